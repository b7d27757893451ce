"""The pipeline's stages against brute force on planted cases, and special input."""

import random

import numpy as np
import pytest
from conftest import SF

import corpus_pipeline as cp
from tamarind.llm import queries as q


def test_stages_and_columns(spark):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "secret_scan", "best_fit_packing"]
    assert "pipeline" in __import__("__spark_entry__").queries()


def test_run(spark, duck):
    got = cp.run(spark, SF).toPandas()
    by = got.groupby("sequence_id").length.sum()
    assert (by <= 4096).all() and got.sequence_id.nunique() <= -(-int(got.length.sum()) // 4096) + 1
    ids = {r[0] for r in duck.sql("select doc_id from documents").fetchall()}
    assert set(got.doc_id) < ids and len(set(got.doc_id)) > 0.7 * len(ids)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Documents with planted cases: ids from 100 are copies, 200 near copies, 300 contaminated, 400 hold secrets."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    clean = [(i, " ".join(word() for _ in range(120))) for i in range(40)]
    item = " ".join(word() for _ in range(30))
    rows = clean + [(100 + i, clean[i][1].upper() if i % 2 else clean[i][1]) for i in range(6)]
    rows += [(200 + i, clean[10 + i][1] + " tail") for i in range(6)]
    rows += [(300, clean[20][1][:300] + " " + item), (301, " ".join(word() for _ in range(2000)) + " " + item)]
    rows += [(400, "note " + clean[30][1][:200] + " password = 'sup3rs3cret' end"), (401, None), (402, ""), (None, "x y z"), (None, "x y z")]
    folder = tmp_path_factory.mktemp("planted")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, place string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), str(folder)


def ids(frame):
    return sorted((r.doc_id if r.doc_id is not None else -1) for r in frame.collect())


def test_toxicity_without_labels_keeps_all(spark, planted):
    docs, folder = planted
    kept = cp.drop_toxic(spark, docs, folder)
    assert ids(kept) == ids(docs) and kept.columns == cp.COLUMNS


def test_near_copies(spark, planted):
    docs, folder = planted
    kept = cp.drop_near_copies(spark, docs, folder)
    want = [i for i in ids(docs) if not 100 <= i < 110 and not 200 <= i < 210]
    want.remove(-1)  # of two equal rows without id one stays
    assert ids(kept) == want and kept.columns == cp.COLUMNS


def test_contaminated(spark, planted):
    docs, folder = planted
    kept = cp.drop_contaminated(spark, docs, folder)
    assert ids(kept) == [i for i in ids(docs) if i != 300] and kept.columns == cp.COLUMNS


def test_secrets(spark, planted):
    docs, folder = planted
    got = {r.doc_id: r for r in cp.redact_secrets(spark, docs, folder).collect()}
    assert len(got) == len(set(ids(docs))) and "sup3rs3cret" not in got[400].text and got[400].n_chars == len(got[400].text)
    before = {r.doc_id: r.text for r in docs.collect()}
    assert all(got[i].text == before[i] for i in got if i != 400)


def test_pack(spark, planted):
    docs, folder = planted
    got = cp.pack(spark, docs, folder).toPandas()
    assert len(got) >= docs.count() and (got.groupby("sequence_id").length.sum() <= 4096).all()
    assert all(len(b) == 4 * n for b, n in zip(got.ids, got.length, strict=True))
    assert sum(np.frombuffer(b, "<u4")[-1] == 1 for b in got.ids) == docs.count()


def test_empty_tables(spark, planted):
    docs, folder = planted
    none = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_toxic_documents_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in cp.drop_toxic(spark, docs, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    right = [(i in kept) == (labels[i] == 0) for i in labels]
    assert sum(right) / len(right) > 0.9
    assert q.QUERIES


def test_clear_deletes_intermediate_tables(spark):
    import os

    from tamarind.llm import workspace

    path = workspace.new_dir(spark, "x")
    workspace.stored(spark.range(3), path)
    local = path.removeprefix("file://")
    assert os.path.isdir(local)
    workspace.clear(spark)
    assert not os.path.exists(local)
