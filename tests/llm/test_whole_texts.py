"""Long texts, texts without spaces, extreme numbers and other settings change no result; operators against slow versions."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tamarind.llm import language, nearest, quality, sampling, secrets, toxicity, warc
from tamarind.llm import queries as q
from tamarind.llm.workspace import join_by_key, new_dir, ship

WORDS = {"en": "the house is very old and they were walking through green fields".split(), "de": "das haus ist sehr alt und wir gehen durch die felder hinaus".split()}


@pytest.fixture(scope="module")
def long_texts(spark):
    """Documents of some 40 KB, half in either language, half with rude words and shouting."""
    rng = random.Random(1)
    ship(spark)
    rows, labels = [], []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        bad = i // 2 % 2
        words = rng.choices(WORDS[lang], k=7000)
        if bad:
            for _ in range(700):
                words[rng.randrange(len(words))] = rng.choice(["blockhead", "NINCOMPOOP!!!", "scoundrel"])
        rows.append((i, " ".join(words), lang))
        labels.append((i, 1 - bad, bad))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels, rows


def test_a_corpus_of_long_texts_is_learnt_from(long_texts):
    docs, labels, known, rows = long_texts
    assert min(len(t) for _, t, _ in rows) > sampling.LONGEST
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in language.languages(docs).collect()) >= 57
    assert sum(r.predicted == known[r.doc_id][2] for r in toxicity.toxicity(docs, labels).collect()) >= 54
    assert sum(r.predicted == known[r.doc_id][1] for r in quality.quality(docs, labels, 0.5).collect()) >= 54


def test_long_texts_are_sampled_from_end_to_end(spark):
    text = "".join(chr(0x4E00 + i % 5000) for i in range(50_000))
    got = spark.createDataFrame([(text,), ("short",), (None,)], "t string").select(sampling.shortened(F.col("t"), 9000).alias("s")).collect()
    parts = got[0].s.split("\n")
    assert len(parts) == sampling.PARTS and text.startswith(parts[0]) and text.endswith(parts[-1]) and len(got[0].s.encode()) < 9100
    assert [r.s for r in got[1:]] == ["short", None]


def slow_score(model, text):
    """Averages embeddings' numbers n-gram by n-gram, word by word, passage by passage, with no running sums."""
    first, place, words = toxicity.distinct_words(pa.array([text]))
    values = {}
    for own, grams in words.grams(np.arange(len(words.keys))):
        for w, row in zip(own, grams, strict=True):
            values[w] = sum(float(model.table[g]) for g in row) / len(row)
    row = [values[w] for w in place]
    passages = [row[i : i + toxicity.PASSAGE] for i in range(max(1, len(row) - toxicity.PASSAGE + 1))] if row else [[0.0]]
    best = max(sum(p) / max(1, len(p)) for p in passages) + model.bias
    return 1 / (1 + np.exp(-(best * model.scale + model.shift)))


def test_toxicity_matches_a_slow_version(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    texts = [r.text for r in docs.limit(12).collect()] + ["", "one", "x" * 100, "日本語のとても長い文章" * 9, "ÄRGER ärger"]
    assert model.scores(pa.array(texts)) == pytest.approx([slow_score(model, t) for t in texts], abs=1e-5)


def test_n_grams_are_of_characters_in_small_letters():
    def grams(text):
        words = toxicity.distinct_words(pa.array([text]))[2]
        return Counter(g for own, rows in words.grams(np.arange(len(words.keys))) for g in rows.ravel().tolist())

    assert grams("ÜBERZEUGUNG") == grams("überzeugung") and grams("ПРИВЕТ") == grams("привет")
    assert sum(grams("日本語文").values()) == 6 + 5 + 4 + 1  # of one, two and three characters with the ends, and the word
    assert grams("x" * 32 + "nincompoop") != grams("x" * 32 + "sunnymeadow")


def test_secrets_take_time_in_proportion(spark):
    detector = secrets.Detector()
    text = " ".join(f"password: secret{i:06} deadbeef{i:024x} some plain words of a text" for i in range(100_000))
    assert len(text) > 7_000_000
    ship(spark)
    began = time.perf_counter()
    found = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"), detector, redacted="masked").first()
    assert len(found.findings) == 200_000 and time.perf_counter() - began < 60
    assert found.masked.count(secrets.MARK) == 200_000 and "secret0" not in found.masked


def test_candidates_that_differ_in_the_middle_look_different():
    a, b = ("plain-words-and-" * 8 + middle + "-other-words-too" * 7 for middle in ("ghp_Zk39dKq1XwB7fTTm", "nothing-special-here"))
    pictures = [secrets.pictures([(x, *w) for w in secrets.windows(0, len(x))]) for x in (a, b)]
    assert pictures[0].shape == pictures[1].shape and (pictures[0] != pictures[1]).any()


def slow_measures(text):
    """Shares by word, and of the worst stretch, from the definition."""
    data = (text or "").encode()
    inside = [bool(quality.IN_WORD[b]) for b in data]
    starts = [i for i in range(len(data)) if inside[i] and not (i and inside[i - 1])]
    ends = [next((j for j in range(i, len(data)) if not inside[j]), len(data)) for i in starts]
    stops = [*starts[1:], len(data)][: len(starts)]
    out = []

    def add(values):
        n, size = len(values), quality.STRETCH
        mean = sum(values) / max(1, n)
        out.extend([mean, max(sum(values[i : i + size]) / size for i in range(n - size + 1)) if n > size else mean])

    spans = list(zip(starts, ends, stops, strict=True))
    latin = lambda i: i > 0 and data[i - 1] == 0xC3 and 0x80 <= data[i] <= 0x9E
    upper = [sum(quality.UPPER[data[i]] or latin(i) for i in range(a, c)) for a, _, c in spans]
    lower = [bytes(x + 32 if 65 <= x <= 90 else x for x in data[a:b]) for a, b, _ in spans]
    add([min(u, b - a) / (b - a) for u, (a, b, _) in zip(upper, spans, strict=True)])
    add([min(8, sum(bool(quality.SIGNS[x]) for x in data[a:c])) for a, _, c in spans])
    add([float(any(quality.DIGIT[x] for x in data[a:c])) for a, _, c in spans])
    add([min(4, sum(bool(quality.END[x]) for x in data[a:c])) for a, _, c in spans])
    add([float(10 in data[a:c]) for a, _, c in spans])
    add([float(i > 0 and lower[i] == lower[i - 1]) for i in range(len(lower))])
    add([min(b - a, 32) / 8 for a, b, _ in spans])
    n, few = len(spans), 1 - len(set(lower)) / max(1, len(spans))
    return [*out, np.log1p(n) / 8, few, float(n == 0), few * np.log1p(n) / 8]


def test_measures_match_a_slow_version(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(15).collect()] + ["", None, "one", "ÄÖ ab 1", "!!", "a a a a " * 20]
    got = quality.measures(pa.array(texts))
    for row, text in zip(got, texts, strict=True):
        assert row == pytest.approx(slow_measures(text), abs=1e-9), text


def test_non_negative_risk_gradient():
    rng = np.random.default_rng(1)
    p, u = rng.normal(size=(30, 4)), rng.normal(size=(50, 4))
    net = quality.Network(np.zeros(4), np.ones(4), rng, 3)
    prior = 0.4

    def risk():
        gp, gu = net.forward(p)[2], net.forward(u)[2]
        return prior * np.logaddexp(0, -gp).mean() + (np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean())

    zp, hp, gp = net.forward(p)
    zu, hu, gu = net.forward(u)
    parts = [(zp, hp, prior * (quality.sigmoid(gp) - 1) / len(p)), (zu, hu, quality.sigmoid(gu) / len(u)), (zp, hp, -prior * quality.sigmoid(gp) / len(p))]
    slopes = [sum(x) for x in zip(*(net.slopes(*x) for x in parts), strict=True)]
    for weights, slope in zip(net.p, slopes, strict=True):
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        weights[at] += 1e-5
        high = risk()
        weights[at] -= 2e-5
        low = risk()
        weights[at] += 1e-5
        assert slope[at] == pytest.approx((high - low) / 2e-5, rel=1e-3)


def test_language_gradients_of_the_backward_network_and_the_softmax():
    rng = np.random.default_rng(6)
    model = language.LanguageModel(["a", "b"], hidden=3)
    for d in (model.there, model.ahead):
        d.p = [w.astype(np.float64) for w in d.p]
    model.out = [w.astype(np.float64) for w in model.out]
    x, y = rng.integers(97, 110, (7, 4)).astype(np.uint8), np.array([0, 1, 1, 0])

    def loss():
        return -np.log(model.labels(model.states(x).astype(np.float64))[:, y, np.arange(4)]).sum()

    keep = ([], [])
    both = model.states(x, keep)
    p = model.labels(both).astype(np.float64)
    p[:, y, np.arange(4)] -= 1
    errors = model.out[0].T @ p
    flat = p.transpose(1, 0, 2).reshape(2, -1)
    slopes = [*model.ahead.back(keep[1], errors[::-1, 3:]), flat @ both.transpose(1, 0, 2).reshape(6, -1).T, flat.sum(axis=1, keepdims=True)]
    for weights, slope in zip([*model.ahead.p, *model.out], slopes, strict=True):
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        weights[at] += 1e-2
        up = loss()
        weights[at] -= 2e-2
        down = loss()
        weights[at] += 1e-2
        assert slope[at] == pytest.approx((up - down) / 2e-2, rel=0.05)


def slow_language(model, text):
    """Mean probabilities over positions, window by window, one step after another."""
    data, total, n = (text or "").encode(), np.zeros(len(model.names)), 0
    size, around = language.WINDOW, language.AROUND
    for s in range(0, len(data), size):
        codes = [data[i] if 0 <= i < len(data) else 0 for i in range(s - around, s + size + around)]

        def states(d, codes):
            h, out, k = np.zeros(d.hidden), [], d.hidden
            for c in codes:
                x = d.p[0][:, c]
                z, r = (1 / (1 + np.exp(-(x[a : a + k] + d.p[1][a : a + k] @ h))) for a in (0, k))
                h = (1 - z) * h + z * np.tanh(x[2 * k :] + d.p[1][2 * k :] @ (r * h))
                out.append(h)
            return out

        there, ahead = states(model.there, codes), states(model.ahead, codes[::-1])[::-1]
        for i in range(around, around + size):
            if s + i - around < len(data) and language.LETTER[codes[i]]:
                x = model.out[0] @ np.concatenate([there[i], ahead[i]]) + model.out[1][:, 0]
                e = np.exp(x - x.max())
                total, n = total + e / e.sum(), n + 1
    return total / max(1, n)


def test_languages_match_a_slow_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs)
    texts = [r.text[:900] for r in docs.limit(5).collect()] + ["", "ab", "日本" * 50, "x" * 88]
    assert model.probabilities(pa.array(texts)) == pytest.approx(np.stack([slow_language(model, t) for t in texts]), abs=2e-4)


def test_archives_are_the_same_under_any_settings(spark):
    rng = random.Random(2)
    ship(spark)
    pages = [(rng.randrange(10**9), f"u{i}", "".join(rng.choices("abcdefgh <>", k=rng.randrange(20, 400))) if i % 5 else "copied payload " * 10) for i in range(6000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    sums, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, dealt in (("3", 2), ("11", 7)):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            folder = new_dir(spark, "warc")
            files = warc.write_archive(frame.repartition(dealt, F.rand()), folder, 5, 20_000).collect()
            sums.append(sorted((f.name, f.records, f.sha256) for f in files))
            assert len({f.shard for f in files}) == 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sums[0] == sums[1]
    got = warc.read_archive(spark, folder)
    assert got.count() == 6000 and got.filter("record_type = 'revisit'").count() == 1199
    stream = warc.store(folder)[0].open_input_stream(f"{warc.store(folder)[1]}/{sums[0][0][0]}", compression=None)
    records = list(warc.records(stream))
    ids = {f["WARC-Record-ID"] for f, _ in records}
    assert len(ids) == len(records) and all(b.startswith(b"HTTP/1.1 200 OK") for f, b in records if f["WARC-Type"] == "response")
    assert all(f["WARC-Refers-To"].startswith("<urn:uuid:") for f, _ in records if f["WARC-Type"] == "revisit")


def brute_neighbours(rows, ids, k=5):
    """(query, rank, vector) by cosine in exact fractions of each vector's own scale."""
    unit = {i: np.array(v, np.float64) for i, v in rows}
    unit = {i: v / np.abs(v).max() for i, v in unit.items()}
    unit = {i: v / np.sqrt((v * v).sum()) for i, v in unit.items()}
    out = {}
    for i in ids:
        others = sorted((-round(float(unit[i] @ v), 9), j) for j, v in unit.items() if j != i)
        out[i] = [j for _, j in others[:k]]
    return out


def test_neighbours_of_huge_and_tiny_and_parallel_vectors(spark):
    rng = np.random.default_rng(3)
    ship(spark)
    base = rng.normal(size=(60, 4))
    rows = [(i, (v * [1, 1e200, 1e-200][i % 3]).tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[0] * 2.0**i).tolist()) for i in range(1, 30)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.nearest(frame, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect()
    want = brute_neighbours(rows, [0, 50])
    assert {i: [r.vec_id for r in got if r.query_id == i] for i in (0, 50)} == want and want[0] == [101, 102, 103, 104, 105]
    assert all(np.isfinite(r.score) and -1 <= r.score <= 1 for r in got)


def test_neighbours_of_vectors_of_other_lengths(spark):
    ship(spark)
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1])]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [3, 1, 2] and got[1].score == pytest.approx(0.5**0.5)


def test_many_queries_of_one_vector(spark):
    ship(spark)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(1000 + i, [1.0, 2.0, 3.0 + i]) for i in range(1, 9)]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True), 3)
    by = {}
    for r in got.collect():
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert len(by) == 308
    for i in range(300):
        assert [v for _, v in sorted(by[i])] == [x for x in range(5) if x != i][:3]


def test_neighbours_match_their_sql(spark, duck):
    from conftest import same_rows

    same_rows(q.op10_hilbert_neighbours(spark, SF), duck.sql(q.OP10))


@pytest.mark.parametrize("name", ["secret_scan_base", "packing_checked"])
def test_what_sql_can_say(spark, duck, name):
    from conftest import same_rows

    same_rows(q.QUERIES[name](spark, SF), duck.sql(q.ORACLES[name]))


def test_hot_keys_are_joined_alike(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    groups = rows.groupBy("k").agg(F.count("*").alias("many"))
    got = join_by_key(rows, groups, "k", "many", 5000).select("k", "v", "many").collect()
    want = rows.join(groups, "k").select("k", "v", "many").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and max(r.many for r in got) > 1000
