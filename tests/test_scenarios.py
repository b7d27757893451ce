"""Scenarios against their SQL; paths, orders, ranges and changes of tables."""

import itertools
import random

import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F

from tamarind import scenarios
from tamarind.engine import Engine
from tamarind.errors import BadRow, Conflict, DuplicateKey, NullInKey
from tamarind.operators import access, dml, statistics
from tamarind.plans.binder import Binder
from tamarind.plans.parser import parse


@pytest.fixture(autouse=True)
def own_settings(spark):
    with scenarios.settings(spark):
        yield


@pytest.mark.parametrize("name", sorted(scenarios.QUERIES))
def test_scenario_matches_its_sql(spark, duck, name):
    same_rows(scenarios.QUERIES[name](spark, SF), duck.sql(scenarios.ORACLES[name]))


@pytest.mark.parametrize("nulls", [False, True])
def test_a_whole_sort_is_numbered_as_its_sql_says(spark, duck, tmp_path, nulls):
    """Rows enough that a sort by ranges samples them, in partitions that stay apart."""
    some = spark.range(0, 60_000, 1, 8).select(*(F.when(F.lit(not nulls) | (F.xxhash64("id", F.lit(i)) % 50 != 0), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(3000))).alias(c) for i, c in enumerate(("l_orderkey", "l_partkey", "l_suppkey"))), (F.col("id") / 7).alias("l_extendedprice"))
    some.write.parquet(f"{tmp_path}/lineitem.parquet")
    sql = scenarios.ORACLES["sorted_whole"].replace("from lineitem", f"from '{tmp_path}/lineitem.parquet/*.parquet'")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        same_rows(scenarios.QUERIES["sorted_whole"](spark, str(tmp_path)), duck.sql(sql))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


KINDS = {
    "i int": [1, 5, 6, None], "l long": [2**53, 2**53 + 1, 5, None], "d double": [1320.5, 5.0, float("nan"), None], "f float": [0.1, 5.5, 16777216.0], "m decimal(10,2)": ["5.25", "5.00", None], "u decimal(20,0)": [0, 2**64 - 1, 5],
    "t string": ["a", "B", "é", "", None], "b boolean": [True, False, None], "ts timestamp": ["2024-03-05 00:00:00", "2024-02-01 12:00:00", None], "dt date": ["2024-02-01", "2024-10-01", None],
}
LITERALS = {"t": ["'a'", "'B'", "''", "'é'", "'b'"], "b": ["TRUE", "FALSE"], "ts": ["'2024-03-05'", "'2024-3-5'", "'2024-03-05 00:00:00'", "'2024-2-1'"], "dt": ["'2024-2-1'", "'2024-02-01'", "'2024-10-01'"]}
NUMBERS = ["0", "1", "4", "5", "6", "1320", "1321", "9007199254740992", "9007199254740993", "16777217"]


@pytest.mark.parametrize("column", sorted(KINDS))
def test_ranges_of_every_type_agree_with_spark(spark, column):
    """No conjunction of comparisons loses a row that Spark itself returns."""
    name, kind = column.split(" ", 1)
    frame = spark.createDataFrame([(k, None if v is None else str(v)) for k, v in enumerate(KINDS[column])], "k int, v string").select("k", F.col("v").cast(kind).alias(name))
    frame = frame.cache()
    rng = random.Random(column)
    for _ in range(25):
        parts = [(name, rng.choice(["=", "<", "<=", ">", ">=", "<>"]), rng.choice(LITERALS.get(name, NUMBERS))) for _ in range(2)]
        where = " AND ".join(f"{a} {op} {b}" for a, op, b in parts)
        got = Binder(lambda _: frame).bind(parse(f"SELECT k FROM x WHERE {where}")).frame
        assert sorted(r[0] for r in got.collect()) == sorted(r.k for r in frame.filter(where).collect()), where
    frame.unpersist()


@pytest.fixture(scope="module")
def ordered(spark, tmp_path_factory):
    """Some thousand rows in files of a few hundred, in two inserts whose keys follow one another."""
    with scenarios.settings(spark):
        e = Engine(spark, str(tmp_path_factory.mktemp("paths")))
        e.run("CREATE TABLE t (id INT, v INT, city TEXT, PRIMARY KEY (id))")
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            for low in (0, 2000):
                dml.insert(e.catalog, "t", spark.range(low, low + 2000).select("id", F.when(F.col("id") % 11 > 0, F.col("id") * 7919 % 1000).alias("v"), F.concat(F.lit("c"), F.col("id") % 5).alias("city")))
            e.run_script("CREATE INDEX t_v ON t (v); ANALYZE t")
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        return e


def rows_of():
    return [(i, i * 7919 % 1000 if i % 11 else None, f"c{i % 5}") for i in range(4000)]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def bound(engine, text):
    return engine.bind(parse(text))


def test_ranges_open_few_files(ordered):
    b = bound(ordered, "SELECT id FROM t WHERE id >= 100 AND id < 120")
    assert b.scans[0].kind == "SeqScan" and b.scans[0].files[0] <= 2 < b.scans[0].files[1]
    assert sorted(r[0] for r in b.frame.collect()) == list(range(100, 120))
    b = bound(ordered, "SELECT city FROM t WHERE v = 7")
    assert b.scans[0].kind == "IndexScan" and b.scans[0].files[0] < b.scans[0].files[1]
    assert sorted(r[0] for r in b.frame.collect()) == sorted(c for _, v, c in rows_of() if v == 7)
    assert bound(ordered, "SELECT city FROM t WHERE v >= 0").scans[0].kind == "SeqScan"
    assert bound(ordered, "SELECT id, v FROM t WHERE v >= 0").scans[0].kind == "IndexOnlyScan"


def test_sorts_are_left_out(spark, ordered):
    b = bound(ordered, "SELECT id, v FROM t ORDER BY id")
    assert b.elided and "Sort" not in plan(b.frame) and [r[0] for r in b.frame.collect()] == list(range(4000))
    b = bound(ordered, "SELECT id FROM t WHERE city = 'c3' ORDER BY id")
    assert b.elided and [r[0] for r in b.frame.collect()] == list(range(3, 4000, 5))
    assert not bound(ordered, "SELECT id FROM t ORDER BY id DESC").elided and not bound(ordered, "SELECT id FROM t ORDER BY v, city").elided
    b = bound(ordered, "SELECT city FROM t WHERE v = 7 ORDER BY v")
    assert b.elided and "Sort" not in plan(b.frame)
    # Entries of two segments overlap, so their order is no order of the whole index; one segment's is.
    assert not bound(ordered, "SELECT v, id FROM t ORDER BY v").elided


def test_top_k_opens_few_files(ordered):
    for text, want in {
        "SELECT id, city FROM t ORDER BY id LIMIT 10": [(i, f"c{i % 5}") for i in range(10)], "SELECT id, city FROM t ORDER BY id DESC LIMIT 10": [(i, f"c{i % 5}") for i in range(3999, 3989, -1)],
        "SELECT v, id FROM t ORDER BY v, id LIMIT 5": sorted(((v, i) for i, v, _ in rows_of() if v is None), key=lambda r: r[1])[:5], "SELECT v, id, city FROM t ORDER BY v DESC, id DESC LIMIT 7": sorted(((v, i, c) for i, v, c in rows_of() if v is not None), reverse=True)[:7],
    }.items():
        b = bound(ordered, text)
        assert [tuple(r) for r in b.frame.collect()] == want, text
        assert b.scans[0].files[0] < b.scans[0].files[1], b.physical()
    b = bound(ordered, "SELECT id FROM t WHERE city = 'c1' ORDER BY id LIMIT 3")
    assert [r[0] for r in b.frame.collect()] == [1, 6, 11]


def test_every_path_gives_the_same_rows(spark, ordered):
    plainly = Engine(spark, ordered.catalog.root, indexes=False)
    for where, order in itertools.product(["", " WHERE v < 9", " WHERE v >= 990 AND city = 'c2'", " WHERE id > 3990 AND v > 5", " WHERE v = 3 AND v = 4"], ["", " ORDER BY id", " ORDER BY v, id", " ORDER BY v DESC, id DESC LIMIT 6", " ORDER BY v, id LIMIT 6", " ORDER BY id LIMIT 6"]):
        for columns in ("id, v", "city, v, id"):
            text = f"SELECT {columns} FROM t{where}{order}"
            a, b = ordered.run(text).rows, plainly.run(text).rows
            assert (a == b if order else sorted(a, key=repr) == sorted(b, key=repr)), text


def test_explanations_say_why(ordered):
    text = ordered.run("EXPLAIN SELECT city FROM t WHERE v = 7").explanation
    assert "IndexScan t index=t_v span=[7, 7]" in text and "rows≈" in text and "cost≈" in text and "fetches from about" in text and "beat SeqScan" in text
    text = ordered.run("EXPLAIN SELECT a.id FROM t a JOIN t b ON a.id = b.v").explanation
    assert "HashJoin keys=[(a.id = b.v)] [build]=" in text and "a nested loop costs" in text
    assert "no Sort by=id" in ordered.run("EXPLAIN SELECT id FROM t ORDER BY id").explanation
    found = ordered.run("EXPLAIN ANALYZE SELECT a.id FROM t a JOIN t b ON a.id = b.v ORDER BY a.id").counters
    assert found["build rows"] > 0 and found["probe rows"] > 0 and found["table rows read"] + found["index entries"] > 0 and found["rows sorted"] >= found["rows out"]


def test_changes_rewrite_only_the_files_they_touch(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.run("CREATE TABLE t (id INT, v INT, PRIMARY KEY (id))")
    for low in range(0, 500, 100):
        dml.insert(e.catalog, "t", spark.range(low, low + 100).select("id", (F.col("id") % 7).alias("v")))
    e.run("CREATE INDEX t_v ON t (v)")
    names = lambda: {f.name for s, files in e.catalog.files("t") for f in files}
    before = names()
    dml.upsert(e.catalog, "t", [(150, 99), (151, 99)])
    assert len(before - names()) == 1
    dml.delete(e.catalog, "t", [(150,), (330,)])
    assert len(before & names()) >= 3 and e.catalog.check("t") == 0
    want = {i: i % 7 for i in range(500)} | {151: 99}
    del want[150], want[330]
    assert dict(e.run("SELECT id, v FROM t").rows) == want
    e.catalog.compact("t")
    assert len(e.catalog.table("t").segments) == 1 and dict(e.run("SELECT id, v FROM t").rows) == want and e.catalog.check("t") == 0
    assert e.catalog.clean("t") > 0 and dict(e.run("SELECT id, v FROM t").rows) == want


def test_many_small_inserts_are_merged(spark, tmp_path, monkeypatch):
    from tamarind.sources import catalog

    monkeypatch.setattr(catalog, "MOST_SEGMENTS", 3)
    e = Engine(spark, str(tmp_path))
    e.run("CREATE TABLE t (id INT, PRIMARY KEY (id))")
    for k in range(6):
        e.run(f"INSERT INTO t VALUES ({k})")
    assert len(e.catalog.table("t").segments) <= 3 and sorted(r[0] for r in e.run("SELECT id FROM t").rows) == list(range(6))


def test_frames_are_checked_as_they_are_written(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.run("CREATE TABLE t (id INT, v TEXT, PRIMARY KEY (id))")
    for rows, schema, error in (([(None, "x")], "id long, v string", NullInKey), ([("1", "x")], "id string, v string", BadRow), ([(1, 2.5)], "id long, v double", BadRow), ([(1, "x"), (1, "y")], "id int, v string", DuplicateKey)):
        with pytest.raises(error):
            dml.insert(e.catalog, "t", spark.createDataFrame(rows, schema))
    assert e.catalog.read("t").count() == 0 and not e.catalog.store.names("t")
    # A frame that gives other rows each time is stored as it was checked.
    dml.insert(e.catalog, "t", spark.range(50).select((F.rand() * 2**60).cast("long").alias("id"), F.lit("x").alias("v")))
    assert e.catalog.read("t").count() == 50 and e.catalog.check("t") == 0


def test_two_sessions_do_not_overwrite_each_other(spark, tmp_path):
    a = Engine(spark, str(tmp_path))
    a.run("CREATE TABLE t (id INT, PRIMARY KEY (id))")
    b, fresh = Engine(spark, str(tmp_path)), Engine(spark, str(tmp_path), level="read committed")
    a.run("INSERT INTO t VALUES (1)")
    assert b.run("SELECT id FROM t").rows == [] and fresh.run("SELECT id FROM t").rows == [(1,)]
    with pytest.raises(Conflict):
        b.run("INSERT INTO t VALUES (2)")
    b.run("INSERT INTO t VALUES (2)")  # it has the other's state now
    assert sorted(Engine(spark, str(tmp_path)).run("SELECT id FROM t").rows) == [(1,), (2,)]


def test_entries_and_rows_one_by_one(ordered):
    seen = []
    assert access.push(access.scan_range(ordered.catalog, "t", (5,)), lambda r: seen.append(r[0]) or len(seen) < 4) == 4 and seen == [5, 6, 7, 8]
    entries = list(itertools.islice(access.pull(access.scan_index(ordered.catalog, "t_v")), 3))
    assert [v for v, _ in entries] == [None] * 3
    assert [tuple(r) for r in access.scan_index(ordered.catalog, "t_v", (3,), (4,)).collect()] == sorted((v, i) for i, v, _ in rows_of() if v == 3)
    assert access.scan_index(ordered.catalog, "t_v", (None,), (0,)).count() == sum(v is None for _, v, _ in rows_of())


@pytest.mark.parametrize("ranked", [0, 10**9])
def test_percentiles_are_exact(spark, monkeypatch, ranked):
    monkeypatch.setattr(statistics, "RANKED", ranked)
    rng = random.Random(4)
    rows = [("a", rng.random()) for _ in range(30_000)] + [("b", 5.0) for _ in range(20_000)] + [("b", float(i)) for i in range(15_000)] + [("c", None)]
    got = {r.k: (r.n, r.p50, r.p99) for r in statistics.latencies(spark.createDataFrame(rows, "k string, v double"), "v", "k").collect()}
    import numpy as np

    for k in "ab":
        values = [v for x, v in rows if x == k]
        assert got[k][0] == len(values) and got[k][1:] == pytest.approx((np.percentile(values, 50), np.percentile(values, 99)), rel=1e-12)
    assert got["c"] == (0, None, None)
