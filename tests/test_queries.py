"""Every query against its SQL, plans, and the entry points."""

import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F

import __spark_entry__
from tamarind.queries import ORACLES, QUERIES, by_sql


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck.sql(ORACLES[name]))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(QUERIES) <= set(__spark_entry__.queries())


def plan(frame):
    return frame._jdf.queryExecution().toString()


def test_predicates_reach_the_scan_and_carry_over(spark):
    text = plan(QUERIES["propagated"](spark, SF))
    assert text.count("LessThan(") >= 2  # on both sides of the join
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text


def test_contradictions_read_nothing(spark):
    for name in ("empty", "empty_carried"):
        assert "FileScan" not in plan(QUERIES[name](spark, SF)).split("== Physical Plan ==")[1]


def test_top_k_has_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["topk"](spark, SF))


def test_joins_agree_whatever_the_algorithm(spark):
    o, c = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "customer"))
    want = sorted(map(tuple, by_sql("select o.o_orderkey, c.c_custkey from orders o join customer c on o.o_custkey = c.c_custkey")(spark, SF).collect()))
    for hint, node in (("broadcast", "BroadcastHashJoin"), ("merge", "SortMergeJoin"), ("shuffle_hash", "ShuffledHashJoin"), ("shuffle_replicate_nl", "CartesianProduct")):
        joined = o.join(c.hint(hint), o.o_custkey == c.c_custkey).select("o_orderkey", "c_custkey")
        assert node in plan(joined)
        assert sorted(map(tuple, joined.collect())) == want


def test_order_of_rows(spark):
    got = [tuple(r) for r in QUERIES["multi_sort"](spark, SF).collect()]
    assert got == sorted(got, key=lambda r: (r[0], -r[1]))


def test_next_uses(spark):
    from tamarind.sources.workload import hit_ratio, next_uses, page_trace

    trace = [1, 2, 1, 3]
    frame = spark.createDataFrame(list(enumerate(trace)), "at long, page long")
    assert [r.next for r in next_uses(frame).orderBy("at").collect()] == [2, None, None, None]
    pages = list(page_trace("zipf", 50, 3000))
    best = hit_ratio(pages, 10, "optimal")
    assert all(0 < hit_ratio(pages, 10, p) <= best for p in ("lru", "clock", "lru2"))
    assert max(page_trace("scan", 5, 100)) < 5 and len(list(page_trace("uniform", 9, 70))) == 70


def test_join_tables(spark):
    from tamarind.sources.workload import join_tables

    ev, dim = join_tables(spark, 400, 20)
    assert ev.join(dim, "kind").count() == 400
    assert ev.orderBy("city").first()["id"] == 399
    assert ev.agg(F.count_distinct("kind")).first()[0] == 20
