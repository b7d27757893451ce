"""The engine's queries on the driver's tables, and the SQL that gives the same rows elsewhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scenarios
from .functions import keycodec
from .operators import statistics
from .plans.binder import Binder
from .plans.parser import parse
from .sources import versions, workload

#: name: SQL of the engine's own surface; the same text is run elsewhere unless ELSEWHERE has another.
SQL = {
    "point": "select o_orderkey, o_totalprice from orders where o_orderkey = 7",
    "pk_range": "select o_orderkey, o_custkey from orders where o_orderkey >= 10 and o_orderkey < 20",
    "pk_closed_range": "select o_orderkey from orders where o_orderkey >= 10 and 20 >= o_orderkey",
    "secondary_range": "select o_orderkey, o_orderstatus from orders where o_custkey >= 5 and o_custkey < 9",
    "covering_range": "select o_custkey, o_orderkey from orders where o_custkey < 9",
    "filter_or": "select c_custkey from customer where c_nationkey = 3 or c_custkey < 50",
    "filter_kleene": "select c_custkey from customer where (c_nationkey = 3 or null) and c_custkey < 500",
    "star": "select * from nation where n_regionkey <> 2",
    "table_star": "select r.*, n.n_name from nation n join region r on n.n_regionkey = r.r_regionkey",
    "repeated_columns": "select n_name as a, n_regionkey as b, n_name as c from nation where n_nationkey > 20",
    "bool_out": "select n_nationkey, n_regionkey < 2 as low from nation",
    "constants": "select n_nationkey, 1 as one, 'x' as x, true as yes from nation",
    "text_order": "select c_custkey, c_mktsegment from customer where c_mktsegment >= 'B' and c_mktsegment < 'C'",
    "flipped": "select n_nationkey from nation where 10 < n_nationkey",
    "eq_join": "select o.o_orderkey, c.c_name from orders o join customer c on o.o_custkey = c.c_custkey where c.c_nationkey < 5",
    "propagated": "select o.o_orderkey, c.c_custkey from orders o join customer c on o.o_custkey = c.c_custkey and c.c_custkey < 25",
    "theta": "select a.n_nationkey x, b.r_regionkey y from nation a join region b on a.n_regionkey > b.r_regionkey",
    "cross": "select n.n_name, r.r_name from nation n join region r on true",
    "cross_constant": "select n.n_name, r.r_name from nation n join region r on 1 = 1",
    "self": "select a.n_nationkey x, b.n_nationkey y from nation a join nation b on a.n_regionkey = b.n_regionkey",
    "two_keys": "select a.l_orderkey k, a.l_linenumber n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber",
    "equi_extra": "select o.o_orderkey, l.l_linenumber from orders o join lineitem l on o.o_orderkey = l.l_orderkey and o.o_totalprice < l.l_extendedprice",
    "or_cross_rel": "select o.o_orderkey, c.c_custkey from orders o join customer c on o.o_custkey = c.c_custkey where o.o_orderkey < 10 or c.c_nationkey = 3",
    "on_single_side": "select o.o_orderkey, c.c_custkey from orders o inner join customer c on o.o_custkey = c.c_custkey and o.o_orderkey < 50",
    "topk": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10",
    "topk_pk": "select o_orderkey, o_custkey from orders order by o_orderkey limit 10",
    "limit_projection": "select o_orderpriority, o_orderkey from orders order by o_orderkey desc limit 7",
    "multi_sort": "select c_nationkey, c_custkey from customer order by c_nationkey, c_custkey desc",
    "sort_hidden": "select n_name from nation order by n_regionkey, n_nationkey limit 9",
    "sort_expression": "select n_nationkey from nation order by n_regionkey < 2 desc, n_nationkey limit 12",
    "limit_zero": "select n_name from nation limit 0",
    "join_sort_limit": "select o.o_orderkey, c.c_name from orders o join customer c on o.o_custkey = c.c_custkey order by o.o_totalprice desc, o.o_orderkey limit 20",
    "empty": "select o_orderkey from orders where o_orderkey > 100 and o_orderkey < 50",
    "empty_carried": "select o.o_orderkey from orders o join customer c on o.o_custkey = c.c_custkey where o.o_custkey > 100 and c.c_custkey < 50",
    "null_cmp": "select event_id from events where props = null",
}
ELSEWHERE = {
    "topk": "select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey asc nulls first limit 10",
    "null_cmp": "select event_id from events where props = null::varchar",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """The query of a text; columns are called by their bare names, as other engines have them."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound = Binder(lambda name: table(spark, sf_dir, name)).bind(parse(text))
        return bound.frame.toDF(*(n.rpartition(".")[2] for n in bound.names))

    return query


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.analyze(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


def count_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.range_count(table(spark, sf_dir, "lineitem"), "l_orderkey", 10, 200)


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics.latencies(table(spark, sf_dir, "events"), "value", "event_type")
    return found.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p99")))


def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics.summary_by_kind(table(spark, sf_dir, "events"), "event_type", F.octet_length("props").cast("long"))
    return found.withColumn("percent", F.round("percent", 6))


def versions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions: users are keys, event ids transactions, and values over 90 deletions."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("xmin"), (F.col("value") > 90).alias("deleted"), F.col("props").alias("value"))


VERSIONS = "v as (select user_id as key, event_id as xmin, value > 90 as deleted, props as value from events)"


def snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.as_of(versions_of(spark, sf_dir), versions.Snapshot(700, 500, frozenset({550, 650})))


def vacuumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.vacuum(versions_of(spark, sf_dir), 800)


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.chain_statistics(versions_of(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


def key_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = keycodec.encoded_key([(F.col("o_custkey"), "INT", False), (F.col("o_orderpriority"), "TEXT", False)])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.hex(key).alias("key"))


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.events(spark, 5000)


def transfer_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.total(table(spark, sf_dir, "orders").select(F.col("o_custkey")), "o_custkey")


FUNCTIONS = {f.__name__: f for f in (stats, count_in_range, latency, log_summary, snapshot_read, vacuumed, chains, key_codec, generated, transfer_sum)}


def _stats_sql() -> str:
    one = "select '{c}' as \"column\", count(*) as \"rows\", min({c})::varchar as min, max({c})::varchar as max, count(distinct {c}) as \"distinct\" from customer"
    return " union all ".join(one.format(c=c) for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


FUNCTION_SQL = {
    "stats": _stats_sql(),
    "count_in_range": "select count(*) as n from lineitem where l_orderkey >= 10 and l_orderkey < 200",
    "latency": "select event_type, count(value) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.99), 6) as p99 from events group by 1",
    "log_summary": "select event_type, count(*) as n, sum(strlen(props))::bigint as bytes, round(100.0 * sum(strlen(props)) / (select sum(strlen(props)) from events), 6)::double as percent from events group by 1",
    "snapshot_read": f"with {VERSIONS} select key, value from (select key, deleted, value, row_number() over (partition by key order by xmin desc) as nth from v where xmin < 500 or xmin < 700 and xmin not in (550, 650)) where nth = 1 and not deleted",
    "vacuumed": f"with {VERSIONS} select key, xmin, deleted, value from v where xmin >= 800 union all select key, xmin, deleted, value from (select *, row_number() over (partition by key order by xmin desc) as nth from v where xmin < 800) where nth = 1 and not deleted",
    "chains": f"with {VERSIONS}, k as (select key, count(*) as n, sum(strlen(value)) as bytes from v group by key) select count(*) as keys, sum(n)::bigint as versions, max(n) as longest, round(sum(n) / count(*), 6)::double as mean, sum(bytes)::bigint as bytes from k",
    "key_codec": "select o_orderkey, '04' || lpad(hex((o_custkey::hugeint + 9223372036854775808)::ubigint), 16, '0') || '06' || hex(o_orderpriority) || '0000' as key from orders",
    "generated": "select i::decimal(20, 0) as id, i % 1000 as kind, case when i % 100 = 0 then 'c' || lpad((i % 97)::varchar, 3, '0') else 'HN' end as city, 'payload-' || i as payload from range(5000) t(i)",
    "transfer_sum": "select sum(o_custkey)::bigint as total from orders",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: by_sql(v) for k, v in SQL.items()} | FUNCTIONS | scenarios.QUERIES
ORACLES = {k: ELSEWHERE.get(k, v) for k, v in SQL.items()} | FUNCTION_SQL | scenarios.ORACLES
FLAGSHIP = "select o.o_orderkey, c.c_name from orders o join customer c on o.o_custkey = c.c_custkey and c.c_custkey < 25 order by o.o_orderkey limit 10"
