"""Queries that change tables, choose paths or run transactions on the driver's tables, and the SQL of what they leave.

Each works on a database of its own in the folder that the session shares with its executors (``spark.checkpoint.dir``), or,
where none is named, in a temporary one.
"""

from __future__ import annotations

import io
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anomalies, cli, labs
from . import transactions as tx
from .engine import Engine
from .errors import EngineError
from .operators import access, dml, statistics
from .plans.parser import parse
from .sources import versions, workload

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def scenario(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            with settings(spark):
                return f(spark, sf_dir)

        QUERIES[f.__name__], ORACLES[f.__name__] = query, sql
        return f

    return keep


@contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    """The engine's settings of names hold while a scenario is built; the session gets its own back."""
    names = ("spark.sql.caseSensitive", "spark.sql.orderByOrdinal")
    before = {k: spark.conf.get(k) for k in names}
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def new_folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="tamarind-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def database(spark: SparkSession, **options) -> Engine:
    return Engine(spark, new_folder(spark, "db"), **options)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_orders(spark: SparkSession, sf_dir: str, **options) -> Engine:
    """All orders in some forty files, with an index on customers, and statistics."""
    rows = table(spark, sf_dir, "orders").count()
    e = database(spark, rows_a_file=max(1, rows // 40), **options)
    e.run("CREATE TABLE orders (o_orderkey INT, o_custkey INT, o_orderstatus TEXT, o_orderpriority TEXT, PRIMARY KEY (o_orderkey))")
    dml.insert(e.catalog, "orders", table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
    e.run_script("CREATE INDEX orders_cust ON orders (o_custkey); ANALYZE orders")
    return e


def with_nations(spark: SparkSession, sf_dir: str) -> Engine:
    e = database(spark)
    e.run("CREATE TABLE nation (n_nationkey INT, n_name TEXT, n_regionkey INT, PRIMARY KEY (n_nationkey))")
    dml.insert(e.catalog, "nation", table(spark, sf_dir, "nation"))
    e.run_script("CREATE UNIQUE INDEX nation_name ON nation (n_name); CREATE INDEX nation_region ON nation (n_regionkey); ANALYZE nation")
    return e


def planned(e: Engine, text: str, kind: str, elided: bool = False) -> DataFrame:
    """The query, if it is read by the path that the scenario is about."""
    bound = e.bind(parse(text))
    if bound.scans[0].kind != kind or bound.elided != elided:
        raise AssertionError(bound.physical())
    return bound.frame


def made(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# Access paths.


@scenario("select o_orderkey, o_orderstatus from orders where o_custkey >= 5 and o_custkey < 6")
def index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(with_orders(spark, sf_dir), "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey >= 5 AND o_custkey < 6", "IndexScan")


@scenario("select o_custkey, o_orderkey from orders where o_custkey < 9")
def index_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(with_orders(spark, sf_dir), "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey < 9", "IndexOnlyScan")


def numbered(frame: DataFrame) -> DataFrame:
    """Rows with their number in the order in which they come.  They are written once, with their task and place in it, and
    counted and read from there: a sort by ranges draws a sample for them and may cut the rows elsewhere when it runs again."""
    spark, path = frame.sparkSession, new_folder(frame.sparkSession, "numbered")
    placed = frame.withColumn("part", F.spark_partition_id()).withColumn("within", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path)
    first = rows.groupBy("part").agg(F.count("*").alias("n"))
    sizes = sorted((r.part, r.n) for r in first.collect())  # one number a partition
    done, before = 0, []
    for part, n in sizes:
        before.append((part, done))
        done += n
    starts = spark.createDataFrame(before, "part int, before long")
    return rows.join(F.broadcast(starts), "part").withColumn("nth", F.col("before") + F.col("within")).drop("part", "within", "before")


@scenario("select o_orderkey, o_custkey, row_number() over (order by o_orderkey) - 1 as nth from orders")
def sort_elided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(planned(with_orders(spark, sf_dir), "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey", "SeqScan", True))


@scenario("select o_custkey, o_orderkey, row_number() over (order by o_custkey, o_orderkey) - 1 as nth from orders")
def order_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(planned(with_orders(spark, sf_dir), "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderkey", "IndexOnlyScan", True))


@scenario("select o_orderkey, o_custkey from orders order by o_orderkey desc limit 10")
def topk_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(with_orders(spark, sf_dir), "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 10", "SeqScan")


@scenario("select o_orderkey, o_custkey, o_orderstatus from orders order by o_custkey, o_orderkey limit 10")
def topk_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(with_orders(spark, sf_dir), "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderkey LIMIT 10", "IndexScan")


@scenario("select o_custkey, o_orderkey from orders where o_custkey = 7")
def order_of_one_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(with_orders(spark, sf_dir), "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey = 7 ORDER BY o_custkey", "IndexOnlyScan", True)


@scenario("select o_orderkey, o_totalprice from orders where o_totalprice > 1320 and o_totalprice < 1321")
def range_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import by_sql

    return by_sql("select o_orderkey, o_totalprice from orders where o_totalprice > 1320 and o_totalprice < 1321")(spark, sf_dir)


@scenario("select event_id from events where ts >= timestamp '2024-01-05' and ts <= timestamp '2024-10-01'")
def range_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import by_sql

    return by_sql("select event_id from events where ts >= '2024-1-5' and ts <= '2024-10-01'")(spark, sf_dir)


@scenario("select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders where o_orderkey >= 100 and o_orderkey < 300")
def iterated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = with_orders(spark, sf_dir)
    return made(spark, list(access.pull(access.scan_range(e.catalog, "orders", (100,), (300,)))), "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")


@scenario("select o_custkey, o_orderkey from orders where o_custkey >= 10 and o_custkey < 12")
def iterated_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = with_orders(spark, sf_dir)
    return made(spark, list(access.pull(access.scan_index(e.catalog, "orders_cust", (10,), (12,)))), "o_custkey long, o_orderkey long")


@scenario("select o_orderkey from orders order by o_orderkey limit 25")
def callback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    got: list[tuple] = []
    with_orders(spark, sf_dir).stream("SELECT o_orderkey FROM orders ORDER BY o_orderkey", lambda r: got.append(r) or len(got) < 25)
    return made(spark, got, "o_orderkey long")


@scenario("select n_nationkey, n_name from nation where n_regionkey = 1 union all select n_nationkey, n_name from nation where n_regionkey > 2")
def fixed_range_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range by each of the paths that can answer it."""
    c = with_nations(spark, sf_dir).catalog
    by_index = access.run(c, access.RangeQuery("nation", "n_regionkey", 1, 2, ("n_nationkey", "n_name")), access.Path("IndexScan", "nation_region", 0, 0, ""))
    by_scan = access.run(c, access.RangeQuery("nation", "n_regionkey", 3, None, ("n_nationkey", "n_name")), access.Path("SeqScan", None, 0, 0, ""))
    return by_index.unionByName(by_scan)


@scenario("select o.* from (select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders) o join customer c on o.o_orderkey = c.c_custkey where c.c_nationkey = 3")
def fetched_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = with_orders(spark, sf_dir)
    keys = table(spark, sf_dir, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_orderkey"))
    return access.fetch(e.catalog, "orders", keys)


@scenario("select l_orderkey, l_partkey, l_suppkey, row_number() over (order by l_partkey, l_suppkey, l_orderkey, l_extendedprice) as nth from lineitem")
def sorted_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sort of the whole table, by ranges over all tasks; each spills what does not fit."""
    keys = ("l_partkey", "l_suppkey", "l_orderkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice").orderBy(*(F.col(c).asc_nulls_last() for c in keys))
    return numbered(rows.drop("l_extendedprice")).withColumn("nth", F.col("nth") + 1)


# Changes.


@scenario("select * from (values (1, 'a', true), (2, null, false), (3, 'it''s', null)) t(id, v, b)")
def inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = database(spark)
    e.run_script("CREATE TABLE t (id INT, v TEXT, b BOOL, PRIMARY KEY (id)); INSERT INTO t VALUES (1, 'a', TRUE); INSERT INTO t (b, id) VALUES (FALSE, 2); INSERT INTO t (id, v) VALUES (3, 'it''s')")
    return e.query("SELECT * FROM t").select(F.col("id").cast("int").alias("id"), "v", "b")


@scenario("select c_custkey, c_name, c_nationkey::bigint as c_nationkey from customer")
def inserted_in_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers, in two inserts."""
    e, rows = database(spark), table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    e.run("CREATE TABLE c (c_custkey INT, c_name TEXT, c_nationkey INT, PRIMARY KEY (c_custkey))")
    for odd in (0, 1):
        dml.insert(e.catalog, "c", rows.filter(F.col("c_nationkey") % 2 == odd))
    return e.query("SELECT * FROM c")


@scenario("select n_nationkey::bigint as n_nationkey, case when n_regionkey = 1 then lower(n_name) else n_name end as n_name, n_regionkey::bigint as n_regionkey from nation union all select 100, 'new', 9")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = with_nations(spark, sf_dir)
    dml.upsert(e.catalog, "nation", e.catalog.read("nation").filter("n_regionkey = 1").withColumn("n_name", F.lower("n_name")))
    dml.upsert(e.catalog, "nation", [(100, "new", 9)])
    return e.query("SELECT * FROM nation")


@scenario("select n_nationkey::bigint as n_nationkey, n_name from nation where n_nationkey not in (3, 4, 5)")
def deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = with_nations(spark, sf_dir)
    dml.delete(e.catalog, "nation", [(3,), (4,), (5,)])
    return e.query("SELECT n_nationkey, n_name FROM nation")


@scenario("select n_regionkey::bigint as n_regionkey, n_nationkey::bigint as n_nationkey from nation where n_nationkey <> 7 and n_nationkey <> 8 union all select 4, 8")
def index_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of an index after a deletion and a change of an indexed column."""
    e = with_nations(spark, sf_dir)
    dml.delete(e.catalog, "nation", [(7,)])
    dml.upsert(e.catalog, "nation", [(8, "moved", 4)])
    return e.catalog.read_index("nation_region")


@scenario("select 'nation' as name, 0::bigint as bad")
def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the check of rows against indexes finds after changes."""
    e = with_nations(spark, sf_dir)
    dml.upsert(e.catalog, "nation", [(1, "x", 1), (50, "y", 2)])
    dml.delete(e.catalog, "nation", [(2,)])
    return made(spark, [("nation", e.catalog.check("nation"))], "name string, bad long")


#: Statements that are refused, by the kind of their refusal.
REFUSED = {
    "SELECT FROM nation": "SqlSyntaxError", "SELECT n_name FROM nation WHERE n_nationkey = 1.5": "SqlSyntaxError", "SELECT nope FROM nation": "BindError", "SELECT n_name FROM nope": "NoTable",
    "SELECT n_name FROM nation WHERE n_name = 1": "BindError", "SELECT n_name FROM nation WHERE n_name = n_nationkey": "BindError", "SELECT n_name FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey": "BindError",
    "SELECT a.n_name FROM nation a JOIN nation a ON TRUE": "BindError", "SELECT n_name FROM nation WHERE n_nationkey": "BindError", "INSERT INTO nation VALUES (1, 'x', 1)": "DuplicateKey", "INSERT INTO nation VALUES (90, 'A', 1), (90, 'B', 1)": "DuplicateKey",
    "INSERT INTO nation VALUES (NULL, 'x', 1)": "NullInKey", "INSERT INTO nation VALUES (91, 5, 1)": "BadRow", "INSERT INTO nation VALUES (92)": "BindError", "INSERT INTO nation (n_nationkey, n_name) VALUES (93, 'taken'), (94, 'taken')": "DuplicateKey",
    "CREATE TABLE nation (a INT, PRIMARY KEY (a))": "AlreadyExists", "CREATE TABLE t (a INT, a INT, PRIMARY KEY (a))": "BindError", "CREATE UNIQUE INDEX twice ON nation (n_regionkey)": "DuplicateKey", "CREATE INDEX i ON nation (n_name DESC)": "BindError",
}


def values(rows: list[tuple], columns: str) -> str:
    def one(x: object) -> str:
        return str(x) if not isinstance(x, str) else "'" + x.replace("'", "''") + "'"

    return f"select * from (values {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({columns})"


@scenario(values([*REFUSED.items(), ("rows afterwards", "25")], "statement, refusal"))
def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, rows = with_nations(spark, sf_dir), []
    for statement in REFUSED:
        try:
            e.run(statement)
            rows.append((statement, "none"))
        except EngineError as error:
            rows.append((statement, type(error).__name__))
    return made(spark, [*rows, ("rows afterwards", str(e.catalog.read("nation").count()))], "statement string, refusal string")


@scenario(values([("null key", "NullInKey"), ("text for a number", "BadRow"), ("repeated key", "DuplicateKey"), ("a column too few", "BadRow"), ("key that is there", "DuplicateKey"), ("negative unsigned", "BadRow"), ("rows afterwards", "25")], "rows, refusal"))
def refused_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that a table does not take."""
    e = with_nations(spark, sf_dir)
    e.run("CREATE TABLE u (id UINT, PRIMARY KEY (id))")
    schema = "n_nationkey long, n_name string, n_regionkey long"
    cases = {
        "null key": ("nation", [(None, "x", 1)], schema), "text for a number": ("nation", [("60", "x", 1)], "n_nationkey string, n_name string, n_regionkey long"), "repeated key": ("nation", [(60, "x", 1), (60, "y", 1)], schema),
        "a column too few": ("nation", [(60, "x")], "n_nationkey long, n_name string"), "key that is there": ("nation", [(60, "x", 1), (3, "y", 1)], schema), "negative unsigned": ("u", [(-1,)], "id long"),
    }
    out = []
    for what, (name, rows, columns) in cases.items():
        try:
            dml.insert(e.catalog, name, made(spark, rows, columns))
            out.append((what, "none"))
        except EngineError as error:
            out.append((what, type(error).__name__))
    return made(spark, [*out, ("rows afterwards", str(e.catalog.read("nation").count()))], "rows string, refusal string")


@scenario(values([("table", "nation", "n_nationkey,n_name,n_regionkey"), ("index", "nation_name", "n_name"), ("index", "nation_region", "n_regionkey")], "kind, name, columns"))
def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What another session finds in the same folder."""
    e = with_nations(spark, sf_dir)
    c = Engine(spark, e.catalog.root).catalog
    rows = [("table", t.name, ",".join(n for n, _ in t.columns)) for t in c.tables.values()] + [("index", i.name, ",".join(i.columns)) for i in c.indexes.values()]
    return made(spark, rows, "kind string, name string, columns string")


@scenario("select * from (select 'n_nationkey' as \"column\", count(*) as \"rows\", min(n_nationkey)::varchar as min, max(n_nationkey)::varchar as max, count(distinct n_nationkey) as \"distinct\" from nation union all select 'n_name', count(*), min(n_name), max(n_name), count(distinct n_name) from nation union all select 'n_regionkey', count(*), min(n_regionkey)::varchar, max(n_regionkey)::varchar, count(distinct n_regionkey) from nation)")
def analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of a script is its last statement's."""
    e = with_nations(spark, sf_dir)
    result = e.run_script("SELECT n_name FROM nation; ANALYZE nation")
    return made(spark, result.rows, "column string, rows long, min string, max string, distinct long")


PRINTED = {
    "select a.x,b.* from t a inner join u as b on a.x=b.y where (a.x<3 or b.z>='it''s') and b.w != null order by a.x desc limit 5": "SELECT a.x, b.* FROM t AS a JOIN u AS b ON (a.x = b.y) WHERE (((a.x < 3) OR (b.z >= 'it''s')) AND (b.w <> NULL)) ORDER BY a.x DESC LIMIT 5",
    "explain analyze select * from t": "EXPLAIN ANALYZE SELECT * FROM t",
}


@scenario(values([(k, v) for k, v in PRINTED.items()], "statement, printed"))
def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, [(s, str(parse(s))) for s in PRINTED], "statement string, printed string")


@scenario("select n_nationkey || chr(9) || n_name as line from nation where n_regionkey = 2")
def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, out = with_nations(spark, sf_dir), io.StringIO()
    cli.main(["-d", e.catalog.root, "-q", "-b", "4096", "-e", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2"], out)
    return made(spark, [(line,) for line in out.getvalue().splitlines()], "line string")


# Explanations.


@scenario("select 'eq' as what, 'HashJoin' as join, (select count(*) from orders o join nation n on o.o_custkey = n.n_nationkey) as \"rows\" union all select 'theta', 'NestedLoopJoin', (select count(*) from nation a join nation b on a.n_nationkey > b.n_regionkey) union all select 'one row', 'NestedLoopJoin', (select count(*) from nation n join orders o on n.n_nationkey = o.o_orderkey where n.n_nationkey = 3)")
def join_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The algorithm that counts call for, and the rows that the work counters see."""
    e = with_orders(spark, sf_dir)
    e.run("CREATE TABLE nation (n_nationkey INT, n_name TEXT, n_regionkey INT, PRIMARY KEY (n_nationkey))")
    dml.insert(e.catalog, "nation", table(spark, sf_dir, "nation"))
    e.run("ANALYZE nation")
    texts = {
        "eq": "SELECT o.o_orderkey FROM orders o JOIN nation n ON o.o_custkey = n.n_nationkey", "theta": "SELECT a.n_nationkey FROM nation a JOIN nation b ON a.n_nationkey > b.n_regionkey",
        "one row": "SELECT o.o_orderkey FROM nation n JOIN orders o ON n.n_nationkey = o.o_orderkey WHERE n.n_nationkey = 3",
    }
    rows = [(what, e.bind(parse(text)).joins[0].kind, e.run(f"EXPLAIN ANALYZE {text}").counters["rows out"]) for what, text in texts.items()]
    return made(spark, rows, "what string, join string, rows long")


@scenario("select count(*) as entries, count(*) as fetches, count(*) as \"out\" from orders where o_custkey = 5")
def work_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of an index scan, the rows that they fetch, and the rows that come out."""
    e = with_orders(spark, sf_dir)
    index = e.run("EXPLAIN ANALYZE SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey = 5").counters
    fetched = e.run("EXPLAIN ANALYZE SELECT o_orderpriority FROM orders WHERE o_custkey = 5").counters
    entries = min(index["index entries"], index["rows out"])  # Spark reads whole row groups, and filters after
    return made(spark, [(entries, min(fetched["fetches"], fetched["rows out"]), fetched["rows out"])], "entries long, fetches long, out long")


# Laboratories.


@scenario("select 5 as low, 9 as high, count(*) as \"rows\" from orders where o_custkey >= 5 and o_custkey < 9 union all select 0, 100000, count(*) from orders where o_custkey >= 0 and o_custkey < 100000")
def estimated_and_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, ranges = with_orders(spark, sf_dir), [(5, 9), (0, 100000)]
    found = labs.estimates(e.catalog, "orders", "o_custkey", ranges)
    return made(spark, [(lo, hi, n) for (lo, hi), (_, n) in zip(ranges, found, strict=True)], "low int, high int, rows long")


@scenario("select round(1.0 / 3, 9)::double as share, 0.2::double as crossing, (select median(o_totalprice) from orders) as median")
def break_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selectivity at which a scan is cheaper by the cost model, where two measured curves cross, and a median."""
    found = statistics.median(table(spark, sf_dir, "orders"), "o_totalprice")
    return found.select(F.round(F.lit(access.CostModel().break_even), 9).alias("share"), F.round(F.lit(access.crossover([(0.1, 2.0, 1.0), (0.3, 2.0, 3.0)])), 9).alias("crossing"), "median")


@scenario("select event_id as at, user_id as page, lead(event_id) over (partition by user_id order by event_id) as next from events")
def next_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.next_uses(table(spark, sf_dir, "events").select(F.col("event_id").alias("at"), F.col("user_id").alias("page")))


@scenario("select i::decimal(20, 0) as id, i % 20 as kind, 'c' || lpad((4000 - i)::varchar, 8, '0') as city, 'payload-' || i || '-xxxxxxxxxxxxxxxx' as payload, 'k' || lpad((i % 20)::varchar, 2, '0') as name from range(4000) t(i)")
def generated_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, dim = workload.join_tables(spark, 4000, 20)
    return ev.join(dim, "kind").select("id", "kind", "city", "payload", "name")


@scenario("select 'uniform' as kind, 4000::bigint as n, true as ordered union all select 'zipf', 4000, true union all select 'scan', 4000, true")
def replayed_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each kind of trace: its length, and whether no policy beats the one that knows the future."""
    rows = []
    for kind in ("uniform", "zipf", "scan"):
        trace = list(workload.page_trace(kind, 100, 4000))
        best = workload.hit_ratio(trace, 20, "optimal")
        rows.append((kind, len(trace), all(workload.hit_ratio(trace, 20, p) <= best for p in ("lru", "clock", "lru2"))))
    return made(spark, rows, "kind string, n long, ordered boolean")


# Transactions.


@scenario(values([(name, level, str(where[k] == "Y").lower()) for name, (_, where) in anomalies.ANOMALIES.items() for k, level in enumerate(tx.LEVELS)], "anomaly, level, occurs"))
def anomaly_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(name, level, str(anomalies.occurs(name, level)).lower()) for name in anomalies.ANOMALIES for level in tx.LEVELS]
    return made(spark, rows, "anomaly string, level string, occurs string")


@scenario("select 'repeatable read' as level, 4000::bigint as sum union all select 'serializable', 4000")
def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, [(level, anomalies.transfers(level)) for level in tx.LEVELS[2:]], "level string, sum long")


def nations_in_store(spark: SparkSession, sf_dir: str) -> tx.Store:
    s = tx.Store()
    rows = [(b"n%03d" % r.n_nationkey, r.n_name.encode()) for r in table(spark, sf_dir, "nation").collect()]
    s.update(lambda t: [t.put(k, v) for k, v in rows])
    return s


def texts(frame: DataFrame) -> DataFrame:
    return frame.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


NATIONS = "select 'n' || lpad(n_nationkey::varchar, 3, '0') as key, n_name as value from nation"


@scenario(f"select key, case when key = 'n002' then 'changed' else value end as value from ({NATIONS}) where key <> 'n003' union all select 'x', 'new'")
def committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is there after a transaction, an aborted one, and one that failed."""
    s = nations_in_store(spark, sf_dir)
    s.update(lambda t: (t.put(b"n002", b"changed"), t.delete(b"n003"), t.put(b"x", b"new")))
    lost = s.begin()
    lost.put(b"n004", b"lost")
    lost.abort()
    return texts(versions.scan(s.versions(spark), s.snapshot()))


@scenario(NATIONS)
def old_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a transaction sees that began before others committed."""
    s = nations_in_store(spark, sf_dir)
    old = s.begin()
    s.update(lambda t: (t.put(b"n002", b"changed"), t.delete(b"n003"), t.put(b"x", b"new")))
    return texts(versions.scan(s.versions(spark), old.snapshot))


@scenario(f"select key, value from ({NATIONS}) where key >= 'n005' and key < 'n010' and key <> 'n007' union all select 'n005x', 'own'")
def snapshot_with_own_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = nations_in_store(spark, sf_dir)
    pending = made(spark, [(bytearray(b"n007"), True, bytearray()), (bytearray(b"n005x"), False, bytearray(b"own"))], "key binary, deleted boolean, value binary")
    return texts(versions.scan(s.versions(spark), s.snapshot(), pending, b"n005", b"n010"))


@scenario(f"select key, value from ({NATIONS}) where key <> 'n001'")
def pruned_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions that are left after many changes of one key, a deletion and a vacuum."""
    s = nations_in_store(spark, sf_dir)
    name = s.view(lambda t: t.get(b"n005"))
    for k in range(100):
        s.update(lambda t, k=k: t.put(b"n005", b"%d" % k))
    s.update(lambda t: (t.put(b"n005", name), t.delete(b"n001")))
    s.vacuum()
    return texts(s.versions(spark))


@scenario(values([("first committer", "Conflict"), ("ended", "TransactionDone"), ("reserved key", "ReservedKey"), ("long chain", "ChainFull"), ("held lock", "LockTimeout"), ("crossed locks", "Deadlock")], "what, refusal"))
def refused_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tx.Store(timeout=0.2)
    s.update(lambda t: (t.put(b"a", b"1"), t.put(b"b", b"1")))
    x, y = s.begin(), s.begin()
    x.put(b"a", b"2"), y.put(b"a", b"3")
    x.commit()
    old = s.begin()

    def chain() -> None:
        for k in range(100):
            s.update(lambda t, k=k: t.put(b"b", b"%d" % k))

    def blocked() -> None:
        holder, waiter = s.begin(tx.SERIALIZABLE), s.begin(tx.SERIALIZABLE)
        try:
            holder.put(b"a", b"9")
            waiter.get(b"a")
        finally:
            holder.abort(), waiter.abort()

    def crossed() -> None:
        locks, span = tx.Locks(1.0), tx.point
        locks.acquire(1, 1, span(b"a"), True, {1: 1, 2: 2})
        locks.held.append((2, span(b"b"), True))
        locks.waits[1] = {2}  # the first waits for the second, which now asks for what the first has
        locks.acquire(2, 2, span(b"a"), True, {1: 1, 2: 2})

    cases = {"first committer": y.commit, "ended": lambda: x.get(b"a"), "reserved key": lambda: s.begin().put(b"\x00x", b""), "long chain": chain, "held lock": blocked, "crossed locks": crossed}
    rows = []
    for what, work in cases.items():
        try:
            work()
            rows.append((what, "none"))
        except EngineError as error:
            rows.append((what, type(error).__name__))
    old.abort()
    return made(spark, rows, "what string, refusal string")
