"""Measurements of the engine: access paths over selectivities, estimates against counts, what indexes cost on writing."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .engine import Engine
from .operators import access, dml
from .plans.parser import parse
from .sources.catalog import Catalog


def median_seconds(work: Callable[[], object], times: int = 3) -> float:
    """The median of some runs after one to warm up."""
    work()
    found = []
    for _ in range(times):
        began = time.perf_counter()
        work()
        found.append(time.perf_counter() - began)
    return statistics.median(found)


def discard(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


@dataclass(frozen=True)
class Point:
    selectivity: float
    scan: float
    index: float
    covering: float


def break_even(catalog: Catalog, index: str, payload: str, shares: tuple[float, ...] = (0.001, 0.01, 0.1, 0.3, 0.6, 1.0), times: int = 3) -> tuple[list[Point], float | None]:
    """Seconds of the three paths for ranges of an index's first column (whole numbers), and the selectivity from
    which on index and fetch are slower than a scan."""
    i = catalog.index(index)
    column = i.columns[0]
    low, high = catalog.read(i.table).agg(F.min(column), F.max(column)).first()
    key = tuple(catalog.table(i.table).key)
    points = []
    for share in shares:
        top = low + max(1, round((high - low + 1) * share))

        def run(kind: str, need: tuple[str, ...], top: int = top) -> float:
            q = access.RangeQuery(i.table, column, low, top, need)
            return median_seconds(lambda: discard(access.run(catalog, q, access.Path(kind, index, 0, 0, ""))), times)

        points.append(Point(share, run("SeqScan", (payload,)), run("IndexScan", (payload,)), run("IndexOnlyScan", key)))
    return points, access.crossover([(p.selectivity, p.scan, p.index) for p in points])


def estimates(catalog: Catalog, table: str, column: str, ranges: list[tuple[object, object]]) -> list[tuple[float, int]]:
    """(estimated rows, rows) of ranges; all ranges are counted in one pass."""
    stats, c = catalog.table(table).stats, F.col(column)
    counts = catalog.read(table).agg(*(F.count(F.when((c >= lo) & (c < hi), 1)).alias(f"n{k}") for k, (lo, hi) in enumerate(ranges))).first()
    rows = stats["rows"] if stats else 0
    return [(rows * access.selectivity(stats, column, lo, hi), counts[k]) for k, (lo, hi) in enumerate(ranges)]


def cost_constants(points: list[Point], rows: int) -> access.CostModel:
    """Costs of a step of each kind from measured paths, a scan's step being 1."""
    full = max(points, key=lambda p: p.selectivity)
    step = full.scan / rows
    index = full.covering / (rows * full.selectivity)
    fetch = max(0.0, full.index / (rows * full.selectivity) - index)
    return access.CostModel(1.0, index / step, fetch / step)


def maintenance_tax(catalog: Catalog, table: str, rows: Callable[[int], list[tuple]], indexes: list[list[str]]) -> list[float]:
    """Seconds of an insert with no index, then with each more of them; ``rows`` makes new rows for a round."""
    found = []
    for k in range(len(indexes) + 1):
        if k:
            catalog.create_index(f"{table}_tax{k}", table, indexes[k - 1])
        began = time.perf_counter()
        dml.insert(catalog, table, rows(k))
        found.append(time.perf_counter() - began)
    return found


def stages(engine: Engine, text: str, times: int = 5) -> dict[str, float]:
    """Seconds of a SELECT by stage: parsing, binding (with the choice of paths), Spark's planning, and running."""

    def planned() -> None:
        frame = engine.query(text)
        frame._jdf.queryExecution().executedPlan()

    parsing = median_seconds(lambda: parse(text), times)
    binding = median_seconds(lambda: engine.bind(parse(text)), times) - parsing
    planning = median_seconds(planned, times) - binding - parsing
    frame = engine.query(text)
    return {"parse": parsing, "bind": max(0.0, binding), "plan": max(0.0, planning), "run": median_seconds(lambda: discard(frame), times)}


def with_and_without(spark: SparkSession, conf: dict[str, str], work: Callable[[], object], times: int = 3) -> tuple[float, float]:
    """Seconds with the settings and without them."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        changed = median_seconds(work, times)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return changed, median_seconds(work, times)


def spilling(spark: SparkSession, frame: DataFrame, by: str, budgets: tuple[int, ...] = (2_000, 1_000_000), times: int = 3) -> dict[int, float]:
    """Seconds of counting each group's rows beside them, by the rows that a task may hold before it spills."""
    held = frame.withColumn("_n", F.count("*").over(W.Window.partitionBy(by)))
    conf = ("spark.sql.windowExec.buffer.in.memory.threshold", "spark.sql.windowExec.buffer.spill.threshold")
    return {rows: with_and_without(spark, dict.fromkeys(conf, str(rows)), lambda: discard(held), times)[0] for rows in budgets}


def order_gain(engine: Engine, text: str, times: int = 3) -> tuple[float, float]:
    """Seconds of a SELECT with ORDER BY as it is planned, and with all its rows sorted."""
    bound = engine.bind(parse(text))
    s = bound.statement
    plain = engine.bind(parse(str(type(s)(**{f: getattr(s, f) for f in s.__dataclass_fields__} | {"order": type(s.order)(), "limit": None})))).frame
    columns = [F.col(f"`{e.column}`").desc_nulls_last() if d else F.col(f"`{e.column}`").asc_nulls_first() for e, d in s.order]
    ordered = plain.orderBy(*columns)
    return median_seconds(lambda: discard(bound.frame), times), median_seconds(lambda: discard(ordered if s.limit is None else ordered.limit(s.limit)), times)


def commits(engine: Engine, table: str, rows: Callable[[int], list[tuple]], n: int) -> tuple[float, float]:
    """Seconds of ``n`` inserts of a row each, and of one insert of as many."""
    began = time.perf_counter()
    for k in range(n):
        dml.insert(engine.catalog, table, [rows(n)[k]])
    single = time.perf_counter() - began
    began = time.perf_counter()
    dml.insert(engine.catalog, table, rows(2 * n)[n:])
    return single, time.perf_counter() - began
