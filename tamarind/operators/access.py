"""Access paths: a full scan, an index projection with a fetch by key, or the projection alone.

The projection is a narrow Parquet table sorted by the index columns, so that a range reads only the row groups that
it touches, and a covering query only its columns.  The small cost model is there to compare paths and for its
break-even selectivity; how each path runs is Catalyst's.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.catalog import FILE, Catalog, File

#: Entries that may be broadcast, by count; key types whose values are the same as literals.
SMALL, RANGED = 200_000, (T.IntegralType, T.DecimalType, T.StringType)


@dataclass(frozen=True)
class CostModel:
    # Measured cost of a step of a scan, of an index, and of a fetch by key.
    scan: float = 1.0
    index: float = 0.6
    fetch: float = 2.4

    @property
    def break_even(self) -> float:
        """The selectivity above which a full scan is cheaper than index and fetch."""
        return self.scan / (self.index + self.fetch)


@dataclass(frozen=True)
class RangeQuery:
    """SELECT need FROM table WHERE low <= column < high; a bound of None is none."""

    table: str
    column: str
    low: object = None
    high: object = None
    need: tuple[str, ...] = ()


@dataclass(frozen=True)
class Path:
    kind: str  # SeqScan, IndexScan, IndexOnlyScan
    index: str | None
    rows: float
    cost: float
    reason: str


def selectivity(stats: dict | None, column: str, low: object, high: object) -> float:
    """The share of rows in a range, as if values were spread evenly; a half if nothing is known."""
    if not stats or column not in stats["columns"]:
        return 0.5
    s, rows = stats["columns"][column], max(1, stats["rows"])
    try:
        least, most = float(stats.get("least", {}).get(column, s["min"])), float(s["max"])
    except (TypeError, ValueError):
        return max(1 / rows, 1 / max(1, s["distinct"]))
    lo, hi = least if low is None else float(low), most + 1 if high is None else float(high)
    width = max(most - least + 1, 1)
    return min(1.0, max(1 / rows, (min(hi, most + 1) - max(lo, least)) / width))


def paths(catalog: Catalog, q: RangeQuery, model: CostModel = CostModel()) -> list[Path]:
    """All paths for a query, the cheapest first.  Without statistics a full scan is chosen."""
    table = catalog.table(q.table)
    rows = float(table.stats["rows"]) if table.stats else 0.0
    share = selectivity(table.stats, q.column, q.low, q.high)
    out = [Path("SeqScan", None, rows * share, rows * model.scan, "reads every row")]
    for i in catalog.indexes_of(q.table):
        if i.columns[0] == q.column:
            covers = set(q.need) <= set(catalog.projection_columns(i))
            cost = rows * share * (model.index + (0 if covers else model.fetch))
            out.append(Path("IndexOnlyScan" if covers else "IndexScan", i.name, rows * share, cost, "the index has all columns" if covers else "one fetch an entry"))
    return sorted(out, key=lambda p: p.cost) if rows else out


def run(catalog: Catalog, q: RangeQuery, path: Path | None = None) -> DataFrame:
    """The query by a path: the cheapest unless one is given.  An index scan first looks up which files hold the rows of its
    entries, and opens only those."""
    path = path or paths(catalog, q)[0]
    c, conditions = F.col(q.column), []
    if q.low is not None:
        conditions.append(c >= F.lit(q.low))
    if q.high is not None:
        conditions.append(c < F.lit(q.high))
    if path.kind == "SeqScan":
        source = catalog.read(q.table)
    elif catalog.table(q.table).path:
        source = catalog.read_index(path.index)
    else:
        source = catalog.open_index(path.index, [(s, [f for f in files if may_hold(f, q.low, q.high)]) for s, files in catalog.index_files(path.index)])
    for condition in conditions:
        source = source.filter(condition)
    if path.kind == "IndexScan":
        source = fetch(catalog, q.table, source)
    return source.select(*q.need)


def may_hold(file: File, low: object, high: object) -> bool:
    """Whether low <= value < high for some value in the file's range; a bound of None is none, unless both are, and NULL is in no range."""
    if low is None and high is None:
        return True
    return file.high is not None and (low is None or file.high >= low) and (high is None or file.low is None or file.low < high)


def fetch(catalog: Catalog, table: str, entries: DataFrame) -> DataFrame:
    """The rows of a table with the primary keys of some entries.  If the entries name their files, those are counted first: of files
    that hold none nothing is read, of the others only row groups within the range of their keys, and a known small number of
    entries goes to the rows, without a shuffle."""
    t = catalog.table(table)
    if FILE not in entries.columns:
        return catalog.read(table).join(entries.select(*t.key).distinct(), t.key, "left_semi")
    lead = t.key[0]
    met = entries.groupBy(FILE).agg(F.count("*").alias("n"), F.min(lead).alias("low"), F.max(lead).alias("high")).collect()  # one row a file
    names = {r[FILE] for r in met}
    base = catalog.open(t, [(s, [f for f in files if f.name in names]) for s, files in catalog.files(table)])
    if met and isinstance(t.schema[lead].dataType, RANGED):
        base = base.filter(F.col(lead).between(min(r.low for r in met), max(r.high for r in met)))
    keys = entries.select(*t.key)
    return base.join(F.broadcast(keys) if sum(r.n for r in met) <= SMALL else keys.distinct(), t.key, "left_semi")


def get(catalog: Catalog, table: str, key: tuple) -> dict | None:
    """The row of a primary key, or None."""
    t = catalog.table(table)
    frame = catalog.read(table)
    for k, v in zip(t.key, key, strict=True):
        frame = frame.filter(F.col(k) == F.lit(v))
    found = frame.limit(1).collect()
    return found[0].asDict() if found else None


def before(columns: list[str], values: tuple):
    """columns < values, by the first column that differs; NULL is the least value, and fewer values are a prefix."""
    out = F.lit(False)
    for k, v in reversed(list(zip(columns, values, strict=False))):
        c = F.col(f"`{k}`")
        out = (c.isNull() | (c < F.lit(v)) if v is not None else F.lit(False)) | (c.eqNullSafe(F.lit(v)) & out)
    return out


def between(frame: DataFrame, columns: list[str], low: tuple, high: tuple | None) -> DataFrame:
    """low <= columns < high, in their order."""
    if low:
        frame = frame.filter(~before(columns, low))
    if high is not None:
        frame = frame.filter(before(columns, high))
    return frame.orderBy(*(F.col(f"`{k}`").asc_nulls_first() for k in columns))


def scan_range(catalog: Catalog, table: str, low: tuple = (), high: tuple | None = None) -> DataFrame:
    """Rows with low <= primary key < high, as tuples (prefixes are allowed), in key order."""
    return between(catalog.read(table), catalog.table(table).key, low, high)


def scan_index(catalog: Catalog, index: str, low: tuple = (), high: tuple | None = None) -> DataFrame:
    """Entries (index columns, primary key) with low <= index columns < high, in their order."""
    return between(catalog.read_index(index), catalog.projection_columns(catalog.index(index)), low, high)


def pull(frame: DataFrame) -> Iterator[tuple]:
    """Rows one by one, a partition at a time; whoever stops taking them stops the work."""
    for r in frame.toLocalIterator():
        yield tuple(r)


def push(frame: DataFrame, row: Callable[[tuple], bool | None]) -> int:
    """Hands rows to a callback until it returns False; how many it was given."""
    n = 0
    for n, r in enumerate(pull(frame), 1):
        if row(r) is False:
            break
    return n


def crossover(points: list[tuple[float, float, float]]) -> float | None:
    """Where the second of two measured curves overtakes the first: points are (selectivity, first, second)."""
    for (x0, a0, b0), (x1, a1, b1) in zip(points, points[1:], strict=False):
        d0, d1 = b0 - a0, b1 - a1
        if d0 <= 0 < d1:
            return x0 + (x1 - x0) * (-d0) / (d1 - d0)
    return None


def sort_cost(rows: float, budget: float | None = None) -> float:
    """n log2 n comparisons, and writing and reading every row once more where they don't fit."""
    return rows * math.log2(max(rows, 2)) + (2 * rows if budget is not None and rows > budget else 0)
