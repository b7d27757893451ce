"""Tables and indexes as Parquet folders, and a catalog file that names what is committed.

A table is a list of segments: folders whose files are sorted by primary key, written once and never changed.  The catalog keeps, of
each file, its rows and the least and greatest value of the leading key column, so that a range or a top-k opens only the files
that can hold it, and a change rewrites only the files that it touches: those are dead from then on, and what is left of their rows
is in a new segment.  An index has a narrow, sorted projection (its columns, the primary key, and the name of the row's
file) of every segment.  Small segments are merged once there are many.

The catalog is a numbered JSON file in the same file system as the tables.  A commit creates the next number, which fails if
another session has; a failed write leaves the tables as they were.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AlreadyExists, BindError, Conflict, DuplicateKey, NoIndex, NoTable
from ..types import SPARK
from .store import Store

#: The column of an index projection that names the row's file.
FILE = "_file"
#: Segments of a table before they are merged into one; catalog files that are kept.
MOST_SEGMENTS, KEPT = 32, 5
#: Rows of a file, at most: with the sort by key, what a range or a top-k has to open.
ROWS_A_FILE = 1_000_000


@dataclass
class File:
    """rows, and the least and greatest value of the leading column (None: NULL, the least of all)."""

    name: str
    rows: int
    low: object
    high: object


@dataclass
class Segment:
    path: str
    files: list[File] = field(default_factory=list)
    dead: list[str] = field(default_factory=list)
    #: By index, the files of its projection of this segment.
    projections: dict[str, list[File]] = field(default_factory=dict)

    @property
    def live(self) -> list[File]:
        return [f for f in self.files if f.name not in self.dead]


@dataclass
class Index:
    name: str
    table: str
    columns: list[str]
    unique: bool = False


@dataclass
class Table:
    name: str
    columns: list[tuple[str, str]]  # (name, BOOL | INT | UINT | TEXT); empty for outside Parquet
    key: list[str]
    segments: list[Segment] = field(default_factory=list)
    path: str | None = None  # an outside Parquet table
    stats: dict | None = None

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, SPARK[k], n not in self.key) for n, k in self.columns])


def above(value: object) -> tuple:
    """Values in the order of keys: NULL is the least."""
    return (False,) if value is None else (True, value)


def plain(value: object) -> object:
    return int(value) if isinstance(value, Decimal) else value


class Catalog:
    def __init__(self, spark: SparkSession, root: str, rows_a_file: int = ROWS_A_FILE):
        self.spark, self.root, self.store, self.rows_a_file = spark, root, Store(spark, root), rows_a_file
        self.load()

    def load(self) -> None:
        """What is committed: the last catalog file that is whole."""
        self.tables: dict[str, Table] = {}
        self.indexes: dict[str, Index] = {}
        numbers = [int(n[8:-5]) for n in self.store.names() if n.startswith("catalog-") and n.endswith(".json")]
        self.version = max(numbers, default=0)
        for number in sorted(numbers, reverse=True):
            try:
                held = json.loads(self.store.read(f"catalog-{number:09d}.json"))
            except json.JSONDecodeError:
                continue  # its writer was lost
            for t in held["tables"]:
                segments = [Segment(s["path"], [File(**f) for f in s["files"]], s["dead"], {i: [File(**f) for f in x] for i, x in s["projections"].items()}) for s in t["segments"]]
                self.tables[t["name"]] = Table(**t | {"columns": [tuple(c) for c in t["columns"]], "segments": segments})
            self.indexes = {i["name"]: Index(**i) for i in held["indexes"]}
            return

    def commit(self) -> None:
        text = json.dumps({"tables": [asdict(t) for t in self.tables.values()], "indexes": [asdict(i) for i in self.indexes.values()]})
        if not self.store.create(f"catalog-{self.version + 1:09d}.json", text):
            self.load()
            raise Conflict("another session has changed the catalog")
        self.version += 1
        self.store.delete(f"catalog-{self.version - KEPT:09d}.json")

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise NoTable(f"no table {name}")
        return self.tables[name]

    def index(self, name: str) -> Index:
        if name not in self.indexes:
            raise NoIndex(f"no index {name}")
        return self.indexes[name]

    def indexes_of(self, table: str) -> list[Index]:
        return [i for i in self.indexes.values() if i.table == table]

    def register(self, name: str, path: str, key: list[str] | None = None) -> None:
        """Names an existing Parquet table."""
        if name in self.tables:
            raise AlreadyExists(f"table {name} exists")
        self.tables[name] = Table(name, [], key or [], path=path)

    def create_table(self, name: str, columns: list[tuple[str, str]], key: list[str]) -> Table:
        if name in self.tables or name in self.indexes:
            raise AlreadyExists(f"{name} exists")
        names = [c for c, _ in columns]
        if len(set(names)) < len(names):
            raise BindError("a column name is used twice")
        if missing := [k for k in key if k not in names]:
            raise BindError(f"the primary key names no column: {missing[0]}")
        if not key or len(set(key)) < len(key):
            raise BindError("a table needs a primary key of different columns")
        self.tables[name] = Table(name, columns, key)
        self.commit()
        return self.tables[name]

    def create_index(self, name: str, table: str, columns: list[str], unique: bool = False) -> Index:
        """Builds the projection of all segments; a unique index on rows that repeat is refused."""
        if name in self.indexes or name in self.tables:
            raise AlreadyExists(f"{name} exists")
        t = self.table(table)
        frame = self.read(table)
        if missing := [c for c in columns if c not in frame.columns]:
            raise BindError(f"table {table} has no column {missing[0]}")
        if not columns or len(set(columns)) < len(columns):
            raise BindError("an index needs different columns")
        if unique and (twice := frame.groupBy(*columns).count().filter("count > 1").limit(1).collect()):
            raise DuplicateKey(f"{tuple(twice[0])[:-1]} is not unique in {table}")
        index = Index(name, table, columns, unique)
        for segment in t.segments:
            segment.projections[name] = self.write_projection(index, t, segment)
        self.indexes[name] = index
        self.commit()
        return index

    def projection_columns(self, index: Index) -> list[str]:
        return [*index.columns, *(k for k in self.table(index.table).key if k not in index.columns)]

    def projection_path(self, index: Index, segment: Segment) -> str:
        return f"{self.root}/_index/{index.name}/{segment.path.rpartition('/')[2]}"

    def write_projection(self, index: Index, table: Table, segment: Segment) -> list[File]:
        columns = self.projection_columns(index)
        rows = self.open(table, [(segment, segment.files)]).select(*columns, file_name().alias(FILE))
        rows.repartitionByRange(*columns).sortWithinPartitions(*columns).write.mode("overwrite").option("maxRecordsPerFile", self.rows_a_file).parquet(path := self.projection_path(index, segment))
        return self.measured(path, rows.schema, columns[0])

    def measured(self, path: str, schema: T.StructType, column: str) -> list[File]:
        """Rows and range of each file of a folder, in the order of their names, which is that of their keys."""
        frame = self.spark.read.schema(schema).parquet(path)
        c = F.col(column)
        found = frame.groupBy(file_name().alias("file")).agg(F.count("*").alias("n"), F.when(F.count(F.when(c.isNull(), 1)) > 0, None).otherwise(F.min(c)).alias("low"), F.max(c).alias("high")).orderBy("file").collect()
        return [File(r.file, r.n, plain(r.low), plain(r.high)) for r in found]

    def open(self, table: Table, parts: Sequence[tuple[Segment, Sequence[File]]]) -> DataFrame:
        """The rows of some files."""
        paths = [f"{s.path}/{f.name}" for s, files in parts for f in files]
        return self.spark.read.schema(table.schema).parquet(*paths) if paths else self.spark.createDataFrame([], table.schema)

    def files(self, name: str) -> list[tuple[Segment, list[File]]]:
        return [(s, s.live) for s in self.table(name).segments]

    def read(self, name: str) -> DataFrame:
        t = self.table(name)
        return self.spark.read.parquet(t.path) if t.path else self.open(t, self.files(name))

    def index_schema(self, index: Index) -> T.StructType:
        fields = {f.name: f for f in self.table(index.table).schema}
        return T.StructType([*(fields[c] for c in self.projection_columns(index)), T.StructField(FILE, T.StringType())])

    def open_index(self, name: str, parts: Sequence[tuple[Segment, Sequence[File]]]) -> DataFrame:
        """Entries of some files of a projection, with FILE, but for those of rows in dead files."""
        index = self.index(name)
        schema = self.index_schema(index)
        paths = [f"{self.projection_path(index, s)}/{f.name}" for s, files in parts for f in files]
        if not paths:
            return self.spark.createDataFrame([], schema)
        frame = self.spark.read.schema(schema).parquet(*paths)
        dead = [d for s, _ in parts for d in s.dead]
        return frame.filter(~F.col(FILE).isin(dead)) if dead else frame

    def index_files(self, name: str) -> list[tuple[Segment, list[File]]]:
        return [(s, s.projections.get(name, [])) for s in self.table(self.index(name).table).segments]

    def read_index(self, name: str) -> DataFrame:
        index = self.index(name)
        if self.table(index.table).path:
            return self.read(index.table).select(*self.projection_columns(index))
        return self.open_index(name, self.index_files(name)).drop(FILE)

    def written(self, name: str, rows: DataFrame) -> Segment:
        """A new segment, sorted by primary key, with its index projections; not committed yet."""
        t = self.table(name)
        if t.path:
            raise BindError(f"{name} is an outside table and can only be read")
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        rows.select(*(F.col(f"`{n}`").cast(SPARK[k]).alias(n) for n, k in t.columns)).repartitionByRange(*t.key).sortWithinPartitions(*t.key).write.option("maxRecordsPerFile", self.rows_a_file).parquet(path)
        return Segment(path, self.measured(path, t.schema, t.key[0]))

    def discard(self, segment: Segment) -> None:
        """Removes a segment that was written but will not be committed."""
        self.store.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(segment.path), True)

    def put(self, name: str, segment: Segment | None, dead: Sequence[str] = ()) -> None:
        """Commits a new segment, and files that are dead from now on."""
        t = self.table(name)
        before = t.segments
        try:
            if segment:
                for index in self.indexes_of(name):
                    segment.projections[index.name] = self.write_projection(index, t, segment)
            gone = set(dead)
            kept = [Segment(s.path, s.files, sorted({*s.dead, *(f.name for f in s.files if f.name in gone)}), s.projections) for s in before]
            t.segments = [*(s for s in kept if s.live), *([segment] if segment and segment.files else [])]
            self.commit()
        except BaseException:
            t.segments = before  # after a conflict the catalog has another session's table, which stays as it is
            raise

    def tidy(self, name: str) -> None:
        """Merges the segments of a table that has many."""
        if len(self.table(name).segments) > MOST_SEGMENTS:
            self.compact(name)

    def append(self, name: str, rows: DataFrame) -> None:
        self.put(name, self.written(name, rows))

    def replace(self, name: str, rows: DataFrame) -> None:
        """Makes ``rows`` the table's only segment."""
        self.put(name, self.written(name, rows), [f.name for s in self.table(name).segments for f in s.files])

    def compact(self, name: str) -> None:
        """Merges all segments into one."""
        self.replace(name, self.read(name))

    def clean(self, name: str) -> int:
        """Removes folders that the catalog no longer names; no reader of an older state may be at work."""
        known = {s.path.rpartition("/")[2] for s in self.table(name).segments}
        gone = [f"{folder}/{x}" for folder in (name, *(f"_index/{i.name}" for i in self.indexes_of(name))) for x in self.store.names(folder) if x not in known]
        for path in gone:
            self.store.delete(path)
        return len(gone)

    def check(self, name: str) -> int:
        """Rows of the table that an index lacks, and index entries without their row; 0 for a sound table."""
        bad, t = 0, self.table(name)
        for index in self.indexes_of(name):
            columns = self.projection_columns(index)
            rows, entries = self.read(name).select(*columns), self.read_index(index.name)
            bad += rows.exceptAll(entries).count() + entries.exceptAll(rows).count()
        twice = self.read(name).groupBy(*t.key).count().filter("count > 1").count() if t.key else 0
        return bad + twice


def file_name():
    """The name of the file that a row is read from."""
    return F.regexp_extract(F.input_file_name(), "([^/]+)$", 1)
