"""Changes of tables: validated inserts, upserts and deletes, as joins with what is there.

New rows are written first, once, and all checks read what was written; it is committed if they hold and removed if not.  So
a frame that gives other rows when it is computed again can't be checked on some rows and stored with others.  Old rows
are only looked for in files whose key range meets that of the new ones, and a change rewrites only the files with rows that it touches.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BadRow, BindError, DuplicateKey, NoRow, NullInKey
from ..sources.catalog import Catalog, File, Segment, Table, above, file_name
from ..types import SPARK, coerce, kind_of


def same(columns: Sequence[str], left: str, right: str) -> Column:
    """Equality of keys; as in the index, NULL equals NULL."""
    return reduce(Column.__and__, [F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`")) for c in columns])


def checked(table: Table, rows: Sequence[Sequence[object]]) -> list[tuple]:
    """Rows of literals as values of the table's types."""
    out = []
    for row in rows:
        if len(row) != len(table.columns):
            raise BadRow(f"{table.name} has {len(table.columns)} columns, the row {len(row)} values")
        values = []
        for value, (name, kind) in zip(row, table.columns, strict=True):
            if isinstance(value, Decimal):
                value = int(value)
            try:
                values.append(coerce(value, kind, f"column {name}"))
            except BindError as e:
                raise BadRow(str(e)) from e
            if value is None and name in table.key:
                raise NullInKey(f"{name} is part of the primary key")
        out.append(tuple(values))
    return out


def frame_of(catalog: Catalog, table: Table, rows: DataFrame | Sequence[Sequence[object]]) -> DataFrame:
    """Rows as a frame of the table's columns.  A frame needs the table's columns by name, and their types: whole numbers fit INT, and
    UINT as far as none is negative, which is checked where they are written; nothing else is converted."""
    if not isinstance(rows, DataFrame):
        return catalog.spark.createDataFrame(checked(table, rows), table.schema)
    names = [n for n, _ in table.columns]
    if sorted(rows.columns) != sorted(names):
        raise BadRow(f"{table.name} has columns {names}, the rows {rows.columns}")
    given = {f.name: kind_of(f.dataType) for f in rows.schema}
    for name, kind in table.columns:
        if given[name] not in {kind, "void"} and (given[name], kind) != ("INT", "UINT"):
            raise BadRow(f"column {name} is {kind}; the rows have {given[name]}")
    return rows.select(*(F.col(f"`{n}`") for n in names))


def write(catalog: Catalog, table: Table, rows: DataFrame) -> tuple[Segment, DataFrame]:
    """The rows as a segment that isn't committed, if no key is null or given twice and every number fits its column."""
    segment = catalog.written(table.name, rows)
    try:
        written = catalog.open(table, [(segment, segment.files)])
        nulls = {k: F.count(F.when(F.col(f"`{k}`").isNull(), 1)) for k in table.key}
        unfit = {n: F.count(F.when((F.col(f"`{n}`") < 0) | (F.col(f"`{n}`") > F.lit(Decimal(2**64 - 1))), 1)) for n, k in table.columns if k == "UINT"}
        found = list(written.agg(*nulls.values(), *unfit.values()).first())
        for error, what, names in ((NullInKey, "nulls in key column", nulls), (BadRow, "values that don't fit column", unfit)):
            for name in names:
                if n := found.pop(0):
                    raise error(f"{n} {what} {name} of {table.name}")
        for what, columns in [("primary key", table.key), *((f"unique index {i.name}", i.columns) for i in catalog.indexes_of(table.name) if i.unique)]:
            if twice := written.groupBy(*columns).count().filter("count > 1").limit(1).collect():
                raise DuplicateKey(f"{what} {tuple(twice[0])[:-1]} is given twice")
    except BaseException:
        catalog.discard(segment)
        raise
    return segment, written


def meeting(files: list[tuple[Segment, list[File]]], new: Sequence[File]) -> list[tuple[Segment, list[File]]]:
    """Files whose range meets that of some of the new ones."""
    spans = [(above(f.low), above(f.high)) for f in new]
    low, high = min((s[0] for s in spans), default=None), max((s[1] for s in spans), default=None)
    if low is None:
        return []
    return [(s, [f for f in held if above(f.low) <= high and above(f.high) >= low]) for s, held in files]


def touched(catalog: Catalog, table: Table, segment: Segment, written: DataFrame) -> tuple[list[tuple[Segment, list[File]]], DataFrame]:
    """(files that hold a row whose key is among the written ones, those rows' keys)."""
    near = meeting(catalog.files(table.name), segment.files)
    there = catalog.open(table, near).select(*table.key, file_name().alias("_from"))
    found = there.alias("old").join(written.select(*table.key).alias("new"), same(table.key, "old", "new"), "left_semi")
    names = {r["_from"] for r in found.select("_from").distinct().collect()}
    return [(s, [f for f in held if f.name in names]) for s, held in near], found


def insert(catalog: Catalog, name: str, rows: DataFrame | Sequence[Sequence[object]]) -> int:
    """Adds all rows or none."""
    table = catalog.table(name)
    segment, written = write(catalog, table, frame_of(catalog, table, rows))
    try:
        old = catalog.open(table, meeting(catalog.files(name), segment.files)).select(*table.key)
        for what, columns, there in [("primary key", table.key, old), *((f"unique index {i.name}", i.columns, catalog.read_index(i.name).select(*i.columns)) for i in catalog.indexes_of(name) if i.unique)]:
            if found := written.select(*columns).alias("new").join(there.alias("old"), same(columns, "new", "old"), "left_semi").limit(1).collect():
                raise DuplicateKey(f"{what} {tuple(found[0])} exists in {name}")
        catalog.put(name, segment)
    except BaseException:
        catalog.discard(segment)
        raise
    catalog.tidy(name)
    return sum(f.rows for f in segment.files)


def upsert(catalog: Catalog, name: str, rows: DataFrame | Sequence[Sequence[object]]) -> None:
    """Rows replace those of equal primary key; others are added.  Unique indexes hold afterwards."""
    table = catalog.table(name)
    segment, written = write(catalog, table, frame_of(catalog, table, rows))
    try:
        files, _ = touched(catalog, table, segment, written)
        for i in catalog.indexes_of(name):
            if i.unique:
                others = catalog.read_index(i.name).alias("old").join(written.select(*table.key).alias("new"), same(table.key, "old", "new"), "left_anti")
                if others.select(*i.columns).alias("a").join(written.select(*i.columns).alias("b"), same(i.columns, "a", "b"), "left_semi").limit(1).collect():
                    raise DuplicateKey(f"unique index {i.name}")
        dead = [f.name for _, held in files for f in held]
        if dead:
            kept = catalog.open(table, files).alias("old").join(written.select(*table.key).alias("new"), same(table.key, "old", "new"), "left_anti")
            whole = catalog.written(name, kept.unionByName(written))
            catalog.discard(segment)
            segment = whole
        catalog.put(name, segment, dead)
    except BaseException:
        catalog.discard(segment)
        raise
    catalog.tidy(name)


def delete(catalog: Catalog, name: str, keys: DataFrame | Sequence[Sequence[object]], missing_ok: bool = False) -> None:
    """Removes rows by primary key; a key that isn't there is an error (unless ``missing_ok``), and nothing is removed."""
    table = catalog.table(name)
    kinds = dict(table.columns)
    if isinstance(keys, DataFrame):
        wanted = keys.select(*table.key).distinct()
    else:
        values = [tuple(coerce(v, kinds[k], k) for v, k in zip(row, table.key, strict=True)) for row in keys]
        wanted = catalog.spark.createDataFrame(values, ", ".join(f"`{k}` {SPARK[kinds[k]].simpleString()}" for k in table.key)).distinct()
    first = F.col(f"`{table.key[0]}`")
    low, high = wanted.agg(F.min(first), F.max(first)).first()
    near = meeting(catalog.files(name), [File("", 0, low, high)]) if low is not None else []
    there = catalog.open(table, near).select(*table.key, file_name().alias("_from"))
    found = wanted.alias("w").join(there.alias("t"), same(table.key, "w", "t"), "left").select("w.*", "t._from")
    if not missing_ok and (missing := found.filter("_from is null").limit(1).collect()):
        raise NoRow(f"{name} has no row {tuple(missing[0])[:-1]}")
    names = {r["_from"] for r in found.filter("_from is not null").select("_from").distinct().collect()}
    files = [(s, [f for f in held if f.name in names]) for s, held in near]
    if names:
        kept = catalog.open(table, files).alias("t").join(wanted.alias("w"), same(table.key, "t", "w"), "left_anti")
        catalog.put(name, catalog.written(name, kept), sorted(names))
    catalog.tidy(name)
