"""Shared storage for intermediate tables, and small helpers every operator uses."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset and Spark runs in local mode, where driver
    and executors are one process, a temporary folder is made and named there; elsewhere that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (master := spark.sparkContext.master).startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tamarind-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Bytes of rows that Python gets at a time: the setting, its default, and what is set instead, so that texts of any length need
#: about the same memory.  A longer row is a batch of its own.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4MB")


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the executors, once a session, so that workers can import it wherever they run."""
    if spark.conf.get(BATCH_BYTES[0]) == BATCH_BYTES[1]:  # Spark's own default
        spark.conf.set(BATCH_BYTES[0], BATCH_BYTES[2])
    context = spark.sparkContext
    if getattr(context, "_tamarind_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    file = os.path.join(tempfile.mkdtemp(prefix="tamarind-"), "tamarind.zip")
    with zipfile.ZipFile(file, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, str(path.relative_to(package.parent)))
    context.addPyFile(file)
    context._tamarind_shipped = True


#: Folders that this process has named, for clear().
_named: list[str] = []


def new_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one.  Operators return DataFrames that read from such folders."""
    _named.append(path := f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return path


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables and archives of this process, once its results have been written elsewhere."""
    while _named:
        remove(spark, _named.pop())


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder through Hadoop's file systems, wherever it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` in the shared folder and reads it again, which cuts its lineage: a lost executor costs only
    the tasks that it was running."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that join_by_key() joins by a broadcast, at most.
HOT_KEYS = 10_000


def join_by_key(rows: DataFrame, groups: DataFrame, key: str, many: str, total: int, least: int = 1000) -> DataFrame:
    """Joins ``rows`` with ``groups`` (one row a key, which has ``many`` of all ``total`` rows).  Keys of at least a
    ten-thousandth of all rows are joined by a broadcast (there are no more than HOT_KEYS of them, whatever the table),
    so that no task gets all rows of a hot key; the others are shuffled."""
    line = max(least, -(-total // HOT_KEYS))
    hot = F.broadcast(groups.filter(F.col(many) >= line))
    cold = rows.join(hot.select(key), key, "left_anti").join(groups.filter(F.col(many) < line), key)
    return rows.join(hot, key).unionByName(cold)


def is_held_out(id_col) -> object:
    """True where crc32 of the id's decimal text leaves 0 modulo 5 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches between rows into pieces of about ``most`` bytes of text, so that vectorised passes stay within
    a bounded memory; a longer text is a piece of its own."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < n:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()  # workers live on, and the next operator shares their memory
