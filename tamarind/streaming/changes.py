"""Structured Streaming over exported versions (key, xmin, deleted, value): an extension of the engine.

A folder of Parquet files of versions is read as a stream.  ``current`` keeps the newest value of each key in the
stream's state; ``apply`` brings a table up to date batch by batch, and doing a batch again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import dml
from ..sources.catalog import Catalog

SCHEMA = "key binary, xmin long, deleted boolean, value binary"


def read_changes(spark: SparkSession, folder: str, schema: str = SCHEMA, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def current(changes: DataFrame) -> DataFrame:
    """The newest version of each key so far (output mode update or complete)."""
    return changes.groupBy("key").agg(F.max("xmin").alias("xmin"), F.max_by(F.struct("deleted", "value"), "xmin").alias("v")).select("key", "xmin", "v.deleted", "v.value")


def windowed(changes: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Changes and deletions by event-time window; windows close once the watermark has passed them."""
    by = changes.withWatermark(time, late).groupBy(F.window(time, width).alias("w"))
    return by.agg(F.count("*").alias("changes"), F.sum(F.col("deleted").cast("long")).alias("deletions")).select(F.col("w.start").alias("start"), "changes", "deletions")


def apply(changes: DataFrame, catalog: Catalog, table: str, checkpoint: str) -> StreamingQuery:
    """Streams rows of a table's own columns with xmin and deleted into it, by primary key."""
    t = catalog.table(table)

    def one(batch: DataFrame, number: int) -> None:
        names = [n for n, _ in t.columns]
        newest = batch.groupBy(*t.key).agg(F.max_by(F.struct("deleted", *names), "xmin").alias("v")).select("v.*").persist()
        try:
            # Only files with rows of the batch are written anew.
            dml.delete(catalog, table, newest.filter("deleted").select(*t.key), missing_ok=True)
            dml.upsert(catalog, table, newest.filter("not deleted").select(*names))
        finally:
            newest.unpersist()

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
