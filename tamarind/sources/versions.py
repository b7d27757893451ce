"""Versioned rows as DataFrames: snapshots, pruning and vacuum of a table (key, xmin, deleted, value)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


@dataclass(frozen=True)
class Snapshot:
    """Transactions below ``low`` are visible, those from ``high`` on aren't, those between unless active."""

    high: int
    low: int
    active: frozenset[int] = frozenset()

    def sees(self, xmin: int) -> bool:
        return xmin < self.low or xmin < self.high and xmin not in self.active

    def condition(self, xmin: Column) -> Column:
        between = xmin < self.high
        if self.active:
            between &= ~xmin.isin(*sorted(self.active))
        return (xmin < self.low) | between


def as_of(versions: DataFrame, snapshot: Snapshot) -> DataFrame:
    """key and value of every row that a snapshot sees.  The newest visible version is a partial aggregate, so a key
    with very many versions is no hot group."""
    newest = versions.filter(snapshot.condition(F.col("xmin"))).groupBy("key").agg(F.max_by(F.struct("deleted", "value"), "xmin").alias("v"))
    return newest.filter(~F.col("v.deleted")).select("key", "v.value")


def vacuum(versions: DataFrame, horizon: int) -> DataFrame:
    """The versions that some snapshot from ``horizon`` on can see: those from the horizon on, and of each key the
    newest before it unless that is a deletion."""
    old = versions.filter(F.col("xmin") < horizon)
    newest = old.groupBy("key").agg(F.max("xmin").alias("xmin"), F.max_by(F.struct("deleted", "value"), "xmin").alias("v"))
    kept = newest.filter(~F.col("v.deleted")).select("key", "xmin", "v.deleted", "v.value")
    return versions.filter(F.col("xmin") >= horizon).select("key", "xmin", "deleted", "value").unionByName(kept)


def scan(versions: DataFrame, snapshot: Snapshot, pending: DataFrame | None = None, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
    """A snapshot overlaid with a transaction's own writes (key, deleted, value), in key order, low <= key < high."""
    frame = as_of(versions, snapshot)
    if pending is not None:
        kept = frame.join(pending.select("key"), "key", "left_anti")
        frame = kept.unionByName(pending.filter("not deleted").select("key", "value"))
    if low is not None:
        frame = frame.filter(F.col("key") >= F.lit(bytearray(low)))
    if high is not None:
        frame = frame.filter(F.col("key") < F.lit(bytearray(high)))
    return frame.orderBy("key")


def histories(versions: DataFrame) -> DataFrame:
    """Each version with how many newer ones its key has."""
    newer = F.row_number().over(W.Window.partitionBy("key").orderBy(F.desc("xmin"))) - 1
    return versions.withColumn("newer", newer)
