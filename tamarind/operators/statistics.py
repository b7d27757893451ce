"""Exact statistics and other aggregates, as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def analyze(frame: DataFrame, columns: list[str] | None = None, least: bool = False) -> DataFrame:
    """One row a column: column, rows, min, max (as text), distinct, and with ``least`` the least value that isn't NULL.  NULL
    is a value, the least of all.

    All columns are aggregated in one pass, each with partial aggregates before the shuffle.
    """
    columns = columns or [f.name for f in frame.schema if f.dataType.typeName() not in ("array", "map", "struct")]
    aggregates = [F.count("*").alias("rows")]
    for k, c in enumerate(columns):
        col = F.col(f"`{c}`")
        nulls = F.count(F.when(col.isNull(), 1))
        aggregates += [F.when(nulls > 0, None).otherwise(F.min(col).cast("string")).alias(f"min{k}"), F.min(col).cast("string").alias(f"least{k}"), F.max(col).cast("string").alias(f"max{k}"), (F.count_distinct(col) + F.when(nulls > 0, 1).otherwise(0)).alias(f"distinct{k}")]
    wide = frame.agg(*aggregates)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col("rows").alias("rows"), F.col(f"min{k}").alias("min"), F.col(f"max{k}").alias("max"), F.col(f"distinct{k}").cast("long").alias("distinct"), *([F.col(f"least{k}").alias("least")] if least else [])) for k, c in enumerate(columns)))
    return wide.select(F.explode(rows).alias("x")).select("x.*")


def range_count(frame: DataFrame, column: str, low: object, high: object) -> DataFrame:
    """How many rows have low <= column < high."""
    return frame.filter((F.col(column) >= low) & (F.col(column) < high)).agg(F.count("*").alias("n"))


#: Rows of a group whose values are ranked without looking for a bracket first, and the accuracy of the brackets.
RANKED, ACCURACY = 100_000, 10_000


def percentiles(frame: DataFrame, value: str, by: str, shares: tuple[float, ...]) -> DataFrame:
    """``by``, p0, p1 ...: exact percentiles, interpolated between ranks; NULLs have no rank.

    Of a large group only what lies between two approximate percentiles around the wanted one is ranked, by distinct
    values with their counts, so no task gets all values of a group, and a value that very many rows share is one row.
    """
    rows = frame.select(F.col(by).alias("k"), F.col(value).alias("v")).filter("v is not null")
    around = [min(1.0, max(0.0, p + d / ACCURACY)) for p in shares for d in (-2, 2)]
    about = rows.groupBy("k").agg(F.count("*").alias("n"), F.percentile_approx("v", around, ACCURACY).alias("near"))
    large = F.col("n") > RANKED
    brackets = F.array(*(F.struct(F.lit(i).alias("i"), ((F.col("n") - 1) * p).alias("at"), F.when(large, F.col("near")[2 * i]).alias("low"), F.when(large, F.col("near")[2 * i + 1]).alias("high")) for i, p in enumerate(shares)))
    wanted = about.select(F.col("k").alias("_k"), F.explode(brackets).alias("b")).select("_k", "b.*")
    met = rows.join(wanted, F.col("k").eqNullSafe(F.col("_k"))).filter("high is null or v <= high")
    # What lies below a bracket is one row without a value.
    counts = met.withColumn("v", F.when(F.col("low").isNull() | (F.col("v") >= F.col("low")), F.col("v"))).groupBy("k", "i", "v").agg(F.count("*").alias("m"), F.first("at").alias("at"))
    upto = F.sum("m").over(W.Window.partitionBy("k", "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(W.Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto)
    found = ranked.groupBy("k", "i").agg(F.first("at").alias("at"), F.min(F.when(F.col("upto") > F.floor("at"), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil("at"), F.col("v"))).alias("b"))
    value_at = F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))
    return found.groupBy(F.col("k").alias(by)).agg(*(F.max(F.when(F.col("i") == i, value_at)).alias(f"p{i}") for i in range(len(shares))))


def latencies(frame: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Count, mean, median and 99th percentile."""
    keyed = frame if by else frame.withColumn("_all", F.lit(0))
    key, v = by or "_all", F.col(value)
    whole = keyed.groupBy(key).agg(F.count(v).alias("n"), F.avg(v).alias("mean"))
    found = percentiles(keyed, value, key, (0.5, 0.99)).select(F.col(key).alias("_k"), F.col("p0").alias("p50"), F.col("p1").alias("p99"))
    out = whole.join(found, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
    return out if by else out.drop("_all")


def median(frame: DataFrame, value: str) -> DataFrame:
    """The median of a column."""
    return percentiles(frame.withColumn("_all", F.lit(0)), value, "_all", (0.5,)).select(F.col("p0").alias("median"))


def summary_by_kind(frame: DataFrame, kind: str, size: Column) -> DataFrame:
    """Count, bytes and share of all bytes by kind: a log's summary."""
    by = frame.groupBy(kind).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    total = frame.agg(F.sum(size).alias("total"))
    return by.crossJoin(F.broadcast(total)).select(kind, "n", "bytes", (100.0 * F.col("bytes") / F.col("total")).alias("percent"))  # one row


def chain_statistics(versions: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Of a version table: keys, versions, the longest chain, and the mean and total size of values."""
    by = versions.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.octet_length(value)).alias("bytes"))
    return by.agg(F.count("*").alias("keys"), F.sum("n").alias("versions"), F.max("n").alias("longest"), (F.sum("n") / F.count("*")).alias("mean"), F.sum("bytes").alias("bytes"))


def total(frame: DataFrame, value: str) -> DataFrame:
    """A sum that transfers leave as it is."""
    return frame.agg(F.sum(value).alias("total"))
