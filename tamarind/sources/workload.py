"""Generated tables and traces, by rules that every task applies by itself."""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W


def events(spark: SparkSession, n: int) -> DataFrame:
    """id, kind (id % 1000), city (HN but for every hundredth row), payload: 99 % of the rows share a city."""
    i = F.col("id")
    city = F.when(i % 100 == 0, F.format_string("c%03d", i % 97)).otherwise("HN")
    return spark.range(n).select(i.cast("decimal(20,0)").alias("id"), (i % 1000).alias("kind"), city.alias("city"), F.concat(F.lit("payload-"), i.cast("string")).alias("payload"))


def join_tables(spark: SparkSession, n: int, kinds: int) -> tuple[DataFrame, DataFrame]:
    """ev(id, kind, city, payload), whose cities run against its ids, and dim(kind, name)."""
    i = F.col("id")
    ev = spark.range(n).select(i.cast("decimal(20,0)").alias("id"), (i % kinds).alias("kind"), F.format_string("c%08d", F.lit(n) - i).alias("city"), F.concat(F.lit("payload-"), i.cast("string"), F.lit("-xxxxxxxxxxxxxxxx")).alias("payload"))
    return ev, spark.range(kinds).select(i.alias("kind"), F.format_string("k%02d", i).alias("name"))


def page_trace(kind: str, pages: int, length: int, seed: int = 1, skew: float = 1.1) -> Iterator[int]:
    """Page numbers: uniform, zipf, or zipf with now and then a scan of all pages."""
    rng = random.Random(seed)
    weights = [1 / (k + 1) ** skew for k in range(pages)]
    done = 0
    while done < length:
        if kind == "scan" and rng.random() < 0.001:
            for page in range(min(pages, length - done)):
                yield page
                done += 1
            continue
        yield rng.randrange(pages) if kind == "uniform" else rng.choices(range(pages), weights)[0]
        done += 1


def next_uses(trace: DataFrame) -> DataFrame:
    """When each page of a trace (at, page) is used next: what an optimal replacement goes by."""
    return trace.withColumn("next", F.lead("at").over(W.Window.partitionBy("page").orderBy("at")))


def hit_ratio(trace: list[int], frames: int, policy: str = "lru") -> float:
    """Replays a trace against a pool of frames: lru, clock, lru2, or optimal (which knows the future)."""
    resident: dict[int, list[int]] = {}
    hits, hand, ring, marked = 0, 0, [], {}
    upcoming: dict[int, list[int]] = {}
    for at in range(len(trace) - 1, -1, -1):
        upcoming.setdefault(trace[at], []).append(at)
    for at, page in enumerate(trace):
        upcoming[page].pop()
        if page in resident:
            hits += 1
        elif len(resident) >= frames:
            if policy == "clock":
                while marked[ring[hand]]:
                    marked[ring[hand]] = False
                    hand = (hand + 1) % len(ring)
                victim, ring[hand] = ring[hand], page
                hand = (hand + 1) % len(ring)
            elif policy == "optimal":
                victim = max(resident, key=lambda p: upcoming[p][-1] if upcoming[p] else len(trace))
            elif policy == "lru2":
                victim = min(resident, key=lambda p: (resident[p][-2] if len(resident[p]) > 1 else -1, resident[p][-1]))
            else:
                victim = min(resident, key=lambda p: resident[p][-1])
            del resident[victim]
        elif policy == "clock":
            ring.append(page)
        resident[page] = [*resident.get(page, [])[-1:], at]
        marked[page] = True
    return hits / max(1, len(trace))
