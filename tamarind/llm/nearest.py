"""Approximate nearest neighbours by shifted space-filling curves.

Each distinct vector is projected to a few dimensions, several times, by random orthonormal directions with a random shift of the
grid, and every projection is ordered along a Hilbert curve.  The orderings are range-partitioned, ranks are cut into
blocks of bounded size, and a query goes to the blocks that its window of neighbouring ranks touches.  There it is
compared with the window's vectors by exact cosine; the best of all windows and curves are merged.

How wide windows have to be depends on the vectors, so it is measured: for a bounded sample of queries the true
neighbours are found by brute force, and for each number of curves from ``FEWEST`` on the least width at which they bring
``recall`` of those together; the cheapest of these pairs, by comparisons and by vectors that are moved, is taken, with windows of
at least ``LEAST`` ranks on either side.
Vectors without structure need windows that are a large share of the table; nothing is dropped then, it only costs more.

Before any product, a vector is divided by the power of two next to its largest component, which changes no digit, so that
very large and small components neither overflow nor vanish.

Special input: vectors that are null, zero, empty or hold a null or non-finite component take no part; a vector that is shorter than others is compared as if zeros
followed; equal vectors are one point on the curves, and each stands for its least ids; rows that repeat an id and
vector count once, and a query's own id is never its neighbour; ids that are null take no part; equal scores go to the
lesser id; an empty table gives no rows; fewer candidates than asked for give fewer ranks; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .workspace import join_by_key, new_dir, stored

#: Curves, at most and at least; dimensions and bits of their grids.
CURVES, FEWEST, DIMS, BITS = 5, 3, 4, 12
#: Ranks of a block, which one task holds at a time; the least window; sample of queries, by which windows are measured.
BLOCK, LEAST, SAMPLE = 1024, 512, 96
RECALL = 0.96
#: Comparisons that cost as much as placing one vector on one more curve: sorting its key, and sending it to its block.
MOVE = 300
#: Scores that differ by no more are told apart by the exact sum alone.
ROUNDING = 1e-9


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points on a grid, (n, dims) of ``bits`` bits each: first undoes the rotations
    of each level, then the Gray code, then interleaves the bits."""
    x = cells.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        p = q - one
        for i in range(len(x)):
            turn = (x[i] & q) != 0
            swap = np.where(turn, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(turn, p, swap)
            if i:
                x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    gray = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        gray ^= np.where((x[-1] & np.uint64(1 << b)) != 0, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= gray
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = key << one | (row >> np.uint64(b)) & one
    return key.view(np.int64)


class Curves:
    """Projections and shifts, from a seed; sizes of the grid cells, from the spread of unit vectors."""

    def __init__(self, length: int, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.dims, self.bits = min(dims, length), bits
        self.directions = [np.linalg.qr(rng.normal(size=(length, self.dims)))[0] for _ in range(curves)]
        self.shifts = rng.random((curves, self.dims))
        self.scale = np.sqrt(length)

    def keys(self, unit: np.ndarray) -> list[np.ndarray]:
        out = []
        for turn, shift in zip(self.directions, self.shifts, strict=True):
            at = np.clip((unit @ turn) * self.scale / 8 + 0.5, 0, 1)  # eight standard deviations
            out.append(hilbert(((at + shift) / 2 * ((1 << self.bits) - 1)).astype(np.int64), self.bits))
        return out


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """Vectors as float64 rows of ``length``, each scaled by a power of two so that its largest component is about 1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == length).all():
        out = values.reshape(len(column), length)
    else:
        out, row = np.zeros((len(column), length)), np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return np.ldexp(out, -np.frexp(np.abs(out).max(axis=1, initial=0))[1][:, None])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T) / (np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1)))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows, each summed from the first component to the last, whatever stands beside it."""

    def summed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for i in range(x.shape[1]):
            out += x[:, i] * y[:, i]
        return out

    return np.clip(summed(a, b) / np.sqrt(summed(a, a) * summed(b, b)), -1, 1)


def best_of(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of everything that is among its row's k greatest, or ties with them within rounding; -2 is nothing."""
    if score.shape[1] > k:
        line = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        return np.nonzero((score >= line[:, None] - ROUNDING) & (score > -1.5))
    return np.nonzero(score > -1.5)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    some = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    return some.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0))


def brute_force(points: DataFrame, sample: np.ndarray, own: np.ndarray, k: int) -> list[list[int]]:
    """The k nearest other points of each sampled one, by reading all points once."""
    length = sample.shape[1]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, score = batch.column("point").to_numpy(), cosines(sample, matrix(batch.column("vector"), length))
            score[own[:, None] == ids] = -2
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            q = np.repeat(np.arange(len(own)), top.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids[top].ravel()), pa.array(score[q, top.ravel()])], ["q", "point", "score"])

    # Spark cuts each task's rows to the first k of a query before it shuffles them.
    found = points.mapInArrow(near, "q long, point long, score double").filter("score > -1.5")
    rank = F.row_number().over(W.Window.partitionBy("q").orderBy(F.desc("score"), "point"))
    best = found.withColumn("rank", rank).filter(f"rank <= {k}").collect()
    out: list[list[int]] = [[] for _ in own]
    for r in best:
        out[r.q].append(r.point)
    return out


def ranked(points: DataFrame, curves: Curves) -> tuple[DataFrame, int]:
    """(point, curve, rank) of every point on every curve, and how many points there are."""
    spark, length = points.sparkSession, len(curves.directions[0])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = matrix(batch.column("vector"), length)
            for c, key in enumerate(curves.keys(m / np.sqrt((m * m).sum(axis=1))[:, None])):
                yield pa.RecordBatch.from_arrays([batch.column("point"), pa.array(np.full(len(key), c)), pa.array(key)], ["point", "curve", "key"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("point"), batch.column("curve"), pa.array(np.full(n, part)), pa.array(np.arange(done, done + n))], ["point", "curve", "part", "nth"])
            done += n

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["curve", "key", "point"]
    sorted_ = points.mapInArrow(keys, "point long, curve long, key long").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = stored(sorted_.mapInArrow(number, "point long, curve long, part long, nth long"), new_dir(spark, "curves"))
    sizes = placed.groupBy("part").count().orderBy("part").collect()  # one row a partition
    before, total = [], 0
    for r in sizes:
        before.append((r["part"], total))
        total += r["count"]
    n = total // len(curves.directions)
    offsets = F.broadcast(spark.createDataFrame(before, "part long, before long"))
    return placed.join(offsets, "part").select("point", "curve", (F.col("before") + F.col("nth") - F.col("curve") * n).alias("rank")), n


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, curves: int = CURVES, width: int | None = None) -> DataFrame:
    """The k nearest rows by cosine of every row for which ``is_query`` (a condition on vec_id) holds.

    Returns query_id, rank, vec_id, score.  ``width`` (ranks on either side) is measured unless given.
    """
    spark = vectors.sparkSession
    some = usable(vectors, id_col, vector_col)
    hashed = some.select("vec_id", "vector", F.xxhash64("vector").alias("a"), F.hash("vector").alias("b"))
    marks = stored(hashed.groupBy("vec_id", "a", "b").agg((F.count("*") > 1).alias("twice")), new_dir(spark, "marks"))
    # The least k + 1 ids of each vector are all that can be among someone's k nearest.  Spark limits each task's rows first.
    by_salt = W.Window.partitionBy("a", "b", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    by_vector = W.Window.partitionBy("a", "b").orderBy("vec_id")
    least = marks.drop("twice").withColumn("nth", F.row_number().over(by_salt)).filter(f"nth <= {k + 1}").withColumn("nth", F.row_number().over(by_vector)).filter(f"nth <= {k + 1}")
    least = stored(least, new_dir(spark, "ids"))
    point = least.filter("nth = 1").select("a", "b", F.col("vec_id").alias("point"))
    ids = least.join(point, ["a", "b"]).select("point", "vec_id")
    # A vector may be that of very many queries.
    wanted = marks.filter(is_query).select(F.col("vec_id").alias("query_id"), F.struct("a", "b").alias("own"))
    owners = wanted.groupBy("own").agg(F.count("*").alias("many")).join(point.select(F.struct("a", "b").alias("own"), "point"), "own")
    owners = stored(owners, new_dir(spark, "owners"))
    queries = stored(join_by_key(wanted, owners, "own", "many", marks.count()).select("query_id", "point"), new_dir(spark, "queries"))
    # What is known of a point is put together without its vector, which is joined once.
    asked = owners.select("point").withColumn("asked", F.lit(True))
    known = point.withColumnRenamed("point", "vec_id").join(marks, ["a", "b", "vec_id"]).join(asked.withColumnRenamed("point", "vec_id"), "vec_id", "left")
    points = hashed.join(known, ["a", "b", "vec_id"]).select(F.col("vec_id").alias("point"), "vector", F.coalesce("asked", F.lit(False)).alias("asked"), "twice")
    points = stored(points, new_dir(spark, "points"))
    if not points.filter("twice").isEmpty():
        points = stored(points.filter("not twice").unionByName(points.filter("twice").dropDuplicates(["point"])), new_dir(spark, "points"))
    length = points.agg(F.max(F.size("vector"))).first()[0]
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ranks, n = ranked(points.select("point", "vector"), Curves(length, curves))
    if width is None:
        curves, width = measured_width(points, ranks, n, k, recall, curves, length)
        ranks = ranks.filter(F.col("curve") < curves)
    block = F.col("curve") * (n // BLOCK + 2) + F.floor(F.col("at") / BLOCK)
    placed = ranks.join(points, "point")
    rows = placed.select(F.col("curve"), F.col("rank").alias("at"), F.lit(0).alias("kind"), "point", "rank", "vector")
    low, high = F.greatest(F.col("rank") - width, F.lit(0)), F.least(F.col("rank") + width, F.lit(n - 1))
    asks = placed.filter("asked").select("curve", F.explode(F.sequence(F.floor(low / BLOCK) * BLOCK, F.floor(high / BLOCK) * BLOCK, F.lit(BLOCK).cast("long"))).alias("at"), F.lit(1).alias("kind"), "point", "rank", "vector")
    both = rows.unionByName(asks).select(block.alias("block"), "kind", "point", "rank", "vector")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's own vectors come first and are held; queries are compared as they come, a batch at a time."""
        held: list[tuple] = []
        now, merged = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks, kinds, point, rank = (batch.column(x).to_numpy() for x in ("block", "kind", "point", "rank"))
            vector = matrix(batch.column("vector"), length)
            cuts = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(blocks)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if blocks[lo] != now:
                    held, now, merged = [], blocks[lo], None
                if not kinds[lo]:
                    held.append((point[lo:hi], rank[lo:hi], vector[lo:hi]))
                    continue
                if merged is None and held:
                    merged = [np.concatenate(x) for x in zip(*held, strict=True)]
                if merged is None:
                    continue
                own, at, m = merged
                for s in range(lo, hi, 512):
                    part = slice(s, min(s + 512, hi))
                    q, mine = point[part], vector[part]
                    score = cosines(mine, m)
                    score[(np.abs(rank[part][:, None] - at) > width) | (q[:, None] == own)] = -2
                    r, c = best_of(score, k)
                    value = exact(mine[r], m[c])
                    # Of ties the lesser ids stay.
                    order = np.lexsort((own[c], -value, r))
                    r, c, value = r[order], c[order], value[order]
                    first = np.arange(len(r)) - np.searchsorted(r, r) < k
                    yield pa.RecordBatch.from_arrays([pa.array(q[r[first]]), pa.array(own[c[first]]), pa.array(value[first])], ["query", "point", "score"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = both.repartition(parts, "block").sortWithinPartitions("block", "kind").mapInArrow(search, "query long, point long, score double")
    best = found.groupBy("query", "point").agg(F.max("score").alias("score"))
    best = best.withColumn("nth", F.row_number().over(W.Window.partitionBy("query").orderBy(F.desc("score"), "point"))).filter(f"nth <= {k}").drop("nth")

    def itself(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = matrix(batch.column("vector"), length)
                yield pa.RecordBatch.from_arrays([batch.column("point"), batch.column("point"), pa.array(exact(m, m))], ["query", "point", "score"])

    best = stored(best.unionByName(points.filter("asked").select("point", "vector").mapInArrow(itself, "query long, point long, score double")), new_dir(spark, "best"))
    order = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = best.join(ids, "point").select("query", "vec_id", "score").join(owners.select(F.col("point").alias("query"), "many"), "query")
    found = found.groupBy("query").agg(F.max("many").alias("many"), F.collect_list(F.struct("vec_id", "score")).alias("found"))  # at most (k + 1) * (k + 1)
    out = join_by_key(queries.withColumnRenamed("point", "query"), found, "query", "many", n).select("query_id", F.explode("found").alias("x")).select("query_id", "x.*").filter("vec_id != query_id")
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return out.withColumn("rank", F.row_number().over(order)).filter(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def measured_width(points: DataFrame, ranks: DataFrame, n: int, k: int, recall: float, curves: int, length: int) -> tuple[int, int]:
    """(curves, width): of all numbers of curves, each with the least window at which the sampled queries' true neighbours
    stand within it on some curve, for a share of ``recall``, the one that costs least: a window's comparisons for each query, and
    MOVE for each vector that is placed.  The sample is at most SAMPLE queries, the same at every size."""
    asked = points.filter("asked")
    some = asked.orderBy(F.xxhash64("point"), "point").limit(SAMPLE).select("point", "vector").toArrow()
    if not some.num_rows:
        return min(FEWEST, curves), LEAST
    own = some.column("point").to_numpy()
    true = brute_force(points.select("point", "vector"), matrix(some.column("vector"), length), own, k)
    wanted = points.sparkSession.createDataFrame([(x,) for x in sorted({*own.tolist(), *(x for row in true for x in row)})], "point long")
    at: dict[int, dict[int, int]] = {}
    for r in ranks.join(F.broadcast(wanted), "point").collect():  # at most SAMPLE * (k + 1) points
        at.setdefault(r.point, {})[r.curve] = r["rank"]
    apart = np.array([[abs(at[q][c] - at[x][c]) for c in range(curves)] for q, row in zip(own.tolist(), true, strict=True) for x in row])
    if not len(apart):
        return min(FEWEST, curves), LEAST
    widths = [max(LEAST, int(np.sort(apart[:, :c].min(axis=1))[min(len(apart) - 1, int(np.ceil(recall * len(apart))))]) + 1) for c in range(1, curves + 1)]
    many = asked.count()
    cost = [(c + 1) * (many * min(n, 2 * w + BLOCK) + MOVE * n) for c, w in enumerate(widths)]
    few = min(FEWEST, curves) - 1
    best = few + int(np.argmin(cost[few:]))
    return best + 1, widths[best]
