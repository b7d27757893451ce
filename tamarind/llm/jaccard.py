"""N-gram Jaccard join with Bayesian pruning of candidates.

1. Each text becomes its set of word five-grams (64-bit hashes), a MinHash signature and band keys.  Texts with equal
   sets are one class, whose copies are never compared.  A class is known by 128 bits of its set, then by a number.
2. Classes that share a band key are candidates.  Within a bucket, signatures are compared a few values at a time; a
   pair is dropped as soon as the posterior probability that its similarity reaches the threshold falls below the
   tolerance.  Buckets of many classes are cut into blocks and spread over tasks by pairs of blocks.  What survives is
   kept as connections: a pair whose classes are connected already need not be kept too.
3. The texts of each connected group meet once (or, for a group of many texts or bytes, once for each pair of blocks).
   Their pairs are pruned by the same comparison of signatures, and those that survive are verified exactly by their
   sets.  Links are counted there, so no pair is ever a row.

A pair at the threshold shares no band with probability (1 - t**rows)**bands, 3e-6 as set; more similar pairs are
missed far more rarely, and a missed pair is still verified if other links connect its classes.

Hot keys: bands and groups with a ten-thousandth of all rows or more are joined by broadcasts, and what they have is dealt
out in blocks before signatures or texts meet.

Special input: a text of one to four words has one shingle, all its words; null texts and texts without words are
linked with nothing, and each is a class and group of its own; a text of any length is read whole and weighs by its bytes where
blocks are cut; repeated rows are copies; null ids are allowed and are
never a label unless nothing else is; ties of ids go to the least; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .wordscan import mix, scan
from .workspace import join_by_key, new_dir, slices, stored

WORDS = 5
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Signature values compared between two looks at the posterior.
STEP = 16
TOLERANCE = 1e-6
#: Classes of a bucket, texts of a group, and about their bytes, in a block; one task compares two blocks at a time.
BLOCK, TEXTS, BYTES = 1024, 128, 16 << 20
_odd = (mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)).astype(np.uint32)
PLACE = mix(np.arange(11, 11 + WORDS, dtype=np.uint64)) | np.uint64(1)


def shingles(first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Five-gram hashes of many texts' words, as (first, hashes); repeated five-grams stay."""
    size = np.diff(first)
    count = np.where(size >= WORDS, size - WORDS + 1, (size > 0).astype(np.int64))
    row = np.repeat(np.arange(len(size)), count)
    out = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(len(row)) - out[row] + first[row]
    total = np.zeros(len(row), np.uint64)
    short = size[row] < WORDS
    padded = np.append(words, np.zeros(WORDS, np.uint64))
    for k in range(WORDS):
        part = padded[at + k] * PLACE[k]
        if short.any():
            part[short & (size[row] <= k)] = 0
        total += part
    return out, mix(total)


def sets(first: np.ndarray, grams: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct shingles, how many they are, and two 64-bit hashes of the set."""
    own = [np.unique(grams[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    n = np.array([len(x) for x in own], np.int64)
    every, ends, marks = np.concatenate([*own, grams[:0]]), np.cumsum(n), []
    for salt in PLACE[:2]:
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(every ^ salt))])
        marks.append(mix(sums[ends] - sums[ends - n] + n.astype(np.uint64)).view(np.int64))
    return own, n, *marks


def sign(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (distinct shingles), bytes, h1 and h2 (hashes of the set), sig (a byte of each MinHash value), bands."""
    schema = T.StructType([T.StructField("doc_id", documents.schema[id_col].dataType), *(T.StructField(x, T.LongType()) for x in ("n", "bytes", "h1", "h2")), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            first, grams = shingles(*scan(batch.column("text")))
            rows = batch.num_rows
            sig = np.zeros((rows, HASHES), np.uint32)
            full = np.flatnonzero(np.diff(first))
            _, n, h1, h2 = sets(first, grams)
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            if len(full):
                begin = first[full]
                low = (grams >> np.uint64(32)).astype(np.uint32)
                for k in range(HASHES):
                    sig[full, k] = np.minimum.reduceat(low * _odd[2 * k] ^ _odd[2 * k + 1], begin)
            by_band = sig.reshape(rows, BANDS, ROWS).astype(np.uint64)
            mark = np.zeros((rows, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for k in range(ROWS):
                mark = mix(mark * PLACE[k] + by_band[:, :, k])
            offsets = np.zeros(rows + 1, np.int32)
            offsets[1:] = np.cumsum(np.where(n > 0, BANDS, 0))
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(mark[n > 0].ravel().view(np.int64)))
            small = mix(sig.astype(np.uint64)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), size, pa.array(h1), pa.array(h2), pa.array([x.tobytes() for x in small], pa.binary()), bands], schema.names)

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


@lru_cache
def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """By values compared so far (in steps): the least number of equal ones at which the posterior probability of
    reaching the threshold is at least the tolerance.  Uniform prior; unequal values share a byte once in 256."""
    grid = (np.arange(4000) + 0.5) / 4000
    equal = grid + (1 - grid) / 256
    reach = grid >= threshold
    least = []
    for n in range(STEP, HASHES + 1, STEP):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(equal) + (n - m) * np.log1p(-equal + 1e-300)
        weight = np.exp(log - log.max(axis=1, keepdims=True))
        posterior = weight[:, reach].sum(axis=1) / weight.sum(axis=1)
        least.append(int(np.argmax(posterior >= tolerance)))
    return np.array(least)


def hung(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unites the labels of a[i] and b[i] for all i."""
    while True:
        x, y = labels[a], labels[b]
        if (x == y).all():
            return labels
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(labels, high, low)
        while (labels[labels] != labels).any():
            labels = labels[labels]


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by ``key``; a group may not exceed a bounded size."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        same = bool(held) and all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in key)
        cuts = np.flatnonzero(change) + 1
        if held and not same:
            yield pa.Table.from_batches(held)
            held = []
        if len(cuts):
            yield pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]))])
            held = [batch.slice(int(cuts[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def in_blocks(rows: DataFrame, key: str, blocks, salt) -> DataFrame:
    """Adds cell and side: a row of a group that has several blocks goes to a cell for each pair of its block with
    another one and with itself.  A cell of one block compares all its rows, one of two only rows of different sides."""
    spread = rows.withColumn("blocks", F.greatest(F.lit(1), blocks).cast("int"))
    spread = spread.withColumn("side", F.pmod(F.xxhash64(salt, F.lit(7)), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("side", "other").cast("long"), F.greatest("side", "other").cast("long")
    cell = low * F.col("blocks") - F.floor(low * (low - 1) / 2) + high - low
    return spread.withColumn("cell", cell.cast("long")).withColumn("cross", low != high)


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Sends the cells of a group to one task after the other, so that no task gets many of them by chance."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionById(parts, F.pmod(F.pmod(F.xxhash64(key), F.lit(parts)) + F.col("cell"), F.lit(parts)).cast("int"))


def similar(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) that no look at the posterior drops."""
    equal = np.zeros(len(i), np.int64)
    for k, needed in enumerate(least):
        if not len(i):
            break
        part = slice(k * STEP, (k + 1) * STEP)
        equal += (sig[i, part] == sig[j, part]).sum(axis=1)
        keep = equal >= needed
        i, j, equal = i[keep], j[keep], equal[keep]
    return i, j


def connections(buckets: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(a, b) edges that connect all classes whose pairs in a bucket survive the pruning."""
    least = least_matches(threshold, tolerance)

    def compare(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        band, cell, side, cross, node, n = (t.column(x).to_numpy() for x in ("band", "cell", "side", "cross", "node", "n"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
        nodes, own = np.unique(node, return_inverse=True)
        labels = np.arange(len(nodes))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        active, shift = np.arange(len(band)), 1
        while len(active):
            active = active[active + shift < len(band)]
            active = active[(band[active + shift] == band[active]) & (cell[active + shift] == cell[active])]
            i, j = active, active + shift
            shift += 1
            keep = (labels[own[i]] != labels[own[j]]) & (~cross[i] | (side[i] != side[j])) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9)
            i, j = similar(sig, i[keep], j[keep], least)
            if len(i):
                a, b = own[i], own[j]
                low, high = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
                _, one = np.unique(low * len(labels) + high, return_index=True)
                labels = hung(labels, a, b)
                out.append((nodes[a[one]], nodes[b[one]]))
        return (np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])) if out else (nodes[:0], nodes[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["band", "cell"]):
            a, b = compare(t)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return buckets.mapInArrow(run, "a long, b long").distinct()


def verified(members: DataFrame, threshold: tuple[int, int], tolerance: float) -> DataFrame:
    """Exact links within the cells of groups: node, links (weighed by the other class's copies), root (the least node
    that the cell connects it with)."""
    up, down = threshold
    least = least_matches(up / down, tolerance)

    def shared(own: list[np.ndarray]) -> np.ndarray:
        """How many shingles each two of some texts share."""
        row, grams = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own)
        # Shingles that only one text has count for no pair.
        _, number, many = np.unique(grams, return_inverse=True, return_counts=True)
        often = many[number] > 1
        row, number = row[often], np.unique(number[often], return_inverse=True)[1]
        order = np.argsort(number, kind="stable")
        row, number = row[order], number[order]
        both = np.zeros((len(own), len(own)), np.int64)
        width = 2048
        for low in range(0, int(number[-1]) + 1 if len(number) else 0, width):
            part = slice(*np.searchsorted(number, [low, low + width]))
            bits = np.zeros((len(own), width), np.float32)
            bits[row[part], number[part] - low] = 1
            both += (bits @ bits.T).astype(np.int64)
        return both

    def compare(t: pa.Table, out: list) -> None:
        node, side, weight = (t.column(x).to_numpy() for x in ("node", "side", "copies"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
        own, n, *_ = sets(*shingles(*scan(t.column("text").combine_chunks())))
        i, j = np.triu_indices(len(node), 1)
        keep = np.minimum(n[i], n[j]) * down >= np.maximum(n[i], n[j]) * up
        if t.column("cross")[0].as_py():
            keep &= side[i] != side[j]
        i, j = similar(sig, i[keep], j[keep], least)
        # Texts that survivors connect are multiplied out together; other pairs have been dropped.
        labels = hung(np.arange(len(node)), i, j)
        order = np.argsort(labels[i], kind="stable")
        i, j = i[order], j[order]
        links, a, b = np.zeros(len(node), np.int64), [i[:0]], [i[:0]]
        kinds, at = np.unique(labels[i], return_index=True)
        for kind, x, y in zip(kinds, np.split(i, at[1:]), np.split(j, at[1:]), strict=True):
            some = np.flatnonzero(labels == kind)
            both = shared([own[k] for k in some])
            p, q = np.searchsorted(some, x), np.searchsorted(some, y)
            link = (up + down) * both[p, q] >= up * (n[x] + n[y])
            a.append(x[link]), b.append(y[link])
        a, b = np.concatenate(a), np.concatenate(b)
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        out.append((node, links, node_roots(node, a, b)))

    def node_roots(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        order = np.argsort(node)
        place = np.empty(len(node), np.int64)
        place[order] = np.arange(len(node))
        labels = hung(np.arange(len(node)), place[a], place[b])
        return node[order][labels][place]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in groups(batches, ["root", "cell"]):
            root, cell = whole.column("root").to_numpy(), whole.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero((root[1:] != root[:-1]) | (cell[1:] != cell[:-1])) + 1).tolist(), len(root)]
            out: list = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                compare(whole.slice(lo, hi - lo), out)
            split = whole.column("blocks").to_numpy() > 1
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in zip(*out, strict=True)), pa.array(split)], ["node", "links", "root", "split"])

    return members.mapInArrow(run, "node long, links long, root long, split boolean")


def texts_of(members: DataFrame, documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds each class's text.  Ids can repeat with other texts, so the text has to have the class's own set."""
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    wanted = members.select("doc_id").distinct()
    if members.count() <= 300_000:  # ids only: a few MB; beyond, the texts are shuffled
        wanted = F.broadcast(wanted)
    found = texts.join(wanted.withColumnRenamed("doc_id", "wanted"), F.col("doc_id").eqNullSafe(F.col("wanted"))).select("text")
    schema = T.StructType([found.schema["text"], T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            _, _, h1, h2 = sets(*shingles(*scan(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("text"), pa.array(h1), pa.array(h2)], schema.names)

    marked = found.mapInArrow(mark, schema).groupBy("h1", "h2").agg(F.min(F.struct(F.octet_length("text"), "text")).alias("x"))
    return members.join(marked.select("h1", "h2", "x.text"), ["h1", "h2"])


def jaccard_join(documents: DataFrame, threshold: tuple[int, int] = (4, 5), tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Joins a table with itself on the Jaccard similarity of word five-grams, at least threshold[0] / threshold[1].

    Returns a row a document: doc_id; class_id, the least id among texts with the same set of five-grams; n_links, how
    many other documents it is linked with, copies among them; group_id, the least id of all that links connect.
    """
    spark = documents.sparkSession
    signed = stored(sign(documents, id_col, text_col), new_dir(spark, "signed"))
    full = signed.filter("n > 0")
    classes = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min("bytes").alias("bytes"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    # The number is given once, as the table is written; everything after reads it.
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), new_dir(spark, "classes"))
    n_classes = classes.count()
    bands = classes.select("node", F.explode("bands").alias("band"))
    shared = stored(bands.groupBy("band").agg(F.count("*").alias("many")).filter("many > 1"), new_dir(spark, "bands"))
    wanted = join_by_key(bands, shared, "band", "many", n_classes * BANDS).join(classes.select("node", "n", "sig"), "node")
    buckets = in_blocks(wanted, "band", F.ceil(F.col("many") / BLOCK), F.col("node"))
    buckets = dealt(buckets.select("band", "cell", "side", "cross", "node", "n", "sig"), "band").sortWithinPartitions("band", "cell", "n")
    roots = connected_components(connections(buckets, threshold[0] / threshold[1], tolerance)).join(classes.select("node", "h1", "h2", "doc_id", "copies", "bytes", "sig"), "node")
    sizes = stored(roots.groupBy("root").agg(F.count("*").alias("size"), F.sum("bytes").alias("sum")), new_dir(spark, "sizes"))
    members = stored(join_by_key(roots, sizes, "root", "size", n_classes), new_dir(spark, "members"))
    blocks = F.greatest(F.ceil(F.col("size") / TEXTS), F.least(F.ceil(F.col("sum") / BYTES), F.col("size")))
    cells = in_blocks(texts_of(members, documents, id_col, text_col), "root", blocks, F.col("node"))
    cells = dealt(cells.select("root", "cell", "blocks", "side", "cross", "node", "copies", "sig", "text"), "root").sortWithinPartitions("root", "cell")
    links = stored(verified(cells, threshold, tolerance), new_dir(spark, "links"))
    joined = connected_components(links.filter("split").select(F.col("node").alias("a"), F.col("root").alias("b")))
    group = links.filter("not split").select("node", "root").unionByName(joined)
    by_class = classes.select("h1", "h2", "node", "copies", F.col("doc_id").alias("class_id")).join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(group, "node", "left")
    by_class = stored(by_class.select("h1", "h2", "copies", "class_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")), new_dir(spark, "groups"))
    least = stored(by_class.groupBy("root").agg(F.min("class_id").alias("group_id"), F.count("*").alias("many")), new_dir(spark, "least"))
    by_class = join_by_key(by_class, least, "root", "many", n_classes)
    by_class = by_class.select(F.struct("h1", "h2").alias("set"), "copies", "class_id", "group_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    by_class = stored(by_class, new_dir(spark, "labels"))
    found = join_by_key(signed.filter("n > 0").select("doc_id", F.struct("h1", "h2").alias("set")), by_class, "set", "copies", signed.count())
    alone = signed.filter("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("group_id"))
    return found.select("doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"), "group_id").unionByName(alone)
