"""Benchmark decontamination by a distributed positional inverted index of the training tokens.

The index has one segment for each few megabytes of text: the segment's terms in order, how many postings each has, and
the word positions of all postings, as differences.  A query block of benchmark windows is sent to every segment, where
the lists of a window's terms, each shifted by the term's place in the window, are intersected from the rarest on.  A
window of which one term has no posting in the segment costs nothing more.

Words are the runs of ASCII letters (A-Z as a-z), digits and characters from U+0080 on; terms are 64-bit hashes of
words.  Special input: a null or empty text has no words and no hits; a text of any length is indexed whole, in a segment of its
own if it is longer than those; repeated rows are judged one by one; items without
words match nothing; a null item id counts as the empty text; item ids that repeat count once, as do items with equal texts' windows, which are looked up once; ties between terms that are equally rare go to the first; an empty table of
documents gives no rows, an empty benchmark no hits; other columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .wordscan import BASE, mix, scan
from .workspace import new_dir, slices, stored

WINDOW = 13
#: Postings of the rarest terms that are followed at a time.
EXPANDED = 1 << 20
#: Bytes of benchmark text in one query block; each block is a broadcast of about this size, whatever the benchmark's.
BLOCK = 6 << 20


def positional_index(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = 2 << 20) -> DataFrame:
    """One row a segment: ids of its documents, where each one's words begin, terms, counts and positions."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(documents.schema[id_col].dataType)), *(T.StructField(x, T.BinaryType()) for x in ("first", "terms", "counts", "positions"))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", segment_bytes):
            first, words = scan(batch.column("text"))
            order = np.argsort(words, kind="stable")
            terms, begin, counts = np.unique(words[order], return_index=True, return_counts=True)
            steps = np.diff(order, prepend=0)
            steps[begin] = order[begin]
            ids = batch.column("doc_id")
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            packed = (first.astype("<i8"), terms.astype("<u8"), counts.astype("<u4"), steps.astype("<u4"))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([x.tobytes()], pa.binary()) for x in packed)], schema.names)

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(build, schema)


class Segment:
    """A segment's lists, laid out so that many postings are looked up at once."""

    def __init__(self, first: bytes, terms: bytes, counts: bytes, positions: bytes):
        self.first, self.terms = np.frombuffer(first, "<i8"), np.frombuffer(terms, "<u8")
        self.counts, steps = np.frombuffer(counts, "<u4").astype(np.int64), np.frombuffer(positions, "<u4").astype(np.int64)
        self.size = int(self.first[-1])
        self.begin = np.cumsum(self.counts) - self.counts
        sums = np.cumsum(steps)
        base = sums[self.begin] - steps[self.begin] if len(steps) else sums
        self.positions = sums - np.repeat(base, self.counts)
        #: term number * size + position, in order.
        self.keys = np.repeat(np.arange(len(self.terms)), self.counts) * max(self.size, 1) + self.positions

    def term_numbers(self, wanted: np.ndarray) -> np.ndarray:
        """The number of each term, -1 if it doesn't occur."""
        if not len(self.terms):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        return np.where(self.terms[at] == wanted, at, -1)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1

    def near(self, term: np.ndarray, position: np.ndarray, slop: int) -> np.ndarray:
        """Whether the term has a posting at most ``slop`` words from the position, in its document."""
        document = self.document(position)
        low, high = np.maximum(position - slop, self.first[document]), np.minimum(position + slop, self.first[document + 1] - 1)
        at = np.searchsorted(self.keys, term * self.size + low)
        found = self.keys[np.minimum(at, len(self.keys) - 1)]
        return (at < len(self.keys)) & (low <= high) & (found <= term * self.size + high)

    def matches(self, words: np.ndarray, begin: np.ndarray, length: np.ndarray, slop: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, position) of each place where all words of a window stand in its order, each at most ``slop``
        words off (0: the exact phrase), within one document; of some windows at a time."""
        if not len(begin) or not self.size:
            return
        number = self.term_numbers(words)
        many = np.where(number >= 0, self.counts[number], 0)
        places = np.arange(int(length.max()))
        for s in range(0, len(begin), 1 << 15):
            inside = places < length[s : s + (1 << 15), None]
            at = np.minimum(begin[s : s + (1 << 15), None] + places, len(words) - 1)
            counts = np.where(inside, many[at], np.int64(2**62)).min(axis=1)
            alive = s + np.flatnonzero(counts > 0)
            done = np.cumsum(counts[alive - s])
            cuts = np.unique(np.searchsorted(done, np.arange(0, int(done[-1]) if len(done) else 0, EXPANDED)))
            for some in np.split(alive, cuts[cuts > 0]):
                window, position = self.follow(number, many, begin[some], length[some], slop)
                yield some[window], position

    def follow(self, number: np.ndarray, many: np.ndarray, begin: np.ndarray, length: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """matches() of windows of which every term occurs, from each one's rarest term on."""
        if not len(begin):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        places = np.arange(int(length.max()))
        at = np.minimum(begin[:, None] + places, len(number) - 1)
        rarest = np.argsort(np.where(places < length[:, None], many[at], np.int64(2**62)), axis=1, kind="stable")
        term = number[at[np.arange(len(begin)), rarest[:, 0]]]
        sizes = self.counts[term]
        window = np.repeat(np.arange(len(begin)), sizes)
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        posting = self.positions[np.repeat(self.begin[term], sizes) + within]
        size, starts = length, []
        for off in range(-slop, slop + 1):  # the rarest term, too, may stand off its place
            position = posting - rarest[window, 0] + off
            last = position + size[window] - 1
            ok = np.flatnonzero((position >= 0) & (last < self.size))
            document = self.document(posting[ok])
            ok = ok[(self.document(position[ok]) == document) & (self.document(last[ok]) == document)]
            starts.append((window[ok], position[ok]))
        window, position = (np.concatenate(x) for x in zip(*starts, strict=True))
        if slop:
            window, position = np.divmod(np.unique(window * self.size + position), self.size)
        for k in range(1, rarest.shape[1]):
            more = np.flatnonzero(k < size[window])
            if not len(more):
                break
            place = rarest[window[more], k]
            ok = np.ones(len(window), bool)
            ok[more] = self.near(number[at[window[more], place]], position[more] + place, slop)
            window, position = window[ok], position[ok]
        return window, position


class Windows:
    """The distinct windows of some benchmark items, as arrays: window i has words[begin[i]:begin[i] + length[i]] and is
    in the items item[first[i]:first[i + 1]]."""

    def __init__(self, ids: list, texts: pa.Array, window: int = WINDOW):
        self.ids = ["" if x is None else str(x) for x in ids]
        first, self.words = scan(texts)
        size = np.diff(first)
        count = np.where(size >= window, size - window + 1, (size > 0).astype(np.int64))
        item = np.repeat(np.arange(len(size)), count)
        begin = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + first[item]
        length = np.minimum(size[item], window)
        marks = length.astype(np.uint64)
        for k in range(window):
            inside = k < length
            marks[inside] = mix(marks[inside] * np.uint64(BASE) + self.words[begin[inside] + k])
        _, one, which = np.unique(marks, return_index=True, return_inverse=True)
        self.begin, self.length = begin[one], length[one]
        pairs = np.unique(np.stack([which, item]), axis=1)
        self.item, self.first = pairs[1], np.searchsorted(pairs[0], np.arange(len(one) + 1))


def judge(index: DataFrame, windows: Windows, slop: int = 0) -> DataFrame:
    """A row a document of the index: doc_id, n_words, hits (spans of words, [start, end)), items (ids, sorted as text)."""
    span = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("doc_id", index.schema["ids"].dataType.elementType), T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(span)), T.StructField("items", T.ArrayType(T.StringType()))])
    sent = index.sparkSession.sparkContext.broadcast(windows)

    def one(ids: pa.Array, first: bytes, terms: bytes, counts: bytes, positions: bytes) -> pa.RecordBatch:
        w, segment = sent.value, Segment(first, terms, counts, positions)
        n = len(segment.first) - 1
        hits, items = [[] for _ in range(n)], [[] for _ in range(n)]
        steps, found = np.zeros(segment.size + 1, np.int64), []
        for window, position in segment.matches(w.words, w.begin, w.length, slop):
            np.add.at(steps, position, 1)
            np.add.at(steps, position + w.length[window], -1)
            found.append(np.unique(np.stack([segment.document(position), window]), axis=1))
        pairs = np.concatenate([*found, np.zeros((2, 0), np.int64)], axis=1)
        if pairs.size:
            hit = np.cumsum(steps[:-1]) > 0
            edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
            # A run of hits ends at its document's end.
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            cuts = segment.first[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < segment.size)]
            cuts = np.unique(cuts[hit[cuts - 1] & hit[cuts]])
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
            for d, a, b in zip((np.searchsorted(segment.first, starts, "right") - 1).tolist(), starts.tolist(), ends.tolist(), strict=True):
                base = int(segment.first[d])
                hits[d].append([a - base, b - base])
            for d, window in pairs.T.tolist():
                items[d] += w.item[w.first[window] : w.first[window + 1]].tolist()
            items = [sorted({w.ids[i] for i in set(x)}) for x in items]
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(segment.first)), pa.array(hits, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield one(batch.column("ids").slice(i, 1).flatten(), *(batch.column(x)[i].as_py() for x in ("first", "terms", "counts", "positions")))

    return index.mapInArrow(run, schema)


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK) -> DataFrame:
    """Judges every document against every benchmark window: doc_id, n_words, hits, items.

    A benchmark larger than ``block_bytes`` is taken in blocks; spans and items of a document's blocks are united.
    """
    spark = documents.sparkSession
    wanted = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).distinct()
    total = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    index = stored(positional_index(documents, id_col, text_col), new_dir(spark, "postings"))
    if blocks > 1:
        index = stored(index.withColumn("segment", F.xxhash64("first", "terms", "positions", F.monotonically_increasing_id())), new_dir(spark, "postings"))
    found = []
    for k in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).toArrow()
        windows = Windows(rows.column("item").to_pylist(), rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string()), window)
        found.append(judge(index.select("ids", "first", "terms", "counts", "positions"), windows, slop) if blocks == 1 else judge_block(index, windows, slop))
    if blocks == 1:
        return found[0]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    flat = every.groupBy("segment", "at").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return flat.select("doc_id", "n_words", united("hits").alias("hits"), "items")


def judge_block(index: DataFrame, windows: Windows, slop: int) -> DataFrame:
    """As judge(), with the segment and the document's place in it, so that blocks can be united."""
    numbered = index.withColumn("ids", F.transform("ids", lambda x, i: F.struct(x.alias("id"), i.cast("long").alias("at"), F.col("segment").alias("segment"))))
    out = judge(numbered.select("ids", "first", "terms", "counts", "positions"), windows, slop)
    return out.select("doc_id.segment", "doc_id.at", F.col("doc_id.id").alias("doc_id"), "n_words", "hits", "items")


def united(hits: str):
    """Joins sorted spans that touch or overlap."""
    empty = F.array().cast("array<array<bigint>>")
    return F.aggregate(hits, empty, lambda done, x: F.when((F.size(done) > 0) & (F.element_at(F.element_at(done, -1), 2) >= x[0]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(F.element_at(done, -1)[0], F.greatest(F.element_at(F.element_at(done, -1), 2), x[1]))))).otherwise(F.concat(done, F.array(x))))


def hit_words(hits):
    """How many words the spans cover."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])
