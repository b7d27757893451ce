"""Best-fit packing of token sequences by bin completion.

How many sequences a packing takes depends on the pieces' lengths alone, and there are at most ``capacity`` different
lengths.  So the driver gets one count for each length (bounded by the capacity, not by the corpus), solves the
problem on these counts with patterns that stand for many sequences each, and executors look up the place of every
piece from its number among the pieces of its length.  Best fit is the incumbent; where it misses the least number
that the bounds allow, each longest piece gets the fullest filling there is, from long pieces first; where that misses
it too, branch and bound on undominated fillings around the longest piece looks for better, within a stated number of
steps.

Results for special input: a null or empty text is one piece, the end id alone; a text of any length is encoded whole;
repeated rows are packed as often as they occur; ties between pieces of a length are decided by their order in the
stored pieces; an empty table gives no rows; null ids are kept; other columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .encoding import encoder
from .workspace import new_dir, slices, stored

Pattern = tuple[tuple[int, int], ...]  # (length, how many of it) in one sequence
#: Steps of the search for a better packing than best fit's, and how often it begins anew within them.
STEPS, ROUNDS = 4_000_000, 128
#: Rows (part, length, pieces before) that are sent to executors as arrays of 12 bytes a row; more are joined by a shuffle.
SENT = 1_000_000


def pieces(documents: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts every document's ids and the end id into pieces: doc_id, piece, start, length, ids (little-endian
    unsigned 32-bit), and part and nth, which number the pieces of a length within a task."""
    key = documents.schema[id_col]
    schema = T.StructType([T.StructField("doc_id", key.dataType), *(T.StructField(x, T.IntegerType()) for x in ("piece", "part", "nth")), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = encoder(tokenizer), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in slices(batches, "text", 2 << 20):
            first, ids = encode.encode(batch.column("text"))
            n = batch.num_rows
            with_end = np.insert(ids.astype("<u4"), first[1:], end_id)
            first = first + np.arange(n + 1)
            size = np.diff(first)
            count = -(-size // capacity)
            row = np.repeat(np.arange(n), count)
            number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = number * capacity
            length = np.minimum(size[row] - start, capacity)
            order = np.argsort(length, kind="stable")
            kinds, at, many = np.unique(length[order], return_index=True, return_counts=True)
            nth = np.empty(len(row), np.int64)
            nth[order] = np.arange(len(row)) - np.repeat(at, many) + np.repeat(seen[kinds], many)
            seen[kinds] += many
            ends = np.concatenate([[0], np.cumsum(length)]) * 4
            packed = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(with_end)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), *(pa.array(x, pa.int32()) for x in (number, np.full(len(row), part), nth)), pa.array(start), pa.array(length), packed], ["doc_id", "piece", "part", "nth", "start", "length", "ids"])

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


class Plan(NamedTuple):
    """Patterns and how many sequences follow each; how many there are in all, the least number that any packing needs
    by the bound, and the steps of the search."""

    patterns: list[tuple[Pattern, int]]
    sequences: int
    bound: int
    steps: int


class Steps:
    """What is left of a search's steps, which end it wherever it runs, however fast the machine is."""

    def __init__(self, most: int):
        self.most = self.left = most

    def take(self) -> bool:
        self.left -= 1
        return self.left >= 0


def bits(lengths: Iterable[int]) -> int:
    """The bit x for each length x."""
    out = bytearray()
    for x in lengths:
        if x >> 3 >= len(out):
            out.extend(bytes((x >> 3) + 1 - len(out)))
        out[x >> 3] |= 1 << (x & 7)
    return int.from_bytes(out, "little")


def dominated(room: int, filling: list[tuple[int, int]], have: dict[int, int], spare: int) -> bool:
    """Whether one more piece that is at hand (``have`` says how many, ``spare`` which lengths, as bits) could replace
    some of the filling's (or none), and stand for them: it is at least as long as those together, the sequence still
    holds it, and it isn't one piece for another of its length."""
    slack = room - sum(x * k for x, k in filling)
    for x, k in filling:
        if have[x] <= k:
            spare &= ~(1 << x)
    # Sums of no piece and of one piece, and of two and more, as bits.
    none, many = 1, 0
    single = 0
    for x, k in filling:
        for _ in range(k):
            many |= (many << x) | (single << x)
            single |= 1 << x
    # A set of pieces with sum t is replaced by x if t <= x <= t + slack; one piece, if t < x.
    reach, wide = (none | single | many) << 1 if slack else 0, 1
    while wide < slack:
        step = min(wide, slack - wide)
        reach |= reach << step
        wide += step
    return bool((many | reach) & spare)


def fillings(room: int, counts: np.ndarray, allowed: int | None = None, steps: Steps | None = None) -> Iterator[Pattern]:
    """Undominated ways to fill ``room`` with the lengths at hand, as (length, how many) from the longest on: all of
    those that waste at most ``allowed``, those without waste first, then in bands of waste that double.

    Every filling is built from its longest piece down; branches end where even all shorter pieces leave more room than
    the waste that is allowed.
    """
    steps = steps or Steps(1 << 62)
    allowed = room if allowed is None else min(allowed, room)
    here = [int(x) for x in np.flatnonzero(counts[: room + 1]) if x]
    steps.left -= len(here) // 8  # these lists cost as much
    have = [int(counts[x]) for x in here]
    held, spare = dict(zip(here, have, strict=True)), bits(here)
    below = [0]
    for x, n in zip(here, have, strict=True):
        below.append(below[-1] + x * n)

    def search(left: int, top: int, chosen: list[tuple[int, int]], least: int, most: int) -> Iterator[Pattern]:
        """Fillings from the lengths here[:top] that leave ``least`` to ``most``."""
        top = min(top, bisect_right(here, left))
        if left <= most and left >= least and not (here and chosen and top and left >= here[0] and left - here[0] > most):
            steps.left -= sum(k for _, k in chosen) // 16  # of as many pieces all sums are taken
            if not dominated(room, chosen, held, spare):
                yield tuple(chosen)
        for i in range(top - 1, -1, -1):
            if left - below[i + 1] > most or not steps.take():
                return
            x = here[i]
            for k in range(min(have[i], left // x), 0, -1):
                if left - k * x >= least:
                    yield from search(left - k * x, i, [*chosen, (x, k)], least, most)

    low, high = 0, 0
    while low <= allowed:
        yield from search(room, len(here), [], low, min(high, allowed))
        low, high = high + 1, max(1, 2 * high + 1)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on counts: the incumbent."""
    open_: dict[int, list[tuple[tuple, int]]] = {}  # room: (chain of (length, how many, chain), sequences)
    rooms: list[int] = []

    def add(room: int, chain: tuple, n: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((chain, n))

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, chain, n = capacity, (), left
            else:
                room = rooms[at]
                chain, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            each = min(room // length, left)
            used = min(n, left // each)
            add(room - each * length, (length, each, chain), used)
            if chain and n > used:
                add(room, chain, n - used)
            left -= used * each

    def pattern(chain: tuple) -> Pattern:
        out: dict[int, int] = defaultdict(int)
        while chain:
            length, each, chain = chain
            out[length] += each
        return tuple(sorted(out.items(), reverse=True))

    return [(pattern(chain), n) for groups in open_.values() for chain, n in groups]


def fullest(room: int, here: list[int], have: list[int], top: int) -> list[tuple[int, int]]:
    """A filling from the lengths here[:top] that leaves as little of ``room`` as any does, as (length, how many); of those
    without waste, one whose shortest length is the longest possible, so that short pieces stay for rooms that need them."""
    rooms, before = 1 << room, []  # the rooms that sets of the lengths so far leave, as bits
    for i in range(top - 1, -1, -1):
        if have[i]:
            before.append((here[i], rooms))
            left, many = min(have[i], room // here[i]), 1
            while left:
                many = min(many, left)
                rooms |= rooms >> here[i] * many
                left, many = left - many, many * 2
            if rooms & 1:
                break
    at, out = (rooms & -rooms).bit_length() - 1, []
    for x, rooms in reversed(before):
        k = 0
        while not rooms >> at & 1:
            at, k = at + x, k + 1
        if k:
            out.append((x, k))
    return out


def fullest_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Around each longest piece left the fullest filling, as often as the counts allow."""
    here = [int(x) for x in np.flatnonzero(counts) if x]
    have, place = [int(counts[x]) for x in here], {x: i for i, x in enumerate(here)}
    top, out = len(here), []
    while top:
        if not have[top - 1]:
            top -= 1
            continue
        longest = here[top - 1]
        have[top - 1] -= 1
        room = capacity - longest
        many = defaultdict(int, fullest(room, here, have, min(top, bisect_right(here, room))))
        have[top - 1] += 1
        many[longest] += 1
        n = min(have[place[x]] // k for x, k in many.items())
        for x, k in many.items():
            have[place[x]] -= n * k
        out.append((tuple(sorted(many.items(), reverse=True)), n))
    return out


def least_sequences(counts: np.ndarray, capacity: int) -> int:
    """A lower bound: for every k, pieces over capacity - k stand alone, those over a half have one sequence each, and what
    room these leave takes pieces of k and more, the rest of which needs sequences of its own."""
    sizes = np.arange(len(counts), dtype=np.int64)
    number, total = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * sizes)])
    k = np.arange(capacity // 2 + 1)
    over, half = capacity - k + 1, capacity // 2 + 1
    n1, n2 = number[-1] - number[np.minimum(over, len(counts))], number[np.minimum(over, len(counts))] - number[min(half, len(counts))]
    s2, s3 = total[np.minimum(over, len(counts))] - total[min(half, len(counts))], total[min(half, len(counts))] - total[np.minimum(k, len(counts))]
    rest = s3 - (n2 * capacity - s2)
    return int((n1 + n2 + np.maximum(0, -(-rest // capacity))).max())


def least_waste(counts: np.ndarray, capacity: int, steps: Steps | None = None) -> int:
    """A lower bound of all sequences' waste: a piece's own is what the fullest sequence around it leaves, were the
    lengths at hand there in any number, and counts by the share of a sequence that the piece takes."""
    here = [int(x) for x in np.flatnonzero(counts) if x]
    if steps:
        steps.left -= len(here) // 8
    left = 1 << capacity  # the rooms that pieces leave, as bits
    for x in here:
        many = x
        while many <= capacity:
            left |= left >> many
            many *= 2
    reach = np.unpackbits(np.frombuffer(left.to_bytes(capacity // 8 + 1, "little"), np.uint8), bitorder="little")[: capacity + 1][::-1]
    full = np.maximum.accumulate(np.where(reach, np.arange(capacity + 1), 0))
    sizes = np.array(here, np.int64)
    room = capacity - sizes
    return -(-int(((room - full[room]) * sizes * counts[sizes]).sum()) // capacity)


def bin_completion(counts: np.ndarray, capacity: int, steps: int = STEPS) -> Plan:
    """As few sequences as are found within ``steps`` steps of the search; best fit is the first incumbent, and where it
    misses the bound, the fullest fit the second.

    Depth first: the longest piece left gets each of its undominated fillings in turn, as often as the counts and the
    waste allow; going back gives up one use at a time, and the next sequence around that length then has a filling that was not
    tried.  A branch ends when the waste is more than an improvement can afford, or when the sequences so far and the
    least number for the rest are no fewer than the incumbent's.  A search that takes long begins anew, with the first
    fillings of each list in another order, until the steps are spent.
    """
    counts = counts.astype(np.int64).copy()
    best = best_fit(counts, capacity)
    fewest, bound, spent = sum(n for _, n in best), least_sequences(counts, capacity), 0
    if fewest > bound and (fit := fullest_fit(counts, capacity)) and (n := sum(n for _, n in fit)) < fewest:
        best, fewest = fit, n
    rng = np.random.default_rng(0)
    while fewest > bound and spent < steps:
        limit = Steps(min(steps - spent, max(1, steps // ROUNDS)))
        found, ended = completions(counts.copy(), capacity, fewest - 1, limit, rng if spent else None)
        spent += limit.most - max(0, limit.left)
        if found:
            best, fewest = found, sum(n for _, n in found)
        elif ended:
            break  # no packing has fewer
    return Plan(best, fewest, bound, spent)


def completions(counts: np.ndarray, capacity: int, most: int, limit: Steps, rng: np.random.Generator | None) -> tuple[list[tuple[Pattern, int]], bool]:
    """A packing into at most ``most`` sequences, if the search meets one, and whether it has seen all there are."""
    total = int((counts * np.arange(len(counts))).sum())
    path: list[tuple] = []  # (pattern, uses, waste of one, fillings yet to come, patterns tried before)
    used, wasted = 0, 0
    tried: frozenset[Pattern] = frozenset()
    options: Iterator[Pattern] | None = None

    def put(pattern: Pattern, n: int) -> None:
        for x, k in pattern:
            counts[x] -= n * k

    while limit.left > 0:
        spare = most * capacity - total - wasted
        longest = int(np.flatnonzero(counts)[-1]) if counts.any() else 0
        if not longest:
            return [(p, n) for p, n, *_ in path], True
        found = None
        if spare >= 0 and (options is not None or used + least_sequences(counts, capacity) <= most and least_waste(counts, capacity, limit) <= spare):
            counts[longest] -= 1
            if options is None:
                options = fillings(capacity - longest, counts.copy(), spare, limit)
                if rng is not None:
                    first = list(islice(options, 12))
                    options = chain([first[i] for i in rng.permutation(len(first))], options)
            for filling in options:
                many = defaultdict(int, filling)
                many[longest] += 1
                pattern = tuple(sorted(many.items(), reverse=True))
                waste = capacity - sum(x * k for x, k in pattern)
                if pattern not in tried and waste <= spare:
                    found = pattern
                    break
            counts[longest] += 1
        if found:
            n = min(int(counts[x]) // k for x, k in found)
            n = min(n, spare // waste) if waste else n
            put(found, n)
            used, wasted = used + n, wasted + n * waste
            path.append((found, n, waste, options, tried))
            tried, options = (tried if counts[longest] else frozenset()), None
            continue
        if not path:
            return [], limit.left > 0
        pattern, n, waste, later, before = path.pop()
        put(pattern, -1)
        used, wasted = used - 1, wasted - waste
        tried = before | {pattern}
        options = later if n == 1 else None
        if n > 1:
            path.append((pattern, n - 1, waste, None, before))
    return [], False


def places(plan: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first number, first sequence, offset, pieces in one sequence), by first number."""
    taken, out, sequence = defaultdict(int), defaultdict(list), 0
    for pattern, n in plan:
        offset = 0
        for length, k in pattern:
            out[length].append((taken[length], sequence, offset, k))
            taken[length] += n * k
            offset += length * k
        sequence += n
    return {x: np.array(rows, np.int64) for x, rows in out.items()}


def best_fit_pack(documents: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs whole documents, cut only where longer than ``capacity``, into sequences of at most ``capacity`` ids.

    Returns doc_id, piece, start, length, ids (binary), sequence_id and offset.
    """
    spark = documents.sparkSession
    cut = stored(pieces(documents, tokenizer, capacity, end_id, id_col, text_col), new_dir(spark, "pieces"))
    by_part = stored(cut.groupBy("length", "part").agg(F.count("*").alias("many")), new_dir(spark, "lengths"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, many in by_part.groupBy("length").agg(F.sum("many")).collect():  # at most `capacity` rows
        counts[length] = many
    table = places(bin_completion(counts, capacity).patterns)
    order = W.Window.partitionBy("length").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    base = by_part.select("length", "part", F.coalesce(F.sum("many").over(order), F.lit(0)).alias("before"))
    if by_part.count() <= SENT:
        held = base.toArrow().sort_by([("part", "ascending"), ("length", "ascending")])
        part, length, before = (held.column(x).to_numpy() for x in ("part", "length", "before"))
        kinds, at = np.unique(part, return_index=True)
        offsets = {p: (length[i:j].astype(np.int32), before[i:j]) for p, i, j in zip(kinds.tolist(), at, [*at, len(part)][1:], strict=True)}
    else:
        offsets, cut = None, cut.join(base, ["length", "part"])
    schema = T.StructType([*(f for f in cut.schema if f.name not in ("part", "nth", "before")), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    sent = spark.sparkContext.broadcast((table, offsets))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, offsets = sent.value
        for batch in batches:
            length, part, number = (batch.column(x).to_numpy() for x in ("length", "part", "nth"))
            number = number.astype(np.int64)
            if offsets is None:
                number += batch.column("before").to_numpy()
            else:
                for p in np.unique(part).tolist():
                    own = part == p
                    number[own] += offsets[p][1][np.searchsorted(offsets[p][0], length[own])]
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            kinds, at = np.unique(length[order], return_index=True)
            for x, own in zip(kinds.tolist(), np.split(order, at[1:]), strict=True):
                rows = table[x][np.searchsorted(table[x][:, 0], number[own], "right") - 1]
                more = number[own] - rows[:, 0]
                sequence[own] = rows[:, 1] + more // rows[:, 3]
                offset[own] = rows[:, 2] + more % rows[:, 3] * x
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema[:-2]), pa.array(sequence), pa.array(offset)], schema.names)

    return cut.mapInArrow(place, schema)
