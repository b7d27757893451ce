"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the embeddings of its character n-grams and of the whole word; a passage's vector is the
mean over its words; a linear softmax on it gives the passage's probability.  Embeddings and softmax are trained
jointly, by AdaGrad in numpy.  A document is judged by its most toxic passage, found among all windows of ``PASSAGE``
words of the whole text, so that long texts dilute nothing.  Characters are Unicode's, in small letters.  While training, n-grams are left out at random, so that a
part of a word's n-grams has to do: a misspelling that was never seen shares some of them.  A run of letters that is too
long for a word, as texts written without spaces are, is walked to its end in overlapping pieces that count as words.

As the softmax is linear, a word adds one number to each of its passages, and each n-gram one number to its words:
a whole text is scored with a table look-up for each distinct word and a running sum.

Special input: null and empty texts, and texts without words, get the score of a passage whose words are all unknown; a text of
any length is scored whole, and of a very long labelled one the fit sees stretches spread over it; repeated
rows are scored alike; labels other than 0 and 1 and null labels teach nothing; without labels of both kinds every score
is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_sample
from .wordscan import BASE, IN_WORD, characters, mix, run_hashes, spans, text_bytes
from .workspace import is_held_out, slices

PASSAGE = 8
DIM = 8
BUCKETS = 1 << 17
#: Characters of an n-gram; and of words with characters from WIDE on, where scripts begin in which one character says as
#: much as some letters do.
NARROW_GRAMS, WIDE_GRAMS, WIDE = (3, 4, 5), (1, 2, 3), 0x2E80
#: A run of more than WORD characters, as texts without spaces are, is walked in pieces of PIECE characters, each of which
#: counts as a word; for runs without and with wide characters.  With the characters beside them, pieces overlap by one less than
#: the longest n-gram, so that they have all n-grams of the run.
WORD, PIECE = np.array([32, 8]), np.array([16, 4])
STEP = PIECE + 3 - np.array([max(NARROW_GRAMS), max(WIDE_GRAMS)])
#: Small letters of the alphabets that have them below this code point; others stay as they are.
CASED = 0x590
WORDY = np.concatenate([IN_WORD[:128], np.ones(CASED - 128, bool)])
SMALL = np.array([ord(c) if len(c := chr(k).lower()) == 1 else k for k in range(CASED)], np.uint32)
#: Rows of n-grams that are held at a time.
ROWS = 1 << 14
#: Labelled documents of each kind that the model is fitted on, at most.
SAMPLE = 1500


def buckets(letters: np.ndarray, whole: np.ndarray, wide: bool = False) -> np.ndarray:
    """A row of n-gram buckets for each row of letters, the whole word's last."""
    letters = letters.astype(np.uint64)
    grams = [whole[:, None]]
    for n in WIDE_GRAMS if wide else NARROW_GRAMS:
        if n > letters.shape[1]:
            break
        count = letters.shape[1] + 1 - n
        total = np.full((len(letters), count), n, np.uint64)
        for k in range(n):
            total = total * np.uint64(0x100000001B3) + letters[:, k : count + k]
        grams.append((mix(total) >> np.uint64(40)).astype(np.int64) % BUCKETS)
    return np.concatenate(grams[::-1], axis=1)


class Words(NamedTuple):
    """Distinct words, and pieces of longer runs: their characters, whether the run goes on before and after them, the
    run's hash, a key of their own, and whether the run has wide characters."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    before: np.ndarray
    after: np.ndarray
    marks: np.ndarray
    keys: np.ndarray
    wide: np.ndarray

    def whole(self) -> np.ndarray:
        return (self.marks >> np.uint64(40)).astype(np.int64) % BUCKETS

    def is_piece(self) -> np.ndarray:
        return self.before | self.after

    def letters(self, own: np.ndarray) -> np.ndarray:
        """The characters of words of one length with the ones beside them; < and > stand at the ends of runs."""
        at = self.starts[own][:, None] + np.arange(-1, self.ends[own[0]] - self.starts[own[0]] + 1)
        out = self.data[np.clip(at, 0, len(self.data) - 1)]
        out[~self.before[own], 0], out[~self.after[own], -1] = 60, 62
        return out

    def grams(self, some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word numbers, buckets) for some of the words, those of one length at a time."""
        kind, whole = 2 * (self.ends[some] - self.starts[some]) + self.wide[some], self.whole()
        order = some[np.argsort(kind, kind="stable")]
        cuts = np.searchsorted(np.sort(kind), np.arange(2, 2 * WORD[0] + 4))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            for s in range(a, b, ROWS):
                own = order[s : min(s + ROWS, b)]
                yield own, buckets(self.letters(own), whole[own], k % 2 == 1)


def distinct_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
    """(first, place, words): place numbers each word or piece of the texts among the distinct ones."""
    offsets, data = characters(*text_bytes(column))
    plain = not len(data) or int(data.max()) < CASED
    data = SMALL[data] if plain else np.where(data < CASED, SMALL[np.minimum(data, CASED - 1)], data)
    starts, ends = spans(offsets, WORDY[data] if plain else (data >= CASED) | WORDY[np.minimum(data, CASED - 1)])
    first = np.searchsorted(starts, offsets)
    marks, some, place = np.unique(run_hashes(data, starts, ends), return_index=True, return_inverse=True)
    starts, ends = starts[some], ends[some]
    seen = np.flatnonzero(data >= WIDE) if not plain else starts[:0]
    wide = (np.searchsorted(seen, ends) > np.searchsorted(seen, starts)).astype(np.int64)
    piece, step = PIECE[wide], STEP[wide]
    many = np.where(ends - starts > WORD[wide], (ends - starts - piece + step - 1) // step + 1, 1)
    begin = np.cumsum(many) - many
    run = np.repeat(np.arange(len(many)), many)
    nth = np.arange(len(run)) - begin[run]
    long = many[run] > 1
    low = np.where(long, np.minimum(starts[run] + step[run] * nth, ends[run] - piece[run]), starts[run])
    high = np.where(long, low + piece[run], ends[run])
    keys = np.where(long, mix(marks[run] + nth.astype(np.uint64) * np.uint64(BASE)), marks[run])
    words = Words(data, low, high, low > starts[run], high < ends[run], marks[run], keys, wide[run])
    count = many[place]
    total = np.concatenate([[0], np.cumsum(count)])
    return total[first], np.repeat(begin[place] - total[:-1], count) + np.arange(total[-1]), words


def passage_sums(first: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum, start, text) of every passage: windows of PASSAGE words, or all words of a shorter text."""
    size = np.diff(first)
    count = np.where(size > PASSAGE, size - PASSAGE + 1, (size > 0).astype(np.int64))
    text = np.repeat(np.arange(len(size)), count)
    start = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + first[text]
    sums = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
    return sums[np.minimum(start + PASSAGE, first[text + 1])] - sums[start], start, text


class Sample:
    """The words of a sample: place numbers each word of the texts among the distinct ones.  Word i's n-grams are
    flat[begin[i]:begin[i] + counts[i]], if it isn't a piece of a longer run; pieces may have as many characters as the
    sample, so of them letters[wide[i]][piece[i]] are kept, and their n-grams are taken anew.  The texts are scanned a slice at a time."""

    def __init__(self, texts: pa.ChunkedArray):
        none = np.zeros(0, np.int64)
        sizes, keys_of_all, keys, counts, grams_of, pieces, kinds, whole = [none], [none.astype(np.uint64)], [none.astype(np.uint64)], [none], [none.astype(np.int32)], [none], [none], [none]
        letters = [[np.zeros((0, n + 2), np.uint32)] for n in PIECE]
        n_kind = [0, 0]
        for batch in slices(pa.table({"text": texts}).to_batches(), "text"):
            first, place, words = distinct_words(batch.column("text"))
            sizes.append(np.diff(first))
            keys_of_all.append(words.keys[place])
            many, long = np.zeros(len(words.keys), np.int64), np.flatnonzero(words.is_piece())
            parts = [(own, grams.astype(np.int32)) for own, grams in words.grams(np.flatnonzero(~words.is_piece()))]
            for own, grams in parts:
                many[own] = grams.shape[1]
            begin = np.cumsum(many) - many
            flat = np.zeros(int(many.sum()), np.int32)
            for own, grams in parts:
                flat[begin[own][:, None] + np.arange(grams.shape[1])] = grams
            piece = np.full(len(words.keys), -1)
            for wide in (0, 1):
                own = long[words.wide[long] == wide]
                piece[own] = n_kind[wide] + np.arange(len(own))
                n_kind[wide] += len(own)
                if len(own):
                    letters[wide].append(words.letters(own))
            kinds.append(words.wide)
            whole.append(words.whole())
            keys.append(words.keys)
            counts.append(many)
            grams_of.append(flat)
            pieces.append(piece)
        self.first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        distinct, some = np.unique(np.concatenate(keys), return_index=True)
        self.place = np.searchsorted(distinct, np.concatenate(keys_of_all))
        every = np.concatenate(counts)
        self.begin, self.counts, self.flat = (np.cumsum(every) - every)[some], every[some], np.concatenate(grams_of)
        self.piece, self.wide, self.whole = (np.concatenate(x)[some] for x in (pieces, kinds, whole))
        self.letters = [np.concatenate(x) for x in letters]

    def grams(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams, which of the words each is of)."""
        many = self.counts[words]
        at = np.repeat(self.begin[words] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        gram, owner = self.flat[at], np.repeat(np.arange(len(words)), many)
        long = np.flatnonzero(self.piece[words] >= 0)
        if not len(long):
            return gram, owner
        grams, owners = [gram], [owner]
        for wide in (0, 1):
            own = long[self.wide[words[long]] == wide]
            more = buckets(self.letters[wide][self.piece[words[own]]], self.whole[words[own]], wide == 1).astype(np.int32)
            grams.append(more.ravel())
            owners.append(np.repeat(own, more.shape[1]))
        return np.concatenate(grams), np.concatenate(owners)

    def values(self, table: np.ndarray) -> np.ndarray:
        """The mean of a table's numbers over each distinct word's n-grams."""
        out = np.zeros(len(self.counts))
        for s in range(0, len(out), ROWS):
            gram, owner = self.grams(np.arange(s, min(s + ROWS, len(out))))
            n = len(out[s : s + ROWS])
            out[s : s + ROWS] = np.bincount(owner, weights=table[gram], minlength=n) / np.maximum(np.bincount(owner, minlength=n), 1)
        return out


class ToxicityModel:
    """After training: a number for each n-gram bucket, a bias, and the scale of the documents' logits."""

    def __init__(self):
        self.table, self.bias, self.scale, self.shift = np.zeros(BUCKETS, np.float32), -np.inf, 1.0, 0.0

    def word_values(self, words: Words) -> np.ndarray:
        values = np.zeros(len(words.keys), np.float32)
        for own, grams in words.grams(np.arange(len(values))):
            values[own] = self.table[grams].mean(axis=1)
        return values

    def logits(self, column: pa.Array) -> np.ndarray:
        """The greatest passage logit of each text."""
        first, place, words = distinct_words(column)
        sums, _, text = passage_sums(first, self.word_values(words)[place])
        size = np.minimum(np.diff(first), PASSAGE)
        best = np.zeros(len(size))
        full = np.flatnonzero(size)
        if len(full):
            best[full] = np.maximum.reduceat(sums, np.searchsorted(text, full)) / size[full]
        return best + self.bias

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.bias == -np.inf:  # nothing was learnt
            return np.zeros(len(column))
        return 1 / (1 + np.exp(-np.clip(self.logits(column) * self.scale + self.shift, -60, 60)))


def train(sample: pa.Table, seed: int = 3, rounds: int = 8, keep: float = 0.5) -> ToxicityModel:
    model = ToxicityModel()
    labels = sample.column("label").to_numpy()
    if len(np.unique(labels)) < 2:
        return model
    rng = np.random.default_rng(seed)
    words = Sample(sample.column("text"))
    first, place = words.first, words.place
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    soft, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    soft[1], soft[0] = rng.normal(0, 0.5, DIM), 0
    soft[0] = -soft[1]
    grown, soft_grown, bias_grown = np.full(BUCKETS, 1e-6, np.float32), 1e-6, 1e-6
    touched = np.zeros(BUCKETS, bool)
    sums, start, text = passage_sums(first, np.zeros(len(place)))
    size = np.minimum(np.diff(first), PASSAGE)
    toxic = labels[text] == 1

    def step(chosen: np.ndarray) -> None:
        """One AdaGrad step on some passages."""
        nonlocal soft, bias, soft_grown, bias_grown
        long = size[text[chosen]]
        row = np.repeat(np.arange(len(chosen)), long)
        at = start[chosen][row] + np.arange(len(row)) - np.repeat(np.cumsum(long) - long, long)
        word, inverse = np.unique(place[at], return_inverse=True)
        gram, owner = words.grams(word)
        kept = rng.random(len(gram)) < keep
        gram, owner = gram[kept], owner[kept]
        share = 1 / np.maximum(np.bincount(owner, minlength=len(word)), 1).astype(np.float32)
        vectors = np.zeros((len(word), DIM), np.float32)
        np.add.at(vectors, owner, embed[gram])
        vectors *= share[:, None]
        passages = np.zeros((len(chosen), DIM), np.float32)
        np.add.at(passages, row, vectors[inverse])
        passages /= long[:, None]
        out = passages @ soft.T + bias
        p = np.exp(out - out.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        y = labels[text[chosen]]
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))[:, None].astype(np.float32)
        p[np.arange(len(y)), y] -= 1
        error = p * weight
        back = error @ soft / long[:, None]
        per_word = np.zeros((len(word), DIM), np.float32)
        np.add.at(per_word, inverse, back[row])
        buckets, inner = np.unique(gram, return_inverse=True)
        slope = np.zeros((len(buckets), DIM), np.float32)
        np.add.at(slope, inner, (per_word * share[:, None])[owner])
        grown[buckets] += (slope**2).mean(axis=1)
        embed[buckets] -= 0.3 * slope / np.sqrt(grown[buckets])[:, None]
        touched[buckets] = True
        slope = error.T @ passages
        soft_grown += float((slope**2).mean())
        bias_grown += float((error.sum(axis=0) ** 2).mean())
        soft -= 0.1 * slope / np.sqrt(soft_grown)
        bias -= 0.1 * error.sum(axis=0) / np.sqrt(bias_grown)

    def settled() -> ToxicityModel:
        model.table = np.where(touched, embed @ (soft[1] - soft[0]), 0).astype(np.float32)
        model.bias = float(bias[1] - bias[0])
        return model

    # First all kinds of passages, then ever again those that look worst.
    apart = (start - first[text]) % PASSAGE == 0
    pools = [np.flatnonzero(apart & toxic), np.flatnonzero(apart & ~toxic)]
    for k in range(rounds + 1):
        if k:
            sums = passage_sums(first, words.values(settled().table)[place])[0] / size[text]
            order = np.lexsort((-sums, text))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - np.searchsorted(text, text[order])
            pools = [np.flatnonzero((rank == 0) & toxic), np.flatnonzero((rank < 3) & ~toxic)]
        some = [rng.permutation(x)[:20_000] for x in pools]
        batches = max(1, len(some[1]) // 256, len(some[0]) // 256)
        for b in range(batches):
            step(np.concatenate([some[0][b::batches], some[1][b::batches]]))
    settled()
    sums = passage_sums(first, words.values(model.table)[place])[0] / size[text]
    logits = np.zeros(len(size))
    full = np.flatnonzero(size)
    if len(full):
        logits[full] = np.maximum.reduceat(sums, np.searchsorted(text, full))
    logits, y = logits + model.bias, np.asarray(labels)
    for _ in range(300):  # scale and shift, both kinds weighing alike
        p = 1 / (1 + np.exp(-np.clip(logits * model.scale + model.shift, -60, 60)))
        error = (p - y) * np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
        model.scale = max(0.05, model.scale - 0.5 * float((error * logits).sum()))
        model.shift -= 0.5 * float(error.sum())
    return model


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    return train(labelled_sample(documents, labels, label, rows, id_col, text_col))


def score(documents: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", name: str = "score") -> DataFrame:
    """The documents with one more column, the score of the whole text; a column of that name is replaced."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            if isinstance(column, pa.ChunkedArray):
                column = column.combine_chunks()
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            found = [sent.value.scores(x.column("text")) for x in slices(iter([batch]), "text")]
            yield pa.array(np.concatenate(found) if found else np.zeros(0))

    return documents.withColumn(name, F.arrow_udf(run, "double")(F.col(text_col)))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(documents.select("doc_id", "text"), fit(documents, labels))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
