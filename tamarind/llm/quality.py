"""Quality classifier by positive-unlabelled learning.

Trusted positives are texts labelled good; everything else is learnt from web text without labels.  A small network on
measures of a text's form is trained to minimise the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),

where the second term's gradient is turned round while it is below zero.  The class prior is estimated first: a
positive-against-unlabelled model is fitted on half of both, and on the other half the least ratio, over thresholds, of the shares of
unlabelled texts and positives above it (with a confidence margin) is the prior; the median of several splits is taken.

Measures are taken over the whole text in a few vectorised passes; those of its worst stretch of ``STRETCH`` words are
among them, so that junk within a long text counts.

Special input: null and empty texts have measures of their own (no words) and are scored like others; repeated rows
alike; null labels teach nothing; without a positive or without texts every score is 0; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import labelled_ids
from .wordscan import IN_WORD, hashes, spans, text_bytes
from .workspace import is_held_out, slices

STRETCH = 24
#: Positives, and unlabelled texts, that the model is fitted on, at most.
SAMPLE = 2500
#: Splits that estimate the class prior, and networks whose scores are averaged.
SPLITS, NETWORKS = 15, 5
#: Columns of measures().
MEASURES = 18
SIGNS = np.isin(np.arange(256), [*b"!#$%&*+<=>@\\^_`{|}~"])
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
END = np.isin(np.arange(256), [*b".?;:"])


def shares(total: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Means over each text's words, and the greatest over its stretches of STRETCH words."""
    size = np.diff(first)
    sums = np.concatenate([[0.0], np.cumsum(total, dtype=np.float64)])
    mean = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(size, 1)
    most = mean.copy()
    long = np.flatnonzero(size > STRETCH)
    if len(long):
        windows = np.append((sums[STRETCH:] - sums[:-STRETCH]) / STRETCH, np.full(STRETCH, -np.inf))
        edges = np.stack([first[long], first[long + 1] - STRETCH + 1], axis=1).ravel()
        most[long] = np.maximum.reduceat(windows, edges)[::2]
    return np.stack([mean, most], axis=1)


def measures(column: pa.Array) -> np.ndarray:
    """A row of measures a text."""
    offsets, data = text_bytes(column)
    n = len(offsets) - 1
    if not len(data):
        return np.zeros((n, MEASURES))
    starts, ends = spans(offsets, IN_WORD[data])
    first = np.searchsorted(starts, offsets)
    size = ends - starts
    # What follows a word, up to the next, counts as its own; so does what stands before a text's first word.
    stop = np.append(starts[1:], len(data))
    if len(starts):
        last = first[1:][np.diff(first) > 0] - 1
        stop[last] = offsets[1:][np.diff(first) > 0]
    kinds = {}
    latin = np.zeros(len(data), bool)
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    for name, is_it in (("upper", UPPER[data] | latin), ("sign", SIGNS[data]), ("digit", DIGIT[data]), ("end", END[data]), ("line", data == 10)):
        sums = np.concatenate([[0], np.cumsum(is_it)])
        kinds[name] = sums[stop] - sums[starts]
    marks = hashes(data, starts, ends)
    again = np.zeros(len(marks))
    again[1:] = marks[1:] == marks[:-1]
    again[first[:-1][first[:-1] < len(again)]] = 0
    few = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        few.append(1 - len(np.unique(marks[a:b])) / max(1, b - a))
    words = np.diff(first)
    columns = [shares(np.minimum(kinds["upper"], size) / np.maximum(size, 1), first), shares(np.minimum(kinds["sign"], 8), first), shares(kinds["digit"] > 0, first), shares(np.minimum(kinds["end"], 4), first), shares(kinds["line"] > 0, first), shares(again, first), shares(np.minimum(size, 32) / 8, first)]
    plain = np.stack([np.log1p(words) / 8, np.array(few), np.where(words > 0, 0.0, 1.0), np.array(few) * np.log1p(words) / 8], axis=1)
    return np.concatenate([*columns, plain], axis=1)


class Network:
    """measures -> 16 tanh units -> a number; a sigmoid makes a score of it."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, rng: np.random.Generator, hidden: int = 16):
        self.mean, self.spread = mean, spread
        self.p = [rng.normal(0, len(mean) ** -0.5, (len(mean), hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        self.moments = [[np.zeros_like(x), np.zeros_like(x)] for x in self.p]
        self.steps = 0

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        h = np.tanh(z @ self.p[0] + self.p[1])
        return z, h, h @ self.p[2] + self.p[3][0]

    def slopes(self, z: np.ndarray, h: np.ndarray, back: np.ndarray) -> list[np.ndarray]:
        inner = back[:, None] * self.p[2] * (1 - h * h)
        return [z.T @ inner, inner.sum(axis=0), h.T @ back, np.array([back.sum()])]

    def step(self, slopes: list[np.ndarray], rate: float = 0.01) -> None:
        self.steps += 1
        for p, g, m in zip(self.p, slopes, self.moments, strict=True):
            g = g + 1e-4 * p
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            p -= rate * (m[0] / (1 - 0.9**self.steps)) / (np.sqrt(m[1] / (1 - 0.999**self.steps)) + 1e-8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.forward(x)[2])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int, rounds: int = 60) -> Network:
    """Non-negative risk with the logistic loss if a prior is given, else positives against unlabelled."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    net = Network(both.mean(axis=0), both.std(axis=0) + 1e-3, rng)
    batches = max(1, len(unlabelled) // 250)
    for _ in range(rounds):
        for p, u in zip(np.array_split(rng.permutation(len(positive)), batches), np.array_split(rng.permutation(len(unlabelled)), batches), strict=True):
            if not len(p) or not len(u):
                continue
            zp, hp, gp = net.forward(positive[p])
            zu, hu, gu = net.forward(unlabelled[u])
            up_p, up_u = sigmoid(gp), sigmoid(gu)
            # Slopes of log(1 + exp(-g)) and log(1 + exp(g)).
            if prior is None:
                parts = [(zp, hp, (up_p - 1) / len(p)), (zu, hu, up_u / len(u))]
            else:
                rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
                negative = [(zu, hu, up_u / len(u)), (zp, hp, -prior * up_p / len(p))]
                parts = [(zp, hp, prior * (up_p - 1) / len(p)), *negative] if rest >= 0 else [(z, h, -b) for z, h, b in negative]
            net.step([sum(x) for x in zip(*(net.slopes(*x) for x in parts), strict=True)])
    return net


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 5, margin: float = 0.05) -> float:
    """The share of positives among unlabelled texts."""
    net = train(positive[::2], unlabelled[::2], None, seed, 30)
    p, u = np.sort(net.scores(positive[1::2])), np.sort(net.scores(unlabelled[1::2]))
    if not len(p) or not len(u):
        return 0.5
    cut = np.unique(p)
    above_p, above_u = 1 - np.searchsorted(p, cut) / len(p), 1 - np.searchsorted(u, cut) / len(u)
    slack = np.sqrt(np.log(2 / margin) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    best = int(np.argmin((above_u + slack) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


class QualityModel:
    def __init__(self, p: np.ndarray, u: np.ndarray):
        """Measures of positives and of unlabelled texts.  The prior is the median of several splits' estimates, and the score
        the mean of several networks', as one of either can be off."""
        self.nets, self.prior = [], None
        if len(p) > 3 and len(u) > 3:
            splits = [np.random.default_rng(k) for k in range(SPLITS)]
            self.prior = float(np.median([class_prior(rng.permutation(p), rng.permutation(u)) for rng in splits]))
            self.nets = [train(p, u, self.prior, 9 + k) for k in range(NETWORKS)]

    def scores(self, column: pa.Array) -> np.ndarray:
        x = measures(column)
        return np.mean([net.scores(x) for net in self.nets], axis=0) if self.nets else np.zeros(len(x))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fits on positives among the labels and on unlabelled texts, at most ``rows`` of either, none of them held out.
    Executors measure the whole texts; the driver gets their measures alone."""
    trusted = labelled_ids(labels.filter(F.col(label) == 1), label, rows, id_col)
    ids = documents.select(F.col(id_col).alias("id")).filter(F.col("id").isNotNull() & ~is_held_out(F.col("id"))).distinct()
    some = ids.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(rows).withColumn("label", F.lit(-1))
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = measures(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(rows), pa.list_(pa.float64()))], ["label", "measures"])

    found = texts.join(F.broadcast(trusted.unionByName(some)), "id").select("label", "text").mapInArrow(measure, "label int, measures array<double>").toArrow()
    label_of, rows_of = found.column("label").to_numpy(), np.array(found.column("measures").to_pylist(), np.float64).reshape(-1, MEASURES)
    order = np.lexsort([*rows_of.T, label_of])  # the same at every partitioning
    label_of, rows_of = label_of[order], rows_of[order]
    mixed = np.random.default_rng(1).permutation(len(order))
    return QualityModel(*(rows_of[mixed[label_of[mixed] == k]] for k in (1, -1)))


def score(documents: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", name: str = "score") -> DataFrame:
    """The documents with one more column, the score of the whole text; a column of that name is replaced."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            if isinstance(column, pa.ChunkedArray):
                column = column.combine_chunks()
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            found = [sent.value.scores(x.column("text")) for x in slices(iter([batch]), "text")]
            yield pa.array(np.concatenate(found) if found else np.zeros(0))

    return documents.withColumn(name, F.arrow_udf(run, "double")(F.col(text_col)))


def quality(documents: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(documents.select("doc_id", "text"), fit(documents, labels))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
