"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of ``WINDOW`` bytes, all of them, so that the whole text is read.  A forward and a backward gated
recurrent network run over each window and the ``AROUND`` bytes on either side, so that states are warm where a window begins and
characters that are cut are read whole; a softmax on both states labels every byte position of the window; a document's
probabilities are the mean over its positions.  Everything is trained in numpy by backpropagation through time.
Positions of bytes that no letter has (ASCII other than letters) are read but not labelled or pooled.

Arrays are laid out with windows last, so a step of many windows is a few matrix products and vectorised gates.

Special input: ``und`` with score 0 for null texts and texts without a letter (as Unicode has it); repeated rows are
labelled alike; texts of any length are read whole, and of very long ones the fit sees stretches spread over them; documents without language teach nothing; without any labelled text every document is ``und`` with
score 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .sampling import LONGEST, texts
from .wordscan import text_bytes
from .workspace import is_held_out, slices

WINDOW, AROUND, HIDDEN = 88, 12, 8
#: Documents of each language, languages, and documents in all, that the model is fitted on, at most.
SAMPLE, LANGUAGES, TOTAL = 250, 200, 4000
_codes = np.arange(256)
LETTER = ((_codes | 32) >= 97) & ((_codes | 32) <= 122) & (_codes < 128) | (_codes >= 128)


def windows(column: pa.Array, size: int = WINDOW, around: int = AROUND) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes by position and window, whether a position is the window's own, text of each window).  Every byte of a text
    is one window's own; beyond a text's ends stands 0."""
    offsets, data = text_bytes(column)
    count = -(-np.diff(offsets) // size)
    text = np.repeat(np.arange(len(count)), count)
    start = offsets[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * size
    place = np.arange(-around, size + around)[:, None]
    at = start + place
    there = (at >= offsets[text]) & (at < offsets[text + 1])
    codes = data[np.clip(at, 0, len(data) - 1)] if len(data) else np.zeros(at.shape, np.uint8)
    return np.where(there, codes, 0).astype(np.uint8), there & (place >= 0) & (place < size), text


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Direction:
    """One gated recurrent network: input weights by byte, recurrent weights; gates z and r, then the candidate."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.hidden = hidden
        self.p = [rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32), (rng.normal(0, hidden**-0.5, (3 * hidden, hidden))).astype(np.float32)]

    def run(self, data: np.ndarray, keep: list | None = None) -> Iterator[np.ndarray]:
        """The state after each step; ``keep`` gets what backpropagation needs."""
        x_by_byte, u = self.p
        n = self.hidden
        h = np.zeros((n, data.shape[1]), np.float32)
        for codes in data:
            x = np.take(x_by_byte, codes, axis=1)
            gates = x[: 2 * n]
            gates += u[: 2 * n] @ h
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:n], gates[n:]
            c = x[2 * n :]
            c += u[2 * n :] @ (r * h)
            np.tanh(c, out=c)
            after = h + z * (c - h)
            if keep is not None:
                keep.append((codes, h, z, r, c))
            h = after
            yield h

    def back(self, kept: list, errors: np.ndarray) -> list[np.ndarray]:
        """Slopes of the weights, from each step's error of the state (steps in running order)."""
        dx, du = (np.zeros_like(p) for p in self.p)
        n, u = self.hidden, self.p[1]
        dh = np.zeros_like(errors[0])
        for (codes, h, z, r, c), error in zip(reversed(kept), errors[::-1], strict=True):
            dh = dh + error
            dc = dh * z * (1 - c * c)
            dz = dh * (c - h) * z * (1 - z)
            drh = u[2 * n :].T @ dc
            dr = drh * h * r * (1 - r)
            da = np.concatenate([dz, dr, dc])
            du[: 2 * n] += da[: 2 * n] @ h.T
            du[2 * n :] += dc @ (r * h).T
            np.add.at(dx.T, codes, da.T)
            dh = dh * (1 - z) + drh * r + u[: 2 * n].T @ da[: 2 * n]
        return [dx, du]


class LanguageModel:
    def __init__(self, names: list[str], hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.names, self.there, self.ahead = names, Direction(rng, hidden), Direction(rng, hidden)
        self.out = [rng.normal(0, 0.3, (len(names), 2 * hidden)).astype(np.float32), np.zeros((len(names), 1), np.float32)]

    def states(self, data: np.ndarray, keep: tuple[list, list] | None = None) -> np.ndarray:
        """Both states at each position: (positions, 2 * hidden, windows)."""
        n = self.there.hidden
        both = np.empty((len(data), 2 * n, data.shape[1]), np.float32)
        for t, h in enumerate(self.there.run(data, keep and keep[0])):
            both[t, :n] = h
        for t, h in enumerate(self.ahead.run(data[::-1], keep and keep[1])):
            both[len(data) - 1 - t, n:] = h
        return both

    def labels(self, both: np.ndarray) -> np.ndarray:
        """Probabilities by position, language and window."""
        x = self.out[0] @ both + self.out[1]
        x -= x.max(axis=1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(axis=1, keepdims=True)
        return x

    def probabilities(self, column: pa.Array) -> np.ndarray:
        """The mean over each text's labelled positions: (texts, languages)."""
        data, real, text = windows(column)
        pooled, count = np.zeros((len(column), len(self.names))), np.zeros(len(column))
        for s in range(0, len(text), 8192):
            part = slice(s, s + 8192)
            p = self.labels(self.states(data[:, part])[AROUND : AROUND + WINDOW])
            counted = (real[:, part] & LETTER[data[:, part]])[AROUND : AROUND + WINDOW].astype(np.float32)
            sums = np.einsum("tlb,tb->bl", p, counted)
            np.add.at(pooled, text[part], sums)
            np.add.at(count, text[part], counted.sum(axis=0))
        return pooled / np.maximum(count, 1)[:, None]

    def train(self, data: np.ndarray, real: np.ndarray, label: np.ndarray, rounds: int = 4, batch: int = 128, rate: float = 0.01, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        params = [*self.there.p, *self.ahead.p, *self.out]
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
        n, k = self.there.hidden, 0
        for _ in range(rounds):
            order = rng.permutation(len(label))
            for s in range(0, len(order) - len(order) % batch or len(order), batch):
                own = order[s : s + batch]
                keep: tuple[list, list] = ([], [])
                x = data[:, own]
                both = self.states(x, keep)
                p = self.labels(both)
                p[:, label[own], np.arange(len(own))] -= 1
                counted = (real[:, own] & LETTER[x]).astype(np.float32)
                p *= counted[:, None] / max(1.0, counted.sum())
                flat = p.transpose(1, 0, 2).reshape(len(self.names), -1)
                slopes = [flat @ both.transpose(1, 0, 2).reshape(2 * n, -1).T, flat.sum(axis=1, keepdims=True)]
                errors = self.out[0].T @ p
                slopes = [*self.there.back(keep[0], errors[:, :n]), *self.ahead.back(keep[1], errors[::-1, n:]), *slopes]
                size = np.sqrt(sum(float((g * g).sum()) for g in slopes))
                k += 1
                for q, g, m in zip(params, slopes, moments, strict=True):
                    g = g * min(1.0, 1 / (size + 1e-9))
                    m[0] = 0.9 * m[0] + 0.1 * g
                    m[1] = 0.999 * m[1] + 0.001 * g * g
                    q -= (rate * (m[0] / (1 - 0.9**k)) / (np.sqrt(m[1] / (1 - 0.999**k)) + 1e-8)).astype(np.float32)


def fit(documents: DataFrame, rows: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", each: int = 12) -> LanguageModel | None:
    """Fits on at most ``rows`` documents of each of the commonest ``LANGUAGES`` languages, ``each`` windows of each
    document spread over its length; none is held out."""
    known = documents.select(F.col(id_col).alias("id"), F.col(lang_col).alias("label")).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & ~is_held_out(F.col("id")))
    names = [r.label for r in known.groupBy("label").count().orderBy(F.desc("count"), "label").limit(LANGUAGES).collect()]
    rows = min(rows, TOTAL // max(1, len(names)))
    first = F.row_number().over(W.Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))
    some = known.filter(F.col("label").isin(names)).withColumn("nth", first).filter(F.col("nth") <= rows).select("id", "label").dropDuplicates(["id"])
    sample = texts(documents, some, "label", id_col, text_col, LONGEST)
    if not sample.num_rows:
        return None
    names = sorted(set(names))
    data, real, text = windows(sample.column("text").combine_chunks())
    if not len(text):
        return None
    place = np.arange(len(text)) - np.searchsorted(text, text)
    size = np.bincount(text)[text]
    chosen = place % np.maximum(size // each, 1) == 0
    model = LanguageModel(names)
    label = np.searchsorted(names, sample.column("label").to_pylist())
    model.train(data[:, chosen], real[:, chosen], label[text[chosen]])
    return model


def identify(documents: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, and probabilities of the model's languages in their order."""
    schema = T.StructType([T.StructField("doc_id", documents.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("probabilities", T.ArrayType(T.DoubleType()))])
    sent = documents.sparkSession.sparkContext.broadcast(model)
    letter = regex.compile(r"\p{L}").search

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            model, n = sent.value, batch.num_rows
            some = np.array([bool(x and letter(x)) for x in batch.column("text").to_pylist()])
            p = model.probabilities(batch.column("text")) if model else np.zeros((n, 0))
            if not model:
                some[:] = False
            best = p.argmax(axis=1) if model else np.zeros(n, int)
            names = [model.names[b] if ok else "und" for b, ok in zip(best.tolist(), some.tolist(), strict=True)]
            score = np.where(some, np.clip(p[np.arange(n), best], 0, 1), 0.0) if model else np.zeros(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(list(p), pa.list_(pa.float64()))], schema.names)

    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def languages(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    found = identify(documents, fit(documents))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
