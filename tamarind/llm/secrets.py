"""Secret scan: fixed patterns, and a character convolutional network over every other candidate.

A candidate is a longest run of the characters that keys are written in, at least ``SHORTEST`` long and with a letter or
a digit, unless base findings cover all of it: one that reaches beyond them is judged as a whole.  The network reads all of it, in windows of ``SHOWN`` characters that
overlap, with ``AROUND`` characters on either side; a candidate's score is that of its worst window.  The network is
embeddings, a convolution, ReLU, the maximum and mean over positions, and a logistic unit, trained in numpy by Adam.  It is
trained on labelled findings: base findings of a bounded sample of texts, and keys of common makes generated into
contexts of the corpus, alone or within paths and slugs, against generated runs that are none.  The sample's candidates that no
pattern confirms are unlabelled, for real keys can be among them: a first network, trained without them, judges
them, and only those that it finds unlikely are examples of what is no secret.  Half of the findings calibrate the
second network: their logits get a scale and shift, and the threshold is the greatest one that keeps ``RECALL`` of the positives that
are candidates, which is what the network judges; base findings, which it never judges, only train it.

Texts without any separator, prefix or run are passed over after one vectorised look at their bytes; all others
are read whole.

Special input: null is an empty text, without spans; a text of any length is read whole, in time in proportion to its length (of
very long ones the fit sees stretches spread over them); repeated rows are scanned alike; an empty table gives no rows;
other columns are ignored.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import sigmoid
from .sampling import LONGEST, texts
from .wordscan import spans, text_bytes
from .workspace import slices

KINDS = ("assign", "access", "hex", "network")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
WRITTEN = re.compile(r"[A-Za-z0-9]")
SHORTEST, AROUND, SHOWN = 16, 16, 48
#: Windows start so far apart: any key of that length is whole in one of them.
STEP = 24
RECALL = 0.98
#: What redaction writes in place of a finding.
MARK = "[SECRET]"
#: Texts that the network's findings come from, at most.
SAMPLE = 3000
#: Windows of either kind that it is trained and calibrated on, at most.
WINDOWS = 12_000
_codes = np.arange(256)
DIGIT = (_codes >= 48) & (_codes <= 57)
ALPHA = ((_codes | 32) >= 97) & ((_codes | 32) <= 122) & (_codes < 128)
IN_HEX = DIGIT | (_codes >= 97) & (_codes <= 102)
IN_RUN = DIGIT | ALPHA | np.isin(_codes, [*b"+/_=-"])
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: 0 pads; 1 other characters; then ASCII from the space on.
SYMBOLS = 97


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out, k = [], 0
    for m in RUN.finditer(text):
        a, b = m.span()
        if b - a < SHORTEST or not WRITTEN.search(m[0]):
            continue
        # Base findings that begin before the end of the run: how far do they cover it without a gap?
        while k < len(base) and base[k][2] <= a:
            k += 1
        reached, at = a, k
        while at < len(base) and base[at][0] <= reached < b:
            reached = max(reached, base[at][2])
            at += 1
        if reached < b:
            out.append((a, b))
    return out


def worth_reading(column: pa.Array) -> np.ndarray:
    """Which texts can hold a span: one with a separator of assignments, or a run that is long enough."""
    offsets, data = text_bytes(column)
    may = np.zeros(len(offsets) - 1, bool)
    for inside, least in ((IN_HEX[data], 24), (IN_RUN[data], SHORTEST)):
        a, b = spans(offsets, inside)
        a = a[b - a >= least]
        may[np.searchsorted(offsets, a, "right") - 1] = True
    signs = np.flatnonzero((data == 0x3A) | (data == 0x3D))
    may[np.searchsorted(offsets, signs, "right") - 1] = True
    return may


def windows(a: int, b: int) -> list[tuple[int, int]]:
    """Overlapping windows over all of a candidate."""
    if b - a <= SHOWN:
        return [(a, b)]
    return [(s, s + SHOWN) for s in (*range(a, b - SHOWN, STEP), b - SHOWN)]


def pictures(items: list[tuple[str, int, int]]) -> np.ndarray:
    """What the network sees of windows (text, start, end): context, the window's characters, context."""
    out = np.zeros((len(items), 2 * AROUND + SHOWN), np.uint8)
    for row, (text, a, b) in zip(out, items, strict=True):
        codes = np.frombuffer(text[max(0, a - AROUND) : b + AROUND].encode("utf-32-le"), "<u4")
        at = max(0, AROUND - a)
        row[at : at + len(codes)] = np.where((codes >= 32) & (codes < 127), codes - 30, 1)
    return out


class Detector:
    """Embedding (97, 8) -> convolution of width 5, 32 filters -> ReLU -> maximum and mean -> logistic."""

    def __init__(self, seed: int = 4, size: int = 8, width: int = 5, filters: int = 32):
        rng = np.random.default_rng(seed)
        self.width = width
        self.p = [rng.normal(0, 0.5, (SYMBOLS, size)), rng.normal(0, (width * size) ** -0.5, (width * size, filters)), np.zeros(filters), rng.normal(0, filters**-0.5, 2 * filters), np.zeros(1)]
        self.scale, self.shift, self.threshold = 1.0, 0.0, 2.0

    def forward(self, x: np.ndarray):
        e = self.p[0][x]
        n = x.shape[1] - self.width + 1
        columns = np.concatenate([e[:, k : k + n] for k in range(self.width)], axis=2)
        h = np.maximum(columns @ self.p[1] + self.p[2], 0)
        most = h.argmax(axis=1)
        pooled = np.concatenate([h.max(axis=1), h.mean(axis=1)], axis=1)
        return columns, h, most, pooled, pooled @ self.p[3] + self.p[4][0]

    def train(self, x: np.ndarray, y: np.ndarray, rounds: int = 12, batch: int = 64, rate: float = 0.004, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in self.p]
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        step = 0
        for _ in range(rounds):
            order = rng.permutation(len(y))
            for s in range(0, len(order), batch):
                own = order[s : s + batch]
                columns, h, most, pooled, out = self.forward(x[own])
                error = (sigmoid(out) - y[own]) * weight[own] / len(own)
                slopes = [None, None, None, pooled.T @ error, np.array([error.sum()])]
                back = error[:, None] * self.p[3]
                f = h.shape[2]
                dh = np.repeat(back[:, None, f:] / h.shape[1], h.shape[1], axis=1)
                i, j = np.ogrid[: len(own), :f]
                dh[i, most, j] += back[:, :f]
                dh *= h > 0
                slopes[2] = dh.sum(axis=(0, 1))
                slopes[1] = np.tensordot(columns, dh, axes=([0, 1], [0, 1]))
                dc = dh @ self.p[1].T
                size, n = self.p[0].shape[1], h.shape[1]
                de = np.zeros((len(own), x.shape[1], size))
                for k in range(self.width):
                    de[:, k : k + n] += dc[:, :, k * size : (k + 1) * size]
                slopes[0] = np.zeros_like(self.p[0])
                np.add.at(slopes[0], x[own].ravel(), de.reshape(-1, size))
                step += 1
                for p, g, m in zip(self.p, slopes, moments, strict=True):
                    m[0] = 0.9 * m[0] + 0.1 * g
                    m[1] = 0.999 * m[1] + 0.001 * g * g
                    p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float, first: np.ndarray | None = None) -> None:
        """x holds windows; those of candidate i, which is labelled y[i], begin at first[i] (one each, if None)."""
        out = self.logits(x)
        if first is not None:
            out = np.maximum.reduceat(out, first)
        for _ in range(400):
            error = (sigmoid(out * self.scale + self.shift) - y) / len(y)
            self.scale = max(0.05, self.scale - 0.5 * float((error * out).sum()))
            self.shift -= 0.5 * float(error.sum())
        good = np.sort(sigmoid(out * self.scale + self.shift)[y == 1])
        self.threshold = float(good[int((1 - recall) * len(good))]) if len(good) else 2.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = [self.forward(x[s : s + 256])[-1] for s in range(0, len(x), 256)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) * self.scale + self.shift)

    def judge(self, items: list[tuple[str, int, int]], at_once: int = 1 << 13) -> np.ndarray:
        """The greatest score of each candidate's windows, of which some thousand are held at a time."""
        best, held, owner = np.zeros(len(items)), [], []

        def settle() -> None:
            np.maximum.at(best, owner, self.scores(pictures(held)))
            held.clear(), owner.clear()

        for i, (text, a, b) in enumerate(items):
            for w in windows(a, b):
                held.append((text, *w))
                owner.append(i)
                if len(held) >= at_once:
                    settle()
        if held:
            settle()
        return best


def firsts(parts: list[list]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64)


def generated(rng: np.random.Generator) -> str:
    """A key of a common make: a prefix and random characters of a base."""
    # Prefixes that services give their keys.
    prefix = ("", "", "ghp_", "sk-", "xoxb-", "AIza", "glpat-", "eyJ", "npm_", "pk_live_", "SG")[rng.integers(11)]
    lower, upper, digits = LETTERS[:26], LETTERS[26:52], LETTERS[52:]
    bases = (LETTERS, LETTERS + "+/", LETTERS + "_-", upper + digits, lower + digits, digits + "abcdef", lower + upper, lower, upper)
    base = bases[rng.choice(9, p=(0.2, 0.15, 0.15, 0.1, 0.1, 0.05, 0.1, 0.075, 0.075))]

    def some(base: str, least: int, most: int) -> str:
        return "".join(base[i] for i in rng.integers(len(base), size=rng.integers(least, most)))

    if rng.integers(10) == 0:  # a part that a base pattern matches, and more behind it
        return f"{('xkeysib-', 'key-', prefix)[rng.integers(3)]}{some(digits + 'abcdef', 24, 65)}-{some(LETTERS, 8, 33)}"
    return prefix + some(base, max(4, SHORTEST - len(prefix)), 60)


def fit(documents: DataFrame, rows: int = SAMPLE, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> Detector:
    """Fits on at most ``rows`` texts, of at most ``longest`` bytes, those whose ids' hashes are least."""
    ids = documents.select(F.col(id_col).alias("id")).filter("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(rows)
    sample = texts(documents, ids.withColumn("label", F.lit(0)), "label", id_col, text_col, longest).column("text").to_pylist()
    rng = np.random.default_rng(8)
    # Runs as (text, start, end, start and end of the key in it).
    positive, negative, unlabelled = [], [], []
    for text in sample:
        base = base_spans(text)
        positive += [(text, a, b, a, b) for a, _, b in base]
        unlabelled += [(text, a, b, a, b) for a, b in candidates(text, base)]
    # Generated keys, and runs that are none (words joined by signs, numbers, paths), in places of the corpus.
    words = sorted({w for text in sample for w in text.split()[:100] if w.isascii() and w.isalpha()}) or ["word"]

    def joined(least: int, most: int) -> str:
        sign = "-_/+"[rng.integers(4)]
        parts = [words[i] for i in rng.integers(len(words), size=rng.integers(least, most))]
        parts.insert(int(rng.integers(len(parts) + 1)), str(rng.integers(3000)))
        return sign + sign.join(parts) + sign

    def placed(run: str, a: int, b: int) -> tuple[str, int, int, int, int]:
        text = sample[rng.integers(len(sample))] if sample else ""
        at = int(rng.integers(len(text) + 1))
        before = text[max(0, at - 40) : at] + " "
        text, s = f"{before}{run} {text[at : at + 40]}", len(before)
        found = [m.span() for m in RUN.finditer(text) if m.start() <= s + a and m.end() >= s + b]
        return text, *(found[0] if found else (s, s + len(run))), s + a, s + b

    for k in range(4000):
        key, before, after = generated(rng), "", ""
        if k % 2:
            before, after = (joined(0, 8) if rng.integers(4) else "" for _ in range(2))
        positive.append(placed(before + key + after, len(before), len(before) + len(key)))
        together = "".join(words[i].lower() if k % 8 else words[i].capitalize() for i in rng.integers(len(words), size=rng.integers(2, 6)))
        negative.append(placed(together, 0, len(together)))
        plain = joined(2, 16 if k % 4 == 3 else 6) if k % 2 else "-".join(str(x) for x in rng.integers(10_000, size=5)) + words[rng.integers(len(words))]
        negative.append(placed(plain.strip("-_/+") if k % 3 else plain, 0, len(plain)))
    positive, negative = ([x[i] for i in rng.permutation(len(x))[:8000]] for x in (positive, negative))
    # What is no candidate teaches nothing as an example of what isn't a secret.
    negative = [r for r in negative if r[2] - r[1] >= SHORTEST]

    def shown(runs: list, ours: bool) -> list[tuple[str, int, int]]:
        """Windows to learn from: of a key's run, those that hold as much of the key as any window has to."""
        out = [(text, c, d) for text, a, b, s, e in runs for c, d in windows(a, b) if not ours or min(d, e) - max(c, s) >= min(e - s, STEP)]
        return [out[i] for i in rng.permutation(len(out))[:WINDOWS]]

    def apart(runs: list) -> list[list[tuple[str, int, int]]]:
        """The windows of each run, as far as there is room."""
        parts = [[(text, *w) for w in windows(a, b)] for text, a, b, _, _ in runs]
        return [p for p, n in zip(parts, np.cumsum([len(p) for p in parts]), strict=True) if n <= WINDOWS]

    def trained(rounds: int) -> Detector:
        detector = Detector()
        x = [pictures(shown(runs[::2], ours)) for runs, ours in ((positive, True), (negative, False))]
        detector.train(np.concatenate(x), np.repeat([1, 0], [len(x[0]), len(x[1])]), rounds)
        return detector

    unlabelled = [unlabelled[i] for i in rng.permutation(len(unlabelled))[:4000]]
    if unlabelled:
        likely = sigmoid(trained(4).judge([r[:3] for r in unlabelled])) >= 0.5
        negative += [r for r, yes in zip(unlabelled, likely.tolist(), strict=True) if not yes]
        negative = [negative[i] for i in rng.permutation(len(negative))]
    detector = trained(12)
    judged = [r for r in positive[1::2] if (r[1], r[2]) in candidates(r[0], base_spans(r[0]))]
    good, bad = apart(judged), apart(negative[1::2])
    detector.calibrate(pictures([w for p in good + bad for w in p]), np.repeat([1, 0], [len(good), len(bad)]), recall, firsts(good + bad))
    return detector


def masked(text: str, findings: list[tuple[int, int]]) -> str:
    """The text with a mark in place of every finding, or of findings that overlap."""
    parts, at = [], 0
    for a, b in sorted(findings):
        if a >= at:
            parts += [text[at:a], MARK]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def find_secrets(documents: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), redacted: str | None = None) -> DataFrame:
    """doc_id, the columns in ``keep``, and findings: kind, start, end, score (1 for base findings), in order; and, with
    ``redacted``, a column of that name: the text with a mark in place of every finding (null stays null)."""
    finding = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    kept = [c for c in keep if c != id_col]
    schema = T.StructType([T.StructField("doc_id", documents.schema[id_col].dataType), *(documents.schema[c] for c in kept), T.StructField("findings", T.ArrayType(finding)), *([T.StructField(redacted, T.StringType())] if redacted else [])])
    sent = documents.sparkSession.sparkContext.broadcast(detector)  # a few thousand numbers
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            column, found = batch.column("__text"), [[] for _ in range(batch.num_rows)]
            items, owner, read = [], [], {}
            for i in np.flatnonzero(worth_reading(column)).tolist():
                text = read[i] = column[i].as_py()
                base = base_spans(text)
                found[i] = [{"kind": KINDS[k], "start": a, "end": b, "score": 1.0} for a, k, b in base]
                for a, b in candidates(text, base):
                    items.append((text, a, b))
                    owner.append(i)
            if items:
                for i, (_, a, b), s in zip(owner, items, sent.value.judge(items).tolist(), strict=True):
                    if s >= sent.value.threshold:
                        found[i].append({"kind": KINDS[3], "start": a, "end": b, "score": s})
            found = [sorted(x, key=lambda f: (f["start"], KINDS.index(f["kind"]))) for x in found]
            arrays = [*(batch.column(f"__{c}") for c in ["id", *kept]), pa.array(found, kind)]
            if redacted:
                texts = column.to_pylist()
                for i, x in enumerate(found):
                    if x:
                        texts[i] = masked(read[i], [(f["start"], f["end"]) for f in x])
                arrays.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return documents.select(F.col(id_col).alias("__id"), *(F.col(c).alias(f"__{c}") for c in kept if c != text_col), F.col(text_col).alias("__text")).mapInArrow(run, schema)
