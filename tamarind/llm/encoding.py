"""Token ids of whole texts, as the tokenizers library gives them, by vectorised byte-pair merging.

The tokenizer files this serves lower-case a text, drop its white space, cut it into pre-tokens (runs of letters,
single digits, runs of other characters, and English contractions) and merge the bytes of each pre-token.  A batch's
distinct pre-tokens are merged together, a column of words of one length at a time, and looked up for all places.
Texts with characters beyond ASCII and the Latin-1 letters, or with a special token, go through the library itself,
chunk by chunk between spaces.  Both ways give the library's ids.  A file with another normaliser or pre-tokenizer goes through the library as a whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from .wordscan import mix, powers, text_bytes

#: Longer pre-tokens go through the library's own model.
LONGEST = 40
#: Chunks that a worker keeps of the texts that the library encodes, and pre-tokens that it keeps merged.
KEPT, MERGED = 100_000, 600_000
NONE = np.int32(2**31 - 1)
# The normaliser and pre-tokenizer that this module's own pass follows.  Files with others go through the library.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
SPACE, LETTER, DIGIT, OTHER, FOREIGN = range(5)


def byte_letters() -> list[str]:
    """The letter that byte-level encodings write for each byte: printable Latin-1 itself, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def byte_kinds() -> np.ndarray:
    kinds = np.full(256, FOREIGN, np.uint8)
    kinds[0x21:0x7F] = OTHER
    kinds[[9, 10, 11, 12, 13, 32]] = SPACE
    kinds[0x30:0x3A] = DIGIT
    kinds[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
    return kinds


class PairTable:
    """(left id, right id) -> (rank, merged id), by open addressing, for whole arrays at once."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray, bits: int = 18):
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, NONE, np.int32)
        self.merged = np.zeros(1 << bits, np.int32)
        wanted = pairs[:, 0].astype(np.int64) << 32 | pairs[:, 1]
        left, slot = np.arange(len(pairs)), self.slot(wanted)
        while len(left):
            free = self.keys[slot] < 0
            _, one = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            one = one[free[one]]
            self.keys[slot[one]], self.rank[slot[one]], self.merged[slot[one]] = wanted[left[one]], left[one], merged[left[one]]
            rest = np.ones(len(left), bool)
            rest[one] = False
            left, slot = left[rest], (slot[rest] + 1) % len(self.keys)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left.astype(np.int64) << 32 | right
        at = self.slot(keys)
        rank, merged = self.rank[at], self.merged[at]
        held = self.keys[at]
        missed = np.flatnonzero(held != keys)
        rank[missed] = NONE
        missed = missed[held[missed] >= 0]
        step = 0
        while len(missed):
            step += 1
            spot = (at[missed] + step) % len(self.keys)
            held = self.keys[spot]
            hit = held == keys[missed]
            rank[missed[hit]], merged[missed[hit]] = self.rank[spot[hit]], self.merged[spot[hit]]
            missed = missed[~hit & (held >= 0)]
        return rank, merged


class BatchEncoder:
    def __init__(self, path: str, special: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        self.library.encode_special_tokens = not special
        self.own = (held["normalizer"], held["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER) and model["type"] == "BPE" and bool(model["end_of_word_suffix"])
        if not self.own:
            return
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.table = PairTable(np.array([(vocab[a], vocab[b]) for a, b in pairs], np.int64), np.array([vocab[a + b] for a, b in pairs], np.int32))
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int32)
        self.last = np.array([vocab[x + suffix] for x in letters], np.int32)
        self.letters = dict(enumerate(letters))
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()] if special else []
        self.kinds = byte_kinds()
        self.kept: dict[bytes, np.ndarray] = {}
        self.forget()

    def forget(self) -> None:
        """Drops the merged pre-tokens: their marks in order, how many ids each has, where they begin in the pool."""
        self.marks, self.length, self.begin, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    # Texts that need the library.

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def by_chunks(self, text: bytes) -> np.ndarray:
        if any(s in text for s in self.special):
            return self.whole(text.decode())
        ids = []
        for chunk in text.split():
            if (x := self.kept.get(chunk)) is None:
                x = self.whole(chunk.decode())
                if len(self.kept) >= KEPT:
                    self.kept.clear()
                if len(chunk) <= 64:
                    self.kept[chunk] = x
            ids.append(x)
        return np.concatenate(ids) if ids else np.zeros(0, np.int32)

    # All other texts.

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(first, ids): the ids of row i are ids[first[i]:first[i + 1]]; null is empty."""
        if not self.own:
            parts = [self.whole(x or "") for x in column.to_pylist()]
            return np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64), np.concatenate([np.zeros(0, np.int32), *parts])
        offsets, data = text_bytes(column)
        n = len(offsets) - 1
        kinds = self.kinds[data]
        latin = np.flatnonzero(data[:-1] == 0xC3)
        latin = latin[(data[latin + 1] & 0xC0 == 0x80) & ~np.isin(data[latin + 1], [0x97, 0xB7])]
        kinds[latin] = kinds[latin + 1] = LETTER
        low = data + (((data >= 0x41) & (data <= 0x5A)) * np.uint8(32))
        upper = latin[data[latin + 1] < 0x9F] + 1
        low[upper] += np.uint8(32)
        foreign = np.zeros(n, bool)
        foreign[np.searchsorted(offsets, np.flatnonzero(kinds == FOREIGN), "right") - 1] = True
        if len(data):
            signs = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
            for at in signs:
                if any(data[at : at + len(s)].tobytes() == s for s in self.special):
                    foreign[np.searchsorted(offsets, at, "right") - 1] = True
        starts, ends = self.spans(offsets, data, kinds)
        row = np.searchsorted(offsets, starts, "right") - 1
        if foreign.any():
            keep = ~foreign[row]
            starts, ends, row = starts[keep], ends[keep], row[keep]
        place, length, pool, begin = self.merged(low, starts, ends)
        sizes = np.bincount(row, weights=length[place], minlength=n).astype(np.int64)
        ids = gather(pool, begin[place], length[place])
        if foreign.any():
            first = np.concatenate([[0], np.cumsum(sizes)])
            parts, done = [], 0
            for i in np.flatnonzero(foreign):
                own = self.by_chunks(data[offsets[i] : offsets[i + 1]].tobytes())
                parts += [ids[done : first[i]], own]
                done, sizes[i] = first[i], len(own)
            ids = np.concatenate([*parts, ids[done:]])
        return np.concatenate([[0], np.cumsum(sizes)]), ids

    def spans(self, offsets: np.ndarray, data: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start = np.empty(n, bool)
        start[0], start[1:] = True, kinds[1:] != kinds[:-1]
        start |= kinds == DIGIT
        borders = offsets[offsets < n]
        start[borders] = True
        # Contractions: an apostrophe that starts a pre-token takes some letters that follow it.
        for at in np.flatnonzero((data == 0x27) & start):
            stop = offsets[np.searchsorted(offsets, at, "right")]
            after = data[at + 1 : min(stop, at + 3)].tobytes().lower()
            size = 2 if after[:1] in (b"s", b"t", b"m", b"d") else 3 if after in (b"re", b"ve", b"ll") else 0
            if size:
                start[at + 1] = False
                if at + size < n and not (at + size == stop):
                    start[at + size] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], n)
        token = kinds[starts] != SPACE
        return starts[token], ends[token]

    def merged(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Merges each new distinct pre-token once: (its number for every place; by number: ids' count; all ids; where they begin)."""
        up, down = powers(len(low) + 1)
        sums = np.zeros(len(low) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        size = ends - starts
        marks = mix((sums[ends] - sums[starts]) * down[starts] + size.astype(np.uint64))
        marks, some, place = np.unique(marks, return_index=True, return_inverse=True)
        if len(self.marks) + len(marks) > MERGED:
            self.forget()
        spot = np.searchsorted(self.marks, marks)
        new = np.ones(len(marks), bool)
        inner = spot < len(self.marks)
        new[inner] = self.marks[spot[inner]] != marks[inner]
        if new.any():
            length, begin, pool = self.merge(low, starts[some[new]], size[some[new]])
            begin += len(self.pool)
            self.pool = np.concatenate([self.pool, pool])
            self.length, self.begin = np.insert(self.length, spot[new], length), np.insert(self.begin, spot[new], begin)
            self.marks = np.insert(self.marks, spot[new], marks[new])
            spot = np.searchsorted(self.marks, marks)
        return place, self.length[spot], self.pool, self.begin[spot]

    def merge(self, low: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        length, begin, pools, total = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), [], 0
        order = np.argsort(size, kind="stable")
        cuts = np.searchsorted(size[order], np.arange(1, LONGEST + 2))
        for k in range(LONGEST):
            group = order[cuts[k] : cuts[k + 1]]
            if len(group):
                for words, ids in self.columns(low[at[group][:, None] + np.arange(k + 1)]):
                    own = group[words]
                    length[own], begin[own] = ids.shape[1], total + np.arange(len(own)) * ids.shape[1]
                    pools.append(ids.ravel())
                    total += ids.size
        for one in order[cuts[LONGEST] :]:
            text = low[at[one] : at[one] + size[one]].tobytes().decode("latin-1").translate(self.letters)
            ids = np.array([t.id for t in self.library.model.tokenize(text)], np.int32)
            length[one], begin[one] = len(ids), total
            pools.append(ids)
            total += len(ids)
        return length, begin, np.concatenate(pools)

    def columns(self, letters: np.ndarray):
        """Merges words of equal length, one pair of each at a time; yields those that are done: (numbers, ids)."""
        ids = self.inner[letters]
        ids[:, -1] = self.last[letters[:, -1]]
        words = np.arange(len(ids))
        rank, into = np.empty((len(ids), ids.shape[1] - 1), np.int32), np.empty((len(ids), ids.shape[1] - 1), np.int32)
        for j in range(ids.shape[1] - 1):
            rank[:, j], into[:, j] = self.table.find(ids[:, j], ids[:, j + 1])
        while ids.shape[1] > 1:
            rows = np.arange(len(ids))
            best = rank.argmin(axis=1)
            open_ = rank[rows, best] < NONE
            if not open_.all():
                yield words[~open_], ids[~open_]
                words, ids, rank, into, best = words[open_], ids[open_], rank[open_], into[open_], best[open_]
                rows = np.arange(len(ids))
                if not len(ids):
                    return
            ids[rows, best] = into[rows, best]
            columns = np.arange(ids.shape[1] - 1)
            ids = np.where(columns > best[:, None], ids[:, 1:], ids[:, :-1])
            columns = columns[:-1]
            rank = np.where(columns >= best[:, None], rank[:, 1:], rank[:, :-1])
            into = np.where(columns >= best[:, None], into[:, 1:], into[:, :-1])
            for shift in (-1, 0):
                spot = best + shift
                ok = np.flatnonzero((spot >= 0) & (spot < ids.shape[1] - 1))
                rank[ok, spot[ok]], into[ok, spot[ok]] = self.table.find(ids[ok, spot[ok]], ids[ok, spot[ok] + 1])
        if len(ids):
            yield words, ids


def gather(pool: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Joins pool[begin[i]:begin[i] + length[i]] for all i."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(begin - (ends - length), length) + np.arange(total)] if total else pool[:0]


_encoders: dict[tuple[str, bool], BatchEncoder] = {}


def encoder(path: str, special: bool = True) -> BatchEncoder:
    """One encoder for each worker process and tokenizer file; without ``special``, special tokens are ordinary text."""
    if (path, special) not in _encoders:
        _encoders[path, special] = BatchEncoder(path, special)
    return _encoders[path, special]
