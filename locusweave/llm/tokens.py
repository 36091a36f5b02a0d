"""Token ids of whole texts by a public tokenizer, a word at a time."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np

from .common import kept
from .words import BYTE_VALUES, mix, spans, word_hashes

#: Words whose ids a Python worker keeps (some 30 bytes each), and bytes of the longest such word.
CACHED, LONGEST = 1_000_000, 64
#: Words that are merged into the kept ones at once.
RECENT = 65_536
#: Bytes of text whose words are looked up at once.
WINDOW = 1 << 18
#: New words that are encoded as one text.
JOINED = 512
#: What may follow a word's letters without changing how they are split.
TRAILING = "!#$%&()*+,-./:;=?@"
#: Bytes that carry no token and part words.
BORDER = np.zeros(256, bool)
BORDER[[0x20, 0x0A]] = True
_OTHER = mix(BYTE_VALUES) | np.uint64(1)


class Words:
    """A tokenizer and the ids of words met before, in sorted arrays of two hashes a word (128 bits).

    Up to `most` words are kept. When they are full, those that were met again
    since the last time stay, so words that never come back don't pile up.
    """

    def __init__(self, path: str, most: int = CACHED) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.model, self.most = Tokenizer.from_file(path), most
        vocabulary = self.model.get_vocab()
        self.kind = np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.old = self.new = self.empty()

    def empty(self) -> tuple[np.ndarray, ...]:
        """hash, second hash, first id in the pool, number of ids, met again; and the pool."""
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool), np.zeros(0, self.kind)

    def place(self, level: tuple[np.ndarray, ...], keys: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Index of each word among a level's, -1 where it is unknown."""
        if not len(level[0]):
            return np.full(len(keys), -1)
        k = np.searchsorted(level[0], keys)
        k[k == len(level[0])] = 0
        return np.where((level[0][k] == keys) & (level[1][k] == others), k, -1)

    def merged(self, a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], only: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Both levels as one; only: which words of the first stay."""
        if only is not None:
            at, n = a[2][only], a[3][only]
            a = (*(x[only] for x in a[:2]), (np.cumsum(n) - n).astype(np.int32), n, np.zeros(len(n), bool), gathered(a[5], at, n))
        b = (*b[:2], b[2] + np.int32(len(a[5])), *b[3:])
        order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        return (*(np.concatenate([x, y])[order] for x, y in zip(a[:5], b[:5], strict=True)), np.concatenate([a[5], b[5]]))

    def flat(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids."""
        return np.array([len(x) for x in ids], np.int32) // np.dtype(self.kind).itemsize, np.frombuffer(b"".join(ids), self.kind)

    def keep(self, keys: np.ndarray, others: np.ndarray, ids: list[bytes]) -> None:
        n, pool = self.flat(ids)
        level = (keys, others, (np.cumsum(n) - n).astype(np.int32), n, np.zeros(len(n), bool), pool)
        order = np.argsort(keys, kind="stable")
        self.new = self.merged(self.new, (*(x[order] for x in level[:5]), level[5]))
        if len(self.new[0]) >= RECENT:
            if len(self.old[0]) + len(self.new[0]) > self.most:
                self.old = self.merged(self.empty(), self.old, None) if self.old[4].all() else self.merged(self.old, self.empty(), self.old[4])
            if len(self.old[0]) + len(self.new[0]) > self.most:
                self.old = self.empty()
            self.old, self.new = self.merged(self.old, self.new), self.empty()

    def ids(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte of each word of the bytes, its number of ids, and the ids of all."""
        starts, ends, _ = spans(data, np.array([0, len(data)]), BORDER)
        if not len(starts):
            return starts, np.zeros(0, np.int64), np.zeros(0, self.kind)
        keys, first, inverse = np.unique(word_hashes(data, starts, ends, BYTE_VALUES), return_index=True, return_inverse=True)
        others = word_hashes(data, starts, ends, _OTHER)[first]
        at, n, parts, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), [], 0
        left = np.arange(len(keys))
        for level in (self.new, self.old):
            k = self.place(level, keys[left], others[left])
            hit = k >= 0
            level[4][k[hit]] = True
            at[left[hit]], n[left[hit]] = level[2][k[hit]] + size, level[3][k[hit]]
            parts.append(level[5])
            size += len(level[5])
            left = left[~hit]
        if len(left):
            raw, spot = data.tobytes(), first[left]
            found = self.learn([raw[a:b].decode() for a, b in zip(starts[spot].tolist(), ends[spot].tolist(), strict=True)])
            n[left], pool = self.flat(found)
            at[left] = size + np.cumsum(n[left]) - n[left]
            parts.append(pool)
            short = (ends[spot] - starts[spot]) <= LONGEST
            self.keep(keys[left[short]], others[left[short]], [x for x, ok in zip(found, short, strict=True) if ok])
        return starts, n[inverse], gathered(np.concatenate(parts), at[inverse], n[inverse])

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of words; a word of letters and marks after them has the ids of the two, and letters those of lower case."""
        plain, other = [], []
        for w in words:
            core = w.rstrip(TRAILING)
            if core.isascii() and core.isalpha() or "Σ" not in core and unicodedata.normalize("NFC", core).lower().isalpha():
                plain.append((w, core.lower(), w[len(core) :]))
            else:
                other.append(w)
        known, width = {"": b""}, np.dtype(self.kind).itemsize
        fresh = list({x for _, core, tail in plain for x in (core, tail)}.difference(known))
        for i in range(0, len(fresh), JOINED):
            part = fresh[i : i + JOINED]
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            stops = (width * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) == len(part):
                raw = ids.tobytes()
                known.update(zip(part, (raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)), strict=True))
            else:
                known.update((w, self.encoded(w)) for w in part)
        found = {w: known[core] + known[tail] for w, core, tail in plain}
        found.update((w, self.encoded(w)) for w in other)
        return [found[w] for w in words]

    def encoded(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, self.kind).tobytes()


def gathered(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs pool[at : at + n], joined."""
    if not len(n):
        return pool[:0]
    before = np.cumsum(n) - n
    return pool[np.repeat(at - before, n) + np.arange(before[-1] + n[-1])]


def windows(data: np.ndarray, most: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Ranges of about `most` bytes that end between words."""
    i = 0
    while i < len(data):
        j = i + most
        while j < len(data):
            border = np.flatnonzero(BORDER[data[j : j + most]])
            if len(border):
                j += int(border[0])
                break
            j += most
        yield i, min(j, len(data))
        i = j


def document_ids(path: str, data: np.ndarray, offsets: np.ndarray, end: int | None = None) -> Iterator[np.ndarray]:
    """Ids of each text (bytes and row offsets) as unsigned 32-bit numbers, with `end` after them.

    The tokenizer must treat blanks and line breaks as borders that carry no
    token, as one of words with word ends does: then the ids of a text are those
    of its parts between them, and frequent parts are encoded once a worker. The
    texts of many rows are looked up together, long ones in windows.
    """
    model = kept(("words", path), lambda: Words(path))
    tail = np.zeros(0, "<u4") if end is None else np.array([end], "<u4")
    i, rows = 0, len(offsets) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + WINDOW, "right")) - 1)
        if j == i + 1:
            whole = data[offsets[i] : offsets[j]]
            yield np.concatenate([*(model.ids(whole[a:b])[2].astype("<u4") for a, b in windows(whole)), tail])
        else:
            # a border between rows, so that no word spans two
            low, high = int(offsets[i]), int(offsets[j])
            row = np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1]))
            joined = np.full(high - low + j - i, 0x20, np.uint8)
            joined[np.arange(high - low) + row] = data[low:high]
            starts, n, ids = model.ids(joined)
            total = np.concatenate([[0], np.cumsum(n)])
            first = total[np.searchsorted(starts, offsets[i : j + 1] - low + np.arange(j - i + 1))]
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                yield np.concatenate([ids[a:b].astype("<u4"), tail])
        i = j
