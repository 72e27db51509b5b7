"""Vectorised tokenising over Arrow buffers, shared by the operators of this folder.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII bytes of the
lower-cased text. Word hashes are 64-bit polynomial hashes of the bytes, mixed; they are the
same on every machine and for every batch size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_RE = r"[a-z0-9_\x{80}-\x{10FFFF}]+"
CHUNK_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_pows: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def mix_int(x: int) -> int:
    return int(mix(np.array([x % (1 << 64)], np.uint64))[0])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _pows or len(_pows["p"]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        for key, base in (("p", _P), ("i", _PINV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _pows[key] = np.multiply.accumulate(a)
    return _pows["p"], _pows["i"]


def forget() -> None:
    """Drops the powers; they are made again, in milliseconds, when next needed."""
    _pows.clear()


def string_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    if not len(col) or col.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, col: str, most: int = CHUNK_BYTES):
    """Row slices of a batch with about `most` bytes of text each, one row at least."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    i = 0
    while i < n:
        j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right"))
        j = max(i + 1, min(j, n))
        yield batch.slice(i, j - i)
        i = j


class Words:
    """hashes: of all words in order; off[d]:off[d+1]: those of text d; start, end: byte spans in raw."""

    def __init__(self, col: pa.Array, lower: bool = True):
        if lower:
            col = pc.utf8_lower(col)
        self._cut(*string_buffer(col), _IS_WORD)

    @classmethod
    def of_bytes(cls, raw: np.ndarray, text_off: np.ndarray, is_word: np.ndarray = _IS_WORD) -> Words:
        """Of bytes at hand; is_word: a flag for each of the 256 bytes."""
        out = cls.__new__(cls)
        out._cut(raw, text_off, is_word)
        return out

    def _cut(self, raw: np.ndarray, text_off: np.ndarray, is_word: np.ndarray) -> None:
        self.raw, self.text_off = raw, text_off
        b, n = self.raw, len(self.raw)
        if not n:
            self.hashes, self.start, self.end = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.off = np.zeros(len(self.text_off), np.int64)
            return
        isw = is_word[b]
        cut = self.text_off[:-1]
        cut = cut[cut < n]
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = isw[:-1]
        before[cut] = False
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = isw[1:]
        after[cut[cut > 0] - 1] = False
        self.start = np.flatnonzero(isw & ~before)
        self.end = np.flatnonzero(isw & ~after) + 1
        p, inv = _powers(n)
        acc = np.empty(n + 1, np.uint64)
        acc[0] = 0
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[:n], out=acc[1:])
        self.hashes = mix((acc[self.end] - acc[self.start]) * inv[self.start])
        self.off = np.searchsorted(self.start, self.text_off)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


_GRAM = [np.uint64(mix_int(1000 + i) | 1) for i in range(64)]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that begin at each place of h; the last n-1 places wrap and mean nothing."""
    out = h * _GRAM[0]
    for j in range(1, n):
        out += np.roll(h, -j) * _GRAM[j]
    return mix(out)


def word_hash(word: str) -> int:
    """Hash of one word, as Words gives it."""
    w = Words(pa.array([word]))
    return int(w.hashes[0]) if len(w.hashes) else 0
