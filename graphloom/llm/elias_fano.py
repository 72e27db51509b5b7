"""Monotone sequences in Elias-Fano form, in numpy, for batches of lookups."""

from __future__ import annotations

import json

import numpy as np

_FULL = ~np.uint64(0)
_L1, _L2, _L4, _BYTES, _TOPS = (np.uint64(int(x * 8, 16)) for x in ("55", "33", "0f", "01", "80"))
_U = [np.uint64(i) for i in range(65)]
#: _SET_BIT[byte * 8 + r]: place of set bit number r of the byte
_SET_BIT = np.array([([i for i in range(8) if x >> i & 1] + [0] * 8)[:8] for x in range(256)], np.int64).ravel()


def _in_word(w: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of set bit number r of each word."""
    s = w - ((w >> _U[1]) & _L1)
    s = (s & _L2) + ((s >> _U[2]) & _L2)
    upto = ((s + (s >> _U[4])) & _L4) * _BYTES  # in each byte the set bits up to it
    r = r.astype(np.uint64)
    byte = np.bitwise_count((((r * _BYTES) | _TOPS) - upto) & _TOPS).astype(np.uint64) << _U[3]
    before = ((upto << _U[8]) >> byte) & np.uint64(255)
    return byte.astype(np.int64) + _SET_BIT[(((w >> byte) & np.uint64(255)) << _U[3] | (r - before)).astype(np.int64)]


class EliasFano:
    """Non-decreasing integers: l low bits of each packed, high bits in unary; l is the one of least size."""

    def __init__(self, part: dict[str, np.ndarray], name: str):
        self.low, self.bits, self.ones, self.zeros = (part[f"{name}.{x}"] for x in ("low", "bits", "ones", "zeros"))
        self.n, self.l, self.top = (int(x) for x in part[f"{name}.size"])
        self.mask = np.uint64((1 << self.l) - 1)

    @staticmethod
    def parts(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
        values = np.asarray(values).astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        l = max(0, (top // max(n, 1)).bit_length() - 1)  # noqa: E741
        # 64 values fill l words
        rows = -(-n // 64)
        low = np.zeros((rows, l + 1), np.uint64)
        v = np.zeros(rows * 64, np.uint64)
        v[:n] = values & np.uint64((1 << l) - 1)
        v = v.reshape(rows, 64)
        for j in range(64 if l else 0):
            word, shift = divmod(j * l, 64)
            low[:, word] |= v[:, j] << np.uint64(shift)
            if shift + l > 64:
                low[:, word + 1] |= v[:, j] >> np.uint64(64 - shift)
        low = np.r_[np.ascontiguousarray(low[:, :l]).ravel(), np.zeros(1, np.uint64)]
        high = (values >> np.uint64(l)).astype(np.int64)
        at = high + np.arange(n)
        size = (int(high[-1]) if n else 0) + n + 1
        flags = np.zeros((-(-size // 256) + 1) * 256, np.uint8)
        flags[at] = 1
        bits = np.packbits(flags, bitorder="little").view(np.uint64)
        # set and clear bits before each block of four words
        ones = np.r_[0, np.cumsum(np.bitwise_count(bits).reshape(-1, 4).sum(1, dtype=np.int64))][:-1]
        return {f"{name}.low": low, f"{name}.bits": bits, f"{name}.ones": ones, f"{name}.zeros": np.arange(len(ones)) * 256 - ones, f"{name}.size": np.array([n, l, int(high[-1]) if n else -1], np.int64)}

    def _low(self, i: np.ndarray) -> np.ndarray:
        p = i * self.l
        word, shift = p >> 6, (p & 63).astype(np.uint64)
        return ((self.low[word] >> shift) | (self.low[word + 1] << (_U[64] - shift))) & self.mask

    def _select(self, k: np.ndarray, before: np.ndarray, flip: np.uint64) -> np.ndarray:
        """Place of set bit number k (of clear bit number k where flip is all ones)."""
        block = np.searchsorted(before, k, "right") - 1
        r = k - before[block]
        word = block << 2
        w = self.bits[word] ^ flip
        c = np.bitwise_count(w).astype(np.int64)
        more = np.flatnonzero(r >= c)
        while len(more):
            r[more] -= c[more]
            word[more] += 1
            w[more] = self.bits[word[more]] ^ flip
            c[more] = np.bitwise_count(w[more])
            more = more[r[more] >= c[more]]
        return (word << 6) + _in_word(w, r)

    def _after(self, p: np.ndarray, flip: np.uint64) -> np.ndarray:
        """Place of the first set (clear) bit after place p; p may be -1."""
        p = p + 1
        word = p >> 6
        w = (self.bits[word] ^ flip) & (_FULL << (p & 63).astype(np.uint64))
        more = np.flatnonzero(w == 0)
        if len(more):
            word[more] += 1
            w[more] = self.bits[word[more]] ^ flip
            more = more[w[more] == 0]
        if len(more):  # the run may be long, so not word by word
            before = self.zeros if flip else self.ones
            block = word[more] >> 2
            inside = np.zeros(len(more), np.int64)
            for j in range(4):
                x = (block << 2) + j
                inside += np.where(x < word[more], np.bitwise_count(self.bits[x] ^ flip).astype(np.int64), 0)
            return self._patched(p, word, w, more, before[block] + inside, before, flip)
        return (word << 6) + np.bitwise_count((w & (~w + _U[1])) - _U[1]).astype(np.int64)

    def _patched(self, p, word, w, more, number, before, flip):
        """Places as _after gives them, those of `more` by the number of the bit sought."""
        w[more] = _U[1]
        out = (word << 6) + np.bitwise_count((w & (~w + _U[1])) - _U[1]).astype(np.int64)
        last = before[-1] + int(np.bitwise_count(self.bits[-4:] ^ flip).sum())
        out[more] = np.where(number < last, self._select(np.minimum(number, last - 1), before, flip), len(self.bits) << 6)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        high = self._select(i, self.ones, np.uint64(0)) - i
        return (high << self.l) | self._low(i).astype(np.int64) if self.l else high

    def get_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at places i and i + 1."""
        p = self._select(i, self.ones, np.uint64(0))
        q = self._after(p, np.uint64(0))
        a, b = p - i, q - i - 1
        return ((a << self.l) | self._low(i).astype(np.int64), (b << self.l) | self._low(i + 1).astype(np.int64)) if self.l else (a, b)

    def locate(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first element that is v or more, n where none is; whether it is v)."""
        none = np.zeros(len(v), bool)
        if self.top < 0:
            return np.zeros(len(v), np.int64), none
        high = v >> self.l
        inside = high <= self.top
        h = np.where(inside, high, 0)
        z = np.where(h > 0, self._select(np.maximum(h - 1, 0), self.zeros, _FULL), -1)
        begin, end = z - (h - 1), self._after(z, _FULL) - h
        begin, end = np.where(inside, begin, self.n), np.where(inside, end, self.n)
        last = end.copy()
        if not self.l:
            return begin, begin < last
        low = v.astype(np.uint64) & self.mask
        live = np.flatnonzero(begin < end)
        while len(live):
            mid = (begin[live] + end[live]) >> 1
            less = self._low(mid) < low[live]
            begin[live[less]] = mid[less] + 1
            end[live[~less]] = mid[~less]
            live = live[begin[live] < end[live]]
        ok = np.flatnonzero(begin < last)
        none[ok] = self._low(begin[ok]) == low[ok]
        return begin, none

    def find(self, v: np.ndarray) -> np.ndarray:
        """Place of the first element that is v or more (n where none is)."""
        return self.locate(v)[0]


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays in one file; written beside and renamed, so a task that is run again does no harm."""
    import os
    import uuid

    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    with open(tmp := f"{path}.{uuid.uuid4().hex}", "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 8))
    os.replace(tmp, path)


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped."""
    raw = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(raw[:8].tobytes(), "little")
    out = {}
    for name, (kind, n, at) in json.loads(raw[8 : 8 + size].tobytes()).items():
        kind = np.dtype(kind)
        at += 8 + size
        out[name] = raw[at : at + n * kind.itemsize].view(kind).view(np.ndarray)
    return out
