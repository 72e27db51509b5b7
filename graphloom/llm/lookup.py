"""Tables of 64-bit keys that tasks look up: sorted arrays in files of the shared folder, mapped when first asked.

A table is cut by ranges of its keys into parts, one file each, so no task or driver ever holds it
whole; batches of keys are looked up in ascending order, so that each part is read from front to back.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .elias_fano import load, save
from .store import mounted, new_path


def pack(values: np.ndarray) -> bytes:
    """Ascending 64-bit values: differences, the bytes of equal weight side by side, compressed."""
    d = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()) if len(d) else b""


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_any(data), dtype=np.uint64)


def pack_any(values: np.ndarray) -> bytes:
    """64-bit values in any order, the same way without differences."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()) if len(values) else b""


def unpack_any(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel()


def trim() -> None:
    """Gives freed memory and the powers of word hashes back to the system; a worker that goes on to its next task, or waits for one, would keep them."""
    text.forget()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def trimmed(make):
    """make (batches to batches), giving freed memory back when its task ends."""

    def run(batches):
        yield from make(batches)
        trim()

    return run


def bounds(parts: int, bits: int = 64) -> np.ndarray:
    """The first key of each part but the first, of keys under 2**bits."""
    return np.array([-(-(p << bits) // parts) for p in range(1, parts)], np.uint64)


def sorted_with_places(keys: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, their places) for keys under 2**bits."""
    room = max(1, int(len(keys)).bit_length())
    if bits + room <= 64:
        x = (keys << np.uint64(room)) | np.arange(len(keys), dtype=np.uint64)
        x.sort()
        return x >> np.uint64(room), (x & np.uint64((1 << room) - 1)).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    return keys[order], order


class Lookup:
    """Reader of a table in folder `at`."""

    def __init__(self, at: str, parts: int, bits: int = 64):
        self.at, self.parts, self.bits, self.cuts, self.open = at, parts, bits, bounds(parts, bits), {}

    def part(self, p: int) -> dict[str, np.ndarray] | None:
        if p not in self.open:
            path = f"{self.at}/{p}"
            self.open[p] = load(path) if os.path.exists(path) else None
        return self.open[p]

    def find(self, keys: np.ndarray, columns: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(found, values of each column; 0 where not found), for keys in ascending order."""
        found = np.zeros(len(keys), bool)
        values = [np.zeros(len(keys), np.int64) for _ in columns]
        ends = np.searchsorted(keys, self.cuts)
        for p, (a, b) in enumerate(zip(np.r_[0, ends], np.r_[ends, len(keys)])):
            if a < b and (t := self.part(p)) is not None and len(t["key"]):
                at = np.minimum(np.searchsorted(t["key"], keys[a:b]), len(t["key"]) - 1)
                ok = t["key"][at] == keys[a:b]
                found[a:b] = ok
                for v, name in zip(values, columns):
                    v[a:b][ok] = t[name][at[ok]]
        return found, values


def folder(spark, name: str) -> str:
    """A new folder that all executors see as a plain path, deleted with the driver's process at the latest."""
    at = mounted(new_path(spark, name))
    os.makedirs(at)
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at


def write(rows: DataFrame, key: str, columns: list[str], rows_a_part: int = 4_000_000) -> tuple[str, int]:
    """(folder, parts) of a table of rows (key long, columns long); keys are taken as unsigned and must be distinct."""
    spark = rows.sparkSession
    parts = max(1, -(-rows.count() // rows_a_part))
    at = folder(spark, "lookup")

    def place(batches):
        cuts = bounds(parts)
        for b in batches:
            p = np.searchsorted(cuts, b.column(key).to_numpy().view(np.uint64), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(p), *b.columns], ["part", *b.schema.names])

    def store(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        part = t.column("part").to_numpy()
        for p in np.unique(part):
            one = t.filter(pa.array(part == p))
            k = one.column(key).to_numpy().view(np.uint64)
            order = np.argsort(k)
            save(f"{at}/{p}", {"key": k[order]} | {c: one.column(c).to_numpy()[order] for c in columns})
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32())})

    kinds = ", ".join(f"`{c}` long" for c in [key, *columns])
    rows.select(key, *columns).mapInArrow(place, f"part int, {kinds}").repartition(parts, F.col("part")).mapInArrow(store, "part int").collect()
    return at, parts
