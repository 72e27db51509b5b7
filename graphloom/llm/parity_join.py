"""Operator 6, n-gram Jaccard join by parity sketches.

A text is the set of its word n-grams (of all its words where it has fewer than n). Texts with equal
sets form one class, so copies are compared once however many there are. A class XOR-hashes its
n-grams into sketches: a bit is the parity of the n-grams that fall on it, so the Hamming distance of
two sketches is at most the symmetric difference of the sets. Jaccard similarity of at least t bounds
that difference by D = (1-t)/(1+t) (|A|+|B|).

Candidates come by the pigeonhole principle from a sketch of 2**56 bits, so wide that an odd bit is one
n-gram: of the |A| - ceil(t|A|) + 1 first odd bits of A in any order that all sets share one is odd in
each B of similarity t and at most A's size, and for the smaller set of a pair the first
|A| - ceil(2t/(1+t) |A|) + 1 will do. (Parts of several bits guarantee nothing at t = 0.5: any of D
differences breaks a part, and then parts that are empty in both sets are the only ones sure to be equal.)
The order is by the number of texts with the n-gram, rare ones first. N-grams of one text only lead
it and match nothing, so most texts have no bits left to join on; which n-grams those are says a
`Lookup` table of all others, built by one exchange of packed hash prefixes (a prefix of
log2(all n-grams) + SPARE bits, so about one n-gram of 2**SPARE is taken for a frequent one, which costs
time and loses nothing).

Sets that share such a bit are linked only where their sketches, of 4 to 8 bits an n-gram, leave the
similarity possible: else chance alone ties most of a large table into one component. The sketches lie in
files of the shared folder, which the tasks that see a bit's sets map. Two sets that other links tie
already need no link of their own, so a bit of many near copies costs about one test a set.
Connected components of the links are compared within tasks, a component of more than BLOCK n-grams or
SETS sets in blocks, each block with each. There sketches of some thousand bits rule out pairs by their
Hamming distance, and the rest is verified on the whole sets. Pairs never leave a task: it gives each
set's number of linked documents and a spanning forest of the links. No cap, no sample, no chance.

Defined results: ids may be of any type with an order. A document is an (id, set of n-grams); rows
repeated under an id count once, two texts under one id are two documents. Rows with null ids are no
documents; null, empty or wordless texts are documents without links, a class each. Ties need no
breaking, as nothing is ranked; similarity equal to t counts. Very long texts are taken whole. An empty
table gives no rows. Columns other than id and text are ignored by `join` and kept by `one_of_each`,
whatever their names.
"""

from __future__ import annotations

import shutil
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .components import components, forest
from .elias_fano import load, save
from .lookup import Lookup, bounds, folder, pack, pack_any, sorted_with_places, trim, trimmed, unpack, unpack_any, write
from .store import cut, table
from .text import Words, grams, mix, mix_int, slices

NGRAM, THRESHOLD = 3, 0.5
SPARE, BATCH, STEPS = 10, 600_000, 16  # n-grams of a batch that is looked up at once
BLOCK, SETS, TILE = 800_000, 4096, 512
SHIFTS, STRETCH, PAIRS = 32, 100_000, 1 << 20  # neighbours tested first; bits, and pairs, taken at once
_KEY = np.uint64(8)  # keys are the upper 56 bits


def text_sets(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of 52 bits, offsets): the sorted distinct n-gram hashes of each text."""
    w = Words(col)
    docs = len(w.off) - 1
    count = np.diff(w.off)
    g = (grams(w.hashes, n) if len(w.hashes) else w.hashes) >> np.uint64(12)
    doc = w.doc_of()
    place = np.arange(len(g)) - w.off[doc] if len(g) else np.zeros(0, np.int64)
    ok = place <= count[doc] - n
    few = np.flatnonzero((count > 0) & (count < n))
    own = np.array([mix_int(int(np.bitwise_xor.reduce(mix(w.hashes[w.off[i] : w.off[i + 1]] + np.arange(count[i], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))) + int(count[i])) >> 12 for i in few], np.uint64)
    g, doc = np.concatenate([g[ok], own]), np.concatenate([doc[ok], few])
    if len(few):
        order = np.argsort(doc, kind="stable")
        g, doc = g[order], doc[order]
    out, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo in range(0, docs, 4096):  # the text's number goes into the upper 12 bits
        a, b = np.searchsorted(doc, [lo, lo + 4096])
        x = ((doc[a:b] - lo).astype(np.uint64) << np.uint64(52)) | g[a:b]
        x.sort()
        x = x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x
        sizes.append(np.bincount((x >> np.uint64(52)).astype(np.int64), minlength=min(4096, docs - lo)))
        out.append(x & np.uint64((1 << 52) - 1))
    return np.concatenate(out), np.r_[0, np.cumsum(np.concatenate(sizes))]


def prints(g: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set, as a signed number."""
    acc = np.zeros(len(g) + 1, np.uint64)
    np.cumsum(mix(g + np.uint64(mix_int(0x51ED270B))), out=acc[1:])
    return mix(acc[off[1:]] - acc[off[:-1]] + np.diff(off).astype(np.uint64)).view(np.int64)


def prefixes(size: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """The odd bits that a set of each size needs as the larger and as the smaller one of a pair."""
    large = size - np.ceil(t * size - 1e-9).astype(np.int64) + 1
    small = size - np.ceil(2 * t / (1 + t) * size - 1e-9).astype(np.int64) + 1
    return large, np.minimum(small, large)


def _batches(batches, n: int, most: int = BATCH):
    """(n-grams, offsets, fingerprints) of distinct sets, in batches of about `most` n-grams."""
    held, size = [], 0

    def joined():
        g, count = np.concatenate([x for x, _ in held]), np.concatenate([np.diff(o) for _, o in held])
        off = np.r_[0, np.cumsum(count)]
        f = prints(g, off)
        _, first = np.unique(f, return_index=True)
        first = np.sort(first[count[first] > 0])
        keep = np.zeros(len(f), bool)
        keep[first] = True
        return g[np.repeat(keep, count)], np.r_[0, np.cumsum(count[first])], f[first]

    for batch in batches:
        for part in slices(batch, "text"):
            held.append(text_sets(part.column("text"), n))
            size += len(held[-1][0])
            if size >= most:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()
        held = []
    trim()


def _rows(n: int, kind: pa.DataType):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                g, off = text_sets(part.column("text"), n)
                yield pa.RecordBatch.from_arrays([part.column("id").cast(kind), part.column("h"), pa.array(np.diff(off)), pa.array(prints(g, off))], ["id", "h", "n", "f"])
        trim()

    return run


def _frequent(texts: DataFrame, n: int, total: int) -> tuple[str, int, int]:
    """(folder, parts, bits) of the table of the n-grams, by their first bits, of two or more texts; level: log2 of how many."""
    bits = min(52, max(1, total).bit_length() + SPARE)
    parts = max(texts.sparkSession.sparkContext.defaultParallelism, -(-total // 2_000_000))
    at = folder(texts.sparkSession, "frequent")
    cuts = bounds(parts, bits)

    def count(batches):
        for g, _, _ in _batches(batches, n):
            u, c = np.unique(g >> np.uint64(52 - bits), return_counts=True)
            cut_at = np.r_[0, np.searchsorted(u, cuts), len(u)]
            rows = [(p, pack(u[a:b]), pack_any(c[a:b] - 1)) for p, (a, b) in enumerate(zip(cut_at, cut_at[1:])) if a < b]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["part", "key", "count"])

    def store(batches):
        by: dict[int, list] = {}
        for b in batches:
            for p, k, c in zip(*(b.column(x).to_pylist() for x in ("part", "key", "count"))):
                by.setdefault(p, []).append((k, c))
        for p in sorted(by):
            got = [(unpack(k), (unpack_any(c) + np.uint64(1)).astype(np.uint32)) for k, c in by.pop(p)]
            low, high = (int(cuts[p - 1]) if p else 0), (int(cuts[p]) if p + 1 < parts else 1 << bits)
            keys, levels = [], []
            step = max(1, (high - low) // STEPS)
            for x in range(low, high, step):  # a stretch at a time, so that what is sorted stays small
                ends = [np.searchsorted(k, np.array([x, min(x + step, high)], np.uint64)) for k, _ in got]
                k, place = sorted_with_places(np.concatenate([k[i:j] for (k, _), (i, j) in zip(got, ends)]), bits)
                if len(k):
                    c = np.concatenate([c[i:j] for (_, c), (i, j) in zip(got, ends)])[place]
                    head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                    c = np.add.reduceat(c, head, dtype=np.int64)
                    keys.append(k[head][c > 1]), levels.append(np.log2(c[c > 1]).astype(np.uint8))
            save(f"{at}/{p}", {"key": np.concatenate([np.zeros(0, np.uint64), *keys]), "level": np.concatenate([np.zeros(0, np.uint8), *levels])})
            del got, keys, levels
            trim()
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32())})

    texts.mapInArrow(count, "part int, key binary, count binary").repartition(parts, F.col("part")).mapInArrow(store, "part int").collect()
    return at, parts, bits


def joined_bits(g: np.ndarray, off: np.ndarray, level: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, place of the n-gram, whether it serves the smaller side) of the bits to join on; level is 0 for n-grams of one text."""
    size = np.diff(off)
    large, small = prefixes(size, t)
    doc = np.repeat(np.arange(len(size)), size)
    alone = np.bincount(doc, level == 0, len(size)).astype(np.int64)
    large, small = large - alone, small - alone
    at = np.flatnonzero((level > 0) & (large[doc] > 0))
    at = at[np.lexsort((g[at], level[at], doc[at]))]
    d = doc[at]
    rank = np.arange(len(at)) - np.searchsorted(d, d)
    ok = rank < large[d]
    return d[ok], at[ok], (rank < small[d])[ok]


def bands(size: np.ndarray, t: float) -> np.ndarray:
    """The size band of each set; sizes within the factor t are in one band or the next."""
    return np.minimum(np.floor(np.log(np.maximum(size, 1)) / np.log(1 / t) + 1e-9), 255).astype(np.int64) if t < 1 else np.zeros(len(size), np.int64)


def widths(size: np.ndarray) -> np.ndarray:
    """The words of the sketch that links are tested by: a power of two, so that wide ones fold, of 4 bits an n-gram or more."""
    return np.int64(1) << np.ceil(np.log2(np.maximum(size, 16) / 16)).astype(np.int64)


def near(flat: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Whether the sketches of the sets a and b, at `start` in flat, leave a similarity of t possible; it never denies a pair that has it."""
    out, words = np.zeros(len(a), bool), widths(size)
    for code in np.unique(words[a] << 32 | words[b]):
        wide, slim = max(code >> 32, code & 0xFFFFFFFF), min(code >> 32, code & 0xFFFFFFFF)
        which = np.flatnonzero((words[a] << 32 | words[b]) == code)
        step = max(1, (PAIRS >> 1) // wide)
        for k in (which[i : i + step] for i in range(0, len(which), step)):
            x, y = (np.bitwise_xor.reduce(flat[start[s][:, None] + np.arange(words[s[0]])].reshape(len(s), -1, slim), axis=1) for s in (a[k], b[k]))
            out[k] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= (1 - t) / (1 + t) * (size[a[k]] + size[b[k]]) + 1e-9
    return out


class Ties:
    """Sets tied by links that sketches allow; test(a, b) gives for sets of one size range whether they may be similar."""

    def __init__(self, size: np.ndarray, t: float):
        self.size, self.t, self.parent = size, t, np.arange(len(size))

    def root(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while ((up := self.parent[r]) != r).any():
            r = up
        return r

    def _test(self, a: np.ndarray, b: np.ndarray, test) -> None:
        apart = self.root(a) != self.root(b)
        if apart.any():
            pairs = np.unique(np.minimum(a, b)[apart] * len(self.size) + np.maximum(a, b)[apart])
            a, b = pairs // len(self.size), pairs % len(self.size)
            ok = test(a, b)
            nodes, roots = forest(self.root(a[ok]), self.root(b[ok]))
            self.parent[nodes] = roots

    def add(self, key: np.ndarray, own: np.ndarray, smaller: np.ndarray, test) -> None:
        """Afterwards all sets of one key that may be a pair, the smaller one as such, are tied."""
        order = np.lexsort((own, self.size[own], key))
        key, own, smaller = key[order], own[order], smaller[order]
        size = self.size[own]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[head, len(key)])
        end = np.repeat(head + count, count)

        def may(i, j):  # i before j in the order of sizes
            return (size[i] >= self.t * size[j] - 1e-9) & (smaller[i] | (smaller[j] & (size[i] == size[j])))

        i = np.arange(len(key))
        for d in range(1, SHIFTS + 1):
            i = i[i + d < end[i]]
            if not len(i):
                return
            use = i[may(i, i + d)]
            self._test(own[use], own[use + d], test)
        root = self.root(own)
        many = np.flatnonzero((count > SHIFTS + 1) & (np.minimum.reduceat(root, head) != np.maximum.reduceat(root, head)))
        for lo, n in zip(head[many].tolist(), count[many].tolist()):
            # those of the largest tied group are pairs of others only
            root = self.root(own[lo : lo + n])
            r, at, c = np.unique(root, return_inverse=True, return_counts=True)
            rest = at != np.argmax(c)
            place = np.arange(n)
            step = max(1, PAIRS // n)
            for some in (x[i : i + step] for x in [np.flatnonzero(rest)] for i in range(0, len(x), step)):
                x, y = np.nonzero(~rest[None, :] | (place[None, :] > some[:, None]))
                x, y = lo + np.minimum(some[x], y), lo + np.maximum(some[x], y)
                ok = may(x, y)
                self._test(own[x[ok]], own[y[ok]], test)


def _candidates(texts: DataFrame, n: int, t: float, how: tuple[str, int, int]) -> tuple[DataFrame, str]:
    """((a, b): edges that connect all pairs of similarity t, by fingerprint; folder of sketches that computing them reads)."""
    at, table_parts, bits = how
    parts = max(texts.sparkSession.sparkContext.defaultParallelism, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = bounds(parts, 56)
    drawn = folder(texts.sparkSession, "sketches")

    def emit(batches):
        table = Lookup(at, table_parts, bits)
        name, kept, before = uuid.uuid4().hex, [], 0  # a task that is run again writes, and names, another file
        for g, off, f in _batches(batches, n):
            if not len(f):
                continue
            q, place = sorted_with_places(g >> np.uint64(52 - bits), bits)
            found, (lv,) = table.find(q, ["level"])
            level = np.zeros(len(g), np.int64)
            level[place] = np.where(found, np.maximum(lv, 1), 0)
            d, i, smaller = joined_bits(g, off, level, t)
            if not len(d):
                continue
            use, own = np.unique(d, return_inverse=True)
            size = np.diff(off)[use]
            words = widths(size)
            start = np.cumsum(words) - words
            flat = np.zeros(int(words.sum()), np.uint64)
            for w in np.unique(words):
                which = np.flatnonzero(words == w)
                step = max(1, (PAIRS >> 6) // int(w))
                for k in (which[x : x + step] for x in range(0, len(which), step)):
                    flat[start[k][:, None] + np.arange(w)] = _sketch_of(g, off, use[k], int(w))
            key, info = mix(g[i]) >> _KEY, ((before + own).astype(np.uint64) << np.uint64(1)) | smaller.astype(np.uint64)
            kept.append((f[use], size, flat))
            before += len(use)
            order = np.argsort(key, kind="stable")
            key, info = key[order], info[order]
            ends = np.r_[0, np.searchsorted(key, cuts), len(key)]
            rows = [(p, name, pack(key[x:y]), pack_any(info[x:y])) for p, (x, y) in enumerate(zip(ends, ends[1:])) if x < y]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int32(), pa.string(), pa.binary(), pa.binary()))], ["part", "file", "key", "info"])
        if kept:
            f, size, flat = (np.concatenate(x) for x in zip(*kept))
            words = widths(size)
            save(f"{drawn}/{name}", {"f": f, "size": size, "start": np.cumsum(words) - words, "sketch": flat})

    def tie(batches):
        key, info, own, names = [], [], [], {}
        for batch in batches:
            for name, k, i in zip(*(batch.column(x).to_pylist() for x in ("file", "key", "info"))):
                key.append(unpack(k)), info.append(unpack_any(i))
                own.append((names.setdefault(name, len(names)) << 40) + (info[-1] >> np.uint64(1)).astype(np.int64))
                info[-1] = (info[-1] & np.uint64(1)).astype(bool)
        if not key:
            return
        key, smaller, own = np.concatenate(key), np.concatenate(info), np.concatenate(own)
        files = [load(f"{drawn}/{name}") for name in names]

        def taken(sets, column):
            return np.concatenate([files[i][column][s] for i, s in each(sets)])

        def each(sets):  # in ascending order
            ends = np.searchsorted(sets, np.arange(len(files) + 1) << 40)
            return [(i, sets[x:y] - (i << 40)) for i, (x, y) in enumerate(zip(ends, ends[1:])) if x < y]

        sets, own = np.unique(own, return_inverse=True)
        f, first, same = np.unique(taken(sets, "f"), return_index=True, return_inverse=True)  # equal sets of several batches
        own = same[own]
        ties = Ties(taken(sets, "size")[first], t)
        order = np.lexsort((own, key))
        key, own, smaller = key[order], own[order], smaller[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])]
        key, own, smaller = key[new], own[new], smaller[new]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[head, len(key)])
        shared = np.repeat(count > 1, count)
        key, own, smaller = key[shared], own[shared], smaller[shared]
        lo = 0
        while lo < len(key):
            hi = int(np.searchsorted(key, key[min(lo + STRETCH, len(key)) - 1], "right"))
            here = np.unique(own[lo:hi])
            where = np.sort(sets[first[here]])
            pieces = []
            for i, s in each(where):
                begin, w = files[i]["start"][s], widths(files[i]["size"][s])
                pieces.append(files[i]["sketch"][np.repeat(begin - (np.cumsum(w) - w), w) + np.arange(w.sum())])
            flat, w = np.concatenate(pieces), widths(taken(where, "size"))
            begin = (np.cumsum(w) - w)[np.searchsorted(where, sets[first[here]])]
            size = ties.size[here]
            ties.add(key[lo:hi], own[lo:hi], smaller[lo:hi], lambda a, b: near(flat, begin, size, np.searchsorted(here, a), np.searchsorted(here, b), t))
            lo = hi
        root = ties.root(np.arange(len(f)))
        tied = np.flatnonzero(root != np.arange(len(f)))
        yield pa.RecordBatch.from_arrays([pa.array(f[tied]), pa.array(f[root[tied]])], ["a", "b"])

    rows = texts.mapInArrow(emit, "part int, file string, key binary, info binary").repartition(parts, F.col("part"))
    return rows.mapInArrow(trimmed(tie), "a long, b long"), drawn


def sketches(g: np.ndarray, off: np.ndarray, words: int) -> np.ndarray:
    """Parity sketches of 64 * words bits, a row for each set."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    bits = np.bincount(doc * (64 * words) + (mix(g + np.uint64(77)) % np.uint64(64 * words)).astype(np.int64), minlength=(len(off) - 1) * 64 * words) & 1
    return np.packbits(bits.astype(np.uint8).reshape(len(off) - 1, -1), axis=1).view(np.uint64)


def _within(g: np.ndarray, off: np.ndarray, x: np.ndarray, y: np.ndarray, t: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the pairs of similarity t between the sets x and the sets y (of x alone, i < j, where same)."""
    size = np.diff(off)
    words = max(1, min(128, int(4 * np.median(size)) // 64 + 1))
    pairs = []
    for xs in (x[i : i + TILE] for i in range(0, len(x), TILE)):
        sx = None
        for ys in (y[i : i + TILE] for i in range(0, len(y), TILE)):
            if same and ys[-1] < xs[0]:
                continue
            nx, ny = size[xs][:, None], size[ys][None, :]
            ok = np.minimum(nx, ny) >= t * np.maximum(nx, ny) - 1e-9
            if same:
                ok &= xs[:, None] < ys[None, :]
            if not ok.any():
                continue
            if len(xs) > 4:
                sx = _sketch_of(g, off, xs, words) if sx is None else sx
                sy = _sketch_of(g, off, ys, words)
                far = np.zeros(ok.shape, np.int64)
                for k in range(words):
                    far += np.bitwise_count(sx[:, k][:, None] ^ sy[:, k][None, :])
                ok &= far <= (1 - t) / (1 + t) * (nx + ny) + 1e-9
            i, j = np.nonzero(ok)
            if not len(i):
                continue
            both = _shared(g, off, xs, ys, i, j)
            good = both / (size[xs[i]] + size[ys[j]] - both) >= t
            pairs.append((xs[i[good]], ys[j[good]]))
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*pairs))


def _of(g: np.ndarray, off: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, offsets) of some of the sets."""
    size = np.diff(off)[which]
    own = np.r_[0, np.cumsum(size)]
    return g[np.repeat(off[which] - own[:-1], size) + np.arange(own[-1])], own


def _sketch_of(g, off, which, words):
    return sketches(*_of(g, off, which), words)


def _shared(g, off, xs, ys, i, j) -> np.ndarray:
    """How many n-grams each pair (xs[i], ys[j]) has in common: set by set for few pairs, else by products of indicator matrices."""
    if len(i) <= 4 * (len(xs) + len(ys)):
        out = np.empty(len(i), np.int64)
        for k, (a, b) in enumerate(zip(xs[i].tolist(), ys[j].tolist())):
            both = np.concatenate([g[off[a] : off[a + 1]], g[off[b] : off[b + 1]]])
            both.sort()
            out[k] = (both[1:] == both[:-1]).sum()
        return out
    gx, ox = _of(g, off, xs)
    gy, oy = _of(g, off, ys)
    u = np.intersect1d(gx, gy)
    at = []
    for gg, oo in ((gx, ox), (gy, oy)):
        p = np.minimum(np.searchsorted(u, gg), max(len(u) - 1, 0))
        ok = u[p] == gg if len(u) else np.zeros(len(gg), bool)
        doc = np.repeat(np.arange(len(oo) - 1), np.diff(oo))
        order = np.argsort(p[ok], kind="stable")
        at.append((p[ok][order], doc[ok][order]))
    total = np.zeros((len(xs), len(ys)), np.float32)
    for lo in range(0, len(u), 2048):
        m = []
        for (p, doc), rows in zip(at, (len(xs), len(ys))):
            a, b = np.searchsorted(p, [lo, lo + 2048])
            one = np.zeros((rows, min(2048, len(u) - lo)), np.float32)
            one[doc[a:b], p[a:b] - lo] = 1
            m.append(one)
        total += m[0] @ m[1].T
    return np.rint(total[i, j]).astype(np.int64)


def _compare(t: float):
    def run(batches):
        def cell(rows):
            side = np.array([r[1] for r in rows])
            f, docs = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
            order = np.lexsort((f, side))
            order = order[np.r_[True, (f[order][1:] != f[order][:-1]) | (side[order][1:] != side[order][:-1])]]
            f, docs, side = f[order], docs[order], side[order]
            sets = [np.frombuffer(rows[k][4], np.uint64) for k in order]
            g, off = np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])]
            every = np.arange(len(f))
            same = side[0] == 2  # a block with itself
            i, j = _within(g, off, every if same else every[side == 0], every if same else every[side == 1], t, same)
            if len(i):
                found = np.bincount(i, docs[j], len(f)) + np.bincount(j, docs[i], len(f))
                nodes, roots = forest(i, j)
                yield pa.RecordBatch.from_arrays([pa.array(f[nodes]), pa.array(f[roots]), pa.array(found[nodes].astype(np.int64))], ["f", "root", "links"])

        held, now = [], None
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("cell", "side", "f", "docs", "grams"))):
                if r[0] != now and held:
                    yield from cell(held)
                    held = []
                now = r[0]
                held.append(r)
        if held:
            yield from cell(held)

    return run


def linked(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = NGRAM, t: float = THRESHOLD, block: int = BLOCK, sets: int = SETS) -> tuple[DataFrame, DataFrame]:
    """(rows: id, h (of id and text), n, f; classes: f, docs, id (the least), links, root), f being the fingerprint of a set of n-grams.

    links counts the documents of other sets that are similar; root is the least f of those that links connect.
    """
    kind = docs.schema[id_col].dataType
    src = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL")
    src = src.withColumn("h", F.xxhash64("id", "text"))
    out = T.StructType([T.StructField("id", kind), T.StructField("h", T.LongType()), T.StructField("n", T.LongType()), T.StructField("f", T.LongType())])
    rows = cut(src.mapInArrow(_rows(n, to_arrow_type(kind)), out))
    classes = cut(rows.filter("n > 0").select("id", "f", "n").distinct().groupBy("f").agg(F.count("*").alias("docs"), F.min("id").alias("id"), F.first("n").alias("n")))
    total = classes.agg(F.sum("n")).first()[0] or 0
    texts = src.filter("text IS NOT NULL").select("text")
    how = _frequent(texts, n, total)
    edges, drawn = _candidates(texts, n, t, how)
    group = cut(components(edges))
    for used in (how[0], drawn):
        shutil.rmtree(used, ignore_errors=True)
    member = classes.select("f", "docs", "n").join(group.select(F.col("node").alias("f"), "root"), "f")
    size = member.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / F.lit(block)), F.ceil(F.count("*") / F.lit(sets))).alias("blocks"))
    member = member.join(size, "root").select("f", "docs", "root", F.col("blocks").cast("bigint").alias("blocks"))
    at, parts = write(member, "f", ["docs", "root", "blocks"])

    def members(batches):
        known = Lookup(at, parts)
        for g, off, f in _batches(batches, n):
            order = np.argsort(f.view(np.uint64))
            found, (count, root, blocks) = known.find(f.view(np.uint64)[order], ["docs", "root", "blocks"])
            for k in np.flatnonzero(found):
                i, q = order[k], int(blocks[k])
                own = int(mix(f[i : i + 1].view(np.uint64))[0] % np.uint64(q))
                data = g[off[i] : off[i + 1]].tobytes()
                other = np.arange(q)
                cells = mix(mix(np.full(q, root[k]).view(np.uint64)) + (np.minimum(other, own) * q + np.maximum(other, own)).astype(np.uint64)).view(np.int64)
                side = np.where(other == own, 2, other < own).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(side), pa.array(np.full(q, f[i])), pa.array(np.full(q, count[k])), pa.array([data] * q, pa.binary())], ["cell", "side", "f", "docs", "grams"])

    cells = texts.mapInArrow(_few_batches(members), "cell long, side int, f long, docs long, grams binary").repartition("cell").sortWithinPartitions("cell")
    found = cut(cells.mapInArrow(trimmed(_compare(t)), "f long, root long, links long"))
    shutil.rmtree(at, ignore_errors=True)
    tied = components(found.select(F.col("f").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("f"), "root")
    count = found.groupBy("f").agg(F.sum("links").alias("links"))
    return rows, classes.select("f", "docs", "id").join(count.join(tied, "f"), "f", "left").select("f", "docs", "id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "f").alias("root"))


def _few_batches(make):
    """The record batches of `make` in larger ones."""

    def run(batches):
        held, size = [], 0
        for b in make(batches):
            held.append(b)
            size += b.nbytes
            if size > 4 << 20:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = NGRAM, t: float = THRESHOLD, **how) -> DataFrame:
    """(doc_id, class_id, links), a row for each document.

    links is the number of other documents whose similarity is t or more; class_id is the least id of
    those that links connect with the document, its own where there are none.
    """
    rows, classes = linked(docs, id_col, text, n, t, **how)
    least = classes.groupBy("root").agg(F.min("id").alias("class_id"))
    info = classes.join(least, "root").select("f", "class_id", (F.col("links") + F.col("docs") - 1).alias("links"))
    got = rows.select("id", "n", "f").distinct().join(info, "f", "left").select(F.col("id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return got.withColumnRenamed("id", "doc_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = NGRAM, t: float = THRESHOLD, **how) -> DataFrame:
    """docs, but of the documents that links connect only the one of the least id.

    Where that id has several sets of the group, all of its rows in it stay; rows repeated under one id
    stay as they are, and so do rows with null ids.
    """
    rows, classes = linked(docs, id_col, text, n, t, **how)
    least = classes.groupBy("root").agg(F.min("id").alias("least"), F.sum("docs").alias("size")).filter("size > 1")
    keep = classes.join(least, "root").select("f", "least")
    gone = rows.filter("n > 0").join(keep, "f").filter("id <> least").select("h").distinct()
    at, parts = write(gone, "h", [])
    tag = "h"
    while tag in docs.columns:
        tag += "_"
    schema = docs.schema

    def run(batches):
        known = Lookup(at, parts)
        for b in batches:
            h = b.column(tag).to_numpy().view(np.uint64)
            order = np.argsort(h)
            drop = np.zeros(len(h), bool)
            drop[order], _ = known.find(h[order], [])
            yield b.drop_columns([tag]).filter(pa.array(~drop))

    # a null id never hashes to what was dropped: it is left out by the flag below
    hashed = docs.withColumn(tag, F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col), F.col(text))).otherwise(F.lit(0)))
    return hashed.mapInArrow(trimmed(run), schema)


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '[a-z0-9_\x{{80}}-\x{{10FFFF}}]+'), []) AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(ws) >= {NGRAM} THEN list_transform(range(1, len(ws) - {NGRAM} + 2), lambda i: array_to_string(ws[i:i + {NGRAM - 1}], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS gs FROM w),
d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, gs FROM s),
u AS (SELECT k, len(gs) AS n, unnest(gs) AS g FROM d),
p AS MATERIALIZED (SELECT a.k AS x, b.k AS y FROM u a JOIN u b ON a.g = b.g AND a.k <> b.k GROUP BY a.k, b.k HAVING count(*) >= {THRESHOLD} * (any_value(a.n) + any_value(b.n) - count(*))),
r(k, doc_id) AS (SELECT k, doc_id FROM d UNION SELECT p.y, r.doc_id FROM r JOIN p ON p.x = r.k)
SELECT d.doc_id, (SELECT min(r.doc_id) FROM r WHERE r.k = d.k) AS class_id, (SELECT count(*) FROM p WHERE p.x = d.k) AS links FROM d
"""
