"""Operator 4, language-model scoring with an Elias-Fano n-gram trie.

A trigram model with interpolated absolute discounting is counted over the whole corpus and every
document is scored with it. The trie is cut by the hash of the first word into parts, one file
each in the shared folder, which executors map into memory. A part holds, in Elias-Fano form,
its word hashes (a word's number is its place), the pointers from words to their successors and
the successors themselves, made monotone by adding up ranges, and the same for trigrams, whose
last word is stored as its place among the successors of the middle word (context-relative).
Lookups are successor searches within the range that the pointers give. Probabilities and
back-off weights are quantised to 256 levels a part, exactly where there are no more values.

Each pass over the corpus gathers sorted counts as packed blocks (differences, compressed), one a batch
and part, by one exchange: words, then pairs, then trigrams. Parts follow the bytes of text, so a part
holds about PART_WORDS words of it. Lookups are of the distinct pairs and trigrams of a batch, in order. The query keeps all of them, those that occur once too.
With `least` above 1 (MIN, where a caller of `build` says nothing) those that occur less often are
left out of the trie; their mass goes to the lower order, and left-out words share the mass of
unknown ones. With c the counts, D the discount and T all words:
p(w) = c(w)/T, p(w|v) = max(c(vw)-D,0)/c(v) + b(v) p(w), p(w|uv) = max(c(uvw)-D,0)/c(uv) + b(uv)
p(w|v), with b the mass that is left; a pair or trigram that is not in the trie has b times the
lower order alone.

Defined results: null, empty and wordless texts have 0 words, a log probability of 0 and a null
perplexity; null ids pass through; repeated rows count and are scored each; texts are counted
and scored whole; an empty table gives no rows; columns other than id and text are ignored.

The trie's folder must be one that every machine mounts; another scheme than file: is refused. It is
deleted when the driver ends, since the scores are computed when their DataFrame is.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .elias_fano import EliasFano, load, save
from .lookup import bounds, folder, pack, pack_any, sorted_with_places, unpack, unpack_any
from .store import table
from .text import Words, slices

MIN, DISCOUNT = 2, 0.75
BATCH_WORDS, PART_WORDS = 1_500_000, 3_000_000
_FINE = 4000.0  # steps of log10 in which the lower-order probability travels with a trigram, to 1e-16


def _codes(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Quantised values: 256 levels, the means of equal shares of the distinct values."""
    values = values.astype(np.float64)
    levels = np.unique(values)
    if len(levels) > 256:
        edge = levels[np.arange(257) * (len(levels) - 1) // 256]
        at = np.clip(np.searchsorted(edge, values, "right") - 1, 0, 255)
        size = np.bincount(at, minlength=256)
        levels = np.where(size > 0, np.bincount(at, values, 256) / np.maximum(size, 1), edge[:256])
    else:
        at = np.searchsorted(levels, values)
    return {name: at.astype(np.uint8), f"{name}.levels": levels}


class Part:
    """One part of the trie, mapped."""

    def __init__(self, at: str, part: int, parts: int):
        a = load(f"{at}/words-{part}")
        self.hash, self.count = EliasFano(a, "hash"), a["count"]
        self.base = int(bounds(parts)[part - 1]) if part else 0
        self.pairs = self.triples = None
        if os.path.exists(path := f"{at}/pairs-{part}"):
            self.pairs = load(path)
            self.next, self.bound, self.ptr = (EliasFano(self.pairs, x) for x in ("next", "bound", "ptr"))
        if os.path.exists(path := f"{at}/triples-{part}"):
            self.triples = load(path)
            self.next3, self.bound3 = (EliasFano(self.triples, x) for x in ("next", "bound"))

    def word(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash in this part, -1 where it isn't."""
        i, ok = self.hash.locate(((h - np.uint64(self.base)) >> np.uint64(8)).astype(np.int64))
        return np.where(ok, i, -1)


def _successor(nxt: EliasFano, bound: EliasFano, ctx: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Place of each value in the range of its context, -1 where it isn't; contexts ascend."""
    new = np.r_[True, ctx[1:] != ctx[:-1]] if len(ctx) else np.zeros(0, bool)
    low, high = bound.get_two(ctx[new])
    back = np.cumsum(new) - 1
    at = low[back] + value
    i, ok = nxt.locate(at)
    return np.where(ok & (at < high[back]), i, -1)


def _ranges(ctx: np.ndarray, value: np.ndarray, contexts: int):
    """Trie arrays for sorted (ctx, value): pointers, and values raised by what the ranges before reach."""
    ptr = np.searchsorted(ctx, np.arange(contexts + 1))
    size = np.zeros(contexts, np.int64)
    some = ptr[1:] > ptr[:-1]
    size[some] = value[ptr[1:][some] - 1] + 1
    bound = np.r_[0, np.cumsum(size)]
    return EliasFano.parts(ptr, "ptr") | EliasFano.parts(value + bound[ctx], "next") | EliasFano.parts(bound, "bound")


class Trie:
    """All parts, opened when first used."""

    def __init__(self, at: str, offsets: np.ndarray, total: int, unknown: int):
        self.at, self.offsets, self.total, self.unknown, self.open = at, offsets, total, unknown, {}
        self.parts = len(offsets) - 1
        self.cuts = bounds(self.parts)

    def part(self, p: int) -> Part:
        if p not in self.open:
            self.open[p] = Part(self.at, p, self.parts)
        return self.open[p]

    def words(self, u: np.ndarray) -> np.ndarray:
        """Number of each word hash, in ascending order; -1 for unknown ones."""
        out = np.empty(len(u), np.int64)
        ends = np.searchsorted(u, self.cuts)
        for p, (a, b) in enumerate(zip(np.r_[0, ends], np.r_[ends, len(u)])):
            if a < b:
                i = self.part(p).word(u[a:b])
                out[a:b] = np.where(i >= 0, i + self.offsets[p], -1)
        return out

    def by_part(self, word: np.ndarray):
        """(part, from, to) of sorted word numbers."""
        cuts = np.searchsorted(word, self.offsets)
        for p in range(self.parts):
            if cuts[p] < cuts[p + 1]:
                yield p, cuts[p], cuts[p + 1]

    def counts(self, word: np.ndarray) -> np.ndarray:
        """How often each word occurs, by number, in ascending order."""
        out = np.zeros(len(word), np.int64)
        for p, a, b in self.by_part(word):
            out[a:b] = self.part(p).count[word[a:b] - self.offsets[p]]
        return out


def _coded(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes in order, place of each among them)."""
    d = pa.array(h).dictionary_encode()
    u = d.dictionary.to_numpy()
    order = np.argsort(u)
    rank = np.empty(len(u), np.int64)
    rank[order] = np.arange(len(u))
    return u[order], rank[d.indices.to_numpy()]


def _grouped(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, which of them each is, how often each occurs); keys are under 2**bits."""
    q, place = sorted_with_places(key.astype(np.uint64), bits)
    new = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    back = np.empty(len(q), np.int64)
    back[place] = np.cumsum(new) - 1
    return q[head].astype(np.int64), back, np.diff(np.r_[head, len(q)])


class Batch:
    """The n-grams of a batch of texts: its words are numbered by place among the batch's distinct ones."""

    def __init__(self, trie: Trie, h: np.ndarray, size: np.ndarray):
        self.trie = trie
        u, self.code = _coded(h)
        self.number = trie.words(u)  # ascends, but for the -1 of unknown words
        self.doc = np.repeat(np.arange(len(size)), size)
        known = self.number[self.code] >= 0 if len(u) else np.zeros(0, bool)
        self.known = known
        self.here = np.flatnonzero(known[:-1] & known[1:] & (self.doc[:-1] == self.doc[1:])) if len(h) else np.zeros(0, np.int64)
        self.bits = max(1, len(u).bit_length())
        pair, self.pair, self.pair_count = _grouped((self.code[self.here] << self.bits) | self.code[self.here + 1], 2 * self.bits)
        self.first, self.second = pair >> self.bits, pair & ((1 << self.bits) - 1)

    def find_pairs(self) -> None:
        """place (-1 for none), rel (place among the first word's successors), part, prob and back2 of the distinct pairs."""
        n = len(self.first)
        w, nxt = self.number[self.first], self.number[self.second]
        self.place, self.rel, self.part = np.full(n, -1), np.full(n, -1), np.zeros(n, np.int64)
        self.prob, self.back2 = np.ones(n), np.ones(n)
        for p, a, b in self.trie.by_part(w):
            x = self.trie.part(p)
            ctx = w[a:b] - self.trie.offsets[p]
            i = _successor(x.next, x.bound, ctx, nxt[a:b])
            hit = i >= 0
            new = np.r_[True, ctx[1:] != ctx[:-1]]
            start = x.ptr.get(ctx[new])[np.cumsum(new) - 1]
            self.place[a:b], self.rel[a:b], self.part[a:b] = i, np.where(hit, i - start, -1), p
            self.prob[a:b][hit] = x.pairs["prob.levels"][x.pairs["prob"][i[hit]]]
            if x.triples is not None:
                self.back2[a:b][hit] = x.triples["back2.levels"][x.triples["back2"][i[hit]]]

    def triples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the trigrams of two pairs of the trie: (distinct ones' first pair, second pair, count; place of the first word in here of each, which it is)."""
        ok = self.place[self.pair] >= 0
        t = np.flatnonzero(ok[:-1] & ok[1:] & (np.diff(self.here) == 1)) if len(self.here) else np.zeros(0, np.int64)
        bits = max(1, len(self.first).bit_length())
        key, which, count = _grouped((self.pair[t] << bits) | self.pair[t + 1], 2 * bits)
        return key >> bits, key & ((1 << bits) - 1), count, t, which

    def score(self) -> np.ndarray:
        """log10 probability of each word, given those before it in its text."""
        trie, n = self.trie, len(self.number)
        p_u, b_u = np.full(n, max(trie.unknown, 1) / (trie.total + 1)), np.ones(n)
        known = np.flatnonzero(self.number >= 0)
        for p, a, b in trie.by_part(self.number[known]):
            x, k = trie.part(p), known[a:b]
            i = self.number[k] - trie.offsets[p]
            p_u[k] = x.count[i] / trie.total
            b_u[k] = x.pairs["back.levels"][x.pairs["back"][i]]
        out = p_u[self.code]
        if not len(self.here):
            return np.log10(out)
        self.find_pairs()
        p2 = np.where(self.place >= 0, self.prob, b_u[self.first] * p_u[self.second])
        here, seen = self.here, self.place[self.pair] >= 0
        out[here + 1] = p2[self.pair]
        # a word after a pair of the trie has the pair's back-off weight times what it has after the second word alone
        next_ = np.flatnonzero(seen[:-1] & (np.diff(here) == 1))
        out[here[next_] + 2] *= self.back2[self.pair[next_]]
        first, second, _, t, which = self.triples()
        if len(first):
            found = np.full(len(first), np.nan)
            part, cut = np.unique(self.part[first], return_index=True)  # parts ascend with the pairs
            for p, a, b in zip(part, cut, np.r_[cut[1:], len(first)]):
                x = trie.part(int(p))
                if x.triples is not None:
                    i = _successor(x.next3, x.bound3, self.place[first[a:b]], self.rel[second[a:b]])
                    hit = i >= 0
                    found[a:b][hit] = x.triples["prob.levels"][x.triples["prob"][i[hit]]]
            p3 = found[which]
            at = here[t] + 2
            out[at] = np.where(np.isnan(p3), out[at], p3)
        return np.log10(out)


def _batches(batches, most: int):
    """(rows, words of the rows) in batches of about `most` words."""
    held, words, size = [], [], 0
    for batch in batches:
        for part in slices(batch, "text"):
            w = Words(part.column("text"))
            held.append(part), words.append((w.hashes, np.diff(w.off)))
            size += len(w.hashes)
            if size >= most:
                yield held, np.concatenate([x for x, _ in words]), np.concatenate([x for _, x in words])
                held, words, size = [], [], 0
    if held:
        yield held, np.concatenate([x for x, _ in words]), np.concatenate([x for _, x in words])


def _blocks(part: np.ndarray, columns: list, make: list):
    """A batch of one row for each part of sorted rows; make: how each column's values become bytes."""
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    ends = np.r_[cut[1:], len(part)] if len(part) else cut
    data = [pa.array([f(c[a:b]) for a, b in zip(cut, ends)], pa.binary()) for c, f in zip(columns, make)]
    return pa.RecordBatch.from_arrays([pa.array(part[cut], pa.int32()), *data], ["part", "key", "count", "low"][: len(data) + 1])


def _gathered(batches, extra: bool = False):
    """(part, keys, counts, with extra also the low of each) of the parts that a task was given, counts of equal keys added up."""
    by: dict[int, list] = {}
    for b in batches:
        for p, *x in zip(*(b.column(n).to_pylist() for n in b.schema.names)):
            by.setdefault(p, []).append(x)
    for p in sorted(by):
        got = by.pop(p)
        k = np.concatenate([unpack(x[0]) for x in got])
        c = np.concatenate([unpack_any(x[1]) for x in got]).astype(np.int64) + 1
        low = np.concatenate([np.frombuffer(x[2], np.uint16) for x in got]) if extra else None
        got.clear()
        order = np.argsort(k, kind="stable")
        k = k[order]
        head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        c = np.add.reduceat(c[order], head)
        yield (p, k[head], c, low[order[head]]) if extra else (p, k[head], c)


def build(docs: DataFrame, text: str = "text", parts: int | None = None, least: int = MIN, discount: float = DISCOUNT) -> tuple:
    """The arguments of a Trie over the texts; its files are in a new folder of the shared one."""
    spark = docs.sparkSession
    src = docs.select(F.col(text).alias("text")).filter("text IS NOT NULL")
    if parts is None:
        parts = max(spark.sparkContext.defaultParallelism, -(-(src.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (6 * PART_WORDS)))
    at = folder(spark, "ngrams")
    cuts = bounds(parts)
    row = "part int, key binary, count binary"

    def count_words(batches):
        for _, h, _ in _batches(batches, 2 * BATCH_WORDS):
            u, code = _coded(h)
            yield _blocks(np.searchsorted(cuts, u, "right"), [u, np.bincount(code, minlength=len(u)) - 1], [pack, pack_any])

    def build_words(batches):
        for p, k, c in _gathered(batches):
            keep = c >= least
            v = ((k[keep] - np.uint64(int(cuts[p - 1]) if p else 0)) >> np.uint64(8)).astype(np.int64)
            one = np.r_[True, v[1:] != v[:-1]] if len(v) else np.zeros(0, bool)
            save(f"{at}/words-{p}", EliasFano.parts(v[one], "hash") | {"count": c[keep][one].astype(np.int64)})
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "n": pa.array([int(one.sum())]), "total": pa.array([int(c.sum())]), "unknown": pa.array([int(c.sum() - c[keep][one].sum())])})

    def gather(counted, kind, built, out):
        return src.mapInArrow(counted, kind).repartition(parts, F.col("part")).mapInArrow(built, out).collect()

    sizes = gather(count_words, row, build_words, "part int, n long, total long, unknown long")
    n = np.zeros(parts, np.int64)
    for r in sizes:
        n[r.part] = r.n
    for p in set(range(parts)) - {r.part for r in sizes}:
        save(f"{at}/words-{p}", EliasFano.parts(np.zeros(0, np.int64), "hash") | {"count": np.zeros(0, np.int64)})
    offsets, total, unknown = np.r_[0, np.cumsum(n)], sum(r.total for r in sizes), sum(r.unknown for r in sizes)
    if offsets[-1] >= 1 << 32:
        raise ValueError("more than 2**32 words")
    how = (at, offsets, total, unknown)

    def count_pairs(batches):
        trie = Trie(*how)
        for _, h, size in _batches(batches, BATCH_WORDS):
            b = Batch(trie, h, size)
            w = b.number[b.first]
            yield _blocks(np.searchsorted(offsets, w, "right") - 1, [(w.astype(np.uint64) << np.uint64(32)) | b.number[b.second].astype(np.uint64), b.pair_count - 1], [pack, pack_any])

    def build_pairs(batches):
        trie = Trie(*how)
        for p, k, c in _gathered(batches):
            keep = c >= least
            k, c = k[keep], c[keep]
            ctx, nxt = (k >> np.uint64(32)).astype(np.int64) - offsets[p], (k & np.uint64(0xFFFFFFFF)).astype(np.int64)
            own = trie.part(p).count
            back = 1 - np.bincount(ctx, c - discount, len(own)) / own
            u, code = _coded(nxt)
            prob = (c - discount) / own[ctx] + back[ctx] * trie.counts(u)[code] / total
            save(f"{at}/pairs-{p}", _ranges(ctx, nxt, len(own)) | _codes(prob, "prob") | _codes(back, "back"))
            save(f"{at}/count-{p}", {"count": c.astype(np.uint32 if len(c) and c.max() < 1 << 32 else np.int64)})
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32())})

    done = gather(count_pairs, row, build_pairs, "part int")
    for p in set(range(parts)) - {r.part for r in done}:
        none = np.zeros(0, np.int64)
        save(f"{at}/pairs-{p}", _ranges(none, none, int(n[p])) | _codes(none, "prob") | _codes(np.ones(int(n[p])), "back"))

    def count_triples(batches):
        trie = Trie(*how)
        for _, h, size in _batches(batches, BATCH_WORDS):
            b = Batch(trie, h, size)
            b.find_pairs()
            first, second, c, _, _ = b.triples()
            key = (b.place[first].astype(np.uint64) << np.uint64(32)) | b.rel[second].astype(np.uint64)
            low = np.clip(np.rint(-np.log10(b.prob[second]) * _FINE), 0, 65535)
            yield _blocks(b.part[first], [key, c - 1, low.astype(np.uint16)], [pack, pack_any, lambda x: x.tobytes()])

    def build_triples(batches):
        for p, k, c, low in _gathered(batches, True):
            keep = c >= least
            k, c, low = k[keep], c[keep], 10.0 ** (low[keep] / -_FINE)
            ctx, rel = (k >> np.uint64(32)).astype(np.int64), (k & np.uint64(0xFFFFFFFF)).astype(np.int64)
            own = load(f"{at}/count-{p}")["count"].astype(np.int64)
            back = 1 - np.bincount(ctx, c - discount, len(own)) / own
            prob = (c - discount) / own[ctx] + back[ctx] * low
            arrays = _ranges(ctx, rel, len(own))
            save(f"{at}/triples-{p}", {x: v for x, v in arrays.items() if not x.startswith("ptr.")} | _codes(prob, "prob") | _codes(back, "back2"))
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32())})

    gather(count_triples, f"{row}, low binary", build_triples, "part int")
    for p in range(parts):
        if os.path.exists(path := f"{at}/count-{p}"):
            os.remove(path)
    return how


def score(docs: DataFrame, how: tuple, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, unknown, log10_prob, perplexity) for each row."""

    def run(batches):
        trie = Trie(*how)
        for held, h, size in _batches(batches, BATCH_WORDS):
            b = Batch(trie, h, size)
            total, out = np.bincount(b.doc, b.score(), len(size)), np.bincount(b.doc, ~b.known, len(size)).astype(np.int64)
            ids = pa.chunked_array([x.column("id") for x in held]).combine_chunks()
            none = size == 0
            perplexity = 10 ** (-total / np.maximum(size, 1))
            yield pa.RecordBatch.from_arrays([ids, pa.array(size.astype(np.int64)), pa.array(out), pa.array(np.round(total, 6)), pa.array(np.round(perplexity, 4), mask=none)], ["id", "n_words", "unknown", "log10_prob", "perplexity"])

    kind = dict(docs.select(id_col).dtypes)[id_col]
    src = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return src.mapInArrow(run, f"id {kind}, n_words long, unknown long, log10_prob double, perplexity double").withColumnRenamed("id", id_col)


def op4_ngram_lm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, build(docs, least=1))
