"""Operator 9, suffix-array dedup of repeated passages.

A window is `length` successive words of a text. Its first occurrence, by (document id, place),
stays; every later one is a repeat, within a document or across documents. A word is removed
when a repeated window covers it.

Only texts that can hold a repeat reach the suffix arrays: each window is represented by its
least word 25-gram (a minimizer), which equal windows share, and the minimizers that occur twice
in the corpus are found by one exchange of (hash, text, place). The texts that hold such
minimizers are dealt into shards by their least repeated minimizer, so that copies meet in a
shard. Each shard sorts the suffixes of its candidate stretches by Larsson-Sadakane refinement
(only groups still tied are sorted again, the depth doubles), takes common prefixes by Kasai's
method in its permuted form, and so gets classes of equal windows. Of each class the first
occurrence goes on, as a sorted run of 64-bit fingerprints, split at fixed fingerprint
boundaries; the runs of all shards in one range are merged by binary search.

Defined results: rows with a null id or null text, and texts of fewer words than a window, are
never a repeat; repeated equal rows under one id count as one; different texts under one id are
different documents, ordered by a hash of the text; a text may be removed wholly; an empty table
gives no rows; extra columns are kept by `remove_repeats`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import trimmed
from .store import table
from .text import Words, mix, mix_int, slices

LENGTH, GRAM = 50, 25
SHARD_WORDS = 500_000
_M = mix_int(77) | 1
_MI = pow(_M, -1, 1 << 64)
_pow: dict = {}


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of h[i:i+n] for each i up to len(h)-n; independent of i."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    if len(_pow.get("p", ())) < len(h):
        for key, base in (("p", _M), ("i", _MI)):
            a = np.full(len(h) + (1 << 18), base, np.uint64)
            a[0] = 1
            _pow[key] = np.multiply.accumulate(a)
    acc = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _pow["p"][: len(h)], out=acc[1:])
    return mix((acc[n:] - acc[:-n]) * _pow["i"][: len(h) - n + 1])


def minimizers(g: np.ndarray, w: int) -> np.ndarray:
    """Place of the least of each w successive hashes, the first of equal ones."""
    if len(g) < w:
        return np.zeros(0, np.int64)
    at = np.arange(len(g), dtype=np.uint64)
    x = (g & ~np.uint64(0xFFFFFF)) | (at & np.uint64(0xFFFFFF))
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    if span < w:
        x = np.minimum(x[: len(g) - w + 1], x[w - span :])
    first = np.arange(len(x), dtype=np.int64)
    return first + ((x.astype(np.int64) - first) & 0xFFFFFF)


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane refinement of the suffixes of integers; a suffix that ends is less."""
    n = len(seq)
    if n == 0:
        return np.zeros(0, np.int64)
    ids = np.unique(seq, return_inverse=True)[1].astype(np.int64) + 1
    wide = np.r_[ids, 0, 0]
    if ids.max() < 1 << 21:
        key, h = (wide[:n] << 42) | (wide[1 : n + 1] << 21) | wide[2:], 3
    else:
        key, h = wide[:n], 1
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = start
    place = np.flatnonzero(~(new & np.r_[new[1:], True]))
    while len(place):
        sub = order[place]
        group = rank[sub]
        key = group * (n + 1) + rank[np.minimum(sub + h, n)] + 1
        by = np.argsort(key, kind="stable")
        sub, key = sub[by], key[by]
        order[place] = sub
        new = np.r_[True, key[1:] != key[:-1]]
        rank[sub] = np.maximum.accumulate(np.where(new, place, 0))
        place = place[~(new & np.r_[new[1:], True])]
        h *= 2
    return order


def common_prefixes(seq: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in order.

    Kasai's bound, that it falls by at most one from a place to the next, is exact but where the
    elements before the two suffixes differ; only there are elements compared.
    """
    n = len(seq)
    if n == 0:
        return np.zeros(0, np.int64)
    phi = np.full(n, -1, np.int64)
    phi[order[1:]] = order[:-1]
    i = np.arange(n)
    before = np.r_[-1, seq[:-1].astype(np.int64)]
    free = (phi < 0) | (i == 0) | (phi == 0) | (before != before[phi])
    at = np.flatnonzero(free & (phi >= 0))
    length = np.zeros(n, np.int64)
    step = np.arange(16)
    live = at
    while len(live):
        x, y = live[:, None] + length[live][:, None] + step, phi[live][:, None] + length[live][:, None] + step
        same = (x < n) & (y < n)
        same &= seq[np.minimum(x, n - 1)] == seq[np.minimum(y, n - 1)]
        run = np.where(same.all(1), 16, np.argmin(same, 1))
        length[live] += run
        live = live[run == 16]
    plcp = np.maximum.accumulate(np.where(free, length + i, -1)) - i
    return plcp[order]


def _text_minimizers(w: Words, length: int, gram: int):
    """For each text of a slice that has a window: (text, minimizer place of each window, gram hashes)."""
    for d in range(len(w.off) - 1):
        h = w.hashes[w.off[d] : w.off[d + 1]]
        if len(h) >= length:
            g = window_hashes(h, gram)
            yield d, minimizers(g, length - gram + 1), g, h


def _anchors(length: int, gram: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                keys = part.column("k").to_numpy()
                fp, k, pos = [], [], []
                for d, at, g, _ in _text_minimizers(Words(part.column("text")), length, gram):
                    at = np.unique(at)
                    fp.append(g[at]), k.append(np.full(len(at), keys[d])), pos.append(at.astype(np.int32))
                if fp:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(fp).view(np.int64)), pa.array(np.concatenate(k)), pa.array(np.concatenate(pos))], ["fp", "k", "pos"])

    return run


def _repeated(batches):
    got = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
    if not got:
        return
    fp, k, pos = (np.concatenate(x) for x in zip(*got))
    got.clear()
    order = np.argsort(fp)
    f = fp[order]
    same = f[1:] == f[:-1]
    order = order[np.r_[False, same] | np.r_[same, False]]
    for i in range(0, len(order), 100_000):
        x = order[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(k[x]), pa.array(pos[x]), pa.array(fp[x])], ["k", "pos", "fp"])


def _islands(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals; touching ones join."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > end[:-1]]
    head = np.flatnonzero(new)
    return start[head], end[np.r_[head[1:], len(start)] - 1]


_WIN = pa.schema([("bucket", pa.int32()), ("fp", pa.binary()), ("idx", pa.binary()), ("pos", pa.binary()), ("cnt", pa.binary()), ("k", pa.list_(pa.int64())), ("doc", pa.list_(pa.int64())), ("runs", pa.binary())])


def _shard(docs: list[tuple[int, int, np.ndarray, np.ndarray]], length: int, buckets: int):
    """Rows of one shard. docs: (k, id, word hashes, places where candidate windows start)."""
    pieces, doc, base = [], [], []
    for d, (_, _, h, start) in enumerate(docs):
        if len(start):
            for a, b in zip(*_islands(start, start + length)):
                pieces.append(h[a:b]), doc.append(d), base.append(a)
    if not pieces:
        return
    size = np.array([len(p) + 1 for p in pieces])
    off = np.r_[0, np.cumsum(size)]
    h = np.zeros(off[-1], np.uint64)
    for p, o in zip(pieces, off):
        h[o : o + len(p)] = p
    seq = np.unique(h, return_inverse=True)[1].astype(np.int64)
    seq[off[1:] - 1] = seq.max() + 1 + np.arange(len(pieces))  # ends of stretches are all different
    piece = np.repeat(np.arange(len(pieces)), size)
    place = np.arange(len(h)) - off[piece]
    is_window = place + length < size[piece]
    order = suffix_array(seq)
    tied = common_prefixes(seq, order) >= length
    cls = np.cumsum(~tied)
    ok = is_window[order]
    order, cls = order[ok], cls[ok]
    del tied, seq
    doc, base = np.array(doc)[piece[order]], np.array(base)[piece[order]] + place[order]
    rank = np.empty(len(docs), np.int64)
    rank[sorted(range(len(docs)), key=lambda d: (docs[d][1], docs[d][0]))] = np.arange(len(docs))
    by = np.lexsort((base, rank[doc], cls))
    doc, base, cls, order = doc[by], base[by], cls[by], order[by]
    first = np.r_[True, cls[1:] != cls[:-1]]
    count = np.diff(np.r_[np.flatnonzero(first), len(cls)])
    ks, ids = np.array([x[0] for x in docs]), np.array([x[1] for x in docs])
    late_doc, late = doc[~first], base[~first]
    by = np.argsort(late_doc, kind="stable")
    late_doc, late = late_doc[by], late[by]
    cut = np.flatnonzero(np.r_[True, late_doc[1:] != late_doc[:-1]]) if len(late_doc) else []
    for a, b in zip(cut, np.r_[cut[1:], len(late_doc)] if len(late_doc) else []):
        s, e = _islands(late[a:b], late[a:b] + length)
        d = int(late_doc[a])
        yield {"bucket": int(ks[d] % buckets), "fp": None, "idx": None, "pos": None, "cnt": None, "k": [int(ks[d])], "doc": [int(ids[d])], "runs": np.stack([s, e]).astype(np.int32).tobytes()}
    fp = window_hashes(h, length)[order[first]]
    by = np.argsort(fp)
    fp, doc, base, count = fp[by], doc[first][by], base[first][by], np.minimum(count, 2)[by]
    step = (1 << 64) // buckets + 1
    cuts = np.searchsorted(fp, np.array([i * step for i in range(1, buckets)], np.uint64))
    for i, (a, b) in enumerate(zip(np.r_[0, cuts], np.r_[cuts, len(fp)])):
        if a < b:
            used, idx = np.unique(doc[a:b], return_inverse=True)
            yield {"bucket": i, "fp": fp[a:b].tobytes(), "idx": idx.astype(np.int32).tobytes(), "pos": base[a:b].astype(np.int32).tobytes(), "cnt": count[a:b].astype(np.uint8).tobytes(), "k": ks[used].tolist(), "doc": ids[used].tolist(), "runs": None}


def _shards(length: int, gram: int, buckets: int, most: int):
    def rows(docs):
        out = list(_shard(docs, length, buckets))
        for i in range(0, len(out), 500):
            yield pa.RecordBatch.from_pylist(out[i : i + 500], _WIN)

    def run(batches):
        docs, words = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                keys, ids, marks = part.column("k").to_numpy(), part.column("doc_id").to_numpy(), part.column("pos")
                for d, at, _, h in _text_minimizers(Words(part.column("text")), length, gram):
                    mark = np.zeros(len(h), bool)
                    mark[marks[d].values.to_numpy()] = True
                    docs.append((int(keys[d]), int(ids[d]), h, np.flatnonzero(mark[at])))
                    words += len(h)
                    if words >= most:
                        yield from rows(docs)
                        docs, words = [], 0
        if docs:
            yield from rows(docs)

    return run


class _Run:
    """Fingerprints in order, with the first occurrence of each and how often it occurs, two at most."""

    def __init__(self, fp, doc, k, pos, cnt):
        self.fp, self.doc, self.k, self.pos, self.cnt = fp, doc, k, pos, cnt

    def merged(self, o: _Run) -> _Run:
        at = np.searchsorted(self.fp, o.fp)
        hit = at < len(self.fp)
        hit[hit] = self.fp[at[hit]] == o.fp[hit]
        i, j = at[hit], np.flatnonzero(hit)
        less = (o.doc[j] < self.doc[i]) | ((o.doc[j] == self.doc[i]) & ((o.k[j] < self.k[i]) | ((o.k[j] == self.k[i]) & (o.pos[j] < self.pos[i]))))
        cols = []
        self.cnt[i] = 2
        for name in ("doc", "k", "pos"):
            getattr(self, name)[i[less]] = getattr(o, name)[j[less]]
        for name in ("fp", "doc", "k", "pos", "cnt"):
            cols.append(np.insert(getattr(self, name), at[~hit], getattr(o, name)[~hit]))
        return _Run(*cols)


def _merge(length: int, with_first: bool):
    def run(batches):
        ranges: dict[int, list[_Run]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["runs"] is not None:
                    yield pa.RecordBatch.from_pydict({"k": pa.array(r["k"], pa.int64()), "doc_id": pa.array(r["doc"], pa.int64()), "removed": [True], "runs": pa.array([r["runs"]], pa.binary())})
                    continue
                idx = np.frombuffer(r["idx"], np.int32)
                ranges.setdefault(r["bucket"], []).append(_Run(np.frombuffer(r["fp"], np.uint64), np.array(r["doc"], np.int64)[idx], np.array(r["k"], np.int64)[idx], np.frombuffer(r["pos"], np.int32).copy(), np.frombuffer(r["cnt"], np.uint8).copy()))
        for bucket in list(ranges):
            runs = ranges.pop(bucket)
            given = [(r.fp, r.k.copy(), r.pos.copy(), r.doc.copy()) for r in runs]
            while len(runs) > 1:
                runs = [a.merged(b) for a, b in zip(runs[::2], runs[1::2])] + ([runs[-1]] if len(runs) % 2 else [])
            all_of = runs[0]
            fp, k, pos, doc = (np.concatenate(x) for x in zip(*given))
            at = np.searchsorted(all_of.fp, fp)
            late = (all_of.k[at] != k) | (all_of.pos[at] != pos)
            for removed, some in ((True, late), (False, ~late & (all_of.cnt[at] > 1))):
                if not some.any() or not (removed or with_first):
                    continue
                kk, pp, dd = k[some], pos[some].astype(np.int64), doc[some]
                by = np.lexsort((pp, kk))
                kk, pp, dd = kk[by], pp[by], dd[by]
                cut = np.flatnonzero(np.r_[True, kk[1:] != kk[:-1]])
                out = [np.stack([pp[a:b], pp[a:b] + length]).astype(np.int32).tobytes() for a, b in zip(cut, np.r_[cut[1:], len(kk)])]
                yield pa.RecordBatch.from_pydict({"k": pa.array(kk[cut]), "doc_id": pa.array(dd[cut]), "removed": pa.array(np.full(len(cut), removed)), "runs": pa.array(out, pa.binary())})

    return run


def _spans(batches):
    by: dict = {}
    for batch in batches:
        for r in batch.to_pylist():
            by.setdefault((r["k"], r["doc_id"], r["removed"]), []).append(np.frombuffer(r["runs"], np.int32).reshape(2, -1))
    rows = []
    for (k, doc, removed), runs in by.items():
        s, e = _islands(*np.concatenate(runs, 1).astype(np.int64))
        rows.append({"k": k, "doc_id": doc, "removed": removed, "starts": s.tolist(), "ends": e.tolist()})
    schema = pa.schema([("k", pa.int64()), ("doc_id", pa.int64()), ("removed", pa.bool_()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
    for i in range(0, len(rows), 5000):
        yield pa.RecordBatch.from_pylist(rows[i : i + 5000], schema)


def _key(id_col: str, text: str):
    return F.xxhash64(F.col(id_col).cast("bigint"), F.col(text))


def spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, with_first: bool = True, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(k, doc_id, removed, starts, ends): word intervals of each document that repeated windows cover.

    removed: those to remove; else those that hold the first occurrence. k tells texts of one id apart.
    """
    gram = min(gram, length)
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"), _key(id_col, text).alias("k")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    marks = src.select("k", "text").mapInArrow(trimmed(_anchors(length, gram)), "fp long, k long, pos int").repartition("fp").mapInArrow(trimmed(_repeated), "k long, pos int, fp long")
    marks = marks.groupBy("k").agg(F.collect_list("pos").alias("pos"), F.min("fp").alias("home"))
    some = src.join(marks, "k").dropDuplicates(["k"]).repartition("home").select("k", "doc_id", "text", "pos")
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wins = some.mapInArrow(trimmed(_shards(length, gram, buckets, shard_words)), "bucket int, fp binary, idx binary, pos binary, cnt binary, k array<long>, doc array<long>, runs binary")
    found = wins.repartition("bucket").mapInArrow(trimmed(_merge(length, with_first)), "k long, doc_id long, removed boolean, runs binary")
    return found.repartition("k").mapInArrow(trimmed(_spans), "k long, doc_id long, removed boolean, starts array<int>, ends array<int>")


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, removed), end exclusive, for each stretch of repeated windows."""
    s = spans(docs, id_col, text, length, gram, True, shard_words)
    return s.select("doc_id", "removed", F.explode(F.arrays_zip("starts", "ends")).alias("x")).select("doc_id", F.col("x.starts").alias("start_word"), F.col("x.ends").alias("end_word"), "removed")


def _cutter(text: str, n_chars: str | None, starts: str, ends: str):
    def run(batches):
        for batch in batches:
            names = [n for n in batch.schema.names if n not in (starts, ends)]
            has = np.flatnonzero(batch.column(starts).is_valid().to_numpy(zero_copy_only=False))
            if not len(has):
                yield batch.select(names)
                continue
            own = batch.column(text).to_pylist()
            live = np.ones(batch.num_rows, bool)
            for d in has.tolist():
                w = Words(pa.array([own[d]]), lower=False)
                raw = own[d].encode()
                at, out = 0, []
                for a, b in zip(batch.column(starts)[d].as_py(), batch.column(ends)[d].as_py()):
                    out.append(raw[at : w.start[a]])
                    at = int(w.start[b]) if b < len(w.start) else len(raw)
                own[d] = b"".join([*out, raw[at:]]).decode()
                live[d] = len(Words(pa.array([own[d]])).hashes) > 0
            cols = {n: batch.column(n) for n in names}
            cols[text] = pa.array(own, batch.schema.field(text).type)
            if n_chars:
                had = cols[n_chars].to_pylist()
                for d in has.tolist():
                    had[d] = len(own[d])
                cols[n_chars] = pa.array(had, batch.schema.field(n_chars).type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names).filter(pa.array(live))

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs without the words of repeated windows, and without texts of which no word is left; n_chars follows, where there is such a column."""
    tag = "__own"
    while any(c.startswith(tag) for c in docs.columns):
        tag += "_"
    cutting = spans(docs, id_col, text, length, gram, False).filter("removed").select(F.col("k").alias(tag), F.col("starts").alias(tag + "s"), F.col("ends").alias(tag + "e"))
    both = docs.withColumn(tag, F.when(F.col(id_col).isNotNull() & F.col(text).isNotNull(), _key(id_col, text))).join(cutting, tag, "left").drop(tag)
    both = both.select(*docs.columns, tag + "s", tag + "e")
    return both.mapInArrow(trimmed(_cutter(text, n_chars if n_chars in docs.columns else None, tag + "s", tag + "e")), docs.schema)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
