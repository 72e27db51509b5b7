"""Operator 1, quality classifier: naive Bayes support vectors.

Indicators of word unigrams and bigrams, of runs of punctuation, of word shapes and of how often a
word repeats the one before it are hashed to 2**BITS features. Over a sample of labelled documents
the class log-count ratio of each feature is taken; indicators are scaled by it, and a linear
hinge-loss model is fitted on them by dual coordinate descent. (`beta` under 1 interpolates its
weights with their mean size; held out, 1 was the better here.) Two heads are fitted: low quality and toxic; a document is kept when it is neither.

The fitting sample is bounded by `per_class` labelled documents of each class and head, the least
by a hash of the id; it goes to one task. The weights have a fixed size and go to the executors;
every document is scored whole. Features in fewer than `least_docs` documents of the sample have
no weight.

Defined results: a null, empty or featureless text is not kept, with null scores; null ids
pass through; repeated rows are scored alike; labels that are null, or of unknown ids, are not
used; a head for which the sample has one class only scores -1 (that class is not what it looks
for) or 1; an empty table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import table
from .text import Words, mix, mix_int, slices, string_buffer

BITS, PER_CLASS, LEAST_DOCS = 20, 4000, 5
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 95), 96, *range(123, 127)]] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = 65, 97, 97, 48


def _bins(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h + np.uint64(mix_int(salt))) >> np.uint64(64 - BITS)).astype(np.int64)


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features, offsets): the distinct features of each text."""
    low = Words(col)
    raw, off = string_buffer(col)
    punct = Words.of_bytes(raw, off, _PUNCT)
    shape = Words.of_bytes(_SHAPE[raw] if len(raw) else raw, off)
    docs = len(off) - 1
    doc = low.doc_of()
    parts = [(doc, _bins(low.hashes, 1)), (punct.doc_of(), _bins(punct.hashes, 3)), (shape.doc_of(), _bins(shape.hashes, 4))]
    if len(doc) > 1:
        same = doc[1:] == doc[:-1]
        parts.append((doc[1:][same], _bins(low.hashes[:-1] * np.uint64(3) + low.hashes[1:], 2)[same]))
        stutter = np.bincount(doc[1:][same & (low.hashes[1:] == low.hashes[:-1])], minlength=docs)
        words = np.diff(low.off)
        some = np.flatnonzero(words > 0)
        parts.append((some, _bins(np.digitize(stutter[some] / words[some], [1e-9, 0.02, 0.05, 0.2]).astype(np.uint64), 5)))
    x = np.sort(np.concatenate([(d << BITS) | f for d, f in parts]))
    if len(x):
        x = x[np.r_[True, x[1:] != x[:-1]]]
    return (x & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(x >> BITS, np.arange(docs + 1))


def fit(rows: list[np.ndarray], y: np.ndarray, c: float = 1.0, epochs: int = 12, beta: float = 1.0, least_docs: int = LEAST_DOCS, seed: int = 5) -> tuple[np.ndarray, float]:
    """(weights, bias) for feature lists and labels 1 and -1; weights include the log-count ratios."""
    size = 1 << BITS
    if len(set(y.tolist())) < 2:
        return np.zeros(size, np.float32), float(y[0]) if len(y) else -1.0
    count = {s: np.bincount(np.concatenate([r for r, v in zip(rows, y) if v == s]), minlength=size) for s in (1, -1)}
    p, q = count[1] + 1.0, count[-1] + 1.0
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[count[1] + count[-1] < least_docs] = 0
    rows = [r[ratio[r] != 0] for r in rows]
    square = np.array([(ratio[r] ** 2).sum() for r in rows]) + 1.0
    w, b, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    rnd = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rnd.permutation(len(rows)):
            r = rows[i]
            x = ratio[r]
            g = y[i] * (w[r] @ x + b) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), c)
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * x
                b += step
                alpha[i] = new
                moved = max(moved, abs(step) * square[i])
        if moved < 1e-3:
            break
    used = ratio != 0
    w[used] = beta * w[used] + (1 - beta) * np.abs(w[used]).mean() * np.sign(w[used])
    return (w * ratio).astype(np.float32), float(b)


def scores(col: pa.Array, w: np.ndarray, b: float) -> np.ndarray:
    f, off = features(col)
    acc = np.r_[0.0, np.cumsum(w[f], dtype=np.float64)]
    return np.where(np.diff(off) > 0, acc[off[1:]] - acc[off[:-1]] + b, np.nan)


def _featured(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            f, off = features(part.column("text"))
            data = pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer((off * 4).astype(np.int64)), pa.py_buffer(f)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("at"), part.column("y"), data], ["at", "y", "f"])


def _fitted(least_docs: int):
    def run(batches):
        got = [(b.column("at").to_pylist(), b.column("y").to_pylist(), b.column("f").to_pylist()) for b in batches]
        data = sorted(((a, y, f) for at, ys, fs in got for a, y, f in zip(at, ys, fs)), key=lambda x: (x[0], x[1], x[2]))
        w, b = fit([np.frombuffer(f, np.int32) for *_, f in data], np.array([1 if y else -1 for _, y, _ in data]), least_docs=least_docs)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([b])], ["w", "b"])

    return run


def train(docs: DataFrame, labels: DataFrame, positive: str, id_col: str = "doc_id", text: str = "text", per_class: int = PER_CLASS, least_docs: int = LEAST_DOCS) -> tuple[np.ndarray, float]:
    """A head for the labelled documents where the SQL predicate `positive` over labels holds."""
    own = labels.select(F.col(id_col).cast("bigint").alias("__id"), F.expr(positive).alias("y")).filter("y IS NOT NULL AND __id IS NOT NULL").withColumn("at", F.xxhash64("__id"))
    part = None
    for side in (True, False):
        one = own.filter(F.col("y") == side).orderBy("at", "__id").limit(per_class)
        part = one if part is None else part.union(one)
    rows = docs.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text).alias("text")).filter("text IS NOT NULL").join(F.broadcast(part), "__id")
    found = rows.select("at", "y", "text").mapInArrow(_featured, "at long, y boolean, f binary").repartition(1).mapInArrow(_fitted(least_docs), "w binary, b double").collect()
    return (np.frombuffer(found[0].w, np.float32), found[0].b) if found else (np.zeros(1 << BITS, np.float32), -1.0)


def classify(docs: DataFrame, low: tuple[np.ndarray, float], toxic: tuple[np.ndarray, float], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, low_quality, toxic, keep): margins of the heads and whether neither is positive."""
    sent = docs.sparkSession.sparkContext.broadcast((low, toxic))

    def run(batches):
        heads = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                a, b = (scores(part.column("text"), *h) for h in heads)
                none = np.isnan(a)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(a, mask=none), pa.array(b, mask=none), pa.array(~none & (a < 0) & (b < 0))], ["id", "low_quality", "toxic", "keep"])

    kind = dict(docs.select(id_col).dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, low_quality double, toxic double, keep boolean").withColumnRenamed("id", id_col)


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return classify(docs, train(docs, labels, "quality = 0"), train(docs, labels, "toxic = 1"))
