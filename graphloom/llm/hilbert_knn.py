"""Operator 2, approximate nearest neighbours on shifted space-filling curves.

Vectors are scaled to length one and projected to DIMS coordinates, by other random directions and
another shift for each curve; the coordinates give a Hilbert key. For each curve Spark range-partitions
all rows by key, which numbers them along the curve, and cuts them into blocks of `block` rows. A query's
candidates on a curve are the `w` rows before it and the `w` after it: the query goes to the blocks that
this window touches, the rows stay where they are. Each block ranks its candidates by cosine similarity;
the best of all blocks and curves are merged and ranked again in double precision. Blocks take their
queries as a stream, so no group has to fit into memory.

w and the number of curves are fitted on a bounded sample: of PROBES queries the true neighbours are
found by one scan, how far apart they lie on each curve is read from the keys of SAMPLE rows, and the
setting of least candidates is taken under which `recall` of them are within the windows. On clustered
vectors the windows are narrow; on vectors without structure in many dimensions they have to be wide,
as no curve keeps such neighbours together. The result is approximate by design.

Every row is indexed; queries are the rows whose id is divisible by `every`.

Defined results: ids are integers; rows with a null id, a null or empty vector, a vector with null, NaN
or infinite values, or of another length than most have no neighbours and are none; of rows repeated
under one id the least vector counts; a zero vector has similarity 0 to all; ties go to the smaller id
among the candidates; with fewer than k other rows all are neighbours; an empty table gives no rows;
columns other than id and vector are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import cut, table

K, CURVES, DIMS, BITS, BLOCK, PROBES, SAMPLE, RECALL, EVERY = 10, 8, 6, 10, 4096, 200, 20_000, 0.96, 50


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid coordinates under 2**bits (Skilling's transform)."""
    x = x.astype(np.uint64).copy()
    n = x.shape[1]
    one = np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > 1:
        p = q - one
        for i in range(n):
            on = (x[:, i] & q) > 0
            t = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(on, x[:, 0] ^ p, x[:, 0] ^ t)
            x[:, i] ^= np.where(on & (i > 0), 0, t).astype(np.uint64)
        q >>= one
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.uint64)
    q = one << np.uint64(bits - 1)
    while q > 1:
        t = np.where((x[:, n - 1] & q) > 0, t ^ (q - one), t)
        q >>= one
    x ^= t[:, None]
    key = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[:, i] >> np.uint64(b)) & one)
    return key


def curve_keys(v: np.ndarray, curve: int) -> np.ndarray:
    rnd = np.random.default_rng(1000 + curve)
    way = rnd.normal(size=(v.shape[1], DIMS))
    at = (v @ way / 2.5 + 1) / 2  # unit vectors project to a standard normal
    grid = (1 << BITS) - 1
    return hilbert_keys(np.clip((at * 0.75 + rnd.uniform(0, 0.25, DIMS)) * grid, 0, grid).astype(np.int64), BITS).astype(np.int64)


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    v = flat.reshape(len(col), -1)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(size > 0, size, 1)


def _keyed(curves: int):
    def run(batches):
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column("v"))
                keys = np.stack([curve_keys(v, c) for c in range(curves)], 1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * curves), pa.array(keys.ravel()))], ["id", "v", "keys"])

    return run


def _best(sim: np.ndarray, k: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all that may be among the k best of each row: within the margin of its k-th best."""
    k = min(k, sim.shape[1])
    least = -np.partition(-sim, k - 1, axis=1)[:, k - 1] - margin
    return np.nonzero((sim >= least[:, None]) & (sim > -5))


def _ranked(q: np.ndarray, qid: np.ndarray, c: np.ndarray, cid: np.ndarray, k: int, qat: np.ndarray | None = None, cat: np.ndarray | None = None, w: int = 0):
    """(query id, neighbour id, similarity) of the k best candidates of each query, itself apart; given places qat and cat only those within w."""
    c32 = c.astype(np.float32)
    margin = 4 * (c.shape[1] + 4) * 2.0**-24  # twice the rounding of two float32 products of unit vectors
    out = []
    for i in range(0, len(q), 256):
        part, own = q[i : i + 256], qid[i : i + 256]
        sim = part.astype(np.float32) @ c32.T
        sim[own[:, None] == cid[None, :]] = -9
        if qat is not None:
            sim[np.abs(qat[i : i + 256, None] - cat[None, :]) > w] = -9
        row, col = _best(sim, k, margin)
        exact = np.concatenate([np.zeros(0), *(np.einsum("nd,nd->n", part[row[j : j + 50_000]], c[col[j : j + 50_000]]) for j in range(0, len(row), 50_000))])
        exact = np.round(exact, 12)
        order = np.lexsort((cid[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        ok = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((own[row[ok]], cid[col[ok]], exact[ok]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def _probe(sent, k: int):
    def run(batches):
        ids, q = sent.value
        for b in batches:
            if b.num_rows:
                x = _ranked(q, ids, _matrix(b.column("v")), b.column("id").to_numpy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in x], ["id", "near", "similarity"])

    return run


def _numbered(batches):
    """Rows with the number of their partition and their place in it."""
    part, at = TaskContext.get().partitionId(), 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part)), pa.array(np.arange(at, at + b.num_rows)), b.column("id"), b.column("v")], ["part", "place", "id", "v"])
        at += b.num_rows


def _windows(k: int, w: int):
    """Rows by block, those of the block first and in order, then the queries that reach into it."""

    def run(batches):
        now, ids, at, v = None, [], [], []
        for b in batches:
            block, asks = b.column("block").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (asks[1:] != asks[:-1])]) if b.num_rows else []
            for x, y in zip(cuts, np.r_[cuts[1:], b.num_rows].astype(int) if len(cuts) else []):
                part = b.slice(x, y - x)
                if block[x] != now:
                    now, ids, at, v = block[x], [], [], []
                mine = part.column("id").to_numpy(), part.column("at").to_numpy(), _matrix(part.column("v"))
                if not asks[x]:
                    for all_, own in zip((ids, at, v), mine):
                        all_.append(own)
                elif ids:
                    ids, at, v = ([np.concatenate(c)] for c in (ids, at, v))
                    got = _ranked(mine[2], mine[0], v[0], ids[0], k, mine[1], at[0], w)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], ["id", "near", "similarity"])

    return run


def top(pairs: DataFrame, k: int) -> DataFrame:
    """The k best distinct neighbours of each id, numbered."""
    by = Window.partitionBy("id").orderBy(F.desc("similarity"), "near")
    return pairs.dropDuplicates(["id", "near"]).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def setting(gaps: np.ndarray, recall: float) -> tuple[int, int]:
    """(curves, w) of least candidates that hold `recall` of the true pairs; gaps: how far apart each pair is on each curve."""
    best = (1, 1, 1)
    if len(gaps):
        found = []
        for c in range(1, gaps.shape[1] + 1):
            w = max(1, int(np.sort(gaps[:, :c].min(1))[min(len(gaps) - 1, int(np.ceil(recall * len(gaps))) - 1)]))
            found.append((c * (2 * w + 1), c, w))
        best = min(found)
    return best[1], best[2]


def fitted(keyed: DataFrame, count: int, asked: DataFrame, k: int, curves: int, recall: float, probes: int, sample: int) -> tuple[int, int]:
    """(curves, w) for the rows, from at most `probes` queries and about `sample` rows' keys."""
    spark = keyed.sparkSession
    hashed = F.xxhash64("id")
    probe = asked.orderBy(hashed, "id").limit(probes).select("id", "v", "keys").collect()
    if not probe:
        return 1, 1
    sent = spark.sparkContext.broadcast((np.array([r.id for r in probe]), _matrix(pa.array([r.v for r in probe]))))
    truth = top(keyed.select("id", "v").mapInArrow(_probe(sent, k), _PAIRS), k).select("id", F.col("near").alias("to"))
    pairs = truth.join(keyed.select(F.col("id").alias("to"), F.col("keys").alias("there")), "to").select("id", "there").collect()
    drawn = keyed.filter(F.pmod(hashed, F.lit(1_000_003)) < int(1_000_003 * min(1.0, sample / count)) + 1).select("keys").collect()
    drawn = np.sort(np.array([r["keys"] for r in drawn], np.int64).reshape(-1, curves), axis=0)
    here = {r.id: r["keys"] for r in probe}
    if not pairs:
        return 1, 1
    a, b = np.array([here[r.id] for r in pairs]), np.array([r.there for r in pairs])
    step = count / max(len(drawn), 1)
    gaps = np.stack([np.maximum(*(np.abs(np.searchsorted(drawn[:, c], a[:, c], x) - np.searchsorted(drawn[:, c], b[:, c], y)) for x, y in (("left", "right"), ("right", "left")))) for c in range(curves)], 1)
    return setting(np.ceil((gaps + 1) * step).astype(np.int64), recall)


_PAIRS = "id long, near long, similarity double"


def neighbours(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = K, curves: int = CURVES, block: int = BLOCK, recall: float = RECALL, probes: int = PROBES, sample: int = SAMPLE, every: int = EVERY) -> DataFrame:
    """(id, near, rank, similarity) for the k nearest other rows, by cosine, of each row whose id is divisible by `every`."""
    spark = rows.sparkSession
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").filter(~bad)
    common = clean.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], "id long, near long, rank int, similarity double")
    clean = clean.filter(F.size("v") == common.n).groupBy("id").agg(F.min("v").alias("v"))
    kind = clean.schema["v"].dataType.simpleString()
    keyed = cut(clean.mapInArrow(_keyed(curves), f"id long, v {kind}, keys array<long>"))
    count = keyed.count()
    asks = F.pmod(F.col("id"), F.lit(every)) == 0
    use, w = fitted(keyed, count, keyed.filter(asks), k, curves, recall, probes, sample)
    parts = max(1, -(-count // (4 * block)))
    found = None
    for c in range(use):
        line = keyed.select("id", "v", F.col("keys")[c].alias("key")).repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id")
        line = cut(line.drop("key").mapInArrow(_numbered, f"part long, place long, id long, v {kind}"))
        # rows before each partition: a table of one row a partition
        before = line.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
        line = line.join(F.broadcast(before), "part").select("id", "v", (F.col("before") + F.col("place")).alias("at"))
        own = line.select(F.expr(f"at div {block}").alias("block"), F.lit(False).alias("asks"), "at", "id", "v")
        low, high = F.greatest(F.col("at") - w, F.lit(0)), F.least(F.col("at") + w, F.lit(count - 1))
        ask = line.filter(asks).select(F.explode(F.sequence(F.floor(low / block), F.floor(high / block))).alias("block"), F.lit(True).alias("asks"), "at", "id", "v")
        both = own.union(ask).repartition("block").sortWithinPartitions("block", "asks", "at")
        near = both.mapInArrow(_windows(k, w), _PAIRS)
        found = near if found is None else found.union(near)
    return top(found, k).select("id", "near", "rank", F.round("similarity", 6).alias("similarity"))


def op2_hilbert_neighbours(spark, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))

