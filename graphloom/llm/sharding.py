"""Operator 5, sharding by sampled splitters.

Records are ordered by (key, id). A record is sampled with a chance in proportion to its bytes
(surely, where it is larger than the sampling step), by a hash of the id, so that every run draws
the same sample. The weighted quantiles of the sample are the range boundaries; each record
finds its range by binary search in them. A range of over `slack` times the mean is subdivided
by running bytes in the order of (key, id, bytes). The number of shards is total bytes over `target`,
`least` at the fewest; the sample has `oversample` records a shard. The splitters, one row a shard, go to
the driver and the executors; more than `most_shards` is refused.

`shards` gives the plan, `sharded` the records themselves, range-partitioned and in order, and `write` a
folder for each shard. All three find the shard of a record from the record alone, without a join.

Defined results: ids are integers and may repeat; null keys and null ids sort first; a null text has no
bytes, as an empty one has; records that tie in key, id and bytes are in one shard, so repeated rows stay
together; a very long record is a shard of its own, or nearly so; an empty table gives no rows. `shards`
ignores columns other than id, key and text, `sharded` and `write` keep them; their new columns get a
free name, with underscores, where theirs is taken.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import cut, table

TARGET, LEAST, OVERSAMPLE, SLACK = 256 << 20, 32, 32, 1.25


def _order(key, ident):
    return (key is not None, key or "", ident is not None, ident or 0)


class Plan:
    """Boundaries of ranges, as _order() gives them; first: of a subdivided range the first (order, bytes) of each shard after its first one."""

    def __init__(self, cuts: list[tuple], base: list[int] | None = None, first: dict[int, list] | None = None):
        self.cuts, self.base, self.first = cuts, base, first or {}
        self.keys, self.low = [], []  # distinct keys of the cuts and where each begins
        for i, c in enumerate(cuts):
            if not self.keys or self.keys[-1] != c[:2]:
                self.keys.append(c[:2]), self.low.append(i)
        self.low.append(len(cuts))
        self.ids = [np.array([c[3] for c in cuts[a:b] if c[2]], np.int64) for a, b in zip(self.low, self.low[1:])]

    def ranges(self, key: pa.Array, ident: pa.Array) -> np.ndarray:
        """The range of each record: how many boundaries are before it."""
        d = key.dictionary_encode(null_encoding="encode")
        code = d.indices.to_numpy(zero_copy_only=False)
        ids, null = pc.fill_null(ident, 0).to_numpy(zero_copy_only=False), ident.is_null().to_numpy(zero_copy_only=False)
        out = np.zeros(len(code), np.int32)
        for c, k in enumerate(d.dictionary.to_pylist()):
            at = np.flatnonzero(code == c)
            k = _order(k, None)[:2]
            i = bisect_left(self.keys, k)
            out[at] = self.low[i]
            if i < len(self.keys) and self.keys[i] == k:
                empty = self.low[i + 1] - self.low[i] - len(self.ids[i])
                out[at] += np.where(null[at], 0, empty + np.searchsorted(self.ids[i], ids[at])).astype(np.int32)
        return out

    def shards(self, key: pa.Array, ident: pa.Array, size: np.ndarray) -> np.ndarray:
        own = self.ranges(key, ident)
        out = np.array(self.base, np.int32)[own]
        for i in np.flatnonzero(np.isin(own, list(self.first))):
            out[i] += bisect_right(self.first[own[i]], (_order(key[i].as_py(), ident[i].as_py()), int(size[i])))
        return out


def plan(rows: DataFrame, target: int = TARGET, least: int = LEAST, oversample: int = OVERSAMPLE, slack: float = SLACK, most_shards: int = 2_000_000) -> Plan:
    """The boundaries for rows (doc_id, key, bytes)."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    n = max(least, -(-total // target))
    if n > most_shards:
        raise ValueError(f"over {most_shards} shards; raise target")
    step = max(1, total // (n * oversample))
    at = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("bigint")
    sample = rows.filter((F.col("bytes") > 0) & (at * step < F.col("bytes") * (1 << 32))).groupBy("key", "doc_id").agg(F.sum(F.greatest("bytes", F.lit(step))).alias("w"))
    # about n * oversample rows of the sample are put in order; the boundaries are as many as shards
    order = [F.col("key").asc_nulls_first(), F.col("doc_id").asc_nulls_first()]
    run = sample.withColumn("end", F.sum("w").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("w").over(Window.partitionBy()))
    splits = run.filter(f"`end` < `all` AND (`end` * {n}) div `all` > ((`end` - w) * {n}) div `all`").select("key", "doc_id")
    found = Plan(sorted(_order(r.key, r.doc_id) for r in splits.collect()))

    def ranges(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found.ranges(b.column("key"), b.column("doc_id")), pa.int32())], [*b.schema.names, "range"])

    own = rows.mapInArrow(ranges, "doc_id long, key string, bytes long, range int")
    mean = total / n
    size = {r.range: r.size for r in own.groupBy("range").agg(F.sum("bytes").alias("size")).collect()}
    parts = [-int(-size[i] // (mean or 1.0)) if size.get(i, 0) > slack * mean else int(i in size) for i in range(len(found.cuts) + 1)]
    base = np.r_[0, np.cumsum(parts)].tolist()
    over = [(i, p, size[i]) for i, p in enumerate(parts) if p > 1]
    first: dict[int, list] = {}
    if over:
        many = F.broadcast(rows.sparkSession.createDataFrame(over, "range int, parts long, size long"))  # one row a range
        alike = own.join(many, "range").groupBy("range", "parts", "size", "key", "doc_id", "bytes").agg(F.sum("bytes").alias("all"))
        before = F.sum("all").over(Window.partitionBy("range").orderBy(*order, "bytes").rowsBetween(Window.unboundedPreceding, 0)) - F.col("all")
        sub = alike.withColumn("before", before).withColumn("sub", F.least(F.expr("before * parts div size"), F.col("parts") - 1))
        start = F.struct(F.col("key").isNotNull(), F.coalesce("key", F.lit("")), F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), F.col("bytes"))
        for r in sub.filter("sub > 0").groupBy("range", "sub").agg(F.min_by(F.struct("key", "doc_id", "bytes"), start).alias("x")).orderBy("range", "sub").collect():
            held = first.setdefault(r.range, [])
            held += [(_order(r.x.key, r.x.doc_id), r.x.bytes)] * (r["sub"] - len(held))
    return Plan(found.cuts, base, first)


def _rows(docs: DataFrame, id_col: str, key: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(key).cast("string").alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("bytes"))


def _placed(df: DataFrame, made: Plan, key: str, ident: str, size: str, name: str) -> DataFrame:
    def run(batches):
        for b in batches:
            found = made.shards(b.column(key), b.column(ident), b.column(size).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int32())], [*b.schema.names, name])

    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{kinds}, `{name}` int")


def shards(docs: DataFrame, id_col: str = "doc_id", key: str = "source", text: str = "text", **how) -> DataFrame:
    """(doc_id, key, bytes, shard) for each record; shards are numbered in key order."""
    rows = cut(_rows(docs, id_col, key, text))
    return _placed(rows, plan(rows, **how), "key", "doc_id", "bytes", "shard")


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def sharded(docs: DataFrame, id_col: str = "doc_id", key: str = "source", text: str = "text", **how) -> tuple[DataFrame, str]:
    """(docs with a column of shard numbers, range-partitioned by it and in order of key and id within; that column's name)."""
    made = plan(cut(_rows(docs, id_col, key, text)), **how)
    names = {}
    for n in ("shard", "key", "ident", "size"):
        names[n] = _free(n, [*docs.columns, *names.values()])
    k, i, z = (names[n] for n in ("key", "ident", "size"))
    own = docs.withColumn(k, F.col(key).cast("string")).withColumn(i, F.col(id_col).cast("bigint")).withColumn(z, F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint"))
    out = _placed(own, made, k, i, z, names["shard"])
    line = [F.col(names["shard"]), F.col(k).asc_nulls_first(), F.col(i).asc_nulls_first(), F.col(z)]
    # one task a shard, by its number; hashing would put several into one
    return out.repartitionById(max(1, made.base[-1]), names["shard"]).sortWithinPartitions(*line).drop(k, i, z), names["shard"]


def write(docs: DataFrame, path: str, id_col: str = "doc_id", key: str = "source", text: str = "text", **how) -> str:
    """docs as Parquet with one folder a shard, sorted by key and id; returns the name of the column of shard numbers."""
    out, name = sharded(docs, id_col, key, text, **how)
    out.write.partitionBy(name).parquet(path)
    return name


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))[0]


ORACLE = f"""
WITH r AS (SELECT *, source AS key, coalesce(strlen(text), 0) AS bytes, ('0x' || substr(md5(coalesce(cast(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS hv FROM documents),
t AS (SELECT sum(bytes)::BIGINT AS total, greatest({LEAST}, (sum(bytes)::BIGINT + {TARGET - 1}) // {TARGET}) AS n FROM r),
s AS (SELECT *, greatest(1, total // (n * {OVERSAMPLE})) AS step FROM t),
g AS (SELECT key, doc_id, sum(greatest(bytes, step))::BIGINT AS w, any_value(n) AS n FROM r, s WHERE bytes > 0 AND hv * step < bytes * 4294967296 GROUP BY key, doc_id),
c AS (SELECT *, sum(w) OVER (ORDER BY key NULLS FIRST, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)::BIGINT AS e, sum(w) OVER ()::BIGINT AS a FROM g),
x AS (SELECT key, doc_id FROM c WHERE e < a AND (e * n) // a > ((e - w) * n) // a),
f AS (SELECT r.*, (SELECT count(*) FROM x WHERE x.key < r.key OR (x.key = r.key AND x.doc_id < r.doc_id)) AS rng FROM r),
z AS (SELECT rng, sum(bytes)::BIGINT AS size FROM f GROUP BY rng),
p AS (SELECT rng, size, CASE WHEN size > {SLACK} * (total / n) THEN ceil(size / (total / n)) ELSE 1 END::INT AS parts FROM z, s),
b AS (SELECT *, sum(parts) OVER (ORDER BY rng ROWS UNBOUNDED PRECEDING) - parts AS base FROM p)
SELECT doc_id, text, lang, source, n_chars, (base + least((sum(bytes) OVER (PARTITION BY f.rng ORDER BY key, doc_id, bytes) - sum(bytes) OVER (PARTITION BY f.rng, key, doc_id, bytes)) * CASE WHEN parts > 1 THEN parts ELSE 0 END // greatest(size, 1), parts - 1))::INT AS shard
FROM f JOIN b ON f.rng = b.rng
"""
