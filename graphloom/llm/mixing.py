"""Operator 8, mixing sources to target weights by temperature.

Source token shares are raised to an exponent and normalised. The exponent is bisected: the
largest one in [0, 1] whose weights have at least the target share of the greatest possible
entropy, then, if a source would be seen more than `repetition` times, the least larger one
at which none is (1, the natural shares, where the budget itself allows no better). The weights
times the token budget give each source its budget, realised as whole passes over the source
and one part of a pass. Documents of a source fall into `blocks` blocks by a hash of the id; each
pass has its own permutation of the blocks, and the part pass takes blocks in that order while
the budget lasts, and within the block at its end documents in hash order.

Only the table of (source, block) sums leaves the cluster's row level: it is `blocks` rows a
source; the plan is joined back without a second pass over the text. Block sums and choices are
made in Spark; the driver sees one row a source for the bisection, and refuses more than
`most_sources`.

Defined results: a null source is a source of its own; a document with a null or wordless text has
no tokens and belongs to no pass; null ids hash like any value, repeated rows are drawn together;
an empty table gives no rows. Extra columns are kept by `mixed`. Tokens are runs of
non-blank characters.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import cut, table

ENTROPY, REPETITION, BLOCKS, SEED = 0.97, 2.0, 64, 17
TOKENS = r"regexp_count({}, '[^ \\t\\r\\n]+')"


def weights(tokens: list[int], budget: float, entropy: float = ENTROPY, repetition: float = REPETITION) -> tuple[float, list[float]]:
    """(exponent, weights) for the token counts of the sources; those of 0 get 0."""
    total = sum(tokens)
    some = [t for t in tokens if t > 0]
    if not some:
        return 1.0, [0.0 for _ in tokens]

    def at(a: float) -> list[float]:
        x = [(t / total) ** a if t > 0 else 0.0 for t in tokens]
        s = sum(x)
        return [v / s for v in x]

    def entropy_of(w: list[float]) -> float:
        return -sum(v * math.log(v) for v in w if v > 0)

    def most(w: list[float]) -> float:
        return max(v * budget / t for v, t in zip(w, tokens) if t > 0)

    need = entropy * math.log(len(some))
    low, high = 0.0, 1.0
    if entropy_of(at(1.0)) >= need:
        low = 1.0
    else:
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if entropy_of(at(mid)) >= need else (low, mid)
    if most(at(low)) > repetition + 1e-9:
        high = 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if most(at(mid)) <= repetition else (mid, high)
        low = high
    return low, at(low)


def _hash(*parts) -> F.Column:
    """A number from 0 to 2**32 - 1 that SQL engines can compute alike."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 8), 16, 10).cast("bigint")


def plan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", budget: int | None = None, entropy: float = ENTROPY, repetition: float = REPETITION, blocks: int = BLOCKS, seed: int = SEED, most_sources: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(each document's id, source, tokens, hash and block; the copies that (source, block) is due).

    Of the second: copies is the number of whole passes, plus one where the block is within the part
    pass; in the block where the budget ends, documents up to hash `last` get one more.
    """
    quoted = "`" + text.replace("`", "``") + "`"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source).cast("string").alias("source"), F.expr(TOKENS.format(quoted)).cast("bigint").alias("tokens"))
    rows = rows.filter("tokens > 0").withColumn("at", _hash(F.lit(seed), F.col("source"), F.col("doc_id"))).withColumn("block", F.expr(f"cast(at % {blocks} as int)"))
    rows = cut(rows)
    sums = cut(rows.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens")))
    per = sums.groupBy("source").agg(F.sum("block_tokens").alias("n")).orderBy("source").limit(most_sources + 1).collect()
    if len(per) > most_sources:
        raise ValueError(f"more than {most_sources} sources; group the rare ones first")
    spark = docs.sparkSession
    total = sum(r.n for r in per)
    goal = total if budget is None else budget
    _, w = weights([r.n for r in per], goal, entropy, repetition)
    schema = pa.schema([("source", pa.string()), ("weight", pa.float64()), ("passes", pa.int64()), ("rest", pa.int64())])
    shares = []
    for r, x in zip(per, w):
        due = int(x * goal + 0.5)
        shares.append((r.source, x, due // r.n, due % r.n))
    # a table of Arrow needs no Python workers, which would stay
    due = spark.createDataFrame(pa.table([pa.array([x[i] for x in shares], f.type) for i, f in enumerate(schema)], schema))
    order = Window.partitionBy("source").orderBy("turn", "block")
    b = sums.join(due, sums.source.eqNullSafe(due.source)).drop(due.source)
    b = b.withColumn("turn", _hash(F.lit(seed), F.lit("pass"), F.col("passes"), F.col("source"), F.col("block")))
    b = b.withColumn("before", F.sum("block_tokens").over(order) - F.col("block_tokens"))
    b = b.withColumn("left", F.col("rest") - F.col("before"))
    ends = b.filter("left > 0 AND left < block_tokens").select(F.col("source").alias("s"), F.col("block").alias("b"), "left")
    # the documents of the one block of each source in which the budget ends, in hash order
    inside = rows.join(ends, rows.source.eqNullSafe(ends.s) & (rows.block == ends.b)).groupBy("source", "block", "at", "left").agg(F.sum("tokens").alias("tokens"))
    run = F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("at"))
    last = inside.withColumn("run", run).filter("run <= left").groupBy("source", "block").agg(F.max("at").alias("last"))
    last = last.select(F.col("source").alias("s"), F.col("block").alias("b"), "last")
    b = b.join(last, b.source.eqNullSafe(last.s) & (b.block == last.b), "left")
    copies = b.select("source", "block", (F.col("passes") + F.expr("CASE WHEN left >= block_tokens THEN 1 ELSE 0 END")).alias("copies"), F.coalesce("last", F.lit(-1)).alias("last"), "weight")
    return rows, copies


def draw(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, source, tokens, copies, weight) for each document with tokens; copies may be 0."""
    rows, copies = plan(docs, **how)
    c = copies.select(F.col("source").alias("s"), F.col("block").alias("b"), "copies", "last", "weight")
    got = rows.join(c, rows.source.eqNullSafe(c.s) & (rows.block == c.b))
    return got.select("doc_id", "source", "tokens", (F.col("copies") + F.when(F.col("at") <= F.col("last"), 1).otherwise(0)).cast("int").alias("copies"), F.round("weight", 6).alias("weight"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """docs, each row as often as it is drawn, with its own columns only."""
    blocks, seed = how.get("blocks", BLOCKS), how.get("seed", SEED)
    _, copies = plan(docs, id_col, text, source, **how)
    tag = "__mix"
    while any(c.startswith(tag) for c in docs.columns):
        tag += "_"
    c = copies.select(*[F.col(x).alias(f"{tag}_{x}") for x in ("source", "block", "copies", "last")])
    at = _hash(F.lit(seed), F.col(source).cast("string"), F.col(id_col))
    quoted = "`" + text.replace("`", "``") + "`"
    both = docs.filter(F.expr(TOKENS.format(quoted)) > 0).withColumn(f"{tag}_at", at)
    both = both.join(c, F.col(source).cast("string").eqNullSafe(F.col(f"{tag}_source")) & (F.expr(f"{tag}_at % {blocks}") == F.col(f"{tag}_block")))
    times = F.col(f"{tag}_copies") + F.when(F.col(f"{tag}_at") <= F.col(f"{tag}_last"), 1).otherwise(0)
    both = both.withColumn(f"{tag}_n", F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
    return both.select(*[F.col("`" + x.replace("`", "``") + "`") for x in docs.columns])


def op8_temperature_mixing(spark, sf_dir: str) -> DataFrame:
    return draw(table(spark, sf_dir, "documents"))
