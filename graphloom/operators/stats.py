"""Counts, coverage and accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C
from ..model import Graph
from .traverse import degree

TOKENS_PER_NODE, DOLLARS_PER_1K, NODES_PER_MINUTE = 600, 0.005, 6


def described():
    return F.coalesce(F.trim("description") != "", F.lit(False))


def counts(g: Graph) -> DataFrame:
    """(metric, key, value): totals, nodes and edges by type, described nodes by type and their share."""
    v = lambda c: c.cast("double").alias("value")
    kind = F.coalesce("type", F.lit(""))
    n = g.nodes.groupBy(kind.alias("key")).agg(F.count("*").alias("n"), F.count_if(described()).alias("d"))
    e = g.edges.groupBy(kind.alias("key")).agg(F.count("*").alias("n"))
    pct = F.bround(100.0 * F.col("d") / F.col("n"), 2)
    parts = [n.select(F.lit(m).alias("metric"), "key", v(c)) for m, c in (("nodes_by_type", F.col("n")), ("described_by_type", F.col("d")), ("coverage_by_type", pct))]
    parts.append(e.select(F.lit("edges_by_type").alias("metric"), "key", v(F.col("n"))))
    total = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("d"), F.lit(0)).alias("d"))
    parts += [total.select(F.lit("total").alias("metric"), F.lit(k).alias("key"), v(c)) for k, c in (("nodes", F.col("n")), ("described", F.col("d")), ("coverage", F.coalesce(pct, F.lit(0.0))))]
    parts.append(e.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total").alias("metric"), F.lit("edges").alias("key"), v(F.col("n"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def meaningful(g: Graph) -> DataFrame:
    """One row: described share of the types worth describing, and what describing the rest would cost."""
    n = g.nodes.filter(F.col("type").isin(*S.MEANINGFUL_TYPES)).agg(F.count("*").alias("total"), F.count_if(described()).alias("described"))
    left = F.col("total") - F.col("described")
    return n.select("total", "described", F.when(F.col("total") > 0, F.bround(100.0 * F.col("described") / F.col("total"), 2)).otherwise(0.0).alias("coverage_pct"), (left * TOKENS_PER_NODE).alias("tokens"), F.bround(left * (TOKENS_PER_NODE * DOLLARS_PER_1K / 1000), 2).alias("dollars"), F.ceil(left / NODES_PER_MINUTE).alias("minutes"))


def top_nodes(g: Graph, limit: int = 5) -> DataFrame:
    """(id, degree): resolved nodes with most incident edges."""
    return degree(g).join(g.nodes.filter(~C.unresolved()).select("id"), "id", "left_semi").select("id", "degree").orderBy(F.desc("degree"), "id").limit(limit)


def accuracy(expected: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """(key, precision, recall, f1) of sets of items (key.., item); 0 where a side is empty."""
    e, f = expected.select(*key, "item").distinct().withColumn("e", F.lit(1)), found.select(*key, "item").distinct().withColumn("f", F.lit(1))
    j = e.join(f, [*key, "item"], "full_outer").groupBy(*key).agg(F.count("e").alias("ne"), F.count("f").alias("nf"), F.count_if(F.expr("e = 1 AND f = 1")).alias("b"))
    p, r = F.when(F.col("nf") > 0, F.col("b") / F.col("nf")).otherwise(0.0), F.when(F.col("ne") > 0, F.col("b") / F.col("ne")).otherwise(0.0)
    return j.select(*key, F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(F.col("b") > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def latency(runs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median, p90)."""
    return runs.groupBy(key).agg(F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(0.9)).alias("p90"))


def quality(cases: DataFrame) -> DataFrame:
    """(category, bucket_hit_rate, label_recall, within_budget) of cases (category, expect_buckets, buckets, expect_labels, labels, bytes, max_tokens)."""
    share = lambda a, b: F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(1.0)
    return cases.groupBy("category").agg(F.round(F.avg(share("expect_buckets", "buckets")), 6).alias("bucket_hit_rate"), F.round(F.avg(share("expect_labels", "labels")), 6).alias("label_recall"), F.round(F.avg((F.col("max_tokens").isNull() | (F.ceil(F.col("bytes") / 4) <= F.col("max_tokens"))).cast("int")), 6).alias("within_budget"))
