"""Ranked text retrieval: substring match of words, BM25 over split fields, hybrid scores, briefs.

A query is an AND of groups; a group is a word and its synonyms. All scores come from one pass over
the nodes; what is global (number of nodes, mean length, document frequencies) is one aggregated
row that is joined back.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..functions import columns as C
from ..model import Graph, aliases
from ..store import cut
from .traverse import incident, neighborhood, structural, trace_from


def groups(term: str) -> list[list[str]]:
    return [list(dict.fromkeys([w, *S.SYNONYMS.get(w, [])])) for w in C.words(term)]


def _parts(c: str) -> Column:
    """The lower-cased field and its parts; nothing for an empty one."""
    low = F.lower(F.coalesce(F.col(c), F.lit("")))
    parts = F.filter(F.split(F.translate(low, "/:.·-_", "      "), C.BLANKS), lambda x: x != "")
    return F.when(low == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(low), parts))


def _lower_all(c: str) -> Column:
    return F.transform(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull()), F.lower)


def tokens() -> Column:
    """Tokens of a node, with repeats: what the index and BM25 count."""
    split = F.flatten(F.transform(_lower_all("constants"), lambda x: F.concat(F.array(x), F.filter(F.split(F.translate(x, "/:.·-_", "      "), C.BLANKS), lambda y: y != ""))))
    return F.concat(_parts("id"), _parts("label"), _parts("file"), _lower_all("exports"), split, _parts("description"))


def token_index(nodes: DataFrame) -> DataFrame:
    """(token, id, tf): an inverted index."""
    return nodes.select("id", F.explode(tokens()).alias("token")).groupBy("token", "id").agg(F.count("*").alias("tf"))


def _holds(word: str):
    return lambda x: x.contains(word)


def _is(word: str):
    return lambda x: x == word


def _hit(group: list[str], constants: bool = True) -> Column:
    """Whether a field holds one of the words."""
    fields = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("id", "label", "file", "description")]
    one = [f.contains(w) for w in group for f in fields]
    lists = [F.exists(_lower_all(c), _holds(w)) for w in group for c in (("exports", "constants") if constants else ("exports",))]
    return reduce(lambda a, b: a | b, one + lists)


def match(nodes: DataFrame, term: str) -> DataFrame:
    """Nodes that hold a word of every group."""
    g = groups(term)
    return nodes.filter(reduce(lambda a, b: a & b, [_hit(x) for x in g])) if g else nodes.limit(0)


def scored(nodes: DataFrame, g: list[list[str]]) -> DataFrame:
    """nodes with bm25 and len: per group the best of its words, over all nodes."""
    words = sorted({w for x in g for w in x})
    base = nodes.withColumn("__tok", tokens()).withColumn("__len", F.size("__tok"))
    for i, w in enumerate(words):
        base = base.withColumn(f"__tf{i}", F.size(F.filter("__tok", _holds(w))))
    base = base.drop("__tok")
    stats = base.agg(F.count("*").alias("__n"), F.avg("__len").alias("__avg"), *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(len(words))])
    both = base.crossJoin(F.broadcast(stats))  # one row

    def one(i: int) -> Column:
        tf, df = F.col(f"__tf{i}"), F.col(f"__df{i}")
        idf = F.log(1 + (F.col("__n") - df + 0.5) / (df + 0.5))
        return F.when(tf > 0, idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * F.col("__len") / F.col("__avg")))).otherwise(F.lit(0.0))

    def best(x: list[str]) -> Column:
        cols = [one(words.index(w)) for w in x]
        return F.greatest(*cols) if len(cols) > 1 else cols[0]

    total = reduce(lambda a, b: a + b, [best(x) for x in g])
    return both.withColumn("bm25", total).drop(*[c for c in both.columns if c.startswith("__")])


def _cosine(term: str, text: Column) -> Column:
    """Cosine of word counts of the query and a text."""
    q = Counter(re.findall("[a-z0-9_]+", term.lower()))
    if not q:
        return F.lit(0.0)
    toks = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))
    dot = reduce(lambda a, b: a + b, [F.size(F.filter(toks, _is(w))) * n for w, n in q.items()])
    norm = F.sqrt(F.aggregate(F.transform(F.array_distinct(toks), lambda u: F.pow(F.size(F.filter(toks, lambda x: x == u)), F.lit(2))), F.lit(0.0), lambda a, x: a + x))
    return F.when(dot > 0, dot / (norm * math.sqrt(sum(n * n for n in q.values())))).otherwise(0.0)


def query(g: Graph, term: str, limit: int = 20, roles: tuple[str, ...] = ()) -> DataFrame:
    """(rank, id, type, label, bm25, structural, authority_rel, score, groups_hit, degraded).

    An old name of a node is that node alone. Otherwise all groups must match; where no node does
    and there are several, nodes that match any are taken, most groups first, then BM25.
    """
    gs = groups(term)
    out = ["rank", "id", "type", "label", "bm25", "structural", "authority_rel", "score", "groups_hit", "degraded"]
    old = aliases(g.nodes).filter(F.lower("alias") == term.strip().lower()).select("id") if gs else g.nodes.limit(0).select("id")
    named = g.nodes.filter(F.col("id") == term.strip()).select("id").union(old)
    base = scored(g.nodes, gs or [["\x00"]])
    strict = reduce(lambda a, b: a + b, [_hit(x).cast("int") for x in gs]) if gs else F.lit(0)
    loose = reduce(lambda a, b: a + b, [_hit(x, False).cast("int") for x in gs]) if gs else F.lit(0)
    base = base.withColumn("s", strict).withColumn("l", loose).filter("s > 0 OR l > 0")
    base = base.withColumn("enriched", F.when(F.trim(F.coalesce(F.get_json_object("props_json", "$.enrichment.description"), F.lit(""))) != "", F.trim(F.get_json_object("props_json", "$.enrichment.description"))))
    base = base.withColumn("semantic", F.when(F.col("enriched").isNotNull(), _cosine(term, F.col("enriched"))))
    base = base.join(named.select("id", F.lit(True).alias("named")).distinct(), "id", "left")
    held = cut(base.drop("description"))
    base = held.join(structural(g, held.select("id")).hint("shuffle_hash"), "id")
    keep = ["id", "type", "label", "bm25", "structural", "authority", "confidence", "resolution", "roles", "s", "l", "named", "semantic"]
    base = cut(base.select(*keep))
    exact, some = F.col("s") == len(gs), (F.col("l") > 0) & F.lit(len(gs) > 1)
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    seen = base.agg(any_(F.coalesce("named", F.lit(False))).alias("any_named"), any_(exact).alias("any_strict")).first()
    m = base.filter("named") if seen.any_named else base.filter(exact) if seen.any_strict else base.filter(some)
    degraded = not seen.any_named and not seen.any_strict
    m = m.withColumn("degraded", F.lit(degraded)).withColumn("groups_hit", F.col("l" if degraded else "s"))
    top = m.agg(F.max("bm25").alias("bm25"), F.max("semantic").alias("semantic"), F.max("structural").alias("structural")).first()
    w = S.SIGNAL_WEIGHTS
    on = {"bm25": (top.bm25 or 0) > 0, "semantic": top.semantic is not None, "structural": (top.structural or 0) > 0}
    m = m.withColumn("authority_rel", C.authority_relevance())
    parts = {"bm25": F.col("bm25") / (top.bm25 or 1.0), "semantic": F.coalesce("semantic", F.lit(0.0)), "structural": F.col("structural"), "authority": F.col("authority_rel")}
    used = [k for k in parts if on.get(k, True)]
    total = reduce(lambda a, b: a + b, [parts[k] * w[k] for k in used])
    m = m.withColumn("score", F.round(total / sum(w[k] for k in used), 9)).withColumn("bm25", F.round("bm25", 9))
    order = [F.when(F.col("degraded"), -F.col("groups_hit")).otherwise(C.resolution_penalty()), F.when(F.col("degraded"), -F.col("bm25")).otherwise(-F.col("score")), F.when(F.col("degraded"), 0).otherwise(C.role_boost(roles)), F.when(F.col("degraded"), 0).otherwise(C.confidence_rank()), F.col("id")]
    top = m.orderBy(*order).limit(limit)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return top.withColumn("bm25", F.round("bm25", 6)).withColumn("structural", F.round("structural", 6)).withColumn("score", F.round("score", 6)).select(*out)


def query_neighborhood(g: Graph, term: str, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """(neighbours, edges) of the matches that are returned."""
    ids = query(g, term, limit).select("id")
    return neighborhood(g, ids), incident(g, ids)


def brief(g: Graph, term: str, limit: int = 20) -> DataFrame:
    """(bucket, pos, id, relevance): matches and their neighbours by class, each bucket in its own order."""
    told = bool(set(C.words(term)) & set(S.INTERACTION_WORDS))
    ids = query(g, term, limit * 3).select("id")
    near = neighborhood(g, ids).select("id", F.lit(False).alias("match"))
    own = g.nodes.join(ids.select("id", F.lit(True).alias("match")).unionByName(near), "id")
    boost = F.when(C.interacts(), 0).otherwise(1) if told else F.lit(0)
    own = own.withColumn("class", C.node_class()).withColumn("bucket", F.create_map(*[F.lit(x) for p in {"doc": "docs", "build": "build", "boundary": "boundaries", "interface": "interfaces", "primary": "primary"}.items() for x in p])[F.col("class")])
    own = own.filter("match OR class <> 'primary'")
    by = Window.partitionBy("bucket").orderBy(boost, C.authority_rank(), C.confidence_rank(), "id")
    return own.withColumn("pos", F.row_number().over(by)).filter(F.col("pos") <= limit).select("bucket", "pos", "id", F.when(F.col("match"), "match").otherwise("related").alias("relevance"))


def trace(g: Graph, term: str | None = None, node: str | None = None, depth: int = 2, seed_limit: int = 5) -> DataFrame:
    """trace_from() of a node, or of the best-ranked matches of a term that have a trace bucket."""
    if (term is None) == (node is None):
        raise ValueError("give a term or a node")
    return trace_from(g, trace_seeds(g, term, node, seed_limit), depth)


def trace_seeds(g: Graph, term: str | None, node: str | None, seed_limit: int = 5) -> DataFrame:
    if node is not None:
        return g.nodes.filter(F.col("id") == node).select("id")
    start = bool(set(C.words(term)) & set(S.STARTUP_WORDS))
    m = query(g, term, seed_limit * 4).select("id", "rank").join(g.nodes, "id").withColumn("bucket", C.trace_bucket())
    m = m.withColumn("any", F.max(F.col("bucket").isNotNull()).over(Window.partitionBy())).filter("bucket IS NOT NULL OR NOT any")
    first = F.when(F.col("type") == "entrypoint", 0).when(F.col("type") == "boundary", 1).when(F.col("bucket").isNotNull(), 2).otherwise(3) if start else F.lit(0)
    return m.orderBy(F.when(F.col("any"), first).otherwise(0), F.when(F.col("any"), C.authority_rank()).otherwise(0), F.when(F.col("any"), C.confidence_rank()).otherwise(0), F.when(F.col("any"), F.lit(0)).otherwise(F.col("rank")), "id").limit(seed_limit).select("id")


def coverage_warnings(nodes: DataFrame) -> DataFrame:
    """(warning, key): protocols of which one side is missing, and surfaces that are mostly guesses."""
    side = nodes.filter(F.col("protocol").isin("http", "grpc")).groupBy("protocol").agg(F.bool_or(F.col("boundary_kind") == "inbound").alias("i"), F.bool_or(F.col("boundary_kind") == "outbound").alias("o"), F.bool_or(F.col("boundary_kind") == "internal").alias("n"))
    i, o, n = (F.coalesce(c, F.lit(False)) for c in ("i", "o", "n"))
    kinds = F.filter(F.array(F.when(i & ~o, "server_without_client"), F.when(o & ~i, "client_without_server"), F.when((F.col("protocol") == "grpc") & i & ~n, "no_internal")), lambda x: x.isNotNull())
    half = nodes.filter(C.interacts()).agg(F.count_if(F.col("confidence") == "speculative").alias("s"), F.count("*").alias("n")).filter("s * 2 > n").select(F.lit("mostly_speculative").alias("warning"), F.lit("confidence").alias("key"))
    return side.select(F.explode(kinds).alias("warning"), F.col("protocol").alias("key")).unionByName(half)


def find_files(index: DataFrame, term: str, limit: int = 20) -> DataFrame:
    """(rank, path, score, tokens) of files (path, tokens) by the number of tokens that hold the term."""
    t = term.lower()
    hit = F.size(F.filter("tokens", lambda x: F.lower(x).contains(t)))
    found = index.withColumn("score", hit).filter("score > 0")
    if limit == 0:
        found = found.limit(0)
    top = found.orderBy(F.desc("score"), "path")
    top = top.limit(limit) if limit > 0 else top
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path"))).select("rank", "path", "score", "tokens")


def grep(files: DataFrame, term: str, most_files: int = 25, most_lines: int = 200) -> DataFrame:
    """(path, line_no, line): the first lines of the first files (path, text) that hold the term, case kept."""
    own = files.filter(F.col("text").contains(term)).orderBy("path").limit(most_files)
    return own.select("path", F.posexplode(F.slice(F.split("text", "\n"), 1, most_lines)).alias("i", "line")).select("path", (F.col("i") + 1).alias("line_no"), "line")
