"""Inventory, impact, plans and audits of AI-customisation assets.

Assets are nodes of agent types; name, platform and the rest come from the property bag.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..model import Graph
from .traverse import degree

ASSET_TYPES = ("agent", "command", "config", "hook", "instruction", "mcp-server", "permission", "prompt", "skill", "subagent", "tool")
NEEDS_DESCRIPTION = ("agent", "command", "prompt", "skill", "subagent")
RESPONSIBLE = ("agent", "skill", "subagent")
VAGUE = ("", "todo", "tbd", "helper", "agent", "skill", "command", "description")
STOP = frozenset("a an and are be by change for from in is it make of on or our please should that the this to update we when with".split())


def _prop(key: str):
    return F.get_json_object("props_json", f"$.{key}")


def norm(c):
    """Lower case, blanks as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def entries(g: Graph, kinds: tuple[str, ...] | None = ASSET_TYPES, platform: str | None = None) -> DataFrame:
    """(id, type, name, platform, platform_name, path, description, status); kinds=None: of every node, else of assets that are more than referenced."""
    auth = F.coalesce("authority", _prop("authority"))
    status = F.when(auth.isin("canonical", "true"), "canonical").when(_prop("generated") == "true", "generated").when((auth != "") & ~auth.isin("external", "referenced"), auth).otherwise(F.coalesce(_prop("status"), F.lit("manual")))
    plat = F.coalesce(_prop("platform"), _prop("source_platform"), F.lit("generic"))
    n = g.nodes
    if kinds is not None:
        n = n.filter(F.col("type").isin(*kinds) & (F.coalesce("source_strategy", _prop("source_strategy")) == "agent_graph_static") & (F.coalesce(_prop("status"), F.lit("")) != "referenced"))
    e = n.select("id", F.coalesce("type", F.lit("")).alias("type"), F.coalesce(_prop("name"), "label", "id").alias("name"), plat.alias("platform"), F.coalesce(_prop("platform_name"), plat).alias("platform_name"), F.coalesce("file", F.lit("")).alias("path"), F.trim(F.regexp_replace(F.coalesce("description", F.lit("")), r"\s+", " ")).alias("description"), status.alias("status"))
    return e.filter((F.lower("platform") == platform.lower()) | (F.lower("platform_name") == platform.lower())) if platform else e



def ordered(e: DataFrame) -> DataFrame:
    return e.orderBy(F.lower("platform_name"), "type", F.lower("name"), "path", "id")


def resolve(g: Graph, text: str) -> DataFrame:
    """(id) of an asset by id, path, name (best connected) or path before a #."""
    q = text.strip()
    q = (q[2:] if q.startswith("./") else q).lower()
    e = entries(g, None)
    how = F.when(F.lower("id") == q, 0).when(F.lower("path") == q, 1).when(F.lower("name") == q, 2).when(F.lower("path").startswith(q + "#"), 3)
    rank = F.create_map(*[F.lit(x) for p in {"canonical": 0, "manual": 1, "generated": 2, "derived": 3}.items() for x in p])[F.col("status")]
    found = e.withColumn("how", how).filter("how IS NOT NULL").join(degree(g).select("id", "degree"), "id", "left")
    return found.orderBy("how", F.coalesce(rank, F.lit(4)), F.desc(F.coalesce("degree", F.lit(0))), F.lower("platform_name"), "type", F.lower("name"), "path", "id").limit(1).select("id")


def relations(g: Graph, target: DataFrame) -> DataFrame:
    """(id, edge_type, direction) of nodes next to the target (id)."""
    t = target.select(F.col("id").alias("t"))
    out = g.edges.join(t, F.col("src") == F.col("t"), "left_semi").select(F.col("dst").alias("id"), F.col("type").alias("edge_type"), F.lit("out").alias("direction"))
    return out.unionByName(g.edges.join(t, F.col("dst") == F.col("t"), "left_semi").select(F.col("src").alias("id"), F.col("type").alias("edge_type"), F.lit("in").alias("direction")))


def _weight(c):
    return F.coalesce(F.create_map(*[F.lit(x) for p in S.AGENT_WEIGHTS.items() for x in p])[c], F.lit(S.AGENT_WEIGHT_ELSE))


def impact(g: Graph, text: str) -> DataFrame:
    """(id, weight) of what a change of the asset concerns: neighbours, variants of the same name or purpose, and canonical ones, by added weights."""
    t = resolve(g, text)
    e = entries(g)
    own = entries(g, None).join(t, "id", "left_semi").select(norm(F.col("name")).alias("n"), norm(F.col("description")).alias("d"), F.col("type").alias("ty"), F.col("id").alias("t"))
    rel = relations(g, t).select("id", "edge_type")
    name = e.join(own, (norm(F.col("name")) == F.col("n")) & (F.col("type") == F.col("ty")) & (F.col("id") != F.col("t"))).select("id", F.lit("same_name").alias("edge_type"))
    purpose = e.join(own, (F.col("d") != "") & (norm(F.col("description")) == F.col("d")) & (F.col("id") != F.col("t"))).select("id", F.lit("same_purpose").alias("edge_type"))
    canon = e.filter("status = 'canonical'").join(own, (norm(F.col("name")) == F.col("n")) & (F.col("id") != F.col("t"))).select("id", F.lit("same_name").alias("edge_type"))
    every = rel.unionByName(name).unionByName(purpose).unionByName(canon)
    return every.groupBy("id").agg(F.sum(_weight(F.col("edge_type"))).alias("weight"))


def plan(g: Graph, request: str, most: int = 5) -> DataFrame:
    """(role, id, score, path): the best-scored assets of a request (ties up to most), and what a change of them concerns by weight, canonical ones always."""
    terms = [t for t in dict.fromkeys(re.findall("[a-z0-9]+", request.lower())) if t not in STOP]
    e = entries(g)
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    score = reduce(lambda a, b: a + b, [F.array_contains(words(F.col(c)), t).cast("int") * w for t in terms for c, w in (("name", 5), ("description", 2), ("path", 1), ("type", 1))], F.lit(0))
    best = e.withColumn("score", score).filter("score > 0").withColumn("top", F.max("score").over(Window.partitionBy())).filter("score = top")
    first = best.orderBy(F.lower("platform_name"), "type", F.lower("name"), "path", "id").limit(most)
    ids = first.select("id")
    rel = g.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"), "type").unionByName(g.edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"), "type"))
    near = rel.groupBy("id").agg(F.sum(_weight(F.col("type"))).alias("w")).join(ids, "id", "left_anti").join(entries(g, None), "id").filter((F.col("w") >= S.AGENT_THRESHOLD) | (F.col("status") == "canonical"))
    return first.select(F.lit("primary").alias("role"), "id", F.col("score").cast("double").alias("score"), "path").unionByName(near.select(F.lit("secondary").alias("role"), "id", F.col("w").alias("score"), "path"))


def _finding(df: DataFrame, code: str, severity: str = "warning") -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.array_sort("node_ids").alias("node_ids"))


def _alone(df: DataFrame, code: str, severity: str = "warning") -> DataFrame:
    return _finding(df.select(F.array("id").alias("node_ids")), code, severity)


def audit(g: Graph, bodies: DataFrame | None = None) -> DataFrame:
    """(code, severity, node_ids): findings; bodies: (text) of instructions, whose mention of a skill counts as its use."""
    e = entries(g)
    every = entries(g, None)
    named = e.withColumn("n", norm(F.col("name"))).withColumn("d", norm(F.col("description")))
    rendered = g.edges.filter("type = 'generated_from'").select("src", "dst")
    out = []
    # a name is told twice where fewer pairs of it are linked than there are
    ends = named.select("id", "type", "n")
    linked = rendered.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct()
    linked = linked.join(ends.withColumnRenamed("id", "a"), "a").join(ends.withColumnRenamed("id", "b"), ["b", "type", "n"]).groupBy("type", "n").agg(F.count("*").alias("tied"))
    loose = ends.groupBy("type", "n").agg(F.count_distinct("id").alias("k")).join(linked, ["type", "n"], "left").filter("k * (k - 1) / 2 > coalesce(tied, 0)").select("type", "n")
    out.append(_finding(named.join(loose, ["type", "n"], "left_semi").groupBy("type", "n").agg(F.collect_set("id").alias("node_ids")), "duplicate_name"))
    out.append(_finding(named.filter(F.col("type").isin(*RESPONSIBLE) & (F.col("d") != "")).groupBy("d").agg(F.collect_set("id").alias("node_ids")).filter("size(node_ids) > 1"), "responsibility_overlap"))
    scope = g.edges.filter("type = 'applies_to_path'").join(g.nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    out.append(_finding(scope.groupBy("dst").agg(F.collect_set("src").alias("node_ids"), F.count("*").alias("k")).filter("k > 1"), "path_scope_overlap"))
    tool = g.edges.filter("type IN ('provides_tool', 'restricts_tool')").join(every.filter("type = 'tool'").select(F.col("id").alias("dst"), F.col("name").alias("tool")), "dst").join(named.select(F.col("id").alias("src"), "n"), "src")
    fight = tool.groupBy("n", "tool").agg(F.bool_or(F.col("type") == "provides_tool").alias("y"), F.bool_or(F.col("type") == "restricts_tool").alias("x")).filter("x AND y").select("n").distinct()
    out.append(_finding(named.join(fight, "n", "left_semi").groupBy("n").agg(F.collect_set("id").alias("node_ids")), "permission_conflict", "error"))
    out.append(_alone(named.filter((F.col("type") == "hook") & ~F.col("d").rlike("risk|rollback|safe")), "unsafe_hook"))
    out.append(_alone(named.filter(F.col("type").isin(*NEEDS_DESCRIPTION) & ~F.col("status").isin("derived", "generated") & ((F.size(F.filter(F.split("d", " "), lambda x: x != "")) < 3) | F.col("d").isin(*VAGUE))), "vague_description"))
    out.append(_finding(named.groupBy("type", "n").agg(F.collect_set("id").alias("node_ids"), F.size(F.collect_set(F.when(F.col("d") != "", F.col("d")))).alias("k")).filter("size(node_ids) > 1 AND k > 1"), "platform_drift"))
    skills = named.filter("type = 'skill'").join(g.edges.filter("type = 'uses_skill'").select(F.col("dst").alias("id")), "id", "left_anti")
    if bodies is not None:
        skills = skills.join(bodies.select(F.lower("text").alias("t")), F.expr(r"n <> '' AND t RLIKE concat('\\b\\Q', n, '\\E\\b')"), "left_anti")
    out.append(_alone(skills, "unused_skill", "info"))
    out.append(_alone(named.filter("type = 'subagent'").join(g.edges.filter("type IN ('handoff_to', 'invokes_agent')").select(F.col("dst").alias("id")), "id", "left_anti"), "unreachable_subagent"))
    gone = every.filter("type = 'agent' AND status = 'referenced'").select(F.col("id").alias("dst"))
    out.append(_finding(g.edges.join(every.filter("type = 'command'").select(F.col("id").alias("src")), "src", "left_semi").join(gone, "dst", "left_semi").select(F.array("src", "dst").alias("node_ids")), "missing_agent", "error"))
    out.append(_alone(every.filter("type = 'mcp-server' AND status = 'referenced'"), "missing_mcp_config", "error"))
    canon = named.filter("status = 'canonical'")
    out.append(_finding(canon.groupBy("type", "n").agg(F.collect_set("id").alias("node_ids")).filter("size(node_ids) > 1"), "ambiguous_canonical", "error"))
    copy = rendered.join(named.select(F.col("id").alias("src"), F.col("d").alias("ds")), "src").join(named.select(F.col("id").alias("dst"), F.col("d").alias("dd")), "dst")
    out.append(_finding(copy.filter("ds <> dd").select(F.array("src", "dst").alias("node_ids")), "rendered_copy_drift"))
    out.append(_finding(rendered.join(g.nodes.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.array("src", "dst").alias("node_ids")), "missing_render_target", "error"))
    return reduce(DataFrame.unionByName, out).distinct()


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def slice_query(g: Graph, term: str, edge_types: tuple[str, ...] | None = None) -> DataFrame:
    """(id) of nodes whose id, label, type and bag hold all words of the term; no synonyms, no ranks."""
    hay = F.lower(F.concat_ws("\n", "id", "label", "type", "file", "description", _prop("name"), _prop("platform")))
    return g.nodes.filter(reduce(lambda a, b: a & b, [hay.contains(w) for w in term.lower().split()], F.lit(True))).select("id").orderBy("id")


def references(texts: DataFrame) -> DataFrame:
    """(path, ref): path-like references in texts (path, text)."""
    return texts.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![\w/])((?:\.{0,2}/)?(?:[\w.-]+/)+[\w.-]+\.\w+)"), F.lit(1)))).alias("ref"))
