"""Neighbourhoods, breadth-first traversals and shortest paths.

Each hop is one join of the frontier with the edges on the end it enters by; visited nodes are
taken out by an anti join, and the hop is cut into the shared folder so that plans stay short.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..functions.columns import surface, trace_bucket
from ..model import Graph, aliases, edge_key
from ..store import BROADCAST_ROWS, cut, few, within, without


def _ids(g: Graph, ids: list[str]) -> DataFrame:
    return g.nodes.sparkSession.createDataFrame([(i,) for i in sorted(set(ids))], "id string")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def both_ways(edges: DataFrame) -> DataFrame:
    """(at, other, ...) of each edge from either end; a loop once."""
    one = edges.select(F.col("src").alias("at"), F.col("dst").alias("other"), "src", "dst", "type", "props_json")
    return one.unionByName(edges.filter("src <> dst").select(F.col("dst").alias("at"), F.col("src").alias("other"), "src", "dst", "type", "props_json"))


def incident(g: Graph, ids: DataFrame) -> DataFrame:
    """Edges with an end in ids (id), each row of the multigraph once."""
    mark = cut(ids.select("id").distinct())
    size = mark.count()
    e = g.edges.join(few(mark.select(F.col("id").alias("src"), F.lit(1).alias("a")), size), "src", "left").join(few(mark.select(F.col("id").alias("dst"), F.lit(1).alias("b")), size), "dst", "left")
    return e.filter("a = 1 OR b = 1").select("src", "dst", "type", "props_json")


def neighborhood(g: Graph, ids: DataFrame) -> DataFrame:
    """(id, type, label) of known neighbours of ids, without ids."""
    e = incident(g, ids)
    found = cut(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(ids.select("id"), "id", "left_anti"))
    return marked(g.nodes.select("id", "type", "label"), found, found.count(), "id")


def marked(df: DataFrame, ids: DataFrame, size: int, on: str) -> DataFrame:
    """Rows of df whose `on` is one of ids (on), of which there are `size`; a few go to the rows, where these lie."""
    return df.join(F.broadcast(ids), on, "left_semi") if size <= BROADCAST_ROWS else within(df, ids, on)


def unmarked(df: DataFrame, ids: DataFrame, size: int, on: str) -> DataFrame:
    return df.join(F.broadcast(ids), on, "left_anti") if size <= BROADCAST_ROWS else without(df, ids, on)


def context(g: Graph, name: str) -> DataFrame:
    """(role, id, type, label): the node of an id or old name and its neighbours; no rows for an unknown name."""
    seed = cut(_ids(g, [name]).join(g.nodes.select("id"), "id", "left_semi").union(aliases(g.nodes).filter(F.col("alias") == name).select("id")))
    own = g.nodes.join(seed, "id", "left_semi").select(F.lit("node").alias("role"), "id", "type", "label")
    return own.unionByName(neighborhood(g, seed).select(F.lit("neighbor").alias("role"), "id", "type", "label"))


def bfs(g: Graph, seeds: DataFrame, depth: int, direction: str = "both", types: tuple[str, ...] | None = None, known: bool = True) -> DataFrame:
    """(id, hop) of what is reached within depth; direction: out, in or both; known: only nodes of the graph."""
    e = g.edges.filter(F.col("type").isin(*types)) if types else g.edges
    e = both_ways(e) if direction == "both" else e.select(F.col("src" if direction == "out" else "dst").alias("at"), F.col("dst" if direction == "out" else "src").alias("other"))
    e = e.select("at", "other")
    seen = front = cut(seeds.select("id", F.lit(0).alias("hop")).distinct())
    size = total = front.count()
    for hop in range(1, depth + 1):
        # a small frontier goes to the edges, so that they are filtered where they lie
        step = marked(e, front.select(F.col("id").alias("at")), size, "at").select(F.col("other").alias("id")).distinct()
        step = unmarked(step, seen.select("id"), total, "id")
        if known:
            step = cut(step)
            step = marked(g.nodes.select("id"), step, step.count(), "id").distinct()
        front = cut(step.withColumn("hop", F.lit(hop)))
        size = front.count()
        if not size:
            break
        seen, total = seen.unionByName(front), total + size
    return seen


def induced(g: Graph, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ids."""
    keep = cut(ids.select("id").distinct())
    size = keep.count()
    return marked(marked(g.edges, keep.withColumnRenamed("id", "src"), size, "src"), keep.withColumnRenamed("id", "dst"), size, "dst")


def subgraph(g: Graph, node: str, depth: int = 1) -> Graph:
    """The node, what is within depth of it and the edges among these."""
    ids = bfs(g, _ids(g, [node]).join(g.nodes.select("id"), "id", "left_semi"), max(depth, 0))
    return Graph(g.nodes.join(ids.select("id"), "id", "left_semi"), induced(g, ids).select(*g.edges.columns), g.meta)


def symbols_named(g: Graph, name: str) -> DataFrame:
    """(id) of symbols by qualified name, its last part, or as an unresolved name."""
    q = F.col("qualname")
    return g.nodes.filter((F.col("type") == "symbol") & ((q == name) | q.endswith("." + name)) | (F.col("id") == f"symbol:unresolved:{name}")).select("id")


def _seeds(g: Graph, name: str) -> DataFrame:
    own = g.nodes.filter(F.col("id") == name).select("id")
    return own if not own.isEmpty() else symbols_named(g, name)


def callers(g: Graph, name: str, depth: int = 1) -> DataFrame:
    """(id, hop) of callers up to depth calls away; seeds are never callers."""
    return bfs(g, _seeds(g, name), max(depth, 1), "in", ("calls",), known=False).filter("hop > 0")


def call_edges(g: Graph, name: str, depth: int = 1) -> DataFrame:
    """The calls that callers() crosses, each once."""
    reached = bfs(g, _seeds(g, name), max(depth, 1) - 1, "in", ("calls",), known=False)
    return g.edges.filter("type = 'calls'").join(reached.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "type", "props_json")


def references(g: Graph, name: str) -> DataFrame:
    """(id) of nodes that call a match of the name; a match may call another."""
    return g.edges.filter("type = 'calls'").join(symbols_named(g, name).select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()


def _hop(g: Graph, e: DataFrame, front: DataFrame, size: int, seen: DataFrame, total: int) -> tuple[DataFrame, DataFrame, int]:
    """Links (at, other, key) from front (id) to known nodes that weren't seen, of each pair that of the least key; these nodes and their number."""
    step = marked(e, front.select(F.col("id").alias("at")), size, "at").groupBy("at", "other").agg(F.min(edge_key()).alias("key"))
    step = cut(unmarked(step, seen.select(F.col("id").alias("other")), total, "other"))
    new = cut(step.select(F.col("other").alias("id")).distinct())
    known = cut(marked(g.nodes.select("id"), new, new.count(), "id").distinct())
    size = known.count()
    return marked(step, known.select(F.col("id").alias("other")), size, "other"), known, size


def path(g: Graph, start: str, goal: str, order: str = "edges") -> DataFrame:
    """(step, id, edge_type, edge_src, edge_dst) of the shortest undirected path that a queue would find first.

    Neighbours are taken in the order of the edges (order="edges"), of the neighbour's id and edge
    ("federated"), or of the neighbour's id ("ids"). No rows where there is no path.

    Both ends are widened, the one with fewer nodes first, until they meet. A queue's order matters
    only among nodes of shortest paths: all parents that such a node may have are of these too.
    """
    spark = g.nodes.sparkSession
    out = "step int, id string, edge_type string, edge_src string, edge_dst string"
    e = both_ways(g.edges)
    known = {r.id for r in g.nodes.filter(F.col("id").isin(start, goal)).select("id").distinct().collect()}
    if known != {start, goal}:
        return spark.createDataFrame([], out)
    # of each end: nodes of the last layer and their number, all nodes and their number, links by hop
    ends = [{"front": x, "size": 1, "seen": x, "total": 1, "links": []} for x in (cut(_ids(g, [start])), cut(_ids(g, [goal])))]
    while start != goal and ends[0]["front"].join(ends[1]["front"], "id", "left_semi").isEmpty():
        x = min(ends, key=lambda x: x["size"])
        links, x["front"], x["size"] = _hop(g, e, x["front"], x["size"], x["seen"], x["total"])
        if not x["size"]:
            return spark.createDataFrame([], out)
        x["links"].append(links)
        x["seen"], x["total"] = x["seen"].union(x["front"]), x["total"] + x["size"]
    # links of shortest paths, hop by hop from the start: (a, b, key), a before b
    near, far = ([x.select(F.col("at" if i == 0 else "other").alias("a"), F.col("other" if i == 0 else "at").alias("b"), "key") for x in end["links"]] for i, end in enumerate(ends))
    steps, on = [], cut(ends[0]["front"].join(ends[1]["front"], "id", "left_semi"))
    meet = on
    for x in reversed(near):
        steps.insert(0, cut(x.join(on.select(F.col("id").alias("b")), "b", "left_semi")))
        on = steps[0].select(F.col("a").alias("id")).distinct()
    on = meet
    for x in reversed(far):
        steps.append(cut(x.join(on.select(F.col("id").alias("a")), "a", "left_semi")))
        on = steps[-1].select(F.col("b").alias("id")).distinct()
    tie = {"edges": F.struct("key"), "federated": F.struct("b", "key"), "ids": F.struct("b", "key")}[order]
    layer, parents = _ids(g, [start]).withColumn("rank", F.lit(0).cast("bigint")), []
    for x in steps:
        step = x.join(layer.select(F.col("id").alias("a"), "rank"), "a").groupBy(F.col("b").alias("id")).agg(F.min(F.struct("rank", tie.alias("tie"), F.col("a").alias("parent"), "key")).alias("m"))
        # range partitions in order, so ids that grow with partition and row keep the order of m
        layer = cut(step.orderBy("m").select("id", F.monotonically_increasing_id().alias("rank"), F.col("m.parent").alias("parent"), F.col("m.key").alias("key")))
        parents.append(layer)
    way, at = [], goal
    for i in range(len(parents), 0, -1):
        r = parents[i - 1].filter(F.col("id") == at).first()
        way.append((i, at, r.key["type"], r.key["src"], r.key["dst"]))
        at = r.parent
    return spark.createDataFrame([(0, start, None, None, None), *reversed(way)], out)


def impact_seeds(g: Graph, target: str) -> DataFrame:
    """(id) of a node id, else of the nodes of a path."""
    p = F.regexp_replace(F.regexp_replace(F.coalesce("file", F.lit("")), r"\\", "/"), r"^(\./)+", "")
    clean = target.replace("\\", "/")
    while clean.startswith("./"):
        clean = clean[2:]
    own = g.nodes.filter(F.col("id") == target).select("id")
    if not own.isEmpty():
        return own
    return g.nodes.filter((F.col("id") == f"file:{clean}") | (p == clean)).select("id")


def impact(g: Graph, target: str, depth: int = 3) -> DataFrame:
    """(id, hop, surface, direct) of all that depends on the target, which has hop 0 itself."""
    if depth < 0:
        raise ValueError("depth must be 0 or more")
    reached = bfs(g, impact_seeds(g, target), depth, "in", known=False)
    return reached.join(g.nodes.select("id", surface().alias("surface")), "id", "left").select("id", "hop", "surface", (F.col("hop") == 1).alias("direct"))


def impact_edges(g: Graph, target: str, depth: int = 3) -> DataFrame:
    """Edges that impact() crosses, equal ones once."""
    if depth == 0:
        return g.edges.limit(0)
    reached = bfs(g, impact_seeds(g, target), depth - 1, "in", known=False)
    return g.edges.join(reached.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "type", "props_json").distinct()


def risk(reached: DataFrame) -> DataFrame:
    """One row: HIGH, MEDIUM or LOW by the surfaces that are reached, with counts."""
    high, mid = F.col("surface").isin("api_endpoints", "entrypoints", "boundaries"), F.col("surface").isin("cli_commands", "mcp_tools")
    level = F.when(F.coalesce(F.bool_or(high), F.lit(False)), "HIGH").when(F.coalesce(F.bool_or(mid), F.lit(False)), "MEDIUM").otherwise("LOW")
    return reached.agg(level.alias("risk_level"), F.count_if(F.col("hop") == 1).alias("direct"), F.count_if(F.col("hop") > 1).alias("transitive"))


def trace_from(g: Graph, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(bucket, pos, id, hop) of what trace edges reach, also through nodes of no bucket, which are left out."""
    reached = bfs(g, seeds, depth, "both", S.TRACE_EDGES)
    from ..functions.columns import authority_rank, confidence_rank

    n = g.nodes.select("id", trace_bucket().alias("bucket"), authority_rank().alias("a"), confidence_rank().alias("c"))
    by = Window.partitionBy("bucket").orderBy("a", "c", "id")
    return reached.join(n, "id").filter("bucket IS NOT NULL").select("bucket", F.row_number().over(by).alias("pos"), "id", "hop")


def trace_edges(g: Graph, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Trace edges whose both ends are in a bucket and were reached, one of each (src, dst, type)."""
    ids = trace_from(g, seeds, depth)
    return induced(g, ids).filter(F.col("type").isin(*S.TRACE_EDGES)).select("src", "dst", "type").distinct()


def degree(g: Graph) -> DataFrame:
    """(id, in_degree, out_degree, degree): incident edges with repeats, loops at both ends."""
    i = g.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    o = g.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    z = F.lit(0).cast("long")
    return i.join(o, "id", "full_outer").select("id", F.coalesce("in_degree", z).alias("in_degree"), F.coalesce("out_degree", z).alias("out_degree"), (F.coalesce("in_degree", z) + F.coalesce("out_degree", z)).alias("degree"))


def structural(g: Graph, ids: DataFrame | None = None) -> DataFrame:
    """(id, structural) of all nodes, or of ids: incoming edges of each node over the most that a node has."""
    i = cut(g.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")))
    # the most of any node: mostly one of those that have most edges, of which some may be no nodes
    lead = cut(i.orderBy(F.desc("n")).limit(100))
    top = marked(g.nodes.select("id"), lead.select("id"), 100, "id").distinct().join(lead, "id").agg(F.max("n").alias("top")).first().top
    if top is None and i.count() > 100:
        top = within(i, g.nodes.select("id"), "id").agg(F.max("n").alias("top")).first().top
    own = g.nodes.select("id") if ids is None else ids.select("id").distinct()
    return own.join(i.hint("shuffle_hash"), "id", "left").select("id", F.coalesce(F.col("n") / F.lit(top).cast("long"), F.lit(0.0)).alias("structural"))


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")
