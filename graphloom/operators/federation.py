"""Several graphs as one: prefixed ids, unions, fan-out queries, cross-repository edges."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..functions import columns as C
from ..model import Graph, fill
from . import retrieve, traverse
from .traverse import first_of

SEP = "\x1f"


def shown(id_):
    """child::id for a prefixed id."""
    return F.regexp_replace(id_, SEP, "::")


def prefixed(g: Graph, child: str) -> Graph:
    p = lambda c: F.concat(F.lit(child + SEP), F.col(c)).alias(c)
    return Graph(g.nodes.select(*[p(c) if c == "id" else F.col(c) for c in g.nodes.columns]), g.edges.select(*[p(c) if c in ("src", "dst") else F.col(c) for c in g.edges.columns]), g.meta)


def merged(parts: list[Graph]) -> Graph:
    """All nodes, of one id the last; all edges, equal ones once."""
    nodes = reduce(DataFrame.unionByName, [fill(p.nodes, S.NODE).withColumn("pos", F.lit(i)) for i, p in enumerate(parts)])
    edges = reduce(DataFrame.unionByName, [fill(p.edges, S.EDGE) for p in parts])
    return Graph(first_of(nodes, ["id"], [F.desc("pos")]).drop("pos"), edges.distinct(), parts[0].meta if parts else {})


def concatenated(root: DataFrame, children: dict[str, DataFrame], limit: int) -> DataFrame:
    """(pos, child, id) of ranked results (rank, id): root first, then children by name, each in its own order, up to limit."""
    parts = [root.select(F.lit(0).alias("c"), F.lit("").alias("child"), "rank", "id")]
    parts += [df.select(F.lit(i).alias("c"), F.lit(name).alias("child"), "rank", F.concat(F.lit(name + SEP), "id").alias("id")) for i, (name, df) in enumerate(sorted(children.items()), 1)]
    both = reduce(DataFrame.unionByName, parts).orderBy("c", "rank").limit(limit)
    return both.withColumn("pos", F.row_number().over(Window.orderBy("c", "rank"))).select("pos", "child", "id")


class Federation:
    """A root graph of repo nodes and cross-repository edges, and its children by name."""

    def __init__(self, root: Graph, children: dict[str, Graph]):
        self.root, self.children = root, children

    def union(self) -> Graph:
        return merged([self.root, *[prefixed(g, n) for n, g in sorted(self.children.items())]])

    def query(self, term: str, limit: int = 20) -> DataFrame:
        q = lambda g: retrieve.query(g, term, limit).select("rank", "id")
        return concatenated(q(self.root), {n: q(g) for n, g in self.children.items()}, limit)

    def get(self, name: str) -> DataFrame:
        """The node of a prefixed id, in either way of writing it."""
        name = name.replace("::", SEP, 1) if SEP not in name else name
        return self.union().nodes.filter(F.col("id") == name)

    def context(self, name: str) -> DataFrame:
        return traverse.context(self.union(), name.replace("::", SEP, 1) if SEP not in name else name)

    def path(self, start: str, goal: str) -> DataFrame:
        fix = lambda x: x.replace("::", SEP, 1) if SEP not in x else x
        return traverse.path(self.union(), fix(start), fix(goal), "federated")

    def callers(self, name: str, depth: int = 1) -> DataFrame:
        parts = [traverse.callers(g, name, depth).select(F.lit(n).alias("child"), F.concat(F.lit(n + SEP), "id").alias("id"), "hop") for n, g in sorted(self.children.items())]
        return reduce(DataFrame.unionByName, parts)

    def references(self, name: str) -> DataFrame:
        parts = [traverse.references(g, name).select(F.lit(n).alias("child"), F.concat(F.lit(n + SEP), "id").alias("id")) for n, g in sorted(self.children.items())]
        return reduce(DataFrame.unionByName, parts)


def root_nodes(ledger: DataFrame) -> DataFrame:
    """A repo node for each present child of a ledger (child, status, path, tags)."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    bag = F.to_json(F.struct(F.size(parts).alias("depth"), F.col("path"), parts.alias("path_segments"), F.col("tags")))
    return fill(ledger.filter("status = 'present'").select(F.concat(F.lit("repo:"), "child").alias("id"), F.lit("repo").alias("type"), F.col("child").alias("label"), bag.alias("props_json")), S.NODE)


def _child(c: str):
    return F.substring_index(c, SEP, 1)


def grpc_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """cross_repo:grpc_calls from callers of rpc:grpc:<service>.<method> in one child to the method's definition in another; nodes and edges have a column child."""
    use = edges.filter((F.col("type") == "invokes") & F.col("dst").startswith("rpc:grpc:")).select(F.col("child").alias("from_child"), "src", F.regexp_extract("dst", r"^rpc:grpc:(.*)\.[^.]*$", 1).alias("s"), F.regexp_extract("dst", r"\.([^.]*)$", 1).alias("method"))
    use = use.withColumn("service", C.slug(F.regexp_extract("s", r"([^.]+)$", 1))).filter("s <> '' AND method <> ''")
    own = nodes.filter((F.col("type") == "rpc") & (F.col("protocol") == "grpc") & (F.coalesce("boundary_kind", F.lit("inbound")) != "outbound")).select(F.col("child").alias("to_child"), F.col("id").alias("def"), F.regexp_extract("id", r"([^.:]+)\.[^.]*$", 1).alias("d"), F.regexp_extract("id", r"\.([^.]*)$", 1).alias("method")).withColumn("service", C.slug("d"))
    j = use.join(own, ["service", "method"]).filter("from_child <> to_child")
    return j.select(F.concat_ws(SEP, "from_child", "src").alias("src"), F.concat_ws(SEP, "to_child", "def").alias("dst"), F.lit("cross_repo:grpc_calls").alias("type"), F.to_json(F.struct("method", "service")).alias("props_json")).distinct()


def http_edges(nodes: DataFrame) -> DataFrame:
    """cross_repo:calls from outbound http nodes with a full URL to the endpoint `METHOD /path` of the child of that host; nodes: (child, id, type, label, protocol, boundary_kind)."""
    n = nodes.filter("protocol = 'http'")
    call = n.filter("boundary_kind = 'outbound'").select(F.col("child").alias("from_child"), F.col("id").alias("caller"), F.upper(F.regexp_extract("label", r"^(\w+)\s", 1)).alias("method"), F.lower(F.regexp_extract("label", r"https?://([^/:?#\s]+)", 1)).alias("host"), F.regexp_extract("label", r"https?://[^/?#\s]+(/[^?#\s]*)?", 1).alias("p"))
    call = call.withColumn("p", F.when(F.col("p") == "", "/").otherwise(F.col("p"))).filter("host <> ''")
    own = n.filter("coalesce(boundary_kind, 'inbound') = 'inbound'").select(F.col("child").alias("to_child"), F.col("id").alias("end"), "label")
    j = call.join(own, (F.lower("to_child") == F.col("host")) & (F.col("label") == F.concat_ws(" ", "method", "p")) & (F.col("from_child") != F.col("to_child")))
    last = j.groupBy("from_child", "caller", "to_child", "method", "p").agg(F.max("end").alias("end"))
    return last.select(F.concat_ws(SEP, "from_child", "caller").alias("src"), F.concat_ws(SEP, "to_child", "end").alias("dst"), F.lit("cross_repo:calls").alias("type"), F.to_json(F.struct(F.col("method"), F.col("p").alias("path"))).alias("props_json"))


def compose_edges(services: DataFrame, children: DataFrame) -> DataFrame:
    """cross_repo:depends_on between repo nodes: services (child, service, image, depends_on) led to children (child) by image name, else by service name."""
    image = F.regexp_extract(F.coalesce("image", F.lit("")), r"([^/:@]+)(?:[:@][^/]*)?$", 1)
    s = services.select(F.col("child").alias("at"), "service", image.alias("img"), "depends_on")
    own = s.join(children.select(F.col("child").alias("c")), (F.col("c") == F.col("img")) | (F.col("c") == F.col("service"))).groupBy("at", "service").agg(F.min_by("c", F.when(F.col("c") == F.col("img"), 0).otherwise(1)).alias("repo"))
    need = s.select("at", "service", F.explode("depends_on").alias("other"))
    j = need.join(own, ["at", "service"]).join(own.select("at", F.col("service").alias("other"), F.col("repo").alias("to")), ["at", "other"]).filter("repo <> to")
    return j.select(F.concat(F.lit("repo:"), "repo").alias("src"), F.concat(F.lit("repo:"), "to").alias("dst"), F.lit("cross_repo:depends_on").alias("type"), F.lit("{}").alias("props_json")).distinct()


def import_edges(nodes: DataFrame) -> DataFrame:
    """depends_on from nodes that import a package that another child defines; nodes: (child, id, type, label, imports_from)."""
    use = nodes.filter("size(imports_from) > 0").select(F.col("child").alias("a"), "id", F.explode(F.array_distinct("imports_from")).alias("name"))
    own = nodes.filter("type = 'package'").select(F.col("child").alias("b"), F.col("id").alias("to"), F.col("label").alias("package"))
    j = use.join(own, F.substring_index(F.col("name"), ".", 1) == F.col("package")).filter("a <> b")
    return j.select(F.concat_ws(SEP, "a", "id").alias("src"), F.concat_ws(SEP, "b", "to").alias("dst"), F.lit("depends_on").alias("type"), F.to_json(F.struct(F.col("name").alias("import_name"))).alias("props_json")).distinct()


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(child, change) of two ledgers (child, graph_sha256, head_sha): added, removed, changed or stable."""
    same = F.col("b.graph_sha256").eqNullSafe(F.col("a.graph_sha256")) & F.col("b.head_sha").eqNullSafe(F.col("a.head_sha"))
    j = after.alias("a").join(before.alias("b"), F.col("a.child") == F.col("b.child"), "full_outer")
    return j.select(F.coalesce("a.child", "b.child").alias("child"), F.when(F.col("b.child").isNull(), "added").when(F.col("a.child").isNull(), "removed").when(same, "stable").otherwise("changed").alias("change"))


def incremental_edges(old: DataFrame, new: DataFrame, changes: DataFrame) -> DataFrame:
    """Old cross edges between stable children, and new ones that touch another child."""
    stable = changes.filter("change = 'stable'").select("child")
    a, b = stable.withColumnRenamed("child", "a"), stable.withColumnRenamed("child", "b")
    keep = old.join(a, _child("src") == F.col("a"), "left_semi").join(b, _child("dst") == F.col("b"), "left_semi")
    both = new.join(a, _child("src") == F.col("a"), "left_semi").join(b, _child("dst") == F.col("b"), "left_semi")
    fresh = new.exceptAll(both)
    gone = changes.filter("change = 'removed'").select(F.col("child").alias("g"))
    fresh = fresh.join(gone, (_child("src") == F.col("g")) | (_child("dst") == F.col("g")), "left_anti")
    return keep.unionByName(fresh).distinct()


_resolvers: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def resolver(name: str):
    """Registers a function of (nodes, edges), both with a column child, that returns cross-repository edges."""
    def add(f):
        _resolvers[name] = f
        return f

    return add


resolver("grpc_service_binding")(grpc_edges)
resolver("service_graph")(lambda nodes, edges: http_edges(nodes))
resolver("package_imports")(lambda nodes, edges: import_edges(nodes))


def resolve(nodes: DataFrame, edges: DataFrame, names: list[str] | None = None, drifted: DataFrame | None = None) -> tuple[DataFrame, dict[str, str]]:
    """(cross edges, errors by resolver): those named, in order; one that fails doesn't stop the others; edges of drifted children (child) are left out."""
    parts, errors = [], {}
    for n in names or sorted(_resolvers):
        try:
            parts.append(_resolvers[n](nodes, edges).select("src", "dst", "type", "props_json"))
        except Exception as e:
            errors[n] = str(e)
    out = reduce(DataFrame.unionByName, parts).distinct() if parts else edges.select("src", "dst", "type", "props_json").limit(0)
    if drifted is not None:
        out = out.join(drifted.select(F.col("child").alias("g")), (_child("src") == F.col("g")) | (_child("dst") == F.col("g")), "left_anti")
    return out, errors


def refuse_empty(before: int, after: int, allow: bool = False) -> None:
    """A graph that had nodes isn't overwritten by one without."""
    if before > 0 and after == 0 and not allow:
        raise ValueError("the new graph has no nodes; it would replace one that has")


def workspace_state(probes: DataFrame) -> DataFrame:
    """A ledger (child, status, head_sha, graph_sha256, is_dirty) of probes (child, exists, has_graph, readable, head_sha, graph_sha256, is_dirty)."""
    status = F.when(~F.col("exists"), "missing").when(~F.col("has_graph"), "uninitialized").when(~F.col("readable"), "corrupt").otherwise("present")
    return probes.select("child", status.alias("status"), "head_sha", "graph_sha256", "is_dirty")
