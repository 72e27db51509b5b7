"""Building a graph: merging claims, dedup, closure, overlays, incremental updates, diff."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema as S
from ..functions import columns as C
from ..model import Graph, fill
from ..store import cut, within
from .traverse import first_of, marked, unmarked


def _rank_of(c: str, ranks: dict[str, int], other: int):
    return F.coalesce(F.create_map(*[F.lit(x) for p in ranks.items() for x in p])[F.col(c)], F.lit(other))


def merge_claims(claims: DataFrame) -> DataFrame:
    """One node of all claims on an id (columns of schema.NODE), in any order.

    Of a scalar the claim of the highest authority that has it wins, then the least text; lists
    are sorted unions; authority is the highest; the cold bag is merged key by key likewise.
    """
    r = claims.withColumn("__r", _rank_of("authority", S.MERGE_RANK, -1))
    scalars = [f.name for f in S.NODE.fields if f.dataType.typeName() == "string" and f.name not in ("id", "authority", "props_json")]
    pick = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(-F.col("__r"), F.col(c).cast("string")))).alias(c)
    lists = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("exports", "constants", "aliases", "roles", "imports_from")]
    bags = F.collect_list(F.struct(F.col("__r").alias("rank"), F.coalesce("props_json", F.lit("{}")).alias("bag"))).alias("__bags")
    out = r.groupBy("id").agg(*[pick(c) for c in [*scalars, "resolved"]], F.max_by("authority", F.struct("__r", "authority")).alias("authority"), *lists, bags)
    has = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    out = out.withColumn("props_json", F.pandas_udf(_merge_bags, "string")("__bags")).drop("__bags")
    names = ("exports", "constants", "aliases", "roles", "imports_from")
    return fill(out.select(*[has(c) if c in names else F.col(c) for c in out.columns]), S.NODE)


def _merge_values(found: list[tuple[int, object]]):
    if all(isinstance(v, dict) for _, v in found):
        keys = sorted({k for _, v in found for k in v})
        return {k: _merge_values([(r, v[k]) for r, v in found if k in v]) for k in keys}
    if all(isinstance(v, list) for _, v in found):
        seen = {json.dumps(x, sort_keys=True): x for _, v in found for x in v}
        return [seen[k] for k in sorted(seen)]
    return min(found, key=lambda x: (-x[0], type(x[1]).__name__, str(x[1])))[1]


def _merge_bags(bags: pd.Series) -> pd.Series:
    return bags.map(lambda own: json.dumps(_merge_values([(int(x["rank"]), json.loads(x["bag"])) for x in own]), sort_keys=True, ensure_ascii=False))


def overlay(old: dict, new: dict) -> dict:
    """Deep merge of bags: the new one wins, dictionaries key by key."""
    return old | {k: overlay(old[k], v) if isinstance(v, dict) and isinstance(old.get(k), dict) else v for k, v in new.items()}


def overlay_nodes(nodes: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, props_json): incoming (id, props_json) laid over the bags of nodes."""
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(overlay(json.loads(x or "{}"), json.loads(y or "{}")), sort_keys=True, ensure_ascii=False) for x, y in zip(a, b)])

    both = nodes.select("id", F.col("props_json").alias("old")).join(incoming.select("id", F.col("props_json").alias("new")), "id", "full_outer")
    return both.select("id", F.pandas_udf(run, "string")("old", "new").alias("props_json"))


def last_wins(claims: DataFrame) -> DataFrame:
    """Of claims with source_pos the one of the last source for each id."""
    return first_of(claims, ["id"], [F.desc("source_pos")]).drop("source_pos")


def upsert(g: Graph, nodes: DataFrame, edges: DataFrame) -> Graph:
    """Incoming nodes replace those of the same id; incoming edges that are there already, bag and all, are left out."""
    new = fill(nodes, S.NODE)
    ids = cut(new.select("id").distinct())
    keep = unmarked(g.nodes, ids, ids.count(), "id").select(*new.columns)
    e = cut(fill(edges, S.EDGE).dropDuplicates())
    ends = cut(e.select("src").distinct())
    own = g.edges.select(*e.columns)
    # only edges from the same nodes are compared
    there = cut(marked(own, ends, ends.count(), "src").dropDuplicates())
    fresh = e.join(there, [e[c].eqNullSafe(there[c]) for c in e.columns], "left_anti")
    return Graph(keep.unionByName(new), own.unionByName(fresh), g.meta)


def remove_nodes(g: Graph, ids: DataFrame) -> Graph:
    """g without nodes of ids (id) and the edges that touch them."""
    gone = ids.select("id").distinct()
    e = g.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return Graph(g.nodes.join(gone, "id", "left_anti"), e.select(*g.edges.columns), g.meta)


def remove_edges(g: Graph, src: str, dst: str, kind: str | None = None) -> Graph:
    hit = (F.col("src") == src) & (F.col("dst") == dst)
    return Graph(g.nodes, g.edges.filter(~(hit & (F.col("type") == kind) if kind else hit)), g.meta)


def dedup_edges(g: Graph) -> DataFrame:
    """Edges between nodes, of each (src, dst, type) the one of the first bag."""
    ids = g.nodes.select("id")
    e = within(within(g.edges, ids.withColumnRenamed("id", "src"), "src"), ids.withColumnRenamed("id", "dst"), "dst")
    return e.groupBy("src", "dst", "type").agg(F.min("props_json").alias("props_json"))


def purge(g: Graph, files: DataFrame, declared: bool = True) -> Graph:
    """g without nodes of files (file); declared: also those that only say where they are declared."""
    at = F.coalesce("file", F.get_json_object("props_json", "$.declared_in")) if declared else F.col("file")
    gone = cut(g.nodes.select("id", at.alias("file")).join(files.select("file").distinct(), "file", "left_semi").select("id").distinct())
    if declared:
        outside = (F.col("type") == "package") & (F.get_json_object("props_json", "$.external") == "true")
        packages = cut(g.nodes.filter(outside).select("id").join(gone, "id", "left_anti"))
        if not packages.isEmpty():
            ends = g.edges.select(F.col("dst").alias("id"), F.col("src").alias("other")).union(g.edges.select("src", "dst"))
            used = ends.join(packages, "id", "left_semi").join(gone.withColumnRenamed("id", "other"), "other", "left_anti").select("id")
            gone = cut(gone.union(packages.join(used, "id", "left_anti")))
    return remove_nodes(g, gone)


def incremental(g: Graph, dirty: DataFrame, nodes: DataFrame, edges: DataFrame) -> Graph:
    """g after files (file) were read again with these nodes and edges; new edges come before old of the same (src, dst, type)."""
    kept = purge(g, dirty)
    new = fill(nodes, S.NODE)
    own = Graph(kept.nodes.join(new.select("id"), "id", "left_anti").select(*new.columns).unionByName(new), kept.edges, g.meta)
    e = fill(edges, S.EDGE).withColumn("age", F.lit(0)).unionByName(kept.edges.withColumn("age", F.lit(1)))
    ids = own.nodes.select("id")
    e = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Graph(own.nodes, first_of(e, ["src", "dst", "type"], [F.col("age"), F.col("props_json")]).drop("age"), g.meta)


def without_output(sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file): all files of sources (source, file) of which no file has a node."""
    seen = sources.join(nodes.select("file", F.lit(True).alias("has")).distinct(), "file", "left")
    none = seen.groupBy("source").agg(F.bool_or(F.coalesce("has", F.lit(False))).alias("any")).filter("NOT any")
    return sources.join(none, "source", "left_semi").select("file").distinct()


def resolve_foreign_keys(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """Edges to `__table__:t` led to the entity of the table (table, id); others of that form are left out."""
    t = F.regexp_extract("dst", "^__table__:(.*)$", 1)
    open_ = F.col("dst").startswith("__table__:")
    done = edges.filter(open_).withColumn("table", t).join(tables.select("table", "id"), "table").withColumn("dst", F.col("id")).select(*edges.columns)
    return edges.filter(~open_).unionByName(done)


def mentions(commands: DataFrame, agents: DataFrame) -> DataFrame:
    """invokes edges from commands (id, text) to agents (id, name) that the text names, in any case.

    A name is looked for in texts that have its longest inner word, one with a blank on either side within
    the name; one without such a word is looked for in texts that have its first three characters.
    """
    c, a = commands.select(F.col("id").alias("src"), F.lower("text").alias("t")), agents.select(F.col("id").alias("dst"), F.lower("name").alias("n")).filter("n <> ''")
    words = F.split("n", " ")
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w != "")
    a = a.withColumn("word", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w), w.alias("w"))))["w"])
    by_word = c.select("src", "t", F.explode(F.array_distinct(F.split("t", " "))).alias("word")).join(a.filter("word IS NOT NULL"), "word")
    out = by_word.filter(F.col("t").contains(F.col("n"))).select("src", "dst")
    rest = cut(a.filter("word IS NULL").select("dst", "n", F.substring("n", 1, 3).alias("head")))
    if not rest.isEmpty():
        sizes = [r[0] for r in rest.select(F.length("head")).distinct().collect()]  # 1 to 3
        at = lambda k: lambda i: F.substr(F.col("t"), i, F.lit(k))
        heads = [F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - (k - 1), F.lit(1))), at(k)) for k in sizes]
        by_head = c.filter("t <> ''").select("src", "t", F.explode(F.array_distinct(F.flatten(F.array(*heads)))).alias("head")).join(rest, "head")
        out = out.union(by_head.filter(F.col("t").contains(F.col("n"))).select("src", "dst"))
    return out.select("src", "dst", F.lit("invokes").alias("type"), F.lit("{}").alias("props_json"))


def topology(g: Graph, nodes: DataFrame, edges: DataFrame, packages: DataFrame | None = None) -> Graph:
    """Static nodes that aren't there, static edges, and contains edges from packages (package, entity)."""
    new = fill(nodes, S.NODE).join(g.nodes.select("id"), "id", "left_anti").select(*S.NODE.fieldNames())
    e = g.edges.unionByName(fill(edges, S.EDGE))
    if packages is not None:
        e = e.unionByName(packages.select(F.col("package").alias("src"), F.col("entity").alias("dst"), F.lit("contains").alias("type"), F.lit("{}").alias("props_json")))
    return Graph(g.nodes.unionByName(new), e, g.meta)


_CLOSED = ("symbol", "rpc", "channel", "ros_action", "ros_interface", "ros_node", "ros_package", "ros_parameter", "ros_service", "ros_topic")
_BY = "closure"


def _anchor(path):
    return F.concat(F.lit("file:"), F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", ""))


def anchors(g: Graph) -> DataFrame:
    """(file, id): the file node of each path, least id first; paths of contained nodes that have none get a new id, with a suffix from 3 up where it is taken."""
    own = g.nodes.filter("type = 'file' AND file <> ''").groupBy("file").agg(F.min("id").alias("id"))
    need = g.nodes.filter((F.col("type").isin(*_CLOSED) | (F.size("imports_from") > 0)) & (F.col("file") != "") & ~F.col("id").startswith("symbol:unresolved:")).select("file").distinct().join(own, "file", "left_anti")
    new = need.withColumn("base", _anchor(F.col("file")))
    taken = g.nodes.select("id", F.regexp_extract("id", r"^(file:.*?)(?::(\d+))?$", 1).alias("base")).filter("base <> ''")
    used = taken.groupBy("base").agg(F.collect_set("id").alias("ids"))
    place = F.row_number().over(Window.partitionBy("base").orderBy("file"))
    new = new.withColumn("k", place).join(used, "base", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    tries = F.concat(F.array("base"), F.transform(F.sequence(F.lit(3), F.size("ids") + F.col("k") + 3), lambda i: F.concat_ws(":", F.col("base"), i.cast("string"))))
    free = F.filter(tries, lambda x: ~F.array_contains("ids", x))
    return own.unionByName(new.select("file", F.element_at(free, F.col("k")).alias("id")))


def close(g: Graph) -> Graph:
    """File anchors over contained nodes, imports as depends_on edges, marks on calls."""
    at = cut(anchors(g))
    new = at.join(g.nodes.select("id"), "id", "left_anti").select("id", F.lit("file").alias("type"), F.col("file").alias("label"), "file", F.lit(_BY).alias("source_strategy"), F.lit("{}").alias("props_json"))
    nodes = g.nodes.unionByName(fill(new, S.NODE))
    bag = lambda **x: F.to_json(F.struct(*[v.alias(k) for k, v in sorted(x.items())]))
    inside = g.nodes.filter(F.col("type").isin(*_CLOSED) & ~F.col("id").startswith("symbol:unresolved:")).select(F.col("id").alias("dst"), "file").join(at, "file").filter("id <> dst")
    inside = inside.select(F.col("id").alias("src"), "dst", F.lit("contains").alias("type"), bag(source_strategy=F.lit(_BY), confidence=F.lit("definite")).alias("props_json"))
    path = F.regexp_replace("file", r"(?<=[^/])\.[^./]+$", "")
    named = at.withColumn("path", path).select("id", F.explode(F.array_distinct(F.flatten(F.array(F.transform(F.array(F.col("path"), F.regexp_replace("path", "/(__init__|index)$", "")), lambda p: F.array(p, F.translate(p, "/", "."))))[0]))).alias("name"))
    given = g.nodes.filter("module <> ''").select("id", F.col("module").alias("name"))
    index = named.withColumn("p", F.lit(0)).unionByName(given.withColumn("p", F.lit(1))).groupBy("name").agg(F.min(F.struct("p", "id")).alias("m")).select("name", F.col("m.id").alias("id"))
    imp = g.nodes.filter(F.size("imports_from") > 0).withColumn("language", C.language()).select("id", "type", "file", "language", F.explode(F.array_distinct("imports_from")).alias("raw")).filter("trim(raw) <> ''")
    imp = imp.join(at.select("file", F.col("id").alias("anchor")), "file", "left").withColumn("src", F.when(F.col("type") == "file", F.col("id")).otherwise(F.coalesce("anchor", "id")))
    imp = imp.withColumn("name", F.regexp_replace(F.trim("raw"), "^[\"'`<>]+|[\"'`<>]+$", "")).filter("name <> ''")
    folder = F.regexp_replace(F.coalesce("file", F.lit("")), "[^/]*$", "")
    joined = F.split(F.concat(folder, "name"), "/")
    clean = F.array_join(F.aggregate(joined, F.array().cast("array<string>"), lambda a, x: F.when((x == ".") | (x == ""), a).when((x == "..") & (F.size(a) > 0), F.slice(a, 1, F.size(a) - 1)).when(x == "..", a).otherwise(F.concat(a, F.array(x)))), "/")
    local = F.col("name").startswith(".") | F.col("name").contains("/")
    ends = ["", *[f".{x}" for x in S.LANGUAGE_OF_SUFFIX], "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/__init__.py"]
    tries = imp.withColumn("base", clean).select("src", "raw", "name", "language", F.posexplode(F.when(local, F.array(*[F.concat("base", F.lit(x)) for x in ends])).otherwise(F.array().cast("array<string>"))).alias("p", "file"))
    by_path = tries.join(at.select("file", F.col("id").alias("dst")), "file").groupBy("src", "raw").agg(F.min_by("dst", "p").alias("path_dst"))
    module = imp.select("src", "raw", F.posexplode(F.array(F.col("name"), F.translate("name", "/", "."))).alias("p", "key")).join(index.withColumnRenamed("id", "dst"), F.col("key") == F.col("name")).groupBy("src", "raw").agg(F.min_by("dst", "p").alias("module_dst"))
    found = imp.select("src", "raw", "name", "language").distinct().join(by_path, ["src", "raw"], "left").join(module, ["src", "raw"], "left")
    outside = F.concat_ws(":", F.lit("package"), "language", F.when(F.col("language") == "java", F.regexp_replace("name", r"\.(\*|[^.]+)$", "")).otherwise(F.col("name")))
    found = cut(found.withColumn("dst", F.coalesce("path_dst", "module_dst", outside)).withColumn("how", F.when(F.col("path_dst").isNotNull(), "local_path").when(F.col("module_dst").isNotNull(), "local_module").otherwise("external")).filter("dst <> src"))
    links = found.select("src", "dst", F.lit("depends_on").alias("type"), bag(source_strategy=F.lit(_BY), confidence=F.when(F.col("how") == "external", "inferred").otherwise("definite"), import_name=F.col("raw"), normalized_import=F.col("name"), language=F.col("language"), resolution=F.col("how")).alias("props_json"))
    packages = found.filter("how = 'external'").select(F.col("dst").alias("id"), F.lit("package").alias("type"), F.regexp_extract("dst", "^package:[^:]*:(.*)$", 1).alias("label"), "language", F.lit(_BY).alias("source_strategy"), F.lit('{"external": true}').alias("props_json")).dropDuplicates(["id"]).join(g.nodes.select("id"), "id", "left_anti")
    return Graph(nodes.unionByName(fill(packages, S.NODE)), decorate_calls(Graph(nodes, g.edges)).unionByName(inside).unionByName(links), g.meta)


def decorate_calls(g: Graph) -> DataFrame:
    """Edges, where calls say whether and how they are resolved, what name they use and where they stand, unless they said so."""
    calls = g.edges.filter("type = 'calls'").join(g.nodes.select(F.col("id").alias("src"), F.col("file").alias("sf")), "src", "left").join(g.nodes.select(F.col("id").alias("dst"), F.col("label").alias("dl"), C.unresolved().alias("open")), "dst", "left")

    def run(bag: pd.Series, file: pd.Series, label: pd.Series, open_: pd.Series, dst: pd.Series) -> pd.Series:
        out = []
        for b, f, n, o, d in zip(bag, file, label, open_, dst):
            b = json.loads(b or "{}")
            done = not (o is None or o != o or bool(o) or d.startswith("symbol:unresolved:"))
            b.setdefault("resolved", done)
            b.setdefault("resolution", "resolved" if b["resolved"] else "unresolved")
            b.setdefault("raw", n or d.rsplit(":", 1)[-1])
            if f:
                b.setdefault("provenance", {"file": f})
            out.append(json.dumps(b, sort_keys=True, ensure_ascii=False))
        return pd.Series(out)

    marked = calls.withColumn("props_json", F.pandas_udf(run, "string")("props_json", "sf", "dl", "open", "dst"))
    return g.edges.filter("type <> 'calls'").unionByName(marked.select(*g.edges.columns))


def overrides(edges: DataFrame, given: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """edges after manual overrides (src, dst, type, action, props_json): removals by (src, dst, type), then additions. With known (child), those of other children are skipped."""
    if known is not None:
        child = lambda c: F.substring_index(c, "\x1f", 1)
        given = given.join(known.select(F.col("child").alias("__a")), child("src") == F.col("__a"), "left_semi").join(known.select(F.col("child").alias("__b")), child("dst") == F.col("__b"), "left_semi")
    kept = edges.join(given.filter("action = 'remove'").select("src", "dst", "type"), ["src", "dst", "type"], "left_anti").select(*edges.columns)
    bag = F.to_json(F.map_concat(F.coalesce(F.from_json("props_json", "map<string,string>"), F.create_map().cast("map<string,string>")), F.create_map(F.lit("source"), F.lit("manual_override"))))
    return kept.unionByName(given.filter("action = 'add'").select("src", "dst", "type", bag.alias("props_json")))


def diff(before: Graph | None, after: Graph | None) -> DataFrame:
    """(kind, id): added, removed and modified nodes, added and removed edges (src|dst|type; a change of its bag alone is none)."""
    spark = (before or after).nodes.sparkSession
    if after is None:
        return spark.createDataFrame([], "kind string, id string")
    names = [f.name for f in S.NODE.fields if f.name != "id"]
    b = after.nodes.select("id", F.struct(*names).alias("b"), F.lit(1).alias("nb"))
    a = before.nodes.select("id", F.struct(*names).alias("a"), F.lit(1).alias("na")) if before else b.select("id", F.col("b").alias("a"), F.col("nb").alias("na")).limit(0)
    n = a.join(b, "id", "full_outer").select("id", F.when(F.col("na").isNull(), "added_node").when(F.col("nb").isNull(), "removed_node").when(~F.col("a").eqNullSafe(F.col("b")), "modified_node").alias("kind"))
    key = F.concat_ws("|", "src", "dst", "type").alias("id")
    sides = [x.edges.select(key, F.lit(a).alias("a"), F.lit(b).alias("b")) for x, a, b in ((before, True, False), (after, False, True)) if x]
    e = reduce(DataFrame.union, sides).groupBy("id").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b")).select("id", F.when(~F.col("a"), "added_edge").when(~F.col("b"), "removed_edge").alias("kind"))
    return n.unionByName(e).filter("kind IS NOT NULL").select("kind", "id")


def diff_text(d: DataFrame, most: int = 50) -> str:
    """A report of a diff: counts, and the first ids of each kind."""
    by = {r.kind: r.n for r in d.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    first = d.withColumn("k", F.row_number().over(Window.partitionBy("kind").orderBy("id"))).filter(F.col("k") <= most).orderBy("kind", "k").collect()
    lines = [f"{kind}: {n}" for kind, n in sorted(by.items())]
    return "\n".join(lines + [f"  {r.kind} {r.id}" for r in first]) or "no changes"


def file_changes(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """(*keys, change) of two states (*keys, sha): added, removed or modified; a file that a state tells several times is there once, with the set of its hashes."""
    state = lambda df, name: df.groupBy(*keys).agg(F.array_sort(F.collect_set("sha")).alias(name))
    j = state(before, "a").join(state(after, "b"), list(keys), "full_outer")
    return j.select(*keys, F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified").alias("change")).filter("change IS NOT NULL")


def post_process(g: Graph, tables: DataFrame | None = None, commands: DataFrame | None = None, agents: DataFrame | None = None) -> Graph:
    """Foreign keys, mentions of agents, closure, then edges without dangling and repeated ones."""
    e = resolve_foreign_keys(g.edges, tables) if tables is not None else g.edges
    if commands is not None and agents is not None:
        e = e.unionByName(mentions(commands, agents))
    done = close(Graph(g.nodes, e, g.meta))
    return Graph(done.nodes, dedup_edges(done), g.meta)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


