"""Diagrams and payloads of graphs that fit a picture."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import unresolved
from ..model import Graph, edge_key
from ..operators.traverse import degree, induced, subgraph

FIRST = ("repo", "service", "package", "boundary", "entrypoint", "rpc", "channel", "route", "contract")
NODES, EDGES, MOST_NODES, MOST_EDGES = 300, 1500, 2000, 6000


def _safe(text: str) -> str:
    x = re.sub(r"\W", "_", text, flags=re.A)
    return x if x and not x[0].isdigit() else "n_" + x


def _quoted(text: str) -> str:
    return '"' + (text or "").replace("\\", "\\\\").replace('"', '\\"').replace("\n", " ") + '"'


def _rows(g: Graph):
    return g.nodes.orderBy("id").select("id", "type", "label").collect(), g.edges.orderBy(edge_key()).select("src", "dst", "type").collect()


def mermaid(g: Graph) -> str:
    nodes, edges = _rows(g)
    return "\n".join(["graph TD", *[f"    {_safe(n.id)}[{_quoted(n.label or n.id)}]" for n in nodes], *[f"    {_safe(e.src)} -->|{e.type}| {_safe(e.dst)}" for e in edges]]) + "\n"


def dot(g: Graph) -> str:
    nodes, edges = _rows(g)
    return "\n".join(["digraph G {", *[f"  {_quoted(n.id)} [label={_quoted(n.label or n.id)}, type={_quoted(n.type)}];" for n in nodes], *[f"  {_quoted(e.src)} -> {_quoted(e.dst)} [label={_quoted(e.type)}];" for e in edges], "}"]) + "\n"


def d2(g: Graph) -> str:
    nodes, edges = _rows(g)
    return "\n".join([*[f"{_safe(n.id)}: {_quoted(n.label or n.id)}" for n in nodes], *[f"{_safe(e.src)} -> {_safe(e.dst)}: {_quoted(e.type)}" for e in edges]]) + "\n"


_FORMATS = {"mermaid": mermaid, "dot": dot, "d2": d2}


def export(g: Graph, fmt: str, node: str | None = None, depth: int = 1) -> str:
    if fmt not in _FORMATS:
        raise ValueError(f"format must be one of {', '.join(sorted(_FORMATS))}")
    return _FORMATS[fmt](subgraph(g, node, depth) if node else g)


def clamp(limit: int | None, usual: int, most: int) -> int:
    return usual if limit is None or limit < 1 else min(limit, most)


def overview(g: Graph, types: tuple[str, ...] | None = None, hide_unresolved: bool = True, nodes: int | None = None, edges: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counts): what a picture shows first, by type, then degree, then id, and whether anything was left out."""
    n = g.nodes.filter(F.col("type").isin(*types)) if types else g.nodes
    n = n.filter(~unresolved()) if hide_unresolved else n
    first = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in FIRST]), F.col("type")), F.lit(0))
    n = n.join(degree(g).select("id", "degree"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    top = n.orderBy(F.when(first == 0, 99).otherwise(first), F.desc("degree"), "id").limit(clamp(nodes, NODES, MOST_NODES)).select("id", "type", "label", "degree")
    inside = induced(g, top)
    e = inside.select("src", "dst", "type").distinct().orderBy("src", "dst", "type").limit(clamp(edges, EDGES, MOST_EDGES))
    counts = n.agg(F.count("*").alias("total_nodes")).crossJoin(g.edges.agg(F.count("*").alias("total_edges"))).select("total_nodes", "total_edges", (F.col("total_nodes") > clamp(nodes, NODES, MOST_NODES)).alias("truncated_nodes"))
    return top, e, counts


def records(g: Graph, focus: list[str], others: DataFrame) -> DataFrame:
    """(pos, id, type, label): the focus first, then the others (id), each once."""
    f = g.nodes.sparkSession.createDataFrame([(i, x) for i, x in enumerate(focus)], "k int, id string")
    every = f.unionByName(others.select(F.lit(len(focus)).alias("k"), "id")).groupBy("id").agg(F.min("k").alias("k"))
    return g.nodes.join(every, "id").select(F.row_number().over(Window.orderBy("k", "id")).alias("pos"), "id", "type", "label")
