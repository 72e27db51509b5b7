"""The graph: two DataFrames and a small dictionary of metadata.

Nodes and edges have the promoted columns of schema.NODE and schema.EDGE; everything else of the
property bag is in props_json, with sorted keys. Edges are ordered by (src, dst, type,
props_json), which stands for a place in a list without numbering all of them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema


class SchemaVersionError(ValueError):
    pass


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    meta: dict = field(default_factory=dict)


def fill(df: DataFrame, kind) -> DataFrame:
    """df with all columns of a row type, null where it has none; others are left out."""
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind.fields])


def edge_key() -> Column:
    return F.struct("src", "dst", "type", F.coalesce("props_json", F.lit("{}")).alias("props_json"))


def empty(spark: SparkSession) -> Graph:
    return Graph(spark.createDataFrame([], schema.NODE), spark.createDataFrame([], schema.EDGE))


def check_layout(meta: dict, most: int = schema.MAX_LAYOUT) -> int:
    """Layout version of a document: 1 where it has none; an error where it isn't a whole number or is too new."""
    found = meta.get("schema_version", 1)
    if isinstance(found, bool) or not isinstance(found, int):
        raise SchemaVersionError(f"schema_version {found!r} is no whole number")
    if found > most:
        raise SchemaVersionError(f"schema_version {found} is newer than {most}")
    return found


def from_rows(spark: SparkSession, doc: dict) -> Graph:
    """A graph of a document {meta, nodes: {id: {type, label, props}} or a list, edges: [{from, to, type, props}]}."""
    meta = doc.get("meta") or {}
    check_layout(meta)
    nodes, names = [], {f.name: f.dataType for f in schema.NODE.fields}
    listed = doc.get("nodes") or {}
    for i, n in listed.items() if isinstance(listed, dict) else ((n["id"], n) for n in listed):
        props = n.get("props") or {}
        row = dict.fromkeys(names)
        for k, v in props.items():
            if k in names and k not in ("id", "type", "label", "props_json"):
                ok = isinstance(v, list) if names[k].typeName() == "array" else isinstance(v, bool) if names[k].typeName() == "boolean" else isinstance(v, str)
                row[k] = ([str(x) for x in v] if isinstance(v, list) else v) if ok else None
        nodes.append(row | {"id": i, "type": n.get("type"), "label": n.get("label"), "props_json": json.dumps(props, sort_keys=True, ensure_ascii=False)})
    edges = [{"src": e["from"], "dst": e["to"], "type": e["type"], "props_json": json.dumps(e.get("props") or {}, sort_keys=True, ensure_ascii=False)} for e in doc.get("edges") or []]
    return Graph(spark.createDataFrame([tuple(n[f] for f in names) for n in nodes], schema.NODE), spark.createDataFrame([tuple(e.values()) for e in edges], schema.EDGE), meta)


def load_json(spark: SparkSession, path: str) -> Graph:
    """A graph document; a missing file is an empty graph."""
    try:
        with open(path, encoding="utf-8") as f:
            return from_rows(spark, json.load(f))
    except FileNotFoundError:
        return empty(spark)


def save(graph: Graph, path: str) -> None:
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
    graph.nodes.sparkSession.createDataFrame([(json.dumps(graph.meta, sort_keys=True),)], "meta string").write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Graph:
    try:
        meta = json.loads(spark.read.parquet(f"{path}/meta").first().meta)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return empty(spark)
        raise
    check_layout(meta)
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), meta)


def document(graph: Graph) -> dict:
    """The whole graph as one document, for graphs that fit the driver."""
    nodes = {r.id: {"type": r.type, "label": r.label, "props": json.loads(r.props_json or "{}")} for r in graph.nodes.orderBy("id").collect()}
    edges = [{"from": r.src, "to": r.dst, "type": r.type, "props": json.loads(r.props_json or "{}")} for r in graph.edges.orderBy(edge_key()).collect()]
    return {"meta": graph.meta, "nodes": nodes, "edges": edges}


def canonical_json(graph: Graph) -> str:
    return json.dumps(document(graph), indent=2, ensure_ascii=False, sort_keys=True) + "\n"


def aliases(nodes: DataFrame) -> DataFrame:
    """(alias, id): old names of nodes; a real id is never hidden and the least id wins."""
    old = nodes.select(F.explode("aliases").alias("alias"), "id").filter("alias IS NOT NULL AND alias <> ''")
    return old.join(nodes.select(F.col("id").alias("alias")), "alias", "left_anti").groupBy("alias").agg(F.min("id").alias("id"))


def resolve(nodes: DataFrame, name: str) -> DataFrame:
    """(id) of a node by its id, else by an old name."""
    own = nodes.filter(F.col("id") == name).select("id")
    old = aliases(nodes.filter((F.col("id") == name) | F.array_contains("aliases", name))).filter(F.col("alias") == name).select("id")
    return own.union(old)
