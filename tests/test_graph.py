import itertools
import random
from collections import deque

import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom import export, model, schema
from graphloom.functions import columns as C
from graphloom.model import Graph, from_rows
from graphloom.operators import build, communities, federation, retrieve, rules, traverse
from graphloom.sources import strategies
from graphloom.streaming import watch


def graph(spark, edges, nodes=None, kind="file", **props):
    names = nodes or sorted({x for e in edges for x in e[:2]})
    return from_rows(spark, {"nodes": {n: {"type": kind, "label": n, "props": props.get(n, {})} for n in names}, "edges": [{"from": e[0], "to": e[1], "type": e[2] if len(e) > 2 else "calls", "props": {}} for e in edges]})


def test_vocabularies():
    assert (len(schema.NODE_TYPES), len(schema.TRACE_EDGES)) == (46, 18) and len(schema.EDGE_TYPES) in (43, 44)
    assert schema.SYNONYMS["sql"] == ["query", "db", "database", "postgres", "sqlite"]


def test_documents_round_trip(spark, tmp_path):
    doc = {"meta": {"version": 5, "schema_version": 1}, "nodes": {"b": {"type": "file", "label": "B", "props": {"file": "x/b.py", "aliases": ["old"], "odd": {"z": 1}}}, "a": {"type": "doc", "label": "A", "props": {}}}, "edges": [{"from": "a", "to": "b", "type": "documents", "props": {"k": 1}}]}
    g = from_rows(spark, doc)
    assert model.document(g) == doc
    model.save(g, str(tmp_path / "g"))
    assert model.document(model.load(spark, str(tmp_path / "g"))) == doc
    assert model.load(spark, str(tmp_path / "none")).nodes.count() == 0
    assert [r.id for r in model.resolve(g.nodes, "old").collect()] == ["b"]
    for bad in (3, "1", True):
        with pytest.raises(model.SchemaVersionError):
            model.check_layout({"schema_version": bad})


def queue_path(edges, start, goal):
    near = {}
    for a, b, t in sorted(edges):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    came, todo = {start: None}, deque([start])
    while todo:
        x = todo.popleft()
        for y in near.get(x, []):
            if y not in came:
                came[y] = x
                todo.append(y)
    way = []
    while goal in came and goal is not None:
        way.append(goal)
        goal = came[goal]
    return way[::-1]


def test_path_is_the_one_a_queue_finds(spark):
    rnd = random.Random(5)
    for _ in range(3):
        edges = [(f"n{rnd.randrange(9)}", f"n{rnd.randrange(9)}", rnd.choice(["calls", "tests"])) for _ in range(14)]
        g = graph(spark, edges)
        names = sorted({x for e in edges for x in e[:2]})
        got = [r.id for r in traverse.path(g, names[0], names[-1]).orderBy("step").collect()]
        assert got == queue_path(edges, names[0], names[-1])
    assert traverse.path(g, "nowhere", names[0]).count() == 0


def test_callers_and_impact(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "b"), ("x", "c", "tests")])
    assert {(r.id, r.hop) for r in traverse.callers(g, "c", 2).collect()} == {("b", 1), ("a", 2), ("d", 2)}
    assert {(r.id, r.hop) for r in traverse.impact(g, "c", 1).collect()} == {("c", 0), ("b", 1), ("x", 1)}
    with pytest.raises(ValueError):
        traverse.impact(g, "c", -1)


def test_label_propagation_two_clusters():
    rows = []
    for s, t in (("a", "123"), ("b", "123")):
        for x in t:
            rows += [(s, s + x, 4.0), (s + x, s, 4.0)]
        for x, y in itertools.permutations(t, 2):
            rows.append((s + x, s + y, 3.0))
    rows += [("a1", "b1", 0.5), ("b1", "a1", 0.5)]
    label, rounds = communities.sweep(pd.DataFrame(rows, columns=["a", "b", "weight"]))
    assert len(set(label.values())) == 2 and rounds <= communities.SWEEPS
    assert len({label[x] for x in ("a", "a1", "a2", "a3")}) == 1


def test_communities_and_cycles(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("c", "e"), ("f", "g"), ("g", "f")])
    assert {(r.id, r.cycle) for r in communities.cycles(g).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("f", "f"), ("g", "f")}
    got = {r.id: r.community for r in communities.assign(g).collect()}
    assert got["f"] == got["g"] != got["a"] and set(got) == set("abcdefg")


def test_merge_is_the_same_in_any_order(spark):
    claims = [("x", "derived", "z", ["b"]), ("x", "canonical", None, ["a"]), ("x", "derived", "a", None)]
    want = None
    for order in itertools.permutations(claims):
        df = model.fill(spark.createDataFrame([(*c, "{}") for c in order], "id string, authority string, description string, roles array<string>, props_json string"), schema.NODE)
        r = build.merge_claims(df).first()
        got = (r.authority, r.description, r.roles)
        want = want or got
        assert got == want == ("canonical", "a", ["a", "b"])


def test_query_and_fallback(spark):
    g = graph(spark, [("a", "b")], nodes=["auth:login", "db:pool", "web:page"], **{"db:pool": {"constants": ["MAX_SIZE"]}})
    assert [r.id for r in retrieve.query(g, "login").collect()] == ["auth:login"]
    assert [r.id for r in retrieve.query(g, "max_size").collect()] == ["db:pool"]
    rows = retrieve.query(g, "login pool").collect()
    assert {r.id for r in rows} == {"auth:login", "db:pool"} and all(r.degraded for r in rows)
    assert retrieve.query(g, "").count() == 0


def test_rules_diff_and_ids(spark):
    g = graph(spark, [("a", "b")], nodes=["a", "b", "lone"])
    assert [r.node_id for r in rules.lint(g, ["orphan-detection", "nope"])[0].collect()] == ["lone"]
    assert rules.lint(g, ["nope"])[1] == ["unknown rule nope"]
    after = graph(spark, [("a", "c")], nodes=["a", "c", "lone"])
    assert {tuple(r) for r in build.diff(g, after).collect()} == {("added_node", "c"), ("removed_node", "b"), ("added_edge", "a|c|calls"), ("removed_edge", "a|b|calls")}
    ids = spark.createDataFrame([("  Foo  Bar!! ",), ("--",)], "t string").select(C.slug(F.col("t")).alias("s")).collect()
    assert [r.s for r in ids] == ["foo-bar", "unknown"]
    assert spark.createDataFrame([("Src/My File.test.py",)], "p string").select(C.file_id(F.col("p"))).first()[0] == "file:src/my-file.test"


def test_federation_and_exports(spark):
    g = graph(spark, [("a", "b")])
    fed = federation.Federation(model.empty(spark), {"one": g, "two": g})
    assert fed.union().nodes.count() == 4 and fed.union().edges.count() == 2
    assert fed.get("one::a").first().id == "one\x1fa"
    assert "a -->|calls| b" in export.export(g, "mermaid") and '"a" -> "b"' in export.export(g, "dot")
    with pytest.raises(ValueError):
        export.export(g, "png")


PY = '''import os
from pkg.util import helper
from pydantic import BaseModel
LIMIT = 3

class Item(BaseModel):
    """An item."""
    name: str

def main():
    helper(1)
    local()
    mystery()

def local():
    os.getcwd()
'''
PROTO = 'package shop; message Req {} service Cart { rpc Add (Req) returns (stream Req); }'


def test_extractors(spark):
    df = spark.createDataFrame([("app/main.py", PY), ("pkg/util.py", "def helper(x):\n    return x\n"), ("p/cart.proto", PROTO), ("README.md", "# T\n## Install it\nx\n## Other\n"), ("bad.py", "def ("), ("package.json", '{"name": "n", "scripts": {"test": "x"}}')], "path string, text string")
    g = strategies.discover(df, ["python_module", "python_callgraph", "pydantic", "grpc_proto", "markdown", "manifest"])
    ids = {r.id for r in g.nodes.collect()}
    assert {"file:app/main", "symbol:py:app.main:main", "contract:Item", "rpc:grpc:shop.Cart.Add", "doc:README", "doc:README#install-it", "test-target:package.json:test"} <= ids
    e = {(r.src, r.dst, r.type) for r in g.edges.collect()}
    assert ("symbol:py:app.main:main", "symbol:py:pkg.util:helper", "calls") in e
    assert ("symbol:py:app.main:main", "symbol:unresolved:mystery", "calls") in e
    assert ("file:app/main", "file:pkg/util", "depends_on") in e and ("file:app/main", "symbol:py:app.main:main", "contains") in e
    assert all(a in ids and b in ids for a, b, _ in e)


def test_bursts_of_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a"), ("2024-01-01 00:00:01", "b"), ("2024-01-01 00:00:03", "a"), ("2024-01-01 00:00:09", "c"), ("2024-01-01 01:00:00", "z")]
    df = spark.createDataFrame(rows, "t string, path string").selectExpr("cast(t AS timestamp) AS ts", "path")
    want = [(["a", "b"], 3), (["c"], 1), (["z"], 1)]
    assert [(r.paths, r.n) for r in watch.bursts(df).orderBy("start").collect()] == want
    df.write.parquet(str(tmp_path / "in"))
    got = []
    q = watch.watch(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), lambda b, _: got.extend((r.paths, r.n) for r in b.collect()), str(tmp_path / "ck"), once=True)
    q.awaitTermination(60)
    assert sorted(got) == sorted(want[:2])
    assert watch.seconds("500ms") == 0.5
