"""Results against plain Python, and plans that don't grow faster than the tables."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.model import Graph, fill
from graphloom.operators import build, communities, rules, traverse
from graphloom.sources import relational

SF = "/root/testdata/sf0.001"


def graph(spark, nodes, edges):
    """nodes: (id, type); edges: (src, dst, type)."""
    n = spark.createDataFrame(nodes, "id string, type string").withColumn("label", F.col("id"))
    return Graph(fill(n, schema.NODE), spark.createDataFrame(edges, "src string, dst string, type string").withColumn("props_json", F.lit("{}")))


def joins(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_ids_are_joined_once_and_not_in_each_branch_of_the_tables(spark):
    g = relational.graph(spark, SF)
    own = joins(g.nodes) + joins(g.edges)
    assert joins(rules.orphans(g)) <= own + 1
    own = 2 * joins(g.nodes) + joins(g.edges)
    assert joins(communities.weighted_pairs(g)) <= own + 2
    assert joins(build.dedup_edges(g)) <= own + 2
    assert joins(communities.valid_edges(g)) <= own + 2


@pytest.mark.parametrize("clash", [False, True])
def test_components_of_numbered_ids(spark, monkeypatch, clash):
    rnd = random.Random(3)
    pairs = [(f"n{rnd.randrange(300):03}", f"n{rnd.randrange(300):03}") for _ in range(180)] + [(f"p{k:03}", f"p{k + 1:03}") for k in range(90)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(pairs, "a string, b string").repartition(7)
    if clash:  # the first numbering gives all ids one number
        real, calls = F.xxhash64, []
        monkeypatch.setattr(F, "xxhash64", lambda *c: real(*c) if calls or calls.append(c) else F.lit(1).cast("bigint"))
    tied, sizes = communities.tied_roots, []
    monkeypatch.setattr(communities, "tied_roots", lambda e: sizes.append(e.count()) or tied(e))
    assert {r.id: r.component for r in communities.components(df).collect()} == {x: find(x) for x in root}
    assert sizes[0] < len(root)  # only roots of partitions are tied to each other


def test_cycles_of_a_random_graph_and_ids_of_one_hash(spark, monkeypatch):
    rnd = random.Random(5)
    edges = sorted({(f"n{rnd.randrange(60):02}", f"n{rnd.randrange(60):02}") for _ in range(75)} | {("u", "v"), ("v", "u"), ("x", "y")})
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for y in out[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen

    far = {x: reach(x) for x in {x for e in edges for x in e}}
    want = {x: min(y for y in far[x] if x in far[y]) for x in far if x in far[x]}
    g = graph(spark, [(x, "symbol") for x in far], [(*e, "calls") for e in edges])
    assert {r.id: r.cycle for r in communities.cycles(g).collect()} == want
    sizes, cut = [], communities.cut
    monkeypatch.setattr(communities, "cut", lambda df: sizes.append(dict(df.dtypes).get("src")) or cut(df))
    communities.cycles(g)
    assert sizes[0] == "bigint"  # numbers are trimmed before texts


@pytest.mark.parametrize("levels", [100, 2])
def test_labels_in_waves_are_those_of_one_task(spark, monkeypatch, levels):
    rnd = random.Random(11)
    parts = [[f"{p}{k:03}" for k in range(n)] for p, n in (("a", 80), ("b", 60), ("c", 30), ("d", 9))]
    edges = [(rnd.choice(p), rnd.choice(p), rnd.choice(["calls", "contains", "relates_to"])) for p in parts for _ in range(3 * len(p))]
    edges += [(rnd.choice(parts[0]), rnd.choice(parts[1]), "relates_to") for _ in range(8)]
    g = graph(spark, [(x, "file") for p in parts for x in [*p, p[0] + ".alone"]], edges)
    want = {(r.id, r.label, r.rounds) for r in communities.labels(g).collect()}
    assert max(r for _, _, r in want) > 2
    waves, real, used = communities.waves, communities.waves.propagate, []
    monkeypatch.setattr(waves, "MOST_LEVELS", levels)
    monkeypatch.setattr(waves, "propagate", lambda df, n: used.append(real(df, n, 60)) or used[-1])
    assert {(r.id, r.label, r.rounds) for r in communities.labels(g, large=20).collect()} == want
    assert (used[0] is None) == (levels == 2)


@pytest.mark.parametrize("order", ["edges", "federated", "ids"])
def test_paths_are_those_of_a_queue(spark, order):
    for seed in range(3):
        rnd = random.Random(seed)
        names = [f"n{k:02}" for k in range(30)]
        edges = [(rnd.choice(names), rnd.choice(names), rnd.choice("xyz")) for _ in range(45)] + [("n01", "gone", "x"), ("gone", "n29", "x")]
        near = defaultdict(list)
        for a, b, t in edges:
            near[a].append((b, (a, b, t)))
            if a != b:
                near[b].append((a, (a, b, t)))
        back, todo = {"n00": None}, deque(["n00"])
        while todo:
            x = todo.popleft()
            for y, key in sorted(near[x], key=lambda z: z[1] if order == "edges" else z):
                if y != "gone" and y not in back:
                    back[y] = (x, key)
                    todo.append(y)
        g = graph(spark, [(x, "file") for x in names], edges)
        goal = next((x for x in reversed(names) if x in back), "n00")
        want, at = [], goal
        while at:
            want.insert(0, (at, *((back[at][1][2], back[at][1][0], back[at][1][1]) if back[at] else (None,) * 3)))
            at = back[at] and back[at][0]
        assert [(r.id, r.edge_type, r.edge_src, r.edge_dst) for r in traverse.path(g, "n00", goal, order).orderBy("step").collect()] == want
    assert traverse.path(g, "n00", "gone").count() == traverse.path(g, "gone", "gone").count() == 0


def test_a_path_is_looked_for_from_the_smaller_end(spark, monkeypatch):
    wide = [("s", f"l{k}", "x") for k in range(300)] + [(f"l{k}", f"m{k}.{i}", "x") for k in range(300) for i in range(5)]
    g = graph(spark, [(x, "file") for x in {x for e in wide for x in e[:2]} | {"a", "b", "goal"}], [*wide, ("s", "a", "x"), ("a", "b", "x"), ("b", "goal", "x")])
    rows, cut = [], traverse.cut
    monkeypatch.setattr(traverse, "cut", lambda df: (lambda out: rows.append(out.count()) or out)(cut(df)))
    assert [r.id for r in traverse.path(g, "s", "goal").orderBy("step").collect()] == ["s", "a", "b", "goal"]
    assert max(rows) <= 301


def test_an_import_is_compared_with_edges_from_its_own_nodes(spark, monkeypatch):
    g = graph(spark, [(f"n{k}", "file") for k in range(9)], [(f"n{k}", f"n{(k + 1) % 9}", "calls") for k in range(9)] + [("n1", "n2", "calls")])
    rows, cut = [], build.cut
    monkeypatch.setattr(build, "cut", lambda df: (lambda out: rows.append(out.count()) or out)(cut(df)))
    e = spark.createDataFrame([("n1", "n2", "calls", "{}"), ("n1", "n3", "calls", "{}"), ("n1", "n3", "calls", "{}")], "src string, dst string, type string, props_json string")
    out = build.upsert(g, g.nodes.filter("id = 'n4'").withColumn("label", F.lit("new")), e)
    assert rows and max(rows) <= 2
    assert out.edges.count() == 11 and out.edges.filter("dst = 'n3' AND src = 'n1'").count() == 1
    assert sorted(r.label for r in out.nodes.collect()) == sorted(["new" if k == 4 else f"n{k}" for k in range(9)])


def test_edges_of_a_diff_are_told_in_one_aggregation(spark):
    g = relational.graph(spark, SF)
    assert joins(build.diff(g, g)) <= 2 * (joins(g.nodes) + joins(g.edges)) + 1


def test_structural_where_more_than_a_hundred_unknown_ends_have_most_edges(spark):
    edges = [(f"s{k}", f"gone{i:03}", "calls") for i in range(105) for k in range(3)] + [("s0", "a", "calls"), ("s1", "a", "calls"), ("s0", "b", "calls")]
    g = graph(spark, [(x, "file") for x in ("a", "b", "c")], edges)
    assert {r.id: r.structural for r in traverse.structural(g).collect()} == {"a": 1.0, "b": 0.5, "c": 0.0}
    assert {r.id: r.structural for r in traverse.structural(g, g.nodes.filter("id = 'b'").select("id")).collect()} == {"b": 0.5}
    assert {r.structural for r in traverse.structural(Graph(g.nodes, g.edges.limit(0))).collect()} == {0.0}
