"""Operators on small graphs with known answers."""

import sys

import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.model import Graph, fill
from graphloom.operators import agents, build, communities, traverse
from graphloom.sources import relational
from graphloom.store import numbered

SF = "/root/testdata/sf0.001"


def graph(spark, nodes, edges):
    """nodes: (id, type[, props_json]); edges: (src, dst, type)."""
    n = spark.createDataFrame([(*x, *[None] * (3 - len(x))) for x in nodes], "id string, type string, props_json string").withColumn("label", F.col("id"))
    e = spark.createDataFrame(edges, "src string, dst string, type string").withColumn("props_json", F.lit("{}"))
    return Graph(fill(n, schema.NODE), e)


def two_clusters(spark):
    nodes = [("service:a", "service"), ("service:b", "service"), *[(f"symbol:{s}{k}", "symbol") for s in "ab" for k in range(3)], ("symbol:unresolved:x", "symbol")]
    edges = []
    for s in "ab":
        edges += [(f"service:{s}", f"symbol:{s}{k}", "contains") for k in range(3)]
        edges += [(f"symbol:{s}0", f"symbol:{s}1", "calls"), (f"symbol:{s}1", f"symbol:{s}2", "calls"), (f"symbol:{s}2", f"symbol:{s}0", "depends_on"), (f"symbol:{s}0", "symbol:unresolved:x", "calls")]
    return graph(spark, nodes, [*edges, ("symbol:a0", "symbol:b0", "relates_to")])


def test_two_communities_and_their_edges(spark):
    g = two_clusters(spark)
    assigned = communities.assign(g)
    by = {}
    for r in assigned.collect():
        by.setdefault(r.community, set()).add(r.id)
    assert by == {"c001": {"service:a", "symbol:a0", "symbol:a1", "symbol:a2"}, "c002": {"service:b", "symbol:b0", "symbol:b1", "symbol:b2"}, "c003": {"symbol:unresolved:x"}}
    s = {r.community: (r.size, r.internal_edges, r.boundary_edges) for r in communities.summaries(g, assigned).collect()}
    assert s == {"c001": (4, 6, 2), "c002": (4, 6, 2), "c003": (1, 0, 2)}
    assert {r.id for r in communities.hubs(g, assigned).filter("pos = 1").collect()} == {"symbol:a0", "symbol:b0"}


@pytest.mark.parametrize(
    "edges, want",
    [
        ([("a", "b"), ("b", "c")], {}),
        ([("a", "b"), ("b", "a")], {"a": "a", "b": "a"}),
        ([("a", "a"), ("a", "b")], {"a": "a"}),
        ([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c")], {"a": "a", "b": "a", "c": "c", "d": "c"}),
        ([("x", "y"), ("y", "z"), ("z", "x"), ("z", "w")], {"x": "x", "y": "x", "z": "x"}),
    ],
)
def test_cycles(spark, edges, want):
    g = graph(spark, [(i, "symbol") for i in sorted({x for e in edges for x in e})], [(*e, "calls") for e in edges])
    assert {r.id: r.cycle for r in communities.cycles(g).collect()} == want


def test_a_path_of_a_hundred_steps(spark):
    n = 100
    g = graph(spark, [(f"n{k:03}", "file") for k in range(n)], [(f"n{k:03}", f"n{k + 1:03}", "calls") for k in range(0, n - 1)] + [("n000", "n050", "calls")])
    way = [r.id for r in traverse.path(g, "n000", "n099").orderBy("step").collect()]
    assert way == ["n000", *[f"n{k:03}" for k in range(50, n)]]
    # of two shortest paths the one of the earlier edge is taken
    g = graph(spark, [(x, "file") for x in "abcd"], [("a", "c", "z"), ("a", "b", "z"), ("b", "d", "z"), ("c", "d", "a")])
    assert [r.id for r in traverse.path(g, "a", "d").orderBy("step").collect()] == ["a", "b", "d"]
    assert traverse.path(g, "a", "nowhere").count() == 0


def test_mentions_by_inner_words_and_by_short_names(spark):
    texts = [("c1", "please Ask the Code Reviewer today"), ("c2", "recode reviewers"), ("c3", "qa, then x"), ("c4", ""), ("c5", None), ("c6", "a  planner-agent's plan")]
    names = [("reviewer", "the code review"), ("qa", "QA"), ("x", "x"), ("none", ""), ("null", None), ("planner", "Planner-Agent"), ("two", "code reviewer")]
    c = spark.createDataFrame(texts, "id string, text string")
    a = spark.createDataFrame(names, "id string, name string")
    want = {(i, k) for i, t in texts for k, n in names if t and n and n.lower() in t.lower()}
    got = [(r.src, r.dst) for r in build.mentions(c, a).collect()]
    assert sorted(got) == sorted(want) and {("c1", "reviewer"), ("c3", "x"), ("c2", "two")} <= want


def test_purge_takes_packages_that_nothing_is_left_of(spark):
    out = '{"external": true}'
    g = graph(spark, [("f", "file"), ("g", "file"), ("p", "package", out), ("q", "package", out), ("r", "package")], [("f", "p", "depends_on"), ("f", "q", "depends_on"), ("g", "q", "depends_on"), ("f", "r", "depends_on")])
    g = Graph(g.nodes.withColumn("file", F.when(F.col("type") == "file", F.concat("id", F.lit(".py")))), g.edges)
    left = build.purge(g, spark.createDataFrame([("f.py",)], "file string"))
    assert {r.id for r in left.nodes.collect()} == {"g", "q", "r"} and [(r.src, r.dst) for r in left.edges.collect()] == [("g", "q")]


def test_purge_is_planned_in_seconds(spark):
    import time

    g = relational.graph(spark, SF)
    began = time.perf_counter()
    out = build.purge(g, g.nodes.filter("file LIKE '%NATION_1%'").select("file"))
    assert out.edges.count() <= g.edges.count() and time.perf_counter() - began < 120


def test_numbered(spark):
    df = spark.range(0, 1000, 1, 7).select(((F.col("id") * 37) % 1000).alias("v"), F.lit(2).alias("w"))
    got = {r.v: r.pos for r in numbered(df, ["v"]).collect()}
    assert got == {v: v + 1 for v in range(1000)}
    assert {r.v: r.t for r in numbered(df, ["v"], "t", F.col("w")).collect()} == {v: 2 * v + 2 for v in range(1000)}
    assert numbered(df.limit(0), ["v"]).count() == 0


def test_changes_of_files_that_a_state_tells_twice(spark, tmp_path):
    state = lambda rows: spark.createDataFrame(rows, "file string, sha string")
    before, after = state([("a", "1"), ("a", "1"), ("b", "1"), ("b", "2"), ("c", "1"), ("g", "1")]), state([("a", "1"), ("b", "2"), ("b", "1"), ("c", "2"), ("c", "1"), ("n", "1"), ("n", "2")])
    assert sorted((r.file, r.change) for r in build.file_changes(before, after).collect()) == [("c", "modified"), ("g", "removed"), ("n", "added")]
    # pages 0 (removed), 1 (added), 2 and 6 (modified) and 3 (as it was) of one address
    spark.createDataFrame([(k, "u", f"<p>{k}</p>") for k in (0, 1, 2, 3, 6)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    from graphloom.plans import catalog

    assert sorted(r.change for r in catalog.queries()["di_file_changes"](spark, str(tmp_path)).collect()) == ["added", "modified", "modified", "removed"]


def test_names_told_twice_unless_every_pair_is_linked(spark):
    bag = lambda n: f'{{"name": "{n}", "source_strategy": "agent_graph_static"}}'
    nodes = [(f"skill:{k}", "skill", bag("same")) for k in "ab"] + [(f"skill:{k}", "skill", bag("other")) for k in "xyz"]
    e = [("skill:b", "skill:a", "generated_from"), ("skill:x", "skill:y", "generated_from"), ("skill:y", "skill:z", "generated_from")]
    found = agents.audit(graph(spark, nodes, e)).filter("code = 'duplicate_name'").collect()
    assert [r.node_ids for r in found] == [["skill:x", "skill:y", "skill:z"]]


def test_the_entry_goes_without_queries_that_cannot_be_imported(monkeypatch):
    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("graphloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    found = entry.queries()
    assert "g11_impact" in found and "op7_sentencepiece" not in found
    assert set(entry.oracle_sql()) <= set(found)
