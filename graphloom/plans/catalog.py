"""Queries over the graph of the driver's tables, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import export, schema
from ..functions import columns as C
from ..model import Graph, fill, resolve
from ..operators import agents, build, communities, enrich, federation, retrieve, rules, stats, traverse
from ..sources import files, relational
from ..sources.relational import graph, sql
from ..store import cut
from ..streaming import watch

_queries: dict = {}
_sql: dict[str, str] = {}


def query(statement: str | None = None):
    """Registers a function of (spark, sf_dir), or of a graph where it takes one argument, under its name."""
    def add(f):
        name = f.__name__
        one = f.__code__.co_argcount == 1
        _queries[name] = (lambda spark, sf_dir: f(graph(spark, sf_dir))) if one else f
        if statement:
            _sql[name] = statement
        return f

    return add


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


_SURFACE = "CASE WHEN type = 'command' THEN 'cli_commands' WHEN type = 'tool' THEN 'mcp_tools' WHEN type IN ('route', 'rpc', 'channel') THEN 'api_endpoints' WHEN type = 'entrypoint' THEN 'entrypoints' WHEN type = 'boundary' THEN 'boundaries' END"
_INTERACTS = "(coalesce(protocol, '') IN ('http', 'event', 'grpc', 'ros2', 'inproc') OR coalesce(boundary_kind, '') IN ('inbound', 'outbound', 'internal'))"
_CLASS = f"CASE WHEN type IN ('doc', 'policy', 'runbook') OR coalesce(doc_kind, '') IN ('adr', 'policy', 'runbook', 'guide') THEN 'doc' WHEN type IN ('build-target', 'test-target', 'test-suite', 'gate') THEN 'build' WHEN type IN ('boundary', 'entrypoint') THEN 'boundary' WHEN type IN ('rpc', 'channel') OR {_INTERACTS} THEN 'interface' ELSE 'primary' END"
_BUCKET = f"CASE WHEN ({_CLASS}) = 'interface' THEN 'interfaces' WHEN ({_CLASS}) = 'boundary' OR type IN ('compose', 'dockerfile', 'deploy') THEN 'boundaries' WHEN type IN ('service', 'package') THEN 'services' WHEN type IN ('contract', 'enum') THEN 'contracts' END"
_UNRESOLVED = "(starts_with(id, 'symbol:unresolved:') OR (type = 'symbol' AND coalesce(NOT resolved, false)))"
_AUTH = "CASE authority WHEN 'canonical' THEN 0 WHEN 'derived' THEN 1 WHEN 'manual' THEN 2 WHEN 'inferred' THEN 3 ELSE 99 END"
_CONF = "CASE confidence WHEN 'definite' THEN 0 WHEN 'inferred' THEN 1 WHEN 'speculative' THEN 2 ELSE 99 END"
_TRACE = ", ".join(f"'{t}'" for t in schema.TRACE_EDGES)


def _reach(seed: str, depth: int, step: str) -> str:
    """Views r0..: breadth-first levels as (id, hop) of what step (a, b) reaches."""
    return f"st AS MATERIALIZED ({step}), r AS (SELECT id, 0 AS hop FROM ({seed}) UNION SELECT st.b, r.hop + 1 FROM r JOIN st ON st.a = r.id WHERE r.hop < {depth}), reach AS (SELECT id, min(hop)::INT AS hop FROM r GROUP BY id)"


_IN = "SELECT DISTINCT dst AS a, src AS b FROM e"
_BOTH = "SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e"


def entry(spark, sf_dir: str) -> DataFrame:
    return traverse.impact(graph(spark, sf_dir), "supplier:1", 3)


# --- filters and projections ---


@query(sql("SELECT id, type, label, description FROM n WHERE id = 'part:7'"))
def p1_get_node(g: Graph):
    return g.nodes.filter(F.col("id") == "part:7").select("id", "type", "label", "description")


@query(sql("SELECT id, label FROM n WHERE type = 'service'"))
def p2_list_nodes(g: Graph):
    return g.nodes.filter("type = 'service'").select("id", "label").orderBy("id")


@query(sql("SELECT 'nation:3' AS name, id FROM n WHERE id = 'nation:3' UNION ALL SELECT 'NATION_4', id FROM n WHERE type = 'deploy' AND label = 'NATION_4'"))
def p3_resolve_id(g: Graph):
    old = g.nodes.withColumn("aliases", F.when(F.col("type") == "deploy", F.array("label")))
    return resolve(old, "nation:3").select(F.lit("nation:3").alias("name"), "id").union(resolve(old, "NATION_4").select(F.lit("NATION_4"), "id"))


@query(sql(f"SELECT id, {_CLASS} AS class FROM n"))
def p4_classify(g: Graph):
    return g.nodes.select("id", C.node_class().alias("class"))


@query(sql(f"SELECT id, {_BUCKET} AS bucket FROM n"))
def p5_trace_bucket(g: Graph):
    return g.nodes.select("id", C.trace_bucket().alias("bucket"))


@query(sql(f"SELECT id, {_SURFACE} AS surface FROM n"))
def p6_surface(g: Graph):
    return g.nodes.select("id", C.surface().alias("surface"))


@query(sql("SELECT id, CASE WHEN trim(coalesce(language, '')) <> '' THEN replace(replace(lower(trim(language)), '_', '-'), '-', '') ELSE 'unknown' END AS language FROM n"))
def p7_language(g: Graph):
    return g.nodes.select("id", C.language().alias("language"))


@query(sql(f"SELECT id FROM n WHERE {_UNRESOLVED}"))
def p8_unresolved(g: Graph):
    return g.nodes.filter(C.unresolved()).select("id")


@query("SELECT page_id, regexp_matches(lower(url), '_test\\.(py|go)|\\.test\\.(tsx?|js)|(^|/)(tests|__tests__)(/|$)|(^|/)test_[^/]*$') AS is_test FROM pages")
def p9_test_path(spark, sf_dir: str):
    p = relational.tables(spark, sf_dir)("pages")
    return p.select("page_id", F.col("url").alias("file"), F.lit(None).cast("array<string>").alias("roles")).select("page_id", C.test_node().alias("is_test"))


@query("SELECT p_partkey, CASE WHEN s = '' THEN 'unknown' ELSE s END AS slug FROM (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(trim(p_type || '  ' || p_name)), '[^a-z0-9._:-]+', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM part)")
def u1_slug(spark, sf_dir: str):
    return relational.tables(spark, sf_dir)("part").select("p_partkey", C.slug(F.concat("p_type", F.lit("  "), "p_name")).alias("slug"))


# --- traversals ---


@query(sql("SELECT DISTINCT n.id, n.type, n.label FROM (SELECT dst AS id FROM e WHERE src IN ('supplier:1', 'nation:2') UNION SELECT src FROM e WHERE dst IN ('supplier:1', 'nation:2')) x JOIN n USING (id) WHERE id NOT IN ('supplier:1', 'nation:2')"))
def g1_neighborhood(g: Graph):
    return traverse.neighborhood(g, g.nodes.filter(F.col("id").isin("supplier:1", "nation:2")).select("id"))


@query(sql("SELECT src, dst, type FROM e WHERE src IN ('supplier:1', 'nation:2') OR dst IN ('supplier:1', 'nation:2')"))
def g1_incident_edges(g: Graph):
    return traverse.incident(g, g.nodes.filter(F.col("id").isin("supplier:1", "nation:2")).select("id")).select("src", "dst", "type")


@query(sql("SELECT 'node' AS role, id, type, label FROM n WHERE id = 'order:1' UNION ALL SELECT 'neighbor', n.id, n.type, n.label FROM (SELECT dst AS id FROM e WHERE src = 'order:1' UNION SELECT src FROM e WHERE dst = 'order:1') x JOIN n USING (id) WHERE id <> 'order:1'"))
def g2_context(g: Graph):
    return traverse.context(g, "order:1")


@query(sql("SELECT id, hop FROM reach WHERE hop > 0", _reach("SELECT 'symbol:unresolved:error' AS id", 2, "SELECT DISTINCT dst AS a, src AS b FROM e WHERE type = 'calls'")))
def g3_callers(g: Graph):
    return traverse.callers(g, "symbol:unresolved:error", 2)


@query(sql("SELECT DISTINCT src AS id FROM e WHERE type = 'calls' AND dst IN (SELECT id FROM n WHERE type = 'symbol' AND (qualname = 'view' OR ends_with(qualname, '.view')) OR id = 'symbol:unresolved:view')"))
def g4_references(g: Graph):
    return traverse.references(g, "view")


@query()
def g5_path(g: Graph):
    return traverse.path(g, "customer:5", "part:11")


@query()
def g6_federated_path(g: Graph):
    return traverse.path(g, "customer:5", "part:11", "federated")


@query()
def g7_path_by_ids(g: Graph):
    return traverse.path(g, "customer:5", "part:11", "ids")


@query(sql("SELECT src, dst, type FROM e WHERE src IN (SELECT id FROM reach) AND dst IN (SELECT id FROM reach)", _reach("SELECT 'supplier:3' AS id", 1, _BOTH)))
def g8_subgraph_edges(g: Graph):
    return traverse.subgraph(g, "supplier:3").edges.select("src", "dst", "type")


@query(sql("SELECT id, hop FROM reach", _reach("SELECT 'page:4' AS id", 2, _BOTH)))
def g9_k_hop(g: Graph):
    return traverse.bfs(g, g.nodes.filter("id = 'page:4'").select("id"), 2)


@query(sql(f"SELECT bucket, row_number() OVER (PARTITION BY bucket ORDER BY a, c, id)::INT AS pos, id, hop FROM (SELECT {_BUCKET} AS bucket, {_AUTH} AS a, {_CONF} AS c, reach.id, hop FROM reach JOIN n USING (id)) WHERE bucket IS NOT NULL", _reach("SELECT 'supplier:2' AS id", 2, f"SELECT src AS a, dst AS b FROM e WHERE type IN ({_TRACE}) UNION SELECT dst, src FROM e WHERE type IN ({_TRACE})")))
def g10_trace(g: Graph):
    return retrieve.trace(g, node="supplier:2", depth=2)


@query()
def g10_trace_term(g: Graph):
    return retrieve.trace(g, term="economy orders", depth=1)


_IMPACT = _reach("SELECT 'supplier:1' AS id", 3, _IN)


@query(sql(f"SELECT reach.id, hop, {_SURFACE} AS surface, hop = 1 AS direct FROM reach LEFT JOIN n USING (id)", _IMPACT))
def g11_impact(g: Graph):
    return traverse.impact(g, "supplier:1", 3)


@query(sql(f"SELECT CASE WHEN coalesce(bool_or(s IN ('api_endpoints', 'entrypoints', 'boundaries')), false) THEN 'HIGH' WHEN coalesce(bool_or(s IN ('cli_commands', 'mcp_tools')), false) THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, count(*) FILTER (hop = 1) AS direct, count(*) FILTER (hop > 1) AS transitive FROM (SELECT hop, {_SURFACE} AS s FROM reach LEFT JOIN n USING (id))", _IMPACT))
def g11_risk(g: Graph):
    return traverse.risk(traverse.impact(g, "supplier:1", 3))


@query(sql("SELECT DISTINCT src, dst, type FROM e WHERE dst IN (SELECT id FROM reach)", _reach("SELECT 'supplier:1' AS id", 1, _IN)))
def g11_impact_edges(g: Graph):
    return traverse.impact_edges(g, "supplier:1", 2).select("src", "dst", "type")


@query(sql("SELECT id, coalesce(i.k, 0) AS in_degree, coalesce(o.k, 0) AS out_degree, coalesce(i.k, 0) + coalesce(o.k, 0) AS degree FROM (SELECT dst AS id, count(*) AS k FROM e GROUP BY 1) i FULL JOIN (SELECT src AS id, count(*) AS k FROM e GROUP BY 1) o USING (id)"))
def g16_degree(g: Graph):
    return traverse.degree(g)


_STRUCT = "(SELECT n.id, round(coalesce(k, 0) / max(coalesce(k, 0)) OVER (), 6) AS structural FROM n LEFT JOIN (SELECT dst AS id, count(*) AS k FROM e GROUP BY 1) i USING (id))"


@query(sql(f"SELECT * FROM {_STRUCT}"))
def g14_structural(g: Graph):
    return traverse.structural(g).select("id", F.round("structural", 6).alias("structural"))


@query(sql(f"SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) JOIN n USING (id) WHERE NOT {_UNRESOLVED} GROUP BY id ORDER BY degree DESC, id LIMIT 5"))
def g15_top_nodes(g: Graph):
    return stats.top_nodes(g, 5)


# --- communities and cycles ---


_WEIGHT = "CASE type WHEN 'contains' THEN 4.0 WHEN 'calls' THEN 3.0 WHEN 'invokes' THEN 3.0 WHEN 'depends_on' THEN 2.0 WHEN 'consumes' THEN 2.0 WHEN 'produces' THEN 2.0 ELSE 1.0 END"
_ADJ = f"okn AS (SELECT id FROM n WHERE NOT {_UNRESOLVED}), dir AS (SELECT src, dst, sum({_WEIGHT}) AS w FROM e WHERE src <> dst AND src IN (SELECT id FROM okn) AND dst IN (SELECT id FROM okn) GROUP BY 1, 2), adj AS (SELECT a, b, sum(w)::DOUBLE AS weight FROM (SELECT src AS a, dst AS b, w FROM dir UNION ALL SELECT dst, src, w FROM dir) GROUP BY 1, 2)"


@query(sql("SELECT a, b, weight FROM adj", _ADJ))
def g12b_adjacency(g: Graph):
    return communities.adjacency(g)


@query()
def g12c_labels(g: Graph):
    return communities.labels(g)


@query()
def g12d_assignments(g: Graph):
    return communities.assign(g)


@query()
def g12e_summaries(g: Graph):
    return communities.summaries(g, communities.assign(g))


@query()
def g12f_community_hubs(g: Graph):
    return communities.hubs(g, communities.assign(g))


@query(sql("SELECT okn.id, count(b) AS degree FROM okn LEFT JOIN adj ON a = okn.id GROUP BY 1 ORDER BY degree DESC, id LIMIT 12", _ADJ))
def g12g_hubs(g: Graph):
    return communities.hubs(g)


@query()
def g12h_health(g: Graph):
    return communities.health(g, communities.assign(g))


@query()
def g13_cycles(g: Graph):
    return communities.cycles(g)


@query()
def g13_components(g: Graph):
    return communities.components(g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))


# --- retrieval ---

def _tk(c: str) -> str:
    low = f"lower(coalesce({c}, ''))"
    return f"CASE WHEN {low} = '' THEN []::VARCHAR[] ELSE list_concat([{low}], list_filter(regexp_split_to_array(translate({low}, '/:.·-_', '      '), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+'), lambda x: x <> '')) END"


_TOKENS = f"tok AS (SELECT id, list_concat(list_concat(list_concat({_tk('id')}, {_tk('label')}), list_concat({_tk('file')}, list_transform(coalesce(exports, []::VARCHAR[]), lambda x: lower(x)))), {_tk('description')}) AS t FROM n)"


def _bm25(groups: list[list[str]]) -> str:
    words = sorted({w for g in groups for w in g})
    tf = ", ".join(f"len(list_filter(t, lambda x: contains(x, '{w}'))) AS tf{i}" for i, w in enumerate(words))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(words)))
    one = lambda w: (lambda i: f"CASE WHEN tf{i} > 0 THEN ln(1 + (nn - df{i} + 0.5) / (df{i} + 0.5)) * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * len / al)) ELSE 0.0 END")(words.index(w))
    total = " + ".join(f"greatest({', '.join(one(w) for w in g)}, 0.0)" for g in groups)
    return f"{_TOKENS}, tfs AS (SELECT id, len(t) AS len, {tf} FROM tok), st1 AS (SELECT count(*) AS nn, avg(len) AS al, {df} FROM tfs), bm AS (SELECT id, {total} AS bm25 FROM tfs, st1)"


def _hit(g: list[str]) -> str:
    return "(" + " OR ".join([f"contains(lower(coalesce({c}, '')), '{w}')" for w in g for c in ("id", "label", "file", "description")] + [f"len(list_filter(coalesce(exports, []::VARCHAR[]), lambda x: contains(lower(x), '{w}'))) > 0" for w in g]) + ")"


def _query_sql(term: str, limit: int) -> str:
    gs = retrieve.groups(term)
    hits = " + ".join(f"{_hit(g)}::INT" for g in gs)
    more = f"{_bm25(gs)}, s0 AS {_STRUCT.replace('round(', '(').replace(', 6) AS structural', ') AS structural')}, m0 AS (SELECT n.*, bm25, structural, {hits} AS h FROM n JOIN bm USING (id) JOIN s0 USING (id)), m1 AS (SELECT *, max(h) OVER () = {len(gs)} AS strict FROM m0 WHERE h > 0), m2 AS (SELECT *, max(bm25) OVER () AS top, max(structural) OVER () > 0 AS os, CASE WHEN {_AUTH} < 4 THEN (4 - {_AUTH}) / 4.0 ELSE 0.0 END AS ar FROM m1 WHERE (strict AND h = {len(gs)}) OR (NOT strict AND {len(gs)} > 1)), m3 AS (SELECT *, CASE WHEN top > 0 THEN 0.4 ELSE 0 END + CASE WHEN os THEN 0.2 ELSE 0 END + 0.1 AS ws, round((CASE WHEN top > 0 THEN 0.4 * bm25 / top ELSE 0 END + CASE WHEN os THEN 0.2 * structural ELSE 0 END + 0.1 * ar) / (CASE WHEN top > 0 THEN 0.4 ELSE 0 END + CASE WHEN os THEN 0.2 ELSE 0 END + 0.1), 9) AS sc FROM m2)"
    order = f"CASE WHEN strict THEN {_UNRESOLVED.split(' OR ')[0][1:]}::INT ELSE -h END, CASE WHEN strict THEN -sc ELSE -round(bm25, 9) END, CASE WHEN strict THEN {_CONF} ELSE 0 END, id"
    return sql(f"SELECT row_number() OVER (ORDER BY {order})::INT AS rank, id, type, label, round(bm25, 6) AS bm25, round(structural, 6) AS structural, ar AS authority_rel, round(sc, 6) AS score, h AS groups_hit, NOT strict AS degraded FROM m3 ORDER BY rank LIMIT {limit}", more)


@query(_query_sql("economy", 20))
def t1_query(g: Graph):
    return retrieve.query(g, "economy", 20)


@query(_query_sql("supplier economy orders", 20))
def t5_or_fallback(g: Graph):
    return retrieve.query(g, "supplier economy orders", 20)


@query(sql("SELECT token, id, count(*) AS tf FROM (SELECT id, unnest(t) AS token FROM tok) GROUP BY 1, 2", _TOKENS))
def t6_token_index(g: Graph):
    return retrieve.token_index(g.nodes)


@query(sql("SELECT id, round(bm25, 6) AS bm25 FROM bm WHERE bm25 > 0", _bm25(retrieve.groups("product red"))))
def t7_bm25(g: Graph):
    return retrieve.scored(g.nodes, retrieve.groups("product red")).filter("bm25 > 0").select("id", F.round("bm25", 6).alias("bm25"))


@query()
def t12_brief(g: Graph):
    return retrieve.brief(g, "economy http", 10)


@query(sql("SELECT warning, key FROM (SELECT 'server_without_client' AS warning, protocol AS key FROM n WHERE protocol IN ('http', 'grpc') GROUP BY protocol HAVING bool_or(boundary_kind = 'inbound') AND NOT coalesce(bool_or(boundary_kind = 'outbound'), false)) UNION ALL SELECT 'mostly_speculative', 'confidence' FROM (SELECT count(*) FILTER (confidence = 'speculative') AS s, count(*) AS c FROM n WHERE " + _INTERACTS + ") WHERE s * 2 > c"))
def t13_warnings(g: Graph):
    return retrieve.coverage_warnings(g.nodes)


@query("WITH t AS (SELECT url AS path, list_sort(list_distinct(regexp_extract_all(lower(html), '[a-z]{6,}'))) AS tokens FROM pages), s AS (SELECT path, tokens, len(list_filter(tokens, lambda x: contains(x, 'tion'))) AS score FROM t) SELECT row_number() OVER (ORDER BY score DESC, path)::INT AS rank, path, score::INT AS score, len(tokens)::INT AS n FROM s WHERE score > 0 ORDER BY rank LIMIT 20")
def f1_find_files(spark, sf_dir: str):
    p = relational.tables(spark, sf_dir)("pages")
    index = p.select(F.col("url").alias("path"), F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("html"), F.lit("([a-z]{6,})"), F.lit(1)))).alias("tokens"))
    return retrieve.find_files(index, "tion", 20).select("rank", "path", "score", F.size("tokens").alias("n"))


@query("SELECT path, line_no::INT AS line_no, line FROM (SELECT path, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line FROM (SELECT 'doc/' || lpad(doc_id::VARCHAR, 9, '0') AS path, string_split(text, chr(10))[:200] AS l FROM documents WHERE contains(text, 'the') ORDER BY 1 LIMIT 25))")
def t16_grep(spark, sf_dir: str):
    d = relational.tables(spark, sf_dir)("documents")
    return retrieve.grep(d.select(F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), "text"), "the")


# --- statistics ---


@query(sql("SELECT 'nodes_by_type' AS metric, type AS key, count(*)::DOUBLE AS value FROM n GROUP BY type UNION ALL SELECT 'described_by_type', type, (count(*) FILTER (trim(description) <> ''))::DOUBLE FROM n GROUP BY type UNION ALL SELECT 'coverage_by_type', type, round_even(100.0::DOUBLE * count(*) FILTER (trim(description) <> '') / count(*), 2) FROM n GROUP BY type UNION ALL SELECT 'edges_by_type', type, count(*) FROM e GROUP BY type UNION ALL SELECT 'total', 'nodes', count(*) FROM n UNION ALL SELECT 'total', 'described', count(*) FILTER (trim(description) <> '') FROM n UNION ALL SELECT 'total', 'coverage', round_even(100.0::DOUBLE * count(*) FILTER (trim(description) <> '') / count(*), 2) FROM n UNION ALL SELECT 'total', 'edges', count(*) FROM e"))
def a1_counts(g: Graph):
    return stats.counts(g)


@query(sql("SELECT total, described, round_even(100.0::DOUBLE * described / total, 2) AS coverage_pct, (total - described) * 600 AS tokens, round_even((total - described) * 0.003::DOUBLE, 2) AS dollars, ceil((total - described) / 6)::BIGINT AS minutes FROM (SELECT count(*) AS total, count(*) FILTER (trim(description) <> '') AS described FROM n WHERE type IN ('agent', 'command', 'config', 'doc', 'file', 'package', 'workflow'))"))
def a2_meaningful(g: Graph):
    return stats.meaningful(g)


@query("SELECT event_type, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.9) AS p90 FROM events GROUP BY event_type")
def a7_latency(spark, sf_dir: str):
    return stats.latency(relational.tables(spark, sf_dir)("events"), "event_type", "value")


@query("WITH x AS (SELECT DISTINCT o_custkey AS c, l_partkey AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'), f AS (SELECT DISTINCT o_custkey AS c, l_partkey AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'), j AS (SELECT coalesce(x.c, f.c) AS o_custkey, count(x.item) AS ne, count(f.item) AS nf, count(*) FILTER (x.item IS NOT NULL AND f.item IS NOT NULL) AS b FROM x FULL JOIN f ON x.c = f.c AND x.item = f.item GROUP BY 1) SELECT o_custkey, round(CASE WHEN nf > 0 THEN b / nf ELSE 0.0 END, 6) AS precision, round(CASE WHEN ne > 0 THEN b / ne ELSE 0.0 END, 6) AS recall, round(CASE WHEN b > 0 THEN 2 * (b / nf) * (b / ne) / (b / nf + b / ne) ELSE 0.0 END, 6) AS f1 FROM j")
def a8_accuracy(spark, sf_dir: str):
    t = relational.tables(spark, sf_dir)
    both = t("orders").join(t("lineitem"), F.expr("o_orderkey = l_orderkey"))
    pick = lambda c: both.filter(c).select("o_custkey", F.col("l_partkey").alias("item"))
    return stats.accuracy(pick("o_orderstatus = 'F'"), pick("l_returnflag = 'R'"), ["o_custkey"])


# --- building ---


@query(sql("SELECT DISTINCT src, dst, type FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)"))
def m8_dedup_edges(g: Graph):
    return build.dedup_edges(g).select("src", "dst", "type")


_GONE = "gone AS MATERIALIZED (SELECT id FROM n WHERE file IN (SELECT 'supplier/' || n_name || '.tbl' FROM nation WHERE n_nationkey < 5))"


@query(sql("SELECT n.id FROM n ANTI JOIN gone ON n.id = gone.id", _GONE))
def m13_purge_nodes(spark, sf_dir: str):
    return build.purge(graph(spark, sf_dir), _stale(spark, sf_dir)).nodes.select("id")


@query(sql("SELECT e.src, e.dst, e.type FROM e ANTI JOIN gone a ON e.src = a.id ANTI JOIN gone b ON e.dst = b.id", _GONE))
def m13_purge_edges(spark, sf_dir: str):
    return build.purge(graph(spark, sf_dir), _stale(spark, sf_dir)).edges.select("src", "dst", "type")


def _stale(spark, sf_dir: str) -> DataFrame:
    return relational.tables(spark, sf_dir)("nation").filter("n_nationkey < 5").select(F.concat(F.lit("supplier/"), "n_name", F.lit(".tbl")).alias("file"))


@query("SELECT 'item:' || l_partkey AS id, min(l_shipmode) AS label, list_sort(list_distinct(list(l_returnflag))) AS roles FROM (SELECT l_partkey, l_returnflag, CASE WHEN r = max(r) OVER (PARTITION BY l_partkey) THEN l_shipmode END AS l_shipmode FROM (SELECT l_partkey, l_returnflag, l_linestatus AS l_shipmode, CASE WHEN l_returnflag = 'R' THEN 3 WHEN l_returnflag = 'A' THEN 1 ELSE -1 END AS r FROM lineitem)) GROUP BY l_partkey")
def m1_merge_claims(spark, sf_dir: str):
    li = relational.tables(spark, sf_dir)("lineitem")
    claims = fill(li.select(F.concat(F.lit("item:"), F.col("l_partkey").cast("string")).alias("id"), F.col("l_linestatus").alias("label"), F.array("l_returnflag").alias("roles"), F.expr("CASE l_returnflag WHEN 'R' THEN 'canonical' WHEN 'A' THEN 'derived' END").alias("authority")), schema.NODE)
    return build.merge_claims(claims).select("id", "label", "roles")


@query(sql("SELECT src, dst, type FROM e WHERE NOT (src = 'nation:1' AND dst = 'supplier:1' AND type = 'contains') AND src <> 'part:3' AND dst <> 'part:3'"))
def m2_remove(g: Graph):
    one = g.nodes.filter("id = 'part:3'").select("id")
    return build.remove_edges(build.remove_nodes(g, one), "nation:1", "supplier:1", "contains").edges.select("src", "dst", "type")


@query("SELECT 'ord:' || o_orderkey AS src, 'customer:' || o_custkey AS dst FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey < 10")
def m5_foreign_keys(spark, sf_dir: str):
    t = relational.tables(spark, sf_dir)
    e = t("orders").select(F.concat(F.lit("ord:"), F.col("o_orderkey").cast("string")).alias("src"), F.concat(F.lit("__table__:"), F.col("o_custkey").cast("string")).alias("dst"), F.lit("depends_on").alias("type"), F.lit("{}").alias("props_json"))
    tables = t("customer").filter("c_nationkey < 10").select(F.col("c_custkey").cast("string").alias("table"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    return build.resolve_foreign_keys(e, tables).select("src", "dst")


@query("SELECT 'doc:' || d.doc_id AS src, 'b:' || b.item_id AS dst FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))")
def m6_mentions(spark, sf_dir: str):
    t = relational.tables(spark, sf_dir)
    docs = t("documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), "text")
    return build.mentions(docs, t("benchmark").select(F.concat(F.lit("b:"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("name"))).select("src", "dst")


@query()
def m9_closure(g: Graph):
    return build.close(Graph(g.nodes.withColumn("module", F.col("label")).withColumn("imports_from", F.when(F.col("type") == "service", F.array("layer"))).withColumn("file", F.when(F.col("type") == "symbol", F.concat(F.lit("ev/"), F.regexp_replace("label", r"\.", "/"), F.lit(".py"))).otherwise(F.col("file"))), g.edges, g.meta)).edges.filter("props_json LIKE '%closure%'").select("src", "dst", "type", "props_json")


@query(sql("SELECT DISTINCT 'customer:' || c_custkey AS file FROM customer WHERE c_nationkey % 3 = 0"))
def m14_without_output(spark, sf_dir: str):
    t = relational.tables(spark, sf_dir)
    src = t("customer").select((F.col("c_nationkey") % 3).cast("string").alias("source"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("file"))
    return build.without_output(src, src.filter("source <> '0'").select("file"))


@query(sql("SELECT src, dst, type FROM e WHERE NOT (type = 'contains' AND starts_with(src, 'nation:') AND starts_with(dst, 'supplier:')) UNION ALL SELECT 'region:' || r_regionkey, 'region:' || r_regionkey, 'governs' FROM region"))
def m15_overrides(g: Graph):
    gone = g.edges.filter("type = 'contains' AND src LIKE 'nation:%' AND dst LIKE 'supplier:%'").select("src", "dst", "type", F.lit("remove").alias("action"), "props_json")
    more = g.nodes.filter("id LIKE 'region:%'").select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("governs").alias("type"), F.lit("add").alias("action"), F.lit("{}").alias("props_json"))
    return build.overrides(g.edges, gone.union(more)).select("src", "dst", "type")


_KEY = "try_cast(regexp_extract(id, '(\\d+)$', 1) AS BIGINT)"


def _halves(g: Graph) -> tuple[Graph, Graph]:
    k = F.regexp_extract("id", r"(\d+)$", 1).try_cast("bigint")
    before = Graph(g.nodes.filter(F.coalesce(k % 10 != 0, F.lit(True))), g.edges.filter("type <> 'produces'"), g.meta)
    after = Graph(g.nodes.withColumn("label", F.when(k % 7 == 0, F.lit("renamed")).otherwise(F.col("label"))), g.edges.filter("type <> 'contains'"), g.meta)
    return before, after


@query(sql(f"SELECT CASE WHEN {_KEY} % 10 = 0 THEN 'added_node' ELSE 'modified_node' END AS kind, id FROM n WHERE {_KEY} % 10 = 0 OR {_KEY} % 7 = 0 UNION ALL SELECT DISTINCT CASE WHEN type = 'produces' THEN 'added_edge' ELSE 'removed_edge' END, src || '|' || dst || '|' || type FROM e WHERE type IN ('produces', 'contains')"))
def d1_diff(g: Graph):
    return build.diff(*_halves(g))


# --- rules ---


@query(sql("SELECT n.id, n.type IN ('doc', 'config') AS suppressed FROM n ANTI JOIN (SELECT src AS id FROM e WHERE type NOT IN ('references_file', 'contains') UNION SELECT dst FROM e WHERE type NOT IN ('references_file', 'contains')) u ON u.id = n.id"))
def l2_orphans(g: Graph):
    return rules.orphans(Graph(g.nodes, g.edges.filter("type NOT IN ('references_file', 'contains')"), g.meta))


@query("SELECT r_name AS id FROM region WHERE r_name NOT IN (SELECT r_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_name < 'M')")
def l3_empty_sources(spark, sf_dir: str):
    t = relational.tables(spark, sf_dir)
    src = t("region").select(F.col("r_name").alias("source"), F.concat(F.lit("^"), "r_name", F.lit("/[^/]*$")).alias("glob_regex"))
    own = t("nation").filter("n_name < 'M'").join(t("region"), F.expr("n_regionkey = r_regionkey")).select(F.concat("r_name", F.lit("/"), "n_name").alias("file"))
    return rules.empty_sources(src, own)


@query(sql("SELECT src, dst, e.type, a.type AS from_layer, b.type AS to_layer FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE a.type <> b.type AND NOT (a.type = 'rpc' AND e.type = 'consumes') AND b.type <> 'contract'"))
def l5_boundary(g: Graph):
    allowed = g.nodes.sparkSession.createDataFrame([("rpc", "*", "consumes"), ("*", "contract", None)], "`from` string, `to` string, edge_type string")
    return rules.boundary(Graph(g.nodes.withColumn("layer", F.col("type")), g.edges, g.meta), allowed)


@query(sql("SELECT x AS id, 'contract:' || substr(id, 6) AS base FROM (SELECT id, unnest([id, 'contract:' || substr(id, 6)]) AS x FROM n WHERE type = 'contract' AND id NOT LIKE '%0')"))
def l6_double_ids(g: Graph):
    twin = g.nodes.filter("type = 'contract'").withColumn("aliases", F.when(F.col("id").endswith("0"), F.array("id"))).withColumn("id", F.concat(F.lit("contract:"), F.substring("id", 6, 20)))
    return rules.double_ids(Graph(g.nodes.unionByName(twin.select(*g.nodes.columns)), g.edges))


@query(sql("SELECT 'file:' || n_nationkey AS id FROM nation WHERE n_nationkey % 2 = 1"))
def l7_lonely_files(spark, sf_dir: str):
    n = relational.tables(spark, sf_dir)("nation")
    f = F.concat(F.lit("file:"), F.col("n_nationkey").cast("string"))
    e = n.select(f.alias("src"), F.lit("symbol:x").alias("dst"), F.lit("contains").alias("type"), F.lit("{}").alias("props_json")).union(n.filter("n_nationkey % 2 = 0").select(F.lit("package:p"), f, F.lit("contains"), F.lit("{}")))
    return rules.lonely_files(Graph(fill(n.select(f.alias("id"), F.lit("file").alias("type"), F.col("n_name").alias("label")), schema.NODE), e))


@query("WITH v AS (SELECT DISTINCT user_id || '/' || date_trunc('day', ts)::DATE AS user_id, event_type FROM events) SELECT user_id AS file, 'p' AS pair, list_sort(list_filter(['click', 'purchase', 'signup'], lambda x: NOT list_contains(l, x))) AS missing FROM (SELECT user_id, list(event_type) AS l FROM v GROUP BY 1) WHERE list_has_any(l, ['click', 'purchase', 'signup']) AND NOT list_has_all(l, ['click', 'purchase', 'signup'])")
def l8_lopsided_pairs(spark, sf_dir: str):
    v = relational.tables(spark, sf_dir)("events").select(F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("file"), F.col("event_type").alias("strategy"))
    return rules.lopsided_pairs(v, spark.createDataFrame([("p", ["click", "purchase", "signup"])], "pair string, strategies array<string>"))


@query(sql("SELECT src, dst, e.type FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE a.type = 'rpc' AND starts_with(b.id, 'supplier:') AND e.type = 'depends_on' AND NOT (b.label LIKE '%1')"))
def l9_custom(g: Graph):
    return rules.custom(g, {"name": "no-suppliers", "deny": [{"from": {"type": "rpc"}, "to": {"id_match": "supplier:*"}, "edge_type": "depends_on"}], "allow": [{"to": {"label_match": "*1"}}]})


@query()
def l1_lint(g: Graph):
    return rules.lint(g)[0]


@query(sql("SELECT 'edges.' || src || '|' || dst || '|' || type AS path, 'from' AS field, 'unknown node ' || src AS message FROM e WHERE src NOT IN (SELECT id FROM n) UNION ALL SELECT 'edges.' || src || '|' || dst || '|' || type, 'to', 'unknown node ' || dst FROM e WHERE dst NOT IN (SELECT id FROM n WHERE type <> 'channel')"))
def v1_validate_edges(g: Graph):
    return rules.validate_edges(Graph(g.nodes.filter("type <> 'channel' OR id IS NULL"), g.edges.filter("src NOT LIKE 'channel:%'"), g.meta))


@query(sql("SELECT 'nodes.' || id AS path, 'type' AS field, 'unknown value contrakt' AS message FROM n WHERE type = 'contract' UNION ALL SELECT 'nodes.' || id, 'protocol', 'unknown value htp' FROM n WHERE protocol = 'http'"))
def v1_validate_nodes(g: Graph):
    bad = g.nodes.withColumn("type", F.regexp_replace("type", "^contract$", "contrakt")).withColumn("protocol", F.regexp_replace("protocol", "^http$", "htp"))
    return rules.validate_nodes(bad)


@query()
def v2_hints(spark, sf_dir: str):
    return rules.hints(v1_validate_nodes(graph(spark, sf_dir)))


@query(sql("SELECT 'no_trace_edges' AS warning FROM (SELECT count(*) AS c FROM e WHERE type = 'references_file') WHERE c > 0"))
def v3_trace_contract(g: Graph):
    return rules.trace_contract(Graph(g.nodes, g.edges.filter("type = 'references_file'")))


@query("SELECT count(*) > 0 AS source_stale, true AS sha_behind, 3 AS commits_behind, count(*) > 0 AS stale FROM pages WHERE starts_with(url, 'https://')")
def v4_stale(spark, sf_dir: str):
    p = relational.tables(spark, sf_dir)("pages").select(F.col("url").alias("file"))
    return rules.stale(p, spark.createDataFrame([("https://",)], "prefix string"), "a", "b", 3)


# --- federation: a child for each region ---


def _child_nodes(g: Graph) -> DataFrame:
    return g.nodes.filter("layer IS NOT NULL").withColumn("child", F.col("layer"))


@query(sql("SELECT 'shop' || chr(31) || id AS id, type FROM n UNION ALL SELECT 'shop' || chr(31) || src || '|shop' || chr(31) || dst, type FROM e"))
def o5_prefix(g: Graph):
    p = federation.prefixed(g, "shop")
    return p.nodes.select("id", "type").union(p.edges.select(F.concat_ws("|", "src", "dst"), "type"))


def _regions(g: Graph) -> federation.Federation:
    """A child for each region with its nations, suppliers and customers and the edges among them; the root has what belongs to none."""
    g = Graph(cut(g.nodes), g.edges, g.meta)
    names = [r.label for r in g.nodes.filter("type = 'boundary'").select("label").orderBy("label").collect()]  # a fixed table
    inside = g.edges.join(g.nodes.select(F.col("id").alias("src"), F.col("layer").alias("a")).hint("shuffle_hash"), "src").join(g.nodes.select(F.col("id").alias("dst"), F.col("layer").alias("b")).hint("shuffle_hash"), "dst")
    inside = cut(inside.filter(F.col("a").eqNullSafe(F.col("b"))).withColumn("at", F.coalesce("a", F.lit(""))).select(*g.edges.columns, "at"))
    part = lambda n, key: Graph(g.nodes.filter(n), inside.filter(F.col("at") == key).drop("at"), g.meta)
    return federation.Federation(part("layer IS NULL", ""), {r: part(F.col("layer") == r, r) for r in names})


_CHILD = "home AS (SELECT e.src, e.dst, e.type, a.layer FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE a.layer IS NOT DISTINCT FROM b.layer)"


@query(sql("SELECT 'node' AS kind, CASE WHEN layer IS NULL THEN id ELSE layer || chr(31) || id END AS id, type FROM n UNION ALL SELECT DISTINCT 'edge', CASE WHEN layer IS NULL THEN src || '|' || dst ELSE layer || chr(31) || src || '|' || layer || chr(31) || dst END, type FROM home", _CHILD))
def o4_merge(g: Graph):
    u = _regions(g).union()
    return u.nodes.select(F.lit("node").alias("kind"), "id", "type").union(u.edges.select(F.lit("edge"), F.concat_ws("|", "src", "dst"), "type"))


@query()
def r9_federated_query(g: Graph):
    return _regions(g).query("supplier", 30)


@query(sql("SELECT (row_number() OVER (ORDER BY c, k, id))::INT AS pos, child, id FROM (SELECT 0 AS c, '' AS child, s_suppkey AS k, 'supplier:' || s_suppkey AS id FROM supplier UNION ALL SELECT 1, 'a', c_custkey, 'a' || chr(31) || 'customer:' || c_custkey FROM customer) ORDER BY pos LIMIT 400"))
def o3_concatenated(spark, sf_dir: str):
    t = relational.tables(spark, sf_dir)
    root = t("supplier").select(F.col("s_suppkey").alias("rank"), F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"))
    one = t("customer").select(F.col("c_custkey").alias("rank"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    return federation.concatenated(root, {"a": one}, 400)


@query("SELECT DISTINCT c.r_name || chr(31) || 'call:' || o_custkey AS src, s.r_name || chr(31) || 'rpc:grpc:supply.m' || l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN (SELECT * FROM nation JOIN region ON r_regionkey = n_regionkey) c ON c_nationkey = c.n_nationkey JOIN supplier ON s_suppkey = l_suppkey JOIN (SELECT * FROM nation JOIN region ON r_regionkey = n_regionkey) s ON s_nationkey = s.n_nationkey WHERE c.r_name <> s.r_name")
def r2_grpc_edges(spark, sf_dir: str):
    t = relational.tables(spark, sf_dir)
    dim = F.broadcast(t("nation").join(t("region"), F.expr("n_regionkey = r_regionkey")).select("n_nationkey", "r_name"))
    own = t("supplier").join(dim, F.expr("s_nationkey = n_nationkey")).select(F.col("r_name").alias("child"), F.concat(F.lit("rpc:grpc:supply.m"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("rpc").alias("type"), F.lit("grpc").alias("protocol"), F.lit("inbound").alias("boundary_kind"))
    use = t("orders").join(t("lineitem"), F.expr("o_orderkey = l_orderkey")).join(t("customer"), F.expr("o_custkey = c_custkey")).join(dim, F.expr("c_nationkey = n_nationkey"))
    calls = use.select(F.col("r_name").alias("child"), F.concat(F.lit("call:"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("rpc:grpc:shop.Supply.m"), F.col("l_suppkey").cast("string")).alias("dst"), F.lit("invokes").alias("type"))
    return federation.grpc_edges(own, calls).select("src", "dst")


@query("SELECT 'web' || chr(31) || 'c' || c_custkey AS src, replace(lower(r_name), ' ', '-') || chr(31) || 'h' || s_suppkey AS dst FROM customer JOIN supplier ON s_suppkey = c_custkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def r3_http_edges(spark, sf_dir: str):
    t = relational.tables(spark, sf_dir)
    dim = t("nation").join(t("region"), F.expr("n_regionkey = r_regionkey"))
    s = t("supplier").join(dim, F.expr("s_nationkey = n_nationkey")).select(F.translate(F.lower("r_name"), " ", "-").alias("host"), F.col("s_suppkey").cast("string").alias("k"))
    serve = s.select(F.col("host").alias("child"), F.concat(F.lit("h"), "k").alias("id"), F.lit("route").alias("type"), F.concat(F.lit("GET /s/"), "k").alias("label"), F.lit("http").alias("protocol"), F.lit("inbound").alias("boundary_kind"))
    call = s.join(t("customer"), F.expr("cast(c_custkey AS string) = k")).select(F.lit("web").alias("child"), F.concat(F.lit("c"), "k").alias("id"), F.lit("rpc").alias("type"), F.concat(F.lit("GET http://"), F.upper("host"), F.lit(":80/s/"), "k", F.lit("?x=1")).alias("label"), F.lit("http").alias("protocol"), F.lit("outbound").alias("boundary_kind"))
    return federation.http_edges(serve.union(call)).select("src", "dst")


@query("SELECT 'repo:' || lower(a.r_name) AS src, 'repo:' || lower(b.r_name) AS dst FROM region a JOIN region b ON b.r_regionkey = a.r_regionkey + 1")
def r4_compose_edges(spark, sf_dir: str):
    r = relational.tables(spark, sf_dir)("region").withColumn("c", F.lower("r_name"))
    nxt = r.select((F.col("r_regionkey") - 1).alias("k"), F.col("c").alias("n"))
    s = r.join(nxt, F.expr("r_regionkey = k"), "left").select(F.lit("root").alias("child"), F.col("c").alias("service"), F.concat(F.lit("reg.io/x/"), "c", F.lit(":1.2")).alias("image"), F.when(F.col("n").isNotNull(), F.array("n")).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    return federation.compose_edges(s, r.select(F.col("c").alias("child"))).select("src", "dst")


@query(sql("SELECT a.layer || chr(31) || a.id AS src, b.layer || chr(31) || b.id AS dst FROM n a JOIN n b ON a.type = 'service' AND b.type = 'deploy' AND b.label = 'NATION_3' AND a.layer <> b.layer"))
def r5_import_edges(g: Graph):
    n = _child_nodes(g).withColumn("type", F.regexp_replace("type", "^deploy$", "package")).withColumn("imports_from", F.when(F.col("type") == "service", F.array(F.lit("NATION_3.core"))))
    return federation.import_edges(n.select("child", "id", "type", "label", "imports_from")).select("src", "dst")


@query("SELECT n_name AS child, CASE WHEN n_nationkey % 5 = 0 THEN 'added' WHEN n_nationkey % 5 = 1 THEN 'removed' WHEN n_nationkey % 5 = 2 THEN 'changed' ELSE 'stable' END AS change FROM nation")
def r6_drift(spark, sf_dir: str):
    n = relational.tables(spark, sf_dir)("nation").withColumn("m", F.col("n_nationkey") % 5)
    led = lambda df, sha: df.select(F.col("n_name").alias("child"), sha.alias("graph_sha256"), F.lit("h").alias("head_sha"))
    return federation.drift(led(n.filter("m <> 0"), F.lit("a")), led(n.filter("m <> 1"), F.when(F.col("m") == 2, "b").otherwise("a")))


@query("SELECT 'repo:' || lower(r_name) AS id, lower(r_name) AS label FROM region WHERE r_regionkey <> 2")
def r8_root_nodes(spark, sf_dir: str):
    r = relational.tables(spark, sf_dir)("region")
    led = r.select(F.lower("r_name").alias("child"), F.when(F.col("r_regionkey") == 2, "missing").otherwise("present").alias("status"), F.concat(F.lit("x/"), F.lower("r_name")).alias("path"), F.create_map(F.lit("a"), F.lit("b")).alias("tags"))
    return federation.root_nodes(led).select("id", "label")


# --- agent assets: parts as skills, suppliers as agents, customers as commands ---


def assets(spark, sf_dir: str) -> Graph:
    t = relational.tables(spark, sf_dir)
    bag = lambda **x: F.to_json(F.struct(*[v.alias(k) for k, v in sorted(x.items())]))
    how = F.lit("agent_graph_static")
    n = t("part").select(F.concat(F.lit("skill:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("skill").alias("type"), F.col("p_name").alias("label"), F.col("p_type").alias("description"), bag(name=F.col("p_name"), platform=F.col("p_brand"), source_strategy=how).alias("props_json"), how.alias("source_strategy"))
    a = t("supplier").select(F.concat(F.lit("agent:"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("agent").alias("type"), F.col("s_name").alias("label"), F.concat(F.lit("supplies parts in nation "), F.col("s_nationkey").cast("string")).alias("description"), bag(name=F.col("s_name"), source_strategy=how, status=F.when(F.col("s_acctbal") < 0, "referenced")).alias("props_json"), how.alias("source_strategy"))
    c = t("customer").select(F.concat(F.lit("command:"), F.col("c_custkey").cast("string")).alias("id"), F.lit("command").alias("type"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("description"), bag(name=F.col("c_name"), source_strategy=how).alias("props_json"), how.alias("source_strategy"))
    li = t("lineitem")
    e = li.filter("l_quantity > 40").select(F.concat(F.lit("agent:"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("skill:"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("uses_skill").alias("type"), F.lit("{}").alias("props_json")).distinct()
    o = li.join(t("orders"), F.expr("l_orderkey = o_orderkey")).filter("l_quantity > 45").select(F.concat(F.lit("command:"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("agent:"), F.col("l_suppkey").cast("string")).alias("dst"), F.lit("invokes_agent").alias("type"), F.lit("{}").alias("props_json")).distinct()
    return Graph(fill(n, schema.NODE).unionByName(fill(a, schema.NODE)).unionByName(fill(c, schema.NODE)), e.union(o))


@query("SELECT 'skill:' || p_partkey AS id, 'skill' AS type, p_name AS name, p_brand AS platform FROM part UNION ALL SELECT 'agent:' || s_suppkey, 'agent', s_name, 'generic' FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT 'command:' || c_custkey, 'command', c_name, 'generic' FROM customer")
def p10_asset_entries(spark, sf_dir: str):
    return agents.entries(assets(spark, sf_dir)).select("id", "type", "name", "platform")


@query("SELECT edge_type, direction, count(*) AS n FROM (SELECT DISTINCT 'uses_skill' AS edge_type, 'out' AS direction, l_partkey AS k FROM lineitem WHERE l_quantity > 40 AND l_suppkey = 5 UNION ALL SELECT DISTINCT 'invokes_agent', 'in', o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45 AND l_suppkey = 5) GROUP BY 1, 2")
def ag1_explain(spark, sf_dir: str):
    g = assets(spark, sf_dir)
    return agents.relations(g, agents.resolve(g, "agent:5")).groupBy("edge_type", "direction").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT 'skill:' || l_partkey AS id, 5.0::DOUBLE AS weight FROM lineitem WHERE l_quantity > 40 AND l_suppkey = 5 UNION ALL SELECT DISTINCT 'command:' || o_custkey, 5.0 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45 AND l_suppkey = 5 UNION ALL SELECT 'agent:' || s.s_suppkey, 2.0 FROM supplier s JOIN supplier t ON t.s_suppkey = 5 AND s.s_suppkey <> 5 AND s.s_acctbal >= 0 AND s.s_nationkey = t.s_nationkey")
def ag2_impact(spark, sf_dir: str):
    return agents.impact(assets(spark, sf_dir), "agent:5")


@query("SELECT ['skill:' || p_partkey] AS node_ids FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def ag3_unused_skills(spark, sf_dir: str):
    return agents.audit(assets(spark, sf_dir)).filter("code = 'unused_skill'").select("node_ids")


@query()
def t14_plan(spark, sf_dir: str):
    return agents.plan(assets(spark, sf_dir), "Please update the economy supplier parts")


@query(sql("SELECT id FROM n WHERE contains(lower(concat_ws(chr(10), id, label, type, file, description)), 'economy') AND contains(lower(concat_ws(chr(10), id, label, type, file, description)), 'part')"))
def t15_slice(g: Graph):
    return agents.slice_query(g, "economy part")


# --- export, enrichment, files, streams ---


@query()
def x5_overview(g: Graph):
    return export.overview(g)[0]


@query(sql("SELECT label, type, near FROM (SELECT n.label, e.type, m.label AS near FROM e JOIN n ON n.id = e.src JOIN n m ON m.id = e.dst WHERE e.src IN (SELECT id FROM reach) AND e.dst IN (SELECT id FROM reach))", _reach("SELECT 'supplier:9' AS id", 1, _BOTH)))
def x1_mermaid(g: Graph):
    """The lines of a diagram around a node, read back."""
    text = export.export(g, "mermaid", "supplier:9", 1)
    names = dict(re.findall(r'^\s*(\w+)\[+"?(.*?)"?\]+$', text, re.M))
    rows = [(names[a], kind, names[b]) for a, kind, b in re.findall(r'^\s*(\w+) --+>\|"?(.*?)"?\| (\w+)$', text, re.M)]
    return g.nodes.sparkSession.createDataFrame(rows, "label string, type string, near string")


@query()
def en1_fingerprints(g: Graph):
    return enrich.fingerprints(g).select("id", "fingerprint")


@query("SELECT url AS file, sha256(html) AS sha FROM pages")
def di3_hashes(spark, sf_dir: str):
    return files.hashes(relational.tables(spark, sf_dir)("pages").select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content"))).select(F.col("path").alias("file"), "sha")


@query("WITH s AS (SELECT user_id, ts, value, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b, event_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS start, list_sort(list(DISTINCT event_type)) AS paths, count(*) AS n FROM g GROUP BY user_id, k")
def w1_bursts(spark, sf_dir: str):
    e = relational.tables(spark, sf_dir)("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("path"))
    return watch.bursts(e, "6 hours", keys=("user_id",)).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "paths", "n")


from . import building  # noqa: E402, F401  registers further queries
