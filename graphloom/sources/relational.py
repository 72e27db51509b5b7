"""A graph of relational, event, text and web tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schema
from ..model import Graph, fill


def tables(spark: SparkSession, sf_dir: str):
    return lambda name: spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _id(prefix: str, key: str):
    return F.concat(F.lit(prefix + ":"), F.col(key).cast("string"))


def _edge(df: DataFrame, src, dst, kind: str) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), F.lit("{}").alias("props_json"))


def _steps(events: DataFrame) -> DataFrame:
    """Each event of a user with the type of the next."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events.select("user_id", "event_type", F.lead("event_type").over(own).alias("then"))
    at = F.concat(F.col("user_id").cast("string"), F.lit("."))
    return e.withColumn("src", F.concat(F.lit("symbol:ev:"), at, F.col("event_type"))).withColumn("dst", F.when(F.col("then") == "error", F.lit("symbol:unresolved:error")).otherwise(F.concat(F.lit("symbol:ev:"), at, F.col("then"))))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    region, nation = t("region"), t("nation").join(F.broadcast(t("region")), F.expr("n_regionkey = r_regionkey"))
    dim = F.broadcast(nation.select("n_nationkey", "n_name", "r_name"))  # a fixed table of 25 nations
    parts = [
        region.select(_id("region", "r_regionkey").alias("id"), F.lit("boundary").alias("type"), F.col("r_name").alias("label")),
        nation.select(_id("nation", "n_nationkey").alias("id"), F.lit("deploy").alias("type"), F.col("n_name").alias("label"), F.col("r_name").alias("layer")),
        t("supplier").join(dim, F.expr("s_nationkey = n_nationkey")).select(_id("supplier", "s_suppkey").alias("id"), F.lit("service").alias("type"), F.col("s_name").alias("label"), F.col("r_name").alias("layer"), F.concat(F.lit("supplier/"), F.col("n_name"), F.lit(".tbl")).alias("file"), F.expr("CASE WHEN s_acctbal >= 5000 THEN 'canonical' WHEN s_acctbal >= 0 THEN 'derived' ELSE 'manual' END").alias("authority")),
        t("customer").join(dim, F.expr("c_nationkey = n_nationkey")).select(_id("customer", "c_custkey").alias("id"), F.lit("entity").alias("type"), F.col("c_name").alias("label"), F.col("r_name").alias("layer"), F.col("c_mktsegment").alias("description")),
        t("orders").select(_id("order", "o_orderkey").alias("id"), F.lit("rpc").alias("type"), F.concat(F.lit("POST /orders/"), F.col("o_orderkey").cast("string")).alias("label"), F.lit("http").alias("protocol"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'inbound' WHEN 'O' THEN 'outbound' ELSE 'internal' END").alias("boundary_kind"), F.expr("CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'definite' WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'inferred' ELSE 'speculative' END").alias("confidence")),
        t("part").select(_id("part", "p_partkey").alias("id"), F.lit("contract").alias("type"), F.col("p_name").alias("label"), F.concat("p_brand", F.lit(" "), "p_type").alias("description"), F.array("p_type").alias("exports")),
        t("documents").select(_id("doc", "doc_id").alias("id"), F.lit("doc").alias("type"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("label"), F.lit("guide").alias("doc_kind"), F.col("lang").alias("language"), F.col("text").alias("description")),
        t("documents").select(F.concat(F.lit("src:"), F.col("source")).alias("id"), F.lit("package").alias("type"), F.col("source").alias("label")).distinct(),
        t("events").select(F.concat(F.lit("symbol:ev:"), F.col("user_id").cast("string"), F.lit("."), F.col("event_type")).alias("id"), F.lit("symbol").alias("type"), F.concat(F.col("user_id").cast("string"), F.lit("."), F.col("event_type")).alias("label")).distinct().withColumn("qualname", F.col("label")),
        t("events").filter("event_type = 'error'").select(F.lit("symbol:unresolved:error").alias("id"), F.lit("symbol").alias("type"), F.lit("error").alias("label"), F.lit("error").alias("qualname"), F.lit(False).alias("resolved")).distinct(),
        t("events").select(F.concat(F.lit("channel:"), F.col("event_type")).alias("id"), F.lit("channel").alias("type"), F.col("event_type").alias("label"), F.lit("event").alias("protocol")).distinct(),
        t("pages").select(_id("page", "page_id").alias("id"), F.lit("route").alias("type"), F.col("url").alias("label"), F.lit("http").alias("protocol")),
    ]
    out = None
    for p in parts:
        p = fill(p, schema.NODE)
        out = p if out is None else out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    line, pages = t("lineitem"), t("pages")
    steps = _steps(t("events"))
    hrefs = F.expr("array_distinct(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1))")
    links = pages.crossJoin(F.broadcast(pages.agg(F.count("*").alias("n")))).select("page_id", "n", F.posexplode(hrefs).alias("i", "href"))
    parts = [
        _edge(t("nation"), _id("region", "n_regionkey"), _id("nation", "n_nationkey"), "contains"),
        _edge(t("supplier"), _id("nation", "s_nationkey"), _id("supplier", "s_suppkey"), "contains"),
        _edge(t("customer"), _id("nation", "c_nationkey"), _id("customer", "c_custkey"), "contains"),
        _edge(t("orders"), _id("customer", "o_custkey"), _id("order", "o_orderkey"), "invokes"),
        _edge(line, _id("order", "l_orderkey"), _id("part", "l_partkey"), "consumes"),
        _edge(line.select("l_suppkey", "l_partkey").distinct(), _id("supplier", "l_suppkey"), _id("part", "l_partkey"), "produces"),
        _edge(line, _id("order", "l_orderkey"), _id("supplier", "l_suppkey"), "depends_on"),
        _edge(t("documents"), F.concat(F.lit("src:"), F.col("source")), _id("doc", "doc_id"), "contains"),
        _edge(steps.filter("then IS NOT NULL"), F.col("src"), F.col("dst"), "calls"),
        _edge(steps, F.col("src"), F.concat(F.lit("channel:"), F.col("event_type")), "produces"),
        _edge(links, _id("page", "page_id"), F.concat(F.lit("page:"), F.expr("cast((page_id * 7 + i) % n AS string)")), "references_file"),
    ]
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir), {"version": schema.CONTRACT_VERSION})


def _n(columns: str, source: str) -> str:
    given = dict(x.rsplit(" AS ", 1)[::-1] for x in columns.split("; "))
    names = ["id", "type", "label", "file", "qualname", "language", "description", "protocol", "boundary_kind", "doc_kind", "layer", "authority", "confidence"]
    return "SELECT " + ", ".join(f"{given.get(c, 'NULL::VARCHAR')} AS {c}" for c in names) + f", {given.get('exports', 'NULL::VARCHAR[]')} AS exports, {given.get('resolved', 'NULL::BOOLEAN')} AS resolved FROM {source}"


SQL = "dim AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey), steps AS (SELECT 'symbol:ev:' || user_id || '.' || event_type AS src, event_type, CASE WHEN nxt = 'error' THEN 'symbol:unresolved:error' ELSE 'symbol:ev:' || user_id || '.' || nxt END AS dst FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)), n AS (" + " UNION ALL ".join([
    _n("'region:' || r_regionkey AS id; 'boundary' AS type; r_name AS label", "region"),
    _n("'nation:' || n_nationkey AS id; 'deploy' AS type; n_name AS label; r_name AS layer", "dim"),
    _n("'supplier:' || s_suppkey AS id; 'service' AS type; s_name AS label; r_name AS layer; 'supplier/' || n_name || '.tbl' AS file; CASE WHEN s_acctbal >= 5000 THEN 'canonical' WHEN s_acctbal >= 0 THEN 'derived' ELSE 'manual' END AS authority", "supplier JOIN dim ON s_nationkey = n_nationkey"),
    _n("'customer:' || c_custkey AS id; 'entity' AS type; c_name AS label; r_name AS layer; c_mktsegment AS description", "customer JOIN dim ON c_nationkey = n_nationkey"),
    _n("'order:' || o_orderkey AS id; 'rpc' AS type; 'POST /orders/' || o_orderkey AS label; 'http' AS protocol; CASE o_orderstatus WHEN 'F' THEN 'inbound' WHEN 'O' THEN 'outbound' ELSE 'internal' END AS boundary_kind; CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'definite' WHEN o_orderpriority[1] = '3' THEN 'inferred' ELSE 'speculative' END AS confidence", "orders"),
    _n("'part:' || p_partkey AS id; 'contract' AS type; p_name AS label; p_brand || ' ' || p_type AS description; [p_type] AS exports", "part"),
    _n("'doc:' || doc_id AS id; 'doc' AS type; 'doc ' || doc_id AS label; 'guide' AS doc_kind; lang AS language; text AS description", "documents"),
    _n("'src:' || source AS id; 'package' AS type; source AS label", "(SELECT DISTINCT source FROM documents)"),
    _n("'symbol:ev:' || user_id || '.' || event_type AS id; 'symbol' AS type; user_id || '.' || event_type AS label; user_id || '.' || event_type AS qualname", "(SELECT DISTINCT user_id, event_type FROM events)"),
    _n("'symbol:unresolved:error' AS id; 'symbol' AS type; 'error' AS label; 'error' AS qualname; false AS resolved", "(SELECT DISTINCT event_type FROM events WHERE event_type = 'error')"),
    _n("'channel:' || event_type AS id; 'channel' AS type; event_type AS label; 'event' AS protocol", "(SELECT DISTINCT event_type FROM events)"),
    _n("'page:' || page_id AS id; 'route' AS type; url AS label; 'http' AS protocol", "pages"),
]) + "), e AS (" + " UNION ALL ".join([
    "SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'contains' AS type FROM nation",
    "SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'contains' FROM supplier",
    "SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains' FROM customer",
    "SELECT 'customer:' || o_custkey, 'order:' || o_orderkey, 'invokes' FROM orders",
    "SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'consumes' FROM lineitem",
    "SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'produces' FROM lineitem",
    "SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'depends_on' FROM lineitem",
    "SELECT 'src:' || source, 'doc:' || doc_id, 'contains' FROM documents",
    "SELECT src, dst, 'calls' FROM steps WHERE dst IS NOT NULL",
    "SELECT src, 'channel:' || event_type, 'produces' FROM steps",
    "SELECT 'page:' || page_id, 'page:' || ((page_id * 7 + i) % c), 'references_file' FROM (SELECT page_id, (SELECT count(*) FROM pages) AS c, unnest(range(len(list_distinct(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1))))) AS i FROM pages)",
]) + ")"


def sql(body: str, more: str = "") -> str:
    """A statement over the views n and e; more: further views."""
    return f"WITH RECURSIVE {SQL}{', ' + more if more else ''} {body}"
