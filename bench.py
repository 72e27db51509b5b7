"""Times the headline graph queries; prints one line of JSON."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from pyspark.sql import SparkSession

    from graphloom.model import load, save
    from graphloom.operators import build, retrieve, stats, traverse
    from graphloom.sources import relational

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    out = tempfile.mkdtemp(prefix="graphloom-bench-")
    took: dict[str, float] = {}

    def timed(name: str, f) -> None:
        began = time.perf_counter()
        f()
        took[name] = round(time.perf_counter() - began, 3)

    def drain(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    try:
        timed("build_graph", lambda: save(relational.graph(spark, sf_dir), out))
        g = load(spark, out)
        timed("query_first", lambda: drain(retrieve.query(g, "economy", 5)))
        timed("query_again", lambda: drain(retrieve.query(g, "economy", 5)))
        timed("query_or_fallback", lambda: drain(retrieve.query(g, "supplier economy orders", 20)))
        timed("impact", lambda: drain(traverse.impact(g, "supplier:1", 3)))
        timed("k_hop", lambda: drain(traverse.bfs(g, g.nodes.filter("id = 'page:4'").select("id"), 2)))
        timed("context", lambda: drain(traverse.context(g, "order:1")))
        timed("degree", lambda: drain(traverse.degree(g)))
        timed("counts", lambda: drain(stats.counts(g)))
        timed("dedup_edges", lambda: drain(build.dedup_edges(g)))
    finally:
        shutil.rmtree(out, ignore_errors=True)
    print(json.dumps({"metric": "graph_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
