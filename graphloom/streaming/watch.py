"""A stream of file changes, gathered into bursts and merged into a graph."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.build import file_changes


def seconds(text: str) -> float:
    """`500ms`, `2s` or `1m` as seconds; a bare number is seconds."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(ms|s|m)?\s*", text)
    if not m:
        raise ValueError(f"no duration: {text!r}")
    return float(m[1]) * {"ms": 0.001, "s": 1, "m": 60, None: 1}[m[2]]


def bursts(changes: DataFrame, gap: str = "2 seconds", late: str = "10 seconds", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, start, end, paths) of changes (ts, path) with no more than gap between them. Of a stream, a burst is given once the watermark has passed its end."""
    src = changes.withWatermark("ts", late) if changes.isStreaming else changes
    own = keys or (F.when(F.col("path").isNull(), 1).otherwise(0).alias("named"),)  # a stream needs a key beside the window
    g = src.groupBy(*own, F.session_window("ts", gap).alias("w")).agg(F.array_sort(F.collect_set("path")).alias("paths"), F.count("*").alias("n"))
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "paths", "n")


def snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, change) of two listings (file, mtime, size)."""
    sign = F.concat_ws("/", F.col("mtime").cast("string"), F.col("size").cast("string"))
    return file_changes(before.select("file", sign.alias("sha")), after.select("file", sign.alias("sha")))


def watch(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, gap: str = "2 seconds", late: str = "10 seconds", once: bool = False):
    """Starts a query that hands each batch of closed bursts to apply(bursts, batch number); a batch that is run again after a failure has the same number."""
    w = bursts(changes, gap, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=gap)).start()
