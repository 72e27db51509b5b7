"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST_ROWS = 500_000


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in spark.checkpoint.dir, which survives the loss of executors; a temporary folder stands in where Spark runs on one machine and the setting is unset."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_dir(spark: SparkSession) -> str:
    sc, at = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not at and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="graphloom-"))
    return at or sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    at = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def numbered(df: DataFrame, order: list, name: str = "pos", add: Column | None = None) -> DataFrame:
    """df in a total order with its place from 1 (or the running sum of `add`) as `name`.

    Range partitions number their own rows; what lies before each comes from a table of one row a partition.
    """
    line = cut(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    one = F.lit(1).cast("bigint") if add is None else add
    before = line.groupBy(part.alias("__p")).agg(F.sum(one).alias("__n"))
    before = before.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__b"))
    own = F.col("__m") - F.shiftleft(part, 33) + 1 if add is None else F.sum(add).over(Window.partitionBy("__p").orderBy("__m"))
    return line.withColumn("__p", part).withColumn(name, own).join(F.broadcast(before), "__p").withColumn(name, F.col(name) + F.col("__b")).drop("__p", "__m", "__b")


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, sent to every executor where its number of rows allows that."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def within(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of df whose `on` is one of ids.

    Not a left semi join: Spark pushes that into each branch of a union below df, where all of ids is
    joined again. Ids are hashed, as they are the smaller side and need no order.
    """
    return df.join(ids.select(on).distinct().hint("shuffle_hash"), on).select(*df.columns)


def without(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of df whose `on` is none of ids; no left anti join, for the same reason."""
    mark = ids.select(on).distinct().withColumn("__in", F.lit(True)).hint("shuffle_hash")
    return df.join(mark, on, "left").filter("__in IS NULL").select(*df.columns)
