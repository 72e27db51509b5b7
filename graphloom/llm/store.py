"""Tables and folders that jobs share between stages."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; set to a new temporary one only where it is unset and Spark runs on one machine."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = sc.getCheckpointDir()
        if not at:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
            at = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; Spark deletes it when nothing refers to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def local_path(uri: str) -> str:
    return uri[5:] if uri.startswith("file:") and not uri.startswith("file://") else uri[7:] if uri.startswith("file://") else uri


def mounted(uri: str) -> str:
    """uri as a plain path; only folders that every machine mounts will do, as tasks map files in them."""
    if re.match(r"(?!file:)[A-Za-z][A-Za-z0-9+.-]*:", uri):
        raise ValueError(f"{uri} is no mounted folder; spark.checkpoint.dir must be one for this operator")
    return local_path(uri)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
