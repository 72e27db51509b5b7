"""Documents to training tokens in five stages, each over all that the stage before it kept.

Every stage but the last returns the columns of documents. Null ids pass all stages but the
first's text rules; an empty table passes as one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import mixing, parity_join, pieces, quality_rules, store, suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the least id stays."""
    return parity_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first occurrence of each passage stays, later ones are cut out of their texts."""
    return suffix_dedup.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources draws it, within a budget of all tokens."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the ids of each text."""
    return pieces.encode(docs, keep=["doc_id", "source"])


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_passages), ("mixing", mix_sources), ("SentencePiece", encode)]

#: SQL has no suffix arrays and no SentencePiece; tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again.

    What a stage wrote is deleted once the next one is through, the last one's when the driver ends.
    """
    at = f"{store.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = store.table(spark, sf_dir, "documents")
    folder = spark._jvm.org.apache.hadoop.fs.Path
    files = folder(at).getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(folder(at))
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        if i:
            files.delete(folder(f"{at}/{i - 1}"), True)
    return docs
