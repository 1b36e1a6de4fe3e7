"""The training-data pipeline: each stage works on the documents its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolscope.llm import decontamination, jaccard, mixing, quality, tokens
from poolscope.llm.tables import fresh_path, join_by_size, stored
from poolscope.llm.workers import reachable


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents the quality classifier rejects."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


ROW = "pipeline_row_hash"


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the one of smallest id.

    Rows are told apart by id and text together (a 64-bit hash), so different texts under one id are
    judged each by itself; where several of them share the group's smallest id, that of the least hash
    stays. Of repeated rows of one id and text one stays. Rows without an id stay and
    link nothing, as do rows without words, but for repeats. Empty table: empty result.
    """
    hashed = docs.withColumn(ROW, F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    groups = jaccard.jaccard_components(hashed.select(F.col(ROW).alias("doc_id"), "text")).filter("doc_id is not null")
    groups = groups.groupBy(F.col("doc_id").alias(ROW), "component_id").agg(F.count("*").alias("rows"))
    ids = hashed.filter(f"{ROW} is not null").groupBy(ROW).agg(F.min("doc_id").alias("id"))
    groups = stored(groups.join(ids, ROW), "pipeline-groups")
    # A row per group, which any number of copies reaches by partial aggregation.
    stays = groups.groupBy("component_id").agg(F.min(F.struct("id", ROW)).alias("least")).select(f"least.{ROW}")
    stays = stored(stays, "pipeline-stays")
    gone = stored(groups.join(stays, ROW, "left_anti").select(ROW), "pipeline-copies")
    kept = join_by_size(hashed, gone, ROW, "left_anti")
    again = stored(groups.filter("rows > 1").join(stays, ROW, "left_semi").select(ROW), "pipeline-repeated")
    if again.isEmpty():
        return kept.drop(ROW)
    once = join_by_size(kept, again, ROW, "left_semi").dropDuplicates([ROW])
    return join_by_size(kept, again, ROW, "left_anti").unionByName(once).drop(ROW)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a passage of the benchmark."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources reach their target weights."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the bit-packed token file and return what it holds of each document."""
    return tokens.written_digests(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _ready(stage: Stage) -> Stage:
    return lambda spark, docs, sf_dir: stage(reachable(spark), docs, sf_dir)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", _ready(quality_stage)),
    ("n-gram Jaccard join", _ready(jaccard_stage)),
    ("benchmark decontamination", _ready(decontamination_stage)),
    ("mixing sources to target weights", _ready(mixing_stage)),
    ("token-ID / binary output", _ready(token_stage)),
]

#: The classifier and the near copies have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, "pipeline-" + name.split(" ")[0])
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
