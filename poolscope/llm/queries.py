"""Registered queries of the training-data operators and their DuckDB checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from poolscope.llm import (
    decontamination, jaccard, language_model, lexical, lines, mixing, neighbours, periodic, quality, substrings, tokens,
    toxicity, urls,
)
from poolscope.llm.checks import ORACLE_SQL, URL_RULES
from poolscope.llm.workers import reachable

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixture(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.kept_digests(table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, neighbours.every_twentieth(vectors))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.without_boilerplate(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(table(spark, sf_dir, "documents"))


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.written_digests(table(spark, sf_dir, "documents"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judged(table(spark, sf_dir, "pages"), rules)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_repeats(table(spark, sf_dir, "documents"))
    return periodic.digests(periodic.periodic_runs(docs))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _ready(query: Query) -> Query:
    return lambda spark, sf_dir: query(reachable(spark), sf_dir)


def queries() -> dict[str, Query]:
    named = (
        op1_source_mixing, op2_jaccard_join, op3_substring_dedup, op4_nearest_neighbours, op5_line_dedup,
        op6_toxicity, op7_quality, op8_decontamination, op9_language_model, op10_token_file,
        op11_url_filters, op12_periodic_runs, op13_lexical_search, pipeline,
    )
    return {q.__name__: _ready(q) for q in named}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
