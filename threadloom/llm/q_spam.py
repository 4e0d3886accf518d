"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import spam
from threadloom.stages import materialize


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("host"), "text")
    return spam.smoothed(materialize(spam.tree_scored(materialize(spam.measured(pages), "pages")), "scores"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are keyword-stuffed or link-list pages."""
    return _scored(spark, sf_dir).filter("score >= 0.5").select("doc_id").distinct()


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the trees' score and the score smoothed by its source."""
    return _scored(spark, sf_dir).select("doc_id", F.col("host").alias("source"), "tree_score", "score")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and spam pages by source."""
    return _scored(spark, sf_dir).groupBy(F.col("host").alias("source")).agg(
        F.count("*").alias("documents"), F.count_if(F.col("score") >= 0.5).alias("spam"), F.avg((F.col("score") >= 0.5).cast("int")).alias("spam_rate")
    )


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
ORACLES: dict[str, str] = {}
