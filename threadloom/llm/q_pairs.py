"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import pairs
from threadloom.llm.records import newest_samples, turn_texts
from threadloom.stages import materialize


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = materialize(newest_samples(spark.read.parquet(f"{sf_dir}/samples.parquet"), "messages"), "samples")
    return pairs.labelled_pairs(samples, samples.select(F.explode(turn_texts("messages")).alias("text")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every broken pair with its defect."""
    return _labelled(spark, sf_dir).filter("defect is not null")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by defect; sound pairs under ``sound``."""
    return _labelled(spark, sf_dir).groupBy(F.coalesce("defect", F.lit("sound")).alias("defect")).agg(
        F.count("*").alias("pairs"), F.countDistinct("sample_no").alias("samples")
    )


QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
ORACLES: dict[str, str] = {}
