"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import overlap as O
from threadloom.llm.records import board_code, newest_samples, turn_texts
from threadloom.stages import materialize


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = newest_samples(
        spark.read.parquet(f"{sf_dir}/samples.parquet"),
        turn_texts("messages").alias("texts"),
        "split_name",
        board_code("metadata.board").alias("board"),
    )
    side = F.when(F.col("split_name") == "train", False).when(F.col("split_name").isin("validation", "test"), True)
    return materialize(
        O.read_texts(one.select(F.col("sample_no").alias("record"), side.alias("eval"), F.col("board").alias("source"), "split_name", "texts")),
        "texts",
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a training and an evaluation sample with the same or nearly the same words."""
    texts = _texts(spark, sf_dir)
    pairs = O.overlap_pairs(texts, O.matching_classes(texts))
    return pairs.select(F.least("train", "eval").alias("sample_a"), F.greatest("train", "eval").alias("sample_b")).distinct()


def overlap_report(texts: DataFrame, matches: DataFrame) -> DataFrame:
    """(split_name, board, samples, overlapping, pairs) of ``texts`` and their written ``matches``, counted by class on either side."""
    sides = []
    for held, own, other in (("eval", "b", "a"), ("not eval", "a", "b")):
        rest = texts.filter(f"not ({held})").groupBy(F.col("cls").alias(other)).agg(F.count("*").alias("k"))
        per_class = matches.join(rest, other).groupBy(own).agg(F.sum("k").alias("partners"))
        rows = texts.filter(held).select(F.col("cls").alias(own), "record", F.col("source").alias("board"), "split_name")
        sides.append(rows.join(per_class, own, "left").select("split_name", "board", "partners"))
    return (
        sides[0].unionByName(sides[1])
        .groupBy("split_name", "board")
        .agg(
            F.count("*").alias("samples"),
            F.count("partners").alias("overlapping"),
            F.coalesce(F.sum("partners"), F.lit(0)).alias("pairs"),
        )
    )


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that occur on the other side (train, or validation and test) and the pairs, by split and board of the sample."""
    texts = _texts(spark, sf_dir)
    return overlap_report(texts, materialize(O.matching_classes(texts), "matches"))


QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
ORACLES: dict[str, str] = {}
