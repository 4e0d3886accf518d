"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import abuse
from threadloom.llm.records import board_code, turn_texts
from threadloom.stages import materialize

#: Score from which a record counts as abusive: between 0.4 and 0.6 the errors in five folds over wordings are fewest.
THRESHOLD = 0.5


def _model(spark: SparkSession, sf_dir: str) -> abuse.Field:
    """The field fitted to the labelled examples, at most FIT_EXAMPLES of them by id."""
    rows = spark.read.parquet(f"{sf_dir}/abuse_examples.parquet").filter("text is not null and is_abusive in (0, 1)")
    chosen = rows.orderBy("example_id", "text").limit(abuse.FIT_EXAMPLES).collect()
    return abuse.fit([(r["text"], r["is_abusive"]) for r in chosen])


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_table, record_id, board, at, texts) of every row of posts and samples; posts take their board from the path."""
    posts = spark.read.parquet(f"{sf_dir}/posts.parquet").filter("post_id is not null")
    by_path = F.regexp_extract("source_path", r"([^/]+)/[^/]*$", 1)
    board = board_code(F.when(by_path != "", by_path).otherwise(F.col("board")))
    p = posts.select(F.lit("posts").alias("record_table"), F.col("post_id").alias("record_id"), board.alias("board"), F.col("fetched_at").alias("at"), F.array("text").alias("texts"))
    samples = spark.read.parquet(f"{sf_dir}/samples.parquet").filter("sample_no is not null")
    s = samples.select(
        F.lit("samples").alias("record_table"), F.col("sample_no").alias("record_id"), board_code("metadata.board").alias("board"),
        F.col("loaded_at").alias("at"), turn_texts("messages").alias("texts"),
    )
    return p.unionByName(s)


def _scored(spark: SparkSession, sf_dir: str, spans: bool = False) -> DataFrame:
    """One row per record, scored: of repeated rows the newest. Rows are scored first, so that no text is shuffled."""
    rows = abuse.scores(_records(spark, sf_dir), _model(spark, sf_dir), spans)
    kept = ["board", "score", *(["spans"] if spans else [])]
    newest = rows.groupBy("record_table", "record_id").agg(F.max(F.struct("at", *kept)).alias("r"))
    return newest.select("record_table", "record_id", *(F.col(f"r.{c}").alias(c) for c in kept))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts and samples with abusive, hateful or sexually explicit language."""
    return _scored(spark, sf_dir).filter(F.col("score") >= THRESHOLD).select("record_table", "record_id")


def p5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post and sample with its score and the offsets of its abusive spans."""
    return _scored(spark, sf_dir, spans=True)


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and abusive records by table and board."""
    hit = F.col("score") >= THRESHOLD
    return materialize(_scored(spark, sf_dir), "scores").groupBy("record_table", "board").agg(
        F.count("*").alias("records"), F.count_if(hit).alias("abusive"), F.avg(hit.cast("int")).alias("abusive_rate")
    )


QUERIES = {"p5_found": p5_found, "p5_scores": p5_scores, "p5_rates": p5_rates}
ORACLES: dict[str, str] = {}
