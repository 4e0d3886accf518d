"""Queries of problems 6, 7 and 8."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm import mixing, packing
from threadloom.llm.languages import declared_code, detect
from threadloom.llm.records import board_code, newest_samples
from threadloom.llm.tokens import TOKENIZER, with_token_counts
from threadloom.operators.joins import lookup
from threadloom.stages import materialize


@F.pandas_udf(T.StringType())
def _language(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else detect("\n".join(x for x in t if x)))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_table, record_id, source, board, declared, texts) of all samples and documents.

    The source of a sample is the board of its thread as in threads, else its own board; boards are looked up by their
    spelling-free codes. A document's source is its source."""
    threads = spark.read.parquet(f"{sf_dir}/threads.parquet")
    thread_board = threads.groupBy("thread_id").agg(F.max(F.struct("fetched_at", "board"))["board"].alias("thread_board"))
    contents = F.transform("messages", lambda m: m["content"])
    samples = newest_samples(
        spark.read.parquet(f"{sf_dir}/samples.parquet"),
        F.col("metadata.thread_id").alias("thread_id"),
        F.col("metadata.board").alias("own_board"),
        declared_code("metadata.lang").alias("declared"),
        contents.alias("texts"),
    )
    samples = lookup(samples, thread_board, "thread_id", "sample_no")
    board = board_code(F.coalesce("thread_board", "own_board"))
    s = samples.select(F.lit("samples").alias("record_table"), F.col("sample_no").alias("record_id"), board.alias("source"), board.alias("board"), "declared", "texts")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    d = documents.select(
        F.lit("documents").alias("record_table"), F.col("doc_id").alias("record_id"), "source", board_code("board").alias("board"),
        declared_code("lang").alias("declared"), F.array("text").alias("texts"),
    )
    return s.unionByName(d)


def _counted(spark: SparkSession, sf_dir: str, path: str = TOKENIZER) -> DataFrame:
    found = _records(spark, sf_dir).withColumn("found", _language("texts"))
    counted = with_token_counts(found, "texts", path)
    domains = spark.read.parquet(f"{sf_dir}/boards.parquet").select(board_code("board").alias("board"), "board_domain").dropDuplicates(["board"])
    return counted.join(domains, "board", "left").select(
        "record_table", "record_id", "source", F.coalesce("found", "declared", F.lit("und")).alias("lang"), "board_domain", "tokens"
    )


def p6_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and tokens by source, language and board domain, and by each of them alone (``slice`` names the grouping)."""
    rows = _counted(spark, sf_dir)
    fine = rows.groupBy("record_table", "source", "lang", "board_domain").agg(F.count("*").alias("r"), F.sum("tokens").alias("t"))
    bits = F.grouping_id()
    return (
        fine.groupingSets(
            [["record_table", "source", "lang", "board_domain"], ["record_table", "source"], ["lang"], ["board_domain"], []],
            "record_table", "source", "lang", "board_domain",
        )
        .agg(F.sum("r").alias("records"), F.sum("t").alias("tokens"), bits.alias("g"))
        .select(
            F.element_at(F.create_map(*(x for k, v in ((0, "all"), (3, "source"), (13, "lang"), (14, "domain"), (15, "total")) for x in (F.lit(k), F.lit(v)))), F.col("g").cast("int")).alias("slice"),
            "record_table", "source", "lang", "board_domain", "records", "tokens",
        )
    )


def p6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact number of tokens of every sample and document."""
    return _counted(spark, sf_dir)


def document_tokens(spark: SparkSession, sf_dir: str, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of all documents, written once."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = documents.select("doc_id", "source", F.array("text").alias("texts"))
    return materialize(with_token_counts(rows, "texts", path), "tokens")


def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    return {r["bin_kind"]: r["capacity_tokens"] for r in spark.read.parquet(f"{sf_dir}/bin_sizes.parquet").collect()}


def p7_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document (or piece of a document above the largest capacity) with its container and step group."""
    capacities = _capacities(spark, sf_dir)
    parts = packing.pieces(document_tokens(spark, sf_dir), max(capacities.values()))
    return packing.pack(parts, capacities)


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of their room that is used, by kind; the spread of tokens over step groups."""
    capacities = _capacities(spark, sf_dir)
    sizes = spark.createDataFrame(sorted(capacities.items()), "bin_kind string, capacity_tokens int")
    bins = p7_bins(spark, sf_dir).groupBy("bin_kind", "step_no", "bin_no").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    steps = bins.groupBy("bin_kind", "step_no").agg(F.sum("t").alias("st"), F.count("*").alias("b"), F.sum("n").alias("n"), F.max("t").alias("mt"))
    return (
        steps.groupBy("bin_kind")
        .agg(
            F.sum("b").alias("bins"), F.sum("n").alias("items"), F.sum("st").alias("tokens"), F.max("mt").alias("fullest"),
            F.count("*").alias("steps"), (F.max("st") - F.min("st")).alias("step_spread"),
        )
        .join(sizes, "bin_kind")
        .withColumn("used_share", F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")))
    )


def _targets(spark: SparkSession, sf_dir: str) -> dict[str, mixing.Target]:
    rows = spark.read.parquet(f"{sf_dir}/mix_targets.parquet").collect()
    return {r["source"]: mixing.Target(r["target_share"], r["max_repeats"]) for r in rows}


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: every copy of a document that is in it, in its order."""
    return mixing.mix(document_tokens(spark, sf_dir), _targets(spark, sf_dir))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of the tokens of each source, and how often its documents are used; what all its documents hold
    (``source_tokens``), the reached size of the mixture and whether this source limits it."""
    targets = spark.read.parquet(f"{sf_dir}/mix_targets.parquet").select("source", "target_share", "max_repeats")
    documents, by_source = document_tokens(spark, sf_dir), _targets(spark, sf_dir)
    held = documents.filter(F.col("source").isin(list(by_source))).groupBy("source").agg(F.sum("tokens").alias("t")).collect()  # one row per target
    tokens = {r["source"]: r["t"] for r in held}
    limit = mixing.limiting_source(tokens, by_source)
    got = mixing.mix(documents, by_source).groupBy("source").agg(
        F.sum("tokens").alias("tokens"), F.count("*").alias("copies"), F.max("copy_no").alias("most_repeats"), F.countDistinct("doc_id").alias("documents")
    )
    rows = targets.join(got, "source", "left").fillna(0, ["tokens", "copies", "most_repeats", "documents"])
    rows = rows.join(spark.createDataFrame(list(tokens.items()), "source string, source_tokens long"), "source", "left").fillna(0, ["source_tokens"])
    whole = F.expr("sum(tokens) over ()")
    return rows.withColumns({
        "reached_share": F.try_divide("tokens", whole), "mixture_tokens": whole, "limits_size": F.coalesce(F.col("source") == F.lit(limit), F.lit(False)),
    })


QUERIES = {
    "p6_budget": p6_budget, "p6_tokens": p6_tokens, "p7_bins": p7_bins, "p7_report": p7_report,
    "p8_mixture": p8_mixture, "p8_shares": p8_shares,
}
ORACLES: dict[str, str] = {}
