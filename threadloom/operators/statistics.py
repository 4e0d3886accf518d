"""Distributions and token statistics of splits, boards and whole corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(share: float) -> Column:
    """Place (from 0) of the nearest-rank percentile among ``count`` sorted values."""
    return F.greatest(F.lit(0), F.floor(F.col("count") * share + 0.999999) - 1)


def distribution(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float] | None = None) -> DataFrame:
    """count, min, max, mean, median (mean of the middle two), ``upper_median`` and nearest-rank percentiles per key.

    Values are counted before anything is sorted, so a key with any number of rows costs as many as it has distinct values.
    Null values are left out; ``keys`` may be empty.
    """
    shares = {"p90": 0.90, "p95": 0.95} if shares is None else shares
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    by = Window.partitionBy(*(keys or [F.lit(0)]))
    run = counts.withColumn("upto", F.sum("n").over(by.orderBy("v"))).withColumn("count", F.sum("n").over(by))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    middle, below = F.floor(F.col("count") / 2), F.floor((F.col("count") - 1) / 2)
    return run.groupBy(*keys).agg(
        F.max("count").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
        ((at(below) + at(middle)) / 2).alias("median"), at(middle).alias("upper_median"), at(F.least(F.col("count") - 1, F.floor(F.col("count") * 9 / 10))).alias("p90_upper"),
        *(at(nearest_rank(share)).alias(name) for name, share in shares.items()),
    )


def measured(samples: DataFrame, max_length: int) -> DataFrame:
    """Lengths of samples (split, board, context, response, segs, resp, ids): whole, context, answer and within the window."""
    context = F.aggregate(F.transform("segs", F.size), F.lit(0), lambda a, x: a + x)
    chars = F.aggregate(F.transform("context", F.length), F.lit(0), lambda a, x: a + x)
    return samples.select(
        "split", "board", context.alias("context_tokens"), F.size("resp").alias("response_tokens"), F.size("context").alias("context_texts"),
        chars.alias("context_chars"), F.length("response").alias("response_chars"), F.when(F.col("ids").isNotNull(), F.size("ids")).alias("window_tokens"),
        F.lit(max_length).alias("max_length"),
    ).withColumn("tokens", F.col("context_tokens") + F.col("response_tokens") + 1)


def token_statistics(rows: DataFrame) -> DataFrame:
    """Sums and counts of ``measured`` per split, per board and in all, in one pass (grouping sets); ratios are unrounded."""
    fits = F.col("window_tokens").isNotNull()
    kept = F.col("window_tokens") - F.col("response_tokens") - 1
    content = F.col("context_tokens") - F.col("context_texts")
    when = lambda c, v=1: F.coalesce(F.sum(F.when(c, v)), F.lit(0))
    sums = rows.groupingSets([["split"], ["board"], []], "split", "board").agg(
        F.count("*").alias("samples"), when(fits).alias("usable_samples"), when(~fits).alias("oversized_samples"), F.sum("tokens").alias("raw_tokens"),
        when(fits, F.col("window_tokens")).alias("effective_tokens"), when(fits, F.greatest(F.col("response_tokens") - 1, F.lit(0))).alias("training_loss_tokens"),
        when(F.col("tokens") <= F.col("max_length")).alias("raw_within_window"), when(F.col("window_tokens") == F.col("max_length")).alias("full_window_samples"),
        when(F.col("window_tokens") < F.col("max_length")).alias("shorter_window_samples"), when(kept < F.col("context_tokens")).alias("truncated_samples"),
        F.sum("context_tokens").alias("context_tokens"), when(fits, F.col("context_tokens")).alias("usable_context_tokens"), when(fits, kept).alias("effective_context_tokens"),
        F.sum("response_tokens").alias("response_tokens"), F.sum(content).alias("context_content_tokens"), F.sum(F.col("response_tokens") - 2).alias("response_content_tokens"),
        when(F.col("response_tokens") > F.col("max_length")).alias("responses_over_window"), F.sum("context_chars").alias("context_chars"), F.sum("response_chars").alias("response_chars"),
        F.grouping_id().alias("g"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.select(
        F.when(F.col("g") == 1, "split").when(F.col("g") == 2, "board").otherwise("total").alias("slice"), "split", "board",
        *(c for c in sums.columns if c not in ("split", "board", "g")),
        ratio(F.col("context_chars") + F.col("response_chars"), F.col("context_content_tokens") + F.col("response_content_tokens")).alias("chars_per_token"),
        ratio((F.col("usable_context_tokens") - F.col("effective_context_tokens")) * 100.0, F.col("usable_context_tokens")).alias("lost_percent"),
    )


def window_fit(rows: DataFrame, length: str, windows: tuple[int, ...] = (512, 768, 1024)) -> DataFrame:
    """(window, samples, percentage) of rows that fit each window; an empty table is an error."""
    sums = rows.agg(F.count("*").alias("n"), *(F.count_if(F.col(length) <= w).alias(str(w)) for w in windows))
    each = F.explode(F.array(*(F.struct(F.lit(w).alias("window"), F.col(str(w)).alias("samples")) for w in windows)))
    return sums.select("n", each.alias("e")).select(
        "e.window", "e.samples", F.when(F.col("n") > 0, 100.0 * F.col("e.samples") / F.col("n")).otherwise(F.raise_error(F.lit("no samples"))).alias("percentage")
    )


def parameter_count(vocabulary: int = 8192, width: int = 256, length: int = 1024, layers: int = 4, inner: int = 1024, bias: bool = True) -> int:
    """Weights of a decoder with learned positions, tied output and two norms per block."""
    block = 4 * width * width + 2 * width * inner + (5 * width + inner if bias else 0) + 4 * width
    return (vocabulary + length) * width + layers * block + 2 * width
