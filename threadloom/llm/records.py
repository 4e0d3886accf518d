"""Readers' views of the samples and documents tables, shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest_samples(samples: DataFrame, *columns: Column | str) -> DataFrame:
    """One row per ``sample_no`` (null ones are left out): that loaded last, among equals the largest values.

    ``columns`` are what is kept besides ``sample_no``; they are cut out before the shuffle.
    """
    narrow = samples.filter("sample_no is not null").select("sample_no", "loaded_at", *columns)
    kept = [c for c in narrow.columns if c not in ("sample_no", "loaded_at")]
    return (
        narrow.groupBy("sample_no")
        .agg(F.max(F.struct("loaded_at", *kept)).alias("r"))
        .select("sample_no", *(F.col("r")[c].alias(c) for c in kept))
    )


def board_code(column: Column | str) -> Column:
    """A board's code from its spellings: blanks and slashes around it and case don't count; blank becomes null."""
    plain = F.lower(F.regexp_replace(column, r"[\s/]+", ""))
    return F.when(plain != "", plain)


def turn_texts(messages: Column | str) -> Column:
    """The user and assistant contents in order, null contents as empty texts; null messages as an empty array."""
    column = F.col(messages) if isinstance(messages, str) else messages
    spoken = F.filter(column, lambda m: m["role"].isin("user", "assistant"))
    return F.coalesce(F.transform(spoken, lambda m: F.coalesce(m["content"], F.lit(""))), F.array().cast("array<string>"))
