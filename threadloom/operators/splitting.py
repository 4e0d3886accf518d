"""Group splits in hash order, and checks of splits."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.stages import small_side

#: The shares of groups that go to train and to validation; the rest is test.
TRAIN_SHARE, VALIDATION_SHARE = 0.9, 0.05
NAMES = ("train", "validation", "test")


@F.pandas_udf(T.StringType())
def _blake(text: pd.Series) -> pd.Series:
    return text.map(lambda t: hashlib.blake2b(t.encode(), digest_size=16).hexdigest())


def group_digest(board: Column, thread_id: Column, seed: int, hashing: str = "sha256") -> Column:
    """The hash that orders groups: of ``seed:board:thread``, ``sha256`` or ``blake2b`` (128 bits)."""
    text = F.concat_ws(":", F.lit(str(seed)), board, thread_id.cast("string"))
    return F.sha2(text, 256) if hashing == "sha256" else _blake(text)


def assign_groups(rows: DataFrame, seed: int = 0, hashing: str = "sha256", buckets: int = 4096) -> DataFrame:
    """(board, thread_id, split) of the distinct groups: the first ⌊0.9 n⌋ in hash order train, the next ⌊0.05 n⌋ validation,
    the rest test.

    Ranks are exact without a global sort in one task: groups are counted per hash bucket, the two cuts are found in the
    running count of the buckets (at most ``buckets`` of them), and only the buckets that a cut falls into are ranked.
    """
    digest = group_digest(F.col("board"), F.col("thread_id"), seed, hashing)
    groups = rows.select("board", "thread_id").distinct().withColumn("digest", digest)
    place = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    groups = groups.withColumn("bucket", F.floor(place * buckets / (1 << 32)).cast("int"))
    counts = dict(sorted(groups.groupBy("bucket").count().collect()))  # at most ``buckets`` rows
    n = sum(counts.values())
    train = int(n * TRAIN_SHARE)
    ends = (train, train + int(n * VALIDATION_SHARE))
    before, run = {}, 0
    for b, c in counts.items():
        before[b] = run
        run += c
    mixed = [b for b, c in counts.items() if any(before[b] < e < before[b] + c for e in ends)]

    def name_at(rank: Column) -> Column:
        return F.when(rank < ends[0], NAMES[0]).when(rank < ends[1], NAMES[1]).otherwise(NAMES[2])

    starts = rows.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "bucket int, start long")
    joined = groups.join(small_side(starts, len(before)), "bucket")
    order = Window.partitionBy("bucket").orderBy("digest", "board", "thread_id")
    inside = joined.filter(F.col("bucket").isin(mixed)).withColumn("split", name_at(F.col("start") + F.row_number().over(order) - 1))
    outside = joined.filter(~F.col("bucket").isin(mixed)).withColumn("split", name_at(F.col("start")))
    return inside.unionByName(outside).select("board", "thread_id", "split")


def split_report(rows: DataFrame) -> DataFrame:
    """(board, split, threads, samples) of rows (board, thread_id, split), with a row of zeros where a board has none, and
    the totals under the null board."""
    names = F.explode(F.array(*map(F.lit, NAMES))).alias("split")
    per = rows.groupBy("board", "thread_id", "split").agg(F.count("*").alias("n"))
    sums = per.groupBy("board", "split").agg(F.count("*").alias("threads"), F.sum("n").alias("samples"))
    grid = rows.select("board").distinct().select("board", names)
    boards = grid.join(sums, ["board", "split"], "left").fillna(0, ["threads", "samples"])
    totals = boards.groupBy("split").agg(F.sum("threads").alias("threads"), F.sum("samples").alias("samples"))
    return boards.unionByName(totals.select(F.lit(None).cast("string").alias("board"), "split", "threads", "samples"))


def leaking_groups(rows: DataFrame) -> DataFrame:
    """(board, thread_id, splits) of groups that own rows in more than one split."""
    return rows.groupBy("board", "thread_id").agg(F.countDistinct("split").alias("splits")).filter("splits > 1")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows by which two frames of the same columns differ, with how often more they occur in ``a`` (negative: in ``b``).

    One grouping of the union instead of two EXCEPT ALL; no rows mean that the frames hold the same rows as often."""
    columns = a.columns
    both = a.select(*columns, F.lit(1).alias("_n")).unionByName(b.select(*columns, F.lit(-1).alias("_n")))
    return both.groupBy(*columns).agg(F.sum("_n").alias("surplus")).filter("surplus <> 0")
