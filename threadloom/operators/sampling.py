"""Reservoirs, top-k, ranks, label audits and seeded orders."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.stages import materialize, small_side


def reservoir(rows: DataFrame, order: list[str], size: int, seed: int, total: int | None = None) -> DataFrame:
    """The rows that Algorithm R with ``random.Random(seed)`` keeps of a stream in ``order``, with their ``slot``.

    Which places of a stream of n rows are kept depends on n, ``size`` and the seed alone, so they are drawn without the rows;
    only the kept places are joined. The draws of this seeded generator can only be made one after another, n of them (about a
    million a second); ``hash_sample`` needs none and suits streams of billions.
    """
    n = rows.count() if total is None else total
    draw, slots = random.Random(seed), {}
    for k in range(n if size > 0 else 0):
        slot = k if k < size else draw.randint(0, k)
        if slot < size:
            slots[slot] = k
    kept = rows.sparkSession.createDataFrame([(k, s) for s, k in slots.items()], "_at long, slot int")
    placed = with_places(rows, order)
    return placed.join(small_side(kept, len(slots)), "_at").drop("_at")


def numbered_ranges(rows: DataFrame, order: list[str], amounts: dict[str, str]) -> DataFrame:
    """``rows`` with, for each new column, the sum of an amount column over the rows before in ``order``: ranges of the order are
    sorted and summed apart, and stitched by the running sums of the ranges (one row per range)."""
    parts = materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    by = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges only
    sums = parts.groupBy("_part").agg(*(F.sum(a).alias(f"_s_{n}") for n, a in amounts.items()))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    starts = sums.select("_part", *(zero(F.sum(f"_s_{n}").over(before)).alias(f"_b_{n}") for n in amounts))
    inside = parts.select("*", *(zero(F.sum(a).over(by)).alias(f"_i_{n}") for n, a in amounts.items()))
    joined = inside.join(starts, "_part")
    return joined.select(*rows.columns, *((F.col(f"_b_{n}") + F.col(f"_i_{n}")).alias(n) for n in amounts))


def with_places(rows: DataFrame, order: list[str], name: str = "_at") -> DataFrame:
    """``rows`` with their place (from 0) in ``order``, numbered in parallel."""
    return numbered_ranges(rows.withColumn("_one", F.lit(1).cast("bigint")), order, {name: "_one"}).drop("_one")


def hash_sample(rows: DataFrame, keys: list[str], size: int, seed: int) -> DataFrame:
    """``size`` rows, the smallest by a hash of seed and keys: a reservoir that needs no order."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)).cast("binary"))
    return rows.withColumn("digest", digest).orderBy("digest").limit(size)


def top_k(rows: DataFrame, keys: list[str], score: str, k: int, ties: list[str]) -> DataFrame:
    """The ``k`` best rows per key by score, ties by the given columns."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), *ties))
    return rows.withColumn("place", at).filter(F.col("place") <= k)


def strict_rank(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """1 plus the number of rows with a greater score."""
    return rows.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(score))))


def shuffled(rows: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """``rows`` in an order that depends on seed, epoch and the row's key alone."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed + epoch)), F.col(key).cast("string")).cast("binary")), key)


def label_audit(rows: DataFrame, labels: str, end_id: int) -> DataFrame:
    """Rows, rows with a supervised end token, and how many such tokens there are."""
    ends = F.size(F.filter(labels, lambda x: x == end_id))
    return rows.agg(F.count("*").alias("rows"), F.count_if(ends > 0).alias("rows_with_end"), F.coalesce(F.sum(ends), F.lit(0)).alias("end_tokens"))


def equal_vectors(rows: DataFrame, vector: str, wanted: Column) -> DataFrame:
    """Rows whose vector equals ``wanted``, with its norm."""
    norm = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x))
    return rows.filter(F.col(vector) == wanted).withColumn("norm", norm)
