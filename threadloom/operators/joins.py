"""Joins whose keys may be null in most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, table: DataFrame, key: str, spread_by: str) -> DataFrame:
    """``rows`` with the columns that ``table`` holds for their ``key`` (null where it holds none or the key is null).

    Rows without a key would all meet in one task; here they are spread by the hash of the column ``spread_by`` and match
    nothing. ``table`` should have one row per key; its null keys match nothing.
    """
    values = [c for c in table.columns if c != key]
    held = table.filter(F.col(key).isNotNull()).select(F.col(key).alias("_held"), F.lit(0).cast("long").alias("_held_salt"), *values)
    salted = rows.withColumn("_salt", F.when(F.col(key).isNull(), F.xxhash64(spread_by).bitwiseOR(F.lit(1).cast("long"))).otherwise(F.lit(0).cast("long")))
    # Null keys join as the key type's zero with an odd salt; held rows have salt 0.
    zero = F.lit(0).cast(dict(rows.dtypes)[key]) if dict(rows.dtypes)[key] != "string" else F.lit("")
    joined = salted.join(held, (F.coalesce(F.col(key), zero) == F.col("_held")) & (F.col("_salt") == F.col("_held_salt")), "left")
    return joined.select(*rows.columns, *values)
