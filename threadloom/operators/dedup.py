"""Exact and near duplicates in stream order.

A text is compared with the texts kept before it, so the outcome depends on the order and is no equivalence. Copies of one
text share their fate, so each distinct text is judged once, at its first place. Pairs share one of a text's smallest
shingle hashes and are met at their rarest shingles; among verified pairs, a text is dropped if an earlier kept text is like it and kept if all earlier texts
like it are dropped, in rounds until all are judged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import bind, canonical, jaccard, shingles
from threadloom.stages import Stage, materialize

#: Shortest canonical text that is judged, least similarity, words of a shingle and hashes that block candidates.
MINIMUM_CHARACTERS, SIMILARITY, SHINGLE, ANCHORS = 80, 0.9, 3, 4


def distinct_texts(rows: DataFrame, text: str, order: str, exact: bool = True, minimum: int = MINIMUM_CHARACTERS) -> DataFrame:
    """(key, place, canonical) of the canonical texts of ``minimum`` characters or more, each at its first place."""
    long_enough = bind(canonical(text, exact), lambda t: F.when(F.length(t) >= minimum, F.array(t)).otherwise(F.array().cast("array<string>")))
    each = rows.select(F.col(order).alias("place"), F.explode(long_enough).alias("canonical"))  # one evaluation for test and value
    return each.groupBy(F.sha2("canonical", 256).alias("key")).agg(F.min("place").alias("place"), F.min("canonical").alias("canonical"))


def similar_pairs(texts: DataFrame, similarity: float = SIMILARITY, hashing: str = "xxhash", anchors: int = ANCHORS) -> DataFrame:
    """(later, earlier, similarity) of distinct texts that are alike and share one of their ``anchors`` smallest shingle hashes; with
    ``anchors`` 0, of all that are alike.

    Two sets alike by s share one of the rarest (1 - s) n + 1 shingles of either, so candidates meet there: a shingle of very many
    texts is only met by texts that hold hardly any other. Lengths that a match allows are in the same or in neighbouring classes,
    which are part of the key; then lengths, sets and anchors are compared.
    """
    grams = materialize(texts.select("key", "place", F.length("canonical").alias("n"), shingles(F.col("canonical"), SHINGLE, hashing).alias("s")), "shingles")
    each = grams.select("key", "place", "n", F.size("s").alias("m"), F.explode("s").alias("gram"))
    held = each.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")  # a shingle of one text meets nothing
    shared = each.join(held, "gram")
    by = Window.partitionBy("key").orderBy("df", "gram")
    # shingles of one text are the rarest, so as many places are taken before the first shared one
    at = F.col("m") - F.count("*").over(Window.partitionBy("key")) + F.row_number().over(by)
    most = F.col("m") - F.ceil(similarity * F.col("m") - 1e-9) + 1
    rare = materialize(shared.withColumns({"at": at, "most": most}).filter("at <= most").select("key", "place", "n", "gram"), "rare")
    length = F.floor(F.log("n") / -math.log(min(similarity, 0.99)) + 1e-9).cast("int")
    a = rare.select("gram", length.alias("len"), F.col("key").alias("later"), F.col("place").alias("pa"), F.col("n").alias("na"))
    b = rare.select("gram", F.explode(F.array(length - 1, length, length + 1)).alias("len"), F.col("key").alias("earlier"), F.col("place").alias("pb"), F.col("n").alias("nb"))
    near = (F.col("pb") < F.col("pa")) & (F.least("na", "nb") / F.greatest("na", "nb") >= similarity)
    pairs = a.join(b, ["gram", "len"]).filter(near).select("later", "earlier").distinct()
    sides = grams.select("key", "s")
    judged = pairs.join(sides.withColumnsRenamed({"key": "later", "s": "sa"}), "later").join(sides.withColumnsRenamed({"key": "earlier", "s": "sb"}), "earlier")
    if anchors:
        smallest = lambda s: F.slice(F.array_sort(s), 1, anchors)
        judged = judged.filter(F.arrays_overlap(smallest("sa"), smallest("sb")))
    return judged.select("later", "earlier", jaccard(F.col("sa"), F.col("sb")).alias("similarity")).filter(F.col("similarity") >= similarity)


def dropped_texts(pairs: DataFrame) -> DataFrame:
    """(key) of the later texts that an earlier kept text is like, for the pairs (later, earlier).

    Each round settles what depends on settled texts only; the earliest open text is always settled, so the rounds end, after
    as many as the longest chain of texts each of which hangs on the one before.
    """
    open_pairs = Stage(pairs.select("later", "earlier"), "pairs")
    out: list[Stage] = []
    while not open_pairs.df.isEmpty():
        now = open_pairs.df
        waiting = now.select(F.col("later").alias("earlier")).distinct()
        # texts that are no later side any more are kept; what is like them is dropped
        hit = Stage(now.join(waiting, "earlier", "left_anti").select(F.col("later").alias("key")).distinct(), "dropped")
        out.append(hit)
        gone = hit.df
        rest = now.join(gone.withColumnRenamed("key", "later"), "later", "left_anti").join(gone.withColumnRenamed("key", "earlier"), "earlier", "left_anti")
        after = Stage(rest, "pairs")
        open_pairs.drop()
        open_pairs = after
    result = pairs.sparkSession.createDataFrame([], "key string")
    for stage in out:
        result = result.unionByName(stage.df)
    return result


def classify(
    rows: DataFrame, text: str = "text", order: str = "place", exact: bool = True, hashing: str = "xxhash",
    minimum: int = MINIMUM_CHARACTERS, similarity: float = SIMILARITY, anchors: int = ANCHORS,
) -> DataFrame:
    """``rows`` with ``status``: ``unique``, ``exact_duplicate`` or ``near_duplicate`` of a text kept earlier in ``order``.

    Texts whose canonical form is shorter than ``minimum``, and null ones, are unique and not compared. ``order`` must be
    unique.
    """
    texts = materialize(distinct_texts(rows, text, order, exact, minimum), "texts")
    dropped = dropped_texts(materialize(similar_pairs(texts, similarity, hashing, anchors), "similar")).withColumn("dropped", F.lit(True))
    fate = texts.select("key", "place").join(dropped, "key", "left").select("key", F.col("place").alias("first"), "dropped")
    form = canonical(text, exact)
    # Texts that aren't compared get a key of their own, so that no null key gathers them in one task.
    own = F.concat(F.lit("-"), F.col(order).cast("string"))
    keyed = rows.withColumn("_key", bind(form, lambda t: F.when(F.length(t) >= minimum, F.sha2(t, 256)).otherwise(own)))
    keyed = keyed.withColumn("_key", F.coalesce("_key", own))
    joined = keyed.join(fate.select(F.col("key").alias("_key"), F.col("first").alias("_first"), F.col("dropped").alias("_dropped")), "_key", "left")
    status: Column = (
        F.when(F.col("_first").isNull(), "unique").when(F.col("_dropped"), "near_duplicate").when(F.col(order) == F.col("_first"), "unique").otherwise("exact_duplicate")
    )
    return joined.withColumn("status", status).drop("_key", "_first", "_dropped")
