"""Filling containers of several capacities with documents measured in tokens.

Only how many documents have each size matters for a packing, and sizes are bounded by the largest capacity. So the plan is
made on that histogram: every document is routed to the smallest tier that holds it, tiers are packed from the largest
down by best fit in decreasing size, and the gaps of longer tiers are filled from shorter ones before these are packed
themselves. The plan says how many containers of each content there are; documents find their place in it by their rank
among those of the same size, which is counted in salted groups. Containers are dealt to step groups of even load.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.packing import RANK_ROWS, plan, ranked_by_size, slots
from threadloom.stages import small_side

#: Containers of one tier that make up a step.
STEP_BINS = 8


def pieces(documents: DataFrame, largest: int) -> DataFrame:
    """(doc_id, piece_no, token_from, tokens) of rows (doc_id, tokens): a document above ``largest`` tokens is cut into
    whole pieces of that many tokens and a rest, all others are one piece. Documents of no tokens take no room."""
    parts = F.sequence(F.lit(0), F.expr(f"cast((tokens - 1) div {largest} as int)"))
    start = F.col("piece_no").cast("long") * largest
    return documents.filter("tokens > 0").select("doc_id", "tokens", F.explode(parts).alias("piece_no")).select(
        "doc_id", "piece_no", start.alias("token_from"), F.least(F.lit(largest), F.col("tokens") - start).cast("int").alias("tokens")
    )


def pack(parts: DataFrame, capacities: dict[str, int], step_bins: int = STEP_BINS, rank_rows: int = RANK_ROWS) -> DataFrame:
    """Rows of ``pieces`` with bin_kind, bin_no (from 0 within the kind) and step_no.

    ``parts`` is read three times, so it should be a written table. Ties and repeated rows are placed like any others (one
    place each). Of kinds with the same capacity the first by name is used; null or non-positive capacities are ignored. No
    rows: an empty result. The result does not depend on how the input is partitioned if (doc_id, piece_no) is unique.
    """
    spark: SparkSession = parts.sparkSession
    kinds: dict[int, str] = {}
    for kind, capacity in sorted(capacities.items(), reverse=True):
        if capacity and capacity > 0:
            kinds[capacity] = kind
    histogram = {r["tokens"]: r["n"] for r in parts.groupBy("tokens").agg(F.count("*").alias("n")).collect()}  # <= largest capacity rows
    rows = [(size, start, stop, kinds[c], base, each) for size, start, stop, c, base, each in slots(plan(histogram, list(kinds)), histogram)]
    bins = {kind: max((base + (stop - start) // each for _, start, stop, k, base, each in rows if k == kind), default=0) for kind in kinds.values()}
    steps = {kind: max(1, -(-n // step_bins)) for kind, n in bins.items()}
    ranked = ranked_by_size(parts, "tokens", ["doc_id", "piece_no"], max(histogram.values(), default=1), rank_rows)
    places = spark.createDataFrame(rows or [(0, 0, 0, "", 0, 1)], "size int, start long, stop long, bin_kind string, base long, each int")
    hit = (F.col("tokens") == F.col("size")) & (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("stop"))
    n_steps = F.element_at(F.create_map(*(F.lit(x) for kv in steps.items() for x in kv)), F.col("bin_kind")) if steps else F.lit(1)
    lap = F.expr("cast(bin_no div n_steps as bigint)")
    seat = F.expr("bin_no % n_steps")
    return (
        ranked.join(small_side(places, len(rows)), hit)
        .select(
            "doc_id", "piece_no", "token_from", "tokens", "bin_kind",
            F.expr("base + (rank - start) div each").alias("bin_no"),
            n_steps.alias("n_steps"),
        )
        .select(
            "doc_id", "piece_no", "token_from", "tokens", "bin_kind", "bin_no",
            F.when(lap % 2 == 0, seat).otherwise(F.col("n_steps") - 1 - seat).alias("step_no"),
        )
    )
