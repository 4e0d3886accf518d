"""Mixing sources to target weights by Poisson replication.

A source that is to give a share of a mixture of T tokens has the repetition rate share * T / (its tokens). Each document
draws its number of copies by inverting the Poisson distribution, cut off at the source's largest repetition and with the
mean at that rate, at a uniform number hashed from its id and a seed. So nothing but the per-source totals is ever gathered.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.stages import small_side


@dataclass(frozen=True)
class Target:
    share: float
    max_repeats: int


def _cdf(mean: float, cap: int) -> list[float]:
    """P(count <= k) for k below the cap; counts are cut off at the cap. Probabilities are summed from their logarithms."""
    if math.isinf(mean):
        return [0.0] * cap
    if mean == 0:
        return [1.0] * cap
    step, run, out = -mean, 0.0, []
    for k in range(cap):
        run += math.exp(step)
        out.append(min(1.0, run))
        step += math.log(mean) - math.log(k + 1)
    return out


def poisson_steps(rate: float, cap: int) -> list[float]:
    """Distribution steps of a Poisson count cut off at ``cap`` whose mean is ``rate`` (at most the cap)."""
    if rate >= cap * (1 - 1e-12):
        return _cdf(math.inf, cap)
    lo, hi = 0.0, 1.0
    mean = lambda m: math.fsum(1 - c for c in _cdf(m, cap))
    while mean(hi) < rate:
        hi *= 2
    while hi - lo > 1e-12 * hi:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean(mid) < rate else (lo, mid)
        if mid in (lo, hi) and (lo + hi) / 2 == mid:
            break
    return _cdf(hi, cap)


def mixture_size(tokens: dict[str, int], targets: dict[str, Target]) -> float:
    """The largest mixture in which every source that has documents reaches its share within its repetitions."""
    there = {s: t for s, t in targets.items() if tokens.get(s) and t.share > 0 and t.max_repeats > 0}
    whole = sum(t.share for t in there.values())
    return min((t.max_repeats * tokens[s] * whole / t.share for s, t in there.items()), default=0.0)


def limiting_source(tokens: dict[str, int], targets: dict[str, Target]) -> str | None:
    """The source that sets ``mixture_size``: the first to reach its repetitions; of equal ones the first by name."""
    there = {s: t for s, t in targets.items() if s is not None and tokens.get(s) and t.share and t.share > 0 and t.max_repeats and t.max_repeats > 0}
    return min(there, key=lambda s: (there[s].max_repeats * tokens[s] / there[s].share, s), default=None)


def _uniform(seed: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(seed.cast("long"), F.col("doc_id")), 11) * F.lit(2.0**-53)


def mix(documents: DataFrame, targets: dict[str, Target], total_tokens: float | None = None, seed: int = 0, trials: int = 1) -> DataFrame:
    """(doc_id, copy_no, source, tokens, mix_key), ordered by ``mix_key``, of documents (doc_id, source, tokens).

    ``total_tokens``: the size aimed at, by default the largest at which every source can reach its share; beyond it sources
    stop at their cap. Documents of no tokens, of no source or of a source without target are left out; targets without
    documents get nothing and the others keep their proportions. ``doc_id`` should be unique: equal ids draw equal counts.
    ``documents`` is read twice and should be a written table. With ``trials`` above 1 it is read once more, and each source takes
    that of so many seeds whose draw comes closest to its aim: shares carry less noise, counts are no longer plain draws. The order is a hash of seed, document and copy.
    """
    spark = documents.sparkSession
    usable = {s: t for s, t in targets.items() if s is not None and t.share and t.share > 0 and t.max_repeats and t.max_repeats > 0}
    schema = "source string, steps array<double>, seed long"
    rows = documents.filter((F.col("tokens") > 0) & F.col("source").isin(list(usable)))
    tokens = {r["source"]: r["t"] for r in rows.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}  # one row per target
    size = mixture_size(tokens, usable) if total_tokens is None else total_tokens
    whole = sum(usable[s].share for s in tokens)
    aims = {s: size * usable[s].share / whole for s in tokens}
    steps = {s: poisson_steps(min(aims[s] / tokens[s], usable[s].max_repeats), usable[s].max_repeats) for s in tokens}
    drawn = lambda u: F.size(F.filter("steps", lambda c: c <= u))
    base = spark.createDataFrame([(s, c, 0) for s, c in steps.items()], schema).drop("seed")
    best = {s: seed * 1000 for s in steps}
    if trials > 1:
        sums = [F.sum(drawn(_uniform(F.lit(seed * 1000 + k))) * F.col("tokens")).alias(f"t{k}") for k in range(trials)]
        tried = rows.join(small_side(base, len(steps)), "source").groupBy("source").agg(*sums).collect()
        best |= {r["source"]: seed * 1000 + min(range(trials), key=lambda k: abs(r[f"t{k}"] - aims[r["source"]])) for r in tried}
    chosen = spark.createDataFrame([(s, c, best[s]) for s, c in steps.items()], schema)
    copies = rows.join(small_side(chosen, len(steps)), "source").withColumn("copies", drawn(_uniform(F.col("seed"))))
    return (
        copies.filter("copies > 0")
        .select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))
        .withColumn("mix_key", F.xxhash64(F.lit(seed), "doc_id", "copy_no"))
        .select("doc_id", "copy_no", "source", "tokens", "mix_key")
        .orderBy("mix_key", "doc_id", "copy_no")
    )
