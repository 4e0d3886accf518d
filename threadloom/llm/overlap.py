"""Same or near-same records across splits.

Two word sequences match if at most one word in ten (of the longer one) is added, left out or replaced. One edit destroys
at most SHINGLE shingles of a text, so texts of n words with at most e edits share n - SHINGLE + 1 - SHINGLE * e shingles or
more, and any two matching texts share one among the SHINGLE * e + 1 rarest of either: an exact prefix filter. Evaluation
prefixes form the index, training prefixes probe it, lengths and positions cut candidates, and a bit-parallel edit
distance verifies them. Exact copies are one class throughout and only become pairs in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.text import plain_words
from threadloom.stages import Stage

#: Words of a shingle, least words of a text, and the longer text's words per permitted edit.
SHINGLE, LEAST_WORDS, WORDS_PER_EDIT = 5, 40, 10

_TEXTS = "record long, eval boolean, source string, split_name string, cls string, n int, words string"
_GRAMS = "rep long, ev boolean, tr boolean, grams array<long>"


def _to_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for record, ev, source, split, texts in zip(*(c.to_pylist() for c in batch.columns)):
            words = [w for t in texts or [] if t for w in plain_words(t)]
            if len(words) >= LEAST_WORDS:
                joined = " ".join(words)
                rows.append((record, ev, source, split, xxhash.xxh3_128_hexdigest(joined), len(words), joined))
        columns = list(zip(*rows)) or [[]] * 7
        kinds = [pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["record", "eval", "source", "split_name", "cls", "n", "words"]
        )


def shingle_hashes(words: list[str], size: int = SHINGLE) -> list[int]:
    """Signed 64-bit hashes of the word shingles; the k-th repeat of a shingle has a hash of its own."""
    seen: dict[str, int] = {}
    out = []
    for i in range(len(words) - size + 1):
        gram = " ".join(words[i : i + size])
        k = seen.get(gram, 0)
        seen[gram] = k + 1
        out.append(xxhash.xxh64_intdigest(gram if not k else f"{gram}#{k}") - (1 << 63))
    return out


def _to_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = [shingle_hashes(w.split(" ")) for w in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(grams, pa.list_(pa.int64()))], names=["rep", "ev", "tr", "grams"])


def edit_distance(a: list[str], b: list[str]) -> int:
    """Words added, left out or replaced between two word lists (bit-parallel, one machine word sequence per row)."""
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    ha, hb = len(a), len(b)
    while ha > lo and hb > lo and a[ha - 1] == b[hb - 1]:
        ha, hb = ha - 1, hb - 1
    a, b = a[lo:ha], b[lo:hb]
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    for w in b:
        eq = places.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (~(xh | up) & full)
        mh = up & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1 | 1) & full
        mh = mh << 1 & full
        up = mh | (~(xv | ph) & full)
        down = ph & xv
    return score


@F.pandas_udf(T.BooleanType())
def _close(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        x, y = x.split(" "), y.split(" ")
        out.append(edit_distance(x, y) <= max(len(x), len(y)) // WORDS_PER_EDIT)
    return pd.Series(out)


def read_texts(records: DataFrame) -> DataFrame:
    """Records (record bigint, eval boolean, source string, split_name string, texts array<string>) with their words and
    the class of texts with the same words. Texts of fewer than ``LEAST_WORDS`` words, null and empty ones are left out,
    as are records whose ``eval`` is null. Null texts in an array count as empty. A record
    may be repeated, but a record number belongs to one text."""
    rows = records.filter("record is not null and eval is not null").select("record", "eval", "source", "split_name", "texts")
    return rows.mapInArrow(_to_words, _TEXTS)


def matching_classes(texts: DataFrame) -> DataFrame:
    """(a, b) of classes of ``read_texts`` that match, a with training and b with evaluation records; a = b for copies.

    Shingles that occur on one side only come first in the order that prefixes are cut by: they can't meet, so they need no row,
    only their number. All others are ordered by how many training classes hold them. Training shingles are shuffled once, to
    meet the evaluation side's; what is left of them stays there to be counted and goes to its class for the rank.
    """
    # A class goes by its smallest record in what follows: exploded shingles then take 20 bytes a row.
    sides = (F.max("eval").alias("ev"), F.max(~F.col("eval")).alias("tr"))
    classes = Stage(texts.groupBy("cls").agg(F.min("record").alias("rep"), F.min("n").alias("n"), *sides), "classes").df
    chosen = classes.select(F.col("rep").alias("record"), "ev", "tr").join(texts.select("record", "words"), "record").dropDuplicates(["record"])
    grams = Stage(chosen.select(F.col("record").alias("rep"), "ev", "tr", "words").mapInArrow(_to_grams, _GRAMS), "grams").df
    held, train = (grams.filter(side).select(F.explode("grams").alias("gram"), "rep") for side in ("ev", "tr"))
    shared = Stage(train.join(held.select("gram").distinct(), "gram", "left_semi"), "shared").df
    times = shared.groupBy("gram").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("df", "gram"))
    edits = F.floor(F.col("n") / (WORDS_PER_EDIT - 1))
    m = F.col("n") - (SHINGLE - 1)

    def prefix(rows: DataFrame) -> DataFrame:
        ranked = rows.join(times, "gram").withColumn("k", rank).withColumn("kept", F.count("*").over(Window.partitionBy("rep")))
        known = ranked.join(classes.select("rep", "n"), "rep").withColumn("at", m - F.col("kept") + F.col("k"))
        return known.filter(F.col("at") <= SHINGLE * edits + 1).select("gram", "rep", "n", "at", m.alias("m"))

    # Texts of matching lengths are in the same or in neighbouring classes of length, so a shingle of very many texts is many keys.
    length = F.floor(F.log(1.12, F.col("n"))).cast("int")
    near_length = F.explode(F.array(length - 1, length, length + 1)).alias("len")
    index, probe = Stage(prefix(held), "index").df, Stage(prefix(shared), "probe").df
    index = index.select("gram", near_length, *(F.col(c).alias(c + "_b") for c in ("rep", "n", "at", "m")))
    probe = probe.select("gram", length.alias("len"), *(F.col(c).alias(c + "_a") for c in ("rep", "n", "at", "m")))
    longer = F.greatest("n_a", "n_b")
    allowed = F.floor(longer / WORDS_PER_EDIT)
    needed = longer - (SHINGLE - 1) - SHINGLE * allowed
    at_most = 1 + F.least(F.col("m_a") - F.col("at_a"), F.col("m_b") - F.col("at_b"))
    candidates = (
        probe.join(index, ["gram", "len"])
        .filter((F.abs(F.col("n_a") - F.col("n_b")) <= allowed) & (at_most >= needed) & (F.col("rep_a") != F.col("rep_b")))
        .select(F.col("rep_a").alias("ra"), F.col("rep_b").alias("rb"))
        .distinct()
    )
    candidates = Stage(candidates, "candidates").df
    text = lambda side, words: texts.select(F.col("record").alias("r" + side), F.col("cls").alias(side), F.col("words").alias(words))
    near = candidates.join(text("a", "x"), "ra").join(text("b", "y"), "rb").filter(_close("x", "y")).select("a", "b").distinct()
    same = classes.filter("ev and tr").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    return near.unionByName(same)


def overlap_pairs(texts: DataFrame, matches: DataFrame) -> DataFrame:
    """All pairs of a training record (train, train_source) and an evaluation record (eval, eval_source, split_name)."""
    train = texts.filter("not eval").select(F.col("cls").alias("a"), F.col("record").alias("train"), F.col("source").alias("train_source"))
    held = texts.filter("eval").select(F.col("cls").alias("b"), F.col("record").alias("eval"), F.col("source").alias("eval_source"), "split_name")
    return matches.join(train, "a").join(held, "b").select("train", "train_source", "eval", "eval_source", "split_name")
