"""Exact token counts under public tokenizers, for texts of any length.

A text above ``PIECE_CHARS`` is cut only where the tokenizer provably starts afresh, its chunks are spread over all
workers and their counts are summed. For rank files with the pattern below that is a single blank between two letters or
digits: the match before it ends at the letter (letters and digits never take in a blank), the next match starts at the
blank whatever stands before, and no alternative looks behind; so the pieces, and the merges within them, are the same.
Other tokenizers have no proven boundary here and see whole texts.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary used unless another path is given.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value of the rank files: the pattern that splits a text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE_CHARS = 1 << 16
_BOUNDARY = re.compile(r"(?<=[\p{L}\p{N}]) (?=[\p{L}\p{N}])")


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[str], int]:
    """A function that counts a text's tokens, without special tokens, by the vocabulary file at ``path``."""
    kind = os.path.splitext(path)[1]
    if kind == ".tiktoken":
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(_well_formed(text)))
    if kind == ".model":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(pieces.encode(text, num_threads=1))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def _well_formed(text: str) -> str:
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def independent_chunks(text: str, size: int = PIECE_CHARS) -> list[str]:
    """The text cut into chunks of ``size`` characters or somewhat more, at boundaries where tokens can't cross."""
    chunks, start = [], 0
    while len(text) - start > size:
        hit = _BOUNDARY.search(text, start + size)
        if hit is None:
            break
        chunks.append(text[start : hit.start()])
        start = hit.start()
    chunks.append(text[start:])
    return chunks


def with_token_counts(records: DataFrame, texts: str = "texts", path: str = TOKENIZER, piece: int = PIECE_CHARS) -> DataFrame:
    """``records`` with ``texts`` (array of strings) replaced by ``tokens`` (bigint), the tokens of all its texts.

    Null texts and a null array count nothing. Records need no key: repeated ones stay repeated, each with its count. Every
    other column is passed on. A record whose texts are longer than ``piece`` is spread over the workers in chunks.
    """
    splits = path.endswith(".tiktoken")

    @F.pandas_udf("long")
    def tokens(column: pd.Series) -> pd.Series:
        count = counter(path)
        return pd.Series([0 if t is None else sum(count(x) for x in t if x) for t in column], dtype="int64")

    @F.pandas_udf("array<string>")
    def chunks(column: pd.Series) -> pd.Series:
        return column.map(lambda t: independent_chunks(t, piece) if splits else [t])

    kept = [c for c in records.columns if c not in (texts, "tokens")]
    size = F.coalesce(F.aggregate(F.col(texts), F.lit(0).cast("long"), lambda n, t: n + F.coalesce(F.length(t), F.lit(0))), F.lit(0))
    short = records.filter(size <= piece).select(*kept, tokens(F.col(texts)).alias("tokens"))
    key = F.struct(*kept, F.xxhash64(texts).alias("_h"))
    parts = records.filter(size > piece).select(key.alias("k"), F.posexplode(texts).alias("i", "text")).filter("text is not null")
    each = parts.select("k", "i", F.posexplode(chunks("text")).alias("j", "chunk"))
    spread = each.repartition(F.xxhash64("k", "i", "j")) if splits else each
    counted = spread.select("k", "i", "j", tokens(F.array("chunk")).alias("tokens"))
    per = counted.groupBy(F.to_json("k").alias("kj"), "i", "j").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.first("k").alias("k"))
    long = per.groupBy("kj").agg(F.sum(F.expr("tokens div n")).alias("tokens"), F.max("n").alias("n"), F.first("k").alias("k"))
    long = long.select("k.*", "tokens", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_c")).drop("_h", "_c")
    return short.unionByName(long.select(*short.columns))
