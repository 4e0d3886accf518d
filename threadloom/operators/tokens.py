"""Token sequences: encoding, context windows, labels, padding, batches and packing of training rows."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.text import md5_number
from threadloom.operators.chat import SPECIAL_TOKENS
from threadloom.operators.packing import placed

IGNORED = -100
_IDS = T.ArrayType(T.LongType())


def word_ids(text: Column, vocabulary: int = 1_000_000) -> Column:
    """Token ids of the words between blanks, by hash: a tokenizer that SQL engines share. Ids start after the special ones."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: md5_number(w) % vocabulary + len(SPECIAL_TOKENS))


def bpe_ids(tokenizer_json: str) -> Callable[[Column], Column]:
    """An encoder by a saved byte-level BPE tokenizer, given as its JSON text; loaded once per worker."""

    @F.pandas_udf(_IDS)
    def encode(text: pd.Series) -> pd.Series:
        tokenizer = _tokenizer(tokenizer_json)
        found = tokenizer.encode_batch([t or "" for t in text], add_special_tokens=False)
        return pd.Series([None if t is None else e.ids for t, e in zip(text, found)])

    return encode


def bpe_text(tokenizer_json: str) -> Callable[[Column], Column]:
    """The decoder to ``bpe_ids``; special tokens are left out."""

    @F.pandas_udf(T.StringType())
    def decode(ids: pd.Series) -> pd.Series:
        tokenizer = _tokenizer(tokenizer_json)
        return ids.map(lambda x: None if x is None else tokenizer.decode(list(map(int, x)), skip_special_tokens=True))

    return decode


_LOADED: dict[str, object] = {}


def _tokenizer(text: str):
    if text not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED.clear()
        _LOADED[text] = Tokenizer.from_str(text)
    return _LOADED[text]


def load_tokenizer(path: str) -> str:
    """The JSON text of a tokenizer file, checked for the special tokens' ids."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    vocabulary = {t["content"]: t["id"] for t in json.loads(text).get("added_tokens", [])}
    if {k: vocabulary.get(k) for k in SPECIAL_TOKENS} != SPECIAL_TOKENS:
        raise ValueError("the special tokens don't have their ids")
    return text


def segments(context: Column, encode: Callable[[Column], Column] = word_ids) -> Column:
    """Ids of each context text after its role's id."""
    n = F.size(context)
    role = lambda i: F.when((n - i) % 2 == 1, SPECIAL_TOKENS["<USER>"]).otherwise(SPECIAL_TOKENS["<ASSISTANT>"]).cast("long")
    return F.transform(context, lambda t, i: F.concat(F.array(role(i)), encode(t)))


def response_ids(response: Column, encode: Callable[[Column], Column] = word_ids) -> Column:
    """The assistant's id, the answer's ids and the end."""
    one = lambda name: F.array(F.lit(SPECIAL_TOKENS[name]).cast("long"))
    return F.concat(one("<ASSISTANT>"), encode(response), one("<EOS>"))


def window(segs: Column, response: Column, max_length: int, partial: bool = True) -> Column:
    """Ids of a dialogue within ``max_length``, or null where the answer doesn't fit.

    The answer is kept whole. Context comes from the newest segment back, whole while it fits; the first that doesn't is cut
    to its role and its last ids if at least two fit (``partial``), or ends the window; without ``partial`` the newest
    segment must fit.
    """
    ids = "array<array<bigint>>"
    state = F.struct((F.lit(max_length) - F.size(response) - 1).alias("left"), F.array().cast(ids).alias("kept"), F.lit(False).alias("done"))

    def step(a: Column, seg: Column) -> Column:
        left, kept, done = a["left"], a["kept"], a["done"]
        fits = ~done & (F.size(seg) <= left)
        cut = ~done & ~fits & (left >= 2) & F.lit(partial)
        tail = F.slice(seg, F.size(seg) - left + 2, F.greatest(left - 1, F.lit(0)))
        more = F.when(fits, F.concat(F.array(seg), kept)).when(cut, F.concat(F.array(F.concat(F.slice(seg, 1, 1), tail)), kept)).otherwise(kept)
        return F.struct(F.when(fits, left - F.size(seg)).otherwise(left).alias("left"), more.alias("kept"), (done | ~fits).alias("done"))

    chosen = F.flatten(F.aggregate(F.reverse(segs), state, step)["kept"])
    fits = F.size(response) + 1 <= max_length
    if not partial:
        fits = fits & (F.coalesce(F.size(F.try_element_at(segs, F.lit(-1))), F.lit(0)) <= F.lit(max_length) - F.size(response) - 1)
    return F.when(fits, F.concat(F.array(F.lit(SPECIAL_TOKENS["<BOS>"]).cast("long")), chosen, response))


def chat_window_drop(pair_lengths: Column, fixed: Column, max_length: int) -> Column:
    """How many of the oldest question-answer pairs must go for the rest, ``fixed`` tokens and all, to fit; null if none helps.

    ``pair_lengths`` has the tokens of each pair before the last question, the oldest first; the last question and the
    answer belong to ``fixed``.
    """
    n = F.size(pair_lengths)
    rest = lambda k: fixed + F.aggregate(F.slice(pair_lengths, k + 1, F.greatest(n - k, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)
    fitting = F.filter(F.sequence(F.lit(0), n), lambda k: rest(k) <= max_length)
    return F.array_min(fitting)


def response_start(ids: Column, response: Column) -> Column:
    """Place (from 0) of the answer's first own token."""
    return F.size(ids) - F.size(response) + 1


def shifted_rows(ids: Column, start: Column) -> tuple[Column, Column]:
    """(input, labels) of next-token training: labels are the ids moved by one, masked before the answer."""
    n = F.size(ids)
    masked = F.array_repeat(F.lit(IGNORED).cast("long"), F.greatest(start - 1, F.lit(0)))
    return F.slice(ids, 1, n - 1), F.concat(masked, F.slice(ids, start + 1, n - start))


def unshifted_labels(ids: Column, start: Column) -> Column:
    """The ids with everything before the answer masked."""
    return F.concat(F.array_repeat(F.lit(IGNORED).cast("long"), start), F.slice(ids, start + 1, F.size(ids) - start))


def loss_tokens(labels: Column, shifted: bool = True) -> Column:
    """Tokens that count for the loss: labels that aren't masked; of unshifted labels the first is never predicted."""
    counted = labels if shifted else F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0)))
    return F.size(F.filter(counted, lambda x: x != IGNORED))


def batches(rows: DataFrame, order: list[str], batch_size: int, within: list[str] | None = None) -> DataFrame:
    """``rows`` with ``batch_no``: ``batch_size`` rows in a row each, the last one may be shorter; counted per ``within``."""
    at = F.row_number().over(Window.partitionBy(*(within or [F.lit(0)])).orderBy(*order))
    return rows.withColumn("batch_no", F.floor((at - 1) / batch_size))


def padded(rows: DataFrame, keys: list[str], ids: str = "input_ids", labels: str = "labels") -> DataFrame:
    """``rows`` right-padded to the longest of their batch, with an attention mask."""
    most = F.max(F.size(ids)).over(Window.partitionBy(*keys))
    gap = most - F.size(ids)
    fill = lambda v: F.array_repeat(F.lit(v).cast("long"), gap)
    mask = F.concat(F.array_repeat(F.lit(1).cast("long"), F.size(ids)), fill(0))
    return rows.select(
        *(c for c in rows.columns if c not in (ids, labels)), F.concat(ids, fill(SPECIAL_TOKENS["<PAD>"])).alias(ids),
        mask.alias("attention_mask"), F.concat(labels, fill(IGNORED)).alias(labels),
    )


def pack_rows(rows: DataFrame, key: str, max_length: int, ids: str = "input_ids", labels: str = "labels") -> DataFrame:
    """(bin_no, input_ids, labels, seq_lengths): whole rows packed into bins of ``max_length`` by best fit decreasing.

    A longer row is an error. Bins hold at most ``max_length`` tokens, so their rows are gathered safely.
    """
    sized = rows.select(key, ids, labels, F.size(ids).alias("n"))
    at = placed(sized.select(key, "n"), "n", [key], [max_length])
    gathered = sized.drop("n").join(at, key).groupBy("bin_no").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(key).alias("k"), F.col(ids).alias("i"), F.col(labels).alias("l"), "n"))).alias("r")
    )
    part = lambda c: F.transform("r", lambda x: x[c])
    return gathered.select("bin_no", F.flatten(part("i")).alias(ids), F.flatten(part("l")).alias(labels), part("n").alias("seq_lengths"))


def until_stop(ids: Column, stops: list[int]) -> Column:
    """The ids before the first stop id."""
    at = F.array_min(F.filter(F.transform(F.array(*(F.lit(s).cast("long") for s in stops)), lambda s: F.array_position(ids, s)), lambda p: p > 0))
    return F.when(at.isNull(), ids).otherwise(F.slice(ids, 1, F.greatest(at - 1, F.lit(0)).cast("int")))


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(piece, n) of the pre-tokenizer's pieces: what a BPE trainer needs to see of a corpus."""
    pieces = F.explode(F.regexp_extract_all(text, F.lit(r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"), 0))
    return texts.select(pieces.alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


def training_plan(samples: int, batch_size: int, epochs: int | None = None, max_steps: int | None = None, accumulation: int = 1) -> tuple[int, int, int]:
    """(steps per epoch, steps in all, epochs) for exactly one of ``epochs`` and ``max_steps``."""
    if min(samples, batch_size, accumulation) <= 0 or (epochs is None) == (max_steps is None) or (epochs or max_steps or 0) <= 0:
        raise ValueError("samples, sizes and exactly one of epochs and max_steps must be positive")
    steps = -(-(-(-samples // batch_size)) // accumulation)
    return (steps, steps * epochs, epochs) if epochs is not None else (steps, max_steps, -(-max_steps // steps))


def training_plan_columns(samples: Column, batch_size: int, epochs: int | None = None, max_steps: int | None = None, accumulation: int = 1) -> tuple[Column, Column, Column]:
    """``training_plan`` for a column of sample numbers; null where there are no samples."""
    training_plan(1, batch_size, epochs, max_steps, accumulation)  # the same demands on the settings
    steps = F.when(samples > 0, F.ceil(F.ceil(samples / batch_size) / accumulation))
    return (steps, steps * epochs, F.when(steps.isNotNull(), F.lit(epochs))) if epochs is not None else (steps, F.when(steps.isNotNull(), F.lit(max_steps)), F.ceil(F.lit(max_steps) / steps))


def chat_prompt(question: Column) -> Column:
    """Ids of a prompt that an answer is to follow: begin, user, the question's ids, assistant. A null question is an empty one."""
    one = lambda name: F.array(F.lit(SPECIAL_TOKENS[name]).cast("long"))
    return F.concat(one("<BOS>"), one("<USER>"), F.coalesce(question, F.array().cast("array<bigint>")), one("<ASSISTANT>"))


def templated_prompt(question: Column, system: Column, begin: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    """A prompt as one text by a chat template: the system text as a message of its own where there is one, the question, and the
    opening of the answer with an empty thought, so that none is written. The markers are parameters."""
    turn = lambda role, text: F.concat(F.lit(f"{begin}{role}\n"), text, F.lit(f"{end}\n"))
    before = F.when(system.isNull(), F.lit("")).otherwise(turn("system", system))
    return F.concat(before, turn("user", F.coalesce(question, F.lit(""))), F.lit(f"{begin}assistant\n<think>\n\n</think>\n\n"))
