"""Chat records: validation, samples, group keys, role tokens and serialised dialogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import stripped

#: Special tokens and their ids.
SPECIAL_TOKENS = {"<PAD>": 0, "<UNK>": 1, "<BOS>": 2, "<EOS>": 3, "<USER>": 4, "<ASSISTANT>": 5}


def turns(messages: Column) -> Column:
    """The messages without a leading system message."""
    first = F.element_at(messages, 1)["role"]
    return F.when(F.size(messages) == 0, messages).otherwise(
        F.slice(messages, F.when(first == "system", 2).otherwise(1), F.greatest(F.size(messages), F.lit(1)))
    )


def is_valid_chat(messages: Column) -> Column:
    """At least one user/assistant pair after an optional system message, strictly alternating from user to assistant, every
    content (the system's too) more than blanks. Null messages, roles or contents make a record invalid."""
    t = turns(messages)
    filled = F.forall(messages, lambda m: F.coalesce(stripped(m["content"]) != "", F.lit(False)))
    in_turn = F.forall(
        F.transform(t, lambda m, i: F.coalesce(m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"), F.lit(False))), lambda x: x
    )
    return F.coalesce((F.size(t) >= 2) & (F.size(t) % 2 == 0) & filled & in_turn, F.lit(False))


def context_and_response(messages: Column) -> tuple[Column, Column]:
    """Contents of all turns but the last, and of the last."""
    t = turns(messages)
    before = F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0)))
    return F.transform(before, lambda m: m["content"]), F.try_element_at(t, F.lit(-1))["content"]


def group_key(board: Column, thread_id: Column, messages: Column) -> tuple[Column, Column]:
    """(board, thread) of a record: its own, else ``chatml`` and the first 8 bytes of the SHA-256 of its [role, content] list
    as unsigned number. The list is written as JSON with ", " between items and no ASCII escapes."""
    quoted = lambda s: F.to_json(F.array(s)).substr(F.lit(2), F.length(F.to_json(F.array(s))) - 2)
    items = F.transform(messages, lambda m: F.concat(F.lit("["), quoted(m["role"]), F.lit(", "), quoted(m["content"]), F.lit("]")))
    text = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    digest = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.coalesce(board, F.lit("chatml")), F.coalesce(thread_id.cast("decimal(20,0)"), digest)


def role_tokens(context: Column) -> Column:
    """A role per context text, alternating backwards from the last, which is the user's."""
    n = F.size(context)
    return F.transform(context, lambda _, i: F.when((n - i) % 2 == 1, "<USER>").otherwise("<ASSISTANT>"))


def serialized(context: Column, response: Column) -> Column:
    """One text of a dialogue: begin, each context text after its role, the answer after the assistant's, end."""
    said = F.zip_with(role_tokens(context), context, lambda r, t: F.concat(r, t))
    return F.concat(F.lit("<BOS>"), F.array_join(said, ""), F.lit("<ASSISTANT>"), response, F.lit("<EOS>"))


def pair_reason(messages: Column, sample_id: Column, flag: Column, thread_id: Column, user_id: Column, assistant_id: Column) -> Column:
    """Why a record is no question-answer pair: ``not_self_contained`` (told first), ``malformed``, or null for a pair."""
    two = (F.size(messages) == 2) & (F.element_at(messages, 1)["role"] == "user") & (F.try_element_at(messages, F.lit(2))["role"] == "assistant")
    filled = F.forall(messages, lambda m: F.coalesce(stripped(m["content"]) != "", F.lit(False)))
    named = (stripped(sample_id) != "") & thread_id.isNotNull() & user_id.isNotNull() & assistant_id.isNotNull()
    sound = F.coalesce(two & filled & named, F.lit(False))
    return F.when(~flag, "not_self_contained").when(flag.isNull() | ~sound, "malformed")


def qa_pairs(samples: DataFrame) -> DataFrame:
    """Samples with ``question``, ``answer`` and ``drop_reason``; exact repeats of a pair after the first (by ``sample_no``,
    then ``loaded_at``) are ``exact_duplicate``. Repeats are found by grouping on the pair's digest, so that no text is
    sorted and a pair of any number of rows is combined before the shuffle."""
    m = F.col("messages")
    rows = samples.select(
        "sample_no", "loaded_at", "sample_id",
        F.element_at(m, 1)["content"].alias("question"),
        F.try_element_at(m, F.lit(2))["content"].alias("answer"),
        pair_reason(m, F.col("sample_id"), F.col("metadata.self_contained_prompt"), F.col("metadata.thread_id"), F.col("metadata.user_post_id"), F.col("metadata.assistant_post_id")).alias("reason"),
    ).withColumn("pair", F.when(F.col("reason").isNull(), F.sha2(F.to_json(F.array("question", "answer")), 256)))
    first = rows.filter("pair is not null").groupBy("pair").agg(F.min(F.struct("sample_no", "loaded_at")).alias("first"))
    kept = rows.filter("pair is not null").join(first, "pair").withColumn(
        "drop_reason", F.when(F.struct("sample_no", "loaded_at") != F.col("first"), F.lit("exact_duplicate"))
    )
    columns = ["sample_no", "loaded_at", "sample_id", "question", "answer", "drop_reason"]
    return kept.select(*columns).unionByName(rows.filter("pair is null").withColumnRenamed("reason", "drop_reason").select(*columns))


def without_thinking(rows: DataFrame, response: str) -> DataFrame:
    """The rows, with an error at run time on a response that holds thinking markup."""
    bad = F.col(response).contains("<think>") | F.col(response).contains("</think>")
    return rows.withColumn(response, F.when(bad, F.raise_error(F.lit("thinking markup in a response"))).otherwise(F.col(response)))
