"""Reply graphs: valid parents, ancestor closure, split answers and training samples of threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import SPACE, bind, clean_text, exact_references, is_image_reply, is_meaningful, lines_of, quotable_lines, stripped, without_lines, without_quotes
from threadloom.operators.hierarchy import newest_posts
from threadloom.stages import Stage, materialize


def thread_posts(posts: DataFrame) -> DataFrame:
    """(thread_id, post_id, ord, text, refs, board, source_path): the newest row of each post, ``refs`` as distinct ids in order."""
    rows = posts.withColumn("refs", exact_references("refs"))
    return newest_posts(rows, "thread_id", "ord", "text", "refs", "board", "source_path")


def reply_edges(threads: DataFrame) -> DataFrame:
    """(thread_id, child, parent, at) of references to earlier posts of the same thread; ``at`` is the place in ``refs``.

    A thread of one post has no edges and its first post never has a parent. The join is on (thread, post) with the order as
    a residual; a post that very many answer is split by adaptive joins.
    """
    named = threads.select("thread_id", F.col("post_id").alias("child"), F.col("ord").alias("child_ord"), F.posexplode("refs").alias("at", "parent"))
    there = threads.select("thread_id", F.col("post_id").alias("parent"), F.col("ord").alias("parent_ord"))
    return named.join(there, ["thread_id", "parent"]).filter("parent_ord < child_ord").select("thread_id", "child", "parent", "at")


def ancestor_closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor) for the acyclic edges (child, parent): all parents, their parents and so on.

    Path doubling: what lies within 2k steps is what lies within k steps, and within k steps of what is k steps away. So a
    round adds about as many pairs as there are, rounds grow with the logarithm of the depth, and pairs are made distinct in
    each round, so that diamonds don't multiply them.
    """
    first = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct()
    known = Stage(first.withColumn("last", F.lit(True)), "closure")  # ``last``: found in exactly as many steps as were taken
    while not known.df.filter("last").isEmpty():
        away = known.df.filter("last").select("node", F.col("ancestor").alias("via"))
        beyond = known.df.select(F.col("node").alias("via"), "ancestor", "last")
        grown = known.df.withColumn("last", F.lit(False)).unionByName(away.join(beyond, "via").drop("via"))
        more = Stage(grown.groupBy("node", "ancestor").agg(F.max("last").alias("last")), "closure")
        known.drop()
        known = more
    return known.df.drop("last")


def split_answer(text: Column | str, parents: Column | str) -> Column:
    """The parts (parent, text) of an answer to several posts, in order of first mention; null where it can't be told apart.

    The text is cut before every line that begins with a reference. It can be told apart if each piece is headed by just one
    reference, to one of two or more ``parents``, and every parent is given some text. Lines lose their outer blanks, empty
    ones are left out, and pieces to one parent are joined. Null texts or parents give null.
    """
    column = F.col(text) if isinstance(text, str) else text
    wanted = F.array_distinct(F.col(parents) if isinstance(parents, str) else parents)
    lines = F.filter(F.transform(lines_of(column), stripped), lambda x: x != "")
    pieces = F.split(F.array_join(lines, "\n"), r"\n(?=>>[0-9])")

    def headed(piece: Column) -> Column:
        heads = F.regexp_extract_all(F.regexp_extract(piece, rf"^(?:{SPACE}*>>[0-9]+)+", 0), F.lit("[0-9]+"), 0)
        said = stripped(F.regexp_replace(piece, rf"^(?:{SPACE}*>>[0-9]+)+", ""))
        return F.struct(F.when(F.size(heads) == 1, F.element_at(heads, 1).try_cast("long")).alias("parent"), said.alias("text"))

    def by_parent(cut: Column) -> Column:
        named = F.array_distinct(F.transform(cut, lambda x: x["parent"]))
        said = lambda p: F.filter(F.transform(F.filter(cut, lambda x: x["parent"] == p), lambda x: x["text"]), lambda t: t != "")
        parts = F.transform(named, lambda p: F.struct(p.alias("parent"), F.array_join(said(p), "\n").alias("text")))
        sound = F.forall(named, lambda p: p.isNotNull() & F.array_contains(wanted, p)) & (F.size(named) == F.size(wanted)) & (F.size(wanted) > 1)
        return F.when(sound & F.forall(parts, lambda x: x["text"] != ""), parts)

    return bind(F.transform(pieces, headed), by_parent)


def validity(cleaned: Column) -> Column:
    """Why a cleaned text can't be used: ``empty_after_cleaning``, ``image_dependent`` or null."""
    return F.when(~F.coalesce(is_meaningful(cleaned), F.lit(False)), "empty_after_cleaning").when(is_image_reply(cleaned), "image_dependent")


def thread_drafts(posts: DataFrame) -> DataFrame:
    """Every answer of every thread with the posts of its context, or the reason why it is none.

    Columns: thread_id, board, source_path, post_id, ord, draft (from 0), drop_reason, referenced_post_ids, context_post_ids (in
    thread order), response, multi_reference, split_from_multi_reference, fallback_prevented. Reasons, first hit: of the post
    ``empty_after_cleaning``, ``image_dependent``, ``missing_reliable_parent``; of a draft ``missing_context`` and then the first
    two again, once quotes of the context are taken out. Duplicates are left to ``dedup.classify``.

    Of a context only numbers travel: the posts' ids, places and hashes of the lines that an answer may quote. Its texts are for
    ``with_context_texts``, once duplicates are gone.
    """
    judged = bind(clean_text("text"), lambda c: F.struct(c.alias("cleaned"), validity(c).alias("reason")))
    t = thread_posts(posts).withColumn("j", judged)
    t = materialize(t.select("*", "j.*").drop("j"), "posts")
    edges = materialize(reply_edges(t), "edges")
    parents = edges.groupBy("child").agg(F.sort_array(F.collect_list(F.struct("at", "parent"))).alias("p")).select(  # bounded by one post's refs
        F.col("child").alias("post_id"), F.transform("p", lambda x: x["parent"]).alias("parents")
    )
    # The first post and the size of each thread, aggregated, never collected as a group.
    heads = t.groupBy("thread_id").agg(F.min(F.struct("ord", "post_id", "reason", "cleaned")).alias("root"), F.count("*").alias("size"))
    answers = t.join(heads.filter("size > 1"), "thread_id").filter(F.col("post_id") != F.col("root.post_id")).join(parents, "post_id", "left")
    body = answers.withColumn("parents", F.coalesce("parents", F.array().cast("array<bigint>")))
    prevented = (
        F.col("reason").isNull() & (F.size("parents") == 0) & (F.size("refs") == 0) & F.col("root.reason").isNull()
        & bind(without_quotes(F.col("cleaned"), F.array("root.cleaned")), lambda t: is_meaningful(t) & ~is_image_reply(t))
    )
    body = body.select(
        "thread_id", "board", "source_path", "post_id", "ord", "text", "cleaned", "parents", prevented.alias("fallback_prevented"),
        F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.size("parents") == 0, "missing_reliable_parent").alias("reason"),
    )
    body = materialize(body, "answers")
    open_ = body.filter("reason is null")
    whole = open_.select("*", F.lit(0).alias("draft"), F.col("parents").alias("to"), F.col("cleaned").alias("clean"), F.lit(False).alias("split"))
    many = open_.filter("size(parents) > 1").withColumn("parts", split_answer("text", "parents"))
    cut = many.filter("parts is not null").select("*", F.posexplode("parts").alias("draft", "d"))
    cut = cut.select(*body.columns, "draft", F.array("d.parent").alias("to"), clean_text("d.text").alias("clean"), F.lit(True).alias("split"))
    uncut = whole.filter("size(parents) = 1").unionByName(
        many.filter("parts is null").select(*body.columns, F.lit(0).alias("draft"), F.col("parents").alias("to"), F.col("cleaned").alias("clean"), F.lit(False).alias("split"))
    )
    drafts = materialize(uncut.unionByName(cut).drop("text", "cleaned", "reason"), "drafts")
    usable = t.filter("reason is null").select(F.col("post_id").alias("ancestor"), F.col("ord").alias("at"), quotable_lines("cleaned").alias("lines"))
    to = drafts.select("post_id", "draft", F.explode("to").alias("parent"))
    named = to.select("post_id", "draft", F.col("parent").alias("ancestor"), F.lit(True).alias("direct"))
    beyond = to.join(ancestor_closure(edges).withColumnRenamed("node", "parent"), "parent").select("post_id", "draft", "ancestor", F.lit(False).alias("direct"))
    reach = named.unionByName(beyond).groupBy("post_id", "draft", "ancestor").agg(F.max("direct").alias("direct"))
    known = reach.join(usable, "ancestor", "left")
    context = known.groupBy("post_id", "draft").agg(  # bounded by the depth of one reply chain
        F.max(F.col("direct") & F.col("at").isNull()).alias("lacks"),
        F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "ancestor")))).alias("c"),
        F.array_distinct(F.flatten(F.collect_list("lines"))).alias("told"),
    )
    ready = drafts.join(context, ["post_id", "draft"], "left")
    answer = bind(without_lines(F.col("clean"), F.col("told")), lambda r: F.struct(r.alias("response"), validity(r).alias("unusable")))
    ready = ready.withColumn("a", answer).select("*", "a.*")
    done = ready.select(
        "thread_id", "board", "source_path", "post_id", "ord", "draft",
        F.when(F.coalesce("lacks", F.lit(False)) | (F.coalesce(F.size("c"), F.lit(0)) < 1), "missing_context").otherwise(F.col("unusable")).alias("drop_reason"),
        F.col("to").alias("referenced_post_ids"), F.transform("c", lambda x: x["ancestor"]).alias("context_post_ids"), "response",
        (F.size("parents") > 1).alias("multi_reference"), F.col("split").alias("split_from_multi_reference"), "fallback_prevented",
    )
    fields = dict(done.dtypes)
    none = lambda c: F.lit(None).cast(fields[c]).alias(c)
    dropped = body.filter("reason is not null").select(
        "thread_id", "board", "source_path", "post_id", "ord", F.lit(0).alias("draft"), F.col("reason").alias("drop_reason"),
        F.col("parents").alias("referenced_post_ids"), none("context_post_ids"), none("response"), (F.size("parents") > 1).alias("multi_reference"),
        F.lit(False).alias("split_from_multi_reference"), "fallback_prevented",
    )
    return done.unionByName(dropped)


def with_context_texts(drafts: DataFrame, posts: DataFrame) -> DataFrame:
    """``drafts`` with ``context``: (post_id, text) of its ``context_post_ids``, cleaned, in their order; null where there are none."""
    texts = newest_posts(posts, "text").select(F.col("post_id").alias("_id"), clean_text("text").alias("_text"))
    each = drafts.filter("size(context_post_ids) > 0").select("post_id", "draft", F.posexplode("context_post_ids").alias("_at", "_id"))
    told = each.join(texts, "_id").groupBy("post_id", "draft").agg(F.sort_array(F.collect_list(F.struct("_at", F.col("_id").alias("post_id"), F.col("_text").alias("text")))).alias("_c"))
    joined = drafts.join(told, ["post_id", "draft"], "left")
    return joined.select(*drafts.columns, F.transform("_c", lambda x: F.struct(x["post_id"].alias("post_id"), x["text"].alias("text"))).alias("context"))


def first_posts(threads: DataFrame) -> DataFrame:
    """Posts ranked in their thread, by place."""
    return threads.withColumn("rank", F.row_number().over(Window.partitionBy("thread_id").orderBy("ord", "post_id")))
