"""Reply-graph, duplicate, split, token and statistics queries over posts, samples and documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import chat, dedup, graph, sampling, splitting, statistics, tokens
from threadloom.operators.chat import SPECIAL_TOKENS
from threadloom.plans.texts import _VALID
from threadloom.stages import materialize


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _threads(spark, sf_dir) -> DataFrame:
    return materialize(graph.thread_posts(_t(spark, sf_dir, "posts")), "threads")


def reply_edges(spark, sf_dir):
    """References of posts to earlier posts of their thread."""
    return graph.reply_edges(_threads(spark, sf_dir)).select("thread_id", "child", "parent")


def ancestor_closure(spark, sf_dir):
    """How many posts each post answers, directly and through others, and the first of them."""
    closure = graph.ancestor_closure(materialize(graph.reply_edges(_threads(spark, sf_dir)), "edges"))
    return closure.groupBy("node").agg(F.count("*").alias("ancestors"), F.min("ancestor").alias("first_ancestor"))


def thread_sizes(spark, sf_dir):
    """Posts, answers and roots of each thread, with the place of its first and last post."""
    t = _threads(spark, sf_dir)
    answers = graph.reply_edges(t).select("thread_id", "child").distinct().groupBy("thread_id").agg(F.count("*").alias("answers"))
    sizes = t.groupBy("thread_id").agg(F.count("*").alias("posts"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))
    return sizes.join(answers, "thread_id", "left").fillna(0, ["answers"])


def thread_samples(spark, sf_dir):
    """Training samples of all threads: every answer with its context, judged for duplicates in thread order."""
    drafts = materialize(graph.thread_drafts(_t(spark, sf_dir, "posts")), "drafts")
    place = F.concat_ws("/", "source_path", F.format_string("%010d", "ord"), F.format_string("%020d", "post_id"), F.format_string("%04d", "draft"))
    ready = drafts.filter("drop_reason is null").withColumn("place", place)
    judged = dedup.classify(ready, "response", "place")
    reason = F.when(F.col("status") != "unique", F.col("status"))
    kept = judged.withColumn("drop_reason", reason).drop("status", "place")
    return kept.unionByName(drafts.filter("drop_reason is not null")).select(
        "thread_id", "post_id", "draft", "drop_reason", F.array_join("referenced_post_ids", ",").alias("parents"),
        F.coalesce(F.size("context_post_ids"), F.lit(0)).alias("context_depth"), "response", "multi_reference", "split_from_multi_reference",
    )


def drop_report(spark, sf_dir):
    """Answers of all threads by the reason they are dropped before duplicates are judged."""
    drafts = graph.thread_drafts(_t(spark, sf_dir, "posts"))
    return drafts.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("outcome")).agg(
        F.count("*").alias("drafts"), F.count_if("fallback_prevented").alias("fallbacks_prevented"), F.count_if("split_from_multi_reference").alias("split")
    )


def _documents(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("place"), "text")


def _spoken(spark, sf_dir) -> DataFrame:
    """(doc_id, place, text) of the samples: all that is said in one, once per sample number."""
    said = F.array_join(F.transform("messages", lambda m: F.coalesce(m["content"], F.lit(""))), " ")
    rows = _t(spark, sf_dir, "samples").filter("sample_no is not null and messages is not null").groupBy(F.col("sample_no").alias("doc_id")).agg(F.min(said).alias("text"))
    return rows.select("doc_id", F.col("doc_id").alias("place"), "text")


def shingle_pairs(spark, sf_dir):
    """Samples whose word shingles are alike by eight tenths, blocked on every shingle, so that none is missed."""
    texts = materialize(dedup.distinct_texts(_spoken(spark, sf_dir), "text", "place", exact=False), "texts")
    pairs = dedup.similar_pairs(texts, 0.8, "md5", anchors=0)
    at = texts.select("key", "place")
    named = pairs.join(at.withColumnsRenamed({"key": "later", "place": "later_id"}), "later").join(at.withColumnsRenamed({"key": "earlier", "place": "earlier_id"}), "earlier")
    return named.select("later_id", "earlier_id", "similarity")


def anchored_pairs(spark, sf_dir):
    """The same blocked on the four smallest shingle hashes: how many of all alike pairs that finds, and how many there are."""
    texts = materialize(dedup.distinct_texts(_spoken(spark, sf_dir), "text", "place", exact=False), "texts")
    every = materialize(dedup.similar_pairs(texts, 0.8, "md5", anchors=0), "every")
    found = dedup.similar_pairs(texts, 0.8, "md5").withColumn("hit", F.lit(1))
    return every.join(found.select("later", "earlier", "hit"), ["later", "earlier"], "left").agg(F.count("hit").alias("found"), F.count("*").alias("pairs"))


def greedy_dedup(spark, sf_dir):
    """Documents judged in the order of their ids: unique, exact or near duplicate of a kept one."""
    return dedup.classify(_documents(spark, sf_dir), exact=False, hashing="md5", similarity=0.8).select("doc_id", "status")


def greedy_dedup_samples(spark, sf_dir):
    """Samples judged in the order of their numbers: unique, exact or near duplicate of a kept one."""
    return dedup.classify(_spoken(spark, sf_dir), exact=False, hashing="md5", similarity=0.8).select("doc_id", "status")


def _grouped(spark, sf_dir) -> DataFrame:
    """All samples with their group: board and thread, else the digest of what is said."""
    code = F.lower(F.regexp_replace("metadata.board", r"[\s/]", ""))
    board, thread = chat.group_key(code, F.col("metadata.thread_id"), F.col("messages"))
    return _t(spark, sf_dir, "samples").select("sample_no", "loaded_at", board.alias("board"), thread.cast("string").alias("thread_id"), "split_name")


def group_split(spark, sf_dir):
    """Threads of the samples cut into train, validation and test in hash order."""
    return splitting.assign_groups(_grouped(spark, sf_dir), seed=42)


def split_report(spark, sf_dir):
    """Threads and samples per board and split, zeros included, and in all."""
    rows = _grouped(spark, sf_dir)
    assigned = splitting.assign_groups(rows, seed=42)
    return splitting.split_report(rows.select("board", "thread_id").join(assigned, ["board", "thread_id"]))


def leakage_check(spark, sf_dir):
    """Threads, and authors by their tripcodes, whose samples lie in more than one of the given splits."""
    rows = _grouped(spark, sf_dir).select("board", "thread_id", F.col("split_name").alias("split"))
    code = F.trim(F.regexp_extract("metadata.author_tag", r"(?s)(!.*)$", 1))
    authors = _t(spark, sf_dir, "samples").select(F.lit("author").alias("board"), code.alias("thread_id"), F.col("split_name").alias("split"))
    return splitting.leaking_groups(rows.unionByName(authors.filter(F.length("thread_id") > 1)))


def multiset_check(spark, sf_dir):
    """Sample numbers that occur more often in the table than once each."""
    rows = _t(spark, sf_dir, "samples").select("sample_no")
    return splitting.multiset_difference(rows, rows.distinct())


def _encoded(spark, sf_dir, max_length: int = 96) -> DataFrame:
    rows = _t(spark, sf_dir, "samples").filter(chat.is_valid_chat(F.col("messages")))
    context, response = chat.context_and_response(F.col("messages"))
    rows = rows.select("sample_no", "loaded_at", F.col("split_name").alias("split"), F.coalesce(F.lower(F.regexp_replace("metadata.board", r"[\s/]", "")), F.lit("chatml")).alias("board"), context.alias("context"), response.alias("response"))
    rows = rows.withColumns({"segs": tokens.segments(F.col("context")), "resp": tokens.response_ids(F.col("response"))})
    return rows.withColumn("ids", tokens.window(F.col("segs"), F.col("resp"), max_length))


def token_window(spark, sf_dir):
    """Token windows of at most 96 ids: the answer whole, context from the newest text back, the last one cut."""
    rows = _encoded(spark, sf_dir)
    return rows.select(
        "sample_no", "loaded_at", F.md5(F.array_join("ids", " ").cast("binary")).alias("digest"), F.when(F.col("ids").isNotNull(), F.size("ids")).alias("n"),
        F.when(F.col("ids").isNotNull(), tokens.response_start(F.col("ids"), F.col("resp"))).alias("response_start"),
    )


def whole_window(spark, sf_dir):
    """The same with whole context texts only and the last question mandatory."""
    rows = _encoded(spark, sf_dir).withColumn("ids", tokens.window(F.col("segs"), F.col("resp"), 96, partial=False))
    return rows.select("sample_no", "loaded_at", F.when(F.col("ids").isNotNull(), F.size("ids")).alias("n"))


def chat_window(spark, sf_dir):
    """How many of the oldest question-answer pairs must go for a chat to fit 96 tokens."""
    rows = _encoded(spark, sf_dir)
    sizes = F.transform("segs", lambda s: F.size(s).cast("long"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("segs") - 1, F.lit(1)), F.lit(2)), lambda i: F.element_at("z", i) + F.coalesce(F.try_element_at("z", i + 1), F.lit(0)))
    rows = rows.withColumn("z", sizes).withColumn("pairs", F.when(F.size("segs") > 1, pairs).otherwise(F.array().cast("array<bigint>")))
    fixed = F.element_at("z", -1) + F.size("resp") + 1
    return rows.select("sample_no", "loaded_at", tokens.chat_window_drop(F.col("pairs"), fixed, 96).alias("pairs_dropped"))


def training_rows(spark, sf_dir, max_length=96):
    """Inputs, masked labels and loss tokens of windows that fit, in both label forms."""
    rows = _encoded(spark, sf_dir, max_length).filter("ids is not null")
    start = tokens.response_start(F.col("ids"), F.col("resp"))
    shifted, labels = tokens.shifted_rows(F.col("ids"), start)
    return rows.select(
        "sample_no", "loaded_at", F.size(shifted).alias("inputs"), tokens.loss_tokens(labels).alias("loss_tokens"),
        tokens.loss_tokens(tokens.unshifted_labels(F.col("ids"), start), shifted=False).alias("unshifted_loss_tokens"),
        F.md5(F.array_join(labels, " ").cast("binary")).alias("label_digest"),
    )


def padded_batches(spark, sf_dir, max_length=96):
    """Batches of eight rows per board, padded to their longest row."""
    rows = _encoded(spark, sf_dir, max_length).filter("ids is not null")
    start = tokens.response_start(F.col("ids"), F.col("resp"))
    shifted, labels = tokens.shifted_rows(F.col("ids"), start)
    rows = rows.select("sample_no", "loaded_at", "board", shifted.alias("input_ids"), labels.alias("labels"))
    rows = tokens.batches(rows, ["sample_no", "loaded_at"], 8, ["board"])
    padded = tokens.padded(rows, ["board", "batch_no"])
    return padded.groupBy("board", "batch_no").agg(
        F.count("*").alias("rows"), F.max(F.size("input_ids")).alias("width"), F.sum(F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x)).alias("real_tokens"),
        F.sum(F.size(F.filter("labels", lambda x: x == tokens.IGNORED))).alias("ignored_labels"),
    )


def packed_rows(spark, sf_dir, max_length=96, capacity=256):
    """Training rows packed whole into bins of ``capacity`` tokens."""
    rows = _encoded(spark, sf_dir, max_length).filter("ids is not null").withColumn("key", F.struct("sample_no", "loaded_at"))
    start = tokens.response_start(F.col("ids"), F.col("resp"))
    ready = materialize(rows.select("key", F.col("ids").alias("input_ids"), tokens.unshifted_labels(F.col("ids"), start).alias("labels")), "rows")
    packed = tokens.pack_rows(ready, "key", capacity)
    return packed.select("bin_no", F.size("input_ids").alias("used"), F.size("labels").alias("labels"), F.array_join("seq_lengths", ",").alias("lengths"))


def packing_totals(spark, sf_dir, max_length=96, capacity=256):
    """What must hold of any packing: rows and tokens in all, and no bin above the capacity."""
    packed = packed_rows(spark, sf_dir, max_length, capacity)
    return packed.agg(F.sum("used").alias("tokens"), F.sum(F.size(F.split("lengths", ","))).alias("rows"), (F.max("used") <= capacity).alias("within"), (F.sum("used") / F.count("*") > capacity * 200 / 256).alias("well_filled"))


def token_statistics(spark, sf_dir, max_length=96):
    """Token statistics per split, per board and in all."""
    return statistics.token_statistics(statistics.measured(_encoded(spark, sf_dir, max_length), max_length))


def length_distributions(spark, sf_dir):
    """Distribution of whole sample lengths per split."""
    rows = statistics.measured(_encoded(spark, sf_dir), 96)
    return statistics.distribution(rows, ["split"], "tokens", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


def window_fit(spark, sf_dir, windows=(64, 128, 256)):
    """Samples that fit windows of 64, 128 and 256 tokens."""
    return statistics.window_fit(statistics.measured(_encoded(spark, sf_dir), 96), "tokens", windows)


def context_sizes(spark, sf_dir):
    """Samples and threads by the number of context texts."""
    rows = _encoded(spark, sf_dir)
    return rows.groupBy(F.size("context").alias("context_texts")).agg(F.count("*").alias("samples"), F.countDistinct("sample_no").alias("distinct_samples"))


def label_audit(spark, sf_dir):
    """Training rows whose labels hold the end of the answer, and how many such ends there are."""
    rows = _encoded(spark, sf_dir).filter("ids is not null")
    labels = tokens.unshifted_labels(F.col("ids"), tokens.response_start(F.col("ids"), F.col("resp")))
    return sampling.label_audit(rows.select(labels.alias("labels")), "labels", SPECIAL_TOKENS["<EOS>"])


QUERIES = {f.__name__: f for f in (
    reply_edges, ancestor_closure, thread_sizes, thread_samples, drop_report, shingle_pairs, anchored_pairs, greedy_dedup, greedy_dedup_samples, group_split, split_report, leakage_check,
    multiset_check, token_window, whole_window, chat_window, training_rows, padded_batches, packed_rows, packing_totals, token_statistics,
    length_distributions, window_fit, context_sizes, label_audit,
)}
#: The same at the reference's default window and report windows; those above show truncation at 96 tokens.
QUERIES |= {
    "training_rows_512": lambda spark, sf_dir: training_rows(spark, sf_dir, 512),
    "padded_batches_512": lambda spark, sf_dir: padded_batches(spark, sf_dir, 512),
    "packed_rows_512": lambda spark, sf_dir: packed_rows(spark, sf_dir, 512, 512),
    "packing_totals_512": lambda spark, sf_dir: packing_totals(spark, sf_dir, 512, 512),
    "token_statistics_512": lambda spark, sf_dir: token_statistics(spark, sf_dir, 512),
    "window_fit_1024": lambda spark, sf_dir: window_fit(spark, sf_dir, (512, 768, 1024)),
}

_EDGES = r"""kept AS (
  SELECT post_id, thread_id, ord, list_transform(list_filter(refs, lambda r: regexp_full_match(r, '>>[0-9]+')), lambda r: TRY_CAST(substr(r, 3) AS BIGINT)) AS refs
  FROM posts WHERE post_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY fetched_at DESC NULLS LAST, thread_id DESC, ord DESC, text DESC) = 1),
edges AS (
  SELECT DISTINCT c.thread_id, c.post_id AS child, p.post_id AS parent
  FROM (SELECT thread_id, post_id, ord, unnest(refs) AS ref FROM kept) c JOIN kept p ON p.thread_id = c.thread_id AND p.post_id = c.ref AND p.ord < c.ord)"""

_SPOKEN = """spoken AS (SELECT sample_no AS doc_id, min(array_to_string(list_transform(messages, lambda m: coalesce(m.content, '')), ' ')) AS text FROM samples WHERE sample_no IS NOT NULL AND messages IS NOT NULL GROUP BY 1)"""

_SHINGLES = r"""c AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') AS c FROM documents),
firsts AS (SELECT c, min(doc_id) AS id FROM c WHERE length(c) >= 80 GROUP BY c),
words AS (SELECT id, c, string_split(c, ' ') AS w FROM firsts),
grams AS (SELECT id, length(c) AS n, list_distinct(list_transform(CASE WHEN len(w) < 3 THEN w ELSE
  list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END, lambda g: CAST('0x' || substr(md5(g), 1, 15) AS BIGINT))) AS s FROM words),
anchors AS (SELECT id, n, unnest(list_sort(s)[1:4]) AS a FROM grams),
cand AS (SELECT DISTINCT x.id AS later, y.id AS earlier FROM anchors x JOIN anchors y ON x.a = y.a AND y.id < x.id
  WHERE least(x.n, y.n) / greatest(x.n, y.n) >= {t}),
resembling AS (SELECT later, earlier, len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) AS similarity
  FROM cand JOIN grams x ON x.id = later JOIN grams y ON y.id = earlier),
alike AS (SELECT * FROM resembling WHERE similarity >= {t})"""

_GROUPS = r"""g AS (SELECT sample_no, coalesce(lower(regexp_replace(metadata.board, '[\s/]', '', 'g')), 'chatml') AS board, coalesce(metadata.thread_id::VARCHAR,
  (CAST('0x' || substr(sha256('[' || array_to_string(list_transform(messages, lambda m: '[' || to_json(m.role)::VARCHAR || ', ' || coalesce(to_json(m.content)::VARCHAR, 'null') || ']'), ', ') || ']'), 1, 16) AS UBIGINT))::VARCHAR) AS thread_id,
  split_name FROM samples),
ranked AS (SELECT board, thread_id, row_number() OVER (ORDER BY sha256('42:' || board || ':' || thread_id), board, thread_id) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT board, thread_id FROM g)),
assigned AS (SELECT board, thread_id, CASE WHEN k < floor(n * 0.9::DOUBLE) THEN 'train' WHEN k < floor(n * 0.9::DOUBLE) + floor(n * 0.05::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM ranked)"""

_IDS = rf"""{_VALID},
coded AS (
  SELECT sample_no, loaded_at, split_name AS split, coalesce(lower(regexp_replace(metadata.board, '[\s/]', '', 'g')), 'chatml') AS board, context, response,
    list_transform(context, lambda c, i: list_concat([CASE WHEN (len(context) - i) % 2 = 0 THEN 4 ELSE 5 END],
      list_transform(list_filter(regexp_split_to_array(c, '\s+'), lambda w: w <> ''), lambda w: CAST('0x' || substr(md5(w), 1, 15) AS BIGINT) % 1000000 + 6))) AS segs,
    list_concat([5], list_transform(list_filter(regexp_split_to_array(response, '\s+'), lambda w: w <> ''), lambda w: CAST('0x' || substr(md5(w), 1, 15) AS BIGINT) % 1000000 + 6), [3]) AS resp FROM chats),
seg AS (SELECT sample_no, loaded_at, unnest(segs) AS s, unnest(range(1, len(segs) + 1)) AS k, 96 - len(resp) - 1 AS room, len(segs) AS m FROM coded),
cum AS (SELECT *, sum(len(s)) OVER (PARTITION BY sample_no, loaded_at ORDER BY k DESC) AS upto FROM seg),
part AS (SELECT *, CASE WHEN upto <= room THEN s WHEN upto - len(s) <= room AND room - (upto - len(s)) >= 2
  THEN list_concat([s[1]], s[len(s) - CAST(room - (upto - len(s)) AS INT) + 2:]) END AS keep FROM cum),
ctx AS (SELECT sample_no, loaded_at, flatten(list(keep ORDER BY k) FILTER (keep IS NOT NULL)) AS ids, sum(len(s)) FILTER (upto <= room) AS whole, bool_or(k = m AND upto <= room) AS newest FROM part GROUP BY ALL),
win AS (SELECT c.*, CASE WHEN len(resp) + 1 <= 96 THEN list_concat([2], coalesce(x.ids, []), resp) END AS ids, coalesce(x.whole, 0) AS whole, x.newest FROM coded c LEFT JOIN ctx x USING (sample_no, loaded_at)),
measured AS (SELECT *, CAST(list_sum(list_transform(segs, lambda s: len(s))) AS BIGINT) AS ct, len(resp) AS rt, len(context) AS cn, CAST(list_sum(list_transform(context, lambda s: length(s))) AS BIGINT) AS cc, length(response) AS rc, len(ids) AS wt,
  CAST(list_sum(list_transform(segs, lambda s: len(s))) AS BIGINT) + len(resp) + 1 AS tokens FROM win)"""

_STATS = """count(*) AS samples, count(wt) AS usable_samples, count(*) - count(wt) AS oversized_samples, sum(tokens)::BIGINT AS raw_tokens, coalesce(sum(wt), 0)::BIGINT AS effective_tokens,
  coalesce(sum(rt - 1) FILTER (wt IS NOT NULL), 0)::BIGINT AS training_loss_tokens, count(*) FILTER (tokens <= 96) AS raw_within_window, count(*) FILTER (wt = 96) AS full_window_samples,
  count(*) FILTER (wt < 96) AS shorter_window_samples, count(*) FILTER (wt - rt - 1 < ct) AS truncated_samples, sum(ct)::BIGINT AS context_tokens,
  coalesce(sum(ct) FILTER (wt IS NOT NULL), 0)::BIGINT AS usable_context_tokens, coalesce(sum(wt - rt - 1), 0)::BIGINT AS effective_context_tokens, sum(rt)::BIGINT AS response_tokens,
  sum(ct - cn)::BIGINT AS context_content_tokens, sum(rt - 2)::BIGINT AS response_content_tokens, count(*) FILTER (rt > 96) AS responses_over_window, sum(cc)::BIGINT AS context_chars, sum(rc)::BIGINT AS response_chars,
  coalesce((sum(cc) + sum(rc)) / (sum(ct - cn) + sum(rt - 2)), 0) AS chars_per_token,
  coalesce((coalesce(sum(ct) FILTER (wt IS NOT NULL), 0) - coalesce(sum(wt - rt - 1), 0)) * 100.0::DOUBLE / nullif(sum(ct) FILTER (wt IS NOT NULL), 0), 0) AS lost_percent"""

ORACLES = {
    "reply_edges": f"WITH {_EDGES} SELECT thread_id, child, parent FROM edges",
    "ancestor_closure": f"""WITH RECURSIVE {_EDGES},
reach AS (SELECT child AS node, parent AS ancestor FROM edges UNION SELECT r.node, e.parent FROM reach r JOIN edges e ON e.child = r.ancestor)
SELECT node, count(*) AS ancestors, min(ancestor) AS first_ancestor FROM reach GROUP BY node""",
    "thread_sizes": f"""WITH {_EDGES}, a AS (SELECT thread_id, count(DISTINCT child) AS answers FROM edges GROUP BY 1)
SELECT thread_id, count(*) AS posts, min(ord) AS first_ord, max(ord) AS last_ord, coalesce(any_value(answers), 0) AS answers FROM kept LEFT JOIN a USING (thread_id) GROUP BY thread_id""",
    "shingle_pairs": f"WITH {_SPOKEN}, {_SHINGLES.replace('{t}', '0.8').replace('list_sort(s)[1:4]', 's').replace('FROM documents', 'FROM spoken')} SELECT later AS later_id, earlier AS earlier_id, similarity FROM alike",
    "anchored_pairs": f"""WITH {_SPOKEN}, {_SHINGLES.replace('{t}', '0.8').replace('FROM documents', 'FROM spoken')},
n AS (SELECT count(*) AS found FROM alike), eb AS (SELECT id, n, unnest(s) AS a FROM grams),
ec AS (SELECT DISTINCT x.id AS later, y.id AS earlier FROM eb x JOIN eb y ON x.a = y.a AND y.id < x.id WHERE least(x.n, y.n) / greatest(x.n, y.n) >= 0.8)
SELECT (SELECT found FROM n) AS found, count(*) AS pairs FROM ec JOIN grams x ON x.id = later JOIN grams y ON y.id = earlier
WHERE len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) >= 0.8""",
    "greedy_dedup": f"""WITH RECURSIVE {_SHINGLES.replace("{t}", "0.8")},
nodes AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT DISTINCT later AS id FROM alike)),
walk AS (
  SELECT 0::BIGINT AS k, [0::BIGINT] AS gone
  UNION ALL
  SELECT w.k + 1, CASE WHEN EXISTS (SELECT 1 FROM alike a WHERE a.later = n.id AND NOT list_contains(w.gone, a.earlier)) THEN list_append(w.gone, n.id) ELSE w.gone END
  FROM walk w JOIN nodes n ON n.k = w.k + 1),
gone AS (SELECT unnest(gone) AS id FROM (SELECT gone FROM walk ORDER BY k DESC LIMIT 1))
SELECT d.doc_id, CASE WHEN f.id IS NULL THEN 'unique' WHEN f.id IN (SELECT id FROM gone) THEN 'near_duplicate' WHEN f.id = d.doc_id THEN 'unique' ELSE 'exact_duplicate' END AS status
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN firsts f ON f.c = c.c""",
    "group_split": f"WITH {_GROUPS} SELECT board, thread_id, split FROM assigned",
    "split_report": f"""WITH {_GROUPS}, r AS (SELECT g.board, split, count(DISTINCT thread_id) AS threads, count(*) AS samples FROM g JOIN assigned USING (board, thread_id) GROUP BY ALL),
grid AS (SELECT board, split FROM (SELECT DISTINCT board FROM g), (VALUES ('train'), ('validation'), ('test')) s(split)),
f AS (SELECT board, split, coalesce(threads, 0) AS threads, coalesce(samples, 0) AS samples FROM grid LEFT JOIN r USING (board, split))
SELECT * FROM f UNION ALL SELECT NULL, split, sum(threads)::BIGINT, sum(samples)::BIGINT FROM f GROUP BY split""",
    "leakage_check": f"""WITH {_GROUPS}, a AS (SELECT board, thread_id, split_name FROM g
  UNION ALL SELECT 'author', trim(regexp_extract(metadata.author_tag, '(?s)(!.*)$', 1), ' '), split_name FROM samples WHERE length(trim(regexp_extract(metadata.author_tag, '(?s)(!.*)$', 1), ' ')) > 1)
SELECT board, thread_id, count(DISTINCT split_name) AS splits FROM a GROUP BY ALL HAVING count(DISTINCT split_name) > 1""",
    "multiset_check": "SELECT sample_no, count(*) - 1 AS surplus FROM samples GROUP BY sample_no HAVING count(*) > 1",
    "token_window": f"""WITH {_IDS} SELECT sample_no, loaded_at, md5(array_to_string(ids, ' ')) AS digest, len(ids)::INT AS n, CASE WHEN ids IS NOT NULL THEN len(ids) - len(resp) + 1 END::INT AS response_start FROM win""",
    "whole_window": f"WITH {_IDS} SELECT sample_no, loaded_at, CASE WHEN len(resp) + 1 <= 96 AND newest THEN 1 + whole + len(resp) END::INT AS n FROM win",
    "chat_window": f"""WITH {_IDS}, q AS (SELECT sample_no, loaded_at, list_transform(segs, lambda s: len(s)) AS z, len(resp) + 1 AS f FROM coded),
k AS (SELECT *, unnest(range(0, CAST((len(z) - 1) / 2 AS INT) + 1)) AS d FROM q)
SELECT q.sample_no, q.loaded_at, min(d) FILTER (f + list_sum(k.z[2 * d + 1:]) <= 96)::INT AS pairs_dropped FROM q LEFT JOIN k USING (sample_no, loaded_at, f) GROUP BY ALL""",
    "training_rows": f"""WITH {_IDS}, l AS (SELECT sample_no, loaded_at, ids, len(ids) - len(resp) + 1 AS st, resp FROM win WHERE ids IS NOT NULL)
SELECT sample_no, loaded_at, (len(ids) - 1)::INT AS inputs, (len(resp) - 1)::INT AS loss_tokens, (len(resp) - 1)::INT AS unshifted_loss_tokens,
  md5(array_to_string(list_concat(list_transform(range(0, st - 1), lambda i: -100), resp[2:]), ' ')) AS label_digest FROM l""",
    "padded_batches": f"""WITH {_IDS}, b AS (SELECT board, floor((row_number() OVER (PARTITION BY board ORDER BY sample_no, loaded_at) - 1) / 8)::BIGINT AS batch_no, len(ids) - 1 AS n, len(resp) - 1 AS loss FROM win WHERE ids IS NOT NULL)
SELECT board, batch_no, count(*) AS rows, max(n)::INT AS width, sum(n)::BIGINT AS real_tokens, (count(*) * max(n) - sum(loss))::BIGINT AS ignored_labels FROM b GROUP BY ALL""",
    "packing_totals": f"WITH {_IDS} SELECT sum(len(ids))::BIGINT AS tokens, count(*) AS rows, true AS within, true AS well_filled FROM win WHERE ids IS NOT NULL",
    "token_statistics": f"""WITH {_IDS}
SELECT 'split' AS slice, split, NULL AS board, {_STATS} FROM measured GROUP BY split
UNION ALL SELECT 'board', NULL, board, {_STATS} FROM measured GROUP BY board UNION ALL SELECT 'total', NULL, NULL, {_STATS} FROM measured""",
    "length_distributions": f"""WITH {_IDS}, o AS (SELECT split, list(tokens ORDER BY tokens) AS v, count(*) AS n FROM measured GROUP BY split)
SELECT split, n AS count, v[1] AS min, v[n] AS max, list_avg(v) AS mean, (v[CAST(floor((n - 1) / 2) AS INT) + 1] + v[CAST(floor(n / 2) AS INT) + 1]) / 2 AS median, v[CAST(floor(n / 2) AS INT) + 1] AS upper_median,
  v[CAST(least(n - 1, floor(n * 9 / 10)) AS INT) + 1] AS p90_upper, v[greatest(0, CAST(floor(n * 0.5::DOUBLE + 0.999999) AS INT) - 1) + 1] AS p50, v[greatest(0, CAST(floor(n * 0.9::DOUBLE + 0.999999) AS INT) - 1) + 1] AS p90,
  v[greatest(0, CAST(floor(n * 0.95::DOUBLE + 0.999999) AS INT) - 1) + 1] AS p95, v[greatest(0, CAST(floor(n * 0.99::DOUBLE + 0.999999) AS INT) - 1) + 1] AS p99 FROM o""",
    "window_fit": f'WITH {_IDS} SELECT w::INT AS "window", count(*) FILTER (tokens <= w) AS samples, 100.0::DOUBLE * count(*) FILTER (tokens <= w) / count(*) AS percentage FROM measured, (VALUES (64), (128), (256)) x(w) GROUP BY w',
    "context_sizes": f"WITH {_IDS} SELECT len(context)::INT AS context_texts, count(*) AS samples, count(DISTINCT sample_no) AS distinct_samples FROM coded GROUP BY 1",
}
ORACLES["greedy_dedup_samples"] = ORACLES["greedy_dedup"].replace("WITH RECURSIVE", f"WITH RECURSIVE {_SPOKEN},").replace("FROM documents", "FROM spoken")
ORACLES["label_audit"] = f"""WITH {_IDS}, e AS (SELECT len(list_filter(resp[2:], lambda x: x = 3)) AS n FROM win WHERE ids IS NOT NULL)
SELECT count(*) AS rows, count(*) FILTER (n > 0) AS rows_with_end, coalesce(sum(n), 0)::BIGINT AS end_tokens FROM e"""
ORACLES |= {f"{name}_512": re.sub(r"\b96\b", "512", ORACLES[name]) for name in ("training_rows", "padded_batches", "packing_totals", "token_statistics")}
ORACLES["window_fit_1024"] = ORACLES["window_fit"].replace("(64), (128), (256)", "(512), (768), (1024)")
