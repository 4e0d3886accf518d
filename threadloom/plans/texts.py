"""Text, source and chat queries over posts, threads, samples and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import catalog, chat
from threadloom.sources import files


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_posts(spark, sf_dir):
    """Every post row's cleaned text with why it can't be used, if so."""
    usable = lambda t: F.coalesce(X.is_meaningful(t) & ~X.is_image_reply(t), F.lit(False))
    judged = X.bind(X.clean_text("text"), lambda t: F.struct(t.alias("cleaned"), usable(t).alias("usable")))
    return _t(spark, sf_dir, "posts").select("post_id", "ord", "fetched_at", judged.alias("j")).select("post_id", "ord", "fetched_at", "j.*")


def text_noise(spark, sf_dir):
    """Documents without links, addresses, numbers to call, handles, references and author marks, by length and digest."""
    bare = X.without_noise("text")
    return _t(spark, sf_dir, "documents").select("doc_id", F.length(bare).alias("chars"), F.md5(bare.cast("binary")).alias("digest"))


def squeezed_text(spark, sf_dir):
    """Documents without control characters, extra blanks and empty lines."""
    return _t(spark, sf_dir, "documents").select("doc_id", X.squeezed("text").alias("squeezed"))


def meaningful_posts(spark, sf_dir):
    """Post rows by whether their text means anything by itself."""
    rows = _t(spark, sf_dir, "posts").select(
        F.coalesce(X.is_meaningful("text"), F.lit(False)).alias("meaningful"), F.coalesce(X.is_image_reply("text"), F.lit(False)).alias("image_reply")
    )
    return rows.groupBy("meaningful", "image_reply").agg(F.count("*").alias("posts"))


def text_references(spark, sf_dir):
    """Distinct references in the text of a post, in order."""
    return _t(spark, sf_dir, "posts").filter("text is not null").select("post_id", F.array_join(X.references("text"), ",").alias("refs")).distinct()


def canonical_copies(spark, sf_dir):
    """Documents that equal another one but for case, punctuation and spacing, with the first of them."""
    rows = _t(spark, sf_dir, "documents").select("doc_id", X.canonical("text", exact=False).alias("c")).filter("c <> ''")
    first = rows.groupBy(F.sha2("c", 256).alias("k")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")
    return rows.select("doc_id", F.sha2("c", 256).alias("k")).join(first, "k").select("doc_id", "first_id", "copies")


def thread_urls(spark, sf_dir):
    """Board and thread named by each thread's addresses."""
    board, number = files.board_url(F.col("source_url"), ["board.example"])
    return _t(spark, sf_dir, "threads").select("thread_id", board.alias("url_board"), number.alias("url_thread")).distinct()


def catalog_scan(spark, sf_dir):
    """Thread numbers of the boards' catalogs, read from their JSON payloads, in the order of first mention."""
    code = F.lower(F.regexp_replace("board", r"[\s/]", "")).alias("code")
    rows = _t(spark, sf_dir, "threads").select(code, F.floor(F.col("thread_id") / 1000).alias("page"), F.col("thread_id").alias("num"), "post_count")
    items = F.sort_array(F.collect_list(F.struct("post_count", "num")))  # a page of a catalog: at most a thousand numbers
    payload = F.to_json(F.struct(F.transform(items, lambda x: F.struct(x["num"].alias("num"))).alias("threads")))
    return files.catalog_ids(rows.groupBy("code", "page").agg(payload.alias("payload")), keys=["code", "page"])


def new_threads(spark, sf_dir):
    """Threads of the catalog that no document was taken from, and threads of documents that no sample knows."""
    ids = lambda name, column: _t(spark, sf_dir, name).select(F.col(column).alias("thread_id")).filter("thread_id is not null").distinct()
    threads, documents, samples = ids("threads", "thread_id"), ids("documents", "thread_id"), ids("samples", "metadata.thread_id")
    one = catalog.missing_keys(threads, documents, ["thread_id"]).withColumn("missing_in", F.lit("documents"))
    return one.unionByName(catalog.missing_keys(documents, samples, ["thread_id"]).withColumn("missing_in", F.lit("samples")))


def raw_posts(spark, sf_dir):
    """Posts with their exact references as distinct numbers in order, by how many there are and the sum of the first ones."""
    rows = _t(spark, sf_dir, "posts").select(X.exact_references("refs").alias("r"))
    return rows.groupBy(F.size("r").alias("references")).agg(F.count("*").alias("posts"), F.sum(F.try_element_at("r", F.lit(1))).alias("first_references"))


def chat_validate(spark, sf_dir):
    """Whether each sample is a valid chat."""
    return _t(spark, sf_dir, "samples").select("sample_no", "loaded_at", chat.is_valid_chat(F.col("messages")).alias("valid"))


def _chats(spark, sf_dir):
    rows = _t(spark, sf_dir, "samples").filter(chat.is_valid_chat(F.col("messages")))
    context, response = chat.context_and_response(F.col("messages"))
    return rows.select("*", context.alias("context"), response.alias("response"))


def chat_samples(spark, sf_dir):
    """Context and answer of valid chats, with the roles that alternate backwards from the last context text."""
    return _chats(spark, sf_dir).select(
        "sample_no", "loaded_at", F.size("context").alias("context_texts"), F.element_at("context", -1).alias("question"), "response",
        F.array_join(chat.role_tokens(F.col("context")), "").alias("roles"),
    )


def chat_serialized(spark, sf_dir):
    """The one-text form of valid chats, by its digest and length."""
    text = chat.serialized(F.col("context"), F.col("response"))
    return _chats(spark, sf_dir).select("sample_no", "loaded_at", F.md5(text.cast("binary")).alias("digest"), F.length(text).alias("chars"))


def chat_groups(spark, sf_dir):
    """Group keys of all samples: board and thread, else by the digest of the messages."""
    board, thread = chat.group_key(F.col("metadata.board"), F.col("metadata.thread_id"), F.col("messages"))
    return _t(spark, sf_dir, "samples").select("sample_no", "loaded_at", board.alias("board"), thread.cast("string").alias("thread_key"))


def training_texts(spark, sf_dir):
    """How often each text of valid chats occurs as training text, by digest."""
    return files.training_texts(_chats(spark, sf_dir)).groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.count("*").alias("n"))


def qa_pairs(spark, sf_dir):
    """Question-answer pairs of the samples with why others are dropped."""
    return chat.qa_pairs(_t(spark, sf_dir, "samples")).select("sample_no", "loaded_at", "drop_reason")


def qa_report(spark, sf_dir):
    """Samples by the reason they are dropped; ``kept`` for pairs."""
    return chat.qa_pairs(_t(spark, sf_dir, "samples")).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("samples"))


def markdown_fences(spark, sf_dir):
    """Length of the fence that encloses each answer's text safely, by how many answers need it."""
    texts = _t(spark, sf_dir, "samples").select(F.explode("messages").alias("m")).filter("m.content is not null")
    return texts.groupBy(F.length(X.fence(F.col("m.content"))).alias("fence")).agg(F.count("*").alias("texts"))


QUERIES = {f.__name__: f for f in (
    clean_posts, text_noise, squeezed_text, meaningful_posts, text_references, canonical_copies, thread_urls, catalog_scan, new_threads, raw_posts,
    chat_validate, chat_samples, chat_serialized, chat_groups, training_texts, qa_pairs, qa_report, markdown_fences,
)}

#: The noise patterns in a dialect without look-around: the characters beside a match are matched and put back, twice, because a
#: character between two matches can serve only one of them at a time.
_W = r"[\p{L}\p{N}_]"
_BLANK = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _sql_noise(text: str) -> str:
    out = f"regexp_replace({text}, '(?i)(?:https?://|ftp://|www\\.)[^{_BLANK[1:-1]}]+', ' ', 'g')"
    out = f"regexp_replace({out}, '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_.+-]*@[\\p{{L}}\\p{{N}}_.-]+\\.[A-Za-z]{{2,}}', ' ', 'g')"
    for pattern in (r"(?:\p{Nd}{1,3}\.){3}\p{Nd}{1,3}", r"\+?\p{Nd}[\p{Nd} ()-]{8,}\p{Nd}", "@[A-Za-z0-9_]{5,}"):
        for _ in range(2):
            out = f"regexp_replace({out}, '(^|[^\\p{{L}}\\p{{N}}_]){pattern}($|[^\\p{{L}}\\p{{N}}_])', '\\1 \\2', 'g')"
    out = f"regexp_replace({out}, '>>\\p{{Nd}}+', ' ', 'g')"
    return f"regexp_replace({out}, '(?i)\\({_BLANK}*OP{_BLANK}*\\)', ' ', 'g')"


def _sql_squeezed(text: str) -> str:
    shown = f"regexp_replace({text}, '[\\x{{00}}-\\x{{08}}\\x{{0B}}-\\x{{1F}}\\x{{7F}}-\\x{{9F}}\\p{{Cf}}\\p{{Co}}]', '', 'g')"
    lines = f"regexp_split_to_array({shown}, '[\\n\\x{{2028}}\\x{{2029}}]')"
    tidy = f"list_transform({lines}, lambda s: regexp_replace(regexp_replace(s, '[ \\t]+', ' ', 'g'), '^{_BLANK}+|{_BLANK}+$', '', 'g'))"
    return f"array_to_string(list_filter({tidy}, lambda s: s <> ''), chr(10))"


_VALID = r"""shaped AS (
  SELECT *, CASE WHEN messages[1].role = 'system' THEN messages[2:] ELSE messages END AS t FROM samples),
checked AS (
  SELECT *, coalesce(len(t) >= 2 AND len(t) % 2 = 0
    AND len(list_filter(messages, lambda m: coalesce(regexp_replace(m.content, '^[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', '') <> '', false))) = len(messages)
    AND len(list_filter(t, lambda m, i: m.role = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) = len(t), false) AS valid FROM shaped),
chats AS (
  SELECT sample_no, loaded_at, list_transform(t[1:len(t)-1], lambda m: m.content) AS context, t[len(t)].content AS response, split_name, metadata
  FROM checked WHERE valid)"""

_QA = r"""rated AS (
  SELECT sample_no, loaded_at, messages[1].content AS q, messages[2].content AS a,
    CASE WHEN NOT metadata.self_contained_prompt THEN 'not_self_contained'
      WHEN metadata.self_contained_prompt IS NULL OR NOT coalesce(len(messages) = 2 AND messages[1].role = 'user' AND messages[2].role = 'assistant'
        AND len(list_filter(messages, lambda m: coalesce(regexp_replace(m.content, '^[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', '') <> '', false))) = len(messages)
        AND trim(sample_id) <> '' AND metadata.thread_id IS NOT NULL AND metadata.user_post_id IS NOT NULL AND metadata.assistant_post_id IS NOT NULL, false)
      THEN 'malformed' END AS reason FROM samples),
final AS (
  SELECT sample_no, loaded_at, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY reason, q, a ORDER BY sample_no, loaded_at) > 1
    THEN 'exact_duplicate' ELSE reason END AS drop_reason FROM rated)"""

ORACLES = {
    "text_noise": f"SELECT doc_id, length(b)::INT AS chars, md5(b) AS digest FROM (SELECT doc_id, {_sql_noise('text')} AS b FROM documents)",
    "squeezed_text": f"SELECT doc_id, {_sql_squeezed('text')} AS squeezed FROM documents",
    "clean_posts": f"""WITH p AS (SELECT post_id, ord, fetched_at, replace(replace(replace(replace(nfc_normalize(text), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t FROM posts),
c AS (SELECT post_id, ord, fetched_at, {_sql_squeezed(_sql_noise(r"regexp_replace(t, '</?[A-Za-z][^>]*>', ' ', 'g')"))} AS cleaned FROM p),
d AS (SELECT *, regexp_replace(regexp_replace(cleaned, '{_BLANK}+', ' ', 'g'), '^[ .,!?:;—-]+|[ .,!?:;—-]+$', '', 'g') AS c FROM c)
SELECT post_id, ord, fetched_at, cleaned, coalesce(regexp_matches(cleaned, '[\\p{{L}}\\p{{N}}\\p{{S}}]') AND NOT (length(c) <= 80
  AND regexp_matches(c, '(?i)^(?:пикрил(?:ейтед)?|вот (?:это|эта|этот|оно)|согласны\\??|как вам\\??|что думаете\\??|(?:смотри|см\\.)?\\s*(?:фото|картинк[ауе]|скрин))$')), false) AS usable FROM d""",
    "meaningful_posts": r"""SELECT coalesce(regexp_matches(text, '[\p{L}\p{N}\p{S}]'), false) AS meaningful,
  coalesce(length(c) <= 80 AND regexp_matches(c, '(?i)^(?:пикрил(?:ейтед)?|вот (?:это|эта|этот|оно)|согласны\??|как вам\??|что думаете\??|(?:смотри|см\.)?\s*(?:фото|картинк[ауе]|скрин))$'), false) AS image_reply,
  count(*) AS posts
FROM (SELECT text, regexp_replace(regexp_replace(text, '[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), '^[ .,!?:;—-]+|[ .,!?:;—-]+$', '', 'g') AS c FROM posts) GROUP BY ALL""",
    "text_references": r"""SELECT DISTINCT post_id, coalesce((SELECT string_agg(r, ',' ORDER BY k) FROM (
  SELECT r, min(k) AS k FROM (SELECT unnest(x) AS r, unnest(range(len(x))) AS k) GROUP BY r)), '') AS refs
FROM (SELECT DISTINCT post_id, regexp_extract_all(text, '>>[0-9]+') AS x FROM posts WHERE text IS NOT NULL)""",
    "canonical_copies": r"""WITH c AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') AS c FROM documents),
g AS (SELECT c, min(doc_id) AS first_id, count(*) AS copies FROM c WHERE c <> '' GROUP BY c HAVING count(*) > 1)
SELECT doc_id, first_id, copies FROM c JOIN g USING (c)""",
    "thread_urls": r"""SELECT DISTINCT thread_id, lower(nullif(regexp_extract(source_url, '^https?://board\.example/([A-Za-z0-9]+)(?:/res/\d+\.html)?/?$', 1), '')) AS url_board,
  TRY_CAST(nullif(regexp_extract(source_url, '^https?://board\.example/[A-Za-z0-9]+/res/(\d+)\.html/?$', 1), '') AS BIGINT) AS url_thread FROM threads""",
    "catalog_scan": r"""SELECT code, page, num, CAST(min(place) AS INT) AS place FROM (
  SELECT lower(regexp_replace(board, '[\s/]', '', 'g')) AS code, thread_id // 1000 AS page, thread_id AS num,
    row_number() OVER (PARTITION BY lower(regexp_replace(board, '[\s/]', '', 'g')), thread_id // 1000 ORDER BY post_count NULLS FIRST, thread_id) - 1 AS place FROM threads) GROUP BY code, page, num""",
    "new_threads": """SELECT DISTINCT thread_id, 'documents' AS missing_in FROM threads WHERE thread_id NOT IN (SELECT thread_id FROM documents WHERE thread_id IS NOT NULL)
UNION ALL SELECT DISTINCT thread_id, 'samples' FROM documents WHERE thread_id IS NOT NULL AND thread_id NOT IN (SELECT metadata.thread_id FROM samples WHERE metadata.thread_id IS NOT NULL)""",
    "raw_posts": """WITH r AS (SELECT coalesce(list_transform(list_filter(refs, lambda r: regexp_full_match(r, '>>[0-9]+')), lambda r: TRY_CAST(substr(r, 3) AS BIGINT)), []) AS r FROM posts)
SELECT len(list_distinct(r))::INT AS "references", count(*) AS posts, sum(r[1])::BIGINT AS first_references FROM r GROUP BY 1""",
    "chat_groups": r"""SELECT sample_no, loaded_at, coalesce(metadata.board, 'chatml') AS board, coalesce(metadata.thread_id::VARCHAR,
  (CAST('0x' || substr(sha256('[' || array_to_string(list_transform(messages, lambda m: '[' || to_json(m.role)::VARCHAR || ', ' || coalesce(to_json(m.content)::VARCHAR, 'null') || ']'), ', ') || ']'), 1, 16) AS UBIGINT))::VARCHAR) AS thread_key FROM samples""",
    "chat_validate": f"WITH {_VALID} SELECT sample_no, loaded_at, valid FROM checked",
    "chat_samples": f"""WITH {_VALID} SELECT sample_no, loaded_at, len(context)::INT AS context_texts, context[len(context)] AS question, response,
  array_to_string(list_transform(context, lambda c, i: CASE WHEN (len(context) - i) % 2 = 0 THEN '<USER>' ELSE '<ASSISTANT>' END), '') AS roles FROM chats""",
    "chat_serialized": f"""WITH {_VALID}, s AS (SELECT sample_no, loaded_at, '<BOS>' || array_to_string(list_transform(context, lambda c, i:
  CASE WHEN (len(context) - i) % 2 = 0 THEN '<USER>' ELSE '<ASSISTANT>' END || c), '') || '<ASSISTANT>' || response || '<EOS>' AS x FROM chats)
SELECT sample_no, loaded_at, md5(x) AS digest, length(x)::INT AS chars FROM s""",
    "training_texts": f"""WITH {_VALID} SELECT md5(x) AS digest, count(*) AS n FROM (SELECT unnest(list_append(context, response)) AS x FROM chats) GROUP BY 1""",
    "qa_pairs": f"WITH {_QA} SELECT sample_no, loaded_at, drop_reason FROM final",
    "qa_report": f"WITH {_QA} SELECT coalesce(drop_reason, 'kept') AS outcome, count(*) AS samples FROM final GROUP BY 1",
    "markdown_fences": r"""SELECT greatest(3, coalesce(list_max(list_transform(regexp_extract_all(c, '`+'), lambda x: length(x))), 0) + 1)::INT AS fence, count(*) AS texts
FROM (SELECT unnest(messages).content AS c FROM samples) WHERE c IS NOT NULL GROUP BY 1""",
}
