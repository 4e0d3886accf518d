"""Queries over runs, reports, files and limits; suppliers, parts, orders and events stand in for runs, files and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import runs as R
from threadloom.operators import tokens


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_manifests(spark, sf_dir):
    """Suppliers as runs whose manifests are updated by their line items."""
    runs = _t(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("run_id"), F.lit(0).cast("bigint").alias("global_step"), F.lit(None).cast("bigint").alias("planned_total_steps"),
        F.create_map(F.lit("first.pt"), F.struct(F.lit(1).cast("bigint").alias("global_step"), F.lit(0.5).alias("validation_loss"), F.lit(1).cast("bigint").alias("modified_ns"), F.lit(1).cast("bigint").alias("size"))).alias("checkpoints"),
    )
    items = _t(spark, sf_dir, "lineitem")
    updates = items.select(
        F.col("l_suppkey").alias("run_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("at"), F.col("l_orderkey").cast("bigint").alias("step"),
        F.when(F.col("l_linenumber") > 3, F.col("l_partkey").cast("bigint")).alias("total"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("step_"), (F.col("l_partkey") % 5).cast("string"))).alias("checkpoint_name"),
        F.when(F.col("l_linenumber") == 4, F.lit(float("nan"))).otherwise(F.col("l_discount").cast("double")).alias("validation_loss"),
        F.col("l_partkey").cast("bigint").alias("modified_ns"), F.col("l_linenumber").cast("bigint").alias("size"),
    )
    entry = F.concat_ws(":", F.col("k"), F.col("v.global_step"), F.coalesce(F.round("v.validation_loss", 2).cast("decimal(9,2)").cast("string"), F.lit("null")), F.col("v.modified_ns"), F.col("v.size"))
    done = R.updated_manifests(runs, updates).select("run_id", "global_step", "planned_total_steps", F.explode("checkpoints").alias("k", "v"))
    return done.select("run_id", "global_step", "planned_total_steps", entry.alias("checkpoint"))


def resume_reasons(spark, sf_dir):
    """Orders as jobs that go on from the runs of other orders."""
    orders = _t(spark, sf_dir, "orders")
    common = lambda shift: [
        ((F.col("o_custkey") + shift) % 3).alias("model_id"), F.lit("d").alias("dataset_id"), F.lit("v1").alias("dataset_version"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 5).alias("split_hash"), (F.col("o_custkey") % 2).alias("batch_size"), F.lit(42).alias("random_seed"), F.lit(None).cast("int").alias("max_train_samples"),
    ]
    runs = orders.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("run_id"), F.concat(F.lit("runs/"), F.col("o_orderkey").cast("string")).alias("directory"), *common(0))
    back = F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("runs/"), (F.col("o_orderkey") - F.col("o_orderkey") % 4).cast("string")))
    jobs = orders.select(F.col("o_orderkey").alias("job_id"), back.alias("directory"), *common(F.col("o_orderkey") % 2))
    return R.resume_reasons(jobs, runs).select("job_id", "parent_run_id", "reason")


def report_blocks(spark, sf_dir):
    """Parts as answers of an evaluation report, by the digest of their Markdown."""
    rows = _t(spark, sf_dir, "part")
    block = R.answer_block(F.concat(F.lit("step_"), F.col("p_partkey").cast("string")), F.col("p_size"), F.col("p_name"), F.concat(F.lit("a ```` b\n"), F.col("p_type")), F.col("p_size"), F.col("p_partkey") / 4)
    return rows.select("p_partkey", F.length(block).alias("chars"), F.md5(block.cast("binary")).alias("digest"))


def unfinished_batches(spark, sf_dir):
    """Batches of 16 events in three epochs that a run stopped after 100 batches of the second still has to do."""
    batches = _t(spark, sf_dir, "events").select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("epoch"), F.floor(F.col("event_id") / 16).alias("batch_no")).distinct()
    return R.unfinished_batches(batches, 1, 100).groupBy("epoch").agg(F.count("*").alias("batches"), F.min("batch_no").alias("first_batch"))


def reusable_statistics(spark, sf_dir):
    """Customers as kept statistics: which of them tell the training tokens of this window, objective and number of samples."""
    rows = _t(spark, sf_dir, "customer")
    train = F.struct((F.col("c_custkey") % 4).cast("bigint").alias("usable_samples"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey").cast("bigint")).alias("training_loss_tokens"))
    kept = rows.select(
        "c_custkey", F.when(F.col("c_nationkey") % 2 == 0, 512).otherwise(1024).alias("max_sequence_length"),
        F.when(F.col("c_nationkey") % 3 == 0, "response_only").when(F.col("c_nationkey") % 3 == 1, "all").alias("training_objective"), F.struct(train.alias("train")).alias("splits"),
    )
    return kept.select("c_custkey", R.reusable_tokens(kept, 512, 2).alias("training_tokens"))


def storage_rollup(spark, sf_dir):
    """Line items as files of parts, some of them links to others."""
    rows = _t(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("path"),
        F.when(F.col("l_linenumber") > 2, F.concat_ws("/", F.lit("blob"), (F.col("l_partkey") % 50).cast("string"))).alias("target"),
        F.when(F.col("l_linenumber") > 2, F.col("l_partkey") % 50).otherwise(F.col("l_linenumber")).cast("bigint").alias("size"), F.col("l_partkey").cast("bigint").alias("modified_ns"),
    )
    return R.storage_rollup(rows, ["l_suppkey"])


def catalog_totals(spark, sf_dir):
    """Parts as versions of their brands' datasets."""
    return R.catalog_totals(_t(spark, sf_dir, "part").select(F.col("p_brand").alias("dataset_id"), F.col("p_partkey").alias("version"), F.col("p_size").cast("bigint").alias("samples")))


def line_index(spark, sf_dir):
    """Byte offsets of the documents in a file of their texts, one a line, and the number of each among those of 200 characters or more."""
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n", " ").alias("line"))
    return R.line_index(rows, ["doc_id"], "line", F.length("line") >= 200).select("doc_id", "line_offset", "row_no")


def first_usable(spark, sf_dir):
    """The first 300 documents of 200 characters or more, in the order of their ids: a limit of a reader, which is the feature."""
    return R.first_usable(_t(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], F.length("text") >= 200, 300).select("doc_id")


def contained_paths(spark, sf_dir):
    """Customers' paths: whether they lie inside the store."""
    k = F.col("c_custkey")
    parts = F.concat(F.lit("/store/"), F.when(k % 4 == 0, "a/../").when(k % 4 == 1, "../").when(k % 4 == 2, "./a//").otherwise("a/b/../../../"), F.when(k % 3 == 0, "").when(k % 3 == 1, "x").otherwise("../store/x"))
    return _t(spark, sf_dir, "customer").select("c_custkey", R.is_contained(parts, F.lit("/store")).alias("inside"))


def config_errors(spark, sf_dir):
    """Parts as configs: which of their settings are out of range."""
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("batch_size"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice").cast("double")).alias("window"))
    return rows.select("p_partkey", F.array_join(R.range_errors({"batch_size": (5, 40), "window": (910.0, None)}), ",").alias("errors"))


def text_snapshots(spark, sf_dir):
    """Customers' comments as streams of words that stop at a word of the market segment: the text after each of them."""
    words = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stream"), F.col("o_orderkey").alias("at"), (F.col("o_orderkey") % 11).alias("token"), F.concat(F.lit(" "), F.col("o_orderpriority")).alias("piece"))
    got = R.text_snapshots(words, "stream", "at", "token", "piece", {7})
    return got.select("stream", "at", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def prompts(spark, sf_dir):
    """Suppliers' names as questions: prompt ids with hashed words, and the templated text by its digest."""
    rows = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"))).alias("system"))
    ids = tokens.chat_prompt(tokens.word_ids(F.col("s_name")))
    text = tokens.templated_prompt(F.col("s_name"), F.col("system"))
    return rows.select("s_suppkey", F.array_join(ids, " ").alias("ids"), F.md5(text.cast("binary")).alias("digest"))


def piece_counts(spark, sf_dir):
    """How often each piece occurs that a byte-pair vocabulary is built of, over all documents."""
    return tokens.word_counts(_t(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    run_manifests, resume_reasons, report_blocks, unfinished_batches, reusable_statistics, storage_rollup, catalog_totals, line_index, first_usable,
    contained_paths, config_errors, text_snapshots, prompts, piece_counts,
)}

ORACLES = {
    "run_manifests": """WITH u AS (SELECT l_suppkey AS run_id, l_orderkey * 10 + l_linenumber AS t, l_orderkey AS step, CASE WHEN l_linenumber > 3 THEN l_partkey END AS total,
  CASE WHEN l_linenumber % 2 = 0 THEN 'step_' || (l_partkey % 5) END AS name, CASE WHEN l_linenumber = 4 THEN NULL ELSE l_discount END AS loss, l_partkey AS m, l_linenumber AS size FROM lineitem),
n AS (SELECT run_id, arg_max(step, t) AS step, arg_max(total, t) FILTER (total IS NOT NULL) AS total FROM u GROUP BY 1),
c AS (SELECT run_id, name, arg_max(name || ':' || step || ':' || coalesce(printf('%.2f', loss::DOUBLE), 'null') || ':' || m || ':' || size, t) AS e FROM u WHERE name IS NOT NULL GROUP BY ALL),
e AS (SELECT run_id, e FROM c UNION ALL SELECT s_suppkey, 'first.pt:1:0.50:1:1' FROM supplier)
SELECT s_suppkey AS run_id, coalesce(step, 0)::BIGINT AS global_step, total::BIGINT AS planned_total_steps, e.e AS checkpoint FROM supplier LEFT JOIN n ON n.run_id = s_suppkey JOIN e ON e.run_id = s_suppkey""",
    "resume_reasons": """WITH j AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey - o_orderkey % 4 END AS p FROM orders),
r AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders WHERE o_orderkey % 3 <> 0)
SELECT j.k AS job_id, r.k AS parent_run_id, CASE WHEN p IS NULL THEN NULL WHEN r.k IS NULL THEN 'no_parent' WHEN (j.c + j.k % 2) % 3 <> r.c % 3 THEN 'other_model_or_data'
  WHEN r.k % 2 = 0 AND (j.k % 2 <> 0 OR j.c % 5 <> r.c % 5) THEN 'splits_changed' WHEN j.c % 2 <> r.c % 2 THEN 'setting_changed' END AS reason FROM j LEFT JOIN r ON r.k = j.p""",
    "report_blocks": """WITH b AS (SELECT p_partkey, chr(10) || '## step_' || p_partkey || ' · вопрос ' || p_size || repeat(chr(10), 2) || '```text' || chr(10) || p_name || chr(10) || '```' || chr(10)
  || chr(10) || '### Ответ' || repeat(chr(10), 2) || '`````text' || chr(10) || 'a ```` b' || chr(10) || p_type || chr(10) || '`````' || chr(10)
  || chr(10) || 'Токенов: ' || p_size || '; секунд: ' || printf('%.2f', p_partkey / 4.0::DOUBLE) || '.' || chr(10) AS b FROM part)
SELECT p_partkey, length(b)::INT AS chars, md5(b) AS digest FROM b""",
    "unfinished_batches": "SELECT epoch::INT AS epoch, count(*) AS batches, min(b)::BIGINT AS first_batch FROM (SELECT DISTINCT event_id // 16 AS b FROM events), (VALUES (0), (1), (2)) e(epoch) WHERE epoch > 1 OR epoch = 1 AND b >= 100 GROUP BY 1",
    "reusable_statistics": "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 AND c_nationkey % 3 = 0 AND c_custkey % 4 = 2 AND c_custkey % 5 <> 0 THEN c_custkey END::BIGINT AS training_tokens FROM customer",
    "storage_rollup": """WITH f AS (SELECT l_suppkey, l_orderkey || '/' || l_linenumber AS path, CASE WHEN l_linenumber > 2 THEN 'blob/' || (l_partkey % 50) END AS target,
  CASE WHEN l_linenumber > 2 THEN l_partkey % 50 ELSE l_linenumber END AS size, l_partkey AS m FROM lineitem),
d AS (SELECT l_suppkey, md5(path || ':' || size || ':' || m) AS h, coalesce(target, path) AS t, size FROM f),
s AS (SELECT l_suppkey, sum(size)::BIGINT AS size_bytes FROM (SELECT l_suppkey, t, max(size) AS size FROM d GROUP BY ALL) GROUP BY 1)
SELECT l_suppkey, count(*) AS files, any_value(size_bytes) AS size_bytes,
  sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)::HUGEINT)::VARCHAR || '-' || sum(CAST('0x' || substr(h, 17, 15) AS BIGINT)::HUGEINT)::VARCHAR AS digest FROM d JOIN s USING (l_suppkey) GROUP BY 1""",
    "catalog_totals": "SELECT count(DISTINCT p_brand) AS dataset_count, count(*) AS version_count, sum(p_size)::BIGINT AS total_samples FROM part",
    "line_index": """WITH l AS (SELECT doc_id, replace(text, chr(10), ' ') AS line FROM documents), s AS (SELECT doc_id, coalesce(octet_length(encode(line)), 0) + 1 AS b, coalesce(length(line) >= 200, false) AS u FROM l)
SELECT doc_id, (sum(b) OVER w - b)::BIGINT AS line_offset, CASE WHEN u THEN count(*) FILTER (u) OVER w - 1 END AS row_no FROM s WINDOW w AS (ORDER BY doc_id)""",
    "first_usable": "SELECT doc_id FROM documents WHERE length(text) >= 200 ORDER BY doc_id LIMIT 300",
    "contained_paths": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_custkey % 4 = 2 WHEN 1 THEN c_custkey % 4 IN (0, 2) ELSE c_custkey % 4 IN (0, 2) END AS inside FROM customer",
    "config_errors": "SELECT p_partkey, concat_ws(',', CASE WHEN p_size NOT BETWEEN 5 AND 40 THEN 'batch_size' END, CASE WHEN p_partkey % 7 = 0 OR p_retailprice < 910 THEN 'window' END) AS errors FROM part",
    "text_snapshots": """WITH w AS (SELECT o_custkey AS stream, o_orderkey AS k, ' ' || o_orderpriority AS piece, coalesce(bool_or(o_orderkey % 11 = 7) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), false) AS done FROM orders),
t AS (SELECT stream, k, coalesce(string_agg(piece, '') FILTER (NOT done) OVER (PARTITION BY stream ORDER BY k), '') AS x FROM w)
SELECT stream, k AS "at", length(x)::INT AS chars, md5(x) AS digest FROM t""",
    "prompts": r"""WITH p AS (SELECT s_suppkey, '2 4 ' || array_to_string(list_transform(list_filter(regexp_split_to_array(s_name, '\s+'), lambda w: w <> ''), lambda w: CAST('0x' || substr(md5(w), 1, 15) AS BIGINT) % 1000000 + 6), ' ') || ' 5' AS ids,
  CASE WHEN s_suppkey % 2 = 0 THEN '<|im_start|>system' || chr(10) || 'nation ' || s_nationkey || '<|im_end|>' || chr(10) ELSE '' END || '<|im_start|>user' || chr(10) || s_name || '<|im_end|>' || chr(10)
  || '<|im_start|>assistant' || chr(10) || '<think>' || repeat(chr(10), 2) || '</think>' || repeat(chr(10), 2) AS x FROM supplier)
SELECT s_suppkey, ids, md5(x) AS digest FROM p""",
    "piece_counts": r"""SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, ' ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+')) AS piece FROM documents) GROUP BY 1""",
}
