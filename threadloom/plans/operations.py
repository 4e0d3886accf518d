"""Progress, catalog and sampling queries over events, embeddings, orders and suppliers standing in for runs and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import catalog, progress, sampling
from threadloom.operators.tokens import training_plan_columns


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")


def loss_series(spark, sf_dir):
    """Rolling mean, best and counters of the events' values per user, in event order."""
    return progress.loss_series(_events(spark, sf_dir), "user_id", "event_id", "value", tokens="event_id", batch_size=4).select(
        "event_id", F.floor(F.col("rolling_loss") * 1e6 + 0.1).alias("rolling_millionths"), "best_loss", "is_best", "samples_seen", "tokens_seen"
    )


def interval_losses(spark, sf_dir):
    """Mean value of every 100 event numbers of an event type."""
    rows = _events(spark, sf_dir).withColumn("step", F.col("event_id") + 1)
    return progress.interval_losses(rows, "event_type", "step", "value", 100)


def weighted_loss(spark, sf_dir):
    """Mean value of each event type, weighted by the user number."""
    return progress.weighted_loss(_events(spark, sf_dir), ["event_type"], "value", "user_id")


def progress_items(spark, sf_dir):
    """The first and every 25th event of each user."""
    return progress.every_nth(_events(spark, sf_dir), "user_id", "event_id", 25).select("user_id", "event_id", "item")


def progress_throttle(spark, sf_dir):
    """Events of each user that a throttle of 10 events or 6 hours lets through."""
    rows = _events(spark, sf_dir).select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("micros"))
    rows = rows.withColumn("seconds", F.col("micros") / 1e6).drop("micros")
    return progress.throttled(rows, "user_id", "event_id", "seconds", 10, 6 * 3600.0).select("user_id", "event_id")


def eta(spark, sf_dir):
    """Seconds left of each user's events at their pace so far, had the run been resumed after two of them."""
    rows = progress.loss_series(_events(spark, sf_dir), "user_id", "event_id", "value")
    left = progress.eta(F.col("event_id").cast("double"), F.col("samples_seen"), F.lit(100), F.lit(2))
    return rows.select("event_id", left.alias("eta_seconds"))


def elapsed_format(spark, sf_dir):
    """The events' numbers as spans of time and as sizes."""
    return _t(spark, sf_dir, "events").select("event_id", X.elapsed(F.col("event_id").cast("double") * 7 - 5).alias("span"), X.byte_size(F.col("event_id") * F.col("event_id")).alias("size"))


def training_plans(spark, sf_dir):
    """Steps of a training run over each event type's events."""
    rows = _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    steps, whole, _ = training_plan_columns(F.col("n"), 8, epochs=3, accumulation=4)
    _, _, epochs = training_plan_columns(F.col("n"), 8, max_steps=500, accumulation=4)
    return rows.select("event_type", steps.alias("steps_per_epoch"), whole.alias("total_steps"), epochs.alias("epochs_for_500"))


def top_scores(spark, sf_dir):
    """The ten events of the highest value per type, and their rank among all of the type."""
    rows = sampling.strict_rank(_events(spark, sf_dir), ["event_type"], "value")
    return sampling.top_k(rows, ["event_type"], "value", 10, ["event_id"]).select("event_type", "event_id", "value", "place", "rank")


def hash_sample(spark, sf_dir):
    """Fifty documents, the smallest by a hash of seed and id."""
    return sampling.hash_sample(_t(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 50, 42)


def reservoir(spark, sf_dir):
    """The fifty documents that a seeded reservoir keeps of the stream in id order."""
    return sampling.reservoir(_t(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 50, 42)


def epoch_order(spark, sf_dir):
    """Documents with their place in the shuffled order of the second epoch."""
    rows = _t(spark, sf_dir, "documents").select("doc_id").withColumn("digest", F.md5(F.concat_ws(":", F.lit("43"), F.col("doc_id").cast("string")).cast("binary")))
    return sampling.with_places(rows, ["digest", "doc_id"], "place").select("doc_id", "place")


def equal_vectors(spark, sf_dir):
    """Embeddings that equal that of the smallest vector number, with their norm."""
    rows = _t(spark, sf_dir, "embeddings")
    wanted = rows.orderBy("vec_id").limit(1).select(F.col("embedding").alias("wanted"))
    joined = rows.join(F.broadcast(wanted), F.col("embedding") == F.col("wanted"))
    return sampling.equal_vectors(joined, "embedding", F.col("wanted")).select("vec_id", "norm")


def version_order(spark, sf_dir):
    """Supplier keys as dataset versions: which are well formed, and their places in numeric order."""
    rows = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("v"), (F.col("s_suppkey") - 1).cast("string")).alias("version"), F.concat(F.lit("set-"), F.col("s_nationkey").cast("string")).alias("dataset_id"))
    good = rows.filter(catalog.is_version(F.col("version")) & catalog.is_safe_id(F.col("dataset_id")))
    number = catalog.version_number(F.col("version"))
    return good.select("dataset_id", "version", F.row_number().over(Window.partitionBy("dataset_id").orderBy(number)).alias("place"))


def run_numbers(spark, sf_dir):
    """The smallest free run number of each nation whose taken numbers are its suppliers' keys."""
    rows = _t(spark, sf_dir, "supplier").select("s_nationkey", F.floor((F.col("s_suppkey") + 3) / 4).alias("number"))
    return catalog.next_run_number(rows, ["s_nationkey"])


def checkpoint_order(spark, sf_dir):
    """Parts as checkpoints: last, best, then by step from the newest."""
    name = F.when(F.col("p_partkey") == 3, "last.pt").when(F.col("p_partkey") == 5, "best.pt").otherwise(F.concat(F.lit("step_"), F.col("p_partkey").cast("string")))
    rows = _t(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", name.alias("name"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy(*catalog.checkpoint_order("name", "p_size")))).select("p_brand", "name", "place")


def evaluation_plan(spark, sf_dir):
    """Every nation as a checkpoint with every region as a question."""
    points = _t(spark, sf_dir, "nation").select(F.concat(F.lit("step_"), F.col("n_nationkey").cast("string")).alias("name"))
    asked = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("question_no"), F.col("r_name").alias("question"))
    return catalog.evaluation_plan(points, asked, 100).select("name", "question_no", "question", "seed")


def catalog_merge(spark, sf_dir):
    """Nations and regions as model sources whose names differ by case; later sources name the model."""
    a = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("model_id"), F.lit(None).cast("string").alias("display_name"))
    b = _t(spark, sf_dir, "region").select(F.initcap("r_name").alias("model_id"), F.col("r_name").alias("display_name"))
    c = _t(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.lower("n_name").alias("model_id"), F.initcap("n_name").alias("display_name"))
    return catalog.merged_catalog([a, b, c])


def registrations(spark, sf_dir):
    """Orders as registrations of customers: the active one, else the first mode."""
    mode = F.element_at(F.array(F.lit("full"), F.lit("lora"), F.lit("qlora"), F.lit("other")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("model_id"), mode.alias("mode"), (F.col("o_orderkey") % 16 == 1).alias("active")).distinct()
    return catalog.registered(rows)


_FILES = (
    "config.json", "model.bin", "onnx/model.safetensors", "optimizer.bin", "model.safetensors", "readme.md", "tokenizer.json", "GGUF/w.json", "sub/scheduler.json", "merges.bpe", "Config.json",
    "a/tf/b/x.txt", "sub/part.bin",
)


def _model_files(spark, sf_dir):
    """Parts as files of their types' and sizes' models."""
    kind = F.element_at(F.array(*map(F.lit, _FILES)), (F.col("p_partkey") % len(_FILES) + 1).cast("int"))
    return _t(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("model"), kind.alias("filename")).distinct()


def selected_files(spark, sf_dir):
    """Parts as files of models: which ones are worth fetching."""
    return catalog.selected_files(_model_files(spark, sf_dir))


def unusable_models(spark, sf_dir):
    """Parts as files of models: which models lack a config or weights."""
    return catalog.unusable_models(_model_files(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    loss_series, interval_losses, weighted_loss, progress_items, progress_throttle, eta, elapsed_format, training_plans, top_scores, hash_sample, reservoir,
    epoch_order, equal_vectors, version_order, run_numbers, checkpoint_order, evaluation_plan, catalog_merge, registrations, selected_files, unusable_models,
)}

ORACLES = {
    "loss_series": """SELECT event_id, floor(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 99 PRECEDING) * 1e6 + 0.1)::BIGINT AS rolling_millionths, min(value) OVER w AS best_loss,
  coalesce(value < min(value) OVER b, min(value) OVER b IS NULL) AS is_best, count(*) OVER w * 4 AS samples_seen, (sum(event_id) OVER w)::BIGINT AS tokens_seen FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id), b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "interval_losses": "SELECT event_type, (event_id // 100)::BIGINT AS interval_no, avg(value) AS mean_loss, count(*) AS steps, max(event_id) + 1 AS last_step FROM events GROUP BY 1, 2",
    "weighted_loss": "SELECT event_type, sum(value * user_id) / sum(user_id) AS weighted_loss, sum(user_id)::BIGINT AS tokens FROM events GROUP BY 1",
    "progress_items": "SELECT user_id, event_id, item::INT AS item FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS item FROM events) WHERE (item - 1) % 25 = 0",
    "progress_throttle": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
w AS (
  SELECT user_id, event_id, k, true AS due, k AS li, s AS lt FROM e WHERE k = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.k, e.k - w.li >= 10 OR e.s - w.lt >= 21600, CASE WHEN e.k - w.li >= 10 OR e.s - w.lt >= 21600 THEN e.k ELSE w.li END,
    CASE WHEN e.k - w.li >= 10 OR e.s - w.lt >= 21600 THEN e.s ELSE w.lt END FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT user_id, event_id FROM w WHERE due""",
    "eta": """SELECT event_id, CASE WHEN k - 2 >= 3 AND 100 >= k THEN event_id::DOUBLE / (k - 2) * (100 - k) END AS eta_seconds
FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)""",
    "elapsed_format": """SELECT event_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS span,
  CASE WHEN b >= 1073741824 THEN printf('%.2f ГиБ', b / 1073741824.0::DOUBLE) WHEN b >= 1048576 THEN printf('%.2f МиБ', b / 1048576.0::DOUBLE) WHEN b >= 1024 THEN printf('%.2f КиБ', b / 1024.0::DOUBLE) ELSE printf('%d Б', b) END AS size
FROM (SELECT event_id, greatest(event_id * 7 - 5, 0) AS s, event_id * event_id AS b FROM events)""",
    "training_plans": """SELECT event_type, s AS steps_per_epoch, s * 3 AS total_steps, ceil(500.0::DOUBLE / s)::BIGINT AS epochs_for_500
FROM (SELECT event_type, ceil(ceil(count(*) / 8.0::DOUBLE) / 4.0::DOUBLE)::BIGINT AS s FROM events GROUP BY 1)""",
    "top_scores": """SELECT event_type, event_id, value, place::INT AS place, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place, rank() OVER (PARTITION BY event_type ORDER BY value DESC) AS r FROM events) WHERE place <= 10""",
    "hash_sample": "SELECT doc_id, md5('42:' || doc_id) AS digest FROM documents ORDER BY 2 LIMIT 50",
    "epoch_order": "SELECT doc_id, row_number() OVER (ORDER BY md5('43:' || doc_id), doc_id) - 1 AS place FROM documents",
    "equal_vectors": "SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings WHERE embedding = (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)",
    "version_order": """SELECT 'set-' || s_nationkey AS dataset_id, 'v' || (s_suppkey - 1) AS version, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey))::INT AS place FROM supplier WHERE s_suppkey > 1""",
    "run_numbers": """WITH t AS (SELECT DISTINCT s_nationkey, (s_suppkey + 3) // 4 AS n FROM supplier), c AS (SELECT DISTINCT s_nationkey, 1::BIGINT AS n FROM t UNION SELECT s_nationkey, n + 1 FROM t)
SELECT s_nationkey, min(n)::BIGINT AS next_number FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.s_nationkey = c.s_nationkey AND t.n = c.n) GROUP BY 1""",
    "checkpoint_order": """WITH r AS (SELECT p_brand, p_size, CASE p_partkey WHEN 3 THEN 'last.pt' WHEN 5 THEN 'best.pt' ELSE 'step_' || p_partkey END AS name FROM part)
SELECT p_brand, name, (row_number() OVER (PARTITION BY p_brand ORDER BY CASE name WHEN 'last.pt' THEN 0 WHEN 'best.pt' THEN 1 ELSE 2 END, p_size DESC, name))::INT AS place FROM r""",
    "evaluation_plan": "SELECT 'step_' || n_nationkey AS name, r_regionkey AS question_no, r_name AS question, 100 + r_regionkey AS seed FROM nation, region",
    "catalog_merge": """WITH r AS (SELECT n_name AS m, NULL AS d, 0 AS p FROM nation UNION ALL SELECT upper(r_name[1]) || lower(r_name[2:]), r_name, 1 FROM region
  UNION ALL SELECT lower(n_name), array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), 2 FROM nation WHERE n_regionkey = 1)
SELECT lower(m) AS key, arg_max(CASE WHEN p = 1 THEN array_to_string(list_transform(string_split(d, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE m END, p) AS model_id, arg_max(d, p) FILTER (d IS NOT NULL) AS display_name, count(DISTINCT p) AS sources FROM r GROUP BY 1""",
    "registrations": """WITH r AS (SELECT DISTINCT o_custkey AS model_id, CASE o_orderkey % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'lora' WHEN 2 THEN 'qlora' ELSE 'other' END AS mode, o_orderkey % 16 = 1 AS active FROM orders)
SELECT model_id, mode, active FROM r WHERE mode <> 'other' QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY CASE WHEN active THEN 0 WHEN mode = 'qlora' THEN 1 WHEN mode = 'lora' THEN 2 ELSE 3 END) = 1""",
}
_SELECTED = f"""WITH f AS (SELECT DISTINCT p_brand || '/' || p_size AS model, {list(_FILES)}[p_partkey % {len(_FILES)} + 1] AS filename FROM part),
o AS (SELECT *, NOT regexp_matches(filename, '(?i)(^|/)(onnx|openvino|original|gguf|ggml|flax|tf)/') AS outside FROM f),
s AS (SELECT *, bool_or(outside AND filename LIKE '%.safetensors') OVER (PARTITION BY model) AS safe FROM o),
t AS (SELECT *, outside AND (regexp_matches(filename, '[.](json|model|txt|tiktoken|bpe|jinja|safetensors)$') OR filename LIKE '%.bin' AND NOT safe)
  AND NOT regexp_matches(filename, '(^|/)(training_args|optimizer|scheduler)[^/]*$') AS take FROM s),
j AS (SELECT *, bool_or(take AND filename = 'config.json') OVER (PARTITION BY model) AS config, bool_or(take AND regexp_matches(filename, '[.](safetensors|bin)$')) OVER (PARTITION BY model) AS weights FROM t)"""
ORACLES["selected_files"] = f"{_SELECTED} SELECT model, filename FROM j WHERE take AND config AND weights"
ORACLES["unusable_models"] = f"{_SELECTED} SELECT DISTINCT model, CASE WHEN NOT config THEN 'no_config' ELSE 'no_weights' END AS reason FROM j WHERE NOT (config AND weights)"
