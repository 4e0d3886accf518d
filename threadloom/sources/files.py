"""Readers of thread files, catalogs, chat lines, question-answer files and manifests, each with its own error policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.text import exact_references, html_to_post, references

_THREAD = (
    "board string, thread_id bigint, posts array<struct<post_id:bigint,text:string,references:array<string>>>"
)


def whole_files(spark: SparkSession, path: str, glob: str, recursive: bool = True) -> DataFrame:
    """(path, name, value) of the files below ``path`` whose name matches ``glob``, one row per file."""
    lines = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).text(path, wholetext=True)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), "value")


def _kind(value: Column, path: str) -> Column:
    """The JSON type at a path, upper case; null where the path is missing."""
    return F.schema_of_variant(F.variant_get(value, path, "variant"))


def raw_threads(spark: SparkSession, path: str) -> DataFrame:
    """One row per post of the files ``<board>/<id>.json`` with ``malformed`` files kept as one row without posts.

    A file is malformed unless it is an object with a board, a whole thread id and posts that each have a whole id, a text
    and a list of references. References count if they are exactly ``>>`` and digits, once each, in order.
    """
    files = whole_files(spark, path, "*.json").withColumn("v", F.try_parse_json("value"))
    posts = F.variant_get("v", "$.posts", "array<variant>")
    whole = lambda v, p: F.coalesce(_kind(v, p) == "BIGINT", F.lit(False))
    text = lambda v, p: F.coalesce(_kind(v, p) == "STRING", F.lit(False))
    sound = F.coalesce(_kind(F.col("v"), "$.board") == "STRING", F.lit(False)) & whole(F.col("v"), "$.thread_id") & posts.isNotNull()
    files = files.withColumn("posts", posts).withColumn("sound", sound)
    each = F.forall("posts", lambda p: whole(p, "$.post_id") & text(p, "$.text") & F.coalesce(_kind(p, "$.references").startswith("ARRAY"), F.lit(False)))
    files = files.withColumn("malformed", ~F.coalesce(F.col("sound") & each, F.lit(False)))
    parsed = F.from_json("value", _THREAD)
    rows = files.select("path", "malformed", F.when(~F.col("malformed"), parsed).alias("t"))
    exploded = rows.select("path", "malformed", F.col("t.board").alias("board"), F.col("t.thread_id").alias("thread_id"), F.posexplode_outer("t.posts").alias("ord", "p"))
    return exploded.select("path", "malformed", "board", "thread_id", "ord", F.col("p.post_id").alias("post_id"), F.col("p.text").alias("text"), F.when(F.col("p").isNotNull(), exact_references("p.references")).alias("refs"))


def catalog_ids(payloads: DataFrame, payload: str = "payload", keys: list[str] | None = None) -> DataFrame:
    """(keys, num, place) of ``threads[].num`` of catalog payloads, each number at its first place."""
    keys = keys or []
    nums = F.from_json(payload, "threads array<struct<num:bigint>>")["threads"]
    each = payloads.select(*keys, F.posexplode(nums).alias("place", "t")).select(*keys, "place", F.col("t.num").alias("num"))
    return each.filter("num is not null").groupBy(*keys, "num").agg(F.min("place").alias("place"))


def thread_documents(payloads: DataFrame, payload: str = "payload", keys: list[str] | None = None) -> DataFrame:
    """(keys, title, ord, post_id, text, refs) of thread payloads: the first thread's posts with a text left after cleaning; the
    title is the first such post's subject, else the payload's."""
    if not keys:
        return thread_documents(payloads.withColumn("_k", F.monotonically_increasing_id()), payload, ["_k"]).drop("_k")
    shape = "title string, threads array<struct<posts:array<struct<num:bigint,comment:string,subject:string>>>>"
    parsed = payloads.select(*keys, F.from_json(payload, shape).alias("d"))
    posts = parsed.select(*keys, F.col("d.title").alias("root_title"), F.posexplode(F.element_at("d.threads", 1)["posts"]).alias("ord", "p"))
    clean = posts.select(*keys, "root_title", "ord", F.col("p.num").alias("post_id"), F.col("p.subject").alias("subject"), html_to_post("p.comment").alias("text"))
    kept = clean.filter("text is not null and text <> '' and post_id is not null").withColumn("refs", references("text"))
    # the first kept post of a payload, by a window over its few posts, so that the payload is parsed once
    first = F.first("subject").over(Window.partitionBy(*keys).orderBy("ord"))
    joined = kept.withColumn("first_subject", first)
    subject = F.when(F.trim("first_subject") != "", F.col("first_subject"))
    return joined.select(*keys, F.coalesce(subject, "root_title").alias("title"), "ord", "post_id", "text", "refs")


def board_url(url: Column, hosts: list[str]) -> tuple[Column, Column]:
    """(board, thread_id) of a board or thread address on one of ``hosts``; nulls where it is none."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    path = F.try_parse_url(url, F.lit("PATH"))
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    fits = scheme.isin("http", "https") & host.isin([h.lower() for h in hosts]) & path.rlike(r"^/[A-Za-z0-9]+(/res/\d+\.html)?/?$")
    board = F.when(fits, F.lower(F.regexp_extract(path, r"^/([A-Za-z0-9]+)", 1)))
    number = F.regexp_extract(path, r"/res/(\d+)\.html", 1).try_cast("long")
    return board, F.when(fits, number)


def qa_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, raw) of the samples in ``*_sft_raw.json`` files, without combined ones; a file holds a list of samples, an object
    with ``samples``, or one sample. A file of another shape gives one row with a null ``raw``; no file is an error."""
    files = whole_files(spark, path, "*_sft_raw.json").filter(~F.lower("name").startswith("combined_"))
    if files.isEmpty():
        raise FileNotFoundError(f"no question-answer files below {path}")
    v = F.try_parse_json("value")
    listed = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$.samples", "array<variant>"))
    single = F.when(F.variant_get(v, "$.messages", "variant").isNotNull(), F.array(v))
    return files.select("path", F.posexplode_outer(F.coalesce(listed, single)).alias("at", "v")).select("path", "at", F.to_json("v").alias("raw"))


def chat_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parsed lines of JSONL files beside their ``raw`` text; blank lines are skipped, a broken line is an error that names it."""
    lines = spark.read.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("path")).filter(F.trim("raw") != "")
    parsed = F.when(F.try_parse_json("raw").isNull(), F.raise_error(F.concat(F.lit("no JSON in "), F.col("path"), F.lit(": "), F.col("raw")))).otherwise(F.from_json("raw", schema))
    return lines.select("raw", "path", parsed.alias("p")).select("raw", "path", "p.*")


def training_texts(samples: DataFrame) -> DataFrame:
    """(text) of all context texts and answers, one row each."""
    return samples.select(F.explode(F.concat("context", F.array("response"))).alias("text"))


def fingerprints(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, sha256) of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def manifests(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Manifest files of a tree, with their path; broken ones are left out."""
    files = spark.read.schema(schema + ", _broken string").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", name)
    read = files.option("columnNameOfCorruptRecord", "_broken").json(path).withColumn("path", F.col("_metadata.file_path"))
    return read.filter("_broken is null").drop("_broken")


def report_examples(reports: DataFrame, text: str = "value") -> DataFrame:
    """(heading, block) of every fenced block of a Markdown report, under its second-level heading."""
    parts = F.filter(F.split(text, r"(?m)^## "), lambda s: s != "")
    each = reports.select(F.explode(parts).alias("part"))
    blocks = F.regexp_extract_all("part", F.lit(r"(?s)(`{3,})[^\n]*\n(.*?)\n\1"), 2)
    return each.select(F.trim(F.substring_index("part", "\n", 1)).alias("heading"), F.explode(blocks).alias("block"))
