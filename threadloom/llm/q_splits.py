"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import splits as S
from threadloom.stages import materialize


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.grouped_samples(spark.read.parquet(f"{sf_dir}/samples.parquet"), spark.read.parquet(f"{sf_dir}/posts.parquet"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose group of related samples spans more than one thread."""
    return S.groups_over_threads(_grouped(spark, sf_dir)).select("sample_no", "group_no")


#: Groups above this share of the samples are placed one by one: a tenth of them is one group, and shares are to be met as closely
#: as the groups allow. ``p3_shares`` reports what plain hashing reaches as well.
PLACE_ABOVE = 0.002
#: More splits than anybody cuts; a table that names more is refused, never cut short.
MOST_SPLITS = 1000


def _shares(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    rows = spark.read.parquet(f"{sf_dir}/split_shares.parquet").select("split_name", "split_share")
    return {r["split_name"]: r["split_share"] for r in S.bounded(rows, MOST_SPLITS)}


def _known(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sample_no, component) of all samples and (component, n), both written."""
    known = materialize(_grouped(spark, sf_dir).select("sample_no", F.col("group_no").alias("component")), "groups")
    return known, materialize(known.groupBy("component").agg(F.count("*").alias("n")), "sizes")


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample with its group and the split that the whole group goes to."""
    known, sizes = _known(spark, sf_dir)
    assigned = S.assign_splits(sizes, _shares(spark, sf_dir), place_above=PLACE_ABOVE)
    return known.join(assigned, "component").select("sample_no", F.col("component").alias("group_no"), "split_name")


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and groups of each split against its target share; ``hashed_share`` is what hashing alone reaches."""
    shares = _shares(spark, sf_dir)
    _, sizes = _known(spark, sf_dir)
    whole = sum(v for v in shares.values() if v)
    targets = spark.createDataFrame([(k, v / whole) for k, v in shares.items() if v], "split_name string, target_share double")
    total = sizes.agg(F.sum("n")).first()[0] or 1
    by_split = lambda above: sizes.join(S.assign_splits(sizes, shares, place_above=above), "component").groupBy("split_name")
    got = by_split(PLACE_ABOVE).agg(F.sum("n").alias("samples"), F.count("*").alias("groups"))
    hashed = by_split(None).agg(F.sum("n").alias("hashed"))
    rows = targets.join(got, "split_name", "left").join(hashed, "split_name", "left").fillna(0, ["samples", "groups", "hashed"])
    return rows.select("split_name", "samples", "groups", "target_share", (F.col("samples") / total).alias("reached_share"), (F.col("hashed") / total).alias("hashed_share"))


QUERIES = {"p3_found": p3_found, "p3_splits": p3_splits, "p3_shares": p3_shares}

ORACLES = {
    "p3_found": r"""WITH RECURSIVE one AS (
  SELECT sample_no, metadata.thread_id AS thread_id, metadata.assistant_post_id AS post_id,
    trim(regexp_extract(metadata.author_tag, '(?s)(!.*)$', 1), ' ') AS author FROM samples WHERE sample_no IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY sample_no ORDER BY loaded_at DESC NULLS LAST) = 1),
post AS (SELECT post_id, arg_max(thread_id, fetched_at) AS thread_id FROM posts GROUP BY post_id),
known AS (
  SELECT o.sample_no, coalesce(o.thread_id, p.thread_id) AS thread_id, CASE WHEN length(author) > 1 THEN author END AS author
  FROM one o LEFT JOIN post p USING (post_id)),
entity AS (
  SELECT sample_no, 't' || thread_id AS e FROM known WHERE thread_id IS NOT NULL
  UNION SELECT sample_no, 'a' || author FROM known WHERE author IS NOT NULL),
hub AS (SELECT e, min(sample_no) AS h FROM entity GROUP BY e),
link AS (SELECT DISTINCT sample_no AS a, h AS b FROM entity JOIN hub USING (e) UNION SELECT h, sample_no FROM entity JOIN hub USING (e)),
reach AS (
  SELECT sample_no AS s, sample_no AS r FROM known
  UNION
  SELECT reach.s, link.b FROM reach JOIN link ON link.a = reach.r),
comp AS (SELECT s AS sample_no, min(r) AS group_no FROM reach GROUP BY s),
span AS (SELECT group_no FROM comp JOIN known USING (sample_no) GROUP BY group_no HAVING count(DISTINCT thread_id) > 1)
SELECT sample_no, group_no FROM comp JOIN span USING (group_no)""",
}
