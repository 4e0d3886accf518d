"""Queries on the reply hierarchy of posts (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import hierarchy as H


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.reply_links(spark.read.parquet(f"{sf_dir}/posts.parquet"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.hierarchy(_links(spark, sf_dir), "post_id", "parent_id", scope="thread_id", unique=True)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post that has a parent, with root and depth (-1 where the chain runs into a loop)."""
    tree = _tree(spark, sf_dir).filter("parent_id is not null")
    return tree.select(F.col("node_id").alias("post_id"), "root_id", "depth")


def p2_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post with parent, root, depth, full path and the number of posts below it."""
    tree = _tree(spark, sf_dir)
    paths = H.with_paths(tree)
    return tree.join(paths, "node_id").select(
        F.col("node_id").alias("post_id"),
        "parent_id",
        "root_id",
        "depth",
        F.array_join("path", "/").alias("path"),
        "n_below",
    )


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post with every post below it and the distance between them."""
    return H.descendants(H.with_paths(_tree(spark, sf_dir))).select(
        F.col("ancestor_id").alias("post_id"), F.col("node_id").alias("below_id"), "distance"
    )


def p2_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post that is itself on a loop of replies."""
    return H.on_loop(_tree(spark, sf_dir)).select(F.col("node_id").alias("post_id"))


_LINKS = r"""
newest AS (
  SELECT post_id, thread_id, refs FROM posts WHERE post_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY fetched_at DESC NULLS LAST, thread_id DESC, refs DESC) = 1),
named AS (
  SELECT post_id, thread_id, unnest(refs) AS ref, unnest(range(len(refs))) AS at FROM newest),
hits AS (
  SELECT n.post_id, arg_min(p.post_id, n.at) AS parent_id FROM named n
  JOIN newest p ON p.thread_id = n.thread_id AND p.post_id = TRY_CAST(substr(n.ref, 3) AS BIGINT)
  WHERE regexp_full_match(n.ref, '>>[0-9]+') GROUP BY n.post_id),
links AS (SELECT n.post_id, h.parent_id FROM newest n LEFT JOIN hits h USING (post_id))"""

_TREE = rf"""WITH RECURSIVE {_LINKS},
down AS (
  SELECT post_id, post_id AS root_id, 0 AS depth, CAST(post_id AS VARCHAR) AS path FROM links WHERE parent_id IS NULL
  UNION ALL
  SELECT l.post_id, d.root_id, d.depth + 1, d.path || '/' || l.post_id FROM links l JOIN down d ON l.parent_id = d.post_id),
rest AS (SELECT post_id, parent_id FROM links WHERE post_id NOT IN (SELECT post_id FROM down)),
walk AS (
  SELECT post_id AS start, parent_id AS cur FROM rest
  UNION
  SELECT w.start, r.parent_id FROM walk w JOIN rest r ON r.post_id = w.cur),
looped AS (SELECT start AS post_id FROM walk WHERE start = cur),
roots AS (
  SELECT w.start AS post_id, min(w.cur) AS root_id FROM walk w JOIN looped l ON l.post_id = w.cur GROUP BY w.start)"""

ORACLES = {
    "p2_found": _TREE + """
SELECT l.post_id, coalesce(d.root_id, r.root_id) AS root_id, CAST(coalesce(d.depth, -1) AS INTEGER) AS depth
FROM links l LEFT JOIN down d USING (post_id) LEFT JOIN roots r USING (post_id) WHERE l.parent_id IS NOT NULL""",
    "p2_loops": _TREE + " SELECT DISTINCT post_id FROM looped",
    "p2_hierarchy": _TREE + """,
around AS (
  SELECT post_id, root_id, CAST(post_id AS VARCHAR) AS path FROM roots WHERE post_id = root_id
  UNION ALL
  SELECT l.post_id, a.root_id, a.path || '/' || l.post_id FROM rest l JOIN around a ON l.parent_id = a.post_id
  WHERE l.post_id <> a.root_id),
every AS (
  SELECT post_id, root_id, depth, path FROM down UNION ALL SELECT post_id, root_id, -1, path FROM around),
above AS (SELECT unnest(string_split(path, '/')) AS a, post_id FROM every),
below AS (SELECT CAST(a AS BIGINT) AS post_id, count(*) - 1 AS n_below FROM above GROUP BY a)
SELECT e.post_id, l.parent_id, e.root_id, CAST(e.depth AS INTEGER) AS depth, e.path, b.n_below
FROM every e JOIN links l USING (post_id) JOIN below b USING (post_id)""",
    "p2_descendants": _TREE + """,
around AS (
  SELECT post_id, root_id, CAST(post_id AS VARCHAR) AS path FROM roots WHERE post_id = root_id
  UNION ALL
  SELECT l.post_id, a.root_id, a.path || '/' || l.post_id FROM rest l JOIN around a ON l.parent_id = a.post_id
  WHERE l.post_id <> a.root_id),
every AS (SELECT post_id, string_split(path, '/') AS p FROM down UNION ALL SELECT post_id, string_split(path, '/') FROM around),
above AS (SELECT post_id, unnest(p) AS a, unnest(range(len(p))) AS k, len(p) AS n FROM every)
SELECT CAST(a AS BIGINT) AS post_id, post_id AS below_id, CAST(n - 1 - k AS INTEGER) AS distance FROM above WHERE CAST(a AS BIGINT) <> post_id""",
}

QUERIES = {"p2_found": p2_found, "p2_hierarchy": p2_hierarchy, "p2_descendants": p2_descendants, "p2_loops": p2_loops}
