"""Every training-data query on the smallest tables; those with SQL against it."""

import duckdb
import pytest

from threadloom.llm.queries import ORACLES, QUERIES
from tools_compare import TABLES, digest

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": [("sample_no", "bigint"), ("pair_no", "int"), ("defect", "string")], "p3_found": [("sample_no", "bigint"), ("group_no", "bigint")],
    "p4_found": [("sample_a", "bigint"), ("sample_b", "bigint")], "p5_found": [("record_table", "string"), ("record_id", "bigint")], "p9_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name] and len(rows) == len(set(rows))
    if name in ORACLES:
        db = duckdb.connect()
        db.execute("SET TimeZone='UTC'")
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        cursor = db.execute(ORACLES[name])
        assert digest(df.columns, rows) == digest([d[0] for d in cursor.description], cursor.fetchall())


def test_every_record_is_covered(spark):
    samples = spark.read.parquet(f"{SF}/samples.parquet").select("sample_no").distinct().count()
    posts = spark.read.parquet(f"{SF}/posts.parquet").select("post_id").distinct().count()
    documents = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert QUERIES["p3_splits"](spark, SF).count() == samples
    assert QUERIES["p5_scores"](spark, SF).count() == samples + posts
    assert QUERIES["p6_tokens"](spark, SF).count() == samples + documents
    assert QUERIES["p9_scores"](spark, SF).count() == documents


def test_shares_name_the_size_and_its_limit(spark):
    rows = QUERIES["p8_shares"](spark, SF).collect()
    assert {r["mixture_tokens"] for r in rows} == {sum(r["tokens"] for r in rows)}
    limits = [r for r in rows if r["limits_size"]]
    assert len(limits) == 1 and limits[0]["tokens"] == limits[0]["source_tokens"] * limits[0]["max_repeats"]
