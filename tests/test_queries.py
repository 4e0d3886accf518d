"""Every query of the core library against its SQL on the smallest tables."""

import duckdb
import pytest

from threadloom.plans.queries import ORACLES, QUERIES
from tools_compare import TABLES, digest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    found.execute("SET TimeZone='UTC'")
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return found


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cursor = db.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()]) == digest(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_with_a_stable_schema(spark, name):
    first, again = QUERIES[name](spark, SF), QUERIES[name](spark, SF)
    assert first.dtypes == again.dtypes and first.count() == again.count()


def test_nothing_imports_the_training_data_operators():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "threadloom"
    for file in root.rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            assert "threadloom.llm" not in file.read_text()
