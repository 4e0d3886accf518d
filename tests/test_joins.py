from threadloom.operators.joins import lookup


def test_lookup_with_null_keys(spark):
    rows = spark.createDataFrame([(k, None if k % 3 else k % 4, "x") for k in range(60)] + [(99, 7, None), (99, 7, None)], "id long, key long, note string")
    table = spark.createDataFrame([(0, "zero"), (3, "three"), (None, "none")], "key long, name string")
    got = sorted(tuple(r) for r in lookup(rows, table, "key", "id").collect())
    want = sorted((r["id"], r["key"], r["note"], {0: "zero", 3: "three"}.get(r["key"])) for r in rows.collect())
    assert str(got) == str(want)
    assert lookup(rows.limit(0), table, "key", "id").collect() == [] and {r["name"] for r in lookup(rows, table.limit(0), "key", "id").collect()} == {None}
    words = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "id long, w string")
    named = spark.createDataFrame([("", 5), ("a", 6)], "w string, v int")
    assert {r["id"]: r["v"] for r in lookup(words, named, "w", "id").collect()} == {1: None, 2: 5, 3: 6}


def test_tables_end_with_their_scope(spark):
    import os

    import pytest

    from threadloom import stages

    with stages.scope(spark):
        stage = stages.Stage(spark.range(3).toDF("k"), "scoped")
        folder = stage.path.removeprefix("file://")
        assert os.path.isdir(folder) and stages.materialize(stage.df, "again").count() == 3
    assert not os.path.isdir(folder)

    class Cluster:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Cluster()

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(RuntimeError):
        stages.shared_folder(Session)
