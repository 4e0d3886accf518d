import json

import pytest
from pyspark.sql import functions as F

from threadloom.operators import catalog, progress, sampling
from threadloom.sinks import files as sinks
from threadloom.sources import files, http
from threadloom.streaming import progress as streams


def test_throttle_by_items_and_time(spark):
    rows = spark.createDataFrame([("a", k, float(s)) for k, s in enumerate((0, 1, 2, 50, 51, 52, 53))] + [("b", 0, None)], "run string, step long, seconds double")
    got = {(r["run"], r["step"]) for r in progress.throttled(rows, "run", "step", "seconds", 3, 10.0).collect()}
    assert got == {("a", 0), ("a", 3), ("a", 6), ("b", 0)}
    assert progress.throttled(rows.limit(0), "run", "step", "seconds", 3, 10.0).collect() == []


def test_series_ignores_values_that_are_no_numbers(spark):
    rows = spark.createDataFrame([("a", 1, 2.0), ("a", 2, float("nan")), ("a", 3, 1.0), ("a", 4, float("inf"))], "run string, step long, loss double")
    got = {r["step"]: r for r in progress.loss_series(rows, "run", "step", "loss").collect()}
    assert got[4]["rolling_loss"] == 1.5 and got[4]["best_loss"] == 1.0 and [got[k]["is_best"] for k in (1, 2, 3, 4)] == [True, False, True, False]
    eta = rows.select(progress.eta(F.lit(12.0), F.lit(10), F.lit(24), F.lit(4))).first()[0]
    assert eta == 28.0


def test_streaming_throttle_equals_the_batch(spark, tmp_path):
    source = tmp_path / "in"
    rows = [("a", k, float(k * 4)) for k in range(9)]
    for k in range(3):
        spark.createDataFrame(rows[3 * k : 3 * k + 3], "run string, step long, seconds double").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("run string, step long, seconds double").parquet(str(source))
    query = streams.throttled_stream(stream, "run", "step", "seconds", 3, 100.0).writeStream.outputMode("append").format("memory").queryName("reports").start()
    query.processAllAvailable()
    query.stop()
    assert {r["step"] for r in spark.table("reports").collect()} == {0, 3, 6}


def test_snapshots_and_events(spark, tmp_path):
    (tmp_path / "ev").mkdir()
    lines = [{"type": "text", "text": "a"}, {"type": "text", "text": "a"}, {"type": "text", "text": "ab"}, {"type": "error", "detail": "x"}]
    (tmp_path / "ev" / "one.ndjson").write_text("\n".join(map(json.dumps, lines)) + "\nno json\n")
    query = streams.event_stream(spark, str(tmp_path / "ev")).writeStream.format("memory").queryName("events_seen").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("events_seen").count() == 5
    rows = spark.createDataFrame([("s", k, x["type"], x.get("text")) for k, x in enumerate(lines)] + [("t", 0, "text", "z")], "stream string, at long, type string, text string")
    assert [r["at"] for r in streams.changed_texts(rows.filter("stream = 's'"), "stream", "at").orderBy("at").collect()] == [0, 2]
    assert {tuple(r) for r in streams.stream_outcome(rows, "stream", "at").collect()} == {("s", "ab", "error"), ("t", "z", "cut_off")}


def test_snapshot_sink(spark, tmp_path):
    source = str(tmp_path / "steps")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "run string, step long").write.parquet(source)
    stream = spark.readStream.schema("run string, step long").parquet(source)
    query = streams.snapshot_sink(stream, str(tmp_path / "out"), str(tmp_path / "check"), "run", "step", "0 seconds")
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 2), ("b", 1)}


def test_catalog(spark):
    rows = spark.createDataFrame([("set", v, f"/x/set/{v}/dataset.json") for v in ("v10", "v2", "v0", "v1")] + [("a", "v1", "/x/b/v1/dataset.json")], "dataset_id string, version string, path string")
    assert [r["version"] for r in catalog.datasets_in_order(rows).collect()] == ["v1", "v2", "v10"]
    names = spark.createDataFrame([("ok-1.2",), ("..",), ("a.",), ("a..b",), ("-a",), (None,), ("",)], "n string")
    assert [r[0] for r in names.select(catalog.is_safe_id(F.col("n"))).collect()] == [True, False, False, False, False, False, False]
    runs = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 2), ("c", 1)], "m string, number long")
    assert {tuple(r) for r in catalog.next_run_number(runs, ["m"]).collect()} == {("a", 3), ("b", 1), ("c", 2)}
    points = spark.createDataFrame([("step_10",), ("best",), ("step_9",)], "name string")
    assert [r[0] for r in points.orderBy(*catalog.evaluation_order("name")).collect()] == ["step_9", "step_10", "best"]


def test_sampling(spark):
    import random

    rows = spark.createDataFrame([(k,) for k in range(200)], "k long")
    draw, slots = random.Random(5), {}
    for k in range(200):
        s = k if k < 7 else draw.randint(0, k)
        if s < 7:
            slots[s] = k
    assert {(r["slot"], r["k"]) for r in sampling.reservoir(rows, ["k"], 7, 5).collect()} == set(slots.items())
    assert sampling.reservoir(rows, ["k"], 0, 5).collect() == []
    assert {(r["k"], r["_at"]) for r in sampling.with_places(rows, ["k"]).collect()} == {(k, k) for k in range(200)}


def test_raw_thread_files(spark, tmp_path):
    (tmp_path / "b").mkdir()
    good = {"board": "b", "thread_id": 1, "posts": [{"post_id": 1, "text": "x", "references": []}, {"post_id": 2, "text": "y", "references": [">>1", ">>1", ">>x"]}]}
    bad = {"board": "b", "thread_id": True, "posts": []}
    (tmp_path / "b" / "1.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "b" / "2.json").write_text(json.dumps(bad))
    (tmp_path / "b" / "3.json").write_text("{broken")
    got = files.raw_threads(spark, str(tmp_path)).collect()
    assert sorted((r["post_id"], r["refs"]) for r in got if not r["malformed"]) == [(1, []), (2, [1])]
    assert sum(r["malformed"] for r in got) == 2


def test_question_answer_files(spark, tmp_path):
    one = {"messages": [], "sample_id": "1"}
    for name, body in (("a_sft_raw.json", [one, one]), ("b_sft_raw.json", {"samples": [one]}), ("c_sft_raw.json", one), ("combined_sft_raw.json", one), ("d_sft_raw.json", {"x": 1})):
        (tmp_path / name).write_text(json.dumps(body))
    rows = files.qa_files(spark, str(tmp_path)).collect()
    assert sum(r["raw"] is not None for r in rows) == 4 and sum(r["raw"] is None for r in rows) == 1
    with pytest.raises(FileNotFoundError):
        files.qa_files(spark, str(_empty(tmp_path)))


def _empty(path):
    (path / "empty").mkdir(exist_ok=True)
    (path / "empty" / "x.txt").write_text("x")
    return path / "empty"


def test_chat_lines_fail_fast(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n  \n{"a": 2}\n')
    assert [r["a"] for r in files.chat_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()] == [1, 2]
    (tmp_path / "y.jsonl").write_text("nope\n")
    with pytest.raises(Exception, match="no JSON"):
        files.chat_lines(spark, str(tmp_path / "y.jsonl"), "a int").collect()


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ё", "train", '{"a": 1}'), (2, None, "test", '{"a":  2}')], "k long, t string, split string, raw string")
    sinks.write_json_lines(rows.select("k", "t"), str(tmp_path / "out"))
    sinks.write_json_lines(rows.select("k", "t"), str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"k":1,"t":"ё"}', '{"k":2,"t":null}']
    with pytest.raises(ValueError):
        sinks.write_json_lines(rows.limit(0), str(tmp_path / "out"), allow_empty=False)
    sinks.write_splits(rows, str(tmp_path / "splits"), order="k")
    assert spark.read.text(str(tmp_path / "splits" / "split=test")).first()[0] == '{"a":  2}'
    made = sinks.publish_version(rows, str(tmp_path / "sets"), "set-1", "v1", "title")
    assert made["samples"] == 2 and (tmp_path / "sets" / "set-1" / "v1" / "dataset.json").exists()
    with pytest.raises(Exception):
        sinks.publish_version(rows, str(tmp_path / "sets"), "set-1", "v1", "title")
    assert [sinks.reserve_run(spark, str(tmp_path / "runs")) for _ in range(2)] == ["run-001", "run-002"]
    threads = spark.createDataFrame([("b", 1), ("b", 2)], "board string, thread_id long")
    assert [r["thread_id"] for r in sinks.save_new_threads(threads, threads.filter("thread_id = 1"), str(tmp_path / "t")).collect()] == [2]


def test_polite_fetch():
    waits, answers = [], iter([(429, {"Retry-After": "7"}, ""), (503, {}, ""), (200, {"Content-Type": "application/json"}, "{}")])
    assert http.fetch("u", lambda _: next(answers), 2, 0.5, waits.append) == "{}" and waits == [7.0, 1.0]
    with pytest.raises(ValueError):
        http.fetch("u", lambda _: (200, {"Content-Type": "text/html"}, ""), 0)
    with pytest.raises(OSError):
        http.fetch("u", lambda _: (404, {}, ""), 2, 0, waits.append)
    assert http.retry_after("Wed, 21 Oct 2015 07:28:00 GMT", 0) > 1e9 and http.retry_after("-3", 0) == 0.0 and http.retry_after("soon", 0) is None


def test_fingerprints_and_manifests(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "dataset.json").write_text(json.dumps({"dataset_id": "a", "version": "v1"}, indent=2))
    (tmp_path / "dataset.json").write_text("{broken")
    got = files.manifests(spark, str(tmp_path), "dataset.json", "dataset_id string, version string").collect()
    assert [r["dataset_id"] for r in got] == ["a"]
    import hashlib

    want = hashlib.sha256((tmp_path / "dataset.json").read_bytes()).hexdigest()
    assert want in {r["sha256"] for r in files.fingerprints(spark, str(tmp_path), "dataset.json").collect()}
    report = spark.createDataFrame([("# r\n## one\n```\nx\n```\n## two\n````text\ny\n```\n````\n",)], "value string")
    assert [tuple(r) for r in files.report_examples(report).collect()] == [("one", "x"), ("two", "y\n```")]
