import json
import os
import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import catalog, runs, tokens
from threadloom.sinks import files as sinks
from threadloom.sources.http import JsonSource, _Reader, fetch

RUN = f"run_id string, global_step long, planned_total_steps long, checkpoints map<string,{runs.CHECKPOINT}>, note string"
UPDATE = "run_id string, at long, step long, total long, checkpoint_name string, validation_loss double, modified_ns long, size long, note int"


def test_manifests_take_the_last_update(spark):
    old = {"global_step": 1, "validation_loss": 0.5, "modified_ns": 1, "size": 1}
    before = spark.createDataFrame([("a", 0, 10, {"x": old, "y": old}, "n"), ("b", 3, None, None, None), (None, 1, 1, None, None)], RUN)
    updates = [("a", 1, 5, None, "x", float("nan"), 2, 2, 0), ("a", 2, 6, 20, "x", 0.25, 3, 3, 0), ("a", 3, 7, None, None, None, None, None, 0), ("a", 1, 4, 15, "z", float("inf"), 9, 9, 0), ("gone", 1, 1, 1, "x", 1.0, 1, 1, 0), (None, 1, 1, 1, "x", 1.0, 1, 1, 0)]
    got = {r["run_id"]: r for r in runs.updated_manifests(before, spark.createDataFrame(updates, UPDATE)).collect()}
    assert set(got) == {"a", "b", None} and (got["a"]["global_step"], got["a"]["planned_total_steps"], got["a"]["note"]) == (7, 20, "n")
    assert {k: tuple(v) for k, v in got["a"]["checkpoints"].items()} == {"x": (6, 0.25, 3, 3), "y": (1, 0.5, 1, 1), "z": (4, None, 9, 9)}
    assert (got["b"]["global_step"], got["b"]["checkpoints"]) == (3, {}) and got[None]["global_step"] == 1
    assert runs.updated_manifests(before.limit(0), spark.createDataFrame(updates, UPDATE)).collect() == []


def test_why_a_run_cannot_be_resumed(spark):
    schema = "{} string, directory string, model_id string, dataset_id string, dataset_version string, split_hash string, batch_size int, random_seed int, max_train_samples int"
    one = ("m", "d", "v1", "h", 8, 42, None)
    known = spark.createDataFrame([("r1", "dir1", *one), ("r2", "dir2", *one[:3], None, *one[4:]), ("r3", None, *one)], schema.format("run_id"))
    jobs = [("ok", "dir1", *one), ("fresh", None, *one), ("lost", "dir9", *one), ("model", "dir1", "x", *one[1:]), ("split", "dir1", *one[:3], "g", *one[4:]), ("free", "dir2", *one[:3], "g", *one[4:]), ("size", "dir1", *one[:4], 4, *one[5:])]
    got = {r["job_id"]: (r["parent_run_id"], r["reason"]) for r in runs.resume_reasons(spark.createDataFrame(jobs, schema.format("job_id")), known).collect()}
    assert got == {
        "ok": ("r1", None), "fresh": (None, None), "lost": (None, "no_parent"), "model": ("r1", "other_model_or_data"), "split": ("r1", "splits_changed"), "free": ("r2", None), "size": ("r1", "setting_changed"),
    }


def test_storage_counts_a_target_once(spark):
    rows = [("k", "a", None, 5, 1), ("k", "b", "t", 7, 1), ("k", "c", "t", 7, 2), ("j", "d", "t", 7, 1), (None, "e", None, None, None)]
    df = spark.createDataFrame(rows, "key string, path string, target string, size long, modified_ns long")
    got = {r["key"]: r for r in runs.storage_rollup(df, ["key"]).collect()}
    assert {k: (r["files"], r["size_bytes"]) for k, r in got.items()} == {"k": (3, 12), "j": (1, 7), None: (1, 0)}
    again = {r["key"]: r["digest"] for r in runs.storage_rollup(df.repartition(5), ["key"]).collect()}
    assert again == {k: r["digest"] for k, r in got.items()} and len(set(again.values())) == 3


def test_line_index_and_limits(spark):
    pick = random.Random(3)
    lines = [(k, pick.choice(["", "ab", "пр", None, "x" * 50])) for k in range(200)]
    df = spark.createDataFrame(lines, "k long, line string")
    got = {r["k"]: (r["line_offset"], r["row_no"]) for r in runs.line_index(df.repartition(7), ["k"], "line", F.length("line") > 1).collect()}
    at = number = 0
    for k, line in lines:
        usable = line is not None and len(line) > 1
        assert got[k] == (at, number if usable else None)
        at, number = at + len((line or "").encode()) + 1, number + usable
    first = sorted(r["k"] for r in runs.first_usable(df.repartition(7), ["k"], F.length("line") > 1, 9).collect())
    assert first == [k for k, x in lines if x and len(x) > 1][:9]
    assert runs.line_index(df.limit(0), ["k"], "line", F.lit(True)).collect() == [] and runs.first_usable(df, ["k"], F.lit(None).cast("boolean"), 9).collect() == []


@pytest.mark.parametrize("path, root, inside", [
    ("/a/b", "/a", True), ("/a", "/a", False), ("/a/../b", "/a", False), ("/a/./b//c", "/a/", True), ("/ab", "/a", False), ("/../a/b", "/a", False), ("a/b", "/a", False), (None, "/a", False),
    ("/x", "/", True), ("/", "/", False), ("/a/b/..", "/a", False), ("\\a\\b", "/a", False),
])
def test_contained(spark, path, root, inside):
    df = spark.createDataFrame([(path, root)], "p string, r string")
    assert df.select(runs.is_contained(F.col("p"), F.col("r"))).first()[0] is inside


def test_range_errors_statistics_and_batches(spark):
    df = spark.createDataFrame([(1, 2.0), (None, float("nan")), (99, -1.0)], "a int, b double")
    assert [r[0] for r in df.select(runs.range_errors({"a": (1, 10), "b": (0.0, None)})).collect()] == [[], ["a", "b"], ["a", "b"]]
    kept = spark.createDataFrame(
        [(512, "response_only", ((4, 70),)), (256, "response_only", ((4, 70),)), (512, "all", ((4, 70),)), (512, "response_only", ((5, 70),)), (512, "response_only", ((4, None),)), (None, None, None)],
        "max_sequence_length int, training_objective string, splits struct<train:struct<usable_samples:long,training_loss_tokens:long>>",
    )
    assert [r[0] for r in kept.select(runs.reusable_tokens(kept, 512, 4)).collect()] == [70, None, None, None, None, None]
    batches = spark.createDataFrame([(e, b) for e in (0, 1, 2) for b in range(3)], "epoch int, batch_no int")
    assert {tuple(r) for r in runs.unfinished_batches(batches, 1, 2).collect()} == {(1, 2), (2, 0), (2, 1), (2, 2)}
    assert runs.catalog_totals(spark.createDataFrame([("a", "v1", 3), ("a", "v2", None)], "dataset_id string, version string, samples long")).first()[:] == (1, 2, 3)


def test_snapshots_of_generated_text(spark):
    smile = "😎".encode()
    rows = [("s", 1, 10, b"a"), ("s", 2, 11, smile[:2]), ("s", 3, 12, smile[2:]), ("s", 4, 3, b"<end>"), ("s", 5, 10, b"z"), ("t", 1, 3, None), (None, 1, 5, b"n")]
    df = spark.createDataFrame(rows, "s string, at long, token long, piece binary")
    got = {(r["stream"], r["at"]): r["text"] for r in runs.text_snapshots(df, "s", "at", "token", "piece", {3}).collect()}
    assert got == {("s", 1): "a", ("s", 2): "a", ("s", 3): "a😎", ("s", 4): "a😎", ("s", 5): "a😎", ("t", 1): "", (None, 1): "n"}


def test_prompts(spark):
    df = spark.createDataFrame([([7, 8], "hi", "be kind"), (None, None, None)], "ids array<long>, q string, s string")
    got = df.select(tokens.chat_prompt(F.col("ids")).alias("i"), tokens.templated_prompt(F.col("q"), F.col("s"), "[", "]").alias("t")).collect()
    assert [r["i"] for r in got] == [[2, 4, 7, 8, 5], [2, 4, 5]]
    assert got[0]["t"] == "[system\nbe kind]\n[user\nhi]\n[assistant\n<think>\n\n</think>\n\n" and got[1]["t"].startswith("[user\n]\n")


def test_files_of_models(spark):
    names = {
        "good": ["config.json", "model.bin", "model.safetensors", "onnx/model.safetensors", "optimizer.bin", "merges.bpe", "readme.md", "sub/vocab.txt"], "old": ["config.json", "model.bin", "GGUF/x.json", "tf/y.safetensors"],
        "bare": ["model.bin"], "empty": ["config.json", "Model.SAFETENSORS"], "case": ["Config.json", "model.bin"],
    }
    df = spark.createDataFrame([(m, n) for m, ns in names.items() for n in [*ns, None]], "model string, filename string")
    got = {}
    for r in catalog.selected_files(df).collect():
        got.setdefault(r["model"], set()).add(r["filename"])
    assert got == {"good": {"config.json", "model.safetensors", "merges.bpe", "sub/vocab.txt"}, "old": {"config.json", "model.bin"}}
    assert {tuple(r) for r in catalog.unusable_models(df).collect()} == {("bare", "no_config"), ("empty", "no_weights"), ("case", "no_config")}


def test_published_bytes_and_reports(spark, tmp_path):
    source = tmp_path / "in.jsonl"
    source.write_text('{"a": 1}\n\n{"a":   2}\n')
    made = sinks.publish_version(str(source), str(tmp_path / "sets"), "set-1", "v1", "t", spark=spark)
    import hashlib

    assert (tmp_path / "sets/set-1/v1/samples.jsonl").read_bytes() == source.read_bytes()
    assert made["samples"] == 2 and made["sha256"] == hashlib.sha256(source.read_bytes()).hexdigest()
    assert json.loads((tmp_path / "sets/set-1/v1/dataset.json").read_text()) == made
    with pytest.raises(FileExistsError):
        sinks.publish_version(str(source), str(tmp_path / "sets"), "set-1", "v1", "t", spark=spark)
    with pytest.raises(ValueError):
        sinks.publish_version(spark.range(0), str(tmp_path / "sets"), "set-1", "v2", "t")
    assert not os.path.exists(tmp_path / "sets/set-1/v2")
    report = str(tmp_path / "report")
    answers = spark.createDataFrame([("step_1", 1, "q", "a ``` b", 5, 1.5)], "checkpoint string, question_number int, question string, answer string, generated_tokens long, elapsed_seconds double")
    with pytest.raises(FileNotFoundError):
        sinks.append_answers(answers, report)
    sinks.create_report(spark, report, "{}")
    for _ in range(2):
        sinks.append_answers(answers, report)
    sinks.finish_report(spark, report, "done")
    with pytest.raises(FileExistsError):
        sinks.create_report(spark, report, "{}")
    blocks = [r["block"] for r in sinks.report_text(spark, report).collect()]
    assert len(blocks) == 2 and "````text\na ``` b\n````" in blocks[0] and "1.50" in blocks[0]


def test_run_numbers_are_taken_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    folder = str(tmp_path / "runs")
    os.makedirs(f"{folder}/run-002")
    with ThreadPoolExecutor(8) as pool:
        names = list(pool.map(lambda _: sinks.reserve_run(spark, folder), range(12)))
    assert len(set(names)) == 12 and "run-002" not in names and "run-001" in names


def test_replacing_keeps_the_old_result_until_the_new_one_stands(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_json_lines(spark.range(3), path)
    with pytest.raises(OSError):
        sinks.swap_in(spark, path + ".missing", path)
    assert spark.read.json(path).count() == 3
    sinks.write_json_lines(spark.range(5), path)
    assert spark.read.json(path).count() == 5 and sorted(os.listdir(tmp_path)) == ["out"]


def test_hosts_are_read_side_by_side():
    reader = _Reader({"urls": "http://a/1 http://b/1 http://A/2", "delay": "0"}, lambda url: (200, {}, f'"{url}"'))
    parts = reader.partitions()
    assert [p.urls for p in parts] == [["http://a/1", "http://A/2"], ["http://b/1"]]
    assert list(reader.read(parts[0])) == [("http://a/1", '"http://a/1"'), ("http://A/2", '"http://A/2"')] and JsonSource.name() == "polite_json"
    with pytest.raises(ValueError):
        fetch("u", lambda _: (200, {"Content-Type": "text/html"}, ""))
