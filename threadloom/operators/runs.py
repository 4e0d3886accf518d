"""Training runs and their files as tables: manifests and their updates, parents of resumed runs, reports, statistics that can be
reused, storage totals, indexes of lines and limits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import bind, fence
from threadloom.operators.progress import finite
from threadloom.operators.sampling import numbered_ranges

CHECKPOINT = "struct<global_step:bigint,validation_loss:double,modified_ns:bigint,size:bigint>"


def updated_manifests(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """``runs`` (run_id, global_step, planned_total_steps, checkpoints map<string, CHECKPOINT>) after ``updates``.

    An update (run_id, at, step, total, checkpoint_name, validation_loss, modified_ns, size) sets the step; a null total or name
    leaves the planned steps or the checkpoints as they are. Of several updates of one run, or of one checkpoint, the last by
    ``at`` and step holds. A loss that is no finite number becomes null. Updates of unknown runs are ignored, as are null ids.
    """
    known = updates.filter("run_id is not null")
    newest = known.groupBy("run_id").agg(
        F.max(F.struct("at", "step"))["step"].alias("_step"),
        F.max(F.when(F.col("total").isNotNull(), F.struct("at", "step", "total")))["total"].alias("_total"),
    )
    entry = F.struct(
        F.col("step").cast("bigint").alias("global_step"), finite(F.col("validation_loss")).alias("validation_loss"),
        F.col("modified_ns").cast("bigint").alias("modified_ns"), F.col("size").cast("bigint").alias("size"),
    )
    saved = known.filter("checkpoint_name is not null").groupBy("run_id", "checkpoint_name").agg(F.max(F.struct("at", "step", entry.alias("e")))["e"].alias("e"))
    # a run has as many entries as it has checkpoint files
    maps = saved.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("checkpoint_name", "e"))).alias("_new"))
    joined = runs.join(newest, "run_id", "left").join(maps, "run_id", "left")
    none = F.create_map().cast(f"map<string,{CHECKPOINT}>")
    old, new = F.coalesce("checkpoints", none), F.coalesce("_new", none)
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)
    own = {"global_step": F.coalesce("_step", "global_step"), "planned_total_steps": F.coalesce("_total", "planned_total_steps"), "checkpoints": merged}
    return joined.select(*(own[c].alias(c) if c in own else F.col(c) for c in runs.columns))


def resume_reasons(jobs: DataFrame, runs: DataFrame, settings: tuple[str, ...] = ("batch_size", "random_seed", "max_train_samples")) -> DataFrame:
    """``jobs`` with ``parent_run_id`` and why they can't be resumed (``reason``, null where they can).

    A job names the ``directory`` of the run it goes on from; a null directory starts afresh. Reasons, first hit: ``no_parent``,
    ``other_model_or_data`` (model_id, dataset_id, dataset_version), ``splits_changed`` (split_hash, if the run kept one) and
    ``setting_changed``. Runs have one row per directory.
    """
    same = ("model_id", "dataset_id", "dataset_version", "split_hash", *settings)
    parents = runs.filter("directory is not null").select("directory", F.col("run_id").alias("parent_run_id"), *(F.col(c).alias(f"_{c}") for c in same))
    going_on = jobs.filter("directory is not null").join(parents, "directory", "left")
    equal = lambda c: F.col(c).eqNullSafe(F.col(f"_{c}"))
    identity = equal("model_id") & equal("dataset_id") & equal("dataset_version")
    kept = F.lit(True)
    for c in settings:
        kept = kept & equal(c)
    reason = (
        F.when(F.col("parent_run_id").isNull(), "no_parent").when(~identity, "other_model_or_data")
        .when(F.col("_split_hash").isNotNull() & ~equal("split_hash"), "splits_changed").when(~kept, "setting_changed")
    )
    fresh = jobs.filter("directory is null").withColumns({"parent_run_id": F.lit(None).cast(dict(runs.dtypes)["run_id"]), "reason": F.lit(None).cast("string")})
    return going_on.select(*jobs.columns, "parent_run_id", reason.alias("reason")).unionByName(fresh.select(*jobs.columns, "parent_run_id", "reason"))


def literal_block(text: Column) -> Column:
    """Text in a fence that nothing in it closes."""
    return bind(F.coalesce(text, F.lit("")), lambda t: F.concat(fence(t), F.lit("text\n"), t, F.lit("\n"), fence(t), F.lit("\n")))


def answer_block(checkpoint: Column, number: Column, question: Column, answer: Column, tokens: Column, seconds: Column) -> Column:
    """One answer of an evaluation report as Markdown. Its headings are fixed values."""
    head = F.concat(F.lit("\n## "), checkpoint, F.lit(" · вопрос "), number.cast("string"), F.lit("\n\n"))
    foot = F.format_string("\nТокенов: %d; секунд: %.2f.\n", tokens.cast("bigint"), seconds.cast("double"))
    return F.concat(head, literal_block(question), F.lit("\n### Ответ\n\n"), literal_block(answer), foot)


def unfinished_batches(batches: DataFrame, epoch: int, done: int) -> DataFrame:
    """The batches (epoch, batch_no from 0) that a run resumed in ``epoch`` after ``done`` of its batches still has to do."""
    return batches.filter((F.col("epoch") > epoch) | (F.col("epoch") == epoch) & (F.col("batch_no") >= done))


def reusable_tokens(statistics: DataFrame, max_length: int, usable: Column | int, objective: str = "response_only") -> Column:
    """The training tokens that a statistics row (max_sequence_length, training_objective, splits) tells of, or null where it was
    made for another window, objective or number of usable samples."""
    train = F.col("splits.train")
    fits = (F.col("max_sequence_length") == max_length) & (F.col("training_objective") == objective) & (train["usable_samples"] == usable)
    return F.when(fits, train["training_loss_tokens"])


def storage_rollup(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, files, size_bytes, digest) of rows (path, target, size, modified_ns): each target counts its size once per key, however
    many paths lead to it; a null target is a path of its own. ``digest`` is a fingerprint of what was seen, the same in any order.

    Targets are made distinct before they are summed, and the digest sums 128 hash bits per path, so no key's files are gathered.
    """
    real = F.coalesce("target", "path")
    line = F.concat_ws(":", "path", F.col("size").cast("string"), F.col("modified_ns").cast("string"))
    halves = [F.conv(F.substring(F.md5(line.cast("binary")), at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 17)]
    seen = files.withColumns({"_real": real, "_a": halves[0], "_b": halves[1]}).groupBy(*keys, "_real").agg(
        F.count("*").alias("n"), F.max("size").alias("s"), F.sum("_a").alias("a"), F.sum("_b").alias("b")
    )
    return seen.groupBy(*keys).agg(
        F.sum("n").alias("files"), F.coalesce(F.sum("s"), F.lit(0)).alias("size_bytes"), F.concat_ws("-", F.sum("a").cast("string"), F.sum("b").cast("string")).alias("digest")
    )


def catalog_totals(versions: DataFrame) -> DataFrame:
    """One row: (dataset_count, version_count, total_samples) of versions (dataset_id, version, samples)."""
    return versions.agg(F.countDistinct("dataset_id").alias("dataset_count"), F.count("*").alias("version_count"), F.coalesce(F.sum("samples"), F.lit(0)).alias("total_samples"))


def line_index(rows: DataFrame, order: list[str], line: str, usable: Column) -> DataFrame:
    """``rows`` with the byte ``line_offset`` of each line in a file of all lines in ``order``, and ``row_no`` (from 0) among the
    usable ones, null for others. Null lines are empty ones. Offsets are summed per range of the order and stitched, in parallel."""
    sized = rows.withColumns({"_bytes": F.coalesce(F.octet_length(line), F.lit(0)).cast("bigint") + 1, "_usable": F.coalesce(usable, F.lit(False)).cast("bigint")})
    out = numbered_ranges(sized, order, {"line_offset": "_bytes", "_before": "_usable"})
    return out.withColumn("row_no", F.when(F.col("_usable") == 1, F.col("_before"))).drop("_bytes", "_usable", "_before")


def first_usable(rows: DataFrame, order: list[str], usable: Column, most: int) -> DataFrame:
    """The first ``most`` usable rows in ``order``: a limit that counts only what can be used."""
    kept = numbered_ranges(rows.filter(usable).withColumn("_one", F.lit(1).cast("bigint")), order, {"_before": "_one"})
    return kept.filter(F.col("_before") < most).drop("_one", "_before")


def normal_path(path: Column) -> Column:
    """A path without empty parts, ``.`` and ``..``; one that climbs above its root is null."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(
        parts, F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("inside")),
        lambda a, p: F.when(p != "..", F.struct(F.concat(a["at"], F.array(p)).alias("at"), a["inside"].alias("inside"))).otherwise(
            F.struct(F.slice(a["at"], F.lit(1), F.greatest(F.size(a["at"]) - 1, F.lit(0))).alias("at"), (a["inside"] & (F.size(a["at"]) > 0)).alias("inside"))
        ),
    )
    return F.when(walked["inside"], F.concat(F.lit("/"), F.array_join(walked["at"], "/")))


def is_contained(path: Column, root: Column) -> Column:
    """An absolute path lies strictly inside ``root`` once both are normal; links are not followed. Nulls lie nowhere."""
    inner, outer = normal_path(path), normal_path(root)
    below = F.when(outer == "/", inner != "/").otherwise(inner.startswith(F.concat(outer, F.lit("/"))))
    return F.coalesce(path.startswith("/") & root.startswith("/") & below, F.lit(False))


def range_errors(rules: dict[str, tuple[float | None, float | None]]) -> Column:
    """The names of the columns that are null or outside their range (least, most), in order; an empty array for a sound config."""
    checks = []
    for name, (least, most) in rules.items():
        value = F.col(name)
        sound = value.isNotNull() & ~F.isnan(value.cast("double"))
        sound = sound if least is None else sound & (value >= least)
        sound = sound if most is None else sound & (value <= most)
        checks.append(F.when(~F.coalesce(sound, F.lit(False)), F.lit(name)))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def text_snapshots(tokens: DataFrame, stream: str, at: str, token: str, piece: str, stops: set[int]) -> DataFrame:
    """(stream, at, text) after each token of a stream: the text so far, without stop tokens and what follows one; a character that
    isn't complete yet waits for the rest of its bytes. ``piece`` holds a token's bytes, null ones none.

    A stream is scanned in order by one task with its own bytes as the only state; streams are spread over the tasks.
    """
    ordered = tokens.select(F.col(stream).alias("stream"), F.col(at).alias("at"), F.col(token).cast("bigint").alias("token"), F.col(piece).cast("binary").alias("piece"))
    ordered = ordered.repartition("stream").sortWithinPartitions("stream", "at")
    fields = {f.name: f.dataType.simpleString() for f in ordered.schema}

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, said, stopped, last = object(), b"", False, ""
        for part in parts:
            out = []
            for s, t, p in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()):
                if s != now:
                    now, said, stopped, last = s, b"", False, ""
                stopped = stopped or t in stops
                if not stopped:
                    said += p or b""
                    text = said.decode("utf-8", "replace")
                    last = last if text.endswith("�") else text
                out.append(last)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], names=["stream", "at", "text"])

    return ordered.mapInArrow(scan, f"stream {fields['stream']}, at {fields['at']}, text string")
