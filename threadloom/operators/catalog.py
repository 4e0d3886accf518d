"""Catalogs of dataset versions, runs, checkpoints and models as tables: identities, precedence, merging and order."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
VERSION = r"^v[1-9]\d*$"


def is_safe_id(name: Column) -> Column:
    """Letters, digits, dots, dashes and underscores from a letter or digit on, without ``..`` or a dot at the end."""
    return F.coalesce(name.rlike(SAFE_ID) & ~name.contains("..") & ~name.endswith("."), F.lit(False))


def is_version(name: Column) -> Column:
    return F.coalesce(name.rlike(VERSION), F.lit(False))


def version_number(name: Column) -> Column:
    """The number of a version for sorting: v2 comes before v10."""
    return F.when(is_version(name), F.substring(name, 2, 18).try_cast("long"))


def datasets_in_order(manifests: DataFrame) -> DataFrame:
    """Manifests (dataset_id, version, path) whose path ends in their identity, by id and version number."""
    own = F.col("path").endswith(F.concat_ws("/", F.lit(""), "dataset_id", "version", F.lit("dataset.json")))
    return manifests.filter(own & is_safe_id(F.col("dataset_id")) & is_version(F.col("version"))).orderBy("dataset_id", version_number(F.col("version")))


def checkpoint_order(name: str, step: str) -> list[Column]:
    """Sort keys of a run's checkpoints: last, best, then by step from the newest, then by name."""
    first = F.when(F.col(name) == "last.pt", 0).when(F.col(name) == "best.pt", 1).otherwise(2)
    return [first, F.desc(step), F.col(name)]


def evaluation_order(name: str) -> list[Column]:
    """Sort keys of checkpoints to evaluate: ``step_N`` by number, then all others by name."""
    number = F.regexp_extract(name, r"^step_(\d+)", 1).try_cast("long")
    return [number.isNull(), number, F.col(name)]


def evaluation_plan(checkpoints: DataFrame, questions: DataFrame, seed: int = 0, most: int = 1000) -> DataFrame:
    """Every checkpoint with every question, and the seed of each answer.

    Questions are a short list written by hand; more than ``most`` are an error. Each checkpoint row is exploded by the list, so
    nothing is joined or shuffled. No questions: an empty result.
    """
    asked = questions.select("question_no", "question").limit(most + 1).collect()
    if len(asked) > most:
        raise ValueError(f"more than {most} questions")
    one = "struct<question_no:bigint,question:string>"
    listed = F.array(*(F.struct(F.lit(q["question_no"]).alias("question_no"), F.lit(q["question"]).alias("question")).cast(one) for q in asked)).cast(f"array<{one}>")
    rows = checkpoints.select("*", F.explode(listed).alias("_q"))
    return rows.select(*checkpoints.columns, "_q.*", (F.lit(seed) + F.col("_q.question_no")).alias("seed"))


def merged_catalog(sources: list[DataFrame]) -> DataFrame:
    """(key, model_id, display_name, sources) of models named by any source (model_id, display_name), the later overriding the
    name; ids that differ by case are one model."""
    rows = [s.select("model_id", "display_name", F.lit(k).alias("priority")) for k, s in enumerate(sources)]
    every = reduce(DataFrame.unionByName, rows).filter("model_id is not null")
    return every.groupBy(F.lower("model_id").alias("key")).agg(
        F.max_by("model_id", "priority").alias("model_id"),
        F.max(F.when(F.col("display_name").isNotNull(), F.struct("priority", "display_name")))["display_name"].alias("display_name"),
        F.countDistinct("priority").alias("sources"),
    )


def registered(rows: DataFrame, modes: tuple[str, ...] = ("qlora", "lora", "full")) -> DataFrame:
    """One registration (model_id, mode, active) per model: the active one, else the first of ``modes``."""
    rank = F.array_position(F.array(*map(F.lit, modes)), F.col("mode"))
    known = rows.filter(rank > 0).withColumn("_rank", F.when(F.col("active"), 0).otherwise(rank))
    return known.withColumn("_k", F.row_number().over(Window.partitionBy("model_id").orderBy("_rank", "mode"))).filter("_k = 1").drop("_rank", "_k")


def next_run_number(runs: DataFrame, keys: list[str], most: int = 9999) -> DataFrame:
    """The smallest free number from 1 per key for rows (keys, number); null where all ``most`` are taken.

    Numbers out of range and null ones take none. A number is free after a gap: numbers are ranked, and the first whose rank lags behind it marks the gap."""
    taken = runs.select(*keys, F.when(F.col("number").between(1, most), F.col("number")).alias("number")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("number")))
    fit = taken.withColumn("fit", F.col("number") == rank)
    free = fit.groupBy(*keys).agg((F.coalesce(F.max(F.when(F.col("fit"), F.col("number"))), F.lit(0)) + 1).alias("next_number"))
    return free.withColumn("next_number", F.when(F.col("next_number") <= most, F.col("next_number")))


def run_name(model: Column, dataset: Column, version: Column, number: Column) -> Column:
    slug = F.lower(F.regexp_replace(F.concat(F.lit("model--"), model), "/", "--"))
    return F.concat_ws("--", slug, F.concat_ws("-", dataset, version), F.concat(F.lit("run-"), F.lpad(number.cast("string"), 3, "0")))


def missing_keys(found: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``found`` whose keys ``known`` doesn't hold; rows with a null key are never known."""
    return found.join(known.select(*keys), keys, "left_anti")


def unknown_versions(found: DataFrame, known: DataFrame) -> DataFrame:
    """Version folders that no manifest names yet."""
    return missing_keys(found, known, ["dataset_id", "version"])


def with_saved_metrics(files: DataFrame, saved: DataFrame) -> DataFrame:
    """Checkpoint files (name, modified_ns, size) with the saved step and loss where time and size are unchanged."""
    keys = ["name", "modified_ns", "size"]
    return files.join(saved.select(*keys, "global_step", "validation_loss"), keys, "left")


#: Folders of other runtimes, kinds of files worth fetching, and beginnings of names that hold training state.
OTHER_RUNTIMES = ("onnx", "openvino", "original", "gguf", "ggml", "flax", "tf")
FILE_KINDS = (".json", ".model", ".txt", ".tiktoken", ".bpe", ".jinja", ".safetensors")
TRAINING_STATE = ("training_args", "optimizer", "scheduler")


def _judged_files(files: DataFrame, model: str, name: str) -> DataFrame:
    folders = F.transform(F.slice(F.split(name, "/"), 1, F.greatest(F.size(F.split(name, "/")) - 1, F.lit(0))), F.lower)
    outside = ~F.arrays_overlap(folders, F.array(*map(F.lit, OTHER_RUNTIMES)))
    ends = lambda *kinds: F.rlike(name, F.lit(f"({'|'.join(map(re.escape, kinds))})$"))
    by = Window.partitionBy(model)
    rows = files.filter(F.col(name).isNotNull()).withColumn("_in", outside).withColumn("_safe", F.max(F.col("_in") & ends(".safetensors")).over(by))
    state = F.element_at(F.split(name, "/"), -1).rlike(f"^({'|'.join(TRAINING_STATE)})")
    rows = rows.withColumn("_take", F.col("_in") & (ends(*FILE_KINDS) | ends(".bin") & ~F.col("_safe")) & ~state)
    return rows.withColumns({
        "_config": F.max(F.col("_take") & (F.col(name) == "config.json")).over(by),
        "_weights": F.max(F.col("_take") & ends(".safetensors", ".bin")).over(by),
    })


def selected_files(files: DataFrame, model: str = "model", name: str = "filename") -> DataFrame:
    """Files worth fetching of each model: of FILE_KINDS outside the folders of other runtimes, no training state, and ``.bin`` files
    only where no safetensors lie outside those folders. Names are compared by case, folders aren't. Models without a
    ``config.json`` or weights have no rows here and one in ``unusable_models``."""
    return _judged_files(files, model, name).filter("_take and _config and _weights").select(*files.columns)


def unusable_models(files: DataFrame, model: str = "model", name: str = "filename") -> DataFrame:
    """(model, reason) of the models none of whose files are selected: ``no_config``, else ``no_weights``."""
    per = _judged_files(files, model, name).groupBy(model).agg(F.max("_config").alias("c"), F.max("_weights").alias("w"))
    return per.filter("not (c and w)").select(model, F.when(~F.col("c"), "no_config").otherwise("no_weights").alias("reason"))
