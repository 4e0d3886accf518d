"""Writers that never leave half a result: JSON lines, split files, immutable threads, published versions and run numbers."""

from __future__ import annotations

import hashlib
import json
import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.catalog import SAFE_ID, VERSION, missing_keys
from threadloom.operators.runs import answer_block
from threadloom.sources.files import fingerprints


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target, jvm


def _moved(fs, source, target) -> bool:
    """Whether the move succeeded; stores differ in whether they say no or raise."""
    try:
        return bool(fs.rename(source, target))
    except Py4JJavaError:
        return False


def swap_in(spark: SparkSession, staged: str, path: str) -> None:
    """Move a finished ``staged`` folder or file to ``path``. What stood there is moved aside first and deleted last, and comes back
    if the move fails; after a crash it is beside ``path`` under ``.old``, never lost."""
    fs, target, jvm = _fs(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(path + ".old")
    if fs.exists(target):
        fs.delete(aside, True)
        if not _moved(fs, target, aside):
            raise OSError(f"could not move {path} aside")
    if not _moved(fs, jvm.org.apache.hadoop.fs.Path(staged), target):
        if fs.exists(aside):
            _moved(fs, aside, target)
        raise OSError(f"could not move {staged} to {path}")
    fs.delete(aside, True)


def write_json_lines(rows: DataFrame, path: str, allow_empty: bool = True) -> None:
    """Replace ``path`` by one compact object per line; with ``allow_empty`` off, no rows are an error and nothing is replaced."""
    if not allow_empty and rows.isEmpty():
        raise ValueError("no rows to write")
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path + ".part")
    swap_in(rows.sparkSession, path + ".part", path)


def write_splits(rows: DataFrame, path: str, raw: str = "raw", split: str = "split", order: str | None = None) -> None:
    """Write the original lines under ``path/split=<name>``, in input order within a file where ``order`` names it."""
    ready = rows.repartitionByRange(split, order) if order else rows
    ready = ready.sortWithinPartitions(split, order) if order else ready
    ready.select(split, raw).write.mode("errorifexists").partitionBy(split).text(path)


def save_new_threads(threads: DataFrame, saved: DataFrame, path: str) -> DataFrame:
    """Append the threads (board, thread_id) that ``saved`` doesn't have yet and return them; saved ones are never touched."""
    new = missing_keys(threads, saved, ["board", "thread_id"])
    new.write.mode("append").partitionBy("board").json(path)
    return new


def _sha256(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name below ``path``, SHA-256) of its data files, in order; a file is hashed by one task."""
    got = fingerprints(spark, path).select("path", "sha256").collect()  # one row per file
    names = {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in got}
    return sorted((n, h) for n, h in names.items() if not n.startswith(("_", ".")))


def create_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that must not exist yet; of several that try at once, only one succeeds. Local files are made by the
    system's exclusive creation, which Hadoop's local file system lacks; elsewhere this is as atomic as the store's creation."""
    fs, target, jvm = _fs(spark, path)
    try:
        _create(spark, fs, target, jvm, text)
    except Py4JJavaError as error:
        if "AlreadyExists" in str(error.java_exception.getClass().getName()):
            raise FileExistsError(path) from error
        raise


def _create(spark: SparkSession, fs, target, jvm, text: str) -> None:
    if fs.getUri().getScheme() == "file":
        local = jvm.java.nio.file.Paths.get(fs.makeQualified(target).toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
        fs.mkdirs(target.getParent())
        jvm.java.nio.file.Files.createFile(local, spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
    out = fs.create(target, fs.getUri().getScheme() == "file")
    out.write(bytearray(text.encode()))
    out.close()


def publish_version(rows: DataFrame | str, root: str, dataset_id: str, version: str, title: str, description: str = "", spark: SparkSession | None = None) -> dict:
    """Publish a version that must not exist yet and return its manifest, which is written last as the mark of completeness.

    ``rows`` is a frame, which is written as JSON lines, or the path of JSON lines (a file or folder), whose bytes are copied as they
    are and compared by SHA-256. The manifest holds the SHA-256 of a single file, else that of all names with their sums.
    """
    if not re.fullmatch(SAFE_ID.strip("^$"), dataset_id) or not re.fullmatch(VERSION.strip("^$"), version):
        raise ValueError("bad dataset id or version")
    spark = spark or (rows.sparkSession if isinstance(rows, DataFrame) else SparkSession.getActiveSession())
    folder = f"{root}/{dataset_id}/{version}"
    fs, target, jvm = _fs(spark, f"{folder}/samples.jsonl")
    if fs.exists(jvm.org.apache.hadoop.fs.Path(folder)):
        raise FileExistsError(folder)
    given = None
    try:
        if isinstance(rows, DataFrame):
            rows.write.mode("errorifexists").json(f"{folder}/samples.jsonl")
        else:
            given = _sha256(spark, rows)
            source = jvm.org.apache.hadoop.fs.Path(rows)
            conf = spark.sparkContext._jsc.hadoopConfiguration()
            if not jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, fs, target, False, conf):
                raise OSError(f"could not copy {rows}")
        sums = _sha256(spark, f"{folder}/samples.jsonl")
        if given is not None and [h for _, h in sums] != [h for _, h in given]:
            raise OSError("the copied bytes differ from the source")
        count = spark.read.text(f"{folder}/samples.jsonl").filter(F.trim("value") != "").count()
        if count < 1:
            raise ValueError("a version needs samples")
    except Exception:
        fs.delete(jvm.org.apache.hadoop.fs.Path(folder), True)
        raise
    whole = sums[0][1] if len(sums) == 1 else hashlib.sha256("".join(f"{n}:{h}\n" for n, h in sums).encode()).hexdigest()
    manifest = {"dataset_id": dataset_id, "version": version, "title": title, "description": description, "samples": count, "sha256": whole}
    create_file(spark, f"{folder}/dataset.json", json.dumps(manifest, ensure_ascii=False, indent=2) + "\n")
    return manifest


def reserve_run(spark: SparkSession, folder: str, most: int = 9999) -> str:
    """Make the folder with the smallest free number ``run-NNN`` and return its name. The number belongs to whoever creates the
    folder's ``.reserved`` file, which only one can; a folder that others made without it is taken too."""
    fs, target, jvm = _fs(spark, folder)
    fs.mkdirs(target)
    for k in range(1, most + 1):
        name = f"run-{k:03d}"
        if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")):
            continue
        try:
            create_file(spark, f"{folder}/{name}/.reserved", "")
        except FileExistsError:  # another run was faster
            continue
        return name
    raise ValueError("no free run number")


def create_report(spark: SparkSession, path: str, metadata: str) -> None:
    """Start an evaluation report that must not exist yet: a folder with its ``metadata`` (JSON text) and one row per answer."""
    create_file(spark, f"{path}/metadata.json", metadata)


def append_answers(answers: DataFrame, path: str) -> None:
    """Add answers (checkpoint, question_number, question, answer, generated_tokens, elapsed_seconds) to a report that was started;
    what was added before stays, so an interrupted run keeps its part."""
    fs, target, _ = _fs(answers.sparkSession, f"{path}/metadata.json")
    if not fs.exists(target):
        raise FileNotFoundError(f"no report at {path}")
    answers.write.mode("append").parquet(f"{path}/answers")


def finish_report(spark: SparkSession, path: str, message: str) -> None:
    """Note how a report ended; only once."""
    create_file(spark, f"{path}/outcome.txt", message + "\n")


def report_text(spark: SparkSession, path: str) -> DataFrame:
    """(checkpoint, question_number, block) of a report's answers as Markdown."""
    rows = spark.read.parquet(f"{path}/answers")
    block = answer_block(*(F.col(c) for c in ("checkpoint", "question_number", "question", "answer", "generated_tokens", "elapsed_seconds")))
    return rows.select("checkpoint", "question_number", block.alias("block"))
