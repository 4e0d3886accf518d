"""Streams of progress and of generated text: stateful throttles, snapshots and change-only text events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.sinks.files import swap_in
from threadloom.stages import Stage

_EVENT = "type string, text string, detail string"


def throttled_stream(stream: DataFrame, run: str, step: str, seconds: str, every_items: int, every_seconds: float) -> DataFrame:
    """The streaming twin of ``operators.progress.throttled``: (run, step, seconds) of the reports that are let through.

    State per run: rows seen, and rows and time at the last report. Rows of a run within a micro-batch are taken in step order.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        items, last_items, last_time = state.get if state.exists else (0, 0, 0.0)
        rows = pd.concat(list(parts)).sort_values(step)
        kept = []
        for at, second in zip(rows[step], rows[seconds]):
            items += 1
            if last_items == 0 or items - last_items >= every_items or second - last_time >= every_seconds:
                last_items, last_time = items, float(second)
                kept.append((key[0], int(at), float(second)))
        state.update((items, last_items, last_time))
        yield pd.DataFrame(kept, columns=["run", "step", "seconds"])

    return stream.select(run, step, seconds).groupBy(run).applyInPandasWithState(
        update, "run string, step long, seconds double", "items long, last_items long, last_time double", "append", "NoTimeout"
    )


def snapshot_sink(stream: DataFrame, path: str, checkpoint: str, run: str, step: str, every: str = "1 second"):
    """Keep the newest row of every run at ``path``, rewritten at most once per ``every``."""

    def save(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            known = batch.unionByName(spark.read.schema(batch.schema).parquet(path))
        except AnalysisException:  # nothing written yet
            known = batch
        newest = Stage(known.groupBy(run).agg(F.max_by(F.struct(*batch.columns), step).alias("r")).select("r.*"), "snapshot")
        newest.df.write.mode("overwrite").parquet(path + ".part")
        swap_in(spark, path + ".part", path)
        newest.drop()

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Events of NDJSON files as they arrive: (path, type, text, detail); lines that are no JSON have a null type."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", _EVENT).alias("e")).select("path", "e.*")


def changed_texts(events: DataFrame, stream: str, at: str) -> DataFrame:
    """Text events that differ from the text event before them in the same stream."""
    before = F.lag("text").over(Window.partitionBy(stream).orderBy(at))
    return events.filter("type = 'text'").withColumn("_before", before).filter(~F.col("text").eqNullSafe(F.col("_before"))).drop("_before")


def stream_outcome(events: DataFrame, stream: str, at: str) -> DataFrame:
    """(stream, text, outcome) of each event stream: the last text and ``done``, ``error`` or, without either, ``cut_off``."""
    return events.groupBy(stream).agg(
        F.max_by(F.when(F.col("type") == "text", F.col("text")), F.when(F.col("type") == "text", F.col(at))).alias("text"),
        F.when(F.max(F.col("type") == "error"), "error").when(F.max(F.col("type") == "done"), "done").otherwise("cut_off").alias("outcome"),
    )
