"""Training progress: rolling means, bests, counters, time left and throttled reports, per run in step order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: steps of the rolling mean.
ROLLING = 100


def finite(value: Column) -> Column:
    """The value, or null where it is no finite number."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def loss_series(rows: DataFrame, run: str, step: str, loss: str, tokens: str | None = None, batch_size: int = 1) -> DataFrame:
    """``rows`` with the rolling mean of the last 100 losses, best loss so far, whether it is a new best, and running totals."""
    by = Window.partitionBy(run).orderBy(step)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    value = finite(F.col(loss))
    best = F.min(value).over(before)
    out = rows.withColumns({
        "rolling_loss": F.avg(value).over(by.rowsBetween(1 - ROLLING, 0)),
        "best_loss": F.min(value).over(upto),
        "is_best": F.coalesce(value < best, value.isNotNull() & best.isNull()),
        "samples_seen": F.count(F.lit(1)).over(upto) * batch_size,
    })
    return out.withColumn("tokens_seen", F.sum(tokens).over(upto)) if tokens else out


def eta(elapsed: Column, step: Column, total: Column, resumed_at: Column, least: int = 3) -> Column:
    """Seconds left at the pace since ``resumed_at``, once ``least`` steps are done; null before."""
    done = step - resumed_at
    return F.when((done >= least) & (total >= step), elapsed / done * (total - step))


def interval_losses(rows: DataFrame, run: str, step: str, loss: str, interval: int) -> DataFrame:
    """Mean loss, steps and last step of every ``interval`` steps (counted from 1) of a run."""
    return rows.groupBy(run, F.floor((F.col(step) - 1) / interval).alias("interval_no")).agg(
        F.avg(finite(F.col(loss))).alias("mean_loss"), F.count("*").alias("steps"), F.max(step).alias("last_step")
    )


def weighted_loss(rows: DataFrame, keys: list[str], loss: str, tokens: str) -> DataFrame:
    """Token-weighted mean loss per key; null where there are no tokens."""
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(F.col(loss) * F.col(tokens)), F.sum(tokens)).alias("weighted_loss"), F.sum(tokens).alias("tokens"))


def every_nth(rows: DataFrame, run: str, step: str, every: int) -> DataFrame:
    """The first row of a run and every ``every``-th after it."""
    at = F.row_number().over(Window.partitionBy(run).orderBy(step))
    return rows.withColumn("item", at).filter((F.col("item") - 1) % every == 0)


def throttled(rows: DataFrame, run: str, step: str, seconds: str, every_items: int, every_seconds: float) -> DataFrame:
    """Rows that a throttle lets through: the first of a run, then any that is ``every_items`` rows or ``every_seconds`` after
    the last one let through.

    Rows of a run are scanned in order with the last report as the only state, so a run may be of any length; runs are
    spread over the tasks.
    """
    ordered = rows.repartition(run).sortWithinPartitions(run, step)
    names = ordered.columns
    at_run, at_seconds = names.index(run), names.index(seconds)

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, items, last_items, last_time = object(), 0, 0, 0.0
        for part in parts:
            keep = []
            for r, s in zip(part.column(at_run).to_pylist(), part.column(at_seconds).to_pylist()):
                if r != now:
                    now, items, last_items = r, 0, 0
                items += 1
                due = last_items == 0 or items - last_items >= every_items or (s is not None and s - last_time >= every_seconds)
                if due:
                    last_items, last_time = items, s if s is not None else last_time
                keep.append(due)
            yield part.filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(scan, ordered.schema)


def progress_line(c: dict[str, Column]) -> Column:
    """One line of a progress report with fixed keys."""
    return F.format_string(
        "epoch=%d/%d epoch_progress=%.2f%% step=%d/%d samples_seen=%d tokens_seen=%d train_loss=%.6f rolling_train_loss_100=%.6f lr=%s tokens/sec=%.1f %s",
        *(c[k] for k in ("epoch", "planned_epochs", "epoch_progress", "step", "total", "samples_seen", "tokens_seen", "loss", "rolling", "lr", "speed", "telemetry")),
    )


def is_same_config(a: str, b: str, defaults: dict[str, object]) -> Column:
    """Two configs (struct columns ``a`` and ``b``) agree on every listed field, missing ones taken at their default."""
    same = F.lit(True)
    for name, value in defaults.items():
        same = same & F.coalesce(F.col(f"{a}.{name}"), F.lit(value)).eqNullSafe(F.coalesce(F.col(f"{b}.{name}"), F.lit(value)))
    return same
