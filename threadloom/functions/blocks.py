"""Bounded blocks of rows for Arrow-backed operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa


def in_blocks(batches: Iterator[pa.RecordBatch], rows: int, key: str | None = None) -> Iterator[pa.Table]:
    """Join Arrow batches into tables of about ``rows`` rows.

    Rows of one ``key`` value that are next to each other stay in one table, so a table may be longer by one such run.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held)
            cut = table.num_rows
            if key is not None:
                values = table.column(key).to_numpy(zero_copy_only=False)
                cut = int((values != values[-1]).nonzero()[0].max(initial=-1)) + 1
                if cut == 0:  # one run only: wait for its end
                    continue
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches() if cut < table.num_rows else []
            count = sum(b.num_rows for b in held)
    if count:
        yield pa.Table.from_batches(held)


def arrow_blocks(fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], rows: int, key: str | None = None):
    """A ``mapInArrow`` function that gives ``fn`` tables of about ``rows`` rows (see ``in_blocks``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_blocks(batches, rows, key):
            yield from fn(table)

    return run
