"""Helpers for functions that run over Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc


def bounded(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 4 << 20,
            max_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``max_rows`` rows and, but for a single longer value, ``max_bytes``
    bytes in ``column``: what a task holds at once doesn't follow the batch size of the session."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and (total + size > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)


def record_batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
