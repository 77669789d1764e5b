"""User functions over record batches of a chosen size, and array columns as matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """List column as a rows x width matrix; every list must have the same length."""
    if column.null_count:
        raise ValueError("null vector")
    rows = len(column)
    values = column.flatten()
    if values.null_count:
        raise ValueError("null element in a vector")
    lengths = np.diff(column.offsets.to_numpy())
    if width is None:
        width = int(lengths[0]) if rows else 0
    if not (lengths == width).all():
        raise ValueError(f"vectors of length {sorted(set(lengths.tolist()))[:5]}, expected {width}")
    return values.to_numpy(zero_copy_only=False).reshape(rows, width)


def list_column(block: np.ndarray) -> pa.ListArray:
    rows, width = block.shape
    offsets = np.arange(0, (rows + 1) * width, max(width, 1), dtype=np.int32)[: rows + 1]
    return pa.ListArray.from_arrays(offsets, np.ascontiguousarray(block).ravel())


def rebatch(
    batches: Iterator[pa.RecordBatch], size: int
) -> Iterator[pa.RecordBatch]:
    """Batches of exactly ``size`` rows, then the rest; empty ones are dropped."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        while batch.num_rows:
            head = batch.slice(0, size - rows)
            held.append(head)
            rows += head.num_rows
            batch = batch.slice(head.num_rows)
            if rows == size:
                yield pa.concat_batches(held)
                held, rows = [], 0
    if rows:
        yield pa.concat_batches(held)


def apply_batches(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: StructType | str,
    batch_size: int | None = None,
) -> DataFrame:
    """Run ``fn`` on every batch of a partition; without a size, batches stay as they arrive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sized = rebatch(batches, batch_size) if batch_size else batches
        for batch in sized:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def mini_batches(
    batches: Iterator[pa.RecordBatch], batch_size: int, group: str
) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(group, batch number, rows) of every mini-batch; rows arrive in the order of ``group`` and ``position``."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        numbers = batch.column("position").to_numpy() // batch_size
        groups = batch.column(group).to_numpy()
        edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(groups) != 0)) + 1
        for low, high in zip([0, *edges], [*edges, len(numbers)]):
            key = int(groups[low]), int(numbers[low])
            if held and key != current:
                yield *current, pa.concat_batches(held)
                held = []
            current = key
            held.append(batch.slice(low, high - low))
    if held:
        yield *current, pa.concat_batches(held)
