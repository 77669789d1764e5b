"""Sums of tensors over all tasks of a job.

A task emits each tensor once, cut into blocks. Partials are added up by executors in
levels of ``FAN_IN``, spread over tensors and blocks, so the driver gets one model's worth of
values whatever the number of tasks; within a group they are added in task order, so a
fixed layout gives a fixed sum. Histograms (``hist:`` tensors) are sparse: the block
number is the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from labelvec.operators.batches import matrix
from labelvec.plans.network import NetSpec, Tensors, batch_sums, dropout_factors

SCHEMA = "part int, tensor string, block bigint, step bigint, data array<double>"
BLOCK_VALUES = 3 << 14  # a multiple of 3, for the triples of reports
FAN_IN = 32
HISTOGRAM = "hist:"


def partial_rows(tensors: Tensors, step: int | None = None) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    for name, tensor in tensors.items():
        if name.startswith(HISTOGRAM):
            blocks, values, size = tensor[:, 0], tensor[:, 1].astype(np.float64), 1
        else:
            values, size = np.ascontiguousarray(tensor, dtype=np.float64).ravel(), BLOCK_VALUES
            blocks = np.arange(-(-len(values) // size))
        for low in range(0, len(blocks), 1024):
            numbers = blocks[low : low + 1024]
            data = values[low * size : (low + len(numbers)) * size]
            edges = np.minimum(np.arange(len(numbers) + 1) * size, len(data))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(numbers), pa.int32()),
                    pa.array([name] * len(numbers)),
                    pa.array(numbers, pa.int64()),
                    pa.array([step] * len(numbers), pa.int64()),
                    pa.ListArray.from_arrays(edges.astype(np.int32), data),
                ],
                names=["part", "tensor", "block", "step", "data"],
            )


def add_into(total: Tensors, sums: Tensors) -> None:
    for name, value in sums.items():
        if name not in total:
            total[name] = value
        elif isinstance(name, str) and name.startswith(HISTOGRAM):
            rows = np.concatenate([total[name], value])
            buckets, which = np.unique(rows[:, 0], return_inverse=True)
            counts = np.bincount(which, rows[:, 1]).astype(np.int64)
            total[name] = np.stack([buckets, counts], axis=1)
        else:
            total[name] = total[name] + value


def _add_rows(table: pa.Table) -> np.ndarray:
    rows = table.sort_by("part").column("data").combine_chunks()
    total = None
    for i in range(len(rows)):
        values = rows[i].values.to_numpy()
        total = values.copy() if total is None else total + values
    return total


def _add_group(table: pa.Table) -> pa.Table:
    total = _add_rows(table)
    first = table.slice(0, 1).to_pydict()
    return pa.table(
        {
            "part": pa.array([first["group"][0]], pa.int32()),
            "tensor": first["tensor"],
            "block": pa.array(first["block"], pa.int64()),
            "step": pa.array([None], pa.int64()),
            "data": pa.ListArray.from_arrays(np.array([0, len(total)], np.int32), total),
        }
    )


def sum_table(rows: pa.Table) -> Tensors:
    """Flat sums by tensor name of partials that already sit on the driver."""
    blocks: dict[str, dict[int, np.ndarray]] = {}
    rows = rows.sort_by([("tensor", "ascending"), ("block", "ascending"), ("part", "ascending")])
    data = rows["data"].combine_chunks()
    for i, (name, block) in enumerate(zip(rows["tensor"].to_pylist(), rows["block"].to_pylist())):
        add_into(blocks.setdefault(name, {}), {block: data[i].values.to_numpy()})
    return {
        name: np.array([(b, v[0]) for b, v in found.items()], np.int64).reshape(-1, 2)
        if name.startswith(HISTOGRAM)
        else np.concatenate(list(found.values()))
        for name, found in blocks.items()
    }


def summed(partials: DataFrame, n_parts: int) -> DataFrame:
    """Sums (tensor, block, data, ...) of what ``n_parts`` tasks emit, as rows."""
    while n_parts > 1:
        partials = (
            partials.withColumn("group", F.floor(F.col("part") / FAN_IN).cast("int"))
            .groupBy("group", "tensor", "block")
            .applyInArrow(_add_group, SCHEMA)
        )
        n_parts = -(-n_parts // FAN_IN)
    return partials


def sum_partials(partials: DataFrame, n_parts: int) -> Tensors:
    """The same sums on the driver, flat by tensor name."""
    return sum_table(summed(partials, n_parts).toArrow())


def gradient_partials(
    df: DataFrame,
    spec: NetSpec,
    weights,
    input_column: str = "image",
    keep_prob: float = 1.0,
    step: int = 0,
    seed: int = 0,
    histograms: bool | str = False,
) -> DataFrame:
    """One set of gradient and metric sums per task. ``weights`` is a broadcast variable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Tensors = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            factors = None
            if keep_prob < 1.0:
                ids = batch.column("sample_id").to_numpy()
                factors = dropout_factors(ids, spec.hidden, step, seed, keep_prob)
            add_into(
                total,
                batch_sums(
                    spec,
                    weights.value,
                    spec.prepare(matrix(batch.column(input_column), spec.inputs)),
                    matrix(batch.column("label"), spec.classes),
                    factors,
                    histograms,
                ),
            )
        yield from partial_rows(total)

    return df.select("sample_id", input_column, "label").mapInArrow(run, SCHEMA)


def dataset_sums(
    df: DataFrame, spec: NetSpec, weights: Tensors, input_column: str = "image", **options
) -> Tensors:
    """Gradient and metric sums over a whole frame."""
    shared = df.sparkSession.sparkContext.broadcast(weights)
    partials = gradient_partials(df, spec, shared, input_column, **options).persist()
    try:
        n_parts = (partials.agg(F.max("part")).first()[0] or 0) + 1
        return sum_partials(partials, n_parts)
    finally:
        partials.unpersist()
        shared.destroy()
