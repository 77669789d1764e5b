"""Weights and optimizer state as rows of blocks, updated where they are: the driver sees no tensor.

A row is (tensor, block, w, s1, s2): some consecutive values of a tensor and of what the optimizer keeps about them. Gradient sums are
rows of the same blocks, so an update is a join and a few array expressions. Tasks that need the weights read them
from the stored table, as many bytes for each task as a broadcast would cost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelvec.functions.draws import truncated_normal
from labelvec.plans.network import NetSpec, Tensors, _starts
from labelvec.plans.optimizers import Adagrad, Adam
from labelvec.plans.partials import BLOCK_VALUES, gradient_partials, summed
from labelvec.session import staging_path
from labelvec.sources.files import filesystem_of, qualified

SCHEMA = "tensor string, block bigint, w array<double>, s1 array<double>, s2 array<double>"
# Slots of each optimizer, in the order of the columns s1 and s2.
SLOTS = {Adagrad: ("Adagrad",), Adam: ("Adam", "Adam_1")}


def _blocks(size: int) -> int:
    return -(-size // BLOCK_VALUES)


def _same(values: Column, value: float) -> Column:
    return F.transform(values, lambda _: F.lit(value))


def initial_rows(spark: SparkSession, spec: NetSpec, optimizer: Adagrad | Adam, seed: int = 0) -> DataFrame:
    """First weights and empty slots, drawn by the executors."""
    rows = None
    for k, (name, deviation, value) in enumerate(_starts(spec)):
        size = math.prod(spec.shapes[name])
        first = F.col("id") * BLOCK_VALUES
        cells = F.sequence(first, F.least(first + (BLOCK_VALUES - 1), F.lit(size - 1).cast("bigint")))
        w = _same(cells, value) if deviation is None else _drawn(cells, k, seed, deviation)
        part = spark.range(_blocks(size)).select(F.lit(name).alias("tensor"), F.col("id").alias("block"), w.alias("w"))
        rows = part if rows is None else rows.union(part)
    return with_slots(rows, optimizer)


def _drawn(cells: Column, tensor: int, seed: int, deviation: float) -> Column:
    return F.transform(cells, lambda i: truncated_normal(i, tensor, seed, deviation))


def with_slots(rows: DataFrame, optimizer: Adagrad | Adam) -> DataFrame:
    first = optimizer.start if isinstance(optimizer, Adagrad) else 0.0
    second = F.lit(None).cast("array<double>") if isinstance(optimizer, Adagrad) else _same(F.col("w"), 0.0)
    return rows.select("tensor", "block", "w", _same(F.col("w"), first).alias("s1"), second.alias("s2"))


def rows_of(spark: SparkSession, spec: NetSpec, weights: Tensors, optimizer: Adagrad | Adam) -> DataFrame:
    """Rows of weights that the caller holds, with empty slots."""
    names, blocks, values = [], [], []
    for name in spec.names:
        flat = np.asarray(weights[name], np.float64).ravel()
        for b in range(_blocks(len(flat))):
            names.append(name)
            blocks.append(b)
            values.append(flat[b * BLOCK_VALUES : (b + 1) * BLOCK_VALUES])
    table = pa.table({"tensor": names, "block": pa.array(blocks, pa.int64()), "w": pa.array(values, pa.list_(pa.float64()))})
    return with_slots(spark.createDataFrame(table), optimizer)


class StoredState:
    """A stored table of state rows. ``value`` reads the weights, in whatever process asks for them."""

    def __init__(self, path: str, spec: NetSpec):
        self.path, self.spec = path, spec
        self._weights: Tensors | None = None

    @classmethod
    def store(cls, rows: DataFrame, spec: NetSpec) -> StoredState:
        path = qualified(rows.sparkSession, staging_path(rows.sparkSession, "state"))
        rows.write.parquet(path)
        return cls(path, spec)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(SCHEMA).parquet(self.path)

    def __getstate__(self):
        return {"path": self.path, "spec": self.spec, "_weights": None}

    @property
    def value(self) -> Tensors:
        if self._weights is None:
            filesystem, inner = filesystem_of(self.path)
            table = ds.dataset(inner, filesystem=filesystem, format="parquet").to_table(["tensor", "block", "w"])
            table = table.sort_by([("tensor", "ascending"), ("block", "ascending")])
            parts: dict[str, list[np.ndarray]] = {}
            data = table["w"].combine_chunks()
            for i, name in enumerate(table["tensor"].to_pylist()):
                parts.setdefault(name, []).append(data[i].values.to_numpy())
            self._weights = {n: np.concatenate(parts[n]).reshape(s) for n, s in self.spec.shapes.items()}
        return self._weights


def _adagrad(optimizer: Adagrad, g: Column) -> dict[str, Column]:
    total = F.zip_with("s1", g, lambda a, x: x * x + a)
    change = F.zip_with(g, total, lambda x, a: x / F.sqrt(a))
    return {"w": F.zip_with("w", change, lambda w, c: c * -optimizer.rate + w), "s1": total, "s2": F.col("s2")}


def _adam(optimizer: Adam, g: Column, updates: int) -> dict[str, Column]:
    rate = optimizer.rate * math.sqrt(1.0 - optimizer.beta2**updates) / (1.0 - optimizer.beta1**updates)
    m = F.zip_with("s1", g, lambda m, x: m * optimizer.beta1 + x * (1.0 - optimizer.beta1))
    v = F.zip_with("s2", g, lambda v, x: v * optimizer.beta2 + x * x * (1.0 - optimizer.beta2))
    change = F.zip_with(m, v, lambda m, v: m / (F.sqrt(v) + optimizer.epsilon))
    return {"w": F.zip_with("w", change, lambda w, c: c * -rate + w), "s1": m, "s2": v}


def updated(rows: DataFrame, sums: DataFrame, optimizer: Adagrad | Adam, scale: float, updates: int) -> DataFrame:
    """The rows after one update; ``sums`` (tensor, block, data) are gradient sums, ``updates`` counts this one too."""
    both = rows.join(sums.select("tensor", "block", "data"), ["tensor", "block"])
    # Blocks of another size would be filled up with nulls.
    same = F.when(F.size("data") == F.size("w"), F.col("data")).otherwise(F.raise_error(F.lit("gradient sums of other blocks")).cast("array<double>"))
    g = F.transform(same, lambda x: x * scale) if scale != 1.0 else same
    new = _adagrad(optimizer, g) if isinstance(optimizer, Adagrad) else _adam(optimizer, g, updates)
    return both.select("tensor", "block", *[column.alias(name) for name, column in new.items()])


def step(
    stored: StoredState, samples: DataFrame, optimizer: Adagrad | Adam, updates: int, input_column: str = "image", **options
) -> tuple[StoredState, dict[str, float]]:
    """One update over a whole frame, and its sums ``loss``, ``correct`` and ``rows``: gradients, their sums and the update
    all stay with the executors. ``updates`` counts the updates of the run, this one included."""
    spec = stored.spec
    partials = gradient_partials(samples, spec, stored, input_column, **options).persist()
    try:
        told = partials.where(F.col("tensor").isin("loss", "correct", "rows")).groupBy("tensor").agg(F.sum(F.col("data")[0]), F.max("part"))
        found = {r[0]: (r[1], r[2]) for r in told.collect()}
        if not found:
            raise ValueError("no samples")
        n_parts = max(part for _, part in found.values()) + 1
        scale = 1.0 if spec.kind == "a" else 1.0 / found["rows"][0]
        sums = summed(partials.where(F.col("tensor").isin(*spec.names)), n_parts)
        new = StoredState.store(updated(stored.rows(samples.sparkSession), sums, optimizer, scale, updates), spec)
    finally:
        partials.unpersist()
    return new, {name: value for name, (value, _) in found.items()}


def values_of(rows: DataFrame, optimizer: Adagrad | Adam) -> DataFrame:
    """(tensor, i, value) of weights and slots; a slot has its optimizer's name after that of the tensor."""
    out = None
    for column, slot in zip(("w", "s1", "s2"), ("", *SLOTS[type(optimizer)])):
        name = F.concat("tensor", F.lit(f"/{slot}")) if slot else F.col("tensor")
        part = rows.select(name.alias("tensor"), "block", F.posexplode(column).alias("at", "value"))
        part = part.select("tensor", (F.col("block") * BLOCK_VALUES + F.col("at")).cast("int").alias("i"), "value")
        out = part if out is None else out.union(part)
    return out
