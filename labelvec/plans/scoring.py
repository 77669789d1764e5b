"""Forward pass over a frame: one narrow stage, weights broadcast."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from labelvec.functions import argmax
from labelvec.operators.batches import apply_batches, list_column, matrix
from labelvec.plans.network import (
    HIST_WIDTH,
    NetSpec,
    Tensors,
    activation_counts,
    layers,
    outputs,
)


def forward(
    df: DataFrame,
    spec: NetSpec,
    weights: Tensors,
    input_column: str = "image",
    keep: tuple[str, ...] = ("sample_id",),
) -> DataFrame:
    """``keep`` columns, then ``output`` (probabilities or logits) and ``prediction``."""
    df = df.select(*keep, input_column)
    shared = df.sparkSession.sparkContext.broadcast({n: weights[n] for n in spec.names})

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = spec.prepare(matrix(batch.column(input_column), spec.inputs))
        _, _, logits = layers(spec, shared.value, x)
        out = outputs(spec, logits)
        return pa.RecordBatch.from_arrays(
            [
                *[batch.column(name) for name in keep],
                list_column(out),
                pa.array(out.argmax(axis=1).astype(np.int32)),
            ],
            names=[*keep, "output", "prediction"],
        )

    schema = T.StructType(
        [
            *[df.schema[name] for name in keep],
            T.StructField("output", T.ArrayType(T.DoubleType())),
            T.StructField("prediction", T.IntegerType()),
        ]
    )
    return apply_batches(df, score, schema)


def predict(
    samples: DataFrame, spec: NetSpec, weights: Tensors, input_column: str = "image"
) -> DataFrame:
    """(sample_id, label, prediction) for samples with one-hot labels; no dropout."""
    classes = samples.withColumn("label", argmax(F.col("label")))
    scored = forward(classes, spec, weights, input_column, keep=("sample_id", "label"))
    return scored.select("sample_id", "label", "prediction")


def activation_histogram(
    df: DataFrame, spec: NetSpec, weights: Tensors, input_column: str = "image", width: float | None = HIST_WIDTH
) -> DataFrame:
    """(tensor, bucket, n) of pre-activations and activations over all rows.

    Each batch is counted where it is scored, so the shuffle carries buckets and
    not one row per sample and unit.
    """
    df = df.select(input_column)
    shared = df.sparkSession.sparkContext.broadcast({n: weights[n] for n in spec.names})

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = spec.prepare(matrix(batch.column(input_column), spec.inputs))
        pre, _, logits = layers(spec, shared.value, x)
        found = activation_counts(pre, logits, width)
        rows = np.concatenate(list(found.values()))
        names = [name.removeprefix("hist:") for name, counts in found.items() for _ in counts]
        return pa.RecordBatch.from_pydict({"tensor": names, "bucket": rows[:, 0], "n": rows[:, 1]})

    partial = apply_batches(df, count, "tensor string, bucket bigint, n bigint")
    return partial.groupBy("tensor", "bucket").agg(F.sum("n").alias("n"))
