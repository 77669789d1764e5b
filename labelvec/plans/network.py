"""The two classifiers: shapes, initial weights, and the math on one block of rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from labelvec.functions.draws import truncated_normal, truncated_normals
from labelvec.functions.vectors import (
    DROPOUT_PRIME,
    DROPOUT_SAMPLE,
    DROPOUT_SEED,
    DROPOUT_STEP,
    DROPOUT_UNIT,
    log_buckets,
)
from labelvec.session import MAX_MODEL_BYTES

Tensors = dict[str, np.ndarray]

# Fixed names of the saved tensors: hidden weights and biases, output weights and biases.
NAMES = {
    "a": ("hid_w", "hid_b", "sm_w", "sm_b"),
    "b": ("layer1/weights", "layer1/biases", "layer2/weights", "layer2/biases"),
}
# Width of the histogram buckets of activations.
HIST_WIDTH = 0.5


@dataclass(frozen=True)
class NetSpec:
    """``kind`` "a": clipped softmax loss, summed. ``kind`` "b": logit loss, averaged, dropout.

    A row's input vector enters as ``v / divisor``, then ``2x - 1`` when ``centered``.
    """

    kind: str = "a"
    inputs: int = 784
    hidden: int = 128
    classes: int = 10
    divisor: float = 255.0
    centered: bool = False

    def __post_init__(self):
        if self.kind not in NAMES:
            raise ValueError(f"unknown model kind {self.kind!r}")
        values = (self.inputs + 1) * self.hidden + (self.hidden + 1) * self.classes
        if values * 8 > MAX_MODEL_BYTES:
            raise ValueError(f"{values * 8} bytes of weights exceed {MAX_MODEL_BYTES}")

    @property
    def names(self) -> tuple[str, str, str, str]:
        return NAMES[self.kind]

    @property
    def shapes(self) -> dict[str, tuple[int, ...]]:
        sizes = (
            (self.inputs, self.hidden),
            (self.hidden,),
            (self.hidden, self.classes),
            (self.classes,),
        )
        return dict(zip(self.names, sizes))

    def prepare(self, block: np.ndarray) -> np.ndarray:
        x = block.astype(np.float64)
        if self.divisor != 1.0:
            x /= self.divisor
        if self.centered:
            x *= 2.0
            x -= 1.0
        return x


def spec_a(**changes) -> NetSpec:
    return NetSpec(**{"kind": "a", "hidden": 128, **changes})


def spec_b(**changes) -> NetSpec:
    return NetSpec(**{"kind": "b", "hidden": 500, **changes})


def _starts(spec: NetSpec) -> list[tuple[str, float | None, float]]:
    """(tensor, deviation of its draws or None, value otherwise) in the order of the tensors."""
    if spec.kind == "a":
        # The first deviation is one over the image side.
        deviations, bias = (1.0 / math.sqrt(spec.inputs), 1.0 / math.sqrt(spec.hidden)), 0.0
    else:
        deviations, bias = (0.1, 0.1), 0.1
    w1, b1, w2, b2 = spec.names
    return [(w1, deviations[0], 0.0), (b1, None, bias), (w2, deviations[1], 0.0), (b2, None, bias)]


def initial_weights(spec: NetSpec, seed: int = 0) -> Tensors:
    """Normal draws within two deviations, and constant biases; a formula of (seed, tensor, cell)."""
    new = {}
    for k, (name, deviation, value) in enumerate(_starts(spec)):
        shape = spec.shapes[name]
        cells = np.arange(math.prod(shape))
        flat = np.full(len(cells), value) if deviation is None else truncated_normals(cells, k, seed, deviation)
        new[name] = flat.reshape(shape)
    return new


def initial_values(spark: SparkSession, spec: NetSpec, seed: int = 0) -> DataFrame:
    """(tensor, i, value): the same weights, drawn by the executors."""
    rows = None
    for k, (name, deviation, value) in enumerate(_starts(spec)):
        cell = F.col("id")
        drawn = F.lit(value) if deviation is None else truncated_normal(cell, k, seed, deviation)
        part = spark.range(math.prod(spec.shapes[name])).select(F.lit(name).alias("tensor"), cell.alias("i"), drawn.alias("value"))
        rows = part if rows is None else rows.union(part)
    return rows


def dropout_factors(
    sample_ids: np.ndarray, units: int, step: np.ndarray | int, seed: int, keep_prob: float
) -> np.ndarray:
    """The same values as the column expression of this name's counterpart."""
    p = DROPOUT_PRIME
    base = (
        sample_ids.astype(np.int64) % p * DROPOUT_SAMPLE
        + np.asarray(step, np.int64) % p * DROPOUT_STEP
        + seed % p * DROPOUT_SEED
    )
    mixed = (base[:, None] + np.arange(units, dtype=np.int64) * DROPOUT_UNIT) % p
    square = mixed * mixed % p
    drawn = square * square % p * mixed % p
    return np.where(drawn < keep_prob * p, 1.0 / keep_prob, 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def layers(
    spec: NetSpec, weights: Tensors, x: np.ndarray, factors: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pre-activations, hidden outputs after dropout, logits)."""
    w1, b1, w2, b2 = (weights[n] for n in spec.names)
    pre = x @ w1 + b1
    hidden = np.maximum(pre, 0.0)
    if factors is not None:
        hidden = hidden * factors
    return pre, hidden, hidden @ w2 + b2


def outputs(spec: NetSpec, logits: np.ndarray) -> np.ndarray:
    return softmax(logits) if spec.kind == "a" else logits


def row_losses(spec: NetSpec, logits: np.ndarray, y: np.ndarray) -> np.ndarray:
    if spec.kind == "a":
        return -(y * np.log(np.maximum(np.minimum(softmax(logits), 1.0), 1e-10))).sum(axis=1)
    top = logits.max(axis=1, keepdims=True)
    lse = np.log(np.exp(logits - top).sum(axis=1, keepdims=True)) + top
    return (y * (lse - logits)).sum(axis=1)


def _logit_gradient(spec: NetSpec, logits: np.ndarray, y: np.ndarray) -> np.ndarray:
    probs = softmax(logits)
    if spec.kind == "b":
        return probs * y.sum(axis=1, keepdims=True) - y
    # Clipping passes no gradient where it is active, so the shortcut probs - y
    # holds only down to the lower clip.
    low = np.minimum(probs, 1.0)
    g = -y / np.maximum(low, 1e-10)
    g = np.where((low >= 1e-10) & (probs <= 1.0), g, 0.0)
    return (g - (g * probs).sum(axis=1, keepdims=True)) * probs


def bucket_counts(values: np.ndarray, width: float | None = HIST_WIDTH) -> np.ndarray:
    """(bucket, count) rows of all fixed-width buckets that hold a value, however far from 0; logarithmic ones without a width."""
    buckets = log_buckets(values.ravel()) if width is None else np.floor(values.ravel() / width).astype(np.int64)
    index, counts = np.unique(buckets, return_counts=True)
    return np.stack([index, counts], axis=1)


def hist_width(histograms: bool | str, width: float) -> float | None:
    """``True`` asks for buckets of equal width, ``"log"`` for logarithmic ones."""
    return None if histograms == "log" else width


def activation_counts(pre: np.ndarray, logits: np.ndarray, width: float | None = HIST_WIDTH) -> Tensors:
    """Bucket counts of both layers before and after activation; the second layer's is the identity."""
    last = bucket_counts(logits, width)
    return {
        "hist:layer1/pre_activations": bucket_counts(pre, width),
        "hist:layer1/activations": bucket_counts(np.maximum(pre, 0.0), width),
        "hist:layer2/pre_activations": last,
        "hist:layer2/activations": last,
    }


def batch_sums(
    spec: NetSpec,
    weights: Tensors,
    x: np.ndarray,
    y: np.ndarray,
    factors: np.ndarray | None = None,
    histograms: bool | str = False,
) -> Tensors:
    """Gradient sums and metric sums of a block. All values add up across blocks."""
    w1, b1, w2, b2 = spec.names
    pre, hidden, logits = layers(spec, weights, x, factors)
    dz = _logit_gradient(spec, logits, y)
    dh = dz @ weights[w2].T
    if factors is not None:
        dh = dh * factors
    dh = dh * (pre > 0)
    sums = {
        w1: x.T @ dh,
        b1: dh.sum(axis=0),
        w2: hidden.T @ dz,
        b2: dz.sum(axis=0),
        **metric_sums(spec, logits, y),
    }
    if histograms:
        sums |= activation_counts(pre, logits, hist_width(histograms, HIST_WIDTH))
    return sums


def metric_sums(spec: NetSpec, logits: np.ndarray, y: np.ndarray) -> Tensors:
    correct = logits.argmax(axis=1) == y.argmax(axis=1)
    return {
        "loss": np.array([row_losses(spec, logits, y).sum()]),
        "correct": np.array([float(correct.sum())]),
        "rows": np.array([float(len(y))]),
    }


def tensor_stats(spec: NetSpec, weights: Tensors) -> np.ndarray:
    """Mean, population deviation, maximum and minimum of each tensor, in one row each."""
    tensors = [weights[name] for name in spec.names]
    return np.array([[w.mean(), w.std(), w.max(), w.min()] for w in tensors])


def gradient(spec: NetSpec, sums: Tensors) -> Tensors:
    """Gradient of the batch loss: a sum for kind a, a mean for kind b."""
    scale = 1.0 if spec.kind == "a" else 1.0 / max(float(sums["rows"][0]), 1.0)
    return {name: sums[name].reshape(spec.shapes[name]) * scale for name in spec.names}


def batch_metrics(spec: NetSpec, sums: Tensors) -> dict[str, float]:
    rows = float(sums["rows"][0])
    loss, accuracy = float(sums["loss"][0]), float(sums["correct"][0]) / rows
    if spec.kind == "a":
        return {"loss": loss, "acc": accuracy}
    return {"cross_entropy": loss / rows, "accuracy": accuracy}
