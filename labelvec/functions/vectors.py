"""Column expressions over vectors; all of them run inside the JVM."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

# Fixed values of the dropout hash: a prime modulus and one multiplier per input.
DROPOUT_PRIME = 2147483647
DROPOUT_SAMPLE = 48271
DROPOUT_UNIT = 69621
DROPOUT_STEP = 16807
DROPOUT_SEED = 39373
# Relative error of a logarithmic bucket, and what keeps the buckets of small numbers positive.
LOG_ERROR = 0.05
LOG_OFFSET = 1 << 20


def _required(value: Column, ok: Column, message: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(message))


def flatten_image(image: Column, channels: bool = False) -> Column:
    """h x w (x c) nested arrays to one vector."""
    flat = F.flatten(image)
    return F.flatten(flat) if channels else flat


def reshape_image(image: Column, height: int, width: int, channels: int | None = None) -> Column:
    """One vector to h x w, or h x w x c when ``channels`` is given."""
    stride = width * (channels or 1)

    def row(r: Column) -> Column:
        cells = F.slice(image, r * stride + 1, stride)
        if channels is None:
            return cells
        return F.transform(
            F.sequence(F.lit(0), F.lit(width - 1)),
            lambda x: F.slice(cells, x * channels + 1, channels),
        )

    return _required(
        F.transform(F.sequence(F.lit(0), F.lit(height - 1)), row),
        F.size(image) == height * stride,
        F.concat(F.lit(f"cannot reshape to {height}x{width}, length "), F.size(image)),
    )


def to_csv_line(vector: Column) -> Column:
    return F.array_join(vector.cast("array<string>"), ",", "")


def from_csv_line(line: Column, element: str = "double", allow_empty: bool = True) -> Column:
    """Text line to a vector; a bad or empty field is an error in every ANSI mode."""

    def field(text: Column) -> Column:
        bad = F.raise_error(F.concat(F.lit(f"not a {element} field: '"), text, F.lit("'")))
        return F.coalesce(text.try_cast(element), bad.cast(element))

    values = F.transform(F.split(line, ","), field)
    if allow_empty:
        return F.when(line == "", F.array().cast(f"array<{element}>")).otherwise(values)
    return values


def combined_line(label: Column, vector: Column) -> Column:
    """``label|v0,v1,...`` with a scalar label."""
    return F.concat_ws("|", label.cast("string"), to_csv_line(vector))


def split_combined_line(line: Column) -> tuple[Column, Column]:
    """Inverse of :func:`combined_line`: class index and vector of ints."""
    head = F.split_part(line, F.lit("|"), F.lit(1))
    tail = F.split_part(line, F.lit("|"), F.lit(2))
    bad = F.raise_error(F.concat(F.lit("not a label|vector line: "), line)).cast("int")
    label = F.when(F.contains(line, F.lit("|")), head.try_cast("int"))
    return F.coalesce(label, bad), from_csv_line(tail, "int")


def normalize(image: Column, divisor: float = 255.0) -> Column:
    return F.transform(image, lambda p: p.cast("double") / F.lit(divisor))


def quantize(vector: Column) -> Column:
    """Values in [-1, 1] to pixels 0..255."""
    return F.transform(
        vector,
        lambda v: F.floor(
            F.least(F.greatest((v.cast("double") + 1.0) * 127.5, F.lit(0.0)), F.lit(255.0))
        ).cast("int"),
    )


def uint8(vector: Column) -> Column:
    """Truncate to whole numbers that must fit an unsigned byte."""

    def byte(v: Column) -> Column:
        whole = v.cast("int")
        return _required(
            whole, whole.between(0, 255), F.concat(F.lit("outside 0..255: "), v.cast("string"))
        )

    return F.transform(vector, byte)


def one_hot(label: Column, classes: int = 10) -> Column:
    return _required(
        F.transform(
            F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == label).cast("double")
        ),
        label.between(0, classes - 1),
        F.concat(F.lit("class outside range: "), label.cast("string")),
    )


def argmax(vector: Column) -> Column:
    """Index of the first maximum."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def clip_unit(value: Column, low: float = 1e-10) -> Column:
    """Minimum with 1 first, then maximum with ``low``."""
    return F.greatest(F.least(value, F.lit(1.0)), F.lit(low))


def prediction_line(label: Column, prediction: Column, at: Column | None = None) -> Column:
    """``Label: l, Prediction: p``, after an ISO time when ``at`` is given."""
    text = F.format_string("Label: %d, Prediction: %d", label, prediction)
    if at is None:
        return text
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(" "), text)


def histogram_bucket(value: Column, low: float, width: float) -> Column:
    return F.floor((value - F.lit(low)) / F.lit(width)).cast("bigint")


def _log_base(error: float) -> float:
    if not 0.0 < error < 1.0:
        raise ValueError(f"a relative error lies between 0 and 1, not at {error}")
    return math.log((1.0 + error) / (1.0 - error))


def log_bucket(value: Column, error: float = LOG_ERROR) -> Column:
    """Bucket of any finite number: 0 for zero, else its sign times a whole number that grows with the logarithm.

    ``log_bucket_value`` is off by the relative ``error`` at most, and doubles of either sign have
    a bounded number of buckets, however they are spread.
    """
    place = F.ceil(F.log(F.abs(value)) / F.lit(_log_base(error))) + LOG_OFFSET
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("int") * place).cast("bigint")


def log_bucket_value(bucket: Column, error: float = LOG_ERROR) -> Column:
    """The number that stands for all of a bucket."""
    power = (F.abs(bucket) - LOG_OFFSET) * _log_base(error)
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket.cast("double")) * F.exp(power) * (1.0 - error))


def log_buckets(values: np.ndarray, error: float = LOG_ERROR) -> np.ndarray:
    """The same buckets as the expression."""
    size = np.abs(values)
    place = np.ceil(np.log(np.where(size > 0, size, 1.0)) / _log_base(error)) + LOG_OFFSET
    return (np.sign(values) * np.where(size > 0, place, 0.0)).astype(np.int64)


def dropout_mask(
    sample_id: Column, units: int, step: Column, seed: int, keep_prob: float
) -> Column:
    """Inverted-dropout factors, one per unit: 0, or 1/keep_prob.

    A hash of ids instead of ``rand()``: a retried task draws the same mask. An
    affine mix of the inputs is raised to the fifth power modulo a prime, which
    permutes the residues.
    """
    p = F.lit(DROPOUT_PRIME).cast("bigint")
    base = (
        sample_id % p * F.lit(DROPOUT_SAMPLE)
        + step.cast("bigint") % p * F.lit(DROPOUT_STEP)
        + F.lit(seed % DROPOUT_PRIME).cast("bigint") * F.lit(DROPOUT_SEED)
    )

    def factor(unit: Column) -> Column:
        mixed = (base + unit * F.lit(DROPOUT_UNIT)) % p
        square = mixed * mixed % p
        drawn = square * square % p * mixed % p
        return F.when(drawn < F.lit(keep_prob) * p, F.lit(1.0 / keep_prob)).otherwise(F.lit(0.0))

    return F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit(units - 1).cast("bigint")), factor
    )
