"""Per-row losses. Class counts are small, so the sums are written out and stay in codegen."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, functions as F

from labelvec.functions.vectors import clip_unit


def _sum(columns: list[Column]) -> Column:
    return functools.reduce(operator.add, columns)


def clipped_cross_entropy(label: Column, probs: Column, classes: int = 10) -> Column:
    """Sum over classes of ``-label * log(clip(prob))``."""
    return -_sum([label[k] * F.log(clip_unit(probs[k])) for k in range(classes)])


def _log_sum_exp(logits: Column, classes: int) -> Column:
    top = F.greatest(*[logits[k] for k in range(classes)])
    return F.log(_sum([F.exp(logits[k] - top) for k in range(classes)])) + top


def logit_cross_entropy(label: Column, logits: Column, classes: int = 10) -> Column:
    """Softmax cross-entropy straight from logits, in the overflow-safe form."""
    lse = _log_sum_exp(logits, classes)
    return _sum([label[k] * (lse - logits[k]) for k in range(classes)])


def softmax(logits: Column) -> Column:
    """Probabilities from logits. Name the result before using it more than once."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, z: acc + F.exp(z - top))
    return F.transform(logits, lambda z: F.exp(z - top) / total)
