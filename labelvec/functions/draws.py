"""Random numbers as column expressions of their place: no state, so any task draws the same ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

# A prime modulus, one multiplier per input, and one between the two rounds of the hash.
PRIME = 2147483647
CELL, TENSOR, SEED, AGAIN = 48271, 69621, 39373, 16807
# Probability below -2 deviations of a normal variable; draws are cut at two deviations.
TAIL = 0.022750131948179207
# Fixed coefficients of the rational approximations of the inverse normal distribution (algorithm AS 241, Wichura 1988),
# by rising powers: around the median, and nearer to the tails.
MIDDLE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
     45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
     21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
OUTER = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
     1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
     0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9),
)


def _fifth(x):
    square = x * x % PRIME
    return square * square % PRIME * x % PRIME


def _drawn(cell, tensor: int, seed: int):
    """A number below the prime for each cell; different cells of a tensor below the prime give different numbers."""
    start = (tensor * TENSOR + seed % PRIME * SEED) % PRIME
    return _fifth((_fifth((cell % PRIME * CELL + start) % PRIME) * AGAIN + start) % PRIME)


def _polynomial(coefficients, x):
    total = coefficients[-1]
    for c in coefficients[-2::-1]:
        total = total * x + c
    return total


def _ratio(pair, x):
    return _polynomial(pair[0], x) / _polynomial(pair[1], x)


def uniform(cell: Column, tensor: int, seed: int) -> Column:
    """Between 0 and 1, without the ends."""
    return (_drawn(cell.cast("bigint"), tensor, seed) + 0.5) / float(PRIME)


def truncated_normal(cell: Column, tensor: int, seed: int, deviation: float) -> Column:
    """Normal draws within two deviations: uniform numbers between the tails, through the inverse distribution."""

    def inverse(p: Column) -> Column:
        q = p - 0.5
        middle = q * _ratio(MIDDLE, F.lit(0.180625) - q * q)
        root = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p))) - 1.6
        outer = F.signum(q) * _ratio(OUTER, root)
        return F.when(F.abs(q) <= 0.425, middle).otherwise(outer) * deviation

    p = uniform(cell, tensor, seed) * (1.0 - 2.0 * TAIL) + TAIL
    return F.element_at(F.transform(F.array(p), inverse), 1)


def truncated_normals(cells: np.ndarray, tensor: int, seed: int, deviation: float) -> np.ndarray:
    """The same values as the expression."""
    p = (_drawn(np.asarray(cells, np.int64), tensor, seed) + 0.5) / float(PRIME) * (1.0 - 2.0 * TAIL) + TAIL
    q = p - 0.5
    root = np.sqrt(-np.log(np.minimum(p, 1.0 - p))) - 1.6
    return np.where(np.abs(q) <= 0.425, q * _ratio(MIDDLE, 0.180625 - q * q), np.sign(q) * _ratio(OUTER, root)) * deviation
