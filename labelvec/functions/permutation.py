"""A keyed bijection of 0..n-1 as a column expression: the order of an epoch, without a sort.

The numbers are laid out as an ``a`` by ``b`` grid with ``a * b >= n``. Rounds of a Feistel network add a hash of one
coordinate, the epoch and the seed to the other one, which permutes the grid. Fewer than ``a`` places of the grid are beyond n;
a number that lands on one walks on along the same bijection until it is back inside. The longest such walk is
found beforehand, from those places alone, so the expression holds just as many steps.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

# Fixed values of the round hash: a prime modulus and one multiplier per input.
PRIME = 2147483647
PLACE, ROUND, EPOCH, SEED = 48271, 69621, 16807, 39373
ROUNDS = 6
# A grid coordinate has to stay below the prime.
MAX_ROWS = 1 << 61


def grid(n: int) -> tuple[int, int]:
    """(rows, columns) of the smallest grid of this form that holds ``n`` places."""
    if not 0 < n <= MAX_ROWS:
        raise ValueError(f"cannot permute {n} numbers")
    rows = math.isqrt(n - 1) + 1
    return rows, -(-n // rows)


def round_key(k: int, seed: int, epoch):
    """Works on numbers and on columns."""
    return epoch % PRIME * EPOCH + (seed % PRIME * SEED + (k + 1) * ROUND) % PRIME


def _fifth(mixed):
    square = mixed * mixed % PRIME
    return square * square % PRIME * mixed % PRIME


def _step(x: np.ndarray, n: int, seed: int, epoch: int) -> np.ndarray:
    rows, columns = grid(n)
    left, right = x // columns, x % columns
    for k in range(ROUNDS):
        key = round_key(k, seed, epoch)
        if k % 2:
            right = (right + _fifth((left % PRIME * PLACE + key) % PRIME)) % columns
        else:
            left = (left + _fifth((right % PRIME * PLACE + key) % PRIME)) % rows
    return left * columns + right


def shuffled(ids: np.ndarray, n: int, seed: int, epoch: int) -> np.ndarray:
    """The same values as :func:`shuffled_position`."""
    x = _step(np.asarray(ids, np.int64), n, seed, epoch)
    while (outside := x >= n).any():
        x[outside] = _step(x[outside], n, seed, epoch)
    return x


def longest_walk(n: int, seed: int, epoch: int) -> int:
    """Steps, after the first one, until no number is on a place beyond ``n``.

    Places that are left when none gets back inside form cycles out there, which no number enters.
    """
    rows, columns = grid(n)
    x, walk = np.arange(n, rows * columns, dtype=np.int64), 0
    while len(x):
        on = _step(x, n, seed, epoch)
        on = on[on >= n]
        if len(on) == len(x):
            break
        x, walk = on, walk + 1
    return walk


def shuffled_position(ids: Column, n: int, seed: int, epoch: int | Column, epochs: int | None = None) -> Column:
    """Place of every id 0..n-1 in the order of an epoch; each place is taken once.

    ``epoch`` is a number, or a column with values below ``epochs``.
    """
    rows, columns = grid(n)
    if isinstance(epoch, Column):
        if epochs is None:
            raise ValueError("say how many epochs the column may name")
        walk = max((longest_walk(n, seed, e) for e in range(epochs)), default=0)
        epoch = epoch.cast("bigint")
    else:
        walk = longest_walk(n, seed, epoch)
    keys = F.array(*[
        F.struct((F.lit(key) if isinstance(key, int) else key).cast("bigint").alias("key"), F.lit(bool(k % 2)).alias("odd"))
        for k in range(ROUNDS)
        for key in [round_key(k, seed, epoch)]
    ])

    def turn(at: Column, key: Column) -> Column:
        seen = F.when(key["odd"], at["left"]).otherwise(at["right"])
        spread = (seen % PRIME * F.lit(PLACE) + key["key"]) % PRIME
        square = spread * spread % PRIME
        drawn = square * square % PRIME * spread % PRIME
        return F.struct(
            F.when(key["odd"], at["left"]).otherwise((at["left"] + drawn) % rows).alias("left"),
            F.when(key["odd"], (at["right"] + drawn) % columns).otherwise(at["right"]).alias("right"),
        )

    def step(x: Column) -> Column:
        start = F.struct(F.call_function("div", x, F.lit(columns)).alias("left"), (x % columns).alias("right"))
        return F.aggregate(keys, start, turn, lambda at: at["left"] * F.lit(columns).cast("bigint") + at["right"])

    place = step(ids.cast("bigint"))
    if not walk:
        return place
    return F.aggregate(F.sequence(F.lit(1), F.lit(walk)), place, lambda x, _: F.when(x < n, x).otherwise(step(x)))
