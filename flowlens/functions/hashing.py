"""Repeatable pseudo-randomness: every draw is a function of (seed, row key), never of partitioning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1


def row_hash(seed: int, *parts: Column) -> Column:
    """Hex md5 of ``seed:part:part…``; sorting by it is a random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the hash."""
    return F.conv(F.substring(row_hash(seed, *parts), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_bucket(hashed: Column) -> Column:
    """The first 16 bits of a hex hash: 65,536 even buckets that keep the hash order."""
    return F.substring(hashed, 1, 4)


def coefficients(hashed: Column) -> list[Column]:
    """Four numbers below 2^31-1, one from each quarter of a hex md5.

    They are the coefficients of a cubic over the prime field, whose values at 1, 2, 3… are
    four-wise independent draws for this row.
    """
    return [(F.conv(F.substring(hashed, 1 + 8 * i, 8), 16, 10).cast("bigint") % PRIME) for i in range(4)]


def draw(coefs: list[Column], point: Column) -> Column:
    """The cubic with ``coefs`` at ``point`` modulo the prime."""
    x = point.cast("bigint")
    acc = coefs[3]
    for coef in (coefs[2], coefs[1], coefs[0]):
        acc = (acc * x + coef) % PRIME
    return acc


def draws(coefs: np.ndarray, points: np.ndarray) -> np.ndarray:
    """``draw`` for many rows and points at once, inside a task. Modulo the prime 2^31 - 1, v mod p folds to (v & p) + (v >> 31).

    Points stay below 2^20, so that no product passes 64 bits before it is folded.
    """
    c, x, prime = coefs.astype(np.uint64), points.astype(np.uint64)[None, :], np.uint64(PRIME)
    acc = c[:, 3:4] * x
    high = np.empty_like(acc)
    for i in (2, 1, 0):
        if i < 2:
            acc *= x
        acc += c[:, i:i + 1]
        np.right_shift(acc, np.uint64(31), out=high)
        acc &= prime
        acc += high
    acc[acc >= prime] -= prime
    return acc.astype(np.uint32)
