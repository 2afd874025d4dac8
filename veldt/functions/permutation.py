"""Keyed permutations of 0 .. n - 1 as a column: each place is computed where it is needed, and nobody holds a list."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: With 6, successors in permutations of 8 places are measurably uneven; with 10 they are not.
ROUNDS = 10
#: Odd constants of a 64-bit mixer in two multiplications. Fixed values.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def places(n: int, seed: int, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the permutation of each ``key`` puts each ``at``. A number is a pair of digits below a and b, a * b being
    just n or more; rounds add a hash of one digit to the other, and what falls beyond n goes through the rounds again."""
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    salt = _mixed(key.astype(np.uint64) + _mixed(np.array([seed & (2**64 - 1)], np.uint64)))
    out, todo = at.astype(np.int64), np.arange(len(at))
    while len(todo):
        lo, hi = np.divmod(out[todo], b)[::-1]
        for r in range(ROUNDS):
            hashed = _mixed((hi if r % 2 else lo).astype(np.uint64) + salt[todo] + np.uint64(r << 56))
            if r % 2:
                lo = (lo + (hashed % np.uint64(b)).astype(np.int64)) % b
            else:
                hi = (hi + (hashed % np.uint64(a)).astype(np.int64)) % a
        out[todo] = hi * b + lo
        todo = todo[out[todo] >= n]
    return out


def permuted(n: int, seed: int, key: Column, at: Column) -> Column:
    """``places`` as a column of longs, for a key and an ``at`` that aren't null."""

    @F.pandas_udf("long")
    def run(key: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series(places(n, seed, key.to_numpy(np.int64), at.to_numpy(np.int64)))

    return run(key, at)
