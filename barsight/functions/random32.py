"""A seeded 32-bit generator whose draws are closed forms of their number.

The generator's state moves by a constant, so draw k of a seed is the mixed value of seed + (k + 1) * STEP: any row computes its own
draw, without the ones before. Once as columns, once as numpy; both give the same doubles in [0, 1).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published mixer (mulberry32): the state's step and the mask of 32 bits.
STEP, MASK = 0x6D2B79F5, 0xFFFFFFFF


def _product(a: Column, b: Column) -> Column:
    """a * b modulo 2^32 of values below 2^32, in parts that stay below 2^63."""
    high = F.shiftright(a, 16) * b
    return ((a.bitwiseAND(0xFFFF) * b) + F.shiftleft(high.bitwiseAND(0xFFFF), 16)).bitwiseAND(MASK)


def draw(seed: int, k: Column) -> Column:
    """Draw number k, from 0."""
    s = ((k.cast("bigint").bitwiseAND(MASK) + 1).bitwiseAND(MASK) * STEP + (seed & MASK)).bitwiseAND(MASK)
    t = _product(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(F.lit(1).cast("bigint")))
    t = (t + _product(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61).cast("bigint")))).bitwiseAND(MASK).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(4294967296.0)


def draws(seed: int, k: np.ndarray) -> np.ndarray:
    """The same for an array of numbers."""
    with np.errstate(over="ignore"):
        s = (np.asarray(k, np.uint64) + np.uint64(1)) * np.uint64(STEP) + np.uint64(seed & MASK)
        s = s.astype(np.uint32)
        t = (s ^ (s >> np.uint32(15))) * (s | np.uint32(1))
        t = (t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61))) ^ t
    return (t ^ (t >> np.uint32(14))) / 4294967296.0
