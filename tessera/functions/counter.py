"""Random draws as a function of what is drawn: (key, draw, place) gives the same number in Spark, numpy and SQL.

A number is taken through rounds of x -> (x + constant)^5 modulo a prime, a permutation of the residues (5 has no factor
in common with the prime less one), first with key and draw, then with the place added. Products of two residues fit
in 64 bits, so integer arithmetic is exact everywhere. No state is carried: any task can make any draw.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
#: Step between draws, and the rounds' constants.
STRIDE, ROUNDS = 40_692_017, (104_729, 1_299_709, 15_485_863)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def key_of(*names: str) -> Column:
    """A number below 2^28 from the text of some columns."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *names)), 1, 7), 16, 10).cast("long")


def _mixed(x: Column) -> Column:
    def one(x: Column, c: Column) -> Column:
        return let((x + c) % PRIME, lambda v: let(v * v % PRIME, lambda w: (w * w % PRIME) * v % PRIME))

    return F.aggregate(F.array(*[F.lit(c).cast("long") for c in ROUNDS]), x.cast("long"), one)


def drawn(key: Column, draw: Column, place: Column, n: Column) -> Column:
    """A number from 0 to n - 1 for a draw's place; ``n`` below 2^31."""
    first = _mixed((key + draw.cast("long") * STRIDE) % PRIME)
    return F.floor(let(_mixed((first + place.cast("long")) % PRIME), lambda x: F.call_function("div", x * n, F.lit(PRIME))))


def drawn_array(key: int, draws: np.ndarray, places: np.ndarray, n: int | None = None) -> np.ndarray:
    """The same for all pairs of draws (rows) and places (columns); without ``n`` the residues themselves."""

    def mixed(x: np.ndarray) -> np.ndarray:
        for c in ROUNDS:
            v = (x + np.uint64(c)) % np.uint64(PRIME)
            w = v * v % np.uint64(PRIME)
            x = (w * w % np.uint64(PRIME)) * v % np.uint64(PRIME)
        return x

    first = mixed((np.uint64(key) + draws.astype(np.uint64) * np.uint64(STRIDE)) % np.uint64(PRIME))
    x = mixed((first[:, None] + places.astype(np.uint64)[None, :]) % np.uint64(PRIME))
    return (x if n is None else x * np.uint64(n) // np.uint64(PRIME)).astype(np.int64)
