"""Statistics over all pairs of a series in n log n: inversions, the median slope, the median distance.

Pairs are counted, never listed: how many slopes lie below a value is how many pairs a shear by that value turns round,
which is a count of inversions. A value between two counts is narrowed until few pairs are left, and these are listed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Pairs that are listed once narrowing has left no more, in rows of the series; fewer would be narrowed longer.
LISTED = 8


def ranks_of(x: np.ndarray) -> np.ndarray:
    """Places of the values among the distinct ones."""
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


def _levels(ranks: np.ndarray):
    """For each bit of the ranks, from the top: places in groups of equal higher bits, the bit, and ones before in the group."""
    order = np.arange(len(ranks))
    for bit in reversed(range(max(int(ranks.max(initial=0)).bit_length(), 1))):
        high = ranks[order] >> (bit + 1)
        ones = (ranks[order] >> bit) & 1
        start = np.flatnonzero(np.concatenate([[True], high[1:] != high[:-1]])) if len(order) else np.zeros(0, np.int64)
        total = np.cumsum(ones) - ones
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
        yield order, start[group], ones, total - total[start][group] if len(order) else total
        order = order[np.argsort(ranks[order] >> bit, kind="stable")]


def inversions(ranks: np.ndarray) -> int:
    """Pairs i < j with ranks[i] > ranks[j]: those that first differ in a bit, the one before the zero."""
    return int(sum(before[ones == 0].sum() for _, _, ones, before in _levels(ranks)))


def listed_inversions(ranks: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of inversions, all of them if there are no more than ``most``."""
    left, right, room = [], [], most
    for order, start, ones, before in _levels(ranks):
        at_one = np.flatnonzero(ones)
        zeros = np.flatnonzero((ones == 0) & (before > 0))
        many = before[zeros]
        fits = int(np.searchsorted(np.cumsum(many), room, "right"))
        if fits < len(zeros):
            zeros, many = zeros[: fits + 1], many[: fits + 1].copy()
            many[-1] = min(many[-1], room - many[:-1].sum())
        seen = np.cumsum(ones) - ones  # ones before, over all groups
        first = seen[start[zeros]]
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        left.append(order[at_one[np.repeat(first, many) + within]])
        right.append(order[np.repeat(zeros, many)])
        room -= int(many.sum())
        if room <= 0:
            break
    return np.concatenate(left), np.concatenate(right)


def kendall_score(x: np.ndarray) -> int:
    """Rising less falling pairs."""
    n, counts = len(x), np.unique(x, return_counts=True)[1].astype(np.int64)
    tied = int((counts * (counts - 1) // 2).sum())
    return n * (n - 1) // 2 - tied - 2 * inversions(ranks_of(x))


def selected(wanted: list[int], low: float, high: float, at_low: int, at_high: int, below: Callable[[float], int], between: Callable[[float, float], np.ndarray], most: int, least: float | None = None) -> list[float]:
    """The values of ranks ``wanted`` (ascending, from 0) in (low, high], which holds ranks at_low to at_high - 1.

    ``below`` counts the values up to one, ``between`` lists those of a range, ``most`` of them at least if there are more.
    """
    least = (high - low) * 2.0**-45 if least is None else least
    while at_high - at_low > most and high - low > least:  # more in a narrower range are equal, but for rounding
        v = low + (high - low) / 2
        n = below(v)
        if n <= wanted[0]:
            low, at_low = v, n
        elif n > wanted[-1]:
            high, at_high = v, n
        else:
            under, over = [r for r in wanted if r < n], [r for r in wanted if r >= n]
            return selected(under, low, v, at_low, n, below, between, most, least) + selected(over, v, high, n, at_high, below, between, most, least)
    found = np.sort(between(low, high))
    if not len(found):
        return [low + (high - low) / 2] * len(wanted)
    return [float(found[min(max(r - at_low, 0), len(found) - 1)]) for r in wanted]


def median_slope(x: np.ndarray) -> float:
    """The median of (x[j] - x[i]) / (j - i) over all i < j; the mean of the middle two where pairs are even in number.

    Slopes up to v are the pairs that shearing by v ties or turns round. Every slope is a mean of steps between
    neighbours, which bounds the search.
    """
    n, place = len(x), np.arange(len(x))
    steps = np.diff(x)
    room = max(float(np.abs(steps).max()), 1e-300)
    low, high = float(steps.min()) - 0.37 * room, float(steps.max()) + 0.41 * room

    def sheared(v: float) -> tuple[np.ndarray, np.ndarray]:
        """Places in the order of the sheared values, ties backwards, and each one's rank in it."""
        order = np.lexsort((-place, x - v * place))
        rank = np.empty(n, np.int64)
        rank[order] = place
        return order, rank

    def below(v: float) -> int:
        return inversions(sheared(v)[1])

    def between(a: float, b: float) -> np.ndarray:
        first = sheared(a)[0]
        i, j = listed_inversions(sheared(b)[1][first], LISTED * n + 1)
        i, j = first[i], first[j]
        return (x[j] - x[i]) / (j - i)

    total = n * (n - 1) // 2
    ranks = sorted({(total - 1) // 2, total // 2})
    got = selected(ranks, low, high, 0, total, below, between, LISTED * n)
    return (got[0] + got[-1]) / 2


def median_square(x: np.ndarray) -> float:
    """The median of (x[i] - x[j])^2 over all pairs; the mean of the middle two where pairs are even in number."""
    s, n = np.sort(x), len(x)
    total = n * (n - 1) // 2
    if not total:
        return 0.0
    place = np.arange(n)

    def upto(d: float) -> np.ndarray:
        """For each value, the end of those not more than d above it."""
        return np.searchsorted(s, s + d, "right") if d >= 0 else place + 1

    def below(d: float) -> int:
        return int((upto(d) - place - 1).sum())

    def between(a: float, b: float) -> np.ndarray:
        start, end = upto(a), upto(b)
        many = np.maximum(end - start, 0)
        many = np.minimum(many, np.maximum(LISTED * n + 1 - (np.cumsum(many) - many), 0))
        other = np.repeat(start, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return s[other] - np.repeat(s, many)

    room = max(float(s[-1] - s[0]), 1e-300)
    got = selected(sorted({(total - 1) // 2, total // 2}), -0.37 * room, 1.41 * room, 0, total, below, between, LISTED * n)
    return (got[0] ** 2 + got[-1] ** 2) / 2
