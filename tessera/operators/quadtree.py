"""An adaptive quadtree over points: cells by their codes, splits by counts, polygons clipped to cells.

A place is coded by interleaving the bits of its column and row at the finest level, so a cell is a run of codes. Points
are counted by finest cell, the counts are rolled up to all levels, and only cells above the capacity come to the
driver: at most ``most_cells`` a level, however many points there are. The tree is these splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Halvings of each side down to the finest cells.
LEVELS = 12
SIDE = 1 << LEVELS
#: Masks of the steps that spread bits apart. Fixed values.
SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


@dataclass(frozen=True)
class Area:
    low_x: float
    low_y: float
    high_x: float
    high_y: float

    def step(self) -> tuple[float, float]:
        """Width and height of a finest cell."""
        return max(self.high_x - self.low_x, 1e-300) / SIDE, max(self.high_y - self.low_y, 1e-300) / SIDE

    def cell(self, level: int, prefix: int) -> tuple[float, float, float, float]:
        """Bounds of a cell, wider by more than rounding can move a point over an edge."""
        x = sum((prefix >> (2 * i) & 1) << i for i in range(level))
        y = sum((prefix >> (2 * i + 1) & 1) << i for i in range(level))
        size = 1 << (LEVELS - level)
        (w, h), room = self.step(), 1e-6
        return self.low_x + (x * size - room) * w, self.low_y + (y * size - room) * h, self.low_x + ((x + 1) * size + room) * w, self.low_y + ((y + 1) * size + room) * h


def code(area: Area, x: Column, y: Column) -> Column:
    """The finest cell of a point of the area."""

    def spread(v: Column) -> Column:
        for shift, mask in SPREAD:
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    w, h = area.step()
    column, row = (F.least(F.greatest(F.floor((v - low) / step), F.lit(0)), F.lit(SIDE - 1)).cast("long") for v, low, step in ((x, area.low_x, w), (y, area.low_y, h)))
    return spread(column).bitwiseOR(F.shiftleft(spread(row), 1))


@dataclass(frozen=True)
class Tree:
    """Split cells as (level, prefix), and the leaves by their first finest code."""

    split: frozenset[tuple[int, int]]
    starts: tuple[int, ...]

    @classmethod
    def of(cls, split: set[tuple[int, int]]) -> Tree:
        starts, stack = [], [(0, 0)]
        while stack:
            level, prefix = stack.pop()
            if (level, prefix) in split and level < LEVELS:
                stack += [(level + 1, 4 * prefix + i) for i in range(4)]
            else:
                starts.append(prefix << 2 * (LEVELS - level))
        return cls(frozenset(split), tuple(sorted(starts)))


def grown(codes: DataFrame, capacity: int, most_cells: int) -> Tree:
    """The tree whose leaves hold at most ``capacity`` of the points (code), or a ``most_cells``-th of them if that is more."""
    counts = codes.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    every = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))
    prefix = F.call_function("shiftright", F.col("code"), (2 * (F.lit(LEVELS) - F.col("level"))).cast("int"))
    nodes = counts.select("code", "n", every.alias("level")).groupBy("level", prefix.alias("prefix")).agg(F.sum("n").alias("n"))
    total = codes.agg(F.count(F.lit(1)).alias("n")).scalar()
    crowded = nodes.filter((F.col("n") > capacity) & (F.col("n") > total / most_cells))
    return Tree.of({(r.level, r.prefix) for r in crowded.select("level", "prefix").collect()})  # bounded, see above


def with_leaf(points: DataFrame, tree: Tree, code: str, name: str, spare: str = "__starts") -> DataFrame:
    """Adds ``name``, the number of the leaf that holds a finest cell, by halving steps over the leaves' first codes."""
    starts = points.sparkSession.createDataFrame(pd.DataFrame({"start": np.array(tree.starts, np.int64)})).agg(F.sort_array(F.collect_list("start"))).scalar()
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(tree.starts).bit_length()))])
    at = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(F.col(spare), n + step - 1) <= F.col(code), n + step).otherwise(n)) - 1
    return points.withColumn(spare, starts).withColumn(name, at).drop(spare)


# --- polygons -----------------------------------------------------------------------------------------


def _meets(e: np.ndarray, cell: tuple[float, float, float, float]) -> np.ndarray:
    """Which edges (ax, ay, bx, by) have a point in the cell: their boxes meet, and its corners lie on both sides."""
    x0, y0, x1, y1 = cell
    near = (np.minimum(e[:, 0], e[:, 2]) <= x1) & (np.maximum(e[:, 0], e[:, 2]) >= x0) & (np.minimum(e[:, 1], e[:, 3]) <= y1) & (np.maximum(e[:, 1], e[:, 3]) >= y0)
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    sides = np.array([dx * (y - e[:, 1]) - dy * (x - e[:, 0]) for x in (x0, x1) for y in (y0, y1)])
    return near & (sides.min(0) <= 0) & (sides.max(0) >= 0)


def _odd(e: np.ndarray, x: float, y: float) -> bool:
    """Even-odd rule for a point on no edge."""
    over = e[(e[:, 1] > y) != (e[:, 3] > y)]
    return bool((x < (over[:, 2] - over[:, 0]) * (y - over[:, 1]) / (over[:, 3] - over[:, 1]) + over[:, 0]).sum() % 2)


def cells_of(edges: np.ndarray, area: Area, tree: Tree) -> Iterator[tuple[int, bool, np.ndarray]]:
    """(leaf, wholly inside, edges that matter) of a polygon, from the root down.

    A cell keeps the edges of its rows that aren't wholly to its left: those that a ray to the right can meet.
    """
    starts, stack = np.array(tree.starts), [(0, 0, edges)]
    while stack:
        level, prefix, e = stack.pop()
        cell = area.cell(level, prefix)
        e = e[(np.maximum(e[:, 1], e[:, 3]) >= cell[1]) & (np.minimum(e[:, 1], e[:, 3]) <= cell[3]) & (np.maximum(e[:, 0], e[:, 2]) >= cell[0])]
        first = prefix << 2 * (LEVELS - level)
        if not _meets(e, cell).any():
            if _odd(e, (cell[0] + cell[2]) / 2, (cell[1] + cell[3]) / 2):
                end = np.searchsorted(starts, (prefix + 1) << 2 * (LEVELS - level))
                for at in range(int(np.searchsorted(starts, first)), int(end)):
                    yield at, True, e[:0]
        elif (level, prefix) in tree.split and level < LEVELS:
            stack += [(level + 1, 4 * prefix + i, e) for i in range(4)]
        else:
            yield int(np.searchsorted(starts, first)), False, e


def clipped(parts: Iterator[pd.DataFrame], area: Area, tree: Tree) -> Iterator[pd.DataFrame]:
    """(polygon, cell, whole, edges) of the polygons (polygon, rings) of each part."""
    for part in parts:
        for polygon, rings in zip(part["polygon"], part["rings"], strict=True):
            points = [np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2) for ring in (rings if rings is not None else [])]
            edges = np.concatenate([np.zeros((0, 4)), *[np.hstack([p, np.roll(p, -1, 0)]) for p in points if len(p)]])
            rows = [(polygon, cell, whole, [dict(zip(("ax", "ay", "bx", "by"), map(float, x), strict=True)) for x in e]) for cell, whole, e in cells_of(edges, area, tree)] if len(edges) else []
            yield pd.DataFrame(rows, columns=["polygon", "cell", "whole", "edges"])
