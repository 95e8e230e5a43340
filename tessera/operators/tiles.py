"""The matrix profile of series too long for one task: tiles of the join matrix as tasks, minima merged by window and side.

A series is cut into blocks of ``tile`` windows. Each pair of blocks of a series is a tile; a block's values are dealt to
every tile in its row and column, so that a tile's task holds two stretches of tile + m - 1 values, however long the
series. Inside, dot products run along the diagonals: each row of the tile follows from the row above. A tile gives, for
its earlier windows, the best neighbour to the right and, for its later ones, the best to the left. What meets
afterwards is one candidate per window, side and tile, reduced before it is shuffled.

A series of n windows makes n^2 / (2 tile^2) tiles and shuffles n^2 / tile values.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.profile import exclusion

TILE = 4096
SIDES = ("left", "right")


def windows_of(values: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Centred values, and each window's mean, deviation (1 for constant ones) and kind: 0 usual, 1 constant, 2 incomplete."""
    known = np.isfinite(values)
    clean = np.where(known, values, 0.0)
    clean = clean - (clean[known].mean() if known.any() else 0.0) * known
    view = np.lib.stride_tricks.sliding_window_view
    win = view(clean, m)
    mean, dev = win.mean(1), win.std(1)
    kind = np.where(~view(known, m).all(1), 2, np.where(dev < 1e-12, 1, 0))
    return clean, mean, np.where(kind == 0, dev, 1.0), kind


def tile_minima(rows: np.ndarray, cols: np.ndarray, m: int, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best distance and place among ``cols``' windows for each of ``rows``', and the reverse.

    The first column window is ``gap`` places after the first row window; only pairs with the column's window more than
    the exclusion zone later count. Ties go to the smallest place; without a pair the distance is infinite, the place -1.
    """
    a, mean_a, dev_a, kind_a = windows_of(rows, m)
    b, mean_b, dev_b, kind_b = windows_of(cols, m)
    n, k = len(mean_a), len(mean_b)
    usual_b, flat_b, whole_b = kind_b == 0, kind_b == 1, kind_b < 2
    best_a, near_a = np.full(n, np.inf), np.full(n, -1, np.int64)
    best_b, near_b = np.full(k, np.inf), np.full(k, -1, np.int64)
    dots = np.correlate(b, a[:m], "valid")
    head = np.correlate(a, b[:m], "valid")
    for i in range(n):
        if i:  # along the diagonal: one product leaves, one enters
            dots[1:] = dots[:-1] - a[i - 1] * b[: k - 1] + a[i + m - 1] * b[m : m + k - 1]
            dots[0] = head[i]
        first = max(0, i - gap + exclusion(m) + 1)
        if first >= k or kind_a[i] == 2:
            continue
        if kind_a[i] == 0:
            rho = (dots[first:] / m - mean_a[i] * mean_b[first:]) / (dev_a[i] * dev_b[first:])
            d = np.sqrt(2 * m * (1 - np.clip(rho, -1, 1)))
            d = np.where(usual_b[first:], d, math.sqrt(m))
        else:
            d = np.where(flat_b[first:], 0.0, math.sqrt(m))
        d = np.where(whole_b[first:], d, np.inf)
        j = int(d.argmin())
        if np.isfinite(d[j]):
            best_a[i], near_a[i] = d[j], first + j
        closer = d < best_b[first:]
        best_b[first:][closer] = d[closer]
        near_b[first:][closer] = i
    return best_a, near_a, best_b, near_b


def tiled_profile(series: DataFrame, m: int, x: str = "x", tile: int = TILE) -> DataFrame:
    """(series, t, date, mp, nn, left_mp, left_nn, right_mp, right_nn): the profile and its parts to either side of a window.

    ``t`` numbers the rows of a series from 0; a place without a row, a null and a NaN are missing values, and a window
    with one is at infinity with neighbour -1, as are the sides of windows that have none there. Series whose last place
    is below 2m - 1 give no rows. Ties go to the smallest neighbour. A repeated (series, t) keeps its largest value.
    """
    rows = series.select("series", "t", "date", F.col(x).cast("double").alias("x"))
    size = rows.groupBy("series").agg((F.max("t") + 1).alias("size")).filter(F.col("size") >= 2 * m)
    reach = math.ceil((m - 1) / tile)
    block = F.floor(F.col("t") / tile)
    # A value is part of its own block's stretch and of those before it whose last windows reach over it.
    dealt = rows.join(size, "series").withColumn("block", F.explode(F.sequence(F.greatest(block - reach, F.lit(0)), block)))
    dealt = dealt.filter(F.col("t") < (F.col("block") + 1) * tile + m - 1).withColumn("last", F.floor((F.col("size") - m) / tile)).filter(F.col("block") <= F.col("last"))
    stretches = dealt.groupBy("series", "block", "last").agg(F.collect_list(F.struct("t", "x")).alias("values"))
    own = F.struct(F.col("block").alias("row"), F.col("block").alias("col"))
    right = F.transform(F.filter(F.sequence(F.lit(0), F.col("last")), lambda c: c > F.col("block")), lambda c: F.struct(F.col("block").alias("row"), c.alias("col")))
    below = F.transform(F.filter(F.sequence(F.lit(0), F.col("last")), lambda r: r < F.col("block")), lambda r: F.struct(r.alias("row"), F.col("block").alias("col")))
    tiles = stretches.select("series", "block", "values", F.inline(F.concat(F.array(own), right, below)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row, col = int(pdf["row"].iloc[0]), int(pdf["col"].iloc[0])
        parts = {}
        for block, values in zip(pdf["block"], pdf["values"], strict=True):
            t = np.array([v["t"] for v in values], np.int64) - block * tile
            x = np.array([np.nan if v["x"] is None else v["x"] for v in values], float)
            order = np.argsort(x, kind="stable")  # a repeated place keeps its largest value, NaN only if all are
            order = np.concatenate([order[np.isnan(x[order])], order[~np.isnan(x[order])]])
            stretch = np.full(int(t.max()) + 1, np.nan)
            stretch[t[order]] = x[order]
            parts[block] = stretch
        a, b = parts.get(row), parts.get(col)
        found = []
        if a is not None and b is not None and len(a) >= m and len(b) >= m:
            best_a, near_a, best_b, near_b = tile_minima(a, b, m, (col - row) * tile)
            for side, base, other, best, near in (("right", row, col, best_a, near_a), ("left", col, row, best_b, near_b)):
                at = np.flatnonzero(near >= 0)
                found.append(pd.DataFrame({"t": at + base * tile, "side": side, "d": best[at], "u": near[at] + other * tile}))
        out = pd.concat(found) if found else pd.DataFrame({"t": [], "side": [], "d": [], "u": []})
        out.insert(0, "series", pdf["series"].iloc[0])
        return out.astype({"t": "int64", "side": str, "d": float, "u": "int64"})

    candidates = tiles.groupBy("series", "row", "col").applyInPandas(run, "series string, t long, side string, d double, u long")
    near = F.struct("d", "u")
    best = candidates.groupBy("series", "t").agg(F.min(near).alias("both"), *[F.min(F.when(F.col("side") == s, near)).alias(s) for s in SIDES])
    windows = rows.join(size, "series").filter(F.col("t") <= F.col("size") - m).groupBy("series", "t").agg(F.min("date").alias("date"))
    far, none = F.lit(float("inf")), F.lit(-1).cast("long")
    named = [(c, p) for c, p in (("both", ""), ("left", "left_"), ("right", "right_"))]
    columns = [col for c, p in named for col in (F.coalesce(f"{c}.d", far).alias(f"{p}mp"), F.coalesce(f"{c}.u", none).alias(f"{p}nn"))]
    return windows.join(best, ["series", "t"], "left").select("series", "t", "date", *columns)
