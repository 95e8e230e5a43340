"""Matrix profiles: nearest neighbours of all windows of a series, motifs and discords.

Two forms of the self-join agree. The relational one pairs window arrays in SQL and suits a check; the kernel takes one
series at a time as numpy diagonals, O(T) memory, and scales over (series, window length) groups.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "series string, t long, date date, mp double, nn long"


def exclusion(m: int) -> int:
    return math.ceil(m / 4)


def self_join(series: DataFrame, m: int, x: str = "x") -> DataFrame:
    """(series, t, date, mp, nn) by a join of z-normalised windows; ties go to the smallest neighbour."""
    w = W.partitionBy("series").orderBy("t").rowsBetween(0, m - 1)
    win = series.select("series", "t", "date", F.collect_list(F.col(x)).over(w).alias("w"), F.avg(x).over(w).alias("mu"), F.stddev_pop(x).over(w).alias("sd")).filter(F.size("w") == m)
    z = win.select("series", "t", "date", F.transform("w", lambda v: (v - F.col("mu")) / F.col("sd")).alias("z"))
    other = z.select("series", F.col("t").alias("u"), F.col("z").alias("v"))
    pairs = z.join(other, "series").filter(F.abs(F.col("t") - F.col("u")) > exclusion(m))
    rho = F.aggregate(F.zip_with("z", "v", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p) / m
    d = F.sqrt(2.0 * m * (1.0 - F.greatest(F.least(rho, F.lit(1.0)), F.lit(-1.0))))
    return pairs.select("series", "t", "date", F.struct(d.alias("d"), "u").alias("n")).groupBy("series", "t", "date").agg(F.min("n").alias("n")).select("series", "t", "date", F.col("n.d").alias("mp"), F.col("n.u").alias("nn"))


def profile_array(x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and neighbours of all length-m windows of ``x``.

    A window with a missing value is at infinity with neighbour -1; two constant windows are at 0, one at sqrt(m).
    """
    n = len(x) - m + 1
    if n < 1:
        return np.zeros(0), np.zeros(0, np.int64)
    ok = np.isfinite(x)
    clean = np.where(ok, x, 0.0)
    clean = clean - clean[ok].mean() if ok.any() else clean
    win = np.lib.stride_tricks.sliding_window_view(clean, m)
    whole = np.lib.stride_tricks.sliding_window_view(ok, m).all(1)
    mu, sd = win.mean(1), win.std(1)
    flat = sd < 1e-12
    best, near = np.full(n, np.inf), np.full(n, -1, np.int64)
    scale = np.where(flat, 1.0, sd)
    for lag in range(exclusion(m) + 1, n):
        a, b = np.arange(n - lag), np.arange(lag, n)
        products = np.concatenate([[0.0], np.cumsum(clean[: len(x) - lag] * clean[lag:])])
        rho = ((products[m:] - products[:-m]) / m - mu[a] * mu[b]) / (scale[a] * scale[b])
        d = np.sqrt(2 * m * (1 - np.clip(rho, -1, 1)))
        d = np.where(flat[a] | flat[b], np.where(flat[a] & flat[b], 0.0, math.sqrt(m)), d)
        d = np.where(whole[a] & whole[b], d, np.inf)
        for own, other in ((a, b), (b, a)):
            closer = (d < best[own]) | ((d == best[own]) & (other < near[own]) & np.isfinite(d))
            best[own[closer]], near[own[closer]] = d[closer], other[closer]
    return best, near


def matrix_profile(series: DataFrame, m: int, x: str = "x") -> DataFrame:
    """(series, t, date, mp, nn) by the kernel, one Arrow group per series; series shorter than 2m give no rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        if len(pdf) < 2 * m:
            return pdf.iloc[:0].assign(mp=0.0, nn=0)[["series", "t", "date", "mp", "nn"]]
        mp, nn = profile_array(pdf["x"].to_numpy(float), m)
        return pdf.iloc[: len(mp)][["series", "t", "date"]].assign(mp=mp, nn=nn)

    return series.select("series", "t", "date", F.col(x).alias("x")).groupBy("series").applyInPandas(run, SCHEMA)


def top_windows(profile: DataFrame, k: int, zone: int, largest: bool = False, key: str = "series") -> DataFrame:
    """(key, rank, t, date, mp, nn): k windows in turn, each the best outside ``zone`` of those before it.

    Best is smallest, or largest with ``largest``; ties go to the earliest. The k rounds are unrolled in one plan.
    """
    rest = profile.filter(F.col("mp").isNotNull() & ~F.isnan("mp") & (F.abs("mp") != float("inf")))
    found = None
    sign = -1.0 if largest else 1.0
    for rank in range(1, k + 1):
        best = rest.groupBy(key).agg(F.min(F.struct((sign * F.col("mp")).alias("o"), "t", "date", "mp", "nn")).alias("b"))
        row = best.select(key, F.lit(rank).alias("rank"), "b.t", "b.date", "b.mp", "b.nn")
        found = row if found is None else found.unionByName(row)
        if rank < k:
            taken = best.select(key, F.col("b.t").alias("__t"))
            rest = rest.join(taken, key).filter(F.abs(F.col("t") - F.col("__t")) > zone).drop("__t")
    return found


def greedy_windows(mp: np.ndarray, k: int, zone: int, largest: bool = False) -> list[int]:
    """Rows of k values in turn, each the best more than ``zone`` rows from those before it; ties go to the first."""
    left = np.where(np.isfinite(mp), -mp if largest else mp, np.inf).astype(float)
    out: list[int] = []
    while len(out) < k and np.isfinite(left).any():
        i = int(np.argmin(left))
        out.append(i)
        left[max(0, i - zone) : i + zone + 1] = np.inf
    return out


def best_windows(profile: DataFrame, k: int, zone: int, largest: bool = False, key: str = "series") -> DataFrame:
    """The rows of ``top_windows``, by one Arrow group per series: a profile is computed once, not once a round."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        at = greedy_windows(pdf["mp"].to_numpy(float), k, zone, largest)
        return pdf.iloc[at].assign(rank=range(1, len(at) + 1))[[key, "rank", "t", "date", "mp", "nn"]]

    return profile.select(key, "t", "date", "mp", "nn").groupBy(key).applyInPandas(run, f"{key} string, rank int, t long, date date, mp double, nn long")


def motif_groups(x: np.ndarray, m: int, most: int = 3, matches: int = 10) -> list[tuple[int, int, int, float, float]]:
    """(rank, start, neighbour, distance to itself, distance to the neighbour) of motif groups.

    A candidate is the smallest profile value left, if not above max(mean - 2 deviations, min); its matches are all
    windows within max(mean - 2 deviations, min) of its distance profile, greedily, ``matches`` at most; the zone
    around every match is then closed. The neighbour is the second match, or -1.
    """
    profile, _ = profile_array(x, m)
    left, zone, out = profile.copy(), exclusion(m), []
    finite = profile[np.isfinite(profile)]
    if not len(finite):
        return out
    cut = max(finite.mean() - 2 * finite.std(), finite.min())
    win = np.lib.stride_tricks.sliding_window_view(x, m)
    sd = win.std(1)
    z = (win - win.mean(1, keepdims=True)) / np.where(sd > 1e-12, sd, 1.0)[:, None]
    for rank in range(1, most + 1):
        i = int(np.argmin(left))
        if not left[i] <= cut + 1e-12:
            break
        d = np.sqrt(np.maximum(((z - z[i]) ** 2).sum(1), 0.0))
        d[~np.isfinite(profile)] = np.inf
        d[i] = 0.0
        known = d[np.isfinite(d)]
        within = max(known.mean() - 2 * known.std(), known.min())
        free, chosen = d.copy(), []
        while len(chosen) < matches:
            j = int(np.argmin(free))
            if not free[j] <= within + 1e-12:
                break
            chosen.append((j, float(d[j])))
            free[max(0, j - zone) : j + zone + 1] = np.inf
        for j, _ in chosen:
            left[max(0, j - zone) : j + zone + 1] = np.inf
        near = chosen[1] if len(chosen) > 1 else (-1, float("nan"))
        out.append((rank, i, near[0], chosen[0][1], near[1]))
    return out


def motifs(series: DataFrame, m: int, most: int = 3, x: str = "x") -> DataFrame:
    """Motif groups of every series, with the distance to the neighbour beside that to itself."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        rows = motif_groups(pdf["x"].to_numpy(float), m, most) if len(pdf) >= 2 * m else []
        out = pd.DataFrame(rows, columns=["rank", "start", "nn", "distance", "nn_distance"])
        out.insert(0, "series", pdf["series"].iloc[0])
        return out.astype({"rank": "int64", "start": "int64", "nn": "int64", "distance": float, "nn_distance": float})

    return series.select("series", "t", F.col(x).alias("x")).groupBy("series").applyInPandas(run, "series string, rank long, start long, nn long, distance double, nn_distance double")
