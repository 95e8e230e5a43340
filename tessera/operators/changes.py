"""Change points: greedy splits by squared error, and exact penalised segmentation with a Gaussian kernel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import pairs

#: Years counted as climate extremes.
EXTREME_YEARS = (*range(2001, 2005), *range(2009, 2012), *range(2014, 2022))
LEAST_ROWS = 24


def binary_segmentation(x: np.ndarray, breaks: int = 3, least: int = 3) -> list[int]:
    """Last rows of the left parts of the ``breaks`` best splits by squared error, in order."""
    s1, s2 = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(x * x)])

    def cost(a, b):
        return s2[b] - s2[a] - (s1[b] - s1[a]) ** 2 / (b - a)

    parts, found = [(0, len(x))], []
    for _ in range(breaks):
        best = None
        for a, b in parts:
            cut = np.arange(a + least, b - least + 1)
            if len(cut):
                gain = cost(a, b) - cost(a, cut) - cost(cut, b)
                i = int(gain.argmax())
                if best is None or gain[i] > best[0]:
                    best = (float(gain[i]), a, int(cut[i]), b)
        if best is None:
            break
        _, a, c, b = best
        parts.remove((a, b))
        parts += [(a, c), (c, b)]
        found.append(c - 1)
    return sorted(found)


def segmentation_table(x: np.ndarray, penalty: float = 10.0, least: int = 3) -> tuple[np.ndarray, np.ndarray, int]:
    """Least cost of each prefix by kernel cost + penalty per segment, where its last segment starts, and cells looked at.

    Starts that can't be on a best way any more are dropped: if a prefix costs less by itself than with a start's segment
    up to it, every later prefix does better by cutting there, as soon as the rest is long enough for a segment. The
    kernel is summed column by column for the starts that are left, so memory is O(n).

    The kernel's width is the median squared distance; its exponent is kept within [0.01, 100].
    """
    n = len(x)
    middle = pairs.median_square(x)
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    best[0] = -penalty
    starts, inside, until = np.zeros(1, np.int64), np.zeros(1), np.full(1, n + 1)
    cells = 0
    for b in range(1, n + 1):
        square = (x[starts[0] : b - 1] - x[b - 1]) ** 2
        column = np.exp(-np.clip(square / middle if middle > 0 else square, 1e-2, 1e2))
        tail = np.append(np.cumsum(column[::-1])[::-1], 0.0)
        inside += 2 * tail[starts - starts[0]] + 1
        cells += len(starts)
        if b < least:
            continue
        open_ = b - starts >= least
        own = best[starts] + (b - starts) - inside / (b - starts)
        i = int(np.where(open_, own, np.inf).argmin())
        if open_[i]:
            best[b], back[b] = own[i] + penalty, starts[i]
        until = np.where(open_ & (own > best[b]), np.minimum(until, b + least), until)
        left = until > b + 1
        starts, inside, until = np.append(starts[left], b), np.append(inside[left], 0.0), np.append(until[left], n + 1)
    return best, back, cells


def kernel_segmentation(x: np.ndarray, penalty: float = 10.0, least: int = 3) -> list[int]:
    """Last rows of all segments but the final one of the best segmentation (see ``segmentation_table``)."""
    best, back, _ = segmentation_table(x, penalty, least)
    out, b = [], len(x)
    while b > 0 and np.isfinite(best[b]):
        b = int(back[b])
        if b:
            out.append(b - 1)
    return sorted(out)


def segmentation_costs(series: DataFrame, penalty: float = 10.0, least: int = 3) -> DataFrame:
    """(series, t, cost, start): the least cost of the values up to each row of ``least`` and more, and its last segment's first row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        best, back, _ = segmentation_table(pdf["x"].to_numpy(float), penalty, least)
        got = pdf[["series", "t"]].assign(cost=best[1:], start=pdf["t"].to_numpy()[np.minimum(back[1:], len(pdf) - 1)])
        return got[np.isfinite(got["cost"])]

    return series.filter("x IS NOT NULL").select("series", "t", "x").groupBy("series").applyInPandas(run, "series string, t long, cost double, start long")


METHODS = {"binseg": binary_segmentation, "pelt": kernel_segmentation}


def break_points(series: DataFrame, method: str, **options) -> DataFrame:
    """(series, method, t, date, near_extreme) of every break; series of fewer than 24 values have none."""
    find = METHODS[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        at = find(pdf["x"].to_numpy(float), **options) if len(pdf) >= LEAST_ROWS else []
        return pdf.iloc[at][["series", "t", "date"]]

    found = series.filter("x IS NOT NULL").select("series", "t", "date", "x").groupBy("series").applyInPandas(run, "series string, t long, date date")
    return found.select("series", F.lit(method).alias("method"), "t", "date", F.year("date").isin(*EXTREME_YEARS).alias("near_extreme"))


def break_summary(breaks: DataFrame) -> DataFrame:
    """Breaks, those near an extreme year, their share, and the years, per series and method."""
    near = F.count_if("near_extreme")
    return breaks.groupBy("series", "method").agg(
        F.count(F.lit(1)).alias("n_breaks"), near.alias("n_near"), (near / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("fraction_near"), F.concat_ws(",", F.array_sort(F.collect_set(F.year("date")))).alias("years")
    )
