"""Lagged cross-correlation and wavelet coherence of aligned series."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import mathx

BY = ("series", "indicator")


def cross_correlation(pairs: DataFrame, most: int = 24) -> DataFrame:
    """(series, indicator, lag, n, r) for lags 0 to ``most``: sum x[t + lag] y[t] / n of z-scores (divided by n at any lag)."""
    own = W.partitionBy(*BY)
    rows = pairs.filter("x IS NOT NULL AND y IS NOT NULL").withColumn("i", F.row_number().over(own.orderBy("date")) - 1)
    z = rows.select(*BY, "i", *[((F.col(c) - F.avg(c).over(own)) / (F.stddev_pop(c).over(own) + 1e-12)).alias(c) for c in "xy"], F.count(F.lit(1)).over(own).alias("n"))
    left = z.select(*BY, "n", F.col("i").alias("j"), "x")
    right = z.select(*BY, F.col("y"), F.explode(F.sequence(F.lit(0), F.lit(most))).alias("lag"), "i").withColumn("j", F.col("i") + F.col("lag"))
    return left.join(right.drop("i"), [*BY, "j"]).groupBy(*BY, "lag", "n").agg((F.sum(F.col("x") * F.col("y")) / F.col("n")).alias("r"))


def correlation_peak(lags: DataFrame) -> DataFrame:
    """The lag of largest |r| (the first of equals), its r, and the Fisher interval with Student's critical value."""
    best = lags.groupBy(*BY, "n").agg(F.max(F.struct(F.round(F.abs("r"), 12).alias("a"), (-F.col("lag")).alias("l"), "r")).alias("b"))
    out = best.select(*BY, "n", (-F.col("b.l")).alias("peak_lag"), F.col("b.r").alias("peak_r"))

    @F.pandas_udf("double")
    def critical(n: pd.Series) -> pd.Series:
        return n.map(lambda v: mathx.t_quantile(0.975, max(v - 2, 1)) / math.sqrt(max(v - 3, 1)))

    z = F.atanh(F.greatest(F.least(F.col("peak_r"), F.lit(0.9999)), F.lit(-0.9999)))
    return out.withColumn("__c", critical("n")).withColumns({"ci_lower": F.tanh(z - F.col("__c")), "ci_upper": F.tanh(z + F.col("__c"))}).drop("__c")


def _wavelet(x: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Morlet transform (frequency 6) at each scale, by FFT with padding to a power of two."""
    n = len(x)
    size = 1 << (2 * n - 1).bit_length()
    k = 2 * np.pi * np.fft.fftfreq(size)
    spectrum = np.fft.fft(x, size)
    psi = np.pi**-0.25 * np.sqrt(2 * np.pi * scales[:, None]) * np.exp(-((scales[:, None] * k - 6.0) ** 2) / 2) * (k > 0)
    return np.fft.ifft(spectrum * psi, axis=1)[:, :n]


def _smooth(w: np.ndarray, scales: np.ndarray, dj: float) -> np.ndarray:
    """A Gaussian of the scale's width along time, then a box of 0.6 octaves along scales."""
    n = w.shape[1]
    size = 1 << (2 * n - 1).bit_length()
    k = 2 * np.pi * np.fft.fftfreq(size)
    out = np.fft.ifft(np.fft.fft(w, size, axis=1) * np.exp(-0.5 * (scales[:, None] * k) ** 2), axis=1)[:, :n]
    half = max(1, round(0.6 / dj / 2))
    sums = np.concatenate([np.zeros((1, n), complex), np.cumsum(out, axis=0)])
    lo, hi = np.maximum(np.arange(len(scales)) - half, 0), np.minimum(np.arange(len(scales)) + half + 1, len(scales))
    out = (sums[hi] - sums[lo]) / (hi - lo)[:, None]
    return out if np.iscomplexobj(w) else out.real


def wavelet_coherence(x: np.ndarray, y: np.ndarray, dj: float = 1 / 12, first: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Periods, and squared coherence by period and time."""
    n = len(x)
    scales = first * 2 ** (np.arange(int(np.log2(n / first) / dj) + 1) * dj)
    wx, wy = (_wavelet((v - v.mean()) / (v.std() + 1e-12), scales) for v in (x, y))
    s = scales[:, None]
    top = np.abs(_smooth(wx * wy.conj() / s, scales, dj)) ** 2
    base = _smooth(np.abs(wx) ** 2 / s, scales, dj) * _smooth(np.abs(wy) ** 2 / s, scales, dj)
    return 4 * np.pi * scales / (6 + math.sqrt(38)), np.clip(top / np.maximum(base, 1e-300), 0, 1)


def coherence_bands(pairs: DataFrame, bands: tuple[int, ...] = (6, 12, 24)) -> DataFrame:
    """Dominant period (largest mean coherence) and mean coherence within half of each band, per series and indicator."""
    names = [f"coh_{b}" for b in bands]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        facts = {"n": len(pdf), "dominant_period": np.nan, **dict.fromkeys(names, np.nan)}
        if len(pdf) >= 8:
            period, coh = wavelet_coherence(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float))
            mean = coh.mean(1)
            facts["dominant_period"] = period[int(mean.argmax())]
            for b, name in zip(bands, names, strict=True):
                within = (period >= 0.5 * b) & (period <= 1.5 * b)
                facts[name] = mean[within].mean() if within.any() else np.nan
        return pdf.iloc[:1][list(BY)].assign(**facts)

    schema = "series string, indicator string, n long, dominant_period double, " + ", ".join(f"{n} double" for n in names)
    return pairs.filter("x IS NOT NULL AND y IS NOT NULL").select(*BY, "date", "x", "y").groupBy(*BY).applyInPandas(run, schema)
