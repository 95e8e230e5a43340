"""Joins of motif starts within a band of lags, and what is counted over them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import counter


#: Shares into which the series of a band of lags are dealt; the other side is sent to each.
SALTS = 8


def lag_pairs(starts: DataFrame, others: DataFrame, most: int, salts: int = SALTS) -> DataFrame:
    """(series, indicator, start, other, lag): pairs of starts at most ``most`` apart; lag = other - start.

    Starts are dealt into bands of ``most`` + 1 rows and each looks into its own and both neighbouring bands, so the
    join is on equal bands whatever the size of the sides. Series are few rows and many in number, and all have starts
    in the same few bands: a band's series are dealt over ``salts`` keys, to each of which the other side's starts go.
    Duplicate starts count once.
    """
    width = most + 1
    x = starts.select("series", F.col("t").alias("start")).distinct().withColumn("band", F.explode(F.array(*[F.floor(F.col("start") / width) + d for d in (-1, 0, 1)]))).withColumn("salt", F.pmod(F.hash("series"), F.lit(salts)))
    y = others.select("indicator", F.col("t").alias("other")).distinct().withColumn("band", F.floor(F.col("other") / width)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    lag = F.col("other") - F.col("start")
    return x.join(y, ["band", "salt"]).filter(F.abs(lag) <= most).select("series", "indicator", "start", "other", lag.alias("lag"))


def overlap_rates(starts: DataFrame, others: DataFrame, most: int) -> DataFrame:
    """Per series and indicator: starts, starts with a partner within ``most``, their share, and whether any is coupled."""
    grid = starts.groupBy("series").agg(F.countDistinct("t").alias("n_starts")).crossJoin(others.select("indicator").distinct())
    matched = lag_pairs(starts, others, most).groupBy("series", "indicator").agg(F.countDistinct("start").alias("n_matched"))
    out = grid.join(matched, ["series", "indicator"], "left").fillna(0, ["n_matched"])
    return out.withColumns({"fraction": F.col("n_matched") / F.greatest("n_starts", F.lit(1)), "coupled": F.col("n_matched") > 0})


def null_cases(starts: DataFrame, others: DataFrame, lengths: DataFrame, m: int, k: int, most: int, by_pairs: bool = False) -> DataFrame:
    """Cases of the null model (series, indicator, length, m, k, most, observed) for every series and indicator.

    What is observed are starts with a partner, as the null counts them, or with ``by_pairs`` all pairs, which can be
    more and so look rarer than they are.
    """
    counts = overlap_rates(starts, others, most).select("series", "indicator", F.col("n_matched").alias("observed"))
    if by_pairs:
        pairs = lag_pairs(starts, others, most).groupBy("series", "indicator").agg(F.count(F.lit(1)).alias("n"))
        counts = counts.select("series", "indicator").join(pairs, ["series", "indicator"], "left").select("series", "indicator", F.coalesce("n", F.lit(0)).cast("long").alias("observed"))
    fixed = [F.lit(v).cast("long").alias(c) for c, v in (("m", m), ("k", k), ("most", most))]
    return counts.join(lengths, "series").select("series", "indicator", "length", *fixed, "observed")


def lag_summary(pairs: DataFrame) -> DataFrame:
    """Per series and indicator: pairs, median lag, and the lag's 2.5 and 97.5 percentiles (linear)."""
    return pairs.groupBy("series", "indicator").agg(
        F.count(F.lit(1)).alias("n_overlaps"), F.median("lag").alias("median_lag"), F.percentile("lag", 0.025).alias("p025"), F.percentile("lag", 0.975).alias("p975"), F.countDistinct("start").alias("n_matched")
    )


def bootstrap_median(values: np.ndarray, key: int, draws: int = 1000) -> tuple[float, float]:
    """95 % interval of the median under resampling; not a number without values."""
    if not len(values):
        return float("nan"), float("nan")
    at = counter.drawn_array(key, np.arange(draws), np.arange(len(values)), len(values))
    lo, hi = np.quantile(np.median(np.sort(values)[at], axis=1), [0.025, 0.975])
    return float(lo), float(hi)


def lag_intervals(pairs: DataFrame, draws: int = 1000, seed: int = 42) -> DataFrame:
    """Bootstrap intervals of the median lag per series and indicator, every draw a row of its own.

    A draw depends on the pair's names, its own number and ``seed`` alone, so any partitioning gives the same intervals,
    and so does SQL.
    """
    own = pairs.groupBy("series", "indicator").agg(F.sort_array(F.collect_list(F.col("lag").cast("double"))).alias("lags"))
    keyed = own.withColumns({"key": counter.key_of("series", "indicator") + seed, "n": F.size("lags").cast("long")})
    rows = keyed.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    places = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    sample = F.sort_array(F.transform(places, lambda i: F.get("lags", counter.drawn(F.col("key"), F.col("draw"), i, F.col("n")).cast("int"))))
    middle = rows.withColumn("sample", sample).select("series", "indicator", "n", ((F.get("sample", F.floor((F.col("n") - 1) / 2).cast("int")) + F.get("sample", F.floor(F.col("n") / 2).cast("int"))) / 2).alias("m"))
    return middle.groupBy("series", "indicator", "n").agg(F.percentile("m", 0.025).alias("ci_lower"), F.percentile("m", 0.975).alias("ci_upper"))


def annual_counts(pairs: DataFrame, dates: DataFrame, first: int, last: int) -> DataFrame:
    """Overlaps per series, indicator and year of the start, with zeros for the other years of first to last."""
    spine = pairs.select("series", "indicator").distinct().select("series", "indicator", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
    when = dates.select("series", F.col("t").alias("start"), F.year("date").alias("year"))
    counts = pairs.join(when, ["series", "start"]).groupBy("series", "indicator", "year").agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, ["series", "indicator", "year"], "left").fillna(0, ["n"])
