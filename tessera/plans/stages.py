"""The analysis stages as lazy frames: series, profiles, starts, overlaps, tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import adapters
from tessera.config import EngineConfig
from tessera.operators import correlate, overlap, profile, rolling, series


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, date, t, x): dense, gap-free monthly means per region."""
    return series.interpolate(series.densify(series.mean_series(adapters.observations(spark, sf_dir))))


def indicator_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, date, t, x): the indicators over the months of the regional series, gap-free."""
    long = series.unpivot(adapters.indicators_wide(spark, sf_dir), adapters.INDICATORS)
    span = series.mean_series(adapters.observations(spark, sf_dir)).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    inside = long.crossJoin(F.broadcast(span)).filter(F.col("date").between(F.col("a"), F.col("b")))  # one row of bounds
    months = span.select(F.posexplode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("t", "date"))
    grid = spark.createDataFrame([(i,) for i in adapters.INDICATORS], "series string").crossJoin(F.broadcast(months))
    dense = grid.join(inside.select(F.col("indicator").alias("series"), "date", F.col("value").alias("x")), ["series", "date"], "left")
    return series.interpolate(dense.select("series", "date", F.col("t").cast("long").alias("t"), "x"))


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, indicator, date, x, y): anomalies of regions and indicators on common dates."""
    regions = series.rolling_anomaly(monthly(spark, sf_dir)).select("series", "date", F.col("anomaly").alias("x"))
    others = series.rolling_anomaly(indicator_series(spark, sf_dir)).select(F.col("series").alias("indicator"), "date", F.col("anomaly").alias("y"))
    return regions.join(others, "date")


def region_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.climatology_anomaly(monthly(spark, sf_dir)).select("series", "date", "t", F.col("anomaly").alias("x"))


def region_profile(spark: SparkSession, sf_dir: str, m: int = 12) -> DataFrame:
    return profile.matrix_profile(region_anomalies(spark, sf_dir), m)


def indicator_profile(spark: SparkSession, sf_dir: str, m: int = 12) -> DataFrame:
    return profile.matrix_profile(indicator_series(spark, sf_dir), m)


def starts(found: DataFrame, m: int, k: int = 3, key: str = "series") -> DataFrame:
    return profile.best_windows(found, k, max(m // 4, 1), key=key)


def pairs(spark: SparkSession, sf_dir: str, m: int = 12, most: int = 12) -> DataFrame:
    """Lag pairs of region and indicator motif starts."""
    mine = starts(region_profile(spark, sf_dir, m), m)
    others = starts(indicator_profile(spark, sf_dir, m), m).withColumnRenamed("series", "indicator")
    return overlap.lag_pairs(mine, others, most)


def sweep(spark: SparkSession, sf_dir: str, lengths: tuple[int, ...] = (12, 24, 36, 48), rolling_mean: bool = False) -> DataFrame:
    """Overlap rates by window length: every profile is computed once per (series, length), then combined.

    Regions are taken as anomalies from their climatology and indicators as they are, or, with ``rolling_mean``, both as
    anomalies from a centred year's mean with edges filled from their neighbours.
    """

    def settled(frame: DataFrame) -> DataFrame:
        return series.fill_both_ways(series.rolling_anomaly(frame), x="anomaly").select("series", "date", "t", F.col("anomaly").alias("x"))

    own = settled(monthly(spark, sf_dir)) if rolling_mean else region_anomalies(spark, sf_dir)
    other = settled(indicator_series(spark, sf_dir)) if rolling_mean else indicator_series(spark, sf_dir)

    def one(m: int) -> DataFrame:
        mine = starts(profile.matrix_profile(own, m), m)
        others = starts(profile.matrix_profile(other, m), m).withColumnRenamed("series", "indicator")
        return overlap.overlap_rates(mine, others, m).withColumn("m", F.lit(m))

    return reduce(DataFrame.unionByName, map(one, lengths))


def configured(spark: SparkSession, sf_dir: str, config: EngineConfig) -> dict[str, DataFrame]:
    """The main stages under ``config``, as lazy frames by name.

    Its regions bound the observations at the source, and ``smoke`` keeps the first region and 60 months.
    """
    seen = adapters.observations(spark, sf_dir)
    names = sorted(config.regions) or ([r.series for r in seen.select("series").distinct().orderBy("series").limit(1).collect()] if config.smoke else [])
    if names:
        seen = seen.filter(F.col("series").isin(config.limited(names)))
    dense = series.densify(series.mean_series(seen))
    regions = series.interpolate(series.first_dates(dense, 60) if config.smoke else dense).select("series", "date", "t", "x")
    found = profile.matrix_profile(series.climatology_anomaly(regions).select("series", "date", "t", F.col("anomaly").alias("x")), config.window)
    other = profile.matrix_profile(indicator_series(spark, sf_dir), config.window)
    zone = max(config.window // 4, 1)
    motifs = profile.best_windows(found, config.motifs, zone)
    met = overlap.lag_pairs(motifs, starts(other, config.window, config.motifs).withColumnRenamed("series", "indicator"), config.window)
    mine = series.rolling_anomaly(regions).select("series", "date", F.col("anomaly").alias("x"))
    theirs = series.rolling_anomaly(indicator_series(spark, sf_dir)).select(F.col("series").alias("indicator"), "date", F.col("anomaly").alias("y"))
    both = mine.join(theirs, "date")
    return {
        "monthly": regions,
        "profile": found,
        "motifs": motifs,
        "discords": profile.best_windows(found, config.discords, zone, largest=True),
        "pairs": met,
        "lag_intervals": overlap.lag_intervals(met, config.bootstraps, config.seed),
        "rolling_pearson": rolling.rolling_pearson(both, config.rolling),
        "xcorr_lags": correlate.cross_correlation(both, config.lags),
    }
