"""Monthly series: means per date, dense calendars, gaps, anomalies, yearly statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def no_nan(x: Column) -> Column:
    """NaN and infinities as null, so that aggregates skip them."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def mean_series(obs: DataFrame, *by: str) -> DataFrame:
    """(series, date, x): the mean of all observations of a series at a date; missing values are skipped."""
    keys = by or ("series",)
    return obs.groupBy(*keys, "date").agg(F.avg(no_nan(F.col("value").cast("double"))).alias("x"))


def densify(series: DataFrame, key: str = "series") -> DataFrame:
    """One row per series and month between the first and last month of all, with t = 0, 1, ... and x null in gaps."""
    span = series.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    months = span.select(F.posexplode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("t", "date"))
    grid = series.select(key).distinct().crossJoin(F.broadcast(months))  # series x months, the output itself
    return grid.join(series.select(key, "date", "x"), [key, "date"], "left").select(key, "date", F.col("t").cast("long").alias("t"), "x")


def interpolate(dense: DataFrame, key: str = "series", x: str = "x", edges: bool = True) -> DataFrame:
    """Gaps filled along the line between their neighbours; a trailing gap repeats the last value.

    A leading gap stays null, or takes the first value with ``edges``.
    """
    back = W.partitionBy(key).orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(key).orderBy("t").rowsBetween(0, W.unboundedFollowing)
    seen = F.when(F.col(x).isNotNull(), F.struct("t", F.col(x).alias("v")))
    out = dense.withColumn("__p", F.last(seen, ignorenulls=True).over(back)).withColumn("__n", F.first(seen, ignorenulls=True).over(ahead))
    p, n = F.col("__p"), F.col("__n")
    line = p["v"] + (n["v"] - p["v"]) * (F.col("t") - p["t"]) / (n["t"] - p["t"])
    filled = F.coalesce(F.col(x), line, p["v"], n["v"] if edges else F.lit(None).cast("double"))
    return out.withColumn(x, filled).drop("__p", "__n")


def fill_both_ways(dense: DataFrame, key: str = "series", x: str = "x") -> DataFrame:
    """Gaps take the value before them, leading ones the value after."""
    back = W.partitionBy(key).orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(key).orderBy("t").rowsBetween(0, W.unboundedFollowing)
    return dense.withColumn(x, F.coalesce(F.last(x, ignorenulls=True).over(back), F.first(x, ignorenulls=True).over(ahead)))


def climatology_anomaly(series: DataFrame, key: str = "series", x: str = "x") -> DataFrame:
    """Adds anomaly: x less the mean of its calendar month."""
    return series.withColumn("anomaly", F.col(x) - F.avg(x).over(W.partitionBy(key, F.month("date"))))


def rolling_anomaly(series: DataFrame, key: str = "series", x: str = "x", window: int = 12, least: int = 6) -> DataFrame:
    """Adds anomaly: x less the centred mean of ``window`` rows (rows -window/2 to window/2 - 1), null below ``least``."""
    w = W.partitionBy(key).orderBy("t").rowsBetween(-(window // 2), (window - 1) // 2)
    return series.withColumn("anomaly", F.col(x) - F.when(F.count(x).over(w) >= least, F.avg(x).over(w)))


def yearly_stats(obs: DataFrame) -> DataFrame:
    """Mean, sample deviation and count of values per series and year."""
    v = no_nan(F.col("value").cast("double"))
    return obs.groupBy("series", F.year("date").alias("year")).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("n"))


def completeness(obs: DataFrame) -> DataFrame:
    """Pixels, dates, rows and rows / (pixels x dates) per series, with a flag below 0.7."""
    out = obs.groupBy("series").agg(F.countDistinct("pixel").alias("n_pixels"), F.countDistinct("date").alias("n_dates"), F.count(F.lit(1)).alias("n_rows"))
    ratio = F.col("n_rows") / (F.col("n_pixels") * F.col("n_dates"))
    return out.withColumn("completeness", ratio).withColumn("sparse", ratio < 0.7)


def null_profile(long: DataFrame, key: str = "indicator") -> DataFrame:
    """Rows, nulls, their share, and least, most and mean value per indicator."""
    missing = F.count_if(F.col("value").isNull())
    return long.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), missing.alias("n_null"), (missing / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("null_rate"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean")
    )


def unpivot(wide: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(date, indicator, value) from one column per indicator."""
    return wide.unpivot(["date"], list(names), "indicator", "value")


def pivot(long: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One column per indicator from (date, indicator, value)."""
    return long.groupBy("date").pivot("indicator", list(names)).agg(F.first("value"))


def first_per(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The first row of each group in ``order``."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("__n = 1").drop("__n")


def first_dates(series: DataFrame, n: int, key: str = "series") -> DataFrame:
    """The rows of the first ``n`` dates of each series (smoke runs)."""
    return series.withColumn("__r", F.dense_rank().over(W.partitionBy(key).orderBy("date"))).filter(F.col("__r") <= n).drop("__r")
