"""Rolling statistics over rows of dense series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.columns import pearson_p
from tessera.operators.series import no_nan


def rolling_pearson(pairs: DataFrame, window: int = 36, by: tuple[str, ...] = ("series", "indicator")) -> DataFrame:
    """(by, date, n_row, r, p): correlation of x and y over the last ``window`` rows, full windows only, with its p-value.

    Rows without either value are dropped first, so windows count rows; a constant window has r = 0; r is kept in [-1, 1].
    """
    own = W.partitionBy(*by).orderBy("date")
    w = own.rowsBetween(-(window - 1), 0)
    rows = pairs.filter("x IS NOT NULL AND y IS NOT NULL")
    x, y = F.col("x"), F.col("y")
    mx, my = F.avg(x).over(w), F.avg(y).over(w)
    num = F.avg(x * y).over(w) - mx * my
    den = F.sqrt(F.greatest((F.avg(x * x).over(w) - mx * mx) * (F.avg(y * y).over(w) - my * my), F.lit(0.0)))
    r = F.greatest(F.least(num / (den + 1e-14), F.lit(1.0)), F.lit(-1.0))
    out = rows.withColumn("r", r).withColumn("__n", F.row_number().over(own)).filter(F.col("__n") >= window)
    return out.select(*by, "date", F.col("__n").alias("n_row"), "r", pearson_p(F.col("r"), F.lit(window)).alias("p"))


def profile_indices(profile: DataFrame, window: int = 24, least: int = 12, threshold: float = 1.5) -> DataFrame:
    """Adds the rolling minimum and mean of mp over ``window`` rows, and anomalous: mp above mean + threshold x deviation."""
    w = W.partitionBy("series").orderBy("t").rowsBetween(-(window - 1), 0)
    whole = W.partitionBy("series")
    mp = no_nan(F.col("mp"))
    enough = F.count(mp).over(w) >= least
    return profile.withColumns(
        {
            "mpi_min": F.when(enough, F.min(mp).over(w)),
            "mpi_mean": F.when(enough, F.avg(mp).over(w)),
            "anomalous": F.coalesce(F.col("mp") > F.avg(mp).over(whole) + threshold * F.stddev_pop(mp).over(whole), F.lit(False)),
        }
    )


def annual_indices(indices: DataFrame) -> DataFrame:
    """(series, year, mpi_min, mpi_mean, n_anomalous): means of the rolling indices and count of anomalous rows by year."""
    return indices.groupBy("series", F.year("date").alias("year")).agg(F.avg("mpi_min").alias("mpi_min"), F.avg("mpi_mean").alias("mpi_mean"), F.count_if("anomalous").cast("double").alias("n_anomalous"))


def with_annual_count(indices: DataFrame) -> DataFrame:
    """Every row with the count of anomalous rows of its year, by a window instead of a join back."""
    year = W.partitionBy("series", F.year("date"))
    return indices.select("series", "date", "mpi_min", "mpi_mean", F.count_if("anomalous").over(year).alias("n_anomalous"))


def recent_rows(annual: DataFrame, split: int) -> DataFrame:
    """(series, indicator, early, value): the annual indices as samples before and from year ``split``, nulls left out."""
    long = annual.unpivot(["series", "year"], ["mpi_min", "mpi_mean", "n_anomalous"], "indicator", "value")
    return long.filter("value IS NOT NULL").select("series", "indicator", (F.col("year") < split).alias("early"), "value")


def anomaly_rates(indices: DataFrame, split: int) -> DataFrame:
    """Share of anomalous rows before and from year ``split``, and whether it grew."""
    before = F.year("date") < split
    flag = F.col("anomalous")
    early = F.count_if(before & flag) / F.greatest(F.count_if(before), F.lit(1))
    late = F.count_if(~before & flag) / F.greatest(F.count_if(~before), F.lit(1))
    return indices.groupBy("series").agg(F.count(F.lit(1)).alias("n"), early.alias("early_rate"), late.alias("late_rate")).withColumn("grew", F.col("late_rate") > F.col("early_rate"))


def profile_summary(profile: DataFrame) -> DataFrame:
    """Count, mean, population deviation, least and most of mp, infinities left out."""
    mp = no_nan(F.col("mp"))
    return profile.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.avg(mp).alias("mean"), F.stddev_pop(mp).alias("std"), F.min(mp).alias("least"), F.max(mp).alias("most"))
