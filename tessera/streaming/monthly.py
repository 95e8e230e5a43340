"""Means over time windows of unbounded observations, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_means(stream: DataFrame, length: str = "30 days", late: str = "2 days", key: str = "event_type", ts: str = "ts", value: str = "value") -> DataFrame:
    """(key, start, n, mean) per tumbling window; works on streams and tables alike."""
    marked = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = marked.groupBy(F.window(ts, length).alias("w"), key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return out.select(key, F.col("w.start").alias("start"), "n", "mean")


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the Parquet files that appear in ``folder``, with the schema of those there now."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
