"""From a data folder's tables to the engine's inputs: value observations, indicators, points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.tables import table

INDICATORS = ("quantity", "discount", "tax", "price")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, pixel, date, value): order totals of customers, by region and month of order."""
    geo = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("series"))
    where = table(spark, sf_dir, "customer").join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "series")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    return orders.join(where, F.col("o_custkey") == F.col("c_custkey")).select("series", F.col("o_custkey").alias("pixel"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("date"), F.col("o_totalprice").alias("value"))


def indicators_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, quantity, discount, tax, price): monthly means of line items."""
    items = table(spark, sf_dir, "lineitem")
    month = F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date")
    cols = dict(zip(INDICATORS, ("l_quantity", "l_discount", "l_tax", "l_extendedprice"), strict=True))
    return items.groupBy(month).agg(*[F.avg(c).alias(name) for name, c in cols.items()])


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, lon, lat) from the first two coordinates of embeddings, spread over a map."""
    e = table(spark, sf_dir, "embeddings")
    first, second = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    return e.select(F.col("vec_id").alias("id"), (first * 400).alias("lon"), (second * 200).alias("lat"))


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, t, date, x): mean price of the line items of a day; t is days since the first, days without items are absent."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").alias("x"))
    first = items.agg(F.min("date")).scalar()
    return items.groupBy("date").agg(F.avg("x").alias("x")).select(F.lit("price").alias("series"), F.date_diff("date", first).cast("long").alias("t"), "date", "x")


def validity_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, event_type, first, last): up to five days from each event, with 18 minutes of events as a day of orders."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    start = e.agg(F.min("ts")).scalar()
    day = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1_080_000_000).cast("int")
    return e.withColumn("day", day).select("event_id", "event_type", F.date_add(F.lit("1995-01-01").cast("date"), F.col("day")).alias("first"), F.date_add(F.lit("1995-01-01").cast("date"), F.col("day") + (F.col("event_id") % 5).cast("int")).alias("last"))
