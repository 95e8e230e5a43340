"""Registered queries of the series engine, each with the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import adapters
from tessera.functions import columns as fn
from tessera.functions import projections
from tessera.operators import bands, changes, correlate, intervals, overlap, profile, rolling, series, spatial, stats, table_functions, tiles
from tessera.plans import stages
from tessera.plans.oracles import DIGITS, NUDGE, DAYS, T975, greater, normal_tail, shown, sided, t_even, t_five, with_parts
from tessera.sources import readers
from tessera.streaming import anomalies, monthly
from tessera.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal, negative zero as zero; dates as text."""
    made = {"double": lambda c: F.round(F.col(c) + NUDGE, digits) + F.lit(0.0), "date": lambda c: F.col(c).cast("string")}
    return df.select(*[made.get(kind, F.col)(c).alias(c) for c, kind in df.dtypes])


def query(sql: str | None = None, digits: int = DIGITS):
    """Registers a query under its name, with its oracle; ``$name`` in the SQL stands for a shared part.

    Columns named date or month are dates, given as text by both.
    """

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            dated = next((c for c in ("date", "month") if re.match(rf"SELECT [^()]*\b{c}\b", sql)), None)
            whole = with_parts(sql)
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE (CAST({dated} AS VARCHAR) AS {dated}) FROM ({whole})" if dated else whole
        return f

    return add


# --- series --------------------------------------------------------------------------------------


@query(f"SELECT series, date, t, {shown('x')} FROM $monthly")
def monthly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.monthly(spark, sf_dir)


@query(f"SELECT series, date, t, {shown('x')} FROM $clim")
def climatology_anomaly(spark, sf_dir):
    return stages.region_anomalies(spark, sf_dir)


@query(f"SELECT series, date, t, {shown('x', 'anomaly')} FROM $roll")
def rolling_deseason(spark, sf_dir):
    return series.rolling_anomaly(stages.monthly(spark, sf_dir))


@query(f"""SELECT series, date, t, {shown('x', 'line', 'near')} FROM (SELECT g.series, g.date, g.t, g.x, m.x AS line,
  coalesce(last_value(g.x IGNORE NULLS) OVER (PARTITION BY g.series ORDER BY g.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(g.x IGNORE NULLS) OVER (PARTITION BY g.series ORDER BY g.t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS near
  FROM $dense g JOIN $monthly m ON g.series = m.series AND g.t = m.t)""")
def fill_gaps(spark, sf_dir):
    dense = series.densify(series.mean_series(adapters.observations(spark, sf_dir))).withColumns({"line": F.col("x"), "near": F.col("x")})
    return series.fill_both_ways(series.interpolate(dense, x="line"), x="near")


@query(f"SELECT date, indicator, {shown('value')} FROM $long")
def indicator_long(spark, sf_dir):
    return series.unpivot(adapters.indicators_wide(spark, sf_dir), adapters.INDICATORS)


@query(f"SELECT date, {shown(*adapters.INDICATORS)} FROM $wide")
def indicator_wide(spark, sf_dir):
    return series.pivot(indicator_long(spark, sf_dir), adapters.INDICATORS)


@query(f"SELECT indicator, n, n_null, {shown('null_rate', 'least', 'most', 'mean')} FROM (SELECT indicator, count(*) AS n, count(*) - count(value) AS n_null, (count(*) - count(value)) / count(*) AS null_rate, min(value) AS least, max(value) AS most, avg(value) AS mean FROM $long GROUP BY ALL)")
def indicator_profile(spark, sf_dir):
    return series.null_profile(indicator_long(spark, sf_dir))


@query(f"SELECT series, year, {shown('mean', 'std', digits=4)}, n FROM (SELECT series, CAST(year(date) AS INTEGER) AS year, avg(value) AS mean, stddev_samp(value) AS std, count(value) AS n FROM $obs GROUP BY ALL)", digits=4)
def yearly_stats(spark, sf_dir):
    return series.yearly_stats(adapters.observations(spark, sf_dir))


@query(f"SELECT series, n_pixels, n_dates, n_rows, {shown('completeness')}, completeness < 0.7 AS sparse FROM (SELECT series, count(DISTINCT pixel) AS n_pixels, count(DISTINCT date) AS n_dates, count(*) AS n_rows, count(*) / (count(DISTINCT pixel) * count(DISTINCT date)) AS completeness FROM $obs GROUP BY ALL)")
def completeness_qc(spark, sf_dir):
    return series.completeness(adapters.observations(spark, sf_dir))


@query("SELECT series, date, t FROM (SELECT *, dense_rank() OVER (PARTITION BY series ORDER BY date) AS r FROM $dense) WHERE r <= 60")
def first_sixty_dates(spark, sf_dir):
    dense = series.densify(series.mean_series(adapters.observations(spark, sf_dir)))
    return series.first_dates(dense, 60).select("series", "date", "t")


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def first_order_per_customer(spark, sf_dir):
    return series.first_per(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority"), ("o_custkey",), ("o_orderdate", "o_orderkey")).drop("o_orderdate")


@query("SELECT pixel, date, t, value FROM (SELECT p.pixel, m.date, m.t, o.value FROM (SELECT DISTINCT pixel FROM $obs) p CROSS JOIN $months m LEFT JOIN (SELECT pixel, date, arg_min(value, value) AS value FROM $obs GROUP BY ALL) o ON o.pixel = p.pixel AND o.date = m.date)")
def pixel_months(spark, sf_dir):
    first = adapters.observations(spark, sf_dir).groupBy("pixel", "date").agg(F.min("value").alias("x"))
    return series.densify(first, "pixel").withColumnRenamed("x", "value")


@query("SELECT date FROM (SELECT date FROM $wide EXCEPT SELECT date FROM $means)")
def months_without_orders(spark, sf_dir):
    return adapters.indicators_wide(spark, sf_dir).select("date").exceptAll(series.mean_series(adapters.observations(spark, sf_dir)).select("date").distinct())


@query("SELECT event_type, CAST(start AS VARCHAR) AS start, n, round(mean + 2e-09, 6) + 0.0 AS mean FROM (SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS start, count(value) AS n, avg(value) AS mean FROM events GROUP BY ALL)")
def event_windows(spark, sf_dir):
    got = monthly.windowed_means(table(spark, sf_dir, "events"), "1 day")
    return got.withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query(f"SELECT series, date, {shown('x', 'anomaly')}, n, false AS late FROM (SELECT series, date, x, x - sum(x) OVER w / count(x) OVER w AS anomaly, count(x) OVER w AS n FROM $monthly WINDOW w AS (PARTITION BY series, month(date) ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))")
def running_anomalies(spark, sf_dir):
    return anomalies.batch_anomalies(stages.monthly(spark, sf_dir))


# --- sources over lines and names made of the tables --------------------------------------------------


_LINES = """SELECT CAST(month AS DATE) AS date, 'price' AS indicator, CASE WHEN CAST(n % 7 AS BIGINT) <> 0 THEN cents / 100.0 END AS value FROM (SELECT date_trunc('month', l_shipdate) AS month, count(*) AS n, CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY ALL)"""


def _months_as_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, n, cents): sums of whole prices by month of shipping."""
    items = table(spark, sf_dir, "lineitem").select(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month"), F.round("l_extendedprice").cast("long").alias("price"))
    return items.groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("cents"))


@query(f"SELECT date, indicator, {shown('value')} FROM ({_LINES})")
def index_lines(spark, sf_dir):
    """Lines YEAR MONTH VALUE, with -99.90 for a missing value, a title and a remark, as the index tables have them."""
    value = F.when(F.col("n") % 7 == 0, "-99.90").otherwise(F.format_string("%d.%02d", F.floor(F.col("cents") / 100), F.col("cents") % 100))
    line = F.concat_ws("  ", F.date_format("month", " yyyy"), F.date_format("month", "M"), value)
    lines = _months_as_lines(spark, sf_dir).select(F.explode(F.array(line, F.lit("YEAR MONTH VALUE"), F.lit("# made of prices"))).alias("value"))
    return readers.parse_long_ascii(lines, "price")


@query(f"SELECT date, indicator, {shown('value')} FROM ({_LINES})")
def seasonal_lines(spark, sf_dir):
    """Lines SEASON YEAR TOTAL ANOMALY, a season named by its three months and dated by the middle one."""
    season = F.element_at(F.array(*map(F.lit, readers.SEASONS)), F.month("month"))
    value = F.when(F.col("n") % 7 == 0, "-99.90").otherwise(F.format_string("%d.%02d", F.floor(F.col("cents") / 100), F.col("cents") % 100))
    line = F.concat_ws(" ", season, F.year("month").cast("string"), F.lit("0.00"), value)
    lines = _months_as_lines(spark, sf_dir).select(F.explode(F.array(line, F.lit("SEAS YR TOTAL ANOM"), F.lit("XYZ 2000 1 1"))).alias("value"))
    return readers.parse_seasonal_ascii(lines, "price")


@query("SELECT region, count(*) AS n FROM (SELECT CASE WHEN s_suppkey % 5 < 4 THEN lower(r_name) END AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY ALL")
def regions_from_names(spark, sf_dir):
    """Regions told from file names; a name with an unknown region, or none, has no region."""
    geo = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 rows at every scale
    named = table(spark, sf_dir, "supplier").join(F.broadcast(geo), F.col("s_nationkey") == F.col("n_nationkey"))
    prefix = F.when(F.col("s_suppkey") % 5 < 4, "kNDVI_").otherwise("other_")
    names = named.select(F.concat(prefix, F.col("r_name"), F.lit("_2000_2025.csv")).alias("name"))
    return names.select(readers.region_from_name(F.col("name"), ["africa", "america", "asia", "europe", "middle east"]).alias("region")).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT region, count(*) AS n, count(*) FILTER (id % 3 = 1 OR id % 5 = 4) AS n_in_2020, count(*) FILTER (id % 3 = 1) AS n_in_2025 FROM $points JOIN $boxes ON lon BETWEEN lon_min AND lon_max AND lat BETWEEN lat_min AND lat_max GROUP BY ALL")
def masked_counts(spark, sf_dir):
    """Points by region, and how many a mask of each year keeps: the diagnostics before an export."""
    got = spatial.assign_boxes(adapters.points(spark, sf_dir), spatial.boxes(spark))
    kept = {year: bands.intact(F.col("id") % 3, F.col("id") % 5, year) for year in (2020, 2025)}
    return got.groupBy("region").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"n_in_{year}") for year, c in kept.items()])


# --- scalar functions ------------------------------------------------------------------------------


@query("""SELECT p_partkey, round(tanh(pow((nir - red) / 1.0, 2)) + 2e-9, 6) + 0.0 AS kndvi, round(tanh(pow((nir - red) / (nir + red), 2)) + 2e-9, 6) + 0.0 AS from_ndvi, raw > -28672 AS kept, round(CASE WHEN raw > -28672 THEN raw * 0.0001 END + 2e-9, 6) + 0.0 AS reflectance,
  round(CASE WHEN max(abs(p_retailprice)) OVER () > 2 THEN p_retailprice / 10000.0 ELSE p_retailprice END + 2e-9, 6) + 0.0 AS rescaled, p_size BETWEEN 0 AND 1 AS quality
  FROM (SELECT *, p_retailprice / 2000 AS nir, p_size / 100.0 AS red, CASE WHEN p_size % 7 = 0 THEN -28672 ELSE p_size * 100 END AS raw FROM part)""")
def kndvi_transform(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    nir, red = F.col("p_retailprice") / 2000, F.col("p_size") / 100.0
    raw = F.when(F.col("p_size") % 7 == 0, fn.FILL).otherwise(F.col("p_size") * 100)
    largest = p.agg(F.max(F.abs("p_retailprice")).alias("largest"))
    return p.crossJoin(F.broadcast(largest)).select(  # one row
        "p_partkey", fn.kndvi(nir, red).alias("kndvi"), fn.kndvi_from_ndvi((nir - red) / (nir + red)).alias("from_ndvi"), (raw > fn.FILL).alias("kept"), fn.unscaled(raw).alias("reflectance"),
        fn.rescaled(F.col("p_retailprice"), F.col("largest")).alias("rescaled"), fn.quality_ok(F.col("p_size")).alias("quality"),
    )


@query("SELECT count(*) FILTER (v BETWEEN -1.000001 AND 1.000001) AS n_ok, count(*) FILTER (NOT v BETWEEN -1.000001 AND 1.000001) AS n_bad FROM (SELECT l_discount * 12 - 0.1 AS v FROM lineitem)")
def range_check(spark, sf_dir):
    ok = (F.col("l_discount") * 12 - 0.1).between(-1.000001, 1.000001)
    return table(spark, sf_dir, "lineitem").agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_bad"))


@query("""SELECT s_suppkey, h, v, round(degrees(x / (6371007.181 * cos(y / 6371007.181))) + 2e-9, 6) + 0.0 AS lon, round(degrees(y / 6371007.181) + 2e-9, 6) + 0.0 AS lat FROM (
  SELECT *, (h - 18) * 1111950.519667 + (c + 0.5) * (1111950.519667 / 1200) AS x, (9 - v) * 1111950.519667 - (r + 0.5) * (1111950.519667 / 1200) AS y FROM (
  SELECT s_suppkey, CAST(10 + s_nationkey % 16 AS INTEGER) AS h, CAST(2 + s_nationkey % 14 AS INTEGER) AS v, (s_suppkey * 5) % 1200 AS r, (s_suppkey * 35) % 1200 AS c FROM supplier))""")
def tile_lon_lat(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (10 + F.col("s_nationkey") % 16).cast("int").alias("h"), (2 + F.col("s_nationkey") % 14).cast("int").alias("v"))
    lon, lat = fn.tile_lon_lat(F.col("h"), F.col("v"), (F.col("s_suppkey") * 5) % 1200, (F.col("s_suppkey") * 35) % 1200)
    return s.select("s_suppkey", "h", "v", lon.alias("lon"), lat.alias("lat"))


@query("SELECT o_orderkey, month, h, v FROM (SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(o_custkey % 36 AS INTEGER) AS h, CAST(o_orderkey % 18 AS INTEGER) AS v FROM orders)")
def file_name_parts(spark, sf_dir):
    name = F.concat(F.lit("MOD.A"), F.date_format("o_orderdate", "yyyyDDD"), F.format_string(".h%02dv%02d.hdf", F.col("o_custkey") % 36, F.col("o_orderkey") % 18))
    named = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"))
    tile = fn.tile_from_name(F.col("name"))
    return named.select("o_orderkey", fn.date_from_name(F.col("name")).alias("month"), tile["h"].alias("h"), tile["v"].alias("v"))


@query("""SELECT p_partkey, round(tanh(pow((CASE WHEN max(p_retailprice) OVER f > 2 THEN p_retailprice / 10000.0 ELSE p_retailprice END - CASE WHEN max(p_size) OVER f > 2 THEN p_size / 10000.0 ELSE p_size END) / 1.0, 2)) + 2e-9, 6) + 0.0 AS kndvi
  FROM part WINDOW f AS (PARTITION BY p_brand)""")
def index_by_precedence(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("file"), F.col("p_retailprice").alias("nir"), F.col("p_size").cast("double").alias("red"), F.lit(0.5).alias("ndvi"))
    return bands.vegetation_index(p, "file").select("p_partkey", "kndvi")


@query("SELECT p_partkey, round(CASE WHEN max(abs(p_retailprice)) OVER (PARTITION BY p_brand) > 2 THEN p_retailprice / 10000.0 ELSE p_retailprice END + 2e-9, 6) + 0.0 AS kndvi FROM part")
def index_as_it_is(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("file"), F.col("p_retailprice").alias("kndvi"), F.lit(0.5).alias("ndvi"))
    return bands.vegetation_index(p, "file").select("p_partkey", "kndvi")


@query("SELECT p_partkey, round(tanh(pow(CASE WHEN max(p_size) OVER (PARTITION BY p_brand) > 2 THEN p_size / 10000.0 ELSE p_size END, 2)) + 2e-9, 6) + 0.0 AS kndvi FROM part")
def index_from_ndvi(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("file"), F.col("p_size").cast("double").alias("ndvi"), F.col("p_retailprice").alias("nir"))
    return bands.vegetation_index(p, "file").select("p_partkey", "kndvi")


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY ALL")
def half_open_dates(spark, sf_dir):
    inside = bands.from_until(table(spark, sf_dir, "orders"), "o_orderdate", dt.date(1996, 1, 1), dt.date(1997, 1, 1))
    return inside.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey, s_nationkey % 3 = 1 OR s_nationkey % 5 = 4 AS in_2020, s_nationkey % 3 = 1 AS in_2025 FROM supplier")
def raster_mask(spark, sf_dir):
    extent, loss = F.col("s_nationkey") % 3, F.col("s_nationkey") % 5
    return table(spark, sf_dir, "supplier").select("s_suppkey", bands.intact(extent, loss, 2020).alias("in_2020"), bands.intact(extent, loss, 2025).alias("in_2025"))


@query("SELECT p_partkey, round_even(p_size / 8.0, 2) AS two, round_even(p_size / 2.0, 0) AS none FROM part")
def half_even_rounding(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fn.half_even(F.col("p_size") / 8.0, 2).alias("two"), fn.half_even(F.col("p_size") / 2.0, 0).alias("none"))


# --- spatial and interval joins ---------------------------------------------------------------------


@query("SELECT id, region, printf('%.4f_%.4f', lon, lat) AS pixel FROM $points JOIN $boxes ON lon BETWEEN lon_min AND lon_max AND lat BETWEEN lat_min AND lat_max")
def region_bbox_fanout(spark, sf_dir):
    got = spatial.assign_boxes(adapters.points(spark, sf_dir), spatial.boxes(spark))
    return got.select("id", "region", fn.pixel_id(F.col("lon"), F.col("lat")).alias("pixel"))


_EDGES = ", ".join(f"('{n}', {a[0]}, {a[1]}, {b[0]}, {b[1]})" for n, rings in spatial.POLYGONS for ring in rings for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


@query(f"""SELECT id, polygon FROM $points, (SELECT * FROM (VALUES {_EDGES}) e(polygon, x1, y1, x2, y2)) WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY id, polygon HAVING count(*) % 2 = 1""")
def points_in_polygons(spark, sf_dir):
    return spatial.within(adapters.points(spark, sf_dir), spatial.polygons(spark)).select("id", "polygon")


@query(f"SELECT region, {shown('lon_min', 'lat_min', 'lon_max', 'lat_max')} FROM (SELECT region, min(lon) AS lon_min, min(lat) AS lat_min, max(lon) AS lon_max, max(lat) AS lat_max FROM $points JOIN $boxes ON lon BETWEEN lon_min AND lon_max AND lat BETWEEN lat_min AND lat_max GROUP BY ALL)")
def region_bounds(spark, sf_dir):
    """The box around the points of each region."""
    got = spatial.assign_boxes(adapters.points(spark, sf_dir), spatial.boxes(spark))
    return got.groupBy("region").agg(F.min("lon").alias("lon_min"), F.min("lat").alias("lat_min"), F.max("lon").alias("lon_max"), F.max("lat").alias("lat_max"))


@query(f"SELECT date, {shown(*adapters.INDICATORS)}, vintage FROM $wide JOIN (SELECT * FROM (VALUES " + ", ".join(f"(CAST({v} AS INTEGER), DATE '{a}', DATE '{b}')" for v, a, b in spatial.PERIODS) + ") p(vintage, first, last)) ON date BETWEEN first AND last")
def period_slices(spark, sf_dir):
    return spatial.assign_periods(adapters.indicators_wide(spark, sf_dir), spatial.periods(spark))


_VALID = """SELECT event_id, event_type, CAST(DATE '1995-01-01' + CAST(floor(epoch(ts - (SELECT min(ts) FROM events)) / 1080) AS INTEGER) AS DATE) AS first, CAST(DATE '1995-01-01' + CAST(floor(epoch(ts - (SELECT min(ts) FROM events)) / 1080) + event_id % 5 AS INTEGER) AS DATE) AS last FROM events"""


@query(f"SELECT event_id, event_type, count(*) AS n, round(sum(o_totalprice) + 2e-09, 4) + 0.0 AS total FROM orders JOIN ({_VALID}) ON CAST(o_orderdate AS DATE) BETWEEN first AND last GROUP BY ALL", digits=4)
def orders_in_validity(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")
    return intervals.interval_totals(orders, adapters.validity_periods(spark, sf_dir), "day", ["o_totalprice"]).withColumnRenamed("o_totalprice", "total")


_TURN = f"pow((1 - {projections.ECCENTRICITY} * sin(radians(lat))) / (1 + {projections.ECCENTRICITY} * sin(radians(lat))), {projections.ECCENTRICITY / 2})"


@query(f"""SELECT id, zone, round(a * radians(lon) + 2e-9, 4) + 0.0 AS x, round(a * ln(tan(pi() / 4 + radians(lat) / 2)) + 2e-9, 4) + 0.0 AS y_sphere, round(a * ln(tan(pi() / 4 + radians(lat) / 2) * {_TURN}) + 2e-9, 4) + 0.0 AS y_ellipsoid, {', '.join(f"round({c} + 2e-9, 8) + 0.0 AS {c}_{k}" for k in ('zone', 'sphere', 'ellipsoid') for c in ('lon', 'lat'))}
  FROM (SELECT *, CAST(floor((lon + 180) / 6) AS INTEGER) + 1 AS zone, {projections.AXIS} AS a FROM $points WHERE lon >= -180 AND lon < 180 AND abs(lat) < 84)""", digits=8)
def projected_points(spark, sf_dir):
    p = adapters.points(spark, sf_dir).filter((F.col("lon") >= -180) & (F.col("lon") < 180) & (F.abs("lat") < 84)).withColumn("zone", projections.zone_of(F.col("lon")))
    lon, lat, south = F.col("lon"), F.col("lat"), F.col("lat") < 0
    planes = {"zone": projections.to_zone(lon, lat, F.col("zone"), south), "sphere": projections.to_mercator(lon, lat), "ellipsoid": projections.to_mercator(lon, lat, ellipsoid=True)}
    systems = {"zone": F.when(south, projections.SOUTH).otherwise(projections.NORTH) + F.col("zone"), "sphere": F.lit(projections.WEB_MERCATOR), "ellipsoid": F.lit(projections.WORLD_MERCATOR)}
    flat = p.select("id", "zone", *[c.alias(f"{axis}_of_{k}") for k, pair in planes.items() for axis, c in zip("xy", pair, strict=True)], *[c.alias(f"system_{k}") for k, c in systems.items()])
    back = flat.select("*", *[projections.to_degrees(F.col(f"x_of_{k}"), F.col(f"y_of_{k}"), F.col(f"system_{k}")).alias(f"back_{k}") for k in planes])
    metres = {"x": "x_of_sphere", "y_sphere": "y_of_sphere", "y_ellipsoid": "y_of_ellipsoid"}
    return back.select("id", "zone", *[(F.round(F.col(c) + NUDGE, 4) + 0.0).alias(name) for name, c in metres.items()], *[F.col(f"back_{k}.{v}").alias(f"{axis}_{k}") for k in planes for v, axis in (("x", "lon"), ("y", "lat"))])


# --- profiles ------------------------------------------------------------------------------------------


@query(f"SELECT series, t, date, {shown('mp', digits=5)}, nn FROM $p12", digits=5)
def matrix_profile_m12(spark, sf_dir):
    return stages.region_profile(spark, sf_dir, 12)


@query(f"SELECT series, t, date, {shown('mp', digits=5)}, nn FROM $p24", digits=5)
def matrix_profile_m24(spark, sf_dir):
    return stages.region_profile(spark, sf_dir, 24)


@query(f"SELECT series, t, date, {shown('mp', digits=5)}, nn FROM $p12", digits=5)
def profile_in_sql(spark, sf_dir):
    table_functions.register(spark)
    return spark.sql("SELECT * FROM matrix_profile(TABLE(SELECT * FROM {rows}) PARTITION BY (series) ORDER BY (t), 12)", rows=stages.region_anomalies(spark, sf_dir))


_SIDES = f"SELECT series, t, date, {shown('mp', 'left_mp', 'right_mp', digits=5)}, nn, left_nn, right_nn FROM "


def _finite(df: DataFrame) -> DataFrame:
    """Distances without a neighbour as null."""
    return df.withColumns({c: F.when(F.col(c) != float("inf"), F.col(c)) for c in ("mp", "left_mp", "right_mp")})


@query(_SIDES + "(" + sided("$z12", 12).format("$z12") + ")", digits=5)
def matrix_profile_sides(spark, sf_dir):
    return _finite(tiles.tiled_profile(stages.region_anomalies(spark, sf_dir), 12))


@query(_SIDES + "(" + sided("$daily_z", DAYS).format(f"(SELECT * FROM $daily WHERE t <= (SELECT max(t) FROM $daily) - {DAYS - 1})") + ")", digits=5)
def daily_profile(spark, sf_dir):
    return _finite(tiles.tiled_profile(adapters.daily_prices(spark, sf_dir), DAYS, tile=512))


@query(f"SELECT series, t, date, {shown('mp', digits=5)}, nn FROM $ip12", digits=5)
def indicator_matrix_profile(spark, sf_dir):
    return stages.indicator_profile(spark, sf_dir, 12)


@query(f"SELECT series, rank, t, date, {shown('mp', digits=5)}, nn FROM $top12", digits=5)
def top_motifs(spark, sf_dir):
    return profile.best_windows(stages.region_profile(spark, sf_dir), 3, 3)


@query(f"SELECT series, rank, t, date, {shown('mp', digits=5)}, nn FROM $discords", digits=5)
def top_discords(spark, sf_dir):
    return profile.best_windows(stages.region_profile(spark, sf_dir), 3, 3, largest=True)


def _motif_groups(m: int, most: int = 3, matches: int = 10) -> str:
    """Groups in turn: the best window left, then its nearest windows one after another, each closing a zone."""
    zone = profile.exclusion(m)
    rounds, before = [], "SELECT series, mp AS open, greatest(list_avg(mp) - 2 * list_aggregate(mp, 'stddev_pop'), list_min(mp)) AS cut FROM (SELECT series, list(mp ORDER BY t) AS mp FROM $p12 GROUP BY ALL)"
    for rank in range(1, most + 1):
        first = f"SELECT b.*, list_transform(w.d, lambda v, j: CASE WHEN j = i + 1 THEN 0.0 ELSE v END) AS d FROM (SELECT *, list_position(open, list_min(open)) - 1 AS i, list_min(open) <= cut + 1e-12 AS live FROM ({before})) b JOIN $distances w ON w.series = b.series AND w.t = b.i"
        got = f"SELECT *, d AS free, CAST([] AS BIGINT[]) AS chosen, greatest(list_avg(d) - 2 * list_aggregate(d, 'stddev_pop'), list_min(d)) + 1e-12 AS within FROM ({first})"
        for _ in range(matches):
            got = f"""SELECT * EXCLUDE (place, near) REPLACE (CASE WHEN near THEN list_append(chosen, place - 1) ELSE chosen END AS chosen, CASE WHEN near THEN list_transform(free, lambda v, j: CASE WHEN abs(j - place) <= {zone} THEN 1e300 ELSE v END) ELSE free END AS free)
              FROM (SELECT *, list_position(free, list_min(free)) AS place, list_min(free) <= within AS near FROM ({got}))"""
        rounds.append(f"round{rank} AS MATERIALIZED ({got})")
        before = f"SELECT series, cut, CASE WHEN live THEN list_transform(open, lambda v, j: CASE WHEN len(list_filter(chosen, lambda c: abs(j - 1 - c) <= {zone})) > 0 THEN 1e300 ELSE v END) ELSE open END AS open FROM round{rank}"
    shown = " UNION ALL ".join(f"SELECT series, CAST({r} AS BIGINT) AS rank, i AS start, coalesce(chosen[2], -1) AS nn, d[chosen[1] + 1] AS distance, d[chosen[2] + 1] AS nn_distance FROM round{r} WHERE live" for r in range(1, most + 1))
    return f"SELECT * FROM (WITH {', '.join(rounds)} {shown})"


@query(f"SELECT series, rank, start, nn, {shown('distance', 'nn_distance', digits=5)} FROM ({_motif_groups(12)})", digits=5)
def motif_groups(spark, sf_dir):
    return profile.motifs(stages.region_anomalies(spark, sf_dir), 12)


@query(f"SELECT series, n, {shown('mean', 'std', 'least', 'most', digits=5)} FROM (SELECT series, count(*) AS n, avg(mp) AS mean, stddev_pop(mp) AS std, min(mp) AS least, max(mp) AS most FROM $p12 GROUP BY ALL)", digits=5)
def profile_summary(spark, sf_dir):
    return rolling.profile_summary(stages.region_profile(spark, sf_dir))


@query(f"SELECT series, t, date, {shown('mp', 'mpi_min', 'mpi_mean', digits=5)}, nn, anomalous FROM $indices", digits=5)
def profile_indices(spark, sf_dir):
    return rolling.profile_indices(stages.region_profile(spark, sf_dir))


@query(f"SELECT series, n, {shown('early_rate', 'late_rate')}, late_rate > early_rate AS grew FROM (SELECT series, count(*) AS n, count(*) FILTER (anomalous AND year(date) < 1998) / greatest(count(*) FILTER (year(date) < 1998), 1) AS early_rate, count(*) FILTER (anomalous AND year(date) >= 1998) / greatest(count(*) FILTER (year(date) >= 1998), 1) AS late_rate FROM $indices GROUP BY ALL)")
def anomaly_rates(spark, sf_dir):
    return rolling.anomaly_rates(profile_indices(spark, sf_dir), 1998)


# --- overlaps ----------------------------------------------------------------------------------------------


@query("SELECT series, indicator, start, other, lag FROM $pairs")
def overlap_pairs(spark, sf_dir):
    return stages.pairs(spark, sf_dir)


_RATES = """SELECT g.series, g.indicator, g.n_starts, coalesce(c.n, 0) AS n_matched, round(coalesce(c.n, 0) / greatest(g.n_starts, 1) + 2e-9, 6) + 0.0 AS fraction, coalesce(c.n, 0) > 0 AS coupled{1} FROM
  (SELECT a.series, i.series AS indicator, count(DISTINCT a.t) AS n_starts FROM $top{0} a, (SELECT DISTINCT series FROM $itop{0}) i GROUP BY ALL) g LEFT JOIN
  (SELECT a.series, b.series AS indicator, count(DISTINCT a.t) AS n FROM $top{0} a JOIN $itop{0} b ON abs(a.t - b.t) <= {0} GROUP BY ALL) c ON g.series = c.series AND g.indicator = c.indicator"""


@query(_RATES.format(12, ""))
def overlap_exists(spark, sf_dir):
    mine = stages.starts(stages.region_profile(spark, sf_dir), 12)
    others = stages.starts(stages.indicator_profile(spark, sf_dir), 12).withColumnRenamed("series", "indicator")
    return overlap.overlap_rates(mine, others, 12)


@query(" UNION ALL ".join(_RATES.format(m, f", {m} AS m") for m in (12, 24, 36, 48)))
def window_sweep(spark, sf_dir):
    return stages.sweep(spark, sf_dir)


@query(" UNION ALL ".join(_RATES.format(m, f", {m} AS m").replace("$top", "$rtop").replace("$itop", "$irtop") for m in (12, 24, 36, 48)))
def window_sweep_rolling(spark, sf_dir):
    """The sweep over anomalies from a centred year's mean, on both sides."""
    return stages.sweep(spark, sf_dir, rolling_mean=True)


@query(f"SELECT series, indicator, n_overlaps, n_matched, {shown('median_lag', 'p025', 'p975')} FROM (SELECT series, indicator, count(*) AS n_overlaps, count(DISTINCT start) AS n_matched, CAST(median(lag) AS DOUBLE) AS median_lag, quantile_cont(CAST(lag AS DOUBLE), 0.025) AS p025, quantile_cont(CAST(lag AS DOUBLE), 0.975) AS p975 FROM $pairs GROUP BY ALL)")
def lag_summary(spark, sf_dir):
    return overlap.lag_summary(stages.pairs(spark, sf_dir))


@query(f"SELECT series, indicator, n, {shown('ci_lower', 'ci_upper')} FROM (SELECT series, indicator, quantile_cont(m, 0.025) AS ci_lower, quantile_cont(m, 0.975) AS ci_upper FROM (SELECT series, indicator, draw, median(lag) AS m FROM $draws GROUP BY ALL) GROUP BY ALL) JOIN (SELECT series, indicator, count(*) AS n FROM $pairs GROUP BY ALL) USING (series, indicator)")
def lag_intervals(spark, sf_dir):
    return overlap.lag_intervals(stages.pairs(spark, sf_dir))


@query("SELECT series, indicator, year, n FROM $annual")
def annual_overlap_counts(spark, sf_dir):
    return overlap.annual_counts(stages.pairs(spark, sf_dir), stages.monthly(spark, sf_dir), 1995, 2001)


@query("SELECT lag, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(range(-12, 13)) AS BIGINT) AS lag) LEFT JOIN (SELECT lag, count(*) AS n FROM $pairs GROUP BY ALL) USING (lag)")
def lag_histogram(spark, sf_dir):
    counts = stages.pairs(spark, sf_dir).groupBy("lag").agg(F.count(F.lit(1)).alias("n"))
    return spark.range(-12, 13).select(F.col("id").alias("lag")).join(counts, "lag", "left").fillna(0, ["n"])


# --- tests and trends -------------------------------------------------------------------------------------------


def _annual_split(spark, sf_dir):
    return annual_overlap_counts(spark, sf_dir).select("series", "indicator", (F.col("year") < 1998).alias("early"), F.col("n").cast("double").alias("value"))


_MWU = f"SELECT *, CASE WHEN n1 > 0 AND n2 > 0 THEN {greater('u', 'n1', 'n2', 'ties')} END AS p FROM $mwu"


@query(f"SELECT series, indicator, n1, n2, {shown('u', 'ties', 'mean1', 'mean2', 'effect', 'p')}, CASE WHEN mean1 > mean2 THEN 'early>late' ELSE 'early<=late' END AS direction FROM ({_MWU})")
def mwu_shift(spark, sf_dir):
    return stats.mann_whitney(_annual_split(spark, sf_dir))


@query(f"""SELECT series, indicator, {shown('r', 'slope', 'p')}, CASE WHEN round(r, 9) < 0 THEN 'decreasing' ELSE 'increasing' END AS direction FROM (SELECT *, {t_five('r')} AS p FROM (
  SELECT series, indicator, CASE WHEN stddev_pop(n) > 0 THEN corr(n, year) END AS r, regr_slope(n, year) AS slope FROM $annual GROUP BY ALL))""")
def annual_trend(spark, sf_dir):
    return stats.annual_trend(annual_overlap_counts(spark, sf_dir))


def _rebuilt(p: str, ones1: str, ones2: str) -> str:
    """The tests of ``p`` with f: the p of samples listed value by value, by comparing every pair of values."""
    return f"""SELECT *, CASE WHEN n1 > 0 AND n2 > 0 THEN {greater('fu', 'n1', 'n2', '(pow(f1, 3) - f1 + pow(f0, 3) - f0)')} END AS f FROM (
      SELECT *, list_sum(list_transform(one, lambda x: list_sum(list_transform(two, lambda y: CASE WHEN x > y THEN 1.0 WHEN x = y THEN 0.5 ELSE 0 END)))) AS fu, len(list_filter(list_concat(one, two), lambda x: x = 1)) AS f1, len(list_filter(list_concat(one, two), lambda x: x = 0)) AS f0 FROM (
        SELECT *, list_transform(range(0, n1), lambda i: CASE WHEN i < {ones1} THEN 1 ELSE 0 END) AS one, list_transform(range(0, n2), lambda i: CASE WHEN i < {ones2} THEN 1 ELSE 0 END) AS two FROM ({p})))"""


_OWN_FLOOR = f"SELECT * EXCLUDE (one, two, fu, f1, f0) RENAME (f AS floor_p) FROM ({_rebuilt(_MWU, 'round_even(mean1 * n1, 0)', 'round_even(mean2 * n2, 0)')})"
_FLOORS = f"SELECT * EXCLUDE (one, two, fu, f1, f0) RENAME (f AS global_floor_p) FROM ({_rebuilt(_OWN_FLOOR, 'n1', '0')})"


@query(f"""SELECT series, indicator, n1, n2, {shown('u', 'ties', 'mean1', 'mean2', 'effect', 'p', 'floor_p', 'global_floor_p')}, CASE WHEN mean1 > mean2 THEN 'early>late' ELSE 'early<=late' END AS direction,
  coalesce(abs(p - floor_p) < 1e-6, false) AS at_floor, coalesce(abs(p - global_floor_p) < 1e-6, false) AS at_global_floor, coalesce(p < 0.05, false) AS significant FROM ({_FLOORS})""")
def floor_flags(spark, sf_dir):
    return stats.conditional_floor(stats.mann_whitney(_annual_split(spark, sf_dir)))


@query("SELECT count(*) AS n, count(*) FILTER (p < 0.05) AS plain, count(*) FILTER (p_hamed_rao < 0.05) AS corrected, count(*) FILTER (p < 0.05 AND p_hamed_rao >= 0.05) AS lost, count(*) FILTER (p >= 0.05 AND p_hamed_rao < 0.05) AS gained FROM $corrected")
def significance_changes(spark, sf_dir):
    return stats.significance_changes(corrected_trends(spark, sf_dir))


_EXACT = """SELECT m.series, m.indicator, least(1.0, 2.0 * sum(c) FILTER (o.u >= greatest(floor(m.u), m.n1 * m.n2 - floor(m.u))) / sum(c)) AS p_exact FROM {0} m JOIN $orders_of_ranks o ON o.n = m.n1 + m.n2 AND o.n1 = m.n1 GROUP BY ALL"""


@query(f"SELECT m.series, m.indicator, {shown('u', 'p', 'p_exact')} FROM ({_MWU}) m LEFT JOIN ({_EXACT.format('$mwu')}) e ON m.series = e.series AND m.indicator = e.indicator")
def mwu_p_values(spark, sf_dir):
    return stats.with_exact_p(stats.mann_whitney(_annual_split(spark, sf_dir))).select("series", "indicator", "u", "p", "p_exact")


@query(f"""SELECT k, n1, n2, u, ties, {shown('p')} FROM (SELECT *, {greater('u', 'n1', 'n2', 'ties')} AS p FROM (
  SELECT k, n1, n2, CAST(k * n2 + (n1 - k) * n2 / 2.0 AS DOUBLE) AS u, CAST(pow(n1 + n2 - k, 3) - (n1 + n2 - k) + pow(k, 3) - k AS DOUBLE) AS ties FROM (SELECT n1, n2, CAST(unnest(range(0, n1 + 1)) AS BIGINT) AS k FROM (SELECT DISTINCT n1, n2 FROM $mwu))))""")
def mwu_floor_grid(spark, sf_dir):
    return stats.floor_grid(stats.mann_whitney(_annual_split(spark, sf_dir)))


@query(f"SELECT series, indicator, date, n_row, {shown('r', 'p')} FROM (SELECT *, {t_even('r', 36)} AS p FROM $pearson)")
def rolling_pearson(spark, sf_dir):
    return rolling.rolling_pearson(stages.aligned(spark, sf_dir)).withColumn("n_row", F.col("n_row").cast("long"))


_MKP = f"SELECT *, 2 * {normal_tail('abs(z)')} AS p FROM $mk"


@query(f"SELECT series, indicator, s, n, {shown('slope', 'intercept', 'var', 'z', 'tau', 'p')}, CASE WHEN abs(z) <= 1.959964 THEN 'no trend' WHEN z > 0 THEN 'increasing' ELSE 'decreasing' END AS trend FROM ({_MKP})")
def mann_kendall(spark, sf_dir):
    return stats.mann_kendall(rolling_pearson(spark, sf_dir), x="r")


_FDR = f"""SELECT series, indicator, n, p, p_bh, p <= threshold AS rejected FROM (
  SELECT *, least(1.0, min(p * f / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_bh, coalesce(max(CASE WHEN p <= k * 0.05 / f THEN p END) OVER (), -1) AS threshold FROM (
    SELECT series, indicator, n, p, count(*) OVER () AS f, row_number() OVER (ORDER BY p) AS k FROM ({_MKP})))"""


@query(f"SELECT series, indicator, n, {shown('p', 'p_bh')}, rejected FROM ({_FDR})")
def bh_fdr(spark, sf_dir):
    return stats.fdr(mann_kendall(spark, sf_dir).select("series", "indicator", "n", "p"))


@query(f"SELECT count(*) AS n_tests, count(*) FILTER (p < 0.05) AS n_uncorrected_sig, count(*) FILTER (rejected) AS n_fdr_sig, CAST(0.05 AS DOUBLE) AS fdr_level_q, 'Benjamini-Hochberg' AS correction FROM ({_FDR})")
def fdr_summary(spark, sf_dir):
    return stats.fdr_summary(bh_fdr(spark, sf_dir))


@query(f"SELECT series, indicator, n, {shown('p', 'p_hamed_rao', 'factor', 'p_block')} FROM $corrected")
def corrected_trends(spark, sf_dir):
    return stats.corrected_trends(rolling_pearson(spark, sf_dir).withColumnRenamed("r", "x"))


@query(f"SELECT series, indicator, lag, n, {shown('r')} FROM $lags")
def xcorr_lags(spark, sf_dir):
    return correlate.cross_correlation(stages.aligned(spark, sf_dir))


_PEAK = "SELECT series, indicator, n, arg_max(lag, (round(abs(r), 12), -lag)) AS peak_lag, arg_max(r, (round(abs(r), 12), -lag)) AS peak_r FROM $lags GROUP BY ALL"


@query(f"""SELECT series, indicator, n, peak_lag, {shown('peak_r', 'ci_lower', 'ci_upper')} FROM (
  SELECT *, tanh(z - c) AS ci_lower, tanh(z + c) AS ci_upper FROM (SELECT *, atanh(greatest(least(peak_r, 0.9999), -0.9999)) AS z, ({T975}) / sqrt(n - 3) AS c FROM ({_PEAK})))""")
def xcorr_peak(spark, sf_dir):
    return correlate.correlation_peak(xcorr_lags(spark, sf_dir))


_COMPARED = f"""SELECT series, indicator, mp_lag, peak_lag, CASE WHEN abs(mp_lag - peak_lag) <= 2 THEN 'agree' ELSE 'disagree' END AS lag_agreement FROM
  ({_PEAK}) LEFT JOIN (SELECT series, indicator, CAST(median(lag) AS DOUBLE) AS mp_lag FROM $pairs GROUP BY ALL) USING (series, indicator)"""


@query(f"SELECT series, indicator, {shown('mp_lag')}, peak_lag, lag_agreement FROM ({_COMPARED})")
def method_comparison(spark, sf_dir):
    peak = xcorr_peak(spark, sf_dir).select("series", "indicator", "peak_lag")
    motif = overlap.lag_summary(stages.pairs(spark, sf_dir)).select("series", "indicator", F.col("median_lag").alias("mp_lag"))
    return peak.join(motif, ["series", "indicator"], "left").withColumn("lag_agreement", fn.agreement(F.col("mp_lag"), F.col("peak_lag")))


@query(f"SELECT {shown('share')}, n FROM (SELECT avg(CASE WHEN lag_agreement = 'agree' THEN 1.0 ELSE 0.0 END) AS share, count(*) AS n FROM ({_COMPARED}))")
def agreement_share(spark, sf_dir):
    agree = F.when(F.col("lag_agreement") == "agree", 1.0).otherwise(0.0)
    return method_comparison(spark, sf_dir).agg(F.avg(agree).alias("share"), F.count(F.lit(1)).alias("n"))


# --- recent trend of the profiles -----------------------------------------------------------------------


@query(f"SELECT series, year, {shown('mpi_min', 'mpi_mean', 'n_anomalous', digits=5)} FROM $yearly", digits=5)
def annual_indices(spark, sf_dir):
    return rolling.annual_indices(rolling.profile_indices(stages.region_profile(spark, sf_dir)))


@query(f"SELECT series, date, {shown('mpi_min', 'mpi_mean', digits=5)}, count(*) FILTER (anomalous) OVER (PARTITION BY series, year(date)) AS n_anomalous FROM $indices", digits=5)
def annual_count_by_month(spark, sf_dir):
    return rolling.with_annual_count(rolling.profile_indices(stages.region_profile(spark, sf_dir)))


_RECENT = """SELECT series, indicator, count(*) FILTER (early) AS n1, count(*) FILTER (NOT early) AS n2, avg(value) FILTER (early) AS mean1, avg(value) FILTER (NOT early) AS mean2,
  (SELECT sum(CASE WHEN round(a.value, 9) > round(b.value, 9) THEN 1.0 WHEN round(a.value, 9) = round(b.value, 9) THEN 0.5 ELSE 0 END) FROM $recent a JOIN $recent b ON a.series = b.series AND a.indicator = b.indicator AND a.early AND NOT b.early WHERE a.series = r.series AND a.indicator = r.indicator) AS u
  FROM $recent r GROUP BY ALL"""


@query(f"SELECT series, indicator, n1, n2, {shown('u', 'effect', 'mean1', 'mean2', 'p', digits=5)}, CASE WHEN mean2 > mean1 THEN 'increasing' ELSE 'decreasing' END AS direction, coalesce(p < 0.05, false) AS significant FROM (SELECT m.*, p_exact AS p, 1 - 2 * u / (n1 * n2) AS effect FROM ({_RECENT}) m LEFT JOIN ({_EXACT.format('(' + _RECENT + ')')}) e ON m.series = e.series AND m.indicator = e.indicator)", digits=5)
def recent_trend(spark, sf_dir):
    got = rolling.recent_rows(rolling.annual_indices(rolling.profile_indices(stages.region_profile(spark, sf_dir))), 1998)
    tests = stats.mann_whitney(got.withColumn("value", F.round("value", 9)), exact=True)
    return tests.drop("ties", "direction").withColumns({"direction": F.when(F.col("mean2") > F.col("mean1"), "increasing").otherwise("decreasing"), "significant": F.coalesce(F.col("p") < 0.05, F.lit(False))})


@query(f"SELECT series, indicator, n, {shown('dominant_period', 'coh_6', 'coh_12', 'coh_24')} FROM (SELECT series, indicator, n, arg_max(period, (c, -idx)) AS dominant_period, " + ", ".join(f"avg(c) FILTER (period BETWEEN {b / 2} AND {b * 1.5}) AS coh_{b}" for b in (6, 12, 24)) + " FROM (SELECT series, indicator, n, idx, 4 * pi() * s / (6 + sqrt(38)) AS period, avg(c) AS c FROM $coherence GROUP BY ALL) GROUP BY ALL)")
def wavelet_bands(spark, sf_dir):
    return correlate.coherence_bands(stages.aligned(spark, sf_dir))


#: Penalty of a segment, and a lighter one under which the short monthly series have breaks.
_PENALTY, _LIGHT = 10.0, 2.0
_EXTREME = f"CAST(year(date) AS INTEGER) IN {changes.EXTREME_YEARS}"


def _pelt(penalty: float) -> str:
    """Least cost of each prefix from those of all shorter ones: best[b + 1] is that of the first b values."""
    return f"""WITH RECURSIVE dp AS (SELECT DISTINCT series, CAST(0 AS BIGINT) AS b, [CAST(-{penalty} AS DOUBLE)] AS best, [CAST(0 AS BIGINT)] AS back FROM $segment_costs
  UNION ALL SELECT series, b, list_append(best, m), list_append(back, list_position(totals, m) - 1) FROM (SELECT *, list_min(totals) AS m FROM (SELECT d.series, c.b, d.best, d.back,
    list_transform(range(0, c.b), lambda a: CASE WHEN c.b - a >= 3 AND (a = 0 OR a >= 3) THEN d.best[a + 1] + c.costs[a + 1] + {penalty} ELSE 1e300 END) AS totals FROM dp d JOIN $segment_costs c ON c.series = d.series AND c.b = d.b + 1)))"""


def _pelt_breaks(penalty: float) -> str:
    longest = "(SELECT series, arg_max(back, b) AS back, max(b) AS n FROM dp GROUP BY series)"
    return f"""SELECT w.series, 'pelt' AS method, w.t, m.date, {_EXTREME} AS near_extreme FROM ({_pelt(penalty)}, walk AS (SELECT series, back, back[n + 1] AS cut FROM {longest} UNION ALL SELECT series, back, back[cut + 1] FROM walk WHERE cut > 0)
  SELECT series, cut - 1 AS t FROM walk WHERE cut > 0) w JOIN $monthly m ON m.series = w.series AND m.t = w.t"""


def _binseg(rounds: int = 3, least: int = 3) -> str:
    """Cuts with the largest gain in squared error, one round after another."""
    sse = lambda a, b: f"(s2[{b} + 1] - s2[{a} + 1] - pow(s1[{b} + 1] - s1[{a} + 1], 2) / ({b} - {a}))"
    got = "SELECT series, list_concat([0.0], list(c1 ORDER BY t)) AS s1, list_concat([0.0], list(c2 ORDER BY t)) AS s2, [0, count(*)] AS cuts, count(*) AS n FROM (SELECT series, t, sum(x) OVER o AS c1, sum(x * x) OVER o AS c2 FROM $monthly WINDOW o AS (PARTITION BY series ORDER BY t)) GROUP BY series"
    for _ in range(rounds):
        gains = f"SELECT series, s1, s2, cuts, n, c, list_max(list_filter(cuts, lambda v: v <= c)) AS a, list_min(list_filter(cuts, lambda v: v > c)) AS b FROM (SELECT *, unnest(range(1, n)) AS c FROM ({got}))"
        best = f"SELECT series, any_value(s1) AS s1, any_value(s2) AS s2, any_value(n) AS n, list_sort(list_append(any_value(cuts), arg_max(c, (gain, -c)))) AS cuts FROM (SELECT *, {sse('a', 'b')} - {sse('a', 'c')} - {sse('c', 'b')} AS gain FROM ({gains}) WHERE c - a >= {least} AND b - c >= {least}) GROUP BY series"
        got = best
    return f"SELECT w.series, 'binseg' AS method, w.t, m.date, {_EXTREME} AS near_extreme FROM (SELECT series, c - 1 AS t FROM (SELECT series, n, unnest(cuts) AS c FROM ({got})) WHERE c > 0 AND c < n) w JOIN $monthly m ON m.series = w.series AND m.t = w.t"


@query(f"SELECT series, method, t, date, near_extreme FROM ({_binseg()})")
def binseg_breaks(spark, sf_dir):
    return changes.break_points(stages.monthly(spark, sf_dir), "binseg")


@query(f"SELECT series, method, t, date, near_extreme FROM ({_pelt_breaks(_PENALTY)})")
def pelt_breaks(spark, sf_dir):
    return changes.break_points(stages.monthly(spark, sf_dir), "pelt", penalty=_PENALTY)


@query(f"SELECT series, method, t, date, near_extreme FROM ({_pelt_breaks(_LIGHT)})")
def pelt_breaks_light(spark, sf_dir):
    return changes.break_points(stages.monthly(spark, sf_dir), "pelt", penalty=_LIGHT)


@query(f"SELECT series, b - 1 AS t, {shown('cost')}, start FROM (SELECT series, unnest(range(3, n + 1)) AS b, unnest(best[4:]) AS cost, unnest(back[4:]) AS start FROM ({_pelt(_PENALTY)} SELECT series, arg_max(best, b) AS best, arg_max(back, b) AS back, max(b) AS n FROM dp GROUP BY series))")
def segmentation_costs(spark, sf_dir):
    return changes.segmentation_costs(stages.monthly(spark, sf_dir), penalty=_PENALTY)


@query(f"""SELECT series, method, n_breaks, n_near, {shown('fraction_near')}, years FROM (SELECT series, method, count(*) AS n_breaks, count(*) FILTER (near_extreme) AS n_near, count(*) FILTER (near_extreme) / count(*) AS fraction_near, array_to_string(list_sort(list(DISTINCT CAST(year(date) AS VARCHAR))), ',') AS years
  FROM (SELECT * FROM ({_binseg()}) UNION ALL SELECT * FROM ({_pelt_breaks(_PENALTY)})) GROUP BY ALL)""")
def break_summary(spark, sf_dir):
    return changes.break_summary(binseg_breaks(spark, sf_dir).unionByName(pelt_breaks(spark, sf_dir)))


def _null(observed: str) -> str:
    """The null by listing all choices of three starts: what they cover, then how many of three others fall inside."""
    m, k, most = 12, 3, 12
    choose = lambda n, r: "(CASE " + " ".join(f"WHEN {r} = {i} THEN " + (" * ".join(f"({n} - {j})" for j in range(i)) or "1.0") + f" / {[1.0, 1.0, 2.0, 6.0][i]}" for i in range(k + 1)) + " END)"
    return f"""SELECT * FROM (WITH cases AS (SELECT series, count(*) AS length FROM $monthly GROUP BY ALL), sizes AS (SELECT DISTINCT length, length - {m} + 1 AS n FROM cases),
      places AS (SELECT length, n, unnest(range(0, n)) AS t FROM sizes),
      covered AS (SELECT a.length, a.n, least(a.t + {most}, a.n - 1) - greatest(a.t - {most}, 0) + 1 + greatest(least(b.t + {most}, a.n - 1) - greatest(b.t - {most}, least(a.t + {most}, a.n - 1) + 1) + 1, 0)
        + greatest(least(c.t + {most}, a.n - 1) - greatest(c.t - {most}, least(b.t + {most}, a.n - 1) + 1) + 1, 0) AS c FROM places a JOIN places b ON a.length = b.length AND a.t < b.t JOIN places c ON a.length = c.length AND b.t < c.t),
      chances AS (SELECT length, x, sum(w * {choose('c', 'x')} * {choose('(n - c)', f'({k} - x)')} / {choose('n', str(k))}) / sum(w) AS p FROM (SELECT length, n, c, count(*) AS w FROM covered GROUP BY ALL), (SELECT unnest(range(0, {k + 1})) AS x) GROUP BY ALL),
      summed AS (SELECT *, sum(p) OVER (PARTITION BY length ORDER BY x) AS upto FROM chances),
      null_of AS (SELECT length, sum(p * x) AS null_mean, sqrt(sum(p * x * x) - pow(sum(p * x), 2)) AS null_std, CAST(min(x) FILTER (upto + 1e-12 >= 0.95) AS DOUBLE) AS p95, CAST(min(x) FILTER (upto + 1e-12 >= 0.99) AS DOUBLE) AS p99 FROM summed GROUP BY ALL),
      seen AS ({observed})
      SELECT series, indicator, length, CAST({m} AS BIGINT) AS m, CAST({k} AS BIGINT) AS k, CAST({most} AS BIGINT) AS most, observed, {shown('null_mean', 'null_std', 'p95', 'p99')}, round((SELECT coalesce(sum(p), 0) FROM chances q WHERE q.length = cases.length AND x >= observed) + 2e-9, 6) + 0.0 AS p_perm, observed > p95 AS exceeds_p95, observed > p99 AS exceeds_p99
      FROM seen JOIN cases USING (series) JOIN null_of USING (length))"""


_SEEN = """SELECT g.series, g.indicator, coalesce(n, 0) AS observed FROM (SELECT DISTINCT a.series, b.series AS indicator FROM $top12 a, $itop12 b) g LEFT JOIN (SELECT series, indicator, {0} AS n FROM $pairs GROUP BY ALL) c ON g.series = c.series AND g.indicator = c.indicator"""


def _null_model(spark: SparkSession, sf_dir: str, by_pairs: bool) -> DataFrame:
    mine = stages.starts(stages.region_profile(spark, sf_dir), 12)
    others = stages.starts(stages.indicator_profile(spark, sf_dir), 12).withColumnRenamed("series", "indicator")
    length = stages.monthly(spark, sf_dir).groupBy("series").agg(F.count(F.lit(1)).alias("length"))
    return stats.null_model(overlap.null_cases(mine, others, length, 12, 3, 12, by_pairs)).drop("chances")


@query(_null(_SEEN.format("count(DISTINCT start)")))
def null_model(spark, sf_dir):
    return _null_model(spark, sf_dir, by_pairs=False)


@query(_null(_SEEN.format("count(*)")))
def null_model_of_pairs(spark, sf_dir):
    """As the first, but what is observed are pairs, more than one a start."""
    return _null_model(spark, sf_dir, by_pairs=True)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region anomalies to matrix profiles to motif starts, joined with the indicators' within a band of lags."""
    return stages.pairs(spark, sf_dir)
