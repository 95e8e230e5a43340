"""Relational operators and sources on small tables."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import EngineConfig
from tessera.functions import columns as fn
from tessera.functions import counter, mathx, projections
from tessera.operators import bands, intervals, overlap, profile, quadtree, rolling, series, spatial, stats, tiles
from tessera.plans import stages
from tessera.sources import readers, writers
from tessera.streaming import monthly


def months(n, first=(2000, 1)):
    return [dt.date(first[0] + (first[1] - 1 + i) // 12, (first[1] - 1 + i) % 12 + 1, 1) for i in range(n)]


def frame(spark, values, name="s"):
    return spark.createDataFrame([(name, d, i, v) for i, (d, v) in enumerate(zip(months(len(values)), values))], "series string, date date, t long, x double")


def test_parse_long_ascii(spark):
    lines = spark.createDataFrame([("2000 1 0.5",), (" 2000  2 -99.90",), ("YEAR MONTH VALUE",), ("",), ("2000 13 1",), ("2001 3 x",), (None,)], "value string")
    got = {(r.date, r.value) for r in readers.parse_long_ascii(lines, "AO").collect()}
    assert got == {(dt.date(2000, 1, 1), 0.5), (dt.date(2000, 2, 1), None), (dt.date(2001, 3, 1), None)}


def test_parse_seasonal_ascii(spark):
    lines = spark.createDataFrame([("DJF 2000 25.1 -1.7",), ("ndj 2001 26 0.3",), ("SEAS YR TOTAL ANOM",), ("ABC 2000 1 1",)], "value string")
    assert {(r.date, r.value) for r in readers.parse_seasonal_ascii(lines, "ENSO").collect()} == {(dt.date(2000, 1, 1), -1.7), (dt.date(2001, 12, 1), 0.3)}


def test_read_observations(spark, tmp_path):
    (tmp_path / "kndvi_a.csv").write_text("Region,date,pixel_id,lat,lon,kNDVI\nr,2001-03-09,p,1,2,0.5\nr,bad,p,1,2,0.5\nr,2001-04-01,p,1,2,NaN\n")
    got = readers.read_observations(spark, f"{tmp_path}/*.csv").orderBy("date").collect()
    assert [(r.date, r.kndvi, r.latitude) for r in got] == [(dt.date(2001, 3, 1), 0.5, 1.0), (dt.date(2001, 4, 1), None, 1.0)]
    with pytest.raises(ValueError, match="missing columns"):
        readers.normalize_columns(spark.range(1), ("kndvi",))
    with pytest.raises(ValueError, match="neither"):
        readers.read_observations(spark, "x.txt")


def test_null_indicator_column_is_an_error(spark, tmp_path):
    (tmp_path / "c.csv").write_text("date,AO,NAO\n2000-01-01,1.0,\n")
    with pytest.raises(ValueError, match="NAO"):
        readers.read_wide_indicators(spark, str(tmp_path / "c.csv"), ("AO", "NAO"))


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.23456, [1, 2]), ("b", 2.0, [])], "k string, v double, l array<int>")
    writers.write_csv(df, f"{tmp_path}/c", digits=2)
    assert {(r.k, r.v, r.l) for r in spark.read.csv(f"{tmp_path}/c", header=True).collect()} == {("a", "1.23", "[1,2]"), ("b", "2.00", "[]")}
    writers.write_parquet(df, f"{tmp_path}/p", ("k",))
    assert spark.read.parquet(f"{tmp_path}/p").filter("k = 'a'").count() == 1
    assert "| a |" in writers.data_card(df.select("k"), "t")


def test_slices_are_folders_of_periods_with_rows(spark, tmp_path):
    rows = spark.createDataFrame([(d,) for d in months(24)], "date date")
    spans = [(1, dt.date(2000, 1, 1), dt.date(2000, 12, 31)), (2, dt.date(2000, 7, 1), dt.date(2001, 6, 30)), (3, dt.date(2010, 1, 1), dt.date(2011, 1, 1))]
    writers.write_slices(rows, spark.createDataFrame(spans, "vintage int, first date, last date"), f"{tmp_path}/s")
    assert {(r.vintage, r["count"]) for r in spark.read.parquet(f"{tmp_path}/s").groupBy("vintage").count().collect()} == {(1, 12), (2, 12)}
    assert not (tmp_path / "s" / "vintage=3").exists()


def test_tiles(spark, tmp_path):
    nir = np.arange(100, dtype="<i2")
    (tmp_path / "MOD.A2001032.h11v08.raw").write_bytes(nir.tobytes() + (nir * 2).astype("<i2").tobytes() + np.zeros(100, np.int8).tobytes())
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = readers.decode_tiles(files, 10, 10).orderBy("row", "col").collect()
    assert [(r.h, r.v, r.row, r.col, r.nir, r.red) for r in got] == [(11, 8, 0, 0, 0, 0), (11, 8, 0, 5, 5, 10), (11, 8, 5, 0, 50, 100), (11, 8, 5, 5, 55, 110)]
    name = files.select(fn.date_from_name(F.col("path")).alias("d")).first()
    assert name.d == dt.date(2001, 2, 1)


def test_gaps(spark):
    s = frame(spark, [None, 1.0, None, 3.0, None])
    assert [r.x for r in series.interpolate(s).orderBy("t").collect()] == [1.0, 1.0, 2.0, 3.0, 3.0]
    assert [r.x for r in series.interpolate(s, edges=False).orderBy("t").collect()] == [None, 1.0, 2.0, 3.0, 3.0]
    assert [r.x for r in series.fill_both_ways(s).orderBy("t").collect()] == [1.0, 1.0, 1.0, 3.0, 3.0]


def test_means_skip_nan(spark):
    obs = spark.createDataFrame([("s", 1, dt.date(2000, 1, 1), 1.0), ("s", 2, dt.date(2000, 1, 1), float("nan")), ("s", 1, dt.date(2000, 3, 1), 2.0)], "series string, pixel long, date date, value double")
    assert [(r.t, r.x) for r in series.densify(series.mean_series(obs)).orderBy("t").collect()] == [(0, 1.0), (1, None), (2, 2.0)]


def test_centred_window_is_six_back_five_ahead(spark):
    s = frame(spark, [float(i * i) for i in range(20)])
    row = {r.t: r.anomaly for r in series.rolling_anomaly(s).collect()}
    assert row[10] == pytest.approx(100 - np.mean([i * i for i in range(4, 16)]))
    assert row[0] == pytest.approx(-np.mean([i * i for i in range(6)]))


def test_rolling_pearson_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=50), rng.normal(size=50)
    pairs = spark.createDataFrame([("s", "i", d, float(a), float(b)) for d, a, b in zip(months(50), x, y)], "series string, indicator string, date date, x double, y double")
    got = [r.r for r in rolling.rolling_pearson(pairs).orderBy("date").collect()]
    assert np.allclose(got, [np.corrcoef(x[i : i + 36], y[i : i + 36])[0, 1] for i in range(15)])
    flat = pairs.withColumn("x", F.lit(1.0))
    assert {r.r for r in rolling.rolling_pearson(flat).collect()} == {0.0}
    assert rolling.rolling_pearson(pairs.limit(10)).count() == 0


def test_profile_forms_agree(spark):
    rng = np.random.default_rng(3)
    s = frame(spark, [float(v) for v in rng.normal(size=70)])
    a = profile.self_join(s, 12).orderBy("t").collect()
    b = profile.matrix_profile(s, 12).orderBy("t").collect()
    assert [r.nn for r in a] == [r.nn for r in b] and np.allclose([r.mp for r in a], [r.mp for r in b], atol=1e-6)
    p = profile.matrix_profile(s, 12)
    key = lambda df: sorted((r.rank, r.t) for r in df.collect())
    assert key(profile.top_windows(p, 3, 3)) == key(profile.best_windows(p, 3, 3))
    assert key(profile.top_windows(p, 3, 3, True)) == key(profile.best_windows(p, 3, 3, True))
    assert profile.matrix_profile(s.limit(20), 12).count() == 0


def test_lag_pairs(spark):
    mine = spark.createDataFrame([("a", 5), ("a", 40), ("a", 5)], "series string, t long")
    others = spark.createDataFrame([("i", 0), ("i", 17), ("i", 18), ("i", 60)], "indicator string, t long")
    assert {(r.start, r.other, r.lag) for r in overlap.lag_pairs(mine, others, 12).collect()} == {(5, 0, -5), (5, 17, 12)}
    row = overlap.overlap_rates(mine, others, 12).first()
    assert (row.n_starts, row.n_matched, row.fraction, row.coupled) == (2, 1, 0.5, True)


def test_mann_whitney_statistic(spark):
    rows = [("s", "i", True, v) for v in [1.0, 1.0] + [0.0] * 8] + [("s", "i", False, 0.0)] * 16
    got = stats.mann_whitney(spark.createDataFrame(rows, "series string, indicator string, early boolean, value double")).first()
    assert (got.u, got.n1, got.n2) == (96.0, 10, 16) and got.effect == pytest.approx(-0.2) and got.p == pytest.approx(0.038473, abs=1e-6)


def test_mann_kendall_matches_kernel(spark):
    x = np.round(np.random.default_rng(4).normal(size=40), 1)
    df = spark.createDataFrame([("s", "i", d, float(v)) for d, v in zip(months(40), x)], "series string, indicator string, date date, x double")
    got = stats.mann_kendall(df).first()
    s, var = stats.kendall(x)
    assert got.s == s and got["var"] == pytest.approx(var) and got.slope == pytest.approx(stats.sen_slope(x))
    assert stats.mann_kendall(df.limit(3)).count() == 0


def test_fdr(spark):
    p = [0.01, 0.04, None, 0.03, 0.5, float("nan")]
    got = stats.fdr(spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double")).orderBy("i").collect()
    assert [r.p_bh if r.p_bh is None else round(r.p_bh, 6) for r in got] == [0.04, 0.053333, None, 0.053333, 0.5, None]
    assert [r.rejected for r in got] == [True, False, False, False, False, False]


def test_points_in_polygons_excludes_edges_and_holes(spark):
    points = spark.createDataFrame([(1, 20.0, 0.0), (2, 0.0, 0.0), (3, 40.0, 0.0), (4, 100.0, 0.0), (5, -5.0, 0.0)], "id int, lon double, lat double")
    assert {(r.id, r.polygon) for r in spatial.within(points, spatial.polygons(spark)).collect()} == {(1, "diamond")}


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("window: 12\nregions: [a, b]\n")
    config = EngineConfig.from_yaml(str(tmp_path / "c.yaml"), "smoke=true")
    assert (config.window, config.limited(["a", "b", "c"])) == (12, ["a"]) and "window: 12" in config.dump()
    with pytest.raises(ValueError, match="unknown"):
        EngineConfig.from_yaml(str(tmp_path / "c.yaml"), "nothing=1")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_stages_follow_the_configuration(spark):
    config = EngineConfig(regions=("ASIA", "EUROPE"), window=12, motifs=2, discords=1, rolling=24, lags=3)
    got = stages.configured(spark, "/root/testdata/sf0.001", config)
    assert {r.series for r in got["monthly"].select("series").distinct().collect()} == {"ASIA", "EUROPE"}
    assert {(r.series, r.n) for r in got["motifs"].groupBy("series").agg(F.count("t").alias("n")).collect()} == {("ASIA", 2), ("EUROPE", 2)}
    assert got["discords"].count() == 2 and got["xcorr_lags"].agg(F.max("lag")).first()[0] == 3
    assert got["rolling_pearson"].agg(F.min("n_row")).first()[0] == 24
    small = stages.configured(spark, "/root/testdata/sf0.001", EngineConfig(smoke=True))["monthly"]
    assert [(r.series, r.n) for r in small.groupBy("series").agg(F.count("t").alias("n")).collect()] == [("AFRICA", 60)]


def test_streamed_means_equal_batch(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1 + i, 3), "a", float(i)) for i in range(20)]
    table = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    table.write.parquet(f"{tmp_path}/in")
    query = monthly.windowed_means(monthly.read_events(spark, f"{tmp_path}/in"), "5 days").writeStream.format("memory").queryName("means").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted((r.start, r.n, r.mean) for r in df.collect())
    assert key(spark.table("means")) == key(monthly.windowed_means(table, "5 days"))


def test_polygons_survive_binary_and_geopackage(spark, tmp_path):
    import sqlite3

    from tessera.sources import geometry

    shapes = spatial.polygons(spark)
    encoded = geometry.encode_polygons(shapes)
    encoded.select("polygon", "geometry").write.parquet(f"{tmp_path}/geo")
    back = geometry.decode_polygons(spark.read.parquet(f"{tmp_path}/geo"))
    assert {r.polygon: r.rings for r in back.collect()} == {r.polygon: r.rings for r in shapes.collect()}
    con = sqlite3.connect(f"{tmp_path}/x.gpkg")
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    con.execute("INSERT INTO gpkg_geometry_columns VALUES ('cover', 'geom')")
    con.execute("CREATE TABLE cover (geom BLOB)")
    wkb = bytes(encoded.first().geometry)
    for flags, envelope in ((1, b""), (3, bytes(32))):
        con.execute("INSERT INTO cover VALUES (?)", (b"GP\0" + bytes([flags]) + bytes(4) + envelope + wkb,))
    con.commit()
    con.close()
    got = geometry.read_geopackage(spark.read.format("binaryFile").load(f"{tmp_path}/x.gpkg")).collect()
    assert [(r.layer, bytes(r.geometry)) for r in got] == [("cover", wkb)] * 2
    con = sqlite3.connect(f"{tmp_path}/y.gpkg")
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    con.execute("INSERT INTO gpkg_geometry_columns VALUES ('cover', 'geom')")
    con.execute("CREATE TABLE cover (geom BLOB)")
    con.execute("INSERT INTO cover VALUES (?)", (b"GP\0\1" + (3857).to_bytes(4, "little") + wkb,))
    con.commit()
    con.close()
    other = spark.read.format("binaryFile").load(f"{tmp_path}/y.gpkg")
    with pytest.raises(Exception, match="3857"):
        geometry.read_geopackage(other).collect()
    assert geometry.read_geopackage(other, (3857,)).count() == 1
    flat = geometry.geographic_polygons(geometry.read_geopackage(other, None)).first()
    x, y = geometry.rings_of(wkb)[0][1]
    lon, lat = np.degrees(x / 6378137), np.degrees(np.arctan(np.sinh(y / 6378137)))
    assert flat.system == 3857 and (flat.rings[0][1].x, flat.rings[0][1].y) == pytest.approx((lon, lat))
    with pytest.raises(Exception, match="no inverse for reference system 2154"):
        geometry.geographic_polygons(geometry.read_geopackage(other, None).withColumn("system", F.lit(2154))).collect()
    with pytest.raises(ValueError, match="neither"):
        geometry.rings_of(b"\x01\x01\0\0\0" + bytes(16))


def test_vegetation_index_takes_the_best_bands_a_table_has(spark):
    rows = spark.createDataFrame([("a", 6000.0, 2000.0, 0.9), ("a", 5000.0, None, 0.9), ("b", 0.6, 0.2, 0.9)], "file string, nir double, red double, ndvi double")
    got = sorted(((r.file, r.kndvi) for r in bands.vegetation_index(rows, "file").collect()), key=str)
    assert got[0][1] == pytest.approx(np.tanh(0.16)) and got[1][1] is None and got[2][1] == pytest.approx(np.tanh(0.16))
    assert [r.kndvi for r in bands.vegetation_index(rows.select("file", "ndvi"), "file").collect()] == pytest.approx([np.tanh(0.81)] * 3)
    with pytest.raises(ValueError, match="no columns"):
        bands.vegetation_index(rows.select("file", "nir"), "file")


def test_dates_end_before_the_last_and_masks_take_nulls_as_outside(spark):
    rows = spark.createDataFrame([(dt.date(2000, 1, 1),), (dt.date(2000, 2, 1),), (None,)], "date date")
    assert [r.date for r in bands.from_until(rows, "date", dt.date(2000, 1, 1), dt.date(2000, 2, 1)).collect()] == [dt.date(2000, 1, 1)]
    pixels = spark.createDataFrame([(1, 0), (0, 4), (0, None), (None, 4)], "e int, l int")
    got = pixels.select(bands.intact(F.col("e"), F.col("l"), 2020).alias("a"), bands.intact(F.col("e"), F.col("l"), 2025).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(True, True), (True, False), (False, False), (True, False)]


def test_p_values_of_the_published_case_and_of_series_without_values(spark):
    values = [(True, 1.0)] * 2 + [(True, 0.0)] * 8 + [(False, 0.0)] * 16
    rows = spark.createDataFrame([("s", "i", e, v) for e, v in values] + [("t", "i", True, 1.0)], "series string, indicator string, early boolean, value double")
    got = {r.series: r for r in stats.mann_whitney(rows).collect()}
    assert got["s"].u == 96 and got["s"].p == pytest.approx(0.038473, abs=1e-6) and got["t"].p is None and got["t"].u is None


# --- long series, pairs, draws -----------------------------------------------------------------------


@pytest.mark.parametrize("tile", [7, 50, 4096])
def test_tiled_profile_equals_the_kernel(spark, tile):
    x = np.random.default_rng(3).normal(size=150).cumsum()
    x[60:75] = 2.0  # constant windows
    x[100] = np.nan
    df = frame(spark, [float(v) for v in x]).unionByName(frame(spark, [1.0, 2.0, 3.0], "short")).repartition(3)
    got = {r.t: r for r in tiles.tiled_profile(df, 8, tile=tile).collect()}
    mp, nn = profile.profile_array(x, 8)
    assert sorted(got) == list(range(len(mp))) and {r.series for r in got.values()} == {"s"}
    assert np.allclose([got[t].mp for t in range(len(mp))], mp, atol=1e-5)
    for t, r in got.items():
        assert r.mp == min(r.left_mp, r.right_mp) and r.nn in (r.left_nn, r.right_nn)
        assert (r.left_nn == -1) == (r.left_mp == float("inf")) and (r.left_nn == -1 or r.left_nn < t - profile.exclusion(8)) and (r.right_nn == -1 or r.right_nn > t + profile.exclusion(8))


def test_tiled_profile_of_odd_series(spark):
    x = np.random.default_rng(6).normal(size=60)
    x[20:22] = np.nan
    rows = [("s", dt.date(2000, 1, 1) + dt.timedelta(i), i, float(x[i])) for i in range(60) if i not in (20, 21)]
    df = spark.createDataFrame([*rows, rows[5], ("s", rows[6][1], 6, None)], "series string, date date, t long, x double").withColumns({"block": F.lit(1), "size": F.lit("x"), "last": F.lit(0)})
    got = tiles.tiled_profile(df, 6, tile=16).collect()
    mp, nn = profile.profile_array(x, 6)
    assert {r.t: r.nn for r in got} == {t: int(nn[t]) for t in range(len(mp)) if t not in (20, 21)}
    assert all(r.mp == float("inf") and r.left_nn == r.right_nn == -1 for r in got if 15 <= r.t < 20)
    assert tiles.tiled_profile(df.limit(0), 6).count() == 0


def test_a_long_series_is_many_tasks(spark):
    x = np.random.default_rng(8).normal(size=6_000)
    df = spark.createDataFrame([("s", None, i, float(v)) for i, v in enumerate(x)], "series string, date date, t long, x double")
    got = tiles.tiled_profile(df, 20, tile=1024).orderBy("t").collect()
    mp, nn = profile.profile_array(x, 20)
    assert np.allclose([r.mp for r in got], mp, atol=1e-6) and [r.nn for r in got] == nn.tolist()


def test_draws_are_the_same_in_spark_and_numpy(spark):
    got = spark.range(40).select(F.col("id").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("p")).select("d", "p", counter.drawn(F.lit(123_456_789), F.col("d"), F.col("p"), F.lit(37)).alias("x")).collect()
    want = counter.drawn_array(123_456_789, np.arange(40), np.arange(10), 37)
    assert all(r.x == want[r.d, r.p] for r in got)


def test_lag_intervals_equal_the_kernel(spark):
    lags = {("a", "x"): [3, -1, 4, 1, -5, 9, 2], ("a", "y"): [6], ("b", "x"): [2, 2, 2, 8]}
    df = spark.createDataFrame([(s, i, 0, 0, v) for (s, i), vs in lags.items() for v in vs], "series string, indicator string, start long, other long, lag long")
    keys = {(r.series, r.indicator): r.key for r in df.select("series", "indicator", counter.key_of("series", "indicator").alias("key")).distinct().collect()}
    for r in overlap.lag_intervals(df.repartition(3), 300, 7).collect():
        assert (r.ci_lower, r.ci_upper) == pytest.approx(overlap.bootstrap_median(np.array(lags[r.series, r.indicator], float), keys[r.series, r.indicator] + 7, 300)) and r.n == len(lags[r.series, r.indicator])


def test_corrected_trends_do_not_depend_on_chunks(spark):
    rng = np.random.default_rng(4)
    rows = [("s", name, d, float(v)) for name, n in (("long", 60), ("block", 30), ("few", 5)) for d, v in zip(months(n), rng.normal(size=n) + np.arange(n) * 0.02)]
    df = spark.createDataFrame(rows, "series string, indicator string, date date, x double")
    one, other = ({r.indicator: r for r in stats.corrected_trends(df.repartition(k), 36, 400, at_once=step).collect()} for k, step in ((1, 400), (3, 33)))
    assert one == other and one["few"].p is None and one["few"].p_block is None
    assert 0 < one["long"].p_block <= 1 and one["block"].n == 30


def test_trend_of_a_very_long_group(spark):
    df = spark.range(200_000).select(F.lit("s").alias("series"), F.lit("i").alias("indicator"), F.date_add(F.lit(dt.date(1700, 1, 1)), F.col("id").cast("int")).alias("date"), ((F.col("id") * 7919 % 1000) + F.col("id") * 0.25).alias("x"))
    got = stats.mann_kendall(df).first()
    assert got.n == 200_000 and got.trend == "increasing" and got.slope == pytest.approx(0.25, abs=1e-4)


def test_floors_of_rebuilt_samples(spark):
    rows = [("a", 10, 16, 96.0, 0.2, 0.0, 0.038473), ("b", 10, 16, 91.0, 0.2, 1 / 16, 0.2), ("c", 4, 4, 16.0, 3.0, 0.0, 0.01), ("d", 0, 4, None, None, 1.0, None)]
    got = {r.k: r for r in stats.conditional_floor(spark.createDataFrame(rows, "k string, n1 long, n2 long, u double, mean1 double, mean2 double, p double")).collect()}

    def p_of(one, two):
        u = sum(1.0 if x > y else 0.5 if x == y else 0.0 for x in one for y in two)
        ones = sum(one) + sum(two)
        zeros = len(one) + len(two) - ones
        return mathx.mwu_greater(u, len(one), len(two), ones**3 - ones + zeros**3 - zeros)

    assert got["a"].floor_p == pytest.approx(p_of([1, 1] + [0] * 8, [0] * 16)) and got["a"].at_floor
    assert got["b"].floor_p == pytest.approx(p_of([1, 1] + [0] * 8, [1] + [0] * 15)) and not got["b"].at_floor
    assert got["c"].floor_p == got["c"].global_floor_p == pytest.approx(p_of([1] * 4, [0] * 4))
    assert got["d"].floor_p is None and not got["d"].at_global_floor


# --- crowded points, intervals, projections -------------------------------------------------------------


def crowded_points(spark, n=6_000):
    rng = np.random.default_rng(12)
    xy = np.concatenate([rng.normal((12.0, 11.0), 0.05, (n // 2, 2)), rng.normal((20.0, 3.0), 1e-4, (n // 4, 2)), rng.uniform((-60, -60), (110, 90), (n // 4, 2))])
    odd = [(float("nan"), 1.0), (None, None), (0.0, 40.0), (10.0, 10.0), (-5.0, 0.0), (500.0, 0.0)]
    return spark.createDataFrame([(i, None if a is None else float(a), None if b is None else float(b), 7) for i, (a, b) in enumerate([*xy.tolist(), *odd])], "id int, lon double, lat double, cell int")


@pytest.mark.parametrize("capacity", [10, 300, 10**6])
def test_quadtree_finds_what_testing_all_finds(spark, capacity):
    points = crowded_points(spark)
    rng = np.random.default_rng(1)
    star = [[(float(30 * r * np.cos(a)), float(30 * r * np.sin(a))) for a, r in zip(np.linspace(0, 2 * np.pi, 400, endpoint=False), rng.uniform(0.3, 1.5, 400))]]
    shapes = spatial.polygons(spark, [*spatial.POLYGONS, ("star", star), ("flat", [[(1.0, 1.0), (2.0, 2.0)]]), ("none", [])])
    got = sorted((r.id, r.polygon) for r in spatial.within(points, shapes, capacity=capacity).collect())
    want = points.join(shapes, spatial.inside(F.col("rings"), F.col("lon"), F.col("lat"))).select("id", "polygon").collect()
    assert got == sorted((r.id, r.polygon) for r in want) and len(got) > 3_000
    assert spatial.within(points, shapes.limit(0)).count() == 0 and spatial.within(points.limit(0), shapes).count() == 0


def test_quadtree_splits_where_points_are_many(spark):
    points = crowded_points(spark).filter("lon BETWEEN -60 AND 110 AND lat BETWEEN -60 AND 90")
    area = quadtree.Area(-60.0, -60.0, 110.0, 90.0)
    coded = points.select(quadtree.code(area, F.col("lon"), F.col("lat")).alias("code"))
    tree = quadtree.grown(coded, 200, 4_096)
    counts = quadtree.with_leaf(coded, tree, "code", "leaf").groupBy("leaf").count().collect()
    assert tree.starts[0] == 0 and sum(r["count"] for r in counts) == points.count()
    finest = coded.groupBy("code").count().agg(F.max("count")).first()[0]
    assert max(r["count"] for r in counts) <= max(200, finest) < points.count() / 3
    assert len(tree.starts) < 4 * 4_096 and len(quadtree.grown(coded, 1, 8).starts) <= 3 * 8 * quadtree.LEVELS + 1


def test_intervals_equal_a_plain_join(spark):
    rng = np.random.default_rng(5)
    at = [*rng.integers(0, 1000, 400).tolist(), *[500] * 300, None]
    ends = [(int(a), int(a + w)) for a, w in zip(rng.integers(-50, 1050, 200), rng.choice([0, 1, 5, 900, -3], 200))]
    ends += [(None, 5), (5, None), (500, 500), (500, 500), (-100, 5000)]
    base = dt.date(2000, 1, 1)
    day = lambda v: None if v is None else base + dt.timedelta(v)
    rows = spark.createDataFrame([(i, a, day(a), None if a is None else a / 2) for i, a in enumerate(at)], "id int, n int, d date, x double").repartition(4)
    dim = spark.createDataFrame([(i, a, b, day(a), day(b)) for i, (a, b) in enumerate(ends)], "k int, a int, b int, first date, last date")
    want = sorted((i, k) for i, v in enumerate(at) for k, (a, b) in enumerate(ends) if None not in (v, a, b) and a <= v <= b)
    for ranges, size in ((1, 10**6), (16, 40), (100, 10**6)):
        got = intervals.interval_join(rows, dim.select("k", "first", "last"), "d", ranges=ranges, rows_a_task=size)
        assert got.columns == ["id", "n", "d", "x", "k"] and sorted((r.id, r.k) for r in got.collect()) == want
    halves = dim.select("k", (F.col("a") / 2).alias("a"), (F.col("b") / 2).alias("b"))
    assert sorted((r.id, r.k) for r in intervals.interval_join(rows, halves, "x", "a", "b").collect()) == want
    assert intervals.interval_join(rows.limit(0), dim.select("k", "first", "last"), "d").count() == 0
    assert intervals.interval_join(rows, dim.select("k", "first", "last").limit(0), "d").count() == 0
    with pytest.raises(ValueError, match="both sides have id"):
        intervals.interval_join(rows, dim.select(F.col("k").alias("id"), "first", "last"), "d")


def test_interval_totals_meet_places_not_rows(spark, monkeypatch):
    base = dt.date(2000, 1, 1)
    rows = spark.range(6_000).select(F.date_add(F.lit(base), (F.col("id") % 3).cast("int")).alias("d"), F.when(F.col("id") % 3 < 2, F.col("id") / 4).alias("v"))
    spans = [(i % 500, *span) for i in range(1_000) for span in [((0, 0), (0, 2), (2, 2), (1, 0), (3, 9))[i % 5]]]
    dim = spark.createDataFrame([(k, base + dt.timedelta(a), base + dt.timedelta(b)) for k, a, b in spans], "k int, first date, last date")
    met = []
    joined = intervals.interval_join
    monkeypatch.setattr(intervals, "interval_join", lambda left, *a, **b: met.append(left.count()) or joined(left, *a, **b))
    got = {r.k: (r.n, r.v) for r in intervals.interval_totals(rows, dim, "d", ["v"]).collect()}
    assert met == [3]  # one row a place: pairs of rows and intervals are never listed
    of = {d: sum(i / 4 for i in range(6_000) if i % 3 == d) for d in (0, 1)}
    assert got == {k: {0: (4_000, 2 * of[0]), 1: (12_000, 2 * (of[0] + of[1])), 2: (4_000, None)}[k % 5] for k in range(500) if k % 5 < 3}


def test_interval_pairs_come_in_pieces(spark):
    places, low, high = np.repeat(np.arange(4), 50), np.array([0, 9, 1, 2, 0]), np.array([3, 9, 2, 1, 0])
    pieces = list(intervals.runs(places, low, high, 64))
    assert max(len(i) for i, _ in pieces) == 64 and len({len(i) for i, _ in pieces[:-1]}) == 1
    want = [(i, j) for j in range(5) for i in range(200) if low[j] <= places[i] <= high[j]]
    assert [(int(i), int(j)) for a, b in pieces for i, j in zip(a, b, strict=True)] == want
    rows, dim = spark.range(300).select("id", (F.col("id") % 2).alias("x")), spark.range(300).select(F.col("id").alias("k"), F.lit(1).alias("first"), F.lit(1).alias("last"))
    got = intervals.interval_join(rows, dim, "x", ranges=2, rows_a_task=40, intervals_a_task=40)
    assert sorted((r.id, r.k) for r in got.collect()) == [(i, k) for i in range(1, 300, 2) for k in range(300)]


def test_projections_have_inverses_and_known_places(spark):
    rng = np.random.default_rng(2)
    lonlat = [(float(a), float(b)) for a, b in zip(rng.uniform(-180, 179.99, 400), rng.uniform(-84, 84, 400))] + [(0.0, 0.0), (3.0, 45.0), (-180.0, 10.0), (179.9, -83.9)]
    df = spark.createDataFrame(lonlat, "lon double, lat double").withColumn("zone", projections.zone_of(F.col("lon")))
    lon, lat, south = F.col("lon"), F.col("lat"), F.col("lat") < 0
    forms = {"zone": projections.from_zone(*projections.to_zone(lon, lat, F.col("zone"), south), F.col("zone"), south), "a": projections.from_mercator(*projections.to_mercator(lon, lat)), "b": projections.from_mercator(*projections.to_mercator(lon, lat, True), True)}
    for name, (x, y) in forms.items():
        worst = df.agg(F.max(F.greatest(F.abs(x - lon), F.abs(y - lat)))).first()[0]
        assert worst < 1e-9, name
    known = [(3.0, 45.0, 31, 500_000.0, 0.9996 * 4_984_944.378), (-(79 + 23 / 60 + 13.7 / 3600), 43 + 38 / 60 + 33.24 / 3600, 17, 630_084.0, 4_833_438.0)]
    for a, b, zone, east, north in known:
        x, y = projections.to_zone(F.lit(a), F.lit(b), F.lit(zone), F.lit(False))
        got = spark.range(1).select(x.alias("x"), y.alias("y")).first()
        assert (got.x, got.y) == (pytest.approx(east, abs=0.7), pytest.approx(north, abs=0.7))
    assert spark.range(1).select(projections.to_degrees(F.lit(1.0), F.lit(2.0), F.lit(2154)).alias("p")).first().p is None
