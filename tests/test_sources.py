"""The raster source, the table function in SQL, and streams with state of their own."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import profile, table_functions
from tessera.sources import raster, readers
from tessera.streaming import anomalies

ROWS, COLS = 30, 20


@pytest.fixture
def tiles_folder(tmp_path):
    rng = np.random.default_rng(1)
    for h, v in ((3, 4), (3, 5), (17, 2)):
        planes = [rng.integers(-2000, 9000, ROWS * COLS).astype("<i2"), rng.integers(-2000, 9000, ROWS * COLS).astype("<i2"), rng.integers(-1, 4, ROWS * COLS).astype("i1")]
        (tmp_path / f"MOD.A2001032.h{h:02d}v{v:02d}.tile").write_bytes(b"".join(p.tobytes() for p in planes))
    return str(tmp_path)


def load(spark, folder, **more):
    raster.register(spark)
    reader = spark.read.format("raster_tiles").option("path", f"{folder}/*.tile").option("rows", ROWS).option("cols", COLS)
    for k, v in more.items():
        reader = reader.option(k, v)
    return reader.load()


def test_raster_source_gives_the_rows_of_the_whole_file_reader(spark, tiles_folder):
    whole = readers.decode_tiles(spark.read.format("binaryFile").load(f"{tiles_folder}/*.tile"), ROWS, COLS, 3)
    got = load(spark, tiles_folder, stride=3, block=7)
    columns = ["h", "v", "row", "col", "nir", "red", "qc"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))
    assert got.rdd.getNumPartitions() == 3 * 4  # the last two rows of a tile are between strides
    where = "h = 3 AND v IN (4, 5) AND row >= 9 AND row < 20 AND col > 5 AND nir > 0"
    assert sorted(map(tuple, got.filter(where).select(columns).collect())) == sorted(map(tuple, whole.filter(where).select(columns).collect()))


def test_raster_source_reads_only_what_is_asked_for(tiles_folder, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringContains

    sizes = []
    plain = raster.TileReader.fetched
    monkeypatch.setattr(raster.TileReader, "fetched", staticmethod(lambda file, size: sizes.append(size) or plain(file, size)))
    reader = raster.TileReader({"path": f"{tiles_folder}/*.tile", "rows": str(ROWS), "cols": str(COLS), "stride": "2", "block": "10"})
    odd = StringContains(("h",), "3")
    assert list(reader.pushFilters([EqualTo(("h",), 3), In(("v",), (5, 9)), GreaterThanOrEqual(("row",), 12), LessThan(("row",), 18), odd, EqualTo(("nir",), 1)])) == [odd, EqualTo(("nir",), 1)]
    blocks = reader.partitions()
    assert [(b.h, b.v, b.first, b.end) for b in blocks] == [(3, 5, 10, 20)]
    batches = [b for p in blocks for b in reader.read(p)]
    assert [b.column("row")[0].as_py() for b in batches] == [12, 14, 16]
    assert sum(sizes) == 3 * COLS * 5  # three rows of five bytes a pixel, of 3 files x 30 rows


def test_raster_source_says_what_is_wrong(spark, tiles_folder, tmp_path):
    with pytest.raises(ValueError, match="at least 1"):
        raster.TileReader({"path": "x", "rows": "1", "cols": "1", "stride": "0"})
    (tmp_path / "h01v01.tile").write_bytes(b"short")
    with pytest.raises(Exception, match="ends early"):
        load(spark, tmp_path).filter("h = 1").collect()


def test_table_function_equals_the_operator(spark):
    x = np.random.default_rng(2).normal(size=60)
    rows = [("a", i, dt.date(2000, 1, 1) + dt.timedelta(31 * i), float(v)) for i, v in enumerate(x)] + [("b", i, dt.date(2000, 1, 1), 1.0 * i) for i in range(5)]
    df = spark.createDataFrame(rows, "series string, t long, date date, x double").repartition(4)
    table_functions.register(spark)
    got = spark.sql("SELECT * FROM matrix_profile(TABLE(SELECT * FROM {df}) PARTITION BY (series), 6)", df=df)
    want = profile.matrix_profile(df, 6)
    assert got.schema == want.schema and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    for bad, text in (("SELECT 1 AS x", "missing columns"), ("SELECT * FROM {df}", "at least 2")):
        with pytest.raises(Exception, match=text):
            spark.sql(f"SELECT * FROM matrix_profile(TABLE({bad}) PARTITION BY (x), 1)", df=df).collect()


def test_streamed_anomalies_survive_restarts(spark, tmp_path):
    rng = np.random.default_rng(3)
    days = [dt.date(2000 + i // 12, i % 12 + 1, 1) for i in range(40)]
    rows = [(s, d, None if i == 7 else float(rng.normal())) for s in ("a", "b") for i, d in enumerate(days)] + [(None, days[0], 1.0)]
    schema = "series string, date date, x double"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part, (a, b) in enumerate(((0, 10), (10, 11), (11, 40))):
            spark.createDataFrame([r for r in rows if days[a] <= r[1] <= days[b - 1]], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = anomalies.running_anomalies(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
            query = stream.writeStream.foreachBatch(anomalies.once(f"{tmp_path}/out")).outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
            query.awaitTermination(180)  # a new query each time: it starts from the checkpoint
            assert query.exception() is None and part < 3
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    want = anomalies.batch_anomalies(spark.createDataFrame(rows, schema))

    def shown(df):
        return sorted((r.series, r.date, r.n, r.late, None if r.anomaly is None else round(r.anomaly, 9)) for r in df.collect())

    assert shown(got) == shown(want) and got.count() == 80


def test_a_batch_written_twice_is_there_once(spark, tmp_path):
    sink = anomalies.once(f"{tmp_path}/x")
    for n in (3, 3, 5):
        sink(spark.range(n), 0)
    sink(spark.range(2), 1)
    assert spark.read.parquet(f"{tmp_path}/x").groupBy("batch").agg(F.count("id").alias("n")).orderBy("batch").collect() == [(0, 5), (1, 2)]


def test_row_limits_are_by_file(spark, tmp_path):
    for name, n in (("kndvi_a", 30), ("kndvi_b", 2), ("skip_c", 9)):
        (tmp_path / f"{name}.csv").write_text("region,date,pixel_id,kndvi\n" + "".join(f"{name},2001-01-01,p{i},0.{i:02d}\n" for i in range(n)))
    got = readers.read_observations(spark, f"{tmp_path}/*.csv", limit=3, exclude="^skip")
    assert sorted((r.region, r.pixel_id) for r in got.collect()) == [("kndvi_a", "p0"), ("kndvi_a", "p1"), ("kndvi_a", "p2"), ("kndvi_b", "p0"), ("kndvi_b", "p1")]
    spark.range(100).repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(f"{tmp_path}/p")
    kept = readers.first_of_files(spark.read.parquet(f"{tmp_path}/p"), 2).collect()
    assert len(kept) == 8 and min(r.id for r in kept) == 0


def test_geoparquet_goes_by_its_footers(spark, tmp_path):
    import json

    import pyarrow as pa
    import pyarrow.parquet as pq

    from tessera.sources import geometry

    ring = [(0.0, 0.0), (1000.0, 0.0), (1000.0, 2000.0)]

    def write(folder, crs, name="a", geo=True):
        (tmp_path / folder).mkdir(exist_ok=True)
        table = pa.table({"polygon": [name], "geometry": [geometry.wkb_of([ring])]})
        meta = {"geo": json.dumps({"version": "1.0.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", **crs}}})} if geo else {}
        pq.write_table(table.replace_schema_metadata(meta), tmp_path / folder / f"{name}.parquet")
        return f"{tmp_path}/{folder}"

    plain = geometry.read_geoparquet(spark, write("plain", {}, geo=False)).first()
    assert [(p.x, p.y) for p in plain.rings[0]] == ring
    same = geometry.read_geoparquet(spark, write("same", {"crs": {"id": {"authority": "OGC", "code": "CRS84"}}})).first()
    assert same.rings == plain.rings
    mercator = write("mercator", {"crs": {"id": {"authority": "EPSG", "code": 3857}}})
    got = geometry.read_geoparquet(spark, mercator).first()
    assert got.rings[0][1].x == pytest.approx(np.degrees(1000 / 6378137)) and geometry.geoparquet_systems(spark, mercator) == {3857: 1}
    write("mercator", {"crs": {"id": {"authority": "EPSG", "code": 32631}}}, "b")
    with pytest.raises(ValueError, match="32631, 3857"):
        geometry.read_geoparquet(spark, mercator)
    with pytest.raises(ValueError, match="None"):
        geometry.read_geoparquet(spark, write("odd", {"crs": {"name": "somewhere"}}))
