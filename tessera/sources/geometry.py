"""Polygons from and to well-known binary, and from GeoPackage containers."""

from __future__ import annotations

import json
import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import projections
from tessera.operators import spatial

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RINGS = T.ArrayType(T.ArrayType(POINT))
#: Geometry kinds of well-known binary.
POLYGON, MULTIPOLYGON = 3, 6


def rings_of(wkb: bytes) -> list[list[tuple[float, float]]]:
    """All rings of a polygon or multipolygon, without the vertex that closes each; other kinds raise ValueError."""
    out: list[list[tuple[float, float]]] = []

    def read(at: int) -> int:
        end = "<" if wkb[at] else ">"
        kind, n = struct.unpack_from(f"{end}II", wkb, at + 1)
        at += 9
        if kind == MULTIPOLYGON:
            for _ in range(n):
                at = read(at)
        elif kind == POLYGON:
            for _ in range(n):
                (k,) = struct.unpack_from(f"{end}I", wkb, at)
                flat = struct.unpack_from(f"{end}{2 * k}d", wkb, at + 4)
                ring = list(zip(flat[::2], flat[1::2], strict=True))
                out.append(ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring)
                at += 4 + 16 * k
        else:
            raise ValueError(f"neither polygon nor multipolygon: kind {kind}")
        return at

    read(0)
    return out


def wkb_of(rings: list) -> bytes:
    """Well-known binary (little-endian) of one polygon."""
    parts = [struct.pack("<BII", 1, POLYGON, len(rings))]
    for ring in rings:
        closed = [*ring, ring[0]]
        parts.append(struct.pack(f"<I{2 * len(closed)}d", len(closed), *(v for p in closed for v in p)))
    return b"".join(parts)


def decode_polygons(df: DataFrame, column: str = "geometry") -> DataFrame:
    """``df`` with rings decoded from a WKB column (as GeoParquet has them); null stays null."""

    @F.pandas_udf(RINGS)
    def decode(part: pd.Series) -> pd.Series:
        return part.map(lambda v: None if v is None else [[{"x": x, "y": y} for x, y in ring] for ring in rings_of(bytes(v))])

    return df.withColumn("rings", decode(column))


def encode_polygons(df: DataFrame, column: str = "rings") -> DataFrame:
    """``df`` with geometry (WKB) from rings, ready for Parquet."""

    @F.pandas_udf(T.BinaryType())
    def encode(part: pd.Series) -> pd.Series:
        return part.map(lambda rings: None if rings is None else wkb_of([[(p["x"], p["y"]) for p in ring] for ring in rings]))

    return df.withColumn("geometry", encode(column))


#: Reference systems whose coordinates are longitudes and latitudes: WGS 84, and the undefined geographic one.
GEOGRAPHIC = (4326, 0)
DEGREES_CODE = 4326


def read_geopackage(files: DataFrame, systems: tuple[int, ...] | None = GEOGRAPHIC) -> DataFrame:
    """(path, layer, geometry WKB, system) of every feature in GeoPackage files from ``spark.read.format("binaryFile")``.

    A file is opened in memory by the task that holds it, so it is read where it lies and never as a local path. A
    geometry's own header is skipped by its flags; ``system`` is the code that the file gives the header's reference
    system. Coordinates are as stored: a geometry in a system beyond ``systems`` raises ValueError, since it would be
    taken for degrees; with None all are read, for ``geographic_polygons`` to convert.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                con = sqlite3.connect(":memory:")
                con.deserialize(bytes(content))
                has_codes = con.execute("SELECT count(*) FROM sqlite_master WHERE name = 'gpkg_spatial_ref_sys'").fetchone()[0]
                codes = dict(con.execute("SELECT srs_id, organization_coordsys_id FROM gpkg_spatial_ref_sys")) if has_codes else {}
                for layer, column in con.execute("SELECT table_name, column_name FROM gpkg_geometry_columns").fetchall():
                    blobs = [b for (b,) in con.execute(f'SELECT "{column}" FROM "{layer}"') if b]  # noqa: S608
                    own = [int.from_bytes(b[4:8], "little" if b[3] & 1 else "big", signed=True) for b in blobs]
                    own = [codes.get(i, i) for i in own]
                    other = set() if systems is None else set(own) - set(systems)
                    if other:
                        raise ValueError(f"{layer} of {path} is in reference system {min(other)}, not one of {systems}")
                    yield pd.DataFrame({"path": path, "layer": layer, "geometry": [b[8 + envelope[b[3] >> 1 & 7] :] for b in blobs], "system": own})
                con.close()

    return files.select("path", "content").mapInPandas(run, "path string, layer string, geometry binary, system int")


def geographic_polygons(features: DataFrame, column: str = "geometry", system_column: str = "system") -> DataFrame:
    """``features`` (geometry WKB, system) with rings in longitude and latitude, converted from the layer's own system.

    Degrees, both Mercator projections and zones of transverse Mercator are known; another system is an error when rows
    in it are computed, not silence. Null geometries have null rings.
    """
    system = F.col(system_column)
    checked = F.when(~projections.known(system), F.raise_error(F.concat(F.lit("no inverse for reference system "), system.cast("string"))).cast("int")).otherwise(system)
    (own,) = spatial.free_names(features, "own_system")
    decoded = decode_polygons(features.withColumn(own, checked), column)
    return decoded.withColumn("rings", projections.rings_to_degrees(F.col("rings"), F.col(own))).drop(own)


def geoparquet_systems(spark: SparkSession, path: str, column: str = "geometry") -> dict[int | None, int]:
    """How many Parquet files of a folder have which reference system, by their footers; None for one without a code.

    A file without the ``geo`` entry, or a column without a system, is in degrees by the format's default.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    listed = root.getFileSystem(conf).listFiles(root, True)
    found: dict[int | None, int] = {}
    while listed.hasNext():
        file = listed.next()
        if not file.getPath().getName().endswith(".parquet"):
            continue
        with_footer = jvm.org.apache.parquet.hadoop.ParquetFileReader.readFooter(conf, file.getPath())
        entry = with_footer.getFileMetaData().getKeyValueMetaData().get("geo")
        system = json.loads(entry).get("columns", {}).get(column, {}).get("crs") if entry else None
        code = DEGREES_CODE if system is None or system.get("id", {}).get("authority") == "OGC" else system.get("id", {}).get("code")
        found[code] = found.get(code, 0) + 1
    return found


def read_geoparquet(spark: SparkSession, path: str, column: str = "geometry") -> DataFrame:
    """A GeoParquet folder with rings in longitude and latitude, converted where its footers name another known system.

    Files in several systems, or in one without a code, raise ValueError.
    """
    systems = geoparquet_systems(spark, path, column)
    if len(systems) > 1 or None in systems:
        raise ValueError(f"{path} has files in systems {', '.join(sorted(map(str, systems)))}")
    df = spark.read.parquet(path)
    (system,) = spatial.free_names(df, "system")
    code = next(iter(systems), DEGREES_CODE)
    return geographic_polygons(df.withColumn(system, F.lit(int(code))), column, system).drop(system)
