"""Sources: ASCII index tables, CSV and Parquet of observations, file sets, raster tiles, with schema checks."""

from __future__ import annotations

import urllib.request
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = -99.0
#: Season codes of three months, by the month in their middle.
SEASONS = ("DJF", "JFM", "FMA", "MAM", "AMJ", "MJJ", "JJA", "JAS", "ASO", "SON", "OND", "NDJ")
OBSERVATIONS = T.StructType(
    [T.StructField("region", T.StringType()), T.StructField("date", T.DateType()), T.StructField("pixel_id", T.StringType()), T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()), T.StructField("kndvi", T.DoubleType())]
)
ALIASES = {"lat": "latitude", "lon": "longitude", "mp_value": "mp", "matrix_profile_value": "mp", "mk_p": "p", "p_value": "p"}


def normalize_columns(df: DataFrame, required: Iterable[str] = (), aliases: dict[str, str] = ALIASES) -> DataFrame:
    """Column names trimmed, lower-cased and by their usual name; raises ValueError if a required one is absent."""
    names: list[str] = []
    for c in df.columns:
        name = aliases.get(c.strip().lower(), c.strip().lower())
        names.append(name if name not in names else f"{name}_{len(names)}")
    absent = sorted(set(required) - set(names))
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df.toDF(*names)


def _value(text):
    v = text.try_cast("double")
    return F.when(v > MISSING, v)


def parse_long_ascii(lines: DataFrame, indicator: str, line: str = "value") -> DataFrame:
    """(date, indicator, value) from lines ``YEAR MONTH VALUE``; others are skipped, -99 and below is null."""
    t = F.split(F.trim(line), r"\s+")
    rows = lines.filter(F.trim(line).rlike(r"^\d") & (F.size(t) >= 3)).select(t[0].try_cast("int").alias("y"), t[1].try_cast("int").alias("m"), _value(t[2]).alias("value"))
    return rows.filter("y IS NOT NULL AND m BETWEEN 1 AND 12").select(F.make_date("y", "m", F.lit(1)).alias("date"), F.lit(indicator).alias("indicator"), "value")


def parse_seasonal_ascii(lines: DataFrame, indicator: str, line: str = "value") -> DataFrame:
    """(date, indicator, value) from lines ``SEASON YEAR TOTAL ANOMALY``; unknown seasons are skipped."""
    t = F.split(F.trim(line), r"\s+")
    month = F.array_position(F.array(*map(F.lit, SEASONS)), F.upper(t[0])).cast("int")
    rows = lines.filter(F.size(t) >= 4).select(month.alias("m"), t[1].try_cast("int").alias("y"), _value(t[3]).alias("value"))
    return rows.filter("m > 0 AND y IS NOT NULL").select(F.make_date("y", "m", F.lit(1)).alias("date"), F.lit(indicator).alias("indicator"), "value")


def fetch_lines(spark: SparkSession, url: str, timeout: float = 60.0) -> DataFrame:
    """(value): the lines of a small remote text, fetched by the driver (an index table of some kB)."""
    with urllib.request.urlopen(url, timeout=timeout) as got:  # noqa: S310
        text = got.read().decode("utf-8", "replace")
    return spark.createDataFrame([(x,) for x in text.splitlines()], "value string")


def first_of_files(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of each file that ``df`` reads; what a task has beyond them leaves before the shuffle."""
    file, block, place, rank = "__file", "__block", "__place", "__rank"
    marked = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.file_block_start").alias(block), F.monotonically_increasing_id().alias(place))
    ranked = marked.withColumn(rank, F.row_number().over(W.partitionBy(file).orderBy(block, place)))
    return ranked.filter(F.col(rank) <= n).drop(file, block, place, rank)


def read_observations(spark: SparkSession, paths: str | list[str], limit: int | None = None, exclude: str | None = None) -> DataFrame:
    """Observations from CSV or Parquet files (by suffix), columns checked, values coerced, bad rows dropped.

    Several paths or patterns are united by column name. ``limit`` is a number of rows of each file, the first ones.
    ``exclude`` is a pattern of file names to leave out.
    """
    paths = [paths] if isinstance(paths, str) else paths
    out = None
    for path in paths:
        if path.endswith((".csv", ".csv.gz")):
            df = spark.read.csv(path, header=True)
        elif path.rstrip("/").endswith(".parquet"):
            df = spark.read.parquet(path)
        else:
            raise ValueError(f"neither CSV nor Parquet: {path}")
        if exclude:
            df = df.filter(~F.col("_metadata.file_name").rlike(exclude))
        df = normalize_columns(df.select("*") if limit is None else first_of_files(df, limit), ("region", "date", "pixel_id", "kndvi"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    numbers = {c: F.col(c).try_cast("double") for c in ("kndvi", "latitude", "longitude") if c in out.columns}
    numbers["kndvi"] = F.when(~F.isnan(numbers["kndvi"]), numbers["kndvi"])
    out = out.withColumns({**numbers, "date": F.trunc(F.to_date(F.try_to_timestamp(F.col("date").cast("string"))), "month")})
    return out.na.drop(subset=["date", "pixel_id"])


def read_wide_indicators(spark: SparkSession, path: str, names: Iterable[str]) -> DataFrame:
    """(date, one DOUBLE per name) from CSV; a column that is null throughout is an error, not data."""
    schema = T.StructType([T.StructField("date", T.DateType()), *[T.StructField(n, T.DoubleType()) for n in names]])
    df = spark.read.csv(path, header=True, schema=schema)
    filled = df.agg(*[F.count(n).alias(n) for n in names]).first()
    empty = [n for n in names if not filled[n]]
    if empty:
        raise ValueError(f"no values in {', '.join(empty)} of {path}")
    return df


def region_from_name(name, regions: Iterable[str]):
    """The first of ``regions`` that a file name holds after ``kndvi_``."""
    return F.nullif(F.regexp_extract(F.lower(name), "kndvi_(" + "|".join(sorted(map(str.lower, regions), key=len, reverse=True)) + ")", 1), F.lit(""))


def decode_tiles(files: DataFrame, rows: int, cols: int, stride: int = 5) -> DataFrame:
    """(h, v, row, col, nir, red, qc) of every ``stride``-th pixel of raw tiles from ``spark.read.format("binaryFile")``.

    A tile's content is three planes of ``rows`` x ``cols``: two of little-endian 16-bit reflectance and one of 8-bit
    quality; its place is in the name (``hNNvNN``). Containers of other formats need their own library.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                at = path.rfind("h", 0, path.rfind("v"))
                nir, red = np.frombuffer(content, "<i2", 2 * rows * cols).reshape(2, rows, cols)[:, ::stride, ::stride]
                qc = np.frombuffer(content, np.int8, rows * cols, 4 * rows * cols).reshape(rows, cols)[::stride, ::stride]
                r, c = np.meshgrid(np.arange(0, rows, stride), np.arange(0, cols, stride), indexing="ij")
                yield pd.DataFrame({"h": int(path[at + 1 : at + 3]), "v": int(path[at + 4 : at + 6]), "row": r.ravel(), "col": c.ravel(), "nir": nir.ravel(), "red": red.ravel(), "qc": qc.ravel()})

    return files.select("path", "content").mapInPandas(run, "h int, v int, row int, col int, nir int, red int, qc int")
