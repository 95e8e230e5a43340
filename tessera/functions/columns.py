"""Column functions: indices, fills, keys, file names, and p-values as Arrow functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.functions import mathx

FILL = -28672
SCALE = 1e-4
RADIUS = 6371007.181
TILE = 1111950.519667
SIZE = 1200


def kndvi(nir: Column, red: Column, sigma: float = 0.5) -> Column:
    """tanh of the squared band difference over twice sigma."""
    return F.tanh(F.pow((nir - red) / (2 * sigma), F.lit(2.0)))


def kndvi_from_ndvi(ndvi: Column) -> Column:
    return F.tanh(ndvi * ndvi)


def unscaled(raw: Column) -> Column:
    """Reflectance of a stored integer; fill values are null."""
    return F.when(raw > FILL, raw * SCALE)


def rescaled(x: Column, largest: Column) -> Column:
    """x / 10000 where the column's largest magnitude (over a file) shows that it is scaled."""
    return F.when(largest > 2, x / 10000.0).otherwise(x)


def quality_ok(qc: Column) -> Column:
    return qc.between(0, 1)


def pixel_id(lon: Column, lat: Column) -> Column:
    return F.format_string("%.4f_%.4f", lon, lat)


def date_from_name(name: Column) -> Column:
    """Month of the ``.AYYYYDDD.`` part of a file name."""
    return F.trunc(F.to_date(F.nullif(F.regexp_extract(name, r"\.A(\d{7})\.", 1), F.lit("")), "yyyyDDD"), "month")


def tile_from_name(name: Column) -> Column:
    """(h, v) of the ``hNNvNN`` part of a file name."""
    return F.struct(*[F.regexp_extract(name, r"h(\d{2})v(\d{2})", i + 1).cast("int").alias(k) for i, k in enumerate("hv")])


def tile_lon_lat(h: Column, v: Column, row: Column, col: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a pixel's centre on the sinusoidal grid of 36 x 18 tiles."""
    pixel = TILE / SIZE
    x = (h - 18) * TILE + (col + 0.5) * pixel
    y = (9 - v) * TILE - (row + 0.5) * pixel
    lat = y / RADIUS
    return F.degrees(x / (RADIUS * F.cos(lat))), F.degrees(lat)


def agreement(a: Column, b: Column, within: int = 2) -> Column:
    return F.when(F.abs(a - b) <= within, "agree").otherwise("disagree")


def half_even(x: Column, digits: int) -> Column:
    """Rounded with halves to the even neighbour."""
    return F.bround(x, digits)


@F.pandas_udf(DoubleType())
def normal_sf(z: pd.Series) -> pd.Series:
    return pd.Series(mathx.normal_sf_array(z.to_numpy(float)))


@F.pandas_udf(DoubleType())
def pearson_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(mathx.pearson_p_array(r.to_numpy(float), n.to_numpy(float)))


@F.pandas_udf(DoubleType())
def mwu_greater_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series(mathx.mwu_greater_array(u.to_numpy(float), n1.to_numpy(float), n2.to_numpy(float), ties.to_numpy(float)))


@F.pandas_udf(DoubleType())
def mwu_exact_p(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series(mathx.mwu_exact_array(u.to_numpy(float), n1.fillna(0).to_numpy(float), n2.fillna(0).to_numpy(float)))
