"""Choosing a vegetation index by the bands a table has, and the filters of pixels before it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as fn


def vegetation_index(rows: DataFrame, by: str, sigma: float = 0.5) -> DataFrame:
    """Adds kndvi: from nir and red where the table has both, else its own kndvi, else from ndvi; without any, ValueError.

    Bands are rescaled by the largest magnitude among rows of one ``by`` (a file), which is aggregated first; the join
    back has one row per file on its other side.
    """
    source = next((s for s in (("nir", "red"), ("kndvi",), ("ndvi",)) if set(s) <= set(rows.columns)), None)
    if source is None:
        raise ValueError("no columns to make a vegetation index from: nir and red, kndvi, or ndvi")
    scales = rows.groupBy(by).agg(*[F.max(F.abs(c)).alias(f"__most_{c}") for c in source])
    band = {c: fn.rescaled(F.col(c), F.col(f"__most_{c}")) for c in source}
    made = fn.kndvi(band["nir"], band["red"], sigma) if "nir" in band else band["kndvi"] if "kndvi" in band else fn.kndvi_from_ndvi(band["ndvi"])
    return rows.join(scales, by).withColumn("kndvi", made).drop(*[f"__most_{c}" for c in source])


def from_until(rows: DataFrame, column: str, first: dt.date, end: dt.date) -> DataFrame:
    """Rows from ``first`` up to, but not on, ``end``; literal bounds, so that the scan gets them."""
    kind = dict(rows.dtypes)[column]
    return rows.filter((F.col(column) >= F.lit(first).cast(kind)) & (F.col(column) < F.lit(end).cast(kind)))


def intact(extent: Column, loss: Column, year: int) -> Column:
    """Pixels of the mask of ``year``: 2020 takes today's extent and what was lost since (class 4), 2025 today's alone."""
    now = F.coalesce(extent == 1, F.lit(False))
    return now | F.coalesce(loss == 4, F.lit(False)) if year == 2020 else now
