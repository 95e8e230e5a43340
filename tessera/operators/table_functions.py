"""The matrix profile as a table function for SQL: one partition of its input is one series.

SELECT * FROM matrix_profile(TABLE(monthly) PARTITION BY (series) ORDER BY (t), 12)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tessera.operators.profile import profile_array

NEEDED = ("series", "t", "date", "x")


@udtf
class MatrixProfile:
    """(series, t, date, mp, nn) of a table (series, t, date, x); a series shorter than two windows gives no rows."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.m = 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, m: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table: TABLE(...) PARTITION BY series")
        absent = [c for c in NEEDED if c not in rows.dataType.names]
        if absent:
            raise ValueError(f"missing columns: {', '.join(absent)}")
        if not isinstance(m.dataType, IntegerType | LongType) or m.value is None or m.value < 2:
            raise ValueError("the window is a constant whole number of at least 2")
        own = {c: rows.dataType[c].dataType for c in NEEDED[:3]}
        return AnalyzeResult(StructType([*[StructField(c, kind) for c, kind in own.items()], StructField("mp", DoubleType()), StructField("nn", LongType())]))

    def eval(self, row: Row, m: int) -> None:
        self.m = m
        self.rows.append(tuple(row[c] for c in NEEDED))

    def terminate(self) -> Iterator[tuple]:
        if len(self.rows) >= 2 * self.m > 0:
            self.rows.sort(key=lambda r: r[1])
            mp, nn = profile_array(np.array([np.nan if r[3] is None else r[3] for r in self.rows], float), self.m)
            for (series, t, date, _), d, u in zip(self.rows, mp, nn, strict=False):
                yield series, t, date, float(d), int(u)


def register(spark: SparkSession) -> None:
    spark.udtf.register("matrix_profile", MatrixProfile)
