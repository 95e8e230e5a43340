"""Anomalies against a climatology that grows with the stream, and a sink that writes a batch once however often it runs.

A series' state is, for each calendar month, how many values it had and their sum. A value's anomaly is its distance
from the mean of its month's values up to and with itself. Batches are taken in the order of dates; a row that comes
after a later one of its series counts like the others, where it comes, and is marked late.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "series string, date date, x double, anomaly double, n long, late boolean"


class Climatology(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.months = handle.getMapState("months", "month int", "n bigint, total double")
        self.last = handle.getValueState("last", "day int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        part = pd.concat(list(rows)).sort_values(["date", "x"], na_position="last", kind="stable", ignore_index=True)
        last = self.last.get()[0] if self.last.exists() else -(1 << 31)
        known: dict[int, tuple[int, float]] = {}
        out = []
        for date, x in zip(part["date"], part["x"], strict=True):
            month, day = date.month, date.toordinal()
            if month not in known:
                known[month] = tuple(self.months.getValue((month,))) if self.months.containsKey((month,)) else (0, 0.0)
            n, total = known[month]
            if pd.notna(x):
                n, total = n + 1, total + x
                known[month] = (n, total)
            out.append((key[0], date, x, x - total / n if n else None, n, day < last))
            last = max(last, day)
        for month, held in known.items():
            self.months.updateValue((month,), held)
        self.last.update((last,))
        yield pd.DataFrame(out, columns=["series", "date", "x", "anomaly", "n", "late"])

    def close(self) -> None:
        pass


def running_anomalies(stream: DataFrame) -> DataFrame:
    """(series, date, x, anomaly, n, late) of a stream (series, date, x); needs the RocksDB state store.

    Rows without a series or date are dropped; a null value has no anomaly and changes nothing.
    """
    rows = stream.filter("series IS NOT NULL AND date IS NOT NULL").select("series", "date", F.col("x").cast("double").alias("x"))
    return rows.groupBy("series").transformWithStateInPandas(Climatology(), OUTPUT, "Append", "None")


def batch_anomalies(series: DataFrame) -> DataFrame:
    """The same of a table, all at once: what a stream in the order of dates comes to, whatever its batches."""
    upto = W.partitionBy("series", F.month("date")).orderBy("date", F.asc_nulls_last("x")).rowsBetween(W.unboundedPreceding, 0)
    rows = series.filter("series IS NOT NULL AND date IS NOT NULL").select("series", "date", F.col("x").cast("double").alias("x"))
    return rows.select("*", (F.col("x") - F.sum("x").over(upto) / F.count("x").over(upto)).alias("anomaly"), F.count("x").over(upto).alias("n"), F.lit(False).alias("late"))


def once(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: a batch's rows are its own folder under ``path``, replaced if the batch runs again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return write
