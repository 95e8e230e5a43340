"""Sinks: partitioned Parquet and CSV, single-file summaries, period slices, a data card."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import spatial


def write_parquet(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Parquet under ``path``, one folder per value of ``by``.

    Rows of a folder are brought together first, by a hint that lets adaptive execution split a folder of many rows
    over tasks (and files) instead of giving one task all of it.
    """
    out = df.hint("rebalance", *by) if by else df
    out.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str, by: tuple[str, ...] = (), digits: int | None = None) -> None:
    """CSV with a header; without ``by`` one file (for summaries). Doubles in ``digits`` decimals if given."""
    if digits is not None:
        df = df.withColumns({c: F.format_string(f"%.{digits}f", c) for c, kind in df.dtypes if kind == "double"})
    lists = {c: F.to_json(c) for c, kind in df.dtypes if kind.startswith("array")}
    out = df.withColumns(lists) if lists else df
    (out.hint("rebalance", *by) if by else out.coalesce(1)).write.mode("overwrite").partitionBy(*by).csv(path, header=True)


def write_slices(df: DataFrame, periods: DataFrame, path: str) -> None:
    """One Parquet folder per vintage of ``periods`` (vintage, first, last) with the rows of ``df`` dated inside it.

    Periods may overlap, a row is then in several slices; a period without rows leaves no folder.
    """
    write_parquet(spatial.assign_periods(df, periods), path, ("vintage",))


def data_card(profile: DataFrame, title: str) -> str:
    """Markdown of an indicator profile (a few rows) for the reader of a data folder."""
    rows = profile.orderBy(profile.columns[0]).collect()
    head = "| " + " | ".join(profile.columns) + " |"
    return "\n".join([f"# {title}", "", head, "|" + "-|" * len(profile.columns), *("| " + " | ".join(str(v) for v in r) + " |" for r in rows), ""])
