"""Rows and the intervals that hold them, where there are too many intervals to send them to every task.

Places are cut into ranges at approximate percentiles of the rows, an interval is dealt to the ranges it reaches, and a
range with many rows at one place is dealt on by a salt, its intervals to each; many intervals of a range are dealt on
likewise, its rows to each. In a range a sweep holds the sorted rows and goes through the intervals in batches: for each
the run of rows between its ends. Work is what is sorted and what comes out, and a task holds a range's rows and a
batch of pairs, however many pairs there are. Where only totals are asked for, ``interval_totals`` sums the rows of a
place before they meet the intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.spatial import free_names

#: Rows of a range that one task sweeps, intervals that it meets them with, and pairs that it makes at once.
SLICE, MET, PAIRS = 200_000, 2_000_000, 100_000


def place_of(df: DataFrame, column: str) -> Column:
    """A date, timestamp or number as a whole or real number in the same order."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    return F.col(column).cast("long" if isinstance(kind, T.IntegralType) else "double")


def range_of(place: Column, cuts: Column, steps: list[int]) -> Column:
    """How many of the ascending ``cuts`` are at most ``place``, by halving steps."""
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, step: F.when(F.get(cuts, n + step - 1) <= place, n + step).otherwise(n))


def interval_join(rows: DataFrame, intervals: DataFrame, at: str, first: str = "first", last: str = "last", ranges: int | None = None, rows_a_task: int = SLICE, intervals_a_task: int = MET) -> DataFrame:
    """All pairs of a row and an interval with first <= at <= last, with the columns of both but the interval's ends.

    Both ends belong to an interval; without ``at`` or an end, and where the ends are in the wrong order, there is no
    pair. NaN is no place. Repeated rows and intervals make a pair each. Names of the interval's other columns must not
    be names of the row's (ValueError).
    """
    kept = [c for c in intervals.columns if c not in (first, last)]
    if set(kept) & set(rows.columns):
        raise ValueError(f"both sides have {', '.join(sorted(set(kept) & set(rows.columns)))}")
    spark = rows.sparkSession
    if ranges is None:
        ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    place, low, high, cuts, part, salt, size = free_names(rows.select("*", *[F.lit(0).alias(c) for c in kept]), "place", "low", "high", "cuts", "part", "salt", "size")
    own = rows.withColumn(place, place_of(rows, at)).filter(F.col(place).isNotNull() & ~F.isnan(F.col(place).cast("double")))
    ends = intervals.select(*kept, place_of(intervals, first).alias(low), place_of(intervals, last).alias(high)).filter(F.col(low) <= F.col(high))
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    at_shares = own.agg(F.array_sort(F.array_distinct(F.percentile_approx(place, shares, max(10_000, 20 * ranges))))).scalar()
    steps = [1 << i for i in reversed(range(ranges.bit_length()))]
    own = own.withColumn(cuts, at_shares).withColumn(part, range_of(F.col(place), F.col(cuts), steps)).drop(cuts)
    sizes = own.groupBy(part).agg(F.ceil(F.count(F.lit(1)) / rows_a_task).cast("int").alias(size))  # one row a range
    own = own.join(F.broadcast(sizes), part).withColumn(salt, F.pmod(F.xxhash64(*rows.columns, F.monotonically_increasing_id()), F.col(size)).cast("int")).drop(size)
    reached = F.sequence(range_of(F.col(low), F.col(cuts), steps), range_of(F.col(high), F.col(cuts), steps))
    ends = ends.withColumn(cuts, at_shares).withColumn(part, F.explode(reached)).drop(cuts).join(F.broadcast(sizes), part)
    ends = ends.withColumn(salt, F.explode(F.sequence(F.lit(0), F.col(size) - 1))).drop(size)
    row, kind, side, other = free_names(rows.select("*", *[F.lit(0).alias(c) for c in (*kept, place, low, high, part, salt)]), "row", "interval", "side", "turn")
    many = ends.groupBy(part, salt).agg(F.ceil(F.count(F.lit(1)) / intervals_a_task).cast("int").alias(size))
    own = own.join(F.broadcast(many), [part, salt]).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(size) - 1)))
    ends = ends.join(F.broadcast(many), [part, salt]).withColumn(other, F.pmod(F.xxhash64(low, high, F.monotonically_increasing_id()), F.col(size)).cast("int"))
    at_type = own.schema[place].dataType
    own = own.select(part, salt, other, F.lit(0).alias(side), F.col(place).alias(low), F.lit(None).cast(at_type).alias(high), F.struct(*rows.columns).alias(row))
    ends = ends.select(part, salt, other, F.lit(1).alias(side), low, high, F.struct(*kept).alias(kind))
    both = own.unionByName(ends, allowMissingColumns=True).repartition(part, salt, other).sortWithinPartitions(part, salt, other, side, low)
    names = [*rows.columns, *kept]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, places = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)
            edges = np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1
            for a, b in zip([0, *edges], [*edges, len(group)], strict=True):
                *of, on = group[a].tolist()
                piece = batch.slice(a, b - a)
                if of != now:
                    now, held, places = of, [], []
                if on == 0:
                    held.append(piece.column(6)), places.append(piece.column(4).to_numpy())
                elif held:
                    if len(held) > 1:
                        held, places = [pa.concat_arrays(held)], [np.concatenate(places)]
                    ends = piece.column(7)
                    for i, j in runs(places[0], piece.column(4).to_numpy(), piece.column(5).to_numpy()):
                        yield pa.record_batch([*held[0].take(pa.array(i)).flatten(), *ends.take(pa.array(j)).flatten()], names)

    schema = T.StructType([*rows.schema.fields, *[intervals.schema[c] for c in kept]])
    return both.select(part, salt, other, side, low, high, row, kind).mapInArrow(sweep, schema)


def runs(places: np.ndarray, low: np.ndarray, high: np.ndarray, size: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of a place, index of an interval) of all pairs of sorted ``places`` and intervals, at most ``size`` at once."""
    start = np.searchsorted(places, low, "left")
    ends = np.cumsum(np.maximum(np.searchsorted(places, high, "right") - start, 0))
    for first in range(0, int(ends[-1]) if len(ends) else 0, size):
        pair = np.arange(first, min(first + size, ends[-1]))
        which = np.searchsorted(ends, pair, "right")
        yield start[which] + pair - np.where(which > 0, ends[which - 1], 0), which


def interval_totals(rows: DataFrame, intervals: DataFrame, at: str, values: list[str], first: str = "first", last: str = "last") -> DataFrame:
    """For each distinct row of the interval's other columns that meets any: its ``n`` pairs, and the sums of ``values``.

    No column of either side may be named n. The same as grouping ``interval_join``, but rows of one place are summed first, so an interval meets no more sums than
    there are places between its ends. Sums are of values that meet, never differences of running sums, which would lose
    digits. Nulls are left out of a sum, which is null where there is nothing else.
    """
    kept = [c for c in intervals.columns if c not in (first, last)]
    sums = rows.groupBy(at).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in values])
    return interval_join(sums, intervals, at, first, last).groupBy(*kept).agg(*[F.sum(c).alias(c) for c in ("n", *values)])
