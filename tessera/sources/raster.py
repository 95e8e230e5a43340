"""Raster tiles as a Spark data source: partitions by tile and block of rows, filters and stride applied before reading.

    raster.register(spark)
    spark.read.format("raster_tiles").option("path", "/data/*.tile").option("rows", 1200).option("cols", 1200).load()

A tile file holds three planes of rows x cols: two of little-endian 16-bit reflectance and one of 8-bit quality; its
place is in its name (``hNNvNN``). Comparisons of h, v, row and col with constants choose files, blocks, rows and
columns, so that only the rows asked for are read, and of these only every ``stride``-th. Paths are read by Python on
the executors: a folder that all of them share.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "h int, v int, row int, col int, nir int, red int, qc int"
#: Bytes of a pixel in each plane, in the order of the planes.
PLANES = (("nir", "<i2"), ("red", "<i2"), ("qc", "i1"))
NAME = re.compile(r"h(\d{2})v(\d{2})")
FAR = 1 << 31


@dataclass
class Block(InputPartition):
    """Rows ``first`` to ``end`` - 1 of a tile file."""

    path: str
    h: int
    v: int
    first: int
    end: int

    def __post_init__(self) -> None:
        super().__init__((self.path, self.first))


@dataclass
class Wanted:
    """Bounds (both included) and chosen values of one column."""

    low: int = -FAR
    high: int = FAR
    among: frozenset[int] | None = None

    def __contains__(self, value: int) -> bool:
        return self.low <= value <= self.high and (self.among is None or value in self.among)

    def narrowed(self, f: Filter) -> bool:
        """Takes in a comparison; False if it isn't one that can be."""
        if isinstance(f, In) and all(isinstance(v, int) for v in f.value):
            self.among = frozenset(f.value) if self.among is None else self.among & frozenset(f.value)
        elif not isinstance(getattr(f, "value", None), int):
            return False
        elif isinstance(f, EqualTo):
            self.low, self.high = max(self.low, f.value), min(self.high, f.value)
        elif isinstance(f, GreaterThan | GreaterThanOrEqual):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
        elif isinstance(f, LessThan | LessThanOrEqual):
            self.high = min(self.high, f.value - isinstance(f, LessThan))
        else:
            return False
        return True


class TileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.rows, self.cols = int(options["rows"]), int(options["cols"])
        self.stride, self.block = int(options.get("stride", 5)), int(options.get("block", 240))
        if min(self.rows, self.cols, self.stride, self.block) < 1:
            raise ValueError("rows, cols, stride and block are at least 1")
        self.wanted = {c: Wanted() for c in ("h", "v", "row", "col")}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            column = getattr(f, "attribute", ("",))
            if not (len(column) == 1 and column[0] in self.wanted and self.wanted[column[0]].narrowed(f)):
                yield f

    def partitions(self) -> list[Block]:
        found = []
        for path in sorted(glob.glob(self.path)):
            place = NAME.search(os.path.basename(path))
            if place is None:
                raise ValueError(f"no hNNvNN in {path}")
            h, v = map(int, place.groups())
            if h in self.wanted["h"] and v in self.wanted["v"]:
                for first in range(0, self.rows, self.block):
                    end = min(first + self.block, self.rows)
                    if any(r in self.wanted["row"] for r in range(-(-first // self.stride) * self.stride, end, self.stride)):
                        found.append(Block(path, h, v, first, end))
        return found

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        wanted = [r for r in range(-(-partition.first // self.stride) * self.stride, partition.end, self.stride) if r in self.wanted["row"]]
        cols = np.array([c for c in range(0, self.cols, self.stride) if c in self.wanted["col"]], np.int32)
        with open(partition.path, "rb") as file:
            for row in wanted:
                planes, start = {}, 0
                for name, kind in PLANES:
                    width = np.dtype(kind).itemsize
                    file.seek(start + row * self.cols * width)
                    raw = self.fetched(file, self.cols * width)
                    planes[name] = np.frombuffer(raw, kind)[cols].astype(np.int32)
                    start += self.rows * self.cols * width
                fixed = {k: np.full(len(cols), v, np.int32) for k, v in (("h", partition.h), ("v", partition.v), ("row", row))}
                yield pa.record_batch({**fixed, "col": cols, **planes})

    @staticmethod
    def fetched(file, size: int) -> bytes:
        raw = file.read(size)
        if len(raw) != size:
            raise ValueError(f"{file.name} ends early")
        return raw


class RasterTiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster_tiles"

    def schema(self) -> T.StructType | str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> TileReader:
        return TileReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterTiles)
