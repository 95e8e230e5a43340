"""Points in boxes, points in polygons, and dates in periods."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import quadtree

#: Boxes in degrees; sub-regions lie inside a larger one, so that a point may have several.
BOXES = [("west", -180.0, -90.0, 0.0, 90.0), ("east", 0.0, -90.0, 180.0, 90.0), ("tropics", -180.0, -23.5, 180.0, 23.5), ("north", -180.0, 23.5, 180.0, 90.0), ("core", -30.0, -15.0, 30.0, 15.0)]
#: Rings of vertices; a second ring inside the first is a hole.
POLYGONS = [
    ("diamond", [[(-40.0, 0.0), (0.0, 40.0), (40.0, 0.0), (0.0, -40.0)], [(-5.0, -5.0), (-5.0, 5.0), (5.0, 5.0), (5.0, -5.0)]]),
    ("wedge", [[(10.0, 10.0), (90.0, 20.0), (60.0, 70.0)]]),
]
PERIODS = [(1995, dt.date(1995, 1, 1), dt.date(1996, 12, 31)), (1997, dt.date(1997, 1, 1), dt.date(1998, 12, 31)), (1999, dt.date(1999, 1, 1), dt.date(2000, 6, 30))]


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Names like ``stems`` that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def boxes(spark: SparkSession, rows=BOXES) -> DataFrame:
    return spark.createDataFrame(rows, "region string, lon_min double, lat_min double, lon_max double, lat_max double")


def assign_boxes(points: DataFrame, dim: DataFrame) -> DataFrame:
    """One row per point and box that holds it, borders included. The boxes are a small literal dimension."""
    inside = F.col("lon").between(F.col("lon_min"), F.col("lon_max")) & F.col("lat").between(F.col("lat_min"), F.col("lat_max"))
    return points.join(F.broadcast(dim), inside).select(*points.columns, "region")


def polygons(spark: SparkSession, rows=POLYGONS) -> DataFrame:
    return spark.createDataFrame(rows, "polygon string, rings array<array<struct<x: double, y: double>>>")


def edges_of(rings: Column) -> Column:
    """All edges of all rings, each ring closed."""

    def closed(ring: Column) -> Column:
        return F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))

    return F.flatten(F.transform(rings, closed))


def inside_edges(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over edges; points on an edge aren't inside. Edges that no ray to the right of (x, y) meets may be absent."""
    crossed = F.filter(edges, lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]))
    on = F.exists(
        edges,
        lambda e: ((e["bx"] - e["ax"]) * (y - e["ay"]) == (e["by"] - e["ay"]) * (x - e["ax"])) & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])),
    )
    return (F.size(crossed) % 2 == 1) & ~on


def inside(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over all rings, so a ring within a ring is a hole; points on an edge aren't inside."""
    return inside_edges(edges_of(rings), x, y)


def within(points: DataFrame, shapes: DataFrame, capacity: int = 50_000, most_cells: int = 4_096) -> DataFrame:
    """(point columns, polygon): points inside polygons, by a quadtree whose cells split where points are many.

    A cell with more than ``capacity`` points (or than a ``most_cells``-th of all, if that is more) is split into four, so
    a crowded place is many cells and as many join keys, an empty one none. Polygons go down the tree and are clipped on
    the way: to each cell they keep the edges that can matter there; points of a cell that lies wholly inside are taken
    without a test. Overlapping polygons give a point several rows, points without coordinates none.
    """
    shapes = shapes.select("polygon", "rings")
    vertex = shapes.select(F.explode(F.flatten("rings")).alias("v"))
    low_x, low_y, high_x, high_y = vertex.agg(*[f(f"v.{c}") for f in (F.min, F.max) for c in ("x", "y")]).first()
    kind = shapes.schema["polygon"].dataType.simpleString()
    if low_x is None:
        return points.filter("false").withColumn("polygon", F.lit(None).cast(kind))
    area = quadtree.Area(low_x, low_y, high_x, high_y)
    near = points.filter(F.col("lon").between(low_x, high_x) & F.col("lat").between(low_y, high_y))
    own = free_names(points, "place", "cell", "starts")
    placed = near.withColumn(own[0], quadtree.code(area, F.col("lon"), F.col("lat")))
    tree = quadtree.grown(placed.select(F.col(own[0]).alias("code")), capacity, most_cells)
    cells = shapes.mapInPandas(lambda parts: quadtree.clipped(parts, area, tree), f"polygon {kind}, cell int, whole boolean, edges array<struct<ax: double, ay: double, bx: double, by: double>>")
    dealt = quadtree.with_leaf(placed, tree, own[0], own[1], own[2])
    hidden = cells.select(F.struct("polygon", "whole", "edges").alias("shape"), F.col("cell").alias("shape_cell"))
    both = dealt.select(F.struct(*points.columns).alias("point"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.col(own[1]).alias("point_cell")).join(hidden, F.col("point_cell") == F.col("shape_cell"))
    return both.filter(F.col("shape.whole") | inside_edges(F.col("shape.edges"), F.col("x"), F.col("y"))).select("point.*", "shape.polygon")


def periods(spark: SparkSession, rows=PERIODS) -> DataFrame:
    return spark.createDataFrame(rows, "vintage int, first date, last date")


def assign_periods(rows: DataFrame, dim: DataFrame) -> DataFrame:
    """Rows with the period that holds their date, both ends included; rows outside all periods go."""
    return rows.join(F.broadcast(dim), F.col("date").between(F.col("first"), F.col("last"))).select(*rows.columns, "vintage")
