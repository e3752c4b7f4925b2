"""Grids over a box: squares, hexagons, triangles, made by range joins of two number columns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions import shapes as S


def _lattice(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """row, col in row-major order with their number as id."""
    return spark.range(rows * cols).select("id", F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))


def square_grid(spark: SparkSession, west: float, south: float, east: float, north: float, size: float) -> DataFrame:
    """id, row, col, polygon; the last row and column end at the box."""
    if size <= 0 or east <= west or north <= south:
        return _lattice(spark, 0, 1).select("id", "row", "col", F.array(S.box_ring(0, 0, 0, 0)).alias("polygon"))
    cols, rows = math.ceil((east - west) / size), math.ceil((north - south) / size)
    x, y = west + F.col("col") * size, south + F.col("row") * size
    return _lattice(spark, rows, cols).select("id", "row", "col", F.array(S.box_ring(x, y, F.least(x + size, F.lit(east)), F.least(y + size, F.lit(north)))).alias("polygon"))


def hex_grid(spark: SparkSession, west: float, south: float, east: float, north: float, size: float) -> DataFrame:
    """Flat-top hexagons of circumradius ``size``; odd columns stand half a cell higher; centres lie in the box."""
    dx, dy = 1.5 * size, math.sqrt(3) * size
    cols, rows = math.floor((east - west) / dx) + 1, math.floor((north - south) / dy) + 1
    x = west + F.col("col") * dx
    y = south + F.col("row") * dy + F.when(F.col("col") % 2 == 1, dy / 2).otherwise(0.0)
    cells = _lattice(spark, rows, cols).withColumn("x", x).withColumn("y", y).where((F.col("x") <= east) & (F.col("y") <= north))
    corners = [(F.col("x") + size * math.cos(math.pi / 3 * k), F.col("y") + size * math.sin(math.pi / 3 * k)) for k in (0, 1, 2, 3, 4, 5, 0)]
    return cells.withColumn("polygon", F.array(S.ring(*corners)))


def triangle_grid(spark: SparkSession, west: float, south: float, east: float, north: float, size: float) -> DataFrame:
    """Two triangles for each square, the lower right and the upper left one."""
    cols, rows = math.ceil((east - west) / size), math.ceil((north - south) / size)
    x, y = west + F.col("col") * size, south + F.col("row") * size
    low = F.array(S.ring((x, y), (x + size, y), (x + size, y + size), (x, y)))
    up = F.array(S.ring((x, y), (x + size, y + size), (x, y + size), (x, y)))
    return _lattice(spark, rows, cols).select("row", "col", F.posexplode(F.array(low, up)).alias("half", "polygon"))
