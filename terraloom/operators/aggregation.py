"""Values of points summed up by the polygon they lie in, one row for every polygon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.functions.num import finite
from terraloom.operators.spatial_join import points_in_polygons

AGGREGATES = {
    "count": lambda v: F.count(F.lit(1)),
    "sum": F.sum,
    "avg": F.avg,
    "median": F.median,
    "deviation": F.stddev_pop,
    "min": F.min,
    "max": F.max,
}


def aggregate_points(polygons: DataFrame, points: DataFrame, polygon_id: str, value: str, how=("count", "sum", "avg", "median", "deviation"), step: float | None = None) -> DataFrame:
    """polygon_id and one column for each of ``how``.

    Only finite numbers count for values; without any the result is null.
    ``count`` counts points, 0 where there are none.
    """
    inside = points_in_polygons(polygons.select(polygon_id, "polygon"), points.select("x", "y", finite(value).alias("_v")), step=step)
    sums = inside.groupBy(polygon_id).agg(*[AGGREGATES[h](F.col("_v")).alias(h) for h in how])
    out = polygons.select(polygon_id).join(sums, polygon_id, "left")
    return out.withColumn("count", F.coalesce("count", F.lit(0))) if "count" in how else out


def collect_points(polygons: DataFrame, points: DataFrame, polygon_id: str, value: str, order: str, step: float | None = None) -> DataFrame:
    """polygon_id and the values of its points in the order of ``order``; null values are kept."""
    inside = points_in_polygons(polygons.select(polygon_id, "polygon"), points.select("x", "y", F.col(order).alias("_o"), F.col(value).alias("_v")), step=step)
    lists = inside.groupBy(polygon_id).agg(F.sort_array(F.collect_list(F.struct("_o", "_v"))).alias("_l"))
    return polygons.select(polygon_id).join(lists, polygon_id, "left").select(polygon_id, F.coalesce(F.transform("_l", lambda s: s["_v"]), F.array()).alias("values"))
