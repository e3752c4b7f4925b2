"""Features cut into tiles: explode the covering tiles, clip, group by tile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.functions import shapes as S
from terraloom.functions import tiles as T
from terraloom.functions.num import c


def point_tiles(points: DataFrame, z: int, x: str = "x", y: str = "y") -> DataFrame:
    """Each point with its tile at a zoom."""
    tx, ty = T.tile_of(c(x), c(y), F.lit(z), True)
    return points.withColumn("z", F.lit(z)).withColumn("tx", tx).withColumn("ty", ty)


def cut_rings(features: DataFrame, feature_id: str, ring: str, z: int, margin: float = 64 / 4096) -> DataFrame:
    """feature_id, z, tx, ty, ring: every ring clipped to each tile it meets, with a margin in parts of a tile.

    Rings without three corners left in a tile are dropped.
    """
    b = S.bounds(F.col(ring))
    own = features.select(F.col(feature_id), F.col(ring).alias("ring"), F.explode(T.covering_tiles(b.west, b.south, b.east, b.north, F.lit(z))).alias("t"))
    w, s, e, n = T.tile_bounds(F.col("t.z"), F.col("t.x"), F.col("t.y"))
    dx, dy = (e - w) * margin, (n - s) * margin
    out = own.select(feature_id, F.lit(z).alias("z"), F.col("t.x").alias("tx"), F.col("t.y").alias("ty"), S.clip_ring("ring", w - dx, s - dy, e + dx, n + dy).alias("ring"))
    return out.where(F.size("ring") >= 3)


def split_at_antimeridian(lines: DataFrame, feature_id: str, line: str) -> DataFrame:
    """feature_id, part, line: lines cut where two neighbours are more than 180 degrees apart, ends at +-180."""
    pts = lines.select(feature_id, F.posexplode(line).alias("i", "p"))
    from pyspark.sql import Window

    w = Window.partitionBy(feature_id).orderBy("i")
    pts = pts.withColumn("before", F.lag("p").over(w)).withColumn("jump", F.coalesce(F.abs(F.col("p.x") - F.col("before.x")) > 180, F.lit(False)))
    pts = pts.withColumn("part", F.sum(F.col("jump").cast("int")).over(w))
    side = F.when(F.col("before.x") > 0, 180.0).otherwise(-180.0)
    far = F.col("p.x") + 2 * side
    y = F.col("before.y") + F.try_divide(side - F.col("before.x"), far - F.col("before.x")) * (F.col("p.y") - F.col("before.y"))
    own = pts.select(feature_id, "part", F.col("i").cast("double").alias("o"), "p")
    enter = pts.where("jump").select(feature_id, "part", (F.col("i") - 0.25).alias("o"), S.point(-side, y).alias("p"))
    leave = pts.where("jump").select(feature_id, (F.col("part") - 1).alias("part"), (F.col("i") - 0.75).alias("o"), S.point(side, y).alias("p"))
    every = own.union(enter).union(leave)
    return every.groupBy(feature_id, "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "p"))), lambda s: s["p"]).alias("line"))
