"""Positions along time-stamped tracks (track, seq, t, x, y) and along paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions import geodesy as G
from terraloom.functions.num import div


def segments(track: DataFrame) -> DataFrame:
    """Each row of a track with the next one (t1, x1, y1); the last row has none."""
    w = Window.partitionBy("track").orderBy("t", "seq")
    return track.select("track", "seq", "t", "x", "y", *[F.lead(n).over(w).alias(f"{n}1") for n in ("t", "x", "y")])


def positions_at(track: DataFrame, asks: DataFrame) -> DataFrame:
    """track, at, x, y: place at each asked time (track, at), linear between rows, kept at both ends."""
    ends = track.groupBy("track").agg(F.min("t").alias("t_first"), F.max("t").alias("t_last"))
    asked = asks.select("track", "at").join(ends, "track").withColumn("when", F.least("t_last", F.greatest("t_first", "at")))
    s = segments(track).withColumnRenamed("track", "k")
    hit = asked.join(s, (F.col("track") == F.col("k")) & (F.col("when") >= F.col("t")) & (F.col("t1").isNull() | (F.col("when") < F.col("t1"))))
    u = F.coalesce(div(F.col("when") - F.col("t"), F.col("t1") - F.col("t")), F.lit(0.0))
    return hit.select("track", "at", (F.col("x") + u * (F.coalesce("x1", "x") - F.col("x"))).alias("x"), (F.col("y") + u * (F.coalesce("y1", "y") - F.col("y"))).alias("y"))


def trail(track: DataFrame, asks: DataFrame, seconds: float) -> DataFrame:
    """Rows of each track within ``seconds`` before each asked time."""
    a = asks.select(F.col("track").alias("k"), "at")
    return track.join(a, (F.col("track") == F.col("k")) & (F.col("t") <= F.col("at")) & (F.col("t") >= F.col("at") - seconds)).drop("k")


def lengths(track: DataFrame, radius: float = G.A) -> DataFrame:
    """track, metres, rows."""
    s = segments(track)
    return s.groupBy("track").agg(F.coalesce(F.sum(G.haversine("x", "y", "x1", "y1", radius)), F.lit(0.0)).alias("metres"), F.count(F.lit(1)).alias("rows"))


def evenly_spaced(track: DataFrame, n: int, radius: float = G.A) -> DataFrame:
    """track, i, metres, x, y: n samples at even distances along each track."""
    s = segments(track).withColumn("d", F.coalesce(G.haversine("x", "y", "x1", "y1", radius), F.lit(0.0)))
    w = Window.partitionBy("track").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("from", F.coalesce(F.sum("d").over(w), F.lit(0.0)))
    total = s.groupBy("track").agg(F.max(F.col("from") + F.col("d")).alias("total")).withColumnRenamed("track", "k")
    asked = total.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("metres", F.col("total") * F.col("i") / max(1, n - 1))
    last = F.col("x1").isNull()
    on = (F.col("track") == F.col("k")) & (((F.col("metres") >= F.col("from")) & (F.col("metres") < F.col("from") + F.col("d"))) | (last & (F.col("metres") >= F.col("from"))))
    u = F.coalesce(div(F.col("metres") - F.col("from"), F.col("d")), F.lit(0.0))
    hit = s.join(asked, on)
    return hit.select("track", "i", "metres", (F.col("x") + u * (F.coalesce("x1", "x") - F.col("x"))).alias("x"), (F.col("y") + u * (F.coalesce("y1", "y") - F.col("y"))).alias("y"))
