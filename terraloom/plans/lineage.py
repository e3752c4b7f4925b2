"""Reliable checkpoints and shared tables for iterative jobs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    A folder of our own is used only where the session has no such setting and
    runs on one machine; on a cluster the missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/terraloom-checkpoints"


def sequential(df: DataFrame, *order, name: str = "n") -> DataFrame:
    """``df`` with a gapless number from 0 in the given order (which should decide all ties).

    Rows are dealt by range and numbered inside their partitions; only one count
    a partition is put in sequence.
    """
    part = cut(df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = part.groupBy(F.col("_part").alias("_p")).count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0)))
    return part.join(F.broadcast(starts), F.col("_part") == F.col("_p")).withColumn(name, F.col("_start") + F.col("_in")).drop("_part", "_in", "_p", "count", "_start")  # a row a partition


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame, *keys) -> DataFrame:
    """``df`` dealt evenly, or by ``keys``, over several tasks a core.

    For steps whose work doesn't show in the bytes of their input, by which
    Spark sizes tasks: joins with many candidates, costly functions of a row.
    The fixed number keeps adaptive execution from merging the tasks again.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def once_each(df: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with the columns that ``compute`` adds to ``keys``, a costly function of theirs, worked out once for each distinct value."""
    own = compute(spread(df.select(*keys).distinct(), *keys))
    names = [n for n in own.columns if n not in keys]
    other = own.select(*[F.col(k).alias(f"_{k}") for k in keys], *names)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.join(other, same).drop(*[f"_{k}" for k in keys])
