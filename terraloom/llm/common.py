"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.plans.lineage import cut, shared_dir  # noqa: F401

#: Words are maximal runs of anything but space, tab, LF, VT, FF and CR; Java and RE2 read it alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def blocks_for(df: DataFrame, per_input_partition: int = 1, least: int = 8) -> int:
    """Number of hash blocks that keeps the rows of a block steady as the input grows.

    Input partitions have a bounded size, so a block count proportional to
    their number bounds a block.  Only the plan is looked at, no rows.
    """
    parts = df.rdd.getNumPartitions() * per_input_partition
    return max(least, parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def words_native(text: str):
    """Column: number of words in ``text`` (null text: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
