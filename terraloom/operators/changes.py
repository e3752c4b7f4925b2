"""Differences of snapshots, and keyed state from a log of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str, content: list[str]) -> DataFrame:
    """key, status: added, removed, modified or unchanged, by the content columns (null equals null)."""
    side = lambda df, n: df.select(F.col(key).alias(f"k{n}"), F.struct(*content).alias(f"c{n}"))
    both = side(old, 0).join(side(new, 1), F.col("k0") == F.col("k1"), "full")
    status = F.when(F.col("k0").isNull(), "added").when(F.col("k1").isNull(), "removed").when(F.col("c0").eqNullSafe(F.col("c1")), "unchanged").otherwise("modified")
    return both.select(F.coalesce("k0", "k1").alias(key), status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of or beside its own."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def state(log: DataFrame, keys: list[str]) -> DataFrame:
    """keys, attribute, value after a log (keys, ord, op, patch: map<string, string>).

    ``set`` and ``add`` merge their patch, the last write of an attribute wins;
    ``remove`` drops the key, ``clear`` too.  Both steps are combined aggregates,
    so a key with many changes isn't gathered anywhere.
    """
    gone = log.where(F.col("op").isin("remove", "clear")).groupBy(*keys).agg(F.max("ord").alias("gone"))
    writes = log.where(F.col("op").isin("set", "add", "update")).select(*keys, "ord", F.explode("patch").alias("attribute", "value"))
    last = writes.groupBy(*keys, "attribute").agg(F.max("ord").alias("ord"), F.max_by("value", "ord").alias("value"))
    return last.join(gone, keys, "left").where(F.col("gone").isNull() | (F.col("ord") > F.col("gone"))).select(*keys, "attribute", "value")


def suppress_overlaps(labels: DataFrame, label_id: str, box: str, priority: str, most_rounds: int = 1000) -> DataFrame:
    """Ids of the labels that stay when higher priority (then smaller id) wins over overlapping boxes.

    Each round keeps every label that beats all open neighbours and drops those
    that overlap a kept one; chains of overlaps bound the rounds.  Of labels
    with the same box only the first can stay, so only that one takes part.
    """
    from terraloom.operators.spatial_join import boxes_overlap
    from terraloom.plans.lineage import cut

    own = labels.select(F.col(label_id).alias("a"), F.col(box).alias("abox"), F.struct(F.col(priority).alias("p"), (-F.col(label_id)).alias("o")).alias("ap"))
    own = own.where("abox IS NULL").unionByName(own.where("abox IS NOT NULL").groupBy("abox").agg(F.max_by("a", "ap").alias("a"), F.max("ap").alias("ap")))
    own = cut(own.select("a", "abox", "ap"))
    other = own.toDF("b", "bbox", "bp")
    rivals = cut(boxes_overlap(own, other, "abox", "bbox").where("bp > ap").select("a", "b"))  # b beats a
    todo, kept = cut(own.select("a")), None
    for _ in range(most_rounds):
        win = cut(todo.join(rivals.select("a").distinct(), "a", "left_anti"))
        kept = win if kept is None else kept.union(win)
        out = rivals.join(win.withColumnRenamed("a", "b"), "b", "left_semi").select("a").distinct()
        todo = cut(todo.join(win, "a", "left_anti").join(out, "a", "left_anti"))
        if todo.isEmpty():
            return kept.select(F.col("a").alias(label_id))
        rivals = cut(rivals.join(todo, "a", "left_semi").join(todo.withColumnRenamed("a", "b"), "b", "left_semi"))
    raise RuntimeError(f"chains of more than {most_rounds} overlaps")
