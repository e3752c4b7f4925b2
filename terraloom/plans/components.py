"""Connected components and pointer jumping as joins with checkpoints between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.plans.lineage import cut


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From edges (u, v): node, root, the smallest node of its component.

    Alternating large-star and small-star steps: every round is two combined
    minima and two joins, and the number of rounds grows with the logarithm of
    the number of nodes.  Nodes without edges don't come out.
    """
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    last = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("node")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), "m")
        small = large.join(low, F.col("u") == F.col("node")).where("v != m").select("v", "m")
        edges = cut(small.union(low).toDF("u", "v").where("u != v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.toDF("node", "root").union(roots)
        last = now
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def jump_to_root(parents: DataFrame, most_rounds: int = 40) -> DataFrame:
    """From (node, parent), where a root is its own parent: node, root, by doubling the jumps."""
    now = cut(parents.select("node", "parent"))
    for _ in range(most_rounds):
        up = now.select(F.col("node").alias("p"), F.col("parent").alias("next"))
        after = cut(now.join(up, F.col("parent") == F.col("p")).select("node", F.col("next").alias("parent"), (F.col("next") != F.col("parent")).alias("moved")))
        now = after.select("node", "parent")
        if after.where("moved").isEmpty():
            return now.withColumnRenamed("parent", "root")
    raise RuntimeError(f"paths longer than 2^{most_rounds}")


def subtree_sizes(parents: DataFrame, most_rounds: int = 40) -> DataFrame:
    """From (node, parent), parent null at a root: node, size of the tree below, itself included.

    Jumps double every round, and each round adds what stands at that jump's
    distance below, so the rounds grow with the logarithm of the depth.
    """
    now = cut(parents.select("node", "parent", F.lit(1).cast("long").alias("size")))
    for _ in range(most_rounds):
        if now.where("parent IS NOT NULL").isEmpty():
            return now.select("node", "size")
        below = now.where("parent IS NOT NULL").groupBy(F.col("parent").alias("p")).agg(F.sum("size").alias("more"))
        up = now.select(F.col("node").alias("q"), F.col("parent").alias("next"))
        grown = now.join(below, F.col("node") == F.col("p"), "left").select("node", "parent", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        now = cut(grown.join(up, F.col("parent") == F.col("q"), "left").select("node", F.col("next").alias("parent"), "size"))
    raise RuntimeError(f"paths longer than 2^{most_rounds}, or a cycle")
