"""Mixing sources to target weights, with DataFrame functions only.

Sources in code point order (null last) get the weights in turn; together they
share ``share`` times all words.  A target stops at ``cap`` times its source's
size, and the excess is shared again by weight until none is above: that is the
water level L with sum(min(cap * size, L * weight)) = budget, found in one pass
over the sources ordered by cap / weight.  Rate = target / source size; a
document is emitted floor(rate) times, plus once more if a hash of the seed and
its id falls below the fraction.

Sizes count words (null text: 0).  A source without words has target 0 and its
documents are taken never.  Repeated rows share an id, therefore a draw.  A null
source is a source of its own; a null id is hashed as the text "null".  Extra
columns are ignored.  An empty table gives an empty result.

Documents meet only in the per-source sums, which are combined before the
shuffle; the sources' table (one row per distinct source) is what the single
ordered window sees, and it is joined back by source.  That join is a broadcast
when Spark sees that the table is small, else a sort-merge join which adaptive
execution splits where one source is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloom.llm.common import table, words_native

WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), 1.5, 2.0, "mix"


def uniform(seed: str, key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """From (source, size): source, source_size, target."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everyone = Window.partitionBy()
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(ranked) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int")))
    per = per.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everyone))
    # With the sources in order of most / weight, the first j are full; the level is that of the first source that isn't.
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", (F.col("budget") - full) / open_weight)
    # That value grows up to the level and falls after it, so the level is its maximum.
    target = F.least("most", F.max("level").over(everyone) * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every row of ``docs``."""
    sized = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].alias("source"), docs[text_col].alias("text")).select("doc_id", "source", words_native("text").alias("size"))
    targets = source_targets(sized, weights, share, cap).withColumnRenamed("source", "target_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = sized.join(targets, sized["source"].eqNullSafe(targets["target_source"]), "left").withColumn("rate", rate)
    extra = (uniform(seed, F.col("doc_id")) < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("copies", F.floor("rate") + extra).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The rows of ``docs``, each as often as its source's rate says; the columns stay as they are."""
    names = docs.columns
    inner = F.struct(*[docs[c] for c in names])
    sized = docs.select(inner.alias("row"), docs[id_col].cast("long").alias("key"), docs[source_col].alias("source"), docs[text_col].alias("text")).select("row", "key", "source", words_native("text").alias("size"))
    targets = source_targets(sized.select("source", "size"), weights, share, cap).withColumnRenamed("source", "target_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = sized.join(targets, sized["source"].eqNullSafe(targets["target_source"]), "left").withColumn("rate", rate)
    copies = F.floor("rate") + (uniform(seed, F.col("key")) < F.col("rate") - F.floor("rate")).cast("long")
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("copy")).select(*[F.col("row").getField(c).alias(c) for c in names])


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0e0, 1.0e0, 2.0e0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source
), capped AS (
  SELECT *, 2.0e0 * source_size AS most, 1.5e0 * sum(source_size) OVER () AS budget FROM per
), levels AS (
  SELECT *, (budget - coalesce(sum(most) OVER before, 0e0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0e0)) AS own
  FROM capped WINDOW before AS (ORDER BY most / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), leveled AS (
  SELECT *, max(own) OVER () AS level FROM levels
), targets AS (
  SELECT source, source_size, least(most, level * weight) AS target FROM leveled
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0e0 END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  ((floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496e0 < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM rated
"""
