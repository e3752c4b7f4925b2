"""Sharding over fixed virtual slots.

Records are hashed by id into thousands of virtual slots.  The bytes of each
slot are summed, and a slot-to-shard map is drawn up from those sums: the
heaviest slot goes to the lightest shard, and so on.  Maps are kept as numbered
versions in a table; ``rebalance`` edits the latest one by moving as few slots
as it takes, so most records stay where they are when sizes or the number of
shards change.

The law that holds is ``bytes``: shard sizes are near equal.  The map has at
most ``slots`` rows, a fixed number, so it may pass through the driver and be
broadcast.  Records never do: they meet only in sums by slot (combined before
the shuffle) and in a numbering inside each slot.

Null texts have no bytes and the crc of the empty string; records without an id
are spread by their size and crc.  Repeated rows are records of their own.  Extra columns are ignored.
Empty tables give an empty result and an even map.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloom.llm.common import scratch_path, table

SLOTS, SHARDS = 4096, 24


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def slot_sums(sized: DataFrame, slots: int = SLOTS) -> dict[int, tuple[int, int]]:
    """slot -> (bytes, rows); at most ``slots`` entries come to the driver."""
    rows = sized.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    found = {r["virtual_slot"]: (r["bytes"], r["rows"]) for r in rows}
    return {s: found.get(s, (0, 0)) for s in range(slots)}


def even_map(sums: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """Heaviest slot first to the lightest shard; ties go to the smaller number."""
    heap = [(0, k) for k in range(shards)]
    out = {}
    for slot in sorted(sums, key=lambda s: (-sums[s][0], s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + sums[slot][0], shard))
    return out


def rebalance(current: dict[int, int], sums: dict[int, tuple[int, int]], shards: int, slack: float = 0.01) -> dict[int, int]:
    """Edit a map for other sizes or a larger number of shards, moving few slots.

    Slots leave the heaviest shard for the lightest as long as that brings the
    two closer and some shard is above the mean by more than ``slack``.
    """
    out = dict(current)
    held: dict[int, set[int]] = {k: set() for k in range(shards)}
    homeless = []
    for slot, shard in out.items():
        (held[shard].add(slot) if shard < shards else homeless.append(slot))
    load = {k: sum(sums[s][0] for s in held[k]) for k in held}
    for slot in sorted(homeless, key=lambda s: (-sums[s][0], s)):
        to = min(load, key=lambda k: (load[k], k))
        out[slot] = to
        held[to].add(slot)
        load[to] += sums[slot][0]
    mean = sum(load.values()) / shards
    for _ in range(len(out)):
        high, low = max(load, key=lambda k: (load[k], -k)), min(load, key=lambda k: (load[k], k))
        gap = load[high] - load[low]
        if load[high] <= mean * (1 + slack) and load[low] >= mean * (1 - slack):
            break
        room = min(load[high] - mean, mean - load[low])
        movable = [s for s in held[high] if 0 < sums[s][0] < gap]
        if not movable:
            break
        best = min(movable, key=lambda s: (abs(sums[s][0] - room), s))
        held[high].remove(best)
        held[low].add(best)
        out[best] = low
        load[high] -= sums[best][0]
        load[low] += sums[best][0]
    return out


def save_map(spark: SparkSession, path: str, mapping: dict[int, int], sums: dict[int, tuple[int, int]], version: int) -> None:
    """Append one version of the map to the table at ``path``; earlier versions stay readable."""
    rows = [(version, s, mapping[s], sums[s][0], sums[s][1]) for s in sorted(mapping)]
    spark.createDataFrame(rows, "version int, virtual_slot int, shard int, bytes long, rows long").coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map, the latest by default."""
    maps = spark.read.parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version).drop("version")


def _stored(spark: SparkSession, path: str) -> bool:
    """Whether any version of a map is stored at ``path``, on whatever file system it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    ``slot`` numbers the records of a shard without gaps: the shard's virtual
    slots one after the other, records in each by id, size and crc.  With
    ``map_path`` the latest stored map there is rebalanced and stored as the
    next version; else a new map is stored in the shared folder.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col], F.lit(""))
    sized = docs.select(docs[id_col].cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")).withColumn("virtual_slot", F.when(F.col("doc_id").isNotNull(), slot_of(F.col("doc_id"), slots)).otherwise(F.pmod(F.xxhash64("size", "text_crc32"), F.lit(slots)).cast("int")))
    sums = slot_sums(sized, slots)
    path, version = map_path or scratch_path(spark, "slot-map"), 0
    if map_path is not None and _stored(spark, path):
        version = 1 + spark.read.parquet(path).agg(F.max("version")).first()[0]
        old = load_map(spark, path, version - 1)
        mapping = rebalance({r["virtual_slot"]: r["shard"] for r in old.select("virtual_slot", "shard").collect()}, sums, shards)
    else:
        mapping = even_map(sums, shards)
    save_map(spark, path, mapping, sums, version)
    before: dict[int, int] = {}
    offsets = []
    for s in sorted(mapping):
        k = mapping[s]
        offsets.append((s, k, before.get(k, 0)))
        before[k] = before.get(k, 0) + sums[s][1]
    placed = spark.createDataFrame(offsets, "virtual_slot int, shard int, offset long")
    in_slot = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    numbered = sized.withColumn("nth", F.row_number().over(in_slot).cast("long") - 1)
    return numbered.join(F.broadcast(placed), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version")
    )


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
