"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code is cut into 4 segments of 16 bits, and every distinct code is
indexed under each segment's value.  A query looks up its own segment values,
then all values at one bit, at two bits, and so on.  Once the segments have
been searched up to radius r, every code within 4 (r + 1) - 1 bits has been
met, so a query is done when its k-th verified distance is within that bound;
only the others go on to the next radius.  The result is exact.

Equal codes are one index entry with their k + 1 smallest ids, which is all a
top-k with ties to the smaller id can ask for.  Index entries are dealt by
segment value into blocks; a value held by many distinct codes is salted over
several blocks, and a probe of it goes to all of them.  A block returns at most
k rows for a query.

Rows with a null id or a null vector take no part; a null or NaN component
gives bit 0, components beyond 64 are left out, missing ones give 0.  Repeated
rows count once.  A query never finds its own id.  With fewer than k other rows
all are returned.  Other columns are ignored, empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloom.llm.common import blocks_for, cut, table

BITS, SEGMENTS, WIDTH = 64, 4, 16
K, EVERY, BLOCK_CODES = 10, 50, 50_000

FOUND = "query_id long, vec_id long, distance int"


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, code: bit i is 1 if component i is above zero."""
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    clean = F.transform(F.slice(vectors[vec_col], 1, BITS), lambda x: F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x.cast("double")))
    code = F.aggregate(F.transform(clean, bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return vectors.where(vectors[id_col].isNotNull() & vectors[vec_col].isNotNull()).select(vectors[id_col].cast("long").alias("id"), code.alias("code"))


def _segment(code: Column, s: int) -> Column:
    return F.shiftrightunsigned(code, s * WIDTH).bitwiseAND(F.lit(0xFFFF)).cast("int")


def _masks(radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for bits in combinations(range(WIDTH), radius)]


def _search(k: int):
    """Group function over a block: the k nearest rows of its probed codes for every query."""

    def search(index: pa.Table, probes: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if index.num_rows and probes.num_rows:
            seg, value = index.column("seg").to_numpy(), index.column("value").to_numpy()
            key = seg.astype(np.int64) << WIDTH | value
            order = np.argsort(key, kind="stable")
            key, code = key[order], index.column("code").to_numpy().view(np.uint64)[order]
            ids = index.column("ids").combine_chunks()
            n_ids = np.diff(ids.offsets.to_numpy())
            id_at = (ids.offsets.to_numpy()[:-1])[order]
            n_ids, flat_ids = n_ids[order], ids.values.to_numpy()
            values = probes.column("values").combine_chunks()
            v_at, v_all = values.offsets.to_numpy(), values.values.to_numpy()
            rows = zip(probes.column("query_id").to_pylist(), probes.column("query_code").to_numpy().view(np.uint64), probes.column("seg").to_pylist(), v_at[:-1], v_at[1:])
            for qid, qcode, s, a, b in rows:
                probe = v_all[a:b].astype(np.int64) | (s << WIDTH)
                lo, hi = np.searchsorted(key, probe), np.searchsorted(key, probe, side="right")
                n = hi - lo
                total = int(n.sum())
                if not total:
                    continue
                at = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(total)
                dist = np.bitwise_count(code[at] ^ qcode)
                if total > k + 1:  # k + 1 codes hold k rows besides the query's own
                    near = dist <= np.partition(dist, k)[k]
                    at, dist = at[near], dist[near]
                m = n_ids[at]
                spread = np.repeat(id_at[at] - np.append(0, np.cumsum(m)[:-1]), m) + np.arange(int(m.sum()))
                found, dist = flat_ids[spread], np.repeat(dist, m)
                other = found != qid
                found, dist = found[other], dist[other]
                best = np.lexsort((found, dist))[:k]
                out.append((np.full(len(best), qid), found[best], dist[best]))
        q, f, d = (np.concatenate(x) for x in zip(*out)) if out else ([], [], [])
        return pa.table([pa.array(q, pa.int64()), pa.array(f, pa.int64()), pa.array(np.asarray(d, np.int32), pa.int32())], ["query_id", "vec_id", "distance"])

    return search


def search_codes(codes: DataFrame, queries: DataFrame, k: int = K, block_codes: int = BLOCK_CODES) -> DataFrame:
    """The ``k`` rows of ``codes`` nearest to each of ``queries`` (both: id, code): query_id, rank, vec_id, distance."""
    codes = codes.distinct()
    in_code = Window.partitionBy("code").orderBy("id")
    some = codes.withColumn("nth", F.row_number().over(in_code)).where(F.col("nth") <= k + 1)
    index = cut(some.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    rows, n_codes = codes.count(), index.count()
    segments = F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), _segment(F.col("code"), s).alias("value")) for s in range(SEGMENTS)]))
    entries = index.select("code", "ids", segments.alias("k")).select("code", "ids", "k.seg", "k.value")
    n_blocks = blocks_for(codes, least=max(8, SEGMENTS * n_codes // block_codes))
    part = max(1, block_codes // 2)
    hot = cut(entries.groupBy("seg", "value").count().where(F.col("count") > part).select(F.col("seg").alias("hot_seg"), F.col("value").alias("hot_value"), F.ceil(F.col("count") / part).cast("int").alias("salts")))
    is_hot = (F.col("seg") == F.col("hot_seg")) & (F.col("value") == F.col("hot_value"))
    block = lambda salt: F.pmod(F.xxhash64("seg", "value", salt), F.lit(n_blocks)).cast("int").alias("block")
    entries = entries.join(hot, is_hot, "left").withColumn("salt", F.pmod(F.xxhash64("code"), F.coalesce("salts", F.lit(1))).cast("int"))
    entries = cut(entries.select(block(F.col("salt")), "seg", "value", "code", "ids"))
    asked = cut(queries.distinct().select(F.col("id").alias("query_id"), F.col("code").alias("query_code")))
    open_queries, best = asked, None
    for radius in range(WIDTH + 1):
        own = F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), _segment(F.col("query_code"), s).alias("value")) for s in range(SEGMENTS)]))
        # each query makes hundreds of probes, so the queries are dealt out before
        spread = open_queries.repartition(n_blocks, "query_id")
        probes = spread.select("query_id", "query_code", own.alias("k")).select("query_id", "query_code", "k.seg", F.col("k.value").alias("home"))
        # the 16-bit values at this distance, one constant of the plan
        masks = F.from_json(F.lit(str(_masks(radius))), "array<int>")
        probes = probes.withColumn("mask", F.explode(masks)).select("query_id", "query_code", "seg", F.col("home").bitwiseXOR(F.col("mask")).alias("value"))
        probes = probes.join(hot, is_hot, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        asks = probes.select(block(F.col("salt")), "query_id", "query_code", "seg", "value").groupBy("block", "query_id", "query_code", "seg").agg(F.collect_set("value").alias("values"))
        found = entries.groupBy("block").cogroup(asks.groupBy("block")).applyInArrow(_search(k), FOUND)
        if best is not None:
            found = found.union(best)
        nearest = Window.partitionBy("query_id").orderBy("distance", "vec_id")
        best = cut(found.distinct().withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "vec_id", "distance"))
        bound = SEGMENTS * (radius + 1) - 1
        done = best.where(F.col("distance") <= bound).groupBy("query_id").count().where(F.col("count") >= min(k, rows - 1)).select(F.col("query_id").alias("done_id"))
        open_queries = cut(asked.join(done, F.col("query_id") == F.col("done_id"), "left_anti"))
        if open_queries.isEmpty():
            break
    nearest = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return best.select("query_id", F.row_number().over(nearest).alias("rank"), "vec_id", "distance")


def op5_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = sign_codes(table(spark, sf_dir, "embeddings"))
    return search_codes(codes, codes.where(F.col("id") % EVERY == 0))


OP5_SQL = """
WITH codes AS (
  SELECT DISTINCT vec_id AS id, list_sum([CASE WHEN embedding[i] > 0 THEN 1::HUGEINT << (i - 1)::INT ELSE 0 END FOR i IN range(1, 65)])::UBIGINT AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), pairs AS (
  SELECT q.id AS query_id, c.id AS vec_id, bit_count(xor(q.code, c.code))::INT AS distance FROM codes q JOIN codes c ON q.id % 50 = 0 AND q.id <> c.id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id))::INT AS rank, vec_id, distance
FROM pairs QUALIFY rank <= 10
"""
