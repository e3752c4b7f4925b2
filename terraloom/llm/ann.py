"""Approximate nearest neighbours by stable projections and a kd-tree.

Vectors are lifted so that the largest inner product is the smallest Euclidean
distance (one more component brings every vector to the largest norm), and
projected to 8 dimensions with Gaussian, hence 2-stable, weights: the projected
squared distance over the true one follows a chi-square law with 8 degrees of
freedom.  The projections are indexed by a kd-tree.  Its upper levels, split at
medians of a bounded sample (``sample`` projections), deal all vectors into
leaves of about ``leaf_rows``; inside a leaf a task splits on into buckets.

A query first searches the leaf it falls into: buckets come in order of their
projected distance, their vectors are verified by exact inner products, and the
search stops when the chi-square test holds: a vector at the next projected
distance or beyond would be nearer than the k-th found with probability at most
1 - ``sure``.  Then the query goes to those other leaves only that the test,
with its k-th distance so far, doesn't exclude, and searches them in the same
way.  All vectors are indexed, equal ones once with their k + 1 smallest ids.

Components are kept in double precision, so scores are those of the vectors as
given.  Null ids, and vectors that are null, zero, hold a null or non-finite component
or have another length than most, take no part.  A query never finds its own
id.  With fewer than k candidates all are found.  Repeated rows count once.
Other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloom.llm.common import cut, table

K, EVERY, DIMS, SURE, LEAF_ROWS, BUCKET_ROWS, SAMPLE, SEED = 20, 20, 8, 0.98, 20_000, 512, 50_000, 7

POINTS = "leaf int, vec array<double>, ids array<long>, proj array<double>"
FOUND = "query_id long, vec_id long, score double"


def chi2_quantile(p: float, dims: int) -> float:
    """Quantile of the chi-square law with an even number of degrees of freedom, by bisection."""
    low, high = 0.0, 50.0 * dims
    for _ in range(100):
        x = (low + high) / 2
        term = total = math.exp(-x / 2)
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - total < p else (low, x)
    return high


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec of the rows that take part; the length that most vectors have decides."""
    v = vectors[vec_col]
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = vectors.where(vectors[id_col].isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    own = own.select(vectors[id_col].cast("long").alias("id"), v.cast("array<double>").alias("vec"))
    most = own.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return own.where(F.size("vec") == (most["n"] if most else 0)).distinct()


class _Tree:
    """Upper levels of the kd-tree: splits at medians of a sample; leaves are numbered from 0."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.splits: list[tuple[int, float, int, int] | None] = []
        self.leaves = 0
        self._grow(points, leaves)

    def _grow(self, points: np.ndarray, leaves: int) -> int:
        me = len(self.splits)
        self.splits.append(None)
        if leaves > 1 and len(points) > 1:
            axis = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
            at = float(np.median(points[:, axis]))
            left = points[:, axis] < at
            if left.any() and not left.all():
                a = self._grow(points[left], leaves // 2)
                b = self._grow(points[~left], leaves - leaves // 2)
                self.splits[me] = (axis, at, a, b)
                return me
        self.splits[me] = (-1, 0.0, self.leaves, 0)
        self.leaves += 1
        return me

    def leaf(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            axis, at, a, b = self.splits[node]
            if axis < 0:
                out[rows] = a
            elif len(rows):
                left = points[rows, axis] < at
                todo += [(a, rows[left]), (b, rows[~left])]
        return out


def _matrix(column, dims: int, kind=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims)


def _lift(vecs: np.ndarray, norm2: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, norm2 - (vecs * vecs).sum(axis=1)))
    return np.hstack([vecs, rest[:, None]])


def _query_points(vecs: np.ndarray, norm2: float) -> np.ndarray:
    """Queries brought to the largest norm; the order of inner products stays."""
    scale = math.sqrt(norm2) / np.sqrt((vecs * vecs).sum(axis=1))
    return np.hstack([vecs * scale[:, None], np.zeros((len(vecs), 1))])


def _box_distance2(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box, one axis after the other, so that no more than the result is held."""
    out = np.zeros((len(points), len(low)))
    for axis in range(points.shape[1]):
        at = points[:, axis, None]
        gap = np.maximum(low[None, :, axis] - at, at - high[None, :, axis])
        np.maximum(gap, 0.0, out=gap)
        gap *= gap
        out += gap
    return out


def _buckets(proj: np.ndarray, most: int) -> list[np.ndarray]:
    out, todo = [], [np.arange(len(proj))]
    while todo:
        rows = todo.pop()
        spread = proj[rows].max(axis=0) - proj[rows].min(axis=0)
        axis = int(np.argmax(spread))
        if len(rows) <= most or spread[axis] == 0:
            out.append(rows)
            continue
        half = np.argpartition(proj[rows, axis], len(rows) // 2)
        todo += [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]]
    return out


def _searcher(dims: int, norm2: float, k: int, limit: float, bucket_rows: int):
    """Group function over a leaf: the k nearest of its vectors for every query sent here."""

    def search(points: pa.Table, asks: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if points.num_rows and asks.num_rows:
            vecs, proj = _matrix(points.column("vec"), dims), _matrix(points.column("proj"), DIMS)
            ids = points.column("ids").to_pylist()
            first_id = np.array([i[0] for i in ids])
            buckets = _buckets(proj, bucket_rows)
            low, high = np.array([proj[b].min(axis=0) for b in buckets]), np.array([proj[b].max(axis=0) for b in buckets])
            all_q, all_p = _matrix(asks.column("vec"), dims), _matrix(asks.column("proj"), DIMS)
            qids, worst = asks.column("query_id").to_numpy(), asks.column("worst").to_numpy(zero_copy_only=False).astype(float)
            norm = math.sqrt(norm2)
            for at in range(0, len(qids), 1024):
                q, p = all_q[at : at + 1024], all_p[at : at + 1024]
                away = _box_distance2(p, low, high)
                order = np.argsort(away, axis=1, kind="stable")
                best: list[list[tuple[float, int, int]]] = [[] for _ in q]
                kth = worst[at : at + 1024].copy()  # smallest score that still matters
                scale = 2 * norm / np.sqrt((q * q).sum(axis=1))
                active = np.arange(len(q))
                for t in range(len(buckets)):
                    nxt = order[active, t]
                    near2 = np.maximum(0.0, 2 * norm2 - kth[active] * scale[active])
                    going = ~(away[active, nxt] > limit * near2)
                    active, nxt = active[going], nxt[going]
                    if not len(active):
                        break
                    for b in np.unique(nxt):
                        rows, who = buckets[b], active[nxt == b]
                        scores = q[who] @ vecs[rows].T
                        better = scores >= kth[who, None]
                        for j in np.flatnonzero(better.any(axis=1)):
                            i, cols = who[j], np.flatnonzero(better[j])
                            s = scores[j, cols]
                            if len(cols) > k + 1:  # k + 1 distinct vectors hold k rows besides the query's own
                                keep = s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                                cols, s = cols[keep], s[keep]
                            mine = best[i]
                            for c, x in zip(rows[cols].tolist(), s.tolist()):
                                mine += [(-x, v, c) for v in ids[c] if v != qids[at + i]]
                            mine.sort()
                            del mine[k:]
                            if len(mine) == k:
                                kth[i] = max(kth[i], -mine[-1][0])
                for i, mine in enumerate(best):
                    out_q += [int(qids[at + i])] * len(mine)
                    out_v += [v for _, v, _ in mine]
                    # summed again in one order, so that a score doesn't depend on the batch it was found in
                    out_s += (vecs[[c for _, _, c in mine]] * q[i]).sum(axis=1).tolist() if mine else []
        return pa.table([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], ["query_id", "vec_id", "score"])

    return search


def search_vectors(vectors: DataFrame, query_where, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, sure: float = SURE, leaf_rows: int = LEAF_ROWS, bucket_rows: int = BUCKET_ROWS, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """The ``k`` rows of largest inner product found for each row where ``query_where`` (a condition on ``id``) holds."""
    spark = vectors.sparkSession
    own = usable(vectors, id_col, vec_col)
    same = Window.partitionBy("vec").orderBy("id")
    distinct = own.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = cut(distinct)
    squares = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    facts = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(squares).alias("norm2"), F.max(F.size("vec")).alias("dims")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, norm2, dims = facts["n"], facts["norm2"], facts["dims"]
    weights = np.random.default_rng(seed).standard_normal((dims + 1, DIMS))
    limit = chi2_quantile(sure, DIMS)

    drawn = distinct.select("vec").orderBy(F.xxhash64("vec")).limit(sample)  # a bounded sample, for the splits only
    points = np.array([r["vec"] for r in drawn.collect()], np.float64)
    tree = _Tree(_lift(points, norm2) @ weights, max(1, -(-n // leaf_rows)))

    def place(batches):
        for batch in batches:
            proj = _lift(_matrix(batch.column("vec"), dims), norm2) @ weights
            cuts = pa.array(np.arange(len(proj) + 1) * DIMS, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(tree.leaf(proj), pa.int32()), batch.column("vec"), batch.column("ids"), pa.ListArray.from_arrays(cuts, pa.array(proj.ravel()))], ["leaf", "vec", "ids", "proj"])

    placed = cut(distinct.mapInArrow(place, POINTS))
    sides = placed.groupBy("leaf").agg(*[f(F.col("proj")[i]).alias(f"{name}{i}") for i in range(DIMS) for name, f in (("low", F.min), ("high", F.max))]).orderBy("leaf").collect()
    leaf_ids = np.array([r["leaf"] for r in sides], np.int32)
    low, high = (np.array([[r[f"{side}{i}"] for i in range(DIMS)] for r in sides]) for side in ("low", "high"))

    def ask(first: bool):
        def route(batches):
            # a matrix of queries by leaves is bounded, whatever the number of leaves
            rows = max(1, 2_000_000 // len(leaf_ids))
            for batch in (whole.slice(at, rows) for whole in batches for at in range(0, whole.num_rows, rows)):
                vecs = _matrix(batch.column("vec"), dims)
                proj = _query_points(vecs, norm2) @ weights
                away = _box_distance2(proj, low, high)
                home = np.argmin(away, axis=1)
                worst = batch.column("worst").to_numpy(zero_copy_only=False).astype(float)
                if first:
                    row, to = np.arange(len(vecs)), home
                else:
                    near2 = np.maximum(0.0, 2 * norm2 - worst * 2 * math.sqrt(norm2) / np.sqrt((vecs * vecs).sum(axis=1)))
                    wanted = away <= limit * near2[:, None]
                    wanted[np.arange(len(vecs)), home] = False
                    row, to = np.nonzero(wanted)
                cuts = pa.array(np.arange(len(row) + 1) * DIMS, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf_ids[to], pa.int32()), batch.column("query_id").take(pa.array(row)), batch.column("vec").take(pa.array(row)), pa.array(worst[row], pa.float64()), pa.ListArray.from_arrays(cuts, pa.array(proj[row].ravel()))],
                    ["leaf", "query_id", "vec", "worst", "proj"],
                )

        return route

    asks = "leaf int, query_id long, vec array<double>, worst double, proj array<double>"
    search = _searcher(dims, norm2, k, limit, bucket_rows)
    asked = own.where(query_where).select(F.col("id").alias("query_id"), "vec")
    start = asked.withColumn("worst", F.lit(float("-inf")))
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    at_home = cut(placed.groupBy("leaf").cogroup(start.mapInArrow(ask(True), asks).groupBy("leaf")).applyInArrow(search, FOUND))
    kth = at_home.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("least")).select(F.col("query_id").alias("q"), F.when(F.col("found") >= k, F.col("least")).alias("least"))
    more = asked.join(kth, F.col("query_id") == F.col("q"), "left").select("query_id", "vec", F.coalesce("least", F.lit(float("-inf"))).alias("worst"))
    abroad = placed.groupBy("leaf").cogroup(more.mapInArrow(ask(False), asks).groupBy("leaf")).applyInArrow(search, FOUND)
    ranked = at_home.union(abroad).withColumn("rank", F.row_number().over(nearest))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_stable_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_vectors(table(spark, sf_dir, "embeddings"), F.col("id") % EVERY == 0)
