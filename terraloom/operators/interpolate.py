"""Surfaces from samples: inverse distance, bilinear, bicubic, variogram, kriging, natural neighbours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions.num import c, catmull_rom, div, lerp
from terraloom.operators.clustering import hulls
from terraloom.operators.spatial_join import nearest_planar
from terraloom.plans.lineage import cut, spread

BLOCK = 2_000  # samples that meet in one block


def _blocks(samples: DataFrame, size: int = BLOCK) -> tuple[DataFrame, int]:
    """Samples (x, y, v, n: a number of their own) dealt into hash blocks of about ``size``, and the number of blocks."""
    own = samples.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("value").cast("double").alias("v")).withColumn("n", F.monotonically_increasing_id())
    own = cut(own)
    blocks = max(1, -(-own.count() // size))
    return own.withColumn("block", F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("int")), blocks


def idw(targets: DataFrame, samples: DataFrame, target_id: str, power: float = 2.0, radius: float | None = None, most_samples: int | None = None) -> DataFrame:
    """target_id, value: mean of the samples weighted by 1 / distance^power; a sample at the place itself decides.

    Without ``radius`` every sample counts for every target: both are dealt into
    blocks that meet one by one, and their sums are added up by target.  With it
    samples are joined by grid cell, which is the way for many targets.  A
    caller may set ``most_samples`` to be stopped before an all-to-all run over
    more; by default there is no bound.
    """
    if radius is None and most_samples is not None and samples.limit(most_samples + 1).count() > most_samples:
        raise ValueError(f"more than {most_samples} samples: give a radius, so that they are joined by place")
    d = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    if radius is None:
        own, blocks = _blocks(samples)
        a = targets.select(F.col(target_id).alias("_t"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("asked"))
        b = own.select(F.col("x").alias("bx"), F.col("y").alias("by"), "v", "block")
        return _weighed(targets, a.join(b, F.col("asked") == F.col("block")), d, power, target_id)
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = targets.select(F.col(target_id).alias("_t"), F.col("x").alias("ax"), F.col("y").alias("ay"), near.alias("n")).withColumn("cx", F.floor(F.col("ax") / radius) + F.col("n.i")).withColumn("cy", F.floor(F.col("ay") / radius) + F.col("n.j"))
    b = samples.select(F.col("x").alias("bx"), F.col("y").alias("by"), F.col("value").alias("v"), F.floor(F.col("x") / radius).alias("ex"), F.floor(F.col("y") / radius).alias("ey"))
    return _weighed(targets, a.join(b, (F.col("cx") == F.col("ex")) & (F.col("cy") == F.col("ey")) & (d <= radius)), d, power, target_id)


def _weighed(targets: DataFrame, pairs: DataFrame, d: Column, power: float, target_id: str) -> DataFrame:
    hit = pairs.withColumn("d", d).withColumn("w", F.coalesce(div(F.lit(1.0), F.pow("d", F.lit(float(power)))), F.lit(0.0)))
    sums = hit.groupBy("_t").agg(F.min(F.when(F.col("d") < 1e-10, F.col("v"))).alias("hit"), F.sum(F.col("w") * F.col("v")).alias("a"), F.sum("w").alias("b"))
    return targets.select(target_id).join(sums, F.col(target_id) == F.col("_t"), "left").select(target_id, F.coalesce("hit", div(F.col("a"), F.col("b"))).alias("value"))


def bilinear(q00, q10, q01, q11, u, v) -> Column:
    """Value inside a cell from its corners; u and v are kept within [0, 1]."""
    u, v = (F.least(F.lit(1.0), F.greatest(F.lit(0.0), c(t))) for t in (u, v))
    return lerp(lerp(q00, q10, u), lerp(q01, q11, u), v)


def bicubic(rows: list[list], u, v) -> Column:
    """Catmull-Rom through 4 x 4 values."""
    return catmull_rom(*[catmull_rom(*r, u) for r in rows], v)


def sample_raster(raster: DataFrame, points: DataFrame, point_id: str) -> DataFrame:
    """point_id, value: bilinear value at (x, y) in columns and rows; null beside missing cells."""
    p = points.select(F.col(point_id).alias("p"), F.floor("x").alias("c0"), F.floor("y").alias("r0"), (F.col("x") - F.floor("x")).alias("u"), (F.col("y") - F.floor("y")).alias("v"))
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    asked = p.withColumn("k", corner).withColumn("w", F.when(F.col("k.i") == 1, F.col("v")).otherwise(1 - F.col("v")) * F.when(F.col("k.j") == 1, F.col("u")).otherwise(1 - F.col("u"))).where("w > 0")
    got = asked.join(raster, (F.col("row") == F.col("r0") + F.col("k.i")) & (F.col("col") == F.col("c0") + F.col("k.j")), "left")
    sums = got.groupBy("p").agg(F.sum(F.col("w") * F.col("value")).alias("s"), F.sum(F.when(F.col("value").isNull(), 1).otherwise(0)).alias("missing"))
    return sums.select(F.col("p").alias(point_id), F.when(F.col("missing") == 0, F.col("s")).alias("value"))


def variogram(samples: DataFrame, lags: int = 10) -> DataFrame:
    """lag, distance (mean), semivariance (mean), pairs, over all pairs of samples.

    Samples at one place are one row with their number and moments, which is all
    that a sum over pairs needs.  Rows are dealt into blocks; every two blocks
    meet in a task and come out as sums by lag, so pairs aren't kept anywhere.
    The largest distance, which sets the lags, lies between corners of the
    convex hull.
    """
    import numpy as np
    import pandas as pd

    own = samples.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("value").cast("double").alias("v"))
    middle = own.agg(F.avg("v")).first()[0] or 0.0  # smaller moments, fewer lost digits
    u = F.col("v") - middle
    places = cut(own.groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count("v").cast("double").alias("m"), F.coalesce(F.sum(u), F.lit(0.0)).alias("s"), F.coalesce(F.sum(u * u), F.lit(0.0)).alias("q")))
    blocks = max(1, -(-places.count() // BLOCK))
    corners = hulls(places.withColumn("one", F.lit(0)), "one").select("ring", F.explode("ring").alias("p"))
    apart = lambda q: F.sqrt((q.x - F.col("p.x")) * (q.x - F.col("p.x")) + (q.y - F.col("p.y")) * (q.y - F.col("p.y")))
    most = corners.agg(F.max(F.array_max(F.transform("ring", apart)))).first()[0]
    held = cut(places.withColumn("block", F.pmod(F.xxhash64("x", "y"), F.lit(blocks))).groupBy("block").agg(*[F.collect_list(F.coalesce(n, F.lit(float("nan")))).alias(n) for n in "xynmsq"]))  # about BLOCK rows each
    side = lambda n: held.select(*[F.col(k).alias(f"{n}_{k}") for k in ("block", *"xynmsq")])
    met = spread(side("a").join(side("b"), F.col("a_block") <= F.col("b_block")))

    def lagged(d):
        if not most:
            return np.full(d.shape, lags - 1)
        known = ~np.isnan(d)
        return np.where(known, np.minimum(np.floor(np.where(known, d, 0.0) / most * lags), lags - 1), lags - 1).astype(np.int64)

    def sums(batches):
        total = np.zeros((5, lags))

        def add(d, pairs, valued, halves):
            lag = lagged(d).ravel()
            known = np.where(np.isnan(d), 0.0, pairs)
            for k, w in enumerate((pairs, known, known * np.nan_to_num(d), valued, halves)):
                total[k] += np.bincount(lag, weights=w.ravel(), minlength=lags)

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ax, ay, an, am, s, q = (np.asarray(getattr(row, f"a_{k}")) for k in "xynmsq")
                bx, by, bn, bm, t, r = (np.asarray(getattr(row, f"b_{k}")) for k in "xynmsq")
                same = row.a_block == row.b_block
                for i in range(0, len(ax), 50):
                    j = slice(i, i + 50)
                    dx, dy = ax[j, None] - bx, ay[j, None] - by
                    once = np.arange(len(ax))[j, None] < np.arange(len(bx)) if same else 1.0
                    halves = (am[j, None] * r + q[j, None] * bm - 2 * s[j, None] * t) / 2
                    add(np.sqrt(dx * dx + dy * dy), an[j, None] * bn * once, am[j, None] * bm * once, halves * once)
                if same:
                    add(np.hypot(ax - ax, ay - ay), an * (an - 1) / 2, am * (am - 1) / 2, (am * q - s * s) / 2)
        yield pd.DataFrame({"lag": np.arange(lags), **dict(zip(("pairs", "known", "d", "valued", "g"), total))})

    part = met.mapInPandas(sums, "lag long, pairs double, known double, d double, valued double, g double")
    all_ = part.groupBy("lag").agg(*[F.sum(n).alias(n) for n in ("pairs", "known", "d", "valued", "g")]).where("pairs > 0")
    return all_.select("lag", div(F.col("d"), F.col("known")).alias("distance"), div(F.col("g"), F.col("valued")).alias("semivariance"), F.col("pairs").cast("long").alias("pairs"))


def fit_variogram(lagged: DataFrame) -> DataFrame:
    """One row (nugget, sill, range_) from the rows of ``variogram``: the first lag's value, the largest, and the first distance at 95 % of it."""
    sill = lagged.agg(F.max("semivariance").alias("sill"), F.min_by("semivariance", "lag").alias("first"), F.max("distance").alias("far"))
    reached = lagged.join(F.broadcast(sill)).agg(F.min(F.when(F.col("semivariance") >= 0.95 * F.col("sill"), F.col("distance"))).alias("at"))  # one row
    return sill.join(F.broadcast(reached)).select(F.greatest(F.lit(0.0), F.least("first", "sill")).alias("nugget"), "sill", F.coalesce("at", "far").alias("range_"))


def halton(index, base: int) -> Column:
    """Radical inverse of a number, in [0, 1)."""
    digits = F.sequence(F.lit(0), F.lit(int(64 / math.log2(base))))
    digit = lambda k: F.pmod(F.floor(c(index) / F.pow(F.lit(float(base)), k)), F.lit(base)) / F.pow(F.lit(float(base)), k + 1)
    return F.aggregate(digits, F.lit(0.0), lambda s, k: s + digit(k))


def natural_neighbour(targets: DataFrame, samples: DataFrame, target_id: str, sample_id: str, draws: int = 1024) -> DataFrame:
    """target_id, value: Sibson's weights by ``draws`` Halton points in the disc of twice the distance to the second nearest sample.

    A draw that is nearer to the target than to any sample counts for the sample
    nearest to it.  A target at a sample has its value; one that no draw counts
    for has the nearest sample's.
    """
    own = samples.select(F.col(sample_id).alias("_s"), F.col("x").cast("double").alias("rx"), F.col("y").cast("double").alias("ry"), F.col("value").cast("double").alias("_v"))
    asks = targets.select(F.col(target_id).alias("_t"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    values = own.select(F.col("_s").alias("of"), "_v")
    near = nearest_planar(asks, own, 2, "_t", "_s").join(values, F.col("_s") == F.col("of"))
    around = near.groupBy("_t").agg(F.max("distance").alias("d2"), F.min("distance").alias("d1"), F.min_by("_v", "rank").alias("first"))
    asked = asks.join(around, "_t")
    i = F.col("i")
    spread = asked.where("d1 > 1e-10").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("r", 2 * F.col("d2") * F.sqrt(halton(i, 2))).withColumn("w", 2 * math.pi * halton(i, 3))
    spread = cut(spread.select(F.struct("_t", "i").alias("draw"), (F.col("x") + F.col("r") * F.cos("w")).alias("x"), (F.col("y") + F.col("r") * F.sin("w")).alias("y"), "r"))
    met = nearest_planar(spread, own, 1, "draw", "_s")
    won = met.join(spread.select(F.col("draw").alias("d"), "r"), F.col("draw") == F.col("d")).where("r < distance").join(values, F.col("_s") == F.col("of"))
    # a draw is won where the target is nearer to it than any sample
    means = won.groupBy(F.col("draw._t").alias("t")).agg(F.avg("_v").alias("mean"))
    return asked.join(means, F.col("_t") == F.col("t"), "left").select(F.col("_t").alias(target_id), F.when(F.col("d1") <= 1e-10, F.col("first")).otherwise(F.coalesce("mean", "first")).alias("value"))


def ordinary_kriging(targets: DataFrame, samples: DataFrame, target_id: str, sample_id: str, nugget: float, sill: float, range_: float, kind: str = "exponential", near: int = 32) -> DataFrame:
    """target_id, value, variance (0 at least) from the ``near`` nearest samples of every target.

    Each target's small system is solved in a task; with ``near`` at the number
    of samples this is the global estimate.  A singular system gives the nearest
    sample's value.
    """
    import numpy as np
    import pandas as pd

    own = samples.select(F.col(sample_id).alias("_s"), F.col("x").cast("double").alias("sx"), F.col("y").cast("double").alias("sy"), F.col("value").cast("double").alias("v"))
    asks = targets.select(F.col(target_id).alias("_t"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    found = nearest_planar(asks, own, near, "_t", "_s", point_dims=("sx", "sy")).withColumnRenamed("_s", "_found")
    rows = found.join(own, F.col("_found") == F.col("_s")).groupBy("_t").agg(F.sort_array(F.collect_list(F.struct("rank", "sx", "sy", "v", "distance"))).alias("near"))  # ``near`` rows each
    shape = {"spherical": lambda r: np.where(r < 1, 1.5 * r - 0.5 * r**3, 1.0), "exponential": lambda r: 1 - np.exp(-3 * r), "gaussian": lambda r: 1 - np.exp(-3 * r * r)}[kind]

    def gamma(h):
        return np.where(h == 0, 0.0, nugget + (sill - nugget) * shape(h / range_))

    def solve(batches):
        for pdf in batches:
            out = []
            for near_rows in pdf["near"]:
                sx, sy, v, d = (np.array([r[k] for r in near_rows]) for k in ("sx", "sy", "v", "distance"))
                n = len(v)
                left, right = np.ones((n + 1, n + 1)), np.append(gamma(d), 1.0)
                left[:n, :n], left[n, n] = gamma(np.hypot(sx[:, None] - sx, sy[:, None] - sy)), 0.0
                try:
                    w = np.linalg.solve(left, right)
                    out.append((float(w[:n] @ v), max(0.0, float(w @ right))))
                except np.linalg.LinAlgError:
                    out.append((float(v[0]), 0.0))
            yield pd.DataFrame({"_t": pdf["_t"], "value": [a for a, _ in out], "variance": [b for _, b in out]})

    kind_of = targets.schema[target_id].dataType.simpleString()
    return rows.mapInPandas(solve, f"_t {kind_of}, value double, variance double").withColumnRenamed("_t", target_id)


def variogram_model(h, nugget, sill, range_, kind: str = "spherical") -> Column:
    """Model semivariance; 0 at distance 0 even with a nugget."""
    h, r = c(h), div(c(h), c(range_))
    spread = c(sill) - c(nugget)
    value = {"spherical": F.when(r < 1, 1.5 * r - 0.5 * r * r * r).otherwise(1.0), "exponential": 1 - F.exp(-3 * r), "gaussian": 1 - F.exp(-3 * r * r)}[kind]
    return F.when(h == 0, F.lit(0.0)).otherwise(c(nugget) + spread * value)
