"""Class breaks of a column and reclassification."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions.num import c, finite
from terraloom.plans.lineage import sequential


def _breaks(df: DataFrame, values: Column) -> DataFrame:
    """(i, value) rows of an array column of one row."""
    return df.select(F.posexplode(values).alias("i", "value"))


def equal_interval(df: DataFrame, column: str, k: int) -> DataFrame:
    """k + 1 breaks of equal steps from the least to the largest finite value."""
    one = df.select(finite(column).alias("v")).agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo IS NOT NULL")
    return _breaks(one, F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.when(i == k, F.col("hi")).otherwise(F.col("lo") + i * (F.col("hi") - F.col("lo")) / k)))


def quantile(df: DataFrame, column: str, k: int) -> DataFrame:
    """k + 1 breaks at exact quantiles, linear between neighbours.

    Values are put in order over range partitions; of these only the ranks at
    the breaks are picked.
    """
    ranked = sequential(df.select(finite(column).alias("v")).where("v IS NOT NULL"), "v", name="n")
    total = ranked.count()
    if not total:
        return _breaks(ranked.agg(F.collect_list("v").alias("q")), F.col("q"))
    places = [i * (total - 1) / k for i in range(k + 1)]
    wanted = sorted({int(x) for p in places for x in (p // 1, min(p // 1 + 1, total - 1))})
    picked = ranked.where(F.col("n").isin(wanted)).agg(F.map_from_entries(F.collect_list(F.struct("n", "v"))).alias("at"))  # 2 (k + 1) rows
    low = lambda p: F.col("at")[F.lit(int(p))]
    high = lambda p: F.col("at")[F.lit(min(int(p) + 1, total - 1))]
    return _breaks(picked, F.array(*[low(p) + (high(p) - low(p)) * (p - int(p)) for p in places]))


def std_deviation(df: DataFrame, column: str, step: float = 1.0) -> DataFrame:
    """Breaks at mean and steps of the population deviation around it, within the range of the values."""
    step = min(max(step, 0.25), 3.0)
    one = df.select(finite(column).alias("v")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).where("lo IS NOT NULL")
    d = F.col("s") * step
    ladder = F.transform(F.sequence(-F.floor((F.col("m") - F.col("lo")) / d), F.floor((F.col("hi") - F.col("m")) / d)), lambda i: F.col("m") + i * d)
    inner = F.filter(ladder, lambda v: (v > F.col("lo")) & (v < F.col("hi")))
    return _breaks(one, F.when(F.col("s") == 0, F.array("m", "m")).otherwise(F.concat(F.array("lo"), inner, F.array("hi"))))


def natural_breaks(df: DataFrame, column: str, k: int, bins: int = 16_384) -> list[float]:
    """Breaks with the least sum of squares within classes.

    Values are counted in Spark by ``bins`` bins of equal width over their range
    (each known by its mean and its least value), whatever their number, so
    values nearer to each other than a bin's width may be taken as one; the
    dynamic program over the bins runs on the driver.  Its splits move one way,
    so it takes k * bins * log(bins) steps.  An inner break is the first value of
    the upper class.
    """
    own = df.select(finite(column).alias("v")).where("v IS NOT NULL")
    lo, hi = own.agg(F.min("v"), F.max("v")).first()
    if lo is None:
        return []
    place = F.least(F.floor((F.col("v") - lo) / ((hi - lo) / bins)), F.lit(bins - 1)) if hi > lo else F.lit(0)
    rows = own.groupBy(place.alias("b")).agg(F.avg("v").alias("v"), F.min("v").alias("least"), F.count(F.lit(1)).alias("n")).orderBy("b").collect()  # ``bins`` rows at most
    k = min(max(k, 2), 20)
    least = [r["least"] for r in rows]
    if len(rows) <= k:
        return [float(x) for x in least]
    v, n = np.array([r["v"] for r in rows]), np.array([r["n"] for r in rows], float)
    v = v - v.mean()
    w, s, q = (np.append(0, np.cumsum(x)) for x in (n, n * v, n * v * v))
    m = len(v)

    def inside(i, j):
        """Sum of squares of the bins i to j - 1 as one class."""
        return (q[j] - q[i]) - (s[j] - s[i]) ** 2 / (w[j] - w[i])

    cost, splits = inside(0, np.arange(1, m + 1)), []
    for classes in range(2, k + 1):
        new, cut = np.full(m, np.inf), np.zeros(m, int)
        todo = [(classes - 1, m - 1, classes - 1, m - 1)]
        while todo:
            a, b, first, last = todo.pop()
            if a > b:
                continue
            j = (a + b) // 2
            i = np.arange(first, min(last, j) + 1)
            total = cost[i - 1] + inside(i, j + 1)
            best = int(np.argmin(total))
            new[j], cut[j] = total[best], i[best]
            todo += [(a, j - 1, first, cut[j]), (j + 1, b, cut[j], last)]
        cost = new
        splits.append(cut)
    out, j = [float(hi)], m - 1
    for cut in reversed(splits):
        j = cut[j]
        out.append(float(least[j]))
        j -= 1
    return [float(lo), *reversed(out[1:]), out[0]]


def reclassify(column, rules: list[tuple[float, float, float]]) -> Column:
    """Value of the first rule (low, high, out) with low <= v < high; null if none holds, the input without rules."""
    v = c(column)
    out = None
    for low, high, to in rules:
        hit = ~F.isnan(v) & (v >= low) & (v < high)
        out = F.when(hit, F.lit(float(to))) if out is None else out.when(hit, F.lit(float(to)))
    return v if out is None else out


def class_of(column, breaks: list[float]) -> Column:
    """Number of the class, from 0; the last class holds the last break."""
    v = c(column)
    inner = breaks[1:-1]
    return F.when(v.isNotNull() & ~F.isnan(v), sum((F.when(v >= b, 1).otherwise(0) for b in inner), F.lit(0)))
