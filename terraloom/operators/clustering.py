"""Clusters of points: grid, density, k-means, heat."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions.num import c
from terraloom.functions.tiles import to_pixel
from terraloom.plans.components import connected_components
from terraloom.plans.lineage import cut, spread


def abbreviate(count) -> Column:
    """1234 -> 1.2k, 2500000 -> 2.5M."""
    n = c(count).cast("double")
    short = lambda v, u: F.concat(F.regexp_replace(F.format_string("%.1f", v), r"\.0$", ""), F.lit(u))
    return F.when(n >= 1e6, short(n / 1e6, "M")).when(n >= 1e3, short(n / 1e3, "k")).otherwise(c(count).cast("long").cast("string"))


def grid_clusters(points: DataFrame, radius: float, x: str = "x", y: str = "y", least: int = 2) -> DataFrame:
    """Groups of at least ``least`` points in cells of radius / 256 * 360 degrees: cell, centroid, count, label."""
    size = radius / 256 * 360
    groups = points.groupBy(F.floor(c(x) / size).alias("cx"), F.floor(c(y) / size).alias("cy")).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.count(F.lit(1)).alias("count"))
    return groups.where(F.col("count") >= least).withColumn("label", abbreviate("count"))


def pixel_clusters(points: DataFrame, pixels: float, zoom: int, x: str = "x", y: str = "y") -> DataFrame:
    """Groups by a grid of screen pixels at a zoom; single points stay as groups of one."""
    px, py = to_pixel(c(x), c(y), F.lit(zoom))
    return points.groupBy(F.floor(px / pixels).alias("cx"), F.floor(py / pixels).alias("cy")).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.count(F.lit(1)).alias("count"))


def cluster_pyramid(points: DataFrame, pixels: float, zooms: range, x: str = "x", y: str = "y", weight: str | None = None) -> DataFrame:
    """Pixel-grid clusters of every zoom level in one pass: zoom, cell, weighted centroid, count.

    Cells of a level are four of the next, so an ancestor holds exactly the
    points of its children; nothing depends on the order of the input.
    """
    w = c(weight) if weight else F.lit(1)
    top = max(zooms)
    px, py = to_pixel(c(x), c(y), F.lit(top))
    base = points.groupBy(F.floor(px / pixels).alias("cx"), F.floor(py / pixels).alias("cy")).agg(F.sum(w).alias("w"), F.sum(w * c(x)).alias("wx"), F.sum(w * c(y)).alias("wy"), F.count(F.lit(1)).alias("n"))
    levels = F.explode(F.array(*[F.struct(F.lit(z).alias("zoom"), F.lit(2 ** (top - z)).alias("by")) for z in zooms]))
    up = base.withColumn("l", levels).groupBy(F.col("l.zoom").alias("zoom"), F.floor(F.col("cx") / F.col("l.by")).alias("cx"), F.floor(F.col("cy") / F.col("l.by")).alias("cy"))
    return up.agg((F.sum("wx") / F.sum("w")).alias("x"), (F.sum("wy") / F.sum("w")).alias("y"), F.sum("n").alias("count"))


def _pairs(points: DataFrame, eps: float) -> DataFrame:
    """Pairs (a, b), a != b, of points (id, x, y, n, cell) at most ``eps`` apart, in both orders, with the n of b and the cells of both."""
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = points.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("cell").alias("acell"), near.alias("d")).withColumn("cx", F.floor(F.col("ax") / eps) + F.col("d.i")).withColumn("cy", F.floor(F.col("ay") / eps) + F.col("d.j"))
    b = points.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("n"), F.col("cell").alias("bcell"), F.floor(F.col("x") / eps).alias("ex"), F.floor(F.col("y") / eps).alias("ey"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    on = (F.col("cx") == F.col("ex")) & (F.col("cy") == F.col("ey")) & (F.col("a") != F.col("b")) & (dx * dx + dy * dy <= eps * eps)
    return spread(a.drop("d"), "cx", "cy").join(spread(b, "ex", "ey"), on).select("a", "b", "n", "acell", "bcell")


def dbscan(points: DataFrame, eps: float, min_points: int, id_col: str, x: str = "x", y: str = "y") -> DataFrame:
    """id, label: clusters are numbered by their first core point, -1 is noise.

    A core point has ``min_points`` others within ``eps``.  A border point joins
    the first cluster that reaches it.  Points at one place have the same
    neighbours, so a place is one node, known by its smallest id and weighted by
    its points.  Core places in one cell with a diagonal below ``eps`` are in
    one cluster, so cells are linked, not places.
    """
    own = points.select(F.col(id_col).alias("id"), c(x).alias("x"), c(y).alias("y"))
    side = eps / 1.4143
    cell = F.struct(F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"))
    places = cut(own.where("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("cell", cell))
    pairs = cut(_pairs(places, eps))
    others = pairs.groupBy("a").agg(F.sum("n").alias("others"))
    core = cut(places.join(others, F.col("id") == F.col("a"), "left").where(F.col("n") - 1 + F.coalesce("others", F.lit(0)) >= min_points).select(F.col("id").alias("core"), "cell"))
    heads = cut(core.groupBy("cell").agg(F.min("core").alias("head")))
    inner = pairs.join(core.select("core"), F.col("a") == F.col("core"), "left_semi")
    across = inner.where("acell != bcell").join(core.select("core"), F.col("b") == F.col("core"), "left_semi").select("acell", "bcell").distinct()
    links = across.join(heads.toDF("acell", "u"), "acell").join(heads.toDF("bcell", "v"), "bcell").where("u > v").select("u", "v")
    roots = connected_components(links)
    of_cell = heads.join(roots, F.col("head") == F.col("node"), "left").select("cell", F.coalesce("root", "head").alias("root"))
    named = cut(core.join(of_cell, "cell").select("core", "root"))
    reached = inner.join(named.withColumnRenamed("core", "k"), F.col("a") == F.col("k")).groupBy(F.col("b").alias("p")).agg(F.min("root").alias("near"))
    of_place = places.join(named, F.col("id") == F.col("core"), "left").join(reached, F.col("id") == F.col("p"), "left").select(F.col("x").alias("px"), F.col("y").alias("py"), F.coalesce("root", "near").alias("root"))
    first = named.groupBy("root").agg(F.min("core").alias("first"))
    # one row per cluster is numbered, not one per point
    labels = first.withColumn("label", F.row_number().over(Window.orderBy("first")) - 1).select(F.col("root").alias("r"), "label")
    labelled = of_place.join(labels, F.col("root") == F.col("r")).select("px", "py", "label")
    return own.join(labelled, (F.col("x") == F.col("px")) & (F.col("y") == F.col("py")), "left").select(F.col("id").alias(id_col), F.coalesce("label", F.lit(-1)).alias("label"))


def k_means(points: DataFrame, k: int, id_col: str, features: list[str], most_rounds: int = 100, tolerance: float = 1e-9) -> tuple[DataFrame, list[list[float]]]:
    """(id, cluster) and the centres.

    Lloyd's rounds from farthest-first centres: the point of smallest id, then
    each time the point farthest from the centres so far.  A round is one
    aggregation to k rows; an empty cluster keeps its centre.  The centres are
    one constant array, so all rounds share the generated code.  The rounds run
    over the distinct feature values, weighted by their points.
    """
    every = points.select(F.col(id_col).alias("id"), F.array(*[c(f).cast("double") for f in features]).alias("f"))
    own = spread(every.groupBy("f").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"))).persist()

    def ranked(centres: list[list[float]], own: DataFrame = own) -> DataFrame:
        """The columns of ``own``, and n: (d, i) of the nearest centre."""
        table = F.from_json(F.lit(json.dumps(centres)), "array<array<double>>")
        apart = lambda m: F.aggregate(F.zip_with("f", m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        near = F.array_min(F.transform(table, lambda m, i: F.struct(apart(m).alias("d"), i.alias("i"))))
        return own.withColumn("n", near)

    row = own.agg(F.min_by("f", "id").alias("f")).first()
    if row["f"] is None:
        return every.select(F.col("id").alias(id_col), F.lit(0).alias("cluster")), []
    centres = [list(row["f"])]
    while len(centres) < k:
        best = ranked(centres).agg(F.max_by("f", F.struct(F.col("n.d"), (-F.col("id")).alias("o"))).alias("f")).first()
        centres.append(list(best["f"]))
    for _ in range(most_rounds):
        means = ranked(centres).groupBy(F.col("n.i").alias("cluster")).agg(*[(F.sum(F.col("f")[i] * F.col("w")) / F.sum("w")).alias(f"m{i}") for i in range(len(features))]).collect()
        moved = 0.0
        for r in means:
            new = [r[f"m{i}"] for i in range(len(features))]
            moved = max(moved, max(abs(a - b) for a, b in zip(new, centres[r["cluster"]])))
            centres[r["cluster"]] = new
        if moved <= tolerance:
            break
    out = cut(ranked(centres, spread(every)).select(F.col("id").alias(id_col), F.col("n.i").alias("cluster")))
    own.unpersist()
    return out, centres


def cluster_leaves(points: DataFrame, radius: float, cx: int, cy: int, order: str, limit: int | None = 10, offset: int = 0, x: str = "x", y: str = "y") -> DataFrame:
    """The points of one grid cluster in the order of ``order``, ``limit`` of them (None: all) from ``offset`` on."""
    size = radius / 256 * 360
    own = points.where((F.floor(c(x) / size) == cx) & (F.floor(c(y) / size) == cy)).orderBy(order).offset(offset)
    return own if limit is None else own.limit(limit)


def cluster_children(points: DataFrame, radius: float, x: str = "x", y: str = "y", least: int = 2) -> DataFrame:
    """Every point of a grid cluster with the cluster's cell: the columns of ``points``, cx, cy."""
    size = radius / 256 * 360
    own = points.withColumn("cx", F.floor(c(x) / size)).withColumn("cy", F.floor(c(y) / size))
    large = own.groupBy(F.col("cx").alias("gx"), F.col("cy").alias("gy")).count().where(F.col("count") >= least)
    return own.join(large, (F.col("cx") == F.col("gx")) & (F.col("cy") == F.col("gy")), "left_semi")


def expansion_zooms(points: DataFrame, pixels: float, zooms: range, x: str = "x", y: str = "y") -> DataFrame:
    """zoom, cx, cy, expands: the first zoom at which a cluster of the pyramid falls apart, null if none of ``zooms`` does that."""
    top = max(zooms)
    px, py = to_pixel(c(x), c(y), F.lit(top))
    base = points.select(F.floor(px / pixels).alias("bx"), F.floor(py / pixels).alias("by")).distinct()
    levels = F.explode(F.array(*[F.struct(F.lit(z).alias("z"), F.lit(w).alias("w")) for z in zooms for w in zooms if w >= z]))
    at = lambda n, z: F.floor(F.col(n) / F.pow(F.lit(2.0), F.lit(top) - F.col(z)))
    own = base.withColumn("l", levels).select("bx", "by", F.col("l.z").alias("z"), F.col("l.w").alias("w"))
    parts = own.select("z", "w", at("bx", "z").alias("cx"), at("by", "z").alias("cy"), at("bx", "w").alias("dx"), at("by", "w").alias("dy"))
    apart = (F.min("dx") < F.max("dx")) | (F.min("dy") < F.max("dy"))
    split = parts.groupBy("z", "cx", "cy", "w").agg(apart.alias("apart"))
    return split.groupBy(F.col("z").alias("zoom"), "cx", "cy").agg(F.min(F.when(F.col("apart"), F.col("w"))).alias("expands"))


def heat_density(cells: DataFrame, points: DataFrame, radius: float, cell_id: str, weight: str | None = None, intensity: float = 1.0) -> DataFrame:
    """Sum of Gaussian weights (sigma = radius / 4) of the points within ``radius`` of each cell (x, y)."""
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = cells.select(F.col(cell_id).alias("c"), F.col("x").alias("ax"), F.col("y").alias("ay"), near.alias("d")).withColumn("cx", F.floor(F.col("ax") / radius) + F.col("d.i")).withColumn("cy", F.floor(F.col("ay") / radius) + F.col("d.j"))
    b = points.select(F.col("x").alias("bx"), F.col("y").alias("by"), (c(weight) if weight else F.lit(1.0)).alias("w"), F.floor(F.col("x") / radius).alias("ex"), F.floor(F.col("y") / radius).alias("ey"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    d2, sigma = dx * dx + dy * dy, radius / 4
    hit = a.join(b, (F.col("cx") == F.col("ex")) & (F.col("cy") == F.col("ey")) & (d2 <= radius * radius)).select("c", (F.col("w") * F.exp(-d2 / (2 * sigma * sigma)) * intensity).alias("h"))
    return cells.select(cell_id).join(hit.groupBy("c").agg(F.sum("h").alias("density")), F.col(cell_id) == F.col("c"), "left").select(cell_id, F.coalesce("density", F.lit(0.0)).alias("density"))


def hulls(points: DataFrame, group: str, x: str = "x", y: str = "y") -> DataFrame:
    """Convex hull of each group, counter-clockwise, open, without collinear points: group, ring.

    Every task first reduces its own points to hulls, so a large group arrives
    at its last task as the few corners of each.
    """
    import pandas as pd

    def turn(o, a, b):
        return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def chain(pts):
        out = []
        for p in pts:
            while len(out) > 1 and turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out

    def hull(pdf):
        pts = sorted(set(zip(pdf["x"], pdf["y"])))
        return pts if len(pts) < 3 else chain(pts)[:-1] + chain(reversed(pts))[:-1]

    def partial(batches):
        for pdf in batches:
            rows = [(g, px, py) for g, own in pdf.groupby("g", sort=False) for px, py in hull(own)]
            yield pd.DataFrame(rows, columns=["g", "x", "y"])

    kind = points.schema[group].dataType.simpleString()
    own = points.select(F.col(group).alias("g"), c(x).alias("x"), c(y).alias("y")).where("g IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    corners = own.mapInPandas(partial, f"g {kind}, x double, y double")
    final = corners.groupBy("g").applyInPandas(lambda pdf: pd.DataFrame({"g": [pdf["g"].iloc[0]], "ring": [[{"x": a, "y": b} for a, b in hull(pdf)]]}), f"g {kind}, ring array<struct<x:double,y:double>>")
    return final.withColumnRenamed("g", group)
