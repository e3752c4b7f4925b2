"""Joins by place: points in polygons, boxes, distances, nearest neighbours.

Every join is an equi-join on grid cells with the exact test as its residual,
so Catalyst shuffles or broadcasts by measured size and adaptive execution
splits hot cells.  A point has one cell, so nothing is found twice.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions import geodesy as G
from terraloom.functions import shapes as S
from terraloom.functions.num import c
from terraloom.plans.lineage import cut, spread


def cell_size(polygons: DataFrame, bounds: Column) -> float:
    """A grid step near the mean extent of the shapes; one row comes to the driver."""
    row = polygons.select(bounds.alias("b")).agg(F.avg(F.greatest(F.col("b.east") - F.col("b.west"), F.col("b.north") - F.col("b.south"))).alias("mean")).first()
    return max(float(row["mean"] or 0.0), 1e-9)


def _cells(b: Column, step: float) -> Column:
    """Array of the cells that a box meets."""
    xs = F.sequence(F.floor(b.west / step), F.floor(b.east / step))
    ys = F.sequence(F.floor(b.south / step), F.floor(b.north / step))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def _levels(shapes: DataFrame, bounds: Column) -> list[int]:
    """Powers of two at or above the extents of the shapes; at most some dozens come to the driver."""
    rows = shapes.select(_level(bounds).alias("level")).where("level IS NOT NULL").distinct().collect()
    return sorted(r["level"] for r in rows) or [0]


def _level(b: Column) -> Column:
    extent = F.greatest(b.east - b.west, b.north - b.south)
    return F.ceil(F.log2(F.when(extent > 1e-9, extent).otherwise(F.when(extent.isNotNull(), F.lit(1e-9))))).cast("int")


def points_in_polygons(polygons: DataFrame, points: DataFrame, polygon_col: str = "polygon", x: str = "x", y: str = "y", step: float | None = None, how: str = "inner") -> DataFrame:
    """Each polygon with each point in its outer ring and in none of its holes (``how`` may be left).

    Each polygon is laid on the grid of its own size, so it has four cells at
    most, however unequal the polygons are; a point has a cell in every grid in
    use.  ``step`` sets one grid for all instead.  Points without finite
    coordinates, and null polygons, match nothing.
    """
    bounds = S.bounds(F.col(polygon_col)[0])
    finite = c(x).isNotNull() & c(y).isNotNull() & ~F.isnan(c(x)) & ~F.isnan(c(y))
    if step:
        left = polygons.withColumn("_cell", F.explode_outer(_cells(bounds, step))).withColumn("_level", F.lit(0))
        right = points.where(finite).withColumn("_grid", F.lit(0)).withColumn("_step", F.lit(float(step)))
    else:
        left = polygons.withColumn("_level", _level(bounds)).withColumn("_cell", F.explode_outer(_cells(bounds, F.pow(F.lit(2.0), F.col("_level")))))
        grids = F.array(*[F.lit(n) for n in _levels(polygons, bounds)])
        right = points.where(finite).withColumn("_grid", F.explode(grids)).withColumn("_step", F.pow(F.lit(2.0), F.col("_grid")))
    right = right.withColumn("_px", F.floor(c(x) / F.col("_step"))).withColumn("_py", F.floor(c(y) / F.col("_step")))
    match = (F.col("_level") == F.col("_grid")) & (F.col("_cell.cx") == F.col("_px")) & (F.col("_cell.cy") == F.col("_py")) & S.in_polygon(c(x), c(y), F.col(polygon_col))
    return left.join(right, match, how).drop("_cell", "_level", "_grid", "_step", "_px", "_py")


def boxes_overlap(left: DataFrame, right: DataFrame, left_box: str, right_box: str, step: float | None = None) -> DataFrame:
    """Pairs of rows whose boxes overlap (closed).

    A pair may share several cells and comes out in one of them: the cell of the
    lower left corner of the common part.
    """
    step = step or cell_size(left, F.col(left_box))
    a = left.withColumn("_cell", F.explode(_cells(F.col(left_box), step))).withColumn("_ax", F.col("_cell.cx")).withColumn("_ay", F.col("_cell.cy")).drop("_cell")
    b = right.withColumn("_cell", F.explode(_cells(F.col(right_box), step))).withColumn("_bx", F.col("_cell.cx")).withColumn("_by", F.col("_cell.cy")).drop("_cell")
    west = F.greatest(F.col(f"{left_box}.west"), F.col(f"{right_box}.west"))
    south = F.greatest(F.col(f"{left_box}.south"), F.col(f"{right_box}.south"))
    first = (F.floor(west / step) == F.col("_ax")) & (F.floor(south / step) == F.col("_ay"))
    on = (F.col("_ax") == F.col("_bx")) & (F.col("_ay") == F.col("_by")) & S.box_overlap(left_box, right_box) & first
    return spread(a, "_ax", "_ay").join(spread(b, "_bx", "_by"), on).drop("_ax", "_ay", "_bx", "_by")


def _sphere_cell(lng: Column, lat: Column, step: float) -> list[Column]:
    return [F.floor(v / step) for v in G.surface_normal(lng, lat)]


def within_distance(left: DataFrame, right: DataFrame, metres: float, left_xy=("x", "y"), right_xy=("rx", "ry"), radius: float = G.A) -> DataFrame:
    """Pairs at most ``metres`` apart on the sphere, with the distance as ``distance``.

    Cells are cubes of the unit sphere's space with the chord as side, so the
    poles and the antimeridian are places like any other.
    """
    angle = min(metres / radius, math.pi)
    step = max(2 * math.sin(angle / 2), 1e-9) * (1 + 1e-9)
    around = F.array(*[F.struct(*[F.lit(d).alias(n) for d, n in zip((i, j, k), "ijk")]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    lx, ly, lz = _sphere_cell(c(left_xy[0]), c(left_xy[1]), step)
    rx, ry, rz = _sphere_cell(c(right_xy[0]), c(right_xy[1]), step)
    unit = lambda df, xy, n: df.withColumns({f"_{n}{k}": v for k, v in zip("uvw", G.surface_normal(c(xy[0]), c(xy[1])))})
    a = unit(left, left_xy, "a").withColumn("_d", F.explode(around)).withColumns({"_ax": lx + F.col("_d.i"), "_ay": ly + F.col("_d.j"), "_az": lz + F.col("_d.k")}).drop("_d")
    b = unit(right, right_xy, "b").withColumns({"_bx": rx, "_by": ry, "_bz": rz})
    apart = G.haversine(c(left_xy[0]), c(left_xy[1]), c(right_xy[0]), c(right_xy[1]), radius)
    chord = sum((F.col(f"_a{k}") - F.col(f"_b{k}")) * (F.col(f"_a{k}") - F.col(f"_b{k}")) for k in "uvw")  # cheap, and a little wider
    on = (F.col("_ax") == F.col("_bx")) & (F.col("_ay") == F.col("_by")) & (F.col("_az") == F.col("_bz")) & (chord <= step * step)
    met = spread(a, "_ax", "_ay", "_az").join(spread(b, "_bx", "_by", "_bz"), on).withColumn("distance", apart).where(F.col("distance") <= metres)
    return met.drop(*[f"_{n}{k}" for n in "ab" for k in "xyzuvw"])


def nearest(queries: DataFrame, points: DataFrame, k: int, query_id: str, point_id: str, query_xy=("x", "y"), point_xy=("rx", "ry"), first_metres: float | None = None, radius: float = G.A) -> DataFrame:
    """The k nearest points of each query: query_id, rank, point_id, distance; ties to the smaller id.

    Rounds of distance joins with doubling reach; a query leaves as soon as k
    points are within reach.  The first reach follows from the number of points.
    """
    n = points.count()
    reach = first_metres or 2 * radius * math.sqrt(max(k, 1) / max(n, 1))
    cols = [F.col(query_id).alias("_q"), c(query_xy[0]).alias("_qx"), c(query_xy[1]).alias("_qy")]
    todo = queries.select(*cols)
    others = points.select(F.col(point_id).alias("_p"), c(point_xy[0]).alias("_rx"), c(point_xy[1]).alias("_ry"))
    order = Window.partitionBy("_q").orderBy("distance", "_p")
    done = None
    while True:
        last = reach >= math.pi * radius
        found = within_distance(todo, others, reach, ("_qx", "_qy"), ("_rx", "_ry"), radius).select("_q", "_p", "distance")
        found = cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        full = found.groupBy("_q").count().where(F.col("count") >= min(k, n)).select(F.col("_q").alias("_f"))
        part = found if last else found.join(full, F.col("_q") == F.col("_f"), "left_semi")
        done = part if done is None else done.union(part)
        todo = cut(todo.join(full, F.col("_q") == F.col("_f"), "left_anti"))
        if last or todo.isEmpty():
            return done.select(F.col("_q").alias(query_id), "rank", F.col("_p").alias(point_id), "distance")
        reach *= 2


def nearest_planar(queries: DataFrame, points: DataFrame, k: int, query_id: str, point_id: str, first: float | None = None, dims: tuple = ("x", "y"), point_dims: tuple = ("rx", "ry")) -> DataFrame:
    """The k nearest points of each query in the plane (or in space): query_id, rank, point_id, distance; ties to the smaller id.

    Rounds of grid joins with doubling reach, like ``nearest``.  Queries at one
    place are one query.
    """
    spread = points.agg(F.count(F.lit(1)).alias("n"), *[F.max(d).alias(f"hi{i}") for i, d in enumerate(point_dims)], *[F.min(d).alias(f"lo{i}") for i, d in enumerate(point_dims)]).first()
    away = queries.agg(*[F.max(d).alias(f"hi{i}") for i, d in enumerate(dims)], *[F.min(d).alias(f"lo{i}") for i, d in enumerate(dims)]).first()
    n = spread["n"]
    side = [spread[f"hi{i}"] - spread[f"lo{i}"] if n else 0.0 for i in range(len(dims))]
    whole = math.sqrt(sum(max(abs((spread[f"hi{i}"] or 0) - (away[f"lo{i}"] or 0)), abs((away[f"hi{i}"] or 0) - (spread[f"lo{i}"] or 0))) ** 2 for i in range(len(dims)))) or 1.0
    reach = first or max(max(side) * (max(k, 1) / max(n, 1)) ** (1 / len(dims)), whole * 1e-6)
    order = Window.partitionBy("_q").orderBy("distance", "_p")
    asked = queries.select(F.col(query_id).alias("_id"), *[c(d).cast("double").alias(f"_q{i}") for i, d in enumerate(dims)])
    at = [f"_q{i}" for i in range(len(dims))]
    todo = cut(asked.select(*at).distinct().withColumn("_q", F.monotonically_increasing_id()))
    places = todo.select(F.col("_q").alias("_place"), *[F.col(n).alias(f"_at{n}") for n in at])
    # of the points at one place only the first k can be among the k nearest
    alike = Window.partitionBy(*[f"_p{i}" for i in range(len(dims))]).orderBy("_p")
    others = points.select(F.col(point_id).alias("_p"), *[c(d).cast("double").alias(f"_p{i}") for i, d in enumerate(point_dims)])
    others = cut(others.withColumn("_nth", F.row_number().over(alike)).where(F.col("_nth") <= k).drop("_nth"))
    done = None
    while True:
        last = reach >= whole
        found = within_reach(todo, others, reach, [f"_q{i}" for i in range(len(dims))], [f"_p{i}" for i in range(len(dims))]).select("_q", "_p", "distance")
        found = cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        full = found.groupBy("_q").count().where(F.col("count") >= min(k, n)).select(F.col("_q").alias("_f"))
        part = found if last else found.join(full, F.col("_q") == F.col("_f"), "left_semi")
        done = part if done is None else done.union(part)
        todo = cut(todo.join(full, F.col("_q") == F.col("_f"), "left_anti"))
        if last or todo.isEmpty():
            same = reduce(lambda a, b: a & b, [F.col(n) == F.col(f"_at{n}") for n in at])
            return asked.join(places, same).join(done, F.col("_place") == F.col("_q")).select(F.col("_id").alias(query_id), "rank", F.col("_p").alias(point_id), "distance")
        reach *= 2


def within_reach(left: DataFrame, right: DataFrame, reach: float, left_dims: list[str], right_dims: list[str]) -> DataFrame:
    """Pairs at most ``reach`` apart in the plane or in space, with the distance as ``distance``."""
    import itertools

    around = F.array(*[F.array(*[F.lit(d) for d in ds]) for ds in itertools.product((-1, 0, 1), repeat=len(left_dims))])
    ka, kb = ([f"_{n}{i}" for i in range(len(left_dims))] for n in ("a", "b"))
    a = left.withColumn("_d", F.explode(around)).withColumns({n: F.floor(c(d) / reach) + F.col("_d")[i] for i, (n, d) in enumerate(zip(ka, left_dims))}).drop("_d")
    b = right.withColumns({n: F.floor(c(d) / reach) for n, d in zip(kb, right_dims)})
    squared = sum(((c(p) - c(q)) * (c(p) - c(q)) for p, q in zip(left_dims, right_dims)), F.lit(0.0))
    on = reduce(lambda p, q: p & q, [F.col(m) == F.col(n) for m, n in zip(ka, kb)], squared <= reach * reach)
    return spread(a, *ka).join(spread(b, *kb), on).withColumn("distance", F.sqrt(squared)).drop(*ka, *kb)


def nearest_on_lines(points: DataFrame, lines: DataFrame, point_id: str, line_id: str, line: str, x: str = "x", y: str = "y") -> DataFrame:
    """point_id, line_id, lng, lat, metres: nearest place on each line (arcs of great circles) for every pair of ids that the caller has joined.

    ``points`` and ``lines`` are joined on equal ``line_id``; segments are exploded, so a long line is spread over tasks.
    """
    v = lambda lng, lat: F.array(*G.surface_normal(lng, lat))
    from terraloom.functions import num as N

    parts = lines.select(F.col(line_id), F.explode(S.edges(F.col(line), False)).alias("e"))
    pairs = points.join(parts, line_id).withColumn("_a", v(F.col("e.a.x"), F.col("e.a.y"))).withColumn("_b", v(F.col("e.b.x"), F.col("e.b.y"))).withColumn("_p", v(c(x), c(y)))
    pairs = pairs.withColumn("_n", N.vec_normalize(N.vec_cross("_a", "_b")))
    pairs = pairs.withColumn("_f", N.vec_normalize(N.vec_sub("_p", N.vec_scale("_n", N.vec_dot("_p", "_n")))))
    inside = (N.vec_dot(N.vec_cross("_a", "_f"), "_n") >= 0) & (N.vec_dot(N.vec_cross("_f", "_b"), "_n") >= 0) & (N.vec_length2("_n") > 0)
    foot = F.when(inside, F.col("_f")).when(N.vec_dot("_p", "_a") >= N.vec_dot("_p", "_b"), F.col("_a")).otherwise(F.col("_b"))
    best = pairs.withColumn("_q", foot).withColumn("_lng", F.degrees(F.atan2(F.col("_q")[1], F.col("_q")[0]))).withColumn("_lat", F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_q")[2])))))
    best = best.withColumn("_m", G.haversine(c(x), c(y), F.col("_lng"), F.col("_lat")))
    out = best.groupBy(point_id, line_id).agg(F.min(F.struct("_m", "_lng", "_lat")).alias("_o"))
    return out.select(point_id, line_id, F.col("_o._lng").alias("lng"), F.col("_o._lat").alias("lat"), F.col("_o._m").alias("metres"))
