"""Functions of the families on fixed values and against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.functions import cells, geodesy, lines, rays, shapes
from terraloom.operators import classify, clustering, interpolate, spatial_join
from terraloom.plans import lineage


def one(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def place(*xy):
    return F.array(*[shapes.point(x, y) for x, y in xy])


# Known ids of places, as published with the cell library.
S2 = [(0x47A1CBD595522B39, 49.703498679, 11.770681595), (0x46525318B63BE0F9, 55.685376759, 12.588490937), (0x52B30B71698E729D, 45.486546517, -93.449700022), (0x46ED8886CFADDA85, 58.299984854, 23.049300056)]


@pytest.mark.parametrize("number, lat, lng", S2)
def test_s2_ids_of_known_places(spark, number, lat, lng):
    cell = cells.s2_cell(F.lit(lng), F.lit(lat), 20)
    got, level, face, center = one(spark, cell, cells.s2_cell_level(cell), cells.s2_cell_face(cell), F.struct(*cells.s2_cell_center(F.lit(number))))
    last = 1 << 20
    assert got == (number & -last | last) and level == 20 and face == number >> 61
    assert list(center) == pytest.approx([lng, lat], abs=1e-7)


def test_s2_families(spark):
    own = spark.range(200).select((F.rand(1) * 360 - 180).alias("x"), (F.rand(2) * 180 - 90).alias("y")).select(cells.s2_cell("x", "y", 12).alias("c"), cells.s2_cell("x", "y", 30).alias("leaf"))
    rows = own.select("c", "leaf", cells.s2_cell_children("c").alias("k"), cells.s2_cell_parent("leaf", 12).alias("up"), cells.s2_cell_children("leaf").alias("none")).collect()
    assert all(r.up == r.c and r.none is None and len(set(r.k)) == 4 for r in rows)
    back = own.select(F.explode(cells.s2_cell_children("c")).alias("k"), "c").select(cells.s2_cell_parent("k", 12).alias("p"), cells.s2_cell_level("k").alias("l"), "c").collect()
    assert all(r.p == r.c and r.l == 13 for r in back)


def test_direct_geodesic_of_a_known_line(spark):
    """The published test line from Flinders Peak to Buninyong."""
    deg = lambda d, m, x: d + m / 60 + x / 3600
    lng, lat, final = geodesy.ellipsoid_destination(F.lit(deg(144, 25, 29.5244)), F.lit(-deg(37, 57, 3.7203)), F.lit(deg(306, 52, 5.37)), F.lit(54972.271))
    assert one(spark, lng, lat, final) == pytest.approx([deg(143, 55, 35.3839), -deg(37, 39, 10.1561), deg(307, 10, 25.07)], abs=1e-6)


def clip_area(a, b):
    """Common area of two convex rings by a fine raster."""
    g = (np.arange(400) + 0.5) / 20
    x, y = np.meshgrid(g, g)

    def inside(r):
        return np.all([(q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) >= 0 for p, q in zip(r, r[1:] + r[:1])], axis=0)

    return (inside(a) & inside(b)).sum() / 400


def test_overlays_of_convex_rings(spark):
    rnd = random.Random(5)

    def convex():
        cx, cy, n = rnd.uniform(6, 14), rnd.uniform(6, 14), rnd.randint(3, 8)
        angles = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(n))
        return [(cx + 5 * math.cos(t), cy + 5 * math.sin(t)) for t in angles]

    pairs = [(convex(), convex()) for _ in range(12)]
    for a, b in pairs:
        both = shapes.intersection(place(*a), place(*reversed(b)))
        got, joined = one(spark, F.coalesce(F.abs(shapes.signed_area(both)), F.lit(0.0)), shapes.union_area(place(*a), place(*b)))
        assert got == pytest.approx(clip_area(a, b), abs=0.3)
    square, hole = place((0, 0), (10, 0), (10, 10), (0, 10)), place((2, 2), (4, 2), (4, 4), (2, 4))
    rest, none, apart, two = one(spark, shapes.polygon_area(shapes.difference(square, hole)), shapes.difference(hole, square), shapes.intersection(hole, place((20, 20), (30, 20), (30, 30))), F.size(shapes.symmetric_difference(square, hole)))
    assert rest == 96 and none is None and apart is None and two == 1


def test_split_and_valid(spark):
    left, right = shapes.split_ring(place((0, 0), (10, 0), (10, 10), (0, 10)), 3.0, 0.0, 3.0, 1.0)
    flat, none = shapes.split_ring(place((0, 0), (1, 0), (1, 1)), 3.0, 0.0, 3.0, 0.0)
    assert one(spark, F.abs(shapes.signed_area(left)), F.abs(shapes.signed_area(right)), F.size(flat), F.size(none)) == [30, 70, 3, 0]
    fixed = shapes.make_valid(F.array(place((0, 0), (0, 0), (0, 1), (1, 1), (1, 0)), place((0.1, 0.1), (0.1, 0.1))))
    assert one(spark, F.size(fixed), shapes.signed_area(fixed[0]), F.size(fixed[0])) == [1, 1.0, 4]


def test_buffers_of_a_bent_line(spark):
    line = place((0, 0), (0.1, 0), (0.1, 0.1))
    got = one(spark, shapes.line_buffer(line, 1000.0, 8), shapes.ring_buffer(shapes.box_ring(0, 0, 0.1, 0.1), 1000.0), shapes.offset_curve(line, 1000.0, "right"), shapes.line_buffer(place((0, 0)), 10.0))
    assert len(got[0]) == 2 * 3 + 2 * 7 + 1 and got[0][0] == got[0][-1] and got[3] is None
    x = [p["x"] for p in got[1]]
    assert min(x) < 0 < 0.1 < max(x) and got[2][0]["y"] < 0


def plain_dp(points, tol):
    if len(points) < 3:
        return points
    (ax, ay), (bx, by) = points[0], points[-1]

    def gap(p):
        d2 = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0, min(1, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / d2)) if d2 else 0
        return math.hypot(p[0] - ax - t * (bx - ax), p[1] - ay - t * (by - ay))

    far = max(range(1, len(points) - 1), key=lambda i: gap(points[i]))
    if gap(points[far]) <= tol:
        return [points[0], points[-1]]
    return plain_dp(points[: far + 1], tol)[:-1] + plain_dp(points[far:], tol)


def test_simplification(spark):
    rnd = random.Random(3)
    own = [[(float(i), rnd.uniform(0, 3)) for i in range(n)] for n in (2, 3, 10, 60)]
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in p]) for i, p in enumerate(own)] + [(9, None)], "id int, line array<struct<x:double,y:double>>")
    got = {r["id"]: r for r in df.select("id", lines.douglas_peucker("line", 0.8).alias("d"), lines.visvalingam("line", 0.8).alias("v"), lines.b_spline("line", 3, 20).alias("b"), lines.visvalingam("line", 0.0).alias("all")).collect()}
    for i, p in enumerate(own):
        assert [(q["x"], q["y"]) for q in got[i]["d"]] == plain_dp(p, 0.8)
        kept = [(q["x"], q["y"]) for q in got[i]["v"]]
        assert kept[0] == p[0] and kept[-1] == p[-1] and len(got[i]["all"]) == len(p)
        triangles = [abs((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) / 2 for a, b, c in zip(kept, kept[1:], kept[2:])]
        assert all(t >= 0.8 for t in triangles)
        b = got[i]["b"]
        assert len(b) == 20 and (b[0]["x"], b[-1]["x"]) == pytest.approx((p[0][0], p[-1][0]))
        assert all(min(y for _, y in p) - 1e-9 <= q["y"] <= max(y for _, y in p) + 1e-9 for q in b)
    assert got[9]["d"] is None and got[9]["b"] is None


def test_rays(spark):
    v = lambda *a: F.array(*[F.lit(float(x)) for x in a])
    hit, inside, miss, along = (rays.ray_box(v(*o), v(*d), v(0, 0, 0), v(1, 1, 1)) for o, d in (((-1, 0.5, 0.5), (1, 0, 0)), ((0.5, 0.5, 0.5), (1, 0, 0)), ((-1, 2, 0.5), (1, 0, 0)), ((-1, 2, 0.5), (0, 1, 0))))
    assert one(spark, hit, inside, miss, along) == [1.0, 0.0, None, None]
    spun = rays.transform_quaternion(v(1, 2, 3), v(0, 0, math.sin(0.3), math.cos(0.3)))
    got = one(spark, spun)[0]
    assert got == pytest.approx([math.cos(0.6) - 2 * math.sin(0.6), math.sin(0.6) + 2 * math.cos(0.6), 3])
    assert one(spark, rays.oct_normal(F.lit(255), F.lit(127.5)))[0] == pytest.approx([1, 0, 0])


def test_nearest_in_the_plane(spark):
    rnd = random.Random(9)
    pts = [(i, rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(300)]
    asks = [(i, rnd.uniform(-9, 9), rnd.uniform(-9, 9)) for i in range(40)]
    got = spatial_join.nearest_planar(spark.createDataFrame(asks, "q int, x double, y double"), spark.createDataFrame(pts, "p int, rx double, ry double"), 4, "q", "p").collect()
    mine = {(r.q, r["rank"]): r.p for r in got}
    for q, x, y in asks:
        assert [mine[q, k] for k in range(1, 5)] == [p for _, p in sorted((math.hypot(x - a, y - b), p) for p, a, b in pts)[:4]]


def test_nearest_on_lines(spark):
    line = spark.createDataFrame([(1, [{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}, {"x": 10.0, "y": 10.0}])], "l int, line array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(1, 1, 4.0, 1.0), (2, 1, -5.0, 0.5), (3, 1, 10.5, 20.0)], "p int, l int, x double, y double")
    got = {r.p: r for r in spatial_join.nearest_on_lines(pts, line, "p", "l", "line").collect()}
    assert (got[1].lng, got[1].lat) == pytest.approx((4, 0), abs=1e-9) and got[1].metres == pytest.approx(math.radians(1) * geodesy.A)
    assert (got[2].lng, got[2].lat) == pytest.approx((0, 0), abs=1e-9) and (got[3].lng, got[3].lat) == pytest.approx((10, 10), abs=1e-9)


def test_unequal_polygons_make_few_cells(spark):
    small = [(i, [[{"x": i * 0.01, "y": 0.0}, {"x": i * 0.01 + 0.008, "y": 0.0}, {"x": i * 0.01 + 0.008, "y": 0.008}, {"x": i * 0.01, "y": 0.008}]]) for i in range(500)]
    large = [(999, [[{"x": -170.0, "y": -80.0}, {"x": 170.0, "y": -80.0}, {"x": 170.0, "y": 80.0}, {"x": -170.0, "y": 80.0}]]), (1000, None)]
    shapes_ = spark.createDataFrame(small + large, "id int, polygon array<array<struct<x:double,y:double>>>")
    pts = spark.createDataFrame([(i, i * 0.01 + 0.004, 0.004) for i in range(500)] + [(900, float("nan"), 1.0), (901, None, 1.0), (902, 100.0, 50.0)], "p int, x double, y double")
    got = spatial_join.points_in_polygons(shapes_, pts).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {i: 1 for i in range(500)} | {999: 501}


def test_kriging_and_natural_neighbours_between_samples(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 10.0, 0.0, 10.0), (3, 5.0, 10.0, 5.0)], "s int, x double, y double, value double")
    t = spark.createDataFrame([(1, 5.0, 3.0), (2, 5.0, 10.0)], "t int, x double, y double")
    k = {r.t: r for r in interpolate.ordinary_kriging(t, s, "t", "s", 0.0, 100.0, 20.0).collect()}
    assert k[1].value == pytest.approx(5, abs=1e-6) and k[1].variance > 0 and k[2].value == pytest.approx(5) and k[2].variance == pytest.approx(0, abs=1e-9)
    n = {r.t: r.value for r in interpolate.natural_neighbour(t, s, "t", "s").collect()}
    assert n[1] == pytest.approx(5, abs=0.5) and n[2] == 5


def test_idw_and_variogram_in_blocks(spark, monkeypatch):
    rnd = random.Random(2)
    pts = [(rnd.uniform(0, 9), rnd.uniform(0, 9), rnd.uniform(0, 9)) for _ in range(90)]
    s = spark.createDataFrame(pts, "x double, y double, value double")
    t = spark.createDataFrame([(1, 4.0, 4.0), (2, *pts[5][:2])], "t int, x double, y double")
    whole = {r.lag: r for r in interpolate.variogram(s).collect()}
    value = {r.t: r.value for r in interpolate.idw(t, s, "t").collect()}
    monkeypatch.setattr(interpolate._blocks, "__defaults__", (7,))
    blocks = {r.lag: r for r in interpolate.variogram(s).collect()}
    assert sum(r.pairs for r in blocks.values()) == 90 * 89 // 2
    assert all(blocks[i].pairs == whole[i].pairs and blocks[i].semivariance == pytest.approx(whole[i].semivariance) for i in whole)
    assert {r.t: r.value for r in interpolate.idw(t, s, "t").collect()} == pytest.approx(value) and value[2] == pts[5][2]
    assert max(math.dist(a[:2], b[:2]) for a in pts for b in pts) >= max(r.distance for r in whole.values())


def test_quantiles_and_breaks(spark):
    rnd = random.Random(8)
    v = [rnd.choice([rnd.gauss(0, 1), 5.0, rnd.gauss(50, 9)]) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in v] + [(None,), (float("nan"),)], "v double").repartition(5)
    got = [r.value for r in classify.quantile(df, "v", 7).orderBy("i").collect()]
    assert got == pytest.approx(np.quantile(v, np.linspace(0, 1, 8)).tolist())
    assert classify.quantile(df.where("v > 1e9"), "v", 4).count() == 0

    def cost(breaks):
        inner = breaks[1:-1]
        groups = {}
        for x in v:
            groups.setdefault(sum(x >= b for b in inner), []).append(x)
        return sum(float(np.var(g) * len(g)) for g in groups.values())

    best = classify.natural_breaks(df, "v", 3)
    ordered = sorted(set(v))
    assert cost(best) <= min(cost([0, a, b, 1]) for a in ordered[1::7] for b in ordered[2::7] if a < b) + 1e-6
    assert classify.natural_breaks(df.where("v > 1e9"), "v", 3) == []


def test_numbering_and_leaves(spark):
    df = spark.range(0, 1000, 1, 7).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("k"))
    got = [(r.n, r.k) for r in lineage.sequential(df, "k").collect()]
    assert sorted(got) == [(i, i) for i in range(1000)]
    pts = spark.createDataFrame([(i, i * 0.1, 0.5) for i in range(60)], "id int, x double, y double")
    assert [r["id"] for r in clustering.cluster_leaves(pts, 1.0, 0, 0, "id", 3, 2).collect()] == [2, 3, 4]
    assert clustering.cluster_leaves(pts, 1.0, 0, 0, "id", None).count() == 15


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_dir(Session())
    Context.master = "local[2]"
    assert lineage.shared_dir(Session())
