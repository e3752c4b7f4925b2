import math
import random

import pytest
from pyspark.sql import functions as F

from terraloom.functions import shapes as S
from terraloom.operators import aggregation, changes, classify, clustering, filters, interpolate, raster, spatial_join, tiling, tracks
from terraloom.plans.components import connected_components, jump_to_root, subtree_sizes


def grid(spark, values):
    return spark.createDataFrame([(i, j, None if v is None else float(v)) for i, r in enumerate(values) for j, v in enumerate(r)], "row int, col int, value double")


def matrix(df, col="value"):
    return {(r.row, r.col): r[col] for r in df.collect()}


def test_aggregate_skips_what_is_not_a_number(spark):
    poly = spark.range(1).select(F.lit(1).alias("id"), F.array(S.box_ring(0, 0, 10, 10), S.box_ring(4, 4, 6, 6)).alias("polygon")).union(spark.range(1).select(F.lit(2), F.array(S.box_ring(20, 20, 30, 30))))
    pts = spark.createDataFrame([(1, 1.0, 1.0, 5.0), (2, 2.0, 2.0, None), (3, 3.0, 3.0, float("nan")), (4, 5.0, 5.0, 100.0), (5, 1.0, 9.0, 7.0), (6, None, 1.0, 1.0)], "o int, x double, y double, v double")
    got = {r["id"]: r for r in aggregation.aggregate_points(poly, pts, "id", "v").collect()}
    assert (got[1]["count"], got[1]["sum"], got[1]["median"], got[1]["deviation"]) == (4, 12, 6, 1)
    assert got[2]["count"] == 0 and got[2]["sum"] is None
    lists = {r["id"]: r["values"] for r in aggregation.collect_points(poly, pts, "id", "v", "o").collect()}
    assert lists[1][0] == 5 and lists[1][1] is None and len(lists[1]) == 4 and lists[2] == []


def test_nearest_against_brute_force(spark):
    rnd = random.Random(1)
    q = [(i, rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for i in range(20)]
    p = [(i, rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for i in range(60)]

    def away(a, b):
        u = [[math.cos(math.radians(v[2])) * math.cos(math.radians(v[1])), math.cos(math.radians(v[2])) * math.sin(math.radians(v[1])), math.sin(math.radians(v[2]))] for v in (a, b)]
        return math.dist(*u)

    got = spatial_join.nearest(spark.createDataFrame(q, "qid int, x double, y double"), spark.createDataFrame(p, "pid int, rx double, ry double"), 3, "qid", "pid").collect()
    for a in q:
        assert [r.pid for r in sorted((r for r in got if r.qid == a[0]), key=lambda r: r.rank)] == [b[0] for b in sorted(p, key=lambda b: away(a, b))[:3]]


def test_components_and_trees(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got[30] == 0 and got[101] == 100 and 7 in got and len(got) == 33
    tree = spark.createDataFrame([(i, i // 2 if i > 1 else None) for i in range(1, 16)], "node long, parent long")
    assert {r.node: r["size"] for r in subtree_sizes(tree).collect()}[1] == 15
    assert {r.root for r in jump_to_root(tree.fillna(1)).collect()} == {1}


def test_dbscan_against_brute_force(spark):
    rnd = random.Random(3)
    pts = [(i, rnd.choice((0, 5, 10)) + rnd.gauss(0, 0.5), rnd.gauss(0, 0.5)) for i in range(80)] + [(80, 100.0, 100.0)]
    near = {a[0]: [b[0] for b in pts if b[0] != a[0] and math.dist(a[1:], b[1:]) <= 0.4] for a in pts}
    core = {i for i, n in near.items() if len(n) >= 3}
    label, label_of = 0, {}
    for i in sorted(core):
        if i in label_of:
            continue
        todo = [i]
        while todo:
            k = todo.pop()
            if k in label_of:
                continue
            label_of[k] = label
            todo += [m for m in near[k] if m in core] if k in core else []
        label += 1
    border = {i: min((label_of[m] for m in near[i] if m in core), default=-1) for i, _, _ in pts if i not in core}
    got = {r.id: r.label for r in clustering.dbscan(spark.createDataFrame(pts, "id int, x double, y double"), 0.4, 3, "id").collect()}
    assert got == {i: label_of[i] if i in core else border[i] for i, _, _ in pts}


def test_k_means_and_hull(spark):
    pts = [(i, float(i % 2) * 10 + i / 100, float(i % 3) / 10, 1) for i in range(40)]
    df = spark.createDataFrame(pts, "id int, x double, y double, g int")
    out, centres = clustering.k_means(df, 2, "id", ["x", "y"])
    assert len(centres) == 2 and {(r.id % 2, r.cluster) for r in out.collect()} in ({(0, 0), (1, 1)}, {(0, 1), (1, 0)})
    square = spark.createDataFrame([(1, 0.0, 0.0), (1, 4.0, 0.0), (1, 4.0, 4.0), (1, 0.0, 4.0), (1, 2.0, 2.0), (1, 2.0, 0.0), (2, 1.0, 1.0)], "g int, x double, y double")
    got = {r.g: r.ring for r in clustering.hulls(square, "g").collect()}
    assert [(p.x, p.y) for p in got[1]] == [(0, 0), (4, 0), (4, 4), (0, 4)] and len(got[2]) == 1


def test_abbreviate(spark):
    got = spark.createDataFrame([(999,), (1234,), (2000,), (2500000,)], "n int").select(clustering.abbreviate("n").alias("t")).collect()
    assert [r.t for r in got] == ["999", "1.2k", "2k", "2.5M"]


def test_natural_breaks_are_the_best(spark):
    from itertools import combinations

    rnd = random.Random(5)
    values = [round(rnd.choice((1, 5, 20)) + rnd.random(), 3) for _ in range(14)]
    v = sorted(set(values))

    def cost(parts):
        return sum(sum((x - sum(own) / len(own)) ** 2 for x in own) for own in parts if own)

    def split(cuts):
        edges = [0, *cuts, len(v)]
        return [[x for x in values if x in v[a:b]] for a, b in zip(edges, edges[1:])]

    best = min(combinations(range(1, len(v)), 2), key=lambda cuts: cost(split(cuts)))
    got = classify.natural_breaks(spark.createDataFrame([(x,) for x in values], "v double"), "v", 3)
    assert got == [v[0], v[best[0]], v[best[1]], v[-1]]
    few = classify.natural_breaks(spark.createDataFrame([(1.0,), (2.0,), (None,)], "v double"), "v", 3)
    assert few == [1, 2]


def test_flow(spark):
    dem = grid(spark, [[10, 9, 8], [9, 8, 7], [8, 7, 6]])
    d = raster.flow_direction(dem)
    assert matrix(d, "direction")[0, 0] == 2 and matrix(d, "direction")[2, 2] == 0
    acc = matrix(raster.flow_accumulation(d))
    assert acc[2, 2] == 9 and acc[0, 0] == 1
    assert len(raster.watershed(d, 2, 2).collect()) == 9 and len(raster.watershed(d, 1, 1).collect()) >= 2


def test_fill_sinks(spark):
    import heapq

    assert matrix(raster.fill_sinks(grid(spark, [[5, 5, 5], [5, 0, 5], [5, 5, 5]])))[1, 1] == 5
    rnd = random.Random(2)
    z = [[rnd.randint(0, 20) for _ in range(7)] for _ in range(6)]
    w, heap = {}, []
    for i in range(6):
        for j in range(7):
            if i in (0, 5) or j in (0, 6):
                w[i, j] = z[i][j]
                heapq.heappush(heap, (z[i][j], i, j))
    while heap:
        v, i, j = heapq.heappop(heap)
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                k = (i + a, j + b)
                if 0 <= k[0] < 6 and 0 <= k[1] < 7 and k not in w:
                    w[k] = max(v, z[k[0]][k[1]])
                    heapq.heappush(heap, (w[k], *k))
    assert matrix(raster.fill_sinks(grid(spark, z))) == matrix(raster.fill_sinks(grid(spark, z), tile=3)) == w


def test_raster_details(spark):
    flat = grid(spark, [[1, 1, 1]] * 3)
    assert matrix(raster.aspect(flat))[1, 1] == -1 and matrix(raster.slope(flat))[0, 0] is None
    hole = grid(spark, [[1, 1, 1], [1, 1, None], [1, 1, 1]])
    assert matrix(raster.slope(hole))[1, 1] is None
    a, b = grid(spark, [[1, 2], [3, 4]]), grid(spark, [[5, 0], [7, 8]])
    got = matrix(raster.map_algebra("try_divide(a, b)", {"a": a, "b": b}))
    assert got[0, 0] == 0.2 and got[0, 1] is None
    seg = raster.contour_segments(grid(spark, [[0, 0], [10, 10]]), [5.0]).collect()
    assert len(seg) == 1 and seg[0].y0 == seg[0].y1 == 0.5
    wall = grid(spark, [[0, 0, 9, 0, 0]])
    assert matrix(raster.visible_from(wall, 0, 0, 1.0, 4), "visible")[0, 4] == 0


def test_interpolation(spark):
    s = spark.createDataFrame([(0.0, 0.0, 10.0), (10.0, 0.0, 20.0), (5.0, 10.0, 15.0)], "x double, y double, value double")
    t = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 0.0), (3, 1000.0, 0.0)], "id int, x double, y double")
    every = {r["id"]: r["value"] for r in interpolate.idw(t, s, "id").collect()}
    near = {r["id"]: r["value"] for r in interpolate.idw(t, s, "id", radius=20.0).collect()}
    assert every[1] == 10 and near[1] == 10 and every[2] == pytest.approx(near[2]) == pytest.approx(15) and near[3] is None
    g = grid(spark, [[0, 1], [2, 3]])
    got = interpolate.sample_raster(g, spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 1.0), (3, 1.5, 0.0)], "id int, x double, y double"), "id")
    assert {r["id"]: r["value"] for r in got.collect()} == {1: 1.5, 2: 3.0, 3: None}
    with pytest.raises(ValueError):
        interpolate.idw(t, s, "id", most_samples=2)


def test_tracks(spark):
    tr = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 10.0, 10.0, 0.0), (1, 2, 10.0, 20.0, 0.0), (2, 0, 5.0, 1.0, 1.0)], "track int, seq int, t double, x double, y double")
    asks = spark.createDataFrame([(1, -5.0), (1, 5.0), (1, 99.0), (2, 7.0)], "track int, at double")
    assert {(r.track, r.at): r.x for r in tracks.positions_at(tr, asks).collect()} == {(1, -5.0): 0, (1, 5.0): 5, (1, 99.0): 20, (2, 7.0): 1}
    even = tracks.evenly_spaced(tr.where("track = 1"), 3).collect()
    assert sorted(round(r.x, 6) for r in even) == [0, 10, 20]


def test_state_and_diff(spark):
    log = spark.createDataFrame([("a", 1, "set", {"x": "1", "y": "2"}), ("a", 2, "set", {"x": "3"}), ("b", 3, "set", {"z": "1"}), ("b", 4, "remove", None), ("c", 5, "remove", None), ("c", 6, "set", {"q": "9"})], "k string, ord int, op string, patch map<string,string>")
    got = {(r.k, r.attribute): r.value for r in changes.state(log, ["k"]).collect()}
    assert got == {("a", "x"): "3", ("a", "y"): "2", ("c", "q"): "9"}
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, None), (4, "d")], "k int, v string")
    assert {r.k: r.status for r in changes.diff(old, new, "k", ["v"]).collect()} == {1: "modified", 2: "unchanged", 3: "removed", 4: "added"}
    assert sorted(r.k for r in changes.upsert(old, new, "k").collect()) == [1, 2, 3, 4]


def test_labels(spark):
    rows = [(i, i * 0.6, 1.0) for i in range(6)]
    df = spark.createDataFrame(rows, "id int, x double, p double").select("id", "p", S.box(F.col("x"), F.lit(0.0), F.col("x") + 1, F.lit(1.0)).alias("b"))
    assert sorted(r["id"] for r in changes.suppress_overlaps(df, "id", "b", "p").collect()) == [0, 2, 4]


def test_filters(spark):
    df = spark.createDataFrame([("road", 3, "#f00"), ("rail", None, "x"), (None, 9, "#01020304")], "class string, n int, c string")
    assert df.where(filters.compile_filter('["all", ["==", ["get", "class"], "road"], [">", ["get", "n"], 1]]')).count() == 1
    assert df.where(filters.compile_filter(["!=", ["get", "class"], "road"])).count() == 2
    assert df.where(filters.compile_filter(None)).count() == 3
    assert [r.v for r in df.select(filters.compile_value(["match", ["get", "class"], "road", 1, ["rail", "tram"], 2, 0]).alias("v")).collect()] == [1, 2, 0]
    colours = [r.v for r in df.select(filters.color("c").alias("v")).collect()]
    assert colours[0].r == 1 and colours[0].g == 0 and colours[1].r == pytest.approx(128 / 255) and colours[2].a == pytest.approx(4 / 255)


def test_antimeridian(spark):
    df = spark.range(1).select("id", S.ring((170.0, 0.0), (-170.0, 10.0), (-160.0, 10.0)).alias("l"))
    got = sorted(tiling.split_at_antimeridian(df, "id", "l").collect(), key=lambda r: r.part)
    assert [[(p.x, p.y) for p in r.line] for r in got] == [[(170, 0), (180, 5)], [(-180, 5), (-170, 10), (-160, 10)]]


def test_queries_cover_whole_tables(spark):
    from terraloom import queries

    sf_dir = "/root/testdata/sf0.01"
    z = {(r.row, r.col): r.value for r in queries.part_raster(spark, sf_dir).collect()}
    around = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    want = {k: v if any((k[0] + i, k[1] + j) not in z for i, j in around) else float("inf") for k, v in z.items()}
    moved = True
    while moved:
        moved = False
        for (i, j), v in want.items():
            low = max(z[i, j], min(want.get((i + a, j + b), v) for a, b in around))
            if low < v:
                want[i, j], moved = low, True
    assert {(r.row, r.col): r.value for r in queries.fill_sinks(spark, sf_dir).collect()} == want
    own = {r.id: (r.x, r.y) for r in queries.customers(spark, sf_dir).collect()}
    got = {r.id: (r.lng, r.lat) for r in queries.laea_everywhere(spark, sf_dir).collect()}
    assert set(got) == {i for i, p in own.items() if p != (-170, -20)}
    assert all(min(abs(got[i][0] - own[i][0]), 360 - abs(got[i][0] - own[i][0])) < 2e-3 and abs(got[i][1] - own[i][1]) < 2e-3 for i in got)
