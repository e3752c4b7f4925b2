"""Steps that were rebuilt for larger tables, against the plain expressions or brute force."""

import math
import random

from pyspark.sql import functions as F

from terraloom import families, queries  # noqa: F401  (registers its queries beside the others)
from terraloom.functions import geodesy as G
from terraloom.functions import shapes as S
from terraloom.operators import changes, clustering, interpolate, overlay, spatial_join
from terraloom.plans.lineage import once_each

RING = "array<struct<x:double,y:double>>"


def ring_pairs(spark):
    rng = random.Random(5)

    def convex(n, closed):
        cx, cy, r, turn = rng.uniform(0, 4), rng.uniform(0, 4), rng.uniform(0.5, 3), rng.uniform(0, 6)
        pts = [(cx + r * math.cos(turn + 2 * math.pi * k / n), cy + r * math.sin(turn + 2 * math.pi * k / n)) for k in range(n)]
        pts = pts[::-1] if rng.random() < 0.5 else pts
        return pts + pts[:1] if closed else pts

    box = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    beside = [(2.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0)]
    inner = [(0.5, 0.5), (1.0, 0.5), (1.0, 1.0)]
    rows = [(k, convex(rng.randint(3, 7), k % 2), convex(rng.randint(3, 7), k % 3)) for k in range(60)]
    rows += [(100, box, box), (101, box, beside), (102, inner, box), (103, box, inner), (104, None, box), (105, box, [])]
    return spark.createDataFrame(rows, f"id int, ra {RING}, rb {RING}")


def test_overlay_areas_equal_the_column_expressions(spark):
    pairs = ring_pairs(spark)
    want = {r.id: r for r in pairs.where("id < 104").select("id", F.abs(S.signed_area("ra")).alias("a"), F.abs(S.signed_area("rb")).alias("b"), F.coalesce(F.abs(S.signed_area(S.intersection("ra", "rb"))), F.lit(0.0)).alias("c")).collect()}
    got = {r.id: r for r in overlay.areas(pairs, "ra", "rb").collect()}
    assert set(got) == set(want) | {104, 105} and got[104].common is None and got[105].area_a is None
    for i, w in want.items():
        assert all(abs(x - y) < 1e-9 for x, y in zip(w[1:], (got[i].area_a, got[i].area_b, got[i].common)))


def test_ring_relations_equal_the_column_expressions(spark):
    pairs = ring_pairs(spark)
    names = ["intersects", "within", "contains", "overlaps", "touches"]
    tests = [S.rings_intersect, S.ring_within, S.ring_contains, S.rings_overlap, S.rings_touch]
    want = {r.id: tuple(r[1:]) for r in pairs.where("id < 104").select("id", *[t("ra", "rb").alias(n) for n, t in zip(names, tests)]).collect()}
    got = {r.id: tuple(r[1:]) for r in overlay.relations(pairs, "ra", "rb").collect()}
    assert {i: g for i, g in got.items() if i < 104} == want and got[104] == (None,) * 5
    assert len(set(want.values())) > 4


def test_sides_of_boxes_tell_what_their_rings_do(spark):
    """Boxes that meet intersect, and within agrees with the predicate of rings, with common sides and corners too."""
    rng = random.Random(6)
    side = lambda: sorted(rng.sample(range(6), 2))
    rows = []
    for i in range(300):
        (aw, ae), (as_, an), (bw, be), (bs, bn) = side(), side(), side(), side()
        off = rng.choice([0.0, 0.0, 0.5, 1e-12])
        rows.append((i, *(float(v) for v in (aw, as_, ae, an)), *(v + off for v in (bw, bs, be, bn))))
    rows += [(300, 0.0, 0.0, 2.0, 2.0, 0.0, 0.0, 2.0, 2.0), (301, 0.0, 1.0, 3.0, 2.0, 1.0, 0.0, 2.0, 3.0)]
    boxes = spark.createDataFrame(rows, "id int, aw double, as_ double, ae double, an double, bw double, bs double, be double, bn double").select("id", S.box("aw", "as_", "ae", "an").alias("a"), S.box("bw", "bs", "be", "bn").alias("b"))
    ring = lambda n: S.box_ring(f"{n}.west", f"{n}.south", f"{n}.east", f"{n}.north")
    met = boxes.where(S.box_overlap("a", "b"))
    got = met.select("id", S.rings_intersect(ring("a"), ring("b")).alias("meets"), S.box_within("a", "b").alias("w"), S.ring_within(ring("a"), ring("b")).alias("rw"), S.box_within("b", "a").alias("c"), S.ring_contains(ring("a"), ring("b")).alias("rc")).collect()
    assert all(r.meets and r.w == r.rw and r.c == r.rc for r in got)
    assert sum(r.w for r in got) > 5 and sum(r.c for r in got) > 5 and sum(not r.w and not r.c for r in got) > 5


def test_topology_takes_no_ring_of_a_pair(spark, sf_dir):
    """Pairs, which are many, are tested by the sides of their boxes inside the join's stage, not by Python."""
    plan = queries.topology(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "MapInArrow" not in plan and "Python" not in plan


def test_variogram_of_many_samples_at_few_places(spark):
    """12,000 samples at 30 places: 72 million pairs, known from the places' moments; null values don't count."""
    rows = spark.range(12_000).selectExpr("cast(id % 6 as double) x", "cast(floor(id / 6) % 5 as double) y", "case when id % 101 = 0 then null else cast((id * 37) % 23 as double) end value")
    own = [(r.x, r.y, r.value) for r in rows.collect()]
    places = {}
    for x, y, v in own:
        places.setdefault((x, y), []).append(v)
    most = math.hypot(5, 4)
    want = {}
    for i, (p, vs) in enumerate(sorted(places.items())):
        for q, ws in sorted(places.items())[i:]:
            d = math.hypot(p[0] - q[0], p[1] - q[1])
            lag = min(9, math.floor(d / most * 10))
            n, g, m = want.get(lag, (0, 0.0, 0))
            known, other = [v for v in vs if v is not None], [v for v in ws if v is not None]
            every = sum(len(other) * v * v - 2 * v * sum(other) + sum(w * w for w in other) for v in known) / 2
            same = p == q
            n += len(vs) * (len(vs) - 1) // 2 if same else len(vs) * len(ws)
            m += len(known) * (len(known) - 1) // 2 if same else len(known) * len(other)
            want[lag] = (n, g + (every / 2 if same else every), m)
    got = {r.lag: r for r in interpolate.variogram(rows).collect()}
    assert {k: r.pairs for k, r in got.items()} == {k: w[0] for k, w in want.items()}
    assert all(abs(got[k].semivariance - w[1] / w[2]) < 1e-7 for k, w in want.items())


def test_dbscan_counts_all_points_of_a_place(spark):
    places = [(0.0, 0.0, 1), (3.0, 0.0, 3), (6.0, 0.0, 1), (20.0, 0.0, 5), (40.0, 0.0, 4), (60.0, 60.0, 1), (64.0, 60.0, 1), (62.0, 63.0, 1), (62.0, 58.0, 1), (62.0, 61.0, 1)]
    rows, n = [], 0
    for x, y, k in reversed(places):
        for _ in range(k):
            rows.append((n, x, y))
            n += 1
    rows.append((n, None, 1.0))
    got = {r.id: r.label for r in clustering.dbscan(spark.createDataFrame(rows, "id int, x double, y double"), 7.0, 4, "id").collect()}
    near = {i: {j for j, u, v in rows if j != i and None not in (x, u) and (x - u) ** 2 + (y - v) ** 2 <= 49} for i, x, y in rows}
    core = {i for i in near if len(near[i]) >= 4}
    root = {i: i for i in core}
    for _ in core:
        root = {i: min([root[i], *(root[j] for j in near[i] & core)]) for i in core}
    order = sorted(set(root.values()))
    want = {i: order.index(root[i]) if i in core else order.index(min(root[j] for j in near[i] & core)) if near[i] & core else -1 for i in near}
    assert got == want and len(order) > 2 and -1 in want.values()


def test_suppressed_labels_with_equal_boxes(spark):
    rng = random.Random(3)
    spots = [(rng.randint(0, 12), rng.randint(0, 12)) for _ in range(40)]
    rows = [(i, *rng.choice(spots), rng.randint(0, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, x int, y int, p int").select("id", S.box(F.col("x"), F.col("y"), F.col("x") + 1.5, F.col("y") + 1.5).alias("b"), "p")
    kept = []
    for i, x, y, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        if all(abs(x - u) > 1.5 or abs(y - v) > 1.5 for _, u, v in kept):
            kept.append((i, x, y))
    assert {r.id for r in changes.suppress_overlaps(df, "id", "b", "p").collect()} == {k[0] for k in kept}


def test_reach_is_compared_squared(spark):
    """A squared distance a little above the squared reach has a root that rounds to the reach."""
    x, y = 11.653915625078684, 16.25380726487019
    a = spark.createDataFrame([(1, 0.0, 0.0)], "i int, x double, y double")
    b = spark.createDataFrame([(1, x, y), (2, 12.0, 16.0)], "j int, rx double, ry double")
    assert x * x + y * y > 400 and math.sqrt(x * x + y * y) == 20.0
    assert [r.j for r in spatial_join.within_reach(a, b, 20.0, ["x", "y"], ["rx", "ry"]).collect()] == [2]


def test_nearest_with_many_queries_and_points_at_one_place(spark):
    q = spark.createDataFrame([(i, float(i % 3), 0.0) for i in range(30)], "i int, x double, y double")
    p = spark.createDataFrame([(j, float(j % 4), 1.0) for j in range(40)], "j int, rx double, ry double")
    want = {(i, k + 1, j) for i in range(30) for k, (_, j) in enumerate(sorted(((j % 4 - i % 3) ** 2 + 1, j) for j in range(40))[:12])}
    assert {(r.i, r.rank, r.j) for r in spatial_join.nearest_planar(q, p, 12, "i", "j").collect()} == want


def test_geodesics_beyond_half_a_turn(spark):
    rows = [(x, y, b, m) for x, y, b in ((10.0, 20.0, 37.0), (-179.9, -84.0, 200.0), (0.0, 0.0, 90.0)) for m in (1000.0, 19_990_000.0, 41_000_000.0, 120_020_000.0)]
    out = spark.createDataFrame(rows, "x double, y double, b double, m double").select("m", G.geodesic_length("x", "y", "b", "m").alias("got")).collect()
    assert len(out) == 12 and all(abs(r.got - r.m) < 5e-4 for r in out)


def larger(spark, tmp_path, ids):
    """A folder with customers of the given ids."""
    spark.createDataFrame([(i, 1.5) for i in ids], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def test_large_ids_read_as_their_sql_has_them(spark, tmp_path):
    sf_dir = larger(spark, tmp_path, [1, 3600, 7200, 100_001, 900_001])
    q = queries.QUERIES
    assert {r.id: r.area for r in q["great_circles"](spark, sf_dir).collect()}[900_001] == "900.00 ha"
    assert {r.id: r.lng for r in q["laea_round_trip"](spark, sf_dir).collect()}[7200] == -180.0
    metres = {r.id: (r.metres, r.lng) for r in q["geodesics"](spark, sf_dir).collect()}
    assert metres[900_001][0] == 900_021_000.0 and metres[3600] == (3_620_000.0, -180.0)


def test_large_marker_clusters_have_whole_numbers(spark, tmp_path):
    rows = queries.QUERIES["marker_clusters"](spark, larger(spark, tmp_path, [61_200 * k for k in range(1200)])).collect()
    assert [(r["count"], r["label"]) for r in rows] == [(1200, "1200")]


def test_costly_columns_are_joined_back_to_every_row(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 1.0, None), (3, None, 2.0), (4, 5.0, 2.0)], "id int, x double, y double")
    got = once_each(df, ["x", "y"], lambda own: own.withColumn("s", F.coalesce("x", F.lit(0.0)) + F.coalesce("y", F.lit(0.0)))).select("id", "s").collect()
    assert sorted((r.id, r.s) for r in got) == [(1, 1.0), (2, 1.0), (3, 2.0), (4, 7.0)]
