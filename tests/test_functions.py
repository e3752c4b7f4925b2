import math

import pytest
from pyspark.sql import functions as F

from terraloom.functions import cells, geodesy, projection, shapes, tiles
from terraloom.functions import num as N


def one(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


@pytest.fixture(autouse=True)
def rings(spark):
    """Columns need a session, so the rings are made here."""
    globals().update(
        SQUARE=shapes.ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0)),
        OTHER=shapes.ring((5, 5), (15, 5), (15, 15), (5, 15), (5, 5)),
        BOWTIE=shapes.ring((0, 0), (10, 10), (10, 0), (0, 10), (0, 0)),
        ELL=shapes.ring((0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)),
    )


def test_known_distance(spark):
    ends = [F.lit(v) for v in (-74.006, 40.7128, -0.1278, 51.5074)]
    ellipsoid, same, bearing = one(spark, geodesy.ellipsoid_distance(*ends), geodesy.ellipsoid_distance(ends[0], ends[1], ends[0], ends[1]), geodesy.initial_bearing(*ends))
    assert ellipsoid == pytest.approx(5585233.58, abs=0.1)
    assert same == 0 and bearing == pytest.approx(51.2, abs=0.2)


def test_round_trips(spark):
    lng, lat, h = F.lit(116.4), F.lit(39.9), F.lit(50.0)
    back = geodesy.from_ecef(*geodesy.to_ecef(lng, lat, h))
    enu = geodesy.ecef_to_enu(*geodesy.enu_to_ecef(3.0, 4.0, 5.0, lng, lat, h), lng, lat, h)
    merc = tiles.from_mercator(*tiles.to_mercator(lng, lat))
    px = tiles.from_pixel(*tiles.to_pixel(lng, lat, F.lit(5)), F.lit(5))
    bd = projection.bd09_to_gcj(*projection.gcj_to_bd09(lng, lat))
    hel = projection.helmert(*projection.helmert(1e6, 2e6, 3e6, 10, 20, 30, 1, 2, 3, 5), 10, 20, 30, 1, 2, 3, 5, inverse=True)
    got = one(spark, *back, *enu, *merc, *px, *bd, *hel)
    assert got[:3] == pytest.approx([116.4, 39.9, 50.0], abs=1e-6)
    assert got[3:6] == pytest.approx([3, 4, 5], abs=1e-6)
    assert got[6:10] == pytest.approx([116.4, 39.9] * 2, abs=1e-9)
    assert got[10:12] == pytest.approx([116.4, 39.9], abs=1e-4)
    assert got[12:] == pytest.approx([1e6, 2e6, 3e6], abs=1e-6)


def test_destination_and_intermediate(spark):
    to = geodesy.destination(F.lit(10.0), F.lit(50.0), F.lit(90.0), F.lit(1000.0))
    gap = geodesy.haversine(F.lit(10.0), F.lit(50.0), *to)
    mid, half = geodesy.midpoint(0.0, 10.0, 40.0, 30.0), geodesy.intermediate(0.0, 10.0, 40.0, 30.0, 0.5)
    got = one(spark, gap, *mid, *half)
    assert got[0] == pytest.approx(1000, abs=1e-3) and got[1:3] == pytest.approx(got[3:5], abs=1e-9)


def test_measures(spark):
    com, area, hole = shapes.center_of_mass(ELL), shapes.signed_area(ELL), shapes.polygon_area(F.array(SQUARE, shapes.ring((1, 1), (2, 1), (2, 2), (1, 2))))
    got = one(spark, area, com["x"], com["y"], hole, shapes.perimeter(SQUARE), shapes.length(SQUARE))
    assert got == pytest.approx([12, 5 / 3, 5 / 3, 99, 40, 40])


def test_predicates(spark):
    got = one(
        spark,
        shapes.in_ring(0, 5, SQUARE), shapes.in_ring(10, 5, SQUARE), shapes.in_ring(5, 5, SQUARE),
        shapes.rings_intersect(SQUARE, OTHER), shapes.rings_overlap(SQUARE, OTHER), shapes.ring_contains(SQUARE, shapes.ring((1, 1), (2, 1), (2, 2))),
        shapes.rings_disjoint(SQUARE, shapes.translate(SQUARE, 20, 0)), shapes.rings_touch(SQUARE, shapes.translate(SQUARE, 10, 0)),
        shapes.is_valid(F.array(SQUARE)), shapes.is_valid(F.array(BOWTIE)), F.size(shapes.kinks(BOWTIE)),
        shapes.lines_cross(shapes.ring((0, 0), (4, 4)), shapes.ring((0, 4), (4, 0))), shapes.on_line(2, 0, SQUARE),
        shapes.winding(5, 5, SQUARE), shapes.in_triangle(1, 1, 0, 0, 4, 0, 0, 4), shapes.in_triangle(1, 1, 0, 0, 1, 1, 2, 2),
    )
    assert got == [True, False, True, True, True, True, True, True, True, False, 1, True, True, 1, True, False]


def test_clipping(spark):
    part = shapes.visible_part(-5.0, 5.0, 15.0, 5.0, 0, 0, 10, 10)
    none = shapes.visible_part(-5.0, 15.0, 15.0, 15.0, 0, 0, 10, 10)
    got = one(spark, shapes.signed_area(shapes.clip_ring(OTHER, 0, 0, 10, 10)), F.size(shapes.clip_ring(shapes.translate(SQUARE, 50, 0), 0, 0, 10, 10)), part["x0"], part["x1"], none.isNull())
    assert got == [25, 0, 0, 10, True]


def test_lines(spark):
    got = one(spark, F.size(shapes.chaikin(shapes.ring((0, 0), (4, 0), (4, 4)))), F.size(shapes.clean(shapes.ring((0, 0), (0, 0), (1, 1), (1, 1)))), shapes.signed_area(F.element_at(shapes.rewind(F.array(F.reverse(SQUARE))), 1)))
    assert got == [6, 2, 100]


def test_tiles_and_cells(spark):
    key = tiles.tile_key(0, 17, 100000, 99999)
    s, z, x, y = tiles.decode_tile_key(key)
    west, south, east, north = tiles.tile_bounds(0, 0, 0)
    got = one(spark, s, z, x, y, west, north, tiles.tile_url("{s}/{z}/{x}/{y}", 3, 1, 2), cells.geohash(-0.1257, 51.5085, 5), cells.geohash(float("nan"), 1.0, 3), cells.geohash_bounds(F.lit("a")).isNull(), cells.geohash_neighbor(F.lit("gcpvj"), 0, 0, 5))
    assert got[:5] == [0, 17, 100000, 99999, -180] and got[5] == pytest.approx(85.0511, abs=1e-4)
    assert got[6:] == ["a/3/1/2", "gcpvj", "", True, "gcpvj"]


def test_s2_children_lie_in_their_parent(spark):
    rows = spark.range(200).select((F.col("id") * 1.7 - 170).alias("x"), (F.col("id") % 170 - 85.0).alias("y"))
    got = rows.select(cells.s2_token_parts("x", "y", 5).alias("c"), cells.s2_token_parts("x", "y", 3).alias("p")).collect()
    assert all(r.c.startswith(r.p) for r in got) and len({r.c for r in got}) > 100


def test_numbers(spark):
    got = one(spark, N.round_half_up(-2.5), N.div(1.0, 0.0), N.clamp(float("nan"), 0, 1), N.normalize_angle(3 * math.pi), N.catmull_rom(0.0, 1.0, 2.0, 3.0, 0.5), N.bezier_cubic(0.0, 0.0, 1.0, 1.0, 0.5), N.vec_dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))), N.vec_length(F.array(F.lit(3.0), F.lit(4.0))), N.inverse_lerp(1.0, 1.0, 5.0))
    assert got[0] == -2 and got[1] is None and math.isnan(got[2])
    assert got[3:] == pytest.approx([math.pi, 1.5, 0.5, 11, 5, 0])
