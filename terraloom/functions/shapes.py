"""Rings, lines and boxes as native column expressions.

A position is struct<x: double, y: double>, a line or ring an array of them, a
polygon an array of rings, the outer one first.  Rings may be closed or not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraloom.functions import geodesy as G
from terraloom.functions.num import c, div, let

POSITION = "struct<x:double,y:double>"
RING = f"array<{POSITION}>"
GONE = 0.999  # a difference of less than the rest is null
POLYGON = f"array<{RING}>"


def point(x, y) -> Column:
    return F.struct(c(x).cast("double").alias("x"), c(y).cast("double").alias("y"))


def ring(*xy) -> Column:
    return F.array(*[point(x, y) for x, y in xy])


def box_ring(west, south, east, north) -> Column:
    return ring((west, south), (east, south), (east, north), (west, north), (west, south))


def from_wkt_numbers(coords: Column) -> Column:
    """array<array<double>> (as GeoJSON has it) to positions."""
    return F.transform(coords, lambda p: point(p[0], p[1]))


def edges(line, closed: bool) -> Column:
    """array<struct<a, b>> of neighbouring positions; ``closed`` adds the edge from last to first."""

    def pairs(line):
        rest = F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0)))
        ends = F.concat(rest, F.slice(line, 1, 1)) if closed else rest
        starts = line if closed else F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0)))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    return let(line, pairs)


def _total(array, f) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, e: s + f(e))


def signed_area(r) -> Column:
    """Shoelace area, positive counter-clockwise."""
    return _total(edges(r, True), lambda e: e.a.x * e.b.y - e.b.x * e.a.y) / 2


def polygon_area(polygon) -> Column:
    """Outer area less the holes."""
    p = c(polygon)
    return F.abs(signed_area(p[0])) - F.aggregate(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.lit(0.0), lambda s, r: s + F.abs(signed_area(r)))


def length(line) -> Column:
    return _total(edges(line, False), lambda e: F.hypot(e.b.x - e.a.x, e.b.y - e.a.y))


def perimeter(r) -> Column:
    return _total(edges(r, True), lambda e: F.hypot(e.b.x - e.a.x, e.b.y - e.a.y))


def geodesic_length(line, radius: float = G.A) -> Column:
    return _total(edges(line, False), lambda e: G.haversine(e.a.x, e.a.y, e.b.x, e.b.y, radius))


def spherical_area(r, radius: float = G.MEAN_RADIUS) -> Column:
    """Square metres of a ring of degrees on the sphere."""
    return F.abs(_total(edges(r, True), lambda e: F.radians(e.b.x - e.a.x) * (2 + F.sin(F.radians(e.a.y)) + F.sin(F.radians(e.b.y))))) * radius * radius / 2


def vertex_mean(line) -> Column:
    """Mean of all vertices as given, so a closing vertex counts twice."""
    line = c(line)
    n = F.size(line)
    return point(div(_total(line, lambda p: p.x), n), div(_total(line, lambda p: p.y), n))


def center_of_mass(r) -> Column:
    """Area-weighted centre; of a ring without area the vertex mean."""
    e = edges(r, True)
    cross = lambda e: e.a.x * e.b.y - e.b.x * e.a.y
    a6 = _total(e, cross) * 3
    x, y = div(_total(e, lambda e: (e.a.x + e.b.x) * cross(e)), a6), div(_total(e, lambda e: (e.a.y + e.b.y) * cross(e)), a6)
    m = vertex_mean(r)
    return point(F.coalesce(x, m.x), F.coalesce(y, m.y))


def bounds(line) -> Column:
    """struct<west, south, east, north>."""
    xs, ys = F.transform(c(line), lambda p: p.x), F.transform(c(line), lambda p: p.y)
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def map_line(line, fx, fy) -> Column:
    return F.transform(c(line), lambda p: point(fx(p), fy(p)))


def translate(line, dx, dy) -> Column:
    return map_line(line, lambda p: p.x + c(dx), lambda p: p.y + c(dy))


def scale(line, factor, pivot=None) -> Column:
    """About a pivot, by default the vertex mean."""
    m = vertex_mean(line) if pivot is None else pivot
    return map_line(line, lambda p: m.x + (p.x - m.x) * c(factor), lambda p: m.y + (p.y - m.y) * c(factor))


def rotate(line, degrees, pivot=None) -> Column:
    """Counter-clockwise about a pivot, by default the vertex mean."""
    m = vertex_mean(line) if pivot is None else pivot
    s, k = F.sin(F.radians(c(degrees))), F.cos(F.radians(c(degrees)))
    return map_line(line, lambda p: m.x + (p.x - m.x) * k - (p.y - m.y) * s, lambda p: m.y + (p.x - m.x) * s + (p.y - m.y) * k)


def flip(line, axis: str) -> Column:
    return map_line(line, lambda p: -p.x if axis == "x" else p.x, lambda p: -p.y if axis == "y" else p.y)


def rewind(polygon) -> Column:
    """Outer ring counter-clockwise, holes clockwise."""
    return F.transform(c(polygon), lambda r, i: F.when((signed_area(r) < 0) == (i == 0), F.reverse(r)).otherwise(r))


def clean(line, eps: float = 1e-10) -> Column:
    """Without positions equal to the one before."""

    def distinct(line):
        before = lambda i: F.element_at(line, F.greatest(i, F.lit(1)))
        return F.filter(line, lambda p, i: (i == 0) | (F.abs(p.x - before(i).x) > eps) | (F.abs(p.y - before(i).y) > eps))

    return let(line, distinct)


def chaikin(line, rounds: int = 1) -> Column:
    """Corner cutting of an open line: ends stay, each edge gives its quarter points."""
    out = c(line)
    for _ in range(rounds):
        cut = F.flatten(F.transform(edges(out, False), lambda e: F.array(point(e.a.x * 0.75 + e.b.x * 0.25, e.a.y * 0.75 + e.b.y * 0.25), point(e.a.x * 0.25 + e.b.x * 0.75, e.a.y * 0.25 + e.b.y * 0.75))))
        out = F.concat(F.slice(out, 1, 1), cut, F.slice(out, -1, 1))
    return out


def visible_part(x0, y0, x1, y1, west, south, east, north) -> Column:
    """Segment within a box by its entry and exit parameters, null if none: struct<x0, y0, x1, y1>."""
    dx, dy = c(x1) - c(x0), c(y1) - c(y0)
    lo, hi, ok = F.lit(0.0), F.lit(1.0), F.lit(True)
    for p, q in ((-dx, c(x0) - c(west)), (dx, c(east) - c(x0)), (-dy, c(y0) - c(south)), (dy, c(north) - c(y0))):
        r = div(q, p)
        lo = F.when(p < 0, F.greatest(lo, r)).otherwise(lo)
        hi = F.when(p > 0, F.least(hi, r)).otherwise(hi)
        ok = ok & ~((p == 0) & (q < 0))
    return F.when(ok & (lo <= hi), F.struct((c(x0) + lo * dx).alias("x0"), (c(y0) + lo * dy).alias("y0"), (c(x0) + hi * dx).alias("x1"), (c(y0) + hi * dy).alias("y1")))


def clip_ring(r, west, south, east, north) -> Column:
    """A ring cut by the four sides of a box, one half plane after the other (pieces stay joined along the cut)."""
    sides = F.array(*[F.struct(F.lit(axis).alias("x"), F.lit(float(sign)).alias("sign"), c(limit).cast("double").alias("limit")) for axis, sign, limit in ((True, 1, west), (True, -1, east), (False, 1, south), (False, -1, north))])

    def cut(line, side):
        inside = lambda p: side["sign"] * (F.when(side["x"], p.x).otherwise(p.y) - side["limit"])
        none = F.array().cast(RING)

        def keep(e):
            """The point where the edge crosses the side, then its end if that is inside."""
            t = F.coalesce(div(inside(e.a), inside(e.a) - inside(e.b)), F.lit(0.0))
            mid = point(e.a.x + t * (e.b.x - e.a.x), e.a.y + t * (e.b.y - e.a.y))
            return F.concat(F.when((inside(e.a) >= 0) != (inside(e.b) >= 0), F.array(mid)).otherwise(none), F.when(inside(e.b) >= 0, F.array(e.b)).otherwise(none))

        return F.flatten(F.transform(edges(line, True), keep))

    return F.aggregate(sides, c(r).cast(RING), cut)


def clip_convex(r, by) -> Column:
    """A ring cut by the half planes of a convex ring (given in either turn), one after the other."""

    def cut_all(by):
        turn = F.when(signed_area(by) < 0, -1.0).otherwise(1.0)

        def cut(line, side):
            inside = lambda p: turn * _turn(side.a.x, side.a.y, side.b.x, side.b.y, p.x, p.y)
            none = F.array().cast(RING)

            def keep(e):
                t = F.coalesce(div(inside(e.a), inside(e.a) - inside(e.b)), F.lit(0.0))
                mid = point(e.a.x + t * (e.b.x - e.a.x), e.a.y + t * (e.b.y - e.a.y))
                return F.concat(F.when((inside(e.a) >= 0) != (inside(e.b) >= 0), F.array(mid)).otherwise(none), F.when(inside(e.b) >= 0, F.array(e.b)).otherwise(none))

            return F.when(F.size(line) == 0, line).otherwise(F.flatten(F.transform(edges(line, True), keep)))

        return F.aggregate(edges(by, True), c(r).cast(RING), cut)

    return let(c(by).cast(RING), cut_all)


def split_ring(r, x0, y0, x1, y1) -> tuple[Column, Column]:
    """Parts of a ring left and right of a line; a line without length leaves all on the left.  Pieces of a side stay joined along the line."""
    x0, y0, x1, y1 = (c(v).cast("double") for v in (x0, y0, x1, y1))
    none = F.array().cast(RING)

    def half(sign: float):
        inside = lambda p: sign * _turn(x0, y0, x1, y1, p.x, p.y)

        def keep(e):
            t = F.coalesce(div(inside(e.a), inside(e.a) - inside(e.b)), F.lit(0.0))
            mid = point(e.a.x + t * (e.b.x - e.a.x), e.a.y + t * (e.b.y - e.a.y))
            return F.concat(F.when((inside(e.a) >= 0) != (inside(e.b) >= 0), F.array(mid)).otherwise(none), F.when(inside(e.b) >= 0, F.array(e.b)).otherwise(none))

        return F.flatten(F.transform(edges(r, True), keep))

    flat = (x0 == x1) & (y0 == y1)
    return F.when(flat, c(r).cast(RING)).otherwise(half(1.0)), F.when(flat, none).otherwise(half(-1.0))


# Overlays of a ring with a convex one.  Polygons are arrays of rings.


def intersection(a, b) -> Column:
    """Common ring of a ring and a convex ring, null if they have no area in common."""
    return let(clip_convex(a, b), lambda r: F.when(F.abs(signed_area(r)) > 0, r))


def union(a, b) -> Column:
    """Both rings as polygons, not dissolved; ``union_area`` counts what they share once."""
    return F.array(F.array(c(a).cast(RING)), F.array(c(b).cast(RING)))


def _common_area(a, b) -> Column:
    return F.coalesce(F.abs(signed_area(clip_convex(a, b))), F.lit(0.0))


def union_area(a, b) -> Column:
    return F.abs(signed_area(a)) + F.abs(signed_area(b)) - _common_area(a, b)


def difference(a, b) -> Column:
    """Polygon of ring a without the convex ring b, which becomes a hole; null if over 99.9 % of a go."""

    def cut(r):
        share = div(F.abs(signed_area(r)), F.abs(signed_area(a)))
        hole = F.when(F.abs(signed_area(r)) > 0, F.array(c(a).cast(RING), r)).otherwise(F.array(c(a).cast(RING)))
        return F.when(F.coalesce(share, F.lit(0.0)) <= GONE, hole)

    return let(clip_convex(a, b), cut)


def symmetric_difference(a, b) -> Column:
    """Array of the differences of two convex rings that are left."""
    return F.filter(F.array(difference(a, b), difference(b, a)), lambda p: p.isNotNull())


def make_valid(polygon) -> Column:
    """Rings without positions repeated in a row, the outer one counter-clockwise, holes clockwise, rings of fewer than three corners left out."""
    return rewind(F.filter(F.transform(c(polygon), lambda r: clean(r)), lambda r: F.size(r) >= 3))


# Buffers in degrees and metres, by great circles.


def _offset(line, i, n, metres, turn: float, closed: bool) -> Column:
    """Position i of a line moved along the bisector of its two edges' bearings, turned by ``turn`` degrees."""
    at = lambda k: F.element_at(line, k)
    before = F.when(i > 1, at(F.greatest(i - 1, F.lit(1)))).otherwise(at(F.lit(-1)) if closed else at(F.lit(1)))
    after = F.when(i < n, at(F.least(i + 1, n))).otherwise(at(F.lit(1)) if closed else at(F.lit(-1)))
    here = at(i)
    come, go = G.initial_bearing(before.x, before.y, here.x, here.y), G.initial_bearing(here.x, here.y, after.x, after.y)
    if not closed:
        come, go = F.when(i > 1, come).otherwise(go), F.when(i < n, go).otherwise(come)
    middle = F.degrees(F.atan2(F.sin(F.radians(come)) + F.sin(F.radians(go)), F.cos(F.radians(come)) + F.cos(F.radians(go))))
    return point(*G.destination(here.x, here.y, middle + turn, metres))


def offset_curve(line, metres, side: str = "left") -> Column:
    """A line beside another, each position moved by ``metres`` at right angles to the mean bearing there."""
    turn = -90.0 if side == "left" else 90.0
    return let(clean(line), lambda own: F.transform(F.sequence(F.lit(1), F.size(own)), lambda i: _offset(own, i, F.size(own), c(metres), turn, False)))


def line_buffer(line, metres, steps: int = 16) -> Column:
    """Closed ring around a line of two positions at least: both offset curves, joined by round caps of ``steps`` parts; nothing is dissolved."""

    def around(own):
        n = F.size(own)
        left = F.transform(F.sequence(F.lit(1), n), lambda i: _offset(own, i, n, c(metres), -90.0, False))
        right = F.transform(F.sequence(F.lit(1), n), lambda i: _offset(own, i, n, c(metres), 90.0, False))

        def cap(p, bearing):
            return F.transform(F.sequence(F.lit(1), F.lit(steps - 1)), lambda k: point(*G.destination(p.x, p.y, bearing - 90 + k * (180.0 / steps), c(metres))))

        first, second = F.element_at(own, 1), F.element_at(own, 2)
        last, before = F.element_at(own, -1), F.element_at(own, -2)
        ring = F.concat(left, cap(last, G.initial_bearing(before.x, before.y, last.x, last.y)), F.reverse(right), cap(first, G.initial_bearing(second.x, second.y, first.x, first.y)))
        return F.when(n >= 2, F.concat(ring, F.slice(ring, 1, 1)))

    return let(clean(line), around)


def ring_buffer(r, metres) -> Column:
    """Closed ring around an outer ring (holes don't count), every corner moved outward along its bisector."""

    def around(own):
        n = F.size(own)
        out = F.transform(F.sequence(F.lit(1), n), lambda i: _offset(own, i, n, c(metres), 90.0, True))
        return F.concat(out, F.slice(out, 1, 1))

    open_ = lambda r: F.when((F.element_at(r, 1) == F.element_at(r, -1)) & (F.size(r) > 1), F.slice(r, 1, F.size(r) - 1)).otherwise(r)
    return let(let(let(clean(r), open_), lambda r: F.when(signed_area(r) < 0, F.reverse(r)).otherwise(r)), around)


# Predicates.


def in_ring(x, y, r) -> Column:
    """Even-odd ray cast; left and lower edges belong to the ring, right and upper ones don't."""
    x, y = c(x), c(y)

    def crosses(e):
        spans = (e.a.y > y) != (e.b.y > y)
        at = (e.b.x - e.a.x) * F.try_divide(y - e.a.y, e.b.y - e.a.y) + e.a.x
        return F.when(spans & F.coalesce(x < at, F.lit(False)), 1).otherwise(0)

    return F.aggregate(edges(r, True), F.lit(0), lambda n, e: n + crosses(e)) % 2 == 1


def in_polygon(x, y, polygon) -> Column:
    """In the outer ring and in none of the holes."""
    p = c(polygon)
    return in_ring(x, y, p[0]) & ~F.exists(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda r: in_ring(x, y, r))


def winding(x, y, r) -> Column:
    """Winding number; unlike even-odd it isn't 0 in doubly wound parts."""
    x, y = c(x), c(y)

    def turn(e):
        left = (e.b.x - e.a.x) * (y - e.a.y) - (x - e.a.x) * (e.b.y - e.a.y)
        return F.when((e.a.y <= y) & (e.b.y > y) & (left > 0), 1).when((e.a.y > y) & (e.b.y <= y) & (left < 0), -1).otherwise(0)

    return F.aggregate(edges(r, True), F.lit(0), lambda n, e: n + turn(e))


def segment_distance(x, y, ax, ay, bx, by) -> Column:
    dx, dy = c(bx) - c(ax), c(by) - c(ay)
    t = F.coalesce(div((c(x) - c(ax)) * dx + (c(y) - c(ay)) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return F.hypot(c(x) - (c(ax) + t * dx), c(y) - (c(ay) + t * dy))


def line_distance(x, y, line, closed: bool = False) -> Column:
    """Least distance of a point to the edges."""
    return F.array_min(F.transform(edges(line, closed), lambda e: segment_distance(x, y, e.a.x, e.a.y, e.b.x, e.b.y)))


def on_line(x, y, line, tolerance: float = 1e-10, closed: bool = False) -> Column:
    return line_distance(x, y, line, closed) <= tolerance


def in_triangle(x, y, ax, ay, bx, by, cx, cy, tol: float = 1e-10) -> Column:
    """Barycentric test; a triangle without area holds nothing."""
    det = (c(by) - c(cy)) * (c(ax) - c(cx)) + (c(cx) - c(bx)) * (c(ay) - c(cy))
    u = F.try_divide((c(by) - c(cy)) * (c(x) - c(cx)) + (c(cx) - c(bx)) * (c(y) - c(cy)), det)
    v = F.try_divide((c(cy) - c(ay)) * (c(x) - c(cx)) + (c(ax) - c(cx)) * (c(y) - c(cy)), det)
    return F.coalesce((F.abs(det) > tol) & (u >= -tol) & (v >= -tol) & (u + v <= 1 + tol), F.lit(False))


def _turn(ax, ay, bx, by, px, py) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def segments_cross(e, f) -> Column:
    """Proper crossing of two edges: each separates the ends of the other strictly."""
    d1, d2 = _turn(e.a.x, e.a.y, e.b.x, e.b.y, f.a.x, f.a.y), _turn(e.a.x, e.a.y, e.b.x, e.b.y, f.b.x, f.b.y)
    d3, d4 = _turn(f.a.x, f.a.y, f.b.x, f.b.y, e.a.x, e.a.y), _turn(f.a.x, f.a.y, f.b.x, f.b.y, e.b.x, e.b.y)
    return (d1 * d2 < 0) & (d3 * d4 < 0)


def segments_touch(e, f, eps: float = 1e-10) -> Column:
    """Crossing, or an end of one on the other."""
    near = [segment_distance(p.x, p.y, s.a.x, s.a.y, s.b.x, s.b.y) <= eps for p, s in ((f.a, e), (f.b, e), (e.a, f), (e.b, f))]
    return segments_cross(e, f) | near[0] | near[1] | near[2] | near[3]


def segment_intersection(e, f) -> Column:
    """Common point of two edges, null if they are parallel or don't meet."""
    rx, ry, sx, sy = e.b.x - e.a.x, e.b.y - e.a.y, f.b.x - f.a.x, f.b.y - f.a.y
    den = rx * sy - ry * sx
    t = div((f.a.x - e.a.x) * sy - (f.a.y - e.a.y) * sx, den)
    u = div((f.a.x - e.a.x) * ry - (f.a.y - e.a.y) * rx, den)
    return F.when((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), point(e.a.x + t * rx, e.a.y + t * ry))


def _any_edges(a, b, closed_a: bool, closed_b: bool, test) -> Column:
    return F.exists(edges(a, closed_a), lambda e: F.exists(edges(b, closed_b), lambda f: test(e, f)))


def rings_intersect(a, b) -> Column:
    """Edges touch, or one ring holds a vertex of the other."""
    return _any_edges(a, b, True, True, segments_touch) | in_ring(c(a)[0].x, c(a)[0].y, b) | in_ring(c(b)[0].x, c(b)[0].y, a)


def rings_disjoint(a, b) -> Column:
    return ~rings_intersect(a, b)


def _inside_or_on(p, r) -> Column:
    return in_ring(p.x, p.y, r) | on_line(p.x, p.y, r, closed=True)


def _strictly(p, r) -> Column:
    return in_ring(p.x, p.y, r) & ~on_line(p.x, p.y, r, closed=True)


def ring_contains(a, b) -> Column:
    """All vertices of b in or on a, one of them strictly inside (or b equal to a in its extent)."""
    return F.forall(c(b), lambda p: _inside_or_on(p, a)) & F.exists(c(b), lambda p: _strictly(p, a))


def ring_within(a, b) -> Column:
    return ring_contains(b, a)


def rings_overlap(a, b) -> Column:
    return rings_intersect(a, b) & ~ring_contains(a, b) & ~ring_contains(b, a)


def rings_touch(a, b) -> Column:
    """They meet, but no vertex of one is strictly inside the other and no edges cross."""
    inside = F.exists(c(a), lambda p: _strictly(p, b)) | F.exists(c(b), lambda p: _strictly(p, a))
    return rings_intersect(a, b) & ~inside & ~_any_edges(a, b, True, True, segments_cross)


def lines_cross(a, b) -> Column:
    return _any_edges(a, b, False, False, segments_cross)


def line_crosses_ring(line, r) -> Column:
    """The line has vertices inside and outside."""
    return F.exists(c(line), lambda p: in_ring(p.x, p.y, r)) & F.exists(c(line), lambda p: ~in_ring(p.x, p.y, r))


def kinks(r) -> Column:
    """Points where edges that aren't neighbours cross."""

    def crossings(e):
        each = lambda a, i: F.filter(F.transform(e, lambda b, j: F.when((j > i + 1) & segments_cross(a, b), segment_intersection(a, b))), lambda p: p.isNotNull())
        return F.flatten(F.transform(e, each))

    return let(edges(clean(r), True), crossings)


def is_valid(polygon) -> Column:
    """Every ring has 4 positions at least and no kinks."""
    return F.forall(c(polygon), lambda r: (F.size(r) >= 4) & (F.size(kinks(r)) == 0))


# Boxes are struct<west, south, east, north>.


def box(west, south, east, north) -> Column:
    return F.struct(c(west).cast("double").alias("west"), c(south).cast("double").alias("south"), c(east).cast("double").alias("east"), c(north).cast("double").alias("north"))


def box_overlap(a, b) -> Column:
    a, b = c(a), c(b)
    return (a.west <= b.east) & (b.west <= a.east) & (a.south <= b.north) & (b.south <= a.north)


def box_contains(a, b) -> Column:
    a, b = c(a), c(b)
    return (a.west <= b.west) & (a.east >= b.east) & (a.south <= b.south) & (a.north >= b.north)


def box_within(a, b, eps: float = 1e-10) -> Column:
    """What ``ring_within`` says of the boxes' rings, from their sides: every corner of a is in b or on its edge, one of them strictly inside."""
    a, b = c(a), c(b)
    inside = lambda v, low, high: (v > low + eps) & (v < high - eps)
    corner = (inside(a.west, b.west, b.east) | inside(a.east, b.west, b.east)) & (inside(a.south, b.south, b.north) | inside(a.north, b.south, b.north))
    return (a.west >= b.west - eps) & (a.east <= b.east + eps) & (a.south >= b.south - eps) & (a.north <= b.north + eps) & corner


def box_has(b, x, y) -> Column:
    """Closed; NaN is nowhere."""
    b, x, y = c(b), c(x), c(y)
    return ~F.isnan(x) & ~F.isnan(y) & (x >= b.west) & (x <= b.east) & (y >= b.south) & (y <= b.north)


def box3(west, south, east, north, low, high) -> Column:
    """struct<west, south, east, north, low, high>."""
    return F.struct(*[c(v).cast("double").alias(n) for v, n in zip((west, south, east, north, low, high), ("west", "south", "east", "north", "low", "high"))])


def box_intersect(a, b) -> Column:
    a, b = c(a), c(b)
    return box(F.greatest(a.west, b.west), F.greatest(a.south, b.south), F.least(a.east, b.east), F.least(a.north, b.north))


def box_union(a, b) -> Column:
    a, b = c(a), c(b)
    return box(F.least(a.west, b.west), F.least(a.south, b.south), F.greatest(a.east, b.east), F.greatest(a.north, b.north))


def box_expand(b, amount) -> Column:
    b, d = c(b), c(amount)
    return box(b.west - d, b.south - d, b.east + d, b.north + d)


def box_margin(b, fraction) -> Column:
    b = c(b)
    dx, dy = (b.east - b.west) * c(fraction), (b.north - b.south) * c(fraction)
    return box(b.west - dx, b.south - dy, b.east + dx, b.north + dy)


def box_center(b) -> Column:
    b = c(b)
    return point((b.west + b.east) / 2, (b.south + b.north) / 2)


def box_empty(b) -> Column:
    b = c(b)
    return (b.west > b.east) | (b.south > b.north)


def box_area(b) -> Column:
    b = c(b)
    return F.when(box_empty(b), F.lit(0.0)).otherwise((b.east - b.west) * (b.north - b.south))


def box_iou(a, b) -> Column:
    """Area of the intersection over that of the union, 0 if neither has area."""
    i = box_area(box_intersect(a, b))
    return F.coalesce(div(i, box_area(a) + box_area(b) - i), F.lit(0.0))


def box_equals(a, b, eps: float = 1e-10) -> Column:
    a, b = c(a), c(b)
    return (F.abs(a.west - b.west) <= eps) & (F.abs(a.south - b.south) <= eps) & (F.abs(a.east - b.east) <= eps) & (F.abs(a.north - b.north) <= eps)


def circle_ring(lng, lat, metres, steps: int = 64) -> Column:
    """Buffer of a point: a ring of ``steps`` positions at a great-circle distance, closed."""
    metres = F.least(F.greatest(c(metres), F.lit(0.001)), F.lit(math.pi * G.MEAN_RADIUS))
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: point(*G.destination(lng, lat, (i % steps) * (360.0 / steps), metres)))
