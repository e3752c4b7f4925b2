"""Great circles, ellipsoid, local frames: native column expressions (degrees unless said)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraloom.functions.num import c, div, let

A, INV_F = 6378137.0, 298.257223563
FLAT = 1 / INV_F
B = A * (1 - FLAT)
E2 = FLAT * (2 - FLAT)
EP2 = E2 / (1 - E2)
MEAN_RADIUS = 6371008.8


def haversine(lng1, lat1, lng2, lat2, radius: float = A) -> Column:
    """Great-circle metres."""
    p1, p2 = F.radians(c(lat1)), F.radians(c(lat2))
    h = F.pow(F.sin((p2 - p1) / 2), F.lit(2)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(c(lng2) - c(lng1)) / 2), F.lit(2))
    return 2 * radius * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))  # not least(), which skips nulls


def initial_bearing(lng1, lat1, lng2, lat2) -> Column:
    """Compass degrees in [0, 360)."""
    p1, p2, d = F.radians(c(lat1)), F.radians(c(lat2)), F.radians(c(lng2) - c(lng1))
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d))) + 360, F.lit(360.0))


def final_bearing(lng1, lat1, lng2, lat2) -> Column:
    return F.pmod(initial_bearing(lng2, lat2, lng1, lat1) + 180, F.lit(360.0))


def midpoint(lng1, lat1, lng2, lat2) -> tuple[Column, Column]:
    """Great-circle midpoint; the longitude isn't wrapped."""
    p1, p2, d = F.radians(c(lat1)), F.radians(c(lat2)), F.radians(c(lng2) - c(lng1))
    bx, by = F.cos(p2) * F.cos(d), F.cos(p2) * F.sin(d)
    lat = F.atan2(F.sin(p1) + F.sin(p2), F.sqrt((F.cos(p1) + bx) * (F.cos(p1) + bx) + by * by))
    return c(lng1) + F.degrees(F.atan2(by, F.cos(p1) + bx)), F.degrees(lat)


def intermediate(lng1, lat1, lng2, lat2, fraction) -> tuple[Column, Column]:
    """Point at a fraction of the great circle; of equal points the first."""
    p1, l1, p2, l2 = (F.radians(c(v)) for v in (lat1, lng1, lat2, lng2))
    d = haversine(lng1, lat1, lng2, lat2, 1.0)
    a, b = div(F.sin((1 - c(fraction)) * d), F.sin(d)), div(F.sin(c(fraction) * d), F.sin(d))
    x = a * F.cos(p1) * F.cos(l1) + b * F.cos(p2) * F.cos(l2)
    y = a * F.cos(p1) * F.sin(l1) + b * F.cos(p2) * F.sin(l2)
    z = a * F.sin(p1) + b * F.sin(p2)
    return F.coalesce(F.degrees(F.atan2(y, x)), c(lng1)), F.coalesce(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), c(lat1))


def destination(lng, lat, bearing, metres, radius: float = A) -> tuple[Column, Column]:
    """Point reached along a great circle."""
    p, t, d = F.radians(c(lat)), F.radians(c(bearing)), c(metres) / radius
    lat2 = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(t))
    return c(lng) + F.degrees(F.atan2(F.sin(t) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(lat2))), F.degrees(lat2)


def ellipsoid_distance(lng1, lat1, lng2, lat2, rounds: int = 12) -> Column:
    """Metres on the ellipsoid by the inverse iteration on the auxiliary sphere.

    Equal points give 0; pairs near the antipode, where the iteration doesn't
    settle in ``rounds`` steps, give null.
    """
    reduced = lambda lat: F.atan((1 - FLAT) * F.tan(F.radians(c(lat))))
    u = F.struct(F.sin(reduced(lat1)).alias("s1"), F.cos(reduced(lat1)).alias("c1"), F.sin(reduced(lat2)).alias("s2"), F.cos(reduced(lat2)).alias("c2"), F.radians(c(lng2) - c(lng1)).alias("big"))

    def on_sphere(u, lam, then):
        """``then`` of sine and cosine of the arc, sine of the azimuth, its squared cosine, and that of twice the midpoint."""
        x, y = u["c2"] * F.sin(lam), u["c1"] * u["s2"] - u["s1"] * u["c2"] * F.cos(lam)
        arc = F.struct(F.hypot(x, y).alias("ss"), (u["s1"] * u["s2"] + u["c1"] * u["c2"] * F.cos(lam)).alias("cs"))

        def azimuth(p):
            sa = F.coalesce(div(u["c1"] * u["c2"] * F.sin(lam), p["ss"]), F.lit(0.0))
            return F.struct(p["ss"].alias("ss"), p["cs"].alias("cs"), sa.alias("sa"), (1 - sa * sa).alias("ca2"))

        def middle(q):
            return F.struct(q["ss"].alias("ss"), q["cs"].alias("cs"), q["sa"].alias("sa"), q["ca2"].alias("ca2"), F.coalesce(q["cs"] - div(2 * u["s1"] * u["s2"], q["ca2"]), F.lit(0.0)).alias("cm"))

        return let(let(let(arc, azimuth), middle), then)

    def solve(u):
        def step(s, _):
            def better(q):
                k = FLAT / 16 * q["ca2"] * (4 + FLAT * (4 - 3 * q["ca2"]))
                turn = F.atan2(q["ss"], q["cs"]) + k * q["ss"] * (q["cm"] + k * q["cs"] * (2 * q["cm"] * q["cm"] - 1))
                return F.struct((u["big"] + (1 - k) * FLAT * q["sa"] * turn).alias("lam"), s["lam"].alias("was"))

            return on_sphere(u, s["lam"], better)

        def metres(out):
            def length(q):
                v = q["ca2"] * EP2
                aa = 1 + v / 16384 * (4096 + v * (-768 + v * (320 - 175 * v)))
                bb = v / 1024 * (256 + v * (-128 + v * (74 - 47 * v)))
                cm2 = q["cm"] * q["cm"]
                ds = bb * q["ss"] * (q["cm"] + bb / 4 * (q["cs"] * (2 * cm2 - 1) - bb / 6 * q["cm"] * (4 * q["ss"] * q["ss"] - 3) * (4 * cm2 - 3)))
                return F.when(q["ss"] < 1e-15, F.lit(0.0)).when(F.abs(out["lam"] - out["was"]) < 1e-9, B * aa * (F.atan2(q["ss"], q["cs"]) - ds))

            return on_sphere(u, out["lam"], length)

        return let(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(u["big"].alias("lam"), F.lit(99.0).alias("was")), step), metres)

    return let(u, solve)


def ellipsoid_destination(lng, lat, bearing, metres, rounds: int = 8) -> tuple[Column, Column, Column]:
    """(lng, lat, final bearing) after ``metres`` along a geodesic of the ellipsoid, by the direct iteration on the auxiliary sphere."""
    t = F.radians(c(bearing))
    u = F.atan((1 - FLAT) * F.tan(F.radians(c(lat))))
    start = F.struct(F.sin(u).alias("su"), F.cos(u).alias("cu"), F.atan2(F.tan(u), F.cos(t)).alias("s1"), (F.cos(u) * F.sin(t)).alias("sa"), F.sin(t).alias("st"), F.cos(t).alias("ct"))

    def solve(q):
        ca2 = 1 - q["sa"] * q["sa"]
        v = ca2 * EP2
        aa = 1 + v / 16384 * (4096 + v * (-768 + v * (320 - 175 * v)))
        bb = v / 1024 * (256 + v * (-128 + v * (74 - 47 * v)))
        base = c(metres) / (B * aa)

        def step(s, _):
            cm, ss, cs = F.cos(2 * q["s1"] + s), F.sin(s), F.cos(s)
            return base + bb * ss * (cm + bb / 4 * (cs * (2 * cm * cm - 1) - bb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))

        def end(s):
            ss, cs, cm = F.sin(s), F.cos(s), F.cos(2 * q["s1"] + s)
            x = q["su"] * ss - q["cu"] * cs * q["ct"]
            lat2 = F.atan2(q["su"] * cs + q["cu"] * ss * q["ct"], (1 - FLAT) * F.hypot(q["sa"], x))
            lam = F.atan2(ss * q["st"], q["cu"] * cs - q["su"] * ss * q["ct"])
            k = FLAT / 16 * ca2 * (4 + FLAT * (4 - 3 * ca2))
            turn = lam - (1 - k) * FLAT * q["sa"] * (s + k * ss * (cm + k * cs * (2 * cm * cm - 1)))
            return F.struct(F.degrees(turn).alias("d"), F.degrees(lat2).alias("lat"), F.pmod(F.degrees(F.atan2(q["sa"], -x)) + 360, F.lit(360.0)).alias("final"))

        return let(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), base, step), end)

    out = let(start, solve)
    return c(lng) + out["d"], out["lat"], out["final"]


def geodesic_length(lng, lat, bearing, metres, leg: float = 1.2e7) -> Column:
    """``metres`` along a geodesic of the ellipsoid, measured again from its positions by the inverse iteration.

    That iteration knows shortest ways only and doesn't settle near the
    antipode.  So whole turns count by their length on this geodesic, and the
    rest is measured in parts of ``leg`` metres at most.
    """
    t, u = F.radians(c(bearing)), F.atan((1 - FLAT) * F.tan(F.radians(c(lat))))

    def measured(q):
        at = lambda k: ellipsoid_destination(lng, lat, bearing, q["start"] + q["rest"] * (c(k) / q["n"]))[:2]
        parts = F.transform(F.sequence(F.lit(0), q["n"].cast("int")), lambda k: F.struct(*[v.alias(n) for v, n in zip(at(k), ("x", "y"))]))

        def total(p):
            ways = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: ellipsoid_distance(a["x"], a["y"], b["x"], b["y"]))
            return F.aggregate(ways, q["start"], lambda s, w: s + w)

        return let(parts, total)

    def split(turn):
        start = F.floor(c(metres) / turn) * turn
        return F.struct(start.alias("start"), (c(metres) - start).alias("rest"), F.greatest(F.lit(1), F.ceil((c(metres) - start) / leg)).alias("n"))

    v = EP2 * (1 - F.cos(u) * F.sin(t) * F.cos(u) * F.sin(t))
    turn = 2 * math.pi * B * (1 + v / 16384 * (4096 + v * (-768 + v * (320 - 175 * v))))
    return let(let(turn, split), measured)


def closest_on_ellipsoid(x, y, z) -> tuple[Column, Column, Column, Column]:
    """(x, y, z) of the foot point on the ellipsoid, and the height above it (below: negative)."""
    lng, lat, h = from_ecef(x, y, z, 8)
    return (*to_ecef(lng, lat, F.lit(0.0)), h)


def rtc_offset(x, y, z, x0, y0, z0) -> tuple[Column, Column, Column]:
    """Position relative to a centre, in single precision."""
    return tuple((c(v) - c(o)).cast("float") for v, o in ((x, x0), (y, y0), (z, z0)))


def to_ecef(lng, lat, h) -> tuple[Column, Column, Column]:
    p, lam = F.radians(c(lat)), F.radians(c(lng))
    n = A / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
    return (n + c(h)) * F.cos(p) * F.cos(lam), (n + c(h)) * F.cos(p) * F.sin(lam), (n * (1 - E2) + c(h)) * F.sin(p)


def from_ecef(x, y, z, rounds: int = 5) -> tuple[Column, Column, Column]:
    """(lng, lat, height) by a fixed number of latitude iterations."""
    p = F.sqrt(c(x) * c(x) + c(y) * c(y))
    radius = lambda lat: A / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    step = lambda lat, _: F.atan2(c(z) + E2 * radius(lat) * F.sin(lat), p)
    lat = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.atan2(c(z), p * (1 - E2)), step)
    h = F.when(p > 1.0, p / F.cos(lat) - radius(lat)).otherwise(F.abs(c(z)) - B)
    return F.degrees(F.atan2(c(y), c(x))), F.degrees(lat), h


def surface_normal(lng, lat) -> tuple[Column, Column, Column]:
    p, lam = F.radians(c(lat)), F.radians(c(lng))
    return F.cos(p) * F.cos(lam), F.cos(p) * F.sin(lam), F.sin(p)


def ecef_to_enu(x, y, z, lng0, lat0, h0) -> tuple[Column, Column, Column]:
    """East, north, up from a reference point."""
    x0, y0, z0 = to_ecef(lng0, lat0, h0)
    dx, dy, dz = c(x) - x0, c(y) - y0, c(z) - z0
    p, lam = F.radians(c(lat0)), F.radians(c(lng0))
    sp, cp, sl, cl = F.sin(p), F.cos(p), F.sin(lam), F.cos(lam)
    return -sl * dx + cl * dy, -sp * cl * dx - sp * sl * dy + cp * dz, cp * cl * dx + cp * sl * dy + sp * dz


def enu_to_ecef(e, n, u, lng0, lat0, h0) -> tuple[Column, Column, Column]:
    x0, y0, z0 = to_ecef(lng0, lat0, h0)
    p, lam = F.radians(c(lat0)), F.radians(c(lng0))
    sp, cp, sl, cl = F.sin(p), F.cos(p), F.sin(lam), F.cos(lam)
    e, n, u = c(e), c(n), c(u)
    return x0 - sl * e - sp * cl * n + cp * cl * u, y0 + cl * e - sp * sl * n + cp * sl * u, z0 + cp * n + sp * u


def geodetic_to_enu(lng, lat, h, lng0, lat0, h0) -> tuple[Column, Column, Column]:
    return ecef_to_enu(*to_ecef(lng, lat, h), lng0, lat0, h0)


def format_distance(metres) -> Column:
    m = c(metres)
    return F.when(m < 1000, F.concat(F.format_number(m, 1), F.lit(" m"))).otherwise(F.concat(F.format_number(m / 1000, 2), F.lit(" km")))


def format_area(square_metres, most_ha: float = 100.0) -> Column:
    """Square metres, hectares, and from ``most_ha`` hectares on square kilometres."""
    a = c(square_metres)
    return F.when(a < 1e4, F.concat(F.format_number(a, 1), F.lit(" m²"))).when(a < most_ha * 1e4, F.concat(F.format_number(a / 1e4, 2), F.lit(" ha"))).otherwise(F.concat(F.format_number(a / 1e6, 2), F.lit(" km²")))
