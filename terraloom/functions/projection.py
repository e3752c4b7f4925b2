"""Map projections and datum shifts as native column expressions (degrees and metres)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraloom.functions import geodesy as G
from terraloom.functions.num import c, div
from terraloom.functions.tiles import from_mercator, to_mercator

K0 = 0.9996
N = G.FLAT / (2 - G.FLAT)
RECT = G.A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
# Krueger's series, third order in n.
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)


def spherical_y(lat) -> Column:
    """Mercator y of the unit sphere (radians)."""
    return F.asinh(F.tan(F.radians(c(lat))))


def from_spherical_y(y) -> Column:
    return F.degrees(F.atan(F.sinh(c(y))))


def ellipsoidal_y(lat) -> Column:
    """Mercator y of the ellipsoid, in units of its half axis."""
    e, s = math.sqrt(G.E2), F.sin(F.radians(c(lat)))
    return F.atanh(s) - e * F.atanh(e * s)


def from_ellipsoidal_y(y, rounds: int = 8) -> Column:
    e = math.sqrt(G.E2)
    step = lambda s, _: F.tanh(c(y) + e * F.atanh(e * s))
    return F.degrees(F.asin(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.tanh(c(y)), step)))


def spherical_to_ellipsoidal_lat(lat) -> Column:
    """Latitude on the ellipsoid with the same Mercator y."""
    return from_ellipsoidal_y(spherical_y(lat))


def ellipsoidal_to_spherical_lat(lat) -> Column:
    return from_spherical_y(ellipsoidal_y(lat))


def utm_zone(lng) -> Column:
    return (F.floor((c(lng) + 180) / 6) + 1).cast("int")


def to_utm(lng, lat, zone=None) -> tuple[Column, Column, Column, Column]:
    """(easting, northing, zone, is north)."""
    zone = utm_zone(lng) if zone is None else c(zone)
    p, lam = F.radians(c(lat)), F.radians(c(lng) - (zone * 6 - 183))
    k = 2 * math.sqrt(N) / (1 + N)
    t = F.sinh(F.atanh(F.sin(p)) - k * F.atanh(k * F.sin(p)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    up = c(lat) >= 0
    return 500_000 + K0 * RECT * east, F.when(up, F.lit(0.0)).otherwise(1e7) + K0 * RECT * north, zone, up


def from_utm(east, north, zone, is_north) -> tuple[Column, Column]:
    """(lng, lat)."""
    xi = (c(north) - F.when(c(is_north), F.lit(0.0)).otherwise(1e7)) / (K0 * RECT)
    eta = (c(east) - 500_000) / (K0 * RECT)
    x, e = xi, eta
    for j, b in enumerate(BETA, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        e = e - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(e))
    lat = chi
    for j, d in enumerate(DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return c(zone) * 6 - 183 + F.degrees(F.atan2(F.sinh(e), F.cos(x))), F.degrees(lat)


def equirectangular(lng, lat, lat0: float = 0.0, radius: float = G.A) -> tuple[Column, Column]:
    return F.radians(c(lng)) * radius * math.cos(math.radians(lat0)), F.radians(c(lat)) * radius


def from_equirectangular(x, y, lat0: float = 0.0, radius: float = G.A) -> tuple[Column, Column]:
    return F.degrees(c(x) / (radius * math.cos(math.radians(lat0)))), F.degrees(c(y) / radius)


E = math.sqrt(G.E2)
QP = 1 - (1 - G.E2) / (2 * E) * math.log((1 - E) / (1 + E))
RQ = G.A * math.sqrt(QP / 2)


def _authalic(p) -> Column:
    s = F.sin(p)
    q = (1 - G.E2) * (s / (1 - G.E2 * s * s) - F.log((1 - E * s) / (1 + E * s)) / (2 * E))
    return F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), q / QP)))


def laea(lng, lat, lng0: float = 0.0, lat0: float = 0.0) -> tuple[Column, Column]:
    """Lambert azimuthal equal-area through authalic latitudes; the antipode goes to (2 Rq, 0)."""
    b, b0, d = _authalic(F.radians(c(lat))), _authalic(F.radians(F.lit(float(lat0)))), F.radians(c(lng) - lng0)
    k = 1 + F.sin(b0) * F.sin(b) + F.cos(b0) * F.cos(b) * F.cos(d)
    s = F.sqrt(F.try_divide(F.lit(2.0), F.when(k > 1e-12, k)))
    x, y = RQ * s * F.cos(b) * F.sin(d), RQ * s * (F.cos(b0) * F.sin(b) - F.sin(b0) * F.cos(b) * F.cos(d))
    return F.coalesce(x, F.lit(2 * RQ)), F.coalesce(y, F.lit(0.0))


def from_laea(x, y, lng0: float = 0.0, lat0: float = 0.0) -> tuple[Column, Column]:
    b0 = _authalic(F.radians(F.lit(float(lat0))))
    rho = F.sqrt(c(x) * c(x) + c(y) * c(y))
    ang = 2 * F.asin(F.least(F.lit(1.0), rho / (2 * RQ)))
    beta = F.asin(F.cos(ang) * F.sin(b0) + F.coalesce(div(c(y) * F.sin(ang) * F.cos(b0), rho), F.lit(0.0)))
    lng = lng0 + F.degrees(F.atan2(c(x) * F.sin(ang), rho * F.cos(b0) * F.cos(ang) - c(y) * F.sin(b0) * F.sin(ang)))
    e4, e6 = G.E2**2, G.E2**3
    lat = beta + (G.E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + 761 * e6 / 45360 * F.sin(6 * beta)
    return F.pmod(lng + 180, F.lit(360.0)) - 180, F.degrees(lat)


# Fixed values of the GCJ-02 and BD-09 systems.
GCJ_A, GCJ_E2, BD = 6378245.0, 0.00669342162296594323, math.pi * 3000.0 / 180.0
GCJ_WEST, GCJ_SOUTH, GCJ_EAST, GCJ_NORTH = 72.004, 0.8293, 137.8347, 55.8271


def _gcj_shift(lng, lat) -> tuple[Column, Column]:
    x, y = c(lng) - 105, c(lat) - 35
    pi = math.pi
    wave = (20 * F.sin(6 * x * pi) + 20 * F.sin(2 * x * pi)) * 2 / 3
    dlat = -100 + 2 * x + 3 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * F.sqrt(F.abs(x)) + wave + (20 * F.sin(y * pi) + 40 * F.sin(y / 3 * pi)) * 2 / 3 + (160 * F.sin(y / 12 * pi) + 320 * F.sin(y * pi / 30)) * 2 / 3
    dlng = 300 + x + 2 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * F.sqrt(F.abs(x)) + wave + (20 * F.sin(x * pi) + 40 * F.sin(x / 3 * pi)) * 2 / 3 + (150 * F.sin(x / 12 * pi) + 300 * F.sin(x / 30 * pi)) * 2 / 3
    rad = F.radians(c(lat))
    magic = 1 - GCJ_E2 * F.sin(rad) * F.sin(rad)
    dlat = dlat * 180 / (GCJ_A * (1 - GCJ_E2) / (magic * F.sqrt(magic)) * pi)
    return dlng * 180 / (GCJ_A / F.sqrt(magic) * F.cos(rad) * pi), dlat


def to_gcj02(lng, lat) -> tuple[Column, Column]:
    """WGS84 to GCJ-02; outside the box of the system nothing changes."""
    inside = c(lng).between(GCJ_WEST, GCJ_EAST) & c(lat).between(GCJ_SOUTH, GCJ_NORTH)
    dx, dy = _gcj_shift(lng, lat)
    return F.when(inside, c(lng) + dx).otherwise(c(lng)), F.when(inside, c(lat) + dy).otherwise(c(lat))


def from_gcj02(lng, lat, rounds: int = 5) -> tuple[Column, Column]:
    """The inverse by a fixed number of rounds, each taking off what the forward shift misses."""

    def step(s, _):
        gx, gy = to_gcj02(s.x, s.y)
        return F.struct((s.x - (gx - c(lng))).alias("x"), (s.y - (gy - c(lat))).alias("y"))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(c(lng).alias("x"), c(lat).alias("y")), step)
    return out.x, out.y


def gcj_to_bd09(lng, lat) -> tuple[Column, Column]:
    z = F.sqrt(c(lng) * c(lng) + c(lat) * c(lat)) + 0.00002 * F.sin(c(lat) * BD)
    t = F.atan2(c(lat), c(lng)) + 0.000003 * F.cos(c(lng) * BD)
    return z * F.cos(t) + 0.0065, z * F.sin(t) + 0.006


def bd09_to_gcj(lng, lat) -> tuple[Column, Column]:
    x, y = c(lng) - 0.0065, c(lat) - 0.006
    z = F.sqrt(x * x + y * y) - 0.00002 * F.sin(y * BD)
    t = F.atan2(y, x) - 0.000003 * F.cos(x * BD)
    return z * F.cos(t), z * F.sin(t)


def _rotation(rx: float, ry: float, rz: float) -> list[list[float]]:
    """Full rotation matrix for angles in seconds of arc (position vector convention)."""
    a, b, g = (math.radians(r / 3600) for r in (rx, ry, rz))
    ca, sa, cb, sb, cg, sg = math.cos(a), math.sin(a), math.cos(b), math.sin(b), math.cos(g), math.sin(g)
    return [[cb * cg, sa * sb * cg - ca * sg, ca * sb * cg + sa * sg], [cb * sg, sa * sb * sg + ca * cg, ca * sb * sg - sa * cg], [-sb, sa * cb, ca * cb]]


def helmert(x, y, z, tx=0.0, ty=0.0, tz=0.0, rx=0.0, ry=0.0, rz=0.0, ppm=0.0, inverse: bool = False, coordinate_frame: bool = False) -> tuple[Column, Column, Column]:
    """Seven-parameter shift of geocentric coordinates; the inverse is exact."""
    sign = -1 if coordinate_frame else 1
    m = _rotation(sign * rx, sign * ry, sign * rz)
    k = 1 + ppm * 1e-6
    v = [c(x), c(y), c(z)]
    if inverse:
        v = [(a - t) / k for a, t in zip(v, (tx, ty, tz))]
        return tuple(m[0][i] * v[0] + m[1][i] * v[1] + m[2][i] * v[2] for i in range(3))
    return tuple(t + k * (m[i][0] * v[0] + m[i][1] * v[1] + m[i][2] * v[2]) for i, t in enumerate((tx, ty, tz)))


class Registry:
    """Coordinate systems by name with pairwise transforms; others go through EPSG:4326.

    A transform is any function from two columns to two columns, so a user's own
    one is compiled into the plan like the built-in ones.
    """

    def __init__(self):
        self.systems: dict[str, dict] = {}
        self.transforms: dict[tuple[str, str], object] = {}
        for name in ("EPSG:4326", "EPSG:3857", "GCJ-02", "BD-09"):
            self.register(name)
        self.register_transform("EPSG:4326", "EPSG:3857", to_mercator)
        self.register_transform("EPSG:3857", "EPSG:4326", from_mercator)
        self.register_transform("EPSG:4326", "GCJ-02", to_gcj02)
        self.register_transform("GCJ-02", "EPSG:4326", from_gcj02)
        self.register_transform("GCJ-02", "BD-09", gcj_to_bd09)
        self.register_transform("BD-09", "GCJ-02", bd09_to_gcj)

    def register(self, name: str, **facts) -> None:
        self.systems[name] = facts

    def register_transform(self, source: str, target: str, how) -> None:
        self.transforms[source, target] = how

    def transform(self, source: str, target: str, x, y) -> tuple[Column, Column]:
        if source == target:
            return c(x), c(y)
        if (source, target) in self.transforms:
            return self.transforms[source, target](x, y)
        hub = "EPSG:4326"
        if hub not in (source, target) and (source, hub) in self.transforms and (hub, target) in self.transforms:
            return self.transforms[hub, target](*self.transforms[source, hub](x, y))
        raise ValueError(f"no transform from {source} to {target}")
