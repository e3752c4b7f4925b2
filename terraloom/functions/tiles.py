"""Web Mercator, tiles, tile keys, Hilbert order: native column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraloom.functions.num import c, clamp

RADIUS, MAX_LAT, TILE = 6378137.0, 85.05112877980659, 512
HALF = math.pi * RADIUS


def clamp_lat(lat) -> Column:
    return clamp(lat, -MAX_LAT, MAX_LAT)


def to_mercator(lng, lat) -> tuple[Column, Column]:
    """EPSG:3857 metres."""
    return F.radians(c(lng)) * RADIUS, F.log(F.tan(math.pi / 4 + F.radians(clamp_lat(lat)) / 2)) * RADIUS


def from_mercator(x, y) -> tuple[Column, Column]:
    return F.degrees(c(x) / RADIUS), F.degrees(2 * F.atan(F.exp(c(y) / RADIUS)) - math.pi / 2)


def tile_count(z) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), c(z).cast("int"))


def _unit(lng, lat) -> tuple[Column, Column]:
    rad = F.radians(clamp_lat(lat))
    return (c(lng) + 180) / 360, (1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2


def tile_of(lng, lat, z, clamp_low: bool = False) -> tuple[Column, Column]:
    """Slippy tile (x, y); only the upper side is clamped unless ``clamp_low``."""
    n = tile_count(z)
    x, y = (F.least(F.floor(u * n), n - 1) for u in _unit(lng, lat))
    return (F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0))) if clamp_low else (x, y)


def _tile_lat(y, n) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * c(y) / n))))


def tile_bounds(z, x, y) -> tuple[Column, Column, Column, Column]:
    """(west, south, east, north) in degrees."""
    n = tile_count(z)
    return c(x) / n * 360 - 180, _tile_lat(c(y) + 1, n), (c(x) + 1) / n * 360 - 180, _tile_lat(y, n)


def geographic_tile_bounds(z, x, y) -> tuple[Column, Column, Column, Column]:
    """Bounds in the scheme of 2 x 1 tiles of equal degrees at level 0."""
    size = F.lit(180.0) / tile_count(z)
    return c(x) * size - 180, 90 - (c(y) + 1) * size, (c(x) + 1) * size - 180, 90 - c(y) * size


def tile_center(z, x, y) -> tuple[Column, Column]:
    w, s, e, n = tile_bounds(z, x, y)
    return (w + e) / 2, (s + n) / 2


def touches_pole(z, y) -> Column:
    return F.when(c(y) == 0, "north").when(c(y) == tile_count(z) - 1, "south")


def ground_resolution(lat, z) -> Column:
    """Metres in a pixel of 512-pixel tiles."""
    return F.cos(F.radians(clamp_lat(lat))) * (2 * HALF) / (TILE * tile_count(z))


def to_pixel(lng, lat, z) -> tuple[Column, Column]:
    return tuple(u * TILE * tile_count(z) for u in _unit(lng, lat))


def from_pixel(px, py, z) -> tuple[Column, Column]:
    size = TILE * tile_count(z)
    return c(px) / size * 360 - 180, _tile_lat(c(py), size)


def tile_key(scheme, z, x, y) -> Column:
    """A long with fields that don't overlap: 2 bits scheme, 5 bits level, 28 bits each for x and y."""
    return ((c(scheme).cast("long") * 32 + c(z)) * (1 << 28) + c(x)) * (1 << 28) + c(y)


def decode_tile_key(key) -> tuple[Column, Column, Column, Column]:
    k = c(key)
    top = F.shiftrightunsigned(k, 56)
    low = F.lit((1 << 28) - 1)
    return F.shiftrightunsigned(top, 5), top.bitwiseAND(F.lit(31)), F.shiftrightunsigned(k, 28).bitwiseAND(low), k.bitwiseAND(low)


def tile_key_string(scheme, z, x, y) -> Column:
    return F.concat_ws("", c(scheme).cast("string"), F.lit(":"), c(z).cast("string"), F.lit("/"), c(x).cast("string"), F.lit("/"), c(y).cast("string"))


def tile_url(template: str, z, x, y, subdomains: str = "abc") -> Column:
    """{z} {x} {y} {s} replaced in a URL template."""
    out = F.lit(template)
    for name, value in (("z", z), ("x", x), ("y", y)):
        out = F.replace(out, F.lit("{" + name + "}"), c(value).cast("string"))
    at = F.pmod(c(x) + c(y), F.lit(len(subdomains))).cast("int") + 1
    return F.replace(out, F.lit("{s}"), F.substring(F.lit(subdomains), at, F.lit(1)))


def normalize_tile_x(x, z) -> Column:
    return F.pmod(c(x), tile_count(z))


def normalize_lng(lng) -> Column:
    """[-180, 180)."""
    return F.pmod(c(lng) + 180, F.lit(360.0)) - 180


def wrap_lng(lng) -> Column:
    """[-180, 180]; both ends stay."""
    return F.when((c(lng) >= -180) & (c(lng) <= 180), c(lng)).otherwise(normalize_lng(lng))


def hilbert_index(x, y, order: int) -> Column:
    """Place of (x, y) on the Hilbert curve of ``order`` levels."""
    start = F.struct(c(x).cast("long").alias("x"), c(y).cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(s, i):
        side = F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))
        rx, ry = (s.x.bitwiseAND(side) != 0).cast("long"), (s.y.bitwiseAND(side) != 0).cast("long")
        low = side - 1
        x, y = s.x.bitwiseAND(low), s.y.bitwiseAND(low)
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, low - x).otherwise(x), F.when(flip, low - y).otherwise(y)
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), (s.d + side * side * (rx * 3).bitwiseXOR(ry)).alias("d"))

    return F.aggregate(F.sequence(F.lit(order - 1), F.lit(0)), start, step).d


def tile_id(z: int, x, y) -> Column:
    """Number of a tile in an archive: all tiles of the levels above, then Hilbert order."""
    return F.lit((4**z - 1) // 3) + (hilbert_index(x, y, z) if z else F.lit(0))


def covering_tiles(west, south, east, north, z) -> Column:
    """Array of (z, x, y) tiles that meet a box of degrees."""
    x0, y0 = tile_of(west, north, z, True)
    x1, y1 = tile_of(east, south, z, True)
    return F.flatten(F.transform(F.sequence(x0, x1), lambda x: F.transform(F.sequence(y0, y1), lambda y: F.struct(c(z).cast("int").alias("z"), x.alias("x"), y.alias("y")))))


def world_copies(lng, copies: int = 1) -> Column:
    """The longitude in each of 2 * copies + 1 worlds."""
    return F.array(*[c(lng) + 360.0 * k for k in range(-copies, copies + 1)])
