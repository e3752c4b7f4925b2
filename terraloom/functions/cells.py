"""Geohash and S2 cells as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraloom.functions.num import c, clamp, let

#: Fixed alphabet of geohash.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def _shift(i) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def geohash(lng, lat, precision: int) -> Column:
    """Base-32 cell of ``precision`` (1 to 12) letters; NaN gives an empty string."""
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((clamp(lng, -180.0, 180.0) + 180) / 360 * float(2**nx)), F.lit(2**nx - 1))
    y = F.least(F.floor((clamp(lat, -90.0, 90.0) + 90) / 180 * float(2**ny)), F.lit(2**ny - 1))

    def letter(k):
        """Five bits from the top, longitude and latitude in turn."""
        value = F.lit(0).cast("long")
        for b in range(5):
            at = k * 5 + b
            own = F.when(at % 2 == 0, F.call_function("shiftright", x, (F.lit(nx - 1) - F.floor(at / 2)).cast("int"))).otherwise(F.call_function("shiftright", y, (F.lit(ny - 1) - F.floor(at / 2)).cast("int")))
            value = value * 2 + own.bitwiseAND(F.lit(1))
        return F.substring(F.lit(ALPHABET), (value + 1).cast("int"), F.lit(1))

    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(precision - 1)), letter), "")
    return F.when(F.isnan(c(lng)) | F.isnan(c(lat)), F.lit("")).otherwise(text)


def geohash_bounds(hash_) -> Column:
    """struct<west, south, east, north>, null for letters outside the alphabet."""
    letters = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c(hash_)), F.lit(1))), lambda i: F.position(F.substring(c(hash_), i, F.lit(1)), F.lit(ALPHABET)) - 1)
    bits = F.flatten(F.transform(letters, lambda v: F.array(*[F.call_function("shiftright", v.cast("long"), F.lit(b)).bitwiseAND(F.lit(1)) for b in (4, 3, 2, 1, 0)])))

    def half(parity, low, high):
        own = F.filter(bits, lambda _, i: i % 2 == parity)
        start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))
        return F.aggregate(own, start, lambda s, b: F.struct(F.when(b == 1, (s.lo + s.hi) / 2).otherwise(s.lo).alias("lo"), F.when(b == 1, s.hi).otherwise((s.lo + s.hi) / 2).alias("hi")))

    lng, lat = half(0, -180.0, 180.0), half(1, -90.0, 90.0)
    ok = (F.length(c(hash_)) > 0) & F.forall(letters, lambda v: v >= 0)
    return F.when(ok, F.struct(lng.lo.alias("west"), lat.lo.alias("south"), lng.hi.alias("east"), lat.hi.alias("north")))


def geohash_center(hash_) -> tuple[Column, Column]:
    b = geohash_bounds(hash_)
    return (b.west + b.east) / 2, (b.south + b.north) / 2


def geohash_neighbor(hash_, dx: int, dy: int, precision: int) -> Column:
    """The cell dx to the east and dy to the north; empty past a pole."""

    def move(b):
        lng, lat = (b["west"] + b["east"]) / 2 + dx * (b["east"] - b["west"]), (b["south"] + b["north"]) / 2 + dy * (b["north"] - b["south"])
        place = F.struct((F.pmod(lng + 180, F.lit(360.0)) - 180).alias("lng"), lat.alias("lat"))
        return let(place, lambda p: F.when(F.abs(p["lat"]) > 90, F.lit("")).otherwise(geohash(p["lng"], p["lat"], precision)))

    return let(geohash_bounds(hash_), move)


def s2_face_ij(lng, lat, level: int = 30) -> Column:
    """struct<face, i, j> of the published quadratic cube projection."""
    p, lam = F.radians(c(lat)), F.radians(c(lng))
    xyz = F.struct((F.cos(p) * F.cos(lam)).alias("x"), (F.cos(p) * F.sin(lam)).alias("y"), F.sin(p).alias("z"))
    side = 1 << level

    def face_uv(s):
        x, y, z = s["x"], s["y"], s["z"]
        axis = F.when((F.abs(x) >= F.abs(y)) & (F.abs(x) >= F.abs(z)), 0).when(F.abs(y) >= F.abs(z), 1).otherwise(2)

        def project(f):
            u = F.when(f == 0, y / x).when(f == 1, -x / y).when(f == 2, -x / z).when(f == 3, z / x).when(f == 4, z / y).otherwise(-y / z)
            v = F.when(f == 0, z / x).when(f == 1, z / y).when(f == 2, -y / z).when(f == 3, y / x).when(f == 4, -x / y).otherwise(-x / z)
            return F.struct(f.alias("face"), u.alias("u"), v.alias("v"))

        lead = F.when(axis == 0, x).when(axis == 1, y).otherwise(z)
        return let(axis + F.when(lead < 0, 3).otherwise(0), project)

    def cell(s):
        st = lambda a: F.when(a >= 0, 0.5 * F.sqrt(1 + 3 * F.abs(a))).otherwise(1 - 0.5 * F.sqrt(1 + 3 * F.abs(a)))
        i, j = (F.greatest(F.lit(0), F.least(F.lit(side - 1), F.floor(st(s[n]) * float(side)))) for n in "uv")
        return F.struct(s["face"].alias("face"), i.alias("i"), j.alias("j"))

    return let(let(xyz, face_uv), cell)


def s2_token_parts(lng, lat, level: int) -> Column:
    """Readable cell name: face/digits, one base-4 digit of the Hilbert curve a level."""

    def name(f):
        # turn: 1 swaps the axes, 2 inverts them; the digits of the published table follow from both
        start = F.struct(F.lit("").alias("text"), (f["face"] % 2).cast("int").alias("turn"))

        def step(s, k):
            a, b = (F.call_function("shiftright", f[n], k.cast("int")).bitwiseAND(F.lit(1)).cast("int") for n in "ij")
            inv, swap = F.call_function("shiftright", s["turn"], F.lit(1)), s["turn"].bitwiseAND(F.lit(1)) == 1

            def digit(q):
                d = F.when(q["p"] == 0, q["q"]).otherwise(3 - q["q"])
                change = F.when(d == 0, 1).when(d == 3, 3).otherwise(0)
                return F.struct(F.concat(s["text"], d.cast("string")).alias("text"), s["turn"].bitwiseXOR(change).cast("int").alias("turn"))

            return let(F.struct(F.when(swap, b).otherwise(a).bitwiseXOR(inv).alias("p"), F.when(swap, a).otherwise(b).bitwiseXOR(inv).alias("q")), digit)

        digits = F.aggregate(F.sequence(F.lit(level - 1), F.lit(0)), start, step)["text"] if level else F.lit("")
        return F.concat(f["face"].cast("string"), F.lit("/"), digits)

    return let(s2_face_ij(lng, lat, level), name)


def s2_parent(token) -> Column:
    return F.expr(f"substring({token}, 1, length({token}) - 1)") if isinstance(token, str) else F.substring(token, 1, F.length(token) - 1)


def s2_level(token) -> Column:
    return F.length(c(token)) - 2


def s2_children(token) -> Column:
    return F.array(*[F.concat(c(token), F.lit(str(d))) for d in range(4)])


# The published 64-bit form: three bits of face, two a level, a one, zeros.


def s2_cell(lng, lat, level: int = 30) -> Column:
    """Cell id as a long (ids of the faces 4 and 5 are negative)."""

    def number(f):
        start = F.struct(F.lit(0).cast("long").alias("pos"), (f["face"] % 2).cast("int").alias("turn"))

        def step(s, k):
            a, b = (F.call_function("shiftright", f[n], k.cast("int")).bitwiseAND(F.lit(1)).cast("int") for n in "ij")
            inv, swap = F.call_function("shiftright", s["turn"], F.lit(1)), s["turn"].bitwiseAND(F.lit(1)) == 1

            def digit(q):
                d = F.when(q["p"] == 0, q["q"]).otherwise(3 - q["q"])
                change = F.when(d == 0, 1).when(d == 3, 3).otherwise(0)
                return F.struct((s["pos"] * 4 + d).alias("pos"), s["turn"].bitwiseXOR(change).cast("int").alias("turn"))

            return let(F.struct(F.when(swap, b).otherwise(a).bitwiseXOR(inv).alias("p"), F.when(swap, a).otherwise(b).bitwiseXOR(inv).alias("q")), digit)

        pos = F.aggregate(F.sequence(F.lit(level - 1), F.lit(0)), start, step)["pos"] if level else F.lit(0).cast("long")
        face = F.shiftleft(f["face"].cast("long"), 61)
        return face.bitwiseOR(F.shiftleft(pos, 61 - 2 * level)).bitwiseOR(F.lit(1 << 60 - 2 * level))

    return let(s2_face_ij(lng, lat, level), number)


def _lowest(cell) -> Column:
    return c(cell).bitwiseAND(F.negate(c(cell)))


def s2_cell_level(cell) -> Column:
    return (30 - F.bit_count(_lowest(cell) - 1) / 2).cast("int")


def s2_cell_face(cell) -> Column:
    return F.shiftrightunsigned(c(cell), 61).cast("int")


def s2_cell_parent(cell, level: int) -> Column:
    last = F.lit(1 << 60 - 2 * level)
    return c(cell).bitwiseAND(F.negate(last)).bitwiseOR(last)


def s2_cell_children(cell) -> Column:
    """The four cells of the next level, in the order of the curve; null for a leaf."""
    step = F.shiftrightunsigned(_lowest(cell), 2)
    return F.when(step > 0, F.array(*[c(cell) - _lowest(cell) + step * k for k in (1, 3, 5, 7)]))


def s2_cell_center(cell) -> tuple[Column, Column]:
    """(lng, lat) of a cell's middle."""

    def decode(cell):
        level, face = s2_cell_level(cell), s2_cell_face(cell)
        start = F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), (face % 2).cast("int").alias("turn"))

        def step(s, k):
            def turned(d):
                inv, swap = F.call_function("shiftright", s["turn"], F.lit(1)), s["turn"].bitwiseAND(F.lit(1)) == 1
                p = F.when(d >= 2, 1).otherwise(0).bitwiseXOR(inv)
                q = F.when((d == 1) | (d == 2), 1).otherwise(0).bitwiseXOR(inv)
                change = F.when(d == 0, 1).when(d == 3, 3).otherwise(0)
                i, j = F.when(swap, q).otherwise(p), F.when(swap, p).otherwise(q)
                return F.struct((s["i"] * 2 + i).alias("i"), (s["j"] * 2 + j).alias("j"), s["turn"].bitwiseXOR(change).cast("int").alias("turn"))

            digit = F.call_function("shiftrightunsigned", cell, (61 - 2 * k).cast("int")).bitwiseAND(F.lit(3)).cast("int")
            return F.when(k <= level, let(digit, turned)).otherwise(s)

        def place(s):
            side = F.pow(F.lit(2.0), level)
            uv = lambda n: let((s[n] + 0.5) / side, lambda t: F.when(t >= 0.5, (4 * t * t - 1) / 3).otherwise((1 - 4 * (1 - t) * (1 - t)) / 3))

            def lifted(q):
                u, v, one = q["u"], q["v"], F.lit(1.0)
                x = F.when(face == 0, one).when((face == 1) | (face == 2), -u).when(face == 3, -one).otherwise(v)
                y = F.when(face == 0, u).when(face == 1, one).when((face == 2) | (face == 3), -v).when(face == 4, -one).otherwise(u)
                z = F.when((face == 0) | (face == 1), v).when(face == 2, one).when((face == 3) | (face == 4), -u).otherwise(-one)
                return F.struct(F.degrees(F.atan2(y, x)).alias("lng"), F.degrees(F.atan2(z, F.hypot(x, y))).alias("lat"))

            return let(F.struct(uv("i").alias("u"), uv("j").alias("v")), lifted)

        return let(F.aggregate(F.sequence(F.lit(1), F.lit(30)), start, step), place)

    out = let(c(cell), decode)
    return out["lng"], out["lat"]
