"""Files of tiles as rows: vector tiles and elevation or wind grids."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions import shapes as S
from terraloom.operators.interpolate import bilinear

VECTOR = "path string, layer string, extent int, feature_id long, geometry_type string, parts array<array<struct<x:double,y:double>>>, properties map<string,string>"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def _fields(data: bytes):
    """(number, value) of a protocol buffer message: ints of varints, bytes of all else."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def _packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = _varint(data, at)
        out.append(v)
    return out


def _signed(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def _text(value: bytes) -> str | None:
    for number, v in _fields(value):
        if number == 1:
            return v.decode()
        if number == 2:
            return repr(struct.unpack("<f", v)[0])
        if number == 3:
            return repr(struct.unpack("<d", v)[0])
        if number == 6:
            return str(_signed(v))
        if number == 7:
            return "true" if v else "false"
        return str(v)
    return None


def _parts(commands: list[int]) -> list[list[dict]]:
    """Lines or rings of a command stream, in tile units."""
    out, line, x, y, at = [], [], 0, 0, 0
    while at < len(commands):
        what, n = commands[at] & 7, commands[at] >> 3
        at += 1
        if what == 7:
            line.append(dict(line[0]))
            continue
        for _ in range(n):
            x, y = x + _signed(commands[at]), y + _signed(commands[at + 1])
            at += 2
            if what == 1:
                line = []
                out.append(line)
            line.append({"x": float(x), "y": float(y)})
    return out


def _layer(path: str, data: bytes):
    name, extent, keys, values, features = "", 4096, [], [], []
    for number, v in _fields(data):
        if number == 1:
            name = v.decode()
        elif number == 2:
            features.append(v)
        elif number == 3:
            keys.append(v.decode())
        elif number == 4:
            values.append(_text(v))
        elif number == 5:
            extent = v
    for f in features:
        own = dict(_fields(f))
        tags = _packed(own.get(2, b""))
        props = {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2])}
        kind = ("Unknown", "Point", "LineString", "Polygon")[own.get(3, 0)]
        yield path, name, extent, own.get(1), kind, _parts(_packed(own.get(4, b""))), props


def read_vector_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Features of vector tile files, one row each; a file is one task's row, decoded in batches."""
    import pandas as pd

    names = [c.split(" ")[0] for c in VECTOR.split(", ")]

    def decode(batches):
        for pdf in batches:
            rows = [r for p, data in zip(pdf["path"], pdf["content"]) for number, v in _fields(bytes(data)) if number == 3 for r in _layer(p, v)]
            yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, VECTOR)


def tile_to_degrees(features: DataFrame, z, x, y) -> DataFrame:
    """Parts of ``read_vector_tiles`` in degrees, for the tile (z, x, y) given as columns or numbers."""
    from terraloom.functions import tiles as T

    def place(p):
        size = T.tile_count(z) * F.col("extent")
        return S.point((x * F.col("extent") + p["x"]) / size * 360 - 180, T._tile_lat(y * F.col("extent") + p["y"], size))

    return features.withColumn("parts", F.transform("parts", lambda part: F.transform(part, place)))


def wind_at(grid: DataFrame, points: DataFrame, west: float, south: float, east: float, north: float, nx: int, ny: int, point_id: str) -> DataFrame:
    """point_id, u, v of a wind grid (row from north, col, u, v) at (x, y), bilinear; outside the bounds null."""
    gx, gy = (F.col("x") - west) / (east - west) * (nx - 1), (north - F.col("y")) / (north - south) * (ny - 1)
    p = points.where((F.col("x") >= west) & (F.col("x") <= east) & (F.col("y") >= south) & (F.col("y") <= north))
    p = p.select(F.col(point_id).alias("p"), gx.alias("gx"), gy.alias("gy"))
    p = p.withColumn("c0", F.least(F.floor("gx"), F.lit(nx - 2))).withColumn("r0", F.least(F.floor("gy"), F.lit(ny - 2)))
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    got = p.withColumn("k", corner).join(grid, (F.col("row") == F.col("r0") + F.col("k.i")) & (F.col("col") == F.col("c0") + F.col("k.j")))
    at = lambda n, i, j: F.max(F.when((F.col("k.i") == i) & (F.col("k.j") == j), F.col(n)))
    sums = got.groupBy("p", "gx", "gy", "c0", "r0").agg(*[at(n, i, j).alias(f"{n}{j}{i}") for n in "uv" for i in (0, 1) for j in (0, 1)])
    fx, fy = F.col("gx") - F.col("c0"), F.col("gy") - F.col("r0")
    found = sums.select("p", *[bilinear(f"{n}00", f"{n}10", f"{n}01", f"{n}11", fx, fy).alias(n) for n in "uv"])
    return points.select(point_id).join(found, F.col(point_id) == F.col("p"), "left").select(point_id, "u", "v")
