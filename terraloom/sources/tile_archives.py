"""Tile archives (one file, Hilbert ids, varint directories) and quantised terrain meshes, read with ``binaryFile``.

One row holds one file, as Spark reads it, so files go up to Spark's limit of
2 GB; many files are spread over tasks.  Broken files raise an error that names
them.
"""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.sources.tile_files import _varint

HEADER = ("root_offset", "root_length", "meta_offset", "meta_length", "leaf_offset", "leaf_length", "data_offset", "data_length", "addressed", "entries", "contents")
DEGREES = ("west", "south", "east", "north")
NONE, GZIP = 1, 2


def archive_header(data: bytes) -> dict:
    """Fields of the 127 bytes at the start of an archive of version 3."""
    if len(data) < 127 or data[:2] != b"PM" or data[7] != 3:
        raise ValueError("no tile archive of version 3")
    out = dict(zip(HEADER, struct.unpack_from("<11Q", data, 8)))
    out |= dict(zip(("clustered", "compression", "tile_compression", "tile_type", "min_zoom", "max_zoom"), data[96:102]))
    return out | {n: v / 1e7 for n, v in zip(DEGREES, struct.unpack_from("<4i", data, 102))}


def _plain(data: bytes, compression: int) -> bytes:
    if compression == GZIP:
        return gzip.decompress(data)
    if compression == NONE:
        return data
    raise ValueError(f"compression {compression} isn't supported")


def directory(data: bytes) -> list[tuple[int, int, int, int]]:
    """(first id, run, offset, length) of a directory's entries; a run of 0 points to a leaf directory."""
    n, at = _varint(data, 0)
    columns = []
    for _ in range(4):
        own = []
        for _ in range(n):
            v, at = _varint(data, at)
            own.append(v)
        columns.append(own)
    deltas, runs, lengths, offsets = columns
    out, tile, end = [], 0, 0
    for delta, run, length, offset in zip(deltas, runs, lengths, offsets):
        tile += delta
        start = end if offset == 0 and out else offset - 1
        end = start + length
        out.append((tile, run, start, length))
    return out


def tile_of_id(number: int) -> tuple[int, int, int]:
    """(z, x, y) of an id: tiles of a level follow the Hilbert curve after all levels above."""
    z, before = 0, 0
    while before + 4**z <= number:
        before += 4**z
        z += 1
    d, x, y = number - before, 0, 0
    for level in range(z):
        side = 1 << level
        rx = d // 2 & 1
        ry = (d ^ rx) & 1
        if not ry:
            if rx:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
        x, y, d = x + side * rx, y + side * ry, d // 4
    return z, x, y


def _entries(data: bytes, head: dict) -> Iterator[tuple[int, int, int, int]]:
    """All tile entries of the root directory and the leaves it points to."""
    todo = [(head["root_offset"], head["root_length"])]
    while todo:
        at, length = todo.pop()
        for tile, run, start, size in directory(_plain(data[at : at + length], head["compression"])):
            if run:
                yield tile, run, start, size
            else:
                todo.append((head["leaf_offset"] + start, size))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """path, header (map of numbers as doubles), metadata (JSON text) of every archive."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, metas = [], []
            for data in batch.column("content").to_pylist():
                head = archive_header(data)
                found.append([(k, float(v)) for k, v in head.items()])
                text = _plain(data[head["meta_offset"] : head["meta_offset"] + head["meta_length"]], head["compression"]).decode() if head["meta_length"] else "{}"
                json.loads(text)
                metas.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.map_(pa.string(), pa.float64())), pa.array(metas, pa.string())], ["path", "header", "metadata"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(heads, "path string, header map<string,double>, metadata string")


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """path, z, x, y, tile_id, data (as stored, but unzipped) of every tile of the archives; runs of equal tiles are spelled out."""

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "z", "x", "y", "tile_id", "data"]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                head, rows = archive_header(data), []
                for first, run, start, size in _entries(data, head):
                    at = head["data_offset"] + start
                    tile = _plain(data[at : at + size], head["tile_compression"])
                    for number in range(first, first + run):
                        rows.append((file, *tile_of_id(number), number, tile))
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(tiles, "path string, z int, x long, y long, tile_id long, data binary")


def high_water_mark(codes: np.ndarray) -> np.ndarray:
    """Indices from their distances to the highest one so far plus one; a distance of 0 raises it."""
    codes = codes.astype(np.int64)
    fresh = codes == 0
    return np.cumsum(fresh) - fresh - codes


def _unfolded(values: np.ndarray) -> np.ndarray:
    """Running sums of differences whose sign is in the lowest bit."""
    v = values.astype(np.int64)
    return np.cumsum((v >> 1) ^ -(v & 1))


def mesh(data: bytes) -> dict:
    """center, heights, and the vertices and triangles of a quantised mesh; u and v run from 0 to 32767 over the tile, h over the heights."""
    cx, cy, cz, low, high = struct.unpack_from("<3d2f", data, 0)
    (n,) = struct.unpack_from("<I", data, 88)
    u, v, h = (_unfolded(np.frombuffer(data, "<u2", n, 92 + 2 * n * k)) for k in range(3))
    at, kind = 92 + 6 * n, "<u2"
    if n > 65536:
        at, kind = at + -at % 4, "<u4"
    (triangles,) = struct.unpack_from("<I", data, at)
    corners = high_water_mark(np.frombuffer(data, kind, 3 * triangles, at + 4))
    return {"center": [cx, cy, cz], "low": low, "high": high, "u": u.tolist(), "v": v.tolist(), "h": h.tolist(), "corners": corners.tolist()}


def read_meshes(spark: SparkSession, path: str) -> DataFrame:
    """path, center, low, high, vertices (u, v, height in metres), triangles (three places in ``vertices``) of every mesh file."""

    def meshes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [mesh(x) for x in batch.column("content").to_pylist()]
            kinds = {"center": pa.list_(pa.float64()), "low": pa.float64(), "high": pa.float64(), **{k: pa.list_(pa.int64()) for k in ("u", "v", "h", "corners")}}
            yield pa.RecordBatch.from_arrays([batch.column("path"), *(pa.array([m[k] for m in own], t) for k, t in kinds.items())], ["path", *kinds])

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(meshes, "path string, center array<double>, low double, high double, u array<long>, v array<long>, h array<long>, corners array<long>")
    height = lambda h: F.col("low") + h / 32767 * (F.col("high") - F.col("low"))
    vertices = F.transform(F.arrays_zip("u", "v", "h"), lambda p: F.struct((p.u / 32767).alias("u"), (p.v / 32767).alias("v"), height(p.h).alias("height")))
    triangles = F.transform(F.sequence(F.lit(1), F.size("corners"), F.lit(3)), lambda i: F.slice("corners", i, 3))
    return raw.select("path", "center", "low", "high", vertices.alias("vertices"), F.when(F.size("corners") > 0, triangles).otherwise(F.array().cast("array<array<long>>")).alias("triangles"))
