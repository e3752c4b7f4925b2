"""Archives and meshes made by hand, read back."""

import gzip
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.functions import tiles as T
from terraloom.sources import tile_archives as A


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def packed(entries):
    """A directory from (id, run, offset, length)."""
    ids = [e[0] for e in entries]
    columns = [[b - a for a, b in zip([0, *ids], ids)], [e[1] for e in entries], [e[3] for e in entries]]
    ends = [None] + [e[2] + e[3] for e in entries]
    columns.append([0 if e[2] == end else e[2] + 1 for e, end in zip(entries, ends)])
    return varint(len(entries)) + b"".join(varint(v) for c in columns for v in c)


def archive(path):
    data = [gzip.compress(t) for t in (b"world", b"two", b"far away")]
    cuts = [0, len(data[0]), len(data[0]) + len(data[1])]
    leaf = gzip.compress(packed([(21, 2, cuts[2], len(data[2]))]))
    root = gzip.compress(packed([(0, 1, 0, len(data[0])), (1, 4, cuts[1], len(data[1])), (21, 0, 0, len(leaf))]))
    meta = gzip.compress(json.dumps({"name": "a world"}).encode())
    body = [root, meta, leaf, b"".join(data)]
    at, places = 127, []
    for part in body:
        places += [at, len(part)]
        at += len(part)
    head = b"PMTiles\x03" + struct.pack("<11Q", *places, 7, 3, 3) + bytes([1, 2, 2, 1, 0, 3]) + struct.pack("<4i", -1800000000, -850000000, 1800000000, 850000000) + bytes(9)
    assert len(head) == 127
    path.write_bytes(head + b"".join(body))


def test_archive(spark, tmp_path):
    archive(tmp_path / "a.tiles")
    (row,) = A.read_archives(spark, str(tmp_path)).collect()
    assert row.header["min_zoom"] == 0 and row.header["west"] == -180 and json.loads(row.metadata) == {"name": "a world"}
    rows = A.read_tiles(spark, str(tmp_path)).collect()
    assert {r.tile_id: bytes(r.data) for r in rows} == {0: b"world", 21: b"far away", 22: b"far away"} | {n: b"two" for n in range(1, 5)}
    assert {(r.z, r.x, r.y) for r in rows if r.z < 2} == {(0, 0, 0)} | {(1, x, y) for x in (0, 1) for y in (0, 1)}
    back = A.read_tiles(spark, str(tmp_path)).where("z = 3").select("tile_id", T.tile_id(3, "x", "y").alias("again")).collect()
    assert len(back) == 2 and all(r.tile_id == r.again for r in back)


def test_ids_and_tiles_undo_each_other(spark):
    every = spark.range(4**4).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y")).select("x", "y", T.tile_id(4, "x", "y").alias("n")).collect()
    assert all(A.tile_of_id(r.n) == (4, r.x, r.y) for r in every) and A.tile_of_id(0) == (0, 0, 0)


@pytest.mark.parametrize("data", [b"", b"PMTiles\x02" + bytes(200), b"no" + bytes(200)])
def test_other_files_are_refused(data):
    with pytest.raises(ValueError):
        A.archive_header(data)


def folded(values):
    d = np.diff([0, *values])
    return np.where(d >= 0, 2 * d, -2 * d - 1).astype("<u2").tobytes()


def test_mesh(spark, tmp_path):
    u, v, h, corners = [0, 32767, 0, 32767], [0, 0, 32767, 32767], [0, 16384, 8192, 32767], [0, 1, 2, 1, 3, 2]
    codes, high = [], 0
    for c in corners:
        codes.append(high - c)
        high += c == high
    head = struct.pack("<3d2f", 1.0, 2.0, 3.0, 100.0, 200.0) + bytes(88 - 32)
    (tmp_path / "m.terrain").write_bytes(head + struct.pack("<I", 4) + folded(u) + folded(v) + folded(h) + struct.pack("<I", 2) + np.array(codes, "<u2").tobytes())
    (row,) = A.read_meshes(spark, str(tmp_path)).collect()
    assert row.triangles == [[0, 1, 2], [1, 3, 2]] and row.center == [1, 2, 3]
    assert [(p.u, p.v) for p in row.vertices] == [(0, 0), (1, 0), (0, 1), (1, 1)] and row.vertices[3].height == 200 and row.vertices[0].height == 100
