import json
import struct

from pyspark.sql import functions as F

from terraloom.functions import shapes as S
from terraloom.operators.raster import elevation
from terraloom.sources import geojson, tile_files
from terraloom.streaming import feeds


def test_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "id": "a", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 0]]]}, "properties": {"n": 1}},
        {"type": "Feature", "geometry": None, "properties": None},
        {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1]]]]}, "properties": {"id": "p"}},
        {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4, 5]]}, "properties": {}},
    ]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    rows = sorted(geojson.read(spark, str(tmp_path / "d.json")).collect(), key=lambda r: r.ord)
    assert [r.feature_id for r in rows] == ["a", "__index_1", "p", "__index_3"]
    assert [r.geometry_type for r in rows] == ["Polygon", "Point", "MultiPolygon", "LineString"]
    assert rows[0].box.east == 4 and rows[0].properties == {"n": "1"} and rows[1].parts[0][0][0].x == 0
    geojson.write_lines(geojson.read(spark, str(tmp_path / "d.json")), str(tmp_path / "out"))
    back = {r.feature_id: r for r in geojson.read_lines(spark, str(tmp_path / "out")).collect()}
    assert back["a"].parts == rows[0].parts and back["p"].geometry_type == "MultiPolygon"


def test_other_documents(spark):
    texts = ['{"type":"Point","coordinates":[1,2]}', '{"type":"Feature","geometry":{"type":"Point","coordinates":[3,4]}}', "nonsense", None, '{"a":1}']
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    assert sorted(r.parts[0][0][0].x for r in geojson.parse(df).collect()) == [1, 3]


def _message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += bytes([number << 3]) + _number(value)
        else:
            out += bytes([number << 3 | 2]) + _number(len(value)) + value
    return out


def _number(v):
    out = b""
    while v > 127:
        out, v = out + bytes([v & 127 | 128]), v >> 7
    return out + bytes([v])


def test_vector_tile(spark, tmp_path):
    zig = lambda v: (v << 1) ^ (v >> 31)
    line = b"".join(_number(v) for v in (9, zig(2), zig(3), 18, zig(5), zig(0), zig(0), zig(-1)))
    value = _message((1, b"road"))
    number = bytes([3 << 3 | 1]) + struct.pack("<d", 2.5)
    feature = _message((1, 7), (2, bytes([0, 0, 1, 1])), (3, 2), (4, line))
    layer = _message((1, b"lines"), (2, feature), (3, b"class"), (3, b"w"), (4, value), (4, number), (5, 4096))
    (tmp_path / "t.mvt").write_bytes(_message((3, layer)))
    r = tile_files.read_vector_tiles(spark, str(tmp_path / "t.mvt")).collect()
    assert len(r) == 1 and r[0].layer == "lines" and r[0].feature_id == 7 and r[0].properties == {"class": "road", "w": "2.5"}
    assert [(p.x, p.y) for p in r[0].parts[0]] == [(2, 3), (7, 3), (7, 2)]
    placed = tile_files.tile_to_degrees(tile_files.read_vector_tiles(spark, str(tmp_path / "t.mvt")), 0, F.lit(0), F.lit(0)).first()
    assert -180 < placed.parts[0][0].x < -179


def test_elevation_and_wind(spark):
    r = spark.range(1).select(elevation(F.lit(1), F.lit(134), F.lit(160)).alias("m"), elevation(F.lit(128), F.lit(0), F.lit(128), "terrarium").alias("t")).first()
    assert abs(r.m - 0) < 1e-6 and r.t == 0.5
    g = spark.createDataFrame([(i, j, float(j), float(i)) for i in range(3) for j in range(3)], "row int, col int, u double, v double")
    p = spark.createDataFrame([(1, 5.0, 5.0), (2, 20.0, 0.0), (3, 10.0, 0.0)], "id int, x double, y double")
    got = {r.id: (r.u, r.v) for r in tile_files.wind_at(g, p, 0.0, 0.0, 10.0, 10.0, 3, 3, "id").collect()}
    assert got == {1: (1.0, 1.0), 2: (None, None), 3: (2.0, 2.0)}


def _drain(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_stream_of_features(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text('{"type":"Feature","id":"x","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"k":"v"}}\nbroken\n')
    messages = feeds.read_messages(spark, str(tmp_path / "in"))
    _drain(feeds.features(messages), "feats")
    _drain(feeds.malformed(messages), "bad")
    assert [r.id for r in spark.table("feats").collect()] == ["x"] and spark.table("bad").count() == 1


def test_keyed_state_stream(spark, tmp_path):
    schema = "key string, ord long, op string, patch map<string,string>"
    rows = [("a", 1, "set", {"x": "1"}), ("a", 2, "set", {"y": "2"}), ("b", 3, "set", {"z": "1"}), ("a", 4, "remove", None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "log"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "log"))
    _drain(feeds.keyed_state(stream), "states")
    got = {(r.key, r.ord): r.attributes for r in spark.table("states").collect()}
    assert got == {("a", 1): {"x": "1"}, ("a", 2): {"x": "1", "y": "2"}, ("b", 3): {"z": "1"}, ("a", 4): {}}


def test_windows_and_upserts(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:05:00", "a"), ("2024-01-01 02:00:00", "a")], "ts string, k string").coalesce(1).write.json(str(tmp_path / "ev"))
    ev = spark.readStream.schema("ts timestamp, k string").json(str(tmp_path / "ev"))
    _drain(feeds.windowed_counts(ev, "ts", "k"), "wins")
    assert [r.n for r in spark.table("wins").collect()] == [2]
    merge = feeds.upsert_into(str(tmp_path / "t"), "k")
    merge(spark.createDataFrame([(1, "a", "set"), (2, "b", "set")], "k int, v string, op string"), 0)
    merge(spark.createDataFrame([(1, "c", "set"), (2, "b", "remove")], "k int, v string, op string"), 1)
    assert [(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "t/version=1")).collect()] == [(1, "c")]


def test_boxes(spark):
    a, b = S.box(0, 0, 2, 2), S.box(1, 1, 3, 3)
    r = spark.range(1).select(S.box_iou(a, b).alias("iou"), S.box_overlap(a, b).alias("o"), S.box_area(S.box_intersect(a, S.box(5, 5, 6, 6))).alias("z"), S.box_contains(S.box_expand(a, 5), b).alias("c")).first()
    assert abs(r.iou - 1 / 7) < 1e-9 and r.o and r.z == 0 and r.c
