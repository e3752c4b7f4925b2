"""GeoJSON documents as rows of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions import shapes as S

FEATURE = "struct<type:string,id:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>"
DOCUMENT = f"struct<type:string,id:string,coordinates:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>,features:array<{FEATURE}>>"


def features_of(text: Column) -> Column:
    """Array of features of a FeatureCollection, a Feature or a bare geometry; empty for anything else."""
    d = F.from_json(text, DOCUMENT)
    none = F.array().cast(f"array<{FEATURE}>")
    one = F.struct(F.lit("Feature").alias("type"), d["id"].alias("id"), d["geometry"].alias("geometry"), d["properties"].alias("properties"))
    bare = F.struct(F.lit("Feature").alias("type"), F.lit(None).cast("string").alias("id"), F.struct(d["type"].alias("type"), d["coordinates"].alias("coordinates")).alias("geometry"), F.lit(None).cast("map<string,string>").alias("properties"))
    return F.coalesce(F.when(d["type"] == "FeatureCollection", d["features"]).when(d["type"] == "Feature", F.array(one)).when(d["coordinates"].isNotNull(), F.array(bare)), none)


def parse(documents: DataFrame, text_col: str = "value") -> DataFrame:
    """feature_id, ord, geometry_type, parts, properties; one row for each feature.

    ``parts`` is the canonical form of every geometry: parts of rings of
    positions.  A missing geometry becomes the point (0, 0), missing properties
    an empty map; the id is the feature's, else its property ``id``, else
    ``__index_<place>``.
    """
    rows = documents.select(F.posexplode(features_of(F.col(text_col))).alias("ord", "f"))
    kind = F.coalesce(F.when(F.col("f.geometry.coordinates").isNotNull(), F.col("f.geometry.type")), F.lit("Point"))
    text = F.coalesce("f.geometry.coordinates", F.lit("[0,0]"))
    pos = lambda p: S.point(p[0], p[1])
    line = lambda r: F.transform(r, pos)
    depth1, depth2, depth3, depth4 = (F.from_json(text, "array<" * n + "double" + ">" * n) for n in (1, 2, 3, 4))
    parts = (
        F.when(kind == "Point", F.array(F.array(F.array(pos(depth1)))))
        .when(kind == "MultiPoint", F.transform(depth2, lambda p: F.array(F.array(pos(p)))))
        .when(kind == "LineString", F.array(F.array(line(depth2))))
        .when(kind == "MultiLineString", F.transform(depth3, lambda r: F.array(line(r))))
        .when(kind == "Polygon", F.array(F.transform(depth3, line)))
        .when(kind == "MultiPolygon", F.transform(depth4, lambda p: F.transform(p, line)))
    )
    props = F.coalesce("f.properties", F.create_map().cast("map<string,string>"))
    fid = F.coalesce("f.id", F.try_element_at(props, F.lit("id")), F.concat(F.lit("__index_"), F.col("ord").cast("string")))
    out = rows.select(fid.alias("feature_id"), "ord", kind.alias("geometry_type"), parts.alias("parts"), props.alias("properties"))
    return out.withColumn("box", S.bounds(F.flatten(F.flatten("parts"))))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold one GeoJSON document each."""
    return parse(spark.read.text(path, wholetext=True))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Files with one feature or collection a line, which Spark can split."""
    return parse(spark.read.text(path))


def write_lines(features: DataFrame, path: str) -> None:
    """One feature a line from the rows of ``parse``."""
    coords = lambda p: F.array(p["x"], p["y"])
    rings = lambda part: F.transform(part, lambda r: F.transform(r, coords))
    kind, parts = F.col("geometry_type"), F.col("parts")
    text = (
        F.when(kind == "Point", F.to_json(coords(parts[0][0][0])))
        .when(kind == "MultiPoint", F.to_json(F.transform(parts, lambda p: coords(p[0][0]))))
        .when(kind == "LineString", F.to_json(F.transform(parts[0][0], coords)))
        .when(kind == "MultiLineString", F.to_json(F.transform(parts, lambda p: F.transform(p[0], coords))))
        .when(kind == "Polygon", F.to_json(rings(parts[0])))
        .otherwise(F.to_json(F.transform(parts, rings)))
    )
    quoted = F.to_json(F.struct(F.col("feature_id").alias("id")))
    line = F.concat(F.lit('{"type":"Feature",'), F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit(',"geometry":{"type":"'), kind, F.lit('","coordinates":'), text, F.lit('},"properties":'), F.to_json("properties"), F.lit("}"))
    features.select(line.alias("value")).write.text(path)
