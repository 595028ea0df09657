"""OpenStreetMap extracts as tables: nodes, ways with their vertices, members of relations.

``Extract`` holds one extract whatever its format: elements (kind, id, tags), way_vertices (id, seq, lon, lat), points
(id, lon, lat) and members (id, seq, way, role). Ids are text; only multipolygon relations keep members.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAGS = "map<string,string>"


class Extract(NamedTuple):
    elements: DataFrame
    points: DataFrame
    way_vertices: DataFrame
    members: DataFrame


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def read_osm_xml(spark: SparkSession, path: str) -> Extract:
    """An .osm file: one split scan per kind of element. Vertices whose node is not in the file are left out."""
    tag = "tag array<struct<_k: string, _v: string>>"
    tags = F.map_from_entries(F.transform(F.coalesce("tag", F.array().cast("array<struct<_k: string, _v: string>>")), lambda t: F.struct(t["_k"].alias("key"), t["_v"].alias("value")))).alias("tags")
    node = _xml(spark, path, "node", f"_id string, _lon double, _lat double, {tag}").where("_id is not null")
    way = _xml(spark, path, "way", f"_id string, nd array<struct<_ref: string>>, {tag}").where("_id is not null")
    rel = _xml(spark, path, "relation", f"_id string, member array<struct<_type: string, _ref: string, _role: string>>, {tag}").where("_id is not null")
    points = node.select(F.col("_id").alias("id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"))
    vertices = way.select(F.col("_id").alias("id"), F.posexplode("nd").alias("seq", "n")).select("id", "seq", F.col("n._ref").alias("node"))
    vertices = vertices.join(points.withColumnRenamed("id", "node"), "node").select("id", "seq", "lon", "lat")
    kinds = [rows.select(F.lit(kind).alias("kind"), F.col("_id").alias("id"), tags) for kind, rows in (("node", node), ("way", way), ("relation", rel))]
    members = rel.select(F.col("_id").alias("id"), tags, F.posexplode("member").alias("seq", "m")).where("tags['type'] = 'multipolygon' and m._type = 'way'")
    return Extract(kinds[0].unionByName(kinds[1]).unionByName(kinds[2]), points, vertices, members.select("id", "seq", F.col("m._ref").alias("way"), F.col("m._role").alias("role")))


def read_overpass(spark: SparkSession, path: str) -> Extract:
    """The JSON answer of an Overpass query that gives geometries. Members carry their own vertices, so they are ways of
    their own here, named by relation and place."""
    place = "struct<lon: double, lat: double>"
    schema = f"elements array<struct<type: string, id: string, lon: double, lat: double, tags: {TAGS}, geometry: array<{place}>, members: array<struct<type: string, ref: string, role: string, geometry: array<{place}>>>>>"
    e = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*")
    elements = e.select(F.col("type").alias("kind"), "id", F.coalesce("tags", F.create_map().cast(TAGS)).alias("tags"))
    points = e.where("type = 'node' and lat is not null").select("id", "lon", "lat")
    spread = lambda rows: rows.select("id", F.posexplode("geometry").alias("seq", "p")).where("p is not null").select("id", "seq", "p.lon", "p.lat")
    m = e.where("type = 'relation'").select("id", F.posexplode("members").alias("seq", "m")).where("m.type = 'way' and m.geometry is not null")
    m = m.select("id", "seq", F.concat_ws("/", "id", "seq").alias("way"), F.col("m.role").alias("role"), F.col("m.geometry").alias("geometry"))
    vertices = spread(e.where("type = 'way'")).unionByName(spread(m.select(F.col("way").alias("id"), "geometry")))
    return Extract(elements, points, vertices, m.select("id", "seq", "way", "role"))


def read_osm_geojson(spark: SparkSession, path: str) -> Extract:
    """A GeoJSON export: points are nodes, lines ways; of polygons the outer ring is a closed way, further ones of a
    multipolygon ways with a number behind their id. Rings inside a polygon are not read."""
    schema = f"features array<struct<id: string, properties: {TAGS}, geometry: struct<type: string, coordinates: string>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("features").alias("_n", "f")).select("_n", "f.*").where("geometry is not null")
    name = F.coalesce(F.try_element_at("properties", F.lit("@id")), F.col("id"), F.lit(""))
    given = F.regexp_extract(name, r"^(?:node|way|relation)/(\d+)", 1)
    shape, text = F.col("geometry.type"), F.col("geometry.coordinates")
    kind = F.coalesce(F.nullif(F.regexp_extract(name, r"^(node|way|relation)/\d+", 1), F.lit("")), F.when(shape == "Point", "node").otherwise("way"))
    rows = f.select(kind.alias("kind"), F.when(given == "", F.col("_n").cast("string")).otherwise(given).alias("id"), F.coalesce("properties", F.create_map().cast(TAGS)).alias("tags"), shape.alias("shape"), text.alias("text"))
    points = rows.where("shape = 'Point'").select("id", F.from_json("text", "array<double>").alias("c")).select("id", F.get("c", F.lit(0)).alias("lon"), F.get("c", F.lit(1)).alias("lat"))
    line = F.from_json("text", "array<array<double>>")
    first = F.get(F.from_json("text", "array<array<array<double>>>"), F.lit(0))
    many = F.transform(F.from_json("text", "array<array<array<array<double>>>>"), lambda p: F.get(p, F.lit(0)))
    lines = F.when(F.col("shape") == "LineString", F.array(line)).when(F.col("shape") == "Polygon", F.array(first)).when(F.col("shape") == "MultiPolygon", many)
    parts = rows.where("shape in ('LineString', 'Polygon', 'MultiPolygon')").select("kind", "id", "tags", F.posexplode(lines).alias("part", "line"))
    parts = parts.withColumn("id", F.when(F.col("part") > 0, F.concat_ws("-", "id", "part")).otherwise(F.col("id")))
    vertices = parts.select("id", F.posexplode("line").alias("seq", "c")).select("id", "seq", F.get("c", F.lit(0)).alias("lon"), F.get("c", F.lit(1)).alias("lat"))
    elements = rows.where("shape = 'Point'").select("kind", "id", "tags").unionByName(parts.select(F.lit("way").alias("kind"), "id", "tags"))
    none = vertices.where("false").select("id", "seq", F.col("id").alias("way"), F.col("id").alias("role"))
    return Extract(elements, points, vertices, none)


READERS = {"xml": read_osm_xml, "overpass": read_overpass, "geojson": read_osm_geojson}


def read_osm(spark: SparkSession, path: str, form: str) -> Extract:
    """``form``: xml, overpass or geojson."""
    return READERS[form](spark, path)
