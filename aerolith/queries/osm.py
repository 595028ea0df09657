"""Map elements: a relation per supplier whose ring is put together from three ways, and the parts as tagged shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.osm import holes, osm_features, ring_vertices, stitched
from . import Family
from .tables import table

FAMILY = Family()

# corners of the outer ring round a place; way a is 0-1-2, way b 2-3-4 (stored backwards by odd suppliers), way c 4-5-0
CORNERS = [(0, 0), (3, -1), (6, 0), (6, 4), (3, 5), (0, 4)]
WAYS = {"a": [0, 1, 2], "b": [2, 3, 4], "c": [4, 5, 0]}


def _relations(spark, sf):
    k = F.col("k")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") * 7 % 300 - 150.0).alias("x"), (F.col("s_suppkey") * 11 % 120 - 60.0).alias("y"))
    way = lambda name, back, places: F.struct(
        F.lit(name).alias("way"), back.alias("back"), F.array(*[F.struct((F.col("x") + dx).alias("lon"), (F.col("y") + dy).alias("lat")) for dx, dy in places]).alias("v")
    )
    outer = [way(n, (k % 2 == 1) if n == "b" else F.lit(False), [CORNERS[c] for c in corners]) for n, corners in WAYS.items()]
    hole = way("h", F.lit(False), [(2, 1), (4, 1), (4, 2), (2, 2), (2, 1)])
    rows = s.select("k", F.explode(F.array(*outer, hole)).alias("w")).select("k", "w.*").where("not (way = 'c' and k % 5 = 0)").withColumn("id", F.concat("way", F.col("k")))
    v = rows.select("id", F.posexplode(F.when(F.col("back"), F.reverse("v")).otherwise(F.col("v"))).alias("seq", "p")).select("id", "seq", "p.lon", "p.lat")
    order = F.element_at(F.create_map(*[F.lit(x) for pair in (("a", 0), ("h", 1), ("c", 2), ("b", 3)) for x in pair]), F.col("way"))
    members = rows.select(F.col("k").cast("string").alias("id"), order.alias("seq"), F.col("id").alias("way"), F.when(F.col("way") == "h", "inner").otherwise("outer").alias("role"))
    return members, v


@FAMILY.add("src_13_osm_rings", """WITH w AS (SELECT * FROM (VALUES ('outer', 0, 'a'), ('outer', 1, 'b'), ('outer', 2, 'c'), ('inner', 0, 'h')) t(role, nth, way))
SELECT CAST(s_suppkey AS VARCHAR) AS id, role, 0 AS ring, nth, way || s_suppkey AS way, way = 'b' AND s_suppkey % 2 = 1 AS backwards FROM supplier, w WHERE role = 'inner' OR s_suppkey % 5 <> 0""")
def _(spark, sf):
    return stitched(*_relations(spark, sf))


@FAMILY.add("src_13_osm_ring_vertices", """WITH w AS (SELECT * FROM (VALUES ('outer', 0, 0, 0), ('outer', 1, 3, -1), ('outer', 2, 6, 0), ('outer', 3, 6, 4), ('outer', 4, 3, 5), ('outer', 5, 0, 4), ('outer', 6, 0, 0),
  ('inner', 0, 2, 1), ('inner', 1, 4, 1), ('inner', 2, 4, 2), ('inner', 3, 2, 2), ('inner', 4, 2, 1)) t(role, place, dx, dy))
SELECT CAST(s_suppkey AS VARCHAR) AS id, role, place, s_suppkey * 7 % 300 - 150.0::double + dx AS lon, s_suppkey * 11 % 120 - 60.0::double + dy AS lat, CASE WHEN role = 'inner' AND s_suppkey % 5 <> 0 THEN 0 END AS outer_ring
FROM supplier, w WHERE role = 'inner' OR s_suppkey % 5 <> 0""")
def _(spark, sf):
    members, v = _relations(spark, sf)
    rows = ring_vertices(stitched(members, v), v)
    inside = holes(rows).select("id", "ring", F.col("outer").alias("outer_ring"), F.lit("inner").alias("role"))
    place = F.expr("cast(row_number() over (partition by id, role, ring order by nth, seq) - 1 as int)")
    return rows.withColumn("place", place).join(inside, ["id", "ring", "role"], "left").select("id", "role", "place", "lon", "lat", "outer_ring")


def _shapes(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    said = lambda **tags: F.map_from_arrays(F.array(*[F.lit(n.replace("__", ":")) for n in tags]), F.array(*[v if not isinstance(v, str) else F.lit(v) for v in tags.values()]))
    size = F.col("p_size").cast("string")
    cases = [
        ("way", "L", said(aeroway="taxiway", ref=F.col("p_brand"), width=F.concat(size, F.lit(" m")), surface=F.when(F.col("p_size") % 2 == 0, "asphalt").otherwise("moss"), oneway=F.when(F.col("p_size") % 3 == 0, "-1").otherwise("no"))),
        ("way", "A", said(aeroway="apron", name=F.col("p_name"), surface="concrete")),
        ("node", "P", said(aeroway="parking_position", ref=F.col("p_brand"))),
        ("node", "P", said(aeroway="holding_position", holding_position__type=F.when(F.col("p_size") % 2 == 0, "cat ii").otherwise("runway"))),
        ("way", "A", said(building="hangar", name=F.col("p_name"), building__levels=size)),
        ("way", "L", said(highway="service")),
        ("node", "P", said(man_made="mast", height=F.concat(size, F.lit(",5")))),
        ("relation", "A", said(natural="water")),
    ]
    pick = lambda place: F.get(F.array(*[F.lit(c[place]) if isinstance(c[place], str) else c[place] for c in cases]), (k % 8).cast("int"))
    return p.select(pick(0).alias("kind"), k.cast("string").alias("id"), F.lit(0).alias("part"), pick(1).alias("shape"), pick(2).alias("tags"))


@FAMILY.add("src_14_osm_features", """WITH p AS (SELECT *, p_partkey % 8 AS c FROM part), f AS (
  SELECT p_partkey, 'TaxiwayGuidanceLine' AS feature_type, 'color=0;direc=' || CASE WHEN p_size % 3 = 0 THEN '2' ELSE '0' END || ';idlin=' || p_brand || ';status=1;style=0' AS attrs FROM p WHERE c = 0
  UNION ALL SELECT p_partkey, 'TaxiwayElement', CASE WHEN p_size % 2 = 0 THEN 'gsurftyp=2;' ELSE '' END || 'idlin=' || p_brand || ';status=1;width=' || p_size || '.0' FROM p WHERE c = 0
  UNION ALL SELECT p_partkey, 'ApronElement', 'aprontyp=1;gsurftyp=1;idapron=' || p_name || ';status=1' FROM p WHERE c = 1 UNION ALL SELECT p_partkey, 'ParkingStandLocation', 'idstd=' || p_brand FROM p WHERE c = 2
  UNION ALL SELECT p_partkey, 'TaxiwayHoldingPosition', CASE WHEN p_size % 2 = 0 THEN 'catstop=3;holddir=0;marktype=1;status=1' ELSE 'catstop=0;holddir=0;marktype=0;status=1' END FROM p WHERE c = 3
  UNION ALL SELECT p_partkey, 'VerticalPolygonalStructure', 'height=' || CAST(round(p_size * 3.5, 1)::double AS VARCHAR) || ';ident=' || p_name || ';plysttyp=2' FROM p WHERE c = 4
  UNION ALL SELECT p_partkey, 'ServiceRoad', 'featbase=0;width=6.0' FROM p WHERE c = 5 UNION ALL SELECT p_partkey, 'VerticalPointStructure', 'height=' || p_size || '.5;pntsttyp=3' FROM p WHERE c = 6 UNION ALL SELECT p_partkey, 'Water', '' FROM p WHERE c = 7)
SELECT CAST(p_partkey AS VARCHAR) AS id, feature_type, attrs FROM f""")
def _(spark, sf):
    text = F.array_join(F.array_sort(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return osm_features(_shapes(spark, sf)).select("id", "feature_type", text.alias("attrs"))
