"""FUN-04/05/06/17, PRJ-03, JON-22, SRC-05/17 on lines, parts, orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import units as U
from ..functions import utm
from ..operators import flatten as FL
from ..operators import mapping as M
from ..operators import polygons as P
from ..operators.stage import settle
from ..sources import files as S
from . import Family
from .spatial import BOXES, CX, CY, customers, nation_rings
from .tables import position, position_sql, sql_bearing, sql_distance, table

FAMILY = Family()
RE = 6371008.8


@FAMILY.add("fun_04_cross_along_track", f"""WITH p AS (SELECT l_orderkey AS k, l_linenumber AS n, {position_sql('l_partkey', 0, 10)[0]} AS x1, {position_sql('l_partkey', 0, 10)[1]} AS y1, {position_sql('l_suppkey', 5, 10)[0]} AS x2, {position_sql('l_suppkey', 5, 10)[1]} AS y2,
  {position_sql('l_orderkey', 77, 10)[0]} + 0.00013 AS x, {position_sql('l_orderkey', 77, 10)[1]} + 0.00017 AS y FROM lineitem),
a AS (SELECT *, {sql_distance('x1', 'y1', 'x', 'y', 1.0)} AS d, radians({sql_bearing('x1', 'y1', 'x', 'y')} - {sql_bearing('x1', 'y1', 'x2', 'y2')}) AS t FROM p WHERE NOT (x1 = x2 AND y1 = y2))
SELECT k, n, round(asin(sin(d) * sin(t)) * {RE}, 1) AS across_m FROM a""")
def _(spark, sf):
    (x1, y1), (x2, y2), (x, y) = position("l_partkey", 0, 10), position("l_suppkey", 5, 10), position("l_orderkey", 77, 10)
    p = settle(table(spark, sf, "lineitem"), x1=x1, y1=y1, x2=x2, y2=y2, x=x + 0.00013, y=y + 0.00017).filter(~((F.col("x1") == F.col("x2")) & (F.col("y1") == F.col("y2"))))
    return p.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.round(G.cross_track("x1", "y1", "x2", "y2", "x", "y"), 1).alias("across_m"))


@FAMILY.add("fun_06_units", """SELECT p_partkey, round(p_size * CASE p_partkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.3048 WHEN 2 THEN 1852.0 WHEN 3 THEN 30.48 ELSE 1000.0 END::DOUBLE, 6) AS metres,
  round(CASE p_partkey % 4 WHEN 0 THEN p_size * 100 WHEN 1 THEN p_size / 0.3048::DOUBLE WHEN 2 THEN 0 ELSE p_size END::DOUBLE, 6) AS limit_ft FROM part""")
def _(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part").withColumn("u", F.get(F.array(*[F.lit(x) for x in ("M", "ft", "NM", "FL", "KM")]), (k % 5).cast("int"))).withColumn("lu", F.get(F.array(*[F.lit(x) for x in ("FL", "M", "", "FT")]), (k % 4).cast("int")))
    limit = F.when(k % 4 == 2, "GND").otherwise(F.col("p_size").cast("string"))
    return p.withColumn("v", limit).select("p_partkey", F.round(U.to_metres("p_size", "u"), 6).alias("metres"), F.round(U.limit_ft("v", "lu"), 6).alias("limit_ft"))


@FAMILY.add("fun_17_utm", f"WITH t AS (SELECT c_custkey, {CX} AS lon, {CY} AS lat FROM customer) SELECT c_custkey, CAST(floor((lon + 180) / 6) % 60 + 1 AS INTEGER) AS zone, round(lon, 7) AS back_lon, round(lat, 7) AS back_lat FROM t")
def _(spark, sf):
    c = customers(spark, sf).withColumn("zone", utm.zone_of("lon"))
    e, n = utm.forward("lon", "lat", "zone")
    c = settle(c, east=e, north=n, south=F.col("lat") < 0)
    x, y = utm.inverse("east", "north", "zone", "south")
    return c.select("c_custkey", "zone", F.round(x, 7).alias("back_lon"), F.round(y, 7).alias("back_lat"))


@FAMILY.add("prj_03_references", "SELECT o_orderkey AS key, 'customer' AS prop, CAST(o_custkey AS VARCHAR) AS ref FROM orders UNION ALL SELECT o_orderkey, 'part', o_orderstatus FROM orders")
def _(spark, sf):
    ref = lambda c: F.struct(F.concat(F.lit("urn:uuid:"), c).alias("ref"))
    tree = F.to_json(F.struct(ref(F.col("o_custkey").cast("string")).alias("customer"), F.struct(ref(F.col("o_orderstatus")).alias("the")).alias("part"), F.col("o_orderpriority").alias("plain")))
    flat = FL.flatten(table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), tree.alias("tree")), "tree", ["key"])
    return FL.references(flat).select("key", "prop", "ref")


@FAMILY.add("jon_22_airspace_over", f"""WITH {BOXES}, pts AS (SELECT c_custkey, c_nationkey, {CX} + 0.0037 AS lon, {CY} + 0.0041 AS lat FROM customer),
i AS (SELECT c_custkey AS ad_id, nation AS airspace_id FROM (SELECT *, w + dw AS e, s + dh AS t FROM pts JOIN boxes ON lon > w AND lon < w + dw AND lat > s AND lat < s + dh) WHERE NOT lat >= (s + t) / 2.0 + abs(lon - (w + e) / 2.0) * (t - s) / (e - w)),
u AS (SELECT ad_id, airspace_id, false AS served FROM i UNION ALL SELECT c_custkey, c_nationkey, true FROM customer) SELECT ad_id, airspace_id, bool_or(served) AS served FROM u GROUP BY 1, 2""")
def _(spark, sf):
    pts = customers(spark, sf).withColumns({"lon": F.col("lon") + 0.0037, "lat": F.col("lat") + 0.0041})
    inside = P.point_in_polygon(pts, P.ring_edges(nation_rings(spark, sf), ["nation"]), ["nation"], "c_custkey", 2.0)
    served = table(spark, sf, "customer").select(F.col("c_custkey").alias("ad_id"), F.col("c_nationkey").alias("airspace_id"))
    return M.airspace_over(inside.withColumnsRenamed({"c_custkey": "ad_id", "nation": "airspace_id"}), served)


@FAMILY.add("src_05_derive_parents", "SELECT l_suppkey AS ad_id, l_returnflag || l_linenumber AS code, max(l_quantity) AS width_m, max(l_extendedprice) AS length_m, count(*) AS n, 'Runway' AS type FROM lineitem WHERE l_linenumber > 1 GROUP BY 1, 2")
def _(spark, sf):
    code = F.when(F.col("l_linenumber") > 1, F.concat("l_returnflag", "l_linenumber")).otherwise("")
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("ad_id"), code.alias("idrwy"), F.col("l_quantity").alias("width_m"), F.col("l_extendedprice").alias("length_m"))
    return M.derive_parents(e, "Runway", "idrwy")


@FAMILY.add("src_17_group_deliveries", """WITH f AS (SELECT doc_id, source, doc_id % 3 AS v FROM documents) SELECT CAST(doc_id AS VARCHAR) AS path, 'set x' || doc_id // 3 AS delivery,
  row_number() OVER (PARTITION BY doc_id // 3 ORDER BY CASE WHEN v = 1 THEN 1 ELSE 0 END, doc_id) AS read_order FROM f""")
def _(spark, sf):
    k = F.col("doc_id")
    kind = F.when(k % 3 == 0, "Airport").when(k % 3 == 1, "Airport_delta").otherwise("Obstacles")
    d = table(spark, sf, "documents").select(k.cast("string").alias("path"), F.concat(F.lit("SET_X"), F.floor(k / 3), F.lit("_"), kind, F.lit(".xml")).alias("name"), F.lit(None).cast("string").alias("manifest"))
    return S.group_deliveries(d).select("path", "delivery", F.col("read_order").cast("long").alias("read_order"))
