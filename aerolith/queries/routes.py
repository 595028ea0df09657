"""Route texts of the orders: suppliers are places, customers the points of the airways of their nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.route_text import expand_routes
from . import Family
from .tables import position, position_sql, table

FAMILY = Family()

SX, SY = position_sql("s_suppkey", 5)
CX, CY = position_sql("c_custkey", 0)
# an airway joins the customers of its nation in order; every tenth one also the one four places on
ROUTES_SQL = f"""pts AS (SELECT c_custkey AS k, c_nationkey AS n, 'P' || c_custkey AS name, {CX} AS lon, {CY} AS lat, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer),
seg AS (SELECT 'UN' || a.n AS airway, a.i * 2 + CASE WHEN b.i = a.i + 1 THEN 0 ELSE 1 END AS no, a.name AS a, b.name AS b FROM pts a JOIN pts b ON a.n = b.n AND (b.i = a.i + 1 OR (b.i = a.i + 4 AND a.i % 10 = 0))),
places AS (SELECT 'S' || s_suppkey AS name, {SX} AS lon, {SY} AS lat FROM supplier UNION ALL SELECT name, lon, lat FROM pts WHERE k % 13 <> 0),
req AS (SELECT o_orderkey AS id, o_custkey AS c, a.n, a.i, 'UN' || a.n AS airway, a.name AS p1, b.name AS p2, 1 + o_orderkey % 7 AS gap, a.k % 13 <> 0 AS k1, b.k % 13 <> 0 AS k2, 200 + o_orderkey % 200 AS fl
  FROM orders JOIN pts a ON a.k = o_custkey JOIN pts b ON b.n = a.n AND b.i = a.i + 1 + o_orderkey % 7)"""


def _world(spark, sf):
    lon, lat = position("c_custkey", 0)
    pts = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), F.concat(F.lit("P"), F.col("c_custkey")).alias("name"), lon.alias("lon"), lat.alias("lat"))
    pts = pts.withColumn("i", F.expr("row_number() over (partition by n order by k)"))
    b = pts.select("n", F.col("i").alias("j"), F.col("name").alias("b"), F.col("lon").alias("b_lon"), F.col("lat").alias("b_lat"))
    steps = F.explode(F.when(F.col("i") % 10 == 0, F.array(F.lit(1), F.lit(4))).otherwise(F.array(F.lit(1))))
    seg = pts.withColumn("step", steps).withColumn("j", F.col("i") + F.col("step")).join(b, ["n", "j"]).select(
        F.concat(F.lit("un "), F.col("n")).alias("airway"), (F.col("i") * 2 + (F.col("step") != 1).cast("int")).alias("no"), F.col("name").alias("a"), F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat"), "b", "b_lon", "b_lat"
    )
    sx, sy = position("s_suppkey", 5)
    sup = table(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("name"), F.lit(0).alias("rank"), sx.alias("lon"), sy.alias("lat"))
    places = sup.unionByName(pts.where("k % 13 <> 0").select("name", F.lit(1).alias("rank"), "lon", "lat"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"))
    far = pts.select("n", F.col("i").alias("j"), F.col("name").alias("p2"))
    routes = o.join(pts.select("k", "n", "i", F.col("name").alias("p1")), "k").withColumn("j", F.col("i") + 1 + F.col("id") % 7).join(far, ["n", "j"])
    word = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    fl = (200 + F.col("id") % 200).cast("string")
    text = word("s1 DCT ", F.col("p1"), "/N0450F", fl, " un", F.col("n"), " ", F.col("p2"), ", F350 5512N02515E UN999 S2; nowhere S3/S1130")
    return routes.select("id", text.alias("text"), F.lit(1000.0).alias("alt")), places, seg


@FAMILY.add("jon_23_route_points", f"""WITH RECURSIVE {ROUTES_SQL},
e AS (SELECT airway, no, a AS u, b AS v FROM seg UNION ALL SELECT airway, no, b, a FROM seg),
ask AS (SELECT DISTINCT airway, p1, p2, gap FROM req WHERE k1),
walk(airway, p1, p2, gap, here, steps, path) AS (SELECT airway, p1, p2, gap, p1, []::BIGINT[], [p1] FROM ask UNION ALL
  SELECT w.airway, w.p1, w.p2, w.gap, v, list_append(steps, no), list_append(path, v) FROM walk w JOIN e ON e.airway = w.airway AND e.u = w.here WHERE w.here <> w.p2 AND len(path) <= w.gap AND NOT list_contains(path, v)),
best AS (SELECT airway, p1, p2, min({{'n': len(steps), 's': steps, 'p': path}}) AS m FROM walk WHERE here = p2 GROUP BY 1, 2, 3),
way AS (SELECT id, airway, m.p AS path FROM req JOIN best USING (airway, p1, p2) WHERE k1),
own AS (SELECT id, 0 AS pos, 'S1' AS name, 1000.0 AS alt FROM req UNION ALL SELECT id, 2, p1, fl * 30.48 FROM req WHERE k1 UNION ALL SELECT id, 4, p2, 1000 FROM req WHERE k2
  UNION ALL SELECT id, 8, 'S2', 350 * 30.48 FROM req UNION ALL SELECT id, 10, 'S3', 11300 FROM req),
mid AS (SELECT id, 3 AS pos, CAST(j - 2 AS INTEGER) AS nth, path[j] AS name, 1000.0 AS alt, airway AS via FROM (SELECT *, unnest(generate_series(2, len(path) - 1)) AS j FROM way WHERE len(path) > 2))
SELECT id, pos::int AS pos, nth, name, round(lon, 6) AS lon, round(lat, 6) AS lat, round(CAST(alt AS DOUBLE), 3) AS alt_m, via FROM
 (SELECT id, pos, 0 AS nth, name, lon, lat, alt, NULL AS via FROM own JOIN places USING (name) UNION ALL SELECT id, 6, 0, '5512N02515E', 25.25, 55.2, 350 * 30.48, NULL FROM req
  UNION ALL SELECT id, pos, nth, mid.name, lon, lat, alt, via FROM mid JOIN pts USING (name))""")
def _(spark, sf):
    routes, places, seg = _world(spark, sf)
    points, _ = expand_routes(routes, places, seg, "id", "text", "alt")
    return points.select("id", "pos", "nth", "name", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("alt_m", 3).alias("alt_m"), "via")


@FAMILY.add("jon_23_unknown_words", f"""WITH {ROUTES_SQL} SELECT id, 7 AS pos, 'UN999' AS token FROM req UNION ALL SELECT id, 9, 'NOWHERE' FROM req UNION ALL SELECT id, 3, airway FROM req WHERE NOT k1
UNION ALL SELECT id, 2, p1 || '/N0450F' || fl FROM req WHERE NOT k1 UNION ALL SELECT id, 4, p2 FROM req WHERE NOT k2""")
def _(spark, sf):
    routes, places, seg = _world(spark, sf)
    return expand_routes(routes, places, seg, "id", "text", "alt")[1]
