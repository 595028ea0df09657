"""JON-06..11/22, FUN-01/02/04/05/21, AGG-13/14/20, JON-29/30/35, AGG-12, PRJ-26, FUN-15, JON-16/17, AGG-17 on positions made of keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions.wgs84 import geodesic_table
from ..operators import polygons as P
from ..operators import spatial as S
from ..operators import terrain as T
from . import Family
from .geodesy import inverse
from .tables import position, position_sql, sql_bearing, sql_distance, table

FAMILY = Family()

CX, CY = position_sql("c_custkey")
SX, SY = position_sql("s_suppkey", 11)
PTS = f"pts AS (SELECT c_custkey, {CX} AS lon, {CY} AS lat FROM customer), sites AS (SELECT s_suppkey, {SX} AS lon, {SY} AS lat FROM supplier)"
D_PS = sql_distance("p.lon", "p.lat", "s.lon", "s.lat")


def customers(spark, sf):
    lon, lat = position("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", lon.alias("lon"), lat.alias("lat"))


def suppliers(spark, sf):
    lon, lat = position("s_suppkey", 11)
    return table(spark, sf, "supplier").select("s_suppkey", lon.alias("lon"), lat.alias("lat"))


@FAMILY.add("jon_06_nearest", f"""WITH {PTS}, d AS (SELECT c_custkey, s_suppkey, {D_PS} AS d FROM pts p CROSS JOIN sites s),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY round(d, 9), s_suppkey) AS rn FROM d WHERE d <= 600)
SELECT c_custkey, s_suppkey, round(d, 5) AS distance_nm FROM r WHERE rn = 1""")
def _(spark, sf):
    near = S.nearest(customers(spark, sf), suppliers(spark, sf), 600.0, "c_custkey", "s_suppkey")
    return near.select("c_custkey", "s_suppkey", F.round("distance_nm", 5).alias("distance_nm"))


@FAMILY.add("jon_07_within_distance", f"WITH {PTS} SELECT c_custkey, s_suppkey, round({D_PS}, 5) AS distance_nm FROM pts p JOIN sites s ON {D_PS} <= 400")
def _(spark, sf):
    pairs = S.within_distance(customers(spark, sf), suppliers(spark, sf), 400.0, ["s_suppkey"])
    return pairs.select("c_custkey", "s_suppkey", F.round("distance_nm", 5).alias("distance_nm"))


@FAMILY.add("src_07_keep_near", f"WITH {PTS} SELECT c_custkey FROM pts p WHERE EXISTS (SELECT 1 FROM sites s WHERE {D_PS} <= 500)")
def _(spark, sf):
    return S.keep_near(customers(spark, sf), suppliers(spark, sf), 500.0, "c_custkey").select("c_custkey")


PAIR_SQL = f"""pairs AS (SELECT l_orderkey, l_linenumber, {position_sql('l_partkey')[0]} AS lon1, {position_sql('l_partkey')[1]} AS lat1,
  {position_sql('l_suppkey', 5)[0]} AS lon2, {position_sql('l_suppkey', 5)[1]} AS lat2, l_quantity AS h1, l_quantity * 3 AS h2 FROM lineitem)"""


def line_pairs(spark, sf):
    a, b = position("l_partkey"), position("l_suppkey", 5)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", a[0].alias("lon1"), a[1].alias("lat1"), b[0].alias("lon2"), b[1].alias("lat2"),
        F.col("l_quantity").alias("h1"), (F.col("l_quantity") * 3).alias("h2"),
    )


@FAMILY.add("fun_01_haversine_bearing", f"""WITH {PAIR_SQL} SELECT l_orderkey, l_linenumber, round({sql_distance('lon1', 'lat1', 'lon2', 'lat2')}, 4) AS distance_nm,
  CASE WHEN lon1 = lon2 AND lat1 = lat2 THEN NULL ELSE round({sql_bearing('lon1', 'lat1', 'lon2', 'lat2')}, 4) % 360 END AS bearing FROM pairs""")
def _(spark, sf):
    same = (F.col("lon1") == F.col("lon2")) & (F.col("lat1") == F.col("lat2"))
    b = F.round(G.bearing("lon1", "lat1", "lon2", "lat2"), 4) % 360
    return line_pairs(spark, sf).select(
        "l_orderkey", "l_linenumber", F.round(G.distance_nm("lon1", "lat1", "lon2", "lat2"), 4).alias("distance_nm"), F.when(~same, b).alias("bearing")
    )


@FAMILY.add("fun_21_vector_table", f"""WITH {PAIR_SQL}, v AS (SELECT *, {sql_distance('lon1', 'lat1', 'lon2', 'lat2', 6371008.8)} AS d FROM pairs)
SELECT l_orderkey, l_linenumber, round(d, 2) AS distance_m, h2 - h1 AS dh_m, round(sqrt(d * d + (h2 - h1) * (h2 - h1)), 2) AS slant_m,
  round(degrees(atan2(h2 - h1, d)), 6) AS angle_deg, CASE WHEN d > 0 THEN round((h2 - h1) / d, 8) END AS gradient FROM v""")
def _(spark, sf):
    v = G.vector_3d(line_pairs(spark, sf), "lon1", "lat1", "h1", "lon2", "lat2", "h2")
    r = lambda c, n: F.round(c, n).alias(c)
    return v.select("l_orderkey", "l_linenumber", r("distance_m", 2), "dh_m", r("slant_m", 2), r("angle_deg", 6), r("gradient", 8))


STEPS = 40
# pairs that have not settled by then are nearly opposite each other: the sphere answers for them
FAR = f"abs(g_l{STEPS} - g_l{STEPS - 1}) > 1e-7"


@FAMILY.add("fun_02_geodesic_table", f"""WITH {PAIR_SQL}, {inverse('g', 'pairs', 'lon1', 'lat1', 'lon2', 'lat2', 'nm', 'az', STEPS)}
SELECT l_orderkey, l_linenumber, round(CASE WHEN {FAR} THEN {sql_distance('lon1', 'lat1', 'lon2', 'lat2')} ELSE nm END, 4) AS geo_nm, round(CASE WHEN {FAR} THEN {sql_bearing('lon1', 'lat1', 'lon2', 'lat2')} ELSE az END, 4) % 360 AS azimuth1 FROM g""")
def _(spark, sf):
    g = geodesic_table(line_pairs(spark, sf))
    return g.select("l_orderkey", "l_linenumber", F.round("geo_nm", 4).alias("geo_nm"), (F.round("azimuth1", 4) % 360).alias("azimuth1"))


# ---------------------------------------------------------------- polygons: boxes of the nations

BOXES = """boxes AS (SELECT n_nationkey AS nation, (n_nationkey * 29 % 300) - 150 AS w, (n_nationkey * 17 % 120) - 60 AS s, 10 + n_nationkey % 7 * 4 AS dw, 8 + n_nationkey % 5 * 3 AS dh FROM nation)"""


def nation_rings(spark, sf):
    """Five vertices of a notched box per nation: containment is not the box test."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"))
    k = F.col("nation")
    n = n.withColumns({"w": (k * 29 % 300) - 150, "s": (k * 17 % 120) - 60, "dw": 10 + k % 7 * 4, "dh": 8 + k % 5 * 3})
    corner = lambda i, x, y: F.struct(F.lit(i).alias("seq"), x.cast("double").alias("lon"), y.cast("double").alias("lat"))
    w, s, e, t = F.col("w"), F.col("s"), F.col("w") + F.col("dw"), F.col("s") + F.col("dh")
    pts = F.array(corner(0, w, s), corner(1, e, s), corner(2, e, t), corner(3, (w + e) / 2, (s + t) / 2), corner(4, w, t))
    return n.select("nation", F.explode(pts).alias("p")).select("nation", "p.*")


@FAMILY.add("jon_08_point_in_polygon", f"""WITH p0 AS (SELECT c_custkey, {CX} + 0.0037 AS lon, {CY} + 0.0041 AS lat FROM customer), pts AS (SELECT * FROM p0), {BOXES},
inbox AS (SELECT c_custkey, nation, lon, lat, w, s, w + dw AS e, s + dh AS t FROM pts JOIN boxes ON lon BETWEEN w AND w + dw AND lat BETWEEN s AND s + dh)
SELECT c_custkey, nation FROM inbox WHERE (lon > w AND lon < e AND lat > s AND lat < t) AND NOT (lat >= t - (t - s) / 2.0 * (1 - abs(2 * (lon - (w + e) / 2.0) / (e - w))) * 1.0
  AND lat >= (s + t) / 2.0 + abs(lon - (w + e) / 2.0) * (t - s) / (e - w))""")
def _(spark, sf):
    edges = P.ring_edges(nation_rings(spark, sf), ["nation"])
    pts = customers(spark, sf).withColumns({"lon": F.col("lon") + 0.0037, "lat": F.col("lat") + 0.0041})
    return P.point_in_polygon(pts, edges, ["nation"], "c_custkey", 2.0)


@FAMILY.add("fun_15_ring_measures", f"""WITH {BOXES} SELECT nation, round(dw * dh * 0.75 * power(6371008.8 * pi() / 180, 2) * cos(radians(s + dh / 2.0)) / 1e6, 2) AS area_km2, w AS west, s AS south, w + dw AS east, s + dh AS north FROM boxes""")
def _(spark, sf):
    m = P.ring_measures(nation_rings(spark, sf), ["nation"])
    return m.select("nation", F.round(F.col("area_m2") / 1e6, 2).alias("area_km2"), *[F.col(c).cast("int").alias(c) for c in ("west", "south", "east", "north")])


@FAMILY.add("prj_26_clean_geometry", f"""WITH {BOXES},
v AS (SELECT nation, unnest([1, 2, 3, 4, 5, 6]) AS i, w, s, w + dw AS e, s + dh AS t FROM boxes)
SELECT nation, CAST(i - 1 AS BIGINT) AS seq, CAST(CASE i WHEN 1 THEN w WHEN 2 THEN e WHEN 3 THEN e WHEN 4 THEN (w + e) / 2.0 WHEN 5 THEN w ELSE w END AS DOUBLE) AS lon,
  CAST(CASE i WHEN 1 THEN s WHEN 2 THEN s WHEN 3 THEN t WHEN 4 THEN (s + t) / 2.0 WHEN 5 THEN t ELSE s END AS DOUBLE) AS lat, CAST(2 AS BIGINT) AS n_dropped, nation % 2 = 1 AS was_reversed FROM v""")
def _(spark, sf):
    r = nation_rings(spark, sf).withColumn("ring", F.lit(0))
    # repeat two vertices and turn every second ring round, keeping its first vertex
    doubled = r.unionByName(r.filter("seq in (1, 3)").withColumn("seq", F.col("seq") + 0.5)).withColumn("seq", (F.col("seq") * 2).cast("int"))
    turned = doubled.withColumn("seq", F.when((F.col("nation") % 2 == 1) & (F.col("seq") > 0), 20 - F.col("seq")).otherwise(F.col("seq")))
    return P.clean_geometry(turned, ["nation"]).select("nation", "seq", "lon", "lat", "n_dropped", "was_reversed")


CELL = 0.5
AREA_SQL = """areas AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'FIR' WHEN 1 THEN 'TMA' ELSE 'CTA' END AS type, (s_suppkey * 37 % 120) / 2.0 - 30 AS w, (s_suppkey * 53 % 60) / 2.0 - 15 AS s,
  2.0 + s_suppkey % 9 AS dw, 1.5 + s_suppkey % 7 AS dh, s_suppkey % 10 * 1000 AS lo, s_suppkey % 10 * 1000 + 8500 AS up FROM supplier)"""


def supplier_areas(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("airspace_id"), F.lit(1).alias("piece_no"), F.when(k % 3 == 0, "FIR").when(k % 3 == 1, "TMA").otherwise("CTA").alias("type"),
        ((k * 37 % 120) / 2.0 - 30).alias("w"), ((k * 53 % 60) / 2.0 - 15).alias("s"), (2.0 + k % 9).alias("dw"), (1.5 + k % 7).alias("dh"),
        (k % 10 * 1000).cast("double").alias("lo_ft"), (k % 10 * 1000 + 8500).cast("double").alias("up_ft"),
    )


def _box_edges(areas):
    w, s, e, t = F.col("w"), F.col("s"), F.col("w") + F.col("dw"), F.col("s") + F.col("dh")
    corner = lambda i, x, y: F.struct(F.lit(i).alias("seq"), x.alias("lon"), y.alias("lat"))
    v = areas.select("airspace_id", "piece_no", F.explode(F.array(corner(0, w, s), corner(1, e, s), corner(2, e, t), corner(3, w, t))).alias("p")).select("airspace_id", "piece_no", "p.*")
    return P.ring_edges(v, ["airspace_id", "piece_no"])


@FAMILY.add("jon_16_airspace_overlaps", f"""WITH {AREA_SQL},
pairs AS (SELECT a.id AS id_a, b.id AS id_b, a.type, greatest(a.w, b.w) AS w, least(a.w + a.dw, b.w + b.dw) AS e, greatest(a.s, b.s) AS s, least(a.s + a.dh, b.s + b.dh) AS t,
   greatest(a.lo, b.lo) AS lo, least(a.up, b.up) AS up FROM areas a JOIN areas b ON a.id < b.id AND a.type = b.type AND a.lo < b.up AND b.lo < a.up),
rows AS (SELECT *, unnest(generate_series(CAST(s / 0.5 AS INTEGER), CAST(t / 0.5 AS INTEGER) - 1)) AS r FROM pairs WHERE w < e AND s < t),
area AS (SELECT id_a, id_b, type, lo, up, sum((e - w) * 0.5 * 3600 * cos(radians((r + 0.5) * 0.5))) AS a FROM rows GROUP BY ALL)
SELECT id_a, id_b, type, round(a, 3) AS area_nm2, CAST(lo AS DOUBLE) AS lo_ft, CAST(up AS DOUBLE) AS up_ft, CASE WHEN type = 'FIR' THEN 'warning' ELSE 'info' END AS severity FROM area WHERE a >= 1""")
def _(spark, sf):
    areas = supplier_areas(spark, sf)
    spans = P.row_spans(_box_edges(areas), ["airspace_id", "piece_no"], CELL)
    out = P.airspace_overlaps(spans, areas.select("airspace_id", "piece_no", "type", "lo_ft", "up_ft"), CELL)
    return out.withColumn("area_nm2", F.round("area_nm2", 3))


@FAMILY.add("jon_17_assemble_airspace", f"""WITH {AREA_SQL},
cells AS (SELECT id, r, c FROM (SELECT id, s, dh, unnest(generate_series(CAST(w / 0.5 AS INTEGER), CAST((w + dw) / 0.5 AS INTEGER) - 1)) AS c FROM areas),
          LATERAL (SELECT unnest(generate_series(CAST(s / 0.5 AS INTEGER), CAST((s + dh) / 0.5 AS INTEGER) - 1)) AS r)),
base AS (SELECT id AS a, r, c FROM cells), u AS (SELECT id - 1 AS a, r, c FROM cells WHERE id % 2 = 1), sub AS (SELECT id - 2 AS a, r, c FROM cells)
SELECT a AS airspace_id, count(*) AS n_cells FROM (SELECT DISTINCT a, r, c FROM ((SELECT * FROM base UNION SELECT * FROM u) EXCEPT SELECT * FROM sub)) WHERE a >= 0 AND a IN (SELECT id FROM areas) GROUP BY 1""")
def _(spark, sf):
    # each airspace: its own box, united with the next one's (even ids), minus the box after that
    areas = supplier_areas(spark, sf)
    spans = P.row_spans(_box_edges(areas), ["airspace_id", "piece_no"], CELL)
    cells = P.spans_to_cells(spans, ["airspace_id"], CELL).withColumnRenamed("airspace_id", "volume_id")
    k = F.col("airspace_id")
    comp = areas.select("airspace_id", F.explode(F.array(
        F.struct(F.lit(1).alias("step"), F.lit("BASE").alias("op"), k.alias("volume_id")),
        F.when(k % 2 == 0, F.struct(F.lit(2).alias("step"), F.lit("UNION").alias("op"), (k + 1).alias("volume_id"))),
        F.struct(F.lit(3).alias("step"), F.lit("SUBTR").alias("op"), (k + 2).alias("volume_id")),
    )).alias("s")).filter("s is not null").select("airspace_id", "s.*", F.lit(None).cast("long").alias("contributor_id"))
    return P.assemble_airspace(cells, comp).groupBy("airspace_id").agg(F.count(F.lit(1)).alias("n_cells"))


@FAMILY.add("agg_17_vertical_band", """WITH v AS (SELECT l_suppkey AS id, CASE WHEN l_linenumber = 7 THEN 'SUBTR' ELSE 'UNION' END AS op, CASE WHEN l_tax >= 0.02 THEN l_quantity * 100 END AS lo,
  CASE WHEN l_discount < 0.09 THEN l_quantity * 100 + l_extendedprice ELSE 'inf'::DOUBLE END AS up FROM lineitem)
SELECT id AS airspace_id, coalesce(min(lo), 0) AS lo_ft, coalesce(max(CASE WHEN up < 'inf'::DOUBLE THEN up END), 0) AS top_ft, bool_or(up = 'inf'::DOUBLE) AS unlimited FROM v WHERE op <> 'SUBTR' GROUP BY 1""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    v = li.select(
        F.col("l_suppkey").alias("airspace_id"), F.when(F.col("l_linenumber") == 7, "SUBTR").otherwise("UNION").alias("op"),
        F.when(F.col("l_tax") >= 0.02, F.col("l_quantity") * 100).alias("lo_ft"),
        F.when(F.col("l_discount") < 0.09, F.col("l_quantity") * 100 + F.col("l_extendedprice")).otherwise(F.lit(float("inf"))).alias("up_ft"),
        F.lit(None).cast("long").alias("contributor_id"), F.lit(None).cast("string").alias("dependency"),
    )
    band = P.vertical_band(v)
    finite = v.filter("op <> 'SUBTR'").filter(F.col("up_ft") < F.lit(float("inf"))).groupBy("airspace_id").agg(F.max("up_ft").alias("top_ft"))
    return band.join(finite, "airspace_id", "left").select("airspace_id", "lo_ft", F.coalesce("top_ft", F.lit(0.0)).alias("top_ft"), (F.col("up_ft") == F.lit(float("inf"))).alias("unlimited"))


# ---------------------------------------------------------------- paths: the orders of a customer by date

PX, PY = position_sql("o_orderkey", 0, 20)
QX, QY = position_sql("p_partkey", 3, 20)
LEGS_SQL = f"""path AS (SELECT o_custkey AS path, o_orderkey AS seq, {PX} AS lon1, {PY} AS lat1, lead({PX}) OVER w AS lon2, lead({PY}) OVER w AS lat2, o_totalprice / 100 AS alt_m
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
legs AS (SELECT * FROM path WHERE lon2 IS NOT NULL), obs AS (SELECT p_partkey, {QX} AS lon, {QY} AS lat, p_retailprice AS elev_m FROM part),
rel AS (SELECT *, cos(radians(lat)) AS k, ((((lon1 - lon) + 180) % 360 + 360) % 360 - 180) * cos(radians(lat)) AS ax, lat1 - lat AS ay, (((lon2 - lon1) + 180) % 360 + 360) % 360 - 180 AS dl, lat2 - lat1 AS dy
  FROM obs JOIN legs ON lat BETWEEN least(lat1, lat2) - 0.1 AND greatest(lat1, lat2) + 0.1 AND lon BETWEEN least(lon1, lon2) - 0.2 AND greatest(lon1, lon2) + 0.2),
near AS (SELECT *, dl * k AS dx, CASE WHEN dl * k * dl * k + dy * dy > 0 THEN greatest(0.0, least(1.0, -(ax * dl * k + ay * dy) / (dl * k * dl * k + dy * dy))) ELSE 0 END AS t FROM rel),
hits AS (SELECT p_partkey, path, seq, elev_m, alt_m, sqrt(power(ax + t * dx, 2) + power(ay + t * dy, 2)) * 60 AS d FROM near)"""


def order_legs(spark, sf):
    lon, lat = position("o_orderkey", 0, 20)
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("seq"), lon.alias("lon"), lat.alias("lat"), (F.col("o_totalprice") / 100).alias("alt_m"))
    return S.path_segments(o, ["path"], block=5000, carry=["alt_m"]).withColumn("moc_m", F.lit(150.0))


def part_points(spark, sf):
    lon, lat = position("p_partkey", 3, 20)
    return table(spark, sf, "part").select("p_partkey", lon.alias("lon"), lat.alias("lat"), F.col("p_retailprice").alias("elev_m"))


@FAMILY.add("jon_10_near_path", f"WITH {LEGS_SQL} SELECT p_partkey, path, round(min(d), 5) AS distance_nm FROM hits WHERE d <= 0.5 GROUP BY ALL")
def _(spark, sf):
    hits = S.near_path(part_points(spark, sf), order_legs(spark, sf), 0.5, ["path"], cell_nm=4.0)
    return hits.groupBy("p_partkey", "path").agg(F.round(F.min("distance_nm"), 5).alias("distance_nm"))


@FAMILY.add("jon_11_obstacle_leg_clearance", f"""WITH {LEGS_SQL}, c AS (SELECT *, alt_m - elev_m AS clr FROM hits WHERE d <= 1),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY clr, seq) AS rn FROM c WHERE clr < 225)
SELECT p_partkey, seq AS leg_id, round(clr, 4) AS clearance_m, CASE WHEN clr < 0 THEN 'error' WHEN clr < 150 THEN 'warning' ELSE 'caution' END AS severity FROM r WHERE rn = 1""")
def _(spark, sf):
    legs = order_legs(spark, sf).withColumnRenamed("seq", "leg_id")
    out = S.obstacle_leg_clearance(part_points(spark, sf), legs, "p_partkey", cell_nm=8.0)
    return out.select("p_partkey", "leg_id", F.round("clearance_m", 4).alias("clearance_m"), "severity")


# ---------------------------------------------------------------- terrain: a grid of the parts

TERRAIN_SQL = """terrain AS (SELECT 'fine' AS source, p_partkey // 100 AS r, p_partkey % 100 AS c, 10 + (p_partkey % 100) * 0.1 AS lon, 50 - (p_partkey // 100) * 0.1 AS lat,
  CASE WHEN p_partkey % 23 <> 0 THEN CAST(p_size * 40 + p_partkey % 7 AS DOUBLE) END AS elev FROM part)"""


def part_terrain(spark, sf):
    k = F.col("p_partkey")
    row, c = F.floor(k / 100).cast("long"), (k % 100).cast("long")
    return table(spark, sf, "part").select(
        F.lit("fine").alias("source"), row.alias("row"), c.alias("col"), (10 + c * 0.1).alias("lon"), (50 - row * 0.1).alias("lat"),
        F.when(k % 23 != 0, (F.col("p_size") * 40 + k % 7).cast("double")).alias("elev"),
    )


def part_grids(cells):
    return cells.groupBy("source").agg((F.max("row") + 1).alias("n_rows"), F.lit(100).alias("n_cols")).withColumns(
        {"spacing_deg": F.lit(0.1), "lon0": F.lit(10.0), "lat0": F.lit(50.0)}
    )


def terrain_points(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", (10 + (k * 37 % 990) / 100.0 + 0.003).alias("lon"), (50 - (k * 53 % 190) / 100.0 - 0.003).alias("lat"), F.col("c_acctbal").alias("published_m"))


AT_SQL = f"""{TERRAIN_SQL}, pts AS (SELECT c_custkey, c_acctbal, 10 + (c_custkey * 37 % 990) / 100.0 + 0.003 AS lon, 50 - (c_custkey * 53 % 190) / 100.0 - 0.003 AS lat FROM customer),
fr AS (SELECT *, (lon - 10) / 0.1 AS x, (50 - lat) / 0.1 AS y, CAST(floor((lon - 10) / 0.1) AS BIGINT) AS c0, CAST(floor((50 - lat) / 0.1) AS BIGINT) AS r0 FROM pts
  WHERE lat BETWEEN 50 - ((SELECT max(r) FROM terrain) + 0.5) * 0.1 AND 50.05 AND lon BETWEEN 9.95 AND 19.95), -- inside the box of the grid

posts AS (SELECT c_custkey, c_acctbal, c0 + dc AS c, r0 + dr AS r, (CASE dc WHEN 0 THEN 1 - (x - c0) ELSE x - c0 END) * (CASE dr WHEN 0 THEN 1 - (y - r0) ELSE y - r0 END) AS w
  FROM fr CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(dc, dr)),
at_ AS (SELECT c_custkey, c_acctbal, sum(w * elev) / sum(w) AS elev FROM posts JOIN terrain t ON t.r = posts.r AND t.c = posts.c WHERE elev IS NOT NULL GROUP BY ALL HAVING sum(w) > 0.25)"""


@FAMILY.add("jon_29_terrain_at", f"WITH {AT_SQL} SELECT c_custkey, round(elev, 4) AS elev FROM at_")
def _(spark, sf):
    cells = part_terrain(spark, sf)
    return T.terrain_at(terrain_points(spark, sf), cells, part_grids(cells), "c_custkey").select("c_custkey", F.round("elev", 4).alias("elev"))


@FAMILY.add("jon_30_terrain_crosscheck", f"WITH {AT_SQL} SELECT c_custkey, round(elev, 4) AS terrain_m, round(c_acctbal - elev, 4) AS diff_m FROM at_")
def _(spark, sf):
    cells = part_terrain(spark, sf)
    out = T.terrain_crosscheck(terrain_points(spark, sf), cells, part_grids(cells), "c_custkey")
    return out.select("c_custkey", F.round("terrain_m", 4).alias("terrain_m"), F.round("diff_m", 4).alias("diff_m"))


@FAMILY.add("agg_12_terrain_stats", f"""WITH {TERRAIN_SQL}, top AS (SELECT lon, lat FROM terrain WHERE elev IS NOT NULL ORDER BY elev DESC, r, c LIMIT 1)
SELECT source, count(*) AS posts, count(*) FILTER (elev IS NULL) AS voids, min(elev) AS min_m, max(elev) AS max_m, round(avg(elev), 6) AS mean_m, round(CAST(any_value(top.lon) AS DOUBLE), 6) AS max_lon, round(CAST(any_value(top.lat) AS DOUBLE), 6) AS max_lat FROM terrain CROSS JOIN top GROUP BY 1""")
def _(spark, sf):
    r = lambda c: F.round(c, 6).alias(c)
    return T.terrain_stats(part_terrain(spark, sf)).select("source", "posts", "voids", "min_m", "max_m", r("mean_m"), r("max_lon"), r("max_lat"))


@FAMILY.add("agg_13_grid_mora", f"""WITH {TERRAIN_SQL} SELECT CAST(floor(lon) AS INTEGER) AS lon_deg, CAST(floor(lat) AS INTEGER) AS lat_deg, max(elev) AS highest_m,
  CAST(ceil((greatest(0, max(elev)) / 0.3048 + CASE WHEN max(elev) / 0.3048 > 5000 THEN 2000 ELSE 1000 END) / 100) * 100 AS BIGINT) AS mora_ft FROM terrain GROUP BY 1, 2""")
def _(spark, sf):
    return T.grid_mora(part_terrain(spark, sf))


@FAMILY.add("agg_14_terrain_rings", f"""WITH {TERRAIN_SQL}, sites AS (SELECT s_suppkey, 10 + (s_suppkey * 37 % 990) / 100.0 + 0.001 AS lon, 50 - (s_suppkey * 53 % 190) / 100.0 - 0.001 AS lat FROM supplier),
d AS (SELECT s_suppkey, elev, {sql_distance('t.lon', 't.lat', 's.lon', 's.lat')} AS d FROM terrain t JOIN sites s ON abs(t.lat - s.lat) < 0.5 WHERE elev IS NOT NULL),
r AS (SELECT s_suppkey, ring, elev, d, row_number() OVER (PARTITION BY s_suppkey, ring ORDER BY elev DESC, round(d, 9)) AS rn FROM d JOIN (VALUES (5.0), (10.0), (25.0)) v(ring) ON d <= ring)
SELECT s_suppkey, CAST(ring AS DOUBLE) AS ring_nm, elev, round(d, 4) AS distance_nm FROM r WHERE rn = 1""")
def _(spark, sf):
    k = F.col("s_suppkey")
    sites = table(spark, sf, "supplier").select("s_suppkey", (10 + (k * 37 % 990) / 100.0 + 0.001).alias("lon"), (50 - (k * 53 % 190) / 100.0 - 0.001).alias("lat"))
    out = S.highest_in_rings(sites, part_terrain(spark, sf), [5, 10, 25], "s_suppkey")
    return out.select("s_suppkey", "ring_nm", "elev", F.round("distance_nm", 4).alias("distance_nm"))


@FAMILY.add("jon_35_terrain_mosaic", f"""WITH {TERRAIN_SQL}, coarse AS (SELECT r // 4 AS r, c // 4 AS c, max(elev) AS elev FROM terrain GROUP BY 1, 2),
g AS (SELECT y, x, 10 + (x + 0.5) * 0.125 - 0.05 AS lon, 50.05 - (y + 0.5) * 0.1 AS lat FROM (SELECT unnest(generate_series(0, 79)) AS x) CROSS JOIN (SELECT unnest(generate_series(0, 19)) AS y)),
f AS (SELECT y, x, t.elev FROM g JOIN terrain t ON t.c = CAST(floor((g.lon - 10) / 0.1 + 0.5) AS BIGINT) AND t.r = CAST(floor((50 - g.lat) / 0.1 + 0.5) AS BIGINT) WHERE t.elev IS NOT NULL),
k AS (SELECT y, x, t.elev FROM g JOIN coarse t ON t.c = CAST(floor((g.lon - 10.15) / 0.4 + 0.5) AS BIGINT) AND t.r = CAST(floor((49.85 - g.lat) / 0.4 + 0.5) AS BIGINT) WHERE t.elev IS NOT NULL)
SELECT CAST(g.y AS INTEGER) AS y, CAST(g.x AS INTEGER) AS x, coalesce(f.elev, k.elev) AS elev FROM g LEFT JOIN f ON f.x = g.x AND f.y = g.y LEFT JOIN k ON k.x = g.x AND k.y = g.y""")
def _(spark, sf):
    fine = part_terrain(spark, sf)
    coarse = fine.groupBy(F.floor(F.col("row") / 4).alias("row"), F.floor(F.col("col") / 4).alias("col")).agg(F.max("elev").alias("elev")).select(
        F.lit("coarse").alias("source"), "row", "col", (10.15 + F.col("col") * 0.4).alias("lon"), (49.85 - F.col("row") * 0.4).alias("lat"), "elev"
    )
    cells = fine.unionByName(coarse)
    fine_grid = part_grids(fine)
    coarse_grid = coarse.groupBy("source").agg((F.max("row") + 1).alias("n_rows"), F.lit(25).alias("n_cols")).withColumns({"spacing_deg": F.lit(0.4), "lon0": F.lit(10.15), "lat0": F.lit(49.85)})
    return T.terrain_mosaic(cells, fine_grid.unionByName(coarse_grid), 9.95, 48.05, 19.95, 50.05, 80, 20).select("y", "x", "elev")
