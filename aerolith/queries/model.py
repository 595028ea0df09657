"""PRJ-04/06/10/11/27, JON-19/21/36, SNK-08, FUN-16/19/20, PRJ-18, WIN-12, JON-27, JOB-22/23 on orders, lines, customers, parts, events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import model as M
from ..operators import polygons as P
from ..plans import effects as E
from ..sources import notam as N
from . import Family
from .spatial import AREA_SQL, AT_SQL, CELL, _box_edges, part_grids, part_terrain, supplier_areas, terrain_points
from .tables import SLICES_SQL, event_slices, position, position_sql, sql_bearing, table

FAMILY = Family()

TYPES = ("AirportHeliport", "VerticalStructure", "VOR", "RunwayDirection", "DesignatedPoint")
PROPS = ("ARP", "part", "location", "_thr", "name")
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def pick_of(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


MODEL_SQL = f"""f AS (SELECT 'O' || o_orderkey AS feature_id, list_extract({_LIST(TYPES)}, o_orderkey % 5 + 1) AS feature_type FROM orders
  UNION ALL SELECT 'N' || c_custkey, 'Navaid' FROM customer),
v AS (SELECT 'O' || l_orderkey AS feature_id, list_extract({_LIST(PROPS)}, l_partkey % 5 + 1) AS prop, CASE WHEN l_suppkey % 3 = 0 THEN 'L' ELSE 'P' END AS shape, l_linenumber AS seq,
  CAST(l_partkey % 360 - 180 AS DOUBLE) AS lon, CAST(l_suppkey % 170 - 85 AS DOUBLE) AS lat FROM lineitem WHERE l_quantity > 40
  UNION ALL SELECT 'N' || c_custkey, 'location', 'P', 1, CAST(c_nationkey AS DOUBLE), CAST(c_custkey % 80 AS DOUBLE) FROM customer WHERE c_custkey % 4 <> 0),
t AS (SELECT 'C' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, 'O' || l_orderkey AS target, l_linenumber AS no, CAST(l_partkey % 90 AS DOUBLE) AS lon, CAST(l_suppkey % 80 AS DOUBLE) AS lat
  FROM lineitem WHERE l_linenumber <= 2 AND l_returnflag = 'A')"""


@FAMILY.add("prj_04_point_of", f"""WITH {MODEL_SQL},
r AS (SELECT feature_id, feature_type, lon, lat, CASE WHEN shape = 'P' AND prop = CASE feature_type WHEN 'AirportHeliport' THEN 'ARP' WHEN 'RunwayDirection' THEN '_thr' WHEN 'VerticalStructure' THEN 'part' ELSE 'location' END THEN 0
  WHEN shape = 'P' THEN 2 ELSE 3 END AS rank, prop, seq FROM v JOIN f USING (feature_id)),
own AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY rank, prop, seq, lon, lat) = 1),
thr AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY target ORDER BY no, id, lon, lat) = 1),
nav AS (SELECT 'O' || o_orderkey AS target, c_nationkey AS lon, c_custkey % 80 AS lat FROM orders JOIN customer ON c_custkey = o_custkey AND c_custkey % 4 <> 0),
j AS (SELECT f.feature_id, f.feature_type, own.rank, own.lon AS olon, own.lat AS olat, thr.lon AS tlon, thr.lat AS tlat, nav.lon AS nlon, nav.lat AS nlat FROM f LEFT JOIN own USING (feature_id)
  LEFT JOIN thr ON thr.target = f.feature_id LEFT JOIN nav ON nav.target = f.feature_id),
s AS (SELECT *, CASE WHEN rank = 0 THEN 'own' WHEN feature_type = 'RunwayDirection' AND tlon IS NOT NULL THEN 'threshold' WHEN rank = 2 THEN 'own' WHEN rank = 3 THEN 'part of a shape' WHEN feature_type = 'VOR' AND nlon IS NOT NULL THEN 'navaid' END AS source FROM j)
SELECT feature_id, source, CAST(CASE source WHEN 'threshold' THEN tlon WHEN 'navaid' THEN nlon ELSE olon END AS DOUBLE) AS lon, CAST(CASE source WHEN 'threshold' THEN tlat WHEN 'navaid' THEN nlat ELSE olat END AS DOUBLE) AS lat FROM s WHERE source IS NOT NULL""")
def _(spark, sf):
    o, li, c = (table(spark, sf, t) for t in ("orders", "lineitem", "customer"))
    key = lambda p, *ks: F.concat(F.lit(p), F.concat_ws("-", *ks))
    none = F.lit(None).cast("string")
    cl = li.filter("l_linenumber <= 2 and l_returnflag = 'A'").withColumn("id", key("C", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    features = (
        o.select(key("O", "o_orderkey").alias("feature_id"), pick_of(TYPES, F.col("o_orderkey") % 5).alias("feature_type"), none.alias("role"))
        .unionByName(c.select(key("N", "c_custkey").alias("feature_id"), F.lit("Navaid").alias("feature_type"), none.alias("role")))
        .unionByName(cl.select(F.col("id").alias("feature_id"), F.lit("RunwayCentrelinePoint").alias("feature_type"), F.when(F.col("l_linenumber") == 1, "THR").otherwise("DISTHR").alias("role")).distinct())
    )
    vertex = lambda df, id_, prop, shape, seq, lon, lat: df.select(id_.alias("feature_id"), prop.alias("prop"), shape.alias("shape"), seq.cast("int").alias("seq"), lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))
    vertices = (
        vertex(li.filter("l_quantity > 40"), key("O", "l_orderkey"), pick_of(PROPS, F.col("l_partkey") % 5), F.when(F.col("l_suppkey") % 3 == 0, "L").otherwise("P"), F.col("l_linenumber"), F.col("l_partkey") % 360 - 180, F.col("l_suppkey") % 170 - 85)
        .unionByName(vertex(c.filter("c_custkey % 4 <> 0"), key("N", "c_custkey"), F.lit("location"), F.lit("P"), F.lit(1), F.col("c_nationkey"), F.col("c_custkey") % 80))
        .unionByName(vertex(cl, F.col("id"), F.lit("location"), F.lit("P"), F.lit(1), F.col("l_partkey") % 90, F.col("l_suppkey") % 80))
    )
    edges = (
        o.select(key("N", "o_custkey").alias("src_id"), F.lit("Navaid").alias("src_type"), key("O", "o_orderkey").alias("target_id"))
        .unionByName(cl.select(F.col("id").alias("src_id"), F.lit("RunwayCentrelinePoint").alias("src_type"), key("O", "l_orderkey").alias("target_id")))
    )
    return M.points_of(features, vertices, edges).filter(~F.col("feature_id").startswith("C"))


@FAMILY.add("prj_06_labels", """WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS m, p_brand AS b, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS n, 'AD' || p_partkey % 7 AS own, p_size AS s FROM part)
SELECT 'P' || k AS feature_id, CASE m WHEN 0 THEN concat_ws(' ', b, n) WHEN 1 THEN own || ' RWY ' || b WHEN 2 THEN coalesce(n, b) ELSE coalesce(b, n) END AS label,
 CASE m WHEN 0 THEN 'AirportHeliport|' || b WHEN 1 THEN 'Runway|' || own || '|' || b WHEN 2 THEN 'VerticalStructure|' || coalesce(n, '') || '|' || printf('%.3f %.3f', s::DOUBLE, s * 2.0::DOUBLE) ELSE 'Taxiway|' || b END AS natural_key FROM p""")
def _(spark, sf):
    k = F.col("p_partkey")
    props = F.map_filter(F.create_map(F.lit("designator"), F.col("p_brand"), F.lit("name"), F.when(k % 3 != 0, F.col("p_name"))), lambda _, v: v.isNotNull())
    f = table(spark, sf, "part").select(
        F.concat(F.lit("P"), k).alias("feature_id"), pick_of(("AirportHeliport", "Runway", "VerticalStructure", "Taxiway"), k % 4).alias("feature_type"), props.alias("props"),
        F.concat(F.lit("AD"), k % 7).alias("owner"), (F.col("p_size") * 2.0).alias("lon"), F.col("p_size").cast("double").alias("lat"),
    )
    return M.labels(f)


@FAMILY.add("prj_11_obstacle_rows", """SELECT l_orderkey AS obstacle_id, count(*) AS n_parts, max(CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_quantity AS DOUBLE) END) AS elev_m, max(CASE WHEN l_suppkey % 3 = 0 THEN CAST(l_linenumber AS DOUBLE) END) AS hgt_m,
  CASE WHEN bool_or(l_returnflag = 'A') THEN 'YES' WHEN bool_or(l_returnflag = 'N') THEN 'NO' END AS lighted, arg_min(l_linestatus, l_linenumber * 10 + CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END) AS type FROM lineitem GROUP BY 1""")
def _(spark, sf):
    none = F.lit(None).cast("double")
    p = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("obstacle_id"), F.col("l_linenumber").alias("part_no"), F.col("l_linestatus").alias("name"), F.col("l_linestatus").alias("type"),
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_quantity").cast("double")).alias("elev_m"), F.when(F.col("l_suppkey") % 3 == 0, F.col("l_linenumber").cast("double")).alias("hgt_m"),
        none.alias("h_acc_m"), none.alias("v_acc_m"), F.when(F.col("l_returnflag") == "A", "YES").when(F.col("l_returnflag") == "N", "NO").alias("lighted"), F.lit("NO").alias("marked"), none.alias("lon"), none.alias("lat"),
    )
    return M.obstacle_rows(p).select("obstacle_id", "n_parts", "elev_m", "hgt_m", "lighted", "type")


@FAMILY.add("jon_19_procedure_legs", """WITH l AS (SELECT DISTINCT l_orderkey AS proc_id, l_returnflag AS transition, l_linenumber AS seq, l_partkey AS leg_id FROM lineitem WHERE l_quantity > 10),
n AS (SELECT DISTINCT l_orderkey AS proc_id, l_linenumber AS seq, l_partkey AS leg_id FROM lineitem)
SELECT proc_id, transition, seq, leg_id, 'listed' AS origin FROM l UNION ALL SELECT proc_id, NULL, seq, leg_id, 'named' FROM n WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.proc_id = n.proc_id AND l.leg_id = n.leg_id)""")
def _(spark, sf):
    legs = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("proc_id"), F.col("l_returnflag").alias("transition"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("leg_id"), "l_quantity")
    return M.procedure_legs(legs.filter("l_quantity > 10").drop("l_quantity").distinct(), legs.select("proc_id", "seq", "leg_id").distinct())


ENDS_SQL = """d AS (SELECT o_orderkey AS dir_id, o_orderkey // 2 AS runway_id FROM orders),
p AS (SELECT l_orderkey AS dir_id, CASE l_partkey % 5 WHEN 0 THEN 'THR' WHEN 1 THEN 'DISTHR' WHEN 2 THEN 'START' WHEN 3 THEN 'END' ELSE 'MID' END AS role, l_linenumber * 1000000 + l_partkey * 200 + l_suppkey AS point_id,
  CAST(l_partkey AS DOUBLE) AS lon, CAST(l_suppkey AS DOUBLE) AS lat FROM lineitem),
t AS (SELECT *, row_number() OVER (PARTITION BY dir_id ORDER BY CASE role WHEN 'THR' THEN 0 WHEN 'DISTHR' THEN 1 ELSE 2 END, point_id) AS rn FROM p WHERE role IN ('THR', 'DISTHR', 'START')),
e AS (SELECT *, row_number() OVER (PARTITION BY dir_id ORDER BY point_id) AS rn FROM p WHERE role = 'END'),
m AS (SELECT l_orderkey AS dir_id, min(CASE WHEN l_linenumber % 4 = 0 THEN CAST(l_quantity AS DOUBLE) END) AS tora_m, min(CASE WHEN l_linenumber % 4 = 3 THEN CAST(l_quantity AS DOUBLE) END) AS lda_m FROM lineitem GROUP BY 1)"""


PX0, PY0 = position_sql("l_partkey", 0, 100)
QX0, QY0 = position_sql("l_suppkey", 7, 100)
# legs of an order: kinds by part and line; every order that divides by five begins at the origin of its customer
PROC_SQL = f"""l AS (SELECT l_orderkey AS id, l_linenumber AS seq, (l_partkey + l_linenumber) % 6 AS k, {PX0} AS px, {PY0} AS py, {QX0} AS qx, {QY0} AS qy, l_quantity * 7 % 360 AS crs, CASE WHEN l_suppkey % 3 > 0 THEN l_quantity / 4 END AS len, l_partkey AS o1, l_suppkey AS o2, l_quantity AS o3 FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, o1, o2, o3) AS i FROM l)"""


@FAMILY.add("jon_20_procedure_paths", f"""WITH RECURSIVE {PROC_SQL},
w AS (SELECT id, 0::BIGINT AS i, 0 AS seq, NULL::VARCHAR AS way, NULL::DOUBLE AS ax, NULL::DOUBLE AS ay, NULL::DOUBLE AS bx, NULL::DOUBLE AS by_, CASE WHEN id % 5 = 0 THEN 1.5::DOUBLE END AS x, CASE WHEN id % 5 = 0 THEN 2.5::DOUBLE END AS y, 0 AS pts FROM (SELECT DISTINCT id FROM n)
UNION ALL SELECT n.id, n.i, n.seq, v.way, v.ax, v.ay, v.bx, v.by_, CASE WHEN v.way IS NOT NULL THEN v.bx WHEN n.k IN (0, 4) THEN n.px ELSE w.x END, CASE WHEN v.way IS NOT NULL THEN v.by_ WHEN n.k IN (0, 4) THEN n.py ELSE w.y END, v.pts
FROM w JOIN n ON n.id = w.id AND n.i = w.i + 1, LATERAL (SELECT CASE WHEN n.k = 3 THEN 'trajectory' WHEN n.k IN (0, 4) AND w.x IS NOT NULL THEN CASE WHEN n.k = 4 THEN 'arc' ELSE 'line' END WHEN n.k = 1 AND w.x IS NOT NULL THEN 'course' WHEN n.k = 5 THEN 'line' END AS way,
  CASE WHEN n.k IN (3, 5) THEN n.qx ELSE w.x END AS ax, CASE WHEN n.k IN (3, 5) THEN n.qy ELSE w.y END AS ay,
  CASE WHEN n.k = 1 THEN (((w.x + degrees(atan2(sin(radians(n.crs)) * sin(least(coalesce(n.len, 3), 10) / 3440.065) * cos(radians(w.y)), cos(least(coalesce(n.len, 3), 10) / 3440.065) - sin(radians(w.y)) * (sin(radians(w.y)) * cos(least(coalesce(n.len, 3), 10) / 3440.065) + cos(radians(w.y)) * sin(least(coalesce(n.len, 3), 10) / 3440.065) * cos(radians(n.crs))))) + 180) % 360 + 360) % 360 - 180) ELSE n.px END AS bx,
  CASE WHEN n.k = 1 THEN degrees(asin(sin(radians(w.y)) * cos(least(coalesce(n.len, 3), 10) / 3440.065) + cos(radians(w.y)) * sin(least(coalesce(n.len, 3), 10) / 3440.065) * cos(radians(n.crs)))) ELSE n.py END AS by_,
  CASE WHEN n.k = 3 THEN 3 WHEN n.k = 4 THEN 1 + greatest(2, ceil(((({sql_bearing('n.qx', 'n.qy', 'n.px', 'n.py')} - {sql_bearing('n.qx', 'n.qy', 'w.x', 'w.y')}) % 360 + 360) % 360) / 5)) ELSE 2 END::INTEGER AS pts) v)
SELECT id AS proc_id, seq, way, pts AS n, round(ax, 5) AS lon1, round(ay, 5) AS lat1, round(bx, 5) AS lon2, round(by_, 5) AS lat2 FROM w WHERE way IS NOT NULL""")
def _(spark, sf):
    px, py = position("l_partkey", 0, 100)
    qx, qy = position("l_suppkey", 7, 100)
    k = (F.col("l_partkey") + F.col("l_linenumber")) % 6
    point = lambda x, y: F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))
    end, other = point(px, py), point(qx, qy)
    legs = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("proc_id"), F.lit(None).cast("string").alias("transition"), F.col("l_linenumber").cast("int").alias("seq"), F.format_string("%09d/%09d/%03d", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("leg_id"),
        F.when(k == 4, "RF").when(k == 2, "IF").otherwise("TF").alias("leg_type"), F.when(k == 5, other).alias("start"), F.when(k.isin(0, 4, 5), end).alias("end"), F.when(k == 4, other).alias("centre"), F.lit(True).alias("clockwise"),
        F.when(k == 1, (F.col("l_quantity") * 7 % 360).cast("double")).alias("course"), F.when(F.col("l_suppkey") % 3 > 0, (F.col("l_quantity") / 4).cast("double")).alias("length_nm"),
        F.when(k == 3, F.array(other, point((px + qx) / 2, (py + qy) / 2), end)).alias("trajectory"), F.when(F.col("l_orderkey") % 5 == 0, point(F.lit(1.5), F.lit(2.5))).alias("origin"),
    )
    rows = M.procedure_paths(legs)
    first, last = F.element_at("path", 1), F.element_at("path", -1)
    r = lambda p, axis, name: F.round(p[axis], 5).alias(name)
    return rows.select("proc_id", "seq", "way", F.size("path").alias("n"), r(first, "lon", "lon1"), r(first, "lat", "lat1"), r(last, "lon", "lon2"), r(last, "lat", "lat2"))


@FAMILY.add("jon_21_runway_ends", f"""WITH {ENDS_SQL} SELECT d.dir_id, t.lon AS thr_lon, t.lat AS thr_lat, coalesce(e.lon, o.lon) AS end_lon, coalesce(e.lat, o.lat) AS end_lat, tora_m, lda_m
FROM d LEFT JOIN t ON t.dir_id = d.dir_id AND t.rn = 1 LEFT JOIN e ON e.dir_id = d.dir_id AND e.rn = 1 LEFT JOIN m ON m.dir_id = d.dir_id
LEFT JOIN t o ON o.rn = 1 AND o.dir_id = d.dir_id + CASE WHEN d.dir_id % 2 = 0 THEN 1 ELSE -1 END""")
def _(spark, sf):
    li, k = table(spark, sf, "lineitem"), F.col("o_orderkey")
    d = table(spark, sf, "orders").select(k.alias("dir_id"), F.floor(k / 2).alias("runway_id"), F.lit("09").alias("designator"))
    role = pick_of(("THR", "DISTHR", "START", "END", "MID"), F.col("l_partkey") % 5)
    at = F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey") * 200 + F.col("l_suppkey")
    p = li.select(F.col("l_orderkey").alias("dir_id"), at.alias("point_id"), role.alias("role"), F.col("l_partkey").cast("double").alias("lon"), F.col("l_suppkey").cast("double").alias("lat"), F.lit(1.0).alias("elev_m"))
    m = li.select(F.col("l_orderkey").alias("dir_id"), pick_of(M.DECLARED, F.col("l_linenumber") % 4).alias("kind"), F.col("l_quantity").cast("double").alias("metres"))
    return M.runway_ends(d, p, m).select("dir_id", "thr_lon", "thr_lat", "end_lon", "end_lat", "tora_m", "lda_m")


@FAMILY.add("jon_36_procedure_places", """WITH r AS (SELECT DISTINCT 'P' || l_orderkey AS proc_id, l_suppkey AS s, l_partkey AS p FROM lineitem)
SELECT DISTINCT proc_id, CASE WHEN s % 2 = 0 THEN 'aerodrome' ELSE 'runway' END AS kind, 'S' || s AS target_id, CASE WHEN s % 5 <> 0 THEN 'home' ELSE 'peer' || s % 3 END AS found_in FROM r""")
def _(spark, sf):
    li, s = table(spark, sf, "lineitem"), F.col("s_suppkey")
    kind = F.when(s % 2 == 0, "AirportHeliport").otherwise("RunwayDirection")
    all_ = table(spark, sf, "supplier").select(F.concat(F.lit("S"), s).alias("feature_id"), kind.alias("feature_type"), F.lit(None).cast("string").alias("gml_id"), F.lit(False).alias("gone"), s.alias("s"))
    refs = li.select(F.lit("home").alias("dataset_id"), F.concat(F.lit("P"), "l_orderkey").alias("src_id"), F.lit("airport").alias("prop"), F.concat(F.lit("S"), "l_suppkey").alias("ref"), F.lit(1).alias("ref_no"))
    home = all_.filter("s % 5 <> 0").drop("s").withColumn("dataset_id", F.lit("home"))
    # every feature also lies in later data sets; the first one in order counts
    peers = all_.select(F.concat(F.lit("peer"), F.col("s") % 3).alias("dataset_id"), F.lit(1).alias("dataset_order"), "feature_id", "feature_type").unionByName(
        all_.select(F.lit("late").alias("dataset_id"), F.lit(2).alias("dataset_order"), "feature_id", "feature_type"))
    return M.procedure_places(refs, home, peers)


@FAMILY.add("snk_08_consolidate_cycle", f"""WITH {SLICES_SQL}, w AS (SELECT *, CASE WHEN life_end <= TIMESTAMP '2024-01-25' THEN 'withdrawn' WHEN valid_end <= TIMESTAMP '2024-01-25' THEN 'ended' ELSE 'kept' END AS why FROM slices),
k AS (SELECT count(*) AS n, count(DISTINCT (feature_id, interp, seq, corr)) AS d FROM w WHERE why = 'kept')
SELECT why AS reason, count(*) AS n FROM w WHERE why <> 'kept' GROUP BY 1 UNION ALL SELECT 'repeated', n - d FROM k UNION ALL SELECT 'written', d FROM k""")
def _(spark, sf):
    once, tally = M.consolidate(event_slices(spark, sf).withColumn("gone", F.lit(False)), "2024-01-25 00:00:00")
    return tally.unionByName(once.agg(F.count(F.lit(1)).alias("n")).select(F.lit("written").alias("reason"), "n"))


@FAMILY.add("prj_10_pick", """SELECT o_custkey AS ad_id, string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) FILTER (o_orderstatus = 'F') AS "F", string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) FILTER (o_orderstatus = 'O') AS "O"
FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey < 5 AND o_orderstatus IN ('F', 'O') GROUP BY 1""")
def _(spark, sf):
    v = table(spark, sf, "orders").select(F.col("o_custkey").alias("ad_id"), F.col("o_orderstatus").alias("item"), F.col("o_orderpriority").alias("value"))
    return M.pick(v, table(spark, sf, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("ad_id")), ["F", "O"])


@FAMILY.add("prj_27_notes", """SELECT l_orderkey AS feature_id, l_returnflag AS text, min(l_linenumber) AS note_no, 'REMARK' AS purpose FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2""")
def _(spark, sf):
    a = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("feature_id"), F.col("l_linenumber").alias("note_no"), F.when(F.col("l_linestatus") == "F", "Surface").alias("prop"), F.lit(None).cast("string").alias("purpose"),
        F.concat(F.lit(" "), "l_returnflag").alias("text"),
    )
    return M.notes(a, "surface")


# every subject with every condition, and letters of the clerks that are in neither table
_SUBJECTS, _CONDITIONS = list(N.SUBJECT_TEXT), list(N.CONDITION_TEXT)
_PAIRS = lambda table: ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in table.items())


@FAMILY.add("fun_19_qcode_text", f"""WITH s(k, t) AS (VALUES {_PAIRS(N.SUBJECT_TEXT)}), c(k, t) AS (VALUES {_PAIRS(N.CONDITION_TEXT)}),
o AS (SELECT o_orderkey AS key, o_orderkey % 9 = 0 AS odd, CASE WHEN o_orderkey % 9 = 0 THEN upper(substr(regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g'), 1, 2)) ELSE {_SUBJECTS}[o_orderkey % {len(_SUBJECTS)} + 1] END AS a, {_CONDITIONS}[o_custkey % {len(_CONDITIONS)} + 1] AS b FROM orders)
SELECT key, coalesce(s.t, a) || ' ' || coalesce(c.t, b) AS text FROM o LEFT JOIN s ON s.k = a LEFT JOIN c ON c.k = b""")
def _(spark, sf):
    k = F.col("o_orderkey")
    letters = F.upper(F.substring(F.regexp_replace("o_orderpriority", "[^A-Za-z]", ""), 1, 2))
    subject = F.when(k % 9 == 0, letters).otherwise(pick_of(_SUBJECTS, k % len(_SUBJECTS)))
    code = F.concat(F.when(k % 2 == 0, "Q").otherwise("q"), subject, F.lower(pick_of(_CONDITIONS, F.col("o_custkey") % len(_CONDITIONS))))
    return table(spark, sf, "orders").select(k.alias("key"), N.qcode_text(code).alias("text"))


@FAMILY.add("fun_20_texts", """SELECT p_partkey AS key, CASE p_partkey % 5 WHEN 0 THEN 'FL ' || p_size WHEN 1 THEN p_size || ' ft AMSL' WHEN 2 THEN 'GND' WHEN 3 THEN 'UNL' ELSE '' END AS limit_text,
  printf('%.3f MHz', 118 + p_size / 40.0::DOUBLE) AS frequency, CASE WHEN p_partkey % 3 = 0 THEN 'EXC ' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN 'MON-FRI ' ELSE '' END || CASE WHEN p_size % 2 = 0 THEN 'H24' ELSE '0600-1830' END AS hours FROM part""")
def _(spark, sf):
    k, z = F.col("p_partkey"), F.col("p_size")
    s = table(spark, sf, "part").select(
        k.alias("key"), F.when(k % 5 < 2, z.cast("string")).when(k % 5 == 2, "0").when(k % 5 == 3, "unl").alias("v"), pick_of(("FL", "FT", "M", "FT", "FT"), k % 5).alias("u"), pick_of(("STD", "MSL", "SFC", "MSL", "MSL"), k % 5).alias("r"),
        (F.lit(118.0) + z / 40.0).alias("f"), F.when(k % 2 == 0, "MON").otherwise("ANY").alias("day"), F.lit("FRI").alias("til"), F.when(z % 2 == 0, "00:00").otherwise("06:00").alias("a"),
        F.when(z % 2 == 0, "24:00").otherwise("18:30").alias("b"), F.when(k % 3 == 0, "YES").alias("x"),
    ).withColumn("til", F.when(F.col("day") == "MON", F.col("til")))
    return s.select("key", M.limit_text("v", "u", "r").alias("limit_text"), M.frequency_text("f", F.lit("MHZ")).alias("frequency"), M.timesheet_text("day", "til", "a", "b", "x").alias("hours"))


# a point is a corner of a box-shaped cloud: the hull's bounds and its area are those of the box
@FAMILY.add("fun_16_hull_by_group", """SELECT l_suppkey AS g, min(l_quantity)::DOUBLE AS lon0, max(l_quantity)::DOUBLE AS lon1, min(l_extendedprice / 1000)::DOUBLE AS lat0, max(l_extendedprice / 1000)::DOUBLE AS lat1, 0::BIGINT AS n_outside FROM lineitem GROUP BY 1""")
def _(spark, sf):
    cloud = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_quantity").cast("double").alias("lon"), (F.col("l_extendedprice") / 1000).cast("double").alias("lat"))
    hull = M.hull_by_group(cloud, "g")
    box = hull.groupBy("g").agg(F.min("lon").alias("lon0"), F.max("lon").alias("lon1"), F.min("lat").alias("lat0"), F.max("lat").alias("lat1"))
    # no point lies to the right of an edge
    edges = P.ring_edges(hull, ["g"]).select("g", "lon1", "lat1", "lon2", "lat2")
    turn = (F.col("lon2") - F.col("lon1")) * (F.col("lat") - F.col("lat1")) - (F.col("lat2") - F.col("lat1")) * (F.col("lon") - F.col("lon1"))
    outside = cloud.join(edges, "g").groupBy("g").agg(F.count_if(turn < -1e-6).alias("n_outside"))
    return box.withColumnsRenamed({"lon1": "_e"}).withColumnRenamed("_e", "lon1").join(outside, "g")


@FAMILY.add("prj_18_notam_areas", """SELECT o_orderkey AS key, 'EAR' || o_orderkey % 90 AS desig, CASE WHEN o_orderkey % 3 = 0 THEN 'off' ELSE 'on' END AS activation, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 5 ELSE 73 END AS INTEGER) AS n FROM orders""")
def _(spark, sf):
    k = F.col("o_orderkey")
    d = (k % 60).cast("int")
    shape = F.when(k % 2 == 0, F.format_string("%02d1000N 0200000E - %02d2000N 0200000E - %02d2000N 0201000E - %02d1000N 0201000E", d, d, d, d)).otherwise(F.format_string("5 NM RADIUS CENTRED ON %02d1000N 0200000E", d))
    text = F.concat(F.lit("RESTRICTED AREA EA R-"), k % 90, F.when(k % 3 == 0, " NOT ACTIVE ").otherwise(" ACTIVE "), shape)
    f = table(spark, sf, "orders").select(
        k.cast("string").alias("id"), F.lit("airspace").alias("cat"), F.lit("RR").alias("subj"), F.lit("").alias("cond"), text.alias("text"), F.lit(0.0).alias("lower_m"), F.lit(1.0).alias("upper_m"),
        F.lit(None).cast("double").alias("q_lon"), F.lit(None).cast("double").alias("q_lat"), F.lit(None).cast("int").alias("q_radius_nm"),
    )
    return N.notam_areas(f).select(F.col("id").cast("long").alias("key"), "desig", "activation", F.size("ring").alias("n"))


@FAMILY.add("win_12_along_profile", """WITH l AS (SELECT o_custkey AS proc_id, o_orderkey AS seq, CASE WHEN o_orderkey % 7 = 3 THEN 'FAF' END AS role, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 11 AS DOUBLE) END AS len FROM orders),
m AS (SELECT proc_id, min(seq) FILTER (role = 'FAF') AS faf, min(seq) AS a, max(seq) AS z FROM l GROUP BY 1), b AS (SELECT proc_id, max(seq) AS i FROM l JOIN m USING (proc_id) WHERE seq < faf GROUP BY 1)
SELECT proc_id, seq, coalesce(sum(coalesce(len, 0)) OVER (PARTITION BY proc_id ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS to_threshold_nm,
  coalesce(role, CASE WHEN seq = i THEN 'IF' WHEN seq = z THEN 'MAPT' WHEN seq = a THEN 'IAF' END) AS role FROM l JOIN m USING (proc_id) LEFT JOIN b USING (proc_id)""")
def _(spark, sf):
    k, none = F.col("o_orderkey"), F.lit(None).cast("double")
    legs = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("proc_id"), k.alias("seq"), k.cast("string").alias("fix"), F.when(k % 7 == 3, "FAF").alias("role"), F.when(k % 5 != 0, (k % 11).cast("double")).alias("length_nm"), none.alias("lower_ft"), none.alias("upper_ft"),
    )
    return E.along_profile(legs).select("proc_id", "seq", "to_threshold_nm", "role")


@FAMILY.add("job_22_airspace_table", f"""WITH {AREA_SQL}, n AS (SELECT id, CAST(CAST(dw / 0.5 AS INTEGER) * CAST(dh / 0.5 AS INTEGER) AS BIGINT) AS n_cells FROM areas WHERE id % 3 <> 0)
SELECT areas.id AS airspace_id, areas.type, coalesce(n_cells, 0) AS n_cells, CASE WHEN areas.id % 4 <> 0 THEN CAST(lo AS DOUBLE) END AS lo_ft, CASE WHEN areas.id % 4 <> 0 THEN CAST(up AS DOUBLE) END AS up_ft FROM areas LEFT JOIN n USING (id)""")
def _(spark, sf):
    # airspace of every third id has no shape, of every fourth no limits
    areas = supplier_areas(spark, sf)
    spans = P.row_spans(_box_edges(areas), ["airspace_id", "piece_no"], CELL)
    cells = P.spans_to_cells(spans, ["airspace_id"], CELL).withColumnRenamed("airspace_id", "volume_id")
    k, none = F.col("airspace_id"), F.lit(None).cast("long").alias("contributor_id")
    comp = areas.filter(k % 3 != 0).select("airspace_id", F.lit(1).alias("step"), F.lit("BASE").alias("op"), k.alias("volume_id"), none)
    limits = areas.filter(k % 4 != 0).select("airspace_id", F.lit("BASE").alias("op"), F.col("lo_ft").cast("double"), F.col("up_ft").cast("double"), none, F.lit(None).cast("string").alias("dependency"))
    return E.airspace_table(areas.select("airspace_id", "type"), cells, comp, limits).select("airspace_id", "type", "n_cells", "lo_ft", "up_ft")


@FAMILY.add("job_23_notam_effects", f"""WITH {AT_SQL}, n AS (SELECT c.c_custkey AS k, e.elev AS g, CASE WHEN c.c_custkey % 2 = 0 THEN 30.0::DOUBLE END AS h, CASE WHEN c.c_custkey % 3 = 0 THEN 900.0::DOUBLE END AS el FROM customer c LEFT JOIN at_ e USING (c_custkey))
SELECT 'N' || k || '#0' AS obstacle_id, 'notam' AS origin, round(coalesce(el, g + h), 4) AS elev_m, round(coalesce(h, CASE WHEN el IS NOT NULL AND g IS NOT NULL THEN greatest(0.0, el - g) END), 4) AS hgt_m FROM n
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'published', CAST(p_size AS DOUBLE), 5.0::DOUBLE FROM part""")
def _(spark, sf):
    cells, k = part_terrain(spark, sf), F.col("c_custkey")
    n = terrain_points(spark, sf).select(F.concat(F.lit("N"), k).alias("id"), F.lit(0).alias("n"), "lon", "lat", F.when(k % 3 == 0, 900.0).alias("elev_m"), F.when(k % 2 == 0, 30.0).alias("hgt_m"))
    o = table(spark, sf, "part").select(F.col("p_partkey").alias("obstacle_id"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"), F.col("p_size").cast("double").alias("elev_m"), F.lit(5.0).alias("hgt_m"))
    out = E.notam_effects(n, o, cells, part_grids(cells))
    return out.select("obstacle_id", "origin", F.round("elev_m", 4).alias("elev_m"), F.round("hgt_m", 4).alias("hgt_m"))


@FAMILY.add("jon_27_event_effects", """WITH t AS (SELECT l_suppkey AS event_id, l_orderkey AS feature_id, l_returnflag AS prop, max(l_linestatus) AS value FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1, 2, 3),
b AS (SELECT l_orderkey AS feature_id, l_returnflag AS prop, max(l_linestatus) AS old FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2),
c AS (SELECT * FROM t LEFT JOIN b USING (feature_id, prop) WHERE old IS NULL OR old <> value)
SELECT event_id, feature_id, count(*) AS n_changed, string_agg(prop || ': ' || coalesce(old, 'not given') || ' → ' || value, chr(10) ORDER BY prop) AS lines FROM c GROUP BY 1, 2""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("event_id"), F.col("l_orderkey").alias("feature_id"), F.col("l_returnflag").alias("prop"), F.col("l_linestatus").alias("value"), "l_linenumber")
    events = table(spark, sf, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("event_id"))
    return E.event_effects(events, li.drop("l_linenumber"), li.filter("l_linenumber = 1").select("feature_id", "prop", "value"))
