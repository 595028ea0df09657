"""JOB-11..17/19/26, WIN-05/06/10, AGG-15/18, FUN-04 on parts as obstacles, suppliers as runway ends, orders as routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import rounded
from ..operators import polygons as P
from ..plans import route as R
from ..plans import runway as W
from . import Family
from .spatial import nation_rings, part_grids, part_terrain
from .tables import position, position_sql, sql_bearing, sql_distance, table

FAMILY = Family()
RE = 6371008.8
MPD = RE * 3.141592653589793 / 180.0
SPREAD = 200


def obstacles(spark, sf, spread=SPREAD):
    lon, lat = position("p_partkey", 3, spread)
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("obstacle_id"), (lon + 20.0003).alias("lon"), (lat + 40.0003).alias("lat"), (F.col("p_size") * 8.0).alias("elev_m"),
        F.when(F.col("p_partkey") % 9 != 0, F.col("p_size") * 3.0).alias("hgt_m"),
    )


OX, OY = position_sql("p_partkey", 3, SPREAD)
EX, EY = position_sql("s_suppkey", 11, SPREAD)
OBS_SQL = f"obs AS (SELECT p_partkey AS obstacle_id, {OX} + 20.0003 AS lon, {OY} + 40.0003 AS lat, p_size * 8.0 AS elev_m, CASE WHEN p_partkey % 9 <> 0 THEN p_size * 3.0 END AS hgt_m FROM part)"
ENDS_SQL = f"ends AS (SELECT s_suppkey AS end_id, {EX} + 20.0 AS lon0, {EY} + 40.0 AS lat0, CAST(s_suppkey % 40 AS DOUBLE) AS elev0, CAST(s_suppkey * 31 % 360 AS DOUBLE) AS trk FROM supplier)"


def sql_dest(lon: str, lat: str, brg: str, dist: str, radius: float = RE) -> tuple[str, str]:
    y = f"degrees(asin(greatest(-1, least(1, sin(radians({lat})) * cos({dist} / {radius}) + cos(radians({lat})) * sin({dist} / {radius}) * cos(radians({brg}))))))"
    s = f"(sin(radians({lat})) * cos({dist} / {radius}) + cos(radians({lat})) * sin({dist} / {radius}) * cos(radians({brg})))"
    x = f"({lon} + degrees(atan2(sin(radians({brg})) * sin({dist} / {radius}) * cos(radians({lat})), cos({dist} / {radius}) - sin(radians({lat})) * {s})))"
    return x, y


def axis_sql(brg: str, dist: float) -> str:
    x, y = sql_dest("lon0", "lat0", brg, str(dist))
    return f"""ax AS (SELECT *, ({x} - lon0) * cos(radians(lat0)) * {MPD} AS px, ({y} - lat0) * {MPD} AS py FROM ends),
un AS (SELECT *, px / sqrt(px * px + py * py) AS ux, py / sqrt(px * px + py * py) AS uy FROM ax),
fr AS (SELECT *, (lon - lon0) * cos(radians(lat0)) * {MPD} AS dx, (lat - lat0) * {MPD} AS dy FROM obs JOIN un ON abs(lat - lat0) < 0.3 AND abs(lon - lon0) < 0.4),
st AS (SELECT *, dx * ux + dy * uy AS s, dx * uy - dy * ux AS x FROM fr)"""


def takeoff_ends(spark, sf, spread=SPREAD):
    lon, lat = position("s_suppkey", 11, spread)
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("end_id"), (lon + 20.0).alias("der_lon"), (lat + 40.0).alias("der_lat"), (k % 40).cast("double").alias("der_elev_m"),
        (k * 31 % 360).cast("double").alias("track"), (k % 4 + 1).alias("code"),
    )


TAKEOFF_SQL = f"""{OBS_SQL}, {ENDS_SQL}, {axis_sql('trk', 15000.0)},
t0 AS (SELECT end_id, obstacle_id, s, x, elev_m - elev0 AS h, s <= 10000 AND abs(x) <= least(90 + 0.125 * s, 900) AS in_a, s <= 10000 AND abs(x) <= least(90 + 0.125 * s, 600) AS in_n,
  abs(x) <= 150 + tan(radians(15)) * s AS in_d FROM st WHERE s > 0.5 AND s <= 15000),
t1 AS (SELECT *, h - 0.012 * s AS pen, h / s AS req, 35 * 0.3048 + 0.016 * s - h AS net, h - (5 + 0.025 * s) AS dpen FROM t0 WHERE in_a OR in_n OR in_d),
t2 AS (SELECT *, NOT in_n OR net >= 35 * 0.3048 AS net_ok, CASE WHEN in_d AND dpen > 0 THEN greatest(0.033, (h - 5) / s + 0.008) END AS pdg, in_d AND dpen > 0 AND h <= 60 AS close_in,
  CASE WHEN in_a AND pen > 0 THEN h - 0.012 * greatest(s, 300) END AS g FROM t1),
takeoff AS (SELECT *, g IS NOT NULL AND g > coalesce(max(g) OVER (PARTITION BY end_id ORDER BY s, obstacle_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e18) AS charted FROM t2)"""


@FAMILY.add("job_12_takeoff", f"""WITH {TAKEOFF_SQL} SELECT end_id, obstacle_id, round(s, 2) AS s, round(x, 2) AS x, round(pen, 4) AS type_a_pen, round(req, 7) AS required_gradient,
  round(net, 4) AS net_clearance, net_ok, round(pdg, 7) AS pdg, close_in, charted FROM takeoff""")
def _(spark, sf):
    t = W.takeoff(obstacles(spark, sf), takeoff_ends(spark, sf))
    r = lambda c, n: rounded(F.col(c), n).alias(c)
    return t.select("end_id", "obstacle_id", r("s", 2), r("x", 2), r("type_a_pen", 4), r("required_gradient", 7), r("net_clearance", 4), "net_ok", r("pdg", 7), "close_in", "charted")


@FAMILY.add("win_06_shadow_rule", f"WITH {TAKEOFF_SQL} SELECT end_id, obstacle_id, charted, NOT charted AS shadow FROM takeoff WHERE g IS NOT NULL")
def _(spark, sf):
    t = W.takeoff(obstacles(spark, sf), takeoff_ends(spark, sf))
    return t.filter("charted or shadow").select("end_id", "obstacle_id", "charted", "shadow")


def approach_ends(spark, sf):
    k = F.col("end_id")
    e = takeoff_ends(spark, sf).select(
        "end_id", F.col("der_lon").alias("thr_lon"), F.col("der_lat").alias("thr_lat"), F.col("der_elev_m").alias("thr_elev_m"), F.col("track").alias("course"),
        F.lit(3.0).alias("gpa"), F.lit(15.0).alias("tch_m"), F.when(k % 3 == 0, "P").when(k % 3 == 1, "NP").otherwise("NI").alias("app_type"), (k % 2 + 3).alias("code"),
    )
    return W.with_approach_surface(e)


APPROACH_SQL = f"""{OBS_SQL}, {ENDS_SQL}, {axis_sql('trk + 180', 20000.0)},
par AS (SELECT *, CASE WHEN end_id % 3 = 2 THEN 150 ELSE 280 END AS ie, CASE WHEN end_id % 3 = 2 THEN 0.10 ELSE 0.15 END AS div, CASE WHEN end_id % 3 < 2 THEN 0.02 WHEN end_id % 2 = 0 THEN 0.0333 ELSE 0.025 END AS s1,
  CASE WHEN end_id % 3 < 2 THEN 3600 ELSE 0 END AS l2, CASE WHEN end_id % 3 < 2 THEN 8400 ELSE 0 END AS lh FROM st),
a0 AS (SELECT *, elev_m - elev0 AS h, s >= 60 AND abs(x) <= ie / 2.0 + div * (s - 60) AS in_app, s >= 60 AND s <= 8000 AND abs(x) <= 75 + 0.15 * (s - 60) AS in_vis FROM par WHERE s >= 0 AND s <= 3060 + l2 + lh),
a1 AS (SELECT *, CASE WHEN in_app THEN CASE WHEN s - 60 <= 3000 THEN (s - 60) * s1 WHEN s - 60 <= 6600 THEN least(150, 3000 * s1 + (s - 3060) * 0.025) ELSE least(150, 3000 * s1 + 90) END END AS allowed
  FROM a0 WHERE in_app OR in_vis OR (abs(x) <= 300 AND s <= 2000)),
app AS (SELECT *, h - allowed AS pen, 15 + s * tan(radians(3.0)) - h AS glide, CASE WHEN in_vis THEN h - (s - 60) * tan(radians(3.0 - 1.12)) END AS vpen,
  CASE WHEN h - allowed > 0 THEN (h - allowed) / CASE WHEN s - 60 <= 3000 THEN s1 ELSE 0.025 END ELSE 0 END AS displacement FROM a1)"""


@FAMILY.add("job_13_approach", f"""WITH {APPROACH_SQL} SELECT end_id, obstacle_id, round(s, 2) AS s, round(-x, 2) AS x, round(allowed, 4) AS allowed, round(pen, 4) AS pen, round(glide, 4) AS glide_clearance,
  round(vpen, 4) AS visual_pen, round(displacement, 2) AS displacement FROM app""")
def _(spark, sf):
    a = W.approach(obstacles(spark, sf), approach_ends(spark, sf))
    r = lambda c, n: rounded(F.col(c), n).alias(c)
    return a.select("end_id", "obstacle_id", r("s", 2), r("x", 2), r("allowed", 4), r("pen", 4), r("glide_clearance", 4), r("visual_pen", 4), r("displacement", 2))


@FAMILY.add("job_14_runway_impact", f"""WITH {TAKEOFF_SQL}, {APPROACH_SQL.split(ENDS_SQL + ', ')[1].replace('ax AS', 'ax2 AS').replace('FROM ax)', 'FROM ax2)').replace('un AS', 'un2 AS').replace('JOIN un ', 'JOIN un2 ').replace('fr AS', 'fr2 AS').replace('FROM fr)', 'FROM fr2)').replace('st AS', 'st2 AS').replace('FROM st)', 'FROM st2)')},
cut AS (SELECT end_id, max((h - (s - 60) * sl) / sl) AS cut FROM (SELECT *, CASE WHEN end_id % 4 + 1 >= 3 THEN 0.02 WHEN end_id % 4 + 1 = 2 THEN 0.04 ELSE 0.05 END AS sl FROM takeoff)
  WHERE s >= 60 AND h - (s - 60) * sl > 0 AND abs(x) <= 90 + 0.125 * (s - 60) GROUP BY 1),
dis AS (SELECT end_id, max(displacement) AS d FROM app GROUP BY 1)
SELECT e.end_id, round(coalesce(cut, 0), 2) AS cut_m, round(coalesce(d, 0), 2) AS displacement, round(CASE WHEN e.end_id % 10 = 0 THEN 0 ELSE greatest(0, 3000 - coalesce(cut, 0)) END, 2) AS tora_left,
  round(CASE WHEN e.end_id % 10 = 0 THEN 0 ELSE greatest(0, 2800 - coalesce(d, 0)) END, 2) AS lda_left, e.end_id % 10 = 0 AS closed FROM ends e LEFT JOIN cut USING (end_id) LEFT JOIN dis USING (end_id)""")
def _(spark, sf):
    ends = takeoff_ends(spark, sf).withColumns({"tora": F.lit(3000.0), "toda": F.lit(3100.0), "lda": F.lit(2800.0)})
    obs = obstacles(spark, sf)
    closed = ends.filter("end_id % 10 = 0")
    out = W.runway_impact(ends, W.takeoff(obs, ends), W.approach(obs, approach_ends(spark, sf)), closed)
    r = lambda c: F.round(c, 2).alias(c)
    return out.select("end_id", r("cut_m"), r("displacement"), r("tora_left"), r("lda_left"), "closed")


def _runways(spark, sf, spread=SPREAD):
    """One runway of 2400 m per supplier, its aerodrome at the middle."""
    e = takeoff_ends(spark, sf, spread)
    k, nm = F.col("end_id"), 1200.0 / 1852.0
    from ..functions.geo import dest_lat, dest_lon

    return e.select(
        k.alias("ad_id"), k.alias("rwy_id"), F.col("der_lon").alias("arp_lon"), F.col("der_lat").alias("arp_lat"), F.col("der_elev_m").alias("field_elev_m"),
        dest_lon("der_lon", "der_lat", F.col("track") + 180.0, F.lit(nm)).alias("a_lon"), dest_lat("der_lat", F.col("track") + 180.0, F.lit(nm)).alias("a_lat"),
        dest_lon("der_lon", "der_lat", F.col("track"), F.lit(nm)).alias("b_lon"), dest_lat("der_lat", F.col("track"), F.lit(nm)).alias("b_lat"),
        F.col("der_elev_m").alias("a_elev_m"), (F.col("der_elev_m") + 6).alias("b_elev_m"), F.when(k % 3 == 0, "P").when(k % 3 == 1, "NP").otherwise("NI").alias("a_type"),
        F.lit("NI").alias("b_type"), F.lit(2400.0).alias("length_m"), F.lit(None).cast("double").alias("strip_m"),
    )


@FAMILY.add("job_11_surfaces_check")
def _(spark, sf):
    r = _runways(spark, sf)
    ads = r.select("ad_id", "arp_lon", "arp_lat", "field_elev_m")
    return W.surfaces_check(obstacles(spark, sf), W.prepare_runways(r.drop("arp_lon", "arp_lat", "field_elev_m"), ads))


@FAMILY.add("job_26_surface_polygons")
def _(spark, sf):
    r = _runways(spark, sf)
    ads = r.select("ad_id", "arp_lon", "arp_lat", "field_elev_m")
    return W.surface_polygons(W.prepare_runways(r.drop("arp_lon", "arp_lat", "field_elev_m"), ads))


WIDE = 60  # a larger region: an obstacle lies in the reach of a few aerodromes only


def _etod(spark, sf):
    r = _runways(spark, sf, WIDE)
    r = r.select(
        "ad_id", "rwy_id", F.lit(1).alias("rwy_no"), "arp_lon", "arp_lat", "a_lon", "a_lat", "b_lon", "b_lat", "a_elev_m", "b_elev_m", F.lit(150.0).alias("strip_half_m"),
        F.lit(60.0).alias("ext_m"), F.lit(0.0).alias("cwy_a_m"), F.lit(200.0).alias("cwy_b_m"), (F.col("ad_id") % 2 == 0).alias("prec_a"), F.lit(False).alias("prec_b"),
    )
    return W.etod_classify(obstacles(spark, sf, WIDE), r)


EA = sql_dest("lon0", "lat0", "(trk + 180)", str(1200 / 1852.0), 3440.065)
EB = sql_dest("lon0", "lat0", "trk", str(1200 / 1852.0), 3440.065)
WIDE_OBS = OBS_SQL.replace(OX, position_sql("p_partkey", 3, WIDE)[0]).replace(OY, position_sql("p_partkey", 3, WIDE)[1])
WIDE_ENDS = ENDS_SQL.replace(EX, position_sql("s_suppkey", 11, WIDE)[0]).replace(EY, position_sql("s_suppkey", 11, WIDE)[1])
ETOD_SQL = f"""{WIDE_OBS}, {WIDE_ENDS}, rw AS (SELECT *, ({EA[0]} - lon0) * cos(radians(lat0)) * {MPD} AS axm, ({EA[1]} - lat0) * {MPD} AS aym, ({EB[0]} - lon0) * cos(radians(lat0)) * {MPD} AS bxm, ({EB[1]} - lat0) * {MPD} AS bym FROM ends),
rl AS (SELECT *, sqrt(power(bxm - axm, 2) + power(bym - aym, 2)) AS L FROM rw),
q AS (SELECT end_id AS ad_id, obstacle_id, elev_m, hgt_m, elev0, L, ((lon - lon0) * cos(radians(lat0)) * {MPD} - axm) AS dx, ((lat - lat0) * {MPD} - aym) AS dy, (bxm - axm) / L AS ux, (bym - aym) / L AS uy,
  {sql_distance('lon0', 'lat0', 'lon', 'lat', RE)} AS arp FROM obs JOIN rl ON {sql_distance('lon0', 'lat0', 'lon', 'lat')} <= {55000 * 1.01 / 1852}),
tc AS (SELECT *, dx * ux + dy * uy AS t, abs(-dx * uy + dy * ux) AS c FROM q),
d AS (SELECT *, CASE WHEN t < -60 THEN -60 - t WHEN t > L + 200 THEN t - L - 200 ELSE 0 END AS dt FROM tc),
d2 AS (SELECT *, sqrt(dt * dt + power(greatest(0, c - 150), 2)) AS d2a, elev0 + 6 * greatest(0, least(L, t)) / L AS el FROM d),
ar AS (SELECT *, CASE WHEN d2a = 0 THEN '2a' WHEN dt > 0 AND dt <= 10000 AND c <= 150 + 0.15 * dt THEN '2b' WHEN d2a <= 10000 THEN '2c' WHEN arp <= 45000 THEN '2d' ELSE '1' END AS area FROM d2),
sf AS (SELECT *, CASE area WHEN '2a' THEN el + 3 WHEN '2b' THEN CASE WHEN t < 0 THEN elev0 ELSE elev0 + 6 END + 0.012 * dt WHEN '2c' THEN el + 0.012 * d2a END AS surf FROM ar),
reached AS (SELECT *, CASE WHEN surf IS NOT NULL THEN elev_m - surf > 0 ELSE hgt_m >= 100 END AS required,
  CASE WHEN d2a = 0 AND c <= 90 AND t >= 0 AND t <= L THEN '3' WHEN ad_id % 2 = 0 AND t < 0 AND t >= -900 AND c <= 60 THEN '4' ELSE area END AS strictest FROM sf),
etod AS (SELECT obstacle_id, ad_id, area, surf, required, strictest FROM reached
  UNION ALL SELECT obstacle_id, NULL, '1', NULL, hgt_m >= 100, '1' FROM obs WHERE obstacle_id NOT IN (SELECT obstacle_id FROM reached))"""


@FAMILY.add("job_15_etod_classify", f"WITH {ETOD_SQL} SELECT obstacle_id, ad_id, area, round(surf, 3) AS surface_m, required, strictest FROM etod")
def _(spark, sf):
    return _etod(spark, sf).select("obstacle_id", "ad_id", "area", F.round("surface_m", 3).alias("surface_m"), "required", "strictest")


@FAMILY.add("agg_18_etod_area_counts", f"""WITH {ETOD_SQL}, acc AS (SELECT p_partkey AS obstacle_id, CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 11 END AS h FROM part),
j AS (SELECT *, CASE strictest WHEN '1' THEN 50 WHEN '3' THEN 0.5 WHEN '4' THEN 2.5 ELSE 5 END AS rh, CASE strictest WHEN '1' THEN 30 WHEN '3' THEN 0.5 WHEN '4' THEN 1 ELSE 3 END AS rv FROM etod JOIN acc USING (obstacle_id))
SELECT area, count(*) AS n, count(*) FILTER (required) AS n_required, count(*) FILTER (required AND h <= rh AND h <= rv) AS n_accurate, count(*) FILTER (required AND h IS NULL) AS n_unknown FROM j GROUP BY 1""")
def _(spark, sf):
    k = F.col("p_partkey")
    h = F.when(k % 6 != 0, (k % 11).cast("double"))
    acc = table(spark, sf, "part").select(k.alias("obstacle_id"), h.alias("h_acc_m"), h.alias("v_acc_m"))
    return W.etod_area_counts(_etod(spark, sf), acc)


# ---------------------------------------------------------------- routes: the orders of a customer

RSPREAD = 20
RX, RY = position_sql("o_orderkey", 0, RSPREAD)


def route_points(spark, sf):
    lon, lat = position("o_orderkey", 0, RSPREAD)
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("route_id"), k.alias("seq"), (lon + 20).alias("lon"), (lat + 48).alias("lat"), F.when(k % 4 != 0, (k % 37 * 100.0)).alias("alt_m"),
    )


ROUTE_SQL = f"""pts AS (SELECT o_custkey AS route_id, o_orderkey AS seq, {RX} + 20 AS lon, {RY} + 48 AS lat, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 37 * 100.0 END AS alt FROM orders),
nx AS (SELECT *, lead(lon) OVER w AS blon, lead(lat) OVER w AS blat, lead(alt) OVER w AS balt FROM pts WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
ln AS (SELECT *, {sql_distance('lon', 'lat', 'blon', 'blat', RE)} AS len FROM nx WHERE blon IS NOT NULL),
legs AS (SELECT *, sum(len) OVER (PARTITION BY route_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - len AS s0 FROM ln)"""


@FAMILY.add("win_05_route_legs", f"WITH {ROUTE_SQL} SELECT route_id, seq AS leg_no, round(len, 2) AS len_m, round(s0, 1) AS s0_m FROM legs")
def _(spark, sf):
    return R.route_legs(route_points(spark, sf), block=5000).select("route_id", "leg_no", F.round("len_m", 2).alias("len_m"), F.round("s0_m", 1).alias("s0_m"))


@FAMILY.add("win_05_cumulative_distance", f"""WITH {ROUTE_SQL}, st AS (SELECT *, CASE WHEN plon IS NULL THEN 0 ELSE {sql_distance('plon', 'plat', 'lon', 'lat')} END AS step FROM (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM pts WINDOW w AS (PARTITION BY route_id ORDER BY seq)))
SELECT route_id, seq, round(sum(step) OVER w, 4) AS along_nm, round(sum(step) OVER w / 180 * 60, 4) AS after_min FROM st WINDOW w AS (PARTITION BY route_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def _(spark, sf):
    c = R.cumulative_distance(route_points(spark, sf), ["route_id"], speed_kt=180.0, block=5000)
    return c.select("route_id", "seq", F.round("along_nm", 4).alias("along_nm"), F.round("after_min", 4).alias("after_min"))


@FAMILY.add("job_19_position_at", f"""WITH {ROUTE_SQL}, st AS (SELECT *, CASE WHEN plon IS NULL THEN 0 ELSE {sql_distance('plon', 'plat', 'lon', 'lat')} END AS step FROM (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM pts WINDOW w AS (PARTITION BY route_id ORDER BY seq))),
d AS (SELECT *, sum(step) OVER (PARTITION BY route_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS d FROM st),
e AS (SELECT *, lag(d) OVER (PARTITION BY route_id ORDER BY seq) AS pd FROM d)
SELECT route_id, round(plon + (lon - plon) * (450 - pd) / (d - pd), 4) AS lon, round(plat + (lat - plat) * (450 - pd) / (d - pd), 4) AS lat FROM e WHERE d >= 450 AND pd < 450""")
def _(spark, sf):
    c = R.cumulative_distance(route_points(spark, sf), ["route_id"], speed_kt=180.0, block=5000)
    timed = c.withColumn("eto", F.timestamp_micros(F.lit(1767225600000000) + F.round(F.col("after_min") * 60e6).cast("long")))
    return R.position_at(timed, "2026-01-01 02:30:00", ["route_id"], block=5000).select("route_id", F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"))


@FAMILY.add("win_10_altitude_at", f"""WITH {ROUTE_SQL}, p AS (SELECT route_id, seq, alt, coalesce(s0, (SELECT max(s0 + len) FROM legs l WHERE l.route_id = pts.route_id), 0.0) AS s FROM pts LEFT JOIN legs USING (route_id, seq, lon, lat, alt)),
m AS (SELECT route_id, seq, s0 + len / 2 AS s FROM legs),
u AS (SELECT route_id, seq, s, 0 AS k, NULL AS alt FROM m UNION ALL SELECT route_id, seq, s, 1, alt FROM p WHERE alt IS NOT NULL),
b AS (SELECT *, last_value(CASE WHEN k = 1 THEN alt END IGNORE NULLS) OVER w AS pa, last_value(CASE WHEN k = 1 THEN s END IGNORE NULLS) OVER w AS ps FROM u WINDOW w AS (PARTITION BY route_id ORDER BY s, k ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, last_value(CASE WHEN k = 1 THEN alt END IGNORE NULLS) OVER w AS na, last_value(CASE WHEN k = 1 THEN s END IGNORE NULLS) OVER w AS ns FROM b WINDOW w AS (PARTITION BY route_id ORDER BY s DESC, k DESC ROWS UNBOUNDED PRECEDING))
SELECT route_id, seq AS leg_no, round(CASE WHEN na IS NULL THEN pa WHEN pa IS NULL THEN na ELSE pa + (na - pa) * (s - ps) / greatest(1.0, ns - ps) END, 3) AS alt_m FROM c WHERE k = 0""")
def _(spark, sf):
    pts = route_points(spark, sf)
    legs = R.route_legs(pts, block=5000)
    at = legs.select("route_id", F.col("leg_no").alias("seq"), "s0_m").unionByName(legs.groupBy("route_id").agg(F.max_by(F.col("s0_m") + F.col("len_m"), "leg_no").alias("s0_m")).withColumn("seq", F.lit(-1).cast("long")))
    last = pts.groupBy("route_id").agg(F.max("seq").alias("_last"))
    located = pts.join(last, "route_id").withColumn("_k", F.when(F.col("seq") == F.col("_last"), F.lit(-1)).otherwise(F.col("seq")))
    located = located.join(at.select("route_id", F.col("seq").alias("_k"), F.col("s0_m").alias("s_m")), ["route_id", "_k"], "left").withColumn("s_m", F.coalesce("s_m", F.lit(0.0)))
    probes = legs.select("route_id", F.col("leg_no").alias("probe_id"), (F.col("s0_m") + F.col("len_m") / 2).alias("s_m"))
    return R.altitude_at(located, probes).select("route_id", F.col("probe_id").cast("long").alias("leg_no"), F.round("alt_m", 3).alias("alt_m"))


def route_obstacles(spark, sf):
    lon, lat = position("p_partkey", 3, RSPREAD)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("obstacle_id"), (lon + 20.0007).alias("lon"), (lat + 48.0007).alias("lat"), (F.col("p_size") * 30.0).alias("elev_m"))


VX, VY = position_sql("p_partkey", 3, RSPREAD)
D13 = f"({sql_distance('g.lon', 'g.lat', 'o.lon', 'o.lat', 1.0)})"


@FAMILY.add("job_16_route_assessment", f"""WITH {ROUTE_SQL}, obs AS (SELECT p_partkey AS oid, {VX} + 20.0007 AS lon, {VY} + 48.0007 AS lat, p_size * 30.0 AS elev FROM part),
g AS (SELECT *, radians({sql_bearing('lon', 'lat', 'blon', 'blat')}) AS t12 FROM legs),
r AS (SELECT g.route_id, g.seq, g.len, g.alt, g.balt, oid, elev, {D13} AS d13, radians({sql_bearing('g.lon', 'g.lat', 'o.lon', 'o.lat')}) - t12 AS turn
  FROM g JOIN obs o ON o.lat BETWEEN least(g.lat, blat) - 0.3 AND greatest(g.lat, blat) + 1.0 AND o.lon BETWEEN least(g.lon, blon) - 0.3 AND greatest(g.lon, blon) + 0.3),
x AS (SELECT *, asin(greatest(-1, least(1, sin(d13) * sin(turn)))) AS xt FROM r),
y AS (SELECT *, acos(greatest(-1, least(1, cos(d13) / cos(xt)))) * CASE WHEN cos(turn) < 0 THEN -1 ELSE 1 END * {RE} AS at_m FROM x WHERE abs(xt) * {RE} <= 5 * 1852),
h AS (SELECT route_id, seq, count(*) AS n, max(elev) AS top, arg_max(oid, elev * 1e7 + oid) AS oid FROM y WHERE at_m >= 0 AND at_m <= len GROUP BY ALL),
z AS (SELECT legs.*, coalesce(h.n, 0) AS n, h.oid, h.top, ceil(round((h.top + 304.8) / 0.3048 / 100, 9)) * 100 * 0.3048 AS msa FROM legs LEFT JOIN h USING (route_id, seq))
SELECT route_id, seq AS leg_no, n AS n_obstacles, oid AS highest_obstacle, round(msa, 3) AS msa_m, coalesce(coalesce(least(alt, balt), alt, balt) >= msa, true) AS ok FROM z""")
def _(spark, sf):
    legs = R.route_legs(route_points(spark, sf), block=5000)
    out = R.route_assessment(legs, route_obstacles(spark, sf))
    return out.select("route_id", "leg_no", "n_obstacles", "highest_obstacle", F.round("msa_m", 3).alias("msa_m"), "ok")


@FAMILY.add("job_17_route_crossings")
def _(spark, sf):
    lon, lat = position("o_orderkey", 0, 200)
    pts = route_points(spark, sf).drop("lon", "lat").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), (lon + 20).alias("lon"), (lat + 48).alias("lat")), "seq")
    legs = R.route_legs(pts, block=5000)
    rings = nation_rings(spark, sf).select(F.col("nation").alias("area_id"), "seq", (F.col("lon") / 166 + 20).alias("lon"), (F.col("lat") / 150 + 48).alias("lat"))
    edges = P.ring_edges(rings, ["area_id"])
    k = F.col("n_nationkey")
    areas = table(spark, sf, "nation").select(
        k.alias("area_id"), F.when(k % 3 == 0, "P").when(k % 3 == 1, "R").otherwise("D").alias("type"), (k * 50.0).alias("lo_m"), (k * 50.0 + 1500).alias("up_m"),
        F.when(k % 4 == 0, "maybe").when(k % 4 == 1, "off").otherwise("on").alias("state"),
    )
    points = legs.select("route_id", F.col("s0_m").alias("s_m"), F.col("a_alt_m").alias("alt_m"))
    return R.route_crossings(legs, points, edges, areas, cell=0.02)


@FAMILY.add("agg_15_leg_terrain")
def _(spark, sf):
    lon, lat = position("o_orderkey", 0, 200)
    pts = table(spark, sf, "orders").select(F.col("o_custkey").alias("route_id"), F.col("o_orderkey").alias("seq"), (lon + 14).alias("lon"), (lat + 49).alias("lat"), (F.col("o_totalprice") / 100).alias("alt_m"))
    legs = R.route_legs(pts, block=5000).withColumn("moc_m", F.lit(300.0))
    cells = part_terrain(spark, sf)
    return R.leg_terrain(legs, cells, part_grids(cells), step_nm=1.0).select("route_id", "leg_no", F.round("terrain_m", 3).alias("terrain_m"), "severity")
