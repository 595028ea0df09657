"""Published values the expressions must give."""

import math

from pyspark.sql import functions as F

from aerolith.functions import calendar as C
from aerolith.functions import coords, geo, ident, wgs84
from aerolith.plans import runway as W


def one(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


def test_cycles(spark):
    rows = [("2026-10-01 00:00:00", "2610", True), ("2026-10-29 00:00:00", "2611", True), ("2026-10-28 16:00:00", "2611", True), ("2026-10-28 10:00:00", "2611", True),
            ("2026-10-28 09:59:00", "2610", False), ("2026-10-28 16:07:00", "2611", False), ("2026-10-29 05:00:00", "2611", False), ("2020-01-02 00:00:00", "2001", True), ("2026-12-31 00:00:00", "2613", False)]
    df = spark.createDataFrame([r[:1] for r in rows], "t string").select("t", C.cycle_id(F.col("t").cast("timestamp")).alias("i"), C.cycle_exact(F.col("t").cast("timestamp")).alias("x"))
    got = {r.t: (r.i, r.x) for r in df.collect()}
    for t, i, x in rows:
        assert got[t] == (i, x), t


def test_crc_and_dms(spark):
    assert one(spark, ident.crc32q(F.lit("123456789"))) == "3010BF7F"
    assert one(spark, coords.format_position(F.lit(-31.9493), F.lit(52.3717), 0)) == "522218N 0315657W"
    for text, lat, want in [("24°42'13.0\"N", True, 24.703611), ("N 24 42 13.0", True, 24.703611), ("0464512.25E", False, 46.753403), ("-46.5", False, -46.5), ("5230N", True, 52.5)]:
        assert abs(one(spark, coords.coordinate(F.lit(text), lat)) - want) < 1e-5


def test_geodesic():
    lon, lat = wgs84.direct_arrays([-31.5], [52.0], [30.0], [123.0])
    assert abs(lat[0] - 53.7604834642) < 1e-9 and abs(lon[0] + 29.7731116872) < 1e-9
    d, a1, a2 = wgs84.inverse_arrays([-31.5], [52.0], [-29.8], [53.5])
    assert abs(d[0] - 109.379384081) < 1e-8 and abs(a1[0] - 33.842083284) < 1e-8 and abs(a2[0] - 35.195439275) < 1e-8


def test_sun(spark):
    df = spark.createDataFrame([("2026-06-21", -0.12, 51.5), ("2026-12-21", 15.0, 78.0)], "d string, lon double, lat double").withColumn("d", F.to_date("d"))
    a, b = df.select(C.sunrise("d", "lon", "lat").alias("r"), C.sunset("d", "lon", "lat").alias("s"), C.polar("d", "lon", "lat").alias("p")).collect()
    assert abs(a.r.hour * 60 + a.r.minute - (3 * 60 + 43)) <= 3 and abs(a.s.hour * 60 + a.s.minute - (20 * 60 + 21)) <= 3 and b.p == "night"


def _place(spark, rows):
    """Obstacles at along / right metres of a path due east from (20, 50)."""
    df = spark.createDataFrame(rows, "obstacle_id string, along double, right double, elev_m double").withColumn("hgt_m", F.lit(10.0))
    m = geo.M_PER_DEGREE
    return df.withColumns({"lon": 20 + F.col("along") / (m * math.cos(math.radians(50))), "lat": 50 - F.col("right") / m})


def test_takeoff(spark):
    obs = _place(spark, [("A", 1000.0, 0.0, 40.0), ("B", 1500.0, 50.0, 30.0), ("C", 3000.0, 0.0, 70.0), ("D", 2000.0, 600.0, 90.0), ("side", 4000.0, -700.0, 140.0)])
    ends = spark.createDataFrame([("09", 20.0, 50.0, 10.0, 90.0, 4)], "end_id string, der_lon double, der_lat double, der_elev_m double, track double, code int")
    t = W.takeoff(obs, ends)
    r = {x.obstacle_id: x for x in t.collect()}
    assert abs(r["A"].type_a_pen - 18) < 0.1 and abs(r["A"].required_gradient - 0.03) < 1e-4 and r["A"].charted and r["A"].close_in
    assert r["B"].shadow and not r["B"].charted
    assert r["C"].charted and r["C"].pdg is None and abs(r["C"].required_gradient - 0.02) < 1e-4
    assert abs(r["D"].pdg - 0.0455) < 2e-4
    assert r["side"].in_departure and not r["side"].in_net
    cut = W.climb_cut(t, ends).collect()[0]
    assert cut.cut_obstacle in ("A", "D", "side") and abs([x for x in W.climb_cut(t.filter("obstacle_id = 'A'"), ends).collect()][0].cut_m - 560) < 1


def test_approach(spark):
    obs = _place(spark, [("M", 1060.0, 0.0, 40.0)])
    ends = spark.createDataFrame([("27", 20.0, 50.0, 10.0, 270.0, 3.0, 15.0, "P", 4)], "end_id string, thr_lon double, thr_lat double, thr_elev_m double, course double, gpa double, tch_m double, app_type string, code int")
    r = W.approach(obs, W.with_approach_surface(ends)).collect()[0]
    assert abs(r.allowed - 20) < 0.05 and abs(r.pen - 10) < 0.05 and abs(r.displacement - 500) < 3


def test_etod(spark):
    obs = _place(spark, [("mid", 1500.0, 20.0, 30.0), ("out", 5060.0, 0.0, 60.0), ("north", 1500.0, -3000.0, 60.0)])
    dlon = 3000 / (geo.M_PER_DEGREE * math.cos(math.radians(50)))
    rw = spark.createDataFrame([("AD", "r", 1, 20 + dlon / 2, 50.0, 20.0, 50.0, 20 + dlon, 50.0, 10.0, 16.0, 150.0, 60.0, 0.0, 0.0, False, False)],
        "ad_id string, rwy_id string, rwy_no int, arp_lon double, arp_lat double, a_lon double, a_lat double, b_lon double, b_lat double, a_elev_m double, b_elev_m double, strip_half_m double, ext_m double, cwy_a_m double, cwy_b_m double, prec_a boolean, prec_b boolean")
    r = {x.obstacle_id: x for x in W.etod_classify(obs, rw).collect()}
    assert r["mid"].area == "2a" and abs(r["mid"].surface_m - 16) < 0.05 and r["mid"].strictest == "3"
    assert r["out"].area == "2b" and abs(r["out"].surface_m - 40) < 0.1
    assert r["north"].area == "2c" and abs(r["north"].surface_m - (13 + 0.012 * 2850)) < 0.2
