"""Faults of the third review, each on a few planted rows."""

from aerolith.operators import refs
from aerolith.operators import spatial as S


def test_latitudes_beyond_a_pole_stay_in_their_own_rows(spark):
    # such a site went into every row back to the pole, thousands of copies
    sites = spark.createDataFrame([(i, 10.0, lat) for i, lat in enumerate((-300.0, -90.0, 0.0, 89.9999, 300.0))], "site int, lon double, lat double")
    h = S.cell_height(0.03)
    copies = {r.site: r.n for r in S.with_reach(sites, 0.03, h).filter("abs(lat) > 90").groupBy("site").agg({"*": "count"}).toDF("site", "n").collect()}
    assert copies and max(copies.values()) <= 4
    points = spark.createDataFrame([(i, 10.0, lat + 0.0004) for i, lat in enumerate((-300.0, -90.0, 0.0, 89.9999, 300.0))], "k int, lon double, lat double")
    assert sorted((r.k, r.site) for r in S.within_distance(points, sites, 0.03, ["site"]).collect()) == [(i, i) for i in range(5)]
    line = sites.filter("abs(lat) > 90").selectExpr("site", "lon - 0.01 AS lon1", "lat AS lat1", "lon + 0.01 AS lon2", "lat AS lat2")
    assert S._cover_segment(line, h, 0.03).count() <= 8
    assert sorted((r.k, r.site) for r in S.near_path(points, line, 0.03, ["site"]).collect()) == [(0, 0), (4, 4)]


def test_harmonized_states_of_whole_prefixes(spark):
    rows = [(i, i, "p", s, w) for i, (s, w) in enumerate([("A", "code"), ("B", "strong"), ("A", "weak"), ("B", "weak"), ("C", "code"), ("C", "strong")])]
    rows += [(9, 9, "q", "A", "code"), (9, 9, "q", "B", "weak"), (10, 10, "q", "A", "code")]  # an id that repeats does not lead itself
    d = spark.createDataFrame(rows, "dataset_id int, dataset_order int, prefix string, state string, strength string")
    got = sorted((r.dataset_id, r.state_detected, r.state, r.state_from) for r in refs.harmonize_states(d).collect())
    assert got == sorted([
        (0, "A", "B", 1), (1, "B", "B", None), (2, "A", "B", 1), (3, "B", "A", 0), (4, "C", "B", 1), (5, "C", "C", None), (9, "A", "A", 10), (9, "B", "A", 10), (10, "A", "A", None),
    ])


def test_states_are_led_by_a_hundred_neighbours(spark, tmp_path):
    from aerolith.queries.references import FAMILY

    rows = [(k, f"Customer#{k:09d}", "LATE" if k == 101 else "LED") for k in (101, 155)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.dataset_id: r.state for r in FAMILY.queries["jon_34_harmonize_states"](spark, str(tmp_path)).collect()}
    assert got == {101: "LATE", 155: "LATE"}


def test_hulls_of_many_groups_in_one_walk(spark):
    from aerolith.operators.model import hull_by_group

    # one call of pandas a group and salt took most of the time where groups are many and small
    box = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (1.0, 1.0), (2.0, 1.0), (0.0, 0.0)]
    rows = [(g, x + g, y) for g in range(700) for x, y in box] + [(9000, float(i), float(i * i)) for i in range(3000)] + [(9001, 1.0, 1.0)]
    hull = hull_by_group(spark.createDataFrame(rows, "g int, lon double, lat double").repartition(6), "g", salts=3)
    assert "FlatMapGroupsInPandas" not in hull._jdf.queryExecution().toString()
    got = {}
    for r in hull.collect():
        got.setdefault(r.g, {})[r.seq] = (r.lon, r.lat)
    assert len(got) == 702 and got[9001] == {0: (1.0, 1.0)} and len(got[9000]) == 3000
    assert all(got[g] == {i: (x + g, y) for i, (x, y) in enumerate(box[:4])} for g in range(700))


def test_fans_hold_what_their_circle_holds(spark):
    import math
    import random

    from pyspark.sql import functions as F

    from aerolith.plans import runway as W

    rng = random.Random(3)
    ends = [(i, lon, lat, trk) for i, (lon, lat, trk) in enumerate([(179.98, 10.0, 80.0), (20.0, 60.0, 0.0), (20.0, -60.0, 90.0), (20.0, 40.0, 233.0), (-179.99, 0.0, 271.0)])]
    obs = [(k, e[1] + rng.uniform(-0.35, 0.35), e[2] + rng.uniform(-0.15, 0.15), float(rng.randrange(400))) for k, e in enumerate(ends * 400)]
    o = spark.createDataFrame([(k, (x + 180) % 360 - 180, y, z) for k, x, y, z in obs], "obstacle_id int, lon double, lat double, elev_m double")
    e = spark.createDataFrame(ends, "end_id int, der_lon double, der_lat double, track double").withColumn("der_elev_m", F.lit(0.0))
    axis = W._axis(e, "der_lon", "der_lat", F.col("track"), 15000.0)
    inside = (F.col("s") > 0.5) & (F.col("s") <= 15000) & (F.abs("x") <= 150 + math.tan(math.radians(15)) * F.col("s"))
    want = {(r.end_id, r.obstacle_id) for r in W._along_across(o.crossJoin(axis), "der_lon", "der_lat").filter(inside).collect()}
    rows = W.takeoff(o, e)
    assert {(r.end_id, r.obstacle_id) for r in rows.collect()} == want and len(want) > 50 and rows.count() == len(want)
    # an end goes to the cells of its own fan, not to all round it, and only obstacles above the surface are ordered
    fan = W.with_fan(axis, W.cell_height(0.5), "der_lon", "der_lat", "_ux", "_uy", F.lit(15000.0), F.lit(150.0), F.lit(4169.0))
    assert fan.groupBy("end_id").count().agg(F.max("count")).collect()[0][0] < 200


def test_terrain_of_legs_is_read_off_in_tiles(spark):
    from pyspark.sql import functions as F

    from aerolith.operators.terrain import terrain_at
    from aerolith.plans import route as R

    # a coarse grid, a finer one inside it with voids, a post given twice; the samples of a leg stay in one row a tile
    grids = spark.createDataFrame([("a", 0.1, 10.0, 50.0, 30, 30), ("b", 0.04, 10.5, 49.5, 25, 20)], "source string, spacing_deg double, lon0 double, lat0 double, n_rows long, n_cols int")
    cells = spark.createDataFrame([(s, r, c, float((r * 31 + c * 17) % 97)) for s, n, m in (("a", 30, 30), ("b", 25, 20)) for r in range(n) for c in range(m) if s == "a" or (r * c) % 3] + [("b", 1, 1, 500.0)], "source string, row long, col long, elev double")
    pts = [(k, q, 9.5 + (k * 37 + q * 83) % 350 / 100.0, 50.4 - (k * 53 + q * 29) % 380 / 100.0, 100.0) for k in range(12) for q in range(4)] + [(3, 1, 10.0, 49.0, 50.0)]
    legs = R.route_legs(spark.createDataFrame(pts, "route_id int, seq int, lon double, lat double, alt_m double")).withColumn("moc_m", F.lit(300.0))
    samples = R.leg_samples(legs, 1.0, 0.5)
    want = samples.join(terrain_at(samples, cells, grids, "sample_id"), "sample_id").groupBy("route_id", "leg_no").agg(F.max("elev").alias("z"))
    near = lambda rows: {(r[0], r[1]): None if r[2] is None else round(r[2], 6) for r in rows}
    expected = near(legs.select("route_id", "leg_no").join(want, ["route_id", "leg_no"], "left").select("route_id", "leg_no", "z").collect())
    assert near(R.leg_terrain(legs, cells, grids, step_nm=1.0).select("route_id", "leg_no", "terrain_m").collect()) == expected
    tops = R._terrain_top(legs.filter("route_id <> 3"), cells, grids, 0.5, 1.0, "route_id")
    assert tops.count() == sum(z is not None and k[0] != 3 for k, z in expected.items())


def test_data_areas_send_no_pairs_through_a_shuffle(spark):
    from pyspark.sql import functions as F

    from aerolith.plans import runway as W

    # one aerodrome of one runway, one of two; an obstacle listed twice, one far away, one without a place
    o = spark.createDataFrame([(1, 20.0, 40.0, 50.0, 120.0), (2, 20.02, 40.01, 90.0, 20.0), (2, 20.02, 40.01, 90.0, 20.0), (3, 60.0, 10.0, 0.0, 150.0), (4, None, None, 0.0, None)], "obstacle_id int, lon double, lat double, elev_m double, hgt_m double")
    rows = [(7, 1, 1, 20.0, 40.0), (8, 1, 1, 20.1, 40.1), (8, 2, 2, 20.1, 40.1)]
    r = spark.createDataFrame(rows, "ad_id int, rwy_id int, rwy_no int, arp_lon double, arp_lat double").select(
        "*", (F.col("arp_lon") - 0.01).alias("a_lon"), F.col("arp_lat").alias("a_lat"), (F.col("arp_lon") + 0.01).alias("b_lon"), (F.col("arp_lat") + (F.col("rwy_no") - 1) * 0.01).alias("b_lat"),
        F.lit(10.0).alias("a_elev_m"), F.lit(12.0).alias("b_elev_m"), F.lit(150.0).alias("strip_half_m"), F.lit(60.0).alias("ext_m"), F.lit(0.0).alias("cwy_a_m"), F.lit(200.0).alias("cwy_b_m"),
        F.lit(True).alias("prec_a"), F.lit(False).alias("prec_b"),
    )
    out = W.etod_classify(o, r)
    got = sorted((x.obstacle_id, x.ad_id or 0, x.area, x.strictest, x.required) for x in out.collect())
    assert got == [(1, 7, "2a", "3", True), (1, 8, "2d", "2d", True), (2, 7, "2c", "2c", True), (2, 7, "2c", "2c", True), (2, 8, "2d", "2d", False), (2, 8, "2d", "2d", False), (3, 0, "1", "1", True), (4, 0, "1", "1", None)]
    assert "LeftOuter" not in out._jdf.queryExecution().toString()  # all pairs went through a join back to the obstacles
    single = W.etod_classify(o, r.filter("ad_id = 7"))
    counts = {x.area: (x.n, x.n_required, x.n_unknown) for x in W.etod_area_counts(single, o.select("obstacle_id", F.lit(None).cast("double").alias("h_acc_m"), F.lit(1.0).alias("v_acc_m")).distinct()).collect()}
    assert counts == {"2a": (1, 1, 1), "2c": (2, 2, 2), "1": (2, 1, 1)}


def test_wide_reaches_are_shared_out(spark):
    import math

    from aerolith.operators import mapping as M

    pts = spark.createDataFrame([(k, k * 0.37 % 5, k * 0.53 % 3) for k in range(60)] + [(3, 1.11, 1.59), (70, None, 1.0)], "key int, lon double, lat double")
    ads = spark.createDataFrame([(1, 1.0, 1.0), (1, 4.0, 2.0), (2, 3.0, 0.5), (2, 3.0, 0.5), (3, 90.0, 0.0)], "ad_id int, lon double, lat double")
    # a wide reach met in cells of its own size: one region was one task, and few rows stayed in the few tasks they came in
    pairs = S.within_distance(pts, ads.withColumnsRenamed({"lon": "x", "lat": "y"}), 120.0, ["ad_id"], site_lon="x", site_lat="y")
    assert "RepartitionByExpression" in pairs._jdf.queryExecution().toString()
    far = lambda a, b: S.R_NM * 2 * math.asin(min(1.0, math.sqrt(math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2)))
    p, a = [tuple(r) for r in pts.collect() if r.lon is not None], [tuple(r) for r in ads.collect()]
    want = sorted((k, d) for k, *at in p for d, *to in a if far(at, to) <= 120.0)
    assert sorted((r.key, r.ad_id) for r in pairs.collect()) == want
    # pairs are not grouped any more; what has several places still comes once, and what is owned keeps that tag
    owned = pts.selectExpr("key", "key % 4 AS ad_id")
    out = M.related(pts, ads, owned, 120.0)
    own = {(r.key, r.ad_id) for r in owned.collect()}
    assert sorted((r.key, r.ad_id, r.tag) for r in out.collect()) == sorted([(*x, "aerodrome data") for x in own] + [(*x, "near") for x in set(want) - own])
    assert "min(_r" not in out._jdf.queryExecution().toString()


def test_nearest_starts_with_small_cells(spark):
    import inspect

    assert inspect.signature(S.nearest).parameters["levels"].default[0] < 0.05
    line = spark.createDataFrame([(k, k * 0.01, 0.0) for k in range(2000)], "s int, lon double, lat double")
    pts = spark.createDataFrame([(k, k * 0.01 + 0.001, 0.0) for k in range(0, 2000, 50)] + [(-1, 25.0, 0.0), (-2, 90.0, 0.0)], "k int, lon double, lat double")
    got = {r.k: r.s for r in S.nearest(pts, line, 600.0, "k", "s").collect()}
    assert got == {k: k for k in range(0, 2000, 50)} | {-1: 1999}


def test_worst_leg_over_all_bands(spark):
    # a band of low legs settles most obstacles; ties, repeated obstacles and legs without a finding stay as they were
    legs = spark.range(3000).selectExpr("id AS leg_id", "double(id % 700) AS alt_m", "150.0D AS moc_m", "0.0D AS lon1", "(id % 10) * 0.5D AS lat1", "1.0D AS lon2", "(id % 10) * 0.5D AS lat2")
    obs = spark.createDataFrame([(1, 0.5, 0.0, 100.0), (1, 0.5, 0.5, 400.0), (2, 0.5, 1.0, 20.0), (3, 0.5, 4.5, None), (4, 0.2, 4.5, -300.0), (5, 9.0, 9.0, 0.0)], "obstacle_id int, lon double, lat double, elev_m double")
    whole = S.obstacle_leg_clearance(obs, legs, band_legs=10**9).orderBy("obstacle_id").collect()
    banded = S.obstacle_leg_clearance(obs, legs, band_legs=10).orderBy("obstacle_id").collect()
    assert banded == whole and [(r.obstacle_id, r.clearance_m, r.severity) for r in whole] == [(1, -399.0, "error"), (2, -18.0, "error")]


def test_holes_are_looked_for_in_their_own_relation(spark):
    # F32: an inner ring met the outer rings of every relation, one group a relation went to Python
    from aerolith.operators import osm as O
    from aerolith.operators import polygons as P

    box = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    ways = {"o": box(0.0, 0.0, 4.0), "p": box(0.0, 0.0, 4.0)[::-1], "h": box(1.0, 1.0, 1.0)}
    v = spark.createDataFrame([(w, k, *p) for w, ps in ways.items() for k, p in enumerate(ps)], "id string, seq int, lon double, lat double")
    m = spark.createDataFrame([("a", 0, "o", "outer"), ("a", 1, "h", "inner"), ("b", 0, "p", "outer"), ("c", None, "h", "inner"), (None, 0, "o", "outer")], "id string, seq int, way string, role string")
    rings = O.stitched(m, v)
    assert sorted((str(r.id), r.role, r.ring, r.way) for r in rings.collect()) == [("None", "outer", 0, "o"), ("a", "inner", 0, "h"), ("a", "outer", 0, "o"), ("b", "outer", 0, "p"), ("c", "inner", 0, "h")]
    assert [tuple(r) for r in O.holes(O.ring_vertices(rings, v)).collect()] == [("a", 0, 0)]
    assert "FlatMapGroupsInPandas" not in rings._jdf.queryExecution().toString()
    edges = P.ring_edges(spark.createDataFrame([(k, i, *p) for k in "ab" for i, p in enumerate(box(0.0, 0.0, 4.0))], "id string, seq int, lon double, lat double"), ["id"])
    pts = spark.createDataFrame([(1, "a", 1.0, 1.0), (2, "z", 1.0, 1.0)], "k int, id string, lon double, lat double")
    assert [tuple(r) for r in P.point_in_polygon(pts, edges, ["id"], "k", shared=["id"]).collect()] == [(1, "a")]


def test_few_rows_that_become_many_are_dealt_out(spark):
    # one small file was one task
    from aerolith.operators import boundary as B
    from aerolith.sources import notam as N

    arcs = spark.range(64).coalesce(1).selectExpr("id AS key", "double(id) AS lon", "0.0D AS lat", "10.0D AS radius_nm", "0.0D AS from_deg", "90.0D AS to_deg", "true AS clockwise")
    assert B.arc_points(arcs, ["key"]).rdd.getNumPartitions() > 1
    f = spark.range(64).coalesce(1).selectExpr("string(id) AS id", "'airspace' AS cat", "'RR' AS subj", "'' AS cond", "'R-12 ACTIVE 5 NM RADIUS CENTRED ON 551000N 0200000E' AS text", "0.0D AS lower_m", "1.0D AS upper_m",
                                               "double(null) AS q_lon", "double(null) AS q_lat", "int(null) AS q_radius_nm")
    rows = N.notam_areas(f)
    assert rows.rdd.getNumPartitions() > 1
    ring = rows.first().ring
    assert len(ring) == 73 and abs(ring[0].lat - (55 + 10 / 60 + 5 / 60)) < 2e-3 and abs(ring[0].lon - 20) < 1e-9


def test_a_leg_after_an_arc_of_unknown_centre_begins_at_its_end(spark):
    # places of legs are folded apart from their paths; an arc whose centre lacks a coordinate still ends on its end
    from aerolith.operators import model as M

    p = "struct<lon: double, lat: double>"
    legs = spark.createDataFrame(
        [(1, None, 1, "a", "IF", None, (0.0, 0.0), None, True, None, None, None, None), (1, None, 2, "b", "RF", None, (1.0, 0.0), (0.5, None), True, None, None, None, None),
         (1, None, 3, "c", "TF", None, (2.0, 0.0), None, True, None, None, None, None), (1, None, 4, "d", "TF", None, None, None, True, 90.0, 6.0, None, None),
         (2, None, 1, "e", "RF", (1.0, 0.0), (0.0, 1.0), (0.0, 0.0), False, None, None, None, None)],
        f"proc_id int, transition string, seq int, leg_id string, leg_type string, start {p}, end {p}, centre {p}, clockwise boolean, course double, length_nm double, trajectory array<{p}>, origin {p}",
    )
    rows = M.procedure_paths(legs)
    got = {r.leg_id: (r.way, len(r.path), tuple(r.path[0]), tuple(round(v, 3) for v in r.path[-1])) for r in rows.collect()}
    assert got == {"b": ("arc", 3, (0.0, 0.0), (1.0, 0.0)), "c": ("line", 2, (1.0, 0.0), (2.0, 0.0)), "d": ("course", 2, (2.0, 0.0), (2.1, 0.0)), "e": ("arc", 19, (1.0, 0.0), (0.0, 1.0))}
    # the legs are dealt out by number, an arc is not drawn inside the fold
    assert rows.rdd.getNumPartitions() > 1


def test_corridor_legs_are_dealt_out(spark):
    # legs of one small table were paired in as many tasks as their size asks for
    from aerolith.plans import route as R

    rows = [(0, i, 20.0 + i * 0.7, 50.0 + (i % 3) * 0.4, 500.0) for i in range(6)] + [(1, i, 20.0 + i * 0.5, 79.0 - i * 0.3, 500.0) for i in range(4)] + [(2, 0, 179.8, -10.0, 500.0), (2, 1, -179.7, -10.3, 500.0)]
    legs = R.route_legs(spark.createDataFrame(rows, "route_id int, seq int, lon double, lat double, alt_m double"))
    near = [(20.0 + i * 0.05, 50.0 + j * 0.03) for i in range(70) for j in range(30)] + [(20.0 + i * 0.05, 78.0 + j * 0.03) for i in range(40) for j in range(40)] + [(180.0, -10.0 - j * 0.02) for j in range(20)]
    obs = spark.createDataFrame([(k, lon, lat, 1.0) for k, (lon, lat) in enumerate(near)], "obstacle_id int, lon double, lat double, elev_m double")
    pairs = R.corridor_pairs(legs, obs, 5.0)
    assert pairs.rdd.getNumPartitions() > 1
    # the whole cross join decides
    from pyspark.sql import functions as F

    from aerolith.functions.geo import along_track, cross_track

    at = ("a_lon", "a_lat", "b_lon", "b_lat", "lon", "lat")
    every = legs.crossJoin(obs).select("route_id", "leg_no", "obstacle_id", "len_m", cross_track(*at).alias("x"), along_track(*at).alias("s")).where((F.abs("x") <= 5.0 * 1852) & (F.col("s") >= 0) & (F.col("s") <= F.col("len_m")))
    key = lambda r: (r.route_id, r.leg_no, r.obstacle_id)
    assert sorted(map(key, pairs.collect())) == sorted(map(key, every.collect()))
