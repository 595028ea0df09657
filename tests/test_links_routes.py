"""Route texts, nested keys, map extracts and the checks of airspace boundaries."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from aerolith.operators import osm as O
from aerolith.operators.links45 import attached, link_45, relation_refs
from aerolith.plans import airspace_checks as C
from aerolith.plans.route_text import expand_routes, level_m
from aerolith.sources.osm import read_osm


def test_levels(spark):
    words = {"F350": 10668.0, "A045": 1371.6, "N0450F350": 10668.0, "K0830S1130": 11300.0, "M082F310": 9448.8, "S1130": 11300.0, "FL350": None, "F35": None, "UL768": None, "M0840": 8400.0, "": None}
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", level_m(F.col("w")).alias("m")).collect()
    assert {r.w: r.m and round(r.m, 6) for r in rows} == words


def test_routes(spark):
    places = spark.createDataFrame([("AAAA", 0, 0.0, 0.0), ("BBB", 1, 1.0, 1.0), ("BBB", 2, 9.0, 9.0), ("EEE", 1, 5.0, 5.0), ("ZZZ", 1, 7.0, 7.0)], "name string, rank int, lon double, lat double")
    # a ring BBB-C-D-EEE with a shortcut BBB-X-EEE later in the file, and a dead end
    pairs = [("BBB", "C"), ("C", "D"), ("D", "EEE"), ("BBB", "X"), ("X", "EEE"), ("D", "Q")]
    at = {n: float(k) for k, n in enumerate("C D X Q BBB EEE".split())}
    seg = spark.createDataFrame([("ul 7", k, a, at[a], -at[a], b, at[b], -at[b]) for k, (a, b) in enumerate(pairs)] + [("UM1", 0, "ZZZ", 7.0, 7.0, "Y", 8.0, 8.0)], "airway string, no int, a string, a_lon double, a_lat double, b string, b_lon double, b_lat double")
    texts = [
        (1, "AAAA DCT bbb UL7 EEE/F200, ZZZ"), (2, "F100 EEE UL7 BBB A050 UM1 nowhere 5530N02515E/S0300"), (3, None), (4, ""), (5, "UL7 BBB UL7"), (6, "BBB UL7 BBB"), (7, "N0450F330 AAAA IFR " + "BBB EEE " * 40),
    ]
    points, unknown = expand_routes(spark.createDataFrame(texts, "route_id int, text string").withColumn("alt", F.lit(5.0)), places, seg, default_m="alt")
    got = {}
    for r in points.orderBy("route_id", "pos", "nth").collect():
        got.setdefault(r.route_id, []).append((r.name, r.lon, round(r.alt_m), r.via))
    assert got[1] == [("AAAA", 0.0, 5, None), ("BBB", 1.0, 5, None), ("X", 2.0, 5, "UL7"), ("EEE", 5.0, 6096, None), ("ZZZ", 7.0, 5, None)]
    assert got[2] == [("EEE", 5.0, 3048, None), ("X", 2.0, 3048, "UL7"), ("BBB", 1.0, 3048, None), ("5530N02515E", 25.25, 3000, None)]
    assert [p[0] for p in got[5]] == ["BBB"] and [p[0] for p in got[6]] == ["BBB", "BBB"] and len(got[7]) == 81 and got[7][5][2] == 10058
    assert sorted(map(tuple, unknown.collect())) == [(2, 5, "UM1"), (2, 6, "NOWHERE"), (5, 0, "UL7"), (5, 2, "UL7")]


def test_airway_search_goes_on_to_the_end(spark):
    seg = [("W", k, f"p{k}", 0.0, 0.0, f"p{k + 1}", 0.0, 0.0) for k in range(12)]
    seg = spark.createDataFrame(seg, "airway string, no int, a string, a_lon double, a_lat double, b string, b_lon double, b_lat double")
    places = spark.createDataFrame([("P0", 0, 0.0, 0.0), ("P12", 0, 0.0, 0.0)], "name string, rank int, lon double, lat double")
    seg = seg.withColumns({"a": F.upper("a"), "b": F.upper("b")})
    points, unknown = expand_routes(spark.createDataFrame([(1, "P12 W P0")], "route_id int, text string"), places, seg)
    assert [r.name for r in points.orderBy("pos", "nth").collect()] == ["P12", *(f"P{k}" for k in range(11, 0, -1)), "P0"] and unknown.isEmpty()


def test_nested_keys(spark):
    uid = lambda **k: json.dumps(k)
    features = spark.createDataFrame(
        [("a1", "Ahp", uid(codeId="EADD", mid="1")), ("a2", "Ahp", uid(codeId="EADH")), ("r1", "Rwy", uid(AhpUid={"codeId": "EADD", "mid": "5"}, txtDesig="09/27")), ("r2", "Rwy", uid(AhpUid={"codeId": "EADH"}, txtDesig="09/27")),
         ("d1", "Rdn", uid(RwyUid={"AhpUid": {"codeId": "EADD"}, "txtDesig": "09/27"}, txtDesig="09")), ("s1", "Ser", uid(UniUid={"txtName": "TWR"}, codeType="ATS"))],
        "feature_id string, tag string, uid string",
    )
    refs = [
        ("1", "Rwy", uid(txtDesig="09/27", AhpUid={"codeId": "EADD"})), ("2", "Rwy", uid(AhpUid={"codeId": "EADH"})), ("3", "Rwy", uid(txtDesig="09/27")), ("4", "Rwy", uid(txtDesig="18/36")),
        ("5", "Rwy", None), ("6", "Rwy", uid(mid="4", txtDesig="")), ("7", "Rdn", uid(RwyUid={"AhpUid": {"codeId": "EADD"}})), ("8", "Rdn", uid(RwyUid={"AhpUid": {"codeId": "EADH"}})), ("9", "Ahp", "not json"),
    ]
    links, problems = link_45(spark.createDataFrame([(s, "x", t, u) for s, t, u in refs], "src_id string, role string, tag string, uid string"), features)
    assert {r.src_id: (r.feature_id, r.match) for r in links.collect()} == {"1": ("r1", "exact"), "2": ("r2", "subset"), "7": ("d1", "subset")}
    assert {r.src_id: (r.problem, r.n) for r in problems.collect()} == {"3": ("ambiguous", 2), "4": ("unresolved", 0), "5": ("empty", 0), "6": ("empty", 0), "8": ("unresolved", 0), "9": ("empty", 0)}
    records = spark.createDataFrame(
        [("x", "Aha", uid(AhaUid={"AhpUid": {"codeId": "EADD"}, "codeType": "PHONE"}, txtAddress="123")), ("y", "Aha", uid(AhaUid={"AhpUid": {"codeId": "EADD"}, "codeType": "FAX"})), ("z", "Sae", uid(SaeUid={"SerUid": {"codeType": "ATS"}, "AseUid": {"codeId": "X"}}))],
        "record_id string, tag string, json string",
    )
    found, lost = link_45(relation_refs(records), features)
    got = {(r.feature_id, r.role): [m.record_id for m in r.records] for r in attached(found, records).collect()}
    assert got == {("a1", "contact"): ["x", "y"], ("s1", "service"): ["z"]} and [(r.role, r.problem) for r in lost.collect()] == [("client airspace", "unresolved")]


OSM_XML = """<?xml version='1.0'?><osm version='0.6'>
<node id='1' lat='50.0' lon='10.0'/><node id='2' lat='50.0' lon='10.1'/><node id='3' lat='50.1' lon='10.1'/><node id='4' lat='50.1' lon='10.0'><tag k='aeroway' v='windsock'/></node>
<node id='5' lat='50.02' lon='10.02'/><node id='6' lat='50.02' lon='10.04'/><node id='7' lat='50.04' lon='10.04'/>
<way id='11'><nd ref='1'/><nd ref='2'/><nd ref='3'/></way><way id='12'><nd ref='4'/><nd ref='3'/></way><way id='13'><nd ref='4'/><nd ref='1'/></way>
<way id='14'><nd ref='5'/><nd ref='6'/><nd ref='7'/><nd ref='5'/><tag k='building' v='yes'/></way><way id='15'><nd ref='1'/><nd ref='99'/><nd ref='3'/><tag k='aeroway' v='taxiway'/><tag k='ref' v='A'/></way>
<way id='16'><nd ref='1'/><nd ref='2'/><nd ref='3'/><nd ref='1'/><tag k='aeroway' v='taxiway'/></way>
<relation id='21'><member type='way' ref='11' role='outer'/><member type='way' ref='14' role='inner'/><member type='way' ref='13' role=''/><member type='way' ref='12' role='outer'/><tag k='type' v='multipolygon'/><tag k='aeroway' v='apron'/><tag k='ref' v='North'/></relation>
<relation id='22'><member type='way' ref='11' role='outer'/><tag k='type' v='route'/></relation></osm>"""


def test_extract_of_three_formats(spark, tmp_path):
    (tmp_path / "a.osm").write_text(OSM_XML)
    x = read_osm(spark, str(tmp_path / "a.osm"), "xml")
    rings = O.stitched(x.members, x.way_vertices)
    assert sorted((r.role, r.ring, r.nth, r.way, r.backwards) for r in rings.collect()) == [("inner", 0, 0, "14", False), ("outer", 0, 0, "11", False), ("outer", 0, 1, "12", True), ("outer", 0, 2, "13", False)]
    v = O.ring_vertices(rings, x.way_vertices)
    assert [(r.lon, r.lat) for r in v.where("role = 'outer'").orderBy("nth", "seq").collect()] == [(10.0, 50.0), (10.1, 50.0), (10.1, 50.1), (10.0, 50.1), (10.0, 50.0)]
    assert [tuple(r) for r in O.holes(v).collect()] == [("21", 0, 0)]
    shapes = O.shapes(x)
    assert {(r.kind, r.id): r["shape"] for r in shapes.collect() if r.kind != "node"} == {("way", "11"): "L", ("way", "12"): "L", ("way", "13"): "L", ("way", "14"): "A", ("way", "15"): "L", ("way", "16"): "L", ("relation", "21"): "A"}
    got = {(r.feature_type, r.id): r.attrs for r in O.osm_features(shapes, spark.createDataFrame([("TaxiwayElement",)], "feature_type string")).collect()}
    assert set(got) == {("VerticalPointStructure", "4"), ("VerticalPolygonalStructure", "14"), ("TaxiwayGuidanceLine", "15"), ("TaxiwayGuidanceLine", "16"), ("ApronElement", "21")}
    assert got["ApronElement", "21"] == {"idapron": "North", "aprontyp": "1", "status": "1"} and got["VerticalPointStructure", "4"]["pntsttyp"] == "4"
    node = lambda a, b: {"lat": b, "lon": a}
    over = {"generator": "Overpass API", "elements": [
        {"type": "node", "id": 4, "lat": 50.1, "lon": 10.0, "tags": {"aeroway": "windsock"}},
        {"type": "way", "id": 15, "tags": {"aeroway": "taxiway"}, "geometry": [node(10.0, 50.0), None, node(10.1, 50.1)]},
        {"type": "relation", "id": 21, "tags": {"aeroway": "apron", "type": "multipolygon"}, "members": [
            {"type": "way", "ref": 11, "role": "outer", "geometry": [node(10.0, 50.0), node(10.1, 50.0)]}, {"type": "way", "ref": 12, "role": "outer", "geometry": [node(10.0, 50.0), node(10.1, 50.1), node(10.1, 50.0)]},
            {"type": "way", "ref": 13, "role": "outer", "geometry": [node(3.0, 3.0), node(4.0, 4.0)]}]}]}
    (tmp_path / "b.json").write_text(json.dumps(over))
    y = read_osm(spark, str(tmp_path / "b.json"), "overpass")
    assert sorted((r.feature_type, r.id) for r in O.osm_features(O.shapes(y)).collect()) == [("ApronElement", "21"), ("TaxiwayElement", "15"), ("TaxiwayGuidanceLine", "15"), ("VerticalPointStructure", "4")]
    square = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
    geo = {"features": [
        {"id": "way/77", "properties": {"aeroway": "apron"}, "geometry": {"type": "Polygon", "coordinates": [square, square]}}, {"properties": {"@id": "node/5", "man_made": "mast"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"properties": {"natural": "water"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}}, {"properties": {}, "geometry": None}]}
    (tmp_path / "c.json").write_text(json.dumps(geo))
    z = read_osm(spark, str(tmp_path / "c.json"), "geojson")
    assert sorted((r.feature_type, r.id) for r in O.osm_features(O.shapes(z)).collect()) == [("ApronElement", "77"), ("VerticalPointStructure", "5"), ("Water", "2"), ("Water", "2-1")]
    with pytest.raises(KeyError):
        read_osm(spark, "x", "pbf")


def test_rings_that_do_not_close_or_touch(spark):
    ways = {"a": [(0, 0), (1, 0)], "b": [(1, 0), (1, 1)], "c": [(1, 1), (0, 0)], "d": [(1, 1), (2, 2)], "e": [(5, 5), (6, 5), (6, 6), (5, 5)], "f": [(9, 9)]}
    v = spark.createDataFrame([(w, k, float(x), float(y)) for w, p in ways.items() for k, (x, y) in enumerate(p)], "id string, seq int, lon double, lat double")
    m = spark.createDataFrame([("r", k, w, "outer") for k, w in enumerate("dabcef")] + [("q", 0, "a", "outer"), ("q", 1, "b", "outer")], "id string, seq int, way string, role string")
    got = O.stitched(m, v).collect()
    assert {(r.id, r.ring, r.way) for r in got} == {("r", 0, "a"), ("r", 0, "b"), ("r", 0, "c"), ("r", 1, "e")}


def test_findings_of_airspace(spark):
    none = (None,) * 5
    rows = [("A", 0, 0, "point", 0.0, 1.0, *none), ("A", 0, 1, "arc", 0.0, 0.0, 30.0, 0.0, 90.0, True, None), ("A", 0, 2, "point", 0.5, 0.0, *none), ("A", 0, 3, "border", None, None, *none[:4], "L"), ("A", 0, 4, "point", -1.0, 0.5, *none), ("A", 0, 5, "border", None, None, *none[:4], "gone")]
    e = spark.createDataFrame(rows, "airspace_id string, ring int, seq int, kind string, lon double, lat double, radius_nm double, from_deg double, to_deg double, clockwise boolean, border string")
    line = spark.createDataFrame([("L", 0, 0.5, -0.001), ("L", 1, -1.0, -0.5)], "border string, k int, lon double, lat double")
    links = spark.createDataFrame([("A", "p1", "point"), ("A", "p2", "circle")], "airspace_id string, ref string, what string")
    comp = spark.createDataFrame([("A", 1, None), ("A", 2, "B"), ("A", 3, "X")], "airspace_id string, step int, contributor_id string")
    spaces = spark.createDataFrame([("A", True), ("B", False)], "airspace_id string, has_shape boolean")
    found = C.airspace_checks(C.arc_ends(e), C.border_links(e, line), C.point_links(links, spark.createDataFrame([("p1",)], "ref string")), C.contributors(comp, spaces))
    got = {(r.rule, r.severity, r.detail): r.value for r in found.collect()}
    assert {k[0] for k in got} == {"arc end", "border missing", "border join", "point missing", "contributor"}
    assert got["arc end", "error", "start off end beside"] > 25
    assert got["border join", "warning", "L leaves"] > 30 and ("border missing", "error", "gone") in got and ("point missing", "error", "circle p2") in got
    assert ("contributor", "warning", "without shape B") in got and ("contributor", "warning", "missing X") in got
