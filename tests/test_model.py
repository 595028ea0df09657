import random

from pyspark.sql import functions as F

from aerolith.operators import model as M
from aerolith.sources import notam as N


def brute_hull(points):
    """Corners: points that no triangle or segment of the others holds, by the side test of every pair."""
    pts = sorted(set(points))
    side = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    out = set()
    for a in pts:
        for b in pts:
            if a != b and all(side(a, b, p) > 0 or (side(a, b, p) == 0 and min(a, b) <= p <= max(a, b)) for p in pts):
                out |= {a, b}
    return out


def test_hull_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [("a", float(rng.randint(0, 20)), float(rng.randint(0, 20))) for _ in range(60)] + [("line", float(i), 2.0 * i) for i in range(5)] + [("one", 1.0, 1.0)] * 3 + [("none", None, 1.0)]
    got = M.hull_by_group(spark.createDataFrame(rows, "g string, lon double, lat double").repartition(5), "g", salts=3).collect()
    hull = {g: {(r.lon, r.lat) for r in got if r.g == g} for g in {r.g for r in got}}
    assert hull["a"] == brute_hull([r[1:] for r in rows if r[0] == "a"])
    assert hull["line"] == {(0.0, 0.0), (4.0, 8.0)} and hull["one"] == {(1.0, 1.0)} and "none" not in hull


def test_code_texts_and_words(spark):
    df = spark.createDataFrame([("QMRLC",), ("QZZLC",), ("",), (None,)], "c string")
    assert [r.t for r in df.select(N.qcode_text("c").alias("t")).collect()] == ["runway closed", "ZZ closed", None, None]


def test_notam_lights_and_work(spark):
    f = spark.createDataFrame([("a", "RWY 09L/27R WIP. PAPI RWY 09L U/S."), ("b", "RWY 18 NOT CLSD. PAPI AVBL. ILS U/S"), ("c", None)], "id string, text string")
    rows = {(r.id, r.rwy): r for r in N.notam_runway(f).collect()}
    assert set(rows) == {("a", "09L/27R"), ("a", "09L"), ("b", "18")}
    assert rows[("a", "09L")].wip and rows[("a", "09L")].lights_out and not rows[("b", "18")].lights_out and not rows[("b", "18")].closed
    o = f.withColumns({"cat": F.lit("obstacle"), "subj": F.lit("OL"), "fmt": F.lit("ICAO"), "q_lat": F.lit(1.0), "q_lon": F.lit(2.0)}).filter("id = 'a'").withColumn("text", F.lit("TOWER CRANE LGT U/S. MAST 12,5 M ABOVE GROUND LEVEL"))
    r = N.notam_obstacles(o).collect()[0]
    assert r.type == "CRANE" and r.lights_out and r.hgt_m == 12.5 and r.approx


def test_item_letters_inside_a_text(spark):
    df = spark.createDataFrame([("(A0001/26 NOTAMN\nQ) EAAD/QXXXX/IV/M/A/000/999/5522N02515E005\nA) EADD B) 2610010600 C) PERM\nE) SEE CHART A) AND B) OF PAGE 2\nG) FL100)",), ("",), (None,)], "text string")
    rows = N.notam_fields(N.split_notams(df)).collect()
    assert len(rows) == 1 and rows[0].text == "SEE CHART A) AND B) OF PAGE 2" and rows[0].upper_m == 3048.0


def test_kinds_by_type_and_name(spark):
    from aerolith.operators.checks import kind_in_text, obstacle_kind

    cases = [
        ("BUILDING", "BUILDING CRANE", "building"), ("TOWER", "WATER TOWER", "watertower"), ("TOWER", "radio towers", "tower"), ("POLE", "street lights", "lamp"), ("POLE", "WINDSOCK", "windsock"), ("POLE", "PAPI", "als"), ("ANTENNA", "DVOR", "vor"),
        ("ANTENNA", "LLZ 09", "loc"), ("ANTENNA", "GP", "gp"), ("ANTENNA", "SSR", "radar"), ("BUILDING", "HANGAR 3", "hangar"), ("BUILDING", "ATC TWR", "ctower"), ("BUILDING", "ARENA", "stadium"), ("COOLING_TOWER", None, "cooling"),
        ("TRANSMISSION_LINE", "", "pylon"), ("WINDMILL_FARMS", "", "windmill"), ("NATURAL_HIGHPOINT", "", "peak"), ("SIGN", "TREE", "sign"), ("GATE", "", "wall"), ("OTHER:PALM TREES", "", "tree"), ("OTHER", "OFFICE", "building"),
        (None, "FLAG", "pole"), (None, "MAST ON HOTEL", "antenna"), (None, None, "other"), ("", "overhead lines", "pylon"), ("power plant", "", "utility"), ("OTHER", "STREET RIGHT ASPIRE", "other"), (None, "MOSQUE", "dome"),
    ]
    rows = spark.createDataFrame(cases, "t string, n string, k string").select("t", "n", "k", obstacle_kind("t", "n").alias("got")).collect()
    assert [(r.t, r.n, r.got) for r in rows] == cases
    own = spark.createDataFrame([("a big grue",), ("gruel",)], "n string").select(kind_in_text("n", {"monster": "GRUE"}, {}).alias("k")).collect()
    assert [r.k for r in own] == ["monster", None]


def test_paths_of_procedures(spark):
    from aerolith.operators.model import procedure_paths

    point = "struct<lon: double, lat: double>"
    schema = f"proc_id string, transition string, seq int, leg_id string, leg_type string, start {point}, end {point}, centre {point}, clockwise boolean, course double, length_nm double, trajectory array<{point}>, origin {point}"
    a, b, c = (0.0, 0.0), (0.0, 1.0), (1.0, 1.0)

    def leg(proc, seq, kind="TF", tr=None, start=None, end=None, centre=None, turn=None, course=None, length=None, line=None, origin=None):
        return (proc, tr, seq, f"{proc}{seq}", kind, start, end, centre, turn, course, length, line, origin)

    legs = [
        leg("p", 1, "IF", end=a), leg("p", 2, end=b), leg("p", 3, "RF", end=c, centre=(0.5, 1.0), turn=True), leg("p", 4, "CF", course=90.0, length=50.0), leg("p", 5, "CA", course=0.0), leg("p", 6), leg("p", 7, end=a),
        leg("q", 1, "CF", course=180.0, origin=b), leg("q", 2, tr="X", end=c, origin=b), leg("q", 3, tr="Y", end=a, origin=b), leg("q", 4, end=c, origin=b),
        leg("r", 1, course=10.0), leg("r", 2, line=[a, b, c]), leg("r", 3, "AF", end=b, centre=(0.5, 1.0)), leg("r", 4, "IF", start=a), leg("r", 5, end=c),
    ]
    rows = procedure_paths(spark.createDataFrame(legs, schema)).orderBy("proc_id", "seq").collect()
    got = {r.leg_id: (r.way, [(round(x.lon, 3), round(x.lat, 3)) for x in r.path]) for r in rows}
    assert got["p2"] == ("line", [a, b]) and got["p3"][0] == "arc" and got["p3"][1][0] == b and got["p3"][1][-1] == c and max(y for _, y in got["p3"][1]) > 1.4
    assert got["p4"][0] == "course" and got["p4"][1][1] == (1.167, 1.0) and got["p5"][1] == [(1.167, 1.0), (1.167, 1.05)]
    assert "p6" not in got and got["p7"][1][0] == (1.167, 1.05) and "p1" not in got and "r1" not in got and "r4" not in got
    assert got["q1"][1][0] == b and got["q2"][1] == [(0.0, 0.95), c] and got["q3"][1] == [b, a] and got["q4"][1] == [a, c]
    assert got["r2"] == ("trajectory", [a, b, c]) and got["r3"][0] == "arc" and got["r3"][1][0] == c and got["r5"][1] == [a, c]
