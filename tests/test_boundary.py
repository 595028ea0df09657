"""Boundaries drawn from points, arcs and borders."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from aerolith.functions.wgs84 import direct_arrays, inverse_arrays
from aerolith.operators import boundary as B

ELEMENT = "id string, seq int, kind string, lon double, lat double, radius_nm double, from_deg double, to_deg double, clockwise boolean, border string"
POINT = (None,) * 5


def point(i, seq, lon, lat):
    return (i, seq, "point", lon, lat, *POINT)


def arc(i, seq, lon, lat, r, b1, b2, cw):
    return (i, seq, "arc", lon, lat, r, float(b1), float(b2), cw, None)


def at(lon, lat, deg, nm):
    x, y = direct_arrays([lon], [lat], [deg], [nm])
    return float(x[0]), float(y[0])


def test_circle_keeps_the_radius(spark):
    got = B.arc_points(spark.createDataFrame([arc("C", 0, 179.9, 60.0, 40.0, 0, 0, True)], ELEMENT), ["id"]).orderBy("k").collect()
    x, y = [r.lon for r in got], [r.lat for r in got]
    assert len(got) > 100
    assert abs(inverse_arrays([179.9] * len(got), [60.0] * len(got), x, y)[0] - 40).max() < 1e-6
    # the middle of a chord is at most the tolerance inside
    mid = inverse_arrays(x[:-1], y[:-1], x[1:], y[1:])[0] / 2
    assert (40 - (40**2 - mid**2) ** 0.5).max() <= B.CHORD_NM


def test_arcs_between_published_points(spark):
    c, c1, c2 = (10.0, 50.0), (0.0, 0.0), (0.0, 1.0)
    on, through = at(*c, 0.3, 30.02), at(*c, 93, 33.0)
    first = at(*c1, 180, 20)
    elements = [
        point("A", 0, *on), arc("A", 1, *c, 30.0, 0, 90, True), point("A", 2, *through), point("A", 3, 10.0, 49.0),
        point("far", 0, 9.0, 50.0), arc("far", 1, *c, 30.0, 0, 90, True), point("far", 2, *at(*c, 90, 50.0)),
        arc("two", 0, *c1, 20.0, 180, 0, True), arc("two", 1, *c2, 20.0, 0, 180, False), point("two", 2, *first),
    ]
    found = {}
    for r in B.drawn(spark.createDataFrame(elements, ELEMENT), None, ["id"]).orderBy("seq", "k").collect():
        found.setdefault(r.id, []).append((r.seq, r.kind, r.lon, r.lat))
    rows = found["A"]
    bent = [p for p in rows if p[0] == 1]
    d = inverse_arrays([c[0]] * len(bent), [c[1]] * len(bent), [p[2] for p in bent], [p[3] for p in bent])[0]
    # the start lies off the arc by more than rounding, the end by far more: drawn through both, the radius changes evenly
    assert rows[0][2:] == pytest.approx(on) and all(x < y for x, y in zip(d, d[1:])) and bent[-1][2:] == pytest.approx(through)
    assert [p[0] for p in rows[-2:]] == [3, 4] and rows[-1][2:] == rows[0][2:]
    coded = [p for p in found["far"] if p[0] == 1]
    assert inverse_arrays([c[0]], [c[1]], [coded[-1][2]], [coded[-1][3]])[0][0] == pytest.approx(30.0)
    two = found["two"]
    assert [p[0] for p in two].count(2) == 1 and two[0][1] == "arc" and two[0][2:] == two[-1][2:]  # the first arc begins on the coded point


def border(i, seq, name):
    return (i, seq, "border", None, None, None, None, None, None, name)


def test_border_across_the_antimeridian(spark):
    line = [("L", k, (170.0 + k + 180) % 360 - 180, 10.0 + (k % 2) * 0.1) for k in range(20)]
    closed = [
        point("across", 0, 172.5, 10.2), border("across", 1, "L"), point("across", 2, -174.6, 9.7), point("across", 3, 179.0, 5.0),
        # the border closes the ring: its ends are the last and the first point; an unknown border leaves a gap
        border("round", 0, "L"), point("round", 1, 174.5, 10.0), point("round", 2, 171.5, 10.0), border("gap", 0, "X"), point("gap", 1, 0.0, 0.0), point("gap", 2, 1.0, 0.0),
    ]
    # open, first: from the border's own beginning
    lines = [point("back", 0, -174.6, 9.7), border("back", 1, "L"), point("back", 2, 172.5, 10.2), border("lead", 0, "L"), point("lead", 1, 172.5, 10.0)]
    found = {}
    for elements, kind in ((closed, True), (lines, False)):
        for r in B.drawn(spark.createDataFrame(elements, ELEMENT), spark.createDataFrame(line, "border string, k int, lon double, lat double"), ["id"], kind).where("kind = 'border'").orderBy("seq", "k").collect():
            found.setdefault(r.id, []).append(round(r.lon))
    assert found == {
        "across": [173, 174, 175, 176, 177, 178, 179, -180, -179, -178, -177, -176, -175], "round": [172, 173, 174],
        "back": [-175, -176, -177, -178, -179, -180, 179, 178, 177, 176, 175, 174, 173], "lead": [170, 171, 172],
    }


def test_closed_border_goes_the_shorter_way(spark):
    line = [("L", k, 5 * math.cos(math.radians(k * 30 % 360)), 5 * math.sin(math.radians(k * 30 % 360))) for k in range(13)]
    uses = spark.createDataFrame([(1, "L", 5.0, -1.5, 4.9, 1.4), (2, "L", 4.9, 1.4, 5.0, -1.5)], "u int, border string, from_lon double, from_lat double, to_lon double, to_lat double")
    got = B.follow_borders(uses, spark.createDataFrame(line, "border string, k int, lon double, lat double"), ["u"]).orderBy("u", "k").collect()
    assert [(r.u, round(r.lon, 6)) for r in got] == [(1, 5.0), (2, 5.0)] and all(0 < r.from_gap_nm < 30 for r in got)


def test_long_lines(spark):
    rows = [(1, 0.0, 50.0, 20.0, 50.0), (2, 170.0, 40.0, -170.0, 45.0), (3, 0.0, 0.0, 0.01, 0.0), (4, 0.0, 0.0, 30.0, 0.0), (5, 0.0, 89.5, 10.0, 80.0)]
    got = B.densify(spark.createDataFrame(rows, "i int, lon1 double, lat1 double, lon2 double, lat2 double"), ["i"]).orderBy("i", "k").collect()
    assert {r.i for r in got} == {1, 2}
    for i, *ends in rows[:2]:
        own = [(r.lon, r.lat) for r in got if r.i == i]
        total = inverse_arrays(*[[e] for e in ends])[0][0]
        legs = [(ends[0], ends[1]), *own, (ends[2], ends[3])]
        assert sum(inverse_arrays([a[0]], [a[1]], [b[0]], [b[1]])[0][0] for a, b in zip(legs, legs[1:])) == pytest.approx(total, abs=1e-6)


def test_empty(spark):
    assert B.drawn(spark.createDataFrame([], ELEMENT), spark.createDataFrame([], "border string, k int, lon double, lat double"), ["id"]).count() == 0
    assert B.arc_points(spark.createDataFrame([], ELEMENT).withColumn("x", F.lit(1)), ["id"]).count() == 0
