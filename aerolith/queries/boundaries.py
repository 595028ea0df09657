"""Arcs, published points beside them, long lines and followed borders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import wrap180
from ..functions.wgs84 import destination_table
from ..operators import boundary as B
from . import Family
from .geodesy import direct, inverse
from .spatial import LEGS_SQL, order_legs
from .tables import position, position_sql, sql_distance, table

FAMILY = Family()

CX, CY = position_sql("p_partkey", 0, 2)
ARCS_SQL = f"""arcs AS (SELECT p_partkey AS key, {CX} AS lon, {CY} AS lat, 0.5 + p_partkey % 130 AS r, p_partkey * 7 % 360 AS b1, (p_partkey * 13 + 1) % 360 AS b2, p_size % 2 = 0 AS cw FROM part)"""


def _sweep(a: str, b: str) -> str:
    turned = f"(((CASE WHEN cw THEN {b} - ({a}) ELSE {a} - ({b}) END) % 360 + 360) % 360)"
    return f"(CASE WHEN {turned} = 0 THEN 360 ELSE {turned} END)"


def part_arcs(spark, sf):
    lon, lat = position("p_partkey", 0, 2)
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("key"), lon.alias("lon"), lat.alias("lat"), (F.lit(0.5) + k % 130).alias("radius_nm"), (k * 7 % 360).cast("double").alias("from_deg"), ((k * 13 + 1) % 360).cast("double").alias("to_deg"),
        (F.col("p_size") % 2 == 0).alias("clockwise"),
    )


@FAMILY.add("fun_03_arc_points", f"""WITH {ARCS_SQL}, s AS (SELECT *, {_sweep('b1', 'b2')} AS sw, least(3.0, 2 * degrees(acos(1 - 0.9 * 0.005 / r))) AS step FROM arcs),
n AS (SELECT *, CAST(least(1440, greatest(2, ceil(sw / step))) AS INTEGER) AS n FROM s),
v AS (SELECT *, b1 + (CASE WHEN cw THEN sw ELSE -sw END) * k / n AS az FROM (SELECT *, unnest(generate_series(0, n)) AS k FROM n)),
{direct('p', 'v', 'lon', 'lat', 'az', 'r', 'x', 'y')} SELECT key AS p_partkey, k::int AS k, round(x, 6) AS lon, round(y, 6) AS lat FROM p""")
def _(spark, sf):
    v = B.arc_points(part_arcs(spark, sf), ["key"])
    return v.select(F.col("key").alias("p_partkey"), "k", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


# how far the published points beside an arc lie from its coded ends: degrees and share of the radius, null: no point
STARTS = [(0, 0.0), (0, 0.002), (0, 0.03), (8, 0.1), (0, 0.3), None, (20, 0.0)]
ENDS = [(0, 0.0), (-3, 0.08), (0, 0.01), None, (25, 0.0)]


def _offsets(shifts: list, modulo: int, place: int) -> str:
    cases = " ".join(f"WHEN {k} THEN {s[place]}" for k, s in enumerate(shifts) if s)
    return f"CASE key % {modulo} {cases} END"


def _fit_state(side: str) -> str:
    return f"CASE WHEN {side}g IS NULL THEN NULL WHEN {side}g <= 0.05 THEN 'on' WHEN {side}g <= least(0.5, 0.05 * r) THEN 'beside' WHEN {side}ok THEN 'through' ELSE 'off' END"


FIT_SQL = f"""WITH {ARCS_SQL}, o AS (SELECT *, {_offsets(STARTS, 7, 0)} AS sa, {_offsets(STARTS, 7, 1)} AS sr, {_offsets(ENDS, 5, 0)} AS ea, {_offsets(ENDS, 5, 1)} AS er FROM arcs),
{direct('pp', 'o', 'lon', 'lat', 'b1 + sa', 'r * (1 + sr)', 'px', 'py')}, {direct('nn', 'pp', 'lon', 'lat', 'b2 + ea', 'r * (1 + er)', 'nx', 'ny')},
{direct('c1', 'nn', 'lon', 'lat', 'b1', 'r', 'sx', 'sy')}, {direct('c2', 'c1', 'lon', 'lat', 'b2', 'r', 'ex', 'ey')},
{inverse('g1', 'c2', 'sx', 'sy', 'px', 'py', 'sg', 'sgz')}, {inverse('g2', 'g1', 'ex', 'ey', 'nx', 'ny', 'eg', 'egz')}, {inverse('h1', 'g2', 'lon', 'lat', 'px', 'py', 'sd', 'sz')}, {inverse('h2', 'h1', 'lon', 'lat', 'nx', 'ny', 'ed', 'ez')},
k AS (SELECT *, abs(sd - r) <= 0.15 * r AND abs(((sz - b1 + 180) % 360 + 360) % 360 - 180) <= 10 AS sok, abs(ed - r) <= 0.15 * r AND abs(((ez - b2 + 180) % 360 + 360) % 360 - 180) <= 10 AS eok FROM h2),
f AS (SELECT *, {_fit_state('s')} AS sf, {_fit_state('e')} AS ef FROM k),
t AS (SELECT *, coalesce(sf = 'through' OR (ef = 'through' AND sf = 'beside' AND sok), false) AS st, coalesce(ef = 'through' OR (sf = 'through' AND ef = 'beside' AND eok), false) AS et FROM f),
z AS (SELECT *, CASE WHEN st THEN sz ELSE b1 END AS f1, CASE WHEN et THEN ez ELSE b2 END AS f2 FROM t),
w AS (SELECT *, abs({_sweep('f1', 'f2')} - {_sweep('b1', 'b2')}) > 10 AS turned FROM z), q AS (SELECT *, st AND NOT turned AS s, et AND NOT turned AS e FROM w)"""


def published_arcs(spark, sf):
    """The arcs with published points beside them, some at the coded ends, some off them."""
    arcs = part_arcs(spark, sf)
    pick = lambda shifts, modulo, place: F.get(F.array(*[F.lit(float(s[place])) if s else F.lit(None).cast("double") for s in shifts]), (F.col("key") % modulo).cast("int"))
    for name, shifts, coded in (("prev", STARTS, "from_deg"), ("next", ENDS, "to_deg")):
        n = len(shifts)
        arcs = arcs.withColumns({"_a": F.col(coded) + pick(shifts, n, 0), "_r": F.col("radius_nm") * (1 + pick(shifts, n, 1))})
        arcs = destination_table(arcs, azimuth="_a", distance="_r").withColumnsRenamed({"dest_lon": f"{name}_lon", "dest_lat": f"{name}_lat"}).drop("_a", "_r")
        arcs = arcs.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in (f"{name}_lon", f"{name}_lat")})
    return arcs


@FAMILY.add("fun_03_fit_arc", f"""{FIT_SQL} SELECT key AS p_partkey, CASE WHEN s THEN 'through' WHEN sf = 'through' THEN 'off' ELSE sf END AS start_fit, CASE WHEN e THEN 'through' WHEN ef = 'through' THEN 'off' ELSE ef END AS end_fit, round(sg, 5) AS start_gap_nm, round(eg, 5) AS end_gap_nm,
  round(CASE WHEN s THEN sz ELSE b1 END, 5) % 360 AS fit_from, round(CASE WHEN e THEN ez ELSE b2 END, 5) % 360 AS fit_to, round(CASE WHEN s THEN sd ELSE r END, 5) AS fit_radius, round(CASE WHEN e THEN ed ELSE r END, 5) AS fit_end_radius FROM q""")
def _(spark, sf):
    fit = B.fit_arcs(published_arcs(spark, sf), ["key"])
    r = lambda c: F.round(c, 5).alias(c)
    return fit.select(F.col("key").alias("p_partkey"), "start_fit", "end_fit", r("start_gap_nm"), r("end_gap_nm"), *[(F.round(c, 5) % 360).alias(c) for c in ("fit_from", "fit_to")], r("fit_radius"), r("fit_end_radius"))


MERC = "ln(tan(pi() / 4 + radians(greatest(-89.9, least(89.9, {0}))) / 2))"


@FAMILY.add("fun_03_densify", f"""WITH {LEGS_SQL.split(', obs AS')[0]}, {inverse('i', 'legs', 'lon1', 'lat1', 'lon2', 'lat2', 'nm', 'az')}, {direct('m', 'i', 'lon1', 'lat1', 'az', 'nm / 2', 'mx', 'my')},
o AS (SELECT *, (lon1 + lon2) / 2 AS cx, greatest({sql_distance('mx', 'my', '((lon1 + lon2) / 2)', '((lat1 + lat2) / 2)')}, {sql_distance('mx', 'my', '((lon1 + lon2) / 2)', f"(degrees(2 * atan(exp(({MERC.format('lat1')} + {MERC.format('lat2')}) / 2))) - 90)")}) AS off FROM m WHERE nm >= 1),
n AS (SELECT *, CAST(least(512, ceil(sqrt(off / 0.005))) AS INTEGER) AS n FROM o WHERE off > 0.005), v AS (SELECT path, seq, lon1, lat1, az, nm, n, unnest(generate_series(1, n - 1)) AS k FROM n WHERE n > 1),
{direct('p', 'v', 'lon1', 'lat1', 'az', 'nm * k / n', 'x', 'y')} SELECT path, seq, k::int AS k, round(x, 5) AS lon, round(y, 5) AS lat FROM p""")
def _(spark, sf):
    return B.densify(order_legs(spark, sf), ["path", "seq"]).select("path", "seq", "k", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"))


# a border per nation: every third one is closed, several cross the antimeridian
WRAP = "((({0}) + 180) % 360 + 360) % 360 - 180"
BORDER_SQL = f"""borders AS (SELECT n_nationkey AS border, k, CASE WHEN n_nationkey % 3 = 0 THEN {WRAP.format("160 + n_nationkey * 5 + 8 * cos(2 * pi() * (k % 40) / 40)")} ELSE {WRAP.format("160 + n_nationkey * 5 + k * 0.5")} END AS lon,
  n_nationkey * 7 % 50 - 25 + CASE WHEN n_nationkey % 3 = 0 THEN 6 * sin(2 * pi() * (k % 40) / 40) ELSE k * 7 % 5 * 0.1 END AS lat FROM nation, (SELECT unnest(generate_series(0, 40)) AS k))"""


def nation_borders(spark, sf):
    n, k = F.col("border"), F.col("k")
    turn = 2 * F.pi() * (k % 40) / 40
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("border"), F.explode(F.sequence(F.lit(0), F.lit(40))).alias("k"))
    lon = F.lit(160) + n * 5 + F.when(n % 3 == 0, 8 * F.cos(turn)).otherwise(k * 0.5)
    return rows.select("border", "k", wrap180(lon).alias("lon"), (n * 7 % 50 - 25 + F.when(n % 3 == 0, 6 * F.sin(turn)).otherwise(k * 7 % 5 * 0.1)).alias("lat"))


@FAMILY.add("jon_18_follow_border", f"""WITH {BORDER_SQL},
seg AS (SELECT * FROM (SELECT *, lead(lon) OVER w AS x, lead(lat) OVER w AS y FROM borders WINDOW w AS (PARTITION BY border ORDER BY k)) WHERE x IS NOT NULL),
len AS (SELECT *, {sql_distance('lon', 'lat', 'x', 'y')} AS len FROM seg), cum AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY border ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM len),
tot AS (SELECT border, sum(len) AS total FROM len GROUP BY 1),
use AS (SELECT s_suppkey AS s, s_nationkey AS border, CASE WHEN s_suppkey % 9 <> 0 THEN s_suppkey % 37 END AS a, CASE WHEN s_suppkey % 13 <> 0 THEN s_suppkey * 11 % 38 END AS b FROM supplier),
ends AS (SELECT s, use.border, 'a' AS side, lon + 0.02 AS px, lat + 0.03 AS py FROM use JOIN borders ON borders.border = use.border AND k = a UNION ALL SELECT s, use.border, 'b', lon - 0.01, lat + 0.02 FROM use JOIN borders ON borders.border = use.border AND k = b),
rel AS (SELECT s, side, k, cum, len, cos(radians(py)) AS q, ({WRAP.format('lon - px')}) * cos(radians(py)) AS ax, lat - py AS ay, ({WRAP.format('x - lon')}) * cos(radians(py)) AS dx, y - lat AS dy FROM ends JOIN cum ON cum.border = ends.border),
t AS (SELECT *, greatest(0.0, least(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS t FROM rel), g AS (SELECT *, sqrt(power(ax + t * dx, 2) + power(ay + t * dy, 2)) * 60 AS gap FROM t),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s, side ORDER BY gap, k) AS rn FROM g) WHERE rn = 1),
w AS (SELECT use.s, use.border, use.border % 3 = 0 AND na.s IS NOT NULL AND nb.s IS NOT NULL AS loop, coalesce(na.k + na.t, -1e-9) AS a, coalesce(nb.k + nb.t, 40 + 1e-9) AS b, na.gap AS ga, nb.gap AS gb, na.cum + na.t * na.len AS ma, nb.cum + nb.t * nb.len AS mb, total
  FROM use JOIN tot USING (border) LEFT JOIN near na ON na.s = use.s AND na.side = 'a' LEFT JOIN near nb ON nb.s = use.s AND nb.side = 'b'),
d AS (SELECT *, CASE WHEN loop THEN (((mb - ma) % total + total) % total) * 2 <= total ELSE a <= b END AS ahead FROM w),
v AS (SELECT d.*, k, lon, lat, CASE WHEN ahead THEN k - a ELSE a - k END AS raw, CASE WHEN ahead THEN b - a ELSE a - b END AS far FROM d JOIN borders ON borders.border = d.border AND NOT (loop AND k = 40)),
u AS (SELECT *, CASE WHEN loop THEN (raw % 40 + 40) % 40 ELSE raw END AS pos, CASE WHEN loop THEN (far % 40 + 40) % 40 ELSE abs(far) END AS span FROM v)
SELECT s AS s_suppkey, CAST(row_number() OVER (PARTITION BY s ORDER BY pos) AS INTEGER) AS nth, round(lon, 6) AS lon, round(lat, 6) AS lat, round(ga, 5) AS from_gap_nm, round(gb, 5) AS to_gap_nm FROM u WHERE pos > 0 AND pos < span""")
def _(spark, sf):
    borders = nation_borders(spark, sf)
    k = F.col("s_suppkey")
    uses = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("border"), F.when(k % 9 != 0, k % 37).alias("_a"), F.when(k % 13 != 0, k * 11 % 38).alias("_b"))
    for side, at, dx, dy in (("from", "_a", 0.02, 0.03), ("to", "_b", -0.01, 0.02)):
        place = borders.select("border", F.col("k").cast("long").alias(at), (F.col("lon") + dx).alias(f"{side}_lon"), (F.col("lat") + dy).alias(f"{side}_lat"))
        uses = uses.join(place, ["border", at], "left")
    way = B.follow_borders(uses, borders, ["s_suppkey"])
    # the stretch of one use is at most its border
    nth = F.expr("cast(row_number() over (partition by s_suppkey order by k) as int)")
    return way.select("s_suppkey", nth.alias("nth"), *[F.round(c, 6).alias(c) for c in ("lon", "lat")], *[F.round(c, 5).alias(c) for c in ("from_gap_nm", "to_gap_nm")])
