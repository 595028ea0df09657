"""Findings of the airspace checks on boundaries made of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import airspace_checks as C
from . import Family
from .boundaries import BORDER_SQL, FIT_SQL, WRAP, nation_borders, published_arcs
from .spatial import BOXES
from .tables import table

FAMILY = Family()
NO = lambda kind: F.lit(None).cast(kind)


def _elements(rows, *elements):
    """Element rows of boundaries: (kind, lon, lat, further columns) in order."""
    columns = {"radius_nm": "double", "from_deg": "double", "to_deg": "double", "clockwise": "boolean", "border": "long"}
    made = [F.struct(F.lit(k).alias("seq"), F.lit(kind).alias("kind"), lon.alias("lon"), lat.alias("lat"), *[more.get(c, NO(t)).alias(c) for c, t in columns.items()]) for k, (kind, lon, lat, more) in enumerate(elements)]
    return rows.select("airspace_id", F.lit(0).alias("ring"), F.explode(F.array(*made)).alias("e")).select("airspace_id", "ring", "e.*")


@FAMILY.add("job_02_arc_ends", f"""{FIT_SQL}, d AS (SELECT key, greatest(sg, eg) AS gap, CASE WHEN s THEN 'through' WHEN sf = 'through' THEN 'off' ELSE sf END AS a, CASE WHEN e THEN 'through' WHEN ef = 'through' THEN 'off' ELSE ef END AS b FROM q WHERE sg IS NOT NULL AND eg IS NOT NULL)
SELECT key AS airspace_id, 'arc end' AS rule, CASE WHEN gap >= 1 THEN 'error' ELSE 'warning' END AS severity, round(gap, 4) AS value, 'start ' || a || ' end ' || b AS detail FROM d WHERE gap > 0.05""")
def _(spark, sf):
    a = published_arcs(spark, sf).where("prev_lon is not null and next_lon is not null").withColumn("airspace_id", F.col("key"))
    arc = {c: F.col(c) for c in ("radius_nm", "from_deg", "to_deg", "clockwise")}
    e = _elements(a, ("point", F.col("prev_lon"), F.col("prev_lat"), {}), ("arc", F.col("lon"), F.col("lat"), arc), ("point", F.col("next_lon"), F.col("next_lat"), {}))
    return C.arc_ends(e).withColumn("value", F.round("value", 4))


@FAMILY.add("job_02_border_links", f"""WITH {BORDER_SQL}, seg AS (SELECT * FROM (SELECT *, lead(lon) OVER w AS x, lead(lat) OVER w AS y FROM borders WINDOW w AS (PARTITION BY border ORDER BY k)) WHERE x IS NOT NULL),
use AS (SELECT s_suppkey AS s, s_nationkey AS border, s_suppkey % 37 AS a, s_suppkey * 11 % 38 AS b FROM supplier),
ends AS (SELECT s, use.border, 'meets' AS side, lon + CASE WHEN s % 2 = 0 THEN 0.001 ELSE 0.02 END AS px, lat + CASE WHEN s % 2 = 0 THEN 0.001 ELSE 0.03 END AS py FROM use JOIN borders ON borders.border = use.border AND k = a
  UNION ALL SELECT s, use.border, 'leaves', lon - 0.01, lat + CASE WHEN s % 3 = 0 THEN 0.001 ELSE 0.2 END FROM use JOIN borders ON borders.border = use.border AND k = b),
rel AS (SELECT s, ends.border, side, cos(radians(py)) AS q, ({WRAP.format('lon - px')}) * cos(radians(py)) AS ax, lat - py AS ay, ({WRAP.format('x - lon')}) * cos(radians(py)) AS dx, y - lat AS dy FROM ends JOIN seg ON seg.border = ends.border WHERE s % 7 <> 0),
t AS (SELECT *, greatest(0.0, least(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS t FROM rel), g AS (SELECT s, border, side, min(sqrt(power(ax + t * dx, 2) + power(ay + t * dy, 2)) * 60) AS gap FROM t GROUP BY ALL)
SELECT s AS airspace_id, 'border join' AS rule, 'warning' AS severity, round(gap, 5) AS value, border || ' ' || side AS detail FROM g WHERE gap > 0.5
UNION ALL SELECT s, 'border missing', 'error', NULL, CAST(border + 100 AS VARCHAR) FROM use WHERE s % 7 = 0""")
def _(spark, sf):
    borders = nation_borders(spark, sf)
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").select(k.alias("airspace_id"), F.col("s_nationkey").cast("long").alias("nation"), (k % 37).alias("_a"), (k * 11 % 38).alias("_b"))
    for at in ("_a", "_b"):
        s = s.join(borders.select(F.col("border").cast("long").alias("nation"), F.col("k").cast("long").alias(at), F.col("lon").alias(f"x{at}"), F.col("lat").alias(f"y{at}")), ["nation", at])
    i = F.col("airspace_id")
    off = lambda m, far: F.when(i % m == 0, 0.001).otherwise(far)
    border = {"border": F.when(i % 7 == 0, F.col("nation") + 100).otherwise(F.col("nation"))}
    e = _elements(s, ("point", F.col("x_a") + off(2, 0.02), F.col("y_a") + off(2, 0.03), {}), ("border", NO("double"), NO("double"), border), ("point", F.col("x_b") - 0.01, F.col("y_b") + off(3, 0.2), {}))
    return C.border_links(e, borders.withColumn("border", F.col("border").cast("long"))).withColumn("value", F.round("value", 5))


@FAMILY.add("job_02_point_links", """SELECT o_custkey AS airspace_id, 'point missing' AS rule, 'error' AS severity, NULL::DOUBLE AS value, lower(o_orderstatus) || ' P' || o_orderkey AS detail FROM orders WHERE o_orderkey NOT IN (SELECT p_partkey * 3 FROM part)""")
def _(spark, sf):
    links = table(spark, sf, "orders").select(F.col("o_custkey").alias("airspace_id"), F.concat(F.lit("P"), "o_orderkey").alias("ref"), F.lower("o_orderstatus").alias("what"))
    return C.point_links(links, table(spark, sf, "part").select(F.concat(F.lit("P"), F.col("p_partkey") * 3).alias("ref")))


@FAMILY.add("job_02_contributors", """SELECT l_suppkey AS airspace_id, 'contributor' AS rule, 'warning' AS severity, l_linenumber::DOUBLE AS value, CASE WHEN p_partkey IS NULL THEN 'missing ' ELSE 'without shape ' END || (l_partkey + l_linenumber % 2 * 100000) AS detail
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey + l_linenumber % 2 * 100000 WHERE p_partkey IS NULL OR p_size < 10""")
def _(spark, sf):
    c = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("airspace_id"), F.col("l_linenumber").alias("step"), (F.col("l_partkey") + F.col("l_linenumber") % 2 * 100000).alias("contributor_id"))
    return C.contributors(c, table(spark, sf, "part").select(F.col("p_partkey").alias("airspace_id"), (F.col("p_size") >= 10).alias("has_shape")))


@FAMILY.add("job_02_crossings", f"""WITH {BOXES} SELECT nation AS airspace_id, 'crosses itself' AS rule, 'warning' AS severity, 1.0::DOUBLE AS value, 'ring 0' AS detail FROM boxes WHERE nation % 2 = 1 AND nation % 6 <> 3""")
def _(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("airspace_id"))
    k = F.col("airspace_id")
    n = n.withColumns({"w": (k * 29 % 300) - 150.0, "s": (k * 17 % 120) - 60.0}).withColumns({"e": F.col("w") + 10 + k % 7 * 4, "t": F.col("s") + 8 + k % 5 * 3})
    corner = lambda i, x, y: F.struct(F.lit(i).alias("seq"), F.col(x).alias("lon"), F.col(y).alias("lat"))
    bow, box = ([corner(0, "w", "s"), corner(1, "e", "t"), corner(2, "e", "s"), corner(3, "w", "t")], [corner(0, "w", "s"), corner(1, "e", "s"), corner(2, "e", "t"), corner(3, "w", "t")])
    v = n.select("airspace_id", F.lit(0).alias("ring"), F.explode(F.when(k % 2 == 1, F.array(*bow)).otherwise(F.array(*box))).alias("p")).select("airspace_id", "ring", "p.*")
    # of every third bow the crossing edge is beside an arc end that was found already
    steps = n.where("airspace_id % 6 = 3").select("airspace_id", F.col("w").alias("lon"), F.col("s").alias("lat"), F.lit(2.0).alias("gap_nm"))
    return C.crossings(v, steps)
