"""Checks of airspace boundaries: each finding is a row airspace_id, rule, severity, value, detail.

The boundaries are the element rows of ``operators.boundary``; every check is one function, ``airspace_checks`` their sum.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import distance_nm
from ..operators.boundary import ON_ARC_NM, beside, fit_arcs, placed_on_borders
from ..operators.polygons import ring_edges, self_crossings

RING = ["airspace_id", "ring"]
# Fixed values (NM): a gap that is an error instead of a warning; how near a boundary joins the border it follows.
WIDE_GAP_NM, JOIN_NM = 1.0, 0.5


def _found(rule: str, severity: Column | str, value: Column, *detail: Column) -> list[Column]:
    sev = severity if isinstance(severity, Column) else F.lit(severity)
    return ["airspace_id", F.lit(rule).alias("rule"), sev.alias("severity"), value.cast("double").alias("value"), F.concat_ws(" ", *detail).alias("detail")]


def arc_ends(elements: DataFrame) -> DataFrame:
    """Arcs whose coded ends miss the published points beside them by more than rounding; the detail says at which of
    them the arc is drawn through the point (``through``) or keeps a step (``off``, ``beside``)."""
    rows = beside(elements, RING, closed=True).where("kind = 'arc' and prev_lon is not null and next_lon is not null")
    rows = fit_arcs(rows, [*RING, "seq"]).withColumn("gap", F.greatest("start_gap_nm", "end_gap_nm")).where(F.col("gap") > ON_ARC_NM)
    return rows.select(*_found("arc end", F.when(F.col("gap") >= WIDE_GAP_NM, "error").otherwise("warning"), F.col("gap"), F.lit("start"), F.col("start_fit"), F.lit("end"), F.col("end_fit")))


def border_links(elements: DataFrame, borders: DataFrame) -> DataFrame:
    """Borders that are not in the data, and points that lie off the border the boundary follows from or to them."""
    keys = [*RING, "seq"]
    uses = beside(elements, RING, closed=True).where("kind = 'border'")
    known = borders.select("border").distinct()
    lost = uses.join(known, "border", "left_anti").select(*_found("border missing", "error", F.lit(None), F.col("border")))
    placed = placed_on_borders(uses.join(known, "border", "left_semi"), borders, keys).where(F.col("p.gap") > JOIN_NM)
    return lost.unionByName(placed.select(*_found("border join", "warning", F.col("p.gap"), F.col("border"), F.when(F.col("side") == "from", "meets").otherwise("leaves"))))


def point_links(links: DataFrame, positions: DataFrame) -> DataFrame:
    """Points and centres of arcs that other features hold and that have no position in the data.

    ``links``: airspace_id, ref, what (point, arc, circle); ``positions``: ref.
    """
    lost = links.join(positions.select("ref").distinct(), "ref", "left_anti")
    return lost.select(*_found("point missing", "error", F.lit(None), F.col("what"), F.col("ref")))


def contributors(components: DataFrame, airspaces: DataFrame) -> DataFrame:
    """Airspace built from others that are not in the data or have no shape of their own.

    ``components``: airspace_id, step, contributor_id; ``airspaces``: airspace_id, has_shape.
    """
    other = airspaces.select(F.col("airspace_id").alias("contributor_id"), "has_shape")
    rows = components.where("contributor_id is not null").join(other, "contributor_id", "left")
    lost = rows.where("has_shape is null or not has_shape")
    return lost.select(*_found("contributor", "warning", F.col("step"), F.when(F.col("has_shape").isNull(), "missing").otherwise("without shape"), F.col("contributor_id")))


def crossings(vertices: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Boundaries that cross themselves: the number of crossings, one finding a ring.

    ``vertices``: airspace_id, ring, seq, lon, lat as drawn. ``steps``: airspace_id, lon, lat, gap_nm of arc ends found
    off their points; a crossing beside one is the same fault and is left out.
    """
    edges = ring_edges(vertices, RING)
    pairs = self_crossings(edges, RING)
    if steps is not None:
        at = pairs.join(edges.select(*RING, F.col("seq").alias("seq_a"), "lon1", "lat1", "lon2", "lat2"), [*RING, "seq_a"])
        near = at.join(steps.select("airspace_id", F.col("lon").alias("x"), F.col("lat").alias("y"), "gap_nm"), "airspace_id")
        reach = F.greatest(F.lit(1.0), F.col("gap_nm") + 0.5)
        same = near.where((distance_nm("lon1", "lat1", "x", "y") < reach) | (distance_nm("lon2", "lat2", "x", "y") < reach)).select(*RING, "seq_a", "seq_b").distinct()
        pairs = pairs.join(same, [*RING, "seq_a", "seq_b"], "left_anti")
    return pairs.groupBy(*RING).agg(F.count(F.lit(1)).alias("n")).select(*_found("crosses itself", "warning", F.col("n"), F.lit("ring"), F.col("ring").cast("string")))


def overlaps(pairs: DataFrame) -> DataFrame:
    """Findings of `polygons.airspace_overlaps`: id_a, id_b, area_nm2, severity."""
    return pairs.withColumnRenamed("id_a", "airspace_id").select(*_found("overlap", F.col("severity"), F.col("area_nm2"), F.col("id_b").cast("string")))


def airspace_checks(*findings: DataFrame) -> DataFrame:
    """All findings; the same fault of one airspace comes once, at its largest."""
    every = reduce(DataFrame.unionByName, findings)
    return every.groupBy("airspace_id", "rule", "severity", "detail").agg(F.max("value").alias("value")).select("airspace_id", "rule", "severity", "value", "detail")
