"""OpenStreetMap elements as shapes, and their tags as aerodrome mapping types."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import number
from ..functions.words import lookup
from ..session import cut_lineage
from ..sources.osm import Extract
from .polygons import point_in_polygon, ring_edges

# Aeroway values that mean an area where their way is closed.
AREAS = ("aerodrome", "apron", "hangar", "helipad", "terminal")


def tag(name: str) -> Column:
    return F.try_element_at("tags", F.lit(name))


def way_ends(vertices: DataFrame) -> DataFrame:
    """id, first and last vertex, number of vertices of each way."""
    place = F.struct("lon", "lat")
    return vertices.groupBy("id").agg(F.min_by(place, "seq").alias("first"), F.max_by(place, "seq").alias("last"), F.count(F.lit(1)).alias("n"))


def stitched(members: DataFrame, vertices: DataFrame) -> DataFrame:
    """Rings of the relations: id, role, ring, nth, way, backwards.

    Ways of one role are joined end to end in the order of the members until the ring closes; what does not close is left
    out. Only the ends of the ways travel, and a relation has 32,000 members at most by the format, so one relation is
    one small group.
    """
    ends = members.join(way_ends(vertices).withColumnRenamed("id", "way"), "way").where("n > 1")
    role = F.when(F.col("role") == "inner", "inner").otherwise("outer")
    at = lambda c: F.concat_ws(" ", F.col(f"{c}.lon").cast("string"), F.col(f"{c}.lat").cast("string"))
    rows = ends.select("id", role.alias("role"), "seq", "way", at("first").alias("a"), at("last").alias("b"))
    # relations are many and small: a task reads its own one after the other, a call of the function for each would cost more
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id", "role")
    return dealt.sortWithinPartitions("id", "role", F.asc_nulls_last("seq"), "way").mapInPandas(_relations, "id string, role string, ring int, nth int, way string, backwards boolean")


def _relations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = (r for batch in batches for r in batch[["id", "role", "way", "a", "b"]].itertuples(index=False, name=None))
    out: list[tuple] = []
    for (relation, role), ways in groupby(rows, key=lambda r: r[:2]):
        out += [(relation, role, *found) for found in _rings([w[2:] for w in ways])]
        if len(out) >= 10000:
            yield pd.DataFrame(out, columns=RING_COLUMNS)
            out = []
    yield pd.DataFrame(out, columns=RING_COLUMNS)


RING_COLUMNS = ["id", "role", "ring", "nth", "way", "backwards"]


def _rings(rows: list[tuple]) -> list[tuple]:
    """(ring, nth, way, backwards) of the ways (way, first, last) of one relation and role."""
    at: dict[str, list[int]] = {}
    for k, (_, a, b) in enumerate(rows):
        at.setdefault(a, []).append(k)
        if b != a:
            at.setdefault(b, []).append(k)
    used: set[int] = set()
    out: list[tuple] = []
    ring = 0
    for k, (_, begin, end) in enumerate(rows):
        if k in used:
            continue
        used.add(k)
        chain = [(k, False)]
        while end != begin:
            ahead = next((j for j in at[end] if j not in used), None)
            if ahead is None:
                break
            used.add(ahead)
            backwards = rows[ahead][1] != end
            chain.append((ahead, backwards))
            end = rows[ahead][1] if backwards else rows[ahead][2]
        if end == begin:
            out += [(ring, nth, rows[j][0], back) for nth, (j, back) in enumerate(chain)]
            ring += 1
    return out


def ring_vertices(rings: DataFrame, vertices: DataFrame) -> DataFrame:
    """Vertices of stitched rings: id, role, ring, nth, seq (order inside a way as flown), lon, lat; a vertex that two ways share comes once."""
    ends = way_ends(vertices).select(F.col("id").alias("way"), "n")
    v = vertices.select(F.col("id").alias("way"), "seq", "lon", "lat")
    numbered = v.join(v.groupBy("way").agg(F.sort_array(F.collect_list("seq")).alias("_s")), "way").withColumn("_i", F.array_position("_s", F.col("seq")).cast("int") - 1)
    rows = rings.join(numbered, "way").join(ends, "way")
    order = F.when(F.col("backwards"), F.col("n") - 1 - F.col("_i")).otherwise(F.col("_i"))
    # written once: whoever looks for holes reads the vertices several times
    return cut_lineage(rows.withColumn("seq", order.cast("int")).where("nth = 0 or seq > 0").select("id", "role", "ring", "nth", "seq", "lon", "lat"))


def holes(vertices: DataFrame) -> DataFrame:
    """The outer ring each inner ring lies in: id, ring (inner), outer; found by the inner ring's first vertex."""
    flat = vertices.withColumn("_seq", F.struct("nth", "seq"))
    outer = flat.where("role = 'outer'").select("id", "ring", (F.col("nth") * 4096 + F.col("seq")).alias("seq"), "lon", "lat")
    inner = flat.where("role = 'inner'").groupBy("id", "ring").agg(F.min_by(F.struct("lon", "lat"), "_seq").alias("p")).select(F.struct(F.col("ring").alias("inner"), "id").alias("hole"), "id", "p.lon", "p.lat")
    hits = point_in_polygon(inner, ring_edges(outer, ["id", "ring"]), ["id", "ring"], "hole", shared=["id"])
    return hits.select("id", F.col("hole.inner").alias("ring"), F.col("ring").alias("outer"))


def shapes(osm: Extract) -> DataFrame:
    """Elements with a shape: kind, id, part, tags, shape (P, L, A), lon, lat (of points).

    A closed way of more than three vertices is an area where its tags say so; a relation gives one area per outer ring.
    """
    points = osm.elements.where("kind = 'node'").join(osm.points, "id").select("kind", "id", F.lit(0).alias("part"), "tags", F.lit("P").alias("shape"), "lon", "lat")
    ends = way_ends(osm.way_vertices).where("n > 1").select("id", ((F.col("first") == F.col("last")) & (F.col("n") > 3)).alias("closed"))
    said = F.coalesce(tag("area"), F.lit(""))
    areal = tag("building").isNotNull() | tag("building:part").isNotNull() | tag("landuse").isNotNull() | (F.coalesce(tag("natural"), F.lit("")) == "water") | F.coalesce(tag("aeroway"), F.lit("")).isin(*AREAS)
    is_area = F.col("closed") & (said != "no") & ((said == "yes") | areal)
    none = F.lit(None).cast("double")
    ways = osm.elements.where("kind = 'way'").join(ends, "id").select("kind", "id", F.lit(0).alias("part"), "tags", F.when(is_area, "A").otherwise("L").alias("shape"), none.alias("lon"), none.alias("lat"))
    rings = stitched(osm.members, osm.way_vertices).where("role = 'outer'").select("id", F.col("ring").alias("part")).distinct()
    areas = osm.elements.where("kind = 'relation'").join(rings, "id").select("kind", "id", "part", "tags", F.lit("A").alias("shape"), none.alias("lon"), none.alias("lat"))
    return points.unionByName(ways).unionByName(areas)


# Codes of ground surfaces, of structures with an extent and of point structures.
SURFACE = {
    "asphalt": "2", "bitumen": "10", "compacted": "8", "concrete": "1", "concrete:lanes": "1", "concrete:plates": "1", "dirt": "4", "earth": "4", "fine_gravel": "8", "grass": "7", "gravel": "8",
    "ground": "4", "paved": "2", "paving_stones": "11", "sand": "3", "sett": "13", "unpaved": "4",
}
STRUCTURE = {"control_tower": "3", "fire_station": "13", "hangar": "2", "terminal": "1", "tower": "3"}
POINT_STRUCTURE = {"antenna": "3", "beacon": "8", "lighthouse": "8", "mast": "3", "tower": "3", "windsock": "4"}

Rule = tuple[str, str, Callable[[], Column], dict[str, Callable[[], Column]]]


def _is(name: str, *values: str) -> Callable[[], Column]:
    return lambda: F.coalesce(tag(name), F.lit("")).isin(*values)


def _text(*names: str) -> Callable[[], Column]:
    return lambda: F.substring(F.coalesce(*[tag(n) for n in names]), 1, 254)


def _metres(*names: str) -> Callable[[], Column]:
    return lambda: F.coalesce(*[number(tag(n)) for n in names]).cast("string")


def _fixed(value: str) -> Callable[[], Column]:
    return lambda: F.lit(value)


def _direction() -> Column:
    way = F.coalesce(tag("oneway"), F.lit(""))
    return F.when(way == "yes", "1").when(way == "-1", "2").otherwise("0")


def _stop_kind() -> Column:
    said = F.upper(F.coalesce(tag("holding_position:type"), tag("aeroway:holding_position"), F.lit("")))
    return F.when(said.contains("III"), "4").when(said.contains("II"), "3").when(said.contains("ILS") | said.contains("CAT"), "1").otherwise("0")


def _height() -> Column:
    return F.round(F.coalesce(number(tag("height")), number(tag("building:levels")) * 3.5), 1).cast("string")


def _structure() -> Column:
    return F.coalesce(lookup(STRUCTURE, F.coalesce(tag("aeroway"), tag("building"))), F.when(tag("tower:type") == "airport_control", "3"), F.lit("4"))


def _point_kind() -> Column:
    return F.when(_is("aeroway", "navigationaid")(), F.lit("9")).otherwise(F.coalesce(lookup(POINT_STRUCTURE, F.coalesce(tag("aeroway"), tag("man_made"))), F.lit("3")))


def _approach_light() -> Column:
    return _is("aeroway", "navigationaid")() & F.coalesce(F.lower(tag("navigationaid")), F.lit("")).rlike("^(als|approach_light)")


def _point_structure() -> Column:
    return (F.coalesce(tag("man_made"), F.lit("")).isin(*POINT_STRUCTURE) | _is("aeroway", "navigationaid", "tower", "windsock")()) & ~_approach_light()


_open = {"status": _fixed("1")}
_ground = {"gsurftyp": lambda: lookup(SURFACE, tag("surface"))}
_stand = {"idstd": _text("ref", "name")}
_painted = {"color": _fixed("0"), "style": _fixed("0")}
# type, shapes it takes, condition, attributes by their codes; `width` is the width in metres that a line is given
RULES: list[Rule] = [
    ("TaxiwayGuidanceLine", "L", _is("aeroway", "taxiway", "taxilane"), {"idlin": _text("ref"), "direc": _direction, **_open, **_painted}),
    ("TaxiwayElement", "L", _is("aeroway", "taxiway"), {"idlin": _text("ref"), "width": _metres("width"), **_open, **_ground}),
    ("TaxiwayElement", "A", _is("aeroway", "taxiway", "taxilane"), {"idlin": _text("ref"), **_open}),
    ("ApronElement", "A", _is("aeroway", "apron"), {"idapron": _text("ref", "name", "name:en"), "aprontyp": _fixed("1"), **_open, **_ground}),
    ("ParkingStandLocation", "PLA", _is("aeroway", "parking_position"), _stand),
    ("StandGuidanceLine", "L", _is("aeroway", "parking_position"), {"direc": _fixed("1"), **_stand, **_open, **_painted}),
    ("ParkingStandArea", "A", _is("aeroway", "parking_position"), {**_stand, **_open}),
    ("TaxiwayHoldingPosition", "P", _is("aeroway", "holding_position"), {"idp": _text("ref"), "catstop": _stop_kind, "marktype": lambda: F.when(_stop_kind() == "0", "0").otherwise("1"), "holddir": _fixed("0"), **_open}),
    ("Stopway", "LA", _is("aeroway", "stopway"), {"width": _metres("width"), **_open}),
    ("Blastpad", "LA", _is("aeroway", "blast_pad"), {"width": _metres("width")}),
    ("TouchDownLiftOffArea", "PA", _is("aeroway", "helipad"), {"idrwy": lambda: F.substring(F.coalesce(tag("ref"), F.lit("H")), 1, 16), "width": _metres("diameter", "length", "width"), **_open}),
    ("VerticalPolygonalStructure", "A", lambda: tag("building").isNotNull() | _is("aeroway", "hangar", "terminal", "tower")(), {"plysttyp": _structure, "height": _height, "ident": _text("name", "name:en", "ref")}),
    ("AerodromeSurfaceLighting", "P", _approach_light, {"lgtuse": _fixed("9"), **_open}),
    ("VerticalPointStructure", "P", _point_structure, {"pntsttyp": _point_kind, "height": _metres("height")}),
    ("ServiceRoad", "L", _is("highway", "service"), {"featbase": _fixed("0"), "width": _metres("width"), **_ground}),
    ("Water", "A", _is("natural", "water"), {}),
]
# Widths in metres of lines that name none.
WIDTHS = {"ServiceRoad": 6.0, "TouchDownLiftOffArea": 20.0}


def osm_features(rows: DataFrame, have: DataFrame | None = None) -> DataFrame:
    """Aerodrome mapping features of the shapes: feature_type, kind, id, part, shape, attrs, source.

    One element may give several features (a taxiway: its guidance line and its surface). ``have``: feature_type that the
    data set gives itself, which then are not added. Rules are columns, so the rows are read once.
    """
    found = []
    for name, allowed, condition, attributes in RULES:
        values = [x for code, value in attributes.items() for x in (F.lit(code), value().cast("string"))]
        attrs = F.map_filter(F.create_map(*values), lambda _, v: v.isNotNull() & (v != "")) if values else F.create_map().cast("map<string,string>")
        if name in WIDTHS:
            attrs = F.map_concat(F.create_map(F.lit("width"), F.lit(str(WIDTHS[name]))), attrs)
        found.append(F.when(F.col("shape").isin(*allowed) & condition(), F.struct(F.lit(name).alias("feature_type"), attrs.alias("attrs"))))
    out = rows.select("kind", "id", "part", "shape", F.explode(F.array_compact(F.array(*found))).alias("f")).select("f.feature_type", "kind", "id", "part", "shape", "f.attrs")
    out = out.withColumn("source", F.concat(F.lit("OpenStreetMap contributors (ODbL 1.0), "), F.col("kind"), F.lit(" "), F.col("id")))
    return out if have is None else out.join(have.select("feature_type").distinct(), "feature_type", "left_anti")
