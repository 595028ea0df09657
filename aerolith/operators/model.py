"""The feature model over read data: positions, labels and keys of features, and the tables that assessments start from.

Inputs are long tables (one row per vertex, property, part, reference), so any reader can feed them. Every operator is
aggregates and equi joins: a feature with very many rows is combined before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import arc_between, bearing, col, dest_lat, dest_lon
from ..functions.words import let, lookup
from .ordered import top_k_per_key
from .refs import resolve_refs
from .stage import settle

# The property that holds the position of a type (others: location), and equipment a navaid lists.
POSITION_PROPERTY = {"AirportHeliport": "ARP", "RunwayDirection": "_thr", "Unit": "position", "VerticalStructure": "part"}
NAVAID_EQUIPMENT = ("Azimuth", "DME", "DirectionFinder", "Elevation", "Glidepath", "Localizer", "MarkerBeacon", "NDB", "SDF", "TACAN", "VOR")
THRESHOLD_ROLES = {"THR": 0, "DISTHR": 1}


def points_of(features: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One position per feature that has any: feature_id, lon, lat, source (own, threshold, part of a shape, navaid).

    ``features``: feature_id, feature_type, role; ``vertices``: feature_id, prop, shape (P point, L line, A area), seq,
    lon, lat; ``edges``: src_id, src_type, target_id. Order: the type's own property, the threshold among the centreline
    points of a runway direction, any point, the first vertex of a line or area, the position of the first navaid that
    lists the equipment. Of equal ranks the smallest (prop, seq, lon, lat) counts. Vertices without numbers are passed over.
    """
    own_prop = F.coalesce(lookup(POSITION_PROPERTY, F.col("feature_type")), F.lit("location"))
    rank = F.when((F.col("shape") == "P") & (F.col("prop") == own_prop), 0).when(F.col("shape") == "P", 2).otherwise(3)
    known = vertices.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).join(features.select("feature_id", "feature_type"), "feature_id")
    best = known.groupBy("feature_id").agg(F.min(F.struct(rank.alias("rank"), "prop", "seq", "lon", "lat")).alias("_own"))
    at = best.select(F.col("feature_id").alias("src_id"), F.col("_own.lon").alias("lon"), F.col("_own.lat").alias("lat"))
    roles = features.select(F.col("feature_id").alias("src_id"), lookup(THRESHOLD_ROLES, F.col("role")).alias("_r")).filter("_r is not null")
    lent = edges.filter(F.col("src_type").isin("Navaid", "RunwayCentrelinePoint")).join(at, "src_id").join(roles, "src_id", "left")
    lent = lent.groupBy(F.col("target_id").alias("feature_id")).agg(
        F.min(F.when((F.col("src_type") == "RunwayCentrelinePoint") & F.col("_r").isNotNull(), F.struct("_r", "src_id", "lon", "lat"))).alias("_thr"),
        F.min(F.when(F.col("src_type") == "Navaid", F.struct("src_id", "lon", "lat"))).alias("_nav"),
    )
    out = features.select("feature_id", "feature_type").join(best, "feature_id", "left").join(lent, "feature_id", "left")
    spot = lambda s, name: F.struct(F.col(f"{s}.lon").alias("lon"), F.col(f"{s}.lat").alias("lat"), name.alias("source"))
    own = spot("_own", F.when(F.col("_own.rank") == 3, "part of a shape").otherwise("own"))
    p = (
        F.when(F.col("_own.rank") == 0, own).when((F.col("feature_type") == "RunwayDirection") & F.col("_thr").isNotNull(), spot("_thr", F.lit("threshold")))
        .when(F.col("_own").isNotNull(), own).when(F.col("feature_type").isin(*NAVAID_EQUIPMENT) & F.col("_nav").isNotNull(), spot("_nav", F.lit("navaid")))
    )
    return out.select("feature_id", F.explode(F.array_compact(F.array(p))).alias("p")).select("feature_id", "p.*")


# Parts of the display label by type ('/' separates alternatives), and of the key that outlives versions.
LABEL_PARTS = {
    "AirportHeliport": "locationIndicatorICAO/designator name", "Airspace": "type designator name", "DesignatedPoint": "designator/name", "Navaid": "type designator name",
    "OrganisationAuthority": "name/designator", "Route": "designator name", "Runway": "@owner +RWY designator", "RunwayDirection": "@owner +RWY designator", "Unit": "name/designator",
    "VOR": "+VOR designator name", "DME": "+DME designator name", "NDB": "+NDB designator name", "VerticalStructure": "name/designator/type",
}
KEY_PARTS = {
    "AirportHeliport": "locationIndicatorICAO/designator", "Airspace": "type designator/name", "DesignatedPoint": "designator/@place", "Navaid": "type designator @owner",
    "RouteSegment": "route start end", "Runway": "@owner designator", "RunwayDirection": "@owner designator", "VerticalStructure": "name @place",
}


def _parts(table: dict[str, str], default: str, props: Column, extra: dict[str, Column], separator: str, missing: bool) -> Column:
    """Text of the parts of a type. ``missing``: whether an absent part leaves an empty place."""
    def one(word: str) -> Column:
        if word.startswith("+"):
            return F.lit(word[1:])
        given = [extra[w[1:]] if w.startswith("@") else F.try_element_at(props, F.lit(w)) for w in word.split("/")]
        found = F.coalesce(*[F.nullif(F.trim(g), F.lit("")) for g in given])
        return F.coalesce(found, F.lit("")) if missing else found

    text = lambda spec: F.concat_ws(separator, F.array_distinct(F.array(*[one(w) for w in spec.split()])) if not missing else F.array(*[one(w) for w in spec.split()]))
    out = text(default)
    for kind, spec in table.items():
        out = F.when(F.col("feature_type") == kind, text(spec)).otherwise(out)
    return out


def labels(features: DataFrame) -> DataFrame:
    """Display label and version-independent key: feature_id, label, natural_key.

    ``features``: feature_id, feature_type, props (MAP of property to text), owner (code of the owning aerodrome),
    lon, lat. Without any part the label is the type and the start of the id; a key without any part is null.
    """
    place = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.format_string("%.3f %.3f", F.col("lat"), F.col("lon")))
    extra = {"owner": F.col("owner"), "place": place}
    label = _parts(LABEL_PARTS, "designator/name/type", F.col("props"), extra, " ", False)
    key = _parts(KEY_PARTS, "designator/name", F.col("props"), extra, "|", True)
    empty = F.regexp_replace(key, r"\|", "") == ""
    return features.select(
        "feature_id", F.coalesce(F.nullif(label, F.lit("")), F.concat_ws(" ", "feature_type", F.substring("feature_id", 1, 24))).alias("label"),
        F.when(~empty, F.concat_ws("|", "feature_type", key)).alias("natural_key"),
    )


def obstacle_rows(parts: DataFrame) -> DataFrame:
    """One row per obstacle of its parts: highest elevation and height, worst accuracies, first type; flags that any part carries.

    ``parts``: obstacle_id, part_no, name, type, elev_m, hgt_m, h_acc_m, v_acc_m, lighted, marked, lon, lat (metres; null
    where not given).
    """
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("part_no", c)))[c].alias(c)
    any_yes = lambda c: F.max(F.when(F.col(c) == "YES", 2).when(F.col(c) == "NO", 1))
    flag = lambda c: F.when(any_yes(c) == 2, "YES").when(any_yes(c) == 1, "NO").alias(c)
    place = F.min(F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.struct("part_no", "lon", "lat")))
    return parts.groupBy("obstacle_id").agg(
        first("name"), first("type"), *[F.max(c).alias(c) for c in ("elev_m", "hgt_m", "h_acc_m", "v_acc_m")], flag("lighted"), flag("marked"),
        place["lon"].alias("lon"), place["lat"].alias("lat"), F.count(F.lit(1)).alias("n_parts"),
    )


def procedure_legs(listed: DataFrame, named: DataFrame) -> DataFrame:
    """Legs of procedures: proc_id, transition, seq, leg_id, origin.

    ``listed``: proc_id, transition, seq, leg_id (from the transitions); ``named``: leg_id, proc_id, seq (legs that only
    name their procedure). A leg that a transition of the procedure lists is not taken again.
    """
    more = named.select("proc_id", F.lit(None).cast("string").alias("transition"), "seq", "leg_id").join(listed.select("proc_id", "leg_id"), ["proc_id", "leg_id"], "left_anti")
    cols = ["proc_id", "transition", "seq", "leg_id"]
    return listed.select(*cols).withColumn("origin", F.lit("listed")).unionByName(more.select(*cols).withColumn("origin", F.lit("named")))


# Nautical miles of a leg that has a course and no length, and the most that is drawn of one; arc legs.
COURSE_NM, COURSE_MOST_NM, ARC_LEGS = 3.0, 10.0, ("AF", "RF")
_POINT, _LINE = "struct<lon: double, lat: double>", "array<struct<lon: double, lat: double>>"


def procedure_paths(legs: DataFrame, proc: str = "proc_id") -> DataFrame:
    """The path of each leg of the procedures: proc, seq, leg_id, way (trajectory, arc, line, course), path (points).

    ``legs``: proc, transition, seq, leg_id, leg_type, start, end, centre (points or null), clockwise, course, length_nm,
    trajectory (points or null), origin (where the procedure begins, or null). A leg begins where the one before it
    ended unless it names its start; a named transition after another one begins at the origin again. A leg without a path (an initial
    fix, a leg reduced to its end) still sets where the next one begins. Null turns take the shorter way.

    What a leg ends on decides the next one, so the legs of one procedure, a few dozen by the format, are folded in
    order; procedures are spread over the tasks.
    """
    leg = F.struct("seq", "leg_id", F.coalesce("transition", F.lit("")).alias("tr"), F.upper(F.coalesce("leg_type", F.lit(""))).alias("type"), "start", "end", "centre", "clockwise", "course", "length_nm", "trajectory")
    # legs are small and cost much: they are dealt out by number, not by size
    dealt = legs.repartition(int(legs.sparkSession.conf.get("spark.sql.shuffle.partitions")), proc)
    rows = dealt.groupBy(proc).agg(F.sort_array(F.collect_list(leg)).alias("_legs"), F.min("origin").alias("_origin"))
    state = F.struct(F.col("_origin").cast(_POINT).alias("at"), F.lit(None).cast("string").alias("tr"), F.array().cast(_LINE).alias("out"))

    def way_of(x: Column, a: Column, b: Column) -> Column:
        both = a.isNotNull() & b.isNotNull()
        return (
            F.when(F.size(F.coalesce(x["trajectory"], F.array().cast(_LINE))) > 1, "trajectory").when(both & x["type"].isin(*ARC_LEGS) & x["centre"].isNotNull(), "arc").when(both, "line")
            .when(a.isNotNull() & x["course"].isNotNull(), "course")
        )

    def ahead(x: Column, a: Column) -> Column:
        far = F.least(F.coalesce(F.nullif(x["length_nm"], F.lit(0.0)), F.lit(COURSE_NM)), F.lit(COURSE_MOST_NM))
        return F.struct(dest_lon(a["lon"], a["lat"], x["course"], far).alias("lon"), dest_lat(a["lat"], x["course"], far).alias("lat")).cast(_POINT)

    def step(acc: Column, x: Column) -> Column:
        """Only where a leg begins is folded; it is drawn after that, leg by leg."""
        again = (F.coalesce(acc["tr"], F.lit("")) != "") & (acc["tr"] != x["tr"]) & (x["tr"] != "")
        before = F.when(again, F.col("_origin").cast(_POINT)).otherwise(acc["at"])
        return let(F.struct(before.alias("before"), F.coalesce(x["start"], before).cast(_POINT).alias("a")), lambda p: ended(acc, x, p["a"], x["end"], p["before"]))

    def ended(acc: Column, x: Column, a: Column, b: Column, before: Column) -> Column:
        w = way_of(x, a, b)
        at = (
            F.when(w.isNull(), F.coalesce(b, F.when(x["type"] == "IF", a), before)).when(w == "trajectory", F.element_at(x["trajectory"], -1))
            .when(w.isin("arc", "line"), b).otherwise(ahead(x, a))
        )
        return F.struct(at.cast(_POINT).alias("at"), x["tr"].alias("tr"), F.concat(acc["out"], F.array(before.cast(_POINT)).cast(_LINE)).alias("out"))

    begun = settle(rows, _before=F.aggregate("_legs", state, step, lambda acc: acc["out"]))
    drawn = begun.select(proc, F.explode(F.transform("_legs", lambda x, i: F.struct(x.alias("x"), F.get("_before", i).alias("before")))).alias("l")).select(proc, "l.x", F.coalesce("l.x.start", "l.before").cast(_POINT).alias("_a"))
    x, a, b, c = F.col("x"), F.col("_a"), F.col("x.end"), F.col("x.centre")
    drawn = settle(drawn, way=way_of(x, a, b)).filter(F.col("way").isNotNull())
    right = F.pmod(bearing(c["lon"], c["lat"], b["lon"], b["lat"]) - bearing(c["lon"], c["lat"], a["lon"], a["lat"]), F.lit(360.0)) <= 180
    w = F.col("way")
    path = (
        F.when(w == "trajectory", x["trajectory"].cast(_LINE)).when(w == "arc", F.concat(F.array(a), arc_between(c, a, b, F.coalesce(x["clockwise"], right)), F.array(b)).cast(_LINE))
        .when(w == "line", F.array(a, b).cast(_LINE)).otherwise(F.array(a, ahead(x, a)).cast(_LINE))
    )
    return settle(drawn.select(proc, F.col("x.seq").cast("int").alias("seq"), F.col("x.leg_id").cast("string").alias("leg_id"), "way", "x", "_a"), path=path).drop("x", "_a")


# The kinds of declared distance.
DECLARED = ("TORA", "TODA", "ASDA", "LDA")


def runway_ends(directions: DataFrame, points: DataFrame, distances: DataFrame) -> DataFrame:
    """Each runway direction with its threshold, its end and its declared distances in metres.

    ``directions``: dir_id, runway_id, designator; ``points``: dir_id, point_id, role, lon, lat, elev_m; ``distances``:
    dir_id, kind, metres. The threshold is the point with role THR, else DISTHR, else START; the end has role END, else
    is the threshold of the opposite direction of the runway. Of repeated distances the shortest counts.
    """
    rank = lambda table: F.min(F.when(lookup(table, F.col("role")).isNotNull(), F.struct(lookup(table, F.col("role")).alias("_r"), "point_id", "lon", "lat", "elev_m")))
    spots = points.groupBy("dir_id").agg(rank({"THR": 0, "DISTHR": 1, "START": 2}).alias("_t"), rank({"END": 0}).alias("_e"))
    lengths = distances.groupBy("dir_id").agg(*[F.min(F.when(F.col("kind") == k, F.col("metres"))).alias(f"{k.lower()}_m") for k in DECLARED])
    ends = directions.join(spots, "dir_id", "left").join(lengths, "dir_id", "left")
    # a runway has few directions; of more than one other direction the smallest id lends its threshold
    pair = ends.groupBy("runway_id").agg(F.array_sort(F.collect_set(F.when(F.col("_t").isNotNull(), F.struct("dir_id", F.col("_t.lon").alias("lon"), F.col("_t.lat").alias("lat"))))).alias("_all"))
    other = F.get(F.filter("_all", lambda x: x["dir_id"] != F.col("dir_id")), F.lit(0))
    return ends.join(pair, "runway_id", "left").select(
        "dir_id", "runway_id", "designator", F.col("_t.lon").alias("thr_lon"), F.col("_t.lat").alias("thr_lat"), F.col("_t.elev_m").alias("thr_elev_m"),
        F.coalesce(F.col("_e.lon"), other["lon"]).alias("end_lon"), F.coalesce(F.col("_e.lat"), other["lat"]).alias("end_lat"), *[f"{k.lower()}_m" for k in DECLARED],
    )


def procedure_places(refs: DataFrame, features: DataFrame, peers: DataFrame) -> DataFrame:
    """Aerodrome and runway directions of procedures: proc_id, kind, target_id, found_in.

    References (dataset_id, src_id, prop, ref, ref_no) are resolved in their own data set, else in the first other one
    (``peers``: dataset_id, dataset_order, feature_id, feature_type) that has the feature. Repeated references count once.
    """
    kinds = {"AirportHeliport": "aerodrome", "RunwayDirection": "runway", "TouchDownLiftOff": "runway"}
    resolved = resolve_refs(refs, features)
    here = resolved.filter(F.col("target_id").isNotNull()).select("src_id", "target_id", "target_type", F.col("dataset_id").alias("found_in"))
    first = peers.groupBy(F.col("feature_id").alias("ref")).agg(F.min_by(F.struct("dataset_id", "feature_type"), "dataset_order").alias("_p"))
    there = resolved.filter(F.col("target_id").isNull()).join(first, "ref").select("src_id", F.col("ref").alias("target_id"), F.col("_p.feature_type").alias("target_type"), F.col("_p.dataset_id").alias("found_in"))
    return here.unionByName(there).withColumn("kind", lookup(kinds, F.col("target_type"))).filter("kind is not null").select(F.col("src_id").alias("proc_id"), "kind", "target_id", "found_in").distinct()


def consolidate(slices: DataFrame, cycle: str) -> tuple[DataFrame, DataFrame]:
    """What is valid from a cycle on, each slice once, and the counts of what was left out.

    ``slices``: feature_id, interp, seq, corr, valid_begin, valid_end, life_end, gone. Left out in this order: slices
    of withdrawn features (gone, or lifetime ended by the cycle), slices ended by it, repeated slices of one (feature,
    interpretation, sequence, correction). Returns (slices, counts by reason).
    """
    at = F.lit(cycle).cast("timestamp")
    key = ["feature_id", "interp", "seq", "corr"]
    reason = F.when(F.coalesce(F.col("gone"), F.lit(False)) | (F.col("life_end") <= at), "withdrawn").when(F.col("valid_end") <= at, "ended").otherwise("kept")
    marked = slices.withColumn("_why", reason)
    kept = marked.filter("_why = 'kept'").drop("_why")
    once = kept.dropDuplicates(key)
    tally = marked.groupBy(F.col("_why").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    extra = kept.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("_more")).agg(F.coalesce(F.sum("_more"), F.lit(0)).alias("n"))
    repeated = extra.select(F.lit("repeated").alias("reason"), "n")
    return once, tally.filter("reason <> 'kept'").unionByName(repeated)


def pick(values: DataFrame, selection: DataFrame, items: Sequence[str], key: str = "ad_id") -> DataFrame:
    """Custom extraction: chosen items of chosen aerodromes, one row per aerodrome and one column per item.

    ``values``: key, item, value; ``selection``: key. Several values of an item are joined in their order by '; '.
    """
    chosen = values.filter(F.col("item").isin(*items) & F.col("value").isNotNull()).join(selection.select(key).distinct(), key, "left_semi")
    cell = lambda i: F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(F.col("item") == i, F.col("value")))), "; "), F.lit("")).alias(i)
    return chosen.groupBy(key).agg(*[cell(i) for i in items])


def notes(annotations: DataFrame, prop: str | None = None, most: int | None = None) -> DataFrame:
    """Remarks of features: feature_id, purpose, text, in reading order.

    ``annotations``: feature_id, note_no, prop (null: on the feature as a whole), purpose, text. With ``prop`` only the
    notes on that property, else those on the feature. Equal texts of a feature count once; ``most`` keeps the first few.
    """
    about = F.lower("prop") == prop.lower() if prop else F.col("prop").isNull()
    once = annotations.filter(about & (F.trim(F.coalesce("text", F.lit(""))) != "")).groupBy("feature_id", F.trim("text").alias("text")).agg(F.min(F.struct("note_no", "purpose")).alias("_m"))
    out = once.select("feature_id", "text", F.col("_m.note_no").alias("note_no"), F.coalesce("_m.purpose", F.lit("REMARK")).alias("purpose"))
    return out if most is None else top_k_per_key(out, ["feature_id"], [F.col("note_no"), F.col("text")], most)


# ---------------------------------------------------------------- readable texts

# Units and references as they are printed.
UNIT_TEXT = {"FT": "ft", "M": "m", "KM": "km", "NM": "NM", "MHZ": "MHz", "KHZ": "kHz", "SM": "SM"}
REFERENCE_TEXT = {"MSL": "AMSL", "OTHER:ALT": "AMSL", "OTHER:HEI": "AGL", "SFC": "AGL", "STD": "STD", "W84": "W84"}


def limit_text(value, uom, reference) -> Column:
    """Vertical limit as printed: UNL, GND, 'FL 95', '2500 ft AMSL'; empty without a value."""
    v, u, r = F.trim(col(value).cast("string")), F.coalesce(col(uom), F.lit("")), F.coalesce(col(reference), F.lit(""))
    said = F.concat_ws(" ", v, F.nullif(F.coalesce(lookup(UNIT_TEXT, u), u), F.lit("")), F.nullif(F.coalesce(lookup(REFERENCE_TEXT, r), F.regexp_replace(r, "^OTHER:", "")), F.lit("")))
    word = F.upper(v).isin("UNL", "GND", "FLOOR", "CEILING") | (u == "OTHER")
    return F.when(F.coalesce(v, F.lit("")) == "", "").when(word, F.upper(v)).when(u == "FL", F.concat(F.lit("FL "), v)).when((r == "SFC") & (v.try_cast("double") == 0), "GND").otherwise(said)


def frequency_text(value, uom) -> Column:
    """Frequency as printed: '118.700 MHz' (three decimals for MHz), other units as given; empty without a value."""
    u = F.upper(F.coalesce(col(uom), F.lit("")))
    number = F.when(u == "MHZ", F.format_string("%.3f", col(value).cast("double"))).otherwise(col(value).cast("string"))
    return F.when(col(value).isNull(), "").otherwise(F.concat_ws(" ", number, F.nullif(F.coalesce(lookup(UNIT_TEXT, u), u), F.lit(""))))


def timesheet_text(day, day_til, start, end, excluded=None) -> Column:
    """One line of a timesheet: 'EXC MON-FRI 0600-1800', H24 for a whole day; ANY as a day is not printed."""
    given = lambda c: F.nullif(F.coalesce(col(c), F.lit("")), F.lit(""))
    a, b = F.nullif(given(day), F.lit("ANY")), F.nullif(given(day_til), F.lit("ANY"))
    days = F.concat_ws("-", a, F.when(a.isNotNull() & (a != b), b))
    clock = lambda c: F.substring(F.regexp_replace(F.coalesce(col(c), F.lit("")), ":", ""), 1, 4)
    whole = clock(start).isin("", "0000") & clock(end).isin("0000", "2400")
    time = F.when(whole, "H24").when((clock(start) != "") | (clock(end) != ""), F.concat(clock(start), F.lit("-"), clock(end)))
    exc = F.when(col(excluded) == "YES", "EXC") if excluded is not None else F.lit(None).cast("string")
    return F.concat_ws(" ", exc, F.nullif(days, F.lit("")), time)


# ---------------------------------------------------------------- hull

def hull_by_group(points: DataFrame, group: str, salts: int = 16) -> DataFrame:
    """Convex hull of the points of each group: group, seq (counter-clockwise from the leftmost), lon, lat.

    Every Arrow batch is reduced to the hulls of its groups before anything is shuffled, then salted parts, then groups: only
    corners of parts meet, also where one group holds most points. A task walks its sorted rows once, whatever the number of
    groups. Repeated points count once; fewer than three points, or points on one line, give their ends.
    Groups of null and points without numbers are left out.
    """
    import numpy as np
    import pandas as pd

    def chain(xs: list[float], ys: list[float]) -> list[int]:
        """Places of the corners below, left to right."""
        half: list[int] = []
        for i in range(len(xs)):
            x, y = xs[i], ys[i]
            while len(half) > 1:
                p, q = half[-2], half[-1]
                if (xs[q] - xs[p]) * (y - ys[p]) - (ys[q] - ys[p]) * (x - xs[p]) > 0:
                    break
                half.pop()
            half.append(i)
        return half

    def corners(frame: pd.DataFrame) -> pd.DataFrame:
        """Hulls of the groups of a frame, groups in the order of their first row, with ``seq``."""
        codes = pd.factorize(frame[group])[0]
        lon, lat = frame["lon"].to_numpy(), frame["lat"].to_numpy()
        order = np.lexsort((lat, lon, codes))
        order = order[codes[order] >= 0]
        c, x, y = codes[order], lon[order], lat[order]
        fresh = np.ones(len(c), bool)
        fresh[1:] = (c[1:] != c[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        order, c, xs, ys = order[fresh], c[fresh], x[fresh].tolist(), y[fresh].tolist()
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.empty(0, np.int64)
        rows: list[int] = []
        seqs: list[int] = []
        for start, stop in zip(first.tolist(), [*first[1:].tolist(), len(c)], strict=True):
            if stop - start < 3:
                around = list(range(start, stop))
            else:
                px, py = xs[start:stop], ys[start:stop]
                last = stop - start - 1
                around = [start + i for i in chain(px, py)[:-1]] + [start + last - i for i in chain(px[::-1], py[::-1])[:-1]]
            rows += around
            seqs += range(len(around))
        out = frame.take(order[rows])[[group, "lon", "lat"]]
        out.insert(1, "seq", np.array(seqs, np.int32))
        return out

    def batches(frames):
        for frame in frames:
            if len(frame):
                yield corners(frame)[[group, "lon", "lat"]]

    def merged(frames):
        """Frames of rows sorted by group: the corners of the last group wait for its further rows."""
        waiting = None
        for frame in frames:
            if not len(frame):
                continue
            rows = frame if waiting is None else pd.concat([waiting, frame], ignore_index=True)
            codes = pd.factorize(rows[group])[0]
            ends = codes == codes[-1]
            if not ends.all():
                yield corners(rows[~ends])
            waiting = corners(rows[ends])[[group, "lon", "lat"]]
        if waiting is not None:
            yield corners(waiting)

    kind = points.schema[group].dataType.simpleString()
    p = points.filter(F.col(group).isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(group, F.col("lon").cast("double"), F.col("lat").cast("double"))
    plain = f"`{group}` {kind}, lon double, lat double"
    parts = p.mapInPandas(batches, plain).withColumn("_salt", F.pmod(F.xxhash64("lon", "lat"), F.lit(salts)))
    parts = parts.repartition(group, "_salt").select(group, "lon", "lat").sortWithinPartitions(group).mapInPandas(lambda frames: (f[[group, "lon", "lat"]] for f in merged(frames)), plain)
    return parts.repartition(group).sortWithinPartitions(group).mapInPandas(merged, f"`{group}` {kind}, seq int, lon double, lat double")
