"""Rules as data, obstacle compliance, integrity items, statistics, search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coords import format_dms
from ..functions.geo import col
from ..functions.ident import crc32q, natural_sort_key
from ..functions.words import let, lookup, says, words
from .ordered import top_k_per_key

# ---------------------------------------------------------------- rules

RULE_KINDS = (
    "mand cmand note equom digits decimals navno navreq ref max forbid forbidval allowed nodesc maxdesc absent unique"
).split()


def run_rules(objects: DataFrame, values: DataFrame, rules: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Failures of every rule: rule_id, feature_id, message, n (repeats inside a feature).

    ``objects``: object_id, feature_id, class, interp; ``values`` (long): object_id, path, value, uom, target_class, nil;
    ``rules``: rule_id, kind, class, p, q, v (array), u (array), n, to_class; ``hierarchy``: class, is_a (with itself).
    A rule meets the objects of its class and of the classes below it; each kind is one expression over the values of
    its two paths.
    """
    sub = hierarchy.withColumnRenamed("is_a", "_rc").withColumnRenamed("class", "_oc")
    r = rules.withColumnRenamed("class", "_rc").join(sub, "_rc")
    full = F.coalesce(F.col("interp"), F.lit("")).isin("BASELINE", "SNAPSHOT", "")
    pairs = objects.withColumnRenamed("class", "_oc").join(r, "_oc").filter(full | ~F.col("kind").isin("mand", "cmand", "navreq"))
    uniques = pairs.filter(F.col("kind") == "unique").select("rule_id", "object_id", "feature_id", F.col("p").alias("_p"))
    rest = pairs.filter(F.col("kind") != "unique")

    def gathered(path: str, name: str) -> DataFrame:
        asked = rest.select("rule_id", "object_id", F.col(path).alias("path")).filter(F.col("path").isNotNull())
        got = asked.join(values, ["object_id", "path"])
        return got.groupBy("rule_id", "object_id").agg(
            F.collect_list(F.struct(F.coalesce("value", F.lit("")).alias("value"), F.coalesce("uom", F.lit("")).alias("uom"), "target_class", F.coalesce("nil", F.lit(False)).alias("nil"))).alias(name)
        )

    e = rest.join(gathered("p", "_p"), ["rule_id", "object_id"], "left").join(gathered("q", "_q"), ["rule_id", "object_id"], "left")
    P, Q = (F.coalesce(F.col(c), F.array().cast("array<struct<value:string,uom:string,target_class:string,nil:boolean>>")) for c in ("_p", "_q"))
    given = lambda a: F.exists(a, lambda x: (x["value"] != "") & ~x["nil"])
    declared = lambda a: F.exists(a, lambda x: x["nil"])
    V, U = F.coalesce("v", F.array().cast("array<string>")), F.coalesce("u", F.array().cast("array<string>"))
    in_unit = F.filter(P, lambda x: F.array_contains(U, x["uom"]))
    kind = F.col("kind")
    fails = (
        F.when(kind == "mand", ~given(P) & ~declared(P))
        .when(kind == "cmand", given(Q) & ~given(P) & ~declared(P))
        .when(kind == "equom", (F.size(in_unit) > 0) & ~F.exists(Q, lambda x: F.array_contains(V, x["value"])))
        .when(kind == "digits", F.exists(in_unit, lambda x: ~x["value"].rlike(r"^\d{1,3}$")))
        .when(kind == "decimals", F.exists(P, lambda x: F.length(F.regexp_extract(x["value"], r"\.(\d+)$", 1)) > F.col("n")))
        .when(kind == "ref", F.exists(P, lambda x: x["target_class"].isNotNull() & (x["target_class"] != F.col("to_class"))))
        .when(kind == "max", F.exists(in_unit, lambda x: x["value"].try_cast("double") > F.col("n")))
        .when(kind == "forbid", given(P))
        .when(kind.isin("forbidval", "navno"), F.exists(P, lambda x: F.array_contains(V, x["value"])))
        .when(kind == "navreq", ~F.exists(P, lambda x: F.array_contains(V, x["value"])))
        .when(kind == "note", F.exists(P, lambda x: (x["value"] != "") & ~F.array_contains(V, x["value"])))
        .when(kind == "allowed", F.exists(Q, lambda x: F.array_contains(U, x["value"])) & F.exists(P, lambda x: (x["value"] != "") & ~F.array_contains(V, x["value"])))
        .when(kind == "nodesc", F.size(P) > 0).when(kind == "maxdesc", F.size(P) > 1).when(kind == "absent", F.lit(True))
    )
    found = e.filter(fails).select("rule_id", "feature_id", F.concat_ws(" ", kind, "p").alias("message"))
    vals = uniques.join(values.withColumnRenamed("path", "_p"), ["object_id", "_p"]).filter(F.col("value") != "").select("rule_id", "feature_id", F.col("_p").alias("p"), "value")
    twice = vals.groupBy("rule_id", "value").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    again = vals.join(twice, ["rule_id", "value"]).select("rule_id", "feature_id", F.concat(F.lit("unique "), F.col("p")).alias("message"))
    return found.unionByName(again).groupBy("rule_id", "feature_id", "message").agg(F.count(F.lit(1)).alias("n"))


def rules_summary(rules: DataFrame, failures: DataFrame, objects: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Per rule: failures, features failing, and whether it failed, passed or met no object."""
    sub = hierarchy.withColumnRenamed("is_a", "_rc").withColumnRenamed("class", "_oc")
    per_class = objects.groupBy(F.col("class").alias("_oc")).agg(F.count(F.lit(1)).alias("_n")).join(sub, "_oc").groupBy("_rc").agg(F.sum("_n").alias("n_objects"))
    bad = failures.groupBy("rule_id").agg(F.sum("n").alias("n_failures"), F.countDistinct("feature_id").alias("n_features"))
    out = rules.select("rule_id", "kind", F.col("class").alias("_rc")).join(per_class, "_rc", "left").join(bad, "rule_id", "left")
    state = F.when(F.col("n_objects").isNull(), "not applicable").when(F.col("n_failures") > 0, "failed").otherwise("passed")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("rule_id", "kind", zero("n_objects"), zero("n_failures"), zero("n_features"), state.alias("state"))


# ---------------------------------------------------------------- obstacles

def filter_obstacles(rows: DataFrame, text: str = "", kind: str | None = None, lit: str | None = None, min_height: float | None = None, only: str | None = None,
                     sort: str = "elev_m", descending: bool = True) -> DataFrame:
    """Obstacle list by words, type, lighting, height and finding, sorted with empty values last."""
    out = rows
    if text:
        hay = F.lower(F.concat_ws(" ", "obstacle_id", "name", "type"))
        for w in text.lower().split():
            out = out.filter(hay.contains(w))
    if kind:
        out = out.filter(F.col("type") == kind)
    if lit is not None:
        out = out.filter(F.coalesce("lighted", F.lit("")) == lit)
    if min_height is not None:
        out = out.filter(F.col("hgt_m") >= min_height)
    if only:
        out = out.filter(F.col(only).isNotNull())
    return out.orderBy(F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last())


HEIGHT_CLASSES = (0, 15, 30, 45, 100, 150, 300)
DISTANCE_CLASSES = (0, 1, 2, 5, 10, 25)


def classed(value, bounds: Sequence[float]) -> Column:
    """Lower bound of the class a value falls in; null below the first."""
    out = F.lit(None).cast("double")
    for b in bounds:
        out = F.when(col(value) >= b, F.lit(float(b))).otherwise(out)
    return out


def obstacle_stats(rows: DataFrame) -> DataFrame:
    """Counts by type, height class (m) and distance class (NM) in one pass: grouping, name, n."""
    base = rows.select(
        F.coalesce("type", F.lit("")).alias("type"), classed("hgt_m", HEIGHT_CLASSES).cast("string").alias("height"), classed("distance_nm", DISTANCE_CLASSES).cast("string").alias("distance")
    )
    g = base.groupingSets([["type"], ["height"], ["distance"]], "type", "height", "distance").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    name = F.when(F.col("_g") == 3, "type").when(F.col("_g") == 5, "height").otherwise("distance")
    return g.select(name.alias("grouping"), F.coalesce("type", "height", "distance").alias("name"), "n")


# Kinds of the coded types of vertical structures.
TYPE_KIND = {
    "AG_EQUIP": "other", "ANTENNA": "antenna", "ARCH": "bridge", "BRIDGE": "bridge", "BUILDING": "building", "CABLE_CAR": "pylon", "CATENARY": "pylon", "CONTROL_TOWER": "ctower",
    "COOLING_TOWER": "cooling", "CRANE": "crane", "DAM": "wall", "DOME": "dome", "ELECTRICAL_EXIT_LIGHT": "lamp", "ELECTRICAL_SYSTEM": "pole", "ELEVATOR": "tank", "FENCE": "wall", "FUEL_SYSTEM": "tank",
    "GATE": "wall", "GENERAL_UTILITY": "utility", "GRAIN_ELEVATOR": "tank", "INDUSTRIAL_SYSTEM": "utility", "LIGHTHOUSE": "lighthouse", "MONUMENT": "monument", "NATURAL_HIGHPOINT": "peak",
    "NAVAID": "antenna", "NUCLEAR_REACTOR": "cooling", "POLE": "pole", "POWER_PLANT": "utility", "REFINERY": "utility", "RIG": "rig", "SIGN": "sign", "SPIRE": "spire", "STACK": "stack",
    "STADIUM": "stadium", "TANK": "tank", "TETHERED_BALLOON": "balloon", "TOWER": "tower", "TRAMWAY": "pylon", "TRANSMISSION_LINE": "pylon", "TREE": "tree", "URBAN": "building",
    "VEGETATION": "tree", "WALL": "wall", "WATER_SYSTEM": "utility", "WATER_TOWER": "watertower", "WINDMILL": "windmill", "WINDMILL_FARMS": "windmill",
}
# What plain words call a structure: nouns by kind, and for some nouns what a word before them makes of it. A caller with
# another vocabulary hands in its own tables.
NOUNS = {
    "als": "PAPI VASIS", "antenna": "AERIAL ANTENNA DME MAST NAVAID NDB", "balloon": "AEROSTAT BALLOON KITE", "bridge": "AQUEDUCT BRIDGE FLYOVER VIADUCT", "building": "BLDG BUILDING HOSPITAL HOTEL HOUSE OFFICE SCHOOL TERMINAL",
    "crane": "CRANE", "ctower": "ATC", "dome": "DOME MOSQUE RADOME", "gp": "GLIDEPATH GP", "hangar": "HANGAR", "lamp": "FLOODLIGHT LAMP LAMPPOST STREETLIGHT", "lighthouse": "LIGHTHOUSE", "loc": "LLZ LOCALISER LOCALIZER",
    "monument": "MONUMENT OBELISK STATUE", "peak": "HILL MOUNTAIN PEAK RIDGE", "pole": "FLAG FLAGPOLE POLE POST", "pylon": "CABLE PYLON WIRE", "radar": "RADAR SSR", "rig": "DERRICK PLATFORM RIG", "sign": "BILLBOARD SIGN",
    "spire": "MINARET SPIRE STEEPLE", "stack": "CHIMNEY FLARE STACK", "stadium": "ARENA STADIUM", "tank": "GASOMETER SILO TANK", "tower": "TOWER TWR", "tree": "FOREST PALM TREE WOOD", "utility": "FACTORY REFINERY SUBSTATION",
    "vor": "DVOR VOR", "wall": "DAM FENCE GATE WALL", "windmill": "WINDMILL WTG", "windsock": "WINDSOCK",
}
# noun -> kind -> the words right before it that make it that kind
QUALIFIED = {
    "TOWER": {"cooling": "COOLING", "ctower": "ATC CONTROL", "monument": "CLOCK", "pylon": "ELECTRICITY TRANSMISSION", "radar": "RADAR", "spire": "BELL CHURCH", "tower": "LATTICE RADIO", "watertower": "WATER"},
    "TWR": {"ctower": "ATC CONTROL"}, "LINE": {"pylon": "OVERHEAD POWER TRANSMISSION"}, "LIGHT": {"als": "APPROACH", "lamp": "STREET"}, "LIGHTING": {"als": "APPROACH"}, "MAST": {"lamp": "LIGHT"},
    "POLE": {"lamp": "LIGHT"}, "POST": {"lamp": "LAMP"}, "PATH": {"gp": "GLIDE"}, "SLOPE": {"gp": "GLIDE"}, "ANTENNA": {"gp": "GP", "loc": "LLZ LOCALIZER", "radar": "RADAR"}, "TANK": {"tank": "FUEL STORAGE", "watertower": "ELEVATED"},
    "PLANT": {"utility": "POWER"}, "STATION": {"utility": "POWER PUMPING"}, "TURBINE": {"windmill": "WIND"}, "FARM": {"windmill": "WIND"}, "CONE": {"windsock": "WIND"}, "SOCK": {"windsock": "WIND"}, "CRANE": {"crane": "TOWER"},
}
# What a kind is built as: a name of that kind says more of a structure coded as one of these.
BUILT_AS = {
    "als": "pole", "cooling": "tower", "ctower": "building tower", "dome": "building", "gp": "antenna tower", "hangar": "building", "lamp": "antenna pole tower", "lighthouse": "tower", "loc": "antenna", "monument": "tower",
    "pylon": "tower", "radar": "antenna tower", "sign": "pole", "stadium": "building", "utility": "building", "vor": "antenna", "watertower": "tower", "windsock": "antenna pole",
}


def kind_in_text(text, nouns: dict[str, str] | None = None, qualified: dict[str, dict[str, str]] | None = None) -> Column:
    """Kind that the words of a text name: by the first noun with a word before it that tells, else by the first noun; null when none.

    Words are compared in the singular.
    """
    one = {n: kind for kind, named in (nouns or NOUNS).items() for n in named.split()}
    two = {f"{before} {noun}": kind for noun, kinds in (qualified or QUALIFIED).items() for kind, named in kinds.items() for before in named.split()}
    plain = F.split(F.trim(F.regexp_replace(F.upper(F.coalesce(col(text), F.lit(""))), r"[^A-Z0-9]+", " ")), " ")

    def told(w: Column) -> Column:
        # a word that is no noun itself may be one without its plural ending
        known = F.array(*[F.lit(x) for x in sorted({*one, *qualified_nouns})])
        w = F.transform(w, lambda x: F.when(F.array_contains(known, x), x).otherwise(F.regexp_replace(x, "S$", "")))
        return let(w, lambda s: F.get(F.array_compact(F.concat(F.transform(s, lambda x, i: lookup(two, F.concat_ws(" ", F.get(s, i - 1), x))), F.transform(s, lambda x: lookup(one, x)))), F.lit(0)))

    qualified_nouns = {word for pair in two for word in pair.split()}
    return let(plain, told)


def obstacle_kind(type_, name, nouns: dict[str, str] | None = None, qualified: dict[str, dict[str, str]] | None = None) -> Column:
    """Kind by the coded type, else by the words of the type. The name decides where neither does, and where its kind is
    built as what the type says.

    Null or empty type and name give 'other'.
    """
    code = F.regexp_replace(F.upper(F.trim(F.coalesce(col(type_), F.lit("")))), "^OTHER:", "")
    by_type = F.coalesce(lookup(TYPE_KIND, F.regexp_replace(code, r"[^A-Z0-9]+", "_")), kind_in_text(code, nouns, qualified), F.lit("other"))
    by_name = kind_in_text(name, nouns, qualified)
    says_more = F.array_contains(F.split(lookup(BUILT_AS, by_name), " "), by_type)
    return F.when(by_type == "other", F.coalesce(by_name, F.lit("other"))).when(says_more, by_name).otherwise(by_type)


# Accuracy required by obstacle area (first character), horizontal / vertical in metres.
AREA_REQUIRED = {"1": (50.0, 30.0), "2": (5.0, 3.0), "3": (0.5, 0.5), "4": (2.5, 1.0)}


def obstacle_area(rows: DataFrame, polygons: DataFrame, key: str = "obstacle_id") -> DataFrame:
    """Area of each obstacle: its own code, the strictest own polygon, the declared area, the strictest other polygon.

    ``rows``: key, area (own code), declared; ``polygons`` (hits): key, area, own (bool).
    """
    need = F.create_map(*[x for k, v in AREA_REQUIRED.items() for x in (F.lit(k), F.lit(v[0]))])
    strict = F.struct(F.element_at(need, F.substring("area", 1, 1)).alias("r"), "area")
    best = polygons.groupBy(key).agg(F.min(F.when(F.col("own"), strict)).alias("_own"), F.min(F.when(~F.col("own"), strict)).alias("_other"))
    return rows.join(best, key, "left").withColumn("area", F.coalesce("area", "_own.area", "declared", "_other.area")).drop("_own", "_other")


# What is asked of an obstacle row: check, severity, condition, columns it reads.
COMPLIANCE = (
    ("Annex 14 surfaces", "error", "given", "pen_m"),
    ("Elevation", "error", "missing", "elev_m"), ("Height", "warning", "missing", "hgt_m"), ("Horizontal accuracy", "warning", "missing", "h_acc_m"), ("Vertical accuracy", "warning", "missing", "v_acc_m"),
    ("Horizontal accuracy", "error", "coarser than the area asks", "h_acc_m 0"), ("Vertical accuracy", "error", "coarser than the area asks", "v_acc_m 1"),
    ("Identifier", "error", "no text", "ident name"), ("Lighting", "warning", "no text", "lighted"), ("Marking", "info", "no text", "marked"), ("Vertical datum", "info", "no text", "v_datum"),
    ("Plausibility", "warning", "above", "hgt_m 1000"), ("Plausibility", "warning", "foot outside", "elev_m hgt_m -60 6000"), ("Position", "error", "any missing", "lon lat"),
    ("Type", "warning", "unspecific", "type"), ("Validity", "info", "over", "valid_to"),
)


def obstacle_compliance(rows: DataFrame, now, decimals: int = 5) -> DataFrame:
    """Findings for obstacle rows: obstacle_id, severity, check.

    Columns used: those of COMPLIANCE and area, path_severity (flight path finding or null).
    """
    blank = lambda x: F.coalesce(F.col(x), F.lit("")) == ""
    asked = F.col("area").substr(1, 1)
    conditions = {
        "missing": lambda x: F.col(x).isNull(), "given": lambda x: F.col(x).isNotNull(), "any missing": lambda *xs: F.array_contains(F.array(*[F.col(x).isNull() for x in xs]), True),
        "no text": lambda *xs: F.concat_ws("", *xs) == "", "unspecific": lambda x: blank(x) | (F.col(x) == "OTHER"), "above": lambda x, top: F.col(x) > float(top),
        "foot outside": lambda x, y, lo, hi: ~(F.col(x) - F.col(y)).between(float(lo), float(hi)), "over": lambda x: F.col(x) < F.lit(now).cast("timestamp"),
        "coarser than the area asks": lambda x, place: F.col(x) > lookup({k: v[int(place)] for k, v in AREA_REQUIRED.items()}, asked) + 1e-6,
    }
    finding = lambda severity, check: F.struct(severity.alias("severity"), F.lit(check).alias("check"))
    found = [F.when(conditions[condition](*columns.split()), finding(F.lit(severity), check)) for check, severity, condition, columns in COMPLIANCE]
    weight = F.when(F.col("path_severity") == "caution", "info").otherwise(F.col("path_severity"))
    found.append(F.when(F.col("path_severity").isNotNull(), finding(weight, "Flight paths")))
    listed = rows.select("obstacle_id", F.explode(F.array_compact(F.array(*found))).alias("f")).select("obstacle_id", "f.severity", "f.check")
    return listed.unionByName(same_position(rows, decimals))


def same_position(rows: DataFrame, decimals: int = 5) -> DataFrame:
    """Obstacles at the position of an earlier one: every one but the first of a position."""
    spot = [F.round("lon", decimals).alias("_x"), F.round("lat", decimals).alias("_y")]
    at = rows.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select("obstacle_id", *spot)
    first = at.groupBy("_x", "_y").agg(F.min("obstacle_id").alias("_f"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return at.join(first, ["_x", "_y"]).filter(F.col("obstacle_id") != F.col("_f")).select("obstacle_id", F.lit("warning").alias("severity"), F.lit("Duplicate").alias("check"))


def duplicate_codes(features: DataFrame, key: str, code: str) -> DataFrame:
    """Features whose code occurs more than once: key, code, n."""
    n = features.filter(F.coalesce(F.col(code), F.lit("")) != "").groupBy(code).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return features.join(n, code).select(key, code, "n")


def designator_spread(points: DataFrame, designator: str = "designator", min_nm: float = 1.0) -> DataFrame:
    """Designators used at places at least 1 NM apart: designator, n, span_nm (largest distance).

    The extreme points of a designator in thirteen directions give a first span. Only places whose farthest corner of
    the designator's box lies beyond that span can belong to a wider pair, so only those few meet each other.
    """
    from ..functions.geo import R_NM, distance_nm

    lat, lon = F.radians("lat"), F.radians("lon")
    spots = points.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).groupBy(designator, "lon", "lat").agg(F.count(F.lit(1)).alias("_n"))
    spots = spots.withColumns({"_x": F.cos(lat) * F.cos(lon), "_y": F.cos(lat) * F.sin(lon), "_z": F.sin(lat)})
    x, y, z = F.col("_x"), F.col("_y"), F.col("_z")
    axes = [x, y, z, x + y, x - y, x + z, x - z, y + z, y - z, x + y + z, x + y - z, x - y + z, x - y - z]
    place = F.struct("lon", "lat")
    agg = spots.groupBy(designator).agg(
        F.sum("_n").alias("n"), *[f(a).alias(f"_{c}{n}") for c, a in (("x", x), ("y", y), ("z", z)) for n, f in (("lo", F.min), ("hi", F.max))],
        *[f(place, a).alias(f"_e{i}{n}") for i, a in enumerate(axes) for n, f in (("lo", F.min_by), ("hi", F.max_by))],
    ).filter("n > 1")
    spans = F.array(*[distance_nm(f"_e{i}lo.lon", f"_e{i}lo.lat", f"_e{i}hi.lon", f"_e{i}hi.lat") for i in range(len(axes))])
    box = agg.select(designator, "n", F.array_max(spans).alias("_span"), *[f"_{c}{n}" for c in "xyz" for n in ("lo", "hi")])
    far = F.lit(0.0)
    for c in "xyz":
        d = F.greatest(F.col(f"_{c}") - F.col(f"_{c}lo"), F.col(f"_{c}hi") - F.col(f"_{c}"))
        far = far + d * d
    reach = 2 * R_NM * F.asin(F.least(F.lit(1.0), F.sqrt(far) / 2))
    left = spots.join(box, designator).filter(reach > F.col("_span")).select(designator, "lon", "lat", "_span")
    right = left.select(designator, F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    wider = left.join(right, designator).groupBy(designator).agg(F.max(distance_nm("lon", "lat", "_lon", "_lat")).alias("_wide"))
    out = box.join(wider, designator, "left").select(designator, "n", F.greatest("_span", "_wide").alias("span_nm"))
    return out.filter(F.col("span_nm") >= min_nm)


# ---------------------------------------------------------------- integrity

# Class, horizontal and vertical accuracy (m) of the classified data items.
INTEGRITY = {
    "THR": ("critical", 1.0, 0.5), "RWYEND": ("critical", 1.0, 0.5), "RCP": ("critical", 1.0, 0.5), "THRP": ("critical", 1.0, 0.25), "ARP": ("routine", 30.0, 0.5),
    "ADELEV": ("essential", None, 0.5), "HOLD": ("critical", 0.5, None), "TWY": ("essential", 0.5, None), "STAND": ("routine", 0.5, None), "ILS": ("essential", 3.0, 3.0),
    "ADNAV": ("essential", 3.0, 30.0), "ENRNAV": ("essential", 100.0, 30.0), "DP": ("essential", 100.0, None), "OBS2": ("essential", 5.0, 3.0), "OBS1": ("routine", 50.0, 30.0),
    "APN": ("routine", 1.0, None),
}
AREA2_NM = 5.4


def integrity_items(items: DataFrame) -> DataFrame:
    """Classified items with fingerprint text, CRC and status.

    ``items``: feature_type, feature_id, label, item, item_key, lon, lat, elev_m, h_acc_m, v_acc_m.
    """
    pick = lambda i, t: F.element_at(F.create_map(*[x for k, v in INTEGRITY.items() for x in (F.lit(k), F.lit(v[i]).cast(t))]), F.col("item_key"))
    d = items.withColumns({"class": pick(0, "string"), "h_required_m": pick(1, "double"), "v_required_m": pick(2, "double")})
    dms = lambda c, lat: F.when(F.col("class") == "critical", format_dms(c, lat, 2)).when(F.col("class") == "essential", format_dms(c, lat, 1)).otherwise(format_dms(c, lat, 0))
    elev = F.coalesce(F.format_string("%.1f", F.col("elev_m")), F.lit(""))
    elev = F.when(F.col("elev_m").isNull(), "").otherwise(elev)
    d = d.withColumn("text", F.concat_ws(";", "feature_type", "label", "item", dms("lat", True), dms("lon", False), elev))
    missing = (F.col("h_required_m").isNotNull() & F.col("h_acc_m").isNull()) | (F.col("v_required_m").isNotNull() & F.col("elev_m").isNotNull() & F.col("v_acc_m").isNull())
    worse = F.coalesce(F.col("h_acc_m") > F.col("h_required_m") + 1e-9, F.lit(False)) | F.coalesce(F.col("elev_m").isNotNull() & (F.col("v_acc_m") > F.col("v_required_m") + 1e-9), F.lit(False))
    status = F.when(worse, "Insufficient accuracy").when(missing, "Accuracy not declared").otherwise("OK")
    return d.withColumn("crc", crc32q("text")).withColumn("status", status).withColumn("key", F.concat_ws(";", "feature_type", "feature_id", "item"))


# ---------------------------------------------------------------- accuracy and fitness

# Words of a source text and the class they mean, by weight of the class.
SOURCE_WORDS = {
    "S": ("ANNEX", "INFERRED", "SCHEMATIC", "STANDARD"), "T": ("DIGITISED", "DIGITIZED", "TRACED"), "C": ("CHART", "CHARTS"), "O": ("OPENSTREETMAP", "OSM"), "A": ("AIP",),
}


def source_class(source) -> Column:
    """Class of a source text: S inferred, T traced, C chart, O volunteered map, A published data, D as delivered (also null)."""
    said = words(source)
    return F.coalesce(*[F.when(says(said, terms), kind) for kind, terms in SOURCE_WORDS.items()], F.lit("D"))


def with_requirement(features: DataFrame, dim: DataFrame, own: DataFrame | None = None, type_: str = "type") -> DataFrame:
    """Adds ``required_m``: the user's own requirement of a type replaces the built-in one (both: type, acc_m)."""
    d = dim.select(F.col("type").alias(type_), F.col("acc_m").alias("_d"))
    out = features.join(d, type_, "left")
    if own is None:
        return out.withColumnRenamed("_d", "required_m")
    o = own.select(F.col("type").alias(type_), F.col("acc_m").alias("_o"))
    return out.join(o, type_, "left").withColumn("required_m", F.coalesce("_o", "_d")).drop("_o", "_d")


def fitness_status(h_acc, required, src, resolution_m=None) -> Column:
    """meets, state, unknown, not met or n/a from declared accuracy or the class of the source."""
    acc, req, s = col(h_acc), col(required), col(src)
    floor = col(resolution_m) if resolution_m is not None else F.lit(None).cast("double")
    return (
        F.when(req.isNull(), "n/a").when(acc > 0, F.when(acc <= req + 1e-9, "meets").otherwise("not met")).when(s == "S", "not met").when(floor > req, "not met")
        .when(s.isin("A", "C"), "state").otherwise("unknown")
    )


def fitness(features: DataFrame, type_: str = "type", status: str = "status") -> DataFrame:
    states = {"meets": "n_meets", "state": "n_state", "unknown": "n_unknown", "not met": "n_not_met", "n/a": "n_no_requirement"}
    out = features.groupBy(type_).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(status) == k).alias(v) for k, v in states.items()])
    return out.withColumn("survey", (F.col("n_not_met") + F.col("n_unknown")) > 0)


def accuracy_stats(measured: DataFrame, keys: Sequence[str], d: str = "d", required: str = "required_m") -> DataFrame:
    """n, missed, mean, RMS, 95th percentile by nearest rank, max and share within requirement of measured distances."""
    v = F.col(d)
    return measured.groupBy(*keys).agg(
        F.count(v).alias("n"), F.count_if(v.isNull()).alias("n_missed"), F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rms"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {d})").alias("p95"), F.max(v).alias("max"), (F.count_if(v <= F.col(required)) / F.count(v)).alias("within"),
    )


def content_check(features: DataFrame, groups: DataFrame, ad: str = "ad_id", type_: str = "type", least: float = 0.94) -> DataFrame:
    """Share of the content groups (group, type) an aerodrome map has, the missing ones, and whether it is usable."""
    wanted = groups.select("group").distinct()
    total = wanted.agg(F.count(F.lit(1)).alias("_t"), F.array_sort(F.collect_set("group")).alias("_all"))
    have = features.join(groups, type_).groupBy(ad).agg(F.array_sort(F.collect_set("group")).alias("_g"))
    every = features.select(ad).distinct().join(have, ad, "left").withColumn("_t", total.select("_t").scalar()).withColumn("_all", total.select("_all").scalar())
    share = F.coalesce(F.size("_g"), F.lit(0)) / F.col("_t")
    return every.select(ad, share.alias("share"), F.array_join(F.array_except("_all", F.coalesce("_g", F.array().cast("array<string>"))), ", ").alias("missing"), (share >= least).alias("usable"))


SOURCE_ORDER = "ACTOS"


def readiness(inputs: DataFrame, ad: str = "ad_id") -> DataFrame:
    """Best source and state of each mapping input of each aerodrome, with the share ready.

    ``inputs``: ad, item, source (A, C, T, O, S), state (1 available, 0.5 partly, 0 missing). The first source in order
    that has the item counts. Output: ad, item, source, state, percent.
    """
    rank = F.position(F.col("source"), F.lit(SOURCE_ORDER))
    best = inputs.groupBy(ad, "item").agg(F.min(F.when(F.col("state") > 0, F.struct(rank.alias("r"), "source", "state"))).alias("_b"))
    best = best.select(ad, "item", F.col("_b.source").alias("source"), F.coalesce("_b.state", F.lit(0.0)).alias("state"))
    share = best.groupBy(ad).agg((F.avg("state") * 100).alias("percent"))
    return best.join(share, ad)


# ---------------------------------------------------------------- search, sort

def search(features: DataFrame, words: str, columns: Sequence[str], key: str, important: Column | None = None, shown: int | None = None) -> DataFrame:
    """All-words search: prefix hits and important rows first; all hits, or the first ``shown`` where a caller asks for it."""
    hay = F.lower(F.concat_ws(" ", *columns))
    q = [w for w in words.lower().split() if w]
    match = F.lit(True)
    for w in q:
        match = match & hay.contains(w)
    score = F.when(F.lower(F.col(columns[0])).startswith(q[0]), 0).otherwise(2) + (F.when(important, 0).otherwise(1) if important is not None else F.lit(0))
    found = features.filter(match).withColumn("score", score).orderBy("score", key)
    return found if shown is None else found.limit(shown)


def top_k(rows: DataFrame, order: Sequence[Column], k: int, keys: Sequence[str] = ()) -> DataFrame:
    """First k rows, overall or per key."""
    return top_k_per_key(rows, keys, order, k) if keys else rows.orderBy(*order).limit(k)


def natural_sort(rows: DataFrame, column: str) -> DataFrame:
    return rows.orderBy(natural_sort_key(column), column)
