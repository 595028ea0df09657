"""Boundaries of areas as drawn: arcs between published points, borders followed, long lines kept on the geodesic.

An element of a boundary is a row: the boundary's keys, ``seq`` (its place), ``kind`` and what the kind needs:
``point`` lon, lat; ``arc`` centre lon, lat, radius_nm, from_deg, to_deg, clockwise; ``border`` the id of another line.
Every step is set-based: what an element needs to know of the ones beside it are values of the row before and after, so a
boundary of any length is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import distance_nm, segment_offset, wrap180
from ..functions.wgs84 import destination_table, geodesic_table
from .ordered import OrderedScan, Running
from .stage import settle

# How far a chord may leave its arc or a drawn line the geodesic (NM); the widest step of an arc in degrees.
CHORD_NM, WIDEST_STEP, MOST_STEPS = 0.005, 3.0, 1440
# A published point lies on an arc, beside it (at most, or that share of the radius), or fits its circle
# within a share of the radius and an angle.
ON_ARC_NM, BESIDE_NM, BESIDE_SHARE, FIT_SHARE, FIT_DEG = 0.05, 0.5, 0.05, 0.15, 10.0
SHORTEST_NM = 1.0  # shorter lines are never filled
MOST_FILLED = 512


def sweep(from_deg: Column, to_deg: Column, clockwise: Column) -> Column:
    """Degrees turned from one bearing to the other; equal bearings are a whole circle."""
    turned = F.pmod(F.when(clockwise, to_deg - from_deg).otherwise(from_deg - to_deg), F.lit(360.0))
    return F.when(turned == 0, 360.0).otherwise(turned)


def arc_steps(radius_nm: Column, swept: Column) -> Column:
    """Number of chords that stay within CHORD_NM of the arc; a tenth of that is left for the ellipsoid."""
    step = F.when(radius_nm > CHORD_NM, F.least(F.lit(WIDEST_STEP), 2 * F.degrees(F.acos(1 - 0.9 * CHORD_NM / radius_nm)))).otherwise(WIDEST_STEP)
    return F.least(F.lit(MOST_STEPS), F.greatest(F.lit(2), F.ceil(swept / step))).cast("int")


def arc_points(arcs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Vertices of arcs as coded: keys, k (from 0), lon, lat.

    ``arcs``: keys, lon, lat (centre), radius_nm, from_deg, to_deg, clockwise; also end_radius_nm, where the radius changes
    evenly. A circle is an arc whose bearings are equal.
    """
    far = F.col("end_radius_nm") if "end_radius_nm" in arcs.columns else F.col("radius_nm")
    rows = arcs.select(*keys, "lon", "lat", "radius_nm", far.alias("_far"), "from_deg", "clockwise", sweep(F.col("from_deg"), F.col("to_deg"), F.col("clockwise")).alias("_sweep"))
    # a few arcs become many vertices: they are dealt out before that, not in the few tasks their own size asks for
    rows = rows.repartition(int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lon", "lat", "radius_nm", "from_deg", "_sweep")
    rows = rows.withColumn("_n", arc_steps(F.greatest("radius_nm", "_far"), F.col("_sweep"))).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    share = F.col("k") / F.col("_n")
    turn = F.when(F.col("clockwise"), F.col("_sweep")).otherwise(-F.col("_sweep")) * share
    rows = rows.withColumns({"_az": F.pmod(F.col("from_deg") + turn, F.lit(360.0)), "_d": F.col("radius_nm") + (F.col("_far") - F.col("radius_nm")) * share})
    return destination_table(rows, azimuth="_az", distance="_d").select(*keys, "k", "_n", F.col("dest_lon").alias("lon"), F.col("dest_lat").alias("lat"))


def fit_arcs(arcs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The arcs as they meet the published points beside them.

    Adds to the rows of ``arcs`` (also prev_lon, prev_lat, next_lon, next_lat, null where there is none): start_fit and
    end_fit (``on``, ``beside``, ``through``, ``off``, null without a point), start_gap_nm and end_gap_nm, and the arc to
    draw: fit_from, fit_to, fit_radius, fit_end_radius.

    A point on the arc becomes its end; one beside it leaves the arc alone; one farther off that still fits the circle is
    drawn through, and then the point at the other end too unless it is on the arc. Where this would turn the arc by more
    than FIT_DEG, it stays as coded.
    """
    side = lambda name, bearing_col, lon, lat: F.struct(F.lit(name).alias("side"), F.col(bearing_col).alias("deg"), F.col(lon).alias("plon"), F.col(lat).alias("plat"))
    ends = arcs.select(*keys, "lon", "lat", "radius_nm", F.explode(F.array(side("start", "from_deg", "prev_lon", "prev_lat"), side("end", "to_deg", "next_lon", "next_lat"))).alias("e")).select(*keys, "lon", "lat", "radius_nm", "e.*")
    ends = destination_table(ends.where("plon is not null and plat is not null"), azimuth="deg", distance="radius_nm")
    ends = geodesic_table(ends, "dest_lon", "dest_lat", "plon", "plat").withColumnRenamed("geo_nm", "gap").drop("azimuth1", "azimuth2")
    ends = geodesic_table(ends, "lon", "lat", "plon", "plat")
    r = F.col("radius_nm")
    fits = (F.abs(F.col("geo_nm") - r) <= FIT_SHARE * r) & (F.abs(wrap180(F.col("azimuth1") - F.col("deg"))) <= FIT_DEG)
    beside = F.col("gap") <= F.least(F.lit(BESIDE_NM), BESIDE_SHARE * r)
    fit = F.when(F.col("gap") <= ON_ARC_NM, "on").when(beside, "beside").when(fits, "through").otherwise("off")
    fact = F.struct(fit.alias("fit"), fits.alias("fits"), F.col("gap"), F.col("geo_nm").alias("nm"), F.col("azimuth1").alias("deg"))
    met = ends.groupBy(*keys).agg(*[F.max(F.when(F.col("side") == s, fact)).alias(f"_{s}") for s in ("start", "end")])
    out = arcs.join(met.withColumnsRenamed({k: f"_j{i}" for i, k in enumerate(keys)}), _same(keys), "left").drop(*[f"_j{i}" for i in range(len(keys))])

    def through(own: str, other: str) -> Column:
        forced = (F.col(f"_{other}.fit") == "through") & (F.col(f"_{own}.fit") == "beside") & F.col(f"_{own}.fits")
        return F.coalesce((F.col(f"_{own}.fit") == "through") | forced, F.lit(False))

    out = settle(out, _ts=through("start", "end"), _te=through("end", "start"))
    chosen = lambda own, there, coded: F.when(F.col(own), F.col(there)).otherwise(F.col(coded))
    out = out.withColumns({"_from": chosen("_ts", "_start.deg", "from_deg"), "_to": chosen("_te", "_end.deg", "to_deg")})
    turned = F.abs(sweep(F.col("_from"), F.col("_to"), F.col("clockwise")) - sweep(F.col("from_deg"), F.col("to_deg"), F.col("clockwise"))) > FIT_DEG
    out = settle(out, _ts=F.col("_ts") & ~turned, _te=F.col("_te") & ~turned)
    state = lambda own, flag: F.when(F.col(flag), "through").when(F.col(f"{own}.fit") == "through", "off").otherwise(F.col(f"{own}.fit"))
    return out.withColumns({
        "start_fit": state("_start", "_ts"), "end_fit": state("_end", "_te"), "start_gap_nm": F.col("_start.gap"), "end_gap_nm": F.col("_end.gap"),
        "fit_from": chosen("_ts", "_start.deg", "from_deg"), "fit_to": chosen("_te", "_end.deg", "to_deg"),
        "fit_radius": chosen("_ts", "_start.nm", "radius_nm"), "fit_end_radius": chosen("_te", "_end.nm", "radius_nm"),
    }).drop("_start", "_end", "_ts", "_te", "_from", "_to")


def _same(keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_j{i}"))
    return on


def beside(elements: DataFrame, keys: Sequence[str], closed: bool) -> DataFrame:
    """The elements with the published point before and after them.

    Adds prev_lon, prev_lat, next_lon, next_lat for arcs: the end of the element right before (a point, or the coded end of
    an arc) and the point right after; and from_lon … to_lat for borders: the nearest end before and beginning after that
    is no border. ``closed``: the last element stands before the first one.
    """
    rows = destination_table(elements, azimuth="from_deg", distance="radius_nm").withColumnsRenamed({"dest_lon": "_sx", "dest_lat": "_sy"})
    rows = destination_table(rows, azimuth="to_deg", distance="radius_nm").withColumnsRenamed({"dest_lon": "_ex", "dest_lat": "_ey"})
    kind = F.col("kind")
    own = F.struct(F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    at = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    rows = rows.withColumns({
        "_point": F.when(kind == "point", own), "_exit": F.when(kind == "point", own).when(kind == "arc", at("_ex", "_ey")), "_entry": F.when(kind == "point", own).when(kind == "arc", at("_sx", "_sy")),
    }).drop("_sx", "_sy", "_ex", "_ey")
    forward = OrderedScan(keys, [F.col("seq")], F.floor(F.col("seq") / 1000))
    rows = forward.compute(rows, running={"_before": Running("last", F.col("_exit"), inclusive=False)}, previous={"_prev": F.col("_exit")}, following={"_next": F.col("_point")})
    rows = OrderedScan(keys, [-F.col("seq")], -F.floor(F.col("seq") / 1000)).compute(rows, running={"_after": Running("last", F.col("_entry"), inclusive=False)})
    if closed:
        given = lambda c: F.when(F.col(c).isNotNull(), F.col("seq"))
        ring = rows.groupBy(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)]).agg(
            F.min("seq").alias("_first"), F.max("seq").alias("_last"), F.max_by("_exit", "seq").alias("_last_exit"), F.min_by("_point", "seq").alias("_first_point"),
            F.max_by("_exit", given("_exit")).alias("_exit_round"), F.min_by("_entry", given("_entry")).alias("_entry_round"), F.count("_point").alias("_points"),
        )
        rows = rows.join(ring, _same(keys), "left")
        round_ = (F.col("_first") < F.col("_last")) & (F.col("_points") > 0)
        rows = rows.withColumns({
            "_prev": F.when((F.col("seq") == F.col("_first")) & round_, F.col("_last_exit")).otherwise(F.col("_prev")),
            "_next": F.when((F.col("seq") == F.col("_last")) & round_, F.col("_first_point")).otherwise(F.col("_next")),
            "_before": F.coalesce("_before", "_exit_round"), "_after": F.coalesce("_after", "_entry_round"),
        })
    named = {f"{a}_{b}": F.col(f"{c}.{b}") for a, c in (("prev", "_prev"), ("next", "_next"), ("from", "_before"), ("to", "_after")) for b in ("lon", "lat")}
    keep = [*elements.columns]
    return rows.select(*keep, *[c.alias(n) for n, c in named.items()])


def _line(borders: DataFrame, border: str) -> DataFrame:
    """Segments of the borders with their length and the length before them; the last vertex has no segment."""
    scan = OrderedScan([border], [F.col("k")], F.floor(F.col("k") / 1000))
    line = scan.compute(borders.select(border, "k", "lon", "lat"), following={"_x": F.col("lon"), "_y": F.col("lat")})
    line = line.withColumn("_len", F.when(F.col("_x").isNotNull(), distance_nm("lon", "lat", "_x", "_y")))
    return scan.compute(line, running={"_cum": Running("sum", F.col("_len"), inclusive=False)}).withColumn("_cum", F.coalesce("_cum", F.lit(0.0)))


def placed_on_borders(uses: DataFrame, borders: DataFrame, keys: Sequence[str], border: str = "border") -> DataFrame:
    """Nearest place on the border of the points beside a use: keys, border, side (from, to), p (gap in NM, i, at, nm)."""
    return _placed(uses, _line(borders, border), keys, border)


def _placed(uses: DataFrame, line: DataFrame, keys: Sequence[str], border: str) -> DataFrame:
    ends = uses.select(*keys, border, F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_lon").alias("px"), F.col(f"{s}_lat").alias("py")) for s in ("from", "to")])).alias("e")).select(*keys, border, "e.*")
    near = ends.where("px is not null and py is not null").join(line.where("_x is not null"), border)
    t, _, _, gap = segment_offset("px", "py", "lon", "lat", "_x", "_y")
    near = settle(near, _t=t, _gap=gap)
    place = F.struct(F.col("_gap").alias("gap"), F.col("k").alias("i"), (F.col("k") + F.col("_t")).alias("at"), (F.col("_cum") + F.col("_t") * F.col("_len")).alias("nm"))
    return near.groupBy(*keys, border, "side").agg(F.min(place).alias("p"))


def follow_borders(uses: DataFrame, borders: DataFrame, keys: Sequence[str], border: str = "border") -> DataFrame:
    """The stretch of a border between the two points beside its use.

    ``uses``: keys, border, from_lon, from_lat, to_lon, to_lat (null: that end of the border); ``borders``: border, k (from 0
    without gaps), lon, lat. Both points are placed on the line by the nearest segment. Gives keys, k (order along the way
    taken), lon, lat, from_gap_nm, to_gap_nm (distance of the points from the line). A line that ends where it began is
    followed the shorter way round, any other one from place to place in the direction they have.
    """
    line = _line(borders, border)
    whole = borders.groupBy(border).agg(F.max("k").alias("_m"), F.min_by(F.struct("lon", "lat"), "k").alias("_a"), F.max_by(F.struct("lon", "lat"), "k").alias("_b"))
    whole = whole.join(line.groupBy(border).agg(F.sum("_len").alias("_total")), border)
    whole = whole.select(border, "_m", "_total", ((F.col("_a") == F.col("_b")) & (F.col("_m") > 2)).alias("_closed"))
    placed = _placed(uses, line, keys, border)
    both = placed.groupBy(*keys, border).agg(*[F.max(F.when(F.col("side") == s, F.col("p"))).alias(f"_{s}") for s in ("from", "to")])
    ways = uses.select(*keys, border).join(both.withColumnsRenamed({k: f"_j{i}" for i, k in enumerate(keys)} | {border: "_jb"}), _same(keys) & F.col(border).eqNullSafe(F.col("_jb")), "left").drop("_jb", *[f"_j{i}" for i in range(len(keys))])
    ways = ways.join(whole, border)
    a, b, m = F.coalesce(F.col("_from.at"), F.lit(-1e-9)), F.coalesce(F.col("_to.at"), F.col("_m") + 1e-9), F.col("_m").cast("double")
    given = F.col("_from").isNotNull() & F.col("_to").isNotNull()
    loop = F.col("_closed") & given
    shorter = F.pmod(F.col("_to.nm") - F.col("_from.nm"), F.col("_total")) * 2 <= F.col("_total")
    ways = settle(ways, _at=a, _loop=loop, _ahead=F.when(loop, shorter).otherwise(a <= b), _span=F.when(loop, F.when(shorter, F.pmod(b - a, m)).otherwise(F.pmod(a - b, m))).otherwise(F.abs(b - a)))
    rows = ways.join(borders.select(F.col(border).alias("_jb"), F.col("k").alias("_k"), "lon", "lat"), F.col(border) == F.col("_jb"))
    off = F.when(F.col("_ahead"), F.col("_k") - F.col("_at")).otherwise(F.col("_at") - F.col("_k"))
    rows = rows.where("not (_loop and _k = _m)").withColumn("_off", F.when(F.col("_loop"), F.pmod(off, m)).otherwise(off))
    inside = rows.where((F.col("_off") > 0) & (F.col("_off") < F.col("_span")))
    return inside.select(*keys, border, F.col("_off").alias("k"), "lon", "lat", F.col("_from.gap").alias("from_gap_nm"), F.col("_to.gap").alias("to_gap_nm"))


def drawn(elements: DataFrame, borders: DataFrame | None, keys: Sequence[str], closed: bool = True) -> DataFrame:
    """Vertices of the boundaries: keys, seq, k (order inside an element), lon, lat, kind.

    ``borders``: border, k, lon, lat. A border that is not among them gives no vertices. Vertices that repeat the one
    before them are left out; a closed boundary ends on its first vertex.
    """
    rows = beside(elements, keys, closed)
    own = [*keys, "seq"]
    points = rows.where("kind = 'point'").select(*own, F.lit(0.0).alias("k"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), "kind")
    arcs = fit_arcs(rows.where("kind = 'arc'"), own)
    shape = arcs.select(*own, "lon", "lat", F.col("fit_radius").alias("radius_nm"), F.col("fit_end_radius").alias("end_radius_nm"), F.col("fit_from").alias("from_deg"), F.col("fit_to").alias("to_deg"), "clockwise")
    caps = arcs.select(*[F.col(c).alias(f"_j{i}") for i, c in enumerate(own)], F.when(F.col("start_fit").isin("on", "through"), F.struct("prev_lon", "prev_lat")).alias("_s"), F.when(F.col("end_fit").isin("on", "through"), F.struct("next_lon", "next_lat")).alias("_e"))
    bent = arc_points(shape, own).join(caps, _same(own), "left")
    cap = lambda axis, plain: F.when((F.col("k") == 0) & F.col("_s").isNotNull(), F.col(f"_s.prev_{axis}")).when((F.col("k") == F.col("_n")) & F.col("_e").isNotNull(), F.col(f"_e.next_{axis}")).otherwise(F.col(plain))
    bent = bent.select(*own, F.col("k").cast("double").alias("k"), cap("lon", "lon").alias("lon"), cap("lat", "lat").alias("lat"), F.lit("arc").alias("kind"))
    out = points.unionByName(bent)
    if borders is not None:
        out = out.unionByName(follow_borders(rows.where("kind = 'border'"), borders, own).select(*own, "k", "lon", "lat", F.lit("border").alias("kind")))
    scan = OrderedScan(keys, [F.col("seq"), F.col("k")], F.struct(F.col("seq").alias("s"), F.floor(F.col("k") / 1000).alias("b")))
    out = scan.previous(out, _px=F.col("lon"), _py=F.col("lat"))
    repeats = (F.abs(F.col("_px") - F.col("lon")) < 1e-9) & (F.abs(F.col("_py") - F.col("lat")) < 1e-9)
    out = out.where(~F.coalesce(repeats, F.lit(False))).select(*own, "k", "lon", "lat", "kind")
    if not closed:
        return out
    place = F.struct("seq", "k")
    ring = out.groupBy(*keys).agg(F.min_by(F.struct("lon", "lat"), place).alias("_a"), F.max_by(F.struct("lon", "lat"), place).alias("_b"), F.max("seq").alias("_s"), F.count(F.lit(1)).alias("_n"))
    last = ring.where("_n > 2 and not (_a <=> _b)").select(*keys, (F.col("_s") + 1).alias("seq"), F.lit(0.0).alias("k"), "_a.lon", "_a.lat", F.lit("point").alias("kind"))
    return out.unionByName(last.withColumn("seq", F.col("seq").cast(out.schema["seq"].dataType)))


def _mercator(lat: Column) -> Column:
    return F.log(F.tan(F.lit(0.7853981633974483) + F.radians(F.greatest(F.lit(-89.9), F.least(F.lit(89.9), lat))) / 2))


def densify(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Vertices inside long lines so that straight ones on a map (degrees or Mercator) stay on the geodesic.

    ``segments``: keys, lon1, lat1, lon2, lat2 (no end at a pole). Gives keys, k (from 1), lon, lat for the lines whose
    middle is more than CHORD_NM off the geodesic.
    """
    rows = geodesic_table(segments.where("abs(lat1) <= 89 and abs(lat2) <= 89").select(*keys, "lon1", "lat1", "lon2", "lat2")).where(F.col("geo_nm") >= SHORTEST_NM)
    rows = destination_table(rows.withColumn("_half", F.col("geo_nm") / 2), "lon1", "lat1", "azimuth1", "_half").withColumnsRenamed({"dest_lon": "_mx", "dest_lat": "_my"})
    middle = wrap180(F.col("lon1") + wrap180(F.col("lon2") - F.col("lon1")) / 2)
    on_map = F.degrees(2 * F.atan(F.exp((_mercator(F.col("lat1")) + _mercator(F.col("lat2"))) / 2))) - 90.0
    off = F.greatest(distance_nm("_mx", "_my", middle, (F.col("lat1") + F.col("lat2")) / 2), distance_nm("_mx", "_my", middle, on_map))
    rows = settle(rows, _off=off).where(F.col("_off") > CHORD_NM)
    rows = rows.withColumn("_n", F.least(F.lit(MOST_FILLED), F.ceil(F.sqrt(F.col("_off") / CHORD_NM))).cast("int")).where("_n > 1")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("_n") - 1))).withColumn("_d", F.col("geo_nm") * F.col("k") / F.col("_n"))
    return destination_table(rows, "lon1", "lat1", "azimuth1", "_d").select(*keys, "k", F.col("dest_lon").alias("lon"), F.col("dest_lat").alias("lat"))
