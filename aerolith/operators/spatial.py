"""Distance joins on a grid of cells.

Catalyst has no spatial join, so a distance becomes an equality: points keep their own cell, the other side is copied
to every cell its reach touches, and the exact distance is the last predicate. Longitude columns are as wide as the
latitude asks for and wrap at the antimeridian; a pair meets in exactly one cell, so nothing needs deduplication.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import M_PER_DEGREE, R_NM, bearing, col, distance_nm, wrap180
from ..session import cut_lineage
from .stage import settle

MAX_LAT = 89.9


def _rows_columns(row: Column, height: float) -> Column:
    """Number of columns of a latitude row; columns are at least as wide as the row is high. Rows beyond a pole are one cell."""
    south, north = row * height - 90.0, (row + 1) * height - 90.0
    edge = F.least(F.greatest(F.abs(south), F.abs(north)), F.lit(MAX_LAT))
    columns = F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(edge)) / height)).cast("int")
    return F.when((south >= 90.0) | (north <= -90.0), 1).otherwise(columns)


def cell_height(reach_nm: float) -> float:
    """Row height in degrees for a reach; never so small that rows or columns overflow an int."""
    return max(reach_nm / 60.0, 1e-6)


def with_cell(points: DataFrame, height: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds ``_row`` and ``_colno``, the cell a point lies in."""
    row = F.floor((F.col(lat) + 90.0) / height).cast("int")
    n = _rows_columns(row, height)
    column = F.pmod(F.floor((wrap180(F.col(lon)) + 180.0) / (F.lit(360.0) / n)).cast("int"), n)
    return points.withColumn("_row", row).withColumn("_colno", column)


def _cover(df: DataFrame, height: float, west: Column, east: Column, south: Column, north: Column) -> DataFrame:
    """Adds one copy of each row per cell its box touches (``east`` may run past 180, it wraps)."""
    rows = F.sequence(F.floor((south + 90.0) / height).cast("int"), F.floor((north + 90.0) / height).cast("int"))
    boxed = df.withColumn("_w", west).withColumn("_e", east).withColumn("_row", F.explode(rows))
    n = _rows_columns(F.col("_row"), height)
    width = F.lit(360.0) / n
    first = F.floor((F.col("_w") + 180.0) / width).cast("int")
    last = F.least(F.floor((F.col("_e") + 180.0) / width).cast("int"), first + n - 1)
    return (
        boxed.withColumn("_colno", F.explode(F.sequence(first, last))).withColumn("_colno", F.pmod(F.col("_colno"), n))
        .drop("_w", "_e")
    )


def with_reach(sites: DataFrame, reach_nm, height: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One copy of each site per cell within its reach (a number or a column, at most the cell height)."""
    reach = col(reach_nm) if not isinstance(reach_nm, (int, float)) else F.lit(float(reach_nm))
    angle = F.degrees(reach / R_NM)
    ratio = F.sin(F.radians(angle)) / F.cos(F.radians(F.least(F.abs(F.col(lat)), F.lit(MAX_LAT))))
    pole = F.abs(F.col(lat)) + angle >= 90.0
    dlon = F.when(pole | (ratio >= 1), F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0))))) + 1e-9
    x = wrap180(F.col(lon))
    # not cut at the poles: a latitude beyond them keeps its own rows, as points do, instead of all rows back to the pole
    return _cover(sites, height, x - dlon, x + dlon, F.col(lat) - angle - 1e-9, F.col(lat) + angle + 1e-9)


WIDE_NM, WIDE_CELLS = 5.0, 3


def within_distance(points: DataFrame, sites: DataFrame, nm: float, site_columns: Sequence[str], lon: str = "lon", lat: str = "lat",
                    site_lon: str = "lon", site_lat: str = "lat", wanted: Column | None = None) -> DataFrame:
    """Pairs of a point and a site at most ``nm`` apart, with ``distance_nm``.

    ``wanted``: a cheap condition that all pairs of interest meet (columns of the site as _s_name); the others go before
    their distance is worked out. The result has a row for every such pair: use it with a reach at which a point meets few sites, or aggregate it.
    """
    # a wide reach has several cells: with cells of its own size a whole region would be a few tasks
    h = cell_height(nm / WIDE_CELLS if nm > WIDE_NM else nm)
    # few rows make many pairs: both sides are dealt out before they meet, whichever of them is small
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    right = sites.select(*[F.col(c).alias(f"_s_{c}") for c in dict.fromkeys([*site_columns, site_lon, site_lat])])
    right = with_reach(right.repartition(parts, f"_s_{site_lon}", f"_s_{site_lat}"), nm, h, f"_s_{site_lon}", f"_s_{site_lat}")
    left = with_cell(points.repartition(parts, lon, lat), h, lon, lat)
    d = distance_nm(lon, lat, f"_s_{site_lon}", f"_s_{site_lat}")
    met = left.join(right, ["_row", "_colno"])
    pairs = settle(met if wanted is None else met.where(wanted), distance_nm=d).filter(F.col("distance_nm") <= nm)
    plain = {f"_s_{c}": c for c in site_columns if c not in points.columns}
    clash = {f"_s_{c}": f"site_{c}" for c in site_columns if c in points.columns}
    extra = [f"_s_{c}" for c in (site_lon, site_lat) if c not in site_columns]
    return pairs.drop("_row", "_colno", *extra).withColumnsRenamed({**plain, **clash})


def with_fan(sites: DataFrame, height: float, lon: str, lat: str, ux: str, uy: str, length_m: Column, half_near_m: Column, half_far_m: Column,
             start_m: Column | None = None) -> DataFrame:
    """One copy of each site per cell its fan touches: a trapezoid in the flat frame of the site, from the site (or
    from ``start_m``) to ``length_m`` along the unit vector, with the half widths of its two ends."""
    x, y = F.col(ux), F.col(uy)
    east_m = F.greatest(F.cos(F.radians(F.col(lat))), F.lit(1e-9)) * M_PER_DEGREE
    near, far, start = half_near_m, half_far_m, F.lit(0.0) if start_m is None else start_m
    corners = [(start, near), (length_m, far), (length_m, -far), (start, -near)]
    fan = settle(sites, **{f"_fx{i}": (x * s + y * c) / east_m for i, (s, c) in enumerate(corners)}, **{f"_fy{i}": (y * s - x * c) / M_PER_DEGREE for i, (s, c) in enumerate(corners)})
    ys = [F.col(f"_fy{i}") for i in range(4)]
    row_of = lambda v: F.floor((v + F.col(lat) + 90.0) / height).cast("int")
    given = F.when(ys[0].isNotNull() & ys[1].isNotNull(), F.sequence(row_of(F.least(*ys) - 1e-9), row_of(F.greatest(*ys) + 1e-9)))
    fan = fan.withColumn("_row", F.explode(given))
    fan = settle(fan, _south=F.col("_row") * height - 90.0 - F.col(lat) - 1e-9, _north=(F.col("_row") + 1) * height - 90.0 - F.col(lat) + 1e-9, _n=_rows_columns(F.col("_row"), height))
    south, north = F.col("_south"), F.col("_north")

    def ends_of(i: int) -> list[Column]:
        """Where an edge enters and leaves the row; null where it does not meet it."""
        j = (i + 1) % 4
        ax, ay, bx, by = F.col(f"_fx{i}"), F.col(f"_fy{i}"), F.col(f"_fx{j}"), F.col(f"_fy{j}")
        dy = by - ay
        at = lambda v: ax + (bx - ax) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - ay) / dy))
        meets, flat = (F.least(ay, by) <= north) & (F.greatest(ay, by) >= south), F.abs(dy) < 1e-12
        return [F.when(meets, F.when(flat, ax).otherwise(at(south))), F.when(meets, F.when(flat, bx).otherwise(at(north)))]

    # the ends of the edges first, then the widest of them: each is worked out once
    cut = settle(fan, **{f"_x{i}": e for i, e in enumerate(e for i in range(4) for e in ends_of(i))})
    xs, x0 = [F.col(f"_x{i}") for i in range(8)], wrap180(F.col(lon))
    cut = settle(cut, _w=x0 + F.least(*xs) - 1e-9, _e=x0 + F.greatest(*xs) + 1e-9)
    width = F.lit(360.0) / F.col("_n")
    first = F.floor((F.col("_w") + 180.0) / width).cast("int")
    last = F.least(F.floor((F.col("_e") + 180.0) / width).cast("int"), first + F.col("_n") - 1)
    made = ["_w", "_e", "_n", "_south", "_north", *[f"_{c}{i}" for c in ("fx", "fy") for i in range(4)], *[f"_x{i}" for i in range(8)]]
    return cut.withColumn("_colno", F.explode(F.sequence(first, last))).withColumn("_colno", F.pmod("_colno", F.col("_n"))).drop(*made)


def nearest(points: DataFrame, sites: DataFrame, max_nm: float, key: str, site_key: str, levels: Sequence[float] = (1 / 64, 0.125, 1.0),
            lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Nearest site of each point within ``max_nm``: key, site_key, distance_nm. Equal distances: the smallest site key.

    Sites at one position are one candidate. The reach grows level by level and points that found their nearest site
    leave, so dense places are settled in small cells instead of pairing everything with everything.
    """
    spots = sites.groupBy(lon, lat).agg(F.min(site_key).alias(site_key)).filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    left = points.select(key, lon, lat).filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    found: DataFrame | None = None
    for level in levels:
        pairs = within_distance(left, spots.select(site_key, lon, lat), max_nm * level, [site_key], lon, lat, lon, lat)
        best = pairs.groupBy(key).agg(F.min(F.struct("distance_nm", site_key)).alias("_b"))
        hit = best.select(key, F.col("_b")[site_key].alias(site_key), F.col("_b.distance_nm").alias("distance_nm"))
        if level == levels[-1]:
            return hit if found is None else found.unionByName(hit)
        hit = cut_lineage(hit)
        found = hit if found is None else found.unionByName(hit)
        left = left.join(hit.select(key), key, "left_anti")
    raise ValueError("levels must not be empty")


def keep_near(points: DataFrame, sites: DataFrame, nm: float, key: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points with at least one site within ``nm`` (semi join on distance)."""
    tagged = sites.select(lon, lat).distinct().withColumn("_site", F.monotonically_increasing_id())
    hits = nearest(points, tagged, nm, key, "_site", lon=lon, lat=lat)
    return points.join(hits.select(key), key, "left_semi")


# ---------------------------------------------------------------- paths

def path_segments(vertices: DataFrame, keys: Sequence[str], seq: str = "seq", lon: str = "lon", lat: str = "lat", block: int = 1000, carry: Sequence[str] = ()) -> DataFrame:
    """Consecutive vertices of each path as segments: keys, seq (of the start), lon1, lat1, lon2, lat2 and ``carry`` of the start."""
    from .ordered import OrderedScan

    scan = OrderedScan(keys, [F.col(seq)], F.floor(F.col(seq) / block))
    paired = scan.compute(vertices.select(*keys, seq, lon, lat, *carry), following={"lon2": F.col(lon), "lat2": F.col(lat)})
    return paired.filter(F.col("lon2").isNotNull()).select(*keys, seq, F.col(lon).alias("lon1"), F.col(lat).alias("lat1"), "lon2", "lat2", *carry)


def _cover_segment(segments: DataFrame, height: float, nm: float) -> DataFrame:
    """One copy of each segment per cell within ``nm`` of it: row by row, the columns its stretch of that row touches."""
    pad = nm / 60.0
    low, high = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    rows = F.sequence(F.floor((low - pad + 90.0) / height).cast("int"), F.floor((high + pad + 90.0) / height).cast("int"))
    dlon, dlat = wrap180(F.col("lon2") - F.col("lon1")), F.col("lat2") - F.col("lat1")
    cut = segments.withColumns({"_x1": wrap180(F.col("lon1")), "_dx": dlon, "_dy": dlat}).withColumn("_row", F.explode(rows))
    south, north = F.col("_row") * height - 90.0 - pad, (F.col("_row") + 1) * height - 90.0 + pad
    share = lambda lat: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (lat - F.col("lat1")) / F.col("_dy")))
    flat = F.abs("_dy") < 1e-12
    t1 = F.when(flat, 0.0).otherwise(share(south))
    t2 = F.when(flat, 1.0).otherwise(share(north))
    xa, xb = F.col("_x1") + F.col("_dx") * t1, F.col("_x1") + F.col("_dx") * t2
    edge = F.least(F.greatest(F.abs(south), F.abs(north)), F.lit(MAX_LAT))
    side = F.lit(pad) / F.cos(F.radians(edge)) + 1e-9
    n = _rows_columns(F.col("_row"), height)
    width = F.lit(360.0) / n
    first = F.floor((F.least(xa, xb) - side + 180.0) / width).cast("int")
    last = F.least(F.floor((F.greatest(xa, xb) + side + 180.0) / width).cast("int"), first + n - 1)
    return cut.withColumn("_colno", F.explode(F.sequence(first, last))).withColumn("_colno", F.pmod(F.col("_colno"), n)).drop("_x1", "_dx", "_dy")


def near_path(points: DataFrame, segments: DataFrame, nm: float, segment_columns: Sequence[str], lon: str = "lon", lat: str = "lat",
              cell_nm: float | None = None) -> DataFrame:
    """Points and segments at most ``nm`` apart sideways: distance_nm and the nearest place (near_lon, near_lat).

    ``segments``: lon1, lat1, lon2, lat2 and the columns to keep. The plane is scaled by cos(latitude of the point).
    Long segments want larger cells, dense points smaller ones; the default cell is four times the distance.
    """
    h = cell_height(max(nm, cell_nm or 4 * nm))
    # a few segments become many rows below: they are dealt out before that, not in the few tasks their own size asks for
    dealt = segments.repartition(int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions")), "lon1", "lat1", "lon2", "lat2")
    right = _cover_segment(dealt, h, nm).select(
        "_row", "_colno", *[F.col(c).alias(f"_{c}") for c in ("lon1", "lat1", "lon2", "lat2")], *segment_columns
    )
    left = settle(with_cell(points, h, lon, lat), _k=F.cos(F.radians(F.col(lat))))
    ax, ay = wrap180(F.col("_lon1") - F.col(lon)) * F.col("_k"), F.col("_lat1") - F.col(lat)
    dx, dy = wrap180(F.col("_lon2") - F.col("_lon1")) * F.col("_k"), F.col("_lat2") - F.col("_lat1")
    # off the whole line by more than the distance: most rows of a cell go here, before anything is divided
    aside = ax * dy - ay * dx
    beside = aside * aside <= (dx * dx + dy * dy) * (nm / 60.0) ** 2 * (1 + 1e-9) + 1e-18
    p = settle(left.join(right, ["_row", "_colno"]).where(beside), _ax=ax, _ay=ay, _dx=dx, _dy=dy)
    ax, ay, dx, dy = (F.col(c) for c in ("_ax", "_ay", "_dx", "_dy"))
    l2 = dx * dx + dy * dy
    p = settle(p, _t=F.when(l2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / l2))).otherwise(F.lit(0.0)))
    px, py = ax + F.col("_t") * dx, ay + F.col("_t") * dy
    p = settle(p, distance_nm=F.sqrt(px * px + py * py) * 60.0).filter(F.col("distance_nm") <= nm)
    return p.withColumn("near_lon", wrap180(F.col(lon) + px / F.col("_k"))).withColumn("near_lat", F.col(lat) + py).drop(
        "_row", "_colno", "_lon1", "_lat1", "_lon2", "_lat2", "_k", "_ax", "_ay", "_dx", "_dy", "_t"
    )


def nearest_path(points: DataFrame, segments: DataFrame, nm: float, key: str, path_key: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Nearest path of each point within ``nm``: key, path_key, distance_nm, near_lon, near_lat."""
    hits = near_path(points.select(key, lon, lat), segments, nm, [path_key], lon, lat)
    best = hits.groupBy(key).agg(F.min(F.struct("distance_nm", path_key, "near_lon", "near_lat")).alias("_b"))
    return best.select(key, "_b.*")


# Indicative obstacle clearance (m) by leg type; other legs 150.
CLEARANCE_M = {
    "ArrivalLeg": 300, "ArrivalFeederLeg": 300, "InitialLeg": 300, "IntermediateLeg": 150, "FinalLeg": 75,
    "MissedApproachLeg": 50, "DepartureLeg": 90,
}


def clearance_required(leg_type) -> Column:
    pairs = [x for k, v in CLEARANCE_M.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.element_at(F.create_map(*pairs), col(leg_type)), F.lit(150.0))


def clearance_severity(clearance, required) -> Column:
    c, moc = col(clearance), col(required)
    return F.when(c < 0, "error").when(c < moc, "warning").when(c < 1.5 * moc, "caution")


BAND_LEGS, BAND_STEP = 1000, 8  # legs in the lowest band of altitudes, at least; how much each further band holds more


def obstacle_leg_clearance(obstacles: DataFrame, legs: DataFrame, key: str = "obstacle_id", leg_key: str = "leg_id", nm: float = 1.0,
                           cell_nm: float | None = None, band_legs: int = BAND_LEGS) -> DataFrame:
    """Worst leg within 1 NM of each obstacle: leg altitude minus top, with severity.

    ``obstacles``: key, lon, lat, elev_m; ``legs`` (segments): leg_key, alt_m, moc_m, lon1, lat1, lon2, lat2. The lowest
    legs go first, in bands of altitude; an obstacle leaves when no higher leg can be worse for it, so where many legs
    pass it meets only the lowest of them.
    """
    points = obstacles.filter(F.col("elev_m").isNotNull()).select(key, "lon", "lat", "elev_m")
    # a clearance from this on is no finding, so legs this far above the highest obstacle meet none
    limit = F.greatest(F.lit(0.0), F.col("moc_m"), 1.5 * F.col("moc_m"))
    top = points.agg(F.max("elev_m").alias("t"))
    usable = legs.filter(F.col("alt_m").isNotNull()).join(F.broadcast(top)).filter(F.col("alt_m") - F.col("t") <= limit)
    usable = cut_lineage(usable.select(leg_key, "alt_m", "moc_m", "lon1", "lat1", "lon2", "lat2"))
    n, most = usable.agg(F.count(F.lit(1)), F.max(limit)).first()
    shares = []
    while n * BAND_STEP ** -(len(shares) + 1) >= band_legs:
        shares.insert(0, float(BAND_STEP) ** -(len(shares) + 1))
    tops = usable.agg(F.percentile_approx("alt_m", shares, 10000)).first()[0] if shares else []
    found: DataFrame | None = None
    low: float | None = None
    for high in [*dict.fromkeys(tops), None]:
        band = usable if low is None else usable.filter(F.col("alt_m") > low)
        band = band if high is None else band.filter(F.col("alt_m") <= high)
        hits = near_path(points, band, nm, [leg_key, "alt_m", "moc_m"], cell_nm=cell_nm)
        per_leg = hits.filter(clearance_severity(F.col("alt_m") - F.col("elev_m"), "moc_m").isNotNull()).groupBy(key, leg_key).agg(
            F.min("distance_nm").alias("distance_nm"), F.any_value(F.col("alt_m") - F.col("elev_m")).alias("clearance_m"),
            F.any_value("moc_m").alias("moc_m"),
        ).withColumn("severity", clearance_severity("clearance_m", "moc_m"))
        worst = per_leg.groupBy(key).agg(F.min(F.struct("clearance_m", leg_key, "distance_nm", "severity")).alias("_w"))
        if high is None:
            found = worst if found is None else found.unionByName(worst)
            break
        worst = cut_lineage(worst)
        found = worst if found is None else found.unionByName(worst)
        next_up = F.lit(high) - F.col("elev_m")  # higher legs clear the obstacle by at least that
        open_ = points.join(worst.select(F.col(key).alias("_k"), F.col("_w.clearance_m").alias("_c")), F.col(key).eqNullSafe(F.col("_k")), "left")
        points = cut_lineage(open_.filter((F.col("_c").isNull() | (next_up <= F.col("_c"))) & (next_up <= F.lit(most))).select(*points.columns))
        low = high
    return found.groupBy(key).agg(F.min("_w").alias("_w")).select(key, "_w.*")


def highest_in_rings(sites: DataFrame, cells: DataFrame, rings: Sequence[float], site_key: str, elev: str = "elev") -> DataFrame:
    """Highest terrain within each ring (NM) of each site, with place, distance and bearing; larger rings include smaller ones.

    Cells are reduced to the highest one per (site, ring band) before anything is gathered.
    """
    widest = max(rings)
    pairs = within_distance(cells.filter(F.col(elev).isNotNull()).select("lon", "lat", elev), sites.select(site_key, F.col("lon").alias("site_lon"), F.col("lat").alias("site_lat")), widest,
                            [site_key, "site_lon", "site_lat"], site_lon="site_lon", site_lat="site_lat")
    band = F.lit(None).cast("double")
    for r in sorted(rings, reverse=True):
        band = F.when(F.col("distance_nm") <= r, F.lit(float(r))).otherwise(band)
    facts = F.struct(F.col(elev).alias("elev"), F.negative("distance_nm").alias("_near"), "lon", "lat", "site_lon", "site_lat")
    per_band = pairs.groupBy(site_key, band.alias("_band")).agg(F.max(facts).alias("_top"))
    wider = F.filter(F.array(*[F.lit(float(r)) for r in sorted(rings)]), lambda r: r >= F.col("_band"))
    ringed = per_band.withColumn("ring_nm", F.explode(wider)).groupBy(site_key, "ring_nm").agg(F.max("_top").alias("_t"))
    return ringed.select(
        site_key, "ring_nm", F.col("_t.elev").alias(elev), (-F.col("_t._near")).alias("distance_nm"),
        bearing("_t.site_lon", "_t.site_lat", "_t.lon", "_t.lat").alias("bearing"),
    )
