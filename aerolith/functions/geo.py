"""Spherical and planar geometry as Column expressions.

Two spheres are in use: R_NM for distances in nautical miles, R_M for the obstacle and runway assessments.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

R_NM = 3440.065
R_M = 6371008.8
NM_M = 1852.0
FT_M = 0.3048
M_PER_DEGREE = R_M * 3.141592653589793 / 180.0


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def fmod360(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def wrap180(x: Column) -> Column:
    """Longitude (or angle difference) folded into [-180, 180)."""
    return F.pmod(x + 180.0, F.lit(360.0)) - 180.0


def rounded(x: Column, digits: int) -> Column:
    """As F.round of a double, which goes through text: that way only close to a tie, where the other one may differ."""
    y = x * float(10**digits)
    whole = F.rint(y)
    return F.when((F.abs(y - whole) < 0.4999) & (F.abs(y) < 1e9), whole / float(10**digits) + 0.0).otherwise(F.round(x, digits))


def _bounded(x: Column) -> Column:
    """x kept within -1 .. 1. It skips nulls, so the callers look at their inputs (_known)."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def _known(value: Column, *inputs) -> Column:
    """value where all inputs are given, else null."""
    given = None
    for i in inputs:
        if isinstance(i, (int, float)):
            continue
        one = col(i).isNotNull()
        given = one if given is None else given & one
    return value if given is None else F.when(given, value)


def _central_angle(lon1, lat1, lon2, lat2) -> Column:
    lon1, lat1, lon2, lat2 = map(col, (lon1, lat1, lon2, lat2))
    s_lat = F.sin(F.radians(lat2 - lat1) / 2)
    s_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = s_lat * s_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s_lon * s_lon
    return _known(2 * F.asin(_bounded(F.sqrt(h))), lon1, lat1, lon2, lat2)


def distance_nm(lon1, lat1, lon2, lat2) -> Column:
    return R_NM * _central_angle(lon1, lat1, lon2, lat2)


def distance_m(lon1, lat1, lon2, lat2) -> Column:
    return R_M * _central_angle(lon1, lat1, lon2, lat2)


def bearing(lon1, lat1, lon2, lat2) -> Column:
    """Initial true bearing in degrees, 0 <= b < 360."""
    lon1, lat1, lon2, lat2 = map(col, (lon1, lat1, lon2, lat2))
    dl = F.radians(lon2 - lon1)
    p1, p2 = F.radians(lat1), F.radians(lat2)
    return fmod360(F.degrees(F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl))))


def dest_lat(lat, bearing_deg, distance, radius: float = R_NM) -> Column:
    p, b, d = F.radians(col(lat)), F.radians(col(bearing_deg)), col(distance) / radius
    return _known(F.degrees(F.asin(_bounded(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b)))), lat, bearing_deg, distance)


def dest_lon(lon, lat, bearing_deg, distance, radius: float = R_NM) -> Column:
    p, b, d = F.radians(col(lat)), F.radians(col(bearing_deg)), col(distance) / radius
    sin_p2 = F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b)
    return wrap180(col(lon) + F.degrees(F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * sin_p2)))


def _once(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dest_places(lon, lat, bearings: Column, distance) -> Column:
    """ARRAY<STRUCT<lon, lat>> of the destinations at an array of bearings; what is the same for all is worked out once."""
    p, d = F.radians(col(lat)), col(distance) / R_NM
    facts = F.struct(
        col(lon).alias("lon"), F.sin(p).alias("sp"), F.cos(p).alias("cp"), F.sin(d).alias("sd"), F.cos(d).alias("cd"), (col(lat).isNotNull() & col(distance).isNotNull()).alias("known")
    )

    def place(f: Column, deg: Column) -> Column:
        b = F.radians(deg)
        z = F.struct(F.sin(b).alias("sb"), (f["sp"] * f["cd"] + f["cp"] * f["sd"] * F.cos(b)).alias("z"), (f["known"] & deg.isNotNull()).alias("known"))
        return _once(z, lambda g: F.named_struct(
            F.lit("lon"), wrap180(f["lon"] + F.degrees(F.atan2(g["sb"] * f["sd"] * f["cp"], f["cd"] - f["sp"] * g["z"]))),
            F.lit("lat"), F.when(g["known"], F.degrees(F.asin(_bounded(g["z"])))),
        ))

    return _once(facts, lambda f: F.transform(bearings, lambda deg: place(f, deg)))


def arc_between(centre: Column, start: Column, end: Column, clockwise: Column, step: float = 5.0) -> Column:
    """Vertices (lon, lat) between two points of an arc round a centre with the radius of the first; the points themselves
    are not among them."""
    at = lambda p: (p["lon"], p["lat"])
    ends = F.struct(bearing(*at(centre), *at(start)).alias("b0"), bearing(*at(centre), *at(end)).alias("b1"))

    def turned(e: Column) -> Column:
        swept = F.when(clockwise, fmod360(e["b1"] - e["b0"])).otherwise(-fmod360(e["b0"] - e["b1"]))
        return F.struct(e["b0"].alias("b0"), swept.alias("swept"), F.greatest(F.lit(2), F.ceil(F.abs(swept) / step).cast("int")).alias("n"))

    bearings = _once(ends, lambda e: _once(turned(e), lambda t: F.transform(F.sequence(F.lit(1), t["n"] - 1), lambda i: t["b0"] + t["swept"] * i / t["n"])))
    return dest_places(*at(centre), bearings, distance_nm(*at(centre), *at(start)))


def cross_track(lon1, lat1, lon2, lat2, lon, lat) -> Column:
    """Signed distance in metres of a point from the great circle 1 -> 2 (right of it positive)."""
    d13 = _central_angle(lon1, lat1, lon, lat)
    turn = F.radians(bearing(lon1, lat1, lon, lat) - bearing(lon1, lat1, lon2, lat2))
    return _known(R_M * F.asin(_bounded(F.sin(d13) * F.sin(turn))), lon1, lat1, lon2, lat2, lon, lat)


def along_track(lon1, lat1, lon2, lat2, lon, lat) -> Column:
    """Signed distance in metres along 1 -> 2 of the foot of the perpendicular from the point."""
    d13 = _central_angle(lon1, lat1, lon, lat)
    turn = F.radians(bearing(lon1, lat1, lon, lat) - bearing(lon1, lat1, lon2, lat2))
    # cos(xt) from sin(xt) directly: xt is an arc sine
    sin_xt = F.sin(d13) * F.sin(turn)
    reach = F.acos(_bounded(F.cos(d13) / F.sqrt(1.0 - sin_xt * sin_xt)))
    return _known(R_M * reach * F.when(F.cos(turn) < 0, -1.0).otherwise(1.0), lon1, lat1, lon2, lat2, lon, lat)


def segment_offset(lon, lat, lon1, lat1, lon2, lat2) -> tuple[Column, Column, Column, Column]:
    """Nearest point of a short segment: (t in 0..1, dx, dy, distance in NM), plane scaled by cos(lat)."""
    lon, lat, lon1, lat1, lon2, lat2 = map(col, (lon, lat, lon1, lat1, lon2, lat2))
    k = F.cos(F.radians(lat))
    ax, ay = wrap180(lon1 - lon) * k, lat1 - lat
    dx, dy = wrap180(lon2 - lon1) * k, lat2 - lat1
    l2 = dx * dx + dy * dy
    t = F.when(l2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / l2))).otherwise(F.lit(0.0))
    px, py = ax + t * dx, ay + t * dy
    return t, px, py, F.sqrt(px * px + py * py) * 60.0


def segment_distance_nm(lon, lat, lon1, lat1, lon2, lat2) -> Column:
    return segment_offset(lon, lat, lon1, lat1, lon2, lat2)[3]


def local_x(lon, origin_lon, origin_lat) -> Column:
    """Metres east of an origin, flat frame."""
    return wrap180(col(lon) - col(origin_lon)) * F.cos(F.radians(col(origin_lat))) * M_PER_DEGREE


def local_y(lat, origin_lat) -> Column:
    """Metres north of an origin, flat frame."""
    return (col(lat) - col(origin_lat)) * M_PER_DEGREE


def vector_3d(df, lon1, lat1, h1, lon2, lat2, h2):
    """Distance, bearing, height difference, slant range, elevation angle and gradient between two points."""
    d = distance_m(lon1, lat1, lon2, lat2)
    dh = F.coalesce(col(h2), F.lit(0.0)) - F.coalesce(col(h1), F.lit(0.0))
    return (
        df.withColumn("distance_m", d)
        .withColumn("bearing", bearing(lon1, lat1, lon2, lat2))
        .withColumn("dh_m", dh)
        .withColumn("slant_m", F.hypot(F.col("distance_m"), F.col("dh_m")))
        .withColumn("angle_deg", F.degrees(F.atan2(F.col("dh_m"), F.col("distance_m"))))
        .withColumn("gradient", F.when(F.col("distance_m") > 0, F.col("dh_m") / F.col("distance_m")))
    )
