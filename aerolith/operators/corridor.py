"""Obstacles in the corridors of legs, counted without a row for each pair.

On the unit sphere a leg is three planes: the one of its great circle and those across its two ends. An obstacle lies in
the corridor when its distances from them, three products of vectors, say so. Tiles deal out legs and obstacles; in a
task the obstacles of a tile form small groups, legs meet the groups they touch, and each such block is worked out as
matrices of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import NM_M, R_M, bearing

TILE_DEG = 4.0
POLAR_LAT = 80.0  # beyond, a leg goes to all tiles of its rows
SALTS, TILE_OBSTACLES = 8, 50_000  # shares of a tile's legs; obstacles of a tile in one task
GROUP, BLOCK = 64, 2048  # obstacles of a group, legs of a block
AT_START, AT_END = 1e-9, 1e-12  # sine of an angle, millimetres on the ground: what stands at an end belongs to the leg


def _columns(row: np.ndarray) -> np.ndarray:
    edge = np.minimum(np.maximum(np.abs(row * TILE_DEG - 90.0), np.abs((row + 1) * TILE_DEG - 90.0)), 89.9)
    return np.maximum(1, np.floor(360.0 * np.cos(np.radians(edge)) / TILE_DEG)).astype(np.int64)


def _unit(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    x, y = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(y) * np.cos(x), np.cos(y) * np.sin(x), np.sin(y)], axis=1)


def _place(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.degrees(np.arctan2(p[:, 1], p[:, 0])), np.degrees(np.arcsin(np.clip(p[:, 2], -1.0, 1.0)))


def _numbers(table, names: list[str]) -> tuple[np.ndarray, ...]:
    return tuple(pc.cast(table.column(n), pa.float64()).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else pc.cast(table.column(n), pa.float64()).to_numpy() for n in names)


def _frame(lon: np.ndarray, lat: np.ndarray, course: np.ndarray, length_m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, direction, right-hand normal of a leg, and the normal of the plane across its end (back towards the start)."""
    x, y, c, angle = np.radians(lon), np.radians(lat), np.radians(course)[:, None], (length_m / R_M)[:, None]
    east = np.stack([-np.sin(x), np.cos(x), np.zeros_like(x)], axis=1)
    north = np.stack([-np.sin(y) * np.cos(x), -np.sin(y) * np.sin(x), np.cos(y)], axis=1)
    start, ahead = _unit(lon, lat), np.cos(c) * north + np.sin(c) * east
    return start, ahead, np.cos(c) * east - np.sin(c) * north, np.sin(angle) * start - np.cos(angle) * ahead


def _repeat(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges first, first + 1, … of n values each: the number of the range and the value."""
    which = np.repeat(np.arange(len(n)), n)
    return which, first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def _tiles_of_legs(lon, lat, course, length_m, reach_nm: float, stretch_m: float) -> tuple[np.ndarray, np.ndarray]:
    """Legs and the tiles their corridors touch, each pair once."""
    start, ahead, _, _ = _frame(lon, lat, course, length_m)
    n = np.maximum(1, np.ceil(length_m / stretch_m)).astype(np.int64)
    leg, i = _repeat(np.zeros_like(n), n)
    at = lambda k: (length_m[leg] * (k / n[leg]) / R_M)[:, None]
    (x1, y1), (x2, y2) = (_place(np.cos(a) * start[leg] + np.sin(a) * ahead[leg]) for a in (at(i), at(i + 1)))
    pad = reach_nm / 60.0
    polar = np.maximum(np.abs(y1), np.abs(y2)) > POLAR_LAT
    more = pad + np.where(polar, stretch_m / NM_M / 60.0, 0.0)
    rows = int(180.0 / TILE_DEG)
    low = np.clip(np.floor((np.minimum(y1, y2) - more + 90.0) / TILE_DEG), 0, rows - 1).astype(np.int64)
    high = np.clip(np.floor((np.maximum(y1, y2) + more + 90.0) / TILE_DEG), 0, rows - 1).astype(np.int64)
    s, row = _repeat(low, high - low + 1)
    columns = _columns(row)
    width = 360.0 / columns
    dx = (x2 - x1 + 180.0) % 360.0 - 180.0
    side = pad / np.cos(np.radians(np.minimum(np.maximum(np.abs(y1), np.abs(y2)) + pad, 89.9))) + 1e-9
    first = np.floor((x1 + np.minimum(dx, 0.0) - side)[s] / width + columns / 2.0).astype(np.int64)
    last = np.floor((x1 + np.maximum(dx, 0.0) + side)[s] / width + columns / 2.0).astype(np.int64)
    number = np.where(polar[s], columns, np.minimum(last - first + 1, columns))
    t, column = _repeat(first, number)
    pairs = np.unique(np.stack([leg[s[t]], row[t] * 1000 + column % columns[t]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _tiles_of_points(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    x, y = _place(_unit(lon, lat))
    row = np.clip(np.floor((y + 90.0) / TILE_DEG), 0, int(180.0 / TILE_DEG) - 1).astype(np.int64)
    columns = _columns(row)
    return row * 1000 + np.floor(x / (360.0 / columns) + columns / 2.0).astype(np.int64) % columns


def _groups(p: np.ndarray) -> list[np.ndarray]:
    """Numbers of points that lie together, some GROUP of them each, in ascending order."""
    found, open_ = [], [np.arange(len(p))]
    while open_:
        these = open_.pop()
        q = p[these]
        axis = int(np.argmax(q.max(axis=0) - q.min(axis=0)))
        if len(these) <= GROUP or q[:, axis].max() == q[:, axis].min():
            found += [these[i:i + BLOCK] for i in range(0, len(these), BLOCK)]
            continue
        order, half = np.argsort(q[:, axis], kind="stable"), len(these) // 2
        open_ += [np.sort(these[order[:half]]), np.sort(these[order[half:]])]
    return found


def _count(legs: tuple[np.ndarray, np.ndarray, np.ndarray], p: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each leg (ahead, right, back): how many points are in its corridor, and the smallest of their numbers."""
    ahead, right, back = legs
    groups = _groups(p)
    centres = np.stack([q / max(np.linalg.norm(q), 1e-12) for q in (p[g].mean(axis=0) for g in groups)])
    radius = np.array([np.linalg.norm(p[g] - c, axis=1).max() for g, c in zip(groups, centres, strict=True)]) + 1e-9  # a chord of a unit vector moves no product by more
    n, best = np.zeros(len(ahead), np.int64), np.full(len(ahead), len(p), np.int64)
    for b in range(0, len(ahead), BLOCK):
        a, r, e = ahead[b:b + BLOCK], right[b:b + BLOCK], back[b:b + BLOCK]
        touched = (np.abs(r @ centres.T) <= math.sin(half) + radius) & (a @ centres.T >= -AT_START - radius) & (e @ centres.T >= -AT_END - radius)
        for j in np.flatnonzero(touched.any(axis=0)):
            i, g = np.flatnonzero(touched[:, j]), groups[j]
            q = p[g].T
            inside = np.abs(r[i] @ q) <= math.sin(half)
            inside &= a[i] @ q >= -AT_START
            inside &= e[i] @ q >= -AT_END
            n[b + i] += np.count_nonzero(inside, axis=1)
            hit = inside.any(axis=1)
            best[b + i[hit]] = np.minimum(best[b + i[hit]], g[inside[hit].argmax(axis=1)])
    return n, best


def corridor_tops(legs: DataFrame, obstacles: DataFrame, half_nm: float, route: str = "route_id", stretch_m: float = 30 * NM_M) -> DataFrame:
    """Obstacles beside each leg (|across| within the half width, foot on the leg): route, leg_no, n_obstacles and the
    highest of them, top (elev_m, obstacle_id); of equally high ones the largest id. Legs with none have no row."""
    leg = legs.select(route, "leg_no", "a_lon", "a_lat", bearing("a_lon", "a_lat", "b_lon", "b_lat").alias("_course"), "len_m").dropna(subset=["a_lon", "a_lat", "_course", "len_m"])
    obs = obstacles.filter(F.col("elev_m").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull()).select("obstacle_id", "lon", "lat", "elev_m")
    reach_nm = half_nm * 1.05 + 0.5  # a stretch bends away from its chord by less than half a mile
    geometry = ["a_lon", "a_lat", "_course", "len_m"]

    def tiled_legs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, BLOCK) for i in range(0, batch.num_rows, BLOCK)):
                numbers = _numbers(part, geometry)
                known = np.flatnonzero(np.isfinite(numbers).all(axis=0))
                which, tile = _tiles_of_legs(*(x[known] for x in numbers), reach_nm, stretch_m)
                table = pa.Table.from_batches([part]).take(pa.array(known[which])).append_column("_tile", pa.array(tile.astype(np.int32)))
                yield from table.append_column("_salt", pa.array((which % SALTS).astype(np.int32))).combine_chunks().to_batches()

    def tiled_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lon, lat = _numbers(batch, ["lon", "lat"])
            known = np.flatnonzero(np.isfinite(lon) & np.isfinite(lat))
            table = pa.Table.from_batches([batch]).take(pa.array(known))
            yield from table.append_column("_tile", pa.array(_tiles_of_points(lon[known], lat[known]).astype(np.int32))).combine_chunks().to_batches()

    def of(df: DataFrame, *more: str) -> T.StructType:
        return T.StructType([*df.schema.fields, *[T.StructField(n, T.IntegerType()) for n in more]])

    points = obs.mapInArrow(tiled_points, of(obs, "_tile"))
    # a tile with very many obstacles is several, and its legs meet each of them
    shares = points.groupBy("_tile").agg(F.ceil(F.count(F.lit(1)) / TILE_OBSTACLES).cast("int").alias("_shares"))
    left = leg.mapInArrow(tiled_legs, of(leg, "_tile", "_salt")).join(shares, "_tile").withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
    right = points.join(shares, "_tile").withColumn("_share", F.pmod(F.xxhash64("lon", "lat", "obstacle_id"), F.col("_shares")).cast("int")).drop("_shares")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = T.StructType([leg.schema[route], leg.schema["leg_no"], T.StructField("_n", T.LongType()), obs.schema["elev_m"], obs.schema["obstacle_id"]])
    half = half_nm * NM_M / R_M

    def met(mine: pa.Table, there: pa.Table) -> pa.Table:
        if not mine.num_rows or not there.num_rows:
            return pa.Table.from_batches([], schema=pa.schema([mine.schema.field(route), mine.schema.field("leg_no"), pa.field("_n", pa.int64()), there.schema.field("elev_m"), there.schema.field("obstacle_id")]))
        # highest first, in the order of Spark: no number above all numbers, then the larger id
        odd = pa.array(np.isnan(_numbers(there, ["elev_m"])[0]).astype(np.int8))
        there = there.take(pc.sort_indices(there.append_column("_odd", odd), sort_keys=[("_odd", "descending"), ("elev_m", "descending"), ("obstacle_id", "descending")]))
        lon, lat = _numbers(there, ["lon", "lat"])
        n, best = _count(_frame(*_numbers(mine, geometry))[1:], _unit(lon, lat), half)
        hit = np.flatnonzero(n)
        mine, there = mine.take(pa.array(hit)), there.take(pa.array(best[hit]))
        return pa.table({route: mine[route], "leg_no": mine["leg_no"], "_n": pa.array(n[hit]), "elev_m": there["elev_m"], "obstacle_id": there["obstacle_id"]})

    keys = ["_tile", "_share", "_salt"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(met, out)
    return found.groupBy(route, "leg_no").agg(F.sum("_n").alias("n_obstacles"), F.max(F.struct("elev_m", "obstacle_id")).alias("top"))
