"""Universal Transverse Mercator on WGS-84 as Column expressions (series in the third flattening, millimetres inside a zone)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col

AXIS, FLAT, SCALE, EAST0, NORTH0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
N = FLAT / (2 - FLAT)
RADIUS = AXIS / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ECC = 2 * math.sqrt(N) / (1 + N)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)


def zone_of(lon) -> Column:
    return (F.floor((col(lon) + 180.0) / 6.0) % 60 + 1).cast("int")


def forward(lon, lat, zone) -> tuple[Column, Column]:
    """Easting and northing (metres, southern hemisphere from 10 000 km)."""
    phi, dl = F.radians(col(lat)), F.radians(col(lon) - (col(zone) * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - ECC * F.atanh(ECC * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EAST0 + SCALE * RADIUS * x, F.when(col(lat) < 0, NORTH0).otherwise(0.0) + SCALE * RADIUS * y


def inverse(east, north, zone, south) -> tuple[Column, Column]:
    """Longitude and latitude of an easting and northing."""
    xi = (col(north) - F.when(col(south), NORTH0).otherwise(0.0)) / (SCALE * RADIUS)
    eta = (col(east) - EAST0) / (SCALE * RADIUS)
    xp, ep = xi, eta
    for j, b in enumerate(BETA, 1):
        xp = xp - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        ep = ep - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xp) / F.cosh(ep))
    lat = chi
    for j, d in enumerate(DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return col(zone) * 6 - 183 + F.degrees(F.atan2(F.sinh(ep), F.cos(xp))), F.degrees(lat)
