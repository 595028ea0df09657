"""The two geodesic problems as DuckDB text, for the SQL that queries are checked against: every step is a column."""

from __future__ import annotations

F_ = "(1 / 298.257223563)"
B_ = f"(6378137.0 * (1 - {F_}))"
EP2 = f"((6378137.0 * 6378137.0 - {B_} * {B_}) / ({B_} * {B_}))"


def _series(p: str) -> list[list[str]]:
    return [[f"{p}c2 * {EP2} AS {p}u"], [f"1 + {p}u / 16384 * (4096 + {p}u * (-768 + {p}u * (320 - 175 * {p}u))) AS {p}ca", f"{p}u / 1024 * (256 + {p}u * (-128 + {p}u * (74 - 47 * {p}u))) AS {p}cb"]]


def _delta(p: str, s: str, c: str, m: str) -> str:
    return f"{p}cb * {s} * ({m} + {p}cb / 4 * ({c} * (2 * {m} * {m} - 1) - {p}cb / 6 * {m} * (4 * {s} * {s} - 3) * (4 * {m} * {m} - 3)))"


def _layers(name: str, source: str, layers: list[list[str]]) -> str:
    """A CTE whose columns are worked out layer by layer; a layer names only columns of earlier ones."""
    text = f"SELECT * FROM {source}"
    for columns in layers:
        text = f"SELECT *, {', '.join(columns)} FROM ({text})"
    return f"{name} AS MATERIALIZED ({text})"


def direct(name: str, source: str, lon: str, lat: str, azimuth: str, nm: str, x: str, y: str, steps: int = 6) -> str:
    """A CTE ``name``: the rows of ``source`` with the destination x, y."""
    p = f"{name}_"
    layers = [
        [f"(1 - {F_}) * tan(radians({lat})) AS {p}t", f"radians({azimuth}) AS {p}a"],
        [f"1 / sqrt(1 + {p}t * {p}t) AS {p}cu", f"{p}t / sqrt(1 + {p}t * {p}t) AS {p}su", f"atan2({p}t, cos({p}a)) AS {p}s1"],
        [f"{p}cu * sin({p}a) AS {p}sa"], [f"1 - {p}sa * {p}sa AS {p}c2"], *_series(p), [f"({nm}) * 1852 / ({B_} * {p}ca) AS {p}g0"],
    ]
    for k in range(steps):
        g, m = f"{p}g{k}", f"{p}m{k}"
        layers += [[f"cos(2 * {p}s1 + {g}) AS {m}"], [f"{p}g0 + {_delta(p, f'sin({g})', f'cos({g})', m)} AS {p}g{k + 1}"]]
    g = f"{p}g{steps}"
    layers += [
        [f"cos(2 * {p}s1 + {g}) AS {p}m", f"{p}su * sin({g}) - {p}cu * cos({g}) * cos({p}a) AS {p}x", f"{F_} / 16 * {p}c2 * (4 + {F_} * (4 - 3 * {p}c2)) AS {p}c"],
        [
            f"degrees(atan2({p}su * cos({g}) + {p}cu * sin({g}) * cos({p}a), (1 - {F_}) * sqrt({p}sa * {p}sa + {p}x * {p}x))) AS {y}",
            f"atan2(sin({g}) * sin({p}a), {p}cu * cos({g}) - {p}su * sin({g}) * cos({p}a)) - (1 - {p}c) * {F_} * {p}sa * ({g} + {p}c * sin({g}) * ({p}m + {p}c * cos({g}) * (2 * {p}m * {p}m - 1))) AS {p}l",
        ],
        [f"((({lon}) + degrees({p}l) + 180) % 360 + 360) % 360 - 180 AS {x}"],
    ]
    return _layers(name, source, layers)


def inverse(name: str, source: str, lon1: str, lat1: str, lon2: str, lat2: str, nm: str, azimuth: str, steps: int = 14) -> str:
    """A CTE ``name``: the rows of ``source`` with the distance and the first bearing between two places."""
    p = f"{name}_"
    layers = [
        [f"radians(((({lon2}) - ({lon1}) + 180) % 360 + 360) % 360 - 180) AS {p}l0", f"atan((1 - {F_}) * tan(radians({lat1}))) AS {p}u1", f"atan((1 - {F_}) * tan(radians({lat2}))) AS {p}u2"],
        [f"sin({p}u1) AS {p}p1", f"cos({p}u1) AS {p}q1", f"sin({p}u2) AS {p}p2", f"cos({p}u2) AS {p}q2"],
    ]

    def facts(k: int) -> list[list[str]]:
        lam, s, c, g, a, d, m = (f"{p}{x}{k}" for x in ("l", "s", "e", "g", "a", "d", "m"))
        return [
            [f"sqrt(power({p}q2 * sin({lam}), 2) + power({p}q1 * {p}p2 - {p}p1 * {p}q2 * cos({lam}), 2)) AS {s}", f"{p}p1 * {p}p2 + {p}q1 * {p}q2 * cos({lam}) AS {c}"],
            [f"atan2({s}, {c}) AS {g}", f"CASE WHEN {s} = 0 THEN 0 ELSE {p}q1 * {p}q2 * sin({lam}) / {s} END AS {a}"],
            [f"1 - {a} * {a} AS {d}"], [f"CASE WHEN {d} <> 0 THEN {c} - 2 * {p}p1 * {p}p2 / {d} ELSE 0 END AS {m}"],
        ]

    for k in range(steps):
        s, c, g, a, d, m = (f"{p}{x}{k}" for x in ("s", "e", "g", "a", "d", "m"))
        f = f"{p}f{k}"
        layers += [*facts(k), [f"{F_} / 16 * {d} * (4 + {F_} * (4 - 3 * {d})) AS {f}"], [f"{p}l0 + (1 - {f}) * {F_} * {a} * ({g} + {f} * {s} * ({m} + {f} * {c} * (2 * {m} * {m} - 1))) AS {p}l{k + 1}"]]
    k = steps
    layers += [
        *facts(k), [f"{p}d{k} AS {p}c2"], *_series(p),
        [
            f"CASE WHEN {p}s{k} = 0 THEN 0 ELSE {B_} * {p}ca * ({p}g{k} - {_delta(p, f'{p}s{k}', f'{p}e{k}', f'{p}m{k}')}) / 1852 END AS {nm}",
            f"CASE WHEN {p}s{k} = 0 THEN 0 ELSE (degrees(atan2({p}q2 * sin({p}l{k}), {p}q1 * {p}p2 - {p}p1 * {p}q2 * cos({p}l{k}))) % 360 + 360) % 360 END AS {azimuth}",
        ],
    ]
    return _layers(name, source, layers)
