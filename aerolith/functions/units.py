"""Unit normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col

# Metres per unit, nautical miles per unit.
METRES = {"M": 1.0, "FT": 0.3048, "KM": 1000.0, "NM": 1852.0, "MI": 1609.344, "CM": 0.01}
NAUTICAL_MILES = {
    "NM": 1.0, "[NMI_I]": 1.0, "KM": 0.5399568, "M": 0.0005399568,
    "FT": 0.000164579, "[FT_I]": 0.000164579, "MI": 0.8689762, "[MI_I]": 0.8689762,
}


def _factor(uom: Column, table: dict[str, float], default: float) -> Column:
    pairs = [x for u, f in table.items() for x in (F.lit(u), F.lit(f))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.upper(uom)), F.lit(default))


def number(text) -> Column:
    """First number of a text; a decimal comma is a point, groups of thousands are joined."""
    joined = F.regexp_replace(col(text).cast("string"), r"\s(?=\d{3}\b)", "")
    found = F.regexp_extract(joined, r"([-+]?\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?)", 1)
    return F.when(found != "", F.regexp_replace(found, ",", ".").cast("double"))


def to_metres(value, uom) -> Column:
    """Value with unit in metres; FL counts hundreds of feet, a missing unit is metres."""
    v, u = col(value).cast("double"), F.coalesce(col(uom), F.lit("M"))
    return F.when(F.upper(u) == "FL", v * 30.48).otherwise(v * _factor(u, METRES, 1.0))


def to_feet(value, uom) -> Column:
    return to_metres(value, uom) / 0.3048


def to_nm(value, uom) -> Column:
    return col(value).cast("double") * _factor(F.coalesce(col(uom), F.lit("NM")), NAUTICAL_MILES, 1.0)


def to_mhz(value, uom) -> Column:
    v, u = col(value).cast("double"), F.upper(F.coalesce(col(uom), F.lit("")))
    return F.when(u == "KHZ", v / 1000).when(u == "GHZ", v * 1000).otherwise(v)


def limit_ft(value, uom, reference=None) -> Column:
    """Vertical limit in feet: GND / SFC 0, UNL infinity, FL (or STD without unit) hundreds of feet."""
    text = F.upper(F.trim(col(value).cast("string")))
    u = F.upper(F.coalesce(col(uom), F.lit("")))
    ref = F.coalesce(col(reference), F.lit("")) if reference is not None else F.lit("")
    n = F.regexp_extract(text, r"^([-+]?\d+(?:\.\d+)?)", 1)
    v = F.when(n != "", n.cast("double"))
    return (
        F.when(text.isin("GND", "SFC"), F.lit(0.0))
        .when(text == "UNL", F.lit(float("inf")))
        .when((u == "FL") | ((ref == "STD") & (u == "")), v * 100)
        .when(u == "M", v / 0.3048)
        .when(u == "KM", v * 1000 / 0.3048)
        .otherwise(v)
    )
