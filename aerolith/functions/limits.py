"""Vertical limits written in running text, read word by word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col
from .words import UNIT_WORDS, let, lookup, words

# Words for the ground and for no upper limit, and abbreviations of what a height counts from.
NO_HEIGHT = {"GND": 0.0, "GROUND": 0.0, "SFC": 0.0, "SURFACE": 0.0, "UNL": float("inf"), "UNLTD": float("inf"), "UNLIMITED": float("inf")}
COUNTS_FROM = {"AAL": "SFC", "AGL": "SFC", "GND": "SFC", "HGT": "SFC", "SFC": "SFC", "ALT": "MSL", "AMSL": "MSL", "MSL": "MSL"}


def limit_words(text) -> Column:
    """Words of a limit; the number of a flight level stands alone."""
    return words(F.regexp_replace(F.upper(col(text)), r"\bFL(?=[0-9])", "FL "))


def _of_words(text, body) -> Column:
    """``body`` of the words of a limit, cut once; null for null and empty texts."""
    return F.when(col(text) != "", let(limit_words(text), body))


def limit_in_text_m(text) -> Column:
    """Metres of a limit such as GND, FL150, 3000FT AMSL, 450 M AGL, UNL; a bare number is feet, other texts are null."""
    return _of_words(text, _metres).alias("limit_m")  # else its name is the whole expression


def _metres(w: Column) -> Column:
    first, second = F.get(w, F.lit(0)), F.get(w, F.lit(1))
    level = F.when((first == "FL") & second.rlike("^[0-9]{2,3}$"), second.try_cast("double") * 30.48)
    value = F.when(first.rlike(r"^[0-9]+(\.[0-9]+)?$"), first.try_cast("double"))
    metric = lookup({u: n == "M" for u, n in UNIT_WORDS.items() if n in ("M", "FT")}, second)
    return F.coalesce(lookup(NO_HEIGHT, first), level, value * F.when(metric, 1.0).otherwise(0.3048))


def limit_in_text_reference(text) -> Column:
    """SFC, MSL or STD: what a limit counts from; a number that names nothing counts from the sea."""
    return _of_words(text, _reference).alias("limit_reference")


def _reference(w: Column) -> Column:
    first = F.get(w, F.lit(0))
    named = F.exists(F.slice(w, 2, 2), lambda x: F.coalesce(lookup(COUNTS_FROM, x) == "SFC", F.lit(False)))
    flat = lookup({k: "SFC" if v == 0 else "STD" for k, v in NO_HEIGHT.items()}, first)
    return F.coalesce(flat, F.when(first == "FL", "STD"), F.when(first.rlike("^[0-9]"), F.when(named, "SFC").otherwise("MSL")))
