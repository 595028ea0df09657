"""Running text as words: what a text says, what it denies, and the measures it names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col
from .units import METRES

BETWEEN = r"\s()\[\],;:"
UNIT_WORDS = {"FT": "FT", "FEET": "FT", "M": "M", "METRE": "M", "METRES": "M", "METER": "M", "METERS": "M", "NM": "NM", "KM": "KM"}


def lookup(table: dict, key: Column) -> Column:
    """Value of a fixed table, null for other keys."""
    return F.try_element_at(F.create_map(*[x if isinstance(x, Column) else F.lit(x) for pair in table.items() for x in pair]), key)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text) -> Column:
    """Upper-case words of a text; a number and its unit are two words, marks around words are dropped."""
    t = F.upper(F.coalesce(col(text), F.lit("")))
    # a mark that most texts do not hold is looked for before its pattern is tried
    t = let(t, lambda t: F.when(t.contains(","), F.regexp_replace(t, r"(?<=\d),(?=\d)", ".")).otherwise(t))
    t = F.regexp_replace(t, r"(?<=\d)(?=(?:FT|FEET|MET(?:RE|ER)S?|M|NM|KM)\b)|(?<=\b(?:RWY|TWY|THR))(?=\d)", " ")
    t = let(t, lambda t: F.when(t.contains("/"), F.regexp_replace(t, r"(\d\d[LRC]?)\s*/\s*(?=\d\d[LRC]?\b)", "$1/")).otherwise(t))
    t = let(t, lambda t: F.when(t.contains("."), F.regexp_replace(t, rf"\.+(?=[\x85\u2028\u2029](?:[{BETWEEN}]|\z))", "")).otherwise(t))
    # points at the end of a word stay behind
    return F.regexp_extract_all(t, F.lit(rf"[^{BETWEEN}]*[^{BETWEEN}.]"), F.lit(0))


def says(said: Column, terms: Iterable[str]) -> Column:
    """Whether one of the terms is among the words."""
    return F.arrays_overlap(said, F.array(*[F.lit(t) for t in terms]))


def denies(said: Column, terms: Iterable[str]) -> Column:
    """Whether the word NOT stands before one of the terms."""
    listed = F.array(*[F.lit(t) for t in terms])
    return F.exists(F.arrays_zip(said.alias("w"), F.slice(said, 2, 1 << 30).alias("v")), lambda p: (p["w"] == "NOT") & F.array_contains(listed, p["v"]))


def first_of(said: Column, table: dict[str, str]) -> Column:
    """Meaning of the first word that the table knows, in the singular or with a final S; null when none."""
    meant = F.transform(said, lambda w: F.coalesce(lookup(table, w), lookup(table, F.regexp_replace(w, "S$", ""))))
    return F.get(F.array_compact(meant), F.lit(0))


def places(said: Column) -> Column:
    return F.sequence(F.lit(0), F.size(said))


def measures(said: Column) -> Column:
    """ARRAY<STRUCT<i, m, unit>> of the numbers with a unit: place of the number, metres, unit."""
    def one(i):
        unit = lookup(UNIT_WORDS, F.get(said, i + 1))
        value = F.when(F.get(said, i).rlike(r"^\d+(\.\d+)?$"), F.get(said, i).try_cast("double"))
        return F.struct(i.alias("i"), (value * lookup(METRES, unit)).alias("m"), unit.alias("unit"))

    # most words stand before no unit: they go before anything is read as a number
    before = F.filter(places(said), lambda i: F.get(said, i + 1).isin(*UNIT_WORDS))
    return F.filter(F.transform(before, one), lambda x: x["m"].isNotNull())
