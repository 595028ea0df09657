"""Summaries of a data set, sections of a publication, procedure legs and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import col

# Airspace types by publication section; other types belong to ENR 2.2.
AIRSPACE_SECTIONS = {
    "ENR 2.1": ["FIR", "UIR", "TMA", "CTA", "UTA", "OCA"], "ENR 5.1": ["P", "R", "D"], "ENR 5.2": ["TSA", "TRA", "CBA", "MTR", "MOA", "ADIZ", "FBZ", "NPZ"], "ENR 5.3": ["A", "W", "D_OTHER"],
}


def dataset_summary(features: DataFrame, dataset: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Per type: features, first, last and most common begin day."""
    day = F.to_date("valid_begin")
    days = features.filter(F.col("valid_begin").isNotNull()).groupBy(*dataset, "feature_type", day.alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    common = days.groupBy(*dataset, "feature_type").agg(F.min("_d").alias("first_day"), F.max("_d").alias("last_day"), F.min_by("_d", F.struct(F.negative("_n"), "_d")).alias("common_day"))
    n = features.groupBy(*dataset, "feature_type").agg(F.count(F.lit(1)).alias("n"))
    return n.join(common, [*dataset, "feature_type"], "left")


def state_vote(features: DataFrame, prefixes: DataFrame, dataset: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """State of each data set by location indicators: aerodromes weigh 1, FIRs 0.5; the longest known prefix counts.

    ``features``: dataset, feature_type, code; ``prefixes``: prefix (1 to 3 letters), state.
    """
    votes = features.filter(F.col("code").rlike("^[A-Z]{4}$")).select(*dataset, "code", F.when(F.col("feature_type") == "AirportHeliport", 1.0).otherwise(0.5).alias("_w"))
    codes = votes.select("code").distinct().select("code", F.explode(F.array(*[F.substring("code", 1, n) for n in (3, 2, 1)])).alias("prefix"))
    state = codes.join(prefixes, "prefix").groupBy("code").agg(F.max_by(F.struct("prefix", "state"), F.length("prefix")).alias("_s"))
    tally = votes.join(state, "code").groupBy(*dataset, F.col("_s.prefix").alias("prefix"), F.col("_s.state").alias("state")).agg(F.sum("_w").alias("weight"))
    best = tally.groupBy(*dataset).agg(F.min(F.struct(F.negative("weight").alias("w"), "prefix", "state")).alias("_b"))
    return best.select(*dataset, F.col("_b.prefix").alias("prefix"), F.col("_b.state").alias("state"), (-F.col("_b.w")).alias("weight"))


def section_of(feature_type, subtype, owned, navigation=None) -> Column:
    """Publication section of a feature: AD for what an aerodrome owns, ENR by airspace kind or navigation type, else GEN or Other."""
    t, s = col(feature_type), col(subtype)
    airspace = F.lit("ENR 2.2")
    for section, kinds in AIRSPACE_SECTIONS.items():
        airspace = F.when(s.isin(kinds), section).otherwise(airspace)
    rnav = col(navigation).rlike("RNAV|RNP") if navigation is not None else F.lit(False)
    return (
        F.when((t == "AirportHeliport") | col(owned), "AD 2").when(t == "Airspace", airspace).when(t.isin("Route", "RouteSegment"), F.when(rnav, "ENR 3.2").otherwise("ENR 3.1"))
        .when(t.isin("OrganisationAuthority"), "GEN 1.1").when(t == "DesignatedPoint", "ENR 4.4").when(t.isin("Navaid", "VOR", "DME", "NDB", "TACAN"), "ENR 4.1").when(t == "VerticalStructure", "ENR 5.4").otherwise("Other")
    )


# What each path terminator needs.
PATH_TERMINATORS = "IF TF CF DF RF AF FA FC FD FM CA CD CI CR VA VD VI VM VR PI HA HF HM".split()
RNAV_TERMINATORS = "IF TF CF DF RF FA FM CA VA VI VM HM".split()
NEEDS_END = "TF CF DF RF AF".split()
NEEDS_TURN = "RF AF".split()
NEEDS_ALTITUDE = "FA CA VA HA".split()
NEEDS_COURSE = "CF FA FM CA CI CD CR VA VI VM VD VR HA HF HM".split()


def first_last_leg(legs: DataFrame, keys: Sequence[str] = ("procedure_id", "phase"), seq: str = "seq", terminator: str = "terminator") -> DataFrame:
    """First and last path terminator of each phase of each procedure."""
    return legs.groupBy(*keys).agg(F.min_by(terminator, seq).alias("first"), F.max_by(terminator, seq).alias("last"))


def leg_checks(legs: DataFrame) -> DataFrame:
    """Findings for procedure legs: procedure_id, seq, severity, check.

    ``legs``: procedure_id, seq, terminator, rnav, end_fix, turn, altitude_m, course, vertical_angle, leg_type.
    """
    t = F.col("terminator")
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    unknown = ~t.isin(PATH_TERMINATORS)
    tests = [
        (empty("terminator") & F.col("rnav"), "warning", "no path terminator"), (~empty("terminator") & unknown, "warning", "unknown path terminator"),
        (F.col("rnav") & ~unknown & ~t.isin(RNAV_TERMINATORS), "warning", "not used for RNAV"), (t.isin(NEEDS_END) & empty("end_fix"), "warning", "needs an end fix"),
        (t.isin(NEEDS_TURN) & empty("turn"), "warning", "no turn direction"), (t.isin(NEEDS_ALTITUDE) & F.col("altitude_m").isNull(), "warning", "no altitude"),
        (t.isin(NEEDS_COURSE) & F.col("course").isNull(), "warning", "no course"),
        (F.col("leg_type").isin("FinalLeg", "IntermediateLeg") & (F.col("vertical_angle") > 0), "warning", "descent angle is positive"),
    ]
    flags = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(k).alias("check"))) for c, s, k in tests]))
    return legs.select("procedure_id", "seq", F.explode(flags).alias("f")).select("procedure_id", "seq", "f.*")


DESIGNATOR = r"^[A-Z]{2,5}[1-9][A-HJ-NP-Z]?$"


def designator_checks(procedures: DataFrame) -> DataFrame:
    """Coded designators that are missing, malformed or longer than a navigation database holds: procedure_id, severity, check."""
    d = F.coalesce(F.col("designator"), F.lit(""))
    tests = [(d == "", "warning", "no coded designator"), ((d != "") & ((F.length(d) > 7) | ~d.rlike(DESIGNATOR)), "info", "designator form"), (F.length(d) > 6, "info", "designator length")]
    flags = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(k).alias("check"))) for c, s, k in tests]))
    return procedures.select("procedure_id", F.explode(flags).alias("f")).select("procedure_id", "f.*")
