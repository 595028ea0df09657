"""State of features over time from validity, temporary changes and schedules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import cover_rows, read_sheet
from ..functions.geo import col
from ..operators.ordered import OrderedScan, Running
from ..session import cut_lineage

SHEET = {k: k for k in (
    "time_ref dst day day_til start_date end_date start_time end_time start_event end_event start_rel end_rel start_interp end_interp".split()
)}
ON = ["ACTIVE", "NORMAL", "OPERATIONAL", "OPEN", "AVAILABLE", "IN_USE", "ON"]
MAYBE = ["AVBL_FOR_ACTIVATION", "CONDITIONAL", "INTERMITTENT", "LIMITED", "ON_REQUEST", "RESTRICTED", "PARTIAL"]


def status_class(status) -> Column:
    """on, maybe or off of a status code; an empty one is on."""
    s = F.upper(F.coalesce(col(status), F.lit("")))
    return F.when((s == "") | s.isin(ON), "on").when(s.isin(MAYBE) | s.startswith("OTHER:"), "maybe").otherwise("off")


def state_at(entries: DataFrame, keys: Sequence[str], t: Column, rule: str = "EU", holidays: Sequence[str] = ()) -> DataFrame:
    """State of features at a moment from their schedule rows: keys, state (on, maybe, off, unknown).

    ``entries``: keys, entry_no, status, nil_reason, has_times, excluded, lon, lat and the timesheet columns, one row per
    timesheet (or one without times). An excluded row that covers the moment takes its entry out; off outranks on, on
    outranks maybe; outside all hours given the state is off.
    """
    e = cover_rows(entries, t, SHEET, "lon", "lat", rule, holidays).withColumn("_class", status_class("status"))
    nil = F.upper(F.coalesce("nil_reason", F.lit("")))
    out = (F.coalesce("excluded", F.lit("")) == "YES") & F.col("_covers")
    per_entry = e.groupBy(*keys, "entry_no").agg(
        F.bool_or(out).alias("_out"), F.bool_or((F.coalesce("excluded", F.lit("")) != "YES") & F.col("_covers")).alias("_in"), F.bool_or("has_times").alias("_timed"),
        F.any_value("_class").alias("_class"), F.bool_or(nil.contains("NOTAM")).alias("_notam"), F.bool_or(nil.contains("H24")).alias("_h24"),
    )
    now = F.when(F.col("_notam"), "maybe").when(F.col("_h24") | ~F.col("_timed"), F.col("_class")).when(F.col("_in") & ~F.col("_out"), F.col("_class"))
    rank = F.when(now == "off", 3).when(now == "on", 2).when(now == "maybe", 1)
    top = per_entry.groupBy(*keys).agg(F.max(rank).alias("_r"), F.bool_or(F.col("_class") != "off").alias("_some"))
    state = F.when(F.col("_r") == 3, "off").when(F.col("_r") == 2, "on").when(F.col("_r") == 1, "maybe").when(F.col("_some"), "off").otherwise("unknown")
    return top.select(*keys, state.alias("state"))


def valid_state(states: DataFrame, t: Column) -> Column:
    """none where a resolved feature is not valid at the moment, else null (its schedule decides)."""
    early = F.col("future") | (F.col("valid_begin") > t) | (F.col("life_begin") > t)
    late = F.col("ended") | (F.col("valid_end") <= t) | (F.col("life_end") <= t)
    return F.when(F.coalesce(early, F.lit(False)) | F.coalesce(late, F.lit(False)), "none")


def state_intervals(samples: DataFrame, keys: Sequence[str], at: str = "at", state: str = "state", segment: str = "day") -> DataFrame:
    """Runs of equal state over a time grid: keys, state, from, until (last sample), n."""
    scan = OrderedScan(keys, [F.col(at)], F.date_trunc(segment, at))
    # both scans read the samples twice: what made them runs once
    seen = scan.previous(cut_lineage(samples.select(*keys, at, state)), _before=F.col(state))
    flagged = seen.withColumn("_new", (~F.col(state).eqNullSafe(F.col("_before"))).cast("int"))
    runs = scan.running(flagged, _run=Running("sum", F.col("_new")))
    return runs.groupBy(*keys, "_run", state).agg(F.min(at).alias("from"), F.max(at).alias("until"), F.count(F.lit(1)).alias("n")).drop("_run")


def time_grid(features: DataFrame, start: str, end: str, step_minutes: int, by: Sequence[str] = ()) -> DataFrame:
    """One row per feature and step.

    With ``by`` the rows are dealt out by these columns before they are copied: a few rows become many, and what groups
    by them afterwards moves none of the copies. Schedule rows are read before they are copied.
    """
    if by:
        features = features.repartition(int(features.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    if set(SHEET) <= set(features.columns):
        features = read_sheet(features, SHEET)
    steps = F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"INTERVAL {step_minutes} MINUTES"))
    return features.withColumn("at", F.explode(steps))


def next_change(samples: DataFrame, keys: Sequence[str], at: str = "at", state: str = "state") -> DataFrame:
    """First sample whose state differs from the first one: keys, changes_at, new_state (null: no change)."""
    samples = cut_lineage(samples.select(*keys, at, state))  # read twice below
    first = samples.groupBy(*keys).agg(F.min_by(state, at).alias("_now"))
    later = samples.join(first, list(keys)).filter(~F.col(state).eqNullSafe(F.col("_now")))
    change = later.groupBy(*keys).agg(F.min(F.struct(F.col(at).alias("changes_at"), F.col(state).alias("new_state"))).alias("_c"))
    return first.join(change, list(keys), "left").select(*keys, F.col("_now").alias("state"), "_c.changes_at", "_c.new_state")
