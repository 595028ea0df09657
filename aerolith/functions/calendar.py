"""Publication cycles, sun times, daylight saving and schedule windows as Column expressions (all UTC)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col

HOUR_MS = 3_600_000
DAY_MS = 86_400_000
CYCLE_MS = 28 * DAY_MS
CYCLE_REF_MS = 1_706_140_800_000  # 2024-01-25T00:00Z, the first day of a cycle
LOCAL_MIDNIGHT_MS = 14 * HOUR_MS  # a cycle starting at local midnight east of Greenwich
PUBLICATION_DAYS = 42


def _shifted(ts) -> tuple[Column, Column, Column]:
    ms = F.unix_millis(col(ts).cast("timestamp"))
    ahead = F.pmod(F.lit(CYCLE_REF_MS) - ms, F.lit(CYCLE_MS))
    local = (ahead > 0) & (ahead <= LOCAL_MIDNIGHT_MS)
    return F.when(local, ms + ahead).otherwise(ms), ahead, local


def _cycle_no(ts) -> Column:
    ms, _, _ = _shifted(ts)
    return F.floor((ms - CYCLE_REF_MS) / CYCLE_MS)


def cycle_start(ts) -> Column:
    """First instant of the 28-day cycle a timestamp belongs to."""
    return F.timestamp_millis(F.lit(CYCLE_REF_MS) + _cycle_no(ts) * CYCLE_MS)


def cycle_next(ts) -> Column:
    return F.timestamp_millis(F.lit(CYCLE_REF_MS) + (_cycle_no(ts) + 1) * CYCLE_MS)


def cycle_id(ts) -> Column:
    """YYNN: year and number of the cycle; number 1 is the first cycle date of the year."""
    n = _cycle_no(ts)
    year = F.year(cycle_start(ts))
    first = F.ceil((F.unix_millis(F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp")) - CYCLE_REF_MS) / CYCLE_MS)
    return F.concat(F.lpad((year % 100).cast("string"), 2, "0"), F.lpad((n - first + 1).cast("string"), 2, "0"))


def cycle_exact(ts) -> Column:
    """True on a cycle date itself, or on a quarter hour up to 14 hours before it (local midnight)."""
    ms, ahead, local = _shifted(ts)
    return (F.pmod(ms - CYCLE_REF_MS, F.lit(CYCLE_MS)) == 0) & (~local | (ahead % 900_000 == 0))


def publication_date(effective) -> Column:
    return F.date_sub(col(effective).cast("date"), PUBLICATION_DAYS)


def _solar(day, lon, lat) -> tuple[Column, Column]:
    """(transit as Julian date, cosine of the hour angle) on a UTC date."""
    j = F.datediff(col(day), F.lit("1970-01-01").cast("date")) + 2440587.5
    n = F.ceil(j - 2451545.0 + 0.0008)
    js = n - col(lon) / 360.0
    anomaly = (357.5291 + 0.98560028 * js) % 360.0
    m = F.radians(anomaly)
    centre = 1.9148 * F.sin(m) + 0.02 * F.sin(2 * m) + 0.0003 * F.sin(3 * m)
    lam = F.radians((anomaly + centre + 180.0 + 102.9372) % 360.0)
    transit = 2451545.0 + js + 0.0053 * F.sin(m) - 0.0069 * F.sin(2 * lam)
    sin_d = F.sin(lam) * F.sin(F.radians(F.lit(23.4397)))
    cos_d = F.cos(F.asin(sin_d))
    cos_w = (F.sin(F.radians(F.lit(-0.833))) - F.sin(F.radians(col(lat))) * sin_d) / (F.cos(F.radians(col(lat))) * cos_d)
    return transit, cos_w


def _julian_ts(j: Column) -> Column:
    return F.timestamp_millis(F.round((j - 2440587.5) * DAY_MS).cast("long"))


def sunrise(day, lon, lat) -> Column:
    """Sunrise as timestamp; null in polar day or night."""
    transit, cos_w = _solar(day, lon, lat)
    return F.when(F.abs(cos_w) <= 1, _julian_ts(transit - F.degrees(F.acos(cos_w)) / 360))


def sunset(day, lon, lat) -> Column:
    transit, cos_w = _solar(day, lon, lat)
    return F.when(F.abs(cos_w) <= 1, _julian_ts(transit + F.degrees(F.acos(cos_w)) / 360))


def polar(day, lon, lat) -> Column:
    """'day' or 'night' where the sun does not set or rise, else null."""
    _, cos_w = _solar(day, lon, lat)
    return F.when(cos_w > 1, "night").when(cos_w < -1, "day")


def _last_sunday(year: Column, month: int) -> Column:
    last = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.date_sub(last, F.dayofweek(last) - 1)


def _nth_sunday(year: Column, month: int, n: int) -> Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(first, F.pmod(F.lit(8) - F.dayofweek(first), F.lit(7)) + 7 * (n - 1))


def _plus_hours(day: Column, hours: int) -> Column:
    return F.timestamp_millis(F.unix_millis(day.cast("timestamp")) + hours * HOUR_MS)


def dst_start(year, rule: str) -> Column:
    y = col(year)
    if rule == "EU":
        return _plus_hours(_last_sunday(y, 3), 1)
    if rule == "US":
        return _plus_hours(_nth_sunday(y, 3, 2), 7)
    return F.lit(None).cast("timestamp")


def dst_end(year, rule: str) -> Column:
    y = col(year)
    if rule == "EU":
        return _plus_hours(_last_sunday(y, 10), 1)
    if rule == "US":
        return _plus_hours(_nth_sunday(y, 11, 1), 6)
    return F.lit(None).cast("timestamp")


def in_dst(ts, rule: str) -> Column:
    t = col(ts)
    inside = (t >= dst_start(F.year(t), rule)) & (t < dst_end(F.year(t), rule))
    return F.coalesce(inside, F.lit(False))


def period_start(ts, period: str) -> Column:
    """Start of the day, the week (from Monday) or the cycle around a timestamp."""
    return cycle_start(ts) if period == "cycle" else F.date_trunc(period, col(ts))


def period_end(ts, period: str) -> Column:
    if period == "cycle":
        return cycle_next(ts)
    days = {"day": 1, "week": 7}[period]
    return F.timestamp_millis(F.unix_millis(F.date_trunc(period, col(ts))) + days * DAY_MS)


# ---------------------------------------------------------------- schedule windows

WEEKDAYS = ["SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT"]


def _weekday(day: Column) -> Column:
    """0 Sunday .. 6 Saturday."""
    return F.dayofweek(day) - 1


def _holiday(day: Column, holidays: Sequence[str]) -> Column:
    return F.date_format(day, "yyyy-MM-dd").isin(list(holidays)) if holidays else F.lit(False)


def _workday(day: Column, holidays: Sequence[str]) -> Column:
    return _weekday(day).between(1, 5) & ~_holiday(day, holidays)


def day_is(code: Column, day: Column, holidays: Sequence[str] = ()) -> Column:
    """Does one schedule day code cover a date? An empty code covers every day."""
    w = _weekday(day)
    code = F.coalesce(code, F.lit(""))
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    return (
        F.when(code.isin("", "ANY"), F.lit(True))
        .when(code == "WORK_DAY", _workday(day, holidays))
        .when(code == "BEF_WORK_DAY", _workday(F.date_add(day, 1), holidays))
        .when(code == "AFT_WORK_DAY", _workday(F.date_sub(day, 1), holidays))
        .when(code == "HOL", _holiday(day, holidays))
        .when(code == "BEF_HOL", _holiday(F.date_add(day, 1), holidays))
        .when(code == "AFT_HOL", _holiday(F.date_sub(day, 1), holidays))
        .when(code == "BUSY_FRI", w == 5)
        .when(code == "MON_FRI", w.between(1, 5))
        .when(code == "SUN_THU", w <= 4)
        .when(code == "SAT_WED", (w == 6) | (w <= 3))
        .when(code == "SAT_THU", w != 5)
        .otherwise(F.coalesce(F.get(names, w) == code, F.lit(False)))
    )


def day_match(day_code, day_til, day, holidays: Sequence[str] = ()) -> Column:
    """A day code, or a range of weekdays that may run over the weekend."""
    code, til, day = F.coalesce(col(day_code), F.lit("")), F.coalesce(col(day_til), F.lit("")), col(day)
    week = F.array(*[F.lit(d) for d in WEEKDAYS[1:] + WEEKDAYS[:1]])
    a, b = F.array_position(week, code) - 1, F.array_position(week, til) - 1
    w = F.pmod(_weekday(day) + 6, F.lit(7))
    in_range = F.when(a <= b, (w >= a) & (w <= b)).otherwise((w >= a) | (w <= b))
    return (
        F.when((til == "") | (til == code) | ((til == "ANY") & code.isin("", "ANY")), day_is(code, day, holidays))
        .when((a >= 0) & (b >= 0), in_range)
        .when(til == "ANY", day_is(code, day, holidays))
        .otherwise(day_is(code, day, holidays) | day_is(til, day, holidays))
    )


def _month_day(code: Column, year: Column, rule: str) -> Column:
    """MMDD of a 'DD-MM' code or of the start / end of daylight saving time."""
    parts = r"^(\d{1,2})-(\d{1,2})$"
    d, m = F.regexp_extract(code, parts, 1), F.regexp_extract(code, parts, 2)
    rule = "EU" if rule == "none" else rule
    span = {"SDLST": dst_start(year, rule), "EDLST": dst_end(year, rule)}
    out = F.when(d != "", m.cast("int") * 100 + d.cast("int"))
    for name, edge in span.items():
        out = F.when(code == name, F.month(edge) * 100 + F.dayofmonth(edge)).otherwise(out)
    return out


def date_match(start_code, end_code, day, rule: str = "EU") -> Column:
    """Yearly date range 'DD-MM' .. 'DD-MM'; it may run over the end of the year, open ends are the year's."""
    day = col(day)
    a = F.coalesce(_month_day(col(start_code), F.year(day), rule), F.lit(101))
    b = F.coalesce(_month_day(col(end_code), F.year(day), rule), F.lit(1231))
    v = F.month(day) * 100 + F.dayofmonth(day)
    return F.when(a <= b, (v >= a) & (v <= b)).otherwise((v >= a) | (v <= b))


def utc_offset_minutes(reference) -> Column:
    """Minutes east of UTC of 'UTC+3' / 'UTC-04:30'; anything else is UTC."""
    p = r"(?i)^UTC\s*([+-])\s*(\d{1,2})(?::?(\d{2}))?$"
    r = F.coalesce(col(reference), F.lit(""))
    sign, h, m = (F.regexp_extract(r, p, i) for i in (1, 2, 3))
    minutes = h.cast("int") * 60 + F.coalesce(F.when(m != "", m.cast("int")), F.lit(0))
    return F.when(h != "", F.when(sign == "-", -minutes).otherwise(minutes)).otherwise(F.lit(0))


def clock_minutes(text) -> Column:
    p = r"^(\d{1,2}):?(\d{2})"
    h = F.regexp_extract(F.coalesce(col(text), F.lit("")), p, 1)
    m = F.regexp_extract(F.coalesce(col(text), F.lit("")), p, 2)
    return F.when(h != "", h.cast("int") * 60 + m.cast("int"))


def read_sheet(df, sheet: dict[str, str]):
    """Adds what the texts of a schedule row say whatever the moment: ``_utc`` and the minutes of its two clock times.

    ``cover_rows`` takes them from there; rows that are copied to many moments are read once, before they are copied.
    """
    from ..operators.stage import settle

    clock = lambda which: clock_minutes(F.col(sheet[f"{which}_time"])).cast("double")
    return settle(df, _utc=utc_offset_minutes(F.col(sheet["time_ref"])), _clock_start=clock("start"), _clock_end=clock("end"))


def cover_rows(df, ts, sheet: dict[str, str], lon, lat, rule: str = "EU", holidays: Sequence[str] = (), out: str = "_covers"):
    """Two rows per schedule row, for today's window and for yesterday's that may run past midnight, with ``out``: it covers ts.

    ``sheet`` names the columns time_ref, dst, day, day_til, start_date, end_date, start_time, end_time, start_event,
    end_event, start_rel, end_rel, start_interp, end_interp. An end at or before the start is on the next day; a missing
    start is 00:00, a missing end 24:00. Sun events are clock minutes of the local day; where the sun does not rise or
    set, polar day counts as the whole day and polar night as noon.
    """
    from ..operators.stage import settle

    c = {k: F.col(v) for k, v in sheet.items()}
    df = df if "_utc" in df.columns else read_sheet(df, sheet)
    offset = F.col("_utc")
    if rule != "none":
        offset = offset + F.when((c["dst"] == "YES") & in_dst(ts, rule), 60).otherwise(0)
    d = settle(df, _off=offset, _ms=F.unix_millis(col(ts)))
    local = F.floor((F.col("_ms") + F.col("_off") * 60000) / DAY_MS)
    d = d.withColumn("_epoch_day", F.explode(F.array(local, local - 1)))
    d = settle(d, _day=F.date_add(F.lit("1970-01-01").cast("date"), F.col("_epoch_day").cast("int")), _since=(F.col("_ms") - F.col("_epoch_day") * DAY_MS) / 60000.0 + F.col("_off"))
    sunny = c["start_event"].isin("SR", "SS") | c["end_event"].isin("SR", "SS")
    minute = lambda t: (F.unix_millis(t) - F.col("_epoch_day") * DAY_MS) / 60000.0 + F.col("_off")
    d = settle(
        d, _match=day_match(c["day"], c["day_til"], F.col("_day"), holidays) & date_match(c["start_date"], c["end_date"], F.col("_day"), rule),
        _rise=F.when(sunny, minute(sunrise("_day", lon, lat))), _set=F.when(sunny, minute(sunset("_day", lon, lat))), _dark=F.when(sunny, polar("_day", lon, lat)),
    )

    def edge(which: str) -> Column:
        clock, event = F.col(f"_clock_{which}"), c[f"{which}_event"]
        sun = F.when(event == "SR", F.coalesce("_rise", F.when(F.col("_dark") == "day", 0.0).otherwise(720.0))).when(
            event == "SS", F.coalesce("_set", F.when(F.col("_dark") == "day", 1440.0).otherwise(720.0))
        ) + F.coalesce(c[f"{which}_rel"], F.lit(0))
        both = F.when(c[f"{which}_interp"] == "LATEST", F.greatest(clock, sun)).otherwise(F.least(clock, sun))
        return both

    d = settle(d, _from=F.coalesce(edge("start"), F.lit(0.0)), _to=F.coalesce(edge("end"), F.lit(1440.0)))
    end = F.when(F.col("_to") <= F.col("_from"), F.col("_to") + 1440.0).otherwise(F.col("_to"))
    return d.withColumn(out, F.col("_match") & (F.col("_since") >= F.col("_from")) & (F.col("_since") < end)).drop(
        "_utc", "_clock_start", "_clock_end", "_off", "_ms", "_epoch_day", "_day", "_since", "_match", "_rise", "_set", "_dark", "_from", "_to"
    )
