"""FUN-10/11/12/13/19/22, JOB-18, WIN-07/08, PRJ-16, JON-28, SRC-09/10, PRJ-17/19, STM-03, SNK-11 on events, orders and text made of their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as C
from ..plans import schedule as H
from ..sources import notam as N
from . import Family
from .tables import table

FAMILY = Family()


@FAMILY.add("fun_10_sun_table", """WITH t AS (SELECT c_custkey, (c_custkey * 37 % 3600) / 10.0 - 180 AS lon, (c_custkey * 53 % 1300) / 10.0 - 65 AS lat, DATE '2026-01-01' + CAST(c_custkey % 365 AS INTEGER) AS day FROM customer),
a AS (SELECT *, ceil(datediff('day', DATE '1970-01-01', day) + 2440587.5 - 2451545.0 + 0.0008) - lon / 360 AS js FROM t), b AS (SELECT *, radians((357.5291 + 0.98560028 * js) % 360) AS m FROM a),
c AS (SELECT *, radians((degrees(m) + 1.9148 * sin(m) + 0.02 * sin(2 * m) + 0.0003 * sin(3 * m) + 180 + 102.9372) % 360) AS l FROM b),
d AS (SELECT *, 2451545.0 + js + 0.0053 * sin(m) - 0.0069 * sin(2 * l) AS tr, sin(l) * sin(radians(23.4397)) AS sd FROM c),
e AS (SELECT *, (sin(radians(-0.833)) - sin(radians(lat)) * sd) / (cos(radians(lat)) * cos(asin(sd))) AS cw FROM d)
SELECT c_custkey, CASE WHEN abs(cw) <= 1 THEN CAST(round(((tr - degrees(acos(cw)) / 360) - 2440587.5) * 1440) AS BIGINT) END AS rise_min, CASE WHEN abs(cw) <= 1 THEN CAST(round(((tr + degrees(acos(cw)) / 360) - 2440587.5) * 1440) AS BIGINT) END AS set_min,
  CASE WHEN cw > 1 THEN 'night' WHEN cw < -1 THEN 'day' END AS polar FROM e""")
def _(spark, sf):
    k = F.col("c_custkey")
    t = table(spark, sf, "customer").select("c_custkey", ((k * 37 % 3600) / 10.0 - 180).alias("lon"), ((k * 53 % 1300) / 10.0 - 65).alias("lat"), F.date_add(F.lit("2026-01-01").cast("date"), (k % 365).cast("int")).alias("day"))
    mins = lambda c: F.round(F.unix_millis(c) / 60000).cast("long")
    return t.select("c_custkey", mins(C.sunrise("day", "lon", "lat")).alias("rise_min"), mins(C.sunset("day", "lon", "lat")).alias("set_min"), C.polar("day", "lon", "lat").alias("polar"))


@FAMILY.add("fun_11_in_dst", """WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS t FROM orders),
s AS (SELECT *, last_day(make_date(year(t), 3, 1)) AS m3, last_day(make_date(year(t), 10, 1)) AS m10 FROM t)
SELECT o_orderkey, t >= CAST(m3 - CAST(dayofweek(m3) AS INTEGER) AS TIMESTAMP) + INTERVAL 1 HOUR AND t < CAST(m10 - CAST(dayofweek(m10) AS INTEGER) AS TIMESTAMP) + INTERVAL 1 HOUR AS summer FROM s""")
def _(spark, sf):
    t = F.timestamp_millis(F.unix_millis(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 24) * 3600000)
    return table(spark, sf, "orders").select("o_orderkey", t.alias("t")).select("o_orderkey", C.in_dst("t", "EU").alias("summer"))


@FAMILY.add("fun_12_day_match", """WITH t AS (SELECT event_id, CAST(ts AS DATE) AS d, ['MON','TUE','WED','THU','FRI','SAT','SUN','WORK_DAY','ANY','SAT_WED'][1 + event_id % 10] AS a, ['MON','TUE','WED','THU','FRI','SAT','SUN',''][1 + event_id % 8] AS b FROM events),
w AS (SELECT *, dayofweek(d) AS w, (dayofweek(d) + 6) % 7 AS m, list_position(['MON','TUE','WED','THU','FRI','SAT','SUN'], a) - 1 AS ia, list_position(['MON','TUE','WED','THU','FRI','SAT','SUN'], b) - 1 AS ib FROM t),
x AS (SELECT *, CASE a WHEN 'WORK_DAY' THEN w BETWEEN 1 AND 5 WHEN 'ANY' THEN true WHEN 'SAT_WED' THEN w = 6 OR w <= 3 ELSE m = ia END AS ma, CASE b WHEN '' THEN true ELSE m = ib END AS mb FROM w)
SELECT event_id, CASE WHEN b = '' OR a = b THEN ma WHEN ia >= 0 AND ib >= 0 THEN CASE WHEN ia <= ib THEN m BETWEEN ia AND ib ELSE m >= ia OR m <= ib END ELSE ma OR mb END AS covered FROM x""")
def _(spark, sf):
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), (F.col("event_id") % n).cast("int"))
    week = ["MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"]
    e = table(spark, sf, "events").select("event_id", F.to_date("ts").alias("d"), pick([*week, "WORK_DAY", "ANY", "SAT_WED"], 10).alias("a"), pick([*week, ""], 8).alias("b"))
    return e.select("event_id", C.day_match("a", "b", "d").alias("covered"))


@FAMILY.add("fun_22_period_window", """SELECT event_id, date_trunc('week', ts)::TIMESTAMP AS week_start, date_trunc('week', ts)::TIMESTAMP + INTERVAL 7 DAY AS week_end, TIMESTAMP '2024-01-25' + to_days(CAST(28 * floor((epoch_ms(ts) + CASE WHEN (1706140800000 - epoch_ms(ts)) % 2419200000 BETWEEN 1 AND 50400000 THEN (1706140800000 - epoch_ms(ts)) % 2419200000 ELSE 0 END - 1706140800000) / 2419200000.0) AS INTEGER)) AS cycle_start FROM events""")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", C.period_start("ts", "week").alias("week_start"), C.period_end("ts", "week").alias("week_end"), C.period_start("ts", "cycle").alias("cycle_start"))


def schedule_entries(spark, sf):
    """Every event as one timesheet row of its user: a status, days and clock times made of its columns."""
    k = F.col("event_id")
    none = lambda c: F.lit(None).cast("string").alias(c)
    hhmm = lambda h: F.format_string("%02d:00", h.cast("int"))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("feature_id"), k.alias("entry_no"), F.when(F.col("event_type") == "error", "CLOSED").when(F.col("event_type") == "view", "LIMITED").otherwise("ACTIVE").alias("status"),
        none("nil_reason"), F.lit(True).alias("has_times"), none("excluded"), F.lit(25.0).alias("lon"), F.lit(52.0).alias("lat"), F.lit("UTC").alias("time_ref"), F.lit("NO").alias("dst"),
        F.get(F.array(*[F.lit(d) for d in C.WEEKDAYS]), (k % 7).cast("int")).alias("day"), none("day_til"), none("start_date"), none("end_date"), hhmm(k * 5 % 24).alias("start_time"), hhmm(k * 11 % 24).alias("end_time"),
        none("start_event"), none("end_event"), F.lit(0).alias("start_rel"), F.lit(0).alias("end_rel"), none("start_interp"), none("end_interp"),
    )


STATE_CASE = """SELECT feature_id, {extra} CASE WHEN max(CASE WHEN c THEN r END) = 3 THEN 'off' WHEN max(CASE WHEN c THEN r END) = 2 THEN 'on' WHEN max(CASE WHEN c THEN r END) = 1 THEN 'maybe' WHEN bool_or(r < 3) THEN 'off' ELSE 'unknown' END AS state"""
ENTRY_SQL = """en AS (SELECT user_id AS feature_id, event_id % 7 AS w, event_id * 5 % 24 * 60 AS a, event_id * 11 % 24 * 60 AS b0, CASE event_type WHEN 'error' THEN 3 WHEN 'view' THEN 1 ELSE 2 END AS r FROM events),
e2 AS (SELECT *, CASE WHEN b0 <= a THEN b0 + 1440 ELSE b0 END AS b FROM en)"""


@FAMILY.add("job_18_state_at", f"""WITH {ENTRY_SQL}, x AS (SELECT *, (w = 3 AND 570 >= a AND 570 < b) OR (w = 2 AND 570 + 1440 >= a AND 570 + 1440 < b) AS c FROM e2)
{STATE_CASE.format(extra='')} FROM x GROUP BY 1""")
def _(spark, sf):
    return H.state_at(schedule_entries(spark, sf), ["feature_id"], F.lit("2026-10-07 09:30:00").cast("timestamp"))


GRID_SQL = f"""{ENTRY_SQL}, g AS (SELECT unnest(generate_series(0, 47)) AS h), x AS (SELECT feature_id, h, r, (w = 3 + h // 24 AND h % 24 * 60 >= a AND h % 24 * 60 < b) OR (w = 2 + h // 24 AND h % 24 * 60 + 1440 >= a AND h % 24 * 60 + 1440 < b) AS c FROM e2 CROSS JOIN g),
s AS ({STATE_CASE.format(extra='h,')} FROM x GROUP BY feature_id, h)"""


def _grid(spark, sf):
    rows = H.time_grid(schedule_entries(spark, sf), "2026-10-07 00:00:00", "2026-10-08 23:00:00", 60, by=["feature_id", "entry_no"])
    return H.state_at(rows, ["feature_id", "at"], F.col("at"))


@FAMILY.add("win_07_state_intervals", f"""WITH {GRID_SQL}, r AS (SELECT *, h - row_number() OVER (PARTITION BY feature_id, state ORDER BY h) AS grp FROM s)
SELECT feature_id, state, TIMESTAMP '2026-10-07' + to_hours(min(h)) AS "from", TIMESTAMP '2026-10-07' + to_hours(max(h)) AS until, count(*) AS n FROM r GROUP BY feature_id, state, grp""")
def _(spark, sf):
    return H.state_intervals(_grid(spark, sf), ["feature_id"])


@FAMILY.add("win_08_next_change", f"""WITH {GRID_SQL}, f AS (SELECT feature_id, state FROM s WHERE h = 0), c AS (SELECT s.feature_id, min(h) AS h FROM s JOIN f ON f.feature_id = s.feature_id AND f.state <> s.state GROUP BY 1)
SELECT f.feature_id, f.state, TIMESTAMP '2026-10-07' + to_hours(c.h) AS changes_at, s.state AS new_state FROM f LEFT JOIN c ON c.feature_id = f.feature_id LEFT JOIN s ON s.feature_id = c.feature_id AND s.h = c.h""")
def _(spark, sf):
    return H.next_change(_grid(spark, sf), ["feature_id"])


@FAMILY.add("prj_16_timesheet_rows", "SELECT CASE event_type WHEN 'error' THEN 'off' WHEN 'view' THEN 'maybe' ELSE 'on' END AS class, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return schedule_entries(spark, sf).groupBy(H.status_class("status").alias("class")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- NOTAM text made of orders, one briefing per customer

def briefings(spark, sf):
    k = F.col("o_orderkey")
    text = F.format_string(
        "(A%04d/%02d NOTAM%s\nQ) EAAD/Q%s/IV/BO/A/000/%03d/5522N02515E%03d\nA) EADD B) 26%02d%02d0600 C) PERM\nE) CRANE AT %02d%02d00N %03d%02d00E HGT %dFT AGL LGTD RWY %02d CLSD)\n",
        (k % 10000).cast("int"), (k % 100).cast("int"), F.when(k % 10 == 0, "C").otherwise("N"), F.when(k % 2 == 0, "OBCE").otherwise("MRLC"), (k % 400).cast("int"), (1 + k % 99).cast("int"),
        F.month("o_orderdate"), F.least(F.dayofmonth("o_orderdate"), F.lit(28)), (40 + k % 40).cast("int"), (k % 60).cast("int"), (k % 170).cast("int"), (k * 7 % 60).cast("int"), (100 + k % 900).cast("int"), (1 + k % 36).cast("int"),
    )
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), (k % 8).alias("page"), k.alias("k"), text.alias("t"))
    return o.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "\n").alias("text"))


@FAMILY.add("src_09_split_notams", "SELECT o_custkey AS doc, o_orderkey % 8 AS page, CAST(row_number() OVER (PARTITION BY o_custkey, o_orderkey % 8 ORDER BY o_orderkey) - 1 AS INTEGER) AS notam_no FROM orders")
def _(spark, sf):
    return N.split_notams(briefings(spark, sf), keep=("doc", "page")).select("doc", "page", "notam_no")


NOTAM_SQL = """n AS (SELECT 'A' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || '/' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS id, o_custkey AS doc, o_orderkey AS k, o_orderdate AS d FROM orders)"""


@FAMILY.add("src_10_notam_fields", f"""WITH {NOTAM_SQL} SELECT doc, id, CASE WHEN k % 10 = 0 THEN 'C' ELSE 'N' END AS type, CASE WHEN k % 2 = 0 THEN 'QOBCE' ELSE 'QMRLC' END AS code, CASE WHEN k % 2 = 0 THEN 'obstacle' ELSE 'runway' END AS cat,
  CAST(1 + k % 99 AS INTEGER) AS q_radius_nm, make_timestamp(2026, month(d), least(day(d), 28), 6, 0, 0) AS valid_from, round((k % 400) * 30.48::DOUBLE, 3) AS upper_m FROM n""")
def _(spark, sf):
    f = N.notam_fields(N.split_notams(briefings(spark, sf), keep=("doc", "page")))
    return f.select("doc", "id", "type", "code", "cat", "q_radius_nm", "valid_from", F.round("upper_m", 3).alias("upper_m"))


@FAMILY.add("prj_17_notam_obstacles", f"""WITH {NOTAM_SQL} SELECT id, round(k % 170 + k * 7 % 60 / 60.0, 6) AS lon, round(40 + k % 40 + k % 60 / 60.0, 6) AS lat, round((100 + k % 900) * 0.3048::DOUBLE, 4) AS hgt_m, 'YES' AS lit, 'CRANE' AS type FROM n WHERE k % 2 = 0""")
def _(spark, sf):
    o = N.notam_obstacles(N.notam_fields(N.split_notams(briefings(spark, sf), keep=("doc", "page"))))
    return o.select("id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("hgt_m", 4).alias("hgt_m"), "lit", "type")


@FAMILY.add("prj_19_notam_runway", f"WITH {NOTAM_SQL} SELECT id, lpad(CAST(1 + k % 36 AS VARCHAR), 2, '0') AS rwy, true AS closed FROM n")
def _(spark, sf):
    return N.notam_runway(N.notam_fields(N.split_notams(briefings(spark, sf), keep=("doc", "page")))).select("id", "rwy", "closed")


@FAMILY.add("stm_03_notam_state", f"""WITH {NOTAM_SQL} SELECT id, CASE WHEN k % 10 = 0 THEN 'cancel' WHEN make_timestamp(2026, month(d), least(day(d), 28), 6, 0, 0) > TIMESTAMP '2026-06-15 12:00:00' THEN 'future' ELSE 'on' END AS state FROM n""")
def _(spark, sf):
    f = N.notam_fields(N.split_notams(briefings(spark, sf), keep=("doc", "page")))
    return f.select("id", N.notam_state("2026-06-15 12:00:00").alias("state"))


@FAMILY.add("fun_13_schedule_rows", """WITH s AS (SELECT o_orderkey AS id, o_orderkey % 3 AS m, o_orderkey % 12 AS a FROM orders), d AS (SELECT id, m, a, unnest(CASE m WHEN 0 THEN [1, 2, 3, 4, 5] WHEN 1 THEN [0, 1, 2, 3, 4, 5, 6] ELSE [6, 0] END) AS day FROM s)
SELECT id, CAST(day AS INTEGER) AS day, CAST(a * 60 AS INTEGER) AS from_min, CAST((a + 8) * 60 AS INTEGER) AS to_min, m = 1 AS partial FROM d""")
def _(spark, sf):
    k = F.col("o_orderkey")
    a = (k % 12).cast("int")
    sched = F.concat(F.when(k % 3 == 0, "MON-FRI ").when(k % 3 == 1, "DAILY EXC HOL ").otherwise("SAT SUN "), F.format_string("%02d00-%02d00", a, a + 8))
    return N.schedule_rows(table(spark, sf, "orders").select(k.alias("id"), sched.alias("sched")))


@FAMILY.add("jon_28_sua_state", """WITH a AS (SELECT s_suppkey AS area_id, 'EAR' || s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 'on' ELSE 'off' END AS sch FROM supplier),
n AS (SELECT 'EAR' || l_suppkey AS k, bool_or(l_linenumber = 1 AND l_quantity > 49) AS off, bool_or(l_quantity < 2) AS act FROM lineitem GROUP BY 1)
SELECT area_id, CASE WHEN off THEN 'off' WHEN act THEN 'on' ELSE sch END AS state FROM a LEFT JOIN n USING (k)""")
def _(spark, sf):
    s = F.col("s_suppkey")
    areas = table(spark, sf, "supplier").select(s.alias("area_id"), F.concat(F.lit("EA R-"), s).alias("desig"), F.when(s % 3 == 0, "on").otherwise("off").alias("scheduled"))
    act = F.when((F.col("l_linenumber") == 1) & (F.col("l_quantity") > 49), "off").when(F.col("l_quantity") < 2, "on").otherwise("")
    n = table(spark, sf, "lineitem").select(F.concat(F.lit("ear "), F.col("l_suppkey")).alias("desig"), act.alias("activation"))
    return N.sua_state(areas, n).select("area_id", "state")
