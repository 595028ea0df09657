"""JON-14, SET-02, JOB-08/09/10, SNK-12, AGG-06/07/09, PRJ-25, SRT-01, FUN-08 on orders as two deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as C
from ..operators import diff as D
from . import Family
from .tables import DELIVERIES_SQL, deliveries, table, with_props

FAMILY = Family()

SECTION_SQL = "CASE substr(priority, 1, 1) WHEN '1' THEN 'GEN 1.1' WHEN '2' THEN 'ENR 2.1' WHEN '3' THEN 'ENR 5.1' WHEN '4' THEN 'AD 2.' || (key % 24 + 1) ELSE 'X' END"

COMPARE_SQL = f"""{DELIVERIES_SQL},
cmp AS (SELECT coalesce(a.key, b.key) AS key, coalesce(b.priority, a.priority) AS priority,
          CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed'
               WHEN a.status IS DISTINCT FROM b.status OR a.cents IS DISTINCT FROM b.cents THEN 'modified' ELSE 'unchanged' END AS kind,
          a.status AS sa, b.status AS sb, a.cents AS ca, b.cents AS cb FROM delivery_a a FULL JOIN delivery_b b ON a.key = b.key),
fields AS (SELECT key, priority, 'status' AS path, sa AS old, sb AS new FROM cmp WHERE kind = 'modified' AND sa IS DISTINCT FROM sb
           UNION ALL SELECT key, priority, 'cents', CAST(ca AS VARCHAR), CAST(cb AS VARCHAR) FROM cmp WHERE kind = 'modified' AND ca IS DISTINCT FROM cb)"""


def section():
    p = F.substring("priority", 1, 1)
    return (
        F.when(p == "1", "GEN 1.1").when(p == "2", "ENR 2.1").when(p == "3", "ENR 5.1")
        .when(p == "4", F.concat(F.lit("AD 2."), F.col("key") % 24 + 1)).otherwise("X")
    )


def _compare(spark, sf):
    a, b = (with_props(d, ["status", "cents", "priority"], ["key", "priority"]) for d in deliveries(spark, sf))
    return D.compare(a, b, ["key"], keep=["priority"])


@FAMILY.add("jon_14_compare_kinds", f"WITH {COMPARE_SQL} SELECT key, kind FROM cmp")
def _(spark, sf):
    return _compare(spark, sf).select("key", "kind")


@FAMILY.add("jon_14_compare_fields", f"""WITH {COMPARE_SQL}
SELECT key, path, old, new, CASE WHEN old IS NULL THEN 'INSERT' WHEN new IS NULL THEN 'DELETE' ELSE 'AMEND' END AS change FROM fields""")
def _(spark, sf):
    return D.compare_fields(_compare(spark, sf), ["key"])


@FAMILY.add("jon_14_key_choice", f"""WITH {DELIVERIES_SQL} SELECT round(avg(CASE WHEN b.key IS NULL THEN 0.0 ELSE 1.0 END), 6) AS share
FROM delivery_a a LEFT JOIN delivery_b b ON a.key = b.key""")
def _(spark, sf):
    a, b = deliveries(spark, sf)
    shaped = lambda d: d.select(F.col("key").alias("feature_id"))
    return D.identifier_match_share(shaped(a), shaped(b)).select(F.round("share", 6).alias("share"))


@FAMILY.add("set_02_crc_verify", f"""WITH {DELIVERIES_SQL},
x AS (SELECT key, md5(concat_ws(';', key, status, cents)) AS crc FROM delivery_b), y AS (SELECT key, md5(concat_ws(';', key, status, cents)) AS crc FROM delivery_a)
SELECT coalesce(x.key, y.key) AS key, CASE WHEN y.key IS NULL THEN 'added' WHEN x.key IS NULL THEN 'missing' WHEN x.crc = y.crc THEN 'same' ELSE 'changed' END AS status
FROM x FULL JOIN y ON x.key = y.key""")
def _(spark, sf):
    a, b = (d.select("key", F.md5(F.concat_ws(";", F.col("key").cast("string"), "status", F.col("cents").cast("string"))).alias("crc")) for d in deliveries(spark, sf))
    return D.crc_verify(b, a, ["key"])


@FAMILY.add("job_10_side_by_side", f"""WITH {DELIVERIES_SQL}
SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'add' WHEN b.key IS NULL THEN 'del'
  WHEN coalesce(a.status, '') <> coalesce(b.status, '') OR a.cents <> b.cents THEN 'chg' ELSE 'same' END AS status,
  CASE WHEN a.key IS NOT NULL AND b.key IS NOT NULL THEN concat_ws(',', CASE WHEN coalesce(a.status, '') <> coalesce(b.status, '') THEN 'status' END, CASE WHEN a.cents <> b.cents THEN 'cents' END) END AS changed
FROM delivery_a a FULL JOIN delivery_b b ON a.key = b.key""")
def _(spark, sf):
    a, b = deliveries(spark, sf)
    return D.side_by_side(a, b, ["key"], ["status", "cents"])


@FAMILY.add("snk_12_change_file", f"""WITH {COMPARE_SQL}
SELECT key, kind, coalesce(cb, ca) AS cents, CASE WHEN kind = 'removed' THEN TIMESTAMP '2002-01-03' END AS ends FROM cmp WHERE kind <> 'unchanged'""")
def _(spark, sf):
    a, b = deliveries(spark, sf)
    return D.change_file(_compare(spark, sf), a, b, ["key"], "2002-01-03").select("key", "kind", "cents", "ends")


@FAMILY.add("job_08_cycle_changes", f"""WITH {COMPARE_SQL},
ch AS (SELECT key, CASE WHEN key % 4 = 0 THEN 'New feature' WHEN key % 4 = 1 THEN 'Amended (new baseline)' ELSE 'Correction' END AS kind, key % 3 AS n_fields, key % 5 = 0 AS same, since FROM delivery_b),
f AS (SELECT key, sum(n_fields)::BIGINT AS nf, bool_or(kind = 'New feature') AS is_new, bool_and(kind = 'Amended (new baseline)') AS amended, count(*) AS n_slices
      FROM ch WHERE NOT same AND since >= TIMESTAMP '1998-02-26' AND since < TIMESTAMP '1998-03-26' GROUP BY 1),
c AS (SELECT key, kind AS k, (sa IS DISTINCT FROM sb)::INT + (ca IS DISTINCT FROM cb)::INT AS n FROM cmp WHERE kind IN ('added', 'modified'))
SELECT coalesce(f.key, c.key) AS key, coalesce(is_new, false) OR coalesce(k, '') = 'added' AS added, coalesce(n_slices, 0) AS n_slices,
       coalesce(nf, 0) AS n_slice_fields, CASE WHEN k = 'modified' THEN n ELSE 0 END::BIGINT AS n_compare_fields
FROM f FULL JOIN c ON f.key = c.key WHERE NOT (coalesce(amended, false) AND k IS NULL)""")
def _(spark, sf):
    _, b = deliveries(spark, sf)
    k = F.col("key")
    changes = b.select(
        "key", F.when(k % 4 == 0, "New feature").when(k % 4 == 1, "Amended (new baseline)").otherwise("Correction").alias("kind"),
        (k % 3).alias("n_fields"), (k % 5 == 0).alias("same"), F.col("since").alias("from"),
    )
    cmp_ = _compare(spark, sf).select("key", "kind", F.coalesce(F.size("fields"), F.lit(0)).alias("n_fields"))
    cmp_ = cmp_.withColumn("n_fields", F.when(F.col("kind") == "modified", F.col("n_fields")).otherwise(0))
    return D.cycle_changes(changes, cmp_, "1998-02-26", "1998-03-26", ["key"])


@FAMILY.add("job_09_amendment_report", f"""WITH {COMPARE_SQL},
lines AS (SELECT {SECTION_SQL} AS section, CASE WHEN old IS NULL THEN 'INSERT' WHEN new IS NULL THEN 'DELETE' ELSE 'AMEND' END AS action FROM fields
          UNION ALL SELECT {SECTION_SQL}, CASE WHEN kind = 'added' THEN 'NEW' ELSE 'WITHDRAWN' END FROM cmp WHERE kind IN ('added', 'removed'))
SELECT section, count(*) FILTER (action = 'INSERT') AS n_insert, count(*) FILTER (action = 'AMEND') AS n_amend, count(*) FILTER (action = 'DELETE') AS n_delete,
  count(*) FILTER (action = 'NEW') AS n_new, count(*) FILTER (action = 'WITHDRAWN') AS n_withdrawn, DATE '2002-01-24' AS effective, DATE '2001-12-13' AS published FROM lines GROUP BY 1""")
def _(spark, sf):
    result = _compare(spark, sf).withColumn("section", section())
    fields = D.compare_fields(result, ["key", "section"])
    return D.amendment_report(fields, result.filter(F.col("kind").isin("added", "removed")), "2002-01-24")


def _changes(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").cast("timestamp").alias("from"),
        (F.col("o_orderstatus") == "P").alias("temporary"), F.col("o_custkey").alias("ad_id"),
    )
    return o.withColumn("section", section())


CHANGES_SQL = f"""ch AS (SELECT *, {SECTION_SQL} AS section FROM (SELECT o_orderkey AS key, o_orderpriority AS priority, CAST(o_orderdate AS TIMESTAMP) AS since, o_orderstatus = 'P' AS temporary, o_custkey AS ad_id FROM orders))"""
CYCLE_NO = "CAST(floor((epoch_ms(since) - 1706140800000) / 2419200000.0) AS BIGINT)"
CYCLE_LABEL = (
    "lpad(CAST(year(start) % 100 AS VARCHAR), 2, '0') || lpad(CAST(no - CAST(ceil((epoch_ms(make_date(year(start), 1, 1)::TIMESTAMP) - 1706140800000) / 2419200000.0) AS BIGINT) + 1 AS VARCHAR), 2, '0')"
)


@FAMILY.add("agg_06_cycle_counts", f"""WITH {CHANGES_SQL}, c AS (SELECT *, {CYCLE_NO} AS no FROM ch),
cal AS (SELECT unnest(generate_series(min(no), max(no))) AS no FROM c),
n AS (SELECT no, count(*) AS n, count(*) FILTER (section LIKE 'GEN%') AS n_gen, count(*) FILTER (section LIKE 'ENR%') AS n_enr, count(*) FILTER (section LIKE 'AD%') AS n_ad,
        count(*) FILTER (section = 'X') AS n_other, count(*) FILTER (temporary) AS n_temporary, count(*) FILTER (NOT temporary) AS n_permanent FROM c GROUP BY 1),
d AS (SELECT cal.no, DATE '2024-01-25' + CAST(cal.no * 28 AS INTEGER) AS start, n.* EXCLUDE (no) FROM cal LEFT JOIN n USING (no))
SELECT {CYCLE_LABEL} AS cycle, start, coalesce(n, 0) AS n, coalesce(n_gen, 0) AS n_gen, coalesce(n_enr, 0) AS n_enr, coalesce(n_ad, 0) AS n_ad, coalesce(n_other, 0) AS n_other,
  coalesce(n_temporary, 0) AS n_temporary, coalesce(n_permanent, 0) AS n_permanent FROM d""")
def _(spark, sf):
    return D.cycle_counts(_changes(spark, sf))


@FAMILY.add("agg_07_section_counts", f"""WITH {CHANGES_SQL}
SELECT 'section' AS level, section AS name, count(*) AS n FROM ch GROUP BY 2 UNION ALL SELECT 'aerodrome', CAST(ad_id AS VARCHAR), count(*) FROM ch GROUP BY 2
UNION ALL SELECT 'group', substr(section, 1, 3), count(*) FROM ch GROUP BY 2""")
def _(spark, sf):
    return D.section_counts(_changes(spark, sf))


@FAMILY.add("fun_08_airac_cycle", f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, CAST(l_shipdate AS TIMESTAMP) + to_hours(CAST(l_linenumber * 5 % 24 AS BIGINT)) AS at_ts FROM lineitem),
m AS (SELECT *, epoch_ms(at_ts) AS ms, ((1706140800000 - epoch_ms(at_ts)) % 2419200000 + 2419200000) % 2419200000 AS ahead FROM t),
c AS (SELECT *, CAST(floor(((CASE WHEN ahead > 0 AND ahead <= 50400000 THEN ms + ahead ELSE ms END) - 1706140800000) / 2419200000.0) AS BIGINT) AS no,
        (CASE WHEN ahead > 0 AND ahead <= 50400000 THEN ms + ahead ELSE ms END - 1706140800000) % 2419200000 = 0 AS exact FROM m),
d AS (SELECT no, exact, DATE '2024-01-25' + CAST(no * 28 AS INTEGER) AS start FROM c)
SELECT {CYCLE_LABEL} AS cycle, start, count(*) AS n, count(*) FILTER (exact) AS n_exact FROM d GROUP BY ALL""")
def _(spark, sf):
    at = F.timestamp_millis(F.unix_millis(F.col("l_shipdate").cast("timestamp")) + (F.col("l_linenumber") * 5 % 24).cast("long") * 3600000)
    li = table(spark, sf, "lineitem").select(at.alias("at"))
    return li.groupBy(C.cycle_id("at").alias("cycle"), C.cycle_start("at").cast("date").alias("start")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(C.cycle_exact("at")).alias("n_exact")
    )


@FAMILY.add("prj_25_filter_changes", """SELECT event_id, event_type AS kind, ts AS "from" FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-15' AND lower(props) LIKE '%"k"%' AND lower(props) LIKE '%7%'""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"), F.col("ts").alias("from"), F.col("props").alias("text"))
    return D.filter_changes(e, "error", "future", "2024-01-15", ['"k"', "7"]).drop("text")


def _issues(spark, sf):
    li = table(spark, sf, "lineitem")
    sev = F.when(F.col("l_discount") > 0.08, "error").when(F.col("l_tax") > 0.06, "warning").otherwise("info")
    return li.select(sev.alias("severity"), F.concat_ws("/", "l_returnflag", "l_linestatus").alias("rule"))


ISSUES_SQL = "i AS (SELECT CASE WHEN l_discount > 0.08 THEN 'error' WHEN l_tax > 0.06 THEN 'warning' ELSE 'info' END AS severity, l_returnflag || '/' || l_linestatus AS rule FROM lineitem)"


@FAMILY.add("agg_09_issue_summary", f"WITH {ISSUES_SQL} SELECT severity, rule, count(*) AS n FROM i GROUP BY ROLLUP (severity, rule)")
def _(spark, sf):
    return D.issue_summary(_issues(spark, sf))


@FAMILY.add("srt_01_worst_first", f"WITH {ISSUES_SQL} SELECT severity, rule, count(*) AS n FROM i GROUP BY severity, rule")
def _(spark, sf):
    return D.worst_first(_issues(spark, sf).groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n")))
