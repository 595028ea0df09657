"""WIN-01/03/11, JON-12/13, WIN-02, AGG-03/16 on events read as time slices of their users."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import slices as S
from . import Family
from .tables import SLICES_SQL, event_slices, table

FAMILY = Family()
AT = "2024-01-20 00:00:00"

ORDERED = "ORDER BY valid_begin, seq, corr, slice_no"


@FAMILY.add("win_01_order_slices", f"WITH {SLICES_SQL} SELECT feature_id, slice_no, row_number() OVER (PARTITION BY feature_id {ORDERED}) AS slice_order FROM slices")
def _(spark, sf):
    return S.order_slices(event_slices(spark, sf)).select("feature_id", "slice_no", "slice_order")


@FAMILY.add("win_03_dedupe_slices", f"""WITH {SLICES_SQL}, ranked AS (
  SELECT feature_id, slice_no, interp, p_value, row_number() OVER (PARTITION BY feature_id, interp, seq, corr, valid_begin, valid_end ORDER BY slice_no) AS rn FROM slices)
SELECT feature_id, slice_no, interp, p_value FROM ranked WHERE rn = 1""")
def _(spark, sf):
    return S.dedupe_slices(event_slices(spark, sf)).select("feature_id", "slice_no", "interp", F.try_element_at("props", F.lit("value")).alias("p_value"))


STATE_SQL = f"""{SLICES_SQL},
counted AS (SELECT *, count(*) OVER (PARTITION BY feature_id) AS n FROM slices),
single AS (SELECT feature_id, slice_no FROM counted WHERE n = 1 AND interp <> 'TEMPDELTA'),
begun AS (SELECT *, row_number() OVER (PARTITION BY feature_id {ORDERED} ) AS rn FROM slices
          WHERE interp <> 'TEMPDELTA' AND valid_begin <= TIMESTAMP '{AT}' AND feature_id NOT IN (SELECT feature_id FROM single)),
chosen AS (SELECT feature_id, max(rn) AS rn_last, max(CASE WHEN interp <> 'PERMDELTA' THEN rn ELSE 0 END) AS rn_reset FROM begun GROUP BY 1),
later AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY CASE WHEN interp = 'TEMPDELTA' THEN 1 ELSE 0 END,
                 CASE WHEN interp = 'TEMPDELTA' THEN NULL ELSE valid_begin END, CASE WHEN interp = 'TEMPDELTA' THEN 0 ELSE seq END,
                 CASE WHEN interp = 'TEMPDELTA' THEN 0 ELSE corr END, slice_no) AS rn
          FROM slices WHERE feature_id NOT IN (SELECT feature_id FROM chosen)),
used AS (
  SELECT b.feature_id, b.slice_no, 0 AS layer, b.rn AS pos FROM begun b JOIN chosen c USING (feature_id) WHERE b.rn >= c.rn_reset
  UNION ALL
  SELECT s.feature_id, s.slice_no, 1 AS layer, s.slice_no AS pos FROM slices s JOIN chosen c USING (feature_id)
  WHERE s.interp = 'TEMPDELTA' AND s.valid_begin <= TIMESTAMP '{AT}' AND (s.valid_end IS NULL OR s.valid_end > TIMESTAMP '{AT}')
  UNION ALL
  SELECT feature_id, slice_no, 0, 1 FROM later WHERE rn = 1)"""


@FAMILY.add("jon_12_resolve_values", f"""WITH {STATE_SQL},
ranked AS (SELECT p.feature_id, p.prop, p.value, row_number() OVER (PARTITION BY p.feature_id, p.prop ORDER BY u.layer DESC, u.pos DESC) AS rn
           FROM slice_props p JOIN used u ON p.feature_id = u.feature_id AND p.slice_no = u.slice_no)
SELECT feature_id, prop, value FROM ranked WHERE rn = 1""")
def _(spark, sf):
    return S.resolve_at(event_slices(spark, sf), AT).values.select("feature_id", "prop", "value")


@FAMILY.add("jon_12_resolve_state", f"""WITH {STATE_SQL},
temps AS (SELECT feature_id, count(*) FILTER (layer = 1) AS n_temp FROM used GROUP BY 1),
picked AS (
  SELECT b.feature_id, b.interp, b.seq, b.corr, b.valid_begin, b.valid_end, false AS future,
         coalesce(b.valid_end <= TIMESTAMP '{AT}', false) AS ended FROM begun b JOIN chosen c ON b.feature_id = c.feature_id AND b.rn = c.rn_last
  UNION ALL
  SELECT feature_id, interp, seq, corr, valid_begin, valid_end, feature_id NOT IN (SELECT feature_id FROM single), false FROM later WHERE rn = 1)
SELECT p.feature_id, p.interp, p.seq, p.corr, p.valid_begin, p.future, p.ended, t.n_temp FROM picked p JOIN temps t USING (feature_id)""")
def _(spark, sf):
    return S.resolve_at(event_slices(spark, sf), AT).state.select(
        "feature_id", "interp", "seq", "corr", "valid_begin", "future", "ended", "n_temp"
    )


PERM_SQL = f"""{SLICES_SQL},
perm AS (SELECT *, row_number() OVER w AS nth, CAST(sum(CASE WHEN interp = 'PERMDELTA' THEN 0 ELSE 1 END) OVER w AS BIGINT) AS reset_no
         FROM slices WHERE interp <> 'TEMPDELTA' WINDOW w AS (PARTITION BY feature_id {ORDERED} ROWS UNBOUNDED PRECEDING)),
props(prop) AS (VALUES ('value'), ('k')),
cells AS (SELECT s.feature_id, s.slice_no, s.interp, s.nth, s.reset_no, p.prop, CASE p.prop WHEN 'value' THEN s.p_value ELSE s.p_k END AS value
          FROM perm s CROSS JOIN props p),
filled AS (SELECT *, last_value(value IGNORE NULLS) OVER (PARTITION BY feature_id, prop, reset_no ORDER BY nth ROWS UNBOUNDED PRECEDING) AS state FROM cells),
steps AS (SELECT *, lag(state) OVER (PARTITION BY feature_id, prop ORDER BY nth) AS old FROM filled),
perm_changes AS (SELECT feature_id, slice_no, prop, old, state AS new FROM steps
                 WHERE (nth > 1 OR interp = 'PERMDELTA') AND old IS DISTINCT FROM state)"""


@FAMILY.add("win_02_field_changes", f"WITH {PERM_SQL} SELECT feature_id, slice_no, prop, old, new FROM perm_changes")
def _(spark, sf):
    return S.permanent_field_changes(event_slices(spark, sf)).select("feature_id", "slice_no", "prop", "old", "new")


TEMP_SQL = f"""{PERM_SQL},
timeline AS (
  SELECT feature_id, prop, valid_begin_x AS at_ts, 0 AS kind, slice_no, NULL AS new, state, seq, corr FROM
    (SELECT f.*, s.valid_begin AS valid_begin_x, s.seq, s.corr FROM filled f JOIN slices s USING (feature_id, slice_no))
  UNION ALL
  SELECT feature_id, prop, valid_begin, 1, slice_no, value, NULL, seq, corr FROM slice_props WHERE interp = 'TEMPDELTA'),
marked AS (SELECT *, max(CASE WHEN kind = 0 THEN ord END) OVER (PARTITION BY feature_id, prop ORDER BY ord) AS base_ord FROM
           (SELECT *, row_number() OVER (PARTITION BY feature_id, prop ORDER BY at_ts, kind, seq, corr, slice_no) AS ord FROM timeline)),
temp_changes AS (SELECT m.feature_id, m.slice_no, m.prop, b.state AS old, m.new FROM marked m
                 LEFT JOIN marked b ON b.feature_id = m.feature_id AND b.prop = m.prop AND b.ord = m.base_ord WHERE m.kind = 1)"""


@FAMILY.add("jon_13_baseline_for_delta", f"WITH {TEMP_SQL} SELECT feature_id, slice_no, prop, old, new FROM temp_changes")
def _(spark, sf):
    return S.base_for_temporary(event_slices(spark, sf)).select("feature_id", "slice_no", "prop", "old", "new")


@FAMILY.add("win_02_in_file_changes", f"""WITH {TEMP_SQL},
nf AS (SELECT feature_id, slice_no, count(*) AS n FROM perm_changes GROUP BY ALL),
nt AS (SELECT feature_id, slice_no, count(*) AS n FROM temp_changes WHERE old IS DISTINCT FROM new GROUP BY ALL),
seqd AS (SELECT *, lag(seq) OVER w AS p_seq, lag(corr) OVER w AS p_corr, max(nth) OVER (PARTITION BY feature_id) AS n_last FROM perm
         WINDOW w AS (PARTITION BY feature_id ORDER BY nth)),
lasts AS (SELECT feature_id, max(valid_begin) AS b_last FROM perm GROUP BY 1)
SELECT s.feature_id, s.slice_no, CASE WHEN interp = 'PERMDELTA' THEN 'Permanent change (PERMDELTA)'
         WHEN p_seq = seq AND corr > p_corr THEN 'Correction' ELSE 'Permanent change (new BASELINE)' END AS kind,
       valid_begin AS "from", coalesce(nf.n, 0) AS n_fields, interp = 'BASELINE' AND nf.n IS NULL AS same
FROM seqd s LEFT JOIN nf USING (feature_id, slice_no) WHERE nth > 1 OR interp = 'PERMDELTA'
UNION ALL
SELECT s.feature_id, s.slice_no, 'Temporary change (TEMPDELTA)', valid_begin, coalesce(nt.n, 0), false
FROM slices s LEFT JOIN nt USING (feature_id, slice_no) WHERE interp = 'TEMPDELTA'
UNION ALL
SELECT feature_id, slice_no, 'Feature withdrawn (end of life)', life_end, 0, false FROM seqd WHERE nth = n_last AND life_end IS NOT NULL
UNION ALL
SELECT feature_id, slice_no, CASE WHEN false THEN 'New feature' ELSE 'Amended (new baseline)' END, valid_begin, 0, false
FROM slices WHERE interp = 'BASELINE' AND life_end IS NULL AND feature_id IN (SELECT feature_id FROM slices GROUP BY 1 HAVING count(*) = 1)
UNION ALL
SELECT feature_id, slice_no, 'Feature withdrawn (validity ended)', valid_end, 0, false FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY valid_end DESC, nth) AS pick FROM perm WHERE valid_end IS NOT NULL)
WHERE pick = 1 AND feature_id NOT IN (SELECT feature_id FROM slices WHERE life_end IS NOT NULL)
  AND feature_id IN (SELECT l.feature_id FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY nth DESC) AS rn FROM perm) l, (SELECT max(valid_begin) AS m FROM slices WHERE interp <> 'TEMPDELTA')
    WHERE rn = 1 AND l.valid_end <= m AND NOT EXISTS (SELECT 1 FROM slices s WHERE s.feature_id = l.feature_id AND s.interp <> 'TEMPDELTA' AND s.slice_no <> l.slice_no AND s.valid_begin >= l.valid_end AND s.valid_begin <= m))
""")
def _(spark, sf):
    return S.in_file_changes(event_slices(spark, sf)).select("feature_id", "slice_no", "kind", "from", "n_fields", "same")


@FAMILY.add("win_02_withdrawn", f"""WITH {SLICES_SQL},
moment AS (SELECT max(valid_begin) AS m FROM slices WHERE interp <> 'TEMPDELTA'),
last AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY CASE WHEN interp = 'TEMPDELTA' THEN 1 ELSE 0 END,
                valid_begin DESC, seq DESC, corr DESC, slice_no DESC) AS rn FROM slices)
SELECT l.feature_id, coalesce(l.life_end <= m, false) OR coalesce(l.valid_end <= m AND NOT EXISTS (
         SELECT 1 FROM slices s WHERE s.feature_id = l.feature_id AND s.interp <> 'TEMPDELTA' AND s.slice_no <> l.slice_no
           AND s.valid_begin >= l.valid_end AND s.valid_begin <= m), false) AS gone
FROM last l CROSS JOIN moment WHERE rn = 1 AND interp <> 'TEMPDELTA'""")
def _(spark, sf):
    sl = event_slices(spark, sf)
    has_perm = sl.filter(F.col("interp") != "TEMPDELTA").select("dataset_id", "feature_id").distinct()
    return S.withdrawn(sl).join(has_perm, ["dataset_id", "feature_id"], "left_semi").select("feature_id", "gone")


@FAMILY.add("win_11_baseline_overlaps", f"""WITH {SLICES_SQL},
b AS (SELECT *, coalesce(valid_end, TIMESTAMP '9999-12-31') AS e FROM slices WHERE interp = 'BASELINE'),
rep AS (SELECT feature_id, CAST(sum(n - 1) AS BIGINT) AS n_repeated FROM (SELECT feature_id, seq, corr, count(*) AS n FROM b GROUP BY ALL) GROUP BY 1),
ovl AS (SELECT feature_id, count(*) FILTER (valid_begin < m) AS n_overlapping FROM (
          SELECT feature_id, valid_begin, max(e) OVER (PARTITION BY feature_id {ORDERED} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM b) GROUP BY 1)
SELECT feature_id, n_repeated, n_overlapping FROM rep JOIN ovl USING (feature_id) WHERE n_repeated > 0 OR n_overlapping > 0""")
def _(spark, sf):
    return S.baseline_overlaps(event_slices(spark, sf)).select("feature_id", "n_repeated", "n_overlapping")


@FAMILY.add("agg_16_load_day", """WITH singles AS (SELECT l_orderkey, max(l_shipdate) AS d FROM lineitem GROUP BY 1 HAVING count(*) = 1),
days AS (SELECT make_date(1990 + 10 * ((year(d) - 1990) // 10), 1, 1) AS day, count(*) AS n FROM singles GROUP BY 1), t AS (SELECT CAST(sum(n) AS BIGINT) AS singles FROM days)
SELECT day, n, singles FROM days CROSS JOIN t WHERE n > greatest(30, singles * 0.3)""")
def _(spark, sf):
    sl = table(spark, sf, "lineitem").select(
        F.lit("lineitem").alias("dataset_id"), F.col("l_orderkey").alias("feature_id"), F.lit("BASELINE").alias("interp"),
        F.make_date(F.lit(1990) + 10 * F.floor((F.year("l_shipdate") - 1990) / 10).cast("int"), F.lit(1), F.lit(1)).cast("timestamp").alias("valid_begin"),
    )
    return S.load_days(sl).select("day", "n", "singles")


@FAMILY.add("agg_03_aerodrome_effective", f"""WITH {SLICES_SQL}
SELECT c_nationkey AS ad_id, max(valid_begin) AS effective FROM slices JOIN customer ON c_custkey = feature_id GROUP BY 1""")
def _(spark, sf):
    owner = table(spark, sf, "customer").select(F.col("c_custkey").alias("feature_id"), F.col("c_nationkey").alias("ad_id"), F.lit("events").alias("dataset_id"))
    return S.aerodrome_effective(event_slices(spark, sf), owner)
