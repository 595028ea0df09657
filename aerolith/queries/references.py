"""JON-01..05/24/25/34, AGG-22, SET-01/03/04/05, WIN-04, SNK-09 on lineitem -> orders -> customer -> nation -> region."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import refs as R
from ..operators.ordered import number_repeats
from . import Family
from .tables import table

FAMILY = Family()

GRAPH_SQL = """
features AS (
  SELECT 'O' || o_orderkey AS feature_id, 'Order' AS feature_type, NULL AS gml_id, o_orderstatus = 'P' AS gone FROM orders
  UNION ALL SELECT 'S' || s_suppkey, 'Supplier', 's' || s_suppkey, s_acctbal < 0 FROM supplier),
refs AS (
  SELECT 'L' || l_orderkey || '-' || l_linenumber AS src_id, 'Line' AS src_type, 'order' AS prop, 'O' || l_orderkey AS ref FROM lineitem
  UNION ALL SELECT 'L' || l_orderkey || '-' || l_linenumber, 'Line', 'supplier', '#s' || (l_suppkey + CASE WHEN l_linenumber = 7 THEN 1000000 ELSE 0 END) FROM lineitem)
"""


def _graph(spark, sf):
    o, s, li = (table(spark, sf, t) for t in ("orders", "supplier", "lineitem"))
    text = F.lit(None).cast("string")
    ds = F.lit("d").alias("dataset_id")
    features = o.select(ds, F.concat(F.lit("O"), "o_orderkey").alias("feature_id"), F.lit("Order").alias("feature_type"), text.alias("gml_id"), (F.col("o_orderstatus") == "P").alias("gone")).unionByName(
        s.select(ds, F.concat(F.lit("S"), "s_suppkey").alias("feature_id"), F.lit("Supplier").alias("feature_type"), F.concat(F.lit("s"), "s_suppkey").alias("gml_id"), (F.col("s_acctbal") < 0).alias("gone"))
    )
    src = F.concat(F.lit("L"), "l_orderkey", F.lit("-"), "l_linenumber").alias("src_id")
    lost = F.when(F.col("l_linenumber") == 7, 1000000).otherwise(0)
    refs = li.select(ds, src, F.lit("Line").alias("src_type"), F.lit("order").alias("prop"), F.concat(F.lit("O"), "l_orderkey").alias("ref")).unionByName(
        li.select(ds, src, F.lit("Line").alias("src_type"), F.lit("supplier").alias("prop"), F.concat(F.lit("#s"), F.col("l_suppkey") + lost).alias("ref"))
    )
    return features, refs


@FAMILY.add("jon_01_resolve_refs", f"""WITH {GRAPH_SQL}, alive AS (SELECT * FROM features WHERE NOT gone)
SELECT prop, coalesce(a.feature_id, b.feature_id) AS target_id, count(*) AS n
FROM refs LEFT JOIN alive a ON a.feature_id = ref LEFT JOIN alive b ON '#' || b.gml_id = ref GROUP BY ALL""")
def _(spark, sf):
    features, refs = _graph(spark, sf)
    return R.resolve_refs(refs, features).groupBy("prop", "target_id").agg(F.count(F.lit(1)).alias("n"))


@FAMILY.add("jon_02_reverse_refs", f"""WITH {GRAPH_SQL}
SELECT feature_id AS target_id, count(*) AS n_users FROM refs JOIN features ON '#' || gml_id = ref WHERE NOT gone AND prop = 'supplier' GROUP BY 1""")
def _(spark, sf):
    features, refs = _graph(spark, sf)
    rev = R.reverse_refs(R.resolve_refs(refs, features), "Line", "supplier")
    return rev.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_users"))


@FAMILY.add("jon_03_unresolved_refs", f"""WITH {GRAPH_SQL},
lost AS (SELECT * FROM refs WHERE ref NOT IN (SELECT feature_id FROM features) AND ref NOT IN (SELECT '#' || gml_id FROM features WHERE gml_id IS NOT NULL)),
few AS (SELECT src_type, prop, src_id, row_number() OVER (PARTITION BY src_type, prop ORDER BY src_id) AS rn FROM (SELECT DISTINCT src_type, prop, src_id FROM lost))
SELECT c.src_type, c.prop, c.n, f.examples, 'warning' AS severity FROM (SELECT src_type, prop, count(*) AS n FROM lost GROUP BY ALL) c
JOIN (SELECT src_type, prop, string_agg(src_id, ', ' ORDER BY src_id) AS examples FROM few WHERE rn <= 5 GROUP BY ALL) f USING (src_type, prop)""")
def _(spark, sf):
    features, refs = _graph(spark, sf)
    return R.unresolved_refs(refs, features)


@FAMILY.add("jon_04_peer_lookup", """WITH lost AS (SELECT DISTINCT l_partkey AS ref FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)),
peers AS (SELECT 'big' AS dataset_id, 2 AS dataset_order, p_partkey AS feature_id FROM part WHERE p_retailprice > 950
          UNION ALL SELECT 'cheap', 1, p_partkey FROM part WHERE p_retailprice < 1000)
SELECT ref, arg_min(dataset_id, dataset_order) AS found_in FROM lost JOIN peers ON feature_id = ref GROUP BY 1""")
def _(spark, sf):
    p = table(spark, sf, "part")
    lost = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("ref")).distinct().join(
        p.filter("p_size > 25").select(F.col("p_partkey").alias("ref")), "ref", "left_anti"
    )
    peer = lambda cond, name, n: p.filter(cond).select(F.lit(name).alias("dataset_id"), F.lit(n).alias("dataset_order"), F.col("p_partkey").alias("feature_id"))
    return R.peer_lookup(lost, peer("p_retailprice > 950", "big", 2).unionByName(peer("p_retailprice < 1000", "cheap", 1)))


@FAMILY.add("agg_22_cross_dataset_refs", """WITH ids AS (SELECT DISTINCT 'lines' || (l_linenumber % 3) AS dataset_id, l_partkey AS ref FROM lineitem),
n AS (SELECT dataset_id, count(*) AS n_ids FROM ids GROUP BY 1),
parts AS (SELECT 'brand' || (p_size % 4) AS other_id, p_partkey AS ref FROM part)
SELECT dataset_id, other_id, n_found, n_ids FROM (SELECT dataset_id, other_id, count(*) AS n_found FROM ids JOIN parts USING (ref) GROUP BY ALL) JOIN n USING (dataset_id)
WHERE n_found >= 3 AND n_found >= 0.2 * n_ids""")
def _(spark, sf):
    lost = table(spark, sf, "lineitem").select(F.concat(F.lit("lines"), F.col("l_linenumber") % 3).alias("dataset_id"), F.col("l_partkey").alias("ref"))
    feats = table(spark, sf, "part").select(F.concat(F.lit("brand"), F.col("p_size") % 4).alias("dataset_id"), F.col("p_partkey").alias("feature_id"))
    # every id is looked up: the sample is the reference's own short cut, not needed for a join
    return R.cross_dataset_refs(lost, feats)


@FAMILY.add("jon_05_owner_aerodrome", """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'N' || c_nationkey END AS ad FROM customer),
s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN 'N' || s_nationkey END AS ad FROM supplier),
o AS (SELECT o_orderkey, ad FROM orders LEFT JOIN c ON c_custkey = o_custkey),
l AS (SELECT l_orderkey, l_suppkey, coalesce(o.ad, s.ad) AS ad FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) LEFT JOIN o ON o_orderkey = l_orderkey LEFT JOIN s USING (l_suppkey))
SELECT 'C' || c_custkey AS feature_id, ad AS ad_id, 'direct' AS via FROM c WHERE ad IS NOT NULL
UNION ALL SELECT 'S' || s_suppkey, ad, 'direct' FROM s WHERE ad IS NOT NULL
UNION ALL SELECT 'O' || o_orderkey, ad, 'component' FROM o WHERE ad IS NOT NULL
UNION ALL SELECT 'L' || l_orderkey || '-' || l_suppkey, ad, 'component' FROM l WHERE ad IS NOT NULL""".replace("LEFT JOIN s USING (l_suppkey)", "LEFT JOIN s ON s_suppkey = l_suppkey"))
def _(spark, sf):
    c, s, o, li, n = (table(spark, sf, t) for t in ("customer", "supplier", "orders", "lineitem", "nation"))
    pairs = li.select("l_orderkey", "l_suppkey").distinct()
    line = F.concat(F.lit("L"), "l_orderkey", F.lit("-"), "l_suppkey")
    kind = lambda df, id_, t: df.select(id_.alias("feature_id"), F.lit(t).alias("feature_type"), F.lit(None).cast("string").alias("subtype"))
    key = lambda p, k: F.concat(F.lit(p), k)
    features = (
        kind(n, key("N", "n_nationkey"), "AirportHeliport").unionByName(kind(c, key("C", "c_custkey"), "Apron"))
        .unionByName(kind(s, key("S", "s_suppkey"), "Runway")).unionByName(kind(o, key("O", "o_orderkey"), "AircraftStand"))
        .unionByName(kind(pairs, line, "RunwayDirection"))
    )
    edge = lambda df, a, ta, prop, no, b, tb: df.select(
        a.alias("src_id"), F.lit(ta).alias("src_type"), F.lit(prop).alias("prop"), F.lit(no).alias("ref_no"), b.alias("target_id"), F.lit(tb).alias("target_type")
    )
    edges = (
        edge(c.filter("c_custkey % 3 <> 0"), key("C", "c_custkey"), "Apron", "airport", 1, key("N", "c_nationkey"), "AirportHeliport")
        .unionByName(edge(s.filter("s_suppkey % 4 <> 0"), key("S", "s_suppkey"), "Runway", "airport", 1, key("N", "s_nationkey"), "AirportHeliport"))
        .unionByName(edge(o, key("O", "o_orderkey"), "AircraftStand", "apron", 1, key("C", "o_custkey"), "Apron"))
        .unionByName(edge(pairs, line, "RunwayDirection", "stand", 1, key("O", "l_orderkey"), "AircraftStand"))
        .unionByName(edge(pairs, line, "RunwayDirection", "runway", 2, key("S", "l_suppkey"), "Runway"))
    )
    return R.ownership(features, edges)


@FAMILY.add("jon_25_closure", """WITH s AS (SELECT 'O' || o_orderkey AS feature_id, o_custkey FROM orders WHERE o_orderstatus = 'F'),
c AS (SELECT 'C' || c_custkey AS feature_id, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM s)),
n AS (SELECT 'N' || n_nationkey AS feature_id, n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c))
SELECT feature_id, 0 AS depth FROM s UNION ALL SELECT feature_id, 1 FROM c UNION ALL SELECT feature_id, 2 FROM n
UNION ALL SELECT DISTINCT 'R' || n_regionkey, 3 FROM n""")
def _(spark, sf):
    c, o, n = (table(spark, sf, t) for t in ("customer", "orders", "nation"))
    key = lambda p, k, a: F.concat(F.lit(p), k).alias(a)
    edges = (
        o.select(key("O", "o_orderkey", "src_id"), key("C", "o_custkey", "target_id"))
        .unionByName(c.select(key("C", "c_custkey", "src_id"), key("N", "c_nationkey", "target_id")))
        .unionByName(n.select(key("N", "n_nationkey", "src_id"), key("R", "n_regionkey", "target_id")))
    )
    seeds = o.filter("o_orderstatus = 'F'").select(key("O", "o_orderkey", "feature_id"))
    return R.closure(seeds, edges).select("feature_id", "depth")


@FAMILY.add("jon_24_chain_segments", """SELECT o_custkey AS route, o_orderkey AS seg,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS chain_no,
  first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS head FROM orders""")
def _(spark, sf):
    from ..operators.ordered import OrderedScan

    o = table(spark, sf, "orders")
    seg = OrderedScan(["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], F.date_trunc("month", "o_orderdate")).previous(o, before=F.col("o_orderkey"))
    seg = seg.select(F.col("o_custkey").alias("route"), F.col("o_orderkey").alias("seg"), F.coalesce("before", F.lit(-1)).alias("a"), F.col("o_orderkey").alias("b"))
    return R.chain_segments(seg, ["route"], "a", "b", ["seg"]).select("route", "seg", "chain_no", "head")


@FAMILY.add("jon_34_harmonize_states", """WITH d AS (SELECT c_custkey AS id, substr(c_name, 1, 16) AS prefix, c_mktsegment AS state,
   CASE WHEN c_custkey % 10 = 0 THEN 'strong' WHEN c_custkey % 10 < 4 THEN 'code' ELSE 'weak' END AS strength FROM customer),
best AS (SELECT w.id, arg_min(s.state, s.id) AS st FROM d w JOIN d s ON s.prefix = w.prefix AND s.id <> w.id AND s.state <> w.state AND s.strength IN ('strong', 'code')
         AND (w.strength = 'weak' OR s.strength = 'strong') WHERE w.strength <> 'strong' GROUP BY 1)
SELECT d.id AS dataset_id, coalesce(st, state) AS state, state AS state_detected FROM d LEFT JOIN best USING (id)""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    d = c.select(
        k.alias("dataset_id"), k.alias("dataset_order"), F.substring("c_name", 1, 16).alias("prefix"), F.col("c_mktsegment").alias("state"),
        F.when(k % 10 == 0, "strong").when(k % 10 < 4, "code").otherwise("weak").alias("strength"),
    )
    return R.harmonize_states(d).select("dataset_id", "state", "state_detected")


@FAMILY.add("set_01_union_datasets", """SELECT 'c' AS part, c_nationkey AS nation, count(*) AS n, count(c_mktsegment) AS n_segment, count(NULL) AS n_supp FROM customer GROUP BY 2
UNION ALL SELECT 's', s_nationkey, count(*), 0, count(s_name) FROM supplier GROUP BY 2""")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("c").alias("part"), F.col("c_nationkey").alias("nation"), "c_mktsegment")
    s = table(spark, sf, "supplier").select(F.lit("s").alias("part"), F.col("s_nationkey").alias("nation"), "s_name")
    return R.union_datasets([c, s]).groupBy("part", "nation").agg(
        F.count(F.lit(1)).alias("n"), F.count("c_mktsegment").alias("n_segment"), F.count("s_name").alias("n_supp")
    )


@FAMILY.add("set_03_allocation", "SELECT p_type AS feature_type, count(*) AS n FROM part WHERE p_type NOT IN (SELECT p_type FROM part GROUP BY 1 HAVING avg(p_size) > 25) GROUP BY 1")
def _(spark, sf):
    p = table(spark, sf, "part").withColumnRenamed("p_type", "feature_type")
    return R.allocation(p, p.groupBy("feature_type").agg(F.avg("p_size").alias("a")).filter("a > 25").select("feature_type"))


@FAMILY.add("set_04_type_except", "SELECT DISTINCT p_brand AS feature_type FROM part WHERE p_type = 'ECONOMY' EXCEPT SELECT p_brand FROM part WHERE p_size = 50")
def _(spark, sf):
    p = table(spark, sf, "part").withColumnRenamed("p_brand", "feature_type")
    return R.type_except(p.filter("p_type = 'ECONOMY'"), p.filter("p_size = 50"))


@FAMILY.add("set_05_upsert_daily", """WITH old AS (SELECT o_orderdate AS day, CAST(count(*) AS BIGINT) AS n, CAST(round(sum(o_totalprice) * 100) AS BIGINT) AS cents FROM orders WHERE o_orderdate < DATE '1999-01-01' GROUP BY 1),
new AS (SELECT o_orderdate AS day, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) % 2 = 0 THEN CAST(count(DISTINCT o_custkey) AS BIGINT) END AS users FROM orders WHERE o_orderdate >= DATE '1998-01-01' GROUP BY 1)
SELECT coalesce(new.day, old.day) AS day, coalesce(new.n, old.n) AS n, cents, users FROM old FULL JOIN new ON old.day = new.day""")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderdate", "day")
    old = o.filter("day < DATE '1999-01-01'").groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice") * 100).cast("long").alias("cents"))
    new = o.filter("day >= DATE '1998-01-01'").groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("_u"))
    new = new.select("day", "n", F.when(F.col("n") % 2 == 0, F.col("_u")).alias("users"))
    return R.upsert(old, new, ["day"])


@FAMILY.add("win_04_suffix_repeats", """WITH k AS (SELECT p_partkey, p_name || '|' || p_brand AS key, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS n FROM part)
SELECT p_partkey, CASE WHEN n > 1 THEN key || '~' || n ELSE key END AS unique_key FROM k""")
def _(spark, sf):
    p = table(spark, sf, "part").withColumn("key", F.concat_ws("|", "p_name", "p_brand"))
    return number_repeats(p, "key", ["p_partkey"], "unique_key", F.floor(F.col("p_partkey") / 100000)).select("p_partkey", "unique_key")


@FAMILY.add("snk_09_merge_states", """WITH p AS (SELECT c_custkey AS id, 1 AS part_no FROM customer UNION ALL SELECT s_suppkey, 2 FROM supplier UNION ALL SELECT p_partkey, 3 FROM part),
f AS (SELECT id, min(part_no) AS first FROM p GROUP BY 1)
SELECT id::VARCHAR AS gml_id, part_no, CASE WHEN part_no > first THEN id || '_p' || part_no ELSE id::VARCHAR END AS output_id FROM p JOIN f USING (id)""")
def _(spark, sf):
    part = lambda t, k, n: table(spark, sf, t).select(F.col(k).cast("string").alias("gml_id"), F.lit(n).alias("part_no"))
    return R.merge_states(R.union_datasets([part("customer", "c_custkey", 1), part("supplier", "s_suppkey", 2), part("part", "p_partkey", 3)]))
