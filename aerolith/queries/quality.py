"""JOB-03/06/07, UDF-01/02, PRJ-01/02/08/09/14, AGG-04/05/08/10/11/19/20, SRT-02/03, JON-09, JOB-25, FUN-07/18 on parts, customers, lines, documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coords, ident
from ..operators import checks as K
from ..operators import flatten as FL
from . import Family
from .assessment import OX, OY, obstacles
from .tables import position, position_sql, sql_distance, table

FAMILY = Family()


def _rules(spark):
    rows = [
        ("R1", "mand", "Part", "brand", None, None, None, None, None), ("R2", "cmand", "Part", "size", "brand", None, None, None, None),
        ("R3", "forbidval", "Thing", "type", None, ["ECONOMY", "PROMO"], None, None, None), ("R4", "max", "Part", "price", None, None, ["USD"], 1000.0, None),
        ("R5", "unique", "Part", "label", None, None, None, None, None), ("R6", "allowed", "Part", "size", "type", ["1", "2", "3", "4", "5"], ["SMALL"], None, None),
        ("R7", "decimals", "Part", "price", None, None, None, 0.0, None), ("R8", "absent", "Ghost", None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "rule_id string, kind string, class string, p string, q string, v array<string>, u array<string>, n double, to_class string")


def _rule_inputs(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    objects = p.select(k.alias("object_id"), k.alias("feature_id"), F.lit("Part").alias("class"), F.lit("BASELINE").alias("interp"))
    val = lambda path, v, uom=None: p.select(k.alias("object_id"), F.lit(path).alias("path"), v.cast("string").alias("value"), F.lit(uom).cast("string").alias("uom"), F.lit(None).cast("string").alias("target_class"), F.lit(False).alias("nil")).filter(F.col("value").isNotNull())
    values = (
        val("brand", F.when(k % 10 != 0, F.col("p_brand"))).unionByName(val("size", F.when(k % 7 != 0, F.col("p_size")))).unionByName(val("type", F.col("p_type")))
        .unionByName(val("price", F.floor("p_retailprice"), "USD")).unionByName(val("label", F.concat_ws("|", "p_name", "p_brand", F.col("p_size").cast("string"))))
    )
    tree = spark.createDataFrame([("Part", "Part"), ("Part", "Thing"), ("Ghost", "Ghost")], "class string, is_a string")
    return objects, values, _rules(spark), tree


RULES_SQL = """p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 <> 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS size, p_type AS type, floor(p_retailprice) AS price,
  p_name || '|' || p_brand || '|' || p_size AS label FROM part),
f AS (SELECT 'R1' AS rule_id, id AS feature_id, 'mand brand' AS message FROM p WHERE brand IS NULL UNION ALL SELECT 'R2', id, 'cmand size' FROM p WHERE brand IS NOT NULL AND size IS NULL
  UNION ALL SELECT 'R3', id, 'forbidval type' FROM p WHERE type IN ('ECONOMY', 'PROMO') UNION ALL SELECT 'R4', id, 'max price' FROM p WHERE price > 1000
  UNION ALL SELECT 'R5', id, 'unique label' FROM p WHERE label IN (SELECT label FROM p GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'R6', id, 'allowed size' FROM p WHERE type = 'SMALL' AND size > 5)"""


@FAMILY.add("udf_01_rule_kinds", f"WITH {RULES_SQL} SELECT rule_id, feature_id, message, CAST(1 AS BIGINT) AS n FROM f")
def _(spark, sf):
    table(spark, sf, "part")
    return K.run_rules(*_rule_inputs(spark, sf))


@FAMILY.add("job_03_business_rules", f"""WITH {RULES_SQL}, r(rule_id, kind, ok) AS (VALUES ('R1','mand',1),('R2','cmand',1),('R3','forbidval',1),('R4','max',1),('R5','unique',1),('R6','allowed',1),('R7','decimals',1),('R8','absent',0))
SELECT r.rule_id, kind, CASE WHEN ok = 1 THEN (SELECT count(*) FROM p) ELSE 0 END AS n_objects, count(f.feature_id) AS n_failures, count(DISTINCT f.feature_id) AS n_features,
  CASE WHEN ok = 0 THEN 'not applicable' WHEN count(f.feature_id) > 0 THEN 'failed' ELSE 'passed' END AS state FROM r LEFT JOIN f USING (rule_id) GROUP BY r.rule_id, kind, ok""")
def _(spark, sf):
    table(spark, sf, "part")
    objects, values, rules, tree = _rule_inputs(spark, sf)
    return K.rules_summary(rules, K.run_rules(objects, values, rules, tree), objects, tree)


@FAMILY.add("prj_01_flatten", """SELECT o_orderkey AS key, unnest(['status', 'money/total', 'money/custom', 'tags[1]', 'tags[2]']) AS path,
  unnest([o_orderstatus, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) || ' CENT', '→' || o_custkey, least(o_orderpriority, o_orderstatus), greatest(o_orderpriority, o_orderstatus)]) AS value FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    tree = F.to_json(F.struct(
        F.col("o_orderstatus").alias("status"), F.lit("x").alias("_t"),
        F.struct(F.struct(F.round(F.col("o_totalprice") * 100).cast("long").cast("string").alias("v"), F.lit("CENT").alias("u")).alias("total"), F.struct(F.col("o_custkey").cast("string").alias("ref")).alias("custom")).alias("money"),
        F.array("o_orderpriority", "o_orderstatus").alias("tags"),
    ))
    return FL.flatten(o.select(F.col("o_orderkey").alias("key"), tree.alias("tree")), "tree", ["key"])


@FAMILY.add("prj_02_fingerprint", "SELECT o_orderkey AS key, md5('priority=' || o_orderpriority || chr(10) || 'status=' || o_orderstatus) AS fingerprint FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders")
    m = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("key"), FL.fingerprint(m).alias("fingerprint"))


@FAMILY.add("agg_04_completeness", """WITH c AS (SELECT c_mktsegment AS feature_type, c_custkey, c_custkey % 5 AS s, c_custkey % 3 AS t FROM customer),
v AS (SELECT feature_type, 'balance' AS prop, CASE WHEN s = 0 THEN 'x' WHEN s = 1 THEN 'u' WHEN s = 2 THEN 'a' ELSE 'g' END AS st FROM c UNION ALL SELECT feature_type, 'name', CASE WHEN t = 0 THEN 'a' ELSE 'g' END FROM c)
SELECT feature_type, prop, count(*) AS n_features, count(*) FILTER (st = 'g') AS n_given, count(*) FILTER (st = 'u') AS n_unknown, count(*) FILTER (st = 'x') AS n_not_applicable, count(*) FILTER (st = 'a') AS n_absent FROM v GROUP BY ALL""")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("feature_type"), F.col("c_custkey").alias("feature_id"))
    k = F.col("feature_id")
    val = lambda prop, keep, nil, na: c.filter(keep).select("feature_type", "feature_id", F.lit(prop).alias("prop"), F.when(nil, "unknown").alias("nil_reason"), na.alias("not_applicable"))
    values = val("balance", k % 5 != 2, k % 5 == 1, k % 5 == 0).unionByName(val("name", k % 3 != 0, F.lit(False), F.lit(False)))
    dim = c.select("feature_type").distinct().select("feature_type", F.explode(F.array(F.lit("balance"), F.lit("name"))).alias("prop"))
    out = FL.completeness(c, values, dim, ["feature_id"])
    return out.select("feature_type", "prop", "n_features", "n_given", "n_unknown", "n_not_applicable", "n_absent")


OROWS_SQL = f"""o AS (SELECT p_partkey AS obstacle_id, CASE WHEN p_partkey % 50 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 12 <> 0 THEN p_type END AS type, {OX} AS lon, {OY} AS lat,
  CASE WHEN p_partkey % 14 <> 0 THEN CAST(p_size * 8 AS DOUBLE) END AS elev_m, CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_size * 3 AS DOUBLE) END AS hgt_m, CASE p_partkey % 4 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' END AS lighted,
  CASE WHEN p_partkey % 8 <> 0 THEN CAST(p_partkey % 11 AS DOUBLE) END AS acc, CASE p_partkey % 3 WHEN 0 THEN '2a' WHEN 1 THEN '1' ELSE '4' END AS area, p_partkey % 37 AS dist FROM part)"""


def obstacle_rows(spark, sf):
    k = F.col("p_partkey")
    lon, lat = position("p_partkey", 3, 200)
    acc = F.when(k % 8 != 0, (k % 11).cast("double"))
    return table(spark, sf, "part").select(
        k.alias("obstacle_id"), F.when(k % 50 != 0, F.col("p_name")).alias("name"), F.lit("").alias("ident"), F.when(k % 12 != 0, F.col("p_type")).alias("type"), lon.alias("lon"), lat.alias("lat"),
        F.when(k % 14 != 0, F.col("p_size") * 8.0).alias("elev_m"), F.when(k % 9 != 0, F.col("p_size") * 3.0).alias("hgt_m"), F.when(k % 4 == 0, "YES").when(k % 4 == 1, "NO").alias("lighted"),
        F.lit("YES").alias("marked"), F.lit("EGM_96").alias("v_datum"), acc.alias("h_acc_m"), acc.alias("v_acc_m"), F.when(k % 3 == 0, "2a").when(k % 3 == 1, "1").otherwise("4").alias("area"),
        F.lit(None).cast("timestamp").alias("valid_to"), F.when(k % 100 == 1, 2.0).alias("pen_m"), F.lit(None).cast("string").alias("path_severity"), (k % 37).cast("double").alias("distance_nm"),
    )


@FAMILY.add("job_06_obstacle_compliance", f"""WITH {OROWS_SQL}, f AS (
  SELECT 'error' AS severity, 'Identifier' AS chk FROM o WHERE name IS NULL UNION ALL SELECT 'warning', 'Type' FROM o WHERE type IS NULL UNION ALL SELECT 'error', 'Elevation' FROM o WHERE elev_m IS NULL
  UNION ALL SELECT 'warning', 'Height' FROM o WHERE hgt_m IS NULL UNION ALL SELECT 'warning', 'Lighting' FROM o WHERE lighted IS NULL
  UNION ALL SELECT 'warning', 'Horizontal accuracy' FROM o WHERE acc IS NULL UNION ALL SELECT 'error', 'Horizontal accuracy' FROM o WHERE acc > CASE area WHEN '2a' THEN 5 WHEN '1' THEN 50 ELSE 2.5 END
  UNION ALL SELECT 'warning', 'Vertical accuracy' FROM o WHERE acc IS NULL UNION ALL SELECT 'error', 'Vertical accuracy' FROM o WHERE acc > CASE area WHEN '2a' THEN 3 WHEN '1' THEN 30 ELSE 1 END
  UNION ALL SELECT 'error', 'Annex 14 surfaces' FROM o WHERE obstacle_id % 100 = 1
  UNION ALL SELECT 'warning', 'Duplicate' FROM o WHERE EXISTS (SELECT 1 FROM o b WHERE b.obstacle_id < o.obstacle_id AND round(b.lon, 5) = round(o.lon, 5) AND round(b.lat, 5) = round(o.lat, 5)))
SELECT severity, chk AS "check", count(*) AS n FROM f GROUP BY ALL""")
def _(spark, sf):
    return K.obstacle_compliance(obstacle_rows(spark, sf), "2026-01-01").groupBy("severity", "check").agg(F.count(F.lit(1)).alias("n"))


@FAMILY.add("agg_08_obstacle_stats", f"""WITH {OROWS_SQL}, c AS (SELECT coalesce(type, '') AS t, CASE WHEN hgt_m >= 300 THEN '300.0' WHEN hgt_m >= 150 THEN '150.0' WHEN hgt_m >= 100 THEN '100.0' WHEN hgt_m >= 45 THEN '45.0' WHEN hgt_m >= 30 THEN '30.0'
  WHEN hgt_m >= 15 THEN '15.0' WHEN hgt_m >= 0 THEN '0.0' END AS h, CASE WHEN dist >= 25 THEN '25.0' WHEN dist >= 10 THEN '10.0' WHEN dist >= 5 THEN '5.0' WHEN dist >= 2 THEN '2.0' WHEN dist >= 1 THEN '1.0' ELSE '0.0' END AS d FROM o)
SELECT 'type' AS grouping, t AS name, count(*) AS n FROM c GROUP BY 2 UNION ALL SELECT 'height', h, count(*) FROM c GROUP BY 2 UNION ALL SELECT 'distance', d, count(*) FROM c GROUP BY 2""")
def _(spark, sf):
    return K.obstacle_stats(obstacle_rows(spark, sf))


@FAMILY.add("prj_08_filter_obstacles", f"WITH {OROWS_SQL} SELECT obstacle_id, elev_m FROM o WHERE lower(concat_ws(' ', obstacle_id, name, type)) LIKE '%ring%' AND coalesce(lighted, '') = 'YES' AND hgt_m >= 30")
def _(spark, sf):
    return K.filter_obstacles(obstacle_rows(spark, sf), "ring", lit="YES", min_height=30.0).select("obstacle_id", "elev_m")


@FAMILY.add("srt_02_top_k", f"WITH {OROWS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY elev_m DESC NULLS LAST, obstacle_id) AS rn FROM o) SELECT obstacle_id, area, elev_m FROM r WHERE rn <= 15")
def _(spark, sf):
    rows = obstacle_rows(spark, sf).select("obstacle_id", "area", "elev_m")
    return K.top_k(rows, [F.col("elev_m").desc_nulls_last(), F.col("obstacle_id")], 15, ["area"])


@FAMILY.add("srt_03_natural_sort", "SELECT p_brand, row_number() OVER (ORDER BY CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER)) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def _(spark, sf):
    from pyspark.sql import Window

    b = K.natural_sort(table(spark, sf, "part").select("p_brand").distinct(), "p_brand")
    # a numbering of the few distinct brands, only to show the order
    return b.select("p_brand", F.row_number().over(Window.orderBy(ident.natural_sort_key("p_brand"))).cast("long").alias("place"))


# coded types and words behind the part's own name; which kind comes of them is the SQL's own reading of the text
_TYPES = ["TOWER", "POLE", "BUILDING", "OTHER:CHIMNEYS", "ANTENNA", "", "WATER_TOWER", "OTHER"]
_WORDS = ["radar tower", "light pole", "hangar", "crane", "", "wind turbines", "ATC twr"]


@FAMILY.add("prj_14_obstacle_kind", f"""WITH p AS (SELECT p_partkey, {_TYPES}[p_size % 8 + 1] AS t, upper(p_name || ' ' || {_WORDS}[p_partkey % 7 + 1]) AS n FROM part),
k AS (SELECT *, CASE WHEN n LIKE '%RADAR TOWER%' THEN 'radar' WHEN n LIKE '%LIGHT POLE%' THEN 'lamp' WHEN n LIKE '%WIND TURBINES%' THEN 'windmill' WHEN n LIKE '%ATC TWR%' THEN 'ctower' WHEN n LIKE '%HANGAR%' THEN 'hangar' WHEN n LIKE '%CRANE%' THEN 'crane' END AS named FROM p)
SELECT p_partkey, CASE WHEN t IN ('', 'OTHER') THEN coalesce(named, 'other') WHEN t = 'OTHER:CHIMNEYS' THEN 'stack' WHEN t = 'WATER_TOWER' THEN 'watertower'
  WHEN t = 'TOWER' AND named IN ('radar', 'lamp', 'ctower') OR t = 'POLE' AND named = 'lamp' OR t = 'BUILDING' AND named IN ('hangar', 'ctower') OR t = 'ANTENNA' AND named IN ('radar', 'lamp') THEN named ELSE lower(t) END AS kind FROM k""")
def _(spark, sf):
    pick = lambda texts, at: F.get(F.array(*[F.lit(x) for x in texts]), at.cast("int"))
    p = table(spark, sf, "part").select("p_partkey", pick(_TYPES, F.col("p_size") % 8).alias("type"), F.concat_ws(" ", "p_name", pick(_WORDS, F.col("p_partkey") % 7)).alias("name"))
    return p.select("p_partkey", K.obstacle_kind("type", "name").alias("kind"))


@FAMILY.add("prj_09_search", """SELECT p_partkey, p_name FROM (SELECT *, CASE WHEN starts_with(lower(p_name), 'blue') THEN 0 ELSE 2 END + CASE WHEN p_size > 25 THEN 0 ELSE 1 END AS score FROM part
  WHERE lower(p_name || ' ' || p_brand) LIKE '%blue%' AND lower(p_name || ' ' || p_brand) LIKE '%brand#1%') ORDER BY score, p_partkey""")
def _(spark, sf):
    return K.search(table(spark, sf, "part"), "blue brand#1", ["p_name", "p_brand"], "p_partkey", F.col("p_size") > 25).select("p_partkey", "p_name")


DX, DY = position_sql("l_partkey", 1, 300)


@FAMILY.add("agg_20_duplicate_codes", "SELECT c_custkey, c_mktsegment || ' ' || c_nationkey AS code, n FROM customer JOIN (SELECT c_mktsegment AS s, c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) > 1) d ON s = c_mktsegment AND k = c_nationkey")
def _(spark, sf):
    c = table(spark, sf, "customer").withColumn("code", F.concat_ws(" ", "c_mktsegment", "c_nationkey"))
    return K.duplicate_codes(c, "c_custkey", "code")


@FAMILY.add("agg_20_designator_spread", f"""WITH t AS (SELECT DISTINCT s_nationkey AS designator, {DX.replace('l_partkey', 's_suppkey')} AS lon, {DY.replace('l_partkey', 's_suppkey')} AS lat FROM supplier),
n AS (SELECT s_nationkey AS designator, count(*) AS n FROM supplier GROUP BY 1)
SELECT a.designator, any_value(n.n) AS n, round(max({sql_distance('a.lon', 'a.lat', 'b.lon', 'b.lat')}), 5) AS span_nm FROM t a JOIN t b USING (designator) JOIN n USING (designator) GROUP BY 1 HAVING max({sql_distance('a.lon', 'a.lat', 'b.lon', 'b.lat')}) >= 1""")
def _(spark, sf):
    lon, lat = position("s_suppkey", 1, 300)
    pts = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("designator"), lon.alias("lon"), lat.alias("lat"))
    return K.designator_spread(pts).withColumn("span_nm", F.round("span_nm", 5))


@FAMILY.add("job_07_integrity_items")
def _(spark, sf):
    o = obstacles(spark, sf)
    k = F.col("obstacle_id")
    items = o.select(
        F.lit("VerticalStructure").alias("feature_type"), k.alias("feature_id"), F.concat(F.lit("OBS "), k).alias("label"), F.lit("Obstacle").alias("item"),
        F.when(k % 2 == 0, "OBS2").otherwise("OBS1").alias("item_key"), "lon", "lat", "elev_m", F.when(k % 5 != 0, (k % 9).cast("double")).alias("h_acc_m"), (k % 4).cast("double").alias("v_acc_m"),
    )
    return K.integrity_items(items).select("feature_id", "text", "crc", "status")


# bit by bit: eight shifts for each byte value, then one look-up for each character
@FAMILY.add("fun_14_crc32q", """WITH t AS (SELECT list(crc ORDER BY b) AS tab FROM (SELECT b, list_reduce([CAST(b AS BIGINT) << 24] || [0, 1, 2, 3, 4, 5, 6, 7],
  lambda c, x: CASE WHEN c >= 2147483648 THEN xor((c << 1) & 4294967295, 2168537515) ELSE c << 1 END) AS crc FROM range(256) r(b)))
SELECT c_custkey, printf('%08X', list_reduce([CAST(0 AS BIGINT)] || list_transform(range(1, length(c_name) + 1), lambda i: CAST(ord(substr(c_name, i, 1)) AS BIGINT)),
  lambda c, x: xor((c << 8) & 4294967295, tab[xor(c >> 24, x) + 1]))) AS crc FROM customer CROSS JOIN t""")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", ident.crc32q("c_name").alias("crc"))


@FAMILY.add("fun_07_format_dms", f"""WITH t AS (SELECT p_partkey, {OX} AS lon, {OY} AS lat FROM part), r AS (SELECT p_partkey, lat, CAST(round(abs(lat) * 360000) AS BIGINT) AS c FROM t)
SELECT p_partkey, lpad(CAST(c // 360000 AS VARCHAR), 2, '0') || lpad(CAST(c // 6000 % 60 AS VARCHAR), 2, '0') || lpad(CAST(c // 100 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || CASE WHEN lat < 0 THEN 'S' ELSE 'N' END AS dms,
  round(CASE WHEN lat < 0 THEN -1 ELSE 1 END * c / 360000.0, 8) AS back FROM r""")
def _(spark, sf):
    lon, lat = position("p_partkey", 3, 200)
    t = table(spark, sf, "part").select("p_partkey", coords.format_dms(lat, True, 2).alias("dms"))
    return t.withColumn("back", F.round(coords.coordinate("dms", True), 8))


@FAMILY.add("fun_18_uuid_for", """SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || CASE strpos('0123456789abcdef', substr(h, 17, 1)) % 4 WHEN 1 THEN '8' WHEN 2 THEN '9' WHEN 3 THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
FROM (SELECT p_partkey, sha1('part|' || p_partkey) AS h FROM part)""")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", ident.uuid_for(F.concat(F.lit("part|"), "p_partkey")).alias("id"))


FIT_SQL = """f AS (SELECT p_type AS type, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS DOUBLE) / 10 END AS acc, CASE p_partkey % 6 WHEN 1 THEN 'S' WHEN 2 THEN 'A' WHEN 3 THEN 'O' WHEN 4 THEN 'C' WHEN 5 THEN 'T' ELSE 'D' END AS src,
  CASE p_type WHEN 'ECONOMY' THEN 1.0::DOUBLE WHEN 'PROMO' THEN 2.0::DOUBLE WHEN 'SMALL' THEN 0.5::DOUBLE END AS req FROM part),
s AS (SELECT type, CASE WHEN req IS NULL THEN 'n/a' WHEN acc > 0 THEN CASE WHEN acc <= req + 1e-9 THEN 'meets' ELSE 'not met' END WHEN src = 'S' THEN 'not met' WHEN src IN ('A', 'C') THEN 'state' ELSE 'unknown' END AS status FROM f)"""


def _fit(spark, sf):
    k = F.col("p_partkey")
    src = F.when(k % 6 == 1, "Inferred x").when(k % 6 == 2, "Generated from AIP data").when(k % 6 == 3, "OpenStreetMap").when(k % 6 == 4, "From the State's charts").when(k % 6 == 5, "Digitised by the user").otherwise("")
    f = table(spark, sf, "part").select(F.col("p_type").alias("type"), F.when(k % 4 == 0, F.col("p_size").cast("double") / 10).alias("h_acc_m"), src.alias("source"))
    dim = spark.createDataFrame([("ECONOMY", 1.0), ("PROMO", 5.0), ("SMALL", 0.5)], "type string, acc_m double")
    own = spark.createDataFrame([("PROMO", 2.0)], "type string, acc_m double")
    f = K.with_requirement(f.withColumn("src", K.source_class("source")), dim, own)
    return f.withColumn("status", K.fitness_status("h_acc_m", "required_m", "src"))


@FAMILY.add("agg_10_fitness", f"""WITH {FIT_SQL} SELECT type, count(*) AS n, count(*) FILTER (status = 'meets') AS n_meets, count(*) FILTER (status = 'state') AS n_state, count(*) FILTER (status = 'unknown') AS n_unknown,
  count(*) FILTER (status = 'not met') AS n_not_met, count(*) FILTER (status = 'n/a') AS n_no_requirement, count(*) FILTER (status IN ('not met', 'unknown')) > 0 AS survey FROM s GROUP BY 1""")
def _(spark, sf):
    return K.fitness(_fit(spark, sf))


@FAMILY.add("udf_02_requirement_overrides", f"WITH {FIT_SQL} SELECT type, req AS required_m, count(*) AS n FROM f GROUP BY ALL")
def _(spark, sf):
    return _fit(spark, sf).groupBy("type", "required_m").agg(F.count(F.lit(1)).alias("n"))


@FAMILY.add("job_25_sources_quality", f"WITH {FIT_SQL} SELECT src, type, count(*) AS n FROM f GROUP BY ALL")
def _(spark, sf):
    return _fit(spark, sf).groupBy("src", "type").agg(F.count(F.lit(1)).alias("n"))


@FAMILY.add("agg_11_accuracy_stats", """WITH m AS (SELECT l_returnflag AS type, CASE WHEN l_quantity > 2 THEN l_quantity / 10 END AS d FROM lineitem)
SELECT type, count(d) AS n, count(*) FILTER (d IS NULL) AS n_missed, round(avg(d), 6) AS mean, round(sqrt(avg(d * d)), 6) AS rms, quantile_disc(d, 0.95) AS p95, max(d) AS max, round(count(*) FILTER (d <= 2.5) / count(d), 6) AS within FROM m GROUP BY 1""")
def _(spark, sf):
    m = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("type"), F.when(F.col("l_quantity") > 2, F.col("l_quantity") / 10).alias("d"), F.lit(2.5).alias("required_m"))
    r = lambda c: F.round(c, 6).alias(c)
    return K.accuracy_stats(m, ["type"]).select("type", "n", "n_missed", r("mean"), r("rms"), "p95", "max", r("within"))


@FAMILY.add("agg_05_content_check", """WITH g AS (SELECT DISTINCT p_brand AS grp FROM part), h AS (SELECT l_suppkey AS ad_id, count(DISTINCT p_brand) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT ad_id, round(n / (SELECT count(*) FROM g), 6) AS share, n / (SELECT count(*) FROM g) >= 0.94 AS usable FROM h""")
def _(spark, sf):
    groups = table(spark, sf, "part").select(F.col("p_brand").alias("group"), F.col("p_partkey").alias("type"))
    feats = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("ad_id"), F.col("l_partkey").alias("type"))
    return K.content_check(feats, groups).select("ad_id", F.round("share", 6).alias("share"), "usable")


@FAMILY.add("agg_19_readiness", """WITH i AS (SELECT l_suppkey AS ad_id, l_linenumber AS item, substr('ACTOS', CAST(1 + l_quantity % 5 AS INTEGER), 1) AS source, CAST(1 + l_quantity % 5 AS INTEGER) AS r, CAST(l_partkey % 3 AS DOUBLE) / 2 AS state FROM lineitem),
b AS (SELECT ad_id, item, min(CASE WHEN state > 0 THEN r * 10 + state END) AS k FROM i GROUP BY ALL)
SELECT ad_id, item, substr('ACTOS', CAST(floor(k / 10) AS INTEGER), 1) AS source, coalesce(k % 10, 0)::DOUBLE AS state FROM b""")
def _(spark, sf):
    n = (F.col("l_quantity") % 5).cast("int")
    i = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("ad_id"), F.col("l_linenumber").alias("item"), F.substring(F.lit("ACTOS"), n + 1, F.lit(1)).alias("source"), ((F.col("l_partkey") % 3) / 2.0).alias("state"))
    return K.readiness(i).select("ad_id", "item", "source", "state")


@FAMILY.add("jon_09_obstacle_area", """WITH h AS (SELECT l_partkey AS id, substr('1234', 1 + l_linenumber % 4, 1) AS area, l_discount > 0.05 AS own FROM lineitem),
b AS (SELECT id, arg_min(area, CASE area WHEN '1' THEN 50 WHEN '2' THEN 5 WHEN '3' THEN 0.5 ELSE 2.5 END) FILTER (own) AS o, arg_min(area, CASE area WHEN '1' THEN 50 WHEN '2' THEN 5 WHEN '3' THEN 0.5 ELSE 2.5 END) FILTER (NOT own) AS x FROM h GROUP BY 1)
SELECT p_partkey AS obstacle_id, coalesce(CASE WHEN p_partkey % 6 = 0 THEN '2a' END, o, CASE WHEN p_partkey % 2 = 0 THEN '1' END, x) AS area FROM part LEFT JOIN b ON id = p_partkey""")
def _(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(k.alias("obstacle_id"), F.when(k % 6 == 0, "2a").alias("area"), F.when(k % 2 == 0, "1").alias("declared"))
    hits = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("obstacle_id"), F.substring(F.lit("1234"), (1 + F.col("l_linenumber") % 4).cast("int"), F.lit(1)).alias("area"), (F.col("l_discount") > 0.05).alias("own"))
    return K.obstacle_area(rows, hits).select("obstacle_id", "area")
