"""Nested composite keys: customers as runways of aerodromes, orders as records that refer to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.links45 import link_45
from . import Family
from .tables import table

FAMILY = Family()


def _inputs(spark, sf):
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    ahp = s.select(text("A", F.col("s_suppkey")).alias("feature_id"), F.lit("Ahp").alias("tag"), F.to_json(F.struct(text("S", F.col("s_suppkey")).alias("codeId"), F.lit("7").alias("_mid"))).alias("uid"))
    held = lambda nation: F.struct(text("S", F.col(nation)).alias("codeId"))
    k = F.col("c_custkey")
    rwy = c.select(
        text("R", k).alias("feature_id"), F.lit("Rwy").alias("tag"),
        F.to_json(F.struct(held("c_nationkey").alias("AhpUid"), (k % 50).cast("string").alias("txtDesig"), k.cast("string").alias("valLen"))).alias("uid"),
    )
    o = table(spark, sf, "orders").join(c.select(k.alias("o_custkey"), "c_nationkey"), "o_custkey").withColumn("x", F.col("o_orderkey") % 5)
    ck = F.col("o_custkey")
    uid = (
        F.when(F.col("x") == 0, F.to_json(F.struct(ck.cast("string").alias("valLen"), held("c_nationkey").alias("AhpUid"), (ck % 50).cast("string").alias("txtDesig"), F.lit("3").alias("mid"))))
        .when(F.col("x") == 1, F.to_json(F.struct((ck % 50).cast("string").alias("txtDesig"), held("c_nationkey").alias("AhpUid"))))
        .when(F.col("x") == 2, F.to_json(F.struct(text("S", ck % 130).alias("codeId"))))
        .when(F.col("x") == 3, F.lit('{"mid": "9", "txtDesig": ""}'))
        .otherwise(F.to_json(F.struct(held("c_nationkey").alias("AhpUid"), ck.cast("string").alias("valLen"))))
    )
    refs = o.select(text("O", F.col("o_orderkey")).alias("src_id"), F.lit("usage").alias("role"), F.when(F.col("x") == 2, "Ahp").otherwise("Rwy").alias("tag"), uid.alias("uid"))
    return refs, ahp.unionByName(rwy)


BASE = """o AS (SELECT 'O' || o_orderkey AS src_id, o_orderkey % 5 AS x, o_custkey AS k, c_nationkey AS n FROM orders JOIN customer ON c_custkey = o_custkey),
d AS (SELECT c_nationkey AS n, c_custkey % 50 AS g, count(*) AS m, min('R' || c_custkey) AS f FROM customer GROUP BY 1, 2)"""


@FAMILY.add("src_03_link_45", f"""WITH {BASE} SELECT src_id, 'R' || k AS feature_id, CASE WHEN x = 0 THEN 'exact' ELSE 'subset' END AS match FROM o WHERE x IN (0, 4)
UNION ALL SELECT src_id, f, 'subset' FROM o JOIN d ON d.n = o.n AND d.g = o.k % 50 WHERE x = 1 AND m = 1 UNION ALL SELECT src_id, 'A' || s_suppkey, 'exact' FROM o JOIN supplier ON s_suppkey = k % 130 WHERE x = 2""")
def _(spark, sf):
    return link_45(*_inputs(spark, sf))[0].select("src_id", "feature_id", "match")


@FAMILY.add("src_03_link_problems", f"""WITH {BASE} SELECT src_id, 'ambiguous' AS problem, m AS n FROM o JOIN d ON d.n = o.n AND d.g = o.k % 50 WHERE x = 1 AND m > 1
UNION ALL SELECT src_id, 'unresolved', 0 FROM o WHERE x = 2 AND k % 130 NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT src_id, 'empty', 0 FROM o WHERE x = 3""")
def _(spark, sf):
    return link_45(*_inputs(spark, sf))[1].select("src_id", "problem", "n")
