"""the grid of moments is made once, and its rows are not moved."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.plans import schedule as H


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _entries(spark):
    none = lambda c: F.lit(None).cast("string").alias(c)
    k = F.col("id")
    return spark.range(12).select(
        (k % 3).alias("feature_id"), k.alias("entry_no"), F.when(k % 4 == 0, "CLOSED").otherwise("ACTIVE").alias("status"), none("nil_reason"), F.lit(True).alias("has_times"), none("excluded"),
        F.lit(25.0).alias("lon"), F.lit(52.0).alias("lat"), F.lit("UTC+2").alias("time_ref"), F.lit("NO").alias("dst"), F.lit("ANY").alias("day"), none("day_til"), none("start_date"), none("end_date"),
        F.format_string("%02d:00", (k * 5 % 24).cast("int")).alias("start_time"), F.format_string("%02d:00", (k * 11 % 24).cast("int")).alias("end_time"), none("start_event"), none("end_event"),
        F.lit(0).alias("start_rel"), F.lit(0).alias("end_rel"), none("start_interp"), none("end_interp"),
    )


def test_grid_of_moments_is_made_once_and_not_moved(spark):
    e = _entries(spark)
    dealt = H.state_at(H.time_grid(e, "2026-10-07 00:00:00", "2026-10-08 23:00:00", 60, by=["feature_id", "entry_no"]), ["feature_id", "at"], F.col("at"))
    plain = H.state_at(e.withColumn("at", F.explode(F.sequence(F.lit("2026-10-07 00:00:00").cast("timestamp"), F.lit("2026-10-08 23:00:00").cast("timestamp"), F.expr("INTERVAL 60 MINUTES")))), ["feature_id", "at"], F.col("at"))
    assert sorted(dealt.collect()) == sorted(plain.collect()) and dealt.count() == 3 * 48
    for out in (H.state_intervals(dealt, ["feature_id"]), H.next_change(dealt, ["feature_id"])):
        assert "Generate" not in plan(out)
