from pyspark.sql import functions as F

from aerolith.operators.slices import in_file_changes


def test_initial_load_is_flagged_not_dropped(spark):
    rows = spark.range(40).select(
        F.lit("d").alias("dataset_id"), F.col("id").alias("feature_id"), F.lit("BASELINE").alias("interp"), F.lit(1).alias("seq"), F.lit(0).alias("corr"),
        F.when(F.col("id") < 38, F.lit("2024-01-25")).otherwise(F.lit("2024-02-22")).cast("timestamp").alias("valid_begin"), F.lit(None).cast("timestamp").alias("valid_end"),
        F.lit(None).cast("timestamp").alias("life_begin"), F.lit(None).cast("timestamp").alias("life_end"), F.lit(1).alias("file_no"), F.col("id").alias("slice_no"),
        F.create_map(F.lit("a"), F.lit("b")).alias("props"),
    )
    got = in_file_changes(rows).groupBy("kind", "initial_load").count().collect()
    assert {(r.kind, r.initial_load): r["count"] for r in got} == {("Amended (new baseline)", True): 38, ("Amended (new baseline)", False): 2}
