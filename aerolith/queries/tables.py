"""The driver tables, and the fixed projections that make slices, positions and deliveries of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


# ---------------------------------------------------------------- slices from events

SLICES_SQL = """
raw_events AS (
  SELECT user_id AS feature_id, event_id AS slice_no, event_type,
         CASE event_type WHEN 'signup' THEN 'BASELINE' WHEN 'view' THEN 'SNAPSHOT' WHEN 'error' THEN 'TEMPDELTA'
              ELSE 'PERMDELTA' END AS interp,
         CAST((event_id * 7) % 11 AS INTEGER) AS seq, CAST(event_id % 3 AS INTEGER) AS corr,
         date_trunc('day', ts) AS valid_begin,
         CASE WHEN event_type = 'error' THEN date_trunc('day', ts) + INTERVAL 1 DAY
              WHEN event_id % 5 = 0 THEN date_trunc('day', ts) + INTERVAL 4 DAY END AS valid_end,
         CASE WHEN event_id % 50 = 0 THEN date_trunc('day', ts) + INTERVAL 9 DAY END AS life_end,
         CAST(CAST(round(value * 10) AS BIGINT) % 40 AS VARCHAR) AS v_value,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 AS VARCHAR) AS v_k
  FROM events),
slices AS (
  SELECT *, CASE WHEN event_type IN ('signup', 'click', 'error') THEN v_value END AS p_value,
            CASE WHEN event_type IN ('signup', 'view', 'purchase') THEN v_k END AS p_k
  FROM raw_events),
slice_props AS (
  SELECT feature_id, slice_no, interp, seq, corr, valid_begin, valid_end, 'value' AS prop, p_value AS value
  FROM slices WHERE p_value IS NOT NULL
  UNION ALL
  SELECT feature_id, slice_no, interp, seq, corr, valid_begin, valid_end, 'k' AS prop, p_k FROM slices WHERE p_k IS NOT NULL)
"""


def event_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a time slice of its user: signups and views are full slices, clicks and purchases deltas."""
    e = table(spark, sf, "events")
    day = F.date_trunc("day", "ts")
    v = (F.round(F.col("value") * 10).cast("long") % 40).cast("string")
    k = (F.get_json_object("props", "$.k").cast("int") % 20).cast("string")
    kind = F.col("event_type")
    props = F.map_filter(
        F.create_map(
            F.lit("value"), F.when(kind.isin("signup", "click", "error"), v),
            F.lit("k"), F.when(kind.isin("signup", "view", "purchase"), k),
        ),
        lambda _, x: x.isNotNull(),
    )
    return e.select(
        F.lit("events").alias("dataset_id"), F.col("user_id").alias("feature_id"), kind.alias("feature_type"),
        F.when(kind == "signup", "BASELINE").when(kind == "view", "SNAPSHOT").when(kind == "error", "TEMPDELTA")
        .otherwise("PERMDELTA").alias("interp"),
        ((F.col("event_id") * 7) % 11).cast("int").alias("seq"), (F.col("event_id") % 3).cast("int").alias("corr"),
        day.alias("valid_begin"),
        F.when(kind == "error", day + F.expr("INTERVAL 1 DAY")).when(F.col("event_id") % 5 == 0, day + F.expr("INTERVAL 4 DAY")).alias("valid_end"),
        F.lit(None).cast("timestamp").alias("life_begin"),
        F.when(F.col("event_id") % 50 == 0, day + F.expr("INTERVAL 9 DAY")).alias("life_end"),
        F.lit(1).alias("file_no"), F.col("event_id").alias("slice_no"), props.alias("props"),
    )


# ---------------------------------------------------------------- positions from keys

def position(key: str, shift: int = 0, spread: int = 1):
    """Deterministic lon / lat of a key; a larger spread packs the points into a smaller region."""
    k = F.col(key) + shift
    lon = (k * 37 % 36000) / (100.0 * spread)
    lat = (k * 53 % 16000) / (100.0 * spread)
    return lon - 180.0 / spread, lat - 80.0 / spread


def position_sql(key: str, shift: int = 0, spread: int = 1) -> tuple[str, str]:
    k = f"({key} + {shift})"
    return (
        f"(({k} * 37 % 36000) / {100.0 * spread} - {180.0 / spread})",
        f"(({k} * 53 % 16000) / {100.0 * spread} - {80.0 / spread})",
    )


def sql_distance(lon1: str, lat1: str, lon2: str, lat2: str, radius: float = 3440.065) -> str:
    return (
        f"(2 * {radius} * asin(least(1.0, sqrt(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
        f"cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2)))))"
    )


def sql_bearing(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return (
        f"((degrees(atan2(sin(radians({lon2} - {lon1})) * cos(radians({lat2})), cos(radians({lat1})) * sin(radians({lat2})) "
        f"- sin(radians({lat1})) * cos(radians({lat2})) * cos(radians({lon2} - {lon1})))) + 360.0) % 360.0)"
    )


# ---------------------------------------------------------------- two deliveries from orders

DELIVERIES_SQL = """
delivery_a AS (
  SELECT o_orderkey AS key, o_orderstatus AS status, o_orderpriority AS priority,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderdate AS since, o_custkey AS owner
  FROM orders WHERE o_orderkey % 13 <> 0),
delivery_b AS (
  SELECT o_orderkey AS key, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END AS status,
         o_orderpriority AS priority,
         CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 7 = 0 THEN 100 ELSE 0 END AS cents,
         o_orderdate AS since, o_custkey AS owner
  FROM orders WHERE o_orderkey % 11 <> 0)
"""


def deliveries(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All orders as two deliveries: rows missing on either side, prices and states changed on the second."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        cents("o_totalprice").alias("cents"), F.col("o_orderdate").cast("timestamp").alias("since"), F.col("o_custkey").alias("owner"),
    )
    a = o.filter(F.col("key") % 13 != 0)
    b = (
        o.filter(F.col("key") % 11 != 0)
        .withColumn("status", F.when(F.col("key") % 17 != 0, F.col("status")))
        .withColumn("cents", F.col("cents") + F.when(F.col("key") % 7 == 0, 100).otherwise(0))
    )
    return a, b


def with_props(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """The columns as a MAP of property to text, nulls left out."""
    pairs = [x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]
    return df.select(*keep, F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("props"))
