"""words of a text and of its limits are cut once, with the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolith.functions.limits import limit_in_text_m, limit_in_text_reference
from aerolith.functions.words import words
from aerolith.sources import notam as N


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_a_limit_are_cut_once(spark):
    t = spark.createDataFrame([("FL150",), ("3,000FT AMSL",), ("GND",), ("",), (None,), ("450 M AGL.",)], "t string")
    both = t.select(limit_in_text_m("t").alias("m"), limit_in_text_reference("t").alias("r"))
    assert [(None if r.m is None else round(r.m, 6), r.r) for r in both.collect()] == [(4572.0, "STD"), (0.9144, "MSL"), (0.0, "SFC"), (None, None), (None, None), (450.0, "SFC")]
    cuts = plan(t.select(limit_in_text_m("t"))).count("regexp_extract_all")
    assert cuts == 1


def test_words_keep_inner_points_and_drop_closing_ones(spark):
    t = spark.createDataFrame([("Rwy09/27 CLSD... 1,500FT a..b ... RWY 09 / 27.",)], "t string")
    assert t.select(words("t")).first()[0] == ["RWY", "09/27", "CLSD", "1.500", "FT", "A..B", "RWY", "09/27"]


def test_items_of_a_notam_in_order_and_out_of_order(spark):
    t = spark.createDataFrame([("A0001/26 NOTAMN\nQ) EAAD A) EADD B) 26 E) see A) and  B) there F) GND G) FL100)  ",)], "t string")
    assert t.select(N.items(F.col("t"))).first()[0] == ["EAAD", "EADD", "26", "", "", "see A) and  B) there", "GND", "FL100)"]
