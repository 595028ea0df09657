"""A few queries of every family next to their SQL on the smallest tables; tests/oracle.py runs them all."""

import pytest

import __spark_entry__ as entry
from tests import oracle

SF = "/root/testdata/sf0.001"
NAMES = [
    "win_01_order_slices", "jon_12_resolve_values", "win_02_field_changes", "jon_14_compare_fields", "jon_01_resolve_refs", "jon_24_chain_segments", "jon_06_nearest", "jon_08_point_in_polygon",
    "jon_29_terrain_at", "win_06_shadow_rule", "agg_06_cycle_counts", "udf_01_rule_kinds", "job_06_obstacle_compliance", "fun_12_day_match",
]


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    status, note, _ = oracle.compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert status in ("OK", "EMPTY"), note


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_state_is_idempotent_and_order_free(spark):
    from aerolith.operators.slices import dedupe_slices, resolve_at
    from aerolith.queries.tables import event_slices

    s = event_slices(spark, SF)
    a = resolve_at(s, "2024-01-20 00:00:00").values
    b = resolve_at(s.orderBy("slice_no", ascending=False), "2024-01-20 00:00:00").values
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    once = dedupe_slices(s)
    assert dedupe_slices(once).count() == once.count()


def test_compare_with_itself_is_empty(spark):
    from aerolith.operators.diff import compare
    from aerolith.queries.tables import deliveries, with_props

    a, _ = deliveries(spark, SF)
    p = with_props(a, ["status", "cents"], ["key"])
    assert compare(p, p, ["key"]).filter("kind <> 'unchanged'").isEmpty()
