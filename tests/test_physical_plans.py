"""Physical-plan properties that matter at scale."""

import contextlib
import io
import os

import pytest

import __spark_entry__ as entry
from tablescope.operators import outliers, stats

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def plan(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.mark.parametrize("key", sorted(entry.queries()))
def test_no_cartesian_or_nested_loop_join(spark, key):
    p = plan(entry.queries()[key](spark, SF), "simple")
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_iqr_filter_reaches_parquet_scan(spark):
    ev = entry.load(spark, SF, "events")
    _, _, _, lo, hi = outliers.iqr_fences(ev, "value")
    p = plan(ev.where(outliers.iqr_predicate("value", lo, hi)).select("event_id"))
    assert "PushedFilters: [Or(LessThan(value," in p


def test_top_k_is_take_ordered(spark):
    p = plan(stats.value_counts(entry.load(spark, SF, "orders"), "o_orderpriority"), "simple")
    assert "TakeOrderedAndProject(limit=20" in p


def test_trend_reads_only_two_columns(spark):
    p = plan(entry.queries()["trend_month"](spark, SF))
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in p


def test_grouped_stats_aggregate_map_side(spark):
    p = plan(entry.queries()["group_sum"](spark, SF), "simple")
    assert "partial_sum" in p
