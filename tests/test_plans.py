"""Plan-shape guards: pushdown reaches the scan, no cross/nested-loop joins, shift joins shuffle."""

import pytest

from conftest import SF_SMALL

import __spark_entry__ as E  # noqa: E402

SKIP = ("stream_", "gbt_", "oof_", "baseline_", "feature_importance", "slice_stats")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(k for k in E.queries() if not k.startswith(SKIP)))
def test_no_cartesian_plans(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_scan_pushdown(spark):
    df = E.queries()["scan_panel_range"](spark, SF_SMALL)
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(date_id), GreaterThanOrEqual(date_id,10), LessThanOrEqual(date_id,20)]" in plan
    assert "feature_01" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_shift_join_is_shuffled(spark, small_panel):
    from tidepanel.operators import features as FE
    plan = _plan(FE.responder_lag(small_panel))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
