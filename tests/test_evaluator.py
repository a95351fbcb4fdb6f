"""Evaluator summaries against the row-level predictions of each variant."""

import numpy as np
import pytest

from tidepanel.plans import evaluator as EV
from tidepanel.plans import walk_forward as WF

SPECS = [("full", 1), ("retrain", 3), ("refit", 2), ("online", 1)]


def test_summaries_equal_row_level_predictions(spark, small_panel):
    prep = WF.prepare(small_panel, WF.WalkForwardConfig(features=["feature_02", "feature_03"]))
    got = {(r["variant"], r["cadence"]): r for r in EV.summaries(small_panel, prep, SPECS).collect()}
    assert len(got) == len(SPECS)
    for v, k in SPECS:
        rows = WF.predictions(small_panel, prep, v, k).toPandas()
        r = got[v, 0 if v == "full" else k]
        assert r["n_rows"] == len(rows)
        for name, x in (("prediction", rows.prediction), ("target", rows.responder_6)):
            want = [x.mean(), np.std(x), x.min(), x.max()]
            assert [r[f"{name}_{m}"] for m in EV.MEASURES] == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_rows_are_read_once_and_not_shuffled(spark, small_panel):
    prep = WF.prepare(small_panel, WF.WalkForwardConfig(features=["feature_02"]))
    plan = EV.summaries(small_panel, prep, SPECS[:2])._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "SortMergeJoin" not in plan.split("BroadcastExchange")[0]
    with pytest.raises(ValueError):
        EV.summaries(small_panel, prep, [("retrain", 0)])
