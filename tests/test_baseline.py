"""Input lists, named subsets and the baseline run."""

import pytest
from pyspark.sql import functions as F

from tidepanel import columns as C
from tidepanel.operators import features as FE
from tidepanel.operators.splits import nested_split
from tidepanel.plans import baseline as BL
from tidepanel.plans import gbt as G


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame([], ", ".join(["date_id int", "time_id int", "symbol_id int", *[f"{f} double" for f in C.FEATURE_COLUMNS]]))


def test_inputs_come_in_fixed_order(wide):
    cols = FE.input_columns(wide, use_lags=True, use_market_avg=True, use_rolling=True)
    top = C.FEATURE_IMPORTANCE_RANKING[:12]
    assert cols[:81] == [*C.FEATURE_COLUMNS, "symbol_id", "time_id"] and cols[81:90] == C.LAG_COLUMNS
    assert cols[90:102] == [f"{f}_mkt" for f in top]
    assert cols[102:] == [c for f in top for c in (f"{f}_roll_mean", f"{f}_roll_std")]
    assert FE.input_columns(wide, symbol=False, time=False) == C.FEATURE_COLUMNS
    assert len(FE.input_columns(wide, use_market_avg=True, engineered="top24")) == 81 + 24


def test_named_subsets(wide, small_panel):
    assert FE.present_features(wide, "all") == C.FEATURE_IMPORTANCE_RANKING
    assert FE.present_features(wide, "top24") == C.FEATURE_IMPORTANCE_RANKING[:24]
    own = [f for f in C.FEATURE_IMPORTANCE_RANKING if f in small_panel.columns]
    assert FE.present_features(small_panel, "top12") == own[:12]  # of the features the frame has
    with pytest.raises(ValueError, match="top13"):
        FE.market_average(small_panel, "top13")
    by_name, by_list = FE.market_average(small_panel, "top12"), FE.market_average(small_panel, own[:12])
    assert by_name.columns == by_list.columns
    assert by_name.agg(F.sum(f"{own[0]}_mkt")).first() == by_list.agg(F.sum(f"{own[0]}_mkt")).first()


def test_baseline_stores_frame_predictions_and_importances(spark, small_panel):
    lo, hi = small_panel.agg(F.min("date_id"), F.max("date_id")).first()
    split = nested_split(lo, hi, 10, 8, 1)
    out = BL.run(small_panel, split, G.GBTParams(max_iter=2, max_depth=2, max_bins=16), engineered=["feature_02"], window=10)
    assert {"symbol_id", "time_id", "responder_6_lag_1", "feature_02_mkt", "feature_02_roll_std"} <= set(out.inputs)
    assert out.frame.count() == small_panel.count()
    assert {r["feature"] for r in out.importances.collect()} == set(out.inputs)
    test = small_panel.where(F.col("date_id") >= split.test_start)
    assert spark.read.parquet(f"{out.path}/oof").count() == test.count() == out.summary.first()["test_rows"]
    rows = out.oof.toPandas()
    want = 1 - (rows.weight * (rows.responder_6 - rows.prediction) ** 2).sum() / (rows.weight * rows.responder_6 ** 2).sum()
    assert out.summary.first()["score"] == pytest.approx(want)
