"""Streaming walk-forward: equal to the batch evaluator, whole or after a restart."""

import os

import pytest
from pyspark.sql import functions as F

from tidepanel.operators.metrics import weighted_r2
from tidepanel.plans import walk_forward as WF
from tidepanel.streaming import walk_forward as SWF

FEATS = ["feature_02", "feature_03"]
COLS = ["date_id", "time_id", "symbol_id", "weight", "responder_6", *FEATS]


@pytest.fixture(scope="module")
def batch(small_panel):
    panel = small_panel.select(*COLS)
    prep = WF.prepare(panel, WF.WalkForwardConfig(features=FEATS))
    return panel, prep, WF.score_variant(prep, "retrain", 3).first()


def run(spark, path, panel, prep, out=None, files=1):
    return SWF.stream_walk_forward(spark, path, panel.schema, prep.cfg, prep.split, 3, prep.standardizer, out, files)


def same(got, want):
    assert got.asDict() == {k: pytest.approx(v, rel=1e-9) if isinstance(v, float) else v for k, v in want.asDict().items()}


def test_stream_equals_batch_evaluator(spark, batch):
    panel, prep, want = batch
    out = run(spark, SWF.stage_panel(panel, 11), panel, prep)
    same(SWF.summary(spark, out, prep.cfg, 3).first(), want)
    rows = SWF.predictions(spark, out)
    assert rows.count() == want["test_rows"]
    assert weighted_r2(rows, "prediction").first()["r2"] == pytest.approx(want["score"], rel=1e-9)
    betas = {r["version"]: r["beta"] for r in WF.version_betas(prep, "retrain", 3).collect()}
    for r in SWF.models(spark, out).collect():
        assert r["beta"] == pytest.approx(betas[r["version"]], rel=1e-9)


def test_stream_resumes_in_mid_day_and_after_a_failure(spark, batch, monkeypatch):
    panel, prep, want = batch
    path = SWF.stage_panel(panel.where("date_id < 66"), 33)
    middle = panel.where("date_id = 66")
    middle.where("time_id % 2 = 0").write.parquet(os.path.join(path, "d66a"))
    out = run(spark, path, panel, prep)
    middle.where("time_id % 2 = 1").write.parquet(os.path.join(path, "d66b"))
    SWF.stage_panel(panel.where("date_id > 66"), 9, path)
    calls = []
    kept = SWF.wls.predict_column

    def fails_once(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return kept(*args)

    monkeypatch.setattr(SWF.wls, "predict_column", fails_once)
    with pytest.raises(Exception, match="lost"):
        run(spark, path, panel, prep, out)  # statistics and models of the batch are written, its predictions are not
    run(spark, path, panel, prep, out)
    same(SWF.summary(spark, out, prep.cfg, 3).first(), want)
    rows = SWF.predictions(spark, out)
    assert rows.count() == want["test_rows"]
    assert SWF.models(spark, out).count() == want["test_days"]
    assert rows.where(F.col("date_id") < prep.split.test_start).count() == 0
