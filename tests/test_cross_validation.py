"""Cross-validation folds against a loop over rows, and sketches against exact counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import sketches as SK
from tidepanel.plans import cross_validation as CV
from tidepanel.plans import walk_forward as WF

FEATS = ["feature_02", "feature_03"]


@pytest.mark.parametrize(("scheme", "kw"), [
    ("expanding", {"n_folds": 4, "valid_days": 7, "purge": 2}), ("rolling", {"n_folds": 5, "valid_days": 6, "train_days": 15, "purge": 1}),
    ("blocked", {"n_folds": 6, "purge": 2, "embargo": 3}), ("blocked", {"n_folds": 83})])
def test_folds_equal_a_loop_over_rows(spark, small_panel, scheme, kw):
    panel = small_panel.where("date_id not in (20, 21, 60)")  # dates without rows
    prep = WF.prepare(panel, WF.WalkForwardConfig(features=FEATS, standardize=False, ridge=0.01))
    lo, hi = panel.agg(F.min("date_id"), F.max("date_id")).first()
    table = CV.folds(spark, lo, hi, scheme, **kw)
    pdf = panel.select("date_id", "weight", "responder_6", *FEATS).toPandas()
    z = np.column_stack([np.ones(len(pdf)), np.nan_to_num(pdf[FEATS].to_numpy(float))])
    y, w, d = (pdf[c].to_numpy(float) for c in ("responder_6", "weight", "date_id"))
    got = {r["fold"]: r for r in CV.score_folds(prep, table).collect()}
    for f in table.collect():
        valid = (d >= f["valid_start"]) & (d <= f["valid_end"])
        early = (d < f["valid_start"] - kw.get("purge", 0)) & (d >= (f["valid_start"] - kw.get("purge", 0) - kw.get("train_days", 10**6)))
        train = early | ((d > f["valid_end"] + kw.get("embargo", 0)) if scheme == "blocked" else np.zeros(len(d), bool))
        zt, wt = z[train], w[train][:, None]
        beta = np.linalg.solve(zt.T @ (wt * zt) + np.diag([0, 0.01, 0.01]), zt.T @ (w[train] * y[train]))
        r = got[f["fold"]]
        assert (r["train_rows"], r["valid_rows"]) == (train.sum(), valid.sum())
        if valid.any():
            want = 1 - (w[valid] * (y[valid] - z[valid] @ beta) ** 2).sum() / (w[valid] * y[valid] ** 2).sum()
            assert r["r2"] == pytest.approx(want, abs=1e-7)
        else:
            assert r["r2"] is None or abs(r["valid_rows"]) == 0


@pytest.mark.parametrize("kw", [
    {"scheme": "leave-one-out", "n_folds": 2}, {"scheme": "rolling", "n_folds": 2, "valid_days": 3}, {"scheme": "expanding", "n_folds": 5, "valid_days": 30},
    {"scheme": "expanding", "n_folds": 0, "valid_days": 3}, {"scheme": "blocked", "n_folds": 1}])
def test_impossible_schemes_are_refused(spark, kw):
    with pytest.raises(ValueError):
        CV.folds(spark, 0, 82, **kw)


def test_sketches_merge_to_any_range(spark):
    rows = spark.range(60_000).select((F.col("id") % 30).cast("int").alias("date_id"), (F.col("id") % 7).alias("symbol_id"),
                                      F.pmod(F.xxhash64("id"), F.lit(20_000)).alias("key"), F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("few"))
    daily = SK.daily_sketches(rows, ["key", "few", "symbol_id"]).checkpoint()
    for lo, hi in ((0, 29), (3, 3), (10, 17), (40, 50)):
        got = SK.distinct_in(daily, lo, hi).first()
        own = rows.where(F.col("date_id").between(lo, hi))
        want = own.agg(F.count("*"), F.countDistinct("key"), F.countDistinct("few"), F.countDistinct("symbol_id")).first()
        assert got["n_rows"] == want[0]
        for c, n in zip(("key", "few", "symbol_id"), want[1:], strict=True):
            assert abs(got[f"distinct_{c}"] - n) <= max(1, 4 * 1.04 / 64 * n)
