"""Trees grown from stored chunks of bins are MLlib's trees."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.columns import RESPONDER_COLUMNS
from tidepanel.operators.splits import nested_split
from tidepanel.plans import baseline as BL
from tidepanel.plans import boosting as B
from tidepanel.plans import gbt as G

FEATS = ["feature_00", "feature_01", "feature_02"]
PARAMS = G.GBTParams(max_iter=5, max_depth=3, max_bins=16, step_size=0.3, seed=11, validation_tol=0.0)


def _rows(spark, n):
    r = np.random.default_rng(3)
    x = r.normal(size=(n, 3))
    pdf = pd.DataFrame({"date_id": np.arange(n) % 40, "time_id": np.arange(n) // 40 % 25, "symbol_id": np.arange(n) // 1000,
                        "feature_00": x[:, 0], "feature_01": np.where(r.random(n) < 0.2, np.nan, x[:, 1]), "feature_02": np.floor(x[:, 2] * 2),
                        "weight": r.integers(0, 5, n).astype(float), "responder_6": x[:, 0] * 2 - (x[:, 1] > 0) + x[:, 2] ** 2 + r.normal(size=n)})
    df = spark.createDataFrame(pdf)
    return df.withColumns({"symbol_id": F.when(F.col("symbol_id") > 0, F.col("symbol_id")), "date_id": F.when(F.col("date_id") != 7, F.col("date_id"))})


@pytest.mark.parametrize("n", [900, 14_000, 40_000])  # all rows are sampled; row by row; by gaps
def test_same_trees_as_mllib(spark, n, monkeypatch):
    df = _rows(spark, n)
    train, valid = df.where("symbol_id is null or symbol_id % 4 != 1"), df.where("symbol_id % 4 = 1") if n > 900 else None
    want = G._fit_mllib(train, FEATS, PARAMS, valid=valid)
    monkeypatch.setattr(G, "_fit_mllib", None)
    got = G.fit(train, FEATS, PARAMS, valid=valid)
    assert got.base.getNumTrees == want.base.getNumTrees
    assert list(got.base.treeWeights) == list(want.base.treeWeights)
    # a value and its flag can cut alike: the last digit decides between them
    assert np.allclose(*(m.base.featureImportances.toArray().reshape(2, 3).sum(axis=0) for m in (got, want)), atol=1e-9)
    ids = ["date_id", "time_id", "symbol_id", *FEATS]
    a, b = (G.predict(m, df).select(*ids, "prediction").toPandas().sort_values(ids).prediction.to_numpy() for m in (got, want))
    assert np.allclose(a, b, atol=1e-9)


def test_chunks_do_not_stay(spark, monkeypatch):
    seen = []
    keep = B.checkpoint_path
    monkeypatch.setattr(B, "checkpoint_path", lambda s, name: (seen.append(keep(s, name)), seen[-1])[1])
    df = _rows(spark, 900)
    G.fit(df, FEATS, PARAMS, valid=df)
    assert len(seen) == 2 and not any(os.path.exists(p) for p in seen)


def test_a_level_in_several_scans(spark, monkeypatch):
    df = _rows(spark, 900)
    want = G.fit(df, FEATS, PARAMS).base.featureImportances.toArray()
    monkeypatch.setattr(B, "HELD_CELLS", 1)
    assert np.allclose(G.fit(df, FEATS, PARAMS).base.featureImportances.toArray(), want, atol=1e-12)


def test_unusable_targets_and_weights_are_refused(spark):
    df = _rows(spark, 900)
    for bad in ({"responder_6": F.lit(None).cast("double")}, {"weight": F.lit(-1.0)}, {"feature_00": F.lit(float("inf"))}):
        with pytest.raises(Exception, match="boosted trees need finite"):
            G.fit(df.withColumns(bad), FEATS, PARAMS)
    with pytest.raises(ValueError, match="need rows"):
        G.fit(df.limit(0), FEATS, PARAMS)


def test_leaf_refits_and_retrains_need_no_mllib_fit(spark, monkeypatch):
    monkeypatch.setattr(G, "GBTRegressor", None)
    df = _rows(spark, 4_000).where("date_id is not null and symbol_id is not null")
    split = nested_split(0, 39, 8, 6, 1)
    test = df.where(F.col("date_id").between(split.test_start, split.test_end))
    for variant in ("refit", "retrain"):
        out, updates = G.walk_forward(df, FEATS, split, variant, 4, PARAMS)
        got = out.toPandas()
        assert updates == 1 and len(got) == test.count()
        r2 = 1 - (got.weight * (got.responder_6 - got.prediction) ** 2).sum() / (got.weight * got.responder_6 ** 2).sum()
        assert r2 > 0.5


def test_baseline_takes_the_stored_chunks(spark, monkeypatch):
    df = _rows(spark, 4_000).where("date_id is not null and symbol_id is not null").withColumns(
        {r: F.col("responder_6") * k for k, r in enumerate(RESPONDER_COLUMNS) if r != "responder_6"})
    split = nested_split(0, 39, 8, 6, 1)
    monkeypatch.setattr(G, "GBTRegressor", None)
    out = BL.run(df, split, PARAMS, engineered=FEATS[:1], window=5)
    monkeypatch.undo()
    days = F.col("date_id")
    want = G._fit_mllib(out.frame.where(days.between(split.train.train_start, split.train.train_end)), out.inputs, PARAMS,
                        valid=out.frame.where(days.between(split.es_start, split.es_end)))
    k = len(out.inputs)
    total = want.base.featureImportances.toArray().reshape(2, k).sum(axis=0)
    got = {r["feature"]: r["importance"] for r in out.importances.collect()}
    assert got == pytest.approx(dict(zip(out.inputs, total, strict=True)), abs=1e-6)
    assert out.oof.count() == out.summary.first()["test_rows"]
