import pytest
from pyspark.sql import functions as F

from tidepanel.plans import gbt as G

FEATS = [f"feature_{i:02d}" for i in range(8)]


@pytest.fixture(scope="module")
def model(small_panel):
    return G.fit(small_panel.where("date_id <= 48"), FEATS, G.GBTParams(max_iter=5, max_depth=3, max_bins=16),
                 valid=small_panel.where("date_id between 51 and 62"))


def test_refit_with_full_decay_is_identity(model, small_panel):
    new = small_panel.where("date_id between 63 and 70")
    same = G.refit(model, new, decay=1.0)
    a = G.predict(model, new).select("date_id", "time_id", "symbol_id", F.col("prediction").alias("a"))
    b = G.predict(same, new).select("date_id", "time_id", "symbol_id", F.col("prediction").alias("b"))
    j = a.join(b, ["date_id", "time_id", "symbol_id"])
    assert j.count() == new.count()
    assert j.where(F.abs(F.col("a") - F.col("b")) > 1e-9).count() == 0


def test_refit_keeps_leaves_that_no_new_row_reaches(model, small_panel):
    one_day = small_panel.where("date_id = 63")
    other = small_panel.where("date_id between 64 and 82")
    same = G.refit(model, one_day, decay=1.0)
    ids = ["date_id", "time_id", "symbol_id"]
    j = G.predict(model, other).select(*ids, F.col("prediction").alias("a")).join(
        G.predict(same, other).select(*ids, F.col("prediction").alias("b")), ids)
    assert j.count() == other.count() and j.where(F.abs(F.col("a") - F.col("b")) > 1e-9).count() == 0


def test_refit_blends_by_hand(spark):
    rows = [(0, i, i % 2, float(i % 2), 1.0 + i % 3, 4.0 * (i % 2)) for i in range(40)]
    schema = "date_id int, time_id int, symbol_id long, feature_00 double, weight double, responder_6 double"
    m = G.fit(spark.createDataFrame(rows, schema), ["feature_00"], G.GBTParams(max_iter=1, max_depth=1, max_bins=4))
    new = spark.createDataFrame([(1, 0, 0, 0.0, 1.0, 1.0), (1, 1, 0, 0.0, 3.0, 2.0)], schema)
    r = G.refit(m, new, decay=0.25)
    probe = spark.createDataFrame([(2, 0, 0, 0.0, 1.0, 0.0), (2, 1, 0, 1.0, 1.0, 0.0)], schema)
    got = {x["feature_00"]: x["prediction"] for x in G.predict(r, probe).collect()}
    assert got[0.0] == pytest.approx(0.25 * 0.0 + 0.75 * (1 * 1 + 3 * 2) / 4)
    assert got[1.0] == pytest.approx(4.0)  # no new row reaches this leaf


def test_refit_and_continue_change_predictions(model, small_panel):
    new = small_panel.where("date_id between 63 and 70")
    r = G.refit(model, new, decay=0.5)
    c = G.continue_training(model, new, 2, G.GBTParams(max_iter=5, max_depth=3, max_bins=16))
    assert len(c.residual_stages) == 1
    base = G.predict(model, new).agg(F.sum("prediction")).first()[0]
    assert G.predict(r, new).agg(F.sum("prediction")).first()[0] != base
    assert G.predict(c, new).agg(F.sum("prediction")).first()[0] != base


def test_importance_ranked(model):
    imp = G.feature_importance(model).collect()
    assert len(imp) == len(FEATS)
    assert [r["importance"] for r in imp] == sorted([r["importance"] for r in imp], reverse=True)
