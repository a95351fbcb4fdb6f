"""Refit and early stopping from leaf statistics against row-by-row forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators.splits import nested_split
from tidepanel.plans import gbt as G
from tidepanel.plans import leaf_stats as LS

FEATS = [f"feature_{i:02d}" for i in range(8)]
IDS = ["date_id", "time_id", "symbol_id"]
PARAMS = G.GBTParams(max_iter=6, max_depth=3, max_bins=16, step_size=0.3)


@pytest.fixture(scope="module")
def model(small_panel):
    return G.fit(small_panel.where("date_id <= 48"), FEATS, PARAMS)


def leaf_values(m):
    return [r["value"] for r in m.leaf_table.orderBy("tree", "leaf").collect()]


def test_one_pass_refit_equals_tree_by_tree(model, small_panel):
    new = small_panel.where("date_id between 63 and 64")
    slow, fast = G.refit(model, new, 0.6), LS.refit(model, new, 0.6)
    assert leaf_values(fast) == pytest.approx(leaf_values(slow), rel=1e-9, abs=1e-9)
    other = small_panel.where("date_id = 70")
    a, b = (sorted(tuple(r) for r in G.predict(m, other).select(*IDS, "prediction").collect()) for m in (slow, fast))
    assert [x[3] for x in a] == pytest.approx([x[3] for x in b], rel=1e-9, abs=1e-9)
    again = LS.refit(fast, other, 0.6)  # a refit of a refit
    assert leaf_values(again) == pytest.approx(leaf_values(G.refit(slow, other, 0.6)), rel=1e-9, abs=1e-9)


def test_refit_is_one_scan_without_row_shuffle(spark, model, small_panel):
    stats = LS.leaf_statistics(model, small_panel.where("date_id = 63"))
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange") == 1 and "Join" not in plan


def test_rows_without_target_or_weight_count_nowhere(model, small_panel):
    new = small_panel.where("date_id = 63")
    holes = new.withColumn("weight", F.when(F.col("symbol_id") % 3 == 0, None).otherwise(F.col("weight")))
    holes = holes.withColumn("responder_6", F.when(F.col("symbol_id") % 3 == 1, float("nan")).otherwise(F.col("responder_6")))
    assert leaf_values(LS.refit(model, holes, 0.5)) == pytest.approx(leaf_values(LS.refit(model, new.where("symbol_id % 3 = 2"), 0.5)))
    assert LS.refit(model, new.limit(0), 0.5).leaf_table is None


def test_small_task_memory_gives_the_same_sums(model, small_panel, monkeypatch):
    new = small_panel.where("date_id between 63 and 66")
    leaves = LS.leaves_of(model)
    whole = LS.gathered(LS.leaf_statistics(model, new, F.col("date_id")), leaves)
    import pyarrow as pa
    rows = G._leaves(model, G.assemble(new.limit(300), FEATS)).select(
        F.col("date_id").cast("long"), "responder_6", "weight", F.col("_leaves").cast("array<int>")).toArrow()
    parts = []
    for cells in (4_000_000, 1):
        monkeypatch.setattr(LS, "HELD_CELLS", cells)
        got = pa.Table.from_batches(LS._sums(leaves.first)(rows.to_batches(50))).to_pandas()
        parts.append(got.groupby(["grp", "a", "b"])["v"].sum())
    assert parts[0].index.equals(parts[1].index) and np.allclose(parts[0], parts[1])
    assert set(whole) == {63, 64, 65, 66}


def test_refit_walk_forward_equals_version_loop(small_panel, model):
    lo, hi = small_panel.agg(F.min("date_id"), F.max("date_id")).first()
    split = nested_split(lo, hi, 20, 12, 2)
    got = {r["version"]: r for r in LS.refit_walk_forward(model, small_panel, split, 7, 0.7).collect()}
    days = sorted(r[0] for r in small_panel.select("date_id").distinct().collect() if r[0] >= split.test_start)
    m = model
    for v, first in enumerate(range(0, len(days), 7)):
        if v:
            m = G.refit(m, small_panel.where(F.col("date_id").isin(days[first - 7:first])), 0.7)
        rows = G.predict(m, small_panel.where(F.col("date_id").isin(days[first:first + 7]))).toPandas()
        sst = (rows.weight * rows.responder_6 ** 2).sum()
        assert got[v]["n_rows"] == len(rows)
        assert got[v]["r2"] == pytest.approx(1 - (rows.weight * (rows.responder_6 - rows.prediction) ** 2).sum() / sst, abs=1e-9)


def test_early_stopping_restores_the_best_round(small_panel):
    train, valid = small_panel.where("date_id <= 20"), small_panel.where("date_id between 51 and 62")
    params = G.GBTParams(max_iter=10, max_depth=4, max_bins=16, step_size=0.5)
    cut, history = LS.fit_early_stopping(train, valid, FEATS, params, 3)
    history = history.orderBy("round").collect()
    full = G.fit(train, FEATS, params)
    losses = []
    for k in range(1, 11):  # every prefix, scored on rows
        rows = G.predict(LS.first_trees(full, k), valid).toPandas()
        losses.append((rows.weight * (rows.responder_6 - rows.prediction) ** 2).sum() / rows.weight.sum())
    best, last = LS.best_round(losses, 3)
    assert [h["loss"] for h in history] == pytest.approx(losses[:last])
    assert [h["round"] for h in history if h["is_best"]] == [best] == [cut.base.getNumTrees]
    r2 = G.predict(cut, valid).agg((1 - F.sum(F.col("weight") * (F.col("responder_6") - F.col("prediction")) ** 2)
                                    / F.sum(F.col("weight") * F.col("responder_6") ** 2)).alias("r2")).first()["r2"]
    assert r2 == pytest.approx(history[best - 1]["r2"], abs=1e-9)


@pytest.mark.parametrize(("losses", "patience", "want"), [
    ([3.0, 2.0, 1.0], 1, (3, 3)), ([1.0, 2.0, 0.5], 1, (1, 2)), ([1.0, 2.0, 0.5], 2, (3, 3)), ([2.0, 2.0, 2.0, 2.0], 2, (1, 3)), ([5.0], 3, (1, 1))])
def test_best_round(losses, patience, want):
    assert LS.best_round(losses, patience) == want
