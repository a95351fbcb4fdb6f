import pytest

from conftest import frame
from tidepanel.operators import experiments as EX

RUNS = "kind string, roll_window int, subset string, seed int, score double"


def test_paired_and_cells(spark):
    runs = frame(spark, [("baseline", None, None, 1, 0.10), ("baseline", None, None, 2, 0.20),
                         ("marketroll", 250, "top12", 1, 0.13), ("marketroll", 250, "top12", 2, 0.19),
                         ("marketroll", 250, "top12", 3, 0.50)], RUNS)
    paired = {r["seed"]: r["delta"] for r in EX.paired_delta(runs).collect()}
    assert set(paired) == {1, 2}  # seed 3 has no baseline -> no row
    assert paired[1] == pytest.approx(0.03) and paired[2] == pytest.approx(-0.01)
    cell = EX.cell_summary(EX.paired_delta(runs)).first()
    assert cell["n_seeds"] == 2 and cell["n_positive"] == 1
    assert cell["mean_delta"] == pytest.approx(0.01)


def test_single_seed_std_zero(spark):
    runs = frame(spark, [("baseline", None, None, 1, 0.010), ("marketroll", 10, "all", 1, 0.011)], RUNS)
    assert EX.cell_summary(EX.paired_delta(runs)).first()["std_delta"] == 0.0


def test_best_cell_and_delta_vs(spark):
    t = frame(spark, [("full", 0.5), ("refit", 0.7), ("retrain", 0.7)], "variant string, score double")
    assert EX.best_cell(t, ["variant"], "score").first()["best"] == "refit"
    d = {r["variant"]: r["delta_vs_full"] for r in EX.delta_vs(t, "variant", "full").collect()}
    assert d["full"] == 0.0 and d["refit"] == pytest.approx(0.2)


def test_split_grid_feasibility(spark):
    ds = frame(spark, [(0,), (82,)], "date_id int")
    g = {r["run_name"]: r for r in EX.split_grid(ds, [12, 80], [0, 5]).collect()}
    assert g["split_v12_g0"]["feasible"] and g["split_v12_g0"]["train_end"] == 70
    assert not g["split_v80_g5"]["feasible"]


def test_aux_style_pairing(spark):
    # base4 is the same-seed baseline of every other aux set.
    runs = frame(spark, [("baseline", None, "base4", 1, 0.010), ("baseline", None, "base4", 2, 0.012),
                         ("aux", None, "all9", 1, 0.011), ("aux", None, "all9", 2, 0.013)], RUNS)
    cell = EX.cell_summary(EX.paired_delta(runs)).first()
    assert cell["mean_delta"] == pytest.approx(0.001) and cell["n_positive"] == 2
