"""Walk-forward strategies from day statistics vs a brute-force day loop over rows."""

import numpy as np
import pytest

from conftest import SF_SMALL
from tidepanel.plans import walk_forward as WF

FEATS = [f"feature_{i:02d}" for i in range(8)]


def _brute(pdf, cfg, variant, cadence):
    pdf = pdf.sort_values(["date_id", "time_id", "symbol_id"])
    dmin, dmax = int(pdf.date_id.min()), int(pdf.date_id.max())
    test_start = dmax - cfg.test_days + 1
    es_start = test_start - cfg.valid_days
    train_end = es_start - cfg.gap_days - 1
    tr = pdf[pdf.date_id <= train_end]
    X = pdf[FEATS].to_numpy(dtype=float)
    Xtr = tr[FEATS].to_numpy(dtype=float)
    mean = np.nan_to_num(np.nanmean(Xtr, axis=0), nan=0.0)
    std = np.maximum(np.nan_to_num(np.nanstd(Xtr, axis=0), nan=1.0), 1e-6)
    Z = np.nan_to_num((X - mean) / std, nan=0.0)
    Z = np.hstack([np.ones((len(Z), 1)), Z])
    y = pdf.responder_6.to_numpy(float)
    w = pdf.weight.to_numpy(float)
    d = pdf.date_id.to_numpy()
    p = Z.shape[1]
    reg = np.eye(p) * cfg.ridge
    reg[0, 0] = 0

    def stats(mask):
        Zm, ym, wm = Z[mask], y[mask], w[mask]
        return (Zm * wm[:, None]).T @ Zm, (Zm * wm[:, None]).T @ ym, float((wm * ym * ym).sum())

    A, b, _ = stats(d <= train_end)
    beta = np.linalg.solve(A + reg, b)
    days = sorted(set(d[d >= test_start]))
    preds, ys, ws = [], [], []
    last = 0
    for i, day in enumerate(days):
        if variant != "full" and i > 0 and i % cadence == 0:
            new = np.isin(d, days[last:i])
            An, bn, cn = stats(new)
            if variant == "retrain":
                A2, b2, _ = stats((d <= train_end) | ((d >= es_start) & (d < days[i])))
                beta = np.linalg.solve(A2 + reg, b2)
            elif variant == "refit":
                A, b = cfg.decay * A + (1 - cfg.decay) * An, cfg.decay * b + (1 - cfg.decay) * bn
                beta = np.linalg.solve(A + reg, b)
            elif variant == "continue":
                beta = beta + np.linalg.solve(An + reg, bn - An @ beta)
            elif variant == "online":
                g = 2 * (An @ beta - bn) / max(cn, 1e-6)
                n = np.linalg.norm(g)
                if n > cfg.grad_clip:
                    g = g * cfg.grad_clip / n
                beta = beta * (1 - cfg.lr * cfg.weight_decay) - cfg.lr * g
            last = i
        m = d == day
        preds.append(Z[m] @ beta)
        ys.append(y[m])
        ws.append(w[m])
    pr, yy, ww = map(np.concatenate, (preds, ys, ws))
    return 1 - (ww * (yy - pr) ** 2).sum() / (ww * yy * yy).sum()


@pytest.fixture(scope="module")
def prepared(spark, small_panel):
    cfg = WF.WalkForwardConfig(features=FEATS, ridge=1e-3, decay=0.8, lr=0.05, grad_clip=1.0, weight_decay=0.01)
    return cfg, WF.prepare(small_panel, cfg), small_panel.toPandas()


@pytest.mark.parametrize("variant,cadence", [("full", 1), ("retrain", 1), ("retrain", 3), ("refit", 2),
                                             ("continue", 4), ("online", 1)])
def test_matches_brute_force(prepared, variant, cadence):
    cfg, prep, pdf = prepared
    got = WF.score_variant(prep, variant, cadence).first()
    want = _brute(pdf, cfg, variant, cadence)
    assert got["score"] == pytest.approx(want, rel=1e-7, abs=1e-9)
    assert got["test_days"] == cfg.test_days
    assert got["n_updates"] == (0 if variant == "full" else (cfg.test_days - 1) // cadence)


def test_predictions_match_day_scores(prepared):
    cfg, prep, _ = prepared
    from pyspark.sql import functions as F
    from tidepanel.operators.metrics import weighted_r2
    from tidepanel.sources.fixtures import load_panel
    spark = prep.days.sparkSession
    rows = WF.predictions(load_panel(spark, SF_SMALL), prep, "retrain", 5)
    r = weighted_r2(rows, "prediction").first()["r2"]
    s = WF.score_variant(prep, "retrain", 5).first()["score"]
    assert r == pytest.approx(s, rel=1e-9)
    assert rows.where(F.col("date_id") < prep.split.test_start).count() == 0


def test_suite_matches_variants(prepared):
    cfg, prep, pdf = prepared
    specs = [("full", 1), ("retrain", 3), ("refit", 2), ("continue", 4), ("online", 1)]
    suite = {(r["variant"], r["cadence"]): r for r in WF.score_suite(prep, specs).collect()}
    for v, k in specs:
        one = WF.score_variant(prep, v, k).first()
        s = suite[(v, 0 if v == "full" else k)]
        assert s["score"] == pytest.approx(one["score"], rel=1e-9)
        assert s["n_updates"] == one["n_updates"] and s["test_rows"] == one["test_rows"]


def test_blas_statistics_match_sql(small_panel):
    from tidepanel.plans import wls
    std = {f: (1.0, 2.0) for f in FEATS}
    a = wls.daily_statistics(small_panel, FEATS, ["responder_6", "responder_3"], standardizer=std, method="sql")
    b = wls.daily_statistics(small_panel, FEATS, ["responder_6", "responder_3"], standardizer=std, method="blas")
    assert a.columns == b.columns
    ra = {r["date_id"]: r for r in a.collect()}
    rb = {r["date_id"]: r for r in b.collect()}
    assert ra.keys() == rb.keys()
    for d in ra:
        for c in a.columns:
            x, y = ra[d][c], rb[d][c]
            assert (x is None and y in (None, 0.0)) or abs(x - y) <= 1e-9 * max(1.0, abs(x)), (d, c, x, y)


@pytest.mark.parametrize("standardize,intercept", [(True, True), (False, False), (True, False)])
def test_one_pass_statistics_match_two_pass(spark, small_panel, standardize, intercept):
    cfg = WF.WalkForwardConfig(features=FEATS, standardize=standardize, intercept=intercept,
                               extra_targets=["responder_3"])
    a = WF.prepare(small_panel, cfg, one_pass=False)
    b = WF.prepare(small_panel, cfg, one_pass=True)
    assert a.split == b.split
    if standardize:
        for f in FEATS:
            assert a.standardizer[f][0] == pytest.approx(b.standardizer[f][0], rel=1e-12, abs=1e-12)
            assert a.standardizer[f][1] == pytest.approx(b.standardizer[f][1], rel=1e-9)
    ra = {r["date_id"]: r for r in a.days.collect()}
    rb = {r["date_id"]: r for r in b.days.collect()}
    assert ra.keys() == rb.keys()
    for d in ra:
        for c in a.days.columns:
            x, y = ra[d][c], rb[d][c]
            if isinstance(x, float) or isinstance(y, float):
                assert abs((x or 0.0) - (y or 0.0)) <= 1e-8 * max(1.0, abs(x or 0.0)), (d, c, x, y)
            else:
                assert x == y, (d, c)
    s1 = WF.score_suite(a, [("retrain", 3), ("online", 1)]).collect()
    s2 = WF.score_suite(b, [("retrain", 3), ("online", 1)]).collect()
    for x, y in zip(sorted(s1), sorted(s2)):
        assert x["score"] == pytest.approx(y["score"], rel=1e-9)
