"""Epoch training on day statistics against a loop over rows."""

import numpy as np
import pytest

from tidepanel.plans import epochs as EP
from tidepanel.plans import walk_forward as WF

FEATS = [f"feature_{i:02d}" for i in range(4)]


@pytest.fixture(scope="module")
def prepared(small_panel):
    cfg = WF.WalkForwardConfig(features=FEATS)
    prep = WF.prepare(small_panel, cfg)
    pdf = small_panel.select("date_id", "weight", "responder_6", *FEATS).toPandas()
    z = np.column_stack([np.ones(len(pdf))] + [np.nan_to_num((pdf[f].astype(float) - prep.standardizer[f][0]) / prep.standardizer[f][1]) for f in FEATS])
    days = {}
    for d in sorted(pdf.date_id.unique()):
        m = (pdf.date_id == d).to_numpy()
        days[int(d)] = (z[m], pdf.responder_6.to_numpy(float)[m], pdf.weight.to_numpy(float)[m])
    return prep, days


def by_rows(days, split, cfg, cadence):
    """The same training with predictions and gradients formed row by row."""
    def grad(beta, day):
        z, y, w = day
        g = -2 * (z * w[:, None]).T @ (y - z @ beta) / max((w * y * y).sum(), 1e-6)
        n = np.linalg.norm(g)
        return g * min(1.0, cfg.grad_clip / n) if n > 0 else g

    def stepper(lr):
        m, v, t = np.zeros(len(FEATS) + 1), np.zeros(len(FEATS) + 1), 0

        def step(beta, day):
            nonlocal m, v, t
            g = grad(beta, day)
            beta = beta - lr * cfg.weight_decay * beta
            if cfg.optimizer == "sgd":
                return beta - lr * g
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            return beta - lr * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        return step

    sse = lambda beta, day: (day[2] * (day[1] - day[0] @ beta) ** 2).sum()
    sst = lambda day: (day[2] * day[1] ** 2).sum()
    fold = lambda lo, hi: [v for d, v in days.items() if lo <= d <= hi]
    fit, es, test = fold(0, split.train.train_end), fold(split.es_start, split.es_end), fold(split.test_start, split.test_end)
    beta, step = np.zeros(len(FEATS) + 1), stepper(cfg.lr)
    scores, models, bad = [], [], 0
    for _ in range(cfg.epochs):
        for day in fit:
            beta = step(beta, day)
        live, live_step, total = beta, stepper(cfg.lr_refit), 0.0
        for day in es:
            total += sse(live, day)
            live = live_step(live, day)
        scores.append(1 - total / sum(map(sst, es)))
        models.append(beta)
        bad = 0 if scores[-1] > max(scores[:-1], default=-np.inf) else bad + 1
        if bad >= cfg.patience + 1:
            break
    best = int(np.argmax(scores))
    beta, total = models[best], 0.0
    for i, day in enumerate(test):
        if i and i % cadence == 0:
            own = stepper(cfg.lr_refit)
            for seen in test[i - cadence:i]:
                beta = own(beta, seen)
        total += sse(beta, day)
    return scores, best + 1, 1 - total / sum(map(sst, test))


@pytest.mark.parametrize(("optimizer", "lr", "patience", "cadence"), [("adamw", 0.02, 1, 1), ("sgd", 0.3, 2, 3), ("adamw", 0.001, 0, 5)])
def test_epochs_equal_a_loop_over_rows(prepared, optimizer, lr, patience, cadence):
    prep, days = prepared
    cfg = EP.EpochConfig(epochs=8, patience=patience, lr=lr, lr_refit=lr / 2, weight_decay=0.01, grad_clip=0.5, optimizer=optimizer)
    scores, best, test = by_rows(days, prep.split, cfg, cadence)
    history = EP.epoch_history(prep, cfg).orderBy("epoch").collect()
    assert [h["valid_score"] for h in history] == pytest.approx(scores, rel=1e-7, abs=1e-9)
    assert [h["epoch"] for h in history if h["is_best"]] == [best]
    got = EP.epoch_walk_forward(prep, cfg, cadence).first()
    assert (got["best_epoch"], got["n_epochs"], got["test_days"]) == (best, len(scores), 20)
    assert got["score"] == pytest.approx(test, rel=1e-7, abs=1e-9)
    assert got["n_updates"] == 19 // cadence


def day(a, b, c):
    return np.array([[a]]), np.array([b]), c


def test_patience_ends_training_and_the_caller_keeps_its_model():
    cfg = EP.EpochConfig(epochs=50, patience=2, lr=0.1, lr_refit=0.0, optimizer="sgd", grad_clip=0)
    # the validation day wants 0.3, the fit day 1: the score falls after the model has passed 0.3
    rows = EP.train([day(1.0, 1.0, 1.0)], [day(1.0, 0.3, 1.0)], cfg)
    best = EP._best(rows)
    assert len(rows) == best + 1 + cfg.patience + 1 and abs(rows[best][3][0] - 0.3) < 0.15
    beta = np.array([0.5])
    EP.score_online(beta, [day(1.0, 1.0, 1.0)] * 5, EP.EpochConfig())
    assert beta.tolist() == [0.5]
    assert EP.score_online(beta, [day(0.0, 0.0, 0.0)], cfg) is None
    assert [r[2] for r in EP.train([day(1.0, 1.0, 1.0)], [], EP.EpochConfig(epochs=2))] == [-r[1] for r in EP.train([day(1.0, 1.0, 1.0)], [], EP.EpochConfig(epochs=2))]


@pytest.mark.parametrize("bad", [{"optimizer": "lbfgs"}, {"epochs": 0}, {"patience": -1}])
def test_impossible_settings_are_refused(bad):
    with pytest.raises(ValueError):
        EP.EpochConfig(**bad)
