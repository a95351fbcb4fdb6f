"""Online training in epochs over the fit days, with patience.

The linear model takes one gradient step of the day's weighted loss per day, in date order,
for several epochs. After each epoch a copy of it goes through the early-stopping days: each
day is predicted, then the copy takes a step on it. The epoch with the best score of these
predictions is kept; training ends after ``patience + 1`` epochs without a better one.

Everything reads the per-day statistics of :mod:`tidepanel.plans.wls` (one row per date): the
panel is scanned once, whatever the number of epochs. The steps follow each other, so they
run in one task over that table of days.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.columns import DATE
from tidepanel.plans import wls
from tidepanel.plans.walk_forward import PreparedPanel

Day = tuple[np.ndarray, np.ndarray, float]  # A, b, c of one date

HISTORY = T.StructType([
    T.StructField("epoch", T.LongType()), T.StructField("train_loss", T.DoubleType()), T.StructField("valid_score", T.DoubleType()),
    T.StructField("is_best", T.BooleanType()), T.StructField("beta", T.ArrayType(T.DoubleType()))])
SCORE = T.StructType([
    T.StructField("best_epoch", T.LongType()), T.StructField("n_epochs", T.LongType()), T.StructField("n_updates", T.LongType()),
    T.StructField("test_days", T.LongType()), T.StructField("test_rows", T.LongType()), T.StructField("score", T.DoubleType())])


@dataclass(frozen=True)
class EpochConfig:
    epochs: int = 20
    patience: int = 3
    lr: float = 0.01
    lr_refit: float = 0.005  # of the steps on validation and test days; 0 takes none
    weight_decay: float = 0.0
    grad_clip: float = 1.0
    optimizer: str = "adamw"  # or "sgd"

    def __post_init__(self):
        if self.optimizer not in ("adamw", "sgd"):
            raise ValueError(f"no optimizer is called {self.optimizer!r}")
        if self.epochs < 1 or self.patience < 0:
            raise ValueError(f"{self.epochs} epochs with a patience of {self.patience} train nothing")


class Stepper:
    """Gradient steps with the optimizer's running moments."""

    def __init__(self, cfg: EpochConfig, lr: float, p: int):
        self.cfg, self.lr, self.t = cfg, lr, 0
        self.m, self.v = np.zeros(p), np.zeros(p)

    def step(self, beta: np.ndarray, day: Day) -> np.ndarray:
        """The coefficients after one step on a day's weighted loss ``sse / c``."""
        A, b, c = day
        g = 2.0 * (A @ beta - b) / max(c, 1e-6)
        norm = float(np.linalg.norm(g))
        if self.cfg.grad_clip and norm > self.cfg.grad_clip:
            g = g * (self.cfg.grad_clip / norm)
        beta = beta * (1.0 - self.lr * self.cfg.weight_decay)
        if self.cfg.optimizer == "sgd":
            return beta - self.lr * g
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return beta - self.lr * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.999 ** self.t)) + 1e-8)


def _sse(beta: np.ndarray, day: Day) -> float:
    A, b, c = day
    return float(c - 2 * beta @ b + beta @ A @ beta)


def score_online(beta: np.ndarray, days: list[Day], cfg: EpochConfig) -> float | None:
    """R² of days that are each predicted, then learned from (the caller's model stays)."""
    steps = Stepper(cfg, cfg.lr_refit, len(beta))
    sse = sst = 0.0
    for day in days:
        sse, sst = sse + _sse(beta, day), sst + day[2]
        if cfg.lr_refit > 0:
            beta = steps.step(beta, day)
    return 1 - sse / sst if sst > 0 else None


def train(fit_days: list[Day], valid_days: list[Day], cfg: EpochConfig) -> list[tuple]:
    """``(epoch, train_loss, valid_score, beta)`` of every epoch until patience ends.

    Without validation days (or weight on them) the score is minus the training loss.
    """
    p = len(fit_days[0][1])
    beta, steps = np.zeros(p), Stepper(cfg, cfg.lr, p)
    rows, best = [], 0
    for epoch in range(1, cfg.epochs + 1):
        losses = []
        for day in fit_days:
            losses.append(_sse(beta, day) / max(day[2], 1e-6))
            beta = steps.step(beta, day)
        score = score_online(beta, valid_days, cfg) if valid_days else None
        rows.append((epoch, float(np.mean(losses)), -float(np.mean(losses)) if score is None else score, beta))
        if epoch == 1 or rows[-1][2] > rows[best][2]:
            best = epoch - 1
        elif epoch - 1 - best >= cfg.patience + 1:
            break
    return rows


def _best(rows: list[tuple]) -> int:
    return max(range(len(rows)), key=lambda i: (rows[i][2], -i))


def _days(pdf: pd.DataFrame, fold: str, p: int, target: str) -> list[Day]:
    own = pdf[pdf["fold"] == fold].sort_values(DATE)
    out = []
    for row in own.to_dict("records"):
        A, b, c = wls.unpack(row, p, [target])
        out.append((A, b[target], c[target]))
    return out


def epoch_history(prep: PreparedPanel, cfg: EpochConfig) -> DataFrame:
    """One row per epoch that ran: loss, validation score, whether it is restored, its model."""
    p, target = prep.p, prep.cfg.target

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = train(_days(pdf, "train", p, target), _days(pdf, "es", p, target), cfg)
        best = _best(rows)
        return pd.DataFrame([(e, loss, score, i == best, beta.tolist()) for i, (e, loss, score, beta) in enumerate(rows)], columns=HISTORY.names)

    days = prep.days.where(F.col("fold").isin("train", "es"))
    return days.groupBy(F.lit(1).alias("_g")).applyInPandas(run, HISTORY)


def epoch_walk_forward(prep: PreparedPanel, cfg: EpochConfig, cadence: int = 1) -> DataFrame:
    """The best epoch's model over the test block, updated every ``cadence`` days.

    An update takes one step on each day predicted since the last one, with new moments.
    """
    p, target = prep.p, prep.cfg.target

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = train(_days(pdf, "train", p, target), _days(pdf, "es", p, target), cfg)
        best = _best(rows)
        beta, test = rows[best][3], _days(pdf, "test", p, target)
        sse = sst = 0.0
        updates = 0
        for i, day in enumerate(test):
            if i and i % cadence == 0 and cfg.lr_refit > 0:
                steps = Stepper(cfg, cfg.lr_refit, p)
                for seen in test[i - cadence:i]:
                    beta = steps.step(beta, seen)
                updates += 1
            sse, sst = sse + _sse(beta, day), sst + day[2]
        n = int(pdf.loc[pdf["fold"] == "test", "n"].sum())
        return pd.DataFrame([(rows[best][0], len(rows), updates, len(test), n, 1 - sse / sst if sst > 0 else None)], columns=SCORE.names)

    return prep.days.groupBy(F.lit(1).alias("_g")).applyInPandas(run, SCORE)
