"""Auxiliary-head stack on shared statistics (K06) and the aux-set x seed sweep.

All heads share one ``Σ w·x·xᵀ``; each auxiliary target adds one right-hand side.
A head's predictions are ``p_t = xᵀβ_t``, so the stacker's normal equations follow
from the same statistics without reading rows again:
``Σ w·p_t·p_s = β_tᵀ A β_s`` and ``Σ w·p_t·y = β_tᵀ b_y``. The stacked model is linear,
``β = Σ_t γ_t β_t``, and is scored from the test-day statistics.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.columns import AUX_TARGET_SETS
from tidepanel.operators.experiments import seeded_day_weight
from tidepanel.plans import wls
from tidepanel.plans.walk_forward import PreparedPanel


def stack_solve(A_fit: np.ndarray, b_fit: dict, heads: list[str], target: str, ridge: float,
                intercept: bool) -> np.ndarray:
    betas = np.stack([wls.ridge_solve(A_fit, b_fit[h], ridge, intercept) for h in heads], axis=1)
    G = betas.T @ A_fit @ betas
    h = betas.T @ b_fit[target]
    gamma = wls.ridge_solve(G, h, ridge, False)
    return betas @ gamma


def aux_sweep(prep: PreparedPanel, aux_sets: list[str], seeds: list[int] | None = None) -> DataFrame:
    """Score the stacked model of every aux set for every seed (seeded weights of the fit
    days; all days weigh 1 without seeds).

    One grouped aggregation of the day statistics per seed (seeds are exploded as a
    parameter array), then one ridge solve per (set, seed) row on the executors.
    """
    cfg, p = prep.cfg, prep.p
    targets = cfg.targets
    cols = wls.stat_columns(p, targets)
    d = prep.days.select("*", F.explode(F.array(*[F.lit(s) for s in seeds or [0]])).alias("seed"))
    fit = F.col("fold") == "train"
    w = seeded_day_weight(F.col("seed")) if seeds else F.lit(1.0)
    test = F.col("fold") == "test"
    sums = d.groupBy("seed").agg(*[F.sum(F.when(fit, w * F.col(c))).alias(f"f_{c}") for c in cols],
                                 *[F.sum(F.when(test, F.col(c))).alias(f"t_{c}") for c in cols])
    sets = {s: AUX_TARGET_SETS[s] for s in aux_sets}
    schema = T.StructType([T.StructField("aux_set", T.StringType()), T.StructField("seed", T.IntegerType()),
                           T.StructField("n_heads", T.LongType()), T.StructField("score", T.DoubleType())])
    target, ridge, icpt = cfg.target, cfg.ridge, cfg.intercept

    def solve(batches):
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                fr = {c: row[f"f_{c}"] for c in cols}
                tr = {c: row[f"t_{c}"] for c in cols}
                Af, bf, _ = wls.unpack(fr, p, targets)
                At, bt, ct = wls.unpack(tr, p, targets)
                for name, heads in sets.items():
                    beta = stack_solve(Af, bf, heads, target, ridge, icpt)
                    sse = ct[target] - 2 * beta @ bt[target] + beta @ At @ beta
                    out.append((name, int(row["seed"]), len(heads), float(1 - sse / ct[target])))
            yield pd.DataFrame(out, columns=["aux_set", "seed", "n_heads", "score"])

    return sums.mapInPandas(solve, schema)  # one row per seed
