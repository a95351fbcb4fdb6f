"""Evaluator summaries (K10, D07): predictions and target of the test block, by variant.

All variants are evaluated in one pass over the test rows: the coefficients of each test day
(one small row per day, an array per variant) are broadcast, and one aggregation gives count,
mean, population standard deviation, minimum and maximum of every variant's predictions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.columns import DATE
from tidepanel.plans import walk_forward as WF
from tidepanel.plans import wls

MEASURES = ("mean", "std", "min", "max")


def day_models(prep: WF.PreparedPanel, specs: list[tuple[str, int]]) -> DataFrame:
    """``date_id, beta_0, beta_1, ...``: the coefficients that predict each test day, by variant."""
    days = prep.days.where(F.col("fold") == "test").select(DATE, "day_index")
    out = days.select(DATE)
    for k, (variant, cadence) in enumerate(specs):
        if cadence < 1:
            raise ValueError(f"a cadence of {cadence} days cannot be scheduled")
        version = (F.col("day_index") * 0 if variant == "full" else F.floor(F.col("day_index") / cadence)).cast("bigint")
        own = days.select(DATE, version.alias("version")).join(WF.version_betas(prep, variant, 1 if variant == "full" else cadence), "version")
        out = out.join(own.select(DATE, F.col("beta").alias(f"beta_{k}")), DATE)
    return out


def _summary(c: str) -> dict:
    return dict(zip(MEASURES, (F.avg(c), F.stddev_pop(c), F.min(c), F.max(c)), strict=True))


def summaries(df: DataFrame, prep: WF.PreparedPanel, specs: list[tuple[str, int]]) -> DataFrame:
    """One row per variant: ``variant, cadence, n_rows, prediction_* , target_*``.

    Null inputs count as 0, as in the model; a null target is left out of the target's
    figures. An empty test block gives zero rows and null figures.
    """
    xs = wls.design_columns(prep.cfg.features, prep.cfg.intercept, prep.standardizer)
    models = day_models(prep, specs)  # one row per test day
    rows = df.where(F.col(DATE) >= prep.split.test_start).join(F.broadcast(models), DATE)
    rows = rows.select(F.col(prep.cfg.target).cast("double").alias("y"),
                       *[wls.predict_column(F.col(f"beta_{k}"), xs).alias(f"p{k}") for k in range(len(specs))])
    aggs = [F.count(F.lit(1)).alias("n_rows"), *[a.alias(f"y_{m}") for m, a in _summary("y").items()]]
    aggs += [a.alias(f"p{k}_{m}") for k in range(len(specs)) for m, a in _summary(f"p{k}").items()]
    one = rows.agg(*aggs)
    parts = [F.struct(F.lit(v).alias("variant"), F.lit(0 if v == "full" else c).cast("bigint").alias("cadence"), F.col("n_rows"),
                      *[F.col(f"p{k}_{m}").alias(f"prediction_{m}") for m in MEASURES], *[F.col(f"y_{m}").alias(f"target_{m}") for m in MEASURES])
             for k, (v, c) in enumerate(specs)]
    return one.select(F.inline(F.array(*parts)))
