"""Weighted (ridge) least squares from per-day sufficient statistics.

One aggregation over the panel produces, per date, ``A_d = Σ w·x·xᵀ``,
``b_d = Σ w·x·y`` (one vector per target), ``c_d = Σ w·y²`` and ``n_d``. Everything
after that -- static, expanding, decayed, residual and online model versions, and
their scores -- is algebra on that small table (one row per date): the panel is read
once, never looped over on the driver, and a model version never reads rows again.

Day SSE of a linear predictor β: ``c_d - 2βᵀb_d + βᵀA_dβ``; block R² is
``1 - Σ_d SSE_d / Σ_d c_d`` (sums over days first, not a mean of daily R²).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.columns import DATE, TARGET_COLUMN, WEIGHT_COLUMN
from tidepanel.functions.exprs import fill_null, nan_to_null, no_nan

ONE = "_one"


def design_names(features: list[str], intercept: bool) -> list[str]:
    return ([ONE] if intercept else []) + list(features)


def design_columns(features: list[str], intercept: bool,
                   standardizer: dict[str, tuple[float, float]] | None = None) -> dict[str, Column]:
    """Model inputs: optional intercept, features z-scored (or raw), null/NaN -> 0."""
    out: dict[str, Column] = {}
    if intercept:
        out[ONE] = F.lit(1.0)
    for f in features:
        x = nan_to_null(F.col(f).cast("double"))
        if standardizer is not None:
            m, s = standardizer[f]
            x = (x - F.lit(float(m))) / F.lit(float(s))
        out[f] = fill_null(x)
    return out


def a_name(i: int, j: int) -> str:
    return f"a_{i}_{j}"


def b_name(t: str, i: int) -> str:
    return f"b_{t}_{i}"


def stat_columns(p: int, targets: list[str]) -> list[str]:
    cols = ["n"] + [f"c_{t}" for t in targets]
    cols += [b_name(t, i) for t in targets for i in range(p)]
    cols += [a_name(i, j) for i in range(p) for j in range(i, p)]
    return cols


# Above this many model inputs the p² products are formed by BLAS inside the tasks
# (one partial row per task and date) instead of as p² SQL expressions per row.
SQL_MAX_INPUTS = 24


def daily_statistics(df: DataFrame, features: list[str], targets: list[str] | None = None,
                     weight: str = WEIGHT_COLUMN, intercept: bool = True,
                     standardizer: dict[str, tuple[float, float]] | None = None,
                     date_col: str = DATE, method: str = "auto") -> DataFrame:
    """Per-date sufficient statistics (upper triangle of A) in one hash aggregation.

    Partial aggregation runs per task before the shuffle, so the exchange carries one
    row per (task, date) whatever the number of rows or symbols. ``sql`` builds the
    products as column expressions (codegen); ``blas`` forms them per Arrow batch with
    numpy (``mapInPandas``) and lets Spark sum the per-task partials -- the choice for
    wide models, where p² expressions per row would dominate.
    """
    tg = targets or [TARGET_COLUMN]
    p_in = len(features) + (1 if intercept else 0)
    if method == "blas" or (method == "auto" and p_in > SQL_MAX_INPUTS):
        return _daily_statistics_blas(df, features, tg, weight, intercept, standardizer, date_col)
    xs = design_columns(features, intercept, standardizer)
    names = list(xs)
    p = len(names)
    base = df.select(F.col(date_col), no_nan(weight).alias("_w"), *[no_nan(t).alias(f"_y_{t}") for t in tg],
                     *[c.alias(f"_x{i}") for i, c in enumerate(xs.values())])
    x = [F.col(f"_x{i}") for i in range(p)]
    wc = F.col("_w")
    aggs = [F.count(F.lit(1)).cast("bigint").alias("n")]
    aggs += [F.sum(wc * F.col(f"_y_{t}") * F.col(f"_y_{t}")).alias(f"c_{t}") for t in tg]
    aggs += [F.sum(wc * x[i] * F.col(f"_y_{t}")).alias(b_name(t, i)) for t in tg for i in range(p)]
    aggs += [F.sum(wc * x[i] * x[j]).alias(a_name(i, j)) for i in range(p) for j in range(i, p)]
    return base.groupBy(date_col).agg(*aggs)


def _daily_statistics_blas(df, features, tg, weight, intercept, standardizer, date_col):
    p = len(features) + (1 if intercept else 0)
    cols = stat_columns(p, tg)
    iu = np.triu_indices(p)
    fields = [T.StructField(date_col, T.IntegerType()), T.StructField("n", T.LongType())]
    fields += [T.StructField(c, T.DoubleType()) for c in cols[1:]]
    schema = T.StructType(fields)
    mean = np.array([standardizer[f][0] for f in features]) if standardizer else None
    std = np.array([standardizer[f][1] for f in features]) if standardizer else None

    def partials(batches):
        acc: dict[int, list] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            x = pdf[features].to_numpy(dtype=float, na_value=np.nan)
            if standardizer is not None:
                x = (x - mean) / std
            x = np.where(np.isnan(x), 0.0, x)  # NULL / NaN -> 0, as in the SQL form
            if intercept:
                x = np.hstack([np.ones((len(x), 1)), x])
            w = pdf[weight].to_numpy(dtype=float, na_value=np.nan)
            w = np.where(np.isnan(w), 0.0, w)
            ys = np.column_stack([pdf[t].to_numpy(dtype=float, na_value=np.nan) for t in tg])
            ys = np.where(np.isnan(ys), 0.0, ys)
            dates = pdf[date_col].to_numpy()
            for d in np.unique(dates):
                m = dates == d
                xw = x[m] * w[m][:, None]
                A = (xw.T @ x[m])[iu]
                B = xw.T @ ys[m]  # p x T
                C = (w[m][:, None] * ys[m] * ys[m]).sum(axis=0)
                cur = acc.get(int(d))
                if cur is None:
                    acc[int(d)] = [int(m.sum()), C, B, A]
                else:
                    cur[0] += int(m.sum())
                    cur[1] = cur[1] + C
                    cur[2] = cur[2] + B
                    cur[3] = cur[3] + A
        rows = []
        for d, (n, C, B, A) in acc.items():
            rows.append([d, n, *C.tolist(), *B.T.reshape(-1).tolist(), *A.tolist()])
        if rows:
            yield pd.DataFrame(rows, columns=[date_col] + cols)

    need = list(dict.fromkeys([date_col, weight, *tg, *features]))
    strict = {weight, *tg}
    part = df.select(*[F.col(c).cast("int") if c == date_col else no_nan(c).alias(c) if c in strict else F.col(c).cast("double") for c in need])
    stats = part.mapInPandas(partials, schema)
    return stats.groupBy(date_col).agg(F.sum("n").cast("bigint").alias("n"),
                                       *[F.sum(c).alias(c) for c in cols[1:]])


def unpack(row: pd.Series | dict, p: int, targets: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray], dict[str, float]]:
    A = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            A[i, j] = A[j, i] = float(row[a_name(i, j)])
    b = {t: np.array([float(row[b_name(t, i)]) for i in range(p)]) for t in targets}
    c = {t: float(row[f"c_{t}"]) for t in targets}
    return A, b, c


def ridge_solve(A: np.ndarray, b: np.ndarray, ridge: float, intercept: bool) -> np.ndarray:
    """``(A + λI)⁻¹ b`` (the intercept is not penalised); least squares if singular."""
    reg = np.eye(A.shape[0]) * ridge
    if intercept and A.shape[0]:
        reg[0, 0] = 0.0
    M = A + reg
    try:
        return np.linalg.solve(M, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(M, b, rcond=None)[0]


def beta_schema(key_fields: list[T.StructField]) -> T.StructType:
    return T.StructType(key_fields + [T.StructField("beta", T.ArrayType(T.DoubleType()), False)])


def solve_rows(stats: DataFrame, key_cols: list[str], p: int, target: str, ridge: float,
               intercept: bool) -> DataFrame:
    """One independent ridge solve per row of a (small) summed-statistics table.

    ``mapInPandas`` keeps the solves on the executors, batch-wise; no shuffle.
    """
    fields = [f for f in stats.schema.fields if f.name in key_cols]
    schema = beta_schema(fields)

    def solve(batches):
        for pdf in batches:
            betas = []
            for _, row in pdf.iterrows():
                A, b, _ = unpack(row, p, [target])
                betas.append(ridge_solve(A, b[target], ridge, intercept).tolist())
            out = pdf[key_cols].copy()
            out["beta"] = betas
            yield out

    return stats.mapInPandas(solve, schema)  # one row per model version


def sse_column(beta: Column, p: int, target: str) -> Column:
    """``c - 2βᵀb + βᵀAβ`` for a row holding day statistics and a ``beta`` array."""
    bb = [F.element_at(beta, i + 1) for i in range(p)]
    lin = None
    for i in range(p):
        term = bb[i] * F.col(b_name(target, i))
        lin = term if lin is None else lin + term
    quad = None
    for i in range(p):
        for j in range(i, p):
            coef = 1.0 if i == j else 2.0
            term = F.lit(coef) * bb[i] * bb[j] * F.col(a_name(i, j))
            quad = term if quad is None else quad + term
    return F.col(f"c_{target}") - F.lit(2.0) * lin + quad


def predict_column(beta: Column, xs: dict[str, Column]) -> Column:
    out = None
    for i, c in enumerate(xs.values()):
        term = F.element_at(beta, i + 1) * c
        out = term if out is None else out + term
    return out
