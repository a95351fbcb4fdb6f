"""One-pass day statistics for standardised linear models.

The standardiser (train-fold mean / population std of every input) is needed before the
day statistics ``Σ w·z·zᵀ`` of the standardised inputs ``z`` can be formed, which costs
a second pass over the (possibly expensive, engineered) frame. Here a single pass
collects, per date, moments of the inputs *centred on a per-date reference* plus the
moments of the null indicators; the standardiser and the standardised statistics are
then exact algebra on that small table:

``s∘z = v + diag(r - m)·o`` with ``v = o∘(x - r)``, so
``Σw(s∘z)(s∘z)ᵀ = Σw·v·vᵀ + V_o·D + D·V_oᵀ + D·O·D`` (``D = diag(r - m)``).

Centring on the day's own level keeps every term well conditioned (no large raw
moments are subtracted). Partials from different tasks of the same date are moved to a
common reference with the same shift identities before they are added.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.columns import DATE
from tidepanel.functions.exprs import no_nan

_ARR = T.ArrayType(T.DoubleType())
MERGE_TASKS = 512  # tasks whose partials of one date are merged first
_FIELDS = ["r", "Vv", "Vo", "Oo", "sv", "so", "Bv", "Bo", "By", "C", "uc", "u1", "u2"]


def _schema(date_col: str) -> T.StructType:
    return T.StructType([T.StructField(date_col, T.IntegerType()), T.StructField("n", T.LongType()),
                         T.StructField("sw", T.DoubleType())] + [T.StructField(f, _ARR) for f in _FIELDS])


def _shift(m: dict, r_new: np.ndarray, p: int, nt: int) -> dict:
    """Move a moment record from its reference ``r`` to ``r_new`` (exact identities)."""
    d = m["r"] - r_new
    if not np.any(d):
        return m
    D = np.diag(d)
    Vv, Vo, Oo = m["Vv"].reshape(p, p), m["Vo"].reshape(p, p), m["Oo"].reshape(p, p)
    Bv, Bo = m["Bv"].reshape(nt, p), m["Bo"].reshape(nt, p)
    out = dict(m)
    out["Vv"] = (Vv + Vo @ D + D @ Vo.T + D @ Oo @ D).reshape(-1)
    out["Vo"] = (Vo + D @ Oo).reshape(-1)
    out["sv"] = m["sv"] + d * m["so"]
    out["Bv"] = (Bv + Bo * d[None, :]).reshape(-1)
    out["u2"] = m["u2"] + 2 * d * m["u1"] + d * d * m["uc"]
    out["u1"] = m["u1"] + d * m["uc"]
    out["r"] = r_new
    return out


def _add(a: dict, b: dict) -> dict:
    out = {k: a[k] + b[k] for k in a if k not in ("r",)}
    out["r"] = a["r"]
    return out


def day_moments(df: DataFrame, features: list[str], targets: list[str], weight: str,
                date_col: str = DATE) -> DataFrame:
    """One pass: centred weighted moments per (task, date) with BLAS, then an exact
    per-date merge (one group per date holding one partial per task)."""
    p, nt = len(features), len(targets)
    schema = _schema(date_col)

    def partials(batches):
        acc: dict[int, dict] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            x = pdf[features].to_numpy(dtype=float, na_value=np.nan)
            o = (~np.isnan(x)).astype(float)
            w = pdf[weight].to_numpy(dtype=float, na_value=np.nan)
            w = np.where(np.isnan(w), 0.0, w)
            ys = np.column_stack([pdf[t].to_numpy(dtype=float, na_value=np.nan) for t in targets])
            ys = np.where(np.isnan(ys), 0.0, ys)
            dates = pdf[date_col].to_numpy()
            for d in np.unique(dates):
                msk = dates == d
                xd, od, wd, yd = x[msk], o[msk], w[msk], ys[msk]
                cnt = od.sum(axis=0)
                r = np.where(cnt > 0, np.nansum(xd, axis=0) / np.where(cnt > 0, cnt, 1), 0.0)
                v = np.where(od > 0, xd - r, 0.0)
                vw, ow = v * wd[:, None], od * wd[:, None]
                rec = {"n": float(msk.sum()), "sw": float(wd.sum()), "r": r,
                       "Vv": (vw.T @ v).reshape(-1), "Vo": (vw.T @ od).reshape(-1), "Oo": (ow.T @ od).reshape(-1),
                       "sv": vw.sum(axis=0), "so": ow.sum(axis=0),
                       "Bv": (yd.T @ vw).reshape(-1), "Bo": (yd.T @ ow).reshape(-1),
                       "By": yd.T @ wd, "C": (yd * yd).T @ wd,
                       "uc": cnt, "u1": v.sum(axis=0), "u2": (v * v).sum(axis=0)}
                key = int(d)
                acc[key] = rec if key not in acc else _add(acc[key], _shift(rec, acc[key]["r"], p, nt))
        if acc:
            ds = sorted(acc)
            cols = {date_col: ds, "n": [int(acc[k]["n"]) for k in ds], "sw": [acc[k]["sw"] for k in ds]}
            for f in _FIELDS:
                cols[f] = [np.asarray(acc[k][f], dtype=float) for k in ds]
            yield pd.DataFrame(cols)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        recs = [{f: np.asarray(row[f], dtype=float) for f in _FIELDS} | {"n": float(row["n"]), "sw": float(row["sw"])}
                for _, row in pdf.iterrows()]
        uc = sum(r["uc"] for r in recs)
        # Common reference: the count-weighted mean of the partial references.
        ref = np.where(uc > 0, sum(r["r"] * r["uc"] for r in recs) / np.where(uc > 0, uc, 1), recs[0]["r"])
        tot = None
        for r in recs:
            s = _shift(r, ref, p, nt)
            tot = s if tot is None else _add(tot, s)
        out = {date_col: [int(pdf[date_col].iloc[0])], "n": [int(tot["n"])], "sw": [tot["sw"]]}
        for f in _FIELDS:
            out[f] = [tot[f]]
        return pd.DataFrame(out)

    need = list(dict.fromkeys([date_col, weight, *targets, *features]))
    strict = {weight, *targets}
    part = df.select(*[F.col(c).cast("int") if c == date_col else no_nan(c).alias(c) if c in strict else F.col(c).cast("double") for c in need])
    # a date has one partial per task: they are merged in groups first, then the groups
    salted = part.mapInPandas(partials, schema).withColumn("_salt", F.floor(F.spark_partition_id() / MERGE_TASKS))
    grouped = salted.groupBy(date_col, "_salt").applyInPandas(lambda pdf: merge(pdf.drop(columns="_salt")), schema)
    return grouped.groupBy(date_col).applyInPandas(merge, schema)


def standardizer_from_moments(rows: list[dict], p: int, nt: int, eps: float = 1e-6):
    """Train-fold mean / population std (NaN-aware; all-null -> (0, 1); floor eps)."""
    ref = rows[0]["r"]
    uc = np.zeros(p)
    u1 = np.zeros(p)
    u2 = np.zeros(p)
    for r in rows:
        s = _shift(r, ref, p, nt)
        uc, u1, u2 = uc + s["uc"], u1 + s["u1"], u2 + s["u2"]
    safe = np.where(uc > 0, uc, 1)
    mean = np.where(uc > 0, ref + u1 / safe, 0.0)
    var = np.where(uc > 0, u2 / safe - (u1 / safe) ** 2, np.nan)
    std = np.where(np.isnan(var), 1.0, np.sqrt(np.maximum(var, 0.0)))
    return mean, np.maximum(std, eps)


def standardized_stats(rec: dict, mean: np.ndarray, std: np.ndarray, p: int, nt: int,
                       intercept: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A, B[target, input], C) of the standardised design for one day's moments."""
    s = _shift(rec, mean, p, nt)  # centre on the train mean: v = o∘(x - m)
    inv = 1.0 / std
    Azz = s["Vv"].reshape(p, p) * np.outer(inv, inv)
    bz = s["Bv"].reshape(nt, p) * inv[None, :]
    if not intercept:
        return Azz, bz, s["C"]
    A = np.zeros((p + 1, p + 1))
    A[0, 0] = rec["sw"]
    A[0, 1:] = A[1:, 0] = s["sv"] * inv
    A[1:, 1:] = Azz
    B = np.hstack([s["By"][:, None], bz])
    return A, B, s["C"]
