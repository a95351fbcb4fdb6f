"""Walk-forward evaluation over a trailing test block, without a loop over the data.

Update strategies (K03-K05, K08, K10, K11, K15, K16), all from one per-day statistics
table (see :mod:`tidepanel.plans.wls`):

- ``full``     version 0 (fit on the train fold) predicts every test day;
- ``retrain``  version v fits train fold + early-stopping holdout + the test days
               revealed before its first day (expanding window, cumulative sums);
- ``refit``    statistics decay: ``A_v = δ·A_{v-1} + (1-δ)·A_new`` (same for b);
- ``continue`` residual fit on the new days: ``β_v = β_{v-1} + (A_new+λI)⁻¹(b_new - A_new β_{v-1})``;
- ``online``   one gradient step of the target loss per update (sgd / fresh AdamW / kept AdamW).

Test day ``i`` (0-based over observed test dates) uses version ``floor(i / cadence)``;
the update before it sees only days already predicted (checked by construction and
by :func:`leakage_guard`).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.columns import DATE, TARGET_COLUMN, WEIGHT_COLUMN
from tidepanel.operators.features import fit_standardizer
from tidepanel.operators.splits import NestedSplit, check_no_leak, nested_split
from tidepanel.plans import wls
from tidepanel.sources.panel import collect_date_range
from tidepanel.session import reliable_checkpoint

VARIANTS = ("full", "retrain", "refit", "continue", "online")


@dataclass
class WalkForwardConfig:
    features: list[str]
    target: str = TARGET_COLUMN
    weight: str = WEIGHT_COLUMN
    test_days: int = 20
    valid_days: int = 12
    gap_days: int = 2
    intercept: bool = True
    standardize: bool = True
    ridge: float = 1e-3
    decay: float = 0.9
    lr: float = 0.01
    weight_decay: float = 0.0
    grad_clip: float = 1.0
    optimizer: str = "sgd"
    extra_targets: list[str] = field(default_factory=list)

    @property
    def targets(self) -> list[str]:
        return [self.target] + [t for t in self.extra_targets if t != self.target]


@dataclass
class PreparedPanel:
    """Day statistics with fold labels plus the split and standardiser used."""

    days: DataFrame
    split: NestedSplit
    standardizer: dict[str, tuple[float, float]] | None
    p: int
    cfg: WalkForwardConfig


def prepare(df: DataFrame, cfg: WalkForwardConfig, checkpoint: bool = True,
            one_pass: bool | None = None) -> PreparedPanel:
    """Split from the observed date range, standardiser fitted on the train fold only,
    and per-day statistics (checkpointed: reused by every variant).

    ``one_pass`` (default for wide models) reads ``df`` once: centred day moments, from
    which the split, the standardiser and the standardised statistics follow exactly
    (:mod:`tidepanel.plans.moments`); otherwise a standardiser pass precedes one
    aggregation of the standardised products.
    """
    p = len(wls.design_names(cfg.features, cfg.intercept))
    if one_pass is None:
        one_pass = p > wls.SQL_MAX_INPUTS
    if one_pass:
        return _prepare_one_pass(df, cfg, p)
    dmin, dmax = collect_date_range(df)
    ns = nested_split(dmin, dmax, cfg.test_days, cfg.valid_days, cfg.gap_days)
    std = None
    if cfg.standardize:
        train = df.where(F.col(DATE).between(ns.train.train_start, ns.train.train_end))
        std = {r["feature"]: (r["mean"], r["std"]) for r in fit_standardizer(train, cfg.features).collect()}
    stats = wls.daily_statistics(df, cfg.features, cfg.targets, cfg.weight, cfg.intercept, std)
    days = _label_days(stats, ns)
    if checkpoint:
        days = reliable_checkpoint(days)
    return PreparedPanel(days, ns, std, p, cfg)


def _label_days(stats: DataFrame, ns: NestedSplit) -> DataFrame:
    d = F.col(DATE)
    fold = (F.when(d >= ns.test_start, "test").when(d >= ns.es_start, "es")
            .when(d > ns.train.train_end, "gap").otherwise("train"))
    labelled = stats.select("*", fold.alias("fold"))
    test_idx = (labelled.where(F.col("fold") == "test").select(DATE)
                .select(DATE, (F.row_number().over(Window.orderBy(DATE)) - 1).cast("bigint").alias("day_index")))
    return labelled.join(test_idx, DATE, "left")


def _prepare_one_pass(df: DataFrame, cfg: WalkForwardConfig, p: int) -> PreparedPanel:
    from tidepanel.plans import moments as MO

    feats, targets = list(cfg.features), cfg.targets
    k, nt = len(feats), len(targets)
    moms = reliable_checkpoint(MO.day_moments(df, feats, targets, cfg.weight))  # one row per date
    rng = moms.agg(F.min(DATE).alias("lo"), F.max(DATE).alias("hi")).first()
    if rng is None or rng["lo"] is None:
        raise ValueError("walk-forward on an empty frame")
    ns = nested_split(int(rng["lo"]), int(rng["hi"]), cfg.test_days, cfg.valid_days, cfg.gap_days)
    lo, hi = ns.train.train_start, ns.train.train_end
    std_schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("mean", T.DoubleType()),
                               T.StructField("std", T.DoubleType())])

    def records(pdf):
        for _, row in pdf.iterrows():
            rec = {f: np.asarray(row[f], dtype=float) for f in MO._FIELDS}
            rec["n"], rec["sw"] = float(row["n"]), float(row["sw"])
            yield int(row[DATE]), rec

    def fit_std(pdf: pd.DataFrame) -> pd.DataFrame:
        train = [r for d, r in records(pdf) if lo <= d <= hi]
        if cfg.standardize:
            mean, std = MO.standardizer_from_moments(train, k, nt)
        else:
            mean, std = np.zeros(k), np.ones(k)
        return pd.DataFrame({"feature": feats, "mean": mean, "std": std})

    # Train-fold moments only: one group, bounded by the number of dates.
    std_df = moms.groupBy(F.lit(1).alias("_g")).applyInPandas(fit_std, std_schema)
    std_rows = {r["feature"]: (r["mean"], r["std"]) for r in std_df.collect()}  # one row per input
    mean = np.array([std_rows[f][0] for f in feats])
    sd = np.array([std_rows[f][1] for f in feats])
    cols = wls.stat_columns(p, targets)
    out_schema = T.StructType([T.StructField(DATE, T.IntegerType()), T.StructField("n", T.LongType())]
                              + [T.StructField(c, T.DoubleType()) for c in cols[1:]])
    iu = np.triu_indices(p)

    def to_stats(batches):
        for pdf in batches:
            rows = []
            for d, rec in records(pdf):
                A, B, C = MO.standardized_stats(rec, mean, sd, k, nt, cfg.intercept)
                rows.append([d, int(rec["n"]), *C.tolist(), *B.reshape(-1).tolist(), *A[iu].tolist()])
            if rows:
                yield pd.DataFrame(rows, columns=[DATE] + cols)

    stats = moms.mapInPandas(to_stats, out_schema)
    days = reliable_checkpoint(_label_days(stats, ns))
    return PreparedPanel(days, ns, std_rows if cfg.standardize else None, p, cfg)


def _version_of_new_data(cadence: int, include_es: bool) -> F.Column:
    """Smallest model version whose fit set contains a day."""
    v = (F.when(F.col("fold") == "train", F.lit(0))
         .when(F.col("fold") == "test", F.floor(F.col("day_index") / cadence) + 1))
    if include_es:
        v = F.when(F.col("fold") == "es", F.lit(1)).otherwise(v)
    return v.cast("bigint")


def _sum_stats(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.sum(c).alias(c) for c in cols])


def version_betas(prep: PreparedPanel, variant: str, cadence: int) -> DataFrame:
    """(version, beta) for every model version a variant uses (a table of ≤ test_days rows)."""
    cfg, p = prep.cfg, prep.p
    cols = wls.stat_columns(p, cfg.targets)
    if variant == "full":
        v0 = prep.days.where(F.col("fold") == "train").agg(*[F.sum(c).alias(c) for c in cols])
        return wls.solve_rows(v0.select(F.lit(0).cast("bigint").alias("version"), *cols),
                              ["version"], p, cfg.target, cfg.ridge, cfg.intercept)
    if variant == "retrain":
        tagged = prep.days.select("*", _version_of_new_data(cadence, True).alias("version"))
        per = _sum_stats(tagged.where(F.col("version").isNotNull()), "version", cols)
        # Expanding fit sets = cumulative sums over versions (a table of ≤ test_days rows).
        cum = Window.orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
        expanding = per.select("version", *[F.sum(c).over(cum).alias(c) for c in cols])
        return wls.solve_rows(expanding, ["version"], p, cfg.target, cfg.ridge, cfg.intercept)
    if variant in ("refit", "continue", "online"):
        tagged = prep.days.select("*", _version_of_new_data(cadence, False).alias("version"))
        per = _sum_stats(tagged.where(F.col("version").isNotNull()), "version", cols)
        return _recursive_versions(per, variant, prep)
    raise ValueError(f"unknown variant {variant!r}; choose from {VARIANTS}")


def _recursive_versions(per: DataFrame, variant: str, prep: PreparedPanel) -> DataFrame:
    """Sequential strategies: one ``applyInPandas`` group walks the versions.

    Its input is the per-version statistics table (≤ test_days + 1 rows of p² numbers),
    not panel rows.
    """
    cfg, p = prep.cfg, prep.p
    target = cfg.target
    schema = T.StructType([T.StructField("version", T.LongType(), False),
                           T.StructField("beta", T.ArrayType(T.DoubleType()), False)])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {int(r["version"]): wls.unpack(r, p, [target]) for _, r in pdf.iterrows()}
        betas = recursive_betas(rows, variant, cfg, p)
        return pd.DataFrame(sorted(betas.items()), columns=["version", "beta"]).assign(
            beta=lambda x: x["beta"].map(list))

    return per.withColumn("_g", F.lit(variant)).groupBy("_g").applyInPandas(
        lambda pdf: walk(pdf.drop(columns=["_g"])), schema)


def recursive_betas(rows: dict[int, tuple], variant: str, cfg: WalkForwardConfig, p: int) -> dict[int, np.ndarray]:
    """Sequential strategies on per-version statistics ``rows[v] = (A, b, c)``; version
    0 holds the train fold, version v >= 1 the test days revealed before version v."""
    target = cfg.target
    A0, b0, _ = rows[0]
    beta = wls.ridge_solve(A0, b0[target], cfg.ridge, cfg.intercept)
    A, b = A0.copy(), b0[target].copy()
    out = {0: beta}
    m, s, step = np.zeros(p), np.zeros(p), 0
    for v in range(1, max(rows) + 1):
        if v not in rows:
            out[v] = beta
            continue
        An, bn, cn = rows[v]
        if variant == "refit":
            A = cfg.decay * A + (1 - cfg.decay) * An
            b = cfg.decay * b + (1 - cfg.decay) * bn[target]
            beta = wls.ridge_solve(A, b, cfg.ridge, cfg.intercept)
        elif variant == "continue":
            beta = beta + wls.ridge_solve(An, bn[target] - An @ beta, cfg.ridge, cfg.intercept)
        elif variant == "online":
            g = 2.0 * (An @ beta - bn[target]) / max(cn[target], 1e-6)
            gn = float(np.linalg.norm(g))
            if cfg.grad_clip and gn > cfg.grad_clip:
                g = g * (cfg.grad_clip / gn)
            beta = beta * (1.0 - cfg.lr * cfg.weight_decay)
            if cfg.optimizer == "sgd":
                beta = beta - cfg.lr * g
            else:
                if cfg.optimizer == "adamw_fresh":
                    m, s, step = np.zeros(p), np.zeros(p), 0
                step += 1
                m = 0.9 * m + 0.1 * g
                s = 0.999 * s + 0.001 * g * g
                mh, sh = m / (1 - 0.9 ** step), s / (1 - 0.999 ** step)
                beta = beta - cfg.lr * mh / (np.sqrt(sh) + 1e-8)
        else:
            raise ValueError(f"not a sequential variant: {variant!r}")
        out[v] = beta
    return out


SUITE_SCHEMA = T.StructType([
    T.StructField("variant", T.StringType()), T.StructField("cadence", T.LongType()),
    T.StructField("n_updates", T.LongType()), T.StructField("test_days", T.LongType()),
    T.StructField("test_rows", T.LongType()), T.StructField("score", T.DoubleType())])


def save_betas(betas: DataFrame, path: str) -> None:
    """A15 for linear models: (version, beta) coefficients as parquet."""
    betas.write.mode("overwrite").parquet(path)


def score_suite(prep: PreparedPanel, specs: list[tuple[str, int]], eval_fold: str = "test") -> DataFrame:
    """Every (variant, cadence) in one pass over the day-statistics table.

    The table has one row per date (p² numbers each), so all strategies, their model
    versions and block scores are evaluated in a single ``applyInPandas`` group; the
    panel rows were reduced by Spark beforehand. Same numbers as
    :func:`score_variant`, with one Python stage instead of one per variant.
    """
    cfg, p = prep.cfg, prep.p
    target = cfg.target

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(DATE)
        st = {int(r[DATE]): (r["fold"], r["day_index"], int(r["n"]), wls.unpack(r, p, [target]))
              for _, r in pdf.iterrows()}
        # Evaluation days in date order; ``es`` gives validation with online updates.
        test = list(enumerate(sorted(d for d, v in st.items() if v[0] == eval_fold)))
        if not test:
            raise ValueError(f"the {eval_fold} block is empty")

        def total(days):
            A = np.zeros((p, p))
            b = np.zeros(p)
            c = 0.0
            for d in days:
                Ad, bd, cd = st[d][3]
                A, b, c = A + Ad, b + bd[target], c + cd[target]
            return A, {target: b}, {target: c}

        train = [d for d, v in st.items() if v[0] == "train"]
        es = [d for d, v in st.items() if v[0] == "es"]
        out = []
        for variant, cad in specs:
            k = 1 if variant == "full" else cad
            n_ver = (len(test) - 1) // k + 1
            chunks = {v + 1: [d for i, d in test if i // k == v] for v in range(n_ver)}
            if variant == "full":
                betas = {0: wls.ridge_solve(total(train)[0], total(train)[1][target], cfg.ridge, cfg.intercept)}
            elif variant == "retrain":
                betas = {}
                A, b = total(train)[0], total(train)[1][target]
                for v in range(n_ver):
                    if v >= 1:  # each day is added once
                        fresh = total((es if v == 1 and eval_fold == "test" else []) + chunks[v])
                        A, b = A + fresh[0], b + fresh[1][target]
                    betas[v] = wls.ridge_solve(A, b, cfg.ridge, cfg.intercept)
            else:
                rows = {0: total(train)}
                rows.update({v: total(chunks[v]) for v in range(1, n_ver)})
                betas = recursive_betas(rows, variant, cfg, p)
            sse = sst = 0.0
            nrows = 0
            for i, d in test:
                beta = betas[0 if variant == "full" else i // k]
                Ad, bd, cd = st[d][3]
                sse += cd[target] - 2 * beta @ bd[target] + beta @ Ad @ beta
                sst += cd[target]
                nrows += st[d][2]
            if not sst > 0:
                raise ValueError(f"the weighted sum of squared targets is {sst}: no score is defined")
            out.append((variant, 0 if variant == "full" else cad, 0 if variant == "full" else n_ver - 1,
                        len(test), nrows, 1 - sse / sst))
        return pd.DataFrame(out, columns=[f.name for f in SUITE_SCHEMA.fields])

    return prep.days.groupBy(F.lit(1).alias("_g")).applyInPandas(run, SUITE_SCHEMA)


def score_variant(prep: PreparedPanel, variant: str, cadence: int = 1) -> DataFrame:
    """One summary row: variant, cadence, n_updates, test_days, test_rows, score."""
    if cadence < 1:
        raise ValueError(f"a cadence of {cadence} days cannot be scheduled")
    cad = 1 if variant == "full" else cadence
    betas = version_betas(prep, variant, cad)
    test = prep.days.where(F.col("fold") == "test")
    # A computed key even for the static model (a literal key would plan as a cross join).
    version = (F.col("day_index") * 0 if variant == "full" else F.floor(F.col("day_index") / cad)).cast("bigint")
    scored = test.select("*", version.alias("version")).join(betas, "version", "inner")
    sse = wls.sse_column(F.col("beta"), prep.p, prep.cfg.target)
    c = F.col(f"c_{prep.cfg.target}")
    agg = scored.agg(F.sum(sse).alias("sse"), F.sum(c).alias("sst"),
                     F.count(F.lit(1)).cast("bigint").alias("test_days"),
                     F.sum("n").cast("bigint").alias("test_rows"),
                     F.max("version").cast("bigint").alias("n_updates"))
    return agg.select(F.lit(variant).alias("variant"),
                      F.lit(0 if variant == "full" else cadence).cast("bigint").alias("cadence"),
                      "n_updates", "test_days", "test_rows",
                      (1 - F.col("sse") / F.col("sst")).alias("score"))


def leakage_guard(prep: PreparedPanel, cadence: int) -> DataFrame:
    """Compares the days every version was fitted on with the days it predicts.

    The fit set of a version are the days whose own version tag is not larger (train,
    then early stopping, then revealed test days), as in :func:`version_betas`.
    """
    fitted = prep.days.select(DATE, _version_of_new_data(cadence, True).alias("version")).where(F.col("version").isNotNull())
    predicted = prep.days.where(F.col("fold") == "test").select(DATE, F.floor(F.col("day_index") / cadence).cast("bigint").alias("version"))
    return check_no_leak(fitted, predicted)


def predictions(df: DataFrame, prep: PreparedPanel, variant: str, cadence: int = 1) -> DataFrame:
    """Row-level out-of-sample predictions of the test block.

    The version table is bounded by the number of test days and the day -> version
    map by the number of dates, so both are broadcast; panel rows are not shuffled.
    """
    cad = 1 if variant == "full" else cadence
    betas = version_betas(prep, variant, cad)
    day_version = prep.days.where(F.col("fold") == "test").select(
        DATE, (F.col("day_index") * 0 if variant == "full" else F.floor(F.col("day_index") / cad)).cast("bigint")
        .alias("version"))
    xs = wls.design_columns(prep.cfg.features, prep.cfg.intercept, prep.standardizer)
    test = df.where(F.col(DATE) >= prep.split.test_start)  # reaches the scan
    rows = test.join(F.broadcast(day_version), DATE, "inner").join(F.broadcast(betas), "version", "inner")
    return rows.select(DATE, "time_id", "symbol_id", prep.cfg.target, prep.cfg.weight,
                       wls.predict_column(F.col("beta"), xs).alias("prediction"))


