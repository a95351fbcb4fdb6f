"""Date-based cross-validation scored from prefix sums over the day statistics (§2.J).

A scheme is a table of folds, each with a validation interval and up to two train intervals
of dates:

- ``expanding``  trains on everything before the validation days;
- ``rolling``    trains on the ``train_days`` before them;
- ``blocked``    cuts all dates into ``n_folds`` blocks and trains on both sides of each.

``purge`` dates before and ``embargo`` dates behind the validation days are kept out of the
train intervals. All folds are fitted and scored from one prefix sum over the per-day
statistics (one row per calendar date): an interval is the difference of two rows, so the
cost follows the number of folds and of dates, never that of panel rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.columns import DATE
from tidepanel.plans import wls
from tidepanel.plans.walk_forward import PreparedPanel

SCHEMES = ("expanding", "rolling", "blocked")
FOLD_SCHEMA = "fold long, valid_start int, valid_end int, train_lo int, train_hi int, late_lo int, late_hi int"


def folds(spark: SparkSession, first: int, last: int, scheme: str, n_folds: int, valid_days: int | None = None,
          train_days: int | None = None, purge: int = 0, embargo: int = 0) -> DataFrame:
    """The fold table; ``late_lo..late_hi`` are train dates behind the validation days.

    ``expanding`` and ``rolling`` validate on the last ``n_folds`` stretches of ``valid_days``
    dates; empty train intervals are null, a fold without any is refused.
    """
    if scheme not in SCHEMES:
        raise ValueError(f"no scheme is called {scheme!r}; there are {', '.join(SCHEMES)}")
    if n_folds < 1 or purge < 0 or embargo < 0 or (scheme != "blocked" and not valid_days) or (scheme == "rolling" and not train_days):
        raise ValueError(f"{scheme} with {n_folds} folds, {valid_days} validation and {train_days} train days, purge {purge}, embargo {embargo}")
    rows = []
    for k in range(n_folds):
        if scheme == "blocked":
            lo = first + k * (last - first + 1) // n_folds
            hi = first + (k + 1) * (last - first + 1) // n_folds - 1
        else:
            hi = last - (n_folds - 1 - k) * valid_days
            lo = hi - valid_days + 1
        early = (max(first, lo - purge - train_days) if scheme == "rolling" else first, lo - purge - 1)
        late = (hi + embargo + 1, last) if scheme == "blocked" else (1, 0)
        spans = [s if s[0] <= s[1] else (None, None) for s in (early, late)]
        if lo > hi or lo < first or spans[0][0] is None and spans[1][0] is None:
            raise ValueError(f"fold {k} of {scheme} has no validation or no train dates in {first}..{last}")
        rows.append((k, lo, hi, *spans[0], *spans[1]))
    return spark.createDataFrame(rows, FOLD_SCHEMA)


def _interval_sums(days: DataFrame, spans: DataFrame, cols: list[str]) -> DataFrame:
    """Sums of the day statistics over the intervals (``fold, lo, hi``) of each fold."""
    ends = days.agg(F.min(DATE).alias("a"), F.max(DATE).alias("b"))
    calendar = ends.select(F.explode(F.sequence(F.col("a") - 1, F.col("b"))).alias(DATE))
    upto = Window.orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)  # one row per calendar date
    prefix = calendar.join(days.select(DATE, *cols), DATE, "left").select(
        DATE, *[F.sum(F.coalesce(c, F.lit(0))).over(upto).alias(c) for c in cols])
    sides = F.array(F.struct(F.col("hi").alias(DATE), F.lit(1).alias("sign")), F.struct((F.col("lo") - 1).alias(DATE), F.lit(-1).alias("sign")))
    cuts = spans.where("lo is not null").select("fold", F.inline(sides))
    return cuts.join(prefix, DATE).groupBy("fold").agg(*[F.sum(F.col("sign") * F.col(c)).alias(c) for c in cols])


def score_folds(prep: PreparedPanel, table: DataFrame) -> DataFrame:
    """``fold, valid_start, valid_end, train_rows, valid_rows, r2`` of every fold.

    Uses the features, target, ridge and intercept of ``prep``; its standardiser was fitted
    on one train fold, so leave standardisation off where folds must not share it.
    """
    cfg, p = prep.cfg, prep.p
    cols = wls.stat_columns(p, cfg.targets)
    early = table.select("fold", F.col("train_lo").alias("lo"), F.col("train_hi").alias("hi"))
    late = table.select("fold", F.col("late_lo").alias("lo"), F.col("late_hi").alias("hi"))
    fitted = _interval_sums(prep.days, early.unionByName(late), cols)
    betas = wls.solve_rows(fitted, ["fold", "n"], p, cfg.target, cfg.ridge, cfg.intercept).withColumnRenamed("n", "train_rows")
    valid = _interval_sums(prep.days, table.select("fold", F.col("valid_start").alias("lo"), F.col("valid_end").alias("hi")), cols)
    scored = valid.join(betas, "fold").join(table.select("fold", "valid_start", "valid_end"), "fold")
    c = F.col(f"c_{cfg.target}")
    return scored.select("fold", "valid_start", "valid_end", F.col("train_rows").cast("long").alias("train_rows"), F.col("n").cast("long").alias("valid_rows"),
                         F.when(c > 0, 1 - wls.sse_column(F.col("beta"), p, cfg.target) / c).alias("r2"))
