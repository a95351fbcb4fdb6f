"""Scoring: sample-weighted zero-mean R² and distribution summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.columns import DATE, TARGET_COLUMN, WEIGHT_COLUMN
from tidepanel.functions.exprs import is_finite


def r2_parts(pred: str, target: str = TARGET_COLUMN, weight: str = WEIGHT_COLUMN) -> list[Column]:
    """Additive pieces of the metric: Σw(y-ŷ)², Σwy², non-finite count, rows."""
    y, p, w = F.col(target), F.col(pred), F.col(weight)
    bad = ~is_finite(y) | ~is_finite(p) | ~is_finite(w)
    return [F.sum(w * (y - p) * (y - p)).alias("sse"), F.sum(w * y * y).alias("sst"),
            F.count_if(bad).alias("n_bad"), F.count(F.lit(1)).cast("bigint").alias("n_rows")]


def r2_from_parts(sse: Column, sst: Column, n_bad: Column | None = None) -> Column:
    """``1 - sse/sst``; raises inside the plan on non-finite input or ``sst <= 0``."""
    checked = F.when(sst <= 0, F.raise_error(F.format_string(
        "the weighted sum of squared targets is %s: no score is defined", sst.cast("string"))))
    if n_bad is not None:
        checked = F.when(n_bad > 0, F.raise_error(F.lit("a target, prediction or weight is not finite"))).otherwise(
            checked.otherwise(1 - sse / sst))
        return checked
    return checked.otherwise(1 - sse / sst)


def weighted_r2(df: DataFrame, pred: str, target: str = TARGET_COLUMN, weight: str = WEIGHT_COLUMN,
                by: list[str] | None = None) -> DataFrame:
    """``1 - Σw(y-ŷ)² / Σwy²`` overall or per group (``by``); one aggregation."""
    parts = r2_parts(pred, target, weight)
    agg = df.groupBy(*by).agg(*parts) if by else df.agg(*parts)
    return agg.select(*(by or []), "n_rows",
                      r2_from_parts(F.col("sse"), F.col("sst"), F.col("n_bad")).alias("r2"))


def distribution_summary(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """Mean, population std, min, max; zeros for an empty input."""
    return df.agg(F.coalesce(F.avg(col), F.lit(0.0)).alias(f"{prefix}_mean"),
                  F.coalesce(F.stddev_pop(col), F.lit(0.0)).alias(f"{prefix}_std"),
                  F.coalesce(F.min(col).cast("double"), F.lit(0.0)).alias(f"{prefix}_min"),
                  F.coalesce(F.max(col).cast("double"), F.lit(0.0)).alias(f"{prefix}_max"))


def daily_loss(df: DataFrame, pred: str, target: str = TARGET_COLUMN, weight: str = WEIGHT_COLUMN,
               eps: float = 1e-6) -> DataFrame:
    """Per-date training loss ``Σw(ŷ-y)² / max(Σwy², eps)``."""
    y, p, w = F.col(target), F.col(pred), F.col(weight)
    return df.groupBy(DATE).agg(
        (F.sum(w * (p - y) * (p - y)) / F.greatest(F.sum(w * y * y), F.lit(eps))).alias("loss"))


def over_clip(df: DataFrame, pred: str, bound: float = 5.0) -> DataFrame:
    """Number of predictions outside ±bound."""
    return df.agg(F.count_if(F.abs(F.col(pred)) > bound).cast("bigint").alias("n_over_clip"),
                  F.count(F.lit(1)).cast("bigint").alias("n_rows"))
