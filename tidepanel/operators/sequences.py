"""Day-sequence assembly, rectangularity, densify and flatten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.columns import DATE, SYMBOL, TARGET_COLUMN, TIME, WEIGHT_COLUMN


def day_sequences(df: DataFrame, features: list[str], target: str = TARGET_COLUMN,
                  weight: str = WEIGHT_COLUMN, aux: list[str] | None = None,
                  standardizer: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """One row per (date, symbol) holding its time-ordered steps
    ``ARRAY<STRUCT<time_id, x ARRAY<DOUBLE>, aux ARRAY<DOUBLE>, y, w>>``.

    A (date, symbol) group is bounded by the intraday grid, so collecting it is safe;
    no day or symbol is ever collected whole.
    """
    aux = aux or []
    if standardizer is not None:
        # Inputs as the sequence model sees them: z-scored, NULL/NaN -> 0.
        from tidepanel.operators.features import apply_standardizer
        df = apply_standardizer(df, standardizer, features)
    step = F.struct(
        F.col(TIME).alias(TIME),
        F.array(*[F.col(f).cast("double") for f in features]).alias("x"),
        F.array(*[F.col(a).cast("double") for a in aux]).alias("aux"),
        F.col(target).cast("double").alias("y"),
        F.col(weight).cast("double").alias("w"),
    )
    return df.groupBy(DATE, SYMBOL).agg(F.sort_array(F.collect_list(step)).alias("steps"))


def sequence_scalars(seqs: DataFrame) -> DataFrame:
    """Comparable scalars of a sequence: length, first/last time, weighted checksum."""
    s = F.col("steps")
    checksum = F.aggregate(s, F.lit(0.0), lambda acc, e: acc + (e[TIME] + 1) * F.coalesce(e["y"], F.lit(0.0)))
    return seqs.select(DATE, SYMBOL, F.size(s).cast("bigint").alias("seq_len"),
                       F.element_at(s, 1)[TIME].alias("first_time"),
                       F.element_at(s, -1)[TIME].alias("last_time"),
                       checksum.alias("checksum"))


def flatten_sequences(seqs: DataFrame) -> DataFrame:
    """Back to one row per step with ``inline``."""
    return seqs.select(DATE, SYMBOL, F.inline("steps")).select(DATE, TIME, SYMBOL, "x", "aux", "y", "w")


def rectangularity(df: DataFrame) -> DataFrame:
    """Per date rows, symbols, grid size; ``rectangular`` is the exact test
    (rows = symbols x times and every cell distinct), ``divisible`` the weaker
    ``rows % times == 0`` check."""
    per = df.groupBy(DATE).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.countDistinct(SYMBOL).cast("bigint").alias("n_symbols"),
        (F.max(TIME) + 1).cast("bigint").alias("n_times"))
    return per.select("*", (F.col("n_rows") == F.col("n_symbols") * F.col("n_times")).alias("rectangular"),
                      (F.col("n_rows") % F.col("n_times") == 0).alias("divisible"))


def densify_days(df: DataFrame, value_cols: list[str]) -> DataFrame:
    """I02 option: complete every (date, symbol) series to the date's full time grid.

    The grid of a (date, symbol) is generated with ``sequence`` + ``explode`` (no
    cross join); missing cells carry NULL values and ``filled = false``.
    """
    grid_size = df.groupBy(DATE).agg((F.max(TIME) + 1).alias("_n_times"))
    members = df.select(DATE, SYMBOL).distinct().join(grid_size, DATE)
    cells = members.select(DATE, SYMBOL, F.explode(F.sequence(F.lit(0), F.col("_n_times") - 1)).alias(TIME))
    vals = df.select(DATE, TIME, SYMBOL, *value_cols, F.lit(True).alias("filled"))
    out = cells.join(vals.hint("merge"), [DATE, TIME, SYMBOL], "left")  # both grow with the data
    return out.select(DATE, TIME, SYMBOL, *value_cols, F.coalesce("filled", F.lit(False)).alias("filled"))
