"""Data-quality profiles and audits.

Every profile is one aggregation pass with map-side combine (partial aggregates per
task, a tiny final merge), then an ``unpivot`` of the one-row result when a long
table is wanted. Nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.columns import DATE, FEATURE_COLUMNS, RESPONDER_COLUMNS, SYMBOL, TARGET_COLUMN, TIME, WEIGHT_COLUMN
from tidepanel.functions.exprs import is_finite


def _summary(col: str, prefix: str) -> list:
    return [F.avg(col).alias(f"{prefix}_mean"), F.stddev_samp(col).alias(f"{prefix}_std"),
            F.min(col).alias(f"{prefix}_min"), F.max(col).alias(f"{prefix}_max")]


def profile_summary(df: DataFrame, target: str = TARGET_COLUMN, weight: str = WEIGHT_COLUMN) -> DataFrame:
    """Mean / std (ddof 1) / min / max of target and weight."""
    aggs = []
    if target in df.columns:
        aggs += _summary(target, "target")
    if weight in df.columns:
        aggs += _summary(weight, "weight")
    return df.agg(*aggs)


def _n_unique(col: str, approx: bool) -> F.Column:
    # Null counts as a value (polars ``n_unique`` semantics).
    base = F.approx_count_distinct(col) if approx else F.countDistinct(col)
    return (base + F.max(F.col(col).isNull().cast("int"))).cast("bigint")


def profile_ids(df: DataFrame, approx: bool = False) -> DataFrame:
    """Row count, date min/max, symbol and time ``n_unique`` in one pass."""
    aggs = [F.count(F.lit(1)).cast("bigint").alias("row_count")]
    if DATE in df.columns:
        aggs += [F.min(DATE).alias("date_min"), F.max(DATE).alias("date_max")]
    if SYMBOL in df.columns:
        aggs.append(_n_unique(SYMBOL, approx).alias("symbol_n_unique"))
    if TIME in df.columns:
        aggs.append(_n_unique(TIME, approx).alias("time_n_unique"))
    return df.agg(*aggs)


def unpivot_one_row(wide: DataFrame, names: list[str], name_col: str, value_col: str,
                    with_ordinal: bool = True) -> DataFrame:
    """Long form of a one-row frame: (name, ordinal, value)."""
    structs = [F.struct(F.lit(n).alias(name_col), F.lit(i).cast("bigint").alias("ordinal"),
                        F.col(n).alias(value_col)) for i, n in enumerate(names)]
    out = wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    return out if with_ordinal else out.drop("ordinal")


def missing_ratio(df: DataFrame, features: list[str] | None = None, top: int | None = 30) -> DataFrame:
    """Null ratio per feature, highest first, ties by column order; top-k."""
    feats = features or [c for c in FEATURE_COLUMNS if c in df.columns]
    wide = df.agg(*[F.avg(F.col(f).isNull().cast("double")).alias(f) for f in feats])
    long = unpivot_one_row(wide, feats, "feature", "missing_ratio")
    long = long.select("feature", "ordinal", F.coalesce("missing_ratio", F.lit(0.0)).alias("missing_ratio"))
    ordered = long.orderBy(F.desc("missing_ratio"), F.asc("ordinal"))
    return ordered.limit(top) if top else ordered


def responder_clip(df: DataFrame, responders: list[str] | None = None, bound: float = 5.0) -> DataFrame:
    """Per-responder min / max and whether all values lie in [-bound, bound]."""
    resp = responders or [c for c in RESPONDER_COLUMNS if c in df.columns]
    aggs = []
    for r in resp:
        aggs += [F.min(r).alias(f"mn_{r}"), F.max(r).alias(f"mx_{r}")]
    wide = df.agg(*aggs)
    structs = [F.struct(F.lit(r).alias("responder"), F.col(f"mn_{r}").alias("min"),
                        F.col(f"mx_{r}").alias("max")) for r in resp]
    long = wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    return long.withColumn("clipped", (F.col("min") >= -bound) & (F.col("max") <= bound))


def tags_long(tags: DataFrame, key_col: str) -> DataFrame:
    """Wide boolean tag table -> (key, tag, value) via ``unpivot``."""
    tag_cols = [c for c in tags.columns if c.startswith("tag_")]
    return tags.unpivot([key_col], tag_cols, "tag", "value")


def tag_counts(tags: DataFrame, key_col: str) -> DataFrame:
    """True / false count per tag."""
    return (tags_long(tags, key_col).groupBy("tag")
            .agg(F.count_if(F.col("value")).cast("bigint").alias("n_true"),
                 F.count_if(~F.col("value")).cast("bigint").alias("n_false")))


def tag_groups(tags: DataFrame, key_col: str) -> DataFrame:
    """Members of each tag, as a long (tag, member) table.

    A tag can hold most of the keys, so members are never collected into one row;
    consumers that want a list aggregate a bounded slice themselves.
    """
    return tags_long(tags, key_col).where(F.col("value")).select("tag", F.col(key_col).alias("member"))


def tags_per_row(tags: DataFrame, key_col: str) -> DataFrame:
    """Active tags of every key: count and ``|``-joined names in column order."""
    tag_cols = [c for c in tags.columns if c.startswith("tag_")]
    active = F.filter(F.array(*[F.when(F.col(t), F.lit(t)) for t in tag_cols]), lambda x: x.isNotNull())
    return tags.select(key_col, F.size(active).cast("bigint").alias("n_tags"),
                       F.array_join(active, "|").alias("tags"))


def weight_constancy(df: DataFrame) -> DataFrame:
    """Per date, how many symbols keep one weight over the whole day."""
    per = df.groupBy(DATE, SYMBOL).agg((F.min(WEIGHT_COLUMN) == F.max(WEIGHT_COLUMN)).alias("const"))
    return per.groupBy(DATE).agg(F.count(F.lit(1)).cast("bigint").alias("n_symbols"),
                                 F.count_if("const").cast("bigint").alias("n_constant"))


def universe_growth(df: DataFrame, warmup_feature: str = "feature_06") -> DataFrame:
    """Universe size, time grid size and warm-up null ratio per date."""
    return df.groupBy(DATE).agg(
        F.countDistinct(SYMBOL).cast("bigint").alias("n_symbols"),
        (F.max(TIME) + 1).cast("bigint").alias("grid_size"),
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.avg(F.col(warmup_feature).isNull().cast("double")).alias("warmup_null_ratio"))


def hollow_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per numeric column, any non-zero value and the non-null count."""
    cols = columns or [f.name for f in df.schema.fields
                       if f.dataType.typeName() in ("double", "float", "integer", "long")]
    aggs = []
    for c in cols:
        aggs += [F.coalesce(F.bool_or(F.col(c) != 0), F.lit(False)).alias(f"nz_{c}"),
                 F.count(c).cast("bigint").alias(f"nn_{c}")]
    wide = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"nz_{c}").alias("any_nonzero"),
                        F.col(f"nn_{c}").alias("non_null")) for c in cols]
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def finite_check(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column, whether every non-null value is finite, and the count that is not."""
    aggs = []
    for c in columns:
        bad = F.col(c).isNotNull() & ~is_finite(c)
        aggs += [F.count_if(bad).cast("bigint").alias(f"bad_{c}")]
    wide = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"bad_{c}").alias("n_non_finite"),
                        (F.col(f"bad_{c}") == 0).alias("all_finite")) for c in columns]
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def contract_report(df: DataFrame, required: list[str], sample_rows: int = 5) -> DataFrame:
    """One-row expectation frame: columns present / missing, row count, date
    bounds, sample readability and an overall pass flag. The column check is
    plan-time; the data part is a single aggregation."""
    missing = [c for c in required if c not in df.columns]
    present = [c for c in required if c in df.columns]
    date_aggs = ([F.min(DATE).alias("date_min"), F.max(DATE).alias("date_max")] if DATE in df.columns
                 else [F.lit(None).cast("int").alias("date_min"), F.lit(None).cast("int").alias("date_max")])
    out = df.agg(F.count(F.lit(1)).cast("bigint").alias("row_count"), *date_aggs)
    return out.select(
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.lit(len(present)).cast("bigint").alias("n_required_present"),
        F.lit(len(missing)).cast("bigint").alias("n_required_missing"),
        F.lit("|".join(missing)).alias("missing_columns"),
        "row_count", "date_min", "date_max",
        F.least(F.col("row_count"), F.lit(sample_rows)).cast("bigint").alias("sample_rows"),
        ((F.lit(len(missing)) == 0) & (F.col("row_count") > 0)).alias("passed"),
    )
