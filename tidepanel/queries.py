"""Registered queries over the provided tables, and their DuckDB oracle SQL.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the *whole* derived
panel (or tags / events). Oracle SQL strings run on DuckDB against the same parquet
tables; ``PANEL`` / ``TAGS`` prefix them with the shared derivation.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.columns import ID_COLUMNS, LAG_COLUMNS, RESPONDER_COLUMNS
from tidepanel.operators import features as FE
from tidepanel.operators import metrics as ME
from tidepanel.operators import profile as PR
from tidepanel.operators import sequences as SQ
from tidepanel.operators import splits as SP
from tidepanel.plans import walk_forward as WF
from tidepanel.session import checkpoint_path, ensure_checkpoint_dir, ship_package
from tidepanel.sources import fixtures as FX
from tidepanel.sources import panel as PN

# Experiment settings for the 83-date panel (FIXTURES §2.2).
TEST_DAYS, VALID_DAYS, GAP_DAYS = 20, 12, 2
W_SMALL, W_LARGE = 10, 250
PANEL_FEATURES = [f"feature_{i:02d}" for i in range(8)]
ROLL_FEATURES = ["feature_00", "feature_04", "feature_06", "feature_07"]
IDS = ", ".join(ID_COLUMNS)

PANEL = f"WITH panel AS ({FX.PANEL_SQL})"
TAGS = f"WITH tags AS ({FX.TAGS_SQL})"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            ship_package(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return run
    return deco


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.load_panel(spark, sf_dir)


def r6(c):
    return F.round(c, 6)


# ------------------------------------------------------------------ sources (A)
@query("scan_panel_range", f"""{PANEL}
SELECT {IDS}, feature_00, feature_04, weight, responder_6 FROM panel WHERE date_id BETWEEN 10 AND 20""")
def scan_panel_range(spark, sf):
    """Checked scan of the stored panel with bounds and a projection."""
    path = FX.panel_path(spark, sf)
    return PN.read_panel(spark, path, ID_COLUMNS + ["feature_00", "feature_04", "weight", "responder_6"], 10, 20)


@query("footer_probe", f"{PANEL} SELECT min(time_id) AS lo, max(time_id) AS hi, CAST(count(*) AS BIGINT) AS n_rows FROM panel")
def footer_probe(spark, sf):
    """Bounds and row count of the stored panel from its file footers."""
    return PN.footer_probe(spark, FX.panel_path(spark, sf), "time_id")


@query("date_range", f"{PANEL} SELECT min(date_id) AS date_min, max(date_id) AS date_max FROM panel")
def date_range(spark, sf):
    """A06."""
    return PN.date_range(panel(spark, sf))


@query("head_sample", f"{PANEL} SELECT * FROM panel ORDER BY date_id, time_id, symbol_id LIMIT 5")
def head_sample(spark, sf):
    """Deterministic first rows (top-k by key)."""
    return PN.head_sample(panel(spark, sf), 5)


@query("slice_stats", f"""{PANEL}
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(21 AS BIGINT) AS columns, min(date_id) AS date_min,
       max(date_id) AS date_max FROM panel WHERE date_id BETWEEN 30 AND 40""")
def slice_stats(spark, sf):
    """Extract a date slice to parquet (overwrite guard) and report what was written."""
    out = checkpoint_path(spark, f"slice_{uuid.uuid4().hex[:10]}")
    return PN.extract_slice(panel(spark, sf), out, 30, 40, overwrite=False)


@query("filter_date_range", f"{PANEL} SELECT {IDS}, responder_6 FROM panel WHERE date_id >= 70")
def filter_date_range(spark, sf):
    """Open-ended inclusive range filter."""
    return PN.filter_date_range(panel(spark, sf), "date_id", 70, None).select(*ID_COLUMNS, "responder_6")


@query("aux_placeholder", f"""{PANEL}
SELECT {IDS}, responder_6, responder_6 AS responder_7, responder_6 AS responder_8 FROM panel""")
def aux_placeholder(spark, sf):
    """Absent responder_7/8 filled from the target."""
    p = panel(spark, sf).drop("responder_7", "responder_8")
    return FE.add_placeholders(p, ["responder_7", "responder_8"]).select(
        *ID_COLUMNS, "responder_6", "responder_7", "responder_8")


def _schema_presence_sql() -> str:
    from tidepanel.operators.schema import PRESENCE_REQUIRED, _family
    vals = ", ".join(f"('{c}', '{_family(c)}', {i})" for i, c in enumerate(PRESENCE_REQUIRED))
    return (f"{PANEL}, d AS (SELECT column_name, column_type FROM (DESCRIBE SELECT * FROM panel)), "
            f"r AS (SELECT * FROM (VALUES {vals}) t(\"column\", family, ordinal)), "
            f"u AS (SELECT name, count(value) AS n FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM panel) ON COLUMNS(*)) GROUP BY name) "
            f"SELECT r.\"column\", r.family, CAST(r.ordinal AS BIGINT) AS ordinal, d.column_name IS NOT NULL AS present, "
            f"CAST(coalesce(u.n, 0) AS BIGINT) AS n_values, "
            f"CASE WHEN d.column_type = 'INTEGER' THEN 'int' ELSE lower(d.column_type) END AS dtype "
            f"FROM r LEFT JOIN d ON d.column_name = r.\"column\" LEFT JOIN u ON u.name = r.\"column\"")


@query("schema_presence", _schema_presence_sql())
def schema_presence(spark, sf):
    """Column-contract report with the non-null values of every column."""
    from tidepanel.operators.schema import schema_presence as sp
    return sp(spark, panel(spark, sf))


# ------------------------------------------------------------------ features (C/E)
_lag_cols = ", ".join(f"l.{r} AS {r}_lag_1" for r in RESPONDER_COLUMNS)


@query("responder_lag", f"""{PANEL.replace(" AS (", " AS MATERIALIZED (", 1)}
SELECT p.date_id, p.time_id, p.symbol_id, p.responder_6, {_lag_cols}
FROM panel p LEFT JOIN panel l
  ON l.date_id + 1 = p.date_id AND l.time_id = p.time_id AND l.symbol_id = p.symbol_id""")
def responder_lag(spark, sf):
    """Previous-day responders by self left join."""
    return FE.responder_lag(panel(spark, sf)).select(
        *ID_COLUMNS, "responder_6", *[f"{r}_lag_1" for r in RESPONDER_COLUMNS])


_mkt_sql = ", ".join(f"avg({f}) OVER (PARTITION BY date_id, time_id) AS {f}_mkt" for f in PANEL_FEATURES)


@query("market_avg", f"{PANEL} SELECT {IDS}, {_mkt_sql} FROM panel")
def market_avg(spark, sf):
    """Cross-sectional mean per (date, time)."""
    out = FE.market_average(panel(spark, sf), PANEL_FEATURES)
    return out.select(*ID_COLUMNS, *[f"{f}_mkt" for f in PANEL_FEATURES])


def _roll_sql(w: int, mean: bool, std: bool) -> str:
    frame = f"OVER (PARTITION BY symbol_id ORDER BY date_id, time_id ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    cols = []
    for f in ROLL_FEATURES:
        if mean:
            cols.append(f"avg({f}) {frame} AS {f}_roll_mean")
        if std:
            cols.append(f"round(coalesce(stddev_samp({f}) {frame}, 0.0), 6) AS {f}_roll_std")
    return f"{PANEL} SELECT {IDS}, {', '.join(cols)} FROM panel"


def _roll(spark, sf, w, mean, std):
    # (date, time, symbol) is unique in the panel: no other column decides the order
    out = FE.rolling_stats(panel(spark, sf).select(*ID_COLUMNS, *ROLL_FEATURES), ROLL_FEATURES, window=w)
    cols = []
    for f in ROLL_FEATURES:
        if mean:
            cols.append(F.col(f"{f}_roll_mean"))
        if std:
            cols.append(r6(F.col(f"{f}_roll_std")).alias(f"{f}_roll_std"))
    return out.select(*ID_COLUMNS, *cols)


@query("rolling_mean", _roll_sql(W_SMALL, True, False))
def rolling_mean(spark, sf):
    """Trailing 10-row mean per symbol (block prefix sums + position join)."""
    return _roll(spark, sf, W_SMALL, True, False)


@query("rolling_std", _roll_sql(W_SMALL, False, True))
def rolling_std(spark, sf):
    """Trailing 10-row sample std per symbol, null -> 0."""
    return _roll(spark, sf, W_SMALL, False, True)


@query("rolling_mean_prefix", _roll_sql(W_LARGE, True, True))
def rolling_mean_prefix(spark, sf):
    """E02/E03 with a 250-row window: cost independent of the window length."""
    return _roll(spark, sf, W_LARGE, True, True)


@query("rolling_w1000", _roll_sql(1000, True, True))
def rolling_w1000(spark, sf):
    """E02/E03 with the default window of 1000 rows."""
    return _roll(spark, sf, 1000, True, True)


_AUX_SQL = """coalesce(responder_8 + lead(responder_8, 4) OVER s, 0.0) AS responder_9,
  coalesce(responder_6 + lead(responder_6, 20) OVER s + lead(responder_6, 40) OVER s, 0.0) AS responder_10"""


@query("aux_targets", f"""{PANEL}
SELECT {IDS}, {_AUX_SQL} FROM panel WINDOW s AS (PARTITION BY symbol_id ORDER BY date_id, time_id)""")
def aux_targets(spark, sf):
    """Forward-shift auxiliary targets."""
    return FE.add_aux_targets(panel(spark, sf).select(*ID_COLUMNS, "responder_6", "responder_8")).select(*ID_COLUMNS, "responder_9", "responder_10")


_STD_CTE = ("stats AS (SELECT " + ", ".join(
    f"coalesce(avg({f}), 0.0) AS m_{f}, greatest(coalesce(stddev_pop({f}), 1.0), 1e-6) AS s_{f}"
    for f in PANEL_FEATURES) + " FROM panel, bounds WHERE date_id <= train_end)")
_BOUNDS_CTE = (f"bounds AS (SELECT min(date_id) AS dmin, max(date_id) AS dmax, "
               f"max(date_id) - {TEST_DAYS} + 1 AS test_start, max(date_id) - {TEST_DAYS} - {VALID_DAYS} + 1 AS es_start, "
               f"max(date_id) - {TEST_DAYS} - {VALID_DAYS} - {GAP_DAYS} AS train_end FROM panel)")


def _bounds(df: DataFrame) -> SP.NestedSplit:
    dmin, dmax = PN.collect_date_range(df)
    return SP.nested_split(dmin, dmax, TEST_DAYS, VALID_DAYS, GAP_DAYS)


@query("standardizer_fit", f"""{PANEL}, {_BOUNDS_CTE}
SELECT feature, mean, round(std, 6) AS std FROM (""" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, coalesce(avg({f}), 0.0) AS mean, greatest(coalesce(stddev_pop({f}), 1.0), 1e-6) AS std "
    f"FROM panel, bounds WHERE date_id <= train_end" for f in PANEL_FEATURES) + ")")
def standardizer_fit(spark, sf):
    """NaN-aware mean / population std on the train fold, (0, 1) when all null."""
    p = panel(spark, sf)
    ns = _bounds(p)
    st = FE.fit_standardizer(p.where(F.col("date_id") <= ns.train.train_end), PANEL_FEATURES)
    return st.select("feature", "mean", r6(F.col("std")).alias("std"))


@query("standardize_apply", f"""{PANEL}, {_BOUNDS_CTE}, {_STD_CTE}
SELECT {IDS}, """ + ", ".join(
    f"round(coalesce(({f} - m_{f}) / s_{f}, 0.0), 6) AS {f}" for f in PANEL_FEATURES) + " FROM panel, stats")
def standardize_apply(spark, sf):
    """Z-score with train-fold statistics, NULL/NaN -> 0."""
    p = panel(spark, sf)
    ns = _bounds(p)
    st = FE.fit_standardizer(p.where(F.col("date_id") <= ns.train.train_end), PANEL_FEATURES)
    z = FE.apply_standardizer(p, st, PANEL_FEATURES)
    return z.select(*ID_COLUMNS, *[r6(F.col(f)).alias(f) for f in PANEL_FEATURES])


@query("model_frame", f"""{PANEL}
SELECT p.date_id, p.time_id, p.symbol_id, p.feature_00, p.weight, p.responder_6,
  coalesce(p.responder_8 + lead(p.responder_8, 4) OVER s, 0.0) AS responder_9,
  coalesce(p.responder_6 + lead(p.responder_6, 20) OVER s + lead(p.responder_6, 40) OVER s, 0.0) AS responder_10,
  l.responder_6 AS responder_6_lag_1,
  avg(p.feature_00) OVER (PARTITION BY p.date_id, p.time_id) AS feature_00_mkt,
  avg(p.feature_00) OVER (s ROWS BETWEEN {W_SMALL - 1} PRECEDING AND CURRENT ROW) AS feature_00_roll_mean,
  round(coalesce(stddev_samp(p.feature_00) OVER (s ROWS BETWEEN {W_SMALL - 1} PRECEDING AND CURRENT ROW), 0.0), 6)
    AS feature_00_roll_std
FROM panel p LEFT JOIN panel l
  ON l.date_id + 1 = p.date_id AND l.time_id = p.time_id AND l.symbol_id = p.symbol_id
WINDOW s AS (PARTITION BY p.symbol_id ORDER BY p.date_id, p.time_id)""")
def model_frame(spark, sf):
    """Placeholders -> aux -> lags -> market average -> rolling, in that order."""
    p = panel(spark, sf).select(*ID_COLUMNS, "feature_00", "weight", "responder_6", "responder_7", "responder_8")
    mf = FE.model_frame(p, use_aux=True, use_lags=True, use_market_avg=True,
                        use_rolling=True, engineered=["feature_00"], window=W_SMALL, lags=["responder_6"])
    return mf.select(*ID_COLUMNS, "feature_00", "weight", "responder_6", "responder_9", "responder_10",
                     "responder_6_lag_1", "feature_00_mkt", "feature_00_roll_mean",
                     r6(F.col("feature_00_roll_std")).alias("feature_00_roll_std"))


# ------------------------------------------------------------------ profiles (D)
@query("profile_summary", f"""{PANEL}
SELECT avg(responder_6) AS target_mean, round(stddev_samp(responder_6), 6) AS target_std,
       min(responder_6) AS target_min, max(responder_6) AS target_max,
       avg(weight) AS weight_mean, round(stddev_samp(weight), 6) AS weight_std,
       min(weight) AS weight_min, max(weight) AS weight_max FROM panel""")
def profile_summary(spark, sf):
    """D01."""
    out = PR.profile_summary(panel(spark, sf))
    return out.select(*[r6(F.col(c)).alias(c) if c.endswith("_std") else F.col(c) for c in out.columns])


@query("profile_ids", f"""{PANEL}
SELECT CAST(count(*) AS BIGINT) AS row_count, min(date_id) AS date_min, max(date_id) AS date_max,
  CAST(count(DISTINCT symbol_id) + max(CASE WHEN symbol_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS symbol_n_unique,
  CAST(count(DISTINCT time_id) + max(CASE WHEN time_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS time_n_unique
FROM panel""")
def profile_ids(spark, sf):
    """Counts and n_unique (null counted as a value) in one pass."""
    return PR.profile_ids(panel(spark, sf))


@query("missing_ratio", f"""{PANEL}
SELECT feature, ordinal, missing_ratio FROM (""" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST({i} AS BIGINT) AS ordinal, "
    f"avg(CASE WHEN {f} IS NULL THEN 1.0e0 ELSE 0.0e0 END) AS missing_ratio FROM panel"
    for i, f in enumerate(PANEL_FEATURES)) + ") ORDER BY missing_ratio DESC, ordinal LIMIT 30")
def missing_ratio(spark, sf):
    """Null ratio per feature, top 30."""
    return PR.missing_ratio(panel(spark, sf), PANEL_FEATURES, 30)


@query("responder_clip", f"{PANEL} SELECT responder, mn AS min, mx AS max, mn >= -5 AND mx <= 5 AS clipped FROM (" +
       " UNION ALL ".join(f"SELECT '{r}' AS responder, min({r}) AS mn, max({r}) AS mx FROM panel"
                          for r in RESPONDER_COLUMNS) + ")")
def responder_clip(spark, sf):
    """D04."""
    return PR.responder_clip(panel(spark, sf))


_PRED = "(feature_02_mkt - 3 * feature_03_mkt)"
_PRED_CTE = ("mk AS (SELECT *, avg(feature_02) OVER (PARTITION BY date_id, time_id) AS feature_02_mkt, "
             "avg(feature_03) OVER (PARTITION BY date_id, time_id) AS feature_03_mkt FROM panel)")


def _mkt_pred(spark, sf) -> DataFrame:
    p = FE.market_average(panel(spark, sf), ["feature_02", "feature_03"])
    return p.withColumn("prediction", F.col("feature_02_mkt") - 3 * F.col("feature_03_mkt"))


@query("weighted_r2", f"""{PANEL}, {_PRED_CTE}, {_BOUNDS_CTE}
SELECT CAST(count(*) AS BIGINT) AS n_rows,
  round(1 - sum(weight * (responder_6 - {_PRED}) * (responder_6 - {_PRED})) / sum(weight * responder_6 * responder_6), 6) AS r2
FROM mk, bounds WHERE date_id >= test_start""")
def weighted_r2(spark, sf):
    """Weighted zero-mean R² of a market-average predictor on the test block."""
    p = _mkt_pred(spark, sf)
    ns = _bounds(p)
    r = ME.weighted_r2(p.where(F.col("date_id") >= ns.test_start), "prediction")
    return r.select("n_rows", r6(F.col("r2")).alias("r2"))


@query("weighted_r2_by_date", f"""{PANEL}, {_PRED_CTE}
SELECT date_id, CAST(count(*) AS BIGINT) AS n_rows,
  round(1 - sum(weight * (responder_6 - {_PRED}) * (responder_6 - {_PRED})) / sum(weight * responder_6 * responder_6), 6) AS r2
FROM mk GROUP BY date_id""")
def weighted_r2_by_date(spark, sf):
    """D05 per date."""
    r = ME.weighted_r2(_mkt_pred(spark, sf), "prediction", by=["date_id"])
    return r.select("date_id", "n_rows", r6(F.col("r2")).alias("r2"))


@query("daily_loss", f"""{PANEL}, {_PRED_CTE}
SELECT date_id, round(sum(weight * ({_PRED} - responder_6) * ({_PRED} - responder_6))
  / greatest(sum(weight * responder_6 * responder_6), 1e-6), 6) AS loss FROM mk GROUP BY date_id""")
def daily_loss(spark, sf):
    """Per-date training loss."""
    r = ME.daily_loss(_mkt_pred(spark, sf), "prediction")
    return r.select("date_id", r6(F.col("loss")).alias("loss"))


@query("finite_check", f"{PANEL} SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE {c} IS NOT NULL AND (isnan({c}) OR isinf({c}))) AS BIGINT) "
    f"AS n_non_finite, count(*) FILTER (WHERE {c} IS NOT NULL AND (isnan({c}) OR isinf({c}))) = 0 AS all_finite FROM panel"
    for c in PANEL_FEATURES + ["weight", "responder_6"]) + ")")
def finite_check(spark, sf):
    """Non-finite values per column."""
    return PR.finite_check(panel(spark, sf), PANEL_FEATURES + ["weight", "responder_6"])


_NUMERIC = ["date_id", "time_id", "symbol_id", *PANEL_FEATURES, "weight", *RESPONDER_COLUMNS]


@query("hollow_columns", f"{PANEL} SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", coalesce(bool_or({c} <> 0), false) AS any_nonzero, "
    f"CAST(count({c}) AS BIGINT) AS non_null FROM panel" for c in _NUMERIC) + ")")
def hollow_columns(spark, sf):
    """Columns without any non-zero / non-null value."""
    return PR.hollow_columns(panel(spark, sf), _NUMERIC)


@query("weight_constancy", f"""{PANEL}
SELECT date_id, CAST(count(*) AS BIGINT) AS n_symbols, CAST(count(*) FILTER (WHERE c) AS BIGINT) AS n_constant
FROM (SELECT date_id, symbol_id, min(weight) = max(weight) AS c FROM panel GROUP BY date_id, symbol_id)
GROUP BY date_id""")
def weight_constancy(spark, sf):
    """Weight constant per (date, symbol)."""
    return PR.weight_constancy(panel(spark, sf))


@query("universe_growth", f"""{PANEL}
SELECT date_id, CAST(count(DISTINCT symbol_id) AS BIGINT) AS n_symbols, CAST(max(time_id) + 1 AS BIGINT) AS grid_size,
  CAST(count(*) AS BIGINT) AS n_rows, avg(CASE WHEN feature_06 IS NULL THEN 1.0e0 ELSE 0.0e0 END) AS warmup_null_ratio
FROM panel GROUP BY date_id""")
def universe_growth(spark, sf):
    """Universe size, grid size and warm-up nulls per date."""
    return PR.universe_growth(panel(spark, sf))


_REQUIRED = ID_COLUMNS + PANEL_FEATURES + ["weight", "responder_6", "responder_9"]


@query("contract_report", f"""{PANEL}
SELECT CAST(21 AS BIGINT) AS n_columns, CAST(13 AS BIGINT) AS n_required_present,
  CAST(1 AS BIGINT) AS n_required_missing, 'responder_9' AS missing_columns,
  CAST(count(*) AS BIGINT) AS row_count, min(date_id) AS date_min, max(date_id) AS date_max,
  CAST(least(count(*), 5) AS BIGINT) AS sample_rows, false AS passed FROM panel""")
def contract_report(spark, sf):
    """Contract expectations as a one-row frame (responder_9 is not stored)."""
    return PR.contract_report(panel(spark, sf), _REQUIRED)


# ------------------------------------------------------------------ tags
def _tags(spark, sf):
    return FX.load_tags(spark, sf)


@query("tag_counts", f"""{TAGS}
SELECT tag, CAST(count(*) FILTER (WHERE v) AS BIGINT) AS n_true, CAST(count(*) FILTER (WHERE NOT v) AS BIGINT) AS n_false
FROM (SELECT 'tag_0' AS tag, tag_0 AS v FROM tags UNION ALL SELECT 'tag_1', tag_1 FROM tags
      UNION ALL SELECT 'tag_2', tag_2 FROM tags) GROUP BY tag""")
def tag_counts(spark, sf):
    """D14."""
    return PR.tag_counts(_tags(spark, sf), "p_partkey")


@query("tag_groups", f"""{TAGS}
SELECT tag, member FROM (SELECT 'tag_0' AS tag, p_partkey AS member, tag_0 AS v FROM tags
  UNION ALL SELECT 'tag_1', p_partkey, tag_1 FROM tags UNION ALL SELECT 'tag_2', p_partkey, tag_2 FROM tags) WHERE v""")
def tag_groups(spark, sf):
    """Tag -> members (long form)."""
    return PR.tag_groups(_tags(spark, sf), "p_partkey")


@query("tags_per_row", f"""{TAGS}
SELECT p_partkey, CAST(CAST(tag_0 AS INT) + CAST(tag_1 AS INT) + CAST(tag_2 AS INT) AS BIGINT) AS n_tags,
  concat_ws('|', CASE WHEN tag_0 THEN 'tag_0' END, CASE WHEN tag_1 THEN 'tag_1' END, CASE WHEN tag_2 THEN 'tag_2' END) AS tags
FROM tags""")
def tags_per_row(spark, sf):
    """D16."""
    return PR.tags_per_row(_tags(spark, sf), "p_partkey")


@query("feature_tag_lookup", f"""{TAGS}
SELECT t.tag_0, t.tag_1, t.tag_2, CAST(count(*) AS BIGINT) AS n_lines, sum(l.l_quantity) AS quantity
FROM lineitem l JOIN tags t ON t.p_partkey = l.l_partkey GROUP BY t.tag_0, t.tag_1, t.tag_2""")
def feature_tag_lookup(spark, sf):
    """Key -> tag lookup join (tag table broadcast only under a checked size)."""
    from tidepanel.plans.joins import join_small
    li = spark.read.parquet(os.path.join(sf, "lineitem.parquet")).select("l_partkey", "l_quantity")
    tags = _tags(spark, sf).withColumnRenamed("p_partkey", "l_partkey")
    j = join_small(li, tags, ["l_partkey"], "inner")
    return j.groupBy("tag_0", "tag_1", "tag_2").agg(F.count(F.lit(1)).cast("bigint").alias("n_lines"),
                                                    F.sum("l_quantity").alias("quantity"))


# ------------------------------------------------------------------ splits (J, D06, E07)
@query("holdout_split", f"""{PANEL}
SELECT min(date_id) AS train_start, max(date_id) - {VALID_DAYS} - {GAP_DAYS} AS train_end,
  max(date_id) - {VALID_DAYS} + 1 AS valid_start, max(date_id) AS valid_end FROM panel""")
def holdout_split(spark, sf):
    """Split bounds from the observed date range (date arithmetic)."""
    from tidepanel.operators.splits import holdout_split_columns
    rng = PN.date_range(panel(spark, sf))
    cols = holdout_split_columns(F.col("date_min"), F.col("date_max"), VALID_DAYS, GAP_DAYS)
    return rng.select(*[cols[k].alias(k) for k in ("train_start", "train_end", "valid_start", "valid_end")])


@query("split_summary", f"""{PANEL}, b AS (SELECT min(date_id) AS lo, max(date_id) - {VALID_DAYS} - {GAP_DAYS} AS te,
  max(date_id) - {VALID_DAYS} + 1 AS vs, max(date_id) AS ve FROM panel)
SELECT lo AS train_start, te AS train_end, vs AS valid_start, ve AS valid_end,
  CAST(count(*) FILTER (WHERE date_id BETWEEN lo AND te) AS BIGINT) AS train_rows,
  CAST(count(*) FILTER (WHERE date_id BETWEEN vs AND ve) AS BIGINT) AS valid_rows,
  CAST(count(DISTINCT CASE WHEN date_id BETWEEN lo AND te THEN date_id END) AS BIGINT) AS train_days,
  CAST(count(DISTINCT CASE WHEN date_id BETWEEN vs AND ve THEN date_id END) AS BIGINT) AS valid_days
FROM panel, b GROUP BY lo, te, vs, ve""")
def split_summary(spark, sf):
    """Rows and days per fold in one pass."""
    p = panel(spark, sf)
    dmin, dmax = PN.collect_date_range(p)
    return SP.split_summary(p, SP.holdout_split(dmin, dmax, VALID_DAYS, GAP_DAYS))


_FOLD = ("CASE WHEN date_id >= test_start THEN 'test' WHEN date_id >= es_start THEN 'es' "
         "WHEN date_id > train_end THEN 'gap' ELSE 'train' END")


@query("nested_split_labels", f"""{PANEL}, {_BOUNDS_CTE}
SELECT {_FOLD} AS fold, min(date_id) AS first_date, max(date_id) AS last_date,
  CAST(count(DISTINCT date_id) AS BIGINT) AS n_days, CAST(count(*) AS BIGINT) AS n_rows
FROM panel, bounds GROUP BY 1""")
def nested_split_labels(spark, sf):
    """Train / gap / early-stopping / test folds."""
    p = panel(spark, sf)
    return SP.nested_split_labels(p, _bounds(p))


_SCHED_K = 5


@query("cadence_schedule", f"""{PANEL}, {_BOUNDS_CTE},
days AS (SELECT DISTINCT date_id FROM panel, bounds WHERE date_id BETWEEN test_start AND dmax),
s AS (SELECT date_id, CAST(row_number() OVER (ORDER BY date_id) - 1 AS BIGINT) AS day_index FROM days)
SELECT date_id, day_index, CAST(floor(day_index / {_SCHED_K}) AS BIGINT) AS version,
  day_index > 0 AND day_index % {_SCHED_K} = 0 AS update_before,
  min(date_id) OVER (PARTITION BY floor(day_index / {_SCHED_K})) AS version_start FROM s""")
def cadence_schedule(spark, sf):
    """Observed test dates -> model version at cadence 5."""
    p = panel(spark, sf)
    ns = _bounds(p)
    return SP.cadence_schedule(p, ns.test_start, ns.test_end, _SCHED_K)


@query("leakage_guard", f"""{PANEL}, {_BOUNDS_CTE},
days AS (SELECT DISTINCT date_id FROM panel),
t AS (SELECT date_id, {_FOLD} AS fold FROM days, bounds),
i AS (SELECT *, CASE WHEN fold = 'test' THEN row_number() OVER (PARTITION BY fold ORDER BY date_id) - 1 END AS i FROM t),
v AS (SELECT date_id, i // {_SCHED_K} AS version FROM i WHERE fold = 'test'),
f AS (SELECT date_id, CASE fold WHEN 'train' THEN 0 WHEN 'es' THEN 1 WHEN 'test' THEN i // {_SCHED_K} + 1 END AS since FROM i),
w AS (SELECT v.version, min(v.date_id) AS first FROM v GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS n_versions,
  bool_and((SELECT max(f.date_id) FROM f WHERE f.since <= w.version) < w.first) AS no_leak FROM w""")
def leakage_guard(spark, sf):
    """The days each version was fitted on lie strictly before the days it predicts."""
    return WF.leakage_guard(_prep(spark, sf), _SCHED_K)


PURGE_ROWS = 40


@query("purge_train_tail", f"""{PANEL}, {_BOUNDS_CTE},
r AS (SELECT p.date_id, p.time_id, p.symbol_id, row_number() OVER (PARTITION BY p.symbol_id
        ORDER BY p.date_id DESC, p.time_id DESC) AS from_end FROM panel p, bounds b WHERE p.date_id <= b.train_end)
SELECT date_id, CAST(count(*) AS BIGINT) AS n_rows FROM r WHERE from_end > {PURGE_ROWS} GROUP BY date_id""")
def purge_train_tail(spark, sf):
    """J02 option: the train fold without the last 40 rows per symbol, whose forward
    aux targets would read the next fold (per-date row counts)."""
    p = panel(spark, sf)
    ns = _bounds(p)
    kept = SP.purge_tail(p, ns.train.train_end, PURGE_ROWS)
    return kept.groupBy("date_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


@query("expanding_history", f"""{PANEL}, {_BOUNDS_CTE}
SELECT date_id, CAST(count(*) AS BIGINT) AS n_rows FROM (
  SELECT date_id FROM panel, bounds WHERE date_id < test_start UNION ALL SELECT date_id FROM panel, bounds WHERE date_id >= test_start)
GROUP BY date_id""")
def expanding_history(spark, sf):
    """History + newly revealed days by ``unionByName`` (the last expanding fit set)."""
    p = panel(spark, sf)
    start = _bounds(p).test_start
    whole = p.where(F.col("date_id") < start).unionByName(p.where(F.col("date_id") >= start))
    return whole.groupBy("date_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


@query("canonical_order_rank", f"""{PANEL}
SELECT {IDS}, CAST(row_number() OVER (ORDER BY date_id, time_id, symbol_id) - 1 AS BIGINT) AS canonical_rank,
  CAST(row_number() OVER (PARTITION BY symbol_id ORDER BY date_id, time_id) - 1 AS BIGINT) AS series_rank
FROM panel""")
def canonical_order_rank(spark, sf):
    """canonical (date, time, symbol) and series (symbol, date, time) positions.

    Both come from per-block row numbers plus offsets of small block-count tables,
    never from one global window over all rows.
    """
    both = FE.series_index(FE.canonical_rank(panel(spark, sf)), pos_col="series_rank")
    return both.select(*ID_COLUMNS, "canonical_rank", "series_rank")


# ------------------------------------------------------------------ walk-forward WLS (K)
WF_X = "feature_02"
DECAY = 0.9
_D1 = (f"d AS (SELECT date_id, sum(weight * {WF_X} * {WF_X}) AS a, sum(weight * {WF_X} * responder_6) AS b, "
       f"sum(weight * responder_6 * responder_6) AS c, count(*) AS n FROM panel GROUP BY date_id), "
       f"t AS (SELECT d.*, {_FOLD} AS fold FROM d, bounds), "
       f"ti AS (SELECT t.*, CASE WHEN fold = 'test' THEN row_number() OVER (PARTITION BY fold ORDER BY date_id) - 1 END AS i FROM t)")


def _wf_cfg() -> WF.WalkForwardConfig:
    return WF.WalkForwardConfig(features=[WF_X], intercept=False, standardize=False, ridge=0.0,
                                decay=DECAY, test_days=TEST_DAYS, valid_days=VALID_DAYS, gap_days=GAP_DAYS)


def _prep(spark, sf, cfg=None) -> WF.PreparedPanel:
    return WF.prepare(panel(spark, sf), cfg or _wf_cfg())


def _betas_sql(variant: str, k: int) -> str:
    """Version -> beta table of the one-input model, in plain SQL."""
    if variant == "full":
        return "beta AS (SELECT 0 AS version, sum(b) / sum(a) AS beta FROM ti WHERE fold = 'train')"
    if variant == "retrain":
        return (f"vm AS (SELECT *, CASE WHEN fold = 'train' THEN 0 WHEN fold = 'es' THEN 1 "
                f"WHEN fold = 'test' THEN floor(i / {k}) + 1 END AS v FROM ti), "
                f"per AS (SELECT v, sum(a) AS a, sum(b) AS b FROM vm WHERE v IS NOT NULL GROUP BY v), "
                f"beta AS (SELECT v AS version, sum(b) OVER (ORDER BY v) / sum(a) OVER (ORDER BY v) AS beta FROM per)")
    newv = (f"nv AS (SELECT floor(i / {k}) + 1 AS v, sum(a) AS a, sum(b) AS b FROM ti WHERE fold = 'test' GROUP BY 1), "
            f"v0 AS (SELECT sum(a) AS a, sum(b) AS b FROM ti WHERE fold = 'train'), "
            f"vers AS (SELECT DISTINCT floor(i / {k}) AS version FROM ti WHERE fold = 'test')")
    if variant == "refit":
        return (newv + f", beta AS (SELECT vers.version, "
                f"(power({DECAY}, vers.version) * max(v0.b) + coalesce(sum(power({DECAY}, vers.version - nv.v) * (1 - {DECAY}) * nv.b), 0)) / "
                f"(power({DECAY}, vers.version) * max(v0.a) + coalesce(sum(power({DECAY}, vers.version - nv.v) * (1 - {DECAY}) * nv.a), 0)) AS beta "
                f"FROM vers CROSS JOIN v0 LEFT JOIN nv ON nv.v <= vers.version GROUP BY vers.version)")
    if variant == "continue":
        return (newv + ", beta AS (SELECT vers.version, CASE WHEN vers.version = 0 THEN max(v0.b) / max(v0.a) "
                "ELSE max(nv.b) / max(nv.a) END AS beta FROM vers CROSS JOIN v0 "
                "LEFT JOIN nv ON nv.v = vers.version GROUP BY vers.version)")
    raise ValueError(variant)


def _wf_sql(variant: str, k: int) -> str:
    version = "0" if variant == "full" else f"floor(ti.i / {k})"
    cadence = 0 if variant == "full" else k
    return (f"SELECT '{variant}' AS variant, CAST({cadence} AS BIGINT) AS cadence, "
            f"CAST(max(beta.version) AS BIGINT) AS n_updates, CAST(count(*) AS BIGINT) AS test_days, "
            f"CAST(sum(ti.n) AS BIGINT) AS test_rows, "
            f"round(1 - sum(ti.c - 2 * beta.beta * ti.b + beta.beta * beta.beta * ti.a) / sum(ti.c), 6) AS score "
            f"FROM ti JOIN beta ON beta.version = {version} WHERE ti.fold = 'test'")


def _wf_one(variant: str, k: int) -> str:
    return f"{PANEL}, {_BOUNDS_CTE}, {_D1}, {_betas_sql(variant, k)} {_wf_sql(variant, k)}"


def _wf_many(pairs: list[tuple[str, int]], with_delta: bool = False, delta_only: bool = False) -> str:
    parts = [f"SELECT * FROM ({_wf_sql_in(v, k)})" for v, k in pairs]
    body = " UNION ALL ".join(parts)
    if with_delta or delta_only:
        cols = "variant" if delta_only else "*"
        body = (f"SELECT {cols}, score - max(CASE WHEN variant = 'full' THEN score END) OVER () AS delta_vs_full "
                f"FROM ({body})")
    return f"{PANEL}, {_BOUNDS_CTE}, {_D1} {body}"


def _wf_sql_in(variant: str, k: int) -> str:
    # Self-contained sub-query: its own beta CTE, sharing the panel/bounds/day CTEs.
    return f"WITH {_betas_sql(variant, k)} {_wf_sql(variant, k)}"


def _score(prep, variant, k):
    s = WF.score_variant(prep, variant, k)
    return s.select("variant", "cadence", "n_updates", "test_days", "test_rows", r6(F.col("score")).alias("score"))


def _suite(prep, pairs, with_delta=False):
    """All (variant, cadence) pairs scored in one pass over the day statistics."""
    out = WF.score_suite(prep, list(pairs)).select(
        "variant", "cadence", "n_updates", "test_days", "test_rows", r6(F.col("score")).alias("score"))
    if with_delta:
        from tidepanel.operators.experiments import delta_vs
        out = delta_vs(out, "variant", "full")
    return out


@query("walk_forward_full", _wf_one("full", 1))
def walk_forward_full(spark, sf):
    """Static model over the test block."""
    return _score(_prep(spark, sf), "full", 1)


@query("walk_forward_retrain", _wf_one("retrain", 5))
def walk_forward_retrain(spark, sf):
    """Expanding retrain every 5 test days."""
    return _score(_prep(spark, sf), "retrain", 5)


@query("wls_expanding", _wf_one("retrain", 1))
def wls_expanding(spark, sf):
    """Daily expanding refit (cumulative day statistics)."""
    return _score(_prep(spark, sf), "retrain", 1)


@query("wls_decay", _wf_one("refit", 1))
def wls_decay(spark, sf):
    """K03 (linear form): exponentially decayed statistics, daily."""
    return _score(_prep(spark, sf), "refit", 1)


@query("wls_continue", _wf_one("continue", 5))
def wls_continue(spark, sf):
    """K04 (linear form): residual fit on the newly revealed days."""
    return _score(_prep(spark, sf), "continue", 5)


_VARIANTS = [("full", 1), ("retrain", 5), ("refit", 5), ("continue", 5)]


@query("variant_summary", _wf_many(_VARIANTS))
def variant_summary(spark, sf):
    """Variant suite over one day-statistics table."""
    return _suite(_prep(spark, sf), _VARIANTS)


from tidepanel.plans import evaluator as EV  # noqa: E402


def _summary_sql(pairs: list[tuple[str, int]]) -> str:
    """Prediction and target figures of the one-input model, variant by variant."""
    def one(v, k):
        version = "0" if v == "full" else f"floor(ti.i / {k})"
        figures = ", ".join(f"round({f}({c}), 6) AS {n}_{m}" for n, c in (("prediction", "p"), ("target", "y"))
                            for m, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))
        return (f"SELECT * FROM (WITH {_betas_sql(v, k)} SELECT '{v}' AS variant, CAST({0 if v == 'full' else k} AS BIGINT) AS cadence, "
                f"CAST(count(*) AS BIGINT) AS n_rows, {figures} FROM (SELECT beta.beta * coalesce(panel.{WF_X}, 0) AS p, panel.responder_6 AS y "
                f"FROM panel JOIN ti USING (date_id) JOIN beta ON beta.version = {version} WHERE ti.fold = 'test'))")
    return f"{PANEL}, {_BOUNDS_CTE}, {_D1} {' UNION ALL '.join(one(v, k) for v, k in pairs)}"


@query("evaluator_summary", _summary_sql(_VARIANTS))
def evaluator_summary(spark, sf):
    """Prediction and target summaries of every variant, one pass over the test rows."""
    p = panel(spark, sf)
    out = EV.summaries(p, WF.prepare(p, _wf_cfg()), _VARIANTS)
    return out.withColumns({f"{n}_{m}": r6(F.col(f"{n}_{m}")) for n in ("prediction", "target") for m in EV.MEASURES})


_IVF = [("full", 1), ("refit", 1), ("continue", 1), ("retrain", 10)]


@query("incremental_vs_full", _wf_many(_IVF, with_delta=True))
def incremental_vs_full(spark, sf):
    """Methods at their cadences, with the delta against ``full``."""
    return _suite(_prep(spark, sf), _IVF, with_delta=True)


_CAD = [("retrain", 1), ("retrain", 5), ("retrain", 10)]


@query("cadence_sweep", _wf_many(_CAD))
def cadence_sweep(spark, sf):
    """Retrain-cadence sweep."""
    return _suite(_prep(spark, sf), _CAD)


@query("walk_forward_by_date", f"""{PANEL}, {_BOUNDS_CTE}, {_D1}, {_betas_sql('retrain', 5)}
SELECT ti.date_id, CAST(ti.n AS BIGINT) AS n_rows, CAST(beta.version AS BIGINT) AS version,
  round(1 - (ti.c - 2 * beta.beta * ti.b + beta.beta * beta.beta * ti.a) / ti.c, 6) AS r2
FROM ti JOIN beta ON beta.version = floor(ti.i / 5) WHERE ti.fold = 'test'""")
def walk_forward_by_date(spark, sf):
    """Flagship: per test date R² of the expanding-retrain (cadence 5) model, scored
    from day statistics without touching rows again."""
    from tidepanel.plans import wls
    prep = _prep(spark, sf)
    betas = WF.version_betas(prep, "retrain", 5)
    test = prep.days.where(F.col("fold") == "test").select("*", F.floor(F.col("day_index") / 5).cast("bigint").alias("version"))
    j = test.join(betas, "version")
    sse = wls.sse_column(F.col("beta"), prep.p, prep.cfg.target)
    return j.select("date_id", F.col("n").alias("n_rows"), "version",
                    r6(1 - sse / F.col(f"c_{prep.cfg.target}")).alias("r2"))


@query("prediction_summary", f"""{PANEL}, {_BOUNDS_CTE}, {_D1}, {_betas_sql('full', 1)},
pr AS (SELECT beta.beta * panel.{WF_X} AS p FROM panel, bounds, beta WHERE panel.date_id >= bounds.test_start)
SELECT round(coalesce(avg(p), 0.0), 6) + 0.0 AS prediction_mean, round(coalesce(stddev_pop(p), 0.0), 6) + 0.0 AS prediction_std,
  round(coalesce(min(p), 0.0), 6) + 0.0 AS prediction_min, round(coalesce(max(p), 0.0), 6) + 0.0 AS prediction_max,
  CAST(count(*) FILTER (WHERE abs(p) > 5) AS BIGINT) AS n_over_clip FROM pr""")
def prediction_summary(spark, sf):
    """Distribution of out-of-sample predictions (population std) and over-clip count."""
    p = panel(spark, sf)
    prep = WF.prepare(p, _wf_cfg())
    preds = WF.predictions(p, prep, "full")
    # D07 (``distribution_summary``) and D13 (``over_clip``) fused into one pass.
    return preds.agg(*[r6(e).alias(n) for n, e in (
        ("prediction_mean", F.coalesce(F.avg("prediction"), F.lit(0.0))),
        ("prediction_std", F.coalesce(F.stddev_pop("prediction"), F.lit(0.0))),
        ("prediction_min", F.coalesce(F.min("prediction"), F.lit(0.0))),
        ("prediction_max", F.coalesce(F.max("prediction"), F.lit(0.0))))],
        F.count_if(F.abs(F.col("prediction")) > 5).cast("bigint").alias("n_over_clip"))


# ------------------------------------------------------------------ experiment algebra
from tidepanel.operators import experiments as EX  # noqa: E402

GRID_VALID, GRID_GAP = [6, 12, 24], [0, 2, 5]
CAND = [f"feature_{i:02d}" for i in range(7)]


def _grid_sql(valid, gap) -> str:
    vv = ", ".join(f"({v})" for v in valid)
    gg = ", ".join(f"({g})" for g in gap)
    return (f"rng AS (SELECT min(date_id) AS dmin, max(date_id) AS dmax FROM panel), "
            f"grid AS (SELECT 'split_v' || CAST(v.valid_days AS VARCHAR) || '_g' || CAST(g.gap_days AS VARCHAR) AS run_name, "
            f"CAST(v.valid_days AS BIGINT) AS valid_days, CAST(g.gap_days AS BIGINT) AS gap_days, dmin AS train_start, "
            f"dmax - v.valid_days - g.gap_days AS train_end, dmax - v.valid_days + 1 AS valid_start, dmax AS valid_end, "
            f"(dmax - v.valid_days + 1 > dmin) AND (dmax - v.valid_days - g.gap_days >= dmin) AS feasible "
            f"FROM rng, (VALUES {vv}) v(valid_days), (VALUES {gg}) g(gap_days))")


def _cand_sql(cands: dict[str, str]) -> str:
    wide = ", ".join(f"sum(weight * coalesce({x}, 0) * coalesce({x}, 0)) AS a_{n}, "
                     f"sum(weight * coalesce({x}, 0) * responder_6) AS b_{n}" for n, x in cands.items())
    longs = " UNION ALL ".join(f"SELECT date_id, c, n, '{n}' AS candidate, a_{n} AS a, b_{n} AS b FROM dw"
                               for n in cands)
    return (f"dw AS (SELECT date_id, sum(weight * responder_6 * responder_6) AS c, count(*) AS n, {wide} "
            f"FROM src GROUP BY date_id), dl AS ({longs})")


_GRID_SCORES = (f"{PANEL}, src AS (SELECT * FROM panel), {_cand_sql({c: c for c in CAND})}, {_grid_sql(GRID_VALID, GRID_GAP)}, "
                f"s AS (SELECT run_name, valid_days, gap_days, candidate, "
                f"sum(CASE WHEN date_id BETWEEN train_start AND train_end THEN a END) AS a_fit, "
                f"sum(CASE WHEN date_id BETWEEN train_start AND train_end THEN b END) AS b_fit, "
                f"sum(CASE WHEN date_id BETWEEN valid_start AND valid_end THEN a END) AS a_ev, "
                f"sum(CASE WHEN date_id BETWEEN valid_start AND valid_end THEN b END) AS b_ev, "
                f"sum(CASE WHEN date_id BETWEEN valid_start AND valid_end THEN c END) AS c_ev, "
                f"sum(CASE WHEN date_id BETWEEN valid_start AND valid_end THEN n END) AS valid_rows "
                f"FROM dl JOIN grid ON grid.feasible AND dl.date_id BETWEEN grid.train_start AND grid.valid_end "
                f"GROUP BY run_name, valid_days, gap_days, candidate), "
                f"sc AS (SELECT run_name, valid_days, gap_days, candidate, CAST(valid_rows AS BIGINT) AS valid_rows, "
                f"b_fit / a_fit AS beta, 1 - (c_ev - 2 * (b_fit / a_fit) * b_ev + (b_fit / a_fit) * (b_fit / a_fit) * a_ev) / c_ev AS score FROM s)")


def _grid_scores(spark, sf) -> DataFrame:
    p = panel(spark, sf)
    ds = EX.candidate_day_stats(p, {c: F.col(c) for c in CAND})
    grid = EX.split_grid(ds, GRID_VALID, GRID_GAP)
    return EX.split_grid_scores(ds, grid)


@query("split_grid", f"""{PANEL}, {_grid_sql(GRID_VALID + [80], GRID_GAP)}
SELECT run_name, valid_days, gap_days, train_start, train_end, valid_start, valid_end, feasible FROM grid""")
def split_grid(spark, sf):
    """Valid x gap grid of holdout splits with run names; infeasible cells flagged."""
    ds = PN.date_range(panel(spark, sf)).select(F.col("date_min").alias("date_id")).unionByName(
        PN.date_range(panel(spark, sf)).select(F.col("date_max").alias("date_id")))
    return EX.split_grid(ds, GRID_VALID + [80], GRID_GAP)


@query("split_grid_scores", f"""{_GRID_SCORES}
SELECT run_name, valid_days, gap_days, candidate, valid_rows, round(beta, 6) AS beta, round(score, 6) AS score FROM sc""")
def split_grid_scores(spark, sf):
    """Every feasible split x every one-input candidate, from per-day sums."""
    s = _grid_scores(spark, sf)
    return s.select("run_name", "valid_days", "gap_days", "candidate", "valid_rows",
                    r6(F.col("beta")).alias("beta"), r6(F.col("score")).alias("score"))


@query("split_stability", f"""{_GRID_SCORES}
SELECT CAST(count(*) AS BIGINT) AS n_splits, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS pstdev,
  round(min(score), 6) AS min, round(max(score), 6) AS max, bool_and(score > 0) AS all_positive
FROM sc WHERE candidate = 'feature_02'""")
def split_stability(spark, sf):
    """Stability of the feature_02 model over the split grid."""
    s = EX.split_stability(_grid_scores(spark, sf).where(F.col("candidate") == "feature_02"))
    return s.select("n_splits", *[r6(F.col(c)).alias(c) for c in ("mean", "pstdev", "min", "max")], "all_positive")


@query("valid_days_trend", f"""{_GRID_SCORES},
m AS (SELECT valid_days, avg(score) AS mean_score FROM sc WHERE candidate = 'feature_02' GROUP BY valid_days),
u AS (SELECT valid_days, mean_score, lag(mean_score) OVER (ORDER BY valid_days) IS NULL
        OR mean_score >= lag(mean_score) OVER (ORDER BY valid_days) AS up FROM m)
SELECT valid_days, round(mean_score, 6) AS mean_score, bool_and(up) OVER () AS monotone_increasing FROM u""")
def valid_days_trend(spark, sf):
    """Mean score per validation length and a monotone-trend flag."""
    t = EX.valid_days_trend(_grid_scores(spark, sf).where(F.col("candidate") == "feature_02"))
    return t.select("valid_days", r6(F.col("mean_score")).alias("mean_score"), "monotone_increasing")


@query("gap_effect", f"""{_GRID_SCORES},
g AS (SELECT valid_days, arg_min(score, gap_days) AS s_lo, arg_max(score, gap_days) AS s_hi,
        count(DISTINCT gap_days) AS n_gaps FROM sc WHERE candidate = 'feature_02' GROUP BY valid_days)
SELECT CAST(count(*) AS BIGINT) AS n_windows, round(avg((s_hi - s_lo) / abs(s_lo)), 6) AS mean_relative_change
FROM g WHERE n_gaps > 1""")
def gap_effect(spark, sf):
    """Relative score change from the smallest to the largest gap, averaged."""
    g = EX.gap_effect(_grid_scores(spark, sf).where(F.col("candidate") == "feature_02"))
    return g.select("n_windows", r6(F.col("mean_relative_change")).alias("mean_relative_change"))


@query("rank_stability", f"""{_GRID_SCORES},
r AS (SELECT run_name, candidate, row_number() OVER (PARTITION BY run_name ORDER BY score DESC, candidate) AS rank FROM sc)
SELECT candidate, CAST(count(*) FILTER (WHERE rank = 1) AS BIGINT) AS n_first,
  CAST(count(*) FILTER (WHERE rank <= 5) AS BIGINT) AS n_top FROM r GROUP BY candidate""")
def rank_stability(spark, sf):
    """How often each input ranks first / in the top 5 across the split runs."""
    return EX.rank_stability(EX.rank_candidates(_grid_scores(spark, sf)), 5)


@query("top5_lists", f"""{_GRID_SCORES},
r AS (SELECT run_name, candidate, row_number() OVER (PARTITION BY run_name ORDER BY score DESC, candidate) AS rank FROM sc)
SELECT run_name, string_agg(candidate, '|' ORDER BY rank) AS top_5 FROM r WHERE rank <= 5 GROUP BY run_name""")
def top5_lists(spark, sf):
    """Per split run, the top-5 inputs as a ``|``-joined string."""
    return EX.top_lists(EX.rank_candidates(_grid_scores(spark, sf)), 5)


@query("rank_stability_lists", f"""{_GRID_SCORES},
r AS (SELECT run_name, candidate, row_number() OVER (PARTITION BY run_name ORDER BY score DESC, candidate) AS rank FROM sc),
l AS (SELECT run_name, string_agg(candidate, '|' ORDER BY rank) AS top_5 FROM r WHERE rank <= 5 GROUP BY run_name),
c AS (SELECT DISTINCT candidate FROM sc)
SELECT c.candidate, CAST(count(*) FILTER (WHERE string_split(l.top_5, '|')[1] = c.candidate) AS BIGINT) AS n_first,
  CAST(count(*) FILTER (WHERE list_contains(string_split(l.top_5, '|'), c.candidate)) AS BIGINT) AS n_top
FROM c, l GROUP BY c.candidate""")
def rank_stability_lists(spark, sf):
    """D12 as the reference computes it: from stored top-5 strings (split / contains)."""
    lists = EX.top_lists(EX.rank_candidates(_grid_scores(spark, sf)), 5)
    return EX.rank_stability_from_lists(lists, CAND)


@query("split_grid_first_n", f"""{PANEL}, {_grid_sql(GRID_VALID + [80], GRID_GAP)}
SELECT run_name, valid_days, gap_days, feasible FROM grid ORDER BY valid_days, gap_days LIMIT 4""")
def split_grid_first_n(spark, sf):
    """the grid limited to its first N cells."""
    rng = PN.date_range(panel(spark, sf))
    ds = rng.select(F.col("date_min").alias("date_id")).unionByName(rng.select(F.col("date_max").alias("date_id")))
    return EX.split_grid(ds, GRID_VALID + [80], GRID_GAP, first_n=4).select("run_name", "valid_days", "gap_days", "feasible")


@query("ranked_subset", f"""{_GRID_SCORES},
imp AS (SELECT candidate AS feature, round(score, 6) AS importance FROM sc WHERE run_name = 'split_v{VALID_DAYS}_g{GAP_DAYS}')
SELECT feature, importance, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS BIGINT) AS rank
FROM imp QUALIFY rank <= 3""")
def ranked_subset(spark, sf):
    """top-k inputs of an importance ranking (univariate holdout R² here)."""
    s = _grid_scores(spark, sf).where(F.col("run_name") == f"split_v{VALID_DAYS}_g{GAP_DAYS}")
    imp = s.select(F.col("candidate").alias("feature"), r6(F.col("score")).alias("importance"))
    return FE.ranked_subset(imp, 3)


# Seeded window x subset sweep (K18): one-input models on rolling means vs a raw baseline.
SWEEP_W = [W_SMALL, W_LARGE]
SWEEP_SUBSETS = ["feature_02", "feature_03"]
SEEDS = [1, 2, 3]


def _sweep_specs() -> list[dict]:
    specs = [{"kind": "baseline", "window": None, "subset": None, "candidate": "base"}]
    for w in SWEEP_W:
        for s in SWEEP_SUBSETS:
            specs.append({"kind": "marketroll", "window": w, "subset": s, "candidate": f"{s}_w{w}"})
    return specs


def _sweep_runs(spark, sf) -> DataFrame:
    p = panel(spark, sf)
    ns = _bounds(p)
    cands = {"base": F.col("feature_02")}
    frame = p.select(*ID_COLUMNS, "weight", "responder_6", *SWEEP_SUBSETS)  # the ids are unique: they decide the order
    for w in SWEEP_W:
        r = FE.rolling_stats(frame, SWEEP_SUBSETS, window=w)
        frame = r.select(*frame.columns, *[F.col(f"{s}_roll_mean").alias(f"{s}_w{w}") for s in SWEEP_SUBSETS])
        for s in SWEEP_SUBSETS:
            cands[f"{s}_w{w}"] = F.col(f"{s}_w{w}")
    ds = EX.candidate_day_stats(frame, cands)
    return EX.seeded_runs(ds, _sweep_specs(), SEEDS, ns.train.train_end, ns.test_start)


def _sweep_sql() -> str:
    frames = []
    for w in SWEEP_W:
        for s in SWEEP_SUBSETS:
            frames.append(f"avg({s}) OVER (PARTITION BY symbol_id ORDER BY date_id, time_id "
                          f"ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS {s}_w{w}")
    cands = {"base": "feature_02"} | {f"{s}_w{w}": f"{s}_w{w}" for w in SWEEP_W for s in SWEEP_SUBSETS}
    specs = ", ".join(
        f"('{sp['kind']}', {sp['window'] if sp['window'] is not None else 'NULL'}, "
        f"{repr(sp['subset']) if sp['subset'] else 'NULL'}, '{sp['candidate']}')" for sp in _sweep_specs())
    seeds = ", ".join(f"({s})" for s in SEEDS)
    return (f"{PANEL}, {_BOUNDS_CTE}, src AS (SELECT *, {', '.join(frames)} FROM panel), {_cand_sql(cands)}, "
            f"specs AS (SELECT * FROM (VALUES {specs}) t(kind, roll_window, subset, want)), "
            f"seeds AS (SELECT * FROM (VALUES {seeds}) t(seed)), "
            f"s AS (SELECT kind, roll_window, subset, seed, "
            f"sum(CASE WHEN date_id <= train_end THEN a * (0.5e0 + (date_id * 7 + seed * 13) % 10 / 9e0) END) AS a_fit, "
            f"sum(CASE WHEN date_id <= train_end THEN b * (0.5e0 + (date_id * 7 + seed * 13) % 10 / 9e0) END) AS b_fit, "
            f"sum(CASE WHEN date_id >= test_start THEN a END) AS a_ev, sum(CASE WHEN date_id >= test_start THEN b END) AS b_ev, "
            f"sum(CASE WHEN date_id >= test_start THEN c END) AS c_ev "
            f"FROM dl, bounds, specs, seeds WHERE dl.candidate = specs.want GROUP BY kind, roll_window, subset, seed), "
            f"runs AS (SELECT kind, CAST(roll_window AS INT) AS roll_window, subset, seed, "
            f"1 - (c_ev - 2 * (b_fit / a_fit) * b_ev + (b_fit / a_fit) * (b_fit / a_fit) * a_ev) / c_ev AS score FROM s), "
            f"paired AS (SELECT r.roll_window, r.subset, r.seed, r.score AS marketroll_score, b.score AS baseline_score, "
            f"r.score - b.score AS delta FROM runs r JOIN runs b ON b.kind = 'baseline' AND b.seed = r.seed "
            f"WHERE r.kind <> 'baseline'), "
            f"cells AS (SELECT roll_window, subset, CAST(count(*) AS BIGINT) AS n_seeds, avg(delta) AS mean_delta, "
            f"coalesce(stddev_samp(delta), 0.0) AS std_delta, CAST(count(*) FILTER (WHERE delta > 0) AS BIGINT) AS n_positive, "
            f"avg(marketroll_score) AS mean_marketroll, avg(baseline_score) AS mean_baseline FROM paired GROUP BY roll_window, subset)")


@query("marketroll_sweep", f"""{_sweep_sql()}
SELECT kind, roll_window, subset, seed, round(score, 6) AS score FROM runs""")
def marketroll_sweep(spark, sf):
    """Window x subset x seed runs plus same-seed baselines, from one aggregation."""
    r = _sweep_runs(spark, sf)
    return r.select("kind", "roll_window", "subset", "seed", r6(F.col("score")).alias("score"))


@query("paired_delta", f"""{_sweep_sql()}
SELECT roll_window, subset, seed, round(marketroll_score, 6) AS marketroll_score, round(baseline_score, 6) AS baseline_score,
  round(delta, 6) AS delta FROM paired""")
def paired_delta(spark, sf):
    """Candidate runs joined to their same-seed baseline."""
    d = EX.paired_delta(_sweep_runs(spark, sf))
    return d.select("roll_window", "subset", "seed", *[r6(F.col(c)).alias(c) for c in ("marketroll_score", "baseline_score", "delta")])


@query("cell_summary", f"""{_sweep_sql()}
SELECT roll_window, subset, n_seeds, round(mean_delta, 6) AS mean_delta, round(std_delta, 6) AS std_delta, n_positive,
  round(mean_marketroll, 6) AS mean_marketroll, round(mean_baseline, 6) AS mean_baseline FROM cells""")
def cell_summary(spark, sf):
    """Per-cell paired statistics, best mean delta first."""
    c = EX.cell_summary(EX.paired_delta(_sweep_runs(spark, sf)))
    return c.select("roll_window", "subset", "n_seeds", r6(F.col("mean_delta")).alias("mean_delta"),
                    r6(F.col("std_delta")).alias("std_delta"), "n_positive",
                    r6(F.col("mean_marketroll")).alias("mean_marketroll"), r6(F.col("mean_baseline")).alias("mean_baseline"))


@query("best_variant", f"""{_sweep_sql()}
SELECT CAST(roll_window AS VARCHAR) || '/' || subset AS best, round(mean_delta, 6) AS mean_delta FROM cells
ORDER BY mean_delta DESC, best LIMIT 1""")
def best_variant(spark, sf):
    """Best cell of the sweep (arg-max, ties by label)."""
    c = EX.cell_summary(EX.paired_delta(_sweep_runs(spark, sf)))
    b = EX.best_cell(c, ["roll_window", "subset"], "mean_delta")
    return b.select("best", r6(F.col("mean_delta")).alias("mean_delta"))


# ------------------------------------------------------------------ sequences
SEQ_FEATURES = ["feature_00", "feature_02", "feature_03"]


@query("day_sequences", f"""{PANEL}
SELECT date_id, symbol_id, CAST(count(*) AS BIGINT) AS seq_len, min(time_id) AS first_time, max(time_id) AS last_time,
  sum((time_id + 1) * coalesce(responder_6, 0.0)) AS checksum FROM panel GROUP BY date_id, symbol_id""")
def day_sequences(spark, sf):
    """Per (date, symbol) time-ordered step arrays, compared through scalars."""
    seqs = SQ.day_sequences(panel(spark, sf), SEQ_FEATURES)
    return SQ.sequence_scalars(seqs)


@query("flatten_sequences", f"{PANEL} SELECT {IDS}, responder_6 AS y, weight AS w, feature_02 AS x1 FROM panel")
def flatten_sequences(spark, sf):
    """Sequences back to rows (``inline``); round trip equals the panel."""
    flat = SQ.flatten_sequences(SQ.day_sequences(panel(spark, sf), SEQ_FEATURES))
    return flat.select(*ID_COLUMNS, "y", "w", F.element_at("x", 2).alias("x1"))


@query("rectangularity", f"""{PANEL}
SELECT date_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT symbol_id) AS BIGINT) AS n_symbols,
  CAST(max(time_id) + 1 AS BIGINT) AS n_times,
  count(*) = count(DISTINCT symbol_id) * (max(time_id) + 1) AS rectangular,
  count(*) % (max(time_id) + 1) = 0 AS divisible FROM panel GROUP BY date_id""")
def rectangularity(spark, sf):
    """Exact rectangularity vs the divisibility test."""
    return SQ.rectangularity(panel(spark, sf))


@query("densify_day", f"""{PANEL},
g AS (SELECT date_id, max(time_id) + 1 AS nt FROM panel GROUP BY date_id),
m AS (SELECT DISTINCT date_id, symbol_id FROM panel)
SELECT m.date_id, CAST(count(*) * 0 + sum(g.nt) AS BIGINT) AS n_cells,
  CAST((SELECT count(*) FROM panel p WHERE p.date_id = m.date_id) AS BIGINT) AS n_filled
FROM m JOIN g ON g.date_id = m.date_id GROUP BY m.date_id""")
def densify_day(spark, sf):
    """I02 option: (date, symbol) series completed to the day's time grid."""
    d = SQ.densify_days(panel(spark, sf), ["responder_6"])
    return d.groupBy("date_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_cells"),
                                    F.count_if("filled").cast("bigint").alias("n_filled"))


# ------------------------------------------------------------------ boosted trees
from tidepanel.plans import gbt as GB  # noqa: E402

GBT_PARAMS = GB.GBTParams(max_iter=10, max_depth=4, max_bins=32, step_size=0.2, seed=7)


def _gbt_summary(preds: DataFrame, variant: str, cadence: int, n_updates: int) -> DataFrame:
    r = ME.weighted_r2(preds, "prediction")
    return r.select(F.lit(variant).alias("variant"), F.lit(cadence).cast("bigint").alias("cadence"),
                    F.lit(n_updates).cast("bigint").alias("n_updates"), F.col("n_rows").alias("test_rows"),
                    r6(F.col("r2")).alias("score"))


def _gbt_wf(spark, sf, variant, cadence):
    p = panel(spark, sf)
    ns = _bounds(p)
    preds, n = GB.walk_forward(p, PANEL_FEATURES, ns, variant, cadence, GBT_PARAMS)
    return _gbt_summary(preds, variant, 0 if variant == "full" else cadence, n)


@query("gbt_fit_predict")
def gbt_fit_predict(spark, sf):
    """Boosted trees with early stopping; test-block predictions keyed by ids."""
    p = panel(spark, sf)
    ns = _bounds(p)
    preds, _ = GB.walk_forward(p, PANEL_FEATURES, ns, "full", 1, GBT_PARAMS)
    return preds.select(*ID_COLUMNS, "responder_6", "weight", "prediction")


@query("gbt_leaf_refit")
def gbt_leaf_refit(spark, sf):
    """Leaf-value refit on revealed days every 10 test days."""
    return _gbt_wf(spark, sf, "refit", 10)


@query("gbt_continue")
def gbt_continue(spark, sf):
    """Extra residual trees on revealed days every 10 test days."""
    return _gbt_wf(spark, sf, "continue", 10)


@query("gbt_retrain")
def gbt_retrain(spark, sf):
    """Expanding refit of the booster every 10 test days."""
    return _gbt_wf(spark, sf, "retrain", 10)


@query("feature_importance")
def feature_importance(spark, sf):
    """Importance ranking of the fitted booster (top 5)."""
    p = panel(spark, sf)
    ns = _bounds(p)
    train = p.where(F.col("date_id").between(ns.train.train_start, ns.train.train_end))
    es = p.where(F.col("date_id").between(ns.es_start, ns.es_end))
    return GB.feature_importance(GB.fit(train, PANEL_FEATURES, GBT_PARAMS, valid=es), 5)


@query("oof_predictions")
def oof_predictions(spark, sf):
    """A10: out-of-fold predictions (ids, target, weight, prediction) written to parquet."""
    p = panel(spark, sf)
    ns = _bounds(p)
    preds, _ = GB.walk_forward(p, PANEL_FEATURES, ns, "full", 1, GBT_PARAMS)
    out = checkpoint_path(spark, f"oof_{uuid.uuid4().hex[:10]}")
    PN.write_table(preds.select(*ID_COLUMNS, "responder_6", "weight", "prediction"), out)
    return spark.read.parquet(out)


from tidepanel.plans import baseline as BL  # noqa: E402


def _baseline(spark, sf) -> BL.BaselineRun:
    p = panel(spark, sf)
    return BL.run(p, _bounds(p), GBT_PARAMS, engineered=["feature_02", "feature_03"], window=W_SMALL)


@query("baseline_run")
def baseline_run(spark, sf):
    """Load -> lags + engineered features -> split -> fit -> score, one summary row."""
    r = _baseline(spark, sf).summary
    return r.select("variant", "cadence", "n_updates", "test_rows", r6(F.col("score")).alias("score"))


@query("baseline_importances")
def baseline_importances(spark, sf):
    """Importances of the baseline's inputs, ids, lags and engineered columns included."""
    r = _baseline(spark, sf).importances
    return r.select("feature", r6(F.col("importance")).alias("importance"))


from tidepanel.plans import leaf_stats as LS  # noqa: E402


@query("gbt_refit_versions")
def gbt_refit_versions(spark, sf):
    """Leaf refits every 5 test days and their scores, from one aggregation."""
    p = panel(spark, sf)
    ns = _bounds(p)
    train = p.where(F.col("date_id").between(ns.train.train_start, ns.train.train_end))
    out = LS.refit_walk_forward(GB.fit(train, PANEL_FEATURES, GBT_PARAMS), p, ns, 5)
    return out.select("version", "n_rows", r6(F.col("r2")).alias("r2"))


@query("gbt_early_stopping")
def gbt_early_stopping(spark, sf):
    """Weighted loss of every prefix of the booster on the holdout; the best is restored."""
    p = panel(spark, sf)
    ns = _bounds(p)
    train = p.where(F.col("date_id").between(ns.train.train_start, ns.train.train_end))
    es = p.where(F.col("date_id").between(ns.es_start, ns.es_end))
    _, history = LS.fit_early_stopping(train, es, PANEL_FEATURES, GBT_PARAMS, 3)
    return history.select("round", r6(F.col("loss")).alias("loss"), r6(F.col("r2")).alias("r2"), "is_best")


# ------------------------------------------------------------------ cross-validation (J), sketches
from tidepanel.operators import sketches as SK  # noqa: E402
from tidepanel.plans import cross_validation as CV  # noqa: E402


def _cv_sql(folds: str) -> str:
    """Fold scores of the one-input model by range joins of folds and days."""
    return f"""{PANEL}, {_BOUNDS_CTE}, {_D1}, k AS (SELECT unnest(range(0, 4)) AS fold), f AS ({folds}),
tr AS (SELECT f.fold, sum(d.a) AS a, sum(d.b) AS b, sum(d.n) AS n FROM f JOIN d ON d.date_id BETWEEN f.lo AND f.hi OR d.date_id BETWEEN f.lo2 AND f.hi2 GROUP BY f.fold),
va AS (SELECT f.fold, f.vs, f.ve, sum(d.a) AS a, sum(d.b) AS b, sum(d.c) AS c, sum(d.n) AS n FROM f JOIN d ON d.date_id BETWEEN f.vs AND f.ve GROUP BY ALL)
SELECT fold, CAST(vs AS INT) AS valid_start, CAST(ve AS INT) AS valid_end, CAST(tr.n AS BIGINT) AS train_rows, CAST(va.n AS BIGINT) AS valid_rows,
  round(1 - (va.c - 2 * (tr.b / tr.a) * va.b + (tr.b / tr.a) * (tr.b / tr.a) * va.a) / va.c, 6) AS r2 FROM tr JOIN va USING (fold)"""


def _cv(spark, sf, scheme, **kw):
    p = panel(spark, sf)
    lo, hi = PN.collect_date_range(p)
    out = CV.score_folds(WF.prepare(p, _wf_cfg()), CV.folds(spark, lo, hi, scheme, 4, **kw))
    return out.withColumn("r2", r6(F.col("r2")))


@query("cv_expanding", _cv_sql("""SELECT fold, dmax - (3 - fold) * 8 - 7 AS vs, dmax - (3 - fold) * 8 AS ve, dmin AS lo, dmax - (3 - fold) * 8 - 7 - 3 AS hi, 1 AS lo2, 0 AS hi2 FROM k, bounds"""))
def cv_expanding(spark, sf):
    """J: expanding cross-validation with a purge of two days."""
    return _cv(spark, sf, "expanding", valid_days=8, purge=2)


@query("cv_rolling", _cv_sql("""SELECT fold, dmax - (3 - fold) * 8 - 7 AS vs, dmax - (3 - fold) * 8 AS ve, greatest(dmin, dmax - (3 - fold) * 8 - 7 - 22) AS lo, dmax - (3 - fold) * 8 - 7 - 3 AS hi, 1 AS lo2, 0 AS hi2 FROM k, bounds"""))
def cv_rolling(spark, sf):
    """J: rolling cross-validation on the 20 days before a purge of two."""
    return _cv(spark, sf, "rolling", valid_days=8, train_days=20, purge=2)


@query("cv_blocked", _cv_sql("""SELECT fold, dmin + fold * (dmax - dmin + 1) // 4 AS vs, dmin + (fold + 1) * (dmax - dmin + 1) // 4 - 1 AS ve, dmin AS lo,
  dmin + fold * (dmax - dmin + 1) // 4 - 3 AS hi, dmin + (fold + 1) * (dmax - dmin + 1) // 4 + 5 AS lo2, dmax AS hi2 FROM k, bounds"""))
def cv_blocked(spark, sf):
    """J: blocks validated by both sides, purge of two and embargo of five days."""
    return _cv(spark, sf, "blocked", purge=2, embargo=5)


@query("sketch_distinct")
def sketch_distinct(spark, sf):
    """Distinct symbols and buckets of date ranges from merged daily sketches."""
    daily = SK.daily_sketches(panel(spark, sf), ["symbol_id", "time_id"]).checkpoint()  # one small row per date and block
    lo, hi = PN.collect_date_range(daily)
    mid = (lo + hi) // 2
    parts = [SK.distinct_in(daily, a, b).select(F.lit(a).alias("first"), F.lit(b).alias("last"), "*") for a, b in ((lo, mid), (mid + 1, hi), (lo, hi))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ------------------------------------------------------------------ multi-target and online
from tidepanel.plans import multitarget as MT  # noqa: E402


def _multi_cfg(extra_targets=None, **kw) -> WF.WalkForwardConfig:
    return WF.WalkForwardConfig(features=PANEL_FEATURES, intercept=True, standardize=True, ridge=1e-3,
                                test_days=TEST_DAYS, valid_days=VALID_DAYS, gap_days=GAP_DAYS,
                                extra_targets=extra_targets or [], **kw)


def _aux_panel(spark, sf) -> DataFrame:
    return FE.add_aux_targets(panel(spark, sf))


@query("multitarget_stack")
def multitarget_stack(spark, sf):
    """Auxiliary heads (base4 / target_family / all9 / all11) stacked into the target."""
    heads = sorted({h for s in MT.AUX_TARGET_SETS.values() for h in s})
    prep = WF.prepare(_aux_panel(spark, sf), _multi_cfg(heads))
    s = MT.aux_sweep(prep, list(MT.AUX_TARGET_SETS))
    return s.select("aux_set", "n_heads", r6(F.col("score")).alias("score"))


@query("aux_sweep")
def aux_sweep(spark, sf):
    """Aux set x seed on one maximal statistics table, paired against base4."""
    heads = sorted({h for s in MT.AUX_TARGET_SETS.values() for h in s})
    prep = WF.prepare(_aux_panel(spark, sf), _multi_cfg(heads))
    runs = MT.aux_sweep(prep, list(MT.AUX_TARGET_SETS), SEEDS)
    base = runs.where(F.col("aux_set") == "base4").select("seed", F.col("score").alias("base_score"))
    j = runs.where(F.col("aux_set") != "base4").join(base, "seed")
    return j.select("aux_set", "seed", r6(F.col("score")).alias("score"), r6(F.col("base_score")).alias("base_score"),
                    r6(F.col("score") - F.col("base_score")).alias("delta"))


@query("wls_online_step")
def wls_online_step(spark, sf):
    """One gradient step per revealed day (sgd, fresh AdamW, kept AdamW)."""
    p = panel(spark, sf)
    out = None
    for opt in ("sgd", "adamw_fresh", "adamw_kept"):
        prep = WF.prepare(p, _multi_cfg(optimizer=opt, lr=0.01, grad_clip=1.0))
        s = _score(prep, "online", 1).withColumn("optimizer", F.lit(opt))
        out = s if out is None else out.unionByName(s)
    return out


@query("online_validation")
def online_validation(spark, sf):
    """The early-stopping holdout scored with daily online / refit updates
    (predict a day, then update), next to the static model."""
    prep = WF.prepare(panel(spark, sf), _multi_cfg())
    s = WF.score_suite(prep, [("full", 1), ("online", 1), ("refit", 1)], eval_fold="es")
    return s.select("variant", "cadence", "n_updates", "test_days", "test_rows", r6(F.col("score")).alias("score"))


from tidepanel.plans import epochs as EP  # noqa: E402

EPOCHS = EP.EpochConfig(epochs=12, patience=2, lr=0.004, lr_refit=0.002, weight_decay=0.01, grad_clip=0.5, optimizer="sgd")


def _epochs_sql() -> str:
    """Gradient steps day by day for several epochs, validated on a copy, in plain SQL."""
    e = EPOCHS

    def step(beta, day, lr):
        g = f"2 * ({day}.a * {beta} - {day}.b) / greatest({day}.c, 1e-6)"
        return f"{beta} * (1 - {lr} * {e.weight_decay}) - {lr} * greatest(-{e.grad_clip}, least({e.grad_clip}, {g}))"

    sse = "{1}.c - 2 * {0} * {1}.b + {0} * {0} * {1}.a".format
    panel = PANEL.replace("WITH ", "WITH RECURSIVE ", 1)
    return f"""{panel}, {_BOUNDS_CTE}, {_D1},
tr AS (SELECT row_number() OVER (ORDER BY date_id) AS k, a, b, c FROM ti WHERE fold = 'train'),
es AS (SELECT row_number() OVER (ORDER BY date_id) AS k, a, b, c FROM ti WHERE fold = 'es'),
te AS (SELECT row_number() OVER (ORDER BY date_id) AS k, a, b, c, n FROM ti WHERE fold = 'test'),
last AS (SELECT count(*) AS m FROM tr),
walk AS (SELECT 1 AS epoch, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS beta, CAST(0 AS DOUBLE) AS loss
  UNION ALL SELECT CASE WHEN walk.k = m THEN walk.epoch + 1 ELSE walk.epoch END, tr.k, {step('walk.beta', 'tr', e.lr)},
    ({sse('walk.beta', 'tr')}) / greatest(tr.c, 1e-6)
  FROM walk, last JOIN tr ON tr.k = CASE WHEN walk.k = m THEN 1 ELSE walk.k + 1 END WHERE walk.epoch < {e.epochs} OR walk.k < m),
val AS (SELECT epoch, CAST(0 AS BIGINT) AS k, beta, CAST(0 AS DOUBLE) AS sse, CAST(0 AS DOUBLE) AS sst FROM walk, last WHERE walk.k = m
  UNION ALL SELECT val.epoch, es.k, {step('val.beta', 'es', e.lr_refit)}, val.sse + {sse('val.beta', 'es')}, val.sst + es.c
  FROM val JOIN es ON es.k = val.k + 1),
sc AS (SELECT epoch, 1 - sse / sst AS score FROM val WHERE k = (SELECT max(k) FROM es)),
top AS (SELECT epoch, score, max(score) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sc),
led AS (SELECT epoch, score, max(CASE WHEN before IS NULL OR score > before THEN epoch END) OVER (ORDER BY epoch) AS best FROM top),
ran AS (SELECT * FROM led WHERE epoch <= coalesce((SELECT min(epoch) FROM led WHERE epoch - best >= {e.patience} + 1), {e.epochs})),
hist AS (SELECT ran.epoch, (SELECT avg(loss) FROM walk WHERE walk.epoch = ran.epoch AND walk.k > 0) AS train_loss, score,
  ran.epoch = (SELECT max(best) FROM ran) AS is_best, (SELECT beta FROM walk, last WHERE walk.epoch = ran.epoch AND walk.k = m) AS beta FROM ran),
live AS (SELECT CAST(0 AS BIGINT) AS k, beta, CAST(0 AS DOUBLE) AS sse, CAST(0 AS DOUBLE) AS sst FROM hist WHERE is_best
  UNION ALL SELECT te.k, {step('live.beta', 'te', e.lr_refit)}, live.sse + {sse('live.beta', 'te')}, live.sst + te.c
  FROM live JOIN te ON te.k = live.k + 1)"""


@query("wls_epochs", f"""{_epochs_sql()}
SELECT CAST(epoch AS BIGINT) AS epoch, round(train_loss, 6) AS train_loss, round(score, 6) AS valid_score, is_best, round(beta, 6) AS beta FROM hist""")
def wls_epochs(spark, sf):
    """Epochs of daily gradient steps with online validation and patience."""
    h = EP.epoch_history(_prep(spark, sf), EPOCHS)
    return h.select("epoch", r6(F.col("train_loss")).alias("train_loss"), r6(F.col("valid_score")).alias("valid_score"), "is_best",
                    r6(F.element_at("beta", 1)).alias("beta"))


@query("wls_epochs_score", f"""{_epochs_sql()}
SELECT CAST((SELECT epoch FROM hist WHERE is_best) AS BIGINT) AS best_epoch, CAST((SELECT count(*) FROM hist) AS BIGINT) AS n_epochs,
  CAST((SELECT count(*) FROM te) - 1 AS BIGINT) AS n_updates, CAST((SELECT count(*) FROM te) AS BIGINT) AS test_days,
  CAST((SELECT sum(n) FROM te) AS BIGINT) AS test_rows, round(1 - sse / sst, 6) AS score FROM live WHERE k = (SELECT max(k) FROM te)""")
def wls_epochs_score(spark, sf):
    """The restored epoch's model over the test block, one step a day."""
    return EP.epoch_walk_forward(_prep(spark, sf), EPOCHS).withColumn("score", r6(F.col("score")))


@query("walk_forward_wide")
def walk_forward_wide(spark, sf):
    """K13 + K10: the full model-input chain (lags of all responders, market averages, rolling
    mean/std of every feature) into the walk-forward suite; p = 42 inputs, so the day statistics
    are formed by BLAS per task and summed by Spark."""
    mf = FE.model_frame(panel(spark, sf), use_lags=True, use_market_avg=True, use_rolling=True, engineered=PANEL_FEATURES,
                        window=W_SMALL)
    feats = PANEL_FEATURES + LAG_COLUMNS + FE.engineered_columns(PANEL_FEATURES, True, True)
    cfg = WF.WalkForwardConfig(features=feats, ridge=1e-2, test_days=TEST_DAYS, valid_days=VALID_DAYS,
                               gap_days=GAP_DAYS)
    prep = WF.prepare(mf, cfg)
    s = WF.score_suite(prep, [("full", 1), ("retrain", 5), ("refit", 5), ("online", 1)])
    return s.select("variant", "cadence", "n_updates", "test_days", "test_rows", r6(F.col("score")).alias("score"))


@query("walk_forward_multi")
def walk_forward_multi(spark, sf):
    """K10/K11 with all panel inputs (standardised, intercept, ridge): every variant,
    all scored in one pass over the day-statistics table."""
    prep = WF.prepare(panel(spark, sf), _multi_cfg())
    s = WF.score_suite(prep, [("full", 1), ("retrain", 5), ("refit", 5), ("continue", 5), ("online", 1)])
    return s.select("variant", "cadence", "n_updates", "test_days", "test_rows", r6(F.col("score")).alias("score"))


# ------------------------------------------------------------------ streaming (L01-L05): plain window and group queries in SQL
from tidepanel.streaming import operators as STR  # noqa: E402


EVENTS = f"WITH ev AS ({FX.EVENTS_SQL})"
_LAGGED = ("lg AS (SELECT e.*, p.m AS value_lag_1 FROM ev e LEFT JOIN (SELECT user_id, time_id, date_id + 1 AS date_id, avg(value) AS m "
           "FROM ev GROUP BY 1, 2, 3) p USING (user_id, time_id, date_id))")


@query("stream_market_avg", f"""{EVENTS}
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
  avg(value) AS avg_value, CAST(count(*) AS BIGINT) AS n_events FROM ev GROUP BY 1, 2""")
def stream_market_avg(spark, sf):
    """Hourly cross-sectional average of the event stream with a watermark."""
    return STR.stream_market_avg(spark, STR.stage_events_by_day(spark, sf))


@query("stream_market_avg_sliding", f"""{EVENTS}, w AS (SELECT value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS window_start FROM ev)
SELECT window_start, window_start + INTERVAL 2 HOUR AS window_end, avg(value) AS avg_value, CAST(count(*) AS BIGINT) AS n_events
FROM w GROUP BY 1, 2""")
def stream_market_avg_sliding(spark, sf):
    """L01 (sliding): 2-hour windows every hour."""
    return STR.stream_market_avg(spark, STR.stage_events_by_day(spark, sf), "2 hours", "1 hour")


@query("stream_rolling", f"""{EVENTS}
SELECT event_id, user_id, ts, round(avg(value) OVER w, 6) AS roll_mean, round(coalesce(stddev_samp(value) OVER w, 0.0), 6) AS roll_std
FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def stream_rolling(spark, sf):
    """Per-user trailing 10-event mean / std held in keyed state."""
    out = STR.stream_rolling(spark, STR.stage_events_by_day(spark, sf), 10)
    return out.withColumns({c: r6(F.col(c)) for c in ("roll_mean", "roll_std",)})


@query("stream_day_lag", f"""{EVENTS}, {_LAGGED}
SELECT event_id, user_id, date_id, time_id, value, round(value_lag_1, 6) AS value_lag_1 FROM lg""")
def stream_day_lag(spark, sf):
    """Previous-day (user, hour) mean handed over at the day boundary."""
    out = STR.stream_day_lag(spark, STR.stage_events_by_day(spark, sf))
    return out.withColumns({c: r6(F.col(c)) for c in ("value_lag_1",)})


@query("stream_running_r2", f"""{EVENTS}, {_LAGGED},
d AS (SELECT date_id, sum((value - coalesce(value_lag_1, 0)) * (value - coalesce(value_lag_1, 0))) AS sse, sum(value * value) AS sst, count(*) AS n FROM lg GROUP BY 1)
SELECT date_id, CAST(sum(n) OVER (ORDER BY date_id) AS BIGINT) AS n_rows,
  round(1 - sum(sse) OVER (ORDER BY date_id) / sum(sst) OVER (ORDER BY date_id), 6) AS running_r2 FROM d""")
def stream_running_r2(spark, sf):
    """Running weighted R² of the previous-day predictor."""
    out = STR.stream_running_r2(spark, STR.stage_events_by_day(spark, sf))
    return out.withColumns({c: r6(F.col(c)) for c in ("running_r2",)})


@query("stream_predict_update", f"""{EVENTS}, h AS (SELECT time_id, date_id, sum(value) AS s, count(*) AS c FROM ev GROUP BY 1, 2),
m AS (SELECT time_id, date_id, sum(s) OVER w / sum(c) OVER w AS m FROM h WINDOW w AS (PARTITION BY time_id ORDER BY date_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, user_id, date_id, time_id, value, round(coalesce(m, 0.0), 6) AS prediction FROM ev LEFT JOIN m USING (time_id, date_id)""")
def stream_predict_update(spark, sf):
    """Predict each day, then update the model, one day per trigger."""
    out = STR.stream_predict_update(spark, STR.stage_events_by_day(spark, sf))
    return out.withColumns({c: r6(F.col(c)) for c in ("prediction",)})


from tidepanel.streaming import walk_forward as SWF  # noqa: E402


@query("stream_walk_forward", _wf_one("retrain", 5))
def stream_walk_forward(spark, sf):
    """The expanding-retrain walk-forward on a stream of panel rows."""
    p = panel(spark, sf).select(*ID_COLUMNS, "weight", "responder_6", WF_X)
    out = SWF.stream_walk_forward(spark, SWF.stage_panel(p), p.schema, _wf_cfg(), _bounds(p), 5)
    return SWF.summary(spark, out, _wf_cfg(), 5).withColumn("score", r6(F.col("score")))


# ------------------------------------------------------------------ survey keys served by a dedicated query
@query("over_clip", f"""{PANEL}, {_BOUNDS_CTE}, {_D1}, {_betas_sql('full', 1)}
SELECT CAST(count(*) FILTER (WHERE abs(beta.beta * panel.{WF_X}) > 5) AS BIGINT) AS n_over_clip,
  CAST(count(*) AS BIGINT) AS n_rows FROM panel, bounds, beta WHERE panel.date_id >= bounds.test_start""")
def over_clip(spark, sf):
    """Out-of-sample predictions outside ±5."""
    p = panel(spark, sf)
    prep = WF.prepare(p, _wf_cfg())
    return ME.over_clip(WF.predictions(p, prep, "full"), "prediction")


@query("delta_vs_full", _wf_many(_IVF, delta_only=True))
def delta_vs_full(spark, sf):
    """Each variant's score minus the static model's."""
    return _suite(_prep(spark, sf), _IVF, with_delta=True).select("variant", "delta_vs_full")
