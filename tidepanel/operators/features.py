"""Leakage-safe feature operators on a (date, time, symbol) panel.

C01 previous-day responder lag, E01 market average, E02/E03 trailing rolling mean/std,
E04/E05 forward-shift auxiliary targets, D19/H02 standardiser, B07 placeholders,
F03 ranked subsets, K13 the model-input chain.

Row order is never implicit: every per-symbol series operator orders by
(date_id, time_id), ties by the remaining columns. There is one plan for all inputs: the row counts of
(symbol, date) blocks give the chunk of a series that a block belongs to, rows go to
(symbol, chunk) together with a halo of the neighbouring chunks, and all windows run
there; they spread evenly over tasks whatever the number of symbols, the largest symbol
or the cores, and the rows are shuffled once. Null symbols form one
series; rows with equal keys stay rows of their own; NaN and infinite values count as
null.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from tidepanel.columns import (
    AUX9_LEADS,
    AUX10_LEADS,
    DATE,
    FEATURE_COLUMNS,
    FEATURE_IMPORTANCE_RANKING,
    ID_COLUMNS,
    LAG_COLUMNS,
    RESPONDER_COLUMNS,
    SYMBOL,
    TARGET_COLUMN,
    TIME,
    subset_features,
)
from tidepanel.functions.exprs import fill_null, nan_to_null
from tidepanel.operators.schema import require_columns
from tidepanel.plans.joins import bounded_broadcast, join_small
from tidepanel.session import reliable_checkpoint

POS = "_pos"

def present_features(df: DataFrame, features: Iterable[str] | str | None = None) -> list[str]:
    """The listed features, those of a named subset, or all features of the frame.

    A subset (``top12``, ``top24``, ``all``) is a prefix of the importance ranking of the
    features that the frame has.
    """
    own = [c for c in FEATURE_COLUMNS if c in df.columns]
    if isinstance(features, str):
        return subset_features(features, [c for c in FEATURE_IMPORTANCE_RANKING if c in own])
    feats = list(features) if features is not None else own
    require_columns(df, feats, "features")
    return feats


# --------------------------------------------------------------------------- E01
def market_average(df: DataFrame, features: list[str] | None = None,
                   keys: tuple[str, ...] = (DATE, TIME), suffix: str = "_mkt",
                   method: str = "join") -> DataFrame:
    """``<f>_mkt`` = mean of ``f`` over all symbols at the same (date, time); nulls skipped.

    ``join``: partial-aggregate per (date, time) (map-side combine, no hot key), then
    join back; the aggregate is broadcast only after a bounded size check, so the panel
    itself is not shuffled. ``window``: ``avg().over(partitionBy(date, time))``.
    """
    feats = present_features(df, features)
    require_columns(df, list(keys), "market_average")
    if method == "window":
        w = Window.partitionBy(*keys)
        return df.select("*", *[F.avg(f).over(w).alias(f + suffix) for f in feats])
    agg = df.groupBy(*keys).agg(*[F.avg(f).alias(f + suffix) for f in feats])
    return join_small(df, agg, list(keys), "left")


# ------------------------------------------------------------ per-symbol series index
def _finite(c: str):
    """The column as double, null where it is NaN or infinite."""
    x = F.col(c).cast("double")
    return F.when((x - x) == F.lit(0.0), x)


def _ties(df: DataFrame, *but: str) -> list[str]:
    """The remaining sortable columns: rows that are equal in them too are interchangeable."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, AtomicType) and f.name not in but]


def _block_offsets(df: DataFrame, key: str, block: str) -> DataFrame:
    """``_key, _block, _n, _off``: rows of a block and of the earlier blocks of its series."""
    before = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(F.col(key).alias("_key"), F.col(block).alias("_block")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.select("*", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))


def _with_blocks(df: DataFrame, blocks: DataFrame, key: str, block: str, max_rows: int | None = None) -> DataFrame:
    """Left join of a table of blocks to the rows; it is stored, counted, and broadcast if small."""
    side, _ = bounded_broadcast(reliable_checkpoint(blocks), max_rows=max_rows)
    return df.join(side, df[key].eqNullSafe(side["_key"]) & df[block].eqNullSafe(side["_block"]), "left").drop("_key", "_block")


def series_index(df: DataFrame, key: str = SYMBOL, block: str = DATE,
                 order: tuple[str, ...] = (TIME,), pos_col: str = POS) -> DataFrame:
    """Dense 0-based position of each row in its ``key`` series ordered by (block, order).

    Two passes instead of one window over the whole series: row numbers inside
    (key, block) groups, plus the exclusive running row count of earlier blocks taken
    from the small (key, block) count table. Equal (key, block, order) rows are ordered
    by the remaining columns, so repeated evaluations agree; null keys and blocks are
    values like any other (nulls first).
    """
    w = Window.partitionBy(key, block).orderBy(*order, *_ties(df, key, block, *order))
    local = df.select("*", (F.row_number().over(w) - 1).alias("_local"))
    offs = _block_offsets(df, key, block).drop("_n")
    out = local.join(offs, local[key].eqNullSafe(offs["_key"]) & local[block].eqNullSafe(offs["_block"]))
    return out.withColumn(pos_col, (F.col("_off") + F.col("_local")).cast("long")).drop("_off", "_local", "_key", "_block")


def canonical_rank(df: DataFrame, out: str = "canonical_rank") -> DataFrame:
    """dense 0-based position in (date, time, symbol) order.

    Positions inside a date come from its (date, time) blocks; only the per-date counts
    (one row per date) are added up in one place.
    """
    ranked = series_index(df, key=DATE, block=TIME, order=(SYMBOL,), pos_col="_in_date")
    before = Window.orderBy("_date").rowsBetween(Window.unboundedPreceding, -1)
    days = df.groupBy(F.col(DATE).alias("_date")).agg(F.count(F.lit(1)).alias("_n"))
    days = days.select("_date", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (ranked.join(days, ranked[DATE].eqNullSafe(days["_date"]))
            .withColumn(out, (F.col("_off") + F.col("_in_date")).cast("long")).drop("_off", "_in_date", "_date"))


LEAD_CHUNK = 1 << 16  # rows of a series in one window partition


def lead_rows(df: DataFrame, leads: dict[str, list[int]], key: str = SYMBOL,
              pos_col: str = POS, chunk: int | None = None) -> DataFrame:
    """Add ``<c>_lead<k>`` = value of ``c`` ``k`` rows later in the same series.

    Positions are cut into chunks; every row goes to its chunk and the first ``max(k)``
    rows of a chunk are also copied (narrowly) to the previous one as a halo, so a window
    over (key, chunk) ordered by position serves all shifts. One shuffle of the rows;
    each window partition is bounded by ``chunk + max(k)`` rows whatever the keys.
    """
    kmax = max(k for ks in leads.values() for k in ks)
    chunk = max(chunk or LEAD_CHUNK, kmax)
    ch = F.floor(F.col(pos_col) / chunk).cast("long")
    own = df.select("*", ch.alias("_chunk"), F.lit(False).alias("_halo"))
    halo = (df.where((F.col(pos_col) % chunk) < kmax)
            .select(key, pos_col, *leads, (ch - 1).alias("_chunk"), F.lit(True).alias("_halo")))
    w = Window.partitionBy(key, "_chunk").orderBy(pos_col)
    exprs = [F.lead(c, k).over(w).alias(f"{c}_lead{k}") for c, ks in leads.items() for k in ks]
    out = own.unionByName(halo, allowMissingColumns=True).select("*", *exprs).where(~F.col("_halo"))
    return out.drop("_chunk", "_halo")


def series_chunks(df: DataFrame, before: int = 0, after: int = 0, key: str = SYMBOL, block: str = DATE,
                  chunk: int | None = None) -> DataFrame:
    """Deals the rows to ``(key, _chunk)``; ``_halo`` marks copies from neighbouring chunks.

    A chunk takes whole (key, block) groups whose first row lies in ``chunk`` consecutive
    positions of the series; every chunk also gets the groups that hold the ``before``
    rows ahead of it and the ``after`` rows behind it. Those rows lie in at most two
    chunks on either side, as ``chunk`` is at least ``before`` and ``after``. All of this
    is decided on the table of block counts. A series that lies in its first chunk needs no
    table; the blocks of the others are stored, counted and broadcast if few (else joined by
    a shuffle), so the rows meet one exchange: that of the windows over ``(key, _chunk)``
    that follow.
    """
    size = max(chunk or LEAD_CHUNK, before, after)
    b = _block_offsets(df, key, block).withColumn("_chunk", F.floor(F.col("_off") / size).cast("long"))
    b = b.withColumn("_last", F.max("_chunk").over(Window.partitionBy("_key"))).where(F.col("_last") > 0)
    b = b.withColumn("_own", F.struct("_chunk", F.min("_off").over(Window.partitionBy("_key", "_chunk")).alias("start")))
    earlier = Window.partitionBy("_key").orderBy("_chunk").rangeBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("_key").orderBy(F.desc("_chunk")).rangeBetween(Window.unboundedPreceding, -1)
    copies = []
    if before:
        b = b.withColumn("_n1", F.min("_own").over(later))
        b = b.withColumn("_n2", F.min(F.struct("_own", "_n1")).over(later)["_n1"])
        end = F.col("_off") + F.col("_n")
        copies += [F.when(F.col(f"{c}.start") - end < before, F.col(f"{c}._chunk")) for c in ("_n1", "_n2")]
    if after:
        b = b.withColumn("_p1", F.max("_own").over(earlier))
        b = b.withColumn("_p2", F.max(F.struct("_own", "_p1")).over(earlier)["_p1"])
        # a chunk ends where the next one starts
        copies += [F.when(F.col("_off") - F.col(f"{c}.start") < after, F.col(f"{up}._chunk")) for c, up in (("_own", "_p1"), ("_p1", "_p2"))]
    to = F.array(F.struct(F.col("_chunk"), F.lit(False).alias("_halo")), *[F.struct(c.alias("_chunk"), F.lit(True).alias("_halo")) for c in copies])
    blocks = b.select("_key", "_block", F.filter(to, lambda t: t["_chunk"].isNotNull()).alias("_to"))
    first = F.array(F.struct(F.lit(0).cast("long").alias("_chunk"), F.lit(False).alias("_halo")))
    dealt = _with_blocks(df, blocks, key, block, max_rows=500_000)
    return dealt.select(*df.columns, F.inline(F.coalesce("_to", first)))


# ------------------------------------------------------------------- E02-E05 together
def series_features(df: DataFrame, aux: bool = False, rolling: list[str] | None = None, window: int = 1000,
                    key: str = SYMBOL) -> DataFrame:
    """Auxiliary targets and rolling statistics (see below) from one exchange of the rows."""
    if window < 1:
        raise ValueError("window must be >= 1")
    feats = rolling or []
    rows = series_chunks(df, before=window - 1 if feats else 0, after=max(*AUX9_LEADS, *AUX10_LEADS) if aux else 0, key=key)
    in_order = Window.partitionBy(key, "_chunk").orderBy(DATE, TIME, *_ties(df, key, DATE, TIME))
    added = []
    if aux:
        r6, r8 = "responder_6", "responder_8"
        rows = rows.select("*", *[F.lead(c, k).over(in_order).alias(f"_{c}_lead{k}")
                                  for c, ks in ((r8, AUX9_LEADS), (r6, AUX10_LEADS)) for k in ks],
                           *[(F.row_number().over(in_order) - 1).alias("_lpos")] * bool(feats))
        s9 = sum((F.col(f"_{r8}_lead{k}") for k in AUX9_LEADS), F.col(r8))
        s10 = sum((F.col(f"_{r6}_lead{k}") for k in AUX10_LEADS), F.col(r6))
        added += [fill_null(s9).alias("responder_9"), fill_null(s10).alias("responder_10")]
    elif feats:
        rows = rows.select("*", (F.row_number().over(in_order) - 1).alias("_lpos"))
    if feats:
        rows, stats = _rolling(rows, feats, window, key)
        added += stats
    return rows.where(~F.col("_halo")).select(*df.columns, *added)


# ------------------------------------------------------------------------- E04/E05
def add_aux_targets(df: DataFrame) -> DataFrame:
    """``responder_9 = r8 + r8[+4]`` and ``responder_10 = r6 + r6[+20] + r6[+40]``.

    Shifts count rows of the symbol's (date, time)-ordered series and cross day
    boundaries; ``fill_null(0)`` applies to the whole sum, so a missing term gives 0.
    """
    require_columns(df, ["responder_6", "responder_8", SYMBOL, DATE, TIME], "aux targets")
    return series_features(df, aux=True)


# ------------------------------------------------------------------------- E02/E03
def rolling_stats(df: DataFrame, features: list[str] | None = None, window: int = 1000,
                  key: str = SYMBOL) -> DataFrame:
    """Trailing ``window``-row mean (min 1 sample) and std (ddof 1, min 2, null -> 0).

    Nulls, NaN and infinities occupy a row of the window but are not samples.

    A dealt chunk is cut into blocks of ``window`` rows. A trailing window is then the tail
    of one block and the head of the next; running (count, mean, squared deviations) from
    either end of a block are combined by the parallel-variance rule. The cost per row
    does not depend on ``window``, and no large sums are subtracted, so the digits hold
    at any level. Every window runs inside (key, chunk).
    """
    return series_features(df, rolling=present_features(df, features), window=window, key=key)


def _rolling(rows: DataFrame, feats: list[str], window: int, key: str) -> tuple[DataFrame, list]:
    """Rows of ``series_chunks`` with ``_lpos`` -> running statistics, and the columns made of them."""
    vals = [f"_v_{f}" for f in feats]
    rows = rows.select("*", F.floor(F.col("_lpos") / window).cast("long").alias("_blk"), *[_finite(f).alias(v) for f, v in zip(feats, vals, strict=True)])
    in_block = Window.partitionBy(key, "_chunk", "_blk")

    def running(w, tag):
        w = w.rowsBetween(Window.unboundedPreceding, 0)
        out = []
        for f, v in zip(feats, vals, strict=True):
            n = F.count(v).over(w)
            out += [n.alias(f"_{tag}n_{f}"), F.avg(v).over(w).alias(f"_{tag}m_{f}"), (F.var_pop(v).over(w) * n).alias(f"_{tag}q_{f}")]
        return out

    rows = rows.select("*", *running(in_block.orderBy(F.desc("_lpos")), "t"))
    rows = rows.select("*", *running(in_block.orderBy("_lpos"), "h"))
    # the tail that completes a head of k rows starts window - k rows before the block
    back = Window.partitionBy(key, "_chunk").orderBy("_blk", "_lpos")
    whole = F.col("_lpos") % window == window - 1
    tails = [F.when(~whole, F.lag(f"_t{x}_{f}", window - 1).over(back)).alias(f"_p{x}_{f}") for f in feats for x in "nmq"] if window > 1 else [
        F.lit(None).cast("double").alias(f"_p{x}_{f}") for f in feats for x in "nmq"]
    rows = rows.select("*", *tails)
    out = []
    for f in feats:
        n1, n2 = F.coalesce(F.col(f"_pn_{f}"), F.lit(0)), F.col(f"_hn_{f}")
        m1, m2 = F.coalesce(f"_pm_{f}", f"_hm_{f}"), F.coalesce(f"_hm_{f}", f"_pm_{f}")
        n = n1 + n2
        mean = m1 + (m2 - m1) * n2 / n
        q = F.coalesce(F.col(f"_pq_{f}"), F.lit(0.0)) + F.coalesce(F.col(f"_hq_{f}"), F.lit(0.0)) + (m2 - m1) * (m2 - m1) * n1 * n2 / n
        out += [F.when(n >= 1, mean).alias(f"{f}_roll_mean"),
                F.when(n >= 2, F.sqrt(q / (n - 1))).otherwise(F.lit(0.0)).alias(f"{f}_roll_std")]
    return rows, out


# ----------------------------------------------------------------------------- C01
def responder_lag(df: DataFrame, responders: list[str] | None = None,
                  assert_unique: bool = False) -> DataFrame:
    """Previous-day responders at the same (time, symbol): ``responder_i_lag_1``.

    Self left equi-join on (date_id + 1, time_id, symbol_id). The first date and
    orphan keys get NULL. Keys are assumed unique (duplicates fan out, as in a plain
    join); ``assert_unique`` raises inside the plan if they are not.
    """
    resp = responders if responders is not None else RESPONDER_COLUMNS
    require_columns(df, ID_COLUMNS + resp, "responder_lag")
    src = df
    if assert_unique:
        dup = df.groupBy(*ID_COLUMNS).count().where("count > 1").limit(1).count()
        if dup:
            raise ValueError("responder_lag: duplicate (date_id, time_id, symbol_id) keys")
    lags = src.select((F.col(DATE) + 1).alias(DATE), TIME, SYMBOL,
                      *[F.col(r).alias(f"{r}_lag_1") for r in resp])
    # Both sides are the whole panel: a shuffle join on evenly spread unique keys,
    # never a broadcast, whatever the planner's size estimate says.
    return df.join(lags.hint("merge"), ID_COLUMNS, "left")


# ----------------------------------------------------------------------------- B07
def add_placeholders(df: DataFrame, columns: list[str], source: str = TARGET_COLUMN) -> DataFrame:
    """Absent columns (e.g. responder_7/8 of a test batch) := ``source``."""
    require_columns(df, [source], "placeholders")
    missing = [c for c in columns if c not in df.columns]
    if not missing:
        return df
    return df.withColumns({c: F.col(source) for c in missing})


# ------------------------------------------------------------------------ D19/H02
def fit_standardizer(df: DataFrame, features: list[str] | None = None,
                     eps: float = 1e-6) -> DataFrame:
    """Long (feature, mean, std): NaN-aware mean and population std, all-null -> (0, 1),
    std floored at ``eps``. One aggregation pass with map-side combine."""
    feats = present_features(df, features)
    aggs = []
    for f in feats:
        x = nan_to_null(F.col(f))
        aggs += [F.coalesce(F.avg(x), F.lit(0.0)).alias(f"m_{f}"),
                 F.greatest(F.coalesce(F.stddev_pop(x), F.lit(1.0)), F.lit(eps)).alias(f"s_{f}")]
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mean"), F.col(f"s_{f}").alias("std"))
        for f in feats])).alias("s")).select("s.*")


def apply_standardizer(df: DataFrame, stats: DataFrame | dict[str, tuple[float, float]],
                       features: list[str] | None = None, suffix: str = "") -> DataFrame:
    """``coalesce((x - mean) / std, 0)``. The statistics table has one row per feature
    (bounded by the column count), so it is inlined as literals."""
    if isinstance(stats, DataFrame):
        stats = {r["feature"]: (r["mean"], r["std"]) for r in stats.collect()}
    feats = features if features is not None else list(stats)
    exprs = {f + suffix: fill_null(nan_to_null((F.col(f) - F.lit(stats[f][0])) / F.lit(stats[f][1])))
             for f in feats}
    return df.withColumns(exprs)


# ----------------------------------------------------------------------------- F03
def ranked_subset(importance: DataFrame, k: int | None, feature_col: str = "feature",
                  score_col: str = "importance") -> DataFrame:
    """Top-``k`` features of an importance table (ties by name), with their rank."""
    w = Window.orderBy(F.desc(score_col), F.asc(feature_col))
    ranked = importance.select(feature_col, score_col, F.row_number().over(w).cast("bigint").alias("rank"))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


# ----------------------------------------------------------------------------- K13
def model_frame(df: DataFrame, *, features: list[str] | str | None = None,
                use_aux: bool = False, use_lags: bool = False, use_market_avg: bool = False,
                use_rolling: bool = False, engineered: list[str] | str | None = None,
                window: int = 1000, lags: list[str] | None = None) -> DataFrame:
    """Model-input chain in the reference order: placeholders -> aux -> lags -> market
    average -> rolling; returns ids, weight, responders and the model inputs. ``features`` and
    ``engineered`` are lists or named subsets; ``lags`` names the lagged responders (all by default)."""
    feats = present_features(df, features)
    eng = present_features(df, engineered) if engineered is not None else feats
    out = add_placeholders(df, ["responder_7", "responder_8"]) if use_aux else df
    if use_aux:
        require_columns(out, ["responder_6", "responder_8", SYMBOL, DATE, TIME], "aux targets")
    if use_aux or use_rolling:  # both from one exchange; the rolling columns go last
        out = series_features(out, aux=use_aux, rolling=eng if use_rolling else None, window=window)
    if use_lags:
        out = responder_lag(out, lags)
    if use_market_avg:
        out = market_average(out, eng)
    last = engineered_columns(eng, False, True) if use_rolling else []
    return out.select(*[c for c in out.columns if c not in last], *last)


def engineered_columns(features: list[str], use_market_avg: bool, use_rolling: bool) -> list[str]:
    cols = []
    if use_market_avg:
        cols += [f"{f}_mkt" for f in features]
    if use_rolling:
        for f in features:
            cols += [f"{f}_roll_mean", f"{f}_roll_std"]
    return cols


def input_columns(df: DataFrame, *, features: list[str] | str | None = None, symbol: bool = True, time: bool = True,
                  use_lags: bool = False, use_market_avg: bool = False, use_rolling: bool = False,
                  engineered: list[str] | str | None = "top12") -> list[str]:
    """The model inputs in their fixed order: features, ``symbol_id``, ``time_id``, lags, then
    the engineered columns of ``engineered`` (see ``model_frame``)."""
    cols = present_features(df, features) + [SYMBOL] * symbol + [TIME] * time
    if use_lags:
        cols += LAG_COLUMNS
    return cols + engineered_columns(present_features(df, engineered), use_market_avg, use_rolling)


__all__ = [
    "add_aux_targets", "add_placeholders", "apply_standardizer", "canonical_rank",
    "fit_standardizer", "input_columns", "lead_rows", "market_average", "model_frame", "ranked_subset",
    "responder_lag", "rolling_stats", "series_chunks", "series_features", "series_index",
]
