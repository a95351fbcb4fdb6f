"""Experiment algebra over runs scored on the panel.

A *run* scores a one-input weighted least-squares predictor of the target: the fit
is ``β = Σ_fit w·x·y / Σ_fit w·x²`` over the run's fit days and the score the block R²
on its evaluation days, both from per-day sums (``a = Σw·x²``, ``b = Σw·x·y``,
``c = Σw·y²``), so a sweep of any size reads the panel rows once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.columns import DATE, TARGET_COLUMN, WEIGHT_COLUMN
from tidepanel.functions.exprs import fill_null
from tidepanel.plans.joins import join_small
from tidepanel.session import reliable_checkpoint


def candidate_day_stats(df: DataFrame, candidates: dict[str, Column], target: str = TARGET_COLUMN,
                        weight: str = WEIGHT_COLUMN) -> DataFrame:
    """Long (date_id, candidate, a, b, c, n): one wide aggregation, then unpivot of the
    small per-day table (never of the panel rows). Inputs: NULL -> 0."""
    y, w = F.col(target), F.col(weight)
    aggs = [F.sum(w * y * y).alias("c"), F.count(F.lit(1)).cast("bigint").alias("n")]
    for name, x in candidates.items():
        xv = fill_null(x)
        aggs += [F.sum(w * xv * xv).alias(f"a__{name}"), F.sum(w * xv * y).alias(f"b__{name}")]
    wide = df.groupBy(DATE).agg(*aggs)
    structs = [F.struct(F.lit(n).alias("candidate"), F.col(f"a__{n}").alias("a"), F.col(f"b__{n}").alias("b"))
               for n in candidates]
    return wide.select(DATE, "c", "n", F.explode(F.array(*structs)).alias("s")).select(
        DATE, "s.candidate", "s.a", "s.b", "c", "n")


def score_from_sums(beta: Column, a: Column, b: Column, c: Column) -> Column:
    """Block R² from summed statistics of the evaluation days."""
    return 1 - (c - 2 * beta * b + beta * beta * a) / c


# ------------------------------------------------------------------ split grid
def split_grid(date_stats: DataFrame, valid_days: list[int], gap_days: list[int],
               stem: str = "split", first_n: int | None = None) -> DataFrame:
    """Grid of holdout splits (valid x gap) from the observed date range,
    run names ``<stem>_v<valid>_g<gap>``; infeasible cells flagged, not dropped.

    The grid is generated by ``explode`` of parameter arrays over the one-row date
    range (no join).
    """
    rng = date_stats.agg(F.min(DATE).alias("dmin"), F.max(DATE).alias("dmax"))
    cells = rng.select("dmin", "dmax", F.explode(F.array(*[F.lit(v) for v in valid_days])).alias("valid_days"))
    cells = cells.select("*", F.explode(F.array(*[F.lit(g) for g in gap_days])).alias("gap_days"))
    valid_start = F.col("dmax") - F.col("valid_days") + 1
    train_end = valid_start - F.col("gap_days") - 1
    grid = cells.select(
        F.format_string(f"{stem}_v%d_g%d", "valid_days", "gap_days").alias("run_name"),
        F.col("valid_days").cast("bigint").alias("valid_days"), F.col("gap_days").cast("bigint").alias("gap_days"),
        F.col("dmin").alias("train_start"), train_end.alias("train_end"), valid_start.alias("valid_start"),
        F.col("dmax").alias("valid_end"),
        ((valid_start > F.col("dmin")) & (train_end >= F.col("dmin"))).alias("feasible"))
    # keep the first N cells in grid order (valid-major, as listed).
    return grid if first_n is None else grid.orderBy("valid_days", "gap_days").limit(first_n)


def split_grid_scores(day_stats: DataFrame, grid: DataFrame) -> DataFrame:
    """Score every feasible grid cell for every candidate input.

    The grid (parameter-sized, a handful of cells) is attached to every per-day
    statistics row by ``explode`` of an array literal built from it, instead of a cross
    join; each day row then finds its role (train / valid / none) in every cell.
    """
    cells = [r.asDict() for r in grid.where("feasible").collect()]  # parameter grid: a handful of rows
    arr = F.array(*[F.struct(F.lit(c["run_name"]).alias("run_name"),
                             F.lit(c["valid_days"]).cast("bigint").alias("valid_days"),
                             F.lit(c["gap_days"]).cast("bigint").alias("gap_days"), F.lit(c["train_start"]).alias("train_start"),
                             F.lit(c["train_end"]).alias("train_end"), F.lit(c["valid_start"]).alias("valid_start"),
                             F.lit(c["valid_end"]).alias("valid_end")) for c in cells])
    d = day_stats.select("*", F.explode(arr).alias("cell")).select("*", "cell.*").drop("cell")
    role = (F.when(F.col(DATE).between(F.col("train_start"), F.col("train_end")), "train")
            .when(F.col(DATE).between(F.col("valid_start"), F.col("valid_end")), "valid"))
    d = d.select("*", role.alias("role")).where(F.col("role").isNotNull())
    keys = ["run_name", "valid_days", "gap_days", "candidate"]
    s = d.groupBy(*keys).agg(
        F.sum(F.when(F.col("role") == "train", F.col("a"))).alias("a_fit"),
        F.sum(F.when(F.col("role") == "train", F.col("b"))).alias("b_fit"),
        F.sum(F.when(F.col("role") == "valid", F.col("a"))).alias("a_ev"),
        F.sum(F.when(F.col("role") == "valid", F.col("b"))).alias("b_ev"),
        F.sum(F.when(F.col("role") == "valid", F.col("c"))).alias("c_ev"),
        F.sum(F.when(F.col("role") == "valid", F.col("n"))).cast("bigint").alias("valid_rows"))
    beta = F.col("b_fit") / F.col("a_fit")
    return s.select(*keys, "valid_rows", beta.alias("beta"),
                    score_from_sums(beta, F.col("a_ev"), F.col("b_ev"), F.col("c_ev")).alias("score"))


def split_stability(scores: DataFrame) -> DataFrame:
    """Mean, population std, min, max and all-positive over splits."""
    return scores.agg(F.count(F.lit(1)).cast("bigint").alias("n_splits"), F.avg("score").alias("mean"),
                      F.stddev_pop("score").alias("pstdev"), F.min("score").alias("min"),
                      F.max("score").alias("max"), F.bool_and(F.col("score") > 0).alias("all_positive"))


def valid_days_trend(scores: DataFrame) -> DataFrame:
    """Mean score per ``valid_days`` and whether it rises with the window length."""
    per = scores.groupBy("valid_days").agg(F.avg("score").alias("mean_score"))
    w = Window.orderBy("valid_days")  # one row per window length: parameter-sized
    prev = F.lag("mean_score").over(w)
    step = per.select("valid_days", "mean_score", (prev.isNull() | (F.col("mean_score") >= prev)).alias("up"))
    return step.select("valid_days", "mean_score",
                       F.bool_and("up").over(Window.partitionBy(F.lit(1))).alias("monotone_increasing"))


def gap_effect(scores: DataFrame) -> DataFrame:
    """Per valid_days, relative change from the smallest to the largest gap; averaged."""
    per = scores.groupBy("valid_days").agg(
        F.min_by("score", "gap_days").alias("s_lo"), F.max_by("score", "gap_days").alias("s_hi"),
        F.countDistinct("gap_days").alias("n_gaps"))
    rel = per.where(F.col("n_gaps") > 1).select(((F.col("s_hi") - F.col("s_lo")) / F.abs(F.col("s_lo"))).alias("rel"))
    return rel.agg(F.count(F.lit(1)).cast("bigint").alias("n_windows"), F.avg("rel").alias("mean_relative_change"))


def rank_candidates(scores: DataFrame, top: int = 5) -> DataFrame:
    """Per run: rank of each candidate by score (ties by name) and the ``|``-joined top list."""
    w = Window.partitionBy("run_name").orderBy(F.desc("score"), F.asc("candidate"))
    ranked = scores.select("run_name", "candidate", "score", F.row_number().over(w).alias("rank"))
    return ranked


def top_lists(ranked: DataFrame, top: int = 5) -> DataFrame:
    """Per run, the ``|``-joined names of its top ``top`` candidates in rank order."""
    best = ranked.where(F.col("rank") <= top).groupBy("run_name").agg(
        F.sort_array(F.collect_list(F.struct("rank", "candidate"))).alias("s"))  # <= top entries
    return best.select("run_name", F.array_join(F.transform("s", lambda e: e["candidate"]), "|").alias(f"top_{top}"))


def rank_stability_from_lists(lists: DataFrame, candidates: list[str], col: str = "top_5") -> DataFrame:
    """D12 from stored top lists (H05): #runs a candidate is first / listed at all."""
    parts = F.split(F.col(col), r"\|")
    rows = lists.select(F.explode(F.array(*[F.lit(c) for c in candidates])).alias("candidate"), parts.alias("p"))
    return rows.groupBy("candidate").agg(
        F.count_if(F.element_at("p", 1) == F.col("candidate")).cast("bigint").alias("n_first"),
        F.count_if(F.array_contains("p", F.col("candidate"))).cast("bigint").alias("n_top"))


def rank_stability(ranked: DataFrame, top: int = 5) -> DataFrame:
    """Per candidate, how many runs rank it first and how many within the top ``top``."""
    return ranked.groupBy("candidate").agg(
        F.count_if(F.col("rank") == 1).cast("bigint").alias("n_first"),
        F.count_if(F.col("rank") <= top).cast("bigint").alias("n_top"))


# ------------------------------------------------------------------ seeded sweeps
def seeded_day_weight(seed: Column, date_col: str = DATE) -> Column:
    """Weight (0.5 to 1.5, 1 on average) of a fit day: the run-to-run variation of a
    deterministic fit. Every day takes part in every run."""
    return F.lit(0.5) + F.pmod(F.col(date_col) * 7 + seed * 13, F.lit(10)) / 9


def seeded_runs(day_stats: DataFrame, specs: list[dict], seeds: list[int], fit_end: int,
                test_start: int) -> DataFrame:
    """Score run specs ``{kind, window, subset, candidate}`` (window -> ``roll_window``) for every seed.

    Specs x seeds are attached to the per-day statistics by ``explode`` (parameter
    sized), so all runs come out of one aggregation.
    """
    arr = F.array(*[F.struct(F.lit(s["kind"]).alias("kind"), F.lit(s.get("window")).cast("int").alias("roll_window"),
                             F.lit(s.get("subset")).cast("string").alias("subset"),
                             F.lit(s["candidate"]).alias("want"), F.lit(seed).alias("seed"))
                    for s in specs for seed in seeds])
    d = day_stats.select("*", F.explode(arr).alias("r")).select("*", "r.*").drop("r")
    d = d.where(F.col("candidate") == F.col("want"))
    fit = F.col(DATE) <= fit_end
    w = seeded_day_weight(F.col("seed"))
    ev = F.col(DATE) >= test_start
    s = d.groupBy("kind", "roll_window", "subset", "seed").agg(
        F.sum(F.when(fit, w * F.col("a"))).alias("a_fit"), F.sum(F.when(fit, w * F.col("b"))).alias("b_fit"),
        F.sum(F.when(ev, F.col("a"))).alias("a_ev"), F.sum(F.when(ev, F.col("b"))).alias("b_ev"),
        F.sum(F.when(ev, F.col("c"))).alias("c_ev"))
    beta = F.col("b_fit") / F.col("a_fit")
    return s.select("kind", "roll_window", "subset", "seed",
                    score_from_sums(beta, F.col("a_ev"), F.col("b_ev"), F.col("c_ev")).alias("score"))


def paired_delta(runs: DataFrame) -> DataFrame:
    """Each candidate run joined to its same-seed baseline; unmatched runs dropped.

    The runs (one row per spec and seed) are stored first: both sides read them.
    """
    runs = reliable_checkpoint(runs)
    base = runs.where(F.col("kind") == "baseline").select("seed", F.col("score").alias("baseline_score"))
    cand = runs.where(F.col("kind") != "baseline")
    j = join_small(cand, base, ["seed"], "inner")
    return j.select("roll_window", "subset", "seed", F.col("score").alias("marketroll_score"), "baseline_score",
                    (F.col("score") - F.col("baseline_score")).alias("delta"))


def cell_summary(paired: DataFrame) -> DataFrame:
    """Per (window, subset) cell, best mean delta first."""
    return (paired.groupBy("roll_window", "subset").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_seeds"), F.avg("delta").alias("mean_delta"),
        F.coalesce(F.stddev_samp("delta"), F.lit(0.0)).alias("std_delta"),
        F.count_if(F.col("delta") > 0).cast("bigint").alias("n_positive"),
        F.avg("marketroll_score").alias("mean_marketroll"), F.avg("baseline_score").alias("mean_baseline"))
        .orderBy(F.desc("mean_delta"), "roll_window", "subset"))


def best_cell(summary: DataFrame, label_cols: list[str], score_col: str) -> DataFrame:
    """The arg-max row (top-1; ties broken by the smallest label)."""
    lab = F.concat_ws("/", *[F.col(c).cast("string") for c in label_cols])
    return summary.select(lab.alias("best"), F.col(score_col)).orderBy(F.desc(score_col), "best").limit(1)


def delta_vs(table: DataFrame, label_col: str, reference: str, score_col: str = "score") -> DataFrame:
    """Score minus the reference row's score (``full`` by default)."""
    ref = F.max(F.when(F.col(label_col) == reference, F.col(score_col))).over(Window.partitionBy(F.lit(1)))
    return table.select("*", (F.col(score_col) - ref).alias(f"delta_vs_{reference}"))
