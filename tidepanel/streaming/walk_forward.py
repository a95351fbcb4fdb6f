"""Walk-forward on a stream: expanding retrain, predicted day by day.

Panel rows arrive in date order, in files of any size. Every micro-batch adds its rows to
the per-day sufficient statistics, fits the model versions that its test days use on days
before them, and predicts its rows with the version of their day:

- ``stats/batch=<id>``  partial statistics of a batch, per date;
- ``models/date=<day>`` the version and coefficients that predict a test day;
- ``pred/batch=<id>``   predictions of a batch.

Each folder is overwritten by the batch (or day) that owns it, so a batch that is replayed
after a failure changes nothing, and a restarted query goes on where it stopped. The
statistics are one row per date and batch; a model is never fitted on rows again. Scores
equal ``walk_forward.score_variant(prep, "retrain", cadence)`` on the same rows, however
days are cut into files and batches.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.columns import DATE
from tidepanel.operators.splits import NestedSplit
from tidepanel.plans import walk_forward as WF
from tidepanel.plans import wls
from tidepanel.session import checkpoint_path


def stage_panel(panel: DataFrame, days_per_file: int = 8, path: str | None = None) -> str:
    """Replay folder of a panel: files of ``days_per_file`` dates, oldest first.

    Stands for the upstream that drops files as days close; the file source follows the
    age of the files.
    """
    spark = panel.sparkSession
    path = path or checkpoint_path(spark, f"panel_stream_{uuid.uuid4().hex[:10]}")
    span = panel.agg(F.min(DATE).alias("lo"), F.max(DATE).alias("hi")).first()
    if span["lo"] is None:
        return path
    for lo in range(int(span["lo"]), int(span["hi"]) + 1, days_per_file):
        part = panel.where(F.col(DATE).between(lo, lo + days_per_file - 1))
        part.write.mode("overwrite").parquet(os.path.join(path, f"d{lo:06d}"))
    return path


def _versions(log: DataFrame, split: NestedSplit, cadence: int) -> DataFrame:
    """Statistics per date with its fold and the first model version that is fitted on it."""
    labelled = WF._label_days(log, split)
    return labelled.select("*", WF._version_of_new_data(cadence, True).alias("version"))


def _sink(out: str, cfg: WF.WalkForwardConfig, split: NestedSplit, cadence: int, standardizer):
    p = len(wls.design_names(cfg.features, cfg.intercept))
    cols = wls.stat_columns(p, cfg.targets)

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            own = wls.daily_statistics(batch, cfg.features, cfg.targets, cfg.weight, cfg.intercept, standardizer)
            mine = os.path.join(out, "stats", f"batch={batch_id}")
            own.write.mode("overwrite").parquet(mine)
            newest = spark.read.schema(own.schema).parquet(mine).agg(F.max(DATE)).first()[0]
            if newest is None or newest < split.test_start:
                return  # history only: nothing is predicted
            log = spark.read.option("basePath", os.path.join(out, "stats")).parquet(os.path.join(out, "stats", "batch=*"))
            per_day = log.where(F.col("batch") <= batch_id).groupBy(DATE).agg(*[F.sum(c).alias(c) for c in cols])
            days = _versions(per_day, split, cadence)  # one row per date
            asked = batch.select(DATE).distinct().where(F.col(DATE).between(split.test_start, split.test_end))
            asked = asked.join(days.select(DATE, F.floor(F.col("day_index") / cadence).cast("bigint").alias("version")), DATE)
            fitted = WF._sum_stats(days.where(F.col("version").isNotNull()), "version", cols)
            upto = Window.orderBy("version").rowsBetween(Window.unboundedPreceding, 0)  # one row per version
            fitted = fitted.select("version", *[F.sum(c).over(upto).alias(c) for c in cols])
            betas = wls.solve_rows(fitted.join(asked.select("version").distinct(), "version"), ["version"], p, cfg.target, cfg.ridge, cfg.intercept)
            models = asked.join(betas, "version").select(DATE, "version", "beta")
            (models.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DATE)
             .parquet(os.path.join(out, "models")))
            xs = wls.design_columns(cfg.features, cfg.intercept, standardizer)
            live = spark.read.schema(f"version long, beta array<double>, {DATE} int").parquet(os.path.join(out, "models"))
            live = live.join(asked.select(DATE), DATE, "left_semi")  # the test days of this batch, one row each
            keys = [c for c in (DATE, "time_id", "symbol_id") if c in batch.columns]
            pred = batch.join(F.broadcast(live), DATE).select(*keys, cfg.target, cfg.weight, "version", wls.predict_column(F.col("beta"), xs).alias("prediction"))
            pred.write.mode("overwrite").parquet(os.path.join(out, "pred", f"batch={batch_id}"))
        finally:
            batch.unpersist()
    return sink


def stream_walk_forward(spark: SparkSession, path: str, schema, cfg: WF.WalkForwardConfig, split: NestedSplit, cadence: int,
                        standardizer: dict | None = None, out: str | None = None, files_per_trigger: int = 1) -> str:
    """Runs the stream over what has arrived in ``path``; returns its folder ``out``.

    Called again with the same ``out``, it goes on with the files that came since. A
    standardiser, if the model has one, is fitted beforehand on the train fold.
    """
    out = out or checkpoint_path(spark, f"stream_wf_{uuid.uuid4().hex[:10]}")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(os.path.join(path, "*"))
    query = (rows.writeStream.foreachBatch(_sink(out, cfg, split, cadence, standardizer))
             .option("checkpointLocation", os.path.join(out, "_checkpoint")).trigger(availableNow=True).start())
    query.awaitTermination()
    return out


def predictions(spark: SparkSession, out: str) -> DataFrame:
    """Row-level predictions of the test days so far."""
    return spark.read.option("basePath", os.path.join(out, "pred")).parquet(os.path.join(out, "pred", "batch=*")).drop("batch")


def models(spark: SparkSession, out: str) -> DataFrame:
    """``date_id, version, beta``: the model of each test day so far."""
    return spark.read.schema(f"version long, beta array<double>, {DATE} int").parquet(os.path.join(out, "models")).select(DATE, "version", "beta")


def summary(spark: SparkSession, out: str, cfg: WF.WalkForwardConfig, cadence: int) -> DataFrame:
    """The summary row of the walk-forward so far, from the logged statistics and models."""
    p = len(wls.design_names(cfg.features, cfg.intercept))
    log = spark.read.option("basePath", os.path.join(out, "stats")).parquet(os.path.join(out, "stats", "batch=*"))
    days = log.groupBy(DATE).agg(*[F.sum(c).alias(c) for c in wls.stat_columns(p, cfg.targets)])
    scored = days.join(models(spark, out), DATE)  # one row per test day
    return scored.agg(F.sum(wls.sse_column(F.col("beta"), p, cfg.target)).alias("sse"), F.sum(f"c_{cfg.target}").alias("sst"),
                      F.count(F.lit(1)).alias("test_days"), F.sum("n").cast("long").alias("test_rows"), F.max("version").alias("n_updates")).select(
        F.lit("retrain").alias("variant"), F.lit(cadence).cast("long").alias("cadence"), "n_updates", "test_days", "test_rows",
        (1 - F.col("sse") / F.col("sst")).alias("score"))
