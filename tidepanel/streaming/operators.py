"""Structured Streaming forms of the panel operators.

Input is the event table replayed day after day (``stage_events_by_day``), any number of
files a day, read with ``readStream`` + ``maxFilesPerTrigger`` and run with
``trigger(availableNow=True)``. The answers do not depend on how a day is cut into files
or micro-batches: the watermark allows for the disorder inside a day, values that depend
on the order of events wait until no earlier event can come, and sums are logged per
date. State lives in Spark's fault-tolerant state store or in tables beside the
checkpoint, one folder a batch, and sinks are idempotent by batch, so a restarted query
resumes without double counting. No operator calls Python per key.
"""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions.exprs import is_finite
from tidepanel.session import checkpoint_path, committed, path_signature
from tidepanel.sources.fixtures import load_events

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("date_id", T.IntegerType()),
    T.StructField("time_id", T.IntegerType()),
])


DISORDER = "25 hours"  # files of one day come in any order, days come in order


def stage_events_by_day(spark: SparkSession, sf_dir: str, files_per_day: int = 1) -> str:
    """Replay folder: the event table written one day after another (file age = day
    order, which the file source follows), each day in ``files_per_day`` files.

    The table is scanned once and split into day folders; the loop then reads each day's
    folder alone. A last file holds a marker without an event id, past every watermark:
    it closes the replay, so that what waits in state is released. Written once per
    state of the input.
    """
    source = os.path.join(sf_dir, "events.parquet")
    tag = hashlib.sha1(f"events-v3:{files_per_day}:{sf_dir}:{path_signature(spark, source)}".encode()).hexdigest()[:12]
    path = checkpoint_path(spark, f"events_by_day_{tag}")
    done = os.path.join(path, "_staged")
    if committed(spark, done):
        return path
    ev = load_events(spark, sf_dir).select(*[f.name for f in EVENT_SCHEMA.fields])
    split = os.path.join(path, "_split")
    ev.withColumn("day", F.col("date_id")).write.mode("overwrite").partitionBy("day").parquet(split)
    days = [r["date_id"] for r in ev.select("date_id").distinct().orderBy("date_id").collect()]  # one row per day
    for d in days:
        # One folder per day, overwritten on a re-run: staging is idempotent.
        day = spark.read.schema(EVENT_SCHEMA).parquet(os.path.join(split, f"day={d}"))
        day.repartition(files_per_day, "event_id").write.mode("overwrite").parquet(os.path.join(path, "data", f"d{d:06d}"))
    end = ev.agg(F.max("ts").alias("ts")).select(
        F.lit(None).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("ts"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields[2:]])
    end.write.mode("overwrite").parquet(os.path.join(path, "data", "end"))
    spark.createDataFrame([(len(days),)], "n_days int").write.mode("overwrite").parquet(done)
    return path


def read_event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(os.path.join(path, "data", "*")))


def _run(query_builder, name: str, spark: SparkSession, state_partitions: int | None = None) -> str:
    """Start a query (availableNow) and wait for it.

    The number of state-store partitions is fixed when a stateful query first starts
    and stays in its checkpoint; it is sized to the cluster's cores here instead of
    inheriting the batch shuffle setting.
    """
    out = checkpoint_path(spark, f"stream_{name}_{uuid.uuid4().hex[:10]}")
    n = state_partitions or max(1, spark.sparkContext.defaultParallelism)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        q = query_builder(out, os.path.join(out, "_checkpoint"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    q.awaitTermination()
    return out


def _upsert_log_sink(out: str):
    """foreachBatch sink: append the batch's rows tagged with the batch id (idempotent:
    a replayed batch id overwrites its own folder)."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(
            os.path.join(out, "log", f"batch={batch_id}"))
    return sink


def _latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    log = spark.read.option("recursiveFileLookup", "true").parquet(os.path.join(out, "log"))
    cols = [c for c in log.columns if c not in keys + ["_batch"]]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*cols), "_batch").alias("s"))
    return last.select(*keys, "s.*")


# ---------------------------------------------------------------- L01
def stream_market_avg(spark: SparkSession, path: str, window: str = "1 hour", slide: str | None = None,
                      delay: str = DISORDER) -> DataFrame:
    """Cross-sectional average per event-time bucket; update mode into an upsert log, so
    open buckets are visible too. The watermark allows for the disorder inside a day."""
    ev = read_event_stream(spark, path).withWatermark("ts", delay).where(F.col("event_id").isNotNull())
    win = F.window("ts", window, slide) if slide else F.window("ts", window)
    agg = ev.groupBy(win.alias("w")).agg(F.avg("value").alias("avg_value"),
                                         F.count(F.lit(1)).cast("bigint").alias("n_events"))
    agg = agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                     "avg_value", "n_events")

    def build(out, ck):
        return (agg.writeStream.outputMode("update").foreachBatch(_upsert_log_sink(out))
                .option("checkpointLocation", ck).trigger(availableNow=True).start())

    return _latest(spark, _run(build, "mkt", spark), ["window_start", "window_end"])


# ---------------------------------------------------------------- L02
ROLL_LOG = ("event_id long, user_id long, ts timestamp, value double, done boolean, roll_mean double, roll_std double, "
            "emit int, keep int")


def _rolling_sink(out: str, window: int):
    """foreachBatch sink of :func:`stream_rolling`: one window over the rows carried from
    the batch before and the batch's own; ``log/batch=<id>`` takes the rows that are
    finished (``emit``) and those that later batches need (``keep``). A replayed batch
    reads the same carried rows and overwrites its own folder."""
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id", "value")
    frame = by_user.rowsBetween(1 - window, 0)

    def f(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("done", F.lit(False))
        if batch_id > 0:
            before = spark.read.schema(ROLL_LOG).parquet(os.path.join(out, "log", f"batch={batch_id - 1}"))
            rows = rows.unionByName(before.where("keep = 1").select(*rows.columns))
        # what is older than the disorder below the newest event is complete; the newest
        # event itself always waits, so the carried rows hold it
        newest = rows.agg(F.max("ts").alias("ts")).select((F.col("ts") - F.expr(f"INTERVAL {DISORDER}")).alias("b"))
        ready = F.coalesce(F.col("ts") < F.lit(newest.first()["b"]), F.lit(False))
        rows = rows.where(F.col("ts").isNotNull() & F.col("event_id").isNotNull()).withColumn("_ready", ready)
        x = F.when(is_finite(F.col("value")), F.col("value"))
        rows = rows.select("*", F.avg(x).over(frame).alias("roll_mean"), F.coalesce(F.stddev_samp(x).over(frame), F.lit(0.0)).alias("roll_std"),
                           F.lead("_ready", window - 1).over(by_user).alias("_full"))
        emit = F.col("_ready") & ~F.col("done")
        # kept: waiting rows, and the last ``window - 1`` finished ones of each user
        keep = ~F.col("_ready") | ~F.coalesce("_full", F.lit(False))
        rows = rows.select("event_id", "user_id", "ts", "value", F.col("_ready").alias("done"), "roll_mean", "roll_std",
                           emit.cast("int").alias("emit"), keep.cast("int").alias("keep"))
        (rows.where("emit = 1 OR keep = 1").write.mode("overwrite").partitionBy("emit", "keep")
             .parquet(os.path.join(out, "log", f"batch={batch_id}")))
    return f


def stream_rolling(spark: SparkSession, path: str, window: int = 10) -> DataFrame:
    """Per-user trailing ``window``-event mean / std (ddof 1, <2 samples -> 0).

    Row-based frames are not allowed on streams, so every batch carries each user's last
    ``window - 1`` events and the events that may still be preceded by others (bounded by
    the window and the disorder, not by history) to the next one; events are emitted in
    event-time order. The carried rows of all users are one table, so a batch is one
    grouped window however many users there are.
    """
    ev = read_event_stream(spark, path).select("event_id", "user_id", "ts", "value")

    def build(out, ck):
        return (ev.writeStream.foreachBatch(_rolling_sink(out, window)).option("checkpointLocation", ck)
                .trigger(availableNow=True).start())

    out = _run(build, "roll", spark)
    log = spark.read.schema(ROLL_LOG + ", batch long").parquet(os.path.join(out, "log"))
    return log.where("emit = 1").select("event_id", "user_id", "ts", "roll_mean", "roll_std")


# ---------------------------------------------------------------- L03
def _with_day_lag(batch: DataFrame, batch_id: int, days: str) -> DataFrame:
    """The batch's rows with ``value_lag_1``, the mean of their (user, hour) on the day before.

    The batch's sums per (user, hour, day) are logged first, in a folder per day and batch
    (a replayed batch overwrites its own); only the days before the batch's own are read
    again. Days come in order, so those are complete.
    """
    spark = batch.sparkSession
    own = batch.groupBy("user_id", "time_id", "date_id").agg(
        F.sum(F.coalesce(F.nanvl("value", F.lit(None).cast("double")), F.lit(0.0))).alias("s"), F.count(F.lit(1)).alias("c"))
    (own.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("date_id", "batch").parquet(days))
    earlier = [r["date_id"] - 1 for r in batch.select("date_id").where("date_id IS NOT NULL").distinct().collect()]  # the days of a batch
    log = spark.read.schema("user_id long, time_id int, s double, c long, date_id int, batch long").parquet(days)
    log = log.where(F.col("date_id").isin(earlier) & (F.col("batch") <= batch_id))
    prev = log.groupBy("user_id", "time_id", (F.col("date_id") + 1).alias("date_id")).agg((F.sum("s") / F.sum("c")).alias("value_lag_1"))
    prev = prev.select(*[F.col(k).alias(f"_{k}") for k in ("user_id", "time_id", "date_id")], "value_lag_1").hint("merge")
    same = [batch[k].eqNullSafe(prev[f"_{k}"]) for k in ("user_id", "time_id", "date_id")]
    return batch.join(prev, same, "left").select(*batch.columns, "value_lag_1")


def _lag_events(spark: SparkSession, path: str) -> DataFrame:
    return read_event_stream(spark, path).select("event_id", "user_id", "date_id", "time_id", "value").where(F.col("event_id").isNotNull())


def stream_day_lag(spark: SparkSession, path: str) -> DataFrame:
    """Previous-day mean value of the same (user, hour), handed over as day D arrives.

    The state is a log of sums per (user, hour), of which a batch reads the day before
    its own: one join a batch however many keys there are."""
    ev = _lag_events(spark, path)

    def sink(out):
        def f(batch: DataFrame, batch_id: int) -> None:
            if batch.isEmpty():
                return
            _with_day_lag(batch, batch_id, os.path.join(out, "days")).write.mode("overwrite").parquet(
                os.path.join(out, "data", f"batch={batch_id}"))
        return f

    def build(out, ck):
        return ev.writeStream.foreachBatch(sink(out)).option("checkpointLocation", ck).trigger(availableNow=True).start()

    data = spark.read.option("recursiveFileLookup", "true").parquet(os.path.join(_run(build, "lag", spark), "data"))
    return data.select("event_id", "user_id", "date_id", "time_id", "value", "value_lag_1")


# ---------------------------------------------------------------- L04
def stream_running_r2(spark: SparkSession, path: str) -> DataFrame:
    """Running zero-mean R² of the previous-day predictor (missing -> 0) after each date.

    Every micro-batch logs its partial sums per date (idempotent by batch id), so a date
    spread over several batches is added up; the cumulative score is a running window
    over that small log."""
    ev = _lag_events(spark, path)

    def sink(out):
        def f(batch: DataFrame, batch_id: int) -> None:
            if batch.isEmpty():
                return
            p = F.coalesce(F.col("value_lag_1"), F.lit(0.0))
            y = F.col("value")
            _with_day_lag(batch, batch_id, os.path.join(out, "days")).groupBy("date_id").agg(
                F.sum((y - p) * (y - p)).alias("sse"), F.sum(y * y).alias("sst"),
                F.count(F.lit(1)).cast("bigint").alias("n")).withColumn("batch", F.lit(batch_id)).write.mode(
                "overwrite").parquet(os.path.join(out, "log", f"batch={batch_id}"))
        return f

    def build(out, ck):
        return ev.writeStream.foreachBatch(sink(out)).option("checkpointLocation", ck).trigger(availableNow=True).start()

    out = _run(build, "r2", spark)
    log = spark.read.option("recursiveFileLookup", "true").parquet(os.path.join(out, "log"))
    log = log.groupBy("date_id").agg(*[F.sum(c).alias(c) for c in ("n", "sse", "sst")])
    w = Window.orderBy("date_id").rowsBetween(Window.unboundedPreceding, 0)  # one row per date
    return log.select("date_id", F.sum("n").over(w).alias("n_rows"),
                      (1 - F.sum("sse").over(w) / F.sum("sst").over(w)).alias("running_r2"))


# ---------------------------------------------------------------- L05
def stream_predict_update(spark: SparkSession, path: str) -> DataFrame:
    """Predict-then-update: each day is predicted with the per-hour mean of all earlier
    days (statistics logged per batch, idempotent), then its own statistics are added.

    A batch may hold part of a day or several days: a day's prediction uses the logged
    and the batch's own statistics of strictly earlier dates."""
    ev = read_event_stream(spark, path).select("event_id", "user_id", "date_id", "time_id", "value").where(F.col("event_id").isNotNull())

    def sink(out):
        model_dir = os.path.join(out, "model")
        pred_dir = os.path.join(out, "pred")

        def f(batch: DataFrame, batch_id: int) -> None:
            if batch.isEmpty():
                return
            # Keyed by batch: a replayed batch overwrites only its own statistics.
            own = batch.groupBy("date_id", "time_id").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("c"))
            own.write.mode("overwrite").parquet(os.path.join(model_dir, f"batch={batch_id}"))
            log = (spark.read.option("basePath", model_dir).parquet(os.path.join(model_dir, "batch=*"))
                   .where(F.col("batch") <= batch_id))
            # at most days x 24 rows; every batch day gets a row per hour of the model
            days = log.groupBy("date_id", "time_id").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
            asked = batch.select("date_id", "time_id").distinct()
            both = days.unionByName(asked.join(days.select("date_id", "time_id"), ["date_id", "time_id"], "left_anti"), allowMissingColumns=True)
            w = Window.partitionBy("time_id").orderBy("date_id").rowsBetween(Window.unboundedPreceding, -1)
            stats = both.select("date_id", "time_id", (F.sum("s").over(w) / F.sum("c").over(w)).alias("prediction"))
            pred = batch.join(stats, ["date_id", "time_id"], "left").withColumn("prediction", F.coalesce("prediction", F.lit(0.0)))
            pred.write.mode("overwrite").parquet(os.path.join(pred_dir, f"batch={batch_id}"))
        return f

    def build(out, ck):
        return (ev.writeStream.foreachBatch(sink(out)).option("checkpointLocation", ck)
                .trigger(availableNow=True).start())

    out = _run(build, "pu", spark)
    return spark.read.option("recursiveFileLookup", "true").parquet(os.path.join(out, "pred")).select(
        "event_id", "user_id", "date_id", "time_id", "value", "prediction")
