"""Stream results equal their batch definitions on the replayed event table."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tidepanel.sources.fixtures import load_events
from tidepanel.streaming import operators as ST


@pytest.fixture(scope="module")
def staged(spark):
    return ST.stage_events_by_day(spark, SF_SMALL)


@pytest.fixture(scope="module")
def scattered(spark):
    """Three files a day; batches of five files end inside days."""
    read = ST.read_event_stream
    ST.read_event_stream = lambda spark, path: read(spark, path, files_per_trigger=5)
    yield ST.stage_events_by_day(spark, SF_SMALL, 3)
    ST.read_event_stream = read


def _same(a, b, cols, tol=1e-9):
    ra = sorted(tuple(r[c] for c in cols) for r in a.collect())
    rb = sorted(tuple(r[c] for c in cols) for r in b.collect())
    assert len(ra) == len(rb)
    for x, y in zip(ra, rb):
        for u, v in zip(x, y):
            if isinstance(u, float) or isinstance(v, float):
                assert (u is None and v is None) or abs(u - v) < tol
            else:
                assert u == v


def test_market_avg_stream_equals_batch(spark, staged):
    s = ST.stream_market_avg(spark, staged)
    ev = load_events(spark, SF_SMALL)
    b = ev.groupBy(F.window("ts", "1 hour").alias("w")).agg(
        F.avg("value").alias("avg_value"), F.count(F.lit(1)).cast("bigint").alias("n_events")).select(
        F.col("w.start").alias("window_start"), "avg_value", "n_events")
    _same(s, b, ["window_start", "avg_value", "n_events"])


def test_rolling_stream_equals_batch(spark, staged):
    s = ST.stream_rolling(spark, staged, 5)
    ev = load_events(spark, SF_SMALL)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    b = ev.select("event_id", F.avg("value").over(w).alias("roll_mean"),
                  F.coalesce(F.stddev_samp("value").over(w), F.lit(0.0)).alias("roll_std"))
    _same(s, b, ["event_id", "roll_mean", "roll_std"], 1e-6)


def test_day_lag_stream_equals_batch(spark, staged):
    s = ST.stream_day_lag(spark, staged)
    ev = load_events(spark, SF_SMALL)
    prev = ev.groupBy("user_id", "date_id", "time_id").agg(F.avg("value").alias("value_lag_1")).withColumn(
        "date_id", F.col("date_id") + 1)
    b = ev.join(prev, ["user_id", "date_id", "time_id"], "left").select("event_id", "value_lag_1")
    _same(s, b, ["event_id", "value_lag_1"])


def test_predict_update_equals_batch(spark, staged):
    s = ST.stream_predict_update(spark, staged)
    ev = load_events(spark, SF_SMALL)
    day_stats = ev.groupBy("date_id", "time_id").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("c"))
    days = ev.select("date_id").distinct()
    hist = days.join(day_stats.withColumnRenamed("date_id", "d0"), F.col("d0") < F.col("date_id"))
    model = hist.groupBy("date_id", "time_id").agg((F.sum("s") / F.sum("c")).alias("prediction"))
    b = ev.join(model, ["date_id", "time_id"], "left").select(
        "event_id", F.coalesce("prediction", F.lit(0.0)).alias("prediction"))
    _same(s, b, ["event_id", "prediction"], 1e-9)


def test_running_r2_final_equals_batch(spark, staged):
    s = ST.stream_running_r2(spark, staged).orderBy(F.desc("date_id")).first()
    ev = load_events(spark, SF_SMALL)
    prev = ev.groupBy("user_id", "date_id", "time_id").agg(F.avg("value").alias("lag")).withColumn(
        "date_id", F.col("date_id") + 1)
    j = ev.join(prev, ["user_id", "date_id", "time_id"], "left").select(
        "value", F.coalesce("lag", F.lit(0.0)).alias("p"))
    b = j.agg((1 - F.sum((F.col("value") - F.col("p")) ** 2) / F.sum(F.col("value") ** 2)).alias("r2")).first()
    assert s["running_r2"] == pytest.approx(b["r2"], rel=1e-9)
    assert s["n_rows"] == ev.count()


def test_sliding_market_avg_stream_equals_batch(spark, staged):
    s = ST.stream_market_avg(spark, staged, "2 hours", "1 hour")
    ev = load_events(spark, SF_SMALL)
    b = ev.groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(
        F.avg("value").alias("avg_value"), F.count(F.lit(1)).cast("bigint").alias("n_events")).select(
        F.col("w.start").alias("window_start"), "avg_value", "n_events")
    _same(s, b, ["window_start", "avg_value", "n_events"])


def test_scattered_files_give_the_same_answers(spark, staged, scattered):
    ids = ["event_id", "roll_mean", "roll_std"]
    ev = load_events(spark, SF_SMALL)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    want = ev.select("event_id", F.avg("value").over(w).alias("roll_mean"), F.coalesce(F.stddev_samp("value").over(w), F.lit(0.0)).alias("roll_std"))
    _same(ST.stream_rolling(spark, scattered, 5), want, ids, 1e-6)
    assert ST.stream_market_avg(spark, scattered).agg(F.sum("n_events")).first()[0] == ev.count()
    test_predict_update_equals_batch(spark, scattered)
    test_running_r2_final_equals_batch(spark, scattered)


def test_keyed_streams_do_not_call_python_per_key(spark, staged, monkeypatch):
    def refuse(*_a, **_k):
        raise AssertionError("a Python call for every key and batch")

    monkeypatch.setattr("pyspark.sql.pandas.group_ops.PandasGroupedOpsMixin.applyInPandasWithState", refuse)
    n = load_events(spark, SF_SMALL).count()
    assert ST.stream_rolling(spark, staged, 5).count() == n
    assert ST.stream_day_lag(spark, staged).count() == n
    assert ST.stream_running_r2(spark, staged).agg(F.max("n_rows")).first()[0] == n


def test_replayed_batches_count_once(spark, tmp_path):
    """Rolling and day-lag batches give the same rows when the last one runs again."""
    def events(rows):
        return spark.createDataFrame(rows, "event_id long, user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))

    first = events([(1, 1, "2024-01-01 05:00:00", 1.0), (2, 1, "2024-01-01 01:00:00", 3.0), (3, 2, "2024-01-01 02:00:00", None)])
    second = events([(4, 1, "2024-01-02 05:00:00", 5.0), (5, 2, "2024-01-02 02:00:00", 7.0), (6, 2, "2024-01-02 03:00:00", float("nan"))])
    end = events([(None, None, "2024-01-12 00:00:00", None)])
    sink = ST._rolling_sink(str(tmp_path / "roll"), 2)
    for k, batch in ((0, first), (1, second), (1, second), (2, end), (2, end)):
        sink(batch, k)
    log = spark.read.schema(ST.ROLL_LOG).parquet(str(tmp_path / "roll" / "log")).where("emit = 1")
    got = {r["event_id"]: (r["roll_mean"], r["roll_std"]) for r in log.collect()}
    assert log.count() == 6
    assert got == {2: (3.0, 0.0), 1: (2.0, pytest.approx(2 ** 0.5)), 4: (3.0, pytest.approx(8 ** 0.5)),
                   3: (None, 0.0), 5: (7.0, 0.0), 6: (7.0, 0.0)}

    def day(df):
        return df.select("event_id", "user_id", (F.dayofmonth("ts") - 1).alias("date_id"), F.hour("ts").alias("time_id"), "value")

    days = str(tmp_path / "days")
    ST._with_day_lag(day(first), 0, days).collect()
    for _ in range(2):
        lag = {r["event_id"]: r["value_lag_1"] for r in ST._with_day_lag(day(second), 1, days).collect()}
    assert lag == {4: 1.0, 5: 0.0, 6: None}
    assert spark.read.parquet(days).agg(F.sum("c")).first()[0] == 6
