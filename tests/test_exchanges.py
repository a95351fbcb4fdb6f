"""Rows meet one exchange, and it carries no more than the step needs."""

import datetime as dt

from pyspark.sql import functions as F

from tidepanel.operators import experiments as EX
from tidepanel.operators import features as FE
from tidepanel.sources import fixtures as FX


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _lineitem(spark):
    day = dt.datetime(1996, 3, 1)
    rows = [(None if k % 11 == 0 else day + dt.timedelta(days=k % 70), k // 4, k % 4, k % 5, 100.5 + k, float(k % 50), 0.04, 0.02,
             "R" if k % 3 else "N", "O", k % 3) for k in range(200)]
    rows += rows[:20]
    return spark.createDataFrame(rows, "l_shipdate timestamp, l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, "
                                       "l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_suppkey long")


def test_stored_panel_is_dealt_once_and_sorted(spark, tmp_path):
    _lineitem(spark).repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    raw = FX._panel_keys(spark.read.parquet(str(tmp_path / "lineitem.parquet"))).repartitionByRange("date_id", "symbol_id")
    assert _plan(FX._panel_columns(raw)).count("Exchange") == 1
    lazy = FX.load_panel(spark, str(tmp_path), materialize=False)
    kept = FX.load_panel(spark, str(tmp_path))
    assert kept.columns == lazy.columns
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, lazy.collect()))
    assert kept.count() == 220
    ids = [tuple(-1 if v is None else v for v in r) for r in kept.select("date_id", "symbol_id", "time_id").collect()]
    assert len(set(ids)) == 220


def test_short_series_need_no_table_of_blocks(spark, monkeypatch):
    """Only series that reach a second chunk are joined to their blocks."""
    sizes = []
    join = FE._with_blocks
    monkeypatch.setattr(FE, "_with_blocks", lambda df, blocks, *a, **k: (sizes.append(blocks.count()), join(df, blocks, *a, **k))[1])
    monkeypatch.setattr(FE, "LEAD_CHUNK", 30)
    rows = [(d, t, s, float(d * 7 + t)) for s in range(20) for d in range(4) for t in range(20 if s == 0 else 5)]
    df = spark.createDataFrame(rows, "date_id int, time_id int, symbol_id long, x double")
    got = FE.rolling_stats(df, ["x"], window=8)
    assert got.count() == len(rows)
    assert sizes == [4]  # the days of the long series
    want = {}
    for s in range(20):
        own = sorted(r for r in rows if r[2] == s)
        for i, r in enumerate(own):
            seen = [q[3] for q in own[max(0, i - 7):i + 1]]
            want[r[:3]] = sum(seen) / len(seen)
    for r in got.collect():
        assert abs(r["x_roll_mean"] - want[r["date_id"], r["time_id"], r["symbol_id"]]) < 1e-9


def test_paired_delta_reads_stored_runs(spark):
    runs = spark.range(4).select(F.when(F.col("id") < 2, "baseline").otherwise("marketroll").alias("kind"), F.lit(5).alias("roll_window"),
                                 F.lit("a").alias("subset"), (F.col("id") % 2).alias("seed"), F.col("id").cast("double").alias("score"))
    out = EX.paired_delta(runs)
    assert "Range" not in _plan(out)
    assert sorted((r["seed"], r["delta"]) for r in out.collect()) == [(0, 2.0), (1, 2.0)]
