import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import frame
from tidepanel.columns import ID_COLUMNS
from tidepanel.operators import features as FE

SCHEMA = "date_id int, time_id int, symbol_id long, feature_00 double"


def sliding(df, f, w):
    """The plain sliding frame: the meaning of the rolling statistics."""
    v = F.when(~F.isnan(f) & (F.abs(f) < float("inf")), F.col(f))
    win = Window.partitionBy("symbol_id").orderBy("date_id", "time_id", f).rowsBetween(-(w - 1), 0)
    return df.select("*", F.avg(v).over(win).alias(f"{f}_roll_mean"), F.coalesce(F.stddev_samp(v).over(win), F.lit(0.0)).alias(f"{f}_roll_std"))


def _roll(spark, rows, w):
    out = FE.rolling_stats(frame(spark, rows, SCHEMA), ["feature_00"], window=w)
    return [(r["symbol_id"], r["feature_00_roll_mean"], r["feature_00_roll_std"])
            for r in out.orderBy("symbol_id", "date_id", "time_id").collect()]


def test_rolling_known_values(spark):
    got = _roll(spark, [(d, 0, 0, float(v)) for d, v in enumerate([1, 2, 3, 4])], 2)
    assert [g[1] for g in got] == [1.0, 1.5, 2.5, 3.5]
    assert got[0][2] == 0.0 and got[1][2] == pytest.approx(math.sqrt(0.5))


def test_rolling_per_symbol_isolation(spark):
    got = _roll(spark, [(0, 0, 0, 1.0), (1, 0, 0, 3.0), (0, 0, 1, 100.0), (1, 0, 1, 300.0)], 2)
    assert [g[1] for g in got] == [1.0, 2.0, 100.0, 200.0]


def test_rolling_nulls_hold_positions(spark):
    got = _roll(spark, [(0, 0, 0, None), (1, 0, 0, 2.0), (2, 0, 0, None), (3, 0, 0, None), (4, 0, 0, 6.0)], 2)
    assert [g[1] for g in got] == [None, 2.0, 2.0, None, 6.0]
    assert [g[2] for g in got] == [0.0] * 5


def test_rolling_causal(spark):
    base = [(d, t, 0, float(d * 3 + t)) for d in range(4) for t in range(3)]
    a, b = _roll(spark, base, 3), _roll(spark, base[:-1] + [base[-1][:3] + (999.0,)], 3)
    assert a[:-1] == b[:-1] and a[-1] != b[-1]


def hostile(spark):
    """NaN, infinities, nulls, null symbols, duplicate keys, one hot and a few small symbols."""
    odd = {3: float("nan"), 7: float("inf"), 11: None, 19: float("-inf")}
    rows = [(i // 9, i % 9 // 2, None if i % 5 == 4 else (0 if i % 3 else i % 7), odd.get(i % 23, 1e6 + (i * 37 % 11))) for i in range(400)]
    return frame(spark, rows + rows[:7], SCHEMA)


@pytest.mark.parametrize("chunk", [1 << 16, 16])
@pytest.mark.parametrize("w", [1, 2, 7, 64, 65, 500])
def test_rolling_equals_the_sliding_frame_on_hostile_rows(spark, monkeypatch, chunk, w):
    monkeypatch.setattr(FE, "LEAD_CHUNK", chunk)
    df = hostile(spark)
    key = lambda r: tuple((x is None, 0 if x is None else x) for x in r)
    cols = ["date_id", "time_id", "symbol_id", "feature_00_roll_mean", "feature_00_roll_std"]
    got = sorted(map(tuple, FE.rolling_stats(df, ["feature_00"], window=w).select(*cols).collect()), key=key)
    want = sorted(map(tuple, sliding(df, "feature_00", w).select(*cols).collect()), key=key)
    assert len(got) == len(want) == df.count()
    for a, b in zip(got, want):
        assert a[:3] == b[:3]
        for x, y in zip(a[3:], b[3:]):
            assert (x is None and y is None) or x == pytest.approx(y, abs=1e-6)


@pytest.mark.parametrize("level", [0.0, 1e6])
def test_rolling_keeps_its_digits(spark, level):
    import numpy as np
    x = np.random.default_rng(0).normal(level, 1.0, 20000)
    x[0] = 0.0
    df = spark.createDataFrame([(i // 100, i % 100, 1, float(v)) for i, v in enumerate(x)], SCHEMA)
    a = FE.rolling_stats(df, ["feature_00"], window=100)
    j = a.join(sliding(df, "feature_00", 100).withColumnRenamed("feature_00_roll_std", "want").withColumnRenamed("feature_00_roll_mean", "wm").drop("feature_00"),
               ["date_id", "time_id", "symbol_id"])
    worst = j.agg(F.max(F.abs(F.col("feature_00_roll_std") - F.col("want"))), F.max(F.abs(F.col("feature_00_roll_mean") - F.col("wm")))).first()
    assert worst[0] <= 1e-6 * max(1.0, level / 1e5) and worst[1] <= 1e-6


def test_rolling_equals_the_sliding_frame_on_the_panel(small_panel):
    feats = ["feature_00", "feature_04", "feature_06", "feature_07"]
    got = {tuple(r[c] for c in ID_COLUMNS): r for r in FE.rolling_stats(small_panel, feats, window=7).collect()}
    for f in feats:
        w = Window.partitionBy("symbol_id").orderBy("date_id", "time_id").rowsBetween(-6, 0)
        for r in small_panel.select(*ID_COLUMNS, F.avg(f).over(w).alias("m"), F.coalesce(F.stddev_samp(f).over(w), F.lit(0.0)).alias("s")).collect():
            x = got[tuple(r[c] for c in ID_COLUMNS)]
            for a, b in ((x[f + "_roll_mean"], r["m"]), (x[f + "_roll_std"], r["s"])):
                assert (a is None and b is None) or abs(a - b) < 1e-9


AUX_SCHEMA = "date_id int, time_id int, symbol_id long, responder_6 double, responder_7 double, responder_8 double"


def test_aux_targets_known_answer(spark):
    rows = [(d, 0, 0, float(1 + d), float(10 + d), float(20 + d)) for d in range(5)]
    out = FE.add_aux_targets(frame(spark, rows, AUX_SCHEMA)).orderBy("date_id").collect()
    assert out[0]["responder_9"] == 44.0
    assert out[-1]["responder_9"] == 0.0
    assert all(r["responder_10"] == 0.0 for r in out)


@pytest.mark.parametrize("chunk", [1 << 16, 50])
def test_aux_targets_equal_the_plain_window_on_hostile_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(FE, "LEAD_CHUNK", chunk)
    rows = [(i // 9, i % 9 // 2, None if i % 5 == 4 else (0 if i % 3 else i % 7), float(i % 13) if i % 17 else None, 0.0, float(i % 19)) for i in range(400)]
    df = frame(spark, rows + rows[:7], AUX_SCHEMA)
    got = FE.add_aux_targets(df)
    w = Window.partitionBy("symbol_id").orderBy("date_id", "time_id", "responder_6", "responder_7", "responder_8")
    r6, r8 = F.col("responder_6"), F.col("responder_8")
    want = df.select("*", F.coalesce(r8 + F.lead(r8, 4).over(w), F.lit(0.0)).alias("responder_9"),
                     F.coalesce(r6 + F.lead(r6, 20).over(w) + F.lead(r6, 40).over(w), F.lit(0.0)).alias("responder_10"))
    assert got.count() == df.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_ranks_keep_null_and_duplicate_keys(spark):
    df = hostile(spark).withColumn("time_id", F.col("time_id") + F.lit(1 << 20))
    got = FE.canonical_rank(df)
    n = df.count()
    assert sorted(r[0] for r in got.select("canonical_rank").collect()) == list(range(n))
    w = Window.orderBy("date_id", "time_id", "symbol_id")
    assert got.select("*", F.rank().over(w).alias("r"), F.count(F.lit(1)).over(w.rangeBetween(0, 0)).alias("k")).where(
        "canonical_rank < r - 1 OR canonical_rank >= r - 1 + k").count() == 0
    assert FE.series_index(df).count() == n


def test_responder_lag(spark):
    rows = [(d, t, s, *[float(100 * d + 10 * t + s + i) for i in range(9)])
            for d in range(2) for t in range(2) for s in range(2)]
    rows.append((1, 5, 7, *[1.0] * 9))  # orphan key: no previous day
    schema = "date_id int, time_id int, symbol_id long, " + ", ".join(f"responder_{i} double" for i in range(9))
    out = {(r["date_id"], r["time_id"], r["symbol_id"]): r for r in FE.responder_lag(frame(spark, rows, schema)).collect()}
    assert out[(0, 0, 0)]["responder_0_lag_1"] is None
    assert out[(1, 1, 1)]["responder_3_lag_1"] == 0 + 10 + 1 + 3
    assert out[(1, 5, 7)]["responder_6_lag_1"] is None
    assert all(r["responder_6_lag_1"] != r["responder_6"] for r in out.values() if r["responder_6_lag_1"] is not None)


@pytest.mark.parametrize("method", ["join", "window"])
def test_market_average(spark, method):
    rows = [(0, 0, 0, 2.0), (0, 0, 1, 4.0), (0, 1, 0, 10.0), (0, 1, 1, None)]
    out = FE.market_average(frame(spark, rows, SCHEMA), ["feature_00"], method=method)
    got = {(r["time_id"], r["symbol_id"]): r["feature_00_mkt"] for r in out.collect()}
    assert got[(0, 0)] == 3.0 and got[(0, 1)] == 3.0 and got[(1, 0)] == 10.0 and got[(1, 1)] == 10.0


def test_standardizer(spark):
    rows = [(0, 0, 0, 1.0), (1, 0, 0, 3.0), (2, 0, 0, None)]
    df = frame(spark, rows, SCHEMA).withColumn("feature_07", F.lit(None).cast("double"))
    st = {r["feature"]: (r["mean"], r["std"]) for r in FE.fit_standardizer(df, ["feature_00", "feature_07"]).collect()}
    assert st["feature_00"] == (2.0, 1.0) and st["feature_07"] == (0.0, 1.0)
    z = FE.apply_standardizer(df, st, ["feature_00"]).orderBy("date_id").collect()
    assert [r["feature_00"] for r in z] == [-1.0, 1.0, 0.0]


def test_series_index_dense(small_panel):
    ix = FE.series_index(small_panel)
    per = ix.groupBy("symbol_id").agg(F.count("*").alias("n"), F.max("_pos").alias("mx"),
                                      F.countDistinct("_pos").alias("nd"))
    assert per.where("mx + 1 != n OR nd != n").count() == 0


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_aux_invariant_to_row_order(small_panel):
    shuffled = small_panel.orderBy(F.rand(7)).repartition(7)
    cols = ["date_id", "time_id", "symbol_id", "responder_9", "responder_10"]
    assert _rows(FE.add_aux_targets(small_panel), cols) == _rows(FE.add_aux_targets(shuffled), cols)


def test_rolling_invariant_to_order_and_relabel(small_panel):
    feats = ["feature_00", "feature_06"]
    cols = ["date_id", "time_id"] + [f"{f}_roll_{k}" for f in feats for k in ("mean", "std")]
    base = FE.rolling_stats(small_panel, feats, 9)
    moved = small_panel.withColumn("symbol_id", F.col("symbol_id") * 7 + 1000).orderBy(F.rand(3)).repartition(5)
    other = FE.rolling_stats(moved, feats, 9)

    def key(df):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                      for r in df.select(*cols).collect())
    assert key(base) == key(other)


def test_day_sequences_standardised(small_panel):
    from tidepanel.operators import sequences as SQ
    st = FE.fit_standardizer(small_panel, ["feature_00", "feature_07"])
    stats = {r["feature"]: (r["mean"], r["std"]) for r in st.collect()}
    seqs = SQ.day_sequences(small_panel, ["feature_00", "feature_07"], standardizer=stats)
    flat = SQ.flatten_sequences(seqs)
    agg = flat.select(F.element_at("x", 1).alias("z0"), F.element_at("x", 2).alias("z7")).agg(
        F.avg("z0").alias("m0"), F.max(F.abs("z7")).alias("a7")).first()
    assert abs(agg["m0"]) < 1e-9 and agg["a7"] == 0.0
    assert flat.count() == small_panel.count()


def test_leads_across_tiny_chunks(small_panel):
    ix = FE.series_index(small_panel.select("date_id", "time_id", "symbol_id", "responder_6"))
    got = FE.lead_rows(ix, {"responder_6": [1, 3, 7]}, chunk=8)  # tiny chunks: halos everywhere
    w = Window.partitionBy("symbol_id").orderBy("date_id", "time_id")
    want = ix.select("*", *[F.lead("responder_6", k).over(w).alias(f"responder_6_lead{k}") for k in (1, 3, 7)])
    cols = ["date_id", "time_id", "symbol_id", "responder_6_lead1", "responder_6_lead3", "responder_6_lead7"]
    assert _rows(got, cols) == _rows(want, cols)
