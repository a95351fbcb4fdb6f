"""The wide walk-forward takes every input of its chain from the whole panel."""

import datetime as dt

import pytest

from tidepanel import queries as Q
from tidepanel.columns import LAG_COLUMNS, RESPONDER_COLUMNS


def test_wide_walk_forward_reads_the_whole_panel(spark, tmp_path, monkeypatch):
    rows = [(dt.datetime(1995 + m // 12, m % 12 + 1, 1 + k), m * 10 + k, k % 3, 11 * m + 7 * k, 100.5 + 3 * m + k, float((5 * k + m) % 50),
             (k + m) % 9 / 100, (2 * k + m) % 7 / 100, "R" if k % 3 else "N", "O", k % 2) for m in range(46) for k in range(8)]
    spark.createDataFrame(rows, "l_shipdate timestamp, l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_quantity double, "
                                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_suppkey long"
                          ).write.parquet(str(tmp_path / "lineitem.parquet"))
    seen = {}
    prepare = Q.WF.prepare

    def spy(df, cfg):
        seen["frame"], seen["prep"] = df.columns, prepare(df, cfg)
        return seen["prep"]

    monkeypatch.setattr(Q.WF, "prepare", spy)
    out = Q.QUERIES["walk_forward_wide"](spark, str(tmp_path)).collect()
    assert set(RESPONDER_COLUMNS) <= set(seen["frame"])
    assert [f for f in seen["prep"].cfg.features if f.endswith("_lag_1")] == LAG_COLUMNS
    assert seen["prep"].p == 42  # 8 features, 9 lags, 8 market averages, 16 rolling statistics, the intercept
    std = seen["prep"].standardizer
    for c in LAG_COLUMNS:  # the lags hold their own responder's values
        own = [r[0] for r in Q.panel(spark, str(tmp_path)).where("date_id < 11").select(c.removesuffix("_lag_1")).collect()]
        assert std[c][0] == pytest.approx(sum(own) / len(own))
    assert [(r["variant"], r["test_days"], r["test_rows"]) for r in out] == [(v, 20, 160) for v in ("full", "retrain", "refit", "online")]
