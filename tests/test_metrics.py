import pytest
from pyspark.errors import PythonException  # noqa: F401
from pyspark.sql import functions as F

from conftest import frame
from tidepanel.operators import metrics as ME

Y = [1.0, -2.0, 0.5, 3.0]
W = [1.0, 2.0, 0.5, 1.0]


def _r2(spark, y, p, w):
    df = frame(spark, list(zip(y, p, w)), "responder_6 double, prediction double, weight double")
    return ME.weighted_r2(df, "prediction").first()["r2"]


def test_perfect_and_zero(spark):
    assert _r2(spark, Y, Y, W) == 1.0
    assert _r2(spark, Y, [0.0] * 4, W) == 0.0


def test_negative(spark):
    assert _r2(spark, [1.0], [-3.0], [1.0]) < 0


def test_non_finite_and_zero_denominator_raise(spark):
    with pytest.raises(Exception):
        _r2(spark, [1.0, float("nan")], [1.0, 1.0], [1.0, 1.0])
    with pytest.raises(Exception):
        _r2(spark, [1.0], [float("inf")], [1.0])
    with pytest.raises(Exception):
        _r2(spark, [0.0, 0.0], [1.0, 1.0], [1.0, 1.0])


def test_grouped(spark):
    df = frame(spark, [(0, 1.0, 1.0, 1.0), (1, 2.0, 0.0, 1.0)], "date_id int, responder_6 double, prediction double, weight double")
    got = {r["date_id"]: r["r2"] for r in ME.weighted_r2(df, "prediction", by=["date_id"]).collect()}
    assert got == {0: 1.0, 1: 0.0}


def test_distribution_summary_empty(spark):
    df = frame(spark, [(1.0,)], "p double").where(F.lit(False))
    r = ME.distribution_summary(df, "p", "prediction").first()
    assert tuple(r) == (0.0, 0.0, 0.0, 0.0)
