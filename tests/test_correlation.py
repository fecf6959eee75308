"""Correlations of columns that never vary."""

import datetime as dt
import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helioframe.functions.expr import correlation
from helioframe.operators import forensics as Z, validation as V

ROWS = [("still", 1.0, float(i)) for i in range(4)] + [("moving", float(i), float(i * i)) for i in range(4)]
ROWS += [("gaps", None, 1.0), ("gaps", 2.0, None), ("gaps", 3.0, 1.0), ("gaps", 5.0, 4.0), ("gaps", 6.0, 2.0), ("none", None, 1.0)]


def test_correlation_equals_sql_and_survives_a_constant(spark):
    df = spark.createDataFrame(ROWS, "k string, x double, y double").repartition(3)
    got = {r["k"]: r["c"] for r in df.groupBy("k").agg(correlation("x", "y").alias("c")).collect()}
    t = pd.DataFrame(ROWS, columns=["k", "x", "y"]).astype({"x": "Float64", "y": "Float64"})  # noqa: F841
    want = dict(duckdb.sql("SELECT k, corr(x, y) FROM t GROUP BY 1").fetchall())
    assert got["none"] is None and want["none"] is None
    assert math.isnan(got["still"]) and math.isnan(want["still"])
    assert got["moving"] == pytest.approx(want["moving"]) and got["gaps"] == pytest.approx(want["gaps"])


def days(spark, temperature):
    rows = [("C0", dt.date(2024, 1, 1 + i), temperature(i), float((i * 7) % 5)) for i in range(14)]
    return spark.createDataFrame(rows, "cell_name string, Date_Day date, Daily_Max_Temp_C double, Daily_Damage_Increment double")


def test_forensics_of_a_device_at_constant_temperature(spark):
    d = days(spark, lambda i: 59.5)
    assert math.isnan(Z.feature_correlation(d, ["Daily_Max_Temp_C"], "Daily_Damage_Increment").first()["pearson"])
    lags = Z.lagged_cross_correlation(d)
    assert all(math.isnan(r["corr"]) for r in lags.collect()) and lags.count() == 11
    assert Z.best_lag(lags).first()["best_lag"] == 0  # as the SQL, where NaN is the greatest
    assert Z.target_profile(d, "Daily_Max_Temp_C").where(~F.isnan("lag_corr")).isEmpty()


def test_lag_correlation_of_a_still_target_is_null(spark):
    long = spark.createDataFrame([("t", 2.0, [float(i)]) for i in range(5)], "target string, y double, x array<double>")
    assert V.lag_correlations(long).first()["lag_corr"] is None
