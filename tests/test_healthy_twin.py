"""Folds of the healthy twin are fitted side by side."""

import threading

from pyspark.sql import functions as F

from helioframe.operators import models as M


class Mean:
    """Fits only while the other folds are being fitted; predicts the mean."""

    def __init__(self, label, meeting):
        self.label, self.meeting = label, meeting

    def fit(self, train):
        self.meeting.wait(timeout=60)
        self.mean = train.agg(F.avg(self.label)).first()[0]
        return self

    def transform(self, rows):
        return rows.withColumn("p", F.lit(self.mean))


def test_folds_are_fitted_side_by_side(spark, monkeypatch):
    meeting = threading.Barrier(5)
    monkeypatch.setattr(M, "TWIN_FEATURES", ["x"])
    monkeypatch.setattr(M, "booster", lambda label, *_: Mean(label, meeting))
    folded = spark.createDataFrame([(float(i), float(i % 5), i % 5) for i in range(10)], "x double, PCE_Relative double, fold int")
    got = sorted(r["r"] for r in M.oof_residuals(folded, "PCE").collect())
    assert got == sorted([abs(f - (10 - f) / 4) for f in range(5)] * 2)
    assert M.oof_residuals(folded.limit(0), "PCE") is None
