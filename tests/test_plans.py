"""Scans of the plans that nest ordered scans, and gaps and distances over awkward values."""

import pytest
from pyspark.sql import functions as F

from helioframe.operators import audits, screening
from helioframe.plans import catalog  # noqa: F401 (registers the queries)
from helioframe.plans.registry import CATALOG

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, most", [("w09_cumulative_dose", 2), ("j02_asof_backward", 2), ("j03_asof_nearest", 3), ("merged_feature_matrix", 4)])
def test_nested_scans_read_each_level_once(spark, name, most):
    plan = CATALOG[name].run(spark, SF)._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() <= most


def test_largest_gap_beside_an_outlier(spark):
    v = [i * 1e-9 for i in range(400)] + [5.0, 9.0, 1e300]
    df = spark.createDataFrame([(x,) for x in v] + [(None,)], "v double")
    r = audits.largest_upper_gap(df, "v", 0.95).first()
    assert (r["gap_lo"], r["gap_hi"]) == (9.0, 1e300)
    r = audits.largest_upper_gap(df.where("v < 6"), "v", 0.95).first()
    assert (r["gap_lo"], r["gap_hi"]) == (399e-9, 5.0)


def test_distribution_distance_ignores_nulls_and_takes_outliers(spark):
    rows = [("A", float(i)) for i in range(10)] + [("B", float(i) + 5) for i in range(10)] + [("A", None), ("B", None), ("C", 3.0)]
    rows += [("A", 1e300), ("B", 1e300)]
    df = spark.createDataFrame(rows, "p string, v double")
    r = screening.ks_two_sample(df, "p", "A", "B", "v").first()
    assert r["statistic"] == pytest.approx(5 / 11) and (r["n_a"], r["n_b"]) == (11, 11)
    assert screening.ks_two_sample(df.where(F.lit(False)), "p", "A", "B", "v").isEmpty()
