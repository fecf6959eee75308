"""Registered queries against their SQL, and the shape of the catalog."""

import duckdb
import pytest

import __spark_entry__ as e
import check

SF = "/root/testdata/sf0.001"
# A cross-section; ``python check.py`` compares every query.
NAMES = [
    "a01_resample_right_closed", "j02_asof_backward", "j03_asof_nearest", "w09_cumulative_dose", "merged_feature_matrix", "w07_t80_table",
    "a10_curve_decision", "p11_physics_gate", "w23_mpp_smoothed", "w28_sweep_interpolate", "a20_score_describe", "w15_robust_z", "w17_largest_upper_gap",
    "a13_daily_rul_matrix", "w13_normalised_state", "a16_alert_summary", "a33_ks_two_sample", "m11_contiguous_folds", "a40_linear_calibration",
    "m03_cluster_quality", "a49_multi_resolution_bands", "s02_parse_and_require", "x01_streaming_resample",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 190


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    got = check.canonical(e.queries()[name](spark, SF).toPandas())
    want = check.canonical(con.execute(e.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_entry_is_lazy_and_has_rows(spark):
    df = e.entry(spark)
    assert df.count() == 8
