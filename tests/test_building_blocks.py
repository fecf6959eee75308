"""Scale-out helpers against brute force, including one group that holds most rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helioframe.functions.ordered import exact_quantiles, ordered_scan, value_chunk
from helioframe.functions.smoothing import quadratic_fit_weights
from helioframe.functions.stages import settle, shared_folder


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(7)
    rows, i = [], 0
    for key, n in (("hot", 900), ("cold", 60), ("one", 1)):
        for t in sorted(rng.sample(range(5000), n)):
            v = None if rng.random() < 0.1 else round(rng.uniform(-3, 3), 3)
            rows.append((key, t, i, v))
            i += 1
    return rows


def test_ordered_scan_equals_a_plain_loop(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, t long, i long, v double")
    out = ordered_scan(
        df, ["k"], ["t", "i"], value_chunk("t", 250), sums={"s": F.col("v")}, lasts={"last": F.col("v")},
        lags={"prev": F.col("v")}, maxes={"top": F.col("v")},
    )
    got = {r["i"]: r for r in out.collect()}
    state = {}
    for k, t, i, v in sorted(skewed, key=lambda r: (r[0], r[1], r[2])):
        st = state.setdefault(k, {"s": None, "last": None, "prev": None, "top": None})
        r = got[i]
        assert r["prev"] == st["prev"]
        if v is not None:
            st["s"] = (st["s"] or 0.0) + v
            st["last"] = v
            st["top"] = v if st["top"] is None else max(st["top"], v)
        st["prev"] = v
        assert r["last"] == st["last"] and r["top"] == st["top"]
        assert (r["s"] is None) == (st["s"] is None) and (r["s"] is None or abs(r["s"] - st["s"]) < 1e-9)


def test_ordered_scan_runs_in_chunks_not_in_whole_devices(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, t long, i long, v double")
    out = ordered_scan(df, ["k"], ["t"], value_chunk("t", 250), sums={"s": F.col("v")})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__chunk" in plan
    row_windows = [l for l in plan.splitlines() if "Window" in l and "__l_s" in l]
    assert row_windows and all("__chunk" in l for l in row_windows)


@pytest.mark.parametrize("bins", [1, 7, 4096])
def test_exact_quantiles_equal_numpy(spark, skewed, bins):
    df = spark.createDataFrame(skewed, "k string, t long, i long, v double")
    qs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.98, "e": 1.0}
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", qs, bins).collect()}
    for key in {r[0] for r in skewed}:
        v = [r[3] for r in skewed if r[0] == key and r[3] is not None]
        if not v:
            assert key not in got
            continue
        for name, q in qs.items():
            assert math.isclose(got[key][name], float(np.quantile(v, q)), abs_tol=1e-9)
        assert got[key]["n"] == len(v)


def test_exact_quantiles_without_keys_and_with_one_value(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    r = exact_quantiles(df, [], "v", {"m": 0.5}).collect()
    assert [(x["m"], x["n"]) for x in r] == [(5.0, 2)]
    assert exact_quantiles(df.where("v IS NULL"), [], "v", {"m": 0.5}).count() == 0


def test_fit_weights_reproduce_a_parabola():
    w = quadratic_fit_weights(5)
    x = np.arange(-5, 6)
    level, slope, bend = w @ (2.0 + 3.0 * x - 0.5 * x * x)
    assert np.allclose([level, slope, bend], [2.0, 3.0, -0.5])


def test_settle_writes_into_the_shared_folder(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    out = settle(df)
    assert out.schema.names == df.schema.names and out.count() == 10
    files = out.inputFiles()
    assert files and all(shared_folder(spark) in f for f in files)
