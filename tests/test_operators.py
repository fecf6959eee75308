"""Hand-computed edge cases: ties, NULLs, gaps, single rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helioframe.functions import expr as X
from helioframe.operators import asof, audits, curves, features, forecast, resample, screening, t80

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


# -- segmentation --------------------------------------------------------------


def segment(spark, directions, gap=5, chunk=3600, max_rows=5_000_000):
    rows = [("A", 0, i, at(i * gap), d, 0.1 * i, 1.0) for i, d in enumerate(directions)]
    df = spark.createDataFrame(rows, "cell_name string, cell_id int, pt int, Timestamp timestamp, ScanDirection string, Voltage_V double, Current_A double")
    out = curves.segment_cycles(df, chunk_seconds=chunk, max_rows=max_rows)
    return [r["curve"] for r in out.orderBy("pt").collect()]


@pytest.mark.parametrize("chunk", [3600, 10, 5])
def test_first_row_starts_a_curve_even_when_forward(spark, chunk):
    d = {"F": "Forward", "R": "Reverse"}
    assert segment(spark, [d[c] for c in "FFRRFR"], chunk=chunk) == [1, 1, 2, 2, 2, 3]
    assert segment(spark, [d[c] for c in "RRRR"], chunk=chunk) == [1, 1, 1, 1]


@pytest.mark.parametrize("max_rows", [1, 3, 1000])
def test_hot_chunks_are_cut_without_changing_the_numbers(spark, max_rows):
    import itertools

    d = list(itertools.islice(itertools.cycle(["Reverse"] * 3 + ["Forward"] * 4), 60))
    want, n = [], 0
    for i, x in enumerate(d):
        n += i == 0 or (x == "Reverse" and d[i - 1] != "Reverse")
        want.append(n)
    assert segment(spark, d, max_rows=max_rows) == want


def test_equal_timestamps_follow_the_point_number(spark):
    assert segment(spark, ["Reverse", "Forward", "Reverse"], gap=0) == [1, 1, 2]


# -- resampling ------------------------------------------------------------------


def test_bins_are_closed_on_the_right(spark):
    rows = [("A", at(600), 1.0), ("A", at(600) + dt.timedelta(microseconds=1), 3.0), ("A", at(1200), 5.0), ("A", at(3000), None)]
    df = spark.createDataFrame(rows, "cell_name string, Timestamp timestamp, x double")
    got = {r["bucket"]: r["x"] for r in resample.resample_right_closed(df, ["x"]).collect()}
    assert got == {at(600): 1.0, at(1200): 4.0}


def test_pce_edges(spark):
    rows = [(1.0, 100.0), (-1.0, 200.0), (1.0, 200.0), (1.0, None), (6.4e-3, 1000.0), (None, 500.0)]
    df = spark.createDataFrame(rows, "p double, g double").select(X.pce_from_power("p", "g").alias("e"))
    got = [r["e"] for r in df.collect()]
    assert got[:4] == [None, 0.0, 100.0, None] and abs(got[4] - 10.0) < 1e-9 and got[5] is None


# -- as-of -----------------------------------------------------------------------


def tables(spark, left, right):
    l = spark.createDataFrame([("A", i, at(t)) for i, t in enumerate(left)], "cell_name string, curve int, Timestamp timestamp")
    r = spark.createDataFrame([("A", at(t), v, i) for i, (t, v) in enumerate(right)], "cell_name string, bucket timestamp, v double, tie long")
    return l, r


@pytest.mark.parametrize("chunk", [60, 3600, 86400])
def test_asof_backward_tolerance_and_duplicates(spark, chunk):
    l, r = tables(spark, [5000, 6200, 6200.000001, 10, 20000], [(5000, 1.0), (5000, 2.0), (19000, 3.0)])
    out = asof.asof_backward(l, r, ["cell_name"], "Timestamp", "bucket", ["v"], "tie", 1200, chunk)
    assert {x["curve"]: x["v"] for x in out.collect()} == {0: 2.0, 1: 2.0, 2: None, 3: None, 4: 3.0}


def test_asof_nearest_prefers_backward_on_ties(spark):
    l, r = tables(spark, [100, 200, 5000, 290], [(0, 1.0), (200, 2.0), (380, 3.0)])
    out = asof.asof_nearest(l, r, ["cell_name"], "Timestamp", "bucket", ["v"], "tie", 1200)
    assert {x["curve"]: x["v"] for x in out.collect()} == {0: 1.0, 1: 2.0, 2: None, 3: 2.0}


def test_rates_and_doses_over_gaps_and_nulls(spark):
    rows = [("A", at(0), 10.0, 1.0, 100.0), ("A", at(600), 11.0, 1.0, None), ("A", at(1200), 11.0, 2.0, 300.0), ("A", at(9000), 20.0, 2.0, 600.0)]
    df = spark.createDataFrame(rows, "cell_name string, Timestamp timestamp, ModuleTemp_C double, AbsoluteHumidity_g_m3 double, POA_Irradiance_W_m2 double")
    got = features.with_rates_and_doses(df, chunk_seconds=600).orderBy("Timestamp").collect()
    assert [round(r["Delta_Temp_C_per_h"], 6) for r in got] == [0.0, 6.0, 0.0, 0.0]
    dose = [r["Cum_Light_Dose_Wh_m2"] for r in got]
    assert dose[1] is None and abs(dose[0] - 100 / 6) < 1e-9 and abs(dose[2] - 400 / 6) < 1e-9 and abs(dose[3] - 400 / 6) < 1e-9


# -- lifetime ----------------------------------------------------------------------


def daily(spark, values, skip=()):
    rows = [
        ("A", (T0 + dt.timedelta(days=i)).date(), v, 0.5, 800.0, float(i), T0 + dt.timedelta(days=i)) for i, v in enumerate(values) if i not in skip
    ]
    return spark.createDataFrame(
        rows, "cell_name string, Date_Day date, PCE_max double, pFF_max double, POA_max double, Exposure_Days_max double, Datetime_max timestamp"
    )


@pytest.mark.parametrize(
    "values, skip, want",
    [
        ([10, 10, 10, 7, 7, 9, 9, 9], (), float("inf")),  # two days, then recovery
        ([10, 10, 10, 7, 7, 7, 9, 9], (), 3.0),  # three days
        ([10, 10, 10, 9, 9, 7], (), 5.0),  # one day, on the last row
        ([10, 7, 7, 7], (), 1.0),  # straight after the peak
        ([10, 9, 9, 9], (), float("inf")),  # never below
        ([10], (), float("inf")),  # single row
        ([10, 10, 10, 7, 99, 7, 7, 9], (4,), 3.0),  # a missing calendar day does not break a run
    ],
)
def test_t80_runs(spark, values, skip, want):
    d = daily(spark, [float(v) for v in values], skip)
    r = t80.extract(t80.below_flag(d, "PCE_max", True)).collect()[0]
    assert r["survival_days"] == want
    brute = brute_force([float(v) for i, v in enumerate(values) if i not in skip], [float(i) for i in range(len(values)) if i not in skip])
    assert brute == want


def brute_force(v, day):
    head = v[:3]
    peak = max(head)
    peak_day = day[head.index(peak)]
    below = [d >= peak_day and x < 0.8 * peak for x, d in zip(v, day)]
    for i in range(len(v)):
        if below[i]:
            j = i
            while j + 1 < len(v) and below[j + 1]:
                j += 1
            if j - i + 1 >= 3 or j == len(v) - 1:
                return day[i]
    return float("inf")


def test_initial_peak_ties_and_nulls(spark):
    assert t80.initial_peak(daily(spark, [9.0, 9.0, 8.0, 99.0]), "PCE_max").collect()[0]["peak_day"] == 0.0
    r = t80.initial_peak(daily(spark, [None, 5.0]), "PCE_max").collect()[0]
    assert (r["initial"], r["peak_day"]) == (5.0, 1.0)


# -- curve parameters ----------------------------------------------------------------


def sweep(spark, vi):
    rows = [("A", 1, i, at(i), "Reverse", float(v), float(j) * 0.64 / 1000.0) for i, (v, j) in enumerate(vi)]
    return spark.createDataFrame(rows, "cell_name string, curve int, pt int, Timestamp timestamp, ScanDirection string, Voltage_V double, Current_A double")


def test_crossings_interpolate_both_axes(spark):
    vi = [(-0.1 + 0.1 * i, 20.0 - 2.0 * (-0.1 + 0.1 * i) / 0.1) for i in range(14)]
    r = curves.crossings(sweep(spark, vi)).collect()[0]
    assert abs(r["jsc"] - 20.0) < 1e-9 and abs(r["voc"] - 1.0) < 1e-9
    assert abs(r["jsc_compat"] - 1.0) < 1e-9  # the voltage where the current is zero


def test_crossings_below_ten_points_and_without_sign_change(spark):
    short = curves.crossings(sweep(spark, [(0.1 * i, 5.0) for i in range(9)])).collect()[0]
    assert short["voc"] is None and short["jsc"] is None
    flat = curves.crossings(sweep(spark, [(0.1 + 0.1 * i, 12.0 - i) for i in range(11)])).collect()[0]
    assert abs(flat["voc"] - 1.1) < 1e-9  # nearest to zero current
    assert abs(flat["jsc"] - 12.0) < 1e-9  # nearest to zero voltage


def test_smoothed_maximum_needs_ten_points(spark):
    assert curves.mpp_smoothed(sweep(spark, [(0.1 * i, 5.0) for i in range(9)])).collect()[0]["err_mpp"] == 1
    for n in (10, 11, 25):
        vi = [(0.1 * (i + 1), 30.0 - i) for i in range(n)]
        best = max(range(n), key=lambda i: vi[i][0] * vi[i][1])
        r = curves.mpp_smoothed(sweep(spark, vi)).collect()[0]  # power is a parabola: smoothing changes nothing
        assert abs(r["p_mpp"] - vi[best][0] * vi[best][1]) < 1e-9 and abs(r["v_mpp"] - vi[best][0]) < 1e-9


def test_dead_and_missing_parameters_are_gated(spark):
    audit = spark.createDataFrame([("A", 1, 1), ("A", 2, 1), ("A", 3, 0)], "cell_name string, curve int, is_curve_valid int")
    params = spark.createDataFrame([("A", 1, 0.9, 5.0), ("A", 2, None, 5.0), ("A", 3, 0.0, 0.0)], "cell_name string, curve int, voc double, jsc double")
    got = {r["curve"]: (r["rej_dead_cell"], r["is_curve_valid"]) for r in curves.physics_gate(audit, params).collect()}
    assert got == {1: (False, 1), 2: (True, 0), 3: (False, 0)}


def test_one_direction_has_no_hysteresis(spark):
    p = sweep(spark, [(0.1 * i, 5.0) for i in range(12)]).withColumn("cell_id", F.lit(0))
    assert curves.curve_stats(p).collect()[0]["hysteresis_index"] is None


# -- screening ----------------------------------------------------------------------


def test_residual_threshold_edges(spark):
    def layered(values):
        df = spark.createDataFrame([(v,) for v in values], "r double")
        return screening.residual_threshold(df, "r").collect()[0]["layered"]

    assert layered([]) == 0.01
    assert layered([0.5]) == 0.5
    assert abs(layered([0.0, 1.0]) - 0.98) < 1e-12
    assert layered([0.001, 0.002]) == 0.01


def test_plateau_prefers_the_earliest_longest_run(spark):
    rows = [(5.0, 3, "a,b,c"), (7.0, 3, "a,b,c"), (10.0, 2, "a,b"), (14.0, 2, "a,b")]
    df = spark.createDataFrame(rows, "window double, n_survivors long, survivors string")
    r = screening.cohort_plateau(df).collect()[0]
    assert (r["lo"], r["hi"], r["length"]) == (5.0, 7.0, 2) and r["centre"] in (5.0, 7.0)
    one = screening.cohort_plateau(df.limit(1)).collect()[0]
    assert one["centre"] == 5.0


def test_kolmogorov_smirnov_edges(spark):
    def stat(a, b):
        rows = [("A", float(x)) for x in a] + [("B", float(x)) for x in b]
        df = spark.createDataFrame(rows, "pop string, r double")
        return screening.ks_two_sample(df, "pop", "A", "B", "r").collect()[0]["statistic"]

    assert stat([1, 2, 2, 3], [1, 2, 2, 3]) == 0.0
    assert stat([1, 2], [5, 6]) == 1.0
    assert abs(stat([1, 1, 2], [1, 2, 2]) - 1 / 3) < 1e-12


def test_folds_partition_the_rows(spark):
    rows = [("A" if i < 9 else "B", i, at(i)) for i in range(13)]
    df = spark.createDataFrame(rows, "cell_name string, curve int, Timestamp timestamp")
    got = {r["curve"]: r["fold"] for r in screening.contiguous_folds(df).collect()}
    assert [got[i] for i in range(13)] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 4, 4]


# -- forecast ------------------------------------------------------------------------


def test_rul_from_damage_edges(spark):
    rows = [(0.0, 0.014, 14.0), (-0.05, -0.05, 14.0), (0.2, 0.3, 14.0), (0.0, -1.0, 14.0), (0.1, None, 0.0)]
    df = spark.createDataFrame(rows, "d0 double, d1 double, n double")
    got = [r["x"] for r in df.select(X.rul_from_damage(F.col("d0"), F.col("d1"), F.col("n")).alias("x")).collect()]
    assert abs(got[0] - 200.0) < 1e-6  # 0.2 / 0.001: no weight on the floor yet
    assert abs(got[1] - 0.25 / 1e-4) < 1e-6
    assert got[2] == 0.0 and abs(got[3] - 2000.0) < 1e-6 and got[4] is None


def test_countdown_first_anchor_rebound_and_missing(spark):
    steps = [(14.0, 20.0), (21.0, None), (28.0, 90.0), (35.0, 1.0)]
    df = spark.createDataFrame([(steps,)], "steps array<struct<day:double,raw:double>>")
    c = {"mu": F.lit(0.2), "eps": F.lit(0.0), "k_blend": F.lit(0.2), "t_ref": F.lit(54.0)}
    got = df.select(forecast.countdown(F.col("steps"), c).alias("o")).collect()[0]["o"]
    r0 = 0.8 * 20 + 0.2 * 40
    r2 = 0.8 * min(0.2 * 90 + 0.8 * max(0, r0 - 14), r0) + 0.2 * 26
    r3 = 0.8 * min(0.2 * 1 + 0.8 * max(0, r2 - 7), r2) + 0.2 * 19
    assert got[1] is None
    assert all(abs(a - b) < 1e-9 for a, b in zip([got[0], got[2], got[3]], [r0, r2, r3]))


def test_paired_delta_edges(spark):
    def verdict(base, other):
        mk = lambda xs: spark.createDataFrame([(str(i), float(x)) for i, x in enumerate(xs)], "cell_name string, mae double")
        return forecast.paired_delta(mk(base), mk(other)).collect()[0]["verdict"]

    assert verdict([1], [2]) == "UNDEFINED"
    assert verdict([1, 1], [2, 2.2]) == "IMPORTANT"
    assert verdict([2, 2.2], [1, 1]) == "HARMFUL"
    assert verdict([0, 0], [0, 2]) == "INFORMATIVE"  # delta equals its standard error


def test_grid_search_agrees_with_a_loop(spark):
    import math

    units = [("A", "Sensor", 14, 14.0, 0.02, 0.05, 14), ("A", "Sensor", 21, 21.0, 0.06, 0.10, 14), ("A", "API", 14, 14.0, 0.02, 0.04, 10)]
    df = spark.createDataFrame(units, "cell_name string, Type string, anchor int, Anchor_Day double, D0 double, D_end double, n_future int")
    life = spark.createDataFrame([("A", 40.0)], "cell_name string, combined_survival_days double")
    small = {"phi_0": [0.001, 0.0025], "phi_1": [0.0025], "phi_2": [1.5], "lambda_w": [0.5, 1.0], "mu": [0.2, 0.5], "eps": [0.0], "k_blend": [0.0, 0.2], "t_ref": [54.0]}
    got = forecast.coefficient_grid_search(df, life, small).collect()
    assert len(got) == 16

    def raw(d0, d1, n, r):
        v, rho = max(1e-4, (d1 - d0) / n), max(0, d0) / 0.2
        fl, w = r["phi_0"] + r["phi_1"] * math.exp(rho * r["phi_2"]), min(1, rho) ** r["lambda_w"]
        return min((0.2 - d0) / max(1e-4, (1 - w) * v + w * max(v, fl)), 3650)

    for r in got:
        errs = {"Sensor": [], "API": []}
        for kind in errs:
            prev = None
            for u in [u for u in units if u[1] == kind]:
                x = raw(u[4], u[5], u[6], r)
                if prev:
                    x = min(r["mu"] * x + (1 - r["mu"]) * max(0, prev[1] - (u[3] - prev[0])), prev[1] + r["eps"])
                if r["k_blend"] > 0:
                    x = (1 - r["k_blend"]) * x + r["k_blend"] * max(0, r["t_ref"] - u[3])
                prev = (u[3], x)
                errs[kind].append(abs(x - (40.0 - u[3])))
        assert abs(r["mae_sensor"] - sum(errs["Sensor"]) / 2) < 1e-9 and abs(r["mae_api"] - errs["API"][0]) < 1e-9


def test_rolling_median_windows(spark):
    rows = [("A", (T0 + dt.timedelta(days=i)).date(), float(v)) for i, v in enumerate([1, 5, 2, 8])]
    df = spark.createDataFrame(rows, "cell_name string, Date_Day date, x double")
    out = df.select("Date_Day", features.rolling_median("x", 1).alias("one"), features.rolling_median("x", 2).alias("two")).orderBy("Date_Day").collect()
    assert [r["one"] for r in out] == [1, 5, 2, 8] and [r["two"] for r in out] == [1.0, 3.0, 3.5, 5.0]


def test_sample_keeps_exactly_the_lowest_hashes(spark):
    import hashlib

    rows = [("hot", i) for i in range(300)] + [("cold", i) for i in range(5)]
    df = spark.createDataFrame(rows, "cell_name string, curve int")
    key = F.concat_ws("|", "cell_name", F.col("curve").cast("string"))
    got = {(r["cell_name"], r["curve"]) for r in audits.stratified_sample(df, 20, key).collect()}
    order = sorted((hashlib.md5(f"hot|{i}".encode()).hexdigest(), i) for i in range(300))[:20]
    assert got == {("hot", i) for _, i in order} | {("cold", i) for i in range(5)}
