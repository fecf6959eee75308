"""Array summaries of sweeps against the window functions they stand for."""

import dataclasses
import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from helioframe.operators import curves as C, sweep_arrays as A

T0 = dt.datetime(2024, 1, 1, 2)


@pytest.fixture(scope="module")
def points(spark):
    rng, rows = random.Random(3), []
    for cell in ("A", "B"):
        for curve in range(1, 40):
            n = rng.choice([1, 2, 8, 9, 10, 11, 12, 40])
            for k in range(n):
                v, i = round(rng.uniform(-0.1, 1.1), 1), rng.uniform(-0.002, 0.02)
                if curve == 7:
                    v = None if k == 0 else v
                if curve == 8 and k == n - 1:
                    i = math.nan
                d = None if curve == 9 and k == 0 else "Reverse" if k < n // 2 else "Forward"
                rows.append((cell, curve, 3, k, T0 + dt.timedelta(seconds=curve * 900 + 5 * k), d, v, i))
    kinds = "cell_name string, curve int, cell_id long, pt int, Timestamp timestamp, ScanDirection string, Voltage_V double, Current_A double"
    return spark.createDataFrame(rows, kinds).repartition(3)


def rows(df, columns):
    out = {}
    for r in df.select(*columns).collect():
        d = r.asDict(recursive=True)
        out[d["cell_name"], d["curve"]] = d
    return out


def alike(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, rel=1e-9, abs=1e-12)
    return a == b


@pytest.mark.parametrize("longest, batch", [(500_000, 65_536), (500_000, 16), (11, 16)])
def test_summary_equals_window_functions(spark, points, monkeypatch, longest, batch):
    plain = C._smooth_columns(C._crossing_columns(C._by_voltage(C.curve_points(points))))
    want = C._finish_parameters(plain.groupBy(*C.KEY).agg(*C._stat_aggregates(), *C._crossing_aggregates(), *C._smooth_aggregates()))
    make = A.summaries

    def small(schema):
        def run(batches):  # the limits hold in the worker
            A.LONGEST, A.BATCH = longest, batch
            return make(schema)(batches)

        return run

    monkeypatch.setattr(A, "summaries", small)
    got = C.curve_summary(points)
    assert set(got.columns) == set(want.columns)
    a, b = rows(got, want.columns), rows(want, want.columns)
    assert a.keys() == b.keys() and len(a) == got.count()
    for key, r in b.items():
        assert all(alike(a[key][c], x) for c, x in r.items()), (key, a[key], r)


def test_points_are_shuffled_once_and_numbers_do_not_depend_on_ranges(spark, points):
    few = C.segment_cycles(points.drop("curve"), max_rows=5_000_000)
    many = C.segment_cycles(points.drop("curve"), max_rows=20)
    key = ["cell_name", "Timestamp", "pt", "curve"]
    assert sorted(map(tuple, few.select(*key).collect())) == sorted(map(tuple, many.select(*key).collect()))
    assert few.select("curve").distinct().count() > 10
    assert "Sort" not in few._jdf.queryExecution().executedPlan().toString().split("BroadcastHashJoin")[-1]
    assert few.where(F.col("curve") < 1).isEmpty()


@pytest.fixture(scope="module")
def numbered(spark, points):
    """Unnumbered points with missing devices and times, and what numbering and windows make of them."""
    raw = points.drop("curve").withColumn("Timestamp", F.when(~((F.col("cell_name") == "B") & (F.col("pt") == 5)), F.col("Timestamp")))
    raw = C.settle(raw.unionByName(raw.where("pt < 2").withColumn("cell_name", F.lit(None).cast("string"))))
    p = C.segment_cycles(raw)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(C, "SETTINGS", dataclasses.replace(C.SETTINGS, night_points_min=5))
        noise = C.noise_floor(p).first()["noise"]
    return raw, C.settle(C.curve_summary(p)), noise, C.settle(C.shape_vectors(p, 6))


@pytest.mark.parametrize("parts, longest, batch", [(7, 11, 16), (40, 500_000, 65_536)])
def test_one_pass_over_ranges_equals_numbering_and_summaries(numbered, monkeypatch, parts, longest, batch):
    raw, want, noise, shapes = numbered
    make = A.of_ranges

    def small(*args):
        def run(batches):  # the limits hold in the worker
            A.LONGEST, A.BATCH = longest, batch
            return make(*args)(b.slice(k, 5) for b in batches for k in range(0, b.num_rows, 5))

        return run

    monkeypatch.setattr(A, "of_ranges", small)
    monkeypatch.setattr(C, "SETTINGS", dataclasses.replace(C.SETTINGS, night_points_min=5))
    got, level, forms = C.sweeps_of_points(raw, 6, max_rows=-(-raw.count() // parts))
    assert set(got.columns) == set(want.columns) and [got.schema[c].dataType for c in want.columns] == [want.schema[c].dataType for c in want.columns]
    a, b = rows(got, want.columns), rows(want, want.columns)
    assert a.keys() == b.keys() and len(a) == got.count() > 40
    for key, r in b.items():
        assert all(alike(a[key][c], x) for c, x in r.items()), (key, a[key], r)
    assert level.first()["noise"] == pytest.approx(noise, rel=1e-12) and noise > 1e-5
    a, b = rows(forms, forms.columns), rows(shapes, shapes.columns)
    assert a.keys() == b.keys() and len(a) == forms.count() > 10
    for key, r in b.items():
        assert a[key]["shape"] == pytest.approx(r["shape"], rel=1e-9, abs=1e-12, nan_ok=True), key


def test_points_are_not_stored_or_shuffled_a_second_time(spark, points, monkeypatch):
    stored, settle = [], C.settle

    def counted(df):
        stored.append(settle(df))
        return stored[-1]

    monkeypatch.setattr(C, "settle", counted)
    n = 300
    many = spark.range(n * 40).selectExpr(
        "'A' as cell_name", "1L as cell_id", "cast(id % 40 as int) as pt", "timestamp_seconds(1704067200 + id * 5) as Timestamp",
        "if(id % 40 < 20, 'Reverse', 'Forward') as ScanDirection", "1.0 - (id % 20) / 19.0D as Voltage_V", "0.01D + (id % 7) / 1000.0D as Current_A",
    )
    summary, _, _ = C.sweeps_of_points(many)
    assert summary.count() == n
    assert stored[0].count() < n + 40 * 2 * 2 + n * 40 * 10 // 24  # sweeps, the ends of two ranges, night steps
    assert stored[0].where(F.col("kind") == A.POINT).count() <= 40 * 2 * 2


OPERATORS = {
    "mpp_smoothed": C.mpp_smoothed,
    "sweep_interpolate": lambda p: C.sweep_interpolate(p, 6),
    "shape_vectors": lambda p: C.shape_vectors(p, 6, [F.size("shape").alias("n"), F.array_max("shape").alias("most")]),
    "sweep_directions": C.sweep_directions,
    "noise_floor": lambda p: C.noise_floor(p, "per_device"),
    "curve_scores": lambda p: C.curve_scores(p, "per_device").select(*C.KEY, "n_points", "v_span_ratio", "snr_i", "n_unphysical"),
    "counted_points": lambda p: C.counted_points(C.curve_scores(p)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_number_the_points_in_their_own_pass(numbered, monkeypatch, name):
    raw, numbers = numbered[0], C.segment_cycles
    monkeypatch.setattr(C, "SETTINGS", dataclasses.replace(C.SETTINGS, night_points_min=5))
    want = OPERATORS[name](numbers(raw))
    monkeypatch.setattr(C, "segment_cycles", None)
    monkeypatch.setattr(C, "SLICE_ROWS", 300)
    got = OPERATORS[name](raw)
    assert set(got.columns) == set(want.columns)
    order = lambda df: sorted((tuple(r) for r in df.select(*want.columns).collect()), key=lambda r: [repr(x) if isinstance(x, str | bool | int | None) else "" for x in r])
    a, b = order(got), order(want)
    assert len(a) == len(b) > 1
    assert all(alike(x, y) for r, s in zip(a, b) for x, y in zip(r, s))


def test_slices_of_time_keep_all_points(numbered):
    raw = numbered[0]
    some = C._slices(raw, raw.count(), 250)
    assert len(some) > 3
    inside = raw.select(F.array(*[F.coalesce(c, F.lit(False)).cast("int") for c in some]).alias("a"))
    assert {sum(r["a"]) for r in inside.collect()} == {1}


def test_unphysical_points_are_dropped_by_count(spark):
    rows = [("A", 1, 4, 2, 1), ("A", 2, 3, 3, 1), ("A", 3, 3, 3, 0), ("B", 1, 5, 0, 1)]
    stats = spark.createDataFrame(rows, "cell_name string, curve int, n_points long, n_unphysical long, is_curve_valid int")
    kept = C.drop_unphysical_points(C.counted_points(stats), stats).groupBy("cell_name", "curve").agg(F.sum("n").alias("n"))
    assert {tuple(r) for r in kept.collect()} == {("A", 1, 2), ("A", 3, 3), ("B", 1, 5)}


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows = [(i, i % 3, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), "a", 20.0 + i % 60, '{"k": 1}') for i in range(900)]
    kinds = "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string"
    spark.createDataFrame(rows, kinds).write.parquet(str(path / "events.parquet"))
    return str(path)


@pytest.mark.parametrize(
    "name", [
        "a06_noise_floor_per_device", "a07_span_ratio_and_snr", "a17_qc_yield", "a18_qc_direction_counts", "a19_curve_timings", "a57_span_distribution",
        "j08_composite_key_flag", "p04_unphysical_point", "shape_pseudo_ff", "w23_mpp_smoothed", "w28_sweep_interpolate",
    ]
)
def test_queries_store_no_points_but_those_at_ends(spark, events, monkeypatch, name):
    from helioframe.plans import catalog  # noqa: F401 (registers the queries)
    from helioframe.plans.registry import CATALOG

    stored, settle = [], C.settle

    def counted(df):
        stored.append(settle(df))
        return stored[-1]

    monkeypatch.setattr(C, "segment_cycles", None)
    monkeypatch.setattr(C, "settle", counted)
    catalog.load()
    assert CATALOG[name].run(spark, events).count() > 1
    assert stored[0].where(F.col("kind") == A.POINT).count() <= 40 * 2 * 3 * 2  # two sweeps a device and range of 36,000 points
