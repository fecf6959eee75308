"""Trajectory units and records on two hand-made devices of 10 and 40 days."""

import datetime as dt

from helioframe.config import TRAJECTORY_PARAMETERS as PS
from helioframe.operators import models, trajectory


def state(spark):
    rows = []
    for cell, days in (("short", 10), ("long", 40)):
        for d in range(1, days + 1):
            level = 1.0 - 0.01 * d
            values = [x for i, _ in enumerate(PS) for x in (99.0, level, 2.0 + i, -0.01)]
            rows.append((cell, dt.date(2024, 1, 1) + dt.timedelta(d), float(d), 5.0, 40.0, 8.0, *values))
    cols = ", ".join(f"{p} double, {p}_State double, {p}_Init double, {p}_Delta double" for p in PS)
    return spark.createDataFrame(rows, f"cell_name string, Date_Day date, Exposure_Days double, Daily_Irradiance_Dose double, Daily_Max_Temp_C double, Daily_Median_Humidity double, {cols}")


def test_horizons_history_and_levels(spark):
    s = state(spark)
    units = {r["cell_name"]: r for r in trajectory.trajectory_units(s, [5.0]).collect()}
    assert (units["short"]["n_future"], units["short"]["n_evaluated"], units["short"]["is_truncated"]) == (5, 5, True)
    assert (units["long"]["n_future"], units["long"]["n_evaluated"], units["long"]["is_truncated"]) == (30, 14, False)
    assert all(len(u["recent"]) == 5 for u in units.values())
    assert {len(r["recent"]) for r in trajectory.trajectory_units(s, [9.0, 20.0]).where("cell_name = 'long'").collect()} == {7}
    f = trajectory.drift_motor(trajectory.trajectory_units(s, [5.0]), s)
    for r in f.where("cell_name = 'long'").collect():
        assert abs(r["Actual_PCE"] - (1 - 0.01 * (5 + r["step"])) * 2.0) < 1e-9  # the smoothed level, not the raw 99
        assert abs(r["Anchor_PCE"] - 0.95 * 2.0) < 1e-9
        assert abs(r["Pred_PCE"] - r["Actual_PCE"]) < 1e-9
    records = trajectory.trajectory_records(s, f, 5.0).groupBy("cell_name", "Phase", "Forecast_Horizon_Used", "Evaluation_Horizon_Used").count().collect()
    got = {tuple(r) for r in records}
    assert got == {("short", "Calibration", 5, 5, 5), ("short", "Forecast", 5, 5, 5), ("long", "Calibration", 30, 14, 5), ("long", "Forecast", 30, 14, 30)}


def test_blind_models_never_see_the_device(spark):
    s = state(spark)
    fit = lambda train: {r[0] for r in train.select("cell_name").distinct().collect()}
    seen = {}

    def roll(units, model):
        seen[units.first()["cell_name"]] = model
        return units.select("cell_name")

    units = trajectory.trajectory_units(s, [5.0])
    assert models.blind(units, s, fit, roll).count() == 2
    assert seen == {"short": {"long"}, "long": {"short"}}
    alone = s.where("cell_name = 'long'")
    assert models.blind(trajectory.trajectory_units(alone, [5.0]), alone, fit, roll) is None
    assert models.blind(trajectory.trajectory_units(alone, [5.0]), alone, fit, roll, "cell_name string").count() == 0


def test_permutation_moves_every_row(spark):
    """A feature that decides the target alone: shuffling it costs the mean distance of two random rows."""
    from pyspark.ml.regression import LinearRegression

    rows = [(f"C{i % 5}", dt.date(2024, 1, 1) + dt.timedelta(i), float(i), float(i % 3), float(i)) for i in range(60)]
    m = spark.createDataFrame(rows, "cell_name string, Date_Day date, x double, z double, y double")
    model = LinearRegression(labelCol="y").fit(models.assemble(m, ["x", "z"]))
    got = {r["feature"]: r["importance"] for r in models.permutation_importance(m, model, "y", ["x", "z"]).collect()}
    assert abs(got["x"] - (60**2 - 1) / (3 * 60)) < 1.5 and abs(got["z"]) < 1e-6
