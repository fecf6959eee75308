"""Multi-parameter trajectories: records, errors, persistence blend, sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from helioframe.config import PERSISTENCE_GRID, SETTINGS, TRAJECTORY_PARAMETERS
from helioframe.operators.forecast import at_anchors, loo_mean, with_neighbours

PARAMS = TRAJECTORY_PARAMETERS
MIN_FUTURE = 3

# Anchors and smoothing windows of the sweeps.
ANCHORS = [3.0, 5.0, 7.0, 10.0, 14.0, 21.0, 28.0]
WINDOWS = [1, 2, 3, 5, 7, 10, 14]
MIN_CELLS = 3
MIN_GAIN = 0.02


def trajectory_units(state: DataFrame, anchors: Sequence[float], horizon: int = SETTINGS.horizon_sim, back: int = SETTINGS.rolling_window) -> DataFrame:
    """Anchored device rows with their last ``back`` and next ``horizon`` days.

    All available days up to ``horizon`` are simulated, the first ``horizon_eval`` of
    them evaluated.  Too short a future drops the unit; fewer days than an evaluation
    needs mark it as truncated.
    """
    cols = [*[f"{p}_State" for p in PARAMS], "Daily_Irradiance_Dose", "Daily_Max_Temp_C", "Daily_Median_Humidity"]
    rows = with_neighbours(state, cols, horizon, back)
    u = at_anchors(rows, F.array(*[F.lit(float(a)) for a in anchors]))
    n = F.size("future")
    u = u.where(n >= MIN_FUTURE).withColumn("n_future", n).withColumn("n_evaluated", F.least(n, F.lit(SETTINGS.horizon_eval)))
    return u.withColumn("is_truncated", F.col("n_evaluated") < SETTINGS.horizon_eval)


def smoothed(p: str) -> Column:
    """Measured level of a parameter: its smoothed relative state in physical units."""
    return F.col(f"{p}_State") * F.col(f"{p}_Init")


def drift_motor(units: DataFrame, state: DataFrame) -> DataFrame:
    """Closed-form motor: each state moves by the mean daily change of the other devices."""
    v = loo_mean(state, [f"{p}_Delta" for p in PARAMS])
    u = units.join(v, "cell_name").select("*", F.posexplode("future").alias("pos", "f"))
    k = F.col("pos") + 1
    preds = [
        (F.greatest(F.lit(0.0), F.col(f"{p}_State") + k * F.col(f"loo_{p}_Delta")) * F.col(f"{p}_Init")).alias(f"Pred_{p}") for p in PARAMS
    ]
    return u.select(
        "cell_name", "anchor", "is_truncated", "n_future", "n_evaluated", k.alias("step"), F.col("f.Date_Day").alias("Date_Day"),
        F.col("f.Exposure_Days").alias("Exposure_Days"), *[(F.col(f"f.{p}_State") * F.col(f"{p}_Init")).alias(f"Actual_{p}") for p in PARAMS], *preds,
        *[smoothed(p).alias(f"Anchor_{p}") for p in PARAMS],
    )


def trajectory_records(state: DataFrame, forecast: DataFrame, anchor: float) -> DataFrame:
    """Calibration rows (measured only) followed by forecast rows (measured and predicted)."""
    info = forecast.groupBy("cell_name").agg(F.max("n_future").alias("n"), F.max("n_evaluated").alias("e"), F.max("is_truncated").alias("t"))
    tail = [F.col("n").alias("Forecast_Horizon_Used"), F.col("e").alias("Evaluation_Horizon_Used"), F.col("t").alias("Forecast_Truncated")]
    past = (
        state.where(F.col("Exposure_Days") <= anchor)
        .join(info, "cell_name")
        .select(
            "cell_name", "Date_Day", "Exposure_Days", F.lit("Calibration").alias("Phase"), *tail,
            *[smoothed(p).alias(f"Actual_{p}") for p in PARAMS], *[F.lit(None).cast("double").alias(f"Pred_{p}") for p in PARAMS],
        )
    )
    ahead = forecast.join(info, "cell_name").select(
        "cell_name", "Date_Day", "Exposure_Days", F.lit("Forecast").alias("Phase"), *tail,
        *[f"Actual_{p}" for p in PARAMS], *[f"Pred_{p}" for p in PARAMS],
    )
    return past.unionByName(ahead)


def long_errors(forecast: DataFrame, days: int = SETTINGS.horizon_eval, keep_truncated: bool = False) -> DataFrame:
    """Absolute error per parameter over the first forecast days."""
    f = forecast.where(F.col("step") <= days)
    if not keep_truncated:
        f = f.where(~F.col("is_truncated"))
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(p).alias("parameter"), F.col(f"Actual_{p}").alias("actual"), F.col(f"Pred_{p}").alias("motor"), F.col(f"Anchor_{p}").alias("persistence"))
                for p in PARAMS
            ]
        )
    )
    return f.select("cell_name", "anchor", rows.alias("r")).select("cell_name", "anchor", "r.*")


def trajectory_mae(forecast: DataFrame, days: int = SETTINGS.horizon_eval, keep_truncated: bool = False) -> DataFrame:
    """Mean over devices of the device's mean error, with its standard error, per anchor and parameter."""
    e = long_errors(forecast, days, keep_truncated)
    cells = e.groupBy("anchor", "parameter", "cell_name").agg(F.avg(F.abs(F.col("motor") - F.col("actual"))).alias("mae"))
    return cells.groupBy("anchor", "parameter").agg(
        F.avg("mae").alias("mae_mean"), F.try_divide(F.stddev_samp("mae"), F.sqrt(F.count("mae"))).alias("mae_se"), F.count("mae").alias("n_cells")
    )


def persistence_blend_sweep(forecast: DataFrame, grid: Sequence[float] = tuple(PERSISTENCE_GRID)) -> DataFrame:
    """Error of every blend of motor and anchor value: all weights in one grouped pass."""
    e = long_errors(forecast, keep_truncated=True)

    def err(k: float) -> Column:
        return F.avg(F.abs((1.0 - k) * F.col("motor") + k * F.col("persistence") - F.col("actual")))

    cells = e.groupBy("parameter", "cell_name").agg(*[err(k).alias(f"k{i}") for i, k in enumerate(grid)])
    means = cells.groupBy("parameter").agg(*[F.avg(f"k{i}").alias(f"k{i}") for i in range(len(grid))])
    rows = F.array(*[F.struct(F.lit(float(k)).alias("k"), F.col(f"k{i}").alias("mae")) for i, k in enumerate(grid)])
    return means.select("parameter", F.explode(rows).alias("r")).select("parameter", "r.*")


def adopt_blend(sweep: DataFrame, gain: float = MIN_GAIN) -> DataFrame:
    """Best weight per parameter, adopted only if it beats the plain motor clearly."""
    g = sweep.groupBy("parameter").agg(
        F.max(F.when(F.col("k") == 0.0, F.col("mae"))).alias("mae_0"),
        F.min_by(F.struct("k", "mae"), F.struct(F.round("mae", 12), F.col("k"))).alias("b"),
    )
    rel = F.when(F.col("mae_0") > 0, (F.col("mae_0") - F.col("b.mae")) / F.col("mae_0")).otherwise(0.0)
    return g.select(
        "parameter", "mae_0", F.col("b.k").alias("k_star"), F.col("b.mae").alias("mae_star"), F.when(rel >= gain, F.col("b.k")).otherwise(0.0).alias("k_adopted")
    )


def anchor_verdict(table: DataFrame) -> DataFrame:
    """Smallest anchor within one standard error of the best, among anchors with enough devices."""
    ok = table.where((F.col("n_cells") >= MIN_CELLS) & F.col("mae_mean").isNotNull())
    best = ok.groupBy("parameter").agg(
        F.min_by(F.struct("anchor", "mae_mean", F.coalesce("mae_se", F.lit(0.0)).alias("se")), F.struct("mae_mean", "anchor")).alias("b")
    )
    j = ok.join(best, "parameter").where(F.col("mae_mean") <= F.col("b.mae_mean") + F.col("b.se"))
    return j.groupBy("parameter").agg(
        F.max("b.anchor").alias("best_anchor"), F.max("b.mae_mean").alias("best_mae"), F.min("anchor").alias("min_usable_anchor")
    )


def window_verdict(table: DataFrame, production: int = SETTINGS.rolling_window) -> DataFrame:
    """Best smoothing window against the one in production."""
    ok = table.where((F.col("n_cells") >= MIN_CELLS) & F.col("mae_mean").isNotNull())
    g = ok.groupBy("parameter").agg(
        F.min_by(F.struct("window", "mae_mean"), F.struct("mae_mean", "window")).alias("b"),
        F.max(F.when(F.col("window") == production, F.col("mae_mean"))).alias("prod_mae"),
        F.max(F.when(F.col("window") == production, F.coalesce("mae_se", F.lit(0.0)))).alias("prod_se"),
    ).where(F.col("prod_mae").isNotNull())
    d = F.col("b.mae_mean") - F.col("prod_mae")
    verdict = F.when(F.abs(d) < F.col("prod_se"), "indistinguishable").when(d < 0, "best_beats_production").otherwise("production_optimal")
    return g.select("parameter", F.col("b.window").alias("best_window"), F.col("b.mae_mean").alias("best_mae"), "prod_mae", verdict.alias("verdict"))


def exposure_fill(records: DataFrame, daily: DataFrame, anchor: float) -> DataFrame:
    """Exposure of a forecast date where measured, else the anchor plus the days since."""
    known = daily.select("cell_name", "Date_Day", F.col("Exposure_Days").alias("known"))
    base = daily.where(F.col("Exposure_Days") <= anchor).groupBy("cell_name").agg(
        F.max("Exposure_Days").alias("base"), F.max("Date_Day").alias("base_day")
    )
    r = records.join(known, ["cell_name", "Date_Day"], "left").join(base, "cell_name", "left")
    return r.withColumn(
        "Exposure_Days", F.coalesce("known", F.col("base") + F.date_diff("Date_Day", "base_day"))
    ).drop("known", "base", "base_day")


def truncation_info(records: DataFrame) -> DataFrame:
    return records.groupBy("cell_name").agg(
        F.max("Forecast_Truncated").alias("is_truncated"), F.max("Forecast_Horizon_Used").alias("horizon_used"),
        F.max(F.when(F.col("Actual_PCE").isNotNull(), F.col("Date_Day"))).alias("last_truth_day"),
    )


def exposure_quartile_error(scored: DataFrame, pred: str, actual: str, bins: int = 4) -> DataFrame:
    """Error per exposure quantile bin; bins are right-closed, the first includes its left edge."""
    from helioframe.functions.ordered import exact_quantiles

    edges = exact_quantiles(scored, [], "Exposure_Days", {f"e{i}": i / bins for i in range(bins + 1)}).drop("n")
    s = scored.crossJoin(F.broadcast(edges))  # one-row edges
    b = F.lit(bins)
    for i in range(bins - 1, 0, -1):
        b = F.when(F.col("Exposure_Days") <= F.col(f"e{i}"), i).otherwise(b)
    s = s.withColumn("bin", b)
    return s.groupBy("bin").agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col(pred) - F.col(actual))).alias("mae"), F.min("Exposure_Days").alias("lo"), F.max("Exposure_Days").alias("hi")
    )
