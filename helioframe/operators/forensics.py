"""Failure forensics on daily tables (one row per device-day)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from helioframe.config import SETTINGS
from helioframe.functions.expr import correlation



def cell() -> W:
    return W.partitionBy("cell_name")


def by_day() -> W:
    return cell().orderBy("Date_Day")


# Evidence thresholds.
SUDDEN_JUMP = 0.20
THERMAL_RATIO = 1.30
LOW_PCE_RATIO = 0.85
LOW_STD_RATIO = 0.60
LOW_RECOVERY_PCT = 30.0
EARLY_DAYS = 10.0

# Days count as recovering or degrading beyond this increment.
MOVE = 0.001


def cohort_overview(daily: DataFrame, t80: DataFrame) -> DataFrame:
    inc = F.col("Daily_Damage_Increment")
    g = daily.groupBy("cell_name").agg(
        F.count("*").alias("n_days"),
        F.avg("Daily_Max_Temp_C").alias("temp_mean"),
        F.avg("Daily_Median_Humidity").alias("humidity_mean"),
        F.avg("Daily_Irradiance_Dose").alias("irr_mean"),
        F.avg("PCE").alias("pce_mean"),
        F.stddev_samp("PCE").alias("pce_std"),
        F.max_by("Cumulative_Damage", "Date_Day").alias("damage_final"),
        F.avg(inc).alias("damage_rate_mean"),
        F.stddev_samp(inc).alias("damage_rate_std"),
        F.max(inc).alias("max_daily_jump"),
        (100.0 * F.count_if(inc < -MOVE) / F.count("*")).alias("recovery_days_pct"),
    )
    j = g.join(t80.select("cell_name", "combined_survival_days"), "cell_name", "left")
    # One row per device: the ranking window is small.
    return j.withColumn("survival_rank", F.rank().over(W.orderBy("combined_survival_days")))


def matched_peers(daily: DataFrame, target: str, metrics: Sequence[str], early: float = EARLY_DAYS) -> DataFrame:
    """Early-phase means of the target and of all other devices pooled, with ratios."""
    mine = F.col("cell_name") == target
    one = daily.where(F.col("Exposure_Days") <= early).agg(
        *[F.avg(F.when(mine, F.col(m))).alias(f"t_{m}") for m in metrics],
        *[F.avg(F.when(~mine, F.col(m))).alias(f"p_{m}") for m in metrics],
    )
    rows = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"t_{m}").alias("target"), F.col(f"p_{m}").alias("peers")) for m in metrics])
    )
    out = one.select(rows.alias("r")).select("r.*")
    ratio = F.try_divide(F.col("target"), F.col("peers"))
    return out.withColumn("ratio", ratio).withColumn("is_off", F.abs(ratio - 1.0) > 0.3)


def thermal_dose(daily: DataFrame) -> DataFrame:
    t = F.col("Daily_Max_Temp_C")
    cols: list[Column] = [F.count("*").alias("n_days")]
    for x in (35, 40, 45, 50):
        cols += [F.count_if(t > x).alias(f"days_{x}"), (100.0 * F.count_if(t > x) / F.count("*")).alias(f"pct_{x}")]
    cols += [F.sum(F.greatest(F.lit(0.0), t - x)).alias(f"thermal_dose_{x}") for x in (35, 40)]
    return daily.groupBy("cell_name").agg(*cols)


def recovery_days(daily: DataFrame) -> DataFrame:
    inc = F.col("Daily_Damage_Increment")
    return daily.groupBy("cell_name").agg(
        F.count_if(inc < -MOVE).alias("n_recovery"),
        F.count_if(inc > MOVE).alias("n_degradation"),
        F.count_if(F.abs(inc) <= MOVE).alias("n_flat"),
        F.min(inc).alias("largest_recovery"),
        F.max(inc).alias("largest_degradation"),
        (100.0 * F.count_if(inc < -MOVE) / F.count("*")).alias("recovery_pct"),
    )


def feature_correlation(matrix: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    g = matrix.groupBy("cell_name").agg(*[correlation(f, target).alias(f) for f in features])
    return g.unpivot(["cell_name"], list(features), "feature", "pearson")


def target_profile(matrix: DataFrame, target: str) -> DataFrame:
    """Distribution of a daily target and its correlation with the day before.

    One row per device, and one with the device NULL over all of them together.
    """
    t = F.col(target)
    m = matrix.withColumn("before", F.lag(t).over(by_day()))
    return m.groupingSets([["cell_name"], []], "cell_name").agg(
        F.count(t).alias("n"),
        F.avg(t).alias("mean"),
        F.percentile(t, 0.5).alias("median"),
        F.stddev_samp(t).alias("std"),
        F.min(t).alias("min"),
        F.max(t).alias("max"),
        F.skewness(t).alias("skew"),
        (100.0 * F.count_if(t == 0) / F.count(t)).alias("pct_zero"),
        (100.0 * F.count_if(t < 0) / F.count(t)).alias("pct_negative"),
        correlation(t, F.col("before")).alias("lag_corr"),
    )


def prefailure_window(daily: DataFrame, days: int = 5) -> DataFrame:
    """The last days of each device, with days of thin coverage marked."""
    last = F.max("Date_Day").over(cell())
    med = F.percentile("n_curves", 0.5).over(cell())
    d = daily.withColumn("last_day", last).withColumn("median_curves", med)
    d = d.where(F.col("Date_Day") > F.date_sub("last_day", days))
    return d.withColumn("is_low_coverage", F.col("n_curves") < 0.5 * F.col("median_curves"))


def lagged_cross_correlation(daily: DataFrame, max_lag: int = 10) -> DataFrame:
    """Correlation of temperature with the damage increment k days later; one aggregate for all lags."""
    lags = range(max_lag + 1)
    d = daily
    for k in lags:
        d = d.withColumn(f"inc_{k}", F.lead("Daily_Damage_Increment", k).over(by_day()))
    g = d.groupBy("cell_name").agg(*[correlation("Daily_Max_Temp_C", f"inc_{k}").alias(str(k)) for k in lags])
    return g.unpivot(["cell_name"], [str(k) for k in lags], "lag", "corr").withColumn("lag", F.col("lag").cast("int"))


def best_lag(xcorr: DataFrame) -> DataFrame:
    key = F.when(F.col("corr").isNotNull(), F.struct(F.abs("corr"), -F.col("lag")))
    return xcorr.groupBy("cell_name").agg(F.max_by(F.struct("lag", "corr"), key).alias("b")).select(
        "cell_name", F.col("b.lag").alias("best_lag"), F.col("b.corr").alias("best_corr")
    )


def device_metrics(daily: DataFrame) -> DataFrame:
    """Per device the metrics judged as evidence, next to the mean over its peers."""
    early = F.when(F.col("Exposure_Days") <= EARLY_DAYS, F.col("PCE"))
    inc = F.col("Daily_Damage_Increment")
    m = daily.groupBy("cell_name").agg(
        F.max(inc).alias("max_jump"),
        F.sum(F.greatest(F.lit(0.0), F.col("Daily_Max_Temp_C") - 35.0)).alias("thermal_dose_35"),
        F.avg(early).alias("pce_early_mean"),
        F.stddev_samp(early).alias("pce_std"),
        (100.0 * F.count_if(inc < -MOVE) / F.count("*")).alias("recovery_pct"),
    )
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # one row per device
    for c in ("thermal_dose_35", "pce_early_mean", "pce_std"):
        others = (F.sum(c).over(every) - F.col(c)) / F.nullif(F.count(c).over(every) - 1, F.lit(0))
        m = m.withColumn(f"peer_{c}", others)
    return m


def failure_evidence(metrics: DataFrame) -> DataFrame:
    """Five evidence flags and the first matching failure mode."""
    c = F.col
    m = (
        metrics.withColumn("sudden_collapse", c("max_jump") > SUDDEN_JUMP)
        .withColumn(
            "thermal_dose_stress",
            (c("peer_thermal_dose_35") > 0) & (c("thermal_dose_35") > c("peer_thermal_dose_35") * THERMAL_RATIO),
        )
        .withColumn(
            "low_initial_pce",
            (c("peer_pce_early_mean") > 0) & (c("pce_early_mean") < c("peer_pce_early_mean") * LOW_PCE_RATIO),
        )
        .withColumn("low_pce_variance", (c("peer_pce_std") > 0) & (c("pce_std") < c("peer_pce_std") * LOW_STD_RATIO))
        .withColumn("monotonic_degradation", c("recovery_pct") < LOW_RECOVERY_PCT)
    )
    flags = ["sudden_collapse", "thermal_dose_stress", "low_initial_pce", "low_pce_variance", "monotonic_degradation"]
    for f in flags:
        m = m.withColumn(f, F.coalesce(f, F.lit(False)))
    any_flag = c(flags[0])
    for f in flags[1:]:
        any_flag = any_flag | c(f)
    sudden, heat, weak, calm = (c(f) for f in flags[:4])
    # Mode, confidence and advice codes in order of precedence.
    rules = [
        (sudden & heat, "Thermal-dose-driven sudden collapse", "high", "thermal_management"),
        (sudden & weak, "Sudden collapse of an intrinsically weak cell", "medium", "manufacturing_inspection"),
        (sudden, "Sudden structural collapse (mechanism unknown)", "medium", "hardware_inspection"),
        (weak & calm, "Intrinsically weak cell with low starting performance", "medium", "exclude_from_reference"),
        (~any_flag, "No anomaly detected with current diagnostic rules", "low", "none"),
    ]
    tail = ("Anomalous behavior (unspecified)", "low", "enlarge_cohort")
    for i, name in enumerate(("mode", "confidence", "recommendation")):
        e = F.when(rules[0][0], rules[0][1 + i])
        for r in rules[1:]:
            e = e.when(r[0], r[1 + i])
        m = m.withColumn(name, e.otherwise(tail[i]))
    return m
