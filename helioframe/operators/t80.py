"""Day on which a device falls below 80 % of its initial level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from helioframe.config import SETTINGS
from helioframe.functions.stages import settle
from helioframe.operators.features import daylight, with_exposure

INF = float("inf")


def tracked_rows(curves: DataFrame) -> DataFrame:
    """Daylight rows with exposure and a plausible pseudo fill factor.

    A missing or implausible pFF removes the row from both trackers.
    """
    return daylight(with_exposure(curves)).where(F.col("pFF") <= SETTINGS.pff_cap)


def daily_maxima(rows: DataFrame) -> DataFrame:
    """Daily maxima (UTC dates) of both metrics, irradiance, exposure and time."""
    return rows.groupBy("cell_name", F.to_date("Timestamp").alias("Date_Day")).agg(
        F.max("PCE").alias("PCE_max"),
        F.max("pFF").alias("pFF_max"),
        F.max("POA_Irradiance_W_m2").alias("POA_max"),
        F.max("Exposure_Days").alias("Exposure_Days_max"),
        F.max("Timestamp").alias("Datetime_max"),
    )


def initial_peak(daily: DataFrame, metric: str, days: int = SETTINGS.t80_peak_days) -> DataFrame:
    """Best of the first observed days; the earliest day wins a tie."""
    first = W.partitionBy("cell_name").orderBy("Date_Day")
    best = F.max_by(
        F.struct(F.col(metric).alias("initial"), F.col("Exposure_Days_max").alias("peak_day")),
        F.when(F.col(metric).isNotNull(), F.struct(F.col(metric), -F.col("day_no"))),
    )
    return (
        daily.withColumn("day_no", F.row_number().over(first))
        .where(F.col("day_no") <= days)
        .groupBy("cell_name")
        .agg(best.alias("best"))
        .select("cell_name", "best.initial", "best.peak_day")
    )


def below_flag(daily: DataFrame, metric: str, poa_gate: bool) -> DataFrame:
    d = daily.join(initial_peak(daily, metric), "cell_name", "left")
    below = (F.col("Exposure_Days_max") >= F.col("peak_day")) & (
        F.col(metric) < F.col("initial") * SETTINGS.t80_fraction
    )
    if poa_gate:
        below = below & (F.col("POA_max") > SETTINGS.t80_min_poa)
    return d.withColumn("is_below", F.coalesce(below, F.lit(False)).cast("int"))


def extract(flags: DataFrame, days: int = SETTINGS.t80_days) -> DataFrame:
    """Start of the first run of ``days`` observed days below, or of a run that reaches the end.

    Days are consecutive observed rows, not calendar days.
    """
    order = W.partitionBy("cell_name").orderBy("Date_Day")
    island = W.partitionBy("cell_name", "is_below").orderBy("Date_Day")
    f = (
        flags.withColumn("rn", F.row_number().over(order))
        .withColumn("n_days", F.count("*").over(W.partitionBy("cell_name")))
        .withColumn("run", F.col("rn") - F.row_number().over(island))
    )
    runs = (
        f.where(F.col("is_below") == 1)
        .groupBy("cell_name", "run", "n_days")
        .agg(
            F.count("*").alias("length"),
            F.min("rn").alias("start"),
            F.max("rn").alias("stop"),
            F.min("Exposure_Days_max").alias("survival_days"),
            F.min("Datetime_max").alias("failure_date"),
        )
        .where((F.col("length") >= days) | (F.col("stop") == F.col("n_days")))
    )
    first = runs.groupBy("cell_name").agg(
        F.min_by(F.struct("survival_days", "failure_date"), "start").alias("hit")
    )
    cells = flags.groupBy("cell_name").agg(F.first("initial").alias("initial"))
    return cells.join(first, "cell_name", "left").select(
        "cell_name",
        "initial",
        F.coalesce("hit.survival_days", F.lit(INF)).alias("survival_days"),
        F.col("hit.failure_date").alias("failure_date"),
    )


def t80_from_daily(daily: DataFrame) -> DataFrame:
    a = extract(below_flag(daily, "PCE_max", True)).select(
        "cell_name",
        F.col("initial").alias("PCE_initial"),
        (F.col("initial") * SETTINGS.t80_fraction).alias("T80_threshold_PCE"),
        F.col("survival_days").alias("survival_days_pce"),
        F.col("failure_date").alias("t80_failure_date_pce"),
    )
    b = extract(below_flag(daily, "pFF_max", False)).select(
        "cell_name",
        F.col("initial").alias("pFF_initial"),
        (F.col("initial") * SETTINGS.t80_fraction).alias("T80_threshold_pFF"),
        F.col("survival_days").alias("survival_days_pff"),
        F.col("failure_date").alias("t80_failure_date_pff"),
    )
    pce_first = F.col("survival_days_pce") <= F.col("survival_days_pff")
    return (
        a.join(b, "cell_name")
        .withColumn("combined_survival_days", F.least("survival_days_pce", "survival_days_pff"))
        .withColumn(
            "combined_failure_date",
            F.when(pce_first, F.col("t80_failure_date_pce")).otherwise(F.col("t80_failure_date_pff")),
        )
    )


def t80_table(curves: DataFrame) -> DataFrame:
    """Survival table, one row per device; ``inf`` means it never failed."""
    return t80_from_daily(settle(daily_maxima(tracked_rows(curves))))


def finite(c: str) -> F.Column:
    """NULL instead of ``inf`` for presentation."""
    return F.when(F.col(c) < INF, F.col(c))
