"""Causal rates, cumulative doses, merged curve matrix and daily matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from helioframe.config import SETTINGS
from helioframe.functions.expr import cyclic_time, days_between, relative_to_initial
from helioframe.functions.ordered import exact_quantiles, ordered_scan, time_chunk
from helioframe.operators.asof import asof_backward

GAP_S = SETTINGS.merge_tolerance_seconds


def with_rates_and_doses(df: DataFrame, ts: str = "Timestamp", chunk_seconds: int = 21600) -> DataFrame:
    """Per-hour changes and running doses over each device's telemetry.

    The first row counts 600 s; a gap beyond the tolerance counts 0 h, and a
    rate over 0 h is 0.
    """
    c = df.withColumn("time_chunk", time_chunk(ts, chunk_seconds))
    prev = F.struct(
        F.unix_micros(ts).alias("us"), F.col("ModuleTemp_C").alias("temp"), F.col("AbsoluteHumidity_g_m3").alias("hum")
    )
    c = ordered_scan(c, ["cell_name"], [ts], "time_chunk", lags={"prev": prev}, store=True)
    dt = (F.unix_micros(ts) - F.col("prev.us")) / F.lit(1e6)
    hours = F.when(dt.isNull(), 600.0).when(dt > GAP_S, 0.0).otherwise(dt) / 3600.0
    c = c.withColumn("dt_hours", hours)

    def rate(now: str, before: str) -> Column:
        return F.coalesce(F.try_divide(F.col(now) - F.col(before), F.col("dt_hours")), F.lit(0.0))

    c = c.withColumn("Delta_Temp_C_per_h", rate("ModuleTemp_C", "prev.temp")).withColumn(
        "Delta_Hum_g_m3_per_h", rate("AbsoluteHumidity_g_m3", "prev.hum")
    )
    light = F.col("POA_Irradiance_W_m2") * F.col("dt_hours")
    damp = F.col("AbsoluteHumidity_g_m3") * F.col("dt_hours")
    c = ordered_scan(c, ["cell_name"], [ts], "time_chunk", sums={"cum_light": light, "cum_damp": damp}, store=True)
    # A missing reading has no dose of its own; the sum goes on after it.
    return (
        c.withColumn("Cum_Light_Dose_Wh_m2", F.when(light.isNotNull(), F.col("cum_light")))
        .withColumn("Cum_Humidity_Exposure", F.when(damp.isNotNull(), F.col("cum_damp")))
        .drop("cum_light", "cum_damp", "prev", "time_chunk")
    )


def device_births(curves: DataFrame, ts: str = "Timestamp") -> DataFrame:
    return curves.groupBy("cell_name").agg(F.min(ts).alias("birth"))


def from_birth(telemetry: DataFrame, births: DataFrame, ts: str = "Timestamp") -> DataFrame:
    """Telemetry from each device's first curve on (one birth row per device)."""
    return telemetry.join(births, "cell_name").where(F.col(ts) >= F.col("birth")).drop("birth")


def attach_quality(curves: DataFrame, audit: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Left join of per-curve quality scores; hysteresis is clipped to [0, 5]."""
    from helioframe.functions.expr import clip

    q = audit.select("cell_name", "curve", *columns)
    if "hysteresis_index" in columns:
        q = q.withColumn("hysteresis_index", clip("hysteresis_index", 0.0, 5.0))
    return curves.join(q, ["cell_name", "curve"], "left")


def curve_collapse(labeled: DataFrame, columns: Sequence[str] = ("pFF", "Voc", "Jsc", "FF")) -> DataFrame:
    """Points to one row per labelled curve; per-curve constants are taken by ``max``."""
    return (
        labeled.where(F.col("label_curve") != -1)
        .groupBy("cell_name", "cell_id", "curve", "label_curve")
        .agg(F.min("Timestamp").alias("Timestamp"), *[F.max(c).alias(c) for c in columns])
    )


def merged_matrix(curves: DataFrame, telemetry10: DataFrame) -> DataFrame:
    """Curve rows with the latest telemetry, rates, doses and cyclic time."""
    tele = from_birth(telemetry10.withColumnRenamed("bucket", "Timestamp"), device_births(curves))
    tele = with_rates_and_doses(tele).withColumnRenamed("Timestamp", "bucket_ts")
    cols = [
        "POA_Irradiance_W_m2", "AbsoluteHumidity_g_m3", "ModuleTemp_C", "PCE", "Delta_Temp_C_per_h",
        "Delta_Hum_g_m3_per_h", "Cum_Light_Dose_Wh_m2", "Cum_Humidity_Exposure",
    ]
    tele = tele.withColumn("tie", F.lit(0))
    out = asof_backward(curves, tele, ["cell_name"], "Timestamp", "bucket_ts", cols, "tie", GAP_S)
    for name, e in cyclic_time("Timestamp").items():
        out = out.withColumn(name, e)
    return out


def with_exposure(df: DataFrame, ts: str = "Timestamp") -> DataFrame:
    """Days since the device's first row (before any daylight filter)."""
    start = df.groupBy("cell_name").agg(F.min(ts).alias("day_zero"))
    return (
        df.join(start, "cell_name")
        .withColumn("Exposure_Days", days_between(F.col(ts), F.col("day_zero")))
        .drop("day_zero")
    )


def daylight(df: DataFrame, minimum: float = SETTINGS.daylight_min) -> DataFrame:
    return df.where(F.col("POA_Irradiance_W_m2") > minimum)


def rows_back(n: int) -> W:
    """Window over the last ``n`` daily rows of a device (one row per device-day)."""
    return W.partitionBy("cell_name").orderBy("Date_Day").rowsBetween(1 - n, 0)


def rolling_median(c: str, n: int) -> Column:
    return F.percentile(F.col(c), 0.5).over(rows_back(n))


def rolling_mean(c: str, n: int = SETTINGS.rolling_window) -> Column:
    return F.avg(c).over(rows_back(n))


def _daily(df: DataFrame, aggs: list[Column]) -> DataFrame:
    """Daily aggregates joined with the exact daily median of humidity."""
    d = df.withColumn("Date_Day", F.to_date("Timestamp"))
    keys = ["cell_name", "Date_Day"]
    med = exact_quantiles(d, keys, "AbsoluteHumidity_g_m3", {"Daily_Median_Humidity": 0.5}).drop("n")
    return d.groupBy(*keys).agg(*aggs).join(med, keys, "left")


def daily_rul_matrix(twin: DataFrame, window: int = 2) -> DataFrame:
    """Daily dose, load, damage and increments; ``PCE_initial`` is per device.

    The dose is the sum over curve rows (a feature, not an energy).
    """
    d = _daily(
        twin,
        [
            F.sum("POA_Irradiance_W_m2").alias("Daily_Irradiance_Dose"),
            F.max("ModuleTemp_C").alias("Daily_Max_Temp_C"),
            F.max("PCE").alias("Daily_PCE"),
            F.max("Exposure_Days").alias("Exposure_Days"),
            F.max("PCE_initial").alias("PCE_Initial"),
        ],
    )
    return damage_features(d, window)


def damage_features(d: DataFrame, window: int) -> DataFrame:
    """Rolling damage, its lag and increment, rolling dose and load; NULL rows dropped."""
    day = W.partitionBy("cell_name").orderBy("Date_Day")
    d = d.withColumn("Instant_Loss", 1.0 - F.col("Daily_PCE") / F.nullif("PCE_Initial", F.lit(0.0)))
    d = d.withColumn("Cumulative_Damage", rolling_median("Instant_Loss", window))
    d = d.withColumn("Cumulative_Damage_Lag1", F.coalesce(F.lag("Cumulative_Damage").over(day), F.lit(0.0)))
    d = d.withColumn("Daily_Damage_Increment", F.col("Cumulative_Damage") - F.col("Cumulative_Damage_Lag1"))
    d = d.withColumn("Rolling_Irradiance", rolling_median("Daily_Irradiance_Dose", window))
    d = d.withColumn("Rolling_Thermal_load", rolling_median("Daily_Max_Temp_C", window))
    return d.dropna(
        subset=[
            "Daily_Irradiance_Dose", "Daily_Max_Temp_C", "Daily_Median_Humidity", "Rolling_Irradiance",
            "Rolling_Thermal_load", "Cumulative_Damage_Lag1", "Daily_Damage_Increment",
        ]
    )


def daily_trajectory(curves: DataFrame) -> DataFrame:
    return _daily(
        curves,
        [
            F.sum("POA_Irradiance_W_m2").alias("Daily_Irradiance_Dose"),
            F.max("ModuleTemp_C").alias("Daily_Max_Temp_C"),
            F.max("Exposure_Days").alias("Exposure_Days"),
            *[F.avg(p).alias(p) for p in ("PCE", "FF", "Jsc", "Voc")],
        ],
    )


def normalised_state(daily: DataFrame, parameters: Sequence[str], window: int = SETTINGS.rolling_window) -> DataFrame:
    """Parameters over their first-three-day mean, smoothed, with lag and change."""
    day = W.partitionBy("cell_name").orderBy("Date_Day")
    d = daily.withColumn("day_no", F.row_number().over(day))
    d = d.withColumn("Rolling_Irradiance", rolling_median("Daily_Irradiance_Dose", window))
    d = d.withColumn("Rolling_Thermal_load", rolling_median("Daily_Max_Temp_C", window))
    need = ["Daily_Median_Humidity", "Rolling_Irradiance", "Rolling_Thermal_load"]
    for p in parameters:
        first = F.avg(F.when(F.col("day_no") <= 3, F.col(p))).over(W.partitionBy("cell_name"))
        d = d.withColumn(f"{p}_Init", first)
        d = d.withColumn(f"{p}_Norm", F.col(p) / (F.col(f"{p}_Init") + 1e-9))
        d = d.withColumn(f"{p}_State", rolling_mean(f"{p}_Norm", window))
        d = d.withColumn(f"{p}_Lag1", F.lag(f"{p}_State").over(day))
        d = d.withColumn(f"{p}_Delta", F.col(f"{p}_State") - F.col(f"{p}_Lag1"))
        need += [f"{p}_State", f"{p}_Lag1", f"{p}_Delta"]
    return d.dropna(subset=need).drop("day_no")


def daily_forensics(twin: DataFrame) -> DataFrame:
    """Fourteen daily aggregates for failure forensics, with damage and increment."""
    day = W.partitionBy("cell_name").orderBy("Date_Day")
    d = _daily(
        twin,
        [
            F.count("*").alias("n_curves"),
            F.sum("POA_Irradiance_W_m2").alias("Daily_Irradiance_Dose"),
            F.max("ModuleTemp_C").alias("Daily_Max_Temp_C"),
            F.avg("ModuleTemp_C").alias("Daily_Mean_Temp_C"),
            F.min("ModuleTemp_C").alias("Daily_Min_Temp_C"),
            F.stddev_samp("ModuleTemp_C").alias("Daily_Std_Temp_C"),
            F.max("PCE").alias("PCE"),
            F.stddev_samp("PCE").alias("PCE_Std"),
            F.avg("FF").alias("FF"),
            F.avg("Jsc").alias("Jsc"),
            F.avg("Voc").alias("Voc"),
            F.avg("pFF").alias("pFF"),
            F.max("Exposure_Days").alias("Exposure_Days"),
            F.max("PCE_initial").alias("PCE_Initial"),
        ],
    )
    d = d.withColumn("Cumulative_Damage", 1.0 - F.col("PCE") / F.nullif("PCE_Initial", F.lit(0.0)))
    return d.withColumn(
        "Daily_Damage_Increment",
        F.col("Cumulative_Damage") - F.coalesce(F.lag("Cumulative_Damage").over(day), F.lit(0.0)),
    )


def relative_columns(df: DataFrame) -> DataFrame:
    """``PCE`` and ``pFF`` relative to the device's initial level."""
    return df.withColumn("PCE_Relative", relative_to_initial("PCE", "PCE_initial")).withColumn(
        "pFF_Relative", relative_to_initial("pFF", "pFF_initial")
    )
