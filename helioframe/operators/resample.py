"""Right-closed resampling, fleet statistics and efficiency per bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.config import SETTINGS
from helioframe.functions.expr import pce_from_power, right_closed_bucket


def resample_right_closed(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("cell_name",), seconds: int = SETTINGS.bucket_seconds
) -> DataFrame:
    """Mean per bin ``(t - width, t]`` labelled ``t``; bins without any value are dropped."""
    out = (
        df.withColumn("bucket", right_closed_bucket("Timestamp", seconds))
        .groupBy(*keys, "bucket")
        .agg(*[F.avg(c).alias(c) for c in columns])
    )
    return out.where(F.coalesce(*columns).isNotNull())


def outer_join_buckets(meteo: DataFrame, mpp: DataFrame, keys: Sequence[str] = ("cell_name", "bucket")) -> DataFrame:
    """Full outer join of two bucketed streams; one-sided buckets survive."""
    return meteo.join(mpp, list(keys), "full_outer")


def with_pce(df: DataFrame) -> DataFrame:
    return df.withColumn("PCE", pce_from_power("Power_W", "POA_Irradiance_W_m2"))


def telemetry_10min(telemetry: DataFrame) -> DataFrame:
    """Canonical long fleet table: one row per device and bucket."""
    cols = ["POA_Irradiance_W_m2", "AbsoluteHumidity_g_m3", "ModuleTemp_C", "Power_W"]
    return with_pce(resample_right_closed(telemetry, cols))


def fleet_temperature_stats(bucketed: DataFrame) -> DataFrame:
    """Spread of the devices' bucket means (one value per device and bucket)."""
    t = F.col("ModuleTemp_C")
    return bucketed.groupBy("bucket").agg(
        F.avg(t).alias("ModuleTemp_Mean_C"),
        F.percentile(t, 0.5).alias("ModuleTemp_Median_C"),
        F.min(t).alias("ModuleTemp_Min_C"),
        F.max(t).alias("ModuleTemp_Max_C"),
    )


def fleet_environment_mean(telemetry: DataFrame, seconds: int = SETTINGS.bucket_seconds) -> DataFrame:
    """Row-weighted environment mean over all devices; buckets without irradiance are dropped."""
    env = resample_right_closed(telemetry, ["POA_Irradiance_W_m2", "AbsoluteHumidity_g_m3"], keys=(), seconds=seconds)
    return env.where(F.col("POA_Irradiance_W_m2").isNotNull())


def gap_count(bucketed: DataFrame) -> DataFrame:
    """Daylight buckets without power, per device."""
    gap = (F.col("POA_Irradiance_W_m2") > SETTINGS.daylight_min) & F.col("Power_W").isNull()
    return bucketed.groupBy("cell_name").agg(F.count_if(gap).alias("n_gaps"), F.count("*").alias("n_buckets"))


def device_columns_to_long(wide: DataFrame, prefix: str = "PCE_") -> DataFrame:
    """Wide ``PCE_<device>`` columns to rows; daylight rows with plausible values only."""
    cols = [c for c in wide.columns if c.startswith(prefix)]
    long = wide.unpivot(["bucket", "POA_Irradiance_W_m2"], cols, "device_column", "PCE")
    return (
        long.where((F.col("POA_Irradiance_W_m2") > SETTINGS.daylight_min) & F.col("PCE").between(0.0, 100.0))
        .withColumn("cell_name", F.regexp_replace("device_column", f"^{prefix}", ""))
        .select("bucket", "cell_name", "PCE")
    )


def power_column_pick(columns: Sequence[str], device: str = "") -> str | None:
    """First column named like a power reading (and like the device, if given)."""
    for c in columns:
        low = c.lower()
        if ("power" in low or "p_mpp" in low) and device.lower() in low:
            return c
    return None
