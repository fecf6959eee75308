"""Deterministic solar views over the generic test tables (see FIXTURES.md).

Every view is a narrow projection of ``events`` or ``embeddings``: no window and
no shuffle, so it scales with the scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe.functions.expr import absolute_humidity, pce_from_power
from helioframe.functions.stages import spread

#: Events whose sweeps one task makes at most, about.
EVENTS_A_TASK = 10_000
EPOCH_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _age() -> F.Column:
    return (F.unix_micros("Timestamp") - EPOCH_US) / F.lit(86_400_000_000.0)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: irradiance, temperatures, humidity and power."""
    return telemetry_columns(table(spark, sf_dir, "events"))


def telemetry_columns(e: DataFrame) -> DataFrame:
    """The telemetry projection of an event table or stream."""
    cell = F.pmod("user_id", F.lit(8))
    k = F.get_json_object("props", "$.k").cast("double")
    decay = 1.0 - F.col("age") * (1 + F.col("cell_id")) / 300.0
    return (
        e.select(
            "event_id",
            cell.alias("cell_id"),
            F.concat(F.lit("C"), cell.cast("string")).alias("cell_name"),
            F.col("ts").cast("timestamp").alias("Timestamp"),
            (F.col("value") * 10.0).alias("POA_Irradiance_W_m2"),
            (10.0 + 0.5 * k).alias("ModuleTemp_C"),
            (5.0 + 0.4 * k).alias("AmbientTemp_C"),
            (20.0 + F.pmod("event_id", F.lit(80))).alias("RelativeHumidity_pct"),
        )
        .withColumn("age", _age())
        .withColumn(
            "Power_W",
            F.col("POA_Irradiance_W_m2") * 6.4e-5 * 0.01 * (18.0 - 0.02 * F.pmod("event_id", F.lit(50))) * decay,
        )
    )


def curve_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event standing for a measured curve with aligned telemetry."""
    eid, cell, age = F.col("event_id"), F.col("cell_id"), F.col("age")

    def fade(span: float) -> F.Column:
        return 1.0 - age * (1 + cell) / span

    def m(n: int) -> F.Column:
        return F.pmod(eid, F.lit(n))

    return telemetry(spark, sf_dir).select(
        "event_id",
        "cell_id",
        "cell_name",
        eid.alias("curve"),
        (m(9) - 1).alias("label_curve"),
        "Timestamp",
        "POA_Irradiance_W_m2",
        "ModuleTemp_C",
        absolute_humidity("AmbientTemp_C", "RelativeHumidity_pct").alias("AbsoluteHumidity_g_m3"),
        pce_from_power("Power_W", "POA_Irradiance_W_m2").alias("PCE"),
        ((0.95 + 0.001 * m(40)) * fade(1500.0)).alias("Voc"),
        (F.col("POA_Irradiance_W_m2") * 0.02 * fade(900.0)).alias("Jsc"),
        ((0.62 - 0.002 * m(20)) * fade(500.0)).alias("FF"),
        F.when(m(67) == 0, F.lit(None).cast("double"))
        .when(m(41) == 0, F.lit(0.75))
        .otherwise((0.66 - 0.003 * m(30)) * fade(350.0))
        .alias("pFF"),
        m(4).alias("spike_count"),
        (m(13) * 0.5).alias("hysteresis_index"),
    )


def sweep_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty sweep points per event: a reverse scan, then a forward scan."""
    e = spread(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), EVENTS_A_TASK)
    eid, i = F.col("event_id"), F.col("pt")
    cell = F.pmod("user_id", F.lit(8))

    def hit(n: int) -> F.Column:
        return F.pmod(eid, F.lit(n)) == 0

    base = e.select(
        "event_id",
        cell.alias("cell_id"),
        F.concat(F.lit("C"), cell.cast("string")).alias("cell_name"),
        (0.0128 * F.least(F.col("value"), F.lit(100.0)) / 50.0 * F.when(hit(53), 0.01).otherwise(1.0)).alias("isc"),
        (0.9 + 0.001 * F.pmod(eid, F.lit(100))).alias("voc_s"),
        (2.0 + 0.5 * F.pmod(cell, F.lit(2))).alias("m"),
        F.explode(F.sequence(F.lit(0), F.lit(39))).alias("pt"),
    )
    down = F.when(i < 20, i).otherwise(39 - i)
    top = 1.01 * F.col("voc_s")
    v0 = base.withColumn("v0", top - (top + 0.05) * down / 19.0)
    v = F.col("v0")
    shape = 1.0 - F.pow(F.greatest(v, F.lit(0.0)) / F.col("voc_s"), F.col("m"))
    return v0.select(
        "event_id",
        "cell_id",
        "cell_name",
        "pt",
        F.timestamp_micros(F.lit(EPOCH_US) + (eid * 240 + i * 5) * 1_000_000).alias("Timestamp"),
        F.when(i < 20, "Reverse").otherwise("Forward").alias("ScanDirection"),
        (v * F.when(hit(43), 0.4).when(hit(47), 0.04).otherwise(1.0)).alias("Voltage_V"),
        (
            F.col("isc")
            * F.when(i < 20, 1.0).otherwise(0.97)
            * shape
            * F.when(hit(37) & (i % 9 == 4), 1.6).otherwise(1.0)
            * F.when(hit(43), -1.0).when(hit(59), 1e-6).otherwise(1.0)
        ).alias("Current_A"),
    )


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding vectors as stand-ins for normalised curve shapes."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("shape")
    )
