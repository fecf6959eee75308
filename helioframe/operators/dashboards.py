"""Parameterised report queries over the long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from helioframe.config import SETTINGS
from helioframe.functions.expr import left_closed_bucket

# Band resolutions in seconds; multi-day ones start on the first day.
RESOLUTIONS = {"1h": 3600, "6h": 21600, "1D": 86400, "3D": 259200, "7D": 604800, "30D": 2592000}
BUCKET_HOURS = SETTINGS.bucket_seconds / 3600.0


def multi_resolution_bands(df: DataFrame, value: str, ts: str = "bucket") -> DataFrame:
    """Mean, minimum and maximum per device for every resolution.

    Rows are reduced to hours once; coarser bands are built from the hourly
    sums, so the input is shuffled once.
    """
    hourly = df.groupBy("cell_name", left_closed_bucket(ts, 3600).alias("hour")).agg(
        F.sum(value).alias("s"), F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")
    )
    start = df.agg(F.date_trunc("day", F.min(ts)).alias("origin"))
    h = hourly.crossJoin(F.broadcast(start))  # one-row origin
    us, o = F.unix_micros("hour"), F.unix_micros("origin")
    bands = []
    for name, sec in RESOLUTIONS.items():
        w = sec * 1_000_000
        base = o if sec > 86400 else F.lit(0)
        bands.append(F.struct(F.lit(name).alias("resolution"), F.timestamp_micros(us - F.pmod(us - base, F.lit(w))).alias("start")))
    e = h.select("cell_name", "s", "n", "lo", "hi", F.explode(F.array(*bands)).alias("b")).select("*", "b.*")
    return e.groupBy("cell_name", "resolution", "start").agg(
        (F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("central"), F.min("lo").alias("band_low"), F.max("hi").alias("band_high")
    ).where(F.col("central").isNotNull())


def median_bands(df: DataFrame, value: str, resolution: str = "1D", ts: str = "bucket") -> DataFrame:
    """Median variant of the bands for one resolution."""
    from helioframe.functions.ordered import exact_quantiles

    d = df.withColumn("start", left_closed_bucket(ts, RESOLUTIONS[resolution]))
    return exact_quantiles(d, ["cell_name", "start"], value, {"central": 0.5})


def dose_and_yield(b10: DataFrame, seconds: int = 86400) -> DataFrame:
    """Energy, radiation, heat and humidity doses per device and period, with efficiency."""
    h = F.lit(BUCKET_HOURS)
    g = b10.groupBy("cell_name", left_closed_bucket("bucket", seconds).alias("start")).agg(
        (F.sum("Power_W") * h).alias("yield_wh"),
        (F.sum("POA_Irradiance_W_m2") * h / 1000.0).alias("radiation_kwh_m2"),
        (F.sum("ModuleTemp_C") * h).alias("thermal_dose"),
        (F.sum("AbsoluteHumidity_g_m3") * h).alias("humidity_dose"),
    )
    eff = 100.0 * (F.col("yield_wh") / 1000.0 / SETTINGS.cell_area_m2) / F.col("radiation_kwh_m2")
    ok = F.col("radiation_kwh_m2") > 0.005
    return g.withColumn("efficiency", F.when(ok, eff)).withColumn(
        "efficiency", F.when(F.col("efficiency").between(0.0, 100.0), F.col("efficiency"))
    )


def fleet_pivot(b10: DataFrame, cells: Sequence[str], value: str = "PCE") -> DataFrame:
    return b10.groupBy("bucket").pivot("cell_name", list(cells)).agg(F.avg(value))


def fleet_map(b10: DataFrame, value: str = "PCE") -> DataFrame:
    """One row a bucket with ``fleet``, a map of device to mean value, for any list of devices.

    A map holds one entry a device.  Rows without a device or bucket are left out; a
    device whose readings in a bucket are all null has a null entry.
    """
    per = b10.where(F.col("cell_name").isNotNull() & F.col("bucket").isNotNull()).groupBy("bucket", "cell_name").agg(F.avg(value).alias("v"))
    return per.groupBy("bucket").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cell_name", "v")))).alias("fleet"))


def fleet_long(wide: DataFrame, value: str = "PCE") -> DataFrame:
    """Rows of a fleet map again: its other columns, ``cell_name`` and the value."""
    rest = [c for c in wide.columns if c != "fleet"]
    return wide.select(*rest, F.explode("fleet").alias("cell_name", value))


def plausible_fleet(wide: DataFrame, value: str = "PCE") -> DataFrame:
    """Daylight rows of a fleet map with readings from 0 to 100."""
    day = wide.where(F.col("POA_Irradiance_W_m2") > SETTINGS.daylight_min)
    return fleet_long(day, value).where(F.col(value).between(0.0, 100.0)).select("bucket", "cell_name", value)


def fleet_mean_efficiency(wide: DataFrame) -> DataFrame:
    """Mean over the readings of a fleet map with a ratio in (0, 1], daylight only."""
    ratio = fleet_long(wide.where(F.col("POA_Irradiance_W_m2") > SETTINGS.daylight_min)).select((F.col("PCE") / 100.0).alias("ratio"))
    return ratio.where((F.col("ratio") > 0) & (F.col("ratio") <= 1)).agg(F.avg("ratio").alias("mean_efficiency"), F.count("*").alias("n"))


def kpi_current_vs_previous(b10: DataFrame, days: int = 7) -> DataFrame:
    """Means and dose in the last days and in the same span before, per device, in one pass."""
    last = b10.agg(F.max("bucket").alias("stop"))
    b = b10.crossJoin(F.broadcast(last))  # one-row end time
    age = (F.unix_micros("stop") - F.unix_micros("bucket")) / F.lit(86_400_000_000.0)
    now, before = age < days, (age >= days) & (age < 2 * days)
    aggs: list[Column] = []
    for name, c in (("pce", "PCE"), ("temp", "ModuleTemp_C")):
        aggs += [F.avg(F.when(now, F.col(c))).alias(f"{name}_now"), F.avg(F.when(before, F.col(c))).alias(f"{name}_before")]
    dose = F.col("POA_Irradiance_W_m2") * BUCKET_HOURS
    aggs += [F.sum(F.when(now, dose)).alias("dose_now"), F.sum(F.when(before, dose)).alias("dose_before")]
    g = b.groupBy("cell_name").agg(*aggs)
    for name in ("pce", "temp", "dose"):
        g = g.withColumn(
            f"{name}_delta_pct", 100.0 * (F.col(f"{name}_now") - F.col(f"{name}_before")) / F.nullif(F.col(f"{name}_before"), F.lit(0.0))
        )
    return g


def operation_days(rows: DataFrame, t80: DataFrame, cap: float = SETTINGS.burn_in_days) -> DataFrame:
    """Days from the first row to the failure or the last row, capped; more than the cap means mature."""
    r = rows.groupBy("cell_name").agg(F.min("Timestamp").alias("t0"), F.max("Timestamp").alias("t1"))
    j = r.join(t80.select("cell_name", "combined_failure_date"), "cell_name", "left")
    end = F.least("combined_failure_date", "t1")
    days = (F.unix_micros(end) - F.unix_micros("t0")) / F.lit(86_400_000_000.0)
    return j.withColumn("operation_days", F.least(days, F.lit(cap))).withColumn("is_mature", days > cap)


def device_first_seen(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy("cell_name").agg(F.min(F.when(F.col(value).isNotNull(), F.col("Timestamp"))).alias("first_seen"))


def device_kpis(alerted: DataFrame) -> DataFrame:
    at = F.struct("Timestamp", "curve")
    return alerted.groupBy("cell_name").agg(
        F.max_by("PCE_Relative", at).alias("latest_relative_pce"), F.bool_or("Digital_Twin_Alert").alias("any_alert")
    )


def t80_reference_lines(t80: DataFrame, until: Column) -> DataFrame:
    """Threshold level of each metric and the failure date if it falls inside the window."""
    rows = F.array(
        F.struct(F.lit("PCE").alias("metric"), F.lit(SETTINGS.t80_fraction).alias("level"), F.col("t80_failure_date_pce").alias("d")),
        F.struct(
            F.lit("pFF").alias("metric"), (F.col("pFF_initial") * SETTINGS.t80_fraction).alias("level"), F.col("t80_failure_date_pff").alias("d")
        ),
    )
    r = t80.select("cell_name", F.explode(rows).alias("r")).select("cell_name", "r.*")
    return r.withColumn("failure_date", F.when(F.col("d") <= until, F.col("d"))).drop("d")


def status_category(summary: DataFrame) -> DataFrame:
    s = F.col("Diagnostic_Status")
    cat = F.when(s.contains("T80"), "T80").when(s.contains("ML"), "ML").otherwise("Healthy")
    return summary.groupBy(cat.alias("category")).agg(F.count("*").alias("n_devices"))


def status_component_filter(summary: DataFrame) -> DataFrame:
    """Only the T80 parts of a status; nothing left reads as Healthy."""
    kept = F.filter(F.split("Diagnostic_Status", r" \+ "), lambda x: x.contains("T80"))
    text = F.array_join(kept, " + ")
    return summary.withColumn("t80_status", F.when(text == "", "Healthy").otherwise(text))


def null_future_events(t80: DataFrame, until: Column, max_days: float) -> DataFrame:
    """Blank failure day and date when they lie beyond the window or the day cap."""
    late = (F.col("combined_failure_date") > until) | (F.col("combined_survival_days") > max_days)
    ok = F.coalesce(~late, F.lit(False)) & F.col("combined_failure_date").isNotNull()
    return t80.withColumn("event_date", F.when(ok, F.col("combined_failure_date"))).withColumn(
        "event_day", F.when(ok, F.col("combined_survival_days"))
    )


def device_timeline(events: DataFrame, max_days: float) -> DataFrame:
    """START, ML and T80 events per device in order of day."""
    rows = F.array(
        F.struct(F.lit("START").alias("event"), F.lit(0.0).alias("day")),
        F.struct(F.lit("ML").alias("event"), F.col("threshold_pct_day").alias("day")),
        F.struct(F.lit("T80").alias("event"), F.col("combined_survival_days").alias("day")),
    )
    e = events.select("cell_name", F.explode(rows).alias("e")).select("cell_name", "e.*").where(F.col("day") <= max_days)
    return e.withColumn("seq", F.row_number().over(W.partitionBy("cell_name").orderBy("day", "event")))


def normalise_by_first_week(daily: DataFrame, value: str, calendar: bool = False) -> DataFrame:
    """Value over its maximum in the first seven observed (or calendar) days."""
    w = W.partitionBy("cell_name")
    d = daily.withColumn("day_no", F.row_number().over(w.orderBy("Date_Day")))
    d = d.withColumn("first_day", F.min("Date_Day").over(w))
    early = F.col("Date_Day") < F.date_add("first_day", 7) if calendar else F.col("day_no") <= 7
    ref = F.max(F.when(early, F.col(value))).over(w)
    return d.withColumn("normalised", F.col(value) / F.nullif(ref, F.lit(0.0))).drop("day_no", "first_day")
