"""Sources, sinks and the streaming job."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from helioframe.config import Coefficients
from helioframe.functions.stages import shared_folder
from helioframe.plans.registry import query
from helioframe.plans.telemetry_queries import tel
from helioframe.sources import files, fixtures
from helioframe.streaming import resample as R


def scratch(spark, name: str) -> str:
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def sweeps_csv(spark, sf) -> str:
    """Sweep points written as CSV (compressed), one folder per device, with some damaged fields."""
    root = scratch(spark, "csv")
    p = fixtures.sweep_points(spark, sf)
    bad_time, bad_value = F.col("event_id") % 97 == 0, F.col("event_id") % 89 == 0
    out = p.select(
        "cell_name",
        F.when(bad_time, "not a time").otherwise(F.date_format("Timestamp", "yyyy-MM-dd HH:mm:ss")).alias("Timestamp"),
        F.when(bad_value, "n/a").otherwise(F.col("Voltage_V").cast("string")).alias("Voltage_V"),
        F.col("Current_A").cast("string").alias("Current_A"),
        "ScanDirection",
    )
    # Even devices: the usual columns.  Odd devices: another order and one more column.
    odd = F.col("cell_name").rlike("[13579]$")
    out.where(~odd).write.option("header", True).option("compression", "gzip").partitionBy("cell_name").csv(f"{root}/a")
    turned = ["ScanDirection", "Note", "Current_A", "Voltage_V", "Timestamp"]
    more = out.where(odd).withColumn("Note", F.lit("x,y")).select(*turned, "cell_name")
    more.write.option("header", True).option("compression", "gzip").partitionBy("cell_name").csv(f"{root}/b")
    return root


def scanned(spark, sf):
    return files.device_csv_scan(spark, sweeps_csv(spark, sf), "jv", "*/*/*.csv.gz", r"cell_name=([^/]+)/")


@query(
    "s01_device_csv_scan",
    "cell_name ScanDirection n:i n_times:i v_sum:g i_sum:f",
    """SELECT cell_name, ScanDirection, count(*) AS n, count(*) FILTER (event_id % 97 <> 0) AS n_times,
  sum(Voltage_V) FILTER (event_id % 89 <> 0) AS v_sum, sum(Current_A) AS i_sum FROM v_pts GROUP BY 1, 2""",
)
def _(spark, sf):
    return scanned(spark, sf).groupBy("cell_name", "ScanDirection").agg(
        F.count("*").alias("n"),
        F.count(F.try_to_timestamp("Timestamp")).alias("n_times"),
        F.sum(F.col("Voltage_V").try_cast("double")).alias("v_sum"),
        F.sum(F.col("Current_A").try_cast("double")).alias("i_sum"),
    )


@query(
    "s02_parse_and_require",
    "cell_name ScanDirection n:i v_mean:f t_max:t",
    """SELECT cell_name, ScanDirection, count(*) AS n, avg(Voltage_V) AS v_mean, max("Timestamp") AS t_max FROM v_pts
WHERE event_id % 97 <> 0 AND event_id % 89 <> 0 GROUP BY 1, 2""",
)
def _(spark, sf):
    raw = scanned(spark, sf)
    ok = files.parse_and_require(raw, files.REQUIRED["jv"], ["Voltage_V", "Current_A"])
    return ok.groupBy("cell_name", "ScanDirection").agg(
        F.count("*").alias("n"), F.avg("Voltage_V").alias("v_mean"), F.max("Timestamp").alias("t_max")
    )


@query(
    "s03_time_sorted_sink",
    "cell_name n:i t_min:t t_max:t n_unsorted:i",
    'SELECT cell_name, count(*) AS n, min("Timestamp") AS t_min, max("Timestamp") AS t_max, 0 AS n_unsorted FROM v_tel GROUP BY 1',
)
def _(spark, sf):
    path = scratch(spark, "sorted")
    files.time_sorted_sink(tel(spark, sf).select("cell_name", "Timestamp", "POA_Irradiance_W_m2"), path)
    back = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    before = F.lag("Timestamp").over(Window.partitionBy("cell_name", "file").orderBy("row"))
    return back.withColumn("before", before).groupBy("cell_name").agg(
        F.count("*").alias("n"),
        F.min("Timestamp").alias("t_min"),
        F.max("Timestamp").alias("t_max"),
        F.count_if(F.col("before") > F.col("Timestamp")).alias("n_unsorted"),
    )


@query(
    "s06_report_csv",
    "cell_name n:i mean_pce:f",
    "SELECT cell_name, count(*) AS n, avg(PCE) AS mean_pce FROM v_rows GROUP BY 1",
)
def _(spark, sf):
    path = scratch(spark, "report")
    g = fixtures.curve_rows(spark, sf).groupBy("cell_name").agg(F.count("*").alias("n"), F.avg("PCE").alias("mean_pce"))
    files.report_csv(g, path)
    return spark.read.option("header", True).csv(path)


@query(
    "s07_weather_hourly_explode",
    "batch:i time:t temperature_2m:f relative_humidity_2m:f shortwave_radiation:f",
    """SELECT event_id // 24 AS batch, date_trunc('second', "Timestamp") AS time, AmbientTemp_C AS temperature_2m,
  RelativeHumidity_pct AS relative_humidity_2m, POA_Irradiance_W_m2 AS shortwave_radiation FROM v_tel""",
)
def _(spark, sf):
    # Payloads of 24 readings each, as a weather service returns them.
    t = tel(spark, sf).withColumn("batch", F.floor(F.col("event_id") / 24.0))
    item = F.struct("event_id", F.date_format("Timestamp", "yyyy-MM-dd HH:mm:ss").alias("t"), "AmbientTemp_C", "RelativeHumidity_pct", "POA_Irradiance_W_m2")
    g = t.groupBy("batch").agg(F.array_sort(F.collect_list(item)).alias("a"))
    hourly = F.struct(
        F.transform("a", lambda x: x["t"]).alias("time"),
        F.transform("a", lambda x: x["AmbientTemp_C"]).alias("temperature_2m"),
        F.transform("a", lambda x: x["RelativeHumidity_pct"]).alias("relative_humidity_2m"),
        F.transform("a", lambda x: x["POA_Irradiance_W_m2"]).alias("shortwave_radiation"),
    )
    payload = g.select("batch", F.to_json(F.struct(hourly.alias("hourly"))).alias("payload"))
    return files.weather_hourly_explode(payload)


DEF = vars(Coefficients())


@query(
    "s08_coefficients_table",
    "event_id:i " + " ".join(f"{k}:f" for k in DEF) + " is_calibrated:b",
    "SELECT event_id, "
    + ", ".join(f"CASE WHEN event_id % 3 = 0 THEN {v} ELSE value * {i + 1} END AS {k}" for i, (k, v) in enumerate(DEF.items()) if k != "t_ref")
    + f", {DEF['t_ref']} AS t_ref, event_id % 3 <> 0 AS is_calibrated FROM events",
)
def _(spark, sf):
    e = fixtures.table(spark, sf, "events")
    # Every third document lacks a required key; t_ref is always left to its default.
    names = [k for k in DEF if k != "t_ref"]
    fields = [F.when((F.lit(k) == "mu") & (F.col("event_id") % 3 == 0), F.lit(None)).otherwise(F.col("value") * (i + 1)).alias(k) for i, k in enumerate(names)]
    return files.coefficients_from_json(e.select("event_id", F.to_json(F.struct(*fields)).alias("payload")))


@query(
    "x01_streaming_resample",
    "cell_name bucket:t POA_Irradiance_W_m2:f ModuleTemp_C:f Power_W:f",
    "SELECT * FROM v_b10",
)
def _(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(os.path.join(sf, "events.parquet")).schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    stream = fixtures.telemetry_columns(raw)
    columns = ["POA_Irradiance_W_m2", "ModuleTemp_C", "Power_W"]
    done = R.run_to_parquet(R.streaming_resample(stream, columns))
    return done.unionByName(R.open_bins(done, tel(spark, sf), columns))
