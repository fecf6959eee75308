"""Fleet maps of many devices."""

import datetime

import pytest
from pyspark.sql import functions as F

from helioframe.operators import dashboards as B


def test_two_thousand_devices(spark):
    t0 = datetime.datetime(2024, 1, 1, 10)
    rows = spark.range(0, 6000).select(
        F.timestamp_micros(F.lit(int(t0.timestamp() * 1e6)) + F.floor(F.col("id") / 2000) * 600_000_000).alias("bucket"),
        F.concat(F.lit("dev-"), (F.col("id") % 2000).cast("string")).alias("cell_name"), (F.col("id") % 2000 / 10.0).alias("PCE"),
    )
    rows = rows.unionByName(rows.limit(5)).unionByName(rows.limit(1).withColumn("cell_name", F.lit(None).cast("string")))
    wide = B.fleet_map(rows)
    assert [len(r["fleet"]) for r in wide.collect()] == [2000] * 3
    assert B.fleet_long(wide).exceptAll(rows.where("cell_name IS NOT NULL").distinct()).isEmpty()
    lit = wide.withColumn("POA_Irradiance_W_m2", F.when(F.minute("bucket") == 0, 50.0).otherwise(500.0))
    assert B.plausible_fleet(lit).count() == 2 * 1001
    r = B.fleet_mean_efficiency(lit).first()
    assert r["n"] == 2 * 1000 and r["mean_efficiency"] == pytest.approx(sum(range(1, 1001)) / 1000 / 1000)


def test_null_readings_and_no_rows(spark):
    none = spark.createDataFrame([], "bucket timestamp, cell_name string, PCE double, POA_Irradiance_W_m2 double")
    assert B.fleet_map(none).isEmpty()
    one = spark.createDataFrame([(datetime.datetime(2024, 1, 1), "a", None, 500.0)], none.schema)
    wide = B.fleet_map(one)
    assert wide.first()["fleet"] == {"a": None}
    assert B.plausible_fleet(wide.withColumn("POA_Irradiance_W_m2", F.lit(500.0))).isEmpty()
