"""Files in, files out, and the stream."""

import csv
import os

import pytest
from pyspark.sql import functions as F

from helioframe.operators import resample
from helioframe.plans.telemetry_queries import tel
from helioframe.sources import files, fixtures
from helioframe.streaming import resample as stream

SF = "/root/testdata/sf0.001"


def write(path, header, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)


def test_device_folders_with_optional_and_damaged_columns(spark, tmp_path):
    root = str(tmp_path)
    write(f"{root}/D1/D1_meteo.csv", ["Timestamp", "POA_Irradiance_W_m2", "ModuleTemp_C", "AmbientTemp_C", "RelativeHumidity_pct"],
          [["2024-01-01 00:00:00", 500, 30, 20, 50], ["broken", 500, 30, 20, 50], ["2024-01-01 00:10:00", "", 30, 20, 50]])
    got = files.ingest(spark, root, "meteo").collect()
    assert [(r["cell_name"], r["POA_Irradiance_W_m2"]) for r in got] == [("D1", 500.0)]
    assert 8.0 < got[0]["AbsoluteHumidity_g_m3"] < 9.0
    assert files.ingest(spark, root, "mpp").count() == 0  # missing kind: a warning, not a failure


def test_sink_is_sorted_within_each_file(spark, tmp_path):
    t = fixtures.telemetry(spark, SF).select("cell_name", "Timestamp", "Power_W")
    files.time_sorted_sink(t, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == t.count()
    one = back.inputFiles()[0]
    times = [r[0] for r in spark.read.parquet(one).select("Timestamp").collect()]
    assert times == sorted(times)


def test_pruned_scan_pushes_predicate_and_columns(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.range(10).selectExpr("id AS curve", "CAST(id % 2 AS INT) AS is_curve_valid", "id * 2 AS voc").write.parquet(path)
    df = files.pruned_scan(spark, path, ["curve"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 5 and "EqualTo(is_curve_valid,1)" in plan and "voc" not in plan


def test_stream_equals_batch_on_closed_bins(spark, tmp_path):
    cols = ["POA_Irradiance_W_m2", "ModuleTemp_C"]
    t = tel(spark, SF).select("cell_name", "Timestamp", *cols)
    t.union(t.limit(50)).repartition(1).write.parquet(str(tmp_path / "in"))  # repeated readings
    raw = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    got = stream.run_to_parquet(stream.streaming_resample(raw, cols), str(tmp_path / "out"))
    end = t.agg(F.max("Timestamp") - F.expr("INTERVAL 1 HOUR")).first()[0]
    want = resample.resample_right_closed(t, cols).where(F.col("bucket") <= F.lit(end))
    rounded = lambda df: sorted((r["cell_name"], r["bucket"], *[round(r[c], 6) for c in cols]) for r in df.collect())
    assert rounded(got) == rounded(want)
    whole = got.unionByName(stream.open_bins(got, t.union(t.limit(50)), cols))
    assert rounded(whole) == rounded(resample.resample_right_closed(t, cols))
    nothing = stream.open_bins(got.limit(0), t, cols)
    assert rounded(nothing) == rounded(resample.resample_right_closed(t, cols))


def test_files_of_different_layouts_keep_their_columns(spark, tmp_path):
    root = str(tmp_path)
    write(f"{root}/A/A_meteo.csv", ["Timestamp", "POA_Irradiance_W_m2", "ModuleTemp_C"], [["2024-01-01 00:00:00", 600, 33]])
    write(f"{root}/B/B_meteo.csv", ["ModuleTemp_C", "RelativeHumidity_pct", "Timestamp", "AmbientTemp_C", "POA_Irradiance_W_m2"], [[34, 50, "2024-01-01 00:00:00", 20, 700]])
    write(f"{root}/C/C_meteo.csv", ["Note", "Timestamp", "POA_Irradiance_W_m2", "ModuleTemp_C"], [["a,b", "2024-01-01 00:00:00", 800, 35], ["", "2024-01-01 00:10:00", 810, 36]])
    got = {(r["cell_name"], r["POA_Irradiance_W_m2"], r["ModuleTemp_C"], r["AmbientTemp_C"]) for r in files.ingest(spark, root, "meteo").collect()}
    assert got == {("A", 600.0, 33.0, None), ("B", 700.0, 34.0, 20.0), ("C", 800.0, 35.0, None), ("C", 810.0, 36.0, None)}
    write(f"{root}/D/D_meteo.csv", ["Timestamp", "ModuleTemp_C"], [["2024-01-01 00:00:00", 35]])
    with pytest.raises(ValueError, match="POA_Irradiance_W_m2"):
        files.ingest(spark, root, "meteo")
    write(f"{root}/D/D_meteo.csv", ["2024-01-01 00:00:00", "35"], [["2024-01-01 00:10:00", 36]])
    with pytest.raises(ValueError, match="no header"):
        files.ingest(spark, root, "meteo")


def test_sweeps_of_one_task_do_not_grow_with_the_events(spark, monkeypatch):
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    whole = fixtures.sweep_points(spark, SF)
    monkeypatch.setattr(fixtures, "EVENTS_A_TASK", 10)
    points = fixtures.sweep_points(spark, SF)
    sizes = [r["count"] for r in points.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * 10 * 40 and sum(sizes) == 40 * events
    assert points.exceptAll(whole).count() == 0


def test_device_files_are_written_compressed(spark, tmp_path):
    from helioframe.plans import sources_queries as Q

    kinds = "event_id long, user_id long, ts timestamp, event_type string, value double, props string"
    rows = spark.range(600).selectExpr("id", "id % 5", "timestamp_seconds(1704067200 + id)", "'a'", "20.0D + id % 60", "'{}'").toDF(*[k.split()[0] for k in kinds.split(", ")])
    rows.write.parquet(f"{tmp_path}/events.parquet")
    root = Q.sweeps_csv(spark, str(tmp_path))
    names = [f"{d}/{n}" for d, _, found in os.walk(root) for n in found if n.startswith("part-")]
    assert names and all(n.endswith(".csv.gz") for n in names)
    lines = spark.read.text(f"{root}/*/*/*.csv.gz")
    assert sum(map(os.path.getsize, names)) * 2 < lines.agg(F.sum(F.length("value") + 1)).first()[0]
    read = files.device_csv_scan(spark, root, "jv", "*/*/*.csv.gz", r"cell_name=([^/]+)/")
    assert read.count() == 600 * 40 and {r[0] for r in read.select("cell_name").distinct().collect()} == {f"C{i}" for i in range(5)}
