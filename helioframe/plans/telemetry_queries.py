"""Telemetry: projections, resampling, as-of joins, rates and doses."""

from __future__ import annotations

from pyspark.sql import functions as F

from helioframe.functions import expr as X
from helioframe.functions.ordered import exact_quantiles
from helioframe.operators import asof, dashboards, features, resample
from helioframe.plans import views  # noqa: F401
from helioframe.plans.registry import query, view
from helioframe.sources import fixtures


def tel(spark, sf):
    return fixtures.telemetry(spark, sf).withColumn(
        "AbsoluteHumidity_g_m3", X.absolute_humidity("AmbientTemp_C", "RelativeHumidity_pct")
    )


def b10(spark, sf):
    return resample.telemetry_10min(tel(spark, sf))


@query(
    "p01_absolute_humidity",
    "event_id:i AbsoluteHumidity_g_m3:f",
    "SELECT event_id, AbsoluteHumidity_g_m3 FROM v_tel",
)
def _(spark, sf):
    return tel(spark, sf)


@query(
    "p02_daylight_filter",
    "event_id:i POA_Irradiance_W_m2:f",
    "SELECT event_id, POA_Irradiance_W_m2 FROM v_tel WHERE POA_Irradiance_W_m2 > 100",
)
def _(spark, sf):
    return features.daylight(tel(spark, sf))


@query("p05_pce_from_power", "event_id:i PCE:f", "SELECT event_id, PCE FROM v_rows")
def _(spark, sf):
    return resample.with_pce(tel(spark, sf))


@query("p08_exposure_days", "event_id:i Exposure_Days:f", "SELECT event_id, Exposure_Days FROM v_exp")
def _(spark, sf):
    return features.with_exposure(fixtures.curve_rows(spark, sf))


@query(
    "p09_cyclic_time",
    "event_id:i Hour_Sin:f Hour_Cos:f Day_Sin:f Day_Cos:f",
    """
SELECT event_id, sin(h * 2 * pi()) AS Hour_Sin, cos(h * 2 * pi()) AS Hour_Cos,
  sin(d * 2 * pi()) AS Day_Sin, cos(d * 2 * pi()) AS Day_Cos
FROM (SELECT event_id, (hour("Timestamp") + minute("Timestamp") / 60.0) / 24.0 AS h,
        dayofyear("Timestamp") / 365.25 AS d FROM v_tel)
""",
)
def _(spark, sf):
    t = tel(spark, sf)
    return t.select("event_id", *[e.alias(n) for n, e in X.cyclic_time("Timestamp").items()])


@query(
    "p10_clip_hysteresis",
    "event_id:i hysteresis_index:f",
    "SELECT event_id, CASE WHEN hysteresis_index IS NULL THEN NULL "
    "ELSE least(5.0, greatest(0.0, hysteresis_index)) END AS hysteresis_index FROM v_rows",
)
def _(spark, sf):
    return fixtures.curve_rows(spark, sf).withColumn("hysteresis_index", X.clip("hysteresis_index", 0.0, 5.0))


@query(
    "p23_weather_plausibility_flag",
    "event_id:i implausible:b",
    "SELECT event_id, coalesce(PCE > 30 OR (PCE < 0.5 AND POA_Irradiance_W_m2 > 200), false) AS implausible FROM v_rows",
)
def _(spark, sf):
    bad = (F.col("PCE") > 30) | ((F.col("PCE") < 0.5) & (F.col("POA_Irradiance_W_m2") > 200))
    return fixtures.curve_rows(spark, sf).withColumn("implausible", F.coalesce(bad, F.lit(False)))


@query(
    "a01_resample_right_closed",
    "cell_name bucket:t POA_Irradiance_W_m2:f AbsoluteHumidity_g_m3:f ModuleTemp_C:f Power_W:f PCE:f",
    "SELECT * FROM v_b10",
)
def _(spark, sf):
    return b10(spark, sf)


view(
    "v_wx",
    f"""SELECT cell_name, {views.BUCKET.format(ts='"Timestamp"', w=600000000)} AS bucket,
  avg(POA_Irradiance_W_m2) AS POA_Irradiance_W_m2, avg(ModuleTemp_C) AS ModuleTemp_C
FROM v_tel WHERE event_type <> 'error' GROUP BY 1, 2""",
)
view(
    "v_pw",
    f"""SELECT cell_name, {views.BUCKET.format(ts='"Timestamp"', w=600000000)} AS bucket, avg(Power_W) AS Power_W
FROM v_tel WHERE event_type <> 'signup' GROUP BY 1, 2""",
)
view("v_joined", "SELECT * FROM v_wx FULL OUTER JOIN v_pw USING (cell_name, bucket)")


def joined_buckets(spark, sf):
    """Two sources with different outages: weather and power."""
    t = tel(spark, sf).join(fixtures.table(spark, sf, "events").select("event_id", "event_type"), "event_id")
    wx = resample.resample_right_closed(t.where("event_type <> 'error'"), ["POA_Irradiance_W_m2", "ModuleTemp_C"])
    pw = resample.resample_right_closed(t.where("event_type <> 'signup'"), ["Power_W"])
    return resample.outer_join_buckets(wx, pw)


@query(
    "j01_outer_join_buckets",
    "cell_name bucket:t POA_Irradiance_W_m2:f ModuleTemp_C:f Power_W:f PCE:f",
    f"SELECT *, {views.PCE} AS PCE FROM v_joined",
)
def _(spark, sf):
    return resample.with_pce(joined_buckets(spark, sf))


@query(
    "a04_gap_count",
    "cell_name n_gaps:i n_buckets:i",
    """SELECT cell_name, count(*) FILTER (POA_Irradiance_W_m2 > 100 AND Power_W IS NULL) AS n_gaps,
  count(*) AS n_buckets FROM v_joined GROUP BY 1""",
)
def _(spark, sf):
    return resample.gap_count(joined_buckets(spark, sf))


@query(
    "a02_fleet_temperature_stats",
    "bucket:t ModuleTemp_Mean_C:f ModuleTemp_Median_C:f ModuleTemp_Min_C:f ModuleTemp_Max_C:f",
    """SELECT bucket, avg(ModuleTemp_C) AS ModuleTemp_Mean_C, quantile_cont(ModuleTemp_C, 0.5) AS ModuleTemp_Median_C,
  min(ModuleTemp_C) AS ModuleTemp_Min_C, max(ModuleTemp_C) AS ModuleTemp_Max_C FROM v_b10 GROUP BY 1""",
)
def _(spark, sf):
    return resample.fleet_temperature_stats(b10(spark, sf))


@query(
    "a03_fleet_environment_mean",
    "bucket:t POA_Irradiance_W_m2:f AbsoluteHumidity_g_m3:f",
    f"""SELECT {views.BUCKET.format(ts='"Timestamp"', w=600000000)} AS bucket,
  avg(POA_Irradiance_W_m2) AS POA_Irradiance_W_m2, avg(AbsoluteHumidity_g_m3) AS AbsoluteHumidity_g_m3
FROM v_tel GROUP BY 1 HAVING avg(POA_Irradiance_W_m2) IS NOT NULL""",
)
def _(spark, sf):
    return resample.fleet_environment_mean(tel(spark, sf))


@query(
    "p14_device_columns_to_long",
    "bucket:t cell_name PCE:f",
    """SELECT bucket, cell_name, PCE FROM v_b10 b
JOIN (SELECT bucket, avg(POA_Irradiance_W_m2) AS fleet_poa FROM v_b10 GROUP BY 1) f USING (bucket)
WHERE fleet_poa > 100 AND PCE BETWEEN 0 AND 100""",
)
def _(spark, sf):
    b = b10(spark, sf)
    names = [f"C{i}" for i in range(8)]
    wide = b.groupBy("bucket").pivot("cell_name", names).agg(F.avg("PCE"))
    wide = wide.select("bucket", *[F.col(n).alias(f"PCE_{n}") for n in names])
    poa = b.groupBy("bucket").agg(F.avg("POA_Irradiance_W_m2").alias("POA_Irradiance_W_m2"))
    return resample.device_columns_to_long(wide.join(poa, "bucket"))


@query(
    "p14_device_map_to_long",
    "bucket:t cell_name PCE:f",
    """SELECT bucket, cell_name, PCE FROM v_b10 b
JOIN (SELECT bucket, avg(POA_Irradiance_W_m2) AS fleet_poa FROM v_b10 GROUP BY 1) f USING (bucket)
WHERE fleet_poa > 100 AND PCE BETWEEN 0 AND 100""",
)
def _(spark, sf):
    """The same rows from a map a bucket, for any list of devices."""
    b = b10(spark, sf)
    poa = b.groupBy("bucket").agg(F.avg("POA_Irradiance_W_m2").alias("POA_Irradiance_W_m2"))
    return dashboards.plausible_fleet(dashboards.fleet_map(b).join(poa, "bucket"))


@query(
    "p15_power_column_pick",
    "bucket:t picked:f",
    "SELECT bucket, avg(Power_W) AS picked FROM v_b10 WHERE cell_name = 'C3' GROUP BY 1",
)
def _(spark, sf):
    b = b10(spark, sf)
    wide = b.groupBy("bucket").pivot("cell_name", [f"C{i}" for i in range(8)]).agg(
        F.avg("ModuleTemp_C").alias("ModuleTemp"), F.avg("Power_W").alias("Power_W")
    )
    name = resample.power_column_pick(wide.columns, "C3")
    return wide.select("bucket", F.col(name).alias("picked")).where(F.col("picked").isNotNull())


view(
    "v_rates",
    """
SELECT *, (ModuleTemp_C - lag(ModuleTemp_C) OVER w) AS d_temp,
  (AbsoluteHumidity_g_m3 - lag(AbsoluteHumidity_g_m3) OVER w) AS d_hum,
  CASE WHEN lag(bucket) OVER w IS NULL THEN 600.0
       WHEN (epoch_us(bucket) - epoch_us(lag(bucket) OVER w)) / 1e6 > 1200 THEN 0.0
       ELSE (epoch_us(bucket) - epoch_us(lag(bucket) OVER w)) / 1e6 END / 3600.0 AS dt_hours
FROM v_b10 WINDOW w AS (PARTITION BY cell_name ORDER BY bucket)
""",
)
view(
    "v_doses",
    """
SELECT *, coalesce(d_temp / nullif(dt_hours, 0), 0) AS Delta_Temp_C_per_h,
  coalesce(d_hum / nullif(dt_hours, 0), 0) AS Delta_Hum_g_m3_per_h,
  sum(POA_Irradiance_W_m2 * dt_hours) OVER w AS Cum_Light_Dose_Wh_m2,
  sum(AbsoluteHumidity_g_m3 * dt_hours) OVER w AS Cum_Humidity_Exposure
FROM v_rates WINDOW w AS (PARTITION BY cell_name ORDER BY bucket ROWS UNBOUNDED PRECEDING)
""",
)


def doses(spark, sf):
    return features.with_rates_and_doses(b10(spark, sf).withColumnRenamed("bucket", "Timestamp"))


@query(
    "w08_causal_rates",
    "cell_name Timestamp:t dt_hours:f Delta_Temp_C_per_h:f Delta_Hum_g_m3_per_h:f",
    'SELECT *, bucket AS "Timestamp" FROM v_doses',
)
def _(spark, sf):
    return doses(spark, sf)


@query(
    "w09_cumulative_dose",
    "cell_name Timestamp:t Cum_Light_Dose_Wh_m2:f Cum_Humidity_Exposure:f",
    'SELECT *, bucket AS "Timestamp" FROM v_doses',
)
def _(spark, sf):
    return doses(spark, sf)


view(
    "v_merged",
    """
SELECT cell_name, curve, CASE WHEN ok THEN poa END AS POA_Irradiance_W_m2, CASE WHEN ok THEN eff END AS PCE,
  CASE WHEN ok THEN temp END AS ModuleTemp_C, CASE WHEN ok THEN hum END AS AbsoluteHumidity_g_m3
FROM (SELECT r.cell_name, r.curve, d.POA_Irradiance_W_m2 AS poa, d.PCE AS eff, d.ModuleTemp_C AS temp,
        d.AbsoluteHumidity_g_m3 AS hum, epoch_us(r."Timestamp") - epoch_us(d.bucket) <= 1200000000 AS ok
      FROM v_rows r ASOF LEFT JOIN v_b10 d ON r.cell_name = d.cell_name AND r."Timestamp" >= d.bucket)
""",
)


@query(
    "j02_asof_backward",
    "cell_name curve:i POA_Irradiance_W_m2:f ModuleTemp_C:f AbsoluteHumidity_g_m3:f PCE:f",
    "SELECT * FROM v_merged",
)
def _(spark, sf):
    curves = fixtures.curve_rows(spark, sf).select("cell_name", "curve", "Timestamp")
    t = b10(spark, sf).withColumn("tie", F.lit(0))
    cols = ["POA_Irradiance_W_m2", "ModuleTemp_C", "AbsoluteHumidity_g_m3", "PCE"]
    return asof.asof_backward(curves, t, ["cell_name"], "Timestamp", "bucket", cols, "tie", 1200)


@query(
    "j03_asof_nearest",
    "cell_name curve:i POA_Irradiance_W_m2:f ModuleTemp_C:f",
    """
SELECT cell_name, curve, CASE WHEN gap <= 1200000000 THEN poa END AS POA_Irradiance_W_m2,
  CASE WHEN gap <= 1200000000 THEN temp END AS ModuleTemp_C
FROM (
  SELECT cell_name, curve,
    CASE WHEN gb IS NULL THEN gf WHEN gf IS NULL OR gb <= gf THEN gb ELSE gf END AS gap,
    CASE WHEN gb IS NOT NULL AND (gf IS NULL OR gb <= gf) THEN poa_b ELSE poa_f END AS poa,
    CASE WHEN gb IS NOT NULL AND (gf IS NULL OR gb <= gf) THEN temp_b ELSE temp_f END AS temp
  FROM (
    SELECT b.cell_name, b.curve, b.gb, b.poa_b, b.temp_b, epoch_us(f.bucket) - epoch_us(b."Timestamp") AS gf,
      f.POA_Irradiance_W_m2 AS poa_f, f.ModuleTemp_C AS temp_f
    FROM (SELECT r.cell_name, r.curve, r."Timestamp", epoch_us(r."Timestamp") - epoch_us(d.bucket) AS gb,
            d.POA_Irradiance_W_m2 AS poa_b, d.ModuleTemp_C AS temp_b
          FROM v_rows r ASOF LEFT JOIN v_b10 d ON r.cell_name = d.cell_name AND r."Timestamp" >= d.bucket) b
    ASOF LEFT JOIN v_b10 f ON b.cell_name = f.cell_name AND b."Timestamp" <= f.bucket))
""",
)
def _(spark, sf):
    curves = fixtures.curve_rows(spark, sf).select("cell_name", "curve", "Timestamp")
    t = b10(spark, sf).withColumn("tie", F.lit(0))
    return asof.asof_nearest(
        curves, t, ["cell_name"], "Timestamp", "bucket", ["POA_Irradiance_W_m2", "ModuleTemp_C"], "tie", 1200
    )


@query(
    "a11_curve_collapse",
    "cell_name cell_id:i curve:i label_curve:i Timestamp:t pFF:f Voc:f Jsc:f FF:f",
    """SELECT cell_name, cell_id, curve, label_curve, min("Timestamp") AS "Timestamp", max(pFF) AS pFF,
  max(Voc) AS Voc, max(Jsc) AS Jsc, max(FF) AS FF FROM v_rows WHERE label_curve <> -1 GROUP BY ALL""",
)
def _(spark, sf):
    return features.curve_collapse(fixtures.curve_rows(spark, sf))


@query(
    "merged_feature_matrix",
    "cell_name curve:i label_curve:i Timestamp:t pFF:f PCE:f POA_Irradiance_W_m2:f Delta_Temp_C_per_h:f "
    "Cum_Light_Dose_Wh_m2:f Cum_Humidity_Exposure:f Hour_Sin:f Day_Cos:f spike_count:i hysteresis_index:f",
    """
WITH c AS (SELECT cell_name, cell_id, curve, label_curve, min("Timestamp") AS "Timestamp", max(pFF) AS pFF
           FROM v_rows WHERE label_curve <> -1 GROUP BY ALL),
birth AS (SELECT cell_name, min("Timestamp") AS b FROM c GROUP BY 1),
t AS (SELECT * FROM v_b10 JOIN birth USING (cell_name) WHERE bucket >= b),
r AS (SELECT *, ModuleTemp_C - lag(ModuleTemp_C) OVER w AS d_temp,
  CASE WHEN lag(bucket) OVER w IS NULL THEN 600.0
       WHEN (epoch_us(bucket) - epoch_us(lag(bucket) OVER w)) / 1e6 > 1200 THEN 0.0
       ELSE (epoch_us(bucket) - epoch_us(lag(bucket) OVER w)) / 1e6 END / 3600.0 AS h
  FROM t WINDOW w AS (PARTITION BY cell_name ORDER BY bucket)),
d AS (SELECT *, coalesce(d_temp / nullif(h, 0), 0) AS Delta_Temp_C_per_h,
  sum(POA_Irradiance_W_m2 * h) OVER w AS light, sum(AbsoluteHumidity_g_m3 * h) OVER w AS damp
  FROM r WINDOW w AS (PARTITION BY cell_name ORDER BY bucket ROWS UNBOUNDED PRECEDING)),
m AS (SELECT c.*, d.* EXCLUDE (cell_name), epoch_us(c."Timestamp") - epoch_us(d.bucket) <= 1200000000 AS ok
  FROM c ASOF LEFT JOIN d ON c.cell_name = d.cell_name AND c."Timestamp" >= d.bucket)
SELECT m.cell_name, m.curve, m.label_curve, m."Timestamp", m.pFF, CASE WHEN ok THEN m.PCE END AS PCE,
  CASE WHEN ok THEN m.POA_Irradiance_W_m2 END AS POA_Irradiance_W_m2,
  CASE WHEN ok THEN m.Delta_Temp_C_per_h END AS Delta_Temp_C_per_h,
  CASE WHEN ok THEN light END AS Cum_Light_Dose_Wh_m2, CASE WHEN ok THEN damp END AS Cum_Humidity_Exposure,
  sin((hour(m."Timestamp") + minute(m."Timestamp") / 60.0) / 24.0 * 2 * pi()) AS Hour_Sin,
  cos(dayofyear(m."Timestamp") / 365.25 * 2 * pi()) AS Day_Cos, q.spike_count,
  least(5.0, greatest(0.0, q.hysteresis_index)) AS hysteresis_index
FROM m LEFT JOIN v_rows q ON m.cell_name = q.cell_name AND m.curve = q.curve
""",
)
def _(spark, sf):
    rows = fixtures.curve_rows(spark, sf)
    merged = features.merged_matrix(features.curve_collapse(rows), b10(spark, sf))
    return features.attach_quality(merged, rows, ["spike_count", "hysteresis_index"])


@query(
    "j04_attach_quality",
    "cell_name curve:i spike_count:i hysteresis_index:f",
    """SELECT cell_name, curve, spike_count, least(5.0, greatest(0.0, hysteresis_index)) AS hysteresis_index FROM v_rows
WHERE label_curve <> -1""",
)
def _(spark, sf):
    rows = fixtures.curve_rows(spark, sf)
    curves = features.curve_collapse(rows)
    return features.attach_quality(curves, rows, ["spike_count", "hysteresis_index"])


@query(
    "device_quantiles",
    "cell_name n:i p25:f p50:f p98:f",
    """SELECT cell_name, count(PCE) AS n, quantile_cont(PCE, 0.25) AS p25, quantile_cont(PCE, 0.5) AS p50,
  quantile_cont(PCE, 0.98) AS p98 FROM v_rows GROUP BY 1""",
)
def _(spark, sf):
    return exact_quantiles(
        fixtures.curve_rows(spark, sf), ["cell_name"], "PCE", {"p25": 0.25, "p50": 0.5, "p98": 0.98}
    )
