"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from helioframe.operators import dashboards as B, features, screening as S
from helioframe.plans import daily_queries as D, screening_queries as Q
from helioframe.plans.lifetime_queries import lifetimes
from helioframe.plans.registry import query
from helioframe.plans.stages import staged
from helioframe.plans.telemetry_queries import b10 as telemetry10
from helioframe.sources import fixtures

CELLS = [f"C{i}" for i in range(8)]
UNTIL = "2024-01-20 00:00:00"


@staged
def b10(spark, sf):
    return telemetry10(spark, sf)


def _band(name: str, sec: int) -> str:
    base = "epoch_us((SELECT date_trunc('day', min(bucket)) FROM v_b10))" if sec > 86400 else "0"
    w = sec * 1000000
    return f"""SELECT cell_name, '{name}' AS resolution, make_timestamp(epoch_us(bucket) - ((epoch_us(bucket) - {base}) % {w} + {w}) % {w}) AS start,
  avg(PCE) AS central, min(PCE) AS band_low, max(PCE) AS band_high FROM v_b10 GROUP BY 1, 2, 3 HAVING avg(PCE) IS NOT NULL"""


@query(
    "a49_multi_resolution_bands",
    "cell_name resolution start:t central:f band_low:f band_high:f",
    " UNION ALL ".join(_band(n, s) for n, s in B.RESOLUTIONS.items()),
)
def _(spark, sf):
    return B.multi_resolution_bands(b10(spark, sf), "PCE")


@query(
    "a49_median_bands",
    "cell_name start:t n:i central:f",
    "SELECT cell_name, date_trunc('day', bucket)::TIMESTAMP AS start, count(PCE) AS n, quantile_cont(PCE, 0.5) AS central FROM v_b10 WHERE PCE IS NOT NULL GROUP BY 1, 2",
)
def _(spark, sf):
    return B.median_bands(b10(spark, sf), "PCE")


@query(
    "a50_dose_and_yield",
    "cell_name start:t yield_wh:f radiation_kwh_m2:f thermal_dose:f humidity_dose:f efficiency:f",
    """SELECT *, CASE WHEN e BETWEEN 0 AND 100 THEN e END AS efficiency FROM (SELECT *,
  CASE WHEN radiation_kwh_m2 > 0.005 THEN 100 * (yield_wh / 1000 / 6.4e-5) / radiation_kwh_m2 END AS e FROM (
  SELECT cell_name, date_trunc('day', bucket)::TIMESTAMP AS start, sum(Power_W) / 6 AS yield_wh, sum(POA_Irradiance_W_m2) / 6 / 1000 AS radiation_kwh_m2,
    sum(ModuleTemp_C) / 6 AS thermal_dose, sum(AbsoluteHumidity_g_m3) / 6 AS humidity_dose FROM v_b10 GROUP BY 1, 2))""",
)
def _(spark, sf):
    return B.dose_and_yield(b10(spark, sf))


@query(
    "a51_fleet_pivot",
    "bucket:t " + " ".join(f"{c}:f" for c in CELLS),
    "SELECT bucket, " + ", ".join(f"avg(PCE) FILTER (cell_name = '{c}') AS {c}" for c in CELLS) + " FROM v_b10 GROUP BY 1",
)
def _(spark, sf):
    return B.fleet_pivot(b10(spark, sf), CELLS)


@query("a51_fleet_map", "bucket:t cell_name PCE:f", "SELECT bucket, cell_name, avg(PCE) AS PCE FROM v_b10 GROUP BY 1, 2")
def _(spark, sf):
    """The pivot for any list of devices: a map a bucket, and its rows again."""
    return B.fleet_long(B.fleet_map(b10(spark, sf)))


KPI = "cell_name " + " ".join(f"{n}_now:f {n}_before:f {n}_delta_pct:f" for n in ("pce", "temp", "dose"))


@query(
    "a52_kpi_current_vs_previous",
    KPI,
    """SELECT *, 100 * (pce_now - pce_before) / nullif(pce_before, 0) AS pce_delta_pct, 100 * (temp_now - temp_before) / nullif(temp_before, 0) AS temp_delta_pct,
  100 * (dose_now - dose_before) / nullif(dose_before, 0) AS dose_delta_pct FROM (
  SELECT cell_name, avg(PCE) FILTER (a < 7) AS pce_now, avg(PCE) FILTER (a >= 7 AND a < 14) AS pce_before, avg(ModuleTemp_C) FILTER (a < 7) AS temp_now,
    avg(ModuleTemp_C) FILTER (a >= 7 AND a < 14) AS temp_before, sum(POA_Irradiance_W_m2) FILTER (a < 7) / 6 AS dose_now,
    sum(POA_Irradiance_W_m2) FILTER (a >= 7 AND a < 14) / 6 AS dose_before
  FROM (SELECT *, (epoch_us((SELECT max(bucket) FROM v_b10)) - epoch_us(bucket)) / 86400000000.0 AS a FROM v_b10) GROUP BY 1)""",
)
def _(spark, sf):
    return B.kpi_current_vs_previous(b10(spark, sf))


@query(
    "a53_fleet_mean_efficiency",
    "mean_efficiency:f n:i",
    """SELECT avg(PCE / 100) AS mean_efficiency, count(*) AS n FROM v_b10 JOIN (
  SELECT bucket, avg(POA_Irradiance_W_m2) AS g FROM v_b10 GROUP BY 1) USING (bucket) WHERE g > 100 AND PCE / 100 > 0 AND PCE / 100 <= 1""",
)
def _(spark, sf):
    b = b10(spark, sf)
    poa = b.groupBy("bucket").agg(F.avg("POA_Irradiance_W_m2").alias("POA_Irradiance_W_m2"))
    return B.fleet_mean_efficiency(B.fleet_map(b).join(poa, "bucket"))


@query(
    "a54_operation_days",
    "cell_name operation_days:f is_mature:b",
    """SELECT cell_name, least(d, 14) AS operation_days, d > 14 AS is_mature FROM (
  SELECT cell_name, (epoch_us(least(combined_failure_date, t1)) - epoch_us(t0)) / 86400000000.0 AS d FROM (
    SELECT cell_name, min("Timestamp") AS t0, max("Timestamp") AS t1 FROM v_rows GROUP BY 1) LEFT JOIN v_t80 USING (cell_name))""",
)
def _(spark, sf):
    return B.operation_days(fixtures.curve_rows(spark, sf), lifetimes(spark, sf))


@query(
    "a55_device_first_seen",
    "cell_name first_seen:t",
    'SELECT cell_name, min("Timestamp") FILTER (PCE IS NOT NULL) AS first_seen FROM v_rows GROUP BY 1',
)
def _(spark, sf):
    return B.device_first_seen(fixtures.curve_rows(spark, sf), "PCE")


@query(
    "a56_device_kpis",
    "cell_name latest_relative_pce:f any_alert:b",
    'SELECT cell_name, arg_max(PCE_Relative, "Timestamp") AS latest_relative_pce, bool_or(Digital_Twin_Alert) AS any_alert FROM v_alert GROUP BY 1',
)
def _(spark, sf):
    return B.device_kpis(Q.alerted(spark, sf))


@query(
    "a61_t80_reference_lines",
    "cell_name metric level:f failure_date:t",
    f"""SELECT cell_name, 'PCE' AS metric, 0.8 AS level, CASE WHEN t80_failure_date_pce <= TIMESTAMP '{UNTIL}' THEN t80_failure_date_pce END AS failure_date FROM v_t80
UNION ALL SELECT cell_name, 'pFF', pFF_initial * 0.8, CASE WHEN t80_failure_date_pff <= TIMESTAMP '{UNTIL}' THEN t80_failure_date_pff END FROM v_t80""",
)
def _(spark, sf):
    return B.t80_reference_lines(lifetimes(spark, sf), F.lit(UNTIL).cast("timestamp"))


@query(
    "a62_status_category",
    "category n_devices:i",
    """SELECT CASE WHEN Diagnostic_Status LIKE '%T80%' THEN 'T80' WHEN Diagnostic_Status LIKE '%ML%' THEN 'ML' ELSE 'Healthy' END AS category,
  count(*) AS n_devices FROM v_status GROUP BY 1""",
)
def _(spark, sf):
    return B.status_category(Q.summary(spark, sf))


@query(
    "p17_status_component_filter",
    "cell_name t80_status",
    """SELECT cell_name, CASE WHEN t = '' THEN 'Healthy' ELSE t END AS t80_status FROM (
  SELECT cell_name, array_to_string(list_filter(string_split(Diagnostic_Status, ' + '), lambda x: x LIKE '%T80%'), ' + ') AS t FROM v_status)""",
)
def _(spark, sf):
    return B.status_component_filter(Q.summary(spark, sf))


@query(
    "p18_null_future_events",
    "cell_name event_date:t event_day:f",
    f"""SELECT cell_name, CASE WHEN ok THEN combined_failure_date END AS event_date, CASE WHEN ok THEN combined_survival_days END AS event_day FROM (
  SELECT *, coalesce(combined_failure_date <= TIMESTAMP '{UNTIL}' AND combined_survival_days <= 14, false) AS ok FROM v_t80)""",
)
def _(spark, sf):
    return B.null_future_events(lifetimes(spark, sf), F.lit(UNTIL).cast("timestamp"), 14.0)


@query(
    "p19_device_timeline",
    "cell_name event day:f seq:i",
    """SELECT *, row_number() OVER (PARTITION BY cell_name ORDER BY day, event) AS seq FROM (
  SELECT cell_name, 'START' AS event, 0.0::DOUBLE AS day FROM v_t80 UNION ALL SELECT cell_name, 'T80', combined_survival_days FROM v_t80
  UNION ALL SELECT cell_name, 'ML', d FROM (SELECT cell_name, CASE WHEN 100.0 * avg(CAST(Digital_Twin_Alert AS INT)) > 25 THEN
    min(Exposure_Days) FILTER (Cum_Alert_Pct > 25 AND Cum_Points >= 100) END AS d FROM v_cum GROUP BY 1)) WHERE day <= 30""",
)
def _(spark, sf):
    day = S.threshold_day(S.cumulative_alert_pct(Q.alerted(spark, sf)))
    return B.device_timeline(lifetimes(spark, sf).join(day, "cell_name", "left"), 30.0)


@query(
    "w30_normalise_by_first_week",
    "cell_name Date_Day:d by_rows:f by_calendar:f",
    """SELECT cell_name, Date_Day, PCE_mean / max(PCE_mean) FILTER (day_no <= 7) OVER (PARTITION BY cell_name) AS by_rows,
  PCE_mean / max(PCE_mean) FILTER (Date_Day < first_day + 7) OVER (PARTITION BY cell_name) AS by_calendar FROM (
  SELECT *, row_number() OVER (PARTITION BY cell_name ORDER BY Date_Day) AS day_no, min(Date_Day) OVER (PARTITION BY cell_name) AS first_day FROM v_day)""",
)
def _(spark, sf):
    d = features.daily_trajectory(features.with_exposure(fixtures.curve_rows(spark, sf)))
    a = B.normalise_by_first_week(d, "PCE").withColumnRenamed("normalised", "by_rows")
    return B.normalise_by_first_week(a, "PCE", calendar=True).withColumnRenamed("normalised", "by_calendar")


@query(
    "t01_first_n_per_group",
    "cell_name Date_Day:d PCE:f",
    """SELECT cell_name, Date_Day, PCE_mean AS PCE FROM (SELECT *, row_number() OVER (PARTITION BY cell_name ORDER BY Date_Day) AS r FROM v_day) WHERE r <= 3""",
)
def _(spark, sf):
    from pyspark.sql import Window as W

    d = features.daily_trajectory(features.with_exposure(fixtures.curve_rows(spark, sf)))
    return d.withColumn("r", F.row_number().over(W.partitionBy("cell_name").orderBy("Date_Day"))).where("r <= 3")


@query(
    "u01_union_device_frames",
    "cell_name source n:i",
    """SELECT cell_name, 'curves' AS source, count(*) AS n FROM v_rows GROUP BY 1 UNION ALL SELECT cell_name, 'buckets', count(*) FROM v_b10 GROUP BY 1""",
)
def _(spark, sf):
    a = fixtures.curve_rows(spark, sf).withColumn("source", F.lit("curves"))
    u = a.unionByName(b10(spark, sf).withColumn("source", F.lit("buckets")), allowMissingColumns=True)
    return u.groupBy("cell_name", "source").agg(F.count("*").alias("n"))
