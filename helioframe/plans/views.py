"""SQL text of the fixture views, mirroring ``sources.fixtures``."""

from helioframe.plans.registry import view

HUMIDITY = "216.68 * (6.112 * exp(17.67 * {t} / ({t} + 243.5)) * {rh} / 100.0) / ({t} + 273.15)"
BUCKET = "make_timestamp(epoch_us({ts}) + ((-epoch_us({ts})) % {w} + {w}) % {w})"

view(
    "v_tel",
    f"""
SELECT *, {HUMIDITY.format(t='"AmbientTemp_C"', rh='"RelativeHumidity_pct"')} AS AbsoluteHumidity_g_m3,
  POA_Irradiance_W_m2 * 6.4e-5 * 0.01 * (18.0 - 0.02 * (event_id % 50)) * (1.0 - age * (1 + cell_id) / 300.0) AS Power_W
FROM (
  SELECT event_id, event_type, user_id % 8 AS cell_id, 'C' || CAST(user_id % 8 AS VARCHAR) AS cell_name,
    ts AS "Timestamp", value * 10.0 AS POA_Irradiance_W_m2,
    10.0 + 0.5 * CAST(json_extract_string(props, '$.k') AS DOUBLE) AS ModuleTemp_C,
    5.0 + 0.4 * CAST(json_extract_string(props, '$.k') AS DOUBLE) AS AmbientTemp_C,
    20.0 + event_id % 80 AS RelativeHumidity_pct,
    (epoch_us(ts) - 1704067200000000) / 86400000000.0 AS age
  FROM events)
""",
)
PCE = """CASE WHEN POA_Irradiance_W_m2 > 100 THEN
  CASE WHEN Power_W IS NOT NULL THEN
    least(100.0, greatest(0.0, Power_W / (POA_Irradiance_W_m2 * 6.4e-5) * 100.0)) END END"""
view(
    "v_rows",
    f"""
SELECT event_id, cell_id, cell_name, event_id AS curve, event_id % 9 - 1 AS label_curve, "Timestamp",
  POA_Irradiance_W_m2, ModuleTemp_C, AbsoluteHumidity_g_m3, {PCE} AS PCE,
  (0.95 + 0.001 * (event_id % 40)) * (1.0 - age * (1 + cell_id) / 1500.0) AS Voc,
  POA_Irradiance_W_m2 * 0.02 * (1.0 - age * (1 + cell_id) / 900.0) AS Jsc,
  (0.62 - 0.002 * (event_id % 20)) * (1.0 - age * (1 + cell_id) / 500.0) AS FF,
  CASE WHEN event_id % 67 = 0 THEN NULL WHEN event_id % 41 = 0 THEN 0.75
       ELSE (0.66 - 0.003 * (event_id % 30)) * (1.0 - age * (1 + cell_id) / 350.0) END AS pFF,
  event_id % 4 AS spike_count, (event_id % 13) * 0.5 AS hysteresis_index
FROM v_tel
""",
)
view(
    "v_b10",
    f"""
SELECT *, {PCE} AS PCE FROM (
  SELECT cell_name, {BUCKET.format(ts='"Timestamp"', w=600000000)} AS bucket,
    avg(POA_Irradiance_W_m2) AS POA_Irradiance_W_m2, avg(AbsoluteHumidity_g_m3) AS AbsoluteHumidity_g_m3,
    avg(ModuleTemp_C) AS ModuleTemp_C, avg(Power_W) AS Power_W
  FROM v_tel GROUP BY 1, 2)
""",
)
view(
    "v_exp",
    """
SELECT r.*, (epoch_us("Timestamp") - epoch_us(z.day_zero)) / 86400000000.0 AS Exposure_Days
FROM v_rows r JOIN (SELECT cell_name, min("Timestamp") AS day_zero FROM v_rows GROUP BY 1) z USING (cell_name)
""",
)
view("v_tracked", "SELECT * FROM v_exp WHERE POA_Irradiance_W_m2 > 100 AND pFF <= 0.7")
view(
    "v_daily",
    """
SELECT cell_name, CAST("Timestamp" AS DATE) AS Date_Day, max(PCE) AS PCE_max, max(pFF) AS pFF_max,
  max(POA_Irradiance_W_m2) AS POA_max, max(Exposure_Days) AS Exposure_Days_max, max("Timestamp") AS Datetime_max
FROM v_tracked GROUP BY 1, 2
""",
)


def _peak(metric: str) -> str:
    return f"""
SELECT cell_name, {metric} AS initial, Exposure_Days_max AS peak_day FROM (
  SELECT *, row_number() OVER (PARTITION BY cell_name ORDER BY {metric} DESC, Date_Day) AS best FROM (
    SELECT *, row_number() OVER (PARTITION BY cell_name ORDER BY Date_Day) AS day_no FROM v_daily)
  WHERE day_no <= 3) WHERE best = 1
"""


def _below(metric: str, peak: str, gate: str) -> str:
    return f"""
SELECT d.*, p.initial, p.peak_day,
  CASE WHEN Exposure_Days_max >= peak_day AND {metric} < initial * 0.8 {gate} THEN 1 ELSE 0 END AS is_below
FROM v_daily d LEFT JOIN {peak} p USING (cell_name)
"""


def _extract(flags: str) -> str:
    return f"""
SELECT c.cell_name, c.initial, coalesce(h.survival_days, 'inf'::DOUBLE) AS survival_days, h.failure_date
FROM (SELECT cell_name, max(initial) AS initial FROM {flags} GROUP BY 1) c
LEFT JOIN (
  SELECT cell_name, arg_min(survival_days, start) AS survival_days, arg_min(failure_date, start) AS failure_date FROM (
    SELECT cell_name, n_days, count(*) AS length, min(rn) AS start, max(rn) AS stop,
      min(Exposure_Days_max) AS survival_days, min(Datetime_max) AS failure_date
    FROM (
      SELECT *, rn - row_number() OVER (PARTITION BY cell_name, is_below ORDER BY Date_Day) AS run FROM (
        SELECT *, row_number() OVER (PARTITION BY cell_name ORDER BY Date_Day) AS rn,
          count(*) OVER (PARTITION BY cell_name) AS n_days FROM {flags}))
    WHERE is_below = 1 GROUP BY cell_name, run, n_days)
  WHERE length >= 3 OR stop = n_days GROUP BY cell_name) h USING (cell_name)
"""


view("v_peak_pce", _peak("PCE_max"))
view("v_peak_pff", _peak("pFF_max"))
view("v_below_pce", _below("PCE_max", "v_peak_pce", "AND POA_max > 400"))
view("v_below_pff", _below("pFF_max", "v_peak_pff", ""))
view("v_hit_pce", _extract("v_below_pce"))
view("v_hit_pff", _extract("v_below_pff"))
view(
    "v_t80",
    """
SELECT a.cell_name, a.initial AS PCE_initial, a.initial * 0.8 AS T80_threshold_PCE,
  a.survival_days AS survival_days_pce, a.failure_date AS t80_failure_date_pce,
  b.initial AS pFF_initial, b.initial * 0.8 AS T80_threshold_pFF,
  b.survival_days AS survival_days_pff, b.failure_date AS t80_failure_date_pff,
  least(a.survival_days, b.survival_days) AS combined_survival_days,
  CASE WHEN a.survival_days <= b.survival_days THEN a.failure_date ELSE b.failure_date END AS combined_failure_date
FROM v_hit_pce a JOIN v_hit_pff b USING (cell_name)
""",
)
