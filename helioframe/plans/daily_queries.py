"""Daily matrices, rolling features and forensics."""

from __future__ import annotations

from pyspark.sql import functions as F

from helioframe.config import DAMAGE_FEATURES, TRAJECTORY_PARAMETERS
from helioframe.functions.stages import settle
from helioframe.operators import features, forensics as Z, t80
from helioframe.plans.lifetime_queries import lifetimes
from helioframe.plans.registry import query, view
from helioframe.plans.stages import staged
from helioframe.sources import fixtures

view("v_cur", "SELECT * FROM v_exp JOIN v_t80 USING (cell_name)")
view(
    "v_day",
    """
SELECT cell_name, CAST("Timestamp" AS DATE) AS Date_Day, count(*) AS n_curves,
  sum(POA_Irradiance_W_m2) AS Daily_Irradiance_Dose, max(ModuleTemp_C) AS Daily_Max_Temp_C,
  avg(ModuleTemp_C) AS Daily_Mean_Temp_C, min(ModuleTemp_C) AS Daily_Min_Temp_C, stddev_samp(ModuleTemp_C) AS Daily_Std_Temp_C,
  quantile_cont(AbsoluteHumidity_g_m3, 0.5) AS Daily_Median_Humidity, max(PCE) AS Daily_PCE, stddev_samp(PCE) AS PCE_Std,
  avg(PCE) AS PCE_mean, avg(FF) AS FF, avg(Jsc) AS Jsc, avg(Voc) AS Voc, avg(pFF) AS pFF,
  max(Exposure_Days) AS Exposure_Days, max(PCE_initial) AS PCE_Initial
FROM v_cur GROUP BY 1, 2
""",
)


def _rul(w: int) -> str:
    r = f"OVER (PARTITION BY cell_name ORDER BY Date_Day ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"""
SELECT *, Cumulative_Damage - Cumulative_Damage_Lag1 AS Daily_Damage_Increment FROM (
  SELECT *, coalesce(lag(Cumulative_Damage) OVER (PARTITION BY cell_name ORDER BY Date_Day), 0) AS Cumulative_Damage_Lag1,
    quantile_cont(Daily_Irradiance_Dose, 0.5) {r} AS Rolling_Irradiance, quantile_cont(Daily_Max_Temp_C, 0.5) {r} AS Rolling_Thermal_load
  FROM (SELECT *, quantile_cont(Instant_Loss, 0.5) {r} AS Cumulative_Damage
        FROM (SELECT *, 1.0 - Daily_PCE / nullif(PCE_Initial, 0) AS Instant_Loss FROM v_day)))
WHERE Daily_Median_Humidity IS NOT NULL AND Cumulative_Damage - Cumulative_Damage_Lag1 IS NOT NULL
"""


view("v_rul", _rul(2))


def current(spark, sf):
    """Curve rows with exposure and the device's lifetime table."""
    rows = features.with_exposure(fixtures.curve_rows(spark, sf))
    return rows.join(lifetimes(spark, sf), "cell_name")


def rul(spark, sf, window: int = 2):
    return features.daily_rul_matrix(current(spark, sf), window)


RUL_COLUMNS = (
    "cell_name Date_Day:d Daily_Irradiance_Dose:f Daily_Max_Temp_C:f Daily_Median_Humidity:f Daily_PCE:f Exposure_Days:f "
    "PCE_Initial:f"
)


@query("a13_daily_rul_matrix", RUL_COLUMNS, "SELECT * FROM v_rul")
def _(spark, sf):
    return rul(spark, sf)


@query(
    "w10_rolling_median",
    "cell_name Date_Day:d Cumulative_Damage:f Rolling_Irradiance:f Rolling_Thermal_load:f",
    _rul(7),
)
def _(spark, sf):
    return rul(spark, sf, 7)


@query(
    "w12_damage_increment",
    "cell_name Date_Day:d Instant_Loss:f Cumulative_Damage:f Cumulative_Damage_Lag1:f Daily_Damage_Increment:f",
    "SELECT * FROM v_rul",
)
def _(spark, sf):
    return rul(spark, sf)


TRAJ = ("Daily_Irradiance_Dose:f Daily_Max_Temp_C:f Daily_Median_Humidity:f Exposure_Days:f PCE:f FF:f Jsc:f Voc:f")


@query(
    "a14_daily_trajectory",
    f"cell_name Date_Day:d {TRAJ}",
    "SELECT *, PCE_mean AS PCE FROM v_day",
)
def _(spark, sf):
    return features.daily_trajectory(features.with_exposure(fixtures.curve_rows(spark, sf)))


@query(
    "w11_rolling_mean",
    "cell_name Date_Day:d PCE_smooth:f",
    """SELECT cell_name, Date_Day, avg(PCE_mean) OVER (PARTITION BY cell_name ORDER BY Date_Day
  ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS PCE_smooth FROM v_day""",
)
def _(spark, sf):
    d = features.daily_trajectory(features.with_exposure(fixtures.curve_rows(spark, sf)))
    return d.withColumn("PCE_smooth", features.rolling_mean("PCE"))


def _state() -> str:
    w = "(PARTITION BY cell_name ORDER BY Date_Day)"
    r = "(PARTITION BY cell_name ORDER BY Date_Day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
    init = ", ".join(
        f"avg({c}) FILTER (day_no <= 3) OVER (PARTITION BY cell_name) AS {p}_Init"
        for p, c in (("PCE", "PCE_mean"), ("FF", "FF"), ("Jsc", "Jsc"), ("Voc", "Voc"))
    )
    state = ", ".join(
        f"avg({c} / ({p}_Init + 1e-9)) OVER {r} AS {p}_State"
        for p, c in (("PCE", "PCE_mean"), ("FF", "FF"), ("Jsc", "Jsc"), ("Voc", "Voc"))
    )
    lag = ", ".join(f"lag({p}_State) OVER {w} AS {p}_Lag1" for p in TRAJECTORY_PARAMETERS)
    delta = ", ".join(f"{p}_State - {p}_Lag1 AS {p}_Delta" for p in TRAJECTORY_PARAMETERS)
    keep = " AND ".join(f"{p}_State - {p}_Lag1 IS NOT NULL" for p in TRAJECTORY_PARAMETERS)
    return f"""
SELECT *, {delta} FROM (SELECT *, {lag} FROM (SELECT *, {state},
  quantile_cont(Daily_Irradiance_Dose, 0.5) OVER {r} AS Rolling_Irradiance,
  quantile_cont(Daily_Max_Temp_C, 0.5) OVER {r} AS Rolling_Thermal_load
  FROM (SELECT *, {init} FROM (SELECT *, row_number() OVER {w} AS day_no FROM v_day))))
WHERE {keep} AND Daily_Median_Humidity IS NOT NULL
"""


view("v_state", _state())


def states(spark, sf):
    d = settle(features.daily_trajectory(features.with_exposure(fixtures.curve_rows(spark, sf))))
    return features.normalised_state(d, TRAJECTORY_PARAMETERS)


@query(
    "w13_normalised_state",
    "cell_name Date_Day:d " + " ".join(f"{p}_State:f {p}_Lag1:f {p}_Delta:f" for p in TRAJECTORY_PARAMETERS),
    "SELECT * FROM v_state",
)
def _(spark, sf):
    return states(spark, sf)


view(
    "v_for",
    """SELECT *, Cumulative_Damage - coalesce(lag(Cumulative_Damage) OVER (PARTITION BY cell_name ORDER BY Date_Day), 0) AS Daily_Damage_Increment
FROM (SELECT *, Daily_PCE AS PCE, 1.0 - Daily_PCE / nullif(PCE_Initial, 0) AS Cumulative_Damage FROM v_day)""",
)


@staged
def forensic_days(spark, sf):
    return features.daily_forensics(current(spark, sf))


@staged
def rul_days(spark, sf):
    return rul(spark, sf)


@query(
    "a15_daily_forensics",
    "cell_name Date_Day:d n_curves:i Daily_Irradiance_Dose:f Daily_Max_Temp_C:f Daily_Mean_Temp_C:f Daily_Min_Temp_C:f "
    "Daily_Std_Temp_C:f Daily_Median_Humidity:f PCE:f PCE_Std:f FF:f Jsc:f Voc:f pFF:f Exposure_Days:f Cumulative_Damage:f "
    "Daily_Damage_Increment:f",
    "SELECT * FROM v_for",
)
def _(spark, sf):
    return forensic_days.build(spark, sf)


@query(
    "a34_cohort_overview",
    "cell_name n_days:i temp_mean:f humidity_mean:f irr_mean:f pce_mean:f pce_std:f damage_final:f damage_rate_mean:f "
    "damage_rate_std:f max_daily_jump:f recovery_days_pct:f survival_rank:i",
    """SELECT *, rank() OVER (ORDER BY combined_survival_days) AS survival_rank FROM (
  SELECT cell_name, count(*) AS n_days, avg(Daily_Max_Temp_C) AS temp_mean, avg(Daily_Median_Humidity) AS humidity_mean,
    avg(Daily_Irradiance_Dose) AS irr_mean, avg(PCE) AS pce_mean, stddev_samp(PCE) AS pce_std,
    arg_max(Cumulative_Damage, Date_Day) AS damage_final, avg(Daily_Damage_Increment) AS damage_rate_mean,
    stddev_samp(Daily_Damage_Increment) AS damage_rate_std, max(Daily_Damage_Increment) AS max_daily_jump,
    100.0 * count(*) FILTER (Daily_Damage_Increment < -0.001) / count(*) AS recovery_days_pct
  FROM v_for GROUP BY 1) JOIN v_t80 USING (cell_name)""",
)
def _(spark, sf):
    return Z.cohort_overview(forensic_days(spark, sf), lifetimes(spark, sf))


PEER = ["Daily_Max_Temp_C", "Daily_Median_Humidity", "Daily_Irradiance_Dose", "PCE", "PCE_Std"]


@query(
    "a35_matched_peers",
    "metric target:f peers:f ratio:f is_off:b",
    "SELECT *, target / nullif(peers, 0) AS ratio, abs(target / nullif(peers, 0) - 1) > 0.3 AS is_off FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, avg({m}) FILTER (cell_name = 'C7') AS target, avg({m}) FILTER (cell_name <> 'C7') AS peers
FROM v_for WHERE Exposure_Days <= 10"""
        for m in PEER
    )
    + ")",
)
def _(spark, sf):
    return Z.matched_peers(forensic_days(spark, sf), "C7", PEER)


DOSE = ", ".join(
    f"count(*) FILTER (Daily_Max_Temp_C > {x}) AS days_{x}, 100.0 * count(*) FILTER (Daily_Max_Temp_C > {x}) / count(*) AS pct_{x}"
    for x in (35, 40, 45, 50)
)


@query(
    "a36_thermal_dose",
    "cell_name n_days:i " + " ".join(f"days_{x}:i pct_{x}:f" for x in (35, 40, 45, 50)) + " thermal_dose_35:f thermal_dose_40:f",
    f"""SELECT cell_name, count(*) AS n_days, {DOSE}, sum(greatest(0, Daily_Max_Temp_C - 35)) AS thermal_dose_35,
  sum(greatest(0, Daily_Max_Temp_C - 40)) AS thermal_dose_40 FROM v_for GROUP BY 1""",
)
def _(spark, sf):
    return Z.thermal_dose(forensic_days(spark, sf))


@query(
    "a37_recovery_days",
    "cell_name n_recovery:i n_degradation:i n_flat:i largest_recovery:f largest_degradation:f recovery_pct:f",
    """SELECT cell_name, count(*) FILTER (Daily_Damage_Increment < -0.001) AS n_recovery,
  count(*) FILTER (Daily_Damage_Increment > 0.001) AS n_degradation, count(*) FILTER (abs(Daily_Damage_Increment) <= 0.001) AS n_flat,
  min(Daily_Damage_Increment) AS largest_recovery, max(Daily_Damage_Increment) AS largest_degradation,
  100.0 * count(*) FILTER (Daily_Damage_Increment < -0.001) / count(*) AS recovery_pct FROM v_for GROUP BY 1""",
)
def _(spark, sf):
    return Z.recovery_days(forensic_days(spark, sf))


@query(
    "a38_feature_correlation",
    "cell_name feature pearson:f",
    " UNION ALL ".join(
        f"SELECT cell_name, '{f}' AS feature, corr({f}, Daily_Damage_Increment) AS pearson FROM v_rul GROUP BY 1"
        for f in DAMAGE_FEATURES
    ),
)
def _(spark, sf):
    return Z.feature_correlation(rul_days(spark, sf), DAMAGE_FEATURES, "Daily_Damage_Increment")


@query(
    "a39_target_profile",
    "cell_name n:i mean:f median:f std:f min:f max:f skew:f pct_zero:f pct_negative:f lag_corr:f",
    """WITH r AS (SELECT cell_name, Daily_Damage_Increment AS t, lag(Daily_Damage_Increment) OVER (PARTITION BY cell_name ORDER BY Date_Day) AS b
  FROM v_rul),
g AS (SELECT r.*, avg(t) OVER (PARTITION BY cell_name) AS mu FROM r UNION ALL SELECT NULL, t, b, avg(t) OVER () FROM r)
SELECT cell_name, count(t) AS n, avg(t) AS mean, quantile_cont(t, 0.5) AS median, stddev_samp(t) AS std, min(t) AS min, max(t) AS max,
  avg(pow(t - mu, 3)) / pow(avg(pow(t - mu, 2)), 1.5) AS skew, 100.0 * count(*) FILTER (t = 0) / count(t) AS pct_zero,
  100.0 * count(*) FILTER (t < 0) / count(t) AS pct_negative, corr(t, b) AS lag_corr FROM g GROUP BY 1""",
)
def _(spark, sf):
    return Z.target_profile(rul_days(spark, sf), "Daily_Damage_Increment")


@query(
    "w31_prefailure_window",
    "cell_name Date_Day:d n_curves:i median_curves:f is_low_coverage:b",
    """SELECT *, n_curves < 0.5 * median_curves AS is_low_coverage FROM (
  SELECT cell_name, Date_Day, n_curves, max(Date_Day) OVER (PARTITION BY cell_name) AS last_day,
    quantile_cont(n_curves, 0.5) OVER (PARTITION BY cell_name) AS median_curves FROM v_for) WHERE Date_Day > last_day - 5""",
)
def _(spark, sf):
    return Z.prefailure_window(forensic_days(spark, sf))


view(
    "v_xcorr",
    """SELECT a.cell_name, k AS lag, corr(a.t, b.inc) AS corr
FROM (SELECT cell_name, Daily_Max_Temp_C AS t, row_number() OVER (PARTITION BY cell_name ORDER BY Date_Day) AS rn FROM v_for) a
JOIN (SELECT unnest(range(11)) AS k) ON true
LEFT JOIN (SELECT cell_name, Daily_Damage_Increment AS inc, row_number() OVER (PARTITION BY cell_name ORDER BY Date_Day) AS rn FROM v_for) b
  ON a.cell_name = b.cell_name AND b.rn = a.rn + k GROUP BY 1, 2""",
)


@query("w32_lagged_cross_correlation", "cell_name lag:i corr:f", "SELECT * FROM v_xcorr")
def _(spark, sf):
    return Z.lagged_cross_correlation(forensic_days(spark, sf))


@query(
    "w32_best_lag",
    "cell_name best_lag:i best_corr:f",
    """SELECT cell_name, lag AS best_lag, corr AS best_corr FROM (
  SELECT *, row_number() OVER (PARTITION BY cell_name ORDER BY abs(corr) DESC, lag) AS r FROM v_xcorr) WHERE r = 1""",
)
def _(spark, sf):
    return Z.best_lag(Z.lagged_cross_correlation(forensic_days(spark, sf)))


FLAGS = """
SELECT *, coalesce(max_jump > 0.2, false) AS sudden_collapse,
  coalesce(peer_thermal_dose_35 > 0 AND thermal_dose_35 > peer_thermal_dose_35 * 1.3, false) AS thermal_dose_stress,
  coalesce(peer_pce_early_mean > 0 AND pce_early_mean < peer_pce_early_mean * 0.85, false) AS low_initial_pce,
  coalesce(peer_pce_std > 0 AND pce_std < peer_pce_std * 0.6, false) AS low_pce_variance,
  coalesce(recovery_pct < 30, false) AS monotonic_degradation
FROM (SELECT *, (sum(thermal_dose_35) OVER () - thermal_dose_35) / (count(*) OVER () - 1) AS peer_thermal_dose_35,
  (sum(pce_early_mean) OVER () - pce_early_mean) / (count(*) OVER () - 1) AS peer_pce_early_mean,
  (sum(pce_std) OVER () - pce_std) / (count(*) OVER () - 1) AS peer_pce_std FROM (
  SELECT cell_name, max(Daily_Damage_Increment) AS max_jump, sum(greatest(0, Daily_Max_Temp_C - 35)) AS thermal_dose_35,
    avg(PCE) FILTER (Exposure_Days <= 10) AS pce_early_mean, stddev_samp(PCE) FILTER (Exposure_Days <= 10) AS pce_std,
    100.0 * count(*) FILTER (Daily_Damage_Increment < -0.001) / count(*) AS recovery_pct FROM v_for GROUP BY 1))
"""


@query(
    "p21_failure_evidence",
    "cell_name sudden_collapse:b thermal_dose_stress:b low_initial_pce:b low_pce_variance:b monotonic_degradation:b mode "
    "confidence recommendation",
    f"""SELECT *, CASE r WHEN 1 THEN 'Thermal-dose-driven sudden collapse' WHEN 2 THEN 'Sudden collapse of an intrinsically weak cell'
    WHEN 3 THEN 'Sudden structural collapse (mechanism unknown)' WHEN 4 THEN 'Intrinsically weak cell with low starting performance'
    WHEN 5 THEN 'No anomaly detected with current diagnostic rules' ELSE 'Anomalous behavior (unspecified)' END AS mode,
  CASE r WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'medium' WHEN 4 THEN 'medium' ELSE 'low' END AS confidence,
  CASE r WHEN 1 THEN 'thermal_management' WHEN 2 THEN 'manufacturing_inspection' WHEN 3 THEN 'hardware_inspection'
    WHEN 4 THEN 'exclude_from_reference' WHEN 5 THEN 'none' ELSE 'enlarge_cohort' END AS recommendation
FROM (SELECT *, CASE WHEN sudden_collapse AND thermal_dose_stress THEN 1 WHEN sudden_collapse AND low_initial_pce THEN 2
    WHEN sudden_collapse THEN 3 WHEN low_initial_pce AND low_pce_variance THEN 4
    WHEN NOT (sudden_collapse OR thermal_dose_stress OR low_initial_pce OR low_pce_variance OR monotonic_degradation) THEN 5 END AS r
  FROM ({FLAGS}))""",
)
def _(spark, sf):
    return Z.failure_evidence(Z.device_metrics(forensic_days(spark, sf)))
