"""Trajectories: records, errors, blends and sweeps (closed-form motor)."""

from __future__ import annotations

from pyspark.sql import functions as F

from helioframe.config import PERSISTENCE_GRID, TRAJECTORY_PARAMETERS as PS
from helioframe.operators import features, trajectory as T
from helioframe.plans import daily_queries as D
from helioframe.plans.registry import query, view
from helioframe.plans.stages import staged
from helioframe.sources import fixtures

view(
    "v_sdrift",
    "SELECT h.cell_name, " + ", ".join(f"avg(r.{p}_Delta) AS loo_{p}" for p in PS)
    + " FROM (SELECT DISTINCT cell_name FROM v_state) h JOIN v_state r ON r.cell_name <> h.cell_name GROUP BY 1",
)
VAL = {"PCE": "PCE_mean", "FF": "FF", "Jsc": "Jsc", "Voc": "Voc"}
view(
    "v_traj",
    f"""SELECT *, least(14, n_future) AS n_evaluated, n_future < 14 AS is_truncated FROM (
  SELECT f.cell_name, h.anchor, f.Date_Day, f.Exposure_Days, row_number() OVER w AS step, least(30, count(*) OVER (PARTITION BY f.cell_name, h.anchor)) AS n_future,
    {', '.join(f'f.{p}_State * f.{p}_Init AS Actual_{p}' for p in PS)},
    {', '.join(f'greatest(0, h.{p}_State + row_number() OVER w * loo_{p}) * h.{p}_Init AS Pred_{p}' for p in PS)},
    {', '.join(f'h.{p}_State * h.{p}_Init AS Anchor_{p}' for p in PS)}
  FROM (SELECT s.*, a.anchor FROM v_state s, (SELECT unnest([3.0, 5.0, 7.0, 10.0, 14.0, 21.0, 28.0]) AS anchor) a
        WHERE s.Exposure_Days <= a.anchor QUALIFY row_number() OVER (PARTITION BY cell_name, a.anchor ORDER BY Exposure_Days DESC) = 1) h
  JOIN v_sdrift USING (cell_name)
  JOIN v_state f ON f.cell_name = h.cell_name AND f.Exposure_Days > h.Exposure_Days
  WINDOW w AS (PARTITION BY f.cell_name, h.anchor ORDER BY f.Date_Day))
WHERE step <= 30 AND n_future >= 3""",
)


@staged
def state(spark, sf):
    return D.states(spark, sf)


@staged
def forecast(spark, sf):
    s = state(spark, sf)
    return T.drift_motor(T.trajectory_units(s, T.ANCHORS), s)


ACT = " ".join(f"Actual_{p}:f" for p in PS) + " " + " ".join(f"Pred_{p}:f" for p in PS)


@query(
    "f12_drift_trajectories",
    f"cell_name anchor:f step:i Date_Day:d is_truncated:b n_future:i n_evaluated:i {ACT}",
    "SELECT * FROM v_traj",
)
def _(spark, sf):
    return forecast(spark, sf)


view(
    "v_trec",
    f"""WITH i AS (SELECT cell_name, max(n_future) AS n, max(n_evaluated) AS e, bool_or(is_truncated) AS t FROM v_traj WHERE anchor = 14 GROUP BY 1)
SELECT cell_name, Date_Day, Exposure_Days, 'Calibration' AS Phase, n AS Forecast_Horizon_Used, e AS Evaluation_Horizon_Used, t AS Forecast_Truncated,
  {', '.join(f'{p}_State * {p}_Init AS Actual_{p}' for p in PS)}, {', '.join(f'NULL::DOUBLE AS Pred_{p}' for p in PS)}
FROM v_state JOIN i USING (cell_name) WHERE Exposure_Days <= 14
UNION ALL SELECT cell_name, Date_Day, Exposure_Days, 'Forecast', n, e, t, {', '.join(f'Actual_{p}' for p in PS)}, {', '.join(f'Pred_{p}' for p in PS)}
FROM v_traj JOIN i USING (cell_name) WHERE anchor = 14""",
)


@staged
def records(spark, sf):
    f = forecast(spark, sf).where("anchor = 14")  # smoothed levels, as the forecast starts from
    return T.trajectory_records(state(spark, sf), f, 14.0)


@query(
    "f13_trajectory_records",
    f"cell_name Date_Day:d Exposure_Days:f Phase Forecast_Horizon_Used:i Evaluation_Horizon_Used:i Forecast_Truncated:b {ACT}",
    "SELECT * FROM v_trec",
)
def _(spark, sf):
    return records(spark, sf)


LONG = " UNION ALL ".join(
    f"SELECT cell_name, anchor, step, is_truncated, '{p}' AS parameter, Actual_{p} AS actual, Pred_{p} AS motor, Anchor_{p} AS persistence FROM v_traj WHERE step <= 14" for p in PS
)
view("v_tlong", LONG)
view(
    "v_tmae",
    """SELECT anchor, parameter, avg(mae) AS mae_mean, stddev_samp(mae) / sqrt(count(*)) AS mae_se, count(*) AS n_cells FROM (
  SELECT anchor, parameter, cell_name, avg(abs(motor - actual)) AS mae FROM v_tlong WHERE NOT is_truncated GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)


@query("f15_trajectory_mae", "anchor:f parameter mae_mean:f mae_se:f n_cells:i", "SELECT * FROM v_tmae")
def _(spark, sf):
    return T.trajectory_mae(forecast(spark, sf))


view(
    "v_blend",
    f"""SELECT parameter, k, avg(mae) AS mae FROM (
  SELECT parameter, k, cell_name, avg(abs((1 - k) * motor + k * persistence - actual)) AS mae
  FROM v_tlong, (SELECT unnest({PERSISTENCE_GRID}) AS k) WHERE anchor = 14 GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)


@query("f14_persistence_blend_sweep", "parameter k:f mae:f", "SELECT * FROM v_blend")
def _(spark, sf):
    return T.persistence_blend_sweep(forecast(spark, sf).where("anchor = 14"))


@query(
    "f14_adopted_blend",
    "parameter mae_0:f k_star:f mae_star:f k_adopted:f",
    """SELECT *, CASE WHEN mae_0 > 0 AND (mae_0 - mae_star) / mae_0 >= 0.02 THEN k_star ELSE 0 END AS k_adopted FROM (
  SELECT parameter, max(mae) FILTER (k = 0) AS mae_0, arg_min(k, round(mae, 12)) AS k_star, min(mae) AS mae_star FROM v_blend GROUP BY 1)""",
)
def _(spark, sf):
    return T.adopt_blend(T.persistence_blend_sweep(forecast(spark, sf).where("anchor = 14")))


@query(
    "f16_anchor_verdict",
    "parameter best_anchor:f best_mae:f min_usable_anchor:f",
    """WITH ok AS (SELECT *, row_number() OVER (PARTITION BY parameter ORDER BY mae_mean, anchor) AS r FROM v_tmae WHERE n_cells >= 3 AND mae_mean IS NOT NULL),
b AS (SELECT parameter, anchor AS best_anchor, mae_mean AS best_mae, coalesce(mae_se, 0) AS se FROM ok WHERE r = 1)
SELECT parameter, max(best_anchor) AS best_anchor, max(best_mae) AS best_mae, min(anchor) AS min_usable_anchor
FROM ok JOIN b USING (parameter) WHERE mae_mean <= best_mae + se GROUP BY 1""",
)
def _(spark, sf):
    return T.anchor_verdict(T.trajectory_mae(forecast(spark, sf)))


def _win(w: int) -> str:
    """Trajectory error at the 14-day anchor with another smoothing window."""
    r = f"(PARTITION BY cell_name ORDER BY Date_Day ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    o = "(PARTITION BY cell_name ORDER BY Date_Day)"
    init = ", ".join(f"avg({VAL[p]}) FILTER (day_no <= 3) OVER (PARTITION BY cell_name) AS {p}_Init" for p in PS)
    st = ", ".join(f"avg({VAL[p]} / ({p}_Init + 1e-9)) OVER {r} AS {p}_State" for p in PS)
    delta = ", ".join(f"{p}_State - lag({p}_State) OVER {o} AS {p}_Delta" for p in PS)
    drift = ", ".join(f"avg(r.{p}_Delta) AS loo_{p}" for p in PS)
    longs = " UNION ALL ".join(
        f"SELECT cell_name, '{p}' AS parameter, abs(greatest(0, {p}_State + step * loo_{p}) * {p}_Init - act_{p}) AS e, n FROM j" for p in PS
    )
    return f"""(WITH s AS (SELECT * FROM (SELECT *, {delta} FROM (SELECT *, {st} FROM (SELECT *, {init} FROM (
    SELECT *, row_number() OVER {o} AS day_no FROM v_day)))) WHERE PCE_Delta IS NOT NULL AND FF_Delta IS NOT NULL AND Jsc_Delta IS NOT NULL AND Voc_Delta IS NOT NULL),
d AS (SELECT h.cell_name, {drift} FROM (SELECT DISTINCT cell_name FROM s) h JOIN s r ON r.cell_name <> h.cell_name GROUP BY 1),
h AS (SELECT * FROM s WHERE Exposure_Days <= 14 QUALIFY row_number() OVER (PARTITION BY cell_name ORDER BY Exposure_Days DESC) = 1),
j AS (SELECT h.*, d.* EXCLUDE (cell_name), {', '.join(f'f.{p}_State * f.{p}_Init AS act_{p}' for p in PS)},
    row_number() OVER (PARTITION BY h.cell_name ORDER BY f.Date_Day) AS step, count(*) OVER (PARTITION BY h.cell_name) AS n
  FROM h JOIN d USING (cell_name) JOIN s f ON f.cell_name = h.cell_name AND f.Exposure_Days > h.Exposure_Days QUALIFY step <= 14),
c AS (SELECT parameter, cell_name, avg(e) AS mae FROM ({longs}) WHERE n >= 14 GROUP BY 1, 2)
SELECT {w} AS "window", parameter, avg(mae) AS mae_mean, stddev_samp(mae) / sqrt(count(*)) AS mae_se, count(*) AS n_cells FROM c GROUP BY 2)"""


view("v_windows", " UNION ALL ".join(_win(w) for w in T.WINDOWS))


@staged
def window_table(spark, sf):
    from helioframe.functions.stages import settle

    d = settle(features.daily_trajectory(features.with_exposure(fixtures.curve_rows(spark, sf))))
    out = None
    for w in T.WINDOWS:
        s = features.normalised_state(d, PS, w)
        m = T.trajectory_mae(T.drift_motor(T.trajectory_units(s, [14.0]), s)).withColumn("window", F.lit(w))
        out = m if out is None else out.unionByName(m)
    return out


@query("f16_window_sweep", "window:i parameter mae_mean:f mae_se:f n_cells:i", "SELECT * FROM v_windows")
def _(spark, sf):
    return window_table(spark, sf)


@query(
    "f16_window_verdict",
    "parameter best_window:i best_mae:f prod_mae:f verdict",
    """SELECT *, CASE WHEN abs(best_mae - prod_mae) < prod_se THEN 'indistinguishable' WHEN best_mae < prod_mae THEN 'best_beats_production'
  ELSE 'production_optimal' END AS verdict FROM (
  SELECT parameter, arg_min("window", mae_mean) AS best_window, min(mae_mean) AS best_mae, max(mae_mean) FILTER ("window" = 7) AS prod_mae,
    max(coalesce(mae_se, 0)) FILTER ("window" = 7) AS prod_se FROM v_windows WHERE n_cells >= 3 GROUP BY 1) WHERE prod_mae IS NOT NULL""",
)
def _(spark, sf):
    return T.window_verdict(window_table(spark, sf))


@query(
    "j17_exposure_fill_join",
    "cell_name Date_Day:d Phase Exposure_Days:f",
    """SELECT r.cell_name, r.Date_Day, r.Phase, coalesce(k.Exposure_Days, b.base + date_diff('day', b.base_day, r.Date_Day)) AS Exposure_Days
FROM v_trec r LEFT JOIN (SELECT * FROM v_day WHERE PCE_mean > 8) k ON r.cell_name = k.cell_name AND r.Date_Day = k.Date_Day
LEFT JOIN (SELECT cell_name, max(Exposure_Days) AS base, max(Date_Day) AS base_day FROM v_day WHERE PCE_mean > 8 AND Exposure_Days <= 14 GROUP BY 1) b ON r.cell_name = b.cell_name""",
)
def _(spark, sf):
    daily = features.daily_trajectory(features.with_exposure(fixtures.curve_rows(spark, sf)))
    measured = daily.where(F.col("PCE") > 8)  # days with little output stand for missing ones
    return T.exposure_fill(records(spark, sf), measured, 14.0)


@query(
    "f19_truncation_info",
    "cell_name is_truncated:b horizon_used:i last_truth_day:d",
    """SELECT cell_name, bool_or(Forecast_Truncated) AS is_truncated, max(Forecast_Horizon_Used) AS horizon_used,
  max(Date_Day) FILTER (Actual_PCE IS NOT NULL) AS last_truth_day FROM v_trec GROUP BY 1""",
)
def _(spark, sf):
    return T.truncation_info(records(spark, sf))


@query(
    "w16_exposure_quartile_error",
    "bin:i n:i mae:f lo:f hi:f",
    """WITH t AS (SELECT * FROM v_traj WHERE anchor = 7 AND step <= 14),
q AS (SELECT quantile_cont(Exposure_Days, 0.25) AS e1, quantile_cont(Exposure_Days, 0.5) AS e2, quantile_cont(Exposure_Days, 0.75) AS e3 FROM t)
SELECT CASE WHEN Exposure_Days <= e1 THEN 1 WHEN Exposure_Days <= e2 THEN 2 WHEN Exposure_Days <= e3 THEN 3 ELSE 4 END AS bin, count(*) AS n,
  avg(abs(Pred_PCE - Actual_PCE)) AS mae, min(Exposure_Days) AS lo, max(Exposure_Days) AS hi FROM t, q GROUP BY 1""",
)
def _(spark, sf):
    return T.exposure_quartile_error(forecast(spark, sf).where("anchor = 7 and step <= 14"), "Pred_PCE", "Actual_PCE")
