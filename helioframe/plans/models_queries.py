"""Model-based operators.

Boosters and forests have the rounds and trees of ``config``.  What SQL can express
of an operator (folds, gates, closed-form fits, residual statistics) is checked;
fits are rows-only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from helioframe.config import DAMAGE_FEATURES, TRAJECTORY_PARAMETERS, TWIN_FEATURES
from helioframe.functions import expr as X
from helioframe.functions.stages import settle, shared_folder
from helioframe.operators import curves, features, forecast as P, models as M, production as K, screening as S, shapes as H, surrogates as R, trajectory as T, validation as V
from helioframe.plans import daily_queries as D, forecast_queries as FQ, screening_queries as Q, sweeps_queries as SQ, trajectory_queries as TQ
from helioframe.plans.lifetime_queries import lifetimes
from helioframe.plans.registry import query, view
from helioframe.plans.stages import staged
from helioframe.sources import fixtures

BRANCH = 50  # points per branch of a sweep's shape


@staged
def twin_features(spark, sf):
    """Screening rows with rates, doses and cyclic time."""
    rows = features.with_rates_and_doses(fixtures.curve_rows(spark, sf))
    extra = rows.select("cell_name", "curve", "Delta_Temp_C_per_h", "Delta_Hum_g_m3_per_h", *[e.alias(n) for n, e in X.cyclic_time("Timestamp").items()])
    return Q.twin(spark, sf).join(extra, ["cell_name", "curve"]).dropna(subset=TWIN_FEATURES)


@query("m10_healthy_twin", "event_id:i PCE_Pred:f pFF_Pred:f Under_PCE:f Under_pFF:f Alert_PCE:b Alert_pFF:b Digital_Twin_Alert:b")
def _(spark, sf):
    return M.healthy_twin(twin_features(spark, sf))


@query("m12_loocv_gate_boosted", "cell_name n:i alert_pct:f verdict")
def _(spark, sf):
    return twin_gate(spark, sf)


GATE = """
WITH l AS (SELECT t.cell_name, in_action_window, is_mature, a_PCE + b_PCE * ModuleTemp_C - PCE_Relative AS u1, a_pFF + b_pFF * ModuleTemp_C - pFF_Relative AS u2
  FROM v_twin t JOIN v_loo USING (cell_name) WHERE is_healthy),
r AS (SELECT f.cell_name, greatest(quantile_cont(abs(a_PCE + b_PCE * ModuleTemp_C - PCE_Relative), 0.98), 0.01) AS t1,
    greatest(quantile_cont(abs(a_pFF + b_pFF * ModuleTemp_C - pFF_Relative), 0.98), 0.01) AS t2
  FROM v_loo f JOIN v_twin t ON t.cell_name <> f.cell_name WHERE is_healthy AND is_mature GROUP BY 1)
SELECT *, CASE WHEN n = 0 THEN 'NO_DATA' WHEN alert_pct > 25 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM (
  SELECT l.cell_name, count(*) AS n, 100.0 * avg(CAST(u1 > t1 OR u2 > t2 AS INT)) AS alert_pct FROM l JOIN r USING (cell_name) WHERE in_action_window GROUP BY 1)
"""


@query("m12_loocv_gate", "cell_name n:i alert_pct:f verdict", GATE)
def _(spark, sf):
    return linear_gate(Q.twin(spark, sf))


def linear_gate(rows):
    """Gate with closed-form fits; thresholds are residual quantiles of each fold's training rows."""
    m = ["PCE", "pFF"]
    fits = settle(S.leave_one_out_fit(S.fit_sums(rows, m), m))
    base = rows.where("is_healthy AND is_mature").select("cell_name", "ModuleTemp_C", *[f"{x}_Relative" for x in m])
    # Leave-one-out needs every training row once per fold; folds are the devices of the cohort.
    line = F.struct(F.col("cell_name").alias("fold"), *[f"{k}_{x}" for x in m for k in "ab"])
    lines = fits.agg(F.collect_list(line).alias("lines"))
    folds = base.crossJoin(F.broadcast(lines)).select("*", F.explode("lines").alias("l")).select(*base.columns, "l.*")  # one row
    folds = folds.where(F.col("cell_name") != F.col("fold"))
    res = folds.select("fold", *[F.abs(F.col(f"a_{x}") + F.col(f"b_{x}") * F.col("ModuleTemp_C") - F.col(f"{x}_Relative")).alias(x) for x in m])
    thr = S.residual_threshold(res.unpivot(["fold"], m, "metric", "r"), "r", ["fold", "metric"])
    thr = thr.groupBy(F.col("fold").alias("cell_name")).agg(*[F.max(F.when(F.col("metric") == x, F.col("layered"))).alias(f"thr_{x}") for x in m])
    held = S.predict(rows.where("is_healthy AND in_action_window"), fits, m).join(thr, "cell_name")
    hit = (F.col("Under_PCE") > F.col("thr_PCE")) | (F.col("Under_pFF") > F.col("thr_pFF"))
    g = held.groupBy("cell_name").agg(F.count("*").alias("n"), (100.0 * F.avg(hit.cast("double"))).alias("alert_pct"))
    return g.withColumn("verdict", M.gate_verdict())


@query(
    "m13_burn_in_grid",
    "window:f n_folds:i mae_mean:f mae_se:f",
    """WITH e AS (SELECT w, cell_name, ModuleTemp_C AS x, PCE_Relative AS y FROM v_twin, (SELECT unnest([5.0, 7.0, 10.0, 14.0, 21.0, 28.0, 35.0]) AS w)
  WHERE combined_survival_days > w AND Exposure_Days > w),
f AS (SELECT h.w, h.cell_name, regr_slope(t.y, t.x) AS b, regr_intercept(t.y, t.x) AS a FROM (SELECT DISTINCT w, cell_name FROM e) h
  JOIN e t ON t.w = h.w AND t.cell_name <> h.cell_name GROUP BY 1, 2)
SELECT w AS "window", count(*) AS n_folds, avg(m) AS mae_mean, stddev_samp(m) / sqrt(count(*)) AS mae_se FROM (
  SELECT e.w, e.cell_name, avg(abs(a + b * x - y)) AS m FROM e JOIN f ON e.w = f.w AND e.cell_name = f.cell_name GROUP BY 1, 2) GROUP BY 1""",
)
def _(spark, sf):
    return M.burn_in_grid(Q.twin(spark, sf))


@query(
    "m13_burn_in_grid_boosted",
    "window:f n_devices:i n_folds_PCE:i n_folds_pFF:i thr_PCE:f thr_pFF:f mae_PCE:f se_PCE:f mae_pFF:f se_pFF:f",
)
def _(spark, sf):
    return M.burn_in_grid_fitted(twin_features(spark, sf))


@query(
    "m14_production_contract",
    "schema_version:i burn_in_days:f production thr_PCE:f thr_pFF:f",
    """SELECT 3 AS schema_version, 14.0 AS burn_in_days, (SELECT coalesce(string_agg(cell_name, ',' ORDER BY cell_name) FILTER (
  combined_survival_days > 14 AND alert_freq_pct <= 25), '') FROM v_summary) AS production, thr_PCE, thr_pFF FROM v_thr""",
)
def _(spark, sf):
    p = Q.predicted(spark, sf)
    c = S.production_cohort(Q.summary(spark, sf)).select("production")
    t = S.thresholds(p, Q.CH).crossJoin(F.broadcast(c))  # two one-row tables
    return t.select(F.lit(3).alias("schema_version"), F.lit(14.0).alias("burn_in_days"), "production", "thr_PCE", "thr_pFF")


@staged
def twin_gate(spark, sf):
    return M.loocv_gate(twin_features(spark, sf))


@query("m14_production_scores", "cell_name curve:i PCE_Pred:f pFF_Pred:f Under_PCE:f Under_pFF:f Alert_PCE:b Alert_pFF:b Digital_Twin_Alert:b")
def _(spark, sf):
    """All screening rows, scored by the production model that was fitted, stored and loaded again."""
    rows = twin_features(spark, sf)
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    K.save(K.fit(rows, twin_gate(spark, sf)), path)
    return K.score(K.load(spark, path), rows)


@query("m15_damage_increment_model", "cell_name Date_Day:d Daily_Damage_Increment:f prediction:f")
def _(spark, sf):
    d = D.rul_days(spark, sf)
    return M.damage_increment_model(d).transform(M.assemble(d, DAMAGE_FEATURES))


@query("m16_trajectory_models", "parameter feature importance:f")
def _(spark, sf):
    models = M.trajectory_models(TQ.state(spark, sf))
    out = None
    for p in TRAJECTORY_PARAMETERS:
        part = M.split_gain_importance(models[p], spark, M.state_features(p)).withColumn("parameter", F.lit(p))
        out = part if out is None else out.unionByName(part)
    return out


@query("m17_model_zoo_cv", "scheme model n:i mae:f rmse:f medae:f r2:f")
def _(spark, sf):
    return M.model_zoo_cv(D.rul_days(spark, sf))


@query("m18_permutation_importance", "feature importance:f std:f")
def _(spark, sf):
    d = D.rul_days(spark, sf)
    return M.permutation_importance(d, M.damage_increment_model(d), "Daily_Damage_Increment", DAMAGE_FEATURES)


@query("m19_split_gain_importance", "feature importance:f")
def _(spark, sf):
    d = D.rul_days(spark, sf)
    return M.split_gain_importance(M.damage_increment_model(d), spark, DAMAGE_FEATURES)


# The audit of the daily models: one stored table of out-of-fold predictions, and what follows from it.


@staged
def out_of_fold(spark, sf):
    jobs = [lambda: V.out_of_fold(D.rul_days(spark, sf), V.damage_targets()), lambda: V.out_of_fold(TQ.state(spark, sf), V.trajectory_targets())]
    damage, state = M.in_parallel(spark, jobs)
    return damage.unionByName(state)


FOLD_SCORES = "target scheme model n_folds:i n:i " + " ".join(f"{m}_{s}:f" for m in V.METRICS for s in ("mean", "std"))


@query("m17_fold_scores", FOLD_SCORES)
def _(spark, sf):
    return V.fold_scores(out_of_fold(spark, sf))


def _audited(name, label, features, table):
    known = " AND ".join(f"{c} IS NOT NULL" for c in (label, *features))
    return f"SELECT '{name}' AS target, cell_name, Date_Day, {label} AS y, {features[-1]} AS own_lag FROM {table} WHERE {known}"


view(
    "v_audited",
    " UNION ALL ".join(
        _audited(t.name, t.label, t.features, v)
        for ts, v in ((V.damage_targets(), "v_rul"), (V.trajectory_targets(), "v_state"))
        for t in ts
    ),
)
view(
    "v_folded",
    " UNION ALL ".join(
        f"SELECT target, '{s}' AS scheme, CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % 5 AS fold, y FROM v_audited"
        for s, key in (("shuffled", "cell_name || '|' || strftime(Date_Day, '%Y-%m-%d')"), ("grouped", "cell_name"))
    ),
)


@query(
    "m17_dummy_scores",
    FOLD_SCORES,
    """WITH f AS (SELECT h.target, h.scheme, h.fold, avg(t.y) AS dummy_mean, quantile_cont(t.y, 0.5) AS dummy_median
  FROM (SELECT DISTINCT target, scheme, fold FROM v_folded) h JOIN v_folded t ON t.target = h.target AND t.scheme = h.scheme AND t.fold <> h.fold GROUP BY 1, 2, 3),
p AS (SELECT target, scheme, fold, y, 'dummy_mean' AS model, dummy_mean AS p FROM v_folded JOIN f USING (target, scheme, fold)
  UNION ALL SELECT target, scheme, fold, y, 'dummy_median', dummy_median FROM v_folded JOIN f USING (target, scheme, fold)),
s AS (SELECT target, scheme, model, fold, count(*) AS n, avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse, quantile_cont(abs(p - y), 0.5) AS medae,
  CASE WHEN min(y) < max(y) THEN 1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)) END AS r2 FROM p GROUP BY 1, 2, 3, 4)
SELECT target, scheme, model, count(*) AS n_folds, sum(n) AS n, avg(mae) AS mae_mean, stddev_pop(mae) AS mae_std, avg(rmse) AS rmse_mean, stddev_pop(rmse) AS rmse_std,
  avg(medae) AS medae_mean, stddev_pop(medae) AS medae_std, avg(r2) AS r2_mean, stddev_pop(r2) AS r2_std FROM s GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    """Folds, dummies and measures alone; the same code scores every model of ``m17_fold_scores``."""
    return V.fold_scores(V.dummies(settle(V.by_scheme(audited(spark, sf)))))


def audited(spark, sf):
    return V.long_rows(D.rul_days(spark, sf), V.damage_targets()).unionByName(V.long_rows(TQ.state(spark, sf), V.trajectory_targets()))


@query("m20_device_errors", "target scheme cell_name n:i mae:f bias:f")
def _(spark, sf):
    return V.device_errors(out_of_fold(spark, sf))


@query("m20_residual_correlations", "target scheme feature corr:f")
def _(spark, sf):
    oof = out_of_fold(spark, sf)
    damage = V.residual_correlations(oof, D.rul_days(spark, sf), V.damage_targets())
    return damage.unionByName(V.residual_correlations(oof, TQ.state(spark, sf), V.trajectory_targets()))


@query("m20_overfit_gap", "target mae_cv:f mae_train:f gap:f is_overfit:b")
def _(spark, sf):
    return V.overfit_gap(out_of_fold(spark, sf))


@query("m21_target_verdicts", "target best_model best_mae:f baseline_mae:f gain_pct:f verdict lag_corr:f lag_verdict")
def _(spark, sf):
    return V.signal_verdicts(V.fold_scores(out_of_fold(spark, sf)), V.lag_correlations(audited(spark, sf)))


@query("m21_lag_correlations", "target lag_corr:f", "SELECT target, corr(y, own_lag) AS lag_corr FROM v_audited GROUP BY 1")
def _(spark, sf):
    return V.lag_correlations(audited(spark, sf))


@query("w16_phase_errors", "target bin:i n:i mae:f lo:f hi:f")
def _(spark, sf):
    return V.phase_errors(out_of_fold(spark, sf))


RES_FEATURES = ["POA_Irradiance_W_m2", "ModuleTemp_C", "AbsoluteHumidity_g_m3"]
MET = ", ".join(f"corr(Under_PCE, {f}) AS c_{i}" for i, f in enumerate(RES_FEATURES))


@query(
    "m20_residual_diagnostics",
    "cell_name n:i bias:f mae_in:f mae_out:f overfit_gap_pct:f is_overfit:b c_0:f c_1:f c_2:f",
    f"""SELECT *, 100 * (mae_out - mae_in) / nullif(mae_out, 0) AS overfit_gap_pct, coalesce(100 * (mae_out - mae_in) / nullif(mae_out, 0) > 30, false) AS is_overfit FROM (
  SELECT cell_name, count(*) AS n, avg(Under_PCE) AS bias, avg(abs(Under_PCE)) AS mae_in, {MET} FROM v_pred WHERE is_healthy AND is_mature GROUP BY 1)
JOIN (SELECT t.cell_name, avg(abs(a_PCE + b_PCE * ModuleTemp_C - PCE_Relative)) AS mae_out FROM v_twin t JOIN v_loo USING (cell_name)
  WHERE is_healthy AND is_mature GROUP BY 1) USING (cell_name)""",
)
def _(spark, sf):
    rows = Q.twin(spark, sf)
    ins = Q.predicted(spark, sf).where("is_healthy AND is_mature").groupBy("cell_name").agg(
        F.count("*").alias("n"), F.avg("Under_PCE").alias("bias"), F.avg(F.abs("Under_PCE")).alias("mae_in"),
        *[X.correlation("Under_PCE", f).alias(f"c_{i}") for i, f in enumerate(RES_FEATURES)],
    )
    fits = S.leave_one_out_fit(S.fit_sums(rows, ["PCE"]), ["PCE"])
    out = S.predict(rows.where("is_healthy AND is_mature"), fits, ["PCE"]).groupBy("cell_name").agg(F.avg(F.abs("Under_PCE")).alias("mae_out"))
    gap = 100.0 * (F.col("mae_out") - F.col("mae_in")) / F.nullif(F.col("mae_out"), F.lit(0.0))
    return ins.join(out, "cell_name").withColumn("overfit_gap_pct", gap).withColumn("is_overfit", F.coalesce(gap > 30.0, F.lit(False)))


SCORES = """
SELECT 'dummy_mean' AS model, avg(abs(y - m)) AS mae FROM (SELECT Daily_Damage_Increment AS y, v AS m FROM v_rul JOIN v_vel USING (cell_name))
UNION ALL SELECT 'dummy_zero', avg(abs(Daily_Damage_Increment)) FROM v_rul
UNION ALL SELECT 'persistence', avg(abs(y - p)) FROM (SELECT Daily_Damage_Increment AS y,
  coalesce(lag(Daily_Damage_Increment) OVER (PARTITION BY cell_name ORDER BY Date_Day), 0) AS p FROM v_rul)
"""


@query(
    "m21_signal_verdict",
    "best_model best_dummy best_mae:f dummy_mae:f gain_pct:f verdict",
    f"""WITH s AS ({SCORES}), b AS (SELECT arg_min(model, mae) AS best_model, min(mae) AS best_mae, arg_min(model, mae) FILTER (model LIKE 'dummy%') AS best_dummy,
  min(mae) FILTER (model LIKE 'dummy%') AS dummy_mae FROM s)
SELECT *, 100 * (dummy_mae - best_mae) / dummy_mae AS gain_pct, CASE WHEN best_model LIKE 'dummy%' THEN 'no_signal'
  WHEN 100 * (dummy_mae - best_mae) / dummy_mae < 3 THEN 'negligible' WHEN 100 * (dummy_mae - best_mae) / dummy_mae < 10 THEN 'weak' ELSE 'useful' END AS verdict FROM b""",
)
def _(spark, sf):
    from pyspark.sql import Window as W

    d = D.rul_days(spark, sf)
    y = F.col("Daily_Damage_Increment")
    before = F.coalesce(F.lag(y).over(W.partitionBy("cell_name").orderBy("Date_Day")), F.lit(0.0))
    v = P.loo_mean(d, ["Daily_Damage_Increment"])
    s = d.withColumn("p", before).join(v, "cell_name").agg(
        F.avg(F.abs(y - F.col("loo_Daily_Damage_Increment"))).alias("dummy_mean"), F.avg(F.abs(y)).alias("dummy_zero"), F.avg(F.abs(y - F.col("p"))).alias("persistence")
    )
    return signal_verdict(s.unpivot([], ["dummy_mean", "dummy_zero", "persistence"], "model", "mae"))


def signal_verdict(scores):
    dummy = F.col("model").startswith("dummy")
    b = scores.agg(
        F.min_by("model", "mae").alias("best_model"), F.min("mae").alias("best_mae"),
        F.min_by("model", F.when(dummy, F.col("mae"))).alias("best_dummy"), F.min(F.when(dummy, F.col("mae"))).alias("dummy_mae"),
    )
    gain = 100.0 * (F.col("dummy_mae") - F.col("best_mae")) / F.nullif(F.col("dummy_mae"), F.lit(0.0))
    v = F.when(F.col("best_model").startswith("dummy"), "no_signal").when(gain < 3, "negligible").when(gain < 10, "weak").otherwise("useful")
    return b.withColumn("gain_pct", gain).withColumn("verdict", v)


@query("m22_feature_ablation", "feature n_folds:i mae_baseline:f mae_other:f delta_mean:f delta_se:f verdict")
def _(spark, sf):
    return M.feature_ablation(D.rul_days(spark, sf))


@query(
    "m22_null_model",
    "cell_name mae:f n:i",
    """SELECT h.cell_name, avg(abs(med - h.Daily_Damage_Increment)) AS mae, count(*) AS n FROM v_rul h JOIN (
  SELECT c.cell_name, quantile_cont(r.Daily_Damage_Increment, 0.5) AS med FROM (SELECT DISTINCT cell_name FROM v_rul) c
  JOIN v_rul r ON r.cell_name <> c.cell_name GROUP BY 1) USING (cell_name) GROUP BY 1""",
)
def _(spark, sf):
    return M.null_model_error(D.rul_days(spark, sf), "Daily_Damage_Increment")


RULES = "cell_name n:i n_positive:i day:f outcome rule support:i share:f importance"


def alert_rows(spark, sf):
    """Early rows with the twin's alert, the physical features and the day of the cumulative alert share."""
    joined = Q.alerted(spark, sf).join(
        twin_features(spark, sf).select("cell_name", "curve", "Delta_Temp_C_per_h", "Delta_Hum_g_m3_per_h"), ["cell_name", "curve"]
    )
    days = S.threshold_day(S.cumulative_alert_pct(Q.alerted(spark, sf))).select("cell_name", "threshold_pct_day")
    return joined.where("in_action_window").join(days, "cell_name", "left")


def prodromal_rows(spark, sf):
    """Life of the devices that died within the burn-in, marked where the last days before that begin."""
    rows = twin_features(spark, sf).where(F.col("combined_survival_days") <= 14.0).where("Exposure_Days <= combined_survival_days")
    start = F.greatest(F.lit(0.0), F.col("combined_survival_days") - 3.0)
    return rows.withColumn("prodromal", F.col("Exposure_Days") >= start)


@query("m23_surrogate_rules_alerts", RULES)
def _(spark, sf):
    return R.rules(alert_rows(spark, sf), "Digital_Twin_Alert", "threshold_pct_day")


@query("m23_surrogate_rules_prodromal", RULES)
def _(spark, sf):
    return R.rules(prodromal_rows(spark, sf), "prodromal", "combined_survival_days")


WSTAT = " UNION ALL ".join(
    f"SELECT {w} AS \"window\", count(*) AS n, avg(Daily_Damage_Increment) AS mean, stddev_samp(Daily_Damage_Increment) AS std, "
    f"min(Daily_Damage_Increment) AS min, max(Daily_Damage_Increment) AS max FROM ({D._rul(w)})"
    for w in T.WINDOWS
)


@query("m24_window_signal_stats", "window:i n:i mean:f std:f min:f max:f", WSTAT)
def _(spark, sf):
    cur = settle(D.current(spark, sf))
    daily = settle(features.daily_rul_matrix(cur, 1))
    base = daily.drop("Instant_Loss", "Cumulative_Damage", "Cumulative_Damage_Lag1", "Daily_Damage_Increment", "Rolling_Irradiance", "Rolling_Thermal_load")
    out = None
    y = "Daily_Damage_Increment"
    for w in T.WINDOWS:
        m = features.damage_features(base, w).agg(
            F.lit(w).alias("window"), F.count("*").alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max")
        )
        out = m if out is None else out.unionByName(m)
    return out


@query("m24_window_signal_sweep", "window:i mae_model:f mae_mean:f gain_pct:f")
def _(spark, sf):
    return M.window_signal_sweep(settle(D.current(spark, sf)), T.WINDOWS)


@query("f04_roll_forward_batch", "cell_name anchor:i D0:f D_end:f n_future:i")
def _(spark, sf):
    none = "cell_name string, anchor int, D0 double, D_end double, n_future int"
    return M.blind(FQ.units(spark, sf), D.rul_days(spark, sf), M.damage_increment_model, M.roll_forward_batch, none)


@query("f12_trajectory_roll_forward", "cell_name anchor:f step:i Date_Day:d " + " ".join(f"Actual_{p}:f Pred_{p}:f" for p in TRAJECTORY_PARAMETERS))
def _(spark, sf):
    s = TQ.state(spark, sf)
    none = "cell_name string, anchor double, step int, Date_Day date, " + ", ".join(f"Actual_{p} double, Pred_{p} double" for p in TRAJECTORY_PARAMETERS)
    return M.blind(T.trajectory_units(s, [14.0]), s, M.trajectory_models, M.trajectory_roll_forward, none)


@query("f08_smoothing_window_sweep", "window:i mae_sensor:f mae_api:f mae_combined:f n_combinations:i")
def _(spark, sf):
    """Best local-grid error per smoothing window, with the constant-velocity engine."""
    # Neighbourhood of the calibrated point, 81 combinations.
    local = {"phi_0": [0.0015, 0.0025, 0.0035], "phi_1": [0.0015, 0.0025, 0.0035], "phi_2": [1.5], "lambda_w": [0.5],
             "mu": [0.1, 0.2, 0.3], "eps": [0.0], "k_blend": [0.1, 0.2, 0.3], "t_ref": [54.0]}
    daily = settle(D.rul(spark, sf, 1))
    base = daily.drop("Instant_Loss", "Cumulative_Damage", "Cumulative_Damage_Lag1", "Daily_Damage_Increment", "Rolling_Irradiance", "Rolling_Thermal_load")
    weather, life = FQ.weather(spark, sf), lifetimes(spark, sf)
    out = None
    for w in T.WINDOWS:
        d = settle(features.damage_features(base, w))
        u = settle(P.simulation_units(d, w))
        fut = P.calibrated_future(u, P.linear_calibration(d, weather), weather)
        cols = ["cell_name", "anchor", "Anchor_Day", "D0", "n_future"]
        b = fut.groupBy("cell_name", "anchor", "Anchor_Day", "D0").agg(F.count("*").cast("int").alias("n_future"))
        both = u.select(*cols).withColumn("Type", F.lit("Sensor")).unionByName(b.withColumn("Type", F.lit("API")))
        grid = P.coefficient_grid_search(P.constant_velocity(both, d), life, local)
        best = grid.agg(F.min_by(F.struct("mae_sensor", "mae_api", "mae_combined"), "mae_combined").alias("b"), F.count("*").alias("n_combinations"))
        part = settle(best.select(F.lit(w).alias("window"), "b.*", "n_combinations"))
        out = part if out is None else out.unionByName(part)
    return out


@query("m01_pca_fit_project", "vec_id:i pc1:f pc2:f")
def _(spark, sf):
    p, _ = M.pca_fit_project(fixtures.shapes(spark, sf), 5)
    return p.select("vec_id", F.col("scores")[0].alias("pc1"), F.col("scores")[1].alias("pc2"))


@query("m02_pca_components_for_variance", "component:i share:f cumulative:f is_chosen:b")
def _(spark, sf):
    s = fixtures.shapes(spark, sf)
    _, model = M.pca_fit_project(s, 64)
    shares = [float(v) for v in model.explainedVariance.toArray()]
    n = M.components_for_variance(shares)
    rows = [(i + 1, v, sum(shares[: i + 1]), i + 1 == n) for i, v in enumerate(shares)]
    return spark.createDataFrame(rows, "component int, share double, cumulative double, is_chosen boolean")


@query("m06_kmeans_seed_labels", "vec_id:i label:i")
def _(spark, sf):
    return M.cluster_once(fixtures.shapes(spark, sf), 4)


@staged
def sweep_shapes(spark, sf):
    """Whole shapes of the valid sweeps of the telemetry, keyed by ``vec_id`` (device and sweep)."""
    summary, floor, s = curves.sweeps_of_points(fixtures.sweep_points(spark, sf), BRANCH)
    ok = curves.curve_audit(None, stats=summary, floor=floor).where("is_curve_valid = 1").select(*curves.KEY)
    whole = s.join(ok, curves.KEY, "left_semi").where((F.size("shape") == 2 * BRANCH) & F.forall("shape", lambda x: x.isNotNull() & ~F.isnan(x)))
    return whole.select(F.struct(*curves.KEY).alias("vec_id"), "shape"), s


# The queries m03-m05 and w33 check the metrics on given labels against SQL; these fit the clusters.
@query("m03_kmeans_quality", "k:i inertia:f davies_bouldin:f calinski_harabasz:f silhouette:f min_delta_pff:f elbow:f")
def _(spark, sf):
    labels, gaps = M.kmeans_per_k(sweep_shapes(spark, sf), BRANCH)
    return H.elbow_distance(H.cluster_quality(labels)).join(gaps, "k")


@query("m05_kmeans_choose_k", "k_elbow:i k_silhouette:i k_davies_bouldin:i consensus:b k:i")
def _(spark, sf):
    labels, gaps = M.kmeans_per_k(sweep_shapes(spark, sf), BRANCH)
    return H.choose_k(H.elbow_distance(H.cluster_quality(labels)).join(gaps, "k"))


@query("m09_prune_and_retrain", "cell_name curve:i label:i")
def _(spark, sf):
    return M.prune_and_retrain(sweep_shapes(spark, sf), None, BRANCH).select("vec_id.*", "label")
