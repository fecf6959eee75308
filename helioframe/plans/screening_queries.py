"""Screening: baseline residuals, thresholds, alerts, cohorts and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from helioframe.config import SETTINGS
from helioframe.functions import expr as X
from helioframe.operators import screening as S, t80
from helioframe.plans import daily_queries as D
from helioframe.plans.lifetime_queries import lifetimes
from helioframe.plans.registry import query, view
from helioframe.plans.stages import staged
from helioframe.sources import fixtures

CH = ["PCE", "pFF", "Voc", "FF"]

view(
    "v_init2",
    """
SELECT cell_name, max(Voc) AS Voc_initial, max(FF) AS FF_initial FROM (
  SELECT *, row_number() OVER (PARTITION BY cell_name ORDER BY d) AS day_no FROM (
    SELECT cell_name, CAST("Timestamp" AS DATE) AS d, max(Voc) AS Voc, max(FF) AS FF FROM v_tracked GROUP BY 1, 2))
WHERE day_no <= 3 GROUP BY 1
""",
)
REL = ", ".join(f"{m} / greatest({m}_initial, 0.001) AS {m}_Relative" for m in CH)
view(
    "v_twin",
    f"""SELECT *, {REL}, combined_survival_days > 14 AS is_healthy, Exposure_Days > 14 AS is_mature, Exposure_Days <= 14 AS in_action_window
FROM v_cur JOIN v_init2 USING (cell_name)
WHERE POA_Irradiance_W_m2 > 100 AND Exposure_Days <= combined_survival_days AND PCE IS NOT NULL AND pFF IS NOT NULL""",
)
SUMS = ", ".join(f"sum({m}_Relative) AS sy_{m}, sum({m}_Relative * ModuleTemp_C) AS sxy_{m}" for m in CH)
view(
    "v_sums",
    f"""SELECT cell_name, count(*) AS n, sum(ModuleTemp_C) AS sx, sum(ModuleTemp_C * ModuleTemp_C) AS sxx, {SUMS}
FROM v_twin WHERE is_healthy AND is_mature GROUP BY 1""",
)
SUM_COLS = ["n", "sx", "sxx", *[f"{k}_{m}" for m in CH for k in ("sy", "sxy")]]
SLOPES = ", ".join(f"(n * sxy_{m} - sx * sy_{m}) / nullif(n * sxx - sx * sx, 0) AS b_{m}" for m in CH)
CUTS = ", ".join(f"(sy_{m} - b_{m} * sx) / n AS a_{m}" for m in CH)
view("v_fit", f"SELECT *, {CUTS} FROM (SELECT *, {SLOPES} FROM (SELECT " + ", ".join(f"sum({c}) AS {c}" for c in SUM_COLS) + " FROM v_sums))")
view(
    "v_loo",
    f"SELECT *, {CUTS} FROM (SELECT *, {SLOPES} FROM (SELECT cell_name, "
    + ", ".join(f"sum({c}) OVER () - {c} AS {c}" for c in SUM_COLS)
    + " FROM v_sums) WHERE n > 0)",
)
PRED = ", ".join(f"a_{m} + b_{m} * ModuleTemp_C AS {m}_Pred, a_{m} + b_{m} * ModuleTemp_C - {m}_Relative AS Under_{m}" for m in CH)
view("v_pred", f"SELECT t.*, {PRED} FROM v_twin t, v_fit")
view(
    "v_thr",
    "SELECT "
    + ", ".join(
        f"coalesce(greatest(quantile_cont(abs(Under_{m}), 0.98), quantile_cont(abs(Under_{m}), 0.25), 0.01), 0.01) AS thr_{m}" for m in CH
    )
    + " FROM v_pred WHERE is_healthy AND is_mature",
)
AL = ", ".join(f"in_action_window AND Under_{m} > thr_{m} AS Alert_{m}" for m in CH)
view("v_alert", f"SELECT *, Alert_PCE OR Alert_pFF AS Digital_Twin_Alert FROM (SELECT p.*, thr_PCE, thr_pFF, {AL} FROM v_pred p, v_thr)")
view(
    "v_summary",
    """SELECT *, combined_survival_days <= 14 OR alert_freq_pct > 25 AS extrinsic_failure FROM (
  SELECT cell_name, count(*) AS n_points, count(*) FILTER (Digital_Twin_Alert) AS n_alerts,
    100.0 * avg(CAST(Digital_Twin_Alert AS INT)) AS alert_freq_pct, 100.0 * avg(CAST(Alert_PCE AS INT)) AS alert_pce_pct,
    100.0 * avg(CAST(Alert_pFF AS INT)) AS alert_pff_pct FROM v_alert WHERE in_action_window GROUP BY 1)
JOIN (SELECT cell_name, survival_days_pce, survival_days_pff, combined_survival_days FROM v_t80) USING (cell_name)""",
)
view(
    "v_status",
    """SELECT *, CASE WHEN NOT extrinsic_failure THEN 'Healthy' WHEN txt = '' THEN 'Unknown' ELSE txt END AS Diagnostic_Status FROM (
  SELECT *, concat_ws(' + ',
    CASE WHEN survival_days_pce <= 14 AND survival_days_pff <= 14 THEN 'T80(Dual)' WHEN survival_days_pce <= 14 THEN 'T80(PCE)'
         WHEN survival_days_pff <= 14 THEN 'T80(pFF)' END,
    CASE WHEN alert_pce_pct > 25 AND alert_pff_pct > 25 THEN 'ML(Dual)' WHEN alert_pce_pct > 25 THEN 'ML(PCE)'
         WHEN alert_pff_pct > 25 THEN 'ML(pFF)' WHEN alert_freq_pct > 25 THEN 'ML(Combined)' END) AS txt FROM v_summary)""",
)


@staged
def twin(spark, sf):
    rows = D.current(spark, sf)
    tracked = t80.tracked_rows(fixtures.curve_rows(spark, sf))
    daily = tracked.groupBy("cell_name", F.to_date("Timestamp").alias("Date_Day")).agg(
        F.max("Voc").alias("Voc"), F.max("FF").alias("FF"), F.max("Exposure_Days").alias("Exposure_Days_max")
    )
    for m in ("Voc", "FF"):
        p = t80.initial_peak(daily, m).select("cell_name", F.col("initial").alias(f"{m}_initial"))
        rows = rows.join(p, "cell_name")
    out = S.twin_rows(rows, ["PCE", "pFF"])
    for m in ("Voc", "FF"):
        out = out.withColumn(f"{m}_Relative", X.relative_to_initial(m, f"{m}_initial"))
    return out


@staged
def predicted(spark, sf):
    rows = twin(spark, sf)
    return S.predict(rows, S.pooled_fit(S.fit_sums(rows, CH), CH), CH)


@staged
def alerted(spark, sf):
    p = predicted(spark, sf)
    return S.with_alerts(p, S.thresholds(p, CH), CH)


@staged
def summary(spark, sf):
    return S.alert_summary(alerted(spark, sf), lifetimes(spark, sf))


def residuals(spark, sf):
    p = predicted(spark, sf).where("is_healthy AND is_mature")
    return p.select(*[F.abs(f"Under_{m}").alias(m) for m in CH]).unpivot([], CH, "metric", "r")


RES = " UNION ALL ".join(f"SELECT '{m}' AS metric, abs(Under_{m}) AS r FROM v_pred WHERE is_healthy AND is_mature" for m in CH)


@query(
    "linear_twin_predictions",
    "event_id:i PCE_Relative:f PCE_Pred:f pFF_Pred:f Under_PCE:f Under_pFF:f",
    "SELECT * FROM v_pred",
)
def _(spark, sf):
    return predicted(spark, sf)


@query(
    "a30_residual_threshold",
    "metric n:i alert:f dynamic_floor:f absolute_floor:f layered:f",
    f"""SELECT metric, count(*) AS n, quantile_cont(r, 0.98) AS alert, quantile_cont(r, 0.25) AS dynamic_floor, 0.01 AS absolute_floor,
  greatest(quantile_cont(r, 0.98), quantile_cont(r, 0.25), 0.01) AS layered FROM ({RES}) GROUP BY 1""",
)
def _(spark, sf):
    return S.residual_threshold(residuals(spark, sf), "r", ["metric"])


@query(
    "a16_alert_summary",
    "cell_name n_points:i n_alerts:i alert_freq_pct:f alert_pce_pct:f alert_pff_pct:f extrinsic_failure:b",
    "SELECT * FROM v_summary",
)
def _(spark, sf):
    return summary(spark, sf)


@query("p16_diagnostic_status", "cell_name Diagnostic_Status", "SELECT * FROM v_status")
def _(spark, sf):
    return summary(spark, sf)


view(
    "v_cum",
    """SELECT *, 100.0 * sum(CAST(Digital_Twin_Alert AS INT)) OVER w / count(*) OVER w AS Cum_Alert_Pct, count(*) OVER w AS Cum_Points
FROM v_alert WHERE in_action_window WINDOW w AS (PARTITION BY cell_name ORDER BY "Timestamp", curve ROWS UNBOUNDED PRECEDING)""",
)


@query("w14_cumulative_alert_pct", "event_id:i Cum_Points:i Cum_Alert_Pct:f", "SELECT * FROM v_cum")
def _(spark, sf):
    return S.cumulative_alert_pct(alerted(spark, sf))


@query(
    "w14_threshold_day",
    "cell_name alert_freq_pct:f threshold_pct_day:f",
    """SELECT cell_name, f AS alert_freq_pct, CASE WHEN f > 25 THEN d END AS threshold_pct_day FROM (
  SELECT cell_name, 100.0 * avg(CAST(Digital_Twin_Alert AS INT)) AS f,
    min(Exposure_Days) FILTER (Cum_Alert_Pct > 25 AND Cum_Points >= 100) AS d FROM v_cum GROUP BY 1)""",
)
def _(spark, sf):
    return S.threshold_day(S.cumulative_alert_pct(alerted(spark, sf)))


view(
    "v_cohorts",
    """SELECT w AS "window", count(*) FILTER (combined_survival_days > w) AS n_survivors,
  coalesce(string_agg(cell_name, ',' ORDER BY cell_name) FILTER (combined_survival_days > w), '') AS survivors
FROM v_t80, (SELECT unnest([5.0, 7.0, 10.0, 14.0, 21.0, 28.0, 35.0]) AS w) GROUP BY 1""",
)


@query("a46_burn_in_cohorts", "window:f n_survivors:i survivors", "SELECT * FROM v_cohorts")
def _(spark, sf):
    return S.burn_in_cohorts(lifetimes(spark, sf))


PLATEAU = """
SELECT *, (SELECT arg_min("window", abs("window" - CASE WHEN length = 1 THEN lo ELSE sqrt(lo * hi) END)) FROM v_cohorts
           WHERE "window" BETWEEN lo AND hi) AS centre FROM (
  SELECT run, count(*) AS length, CAST(min("window") AS DOUBLE) AS lo, CAST(max("window") AS DOUBLE) AS hi, max(survivors) AS survivors FROM (
    SELECT *, sum(new) OVER (ORDER BY "window" ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT *, CASE WHEN survivors = lag(survivors) OVER (ORDER BY "window") THEN 0 ELSE 1 END AS new FROM v_cohorts))
  GROUP BY run ORDER BY length DESC, run LIMIT 1)
"""


@query("w18_cohort_plateau", "length:i lo:f hi:f survivors centre:f", PLATEAU)
def _(spark, sf):
    return S.cohort_plateau(S.burn_in_cohorts(lifetimes(spark, sf)))


@query(
    "u03_cohort_set_equality",
    "window:f same_as_previous:b",
    'SELECT "window", coalesce(survivors = lag(survivors) OVER (ORDER BY "window"), false) AS same_as_previous FROM v_cohorts',
)
def _(spark, sf):
    from pyspark.sql import Window as W

    c = S.burn_in_cohorts(lifetimes(spark, sf))
    same = F.col("survivors") == F.lag("survivors").over(W.orderBy("window"))  # one row per candidate
    return c.withColumn("same_as_previous", F.coalesce(same, F.lit(False)))


@query(
    "u02_cohort_sets",
    "failed gated production",
    """SELECT coalesce(string_agg(cell_name, ',' ORDER BY cell_name) FILTER (f), '') AS failed,
  coalesce(string_agg(cell_name, ',' ORDER BY cell_name) FILTER (NOT f AND g), '') AS gated,
  coalesce(string_agg(cell_name, ',' ORDER BY cell_name) FILTER (NOT f AND NOT g), '') AS production
FROM (SELECT cell_name, combined_survival_days <= 14 AS f, alert_freq_pct > 25 AS g FROM v_summary)""",
)
def _(spark, sf):
    return S.production_cohort(summary(spark, sf))


@query(
    "a45_gate_sensitivity",
    "threshold_pct:f n_gated:i n_production:i gated_cells production_cells is_current:b",
    """SELECT x AS threshold_pct, count(*) FILTER (alert_freq_pct > x) AS n_gated, count(*) FILTER (NOT alert_freq_pct > x) AS n_production,
  coalesce(string_agg(cell_name, ',' ORDER BY cell_name) FILTER (alert_freq_pct > x), '') AS gated_cells,
  coalesce(string_agg(cell_name, ',' ORDER BY cell_name) FILTER (NOT alert_freq_pct > x), '') AS production_cells, x = 25 AS is_current
FROM v_summary, (SELECT unnest([5.0, 10.0, 25.0, 40.0, 50.0]) AS x) GROUP BY x""",
)
def _(spark, sf):
    return S.gate_sensitivity(summary(spark, sf))


FOUR = "Alert_PCE OR Alert_pFF OR Alert_Voc OR Alert_FF"
view(
    "v_channels",
    f"""SELECT *, pct_4 - pct_2 AS delta FROM (SELECT cell_name, bool_or(is_healthy) AS is_healthy,
  100.0 * avg(CAST(Digital_Twin_Alert AS INT)) AS pct_2, 100.0 * avg(CAST({FOUR} AS INT)) AS pct_4, """
    + ", ".join(f"100.0 * avg(CAST(Alert_{m} AS INT)) AS pct_{m}" for m in CH)
    + " FROM v_alert WHERE in_action_window GROUP BY 1)",
)


@query(
    "a44_alert_frequency_channels",
    "cell_name is_healthy:b pct_2:f pct_4:f delta:f " + " ".join(f"pct_{m}:f" for m in CH),
    "SELECT * FROM v_channels",
)
def _(spark, sf):
    return S.channel_frequencies(alerted(spark, sf), CH)


@query(
    "a44_channel_verdict",
    "healthy_max_2:f sick_min_2:f gap_2:f healthy_max_4:f sick_min_4:f gap_4:f rescued lost safe_to_promote:b",
    """SELECT *, sick_min_2 - healthy_max_2 AS gap_2, sick_min_4 - healthy_max_4 AS gap_4,
  coalesce(sick_min_4 - healthy_max_4 > 10, false) AS safe_to_promote FROM (
  SELECT max(pct_2) FILTER (is_healthy) AS healthy_max_2, min(pct_2) FILTER (NOT is_healthy) AS sick_min_2,
    max(pct_4) FILTER (is_healthy) AS healthy_max_4, min(pct_4) FILTER (NOT is_healthy) AS sick_min_4,
    coalesce(string_agg(cell_name, ',' ORDER BY cell_name) FILTER (NOT is_healthy AND pct_2 <= 25 AND pct_4 > 25), '') AS rescued,
    coalesce(string_agg(cell_name, ',' ORDER BY cell_name) FILTER (is_healthy AND pct_2 <= 25 AND pct_4 > 25), '') AS lost FROM v_channels)""",
)
def _(spark, sf):
    return S.channel_verdict(S.channel_frequencies(alerted(spark, sf), CH))


@query(
    "j10_leave_one_group_out",
    "fold n_train:i n_test:i train_mean:f test_mean:f",
    """SELECT f.cell_name AS fold, count(*) FILTER (t.cell_name <> f.cell_name) AS n_train, count(*) FILTER (t.cell_name = f.cell_name) AS n_test,
  avg(PCE_Relative) FILTER (t.cell_name <> f.cell_name) AS train_mean, avg(PCE_Relative) FILTER (t.cell_name = f.cell_name) AS test_mean
FROM v_twin t, (SELECT DISTINCT cell_name FROM v_twin) f GROUP BY 1""",
)
def _(spark, sf):
    return S.leave_one_group_out(twin(spark, sf), "PCE_Relative")


@query(
    "m11_contiguous_folds",
    "event_id:i idx:i fold:i",
    """SELECT event_id, idx, CASE WHEN idx < (n % 5) * (n // 5 + 1) THEN idx // (n // 5 + 1)
  ELSE n % 5 + (idx - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold
FROM (SELECT event_id, row_number() OVER (ORDER BY cell_name, "Timestamp", curve) - 1 AS idx, count(*) OVER () AS n FROM v_twin)""",
)
def _(spark, sf):
    return S.contiguous_folds(twin(spark, sf))


LOO = ", ".join(f"abs(a_{m} + b_{m} * ModuleTemp_C - {m}_Relative) AS r_{m}" for m in ("PCE", "pFF"))
view(
    "v_pops",
    f"""WITH l AS (SELECT is_mature, {LOO} FROM v_twin JOIN v_loo USING (cell_name) WHERE is_healthy)
SELECT 'A' AS pop, 'PCE' AS metric, abs(Under_PCE) AS r FROM v_pred WHERE is_healthy AND is_mature
UNION ALL SELECT 'A', 'pFF', abs(Under_pFF) FROM v_pred WHERE is_healthy AND is_mature
UNION ALL SELECT CASE WHEN is_mature THEN 'C' ELSE 'B' END, 'PCE', r_PCE FROM l
UNION ALL SELECT CASE WHEN is_mature THEN 'C' ELSE 'B' END, 'pFF', r_pFF FROM l""",
)


@staged
def populations(spark, sf):
    """A: pooled fit on mature rows; B and C: early and mature rows of each holdout."""
    m = ["PCE", "pFF"]
    rows = twin(spark, sf)
    a = predicted(spark, sf).where("is_healthy AND is_mature").withColumn("pop", F.lit("A"))
    held = S.predict(rows, S.leave_one_out_fit(S.fit_sums(rows, CH), CH), CH).where("is_healthy")
    held = held.withColumn("pop", F.when(F.col("is_mature"), "C").otherwise("B"))
    cols = ["pop", *[F.abs(f"Under_{x}").alias(x) for x in m]]
    return a.select(*cols).unionByName(held.select(*cols)).unpivot(["pop"], m, "metric", "r")


@query(
    "a32_population_compare",
    "metric pop n:i p50:f p90:f p98:f p99:f p98_ratio:f",
    """WITH q AS (SELECT metric, pop, count(*) AS n, quantile_cont(r, 0.5) AS p50, quantile_cont(r, 0.9) AS p90,
  quantile_cont(r, 0.98) AS p98, quantile_cont(r, 0.99) AS p99 FROM v_pops GROUP BY 1, 2)
SELECT q.*, q.p98 / a.p98 AS p98_ratio FROM q LEFT JOIN (SELECT metric, p98 FROM q WHERE pop = 'A') a ON q.metric = a.metric""",
)
def _(spark, sf):
    return S.population_compare(populations(spark, sf))


@query(
    "a33_ks_two_sample",
    "metric statistic:f n_a:i n_b:i p_value:f",
    """WITH c AS (SELECT metric, r, count(*) FILTER (pop = 'A') AS na, count(*) FILTER (pop = 'B') AS nb FROM v_pops WHERE pop IN ('A', 'B') GROUP BY 1, 2),
f AS (SELECT metric, sum(na) OVER w / sum(na) OVER g AS fa, sum(nb) OVER w / sum(nb) OVER g AS fb, sum(na) OVER g AS ta, sum(nb) OVER g AS tb
  FROM c WINDOW w AS (PARTITION BY metric ORDER BY r ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY metric)),
d AS (SELECT metric, max(abs(fa - fb)) AS statistic, max(ta) AS n_a, max(tb) AS n_b FROM f GROUP BY 1)
SELECT metric, statistic, n_a, n_b, least(1.0, greatest(0.0, sum(CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END
  * exp(-2.0 * k * k * (CAST(n_a AS DOUBLE) * n_b / (n_a + n_b)) * statistic * statistic)))) AS p_value
FROM d, (SELECT unnest(range(1, 101)) AS k) GROUP BY 1, 2, 3, 4""",
)
def _(spark, sf):
    return S.ks_two_sample(populations(spark, sf), "pop", "A", "B", "r", ["metric"])


@query(
    "a31_empirical_coverage",
    "metric threshold:f coverage:f mean_underperformance:f n:i",
    f"""SELECT metric, t AS threshold, avg(CAST(r <= t AS INT)) AS coverage, avg(r) AS mean_underperformance, count(*) AS n
FROM (SELECT *, quantile_cont(r, 0.98) OVER (PARTITION BY metric) AS t FROM ({RES})) GROUP BY 1, 2""",
)
def _(spark, sf):
    return S.empirical_coverage(residuals(spark, sf), "r", ["metric"])


@query(
    "a60_cohort_coverage",
    "coverage_pce:f coverage_pff:f n:i",
    """SELECT avg(CAST(abs(Under_PCE) <= thr_PCE AS INT)) AS coverage_pce, avg(CAST(abs(Under_pFF) <= thr_pFF AS INT)) AS coverage_pff,
  count(*) AS n FROM v_alert WHERE is_healthy AND is_mature""",
)
def _(spark, sf):
    return alerted(spark, sf).where("is_healthy AND is_mature").agg(
        F.avg((F.abs("Under_PCE") <= F.col("thr_PCE")).cast("double")).alias("coverage_pce"),
        F.avg((F.abs("Under_pFF") <= F.col("thr_pFF")).cast("double")).alias("coverage_pff"),
        F.count("*").alias("n"),
    )


@query(
    "a59_threshold_crossings",
    "cell_name threshold:f anomaly_pct:f exposure_day:f first_crossing:t",
    """SELECT cell_name, x AS threshold, 100.0 * avg(CAST(Under_PCE > x AS INT)) AS anomaly_pct,
  arg_min(Exposure_Days, "Timestamp") FILTER (Under_PCE > x) AS exposure_day, min("Timestamp") FILTER (Under_PCE > x) AS first_crossing
FROM v_pred, (SELECT unnest([0.025, 0.05, 0.075]) AS x) WHERE in_action_window GROUP BY 1, 2""",
)
def _(spark, sf):
    return S.threshold_crossings(predicted(spark, sf).where("in_action_window"), "Under_PCE")


@query(
    "a58_threshold_autopsy",
    "cell_name n:i mean_under_pce:f anomaly_pct_pce:f band_low_pce:f mean_under_pff:f anomaly_pct_pff:f band_low_pff:f",
    """SELECT cell_name, count(*) AS n, avg(greatest(0, Under_PCE)) AS mean_under_pce, 100.0 * avg(CAST(Under_PCE > thr_PCE AS INT)) AS anomaly_pct_pce,
  avg(PCE_Pred - thr_PCE) AS band_low_pce, avg(greatest(0, Under_pFF * pFF_initial)) AS mean_under_pff,
  100.0 * avg(CAST(Under_pFF * pFF_initial > thr_pFF * pFF_initial AS INT)) AS anomaly_pct_pff,
  avg(pFF_Pred * pFF_initial - thr_pFF * pFF_initial) AS band_low_pff
FROM v_alert WHERE in_action_window GROUP BY 1""",
)
def _(spark, sf):
    # The pFF series is absolute, so its threshold is scaled by the initial level.
    x0, zero = F.col("pFF_initial"), F.lit(0.0)
    thr, under = F.col("thr_pFF") * x0, F.col("Under_pFF") * x0
    return alerted(spark, sf).where("in_action_window").groupBy("cell_name").agg(
        F.count("*").alias("n"),
        F.avg(F.greatest(zero, "Under_PCE")).alias("mean_under_pce"),
        (100.0 * F.avg((F.col("Under_PCE") > F.col("thr_PCE")).cast("double"))).alias("anomaly_pct_pce"),
        F.avg(F.col("PCE_Pred") - F.col("thr_PCE")).alias("band_low_pce"),
        F.avg(F.greatest(zero, under)).alias("mean_under_pff"),
        (100.0 * F.avg((under > thr).cast("double"))).alias("anomaly_pct_pff"),
        F.avg(F.col("pFF_Pred") * x0 - thr).alias("band_low_pff"),
    )


@query(
    "p20_positive_underperformance",
    "event_id:i under_pce:f under_pff:f Healthy_Mature:b",
    """SELECT event_id, greatest(0, Under_PCE) AS under_pce, greatest(0, Under_pFF) AS under_pff, is_healthy AND is_mature AS Healthy_Mature FROM v_pred""",
)
def _(spark, sf):
    zero = F.lit(0.0)
    return predicted(spark, sf).select(
        "event_id",
        F.greatest(zero, "Under_PCE").alias("under_pce"),
        F.greatest(zero, "Under_pFF").alias("under_pff"),
        (F.col("is_healthy") & F.col("is_mature")).alias("Healthy_Mature"),
    )
