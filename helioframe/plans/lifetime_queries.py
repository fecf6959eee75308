"""Lifetime table and its building blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from helioframe.functions import expr as X
from helioframe.operators import features, t80
from helioframe.plans import views  # noqa: F401
from helioframe.plans.registry import query
from helioframe.plans.stages import staged
from helioframe.sources import fixtures


def daily(spark, sf):
    return t80.daily_maxima(t80.tracked_rows(fixtures.curve_rows(spark, sf)))


@staged
def lifetimes(spark, sf):
    return t80.t80_table(fixtures.curve_rows(spark, sf))


@query(
    "p12_pff_cap",
    "event_id:i cell_name PCE:f pFF:f Exposure_Days:f",
    "SELECT * FROM v_tracked",
)
def _(spark, sf):
    return t80.tracked_rows(fixtures.curve_rows(spark, sf))


@query(
    "a12_daily_maxima",
    "cell_name Date_Day:d PCE_max:f pFF_max:f POA_max:f Exposure_Days_max:f Datetime_max:t",
    "SELECT * FROM v_daily",
)
def _(spark, sf):
    return daily(spark, sf)


@query(
    "w04_initial_peak",
    "metric cell_name initial:f peak_day:f",
    "SELECT 'PCE' AS metric, * FROM v_peak_pce UNION ALL SELECT 'pFF', * FROM v_peak_pff",
)
def _(spark, sf):
    d = daily(spark, sf)
    return (
        t80.initial_peak(d, "PCE_max")
        .withColumn("metric", F.lit("PCE"))
        .unionByName(t80.initial_peak(d, "pFF_max").withColumn("metric", F.lit("pFF")))
    )


@query(
    "w05_below_t80_flag",
    "cell_name Date_Day:d below_pce:i below_pff:i",
    """SELECT a.cell_name, a.Date_Day, a.is_below AS below_pce, b.is_below AS below_pff
FROM v_below_pce a JOIN v_below_pff b USING (cell_name, Date_Day)""",
)
def _(spark, sf):
    d = daily(spark, sf)
    a = t80.below_flag(d, "PCE_max", True).select("cell_name", "Date_Day", F.col("is_below").alias("below_pce"))
    b = t80.below_flag(d, "pFF_max", False).select("cell_name", "Date_Day", F.col("is_below").alias("below_pff"))
    return a.join(b, ["cell_name", "Date_Day"])


@query(
    "w06_t80_extract",
    "cell_name survival_days:f is_censored:b failure_date:t",
    """SELECT cell_name, CASE WHEN survival_days < 'inf'::DOUBLE THEN survival_days END AS survival_days,
  survival_days = 'inf'::DOUBLE AS is_censored, failure_date FROM v_hit_pce""",
)
def _(spark, sf):
    hits = t80.extract(t80.below_flag(daily(spark, sf), "PCE_max", True))
    return hits.withColumn("is_censored", F.col("survival_days") == t80.INF).withColumn(
        "survival_days", t80.finite("survival_days")
    )


T80_COLUMNS = (
    "cell_name PCE_initial:f T80_threshold_PCE:f survival_days_pce:f t80_failure_date_pce:t pFF_initial:f "
    "T80_threshold_pFF:f survival_days_pff:f t80_failure_date_pff:t combined_survival_days:f "
    "combined_failure_date:t is_censored:b"
)


@query(
    "w07_t80_table",
    T80_COLUMNS,
    """SELECT * REPLACE (
  CASE WHEN survival_days_pce < 'inf'::DOUBLE THEN survival_days_pce END AS survival_days_pce,
  CASE WHEN survival_days_pff < 'inf'::DOUBLE THEN survival_days_pff END AS survival_days_pff,
  CASE WHEN combined_survival_days < 'inf'::DOUBLE THEN combined_survival_days END AS combined_survival_days),
  combined_survival_days = 'inf'::DOUBLE AS is_censored FROM v_t80""",
)
def _(spark, sf):
    t = lifetimes.build(spark, sf).withColumn("is_censored", F.col("combined_survival_days") == t80.INF)
    for c in ("survival_days_pce", "survival_days_pff", "combined_survival_days"):
        t = t.withColumn(c, t80.finite(c))
    return t


@query(
    "j05_attach_t80",
    "event_id:i PCE_initial:f pFF_initial:f",
    "SELECT event_id, PCE_initial, pFF_initial FROM v_rows JOIN v_t80 USING (cell_name)",
)
def _(spark, sf):
    return fixtures.curve_rows(spark, sf).join(lifetimes(spark, sf), "cell_name")


@query(
    "p07_relative_to_initial",
    "event_id:i PCE_Relative:f pFF_Relative:f",
    """SELECT event_id, PCE / greatest(PCE_initial, 0.001) AS PCE_Relative,
  pFF / greatest(pFF_initial, 0.001) AS pFF_Relative FROM v_rows JOIN v_t80 USING (cell_name)""",
)
def _(spark, sf):
    return features.relative_columns(fixtures.curve_rows(spark, sf).join(lifetimes(spark, sf), "cell_name"))


@query(
    "p13_censor_at_failure",
    "event_id:i Exposure_Days:f PCE:f pFF:f",
    """SELECT event_id, Exposure_Days, PCE, pFF FROM v_exp JOIN v_t80 USING (cell_name)
WHERE Exposure_Days <= combined_survival_days AND PCE IS NOT NULL AND pFF IS NOT NULL""",
)
def _(spark, sf):
    rows = features.with_exposure(fixtures.curve_rows(spark, sf)).join(lifetimes(spark, sf), "cell_name")
    return rows.where(F.col("Exposure_Days") <= F.col("combined_survival_days")).dropna(subset=["PCE", "pFF"])
