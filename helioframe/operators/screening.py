"""Screening of devices against a healthy baseline.

The baseline here is a closed-form linear twin whose fit is a handful of sums
per device; leave-one-out fits follow by subtracting a device's own sums, so no
row is ever copied per fold.  The tree-based twin is in ``models``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from helioframe.config import SETTINGS
from helioframe.functions.expr import diagnostic_status, relative_to_initial
from helioframe.functions.ordered import CHUNK, exact_quantiles, ordered_scan, range_chunks, time_chunk
from helioframe.functions.stages import settle
from helioframe.operators.features import daylight

BURN = SETTINGS.burn_in_days
GATE = SETTINGS.alert_gate_pct


def twin_rows(current: DataFrame, metrics: Sequence[str] = ("PCE", "pFF")) -> DataFrame:
    """Daylight rows up to the device's failure, relative to its initial level."""
    r = daylight(current).where(F.col("Exposure_Days") <= F.col("combined_survival_days")).dropna(subset=list(metrics))
    for m in metrics:
        r = r.withColumn(f"{m}_Relative", relative_to_initial(m, f"{m}_initial"))
    r = r.withColumn("is_healthy", F.col("combined_survival_days") > BURN)
    return r.withColumn("is_mature", F.col("Exposure_Days") > BURN).withColumn("in_action_window", ~F.col("is_mature"))


def fit_sums(rows: DataFrame, metrics: Sequence[str], x: str = "ModuleTemp_C") -> DataFrame:
    """Sufficient statistics of the linear twin per healthy device (mature rows only)."""
    aggs = [F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(F.col(x) * F.col(x)).alias("sxx")]
    for m in metrics:
        y = F.col(f"{m}_Relative")
        aggs += [F.sum(y).alias(f"sy_{m}"), F.sum(y * F.col(x)).alias(f"sxy_{m}")]
    return rows.where(F.col("is_healthy") & F.col("is_mature")).groupBy("cell_name").agg(*aggs)


def _line(metrics: Sequence[str]) -> list[Column]:
    n, sx, sxx = F.col("n"), F.col("sx"), F.col("sxx")
    out = []
    for m in metrics:
        sy, sxy = F.col(f"sy_{m}"), F.col(f"sxy_{m}")
        slope = (n * sxy - sx * sy) / F.nullif(n * sxx - sx * sx, F.lit(0.0))
        out += [slope.alias(f"b_{m}"), ((sy - slope * sx) / n).alias(f"a_{m}")]
    return out


def pooled_fit(sums: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row: intercept and slope of every metric over the healthy cohort."""
    cols = [c for c in sums.columns if c != "cell_name"]
    return sums.agg(*[F.sum(c).alias(c) for c in cols]).select(*_line(metrics))


def leave_one_out_fit(sums: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per holdout, fitted on all the other devices."""
    cols = [c for c in sums.columns if c != "cell_name"]
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # one row per device
    rest = sums.select("cell_name", *[(F.sum(c).over(every) - F.col(c)).alias(c) for c in cols])
    return rest.where(F.col("n") > 0).select("cell_name", *_line(metrics))


def predict(rows: DataFrame, fit: DataFrame, metrics: Sequence[str], x: str = "ModuleTemp_C") -> DataFrame:
    """Prediction and underperformance (prediction minus measurement) per metric."""
    p = rows.join(fit, "cell_name") if "cell_name" in fit.columns else rows.crossJoin(F.broadcast(fit))  # one-row fit
    for m in metrics:
        p = p.withColumn(f"{m}_Pred", F.col(f"a_{m}") + F.col(f"b_{m}") * F.col(x))
        p = p.withColumn(f"Under_{m}", F.col(f"{m}_Pred") - F.col(f"{m}_Relative"))
    return p.drop(*[f"{k}_{m}" for k in "ab" for m in metrics])


def leave_one_group_out(rows: DataFrame, value: str) -> DataFrame:
    """Train and test count and mean of each leave-one-device-out fold."""
    g = rows.groupBy("cell_name").agg(F.count(value).alias("n_test"), F.sum(value).alias("s_test"))
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # one row per device
    n, s = F.sum("n_test").over(every) - F.col("n_test"), F.sum("s_test").over(every) - F.col("s_test")
    return g.select(
        F.col("cell_name").alias("fold"),
        n.alias("n_train"),
        "n_test",
        F.try_divide(s, n).alias("train_mean"),
        F.try_divide(F.col("s_test"), F.col("n_test")).alias("test_mean"),
    )


def residual_threshold(residuals: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Largest of the alert quantile, the floor quantile and the absolute floor."""
    q = exact_quantiles(
        residuals, list(keys), column, {"alert": SETTINGS.alert_quantile, "dynamic_floor": SETTINGS.floor_quantile}
    )
    floor = F.lit(SETTINGS.residual_floor)
    if not keys:
        # No residual at all still yields a row with the absolute floor.
        q = q.agg(F.max("alert").alias("alert"), F.max("dynamic_floor").alias("dynamic_floor"), F.max("n").alias("n"))
    return q.withColumn("absolute_floor", floor).withColumn("layered", F.greatest("alert", "dynamic_floor", floor))


def thresholds(predicted: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row with the alert threshold of every metric (healthy mature residuals)."""
    base = predicted.where(F.col("is_healthy") & F.col("is_mature"))
    long = base.select(*[F.abs(f"Under_{m}").alias(m) for m in metrics]).unpivot([], list(metrics), "metric", "r")
    t = residual_threshold(long, "r", ["metric"])
    return t.agg(
        *[
            F.coalesce(F.max(F.when(F.col("metric") == m, F.col("layered"))), F.lit(SETTINGS.residual_floor)).alias(f"thr_{m}")
            for m in metrics
        ]
    )


def with_alerts(predicted: DataFrame, thr: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Alerts are raised inside the action window only."""
    p = predicted.crossJoin(F.broadcast(thr))  # one-row thresholds
    for m in metrics:
        p = p.withColumn(f"Alert_{m}", F.col("in_action_window") & (F.col(f"Under_{m}") > F.col(f"thr_{m}")))
    return p.withColumn("Digital_Twin_Alert", F.col("Alert_PCE") | F.col("Alert_pFF"))


def alert_summary(alerted: DataFrame, t80: DataFrame) -> DataFrame:
    pct = lambda c: 100.0 * F.avg(F.col(c).cast("double"))
    s = alerted.where("in_action_window").groupBy("cell_name").agg(
        F.count("*").alias("n_points"),
        F.count_if("Digital_Twin_Alert").alias("n_alerts"),
        pct("Digital_Twin_Alert").alias("alert_freq_pct"),
        pct("Alert_PCE").alias("alert_pce_pct"),
        pct("Alert_pFF").alias("alert_pff_pct"),
    )
    s = s.join(t80.select("cell_name", "survival_days_pce", "survival_days_pff", "combined_survival_days"), "cell_name", "left")
    early = F.coalesce(F.col("combined_survival_days") <= BURN, F.lit(False))  # no lifetime row: not failed
    s = s.withColumn("extrinsic_failure", early | (F.col("alert_freq_pct") > GATE))
    return s.withColumn("Diagnostic_Status", diagnostic_status())


def cumulative_alert_pct(alerted: DataFrame) -> DataFrame:
    """Running share of alerts inside the action window, in time order."""
    a = alerted.where("in_action_window")
    a = ordered_scan(
        a, ["cell_name"], ["Timestamp", "curve"], time_chunk("Timestamp", 21600),
        sums={"Cum_Points": F.lit(1), "Cum_Alerts": F.col("Digital_Twin_Alert").cast("int")},
    )
    return a.withColumn("Cum_Alert_Pct", 100.0 * F.col("Cum_Alerts") / F.col("Cum_Points"))


def threshold_day(cumulative: DataFrame, min_points: int = 100) -> DataFrame:
    """First exposure day above the gate with enough points, if the final share is above it."""
    final = 100.0 * F.avg(F.col("Digital_Twin_Alert").cast("double"))
    crossed = (F.col("Cum_Alert_Pct") > GATE) & (F.col("Cum_Points") >= min_points)
    g = cumulative.groupBy("cell_name").agg(
        final.alias("alert_freq_pct"), F.min(F.when(crossed, F.col("Exposure_Days"))).alias("day")
    )
    return g.select(
        "cell_name", "alert_freq_pct", F.when(F.col("alert_freq_pct") > GATE, F.col("day")).alias("threshold_pct_day")
    )


def burn_in_cohorts(t80: DataFrame, windows: Sequence[float] = SETTINGS.burn_in_grid) -> DataFrame:
    """Devices that outlive each candidate window (one row per device comes in)."""
    grid = t80.withColumn("window", F.explode(F.array(*[F.lit(float(w)) for w in windows])))
    alive = F.when(F.col("combined_survival_days") > F.col("window"), F.col("cell_name"))
    return grid.groupBy("window").agg(
        F.count(alive).alias("n_survivors"), F.array_join(F.array_sort(F.collect_set(alive)), ",").alias("survivors")
    )


def cohort_plateau(cohorts: DataFrame) -> DataFrame:
    """Longest run of consecutive windows with the same survivors (earliest on ties)."""
    w = W.orderBy("window")  # one row per candidate window
    c = cohorts.withColumn("new", F.coalesce((F.col("survivors") != F.lag("survivors").over(w)).cast("int"), F.lit(1)))
    c = c.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = c.groupBy("run").agg(
        F.count("*").alias("length"),
        F.min("window").alias("lo"),
        F.max("window").alias("hi"),
        F.max("survivors").alias("survivors"),
        F.array_sort(F.collect_list("window")).alias("windows"),
    )
    best = runs.agg(F.max_by(F.struct("length", "lo", "hi", "survivors", "windows"), F.struct("length", -F.col("run"))).alias("b"))
    b = best.select("b.*")
    centre = F.when(F.col("length") == 1, F.col("lo")).otherwise(F.sqrt(F.col("lo") * F.col("hi")))
    ranked = F.array_sort(F.transform("windows", lambda x: F.struct(F.abs(x - F.col("mid")).alias("d"), x.alias("w"))))
    return b.withColumn("mid", centre).withColumn("centre", ranked[0]["w"]).drop("windows", "mid")


def gate_sensitivity(summary: DataFrame, limits: Sequence[float] = (5.0, 10.0, 25.0, 40.0, 50.0)) -> DataFrame:
    """Gated and production devices for several alert gates (one row per device comes in)."""
    grid = summary.withColumn("threshold_pct", F.explode(F.array(*[F.lit(float(x)) for x in limits])))
    over = F.col("alert_freq_pct") > F.col("threshold_pct")
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("cell_name")))), ",")
    g = grid.groupBy("threshold_pct").agg(
        F.count_if(over).alias("n_gated"), F.count_if(~over).alias("n_production"),
        names(over).alias("gated_cells"), names(~over).alias("production_cells"),
    )
    return g.withColumn("is_current", F.abs(F.col("threshold_pct") - GATE) < 1e-9)


def production_cohort(summary: DataFrame) -> DataFrame:
    """Devices failed physically, gated by alerts, and kept for production."""
    failed = F.col("combined_survival_days") <= BURN
    gated = ~failed & (F.col("alert_freq_pct") > GATE)
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("cell_name"))))
    s = summary.agg(
        F.array_sort(F.collect_list("cell_name")).alias("everyone"), pick(failed).alias("f"), pick(gated).alias("g")
    )
    dropped = F.array_union("f", "g")
    return s.select(
        F.array_join("f", ",").alias("failed"),
        F.array_join("g", ",").alias("gated"),
        F.array_join(F.array_except("everyone", dropped), ",").alias("production"),
    )


def channel_frequencies(alerted: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Alert shares per device over two channels and over all of them."""
    two = F.col(f"Alert_{channels[0]}") | F.col(f"Alert_{channels[1]}")
    four = two
    for c in channels[2:]:
        four = four | F.col(f"Alert_{c}")
    pct = lambda c: 100.0 * F.avg(c.cast("double"))
    g = alerted.where("in_action_window").groupBy("cell_name").agg(
        F.max("is_healthy").alias("is_healthy"),
        pct(two).alias("pct_2"),
        pct(four).alias("pct_4"),
        *[pct(F.col(f"Alert_{c}")).alias(f"pct_{c}") for c in channels],
    )
    return g.withColumn("delta", F.col("pct_4") - F.col("pct_2"))


def channel_verdict(freq: DataFrame) -> DataFrame:
    """Gap between pathological minimum and healthy maximum; rescued and lost devices."""
    h = F.col("is_healthy")
    over2, over4 = F.col("pct_2") > GATE, F.col("pct_4") > GATE
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("cell_name")))), ",")
    aggs = []
    for k in (2, 4):
        aggs += [
            F.max(F.when(h, F.col(f"pct_{k}"))).alias(f"healthy_max_{k}"),
            F.min(F.when(~h, F.col(f"pct_{k}"))).alias(f"sick_min_{k}"),
        ]
    g = freq.agg(*aggs, names(~h & ~over2 & over4).alias("rescued"), names(h & ~over2 & over4).alias("lost"))
    for k in (2, 4):
        g = g.withColumn(f"gap_{k}", F.col(f"sick_min_{k}") - F.col(f"healthy_max_{k}"))
    return g.withColumn("safe_to_promote", F.coalesce(F.col("gap_4") > 10.0, F.lit(False)))


def row_index(rows: DataFrame, order: Sequence[str] = ("Timestamp", "curve")) -> DataFrame:
    """0-based position over (device, time) without a global sort: device offset plus running count."""
    counted = ordered_scan(rows, ["cell_name"], list(order), time_chunk("Timestamp", 21600), sums={"pos": F.lit(1)})
    sizes = rows.groupBy("cell_name").agg(F.count("*").alias("m"))
    earlier = W.orderBy("cell_name").rowsBetween(W.unboundedPreceding, -1)  # one row per device
    offsets = sizes.select("cell_name", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("offset"))
    return counted.join(offsets, "cell_name").withColumn("idx", F.col("offset") + F.col("pos") - 1).drop("offset", "pos")


def contiguous_block(idx: Column, n: Column, k: int) -> Column:
    """Which of ``k`` unshuffled blocks of ``n`` rows holds row ``idx``; the first ``n % k`` blocks hold one row more."""
    size, extra = F.floor(n / k), n % k
    edge = extra * (size + 1)
    return F.when(idx < edge, F.floor(idx / (size + 1))).otherwise(extra + F.floor((idx - edge) / F.greatest(size, F.lit(1))))


def contiguous_folds(rows: DataFrame, k: int = 5) -> DataFrame:
    """Unshuffled blocks in row order; the first ``n % k`` blocks hold one row more."""
    total = rows.agg(F.count("*").alias("n_rows"))
    r = row_index(rows).crossJoin(F.broadcast(total))  # one-row count
    return r.withColumn("fold", contiguous_block(F.col("idx"), F.col("n_rows"), k)).drop("n_rows")


def population_compare(pops: DataFrame) -> DataFrame:
    """Size and quantiles of each residual population, and their p98 relative to A."""
    q = exact_quantiles(pops, ["metric", "pop"], "r", {"p50": 0.5, "p90": 0.9, "p98": 0.98, "p99": 0.99})
    base = q.where(F.col("pop") == "A").select("metric", F.col("p98").alias("p98_a"))
    return q.join(base, "metric", "left").withColumn("p98_ratio", F.try_divide(F.col("p98"), F.col("p98_a"))).drop("p98_a")


def ks_two_sample(samples: DataFrame, label: str, a: str, b: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Largest distance between two empirical distributions, with the asymptotic p-value.

    Equal values are counted first; running counts go through ranges of equal size.  Null
    values do not take part.
    """
    s = samples.where(F.col(label).isin(a, b) & F.col(value).isNotNull())
    ks = list(keys) or ["one"]
    if not keys:
        s = s.withColumn("one", F.lit(1))
    counts = s.groupBy(*ks, F.col(value).alias("v")).agg(F.count_if(F.col(label) == a).alias("na"), F.count_if(F.col(label) == b).alias("nb"))
    counts = range_chunks(counts, ks, ["v"])
    run = ordered_scan(counts, ks, ["v"], CHUNK, sums={"ca": F.col("na"), "cb": F.col("nb")})
    total = counts.groupBy(*ks).agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    j = run.join(total, ks)
    d = F.max(F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb")))
    out = j.groupBy(*ks).agg(d.alias("statistic"), F.max("ta").alias("n_a"), F.max("tb").alias("n_b"))
    lam2 = F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")) * F.col("statistic") * F.col("statistic")
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: F.when(i % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * i * i * lam2))
    p = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    return out.withColumn("p_value", F.when(lam2 < 1e-4, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))))


def empirical_coverage(residuals: DataFrame, value: str, keys: Sequence[str], q: float = SETTINGS.alert_quantile) -> DataFrame:
    """Quantile threshold and the share of residuals at or below it."""
    t = exact_quantiles(residuals, keys, value, {"threshold": q})
    return residuals.join(t.drop("n"), list(keys)).groupBy(*keys).agg(
        F.max("threshold").alias("threshold"),
        F.avg((F.col(value) <= F.col("threshold")).cast("double")).alias("coverage"),
        F.avg(value).alias("mean_underperformance"),
        F.count("*").alias("n"),
    )


def threshold_crossings(series: DataFrame, value: str, limits: Sequence[float] = (0.025, 0.05, 0.075)) -> DataFrame:
    """Share of anomalies and first crossing per device for several limits, in one pass."""
    aggs = []
    for i, x in enumerate(limits):
        hit = F.col(value) > x
        aggs += [
            (100.0 * F.avg(hit.cast("double"))).alias(f"pct{i}"),
            F.min_by("Exposure_Days", F.when(hit, F.struct("Timestamp", "curve"))).alias(f"day{i}"),
            F.min(F.when(hit, F.col("Timestamp"))).alias(f"ts{i}"),
        ]
    g = series.groupBy("cell_name").agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(x).alias("threshold"), F.col(f"pct{i}").alias("anomaly_pct"), F.col(f"day{i}").alias("exposure_day"),
                F.col(f"ts{i}").alias("first_crossing"),
            )
            for i, x in enumerate(limits)
        ]
    )
    return g.select("cell_name", F.explode(rows).alias("r")).select("cell_name", "r.*")
