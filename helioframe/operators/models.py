"""Operators that fit MLlib models.

Fits are driver-side actions whose work runs on the executors; independent folds
are submitted from a few threads.  Scoring stays lazy.  Training sets are
settled once, so every boosting round reads a flat table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from helioframe.config import (
    DAMAGE_FEATURES, DAMAGE_PARAMS, DAMAGE_PENALTIES, FOREST_PARAMS, SEED, SETTINGS, TRAJECTORY_PARAMETERS, TWIN_FEATURES,
    TWIN_PCE_PARAMS, TWIN_PENALTIES, TWIN_PFF_PARAMS,
)
from helioframe.functions.ordered import exact_quantiles, left_out_quantile, ordered_scan, time_chunk
from helioframe.functions.stages import settle
from helioframe.operators import boosting as B, screening as S, shapes as H

PARALLEL = 4


def in_parallel(spark, jobs: Sequence[Callable], threads: int = PARALLEL) -> list:
    """Run independent driver-side jobs from a few threads."""
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(lambda j: inheritable_thread_target(spark)(j)(), jobs))


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)


def booster(label: str, params: dict, rounds: int | None = None, prediction: str = "prediction") -> GBTRegressor:
    p = {**params, **({"maxIter": rounds} if rounds else {})}
    return GBTRegressor(labelCol=label, featuresCol="features", predictionCol=prediction, seed=SEED, **p)


def forest(label: str, trees: int | None = None) -> RandomForestRegressor:
    p = {**FOREST_PARAMS, **({"numTrees": trees} if trees else {})}
    return RandomForestRegressor(labelCol=label, featuresCol="features", seed=SEED, **p)


def mae(pred: Column, actual: Column) -> Column:
    return F.avg(F.abs(pred - actual))


# -- healthy twin ----------------------------------------------------------------

TWIN = {"PCE": TWIN_PCE_PARAMS, "pFF": TWIN_PFF_PARAMS}


def healthy_twin(rows: DataFrame, rounds: int | None = None) -> DataFrame:
    """Predict relative PCE and pFF of every row from weather and time.

    Trained on mature rows of the surviving devices; thresholds come from
    out-of-fold residuals; alerts are raised inside the action window only.
    """
    data = settle(rows)
    base = settle(S.contiguous_folds(data.where("is_healthy AND is_mature")))
    spark = rows.sparkSession

    def final(metric: str):
        return booster(f"{metric}_Relative", TWIN[metric], rounds, f"{metric}_Pred").fit(assemble(base, TWIN_FEATURES))

    jobs = [lambda m=m: final(m) for m in TWIN] + [lambda m=m: threshold(base, m, rounds) for m in TWIN]
    done = in_parallel(spark, jobs)
    fitted = dict(zip(TWIN, zip(done[: len(TWIN)], done[len(TWIN) :])))
    out = assemble(data, TWIN_FEATURES)
    for m, (model, thr) in fitted.items():
        out = model.transform(out).withColumn(f"Under_{m}", F.col(f"{m}_Pred") - F.col(f"{m}_Relative"))
        out = out.withColumn(f"thr_{m}", F.lit(thr))
        out = out.withColumn(f"Alert_{m}", F.col("in_action_window") & (F.col(f"Under_{m}") > thr))
    return out.drop("features").withColumn("Digital_Twin_Alert", F.col("Alert_PCE") | F.col("Alert_pFF"))


def oof_residuals(folded: DataFrame, metric: str, rounds: int | None = None, k: int = 5) -> DataFrame:
    """Absolute residuals of contiguous blocks, each predicted from the other blocks; the fits run side by side."""
    data = assemble(folded, TWIN_FEATURES)

    def job(i: int) -> DataFrame | None:
        train = data.where(F.col("fold") != i)
        if train.isEmpty():
            return None
        model = booster(f"{metric}_Relative", TWIN[metric], rounds, "p").fit(train)
        return model.transform(data.where(F.col("fold") == i)).select(F.abs(F.col("p") - F.col(f"{metric}_Relative")).alias("r"))

    out = None
    for part in in_parallel(folded.sparkSession, [lambda i=i: job(i) for i in range(k)], k):
        if part is not None:
            out = part if out is None else out.unionByName(part)
    return out


def threshold(folded: DataFrame, metric: str, rounds: int | None = None) -> float:
    res = oof_residuals(folded, metric, rounds)
    if res is None:
        return SETTINGS.residual_floor
    return float(S.residual_threshold(res, "r").first()["layered"])  # one number


INNER = 5  # contiguous blocks whose residuals give a fold's thresholds


def _none() -> Column:
    return F.array().cast("array<int>")


def device_groups(rows: DataFrame, groups: int = B.GROUPS) -> DataFrame:
    """Devices of ``rows`` in at most ``groups`` runs of device order: ``cell_name`` and ``grp`` from 0.

    Up to ``groups`` devices each is a group, so leaving a group out leaves a device out;
    with more, a group holds several, so that models do not grow with the fleet.
    """
    cells = rows.select("cell_name").where(F.col("cell_name").isNotNull()).distinct()
    return cells.withColumn("grp", F.ntile(groups).over(W.orderBy("cell_name")) - 1)  # one row a device


def twin_models(sets: int | Sequence[int]) -> list[B.Model]:
    """The boosters of relative PCE and pFF for each training set (a list, or how many)."""
    boosts = [B.settings(TWIN[m], **TWIN_PENALTIES) for m in TWIN]
    every = range(sets) if isinstance(sets, int) else sets
    return [B.Model(s, i, tuple(range(len(TWIN_FEATURES))), b) for s in every for i, b in enumerate(boosts)]


def twin_predictions(rows: DataFrame, keys: Sequence[str], sets: int | Sequence[int]) -> DataFrame:
    """Predictions of the twin's boosters as one row a row and set: ``set``, ``p_PCE``, ``p_pFF``."""
    models = twin_models(sets)
    got, _ = B.fit_many(rows, keys, TWIN_FEATURES, [f"{m}_Relative" for m in TWIN], models)
    place = F.col("model") % len(TWIN)
    picks = [F.max(F.when(place == i, F.col("prediction"))).alias(f"p_{m}") for i, m in enumerate(TWIN)]
    of = F.get(F.array(*[F.lit(m.set) for m in models]), F.col("model")) if models else F.lit(0)
    return got.groupBy(*keys, of.alias("set")).agg(*picks)


def loocv_gate(rows: DataFrame) -> DataFrame:
    """Leave-one-device-out check of the healthy cohort: alert share and verdict per holdout.

    For each holdout the twin is fitted to the others' mature rows, and its thresholds
    come from residuals of contiguous blocks of those rows, each predicted from the
    other blocks.  All these fits run at once.  A holdout without training rows (the only
    device) or without early rows has no data.  An empty cohort gives an empty table.
    """
    data = settle(rows.where("is_healthy"))
    train = data.where("is_mature")
    groups = settle(device_groups(data))
    sizes = data.join(groups, "cell_name").groupBy("grp").agg(F.count(F.when(F.col("is_mature"), 1)).alias("n"))
    spans, at = [], 0
    for r in sizes.orderBy("grp").collect():  # GROUPS rows at most
        spans.append((at, r["n"]))
        at += r["n"]
    holdouts, total, per = len(spans), at, 1 + INNER
    idx = S.row_index(train).select("cell_name", "curve", F.col("idx").alias("row"))
    d = data.join(groups, "cell_name").join(idx, ["cell_name", "curve"], "left")
    trains, asked = [], []
    for h, (start, n) in enumerate(spans):
        row = F.when(F.col("row") < start, F.col("row")).otherwise(F.col("row") - n)
        block = S.contiguous_block(row, F.lit(total - n), INNER).cast("int")
        mine = (F.col("grp") != h) & F.col("is_mature")
        sets = F.array(F.lit(h * per), *[F.when(block != j, F.lit(h * per + 1 + j)) for j in range(INNER)])
        trains.append(F.when(mine, F.array_compact(sets)).otherwise(_none()))
        asked.append(F.when(mine, F.array(block + (h * per + 1))).when((F.col("grp") == h) & F.col("in_action_window"), F.array(F.lit(h * per))).otherwise(_none()))
    d = d.withColumns({"trains": F.flatten(F.array(*trains)) if trains else _none(), "asked": F.flatten(F.array(*asked)) if asked else _none()})
    p = settle(twin_predictions(d, ["cell_name", "curve"], holdouts * per).join(groups, "cell_name"))
    truth = data.select("cell_name", "curve", *[f"{m}_Relative" for m in TWIN])
    inner = p.where(F.col("set") % per > 0).join(truth, ["cell_name", "curve"])
    res = inner.select(F.floor(F.col("set") / per).cast("int").alias("holdout"), *[F.abs(F.col(f"p_{m}") - F.col(f"{m}_Relative")).alias(m) for m in TWIN])
    thr = S.residual_threshold(res.unpivot(["holdout"], list(TWIN), "metric", "r"), "r", ["holdout", "metric"])
    thr = thr.groupBy(F.col("holdout").alias("grp")).agg(*[F.max(F.when(F.col("metric") == m, F.col("layered"))).alias(f"thr_{m}") for m in TWIN])
    early = p.where((F.col("set") % per == 0) & F.col("p_PCE").isNotNull()).join(truth, ["cell_name", "curve"]).join(thr, "grp")
    hit = F.lit(False)
    for m in TWIN:
        hit = hit | (F.col(f"p_{m}") - F.col(f"{m}_Relative") > F.col(f"thr_{m}"))
    found = early.groupBy("cell_name").agg(F.count("*").alias("n"), (100.0 * F.avg(hit.cast("double"))).alias("alert_pct"))
    out = groups.select("cell_name").join(found, "cell_name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("verdict", gate_verdict())


def gate_verdict() -> Column:
    return F.when(F.col("n") == 0, "NO_DATA").when(F.col("alert_pct") > SETTINGS.alert_gate_pct, "FAIL").otherwise("PASS")


def burn_in_grid(rows: DataFrame, windows: Sequence[float] = SETTINGS.burn_in_grid, x: str = "ModuleTemp_C") -> DataFrame:
    """Leave-one-out error of the closed-form twin for every burn-in window.

    Sums per (window, device) give all the fits; one more pass scores them.
    """
    m = "PCE_Relative"
    e = rows.select("cell_name", "Exposure_Days", "combined_survival_days", x, m)
    e = e.withColumn("window", F.explode(F.array(*[F.lit(float(w)) for w in windows])))
    e = e.where((F.col("combined_survival_days") > F.col("window")) & (F.col("Exposure_Days") > F.col("window")))
    cx, y = F.col(x), F.col(m)
    sums = settle(
        e.groupBy("window", "cell_name").agg(
            F.count("*").alias("n"), F.sum(cx).alias("sx"), F.sum(y).alias("sy"), F.sum(cx * cx).alias("sxx"), F.sum(cx * y).alias("sxy")
        )
    )
    every = W.partitionBy("window").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # one row per device
    rest = sums.select("window", "cell_name", *[(F.sum(c).over(every) - F.col(c)).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
    fit = rest.where("n > 0").withColumn("b", slope).withColumn("a", (F.col("sy") - F.col("b") * F.col("sx")) / F.col("n"))
    err = e.join(fit.select("window", "cell_name", "a", "b"), ["window", "cell_name"])
    folds = err.groupBy("window", "cell_name").agg(mae(F.col("a") + F.col("b") * cx, y).alias("mae"))
    return folds.groupBy("window").agg(
        F.count("*").alias("n_folds"), F.avg("mae").alias("mae_mean"), F.try_divide(F.stddev_samp("mae"), F.sqrt(F.count("*"))).alias("mae_se")
    )


def burn_in_grid_fitted(rows: DataFrame, windows: Sequence[float] = SETTINGS.burn_in_grid) -> DataFrame:
    """The grid with the boosted twin: thresholds and leave-one-device-out errors of every burn-in window.

    The cohort of a window are the devices that outlive it; it trains on their rows after
    the window, and a holdout is judged by its rows within the window.  Thresholds come
    from contiguous blocks of the cohort's training rows.  ``mae`` is the mean over
    devices, ``se`` its error over devices.  All fits of all windows run at once.  A window
    with fewer than two devices has no folds and no thresholds.
    """
    data = settle(rows)
    groups = settle(device_groups(data))
    count = (groups.agg(F.max("grp").alias("m")).first()["m"] or 0) + 1
    per = count + INNER
    inside = [F.col("combined_survival_days") > w for w in windows]
    learns = [c & (F.col("Exposure_Days") > w) for c, w in zip(inside, windows, strict=True)]
    cohorts = data.agg(*[F.count_distinct(F.when(c, F.col("cell_name"))).alias(f"c{i}") for i, c in enumerate(inside)], *[F.count(F.when(c, 1)).alias(f"n{i}") for i, c in enumerate(learns)]).first()
    per_cell = data.groupBy("cell_name").agg(*[F.count(F.when(c, 1)).alias(f"m{i}") for i, c in enumerate(learns)])
    earlier = W.orderBy("cell_name").rowsBetween(W.unboundedPreceding, -1)  # one row a device
    offsets = per_cell.select("cell_name", *[F.coalesce(F.sum(f"m{i}").over(earlier), F.lit(0)).alias(f"o{i}") for i in range(len(windows))])
    alive = data.join(groups, "cell_name").groupBy("grp").agg(*[F.max(c.cast("int")).alias(f"c{i}") for i, c in enumerate(inside)]).collect()  # one row a group
    d = ordered_scan(data, ["cell_name"], ["Timestamp", "curve"], time_chunk("Timestamp", 21600), sums={f"r{i}": c.cast("int") for i, c in enumerate(learns)})
    d = d.join(offsets, "cell_name").join(groups, "cell_name")
    trains, asked, used = [], [], []
    for i, (c, learn) in enumerate(zip(inside, learns, strict=True)):
        if cohorts[f"c{i}"] < 2:
            continue
        first = i * per
        block = S.contiguous_block(F.col(f"r{i}") + F.col(f"o{i}") - 1, F.lit(cohorts[f"n{i}"]), INNER).cast("int")
        held = sorted(r["grp"] for r in alive if r[f"c{i}"])
        used += [first + j for j in [*held, *range(count, per)]]
        sets = [F.when(F.col("grp") != j, F.lit(first + j)) for j in held] + [F.when(block != j, F.lit(first + count + j)) for j in range(INNER)]
        trains.append(F.when(learn, F.array_compact(F.array(*sets))).otherwise(_none()))
        asked.append(F.when(learn, F.array(block + (first + count))).when(c, F.array(F.col("grp") + first)).otherwise(_none()))
    d = d.withColumns({"trains": F.flatten(F.array(*trains)) if trains else _none(), "asked": F.flatten(F.array(*asked)) if asked else _none()})
    p = twin_predictions(d, ["cell_name", "curve"], used)
    truth = data.select("cell_name", "curve", *[f"{m}_Relative" for m in TWIN])
    p = p.join(truth, ["cell_name", "curve"]).withColumns({"w": F.floor(F.col("set") / per).cast("int"), "inner": F.col("set") % per >= count})
    long = p.select("w", "inner", "cell_name", *[F.abs(F.col(f"p_{m}") - F.col(f"{m}_Relative")).alias(m) for m in TWIN])
    long = settle(long.unpivot(["w", "inner", "cell_name"], list(TWIN), "metric", "r").where(F.col("r").isNotNull()))
    thr = S.residual_threshold(long.where("inner"), "r", ["w", "metric"]).select("w", "metric", F.col("layered").alias("thr"))
    err = long.where("not inner").groupBy("w", "metric", "cell_name").agg(F.avg("r").alias("mae")).groupBy("w", "metric")
    se = F.try_divide(F.stddev_samp("mae"), F.sqrt(F.count("*")))
    err = err.agg(F.count("*").alias("n_folds"), F.avg("mae").alias("mae"), se.alias("se")).join(thr, ["w", "metric"], "full")
    of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{c}_{m}")
    wide = err.groupBy("w").agg(*[of(m, c) for m in TWIN for c in ("n_folds", "thr", "mae", "se")])
    every = data.sparkSession.createDataFrame([(i, float(w), cohorts[f"c{i}"]) for i, w in enumerate(windows)], "w int, window double, n_devices long")
    return every.join(F.broadcast(wide), "w", "left").drop("w")  # one row a window


# -- daily models ------------------------------------------------------------------


def damage_increment_model(matrix: DataFrame, rounds: int | None = None):
    return booster("Daily_Damage_Increment", DAMAGE_PARAMS, rounds).fit(assemble(matrix, DAMAGE_FEATURES))


def state_features(p: str) -> list[str]:
    return ["Daily_Irradiance_Dose", "Daily_Max_Temp_C", "Daily_Median_Humidity", "Rolling_Irradiance", "Rolling_Thermal_load", f"{p}_Lag1"]


def trajectory_models(state: DataFrame, rounds: int | None = None, trees: int | None = None) -> dict:
    """One regressor of the daily change per parameter: boosted for PCE, forests for the rest."""
    data = settle(state)

    def job(p: str):
        est = booster(f"{p}_Delta", DAMAGE_PARAMS, rounds)
        if p != "PCE":
            est = forest(f"{p}_Delta", trees)
        return est.fit(assemble(data, state_features(p)))

    fitted = in_parallel(state.sparkSession, [lambda p=p: job(p) for p in TRAJECTORY_PARAMETERS])
    return dict(zip(TRAJECTORY_PARAMETERS, fitted))


def column_of(rows: str, field: str) -> Column:
    """One field of an array of structs, as an array."""
    return F.transform(rows, lambda r: r[field])


def array_median(a: Column) -> Column:
    s = F.array_sort(a)
    n = F.size(s)
    return (F.element_at(s, F.floor((n + 1) / 2.0).cast("int")) + F.element_at(s, F.ceil((n + 1) / 2.0).cast("int"))) / 2.0


def blind(units: DataFrame, rows: DataFrame, fit: Callable, roll: Callable, empty: str | None = None) -> DataFrame | None:
    """Forecasts of each device by a model that never saw it; without a second device an empty table of schema ``empty``, or None.

    ``fit`` gets the training rows of the other devices, ``roll`` the device's units and
    that model.  Devices are fitted from a few threads; each roll is stored.
    """
    data, todo = settle(rows), settle(units)
    cells = [r[0] for r in todo.select("cell_name").distinct().orderBy("cell_name").collect()]  # device names

    def job(c: str) -> DataFrame | None:
        train = data.where(F.col("cell_name") != c)
        return None if train.isEmpty() else settle(roll(todo.where(F.col("cell_name") == c), fit(train)))

    out = None
    for p in in_parallel(units.sparkSession, [lambda c=c: job(c) for c in cells]):
        if p is not None:
            out = p if out is None else out.unionByName(p)
    return units.sparkSession.createDataFrame([], empty) if out is None and empty else out


def roll_forward_batch(units: DataFrame, model, horizon: int = SETTINGS.horizon_eval, window: int = 2) -> DataFrame:
    """Advance the damage of all units together, one model pass per horizon day.

    A unit shorter than the horizon keeps its last state.  The state is settled
    every few days to keep the plan short.
    """
    u = units.withColumn("damage", F.col("D0"))
    for c in ("Daily_Irradiance_Dose", "Daily_Max_Temp_C"):
        u = u.withColumn(f"mem_{c}", column_of("recent", c))
    for i in range(horizon):
        day = F.get("future", F.lit(i))
        for c in ("Daily_Irradiance_Dose", "Daily_Max_Temp_C", "Daily_Median_Humidity"):
            u = u.withColumn(c, F.coalesce(day[c], F.lit(0.0)))
        for c in ("Daily_Irradiance_Dose", "Daily_Max_Temp_C"):
            grown = F.concat(F.col(f"mem_{c}"), F.array(c))
            u = u.withColumn(f"mem_{c}", F.slice(grown, F.greatest(F.lit(1), F.size(grown) - window + 1), window))
        u = u.withColumn("Rolling_Irradiance", array_median(F.col("mem_Daily_Irradiance_Dose")))
        u = u.withColumn("Rolling_Thermal_load", array_median(F.col("mem_Daily_Max_Temp_C")))
        u = u.withColumn("Cumulative_Damage_Lag1", F.col("damage"))
        scored = model.transform(assemble(u, DAMAGE_FEATURES))
        u = scored.withColumn("damage", F.col("damage") + F.when(F.col("n_future") > i, F.col("prediction")).otherwise(0.0))
        u = u.drop("features", "prediction", *DAMAGE_FEATURES)
        if i % 5 == 4:
            u = settle(u)
    return u.withColumn("D_end", F.when(F.col("n_future") > 0, F.col("damage"))).drop("damage", "mem_Daily_Irradiance_Dose", "mem_Daily_Max_Temp_C")


def trajectory_roll_forward(units: DataFrame, models: dict, horizon: int = SETTINGS.horizon_sim, window: int = SETTINGS.rolling_window) -> DataFrame:
    """Advance all parameters of all units day by day; states never fall below zero."""
    u = units
    for c in ("Daily_Irradiance_Dose", "Daily_Max_Temp_C"):
        u = u.withColumn(f"mem_{c}", column_of("recent", c))
    for p in TRAJECTORY_PARAMETERS:
        u = u.withColumn(f"s_{p}", F.col(f"{p}_State")).withColumn(f"path_{p}", F.array().cast("array<double>"))
    drop = ["Daily_Irradiance_Dose", "Daily_Max_Temp_C", "Daily_Median_Humidity", "Rolling_Irradiance", "Rolling_Thermal_load"]
    keep = ["cell_name", "anchor", "n_future", "is_truncated", "future", *[f"{p}_Init" for p in TRAJECTORY_PARAMETERS]]
    u = u.select(*keep, *[c for c in u.columns if c.startswith(("mem_", "s_", "path_"))])
    for i in range(horizon):
        day = F.get("future", F.lit(i))
        for c in drop[:3]:
            u = u.withColumn(c, F.coalesce(day[c], F.lit(0.0)))
        for c in drop[:2]:
            grown = F.concat(F.col(f"mem_{c}"), F.array(c))
            u = u.withColumn(f"mem_{c}", F.slice(grown, F.greatest(F.lit(1), F.size(grown) - window + 1), window))
        u = u.withColumn("Rolling_Irradiance", array_median(F.col("mem_Daily_Irradiance_Dose")))
        u = u.withColumn("Rolling_Thermal_load", array_median(F.col("mem_Daily_Max_Temp_C")))
        for p in TRAJECTORY_PARAMETERS:
            u = u.withColumn(f"{p}_Lag1", F.col(f"s_{p}"))
            u = models[p].transform(assemble(u, state_features(p)))
            nxt = F.greatest(F.lit(0.0), F.col(f"s_{p}") + F.col("prediction"))
            u = u.withColumn(f"s_{p}", nxt).withColumn(f"path_{p}", F.concat(f"path_{p}", F.array(nxt))).drop("features", "prediction", f"{p}_Lag1")
        u = u.drop(*drop)
        if i % 3 == 2:
            u = settle(u)
    z = u.select(
        "cell_name", "anchor", "n_future", "is_truncated", *[f"{p}_Init" for p in TRAJECTORY_PARAMETERS],
        F.posexplode(F.arrays_zip("future", *[f"path_{p}" for p in TRAJECTORY_PARAMETERS])).alias("pos", "z"),
    ).where(F.col("pos") < F.col("n_future"))
    return z.select(
        "cell_name", "anchor", "n_future", "is_truncated", (F.col("pos") + 1).alias("step"), F.col("z.future.Date_Day").alias("Date_Day"),
        F.col("z.future.Exposure_Days").alias("Exposure_Days"),
        *[(F.col(f"z.future.{p}_State") * F.col(f"{p}_Init")).alias(f"Actual_{p}") for p in TRAJECTORY_PARAMETERS],
        *[(F.col(f"z.path_{p}") * F.col(f"{p}_Init")).alias(f"Pred_{p}") for p in TRAJECTORY_PARAMETERS],
    )


# -- audits of the daily models ------------------------------------------------------


def cv_folds(matrix: DataFrame, k: int = 5) -> DataFrame:
    """Shuffled folds by row hash and grouped folds by device hash."""
    return matrix.withColumn("shuffled", F.pmod(F.xxhash64("cell_name", "Date_Day"), F.lit(k))).withColumn(
        "grouped", F.pmod(F.xxhash64("cell_name"), F.lit(k))
    )


def zoo(label: str, rounds: int | None = None, trees: int | None = None, n: int = 1) -> dict:
    """Estimators compared by the audit; penalties are fixed values, for a sum over ``n`` training rows."""
    z = {f"ridge_{a}": LinearRegression(labelCol=label, regParam=a / n) for a in (0.1, 1.0, 10.0, 100.0)}
    z["forest"] = forest(label, trees)
    z["booster"] = booster(label, DAMAGE_PARAMS, rounds)
    return z


def model_zoo_cv(matrix: DataFrame, label: str = "Daily_Damage_Increment", rounds: int | None = None, trees: int | None = None, k: int = 5) -> DataFrame:
    """Cross-validated errors of dummies, ridges, forest and booster under two fold schemes."""
    data = settle(assemble(cv_folds(matrix, k), DAMAGE_FEATURES))
    spark = matrix.sparkSession
    y = F.col(label)

    def job(scheme: str, i: int, name: str):
        train, test = data.where(F.col(scheme) != i), data.where(F.col(scheme) == i)
        if train.isEmpty() or test.isEmpty():
            return None
        if name == "dummy_mean":
            scored = test.crossJoin(F.broadcast(train.agg(F.avg(y).alias("prediction"))))  # one row
        elif name == "dummy_median":
            scored = test.crossJoin(F.broadcast(exact_quantiles(train, [], label, {"prediction": 0.5}).drop("n")))  # one row
        else:
            scored = zoo(label, rounds, trees, train.count())[name].fit(train).transform(test)
        return scored.select(F.lit(scheme).alias("scheme"), F.lit(name).alias("model"), y.alias("y"), "prediction")

    names = ["dummy_mean", "dummy_median", *zoo(label, rounds, trees)]
    jobs = [lambda s=s, i=i, n=n: job(s, i, n) for s in ("shuffled", "grouped") for n in names for i in range(k)]
    scored = spark.createDataFrame([], "scheme string, model string, y double, prediction double")
    for p in in_parallel(spark, jobs):
        if p is not None:
            scored = scored.unionByName(p)
    scored = settle(scored)
    keys = ["scheme", "model"]
    e = F.col("prediction") - F.col("y")
    med = exact_quantiles(scored.withColumn("ae", F.abs(e)), keys, "ae", {"medae": 0.5}).drop("n")
    total = F.var_pop("y") * F.count("*")
    return scored.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1.0 - F.sum(e * e) / F.nullif(total, F.lit(0.0))).alias("r2")
    ).join(med, keys)


def permutation_importance(matrix: DataFrame, model, label: str, features: Sequence[str], repeats: int = 20, slices: int = 256) -> DataFrame:
    """Rise of the error when a feature is shuffled; all repeats of a feature are scored in one pass.

    Every repeat permutes all rows: two random orders are ranked, each by slices of its
    own key, and the row of a rank in one order takes the value of that rank in the other.
    """
    key = F.concat_ws("|", "cell_name", F.col("Date_Day").cast("string"))
    base = settle(matrix.select("cell_name", "Date_Day", label, *features).withColumn("key", key))
    plain = model.transform(assemble(base, features)).agg(mae(F.col("prediction"), F.col(label)).alias("base_mae"))
    shuffled = base.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    for rank in ("ra", "rb"):
        at = f"at_{rank}"
        shuffled = shuffled.withColumn(at, F.xxhash64("key", "rep", F.lit(rank)))
        part = F.floor(F.col(at) / F.lit(2.0**64 / slices)).cast("long")
        shuffled = ordered_scan(shuffled, ["rep"], [at, "key"], part, sums={rank: F.lit(1)})
    shuffled = settle(shuffled)
    out = None
    for f in features:
        donor = shuffled.select("rep", F.col("rb").alias("ra"), F.col(f).alias("moved"))
        s = shuffled.join(donor, ["rep", "ra"]).withColumn(f, F.col("moved"))
        m = model.transform(assemble(s, features)).groupBy("rep").agg(mae(F.col("prediction"), F.col(label)).alias("m"))
        part = m.agg(F.lit(f).alias("feature"), F.avg("m").alias("m"), F.stddev_samp("m").alias("std"))
        out = part if out is None else out.unionByName(part)
    return out.crossJoin(F.broadcast(plain)).select("feature", (F.col("m") - F.col("base_mae")).alias("importance"), "std")  # one row


def split_gain_importance(model, spark, features: Sequence[str]) -> DataFrame:
    """Importances of a fitted tree ensemble (one number per feature)."""
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())], "feature string, importance double")


def damage_boost(rounds: int | None = None) -> B.Boost:
    return B.settings({**DAMAGE_PARAMS, **({"maxIter": rounds} if rounds else {})}, **DAMAGE_PENALTIES)


def feature_ablation(matrix: DataFrame, label: str = "Daily_Damage_Increment", features: Sequence[str] = tuple(DAMAGE_FEATURES), rounds: int | None = None) -> DataFrame:
    """Paired change of the leave-one-device-out error, and verdict, when each feature is left out.

    All devices and all feature sets are fitted at once.  One device alone leaves nothing
    to learn from: an empty table.
    """
    from helioframe.operators.forecast import paired_delta

    data = settle(matrix)
    groups = settle(device_groups(data))
    count = (groups.agg(F.max("grp").alias("m")).first()["m"] or 0) + 1
    every = range(len(features))
    kept = [tuple(every), *[tuple(i for i in every if i != j) for j in every]]
    models = [B.Model(g, 0, f, damage_boost(rounds)) for g in range(count) for f in kept]
    d = data.join(groups, "cell_name")
    others = F.filter(F.sequence(F.lit(0), F.lit(count - 1)), lambda g: g != F.col("grp"))
    d = d.withColumns({"trains": others, "asked": F.array("grp")})
    keys = ["cell_name", "Date_Day"]
    got, _ = B.fit_many(d, keys, features, [label], models)
    err = got.where("prediction IS NOT NULL").join(data.select(*keys, F.col(label).alias("y")), keys)
    err = settle(err.groupBy("cell_name", (F.col("model") % len(kept)).alias("left_out")).agg(mae(F.col("prediction"), F.col("y")).alias("mae")))
    base, out = err.where("left_out = 0").select("cell_name", "mae"), None
    for i, f in enumerate(features):
        part = paired_delta(base, err.where(F.col("left_out") == i + 1).select("cell_name", "mae")).withColumn("feature", F.lit(f))
        out = part if out is None else out.unionByName(part)
    return out.where("n_folds > 0")


def null_model_error(matrix: DataFrame, label: str) -> DataFrame:
    """Error of the training median per holdout (daily rows, one fold per device)."""
    m = matrix.select("cell_name", F.col(label).alias("y"))
    med = left_out_quantile(m, [], "cell_name", "y", 0.5).select("cell_name", F.col("value").alias("median"))
    return m.join(med, "cell_name").groupBy("cell_name").agg(mae(F.col("median"), F.col("y")).alias("mae"), F.count("*").alias("n"))


def window_signal_sweep(curves: DataFrame, windows: Sequence[int], rounds: int | None = None, k: int = 5) -> DataFrame:
    """Gain of the booster over the mean for several smoothing windows, all fitted at once.

    The daily matrix of each window is cut into ``k`` shuffled folds; a fold is predicted
    from the others.  A window without rows is not reported.
    """
    from helioframe.operators.features import daily_rul_matrix

    y, keys, d = F.col("Daily_Damage_Increment"), ["window", "cell_name", "Date_Day"], None
    for i, w in enumerate(windows):
        part = cv_folds(daily_rul_matrix(curves, w), k).select(F.lit(w).alias("window"), F.lit(i * k).alias("first"), "cell_name", "Date_Day", "shuffled", *DAMAGE_FEATURES, y.alias("y"))
        d = part if d is None else d.unionByName(part)
    folds = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: j != F.col("shuffled"))
    d = settle(d.withColumns({"trains": F.transform(folds, lambda j: (j + F.col("first")).cast("int")), "asked": F.array((F.col("shuffled") + F.col("first")).cast("int"))}))
    every = tuple(range(len(DAMAGE_FEATURES)))
    got, _ = B.fit_many(d, keys, DAMAGE_FEATURES, ["y"], [B.Model(s, 0, every, damage_boost(rounds)) for s in range(len(windows) * k)])
    sums = d.groupBy("window", "shuffled").agg(F.sum("y").alias("s"), F.count("y").alias("c"))  # a few rows a window
    of = W.partitionBy("window")
    means = sums.select("window", "shuffled", ((F.sum("s").over(of) - F.col("s")) / F.nullif(F.sum("c").over(of) - F.col("c"), F.lit(0))).alias("mean"))
    p = got.join(d.select(*keys, "shuffled", "y"), keys).join(means, ["window", "shuffled"])
    m = p.groupBy("window").agg(mae(F.col("prediction"), F.col("y")).alias("mae_model"), mae(F.col("mean"), F.col("y")).alias("mae_mean"))
    return m.withColumn("gain_pct", 100.0 * (F.col("mae_mean") - F.col("mae_model")) / F.nullif(F.col("mae_mean"), F.lit(0.0)))


# -- shapes --------------------------------------------------------------------------


def pca_fit_project(df: DataFrame, k: int):
    """Centred principal components: projected shapes and the explained shares."""
    v = df.withColumn("raw_vec", array_to_vector("shape"))
    centred = StandardScaler(inputCol="raw_vec", outputCol="vec", withMean=True, withStd=False).fit(v).transform(v)
    model = PCA(k=k, inputCol="vec", outputCol="pc").fit(centred)
    return model.transform(centred).withColumn("scores", vector_to_array("pc")).drop("raw_vec", "vec", "pc"), model


def components_for_variance(shares: Sequence[float], target: float = 0.90) -> int:
    """First count of components whose cumulative share reaches the target, else all."""
    total = 0.0
    for i, s in enumerate(shares, 1):
        total += s
        if total >= target:
            return i
    return len(shares)


def cluster_once(df: DataFrame, k: int, target: float = 0.90) -> DataFrame:
    """Reduce, cluster, and label each shape by its nearest representative."""
    dims = len(df.select("shape").first()[0])
    full, model = pca_fit_project(df, dims)
    n = components_for_variance(model.explainedVariance.toArray(), target)
    v = full.withColumn("pc", array_to_vector(F.slice("scores", 1, n)))
    labels = KMeans(k=k, seed=SEED, featuresCol="pc", predictionCol="seed_label").fit(v).transform(v)
    labels = settle(labels.select("vec_id", "shape", F.col("seed_label").alias("label")))
    meds = H.medoids(labels, "vec_id")
    return H.medoid_assign(labels, meds).select("vec_id", "shape", F.col("assigned").alias("label"))


def kmeans_per_k(df: DataFrame, branch: int, ks: Sequence[int] = tuple(range(2, 9)), target: float = 0.90, restarts: int = 10) -> tuple[DataFrame, DataFrame]:
    """KMeans for every ``k`` on the reduced shapes, the best of some starts.

    Returns ``vec_id``, ``k``, ``label`` and the reduced ``shape`` (of a settled table), and the
    smallest gap between the pseudo fill factors of each ``k``'s centres, led back to shapes.
    """
    spark = df.sparkSession
    dims = len(df.select("shape").first()[0])
    full, model = pca_fit_project(df, dims)
    n = components_for_variance(model.explainedVariance.toArray(), target)
    v = settle(full.select("vec_id", F.slice("scores", 1, n).alias("shape")))
    data = v.withColumn("pc", array_to_vector("shape"))
    vectors = data.select("pc").persist(StorageLevel.MEMORY_AND_DISK)  # else each fit keeps its own
    mean = np.array(H.centres(df, []).first()["centre"])  # one shape
    back = model.pc.toArray()[:, :n].T

    def job(k: int, seed: int):
        fit = KMeans(k=k, seed=seed, featuresCol="pc", predictionCol="label").fit(vectors)
        return fit.summary.trainingCost, seed, fit

    jobs = [lambda k=k, s=s: (k, job(k, SEED + s)) for k in ks for s in range(restarts)]
    best: dict[int, tuple] = {}
    for k, got in in_parallel(spark, jobs):
        best[k] = min(best.get(k, got), got, key=lambda g: g[:2])
    vectors.unpersist()
    gaps = []
    for k, (_, _, fit) in best.items():
        data = fit.setPredictionCol(f"label_{k}").transform(data)
        centre = mean + np.array(fit.clusterCenters()) @ back
        axis = np.linspace(0.0, 1.0, branch)
        ff = np.sort(((axis * centre[:, :branch]).max(axis=1) + (axis * centre[:, branch : 2 * branch]).max(axis=1)) / 2.0)
        gaps.append((k, float(np.diff(ff).min()) if len(ff) > 1 else None))
    labels = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"label_{k}").alias("label")) for k in best])
    kept = settle(data.select("vec_id", "shape", labels.alias("labels")))  # each shape once, whatever the counts
    return kept.select("vec_id", F.inline("labels"), "shape"), spark.createDataFrame(gaps, "k int, min_delta_pff double")


def best_k(df: DataFrame, branch: int) -> int:
    """Count of clusters that the quality of the fits for k = 2..8 asks for."""
    labels, gaps = kmeans_per_k(df, branch)
    return H.choose_k(H.elbow_distance(H.cluster_quality(labels)).join(gaps, "k")).first()["k"]  # one number


def prune_and_retrain(df: DataFrame, k: int | None, branch: int, rounds: int = 5, validity: Callable | None = None) -> DataFrame:
    """Drop clusters with implausible representatives and refit, a few rounds at most.

    Shapes pruned in any round end with label -1.  Each round is settled, and chooses
    its own count of clusters if ``k`` is None.
    """
    check = validity or (lambda m: H.medoid_validity(m, branch))
    active = settle(df.select("vec_id", "shape"))
    labelled, fixed = None, k
    for _ in range(rounds):
        k = fixed or best_k(active, branch)
        labelled = settle(cluster_once(active, k))
        bad = settle(check(H.medoids(labelled, "vec_id")).where(~F.col("is_valid")).select("label"))
        if bad.isEmpty():
            break
        survivors = settle(labelled.join(F.broadcast(bad), "label", "left_anti").select("vec_id", "shape"))
        labelled = labelled.join(survivors.select("vec_id"), "vec_id", "left_semi")
        if survivors.limit(k + 1).count() <= k:
            break
        active = survivors
    final = labelled.select("vec_id", "label")
    return df.select("vec_id").join(final, "vec_id", "left").withColumn("label", F.coalesce("label", F.lit(-1)))
