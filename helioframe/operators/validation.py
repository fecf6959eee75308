"""Out-of-fold predictions of the daily models, and every audit statistic that follows from them.

``out_of_fold`` gives one table: a row of the daily matrix, a fold scheme, a target, a
model, the truth and the prediction.  It is stored once; scores, biases, correlations of
residuals, overfit gaps, exposure phases and verdicts are aggregates of it.

Rows enter in one long shape for all targets (``long_rows``), so that folds, dummies and
ridges of all targets come from one pass each, whatever the number of devices.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from helioframe.config import DAMAGE_FEATURES, DAMAGE_PARAMS, DAMAGE_PENALTIES, TRAJECTORY_PARAMETERS
from helioframe.functions.expr import correlation
from helioframe.functions.ordered import exact_quantiles, left_out_quantile
from helioframe.functions.stages import settle
from helioframe.operators import boosting as B, models as M

FOLDS = 5
SCHEMES = ("shuffled", "grouped")
#: Ridge penalties, penalties of the second booster, share of the error that marks an overfit.
RIDGES, OTHER_PENALTIES, OVERFIT_SHARE = (0.1, 1.0, 10.0, 100.0), {"l2": 100.0, "l1": 1.0}, 0.30
#: Gains in percent below which there is no or a weak signal, least correlation with the own lag.
NO_SIGNAL_PCT, WEAK_SIGNAL_PCT, LEAST_LAG_CORR = 3.0, 10.0, 0.10
OOF = "cell_name string, Date_Day date, Exposure_Days double, target string, scheme string, fold int, model string, y double, prediction double"


@dataclass(frozen=True)
class Target:
    """A daily change to predict; the last feature is its own lag."""

    name: str
    label: str
    features: tuple[str, ...]


def damage_targets() -> list[Target]:
    return [Target("Damage", "Daily_Damage_Increment", tuple(DAMAGE_FEATURES))]


def trajectory_targets() -> list[Target]:
    return [Target(p, f"{p}_Delta", tuple(M.state_features(p))) for p in TRAJECTORY_PARAMETERS]


def hash_fold(key: Column, k: int = FOLDS) -> Column:
    """Fold of a text, from the first 32 bits of its MD5 sum."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")


def long_rows(matrix: DataFrame, targets: Sequence[Target], k: int = FOLDS) -> DataFrame:
    """One row a target and complete matrix row, with ``y``, features ``x`` and the fold of each scheme.

    Rows with a null or NaN in the label or a feature are left out for that target.  All
    targets have the same number of features.
    """
    day = F.concat_ws("|", "cell_name", F.date_format("Date_Day", "yyyy-MM-dd"))
    at = [hash_fold(day, k).alias("shuffled"), hash_fold(F.col("cell_name"), k).alias("grouped")]
    of = [
        F.struct(F.lit(t.name).alias("target"), F.col(t.label).cast("double").alias("y"), F.array(*[F.col(f).cast("double") for f in t.features]).alias("x"))
        for t in targets
    ]
    long = matrix.select("cell_name", "Date_Day", F.col("Exposure_Days").cast("double"), *at, F.explode(F.array(*of)).alias("t")).select("*", "t.*").drop("t")
    known = lambda v: v.isNotNull() & ~F.isnan(v)
    return long.where(known(F.col("y")) & F.forall("x", known))


def by_scheme(long: DataFrame) -> DataFrame:
    """One row a scheme, with its fold."""
    both = F.array(*[F.struct(F.lit(s).alias("scheme"), F.col(s).alias("fold")) for s in SCHEMES])
    return long.withColumn("s", F.explode(both)).select("*", "s.*").drop("s", *SCHEMES)


def _shape(df: DataFrame) -> DataFrame:
    return df.select(*[c.split()[0] for c in OOF.split(", ")])


def dummies(folded: DataFrame) -> DataFrame:
    """Mean and median of the training rows.  A fold without training rows is not predicted."""
    keys = ["target", "scheme"]
    sums = folded.groupBy(*keys, "fold").agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    every = W.partitionBy(*keys)  # one row a fold
    rest = F.sum("n").over(every) - F.col("n")
    mean = sums.select(*keys, "fold", ((F.sum("s").over(every) - F.col("s")) / F.nullif(rest, F.lit(0))).alias("dummy_mean"))
    med = left_out_quantile(folded, keys, "fold", "y", 0.5).select(*keys, "fold", F.col("value").alias("dummy_median"))
    names = ["dummy_mean", "dummy_median"]
    fits = mean.join(med, [*keys, "fold"], "left")
    got = folded.join(F.broadcast(fits), [*keys, "fold"])  # a row a target, scheme and fold
    every_model = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("prediction")) for m in names]))
    return _shape(got.withColumn("m", every_model).select("*", "m.*").where(F.col("prediction").isNotNull()))


def ridges(folded: DataFrame, alphas: Sequence[float] = RIDGES) -> DataFrame:
    """Standardised ridge regressions, all folds from one pass of sums.

    Sums of products of each fold, about the means of the target's rows, give those of the
    other folds; the small systems (a few features each) are solved on the driver: targets
    x schemes x folds of them.  A feature without spread has no weight.
    """
    keys, m = ["target", "scheme"], len(folded.select("x").first()["x"]) if not folded.isEmpty() else 0
    if not m:
        return folded.sparkSession.createDataFrame([], OOF)
    z = [*[F.get("x", F.lit(i)) for i in range(m)], F.col("y")]
    centre = folded.groupBy(*keys).agg(F.array(*[F.avg(c) for c in z]).alias("c"))
    moved = folded.join(F.broadcast(centre), keys)  # a row a target and scheme
    d = [c - F.get("c", F.lit(i)) for i, c in enumerate(z)]
    pairs = [(i, j) for i in range(m + 1) for j in range(i, m + 1)]
    sums = moved.groupBy(*keys, "fold").agg(F.first("c").alias("c"), F.count("*").alias("n"), F.array(*[F.sum(v) for v in d]).alias("s"), F.array(*[F.sum(d[i] * d[j]) for i, j in pairs]).alias("p"))
    parts: dict[tuple, dict[int, tuple]] = {}
    for r in sums.collect():  # one row a target, scheme and fold
        p = np.zeros((m + 1, m + 1))
        for (i, j), v in zip(pairs, r["p"], strict=True):
            p[i, j] = p[j, i] = v
        parts.setdefault((r["target"], r["scheme"]), {})[r["fold"]] = (r["n"], np.array(r["s"]), p, np.array(r["c"]))
    fits = []
    for (target, scheme), of in parts.items():
        for fold in of:
            rest = [of[f] for f in sorted(of) if f != fold]
            n = sum(v[0] for v in rest)
            if not n:
                continue
            s, p, c = sum(v[1] for v in rest), sum(v[2] for v in rest), rest[0][3]
            cov = p / n - np.outer(s, s) / n**2
            spread = np.sqrt(np.maximum(np.diag(cov)[:m], 0.0))
            used = np.flatnonzero(spread > 1e-12 * np.maximum(1.0, np.abs(c[:m])))
            corr = cov[np.ix_(used, used)] / np.outer(spread[used], spread[used])
            for a in alphas:
                w = np.zeros(m)
                w[used] = np.linalg.solve(corr * n + a * np.eye(len(used)), cov[used, m] / spread[used] * n) / spread[used]
                fits.append((target, scheme, fold, f"ridge_{a}", [float(v) for v in w], float(c[m] + s[m] / n - w @ (c[:m] + s[:m] / n))))
    weights = folded.sparkSession.createDataFrame(fits, "target string, scheme string, fold int, model string, w array<double>, b double")
    got = folded.join(F.broadcast(weights), [*keys, "fold"])  # a row a model
    dot = F.aggregate(F.zip_with("x", "w", lambda x, w: x * w), F.col("b"), lambda s, v: s + v)
    return _shape(got.withColumn("prediction", dot))


def forests(long: DataFrame, targets: Sequence[Target], trees: int | None = None, k: int = FOLDS) -> DataFrame:
    """Random forests: one fit a target, scheme and fold, whatever the number of devices."""
    data = settle(long.withColumn("features", array_to_vector("x")))

    def job(t: str, scheme: str, i: int):
        mine = data.where(F.col("target") == t)
        train, test = mine.where(F.col(scheme) != i), mine.where(F.col(scheme) == i)
        if train.isEmpty() or test.isEmpty():
            return None
        got = M.forest("y", trees).fit(train).transform(test)
        return settle(_shape(got.select("*", F.lit(scheme).alias("scheme"), F.col(scheme).alias("fold"), F.lit("forest").alias("model"))))

    jobs = [lambda t=t, s=s, i=i: job(t.name, s, i) for t in targets for s in SCHEMES for i in range(k)]
    out = long.sparkSession.createDataFrame([], OOF)
    for p in M.in_parallel(long.sparkSession, jobs):
        if p is not None:
            out = out.unionByName(p)
    return out


def _others(folds: Column, scheme: str, first: int) -> Column:
    """Set numbers of the folds that a row is not in."""
    return F.transform(F.filter(folds, lambda j: j != F.col(scheme)), lambda j: (j + first).cast("int"))


def boosters(matrix: DataFrame, targets: Sequence[Target], rounds: int | None = None, k: int = FOLDS) -> DataFrame:
    """The daily booster with its own and with stronger penalties, all folds and targets fitted at once.

    Scheme ``train`` holds what the booster says of the rows that it was fitted to.
    """
    features = list(dict.fromkeys(f for t in targets for f in t.features))
    day = F.concat_ws("|", "cell_name", F.date_format("Date_Day", "yyyy-MM-dd"))
    at = [hash_fold(day, k).alias("shuffled"), hash_fold(F.col("cell_name"), k).alias("grouped")]
    used = [*features, *[t.label for t in targets]]
    finite = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    d = matrix.select("cell_name", "Date_Day", *[finite(c).alias(c) for c in used], *at)
    everything = len(SCHEMES) * k
    per, trains, asked = everything + 1, [], []
    folds = F.sequence(F.lit(0), F.lit(k - 1))
    for n, t in enumerate(targets):
        sets, asks = [F.array(F.lit(n * per + everything))], [F.lit(n * per + everything)]
        for i, s in enumerate(SCHEMES):
            first = n * per + i * k
            sets.append(_others(folds, s, first))
            asks.append((F.col(s) + first).cast("int"))
        whole = F.forall(F.array(t.label, *t.features), lambda v: v.isNotNull())
        none = F.array().cast("array<int>")
        trains.append(F.when(whole, F.flatten(F.array(*sets))).otherwise(none))
        asked.append(F.when(whole, F.array(*asks)).otherwise(none))
    # What a target lacks is 0 here and in none of its sets.
    d = d.withColumns({"trains": F.flatten(F.array(*trains)), "asked": F.flatten(F.array(*asked))}).fillna(0.0, used)
    own = B.settings({**DAMAGE_PARAMS, **({"maxIter": rounds} if rounds else {})}, **DAMAGE_PENALTIES)
    other = B.settings({**DAMAGE_PARAMS, **({"maxIter": rounds} if rounds else {})}, **{**DAMAGE_PENALTIES, **OTHER_PENALTIES})
    models, names = [], []
    for n, t in enumerate(targets):
        at = tuple(features.index(f) for f in t.features)
        for name, boost in (("booster", own), ("booster_l2_100", other)):
            sets = range(everything + (name == "booster"))
            models += [B.Model(n * per + s, n, at, boost) for s in sets]
            names += [(t.name, *(("train", 0) if s == everything else (SCHEMES[s // k], s % k)), name) for s in sets]
    got, _ = B.fit_many(d, ["cell_name", "Date_Day"], features, [t.label for t in targets], models)
    spec = "model_no int, target string, scheme string, fold int, model string"
    which = matrix.sparkSession.createDataFrame([(i, *n) for i, n in enumerate(names)], spec)
    got = got.withColumnRenamed("model", "model_no").join(F.broadcast(which), "model_no")  # a row a model
    truth = long_rows(matrix, targets, k).select("cell_name", "Date_Day", "Exposure_Days", "target", "y")
    return _shape(got.where("prediction IS NOT NULL").join(truth, ["cell_name", "Date_Day", "target"]))


def out_of_fold(matrix: DataFrame, targets: Sequence[Target], rounds: int | None = None, trees: int | None = None, k: int = FOLDS) -> DataFrame:
    """Predictions of all models of the audit, one row a matrix row, target, scheme and model.

    Models: mean and median, four ridges, a forest and two boosters; schemes: rows dealt
    to ``k`` folds by hash, devices dealt to ``k`` folds by hash, and ``train`` (booster
    only).  ``matrix`` has one row a ``cell_name`` and ``Date_Day``.  A fold whose
    training rows are empty (a single device under ``grouped``) has no predictions; an
    empty matrix gives an empty table.
    """
    data = settle(matrix.select("cell_name", "Date_Day", "Exposure_Days", *dict.fromkeys(c for t in targets for c in (*t.features, t.label))))
    long = settle(long_rows(data, targets, k))
    if long.isEmpty():
        return matrix.sparkSession.createDataFrame([], OOF)
    folded = settle(by_scheme(long))
    jobs = [lambda: boosters(data, targets, rounds, k), lambda: forests(long, targets, trees, k), lambda: ridges(folded), lambda: dummies(folded)]
    out = None
    for part in M.in_parallel(matrix.sparkSession, jobs):
        out = part if out is None else out.unionByName(part)
    return out


# -- statistics of the table -----------------------------------------------------------

METRICS = ("mae", "rmse", "medae", "r2")


def _error() -> Column:
    return F.col("prediction") - F.col("y")


def fold_scores(oof: DataFrame) -> DataFrame:
    """Mean and population deviation over folds of four error measures, by target, scheme and model.

    R2 of a fold of one row, or without spread, is NULL and does not count.
    """
    keys = ["target", "scheme", "model"]
    rows = oof.where("scheme <> 'train'").withColumn("ae", F.abs(_error()))
    med = exact_quantiles(rows, [*keys, "fold"], "ae", {"medae": 0.5}).drop("n")
    total = F.var_pop("y") * F.count("*")
    r2 = F.when(F.min("y") < F.max("y"), 1.0 - F.sum(_error() * _error()) / F.nullif(total, F.lit(0.0)))
    per = rows.groupBy(*keys, "fold").agg(F.count("*").alias("n"), F.avg("ae").alias("mae"), F.sqrt(F.avg(_error() * _error())).alias("rmse"), r2.alias("r2")).join(med, [*keys, "fold"])
    stats = [f(m).alias(f"{m}_{tag}") for m in METRICS for tag, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return per.groupBy(*keys).agg(F.count("*").alias("n_folds"), F.sum("n").alias("n"), *stats)


def device_errors(oof: DataFrame, model: str = "booster") -> DataFrame:
    """Error and mean residual (truth less prediction) of each device."""
    rows = oof.where((F.col("scheme") != "train") & (F.col("model") == model))
    return rows.groupBy("target", "scheme", "cell_name").agg(F.count("*").alias("n"), F.avg(F.abs(_error())).alias("mae"), F.avg(-_error()).alias("bias"))


def residual_correlations(oof: DataFrame, matrix: DataFrame, targets: Sequence[Target], model: str = "booster") -> DataFrame:
    """Correlation of the out-of-fold residuals with each feature; NULL where one has no spread."""
    rows = oof.where((F.col("scheme") != "train") & (F.col("model") == model))
    feats = long_rows(matrix, targets).select("cell_name", "Date_Day", "target", "x")
    j = rows.select("cell_name", "Date_Day", "target", "scheme", (-_error()).alias("r")).join(feats, ["cell_name", "Date_Day", "target"])
    m = len(targets[0].features)
    got = j.groupBy("target", "scheme").agg(*[correlation("r", F.get("x", F.lit(i))).alias(f"c{i}") for i in range(m)])
    names = F.lit(None)
    for t in targets:
        names = F.when(F.col("target") == t.name, F.array(*[F.lit(f) for f in t.features])).otherwise(names)
    pairs = F.arrays_zip(names.alias("feature"), F.array(*[f"c{i}" for i in range(m)]).alias("corr"))
    out = got.select("target", "scheme", F.explode(pairs).alias("z")).select("target", "scheme", F.col("z").getField("feature").alias("feature"), F.col("z").getField("corr").alias("corr"))
    return out.withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))


def overfit_gap(oof: DataFrame, model: str = "booster", share: float = OVERFIT_SHARE) -> DataFrame:
    """Mean fold error under shuffled folds against the error on the training rows."""
    rows = oof.where(F.col("model") == model)
    cv = rows.where("scheme = 'shuffled'").groupBy("target", "fold").agg(F.avg(F.abs(_error())).alias("m")).groupBy("target").agg(F.avg("m").alias("mae_cv"))
    train = rows.where("scheme = 'train'").groupBy("target").agg(F.avg(F.abs(_error())).alias("mae_train"))
    gap = F.col("mae_cv") - F.col("mae_train")
    return cv.join(train, "target").withColumn("gap", gap).withColumn("is_overfit", gap > share * F.col("mae_cv"))


def phase_errors(oof: DataFrame, model: str = "booster", bins: int = 4) -> DataFrame:
    """Out-of-fold error by quantile bin of exposure (right-closed), for each target under shuffled folds."""
    rows = oof.where((F.col("scheme") == "shuffled") & (F.col("model") == model) & F.col("Exposure_Days").isNotNull())
    edges = exact_quantiles(rows, ["target"], "Exposure_Days", {f"e{i}": i / bins for i in range(1, bins)}).drop("n")
    b = F.lit(bins)
    for i in range(bins - 1, 0, -1):
        b = F.when(F.col("Exposure_Days") <= F.col(f"e{i}"), i).otherwise(b)
    got = rows.join(F.broadcast(edges), "target").withColumn("bin", b)  # a row a target
    return got.groupBy("target", "bin").agg(F.count("*").alias("n"), F.avg(F.abs(_error())).alias("mae"), F.min("Exposure_Days").alias("lo"), F.max("Exposure_Days").alias("hi"))


def signal_verdicts(scores: DataFrame, lags: DataFrame) -> DataFrame:
    """Verdict of each target: gain of the best model over the mean under shuffled folds.

    A winning dummy means no signal.  ``lags`` holds ``target`` and the correlation
    ``lag_corr`` of the target with its own lag.
    """
    s = scores.where("scheme = 'shuffled'")
    best = s.groupBy("target").agg(
        F.min_by("model", F.struct("mae_mean", "model")).alias("best_model"), F.min("mae_mean").alias("best_mae"),
        F.max(F.when(F.col("model") == "dummy_mean", F.col("mae_mean"))).alias("baseline_mae"),
    )
    gain = F.when(F.col("baseline_mae") > 0, 100.0 * (F.col("baseline_mae") - F.col("best_mae")) / F.col("baseline_mae")).otherwise(0.0)
    dummy = F.col("best_model").startswith("dummy")
    verdict = F.when(dummy | (F.col("gain_pct") < NO_SIGNAL_PCT), "no_signal").when(F.col("gain_pct") < WEAK_SIGNAL_PCT, "weak").otherwise("real")
    lag = F.when(F.col("lag_corr").isNull(), "unavailable").when(F.abs("lag_corr") < LEAST_LAG_CORR, "none").otherwise("autocorrelated")
    out = best.withColumn("gain_pct", gain).withColumn("verdict", verdict)
    return out.join(lags, "target", "left").withColumn("lag_verdict", lag)


def lag_correlations(long: DataFrame) -> DataFrame:
    """Correlation of each target with its own lag, the last feature; NULL without spread."""
    c = correlation("y", F.element_at("x", -1))
    return long.groupBy("target").agg(c.alias("c")).select("target", F.when(~F.isnan("c"), F.col("c")).alias("lag_corr"))
