"""Out-of-fold table and its statistics against plain loops and SQL on the stored table."""

import datetime
import glob
import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helioframe.functions.ordered import exact_quantiles, left_out_quantile
from helioframe.functions.stages import settle
from helioframe.operators import validation as V
from helioframe.config import DAMAGE_FEATURES

LABEL = "Daily_Damage_Increment"
T = V.damage_targets()


def make(spark, cells=6, days=25, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(cells):
        for d in range(days):
            x = rng.normal(size=len(DAMAGE_FEATURES))
            y = 0.5 * x[0] - 0.3 * x[5] + 0.1 * rng.normal()
            rows.append((f"d{c}", datetime.date(2024, 1, 1) + datetime.timedelta(d), float(d), *map(float, x), float(y) if (c, d) != (0, 0) else None))
    cols = ["cell_name string", "Date_Day date", "Exposure_Days double", *[f"{f} double" for f in DAMAGE_FEATURES], f"{LABEL} double"]
    return spark.createDataFrame(rows, ", ".join(cols))


@pytest.fixture(scope="module")
def matrix(spark):
    return settle(make(spark))


@pytest.fixture(scope="module")
def oof(spark, matrix):
    return settle(V.out_of_fold(matrix, T, rounds=3, trees=2))


def local(df):
    return df.toPandas()


def fold(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % V.FOLDS


def test_folds_are_hashes_and_every_complete_row_is_predicted_once(matrix, oof):
    m = local(matrix).dropna()
    p = local(oof)
    assert set(p["model"]) == {"dummy_mean", "dummy_median", *[f"ridge_{a}" for a in V.RIDGES], "forest", "booster", "booster_l2_100"}
    for (scheme, model), g in p.groupby(["scheme", "model"]):
        assert len(g) == len(m) and not g.duplicated(["cell_name", "Date_Day"]).any(), (scheme, model)
    for r in p[p["scheme"] == "grouped"].itertuples():
        assert r.fold == fold(r.cell_name)
    for r in p[p["scheme"] == "shuffled"].head(50).itertuples():
        assert r.fold == fold(f"{r.cell_name}|{r.Date_Day:%Y-%m-%d}")


def test_dummies_and_ridges_equal_plain_fits(matrix, oof):
    m = local(matrix).dropna().reset_index(drop=True)
    x, y = m[DAMAGE_FEATURES].to_numpy(), m[LABEL].to_numpy()
    got = local(oof).set_index(["scheme", "model", "cell_name", "Date_Day"])["prediction"]
    for scheme in V.SCHEMES:
        at = np.array([fold(c if scheme == "grouped" else f"{c}|{d:%Y-%m-%d}") for c, d in zip(m["cell_name"], m["Date_Day"])])
        for i in set(at):
            train = at != i
            mu, sd = x[train].mean(axis=0), x[train].std(axis=0)
            z = (x - mu) / sd
            want = {"dummy_mean": np.full(len(y), y[train].mean()), "dummy_median": np.full(len(y), np.median(y[train]))}
            for a in V.RIDGES:
                zt, yt = z[train], y[train] - y[train].mean()
                w = np.linalg.solve(zt.T @ zt + a * np.eye(x.shape[1]), zt.T @ yt)
                want[f"ridge_{a}"] = z @ w + y[train].mean()
            for model, p in want.items():
                for j in np.flatnonzero(at == i):
                    assert got[scheme, model, m["cell_name"][j], m["Date_Day"][j]] == pytest.approx(p[j], abs=1e-9)


def test_statistics_equal_sql_on_the_stored_table(spark, matrix, oof):
    files = oof.inputFiles()
    con = duckdb.connect()
    con.execute("CREATE VIEW o AS SELECT * FROM read_parquet(?)".replace("?", str([f.replace("file://", "") for f in files])))
    con.register("m", local(matrix))
    same(
        con, V.fold_scores(oof), ["target", "scheme", "model"],
        """SELECT target, scheme, model, count(*) n_folds, sum(n) n, avg(mae) mae_mean, stddev_pop(mae) mae_std, avg(rmse) rmse_mean, stddev_pop(rmse) rmse_std,
        avg(medae) medae_mean, stddev_pop(medae) medae_std, avg(r2) r2_mean, stddev_pop(r2) r2_std FROM (
        SELECT target, scheme, model, fold, count(*) n, avg(abs(prediction - y)) mae, sqrt(avg((prediction - y) ** 2)) rmse, median(abs(prediction - y)) medae,
        1 - sum((prediction - y) ** 2) / (var_pop(y) * count(*)) r2 FROM o WHERE scheme <> 'train' GROUP BY ALL) GROUP BY ALL""",
    )
    same(
        con, V.device_errors(oof), ["scheme", "cell_name"],
        """SELECT target, scheme, cell_name, count(*) n, avg(abs(prediction - y)) mae, avg(y - prediction) bias FROM o
        WHERE scheme <> 'train' AND model = 'booster' GROUP BY ALL""",
    )
    corr = " UNION ALL ".join(
        f"SELECT target, scheme, '{f}' AS feature, corr(o.y - prediction, m.{f}) AS corr FROM o JOIN m USING (cell_name, Date_Day) WHERE scheme <> 'train' AND model = 'booster' GROUP BY ALL"
        for f in DAMAGE_FEATURES
    )
    same(con, V.residual_correlations(oof, matrix, T), ["scheme", "feature"], corr)
    same(
        con, V.overfit_gap(oof), ["target"],
        """SELECT *, mae_cv - mae_train AS gap, mae_cv - mae_train > 0.3 * mae_cv AS is_overfit FROM
        (SELECT target, avg(m) mae_cv FROM (SELECT target, fold, avg(abs(prediction - y)) m FROM o WHERE scheme = 'shuffled' AND model = 'booster' GROUP BY ALL) GROUP BY ALL)
        JOIN (SELECT target, avg(abs(prediction - y)) mae_train FROM o WHERE scheme = 'train' GROUP BY ALL) USING (target)""",
    )
    same(
        con, V.phase_errors(oof), ["bin"],
        """WITH r AS (SELECT * FROM o WHERE scheme = 'shuffled' AND model = 'booster'),
        q AS (SELECT quantile_cont(Exposure_Days, 0.25) a, quantile_cont(Exposure_Days, 0.5) b, quantile_cont(Exposure_Days, 0.75) c FROM r)
        SELECT target, CASE WHEN Exposure_Days <= a THEN 1 WHEN Exposure_Days <= b THEN 2 WHEN Exposure_Days <= c THEN 3 ELSE 4 END AS bin,
        count(*) n, avg(abs(prediction - y)) mae, min(Exposure_Days) lo, max(Exposure_Days) hi FROM r, q GROUP BY ALL""",
    )


def same(con, df, keys, sql):
    got, want = local(df), con.execute(sql).df()
    assert set(got.columns) == set(want.columns)
    got, want = (d.sort_values(keys).reset_index(drop=True) for d in (got, want))
    assert len(got) == len(want) > 0
    for c in got.columns:
        if got[c].dtype.kind == "f":
            np.testing.assert_allclose(got[c], want[c].astype(float), atol=1e-9, err_msg=c)
        else:
            assert list(got[c]) == list(want[c]), c


def test_verdicts(spark, matrix, oof):
    v = V.signal_verdicts(V.fold_scores(oof), V.lag_correlations(V.long_rows(matrix, T))).collect()[0]
    assert v["best_model"].startswith("ridge") and v["verdict"] == "real" and v["lag_verdict"] == "autocorrelated"
    schema = "target string, scheme string, model string, mae_mean double"
    rows = [("a", "dummy_mean", 1.0), ("a", "dummy_median", 0.5), ("a", "forest", 0.6), ("b", "dummy_mean", 1.0), ("b", "forest", 0.98), ("c", "dummy_mean", 1.0), ("c", "forest", 0.95), ("d", "dummy_mean", 0.0)]
    s = spark.createDataFrame([(t, "shuffled", m, e) for t, m, e in rows], schema)
    lags = spark.createDataFrame([("a", 0.05), ("b", -0.4), ("c", None)], "target string, lag_corr double")
    got = {r["target"]: (r["verdict"], r["lag_verdict"]) for r in V.signal_verdicts(s, lags).collect()}
    assert got == {"a": ("no_signal", "none"), "b": ("no_signal", "autocorrelated"), "c": ("weak", "unavailable"), "d": ("no_signal", "unavailable")}


def test_one_device_and_an_empty_matrix(spark, matrix):
    one = V.out_of_fold(matrix.where("cell_name = 'd1'"), T, rounds=1, trees=1)
    assert set(r["scheme"] for r in one.select("scheme").distinct().collect()) == {"shuffled", "train"}
    assert V.out_of_fold(matrix.limit(0), T, rounds=1, trees=1).isEmpty()


def test_a_target_that_a_row_lacks_does_not_cost_the_others(spark, matrix):
    two = [*T, V.Target("Other", "other", tuple(DAMAGE_FEATURES))]
    m = matrix.withColumn("other", F.when(F.col("Exposure_Days") > 12, F.col(LABEL)))
    n = {r["target"]: r["n"] for r in V.boosters(m, two, rounds=1).where("scheme = 'train'").groupBy("target").agg(F.count("*").alias("n")).collect()}
    assert n == {"Damage": 149, "Other": 72}


def test_quantiles_with_outliers_ties_and_groups_left_out(spark):
    rng = np.random.default_rng(1)
    n = 3000
    v, g, k = np.round(rng.normal(size=n), 2), rng.integers(0, 7, size=n), rng.integers(0, 2, size=n)
    v[:1000], v[1001], g[:1500] = 0.0, 1e300, 3
    df = settle(spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(k, g, v)], "k int, g int, v double"))
    got = {(r["k"], r["g"]): (r["value"], r["n"]) for r in left_out_quantile(df, ["k"], "g", "v", 0.3).collect()}
    assert len(got) == 14
    for (a, b), (value, count) in got.items():
        rest = v[(k == a) & (g != b)]
        assert count == len(rest) and value == pytest.approx(np.quantile(rest, 0.3))
    q = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", {"lo": 0.1, "hi": 0.999}).collect()}
    for a in (0, 1):
        assert [q[a]["lo"], q[a]["hi"]] == pytest.approx(list(np.quantile(v[k == a], [0.1, 0.999])))
    assert left_out_quantile(df.where("g = 3"), [], "g", "v").isEmpty()
    assert exact_quantiles(df.limit(0), [], "v", {"lo": 0.1}).isEmpty()


def test_an_outlier_does_not_put_all_values_in_one_chunk(spark):
    from helioframe.functions.ordered import CHUNK, range_chunks

    df = spark.range(0, 20000).select((1.0 + F.col("id") * 1e-12).alias("v")).unionByName(spark.createDataFrame([(1e300,)], "v double"))
    sizes = [r["count"] for r in range_chunks(df, [], ["v"]).groupBy(CHUNK).count().collect()]
    assert max(sizes) < 3 * sum(sizes) / int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_left_out_quantiles_plan_has_no_row_a_row_and_group(spark):
    df = spark.range(0, 100).select((F.col("id") % 5).alias("g"), F.col("id").cast("double").alias("v"))
    plan = left_out_quantile(df, [], "g", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan and "Cross" not in plan
