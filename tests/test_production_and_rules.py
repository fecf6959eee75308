"""Stored production model and surrogate rules against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helioframe.config import TWIN_FEATURES
from helioframe.operators import boosting as B, models as M, production as K, surrogates as R


@pytest.fixture(scope="module")
def twin_rows(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(4):
        for i in range(60):
            x = [float(v) for v in rng.normal(size=len(TWIN_FEATURES))]
            y = 0.9 + 0.05 * x[0] - 0.02 * c * (i / 60)
            rows.append((f"C{c}", i, i * 0.5, c != 3, i * 0.5 > 14, i * 0.5 <= 14, *x, y, y + 0.01 * x[1], 100.0 if c != 3 else 9.0))
    schema = "cell_name string, curve long, Exposure_Days double, is_healthy boolean, is_mature boolean, in_action_window boolean, "
    schema += ", ".join(f"{f} double" for f in TWIN_FEATURES) + ", PCE_Relative double, pFF_Relative double, combined_survival_days double"
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("Timestamp", F.timestamp_micros((F.col("Exposure_Days") * 86_400_000_000).cast("long")))


@pytest.fixture(autouse=True)
def fewer_rounds(monkeypatch):
    monkeypatch.setitem(M.TWIN, "PCE", {"maxIter": 2, "stepSize": 0.3, "maxDepth": 2})
    monkeypatch.setitem(M.TWIN, "pFF", {"maxIter": 2, "stepSize": 0.3, "maxDepth": 3})


def test_model_survives_storing(spark, twin_rows, tmp_path):
    gate = M.loocv_gate(twin_rows)
    assert {r["cell_name"]: r["n"] for r in gate.collect()} == {"C0": 29, "C1": 29, "C2": 29}
    model = K.fit(twin_rows, gate)
    assert model.contract["gated_physical"] == ["C3"] and set(model.contract["production"]) | set(model.contract["gated_loocv"]) == {"C0", "C1", "C2"}
    before = sorted(map(tuple, K.score(model, twin_rows).select("cell_name", "curve", "PCE_Pred", "pFF_Pred", "Digital_Twin_Alert").collect()))
    path = str(tmp_path / "model")
    K.save(model, path)
    again = K.load(spark.newSession(), path)
    assert again.contract == model.contract
    after = sorted(map(tuple, K.score(again, twin_rows).select("cell_name", "curve", "PCE_Pred", "pFF_Pred", "Digital_Twin_Alert").collect()))
    assert before == after and len(after) == 240
    with pytest.raises(Exception, match="already exists"):
        K.save(model, path)


def test_scores_equal_the_fit(twin_rows):
    named = twin_rows.where("is_mature").withColumns({"trains": F.array(F.lit(0)), "asked": F.array(F.lit(0))})
    got, forest = B.fit_many(named, ["cell_name", "curve"], TWIN_FEATURES, ["PCE_Relative", "pFF_Relative"], M.twin_models(1))
    want = {(r["cell_name"], r["curve"], r["model"]): r["prediction"] for r in got.collect()}
    nodes = [("PCE" if k == 0 else "pFF", *rest) for k, *rest in forest.rows()]
    model = K.Production({"features": list(TWIN_FEATURES), "thresholds": {"PCE": 0.1, "pFF": 0.1}}, twin_rows.sparkSession.createDataFrame(nodes, K.TREES))
    for r in K.score(model, twin_rows.where("is_mature")).collect():
        assert (r["PCE_Pred"], r["pFF_Pred"]) == (want[r["cell_name"], r["curve"], 0], want[r["cell_name"], r["curve"], 1])


def test_wrong_contracts_are_errors(spark, tmp_path):
    empty = spark.createDataFrame([], K.TREES)
    contract = {"schema_version": 2, "features": list(TWIN_FEATURES), "burn_in_days": 14.0, "production": [], "gated_physical": [], "gated_loocv": [], "no_data": [], "thresholds": {"PCE": 0.1, "pFF": 0.1}, "gate_metric": "", "t80_metric": ""}
    K.save(K.Production(contract, empty), str(tmp_path / "old"))
    with pytest.raises(ValueError, match="schema version 2"):
        K.load(spark, str(tmp_path / "old"))
    K.save(K.Production({**contract, "schema_version": 3, "features": ["x"]}, empty), str(tmp_path / "other"))
    with pytest.raises(ValueError, match="features"):
        K.load(spark, str(tmp_path / "other"))


def test_odd_rows_and_cohorts(spark, twin_rows):
    one = twin_rows.where("cell_name IN ('C0', 'C3')")
    assert [tuple(r) for r in M.loocv_gate(one).collect()] == [("C0", 0, None, "NO_DATA")]  # nothing to learn from
    assert M.loocv_gate(twin_rows.limit(0)).collect() == []
    none = K.fit(twin_rows.limit(0), M.loocv_gate(twin_rows.limit(0)))
    assert none.contract["production"] == [] and none.contract["thresholds"] == {"PCE": 0.01, "pFF": 0.01}
    blank = K.score(none, twin_rows).agg(F.count("PCE_Pred"), F.max("Digital_Twin_Alert")).first()
    assert tuple(blank) == (0, False)
    grid = {r["window"]: r for r in M.burn_in_grid_fitted(twin_rows, (5.0, 14.0, 200.0)).collect()}
    assert [grid[w]["n_devices"] for w in (5.0, 14.0, 200.0)] == [4, 3, 0]
    assert (grid[5.0]["n_folds_PCE"], grid[14.0]["n_folds_PCE"], grid[200.0]["n_folds_PCE"]) == (4, 3, None)
    assert grid[14.0]["thr_PCE"] >= 0.01 and grid[14.0]["mae_PCE"] > 0


def test_gate_equals_single_fits(twin_rows):
    """Alert shares from models fitted one holdout at a time."""
    rows = twin_rows.where("is_healthy")
    keys, labels = ["cell_name", "curve"], ["PCE_Relative", "pFF_Relative"]
    for r in M.loocv_gate(twin_rows).collect():
        c = r["cell_name"]
        train = M.S.contiguous_folds(rows.where(F.col("is_mature") & (F.col("cell_name") != c)))
        fold = F.col("fold").cast("int") + 1
        t = train.withColumns({"trains": F.filter(F.sequence(F.lit(0), F.lit(5)), lambda s: s != fold), "asked": F.array(fold)}).drop("fold", "idx")
        early = rows.where(F.col("in_action_window") & (F.col("cell_name") == c))
        e = early.withColumns({"trains": F.array().cast("array<int>"), "asked": F.array(F.lit(0))})
        got, _ = B.fit_many(t.select(*e.columns).unionByName(e), keys, TWIN_FEATURES, labels, M.twin_models(6))
        got = got.join(rows.select(*keys, *labels), keys).toPandas()
        inner, held = got[got.model >= 2], got[got.model < 2]
        hit = {}
        for i, y in enumerate(labels):
            res = (inner.prediction - inner[y]).abs()[inner.model % 2 == i]
            thr = max(res.quantile(0.98), res.quantile(0.25), 0.01)
            mine = held[held.model == i].set_index("curve")
            hit[y] = mine.prediction - mine[y] > thr
        share = 100.0 * (hit[labels[0]] | hit[labels[1]]).mean()
        assert math.isclose(share, r["alert_pct"], abs_tol=1e-9) and r["n"] == 29


# -- rules ---------------------------------------------------------------------------


def brute_rules(rows, features, edges, depth=3, least=5):
    """Leaves of one device's tree: condition texts, support and share."""
    n, pos = len(rows), sum(r["label"] for r in rows)
    w = (n / (2 * (n - pos)), n / (2 * pos))

    def gini(rs):
        a, b = (sum(w[k] for r in rs if r["label"] == k) for k in (0, 1))
        return (a + b) - (a * a + b * b) / (a + b) if rs else 0.0

    def text(v):
        s = f"{v:,.4f}".rstrip("0")
        return s + "0" if s.endswith(".") else s

    def walk(rs, path):
        best = None
        if len(path) < depth:
            for i, f in enumerate(features):
                for b, cut in enumerate(edges[f]):
                    left = [r for r in rs if r[f] <= cut]
                    right = [r for r in rs if r[f] > cut]
                    if len(left) >= least and len(right) >= least and any(sum(e < r[f] for e in edges[f]) == b for r in left):
                        gain = round(gini(rs) - gini(left) - gini(right), 9)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, f, cut, left, right)
        if best is None:
            return [(" AND ".join(path), len(rs), sum(r["label"] for r in rs) / len(rs))] if path else []
        _, f, cut, left, right = best
        return walk(left, [*path, f"{f} <= {text(cut)}"]) + walk(right, [*path, f"{f} > {text(cut)}"])

    return walk(rows, [])


def test_rules_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    features, rows = ["a", "b"], []
    for c in range(3):
        for _ in range(150):
            a, b = round(float(rng.normal()), 2), round(float(rng.normal() * 20), 1)
            rows.append((f"C{c}", a, b, bool((a > 0.2 * c) != (b > 3) if rng.random() > 0.1 else rng.random() > 0.5), 3.0 + c))
    rows += [("same", 1.0, float(i), True, 1.0) for i in range(20)] + [("never", 1.0, float(i), False, None) for i in range(20)]
    rows += [("few", float(i), 1.0, i > 3, 1.0) for i in range(8)] + [("flat", 1.0, 1.0, i % 2 == 0, 1.0) for i in range(40)]
    rows += [("gone", None, 1.0, True, 1.0), (None, 1.0, 1.0, True, 1.0), ("C0", 1.0, 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, "cell_name string, a double, b double, alert boolean, day double").repartition(5)
    got = R.rules(df, "alert", "day", features).collect()
    outcome = {r["cell_name"]: (r["outcome"], r["n"], r["day"]) for r in got}
    assert outcome["same"] == ("always", 20, 1.0) and outcome["never"] == ("never", 20, None)
    assert outcome["few"][0] == "too few rows" and outcome["flat"][0] == "single node" and set(outcome) == {"C0", "C1", "C2", "same", "never", "few", "flat"}
    qs = [i / 64 for i in range(1, 64)]
    for c in ("C0", "C1", "C2"):
        mine = [dict(zip(("cell", "a", "b", "label"), r[:4], strict=True)) for r in rows if r[0] == c and r[3] is not None]
        edges = {f: sorted(set(np.quantile([r[f] for r in mine], qs))) for f in features}
        want = brute_rules(mine, features, edges)
        assert sorted((r["rule"], r["support"], round(r["share"], 9)) for r in got if r["cell_name"] == c) == sorted((t, n, round(s, 9)) for t, n, s in want)
        assert all(r["importance"].count("=") <= 2 for r in got if r["cell_name"] == c)
    assert R.rules(df.limit(0), "alert", "day", features).collect() == []
