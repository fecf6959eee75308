"""The production model of the screening twin: final fit, stored contract, scoring.

A stored model is a folder with two Parquet tables: ``contract`` (one row: schema
version, features, burn-in, cohorts, thresholds, gate) and ``trees`` (one row a node).
Loading checks the contract; scoring needs no library beyond this package.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe.config import SETTINGS, TWIN_FEATURES
from helioframe.functions.stages import settle, ship_code
from helioframe.operators import boosting as B, models as M, screening as S

SCHEMA_VERSION = 3
TREES = "metric string, round int, node int, feature string, cut double, value double"
CONTRACT = (
    "schema_version int, features array<string>, burn_in_days double, production array<string>, gated_physical array<string>, "
    "gated_loocv array<string>, no_data array<string>, thresholds map<string, double>, gate_metric string, t80_metric string"
)


@dataclass
class Production:
    """A contract row as a dictionary and the trees as a table of ``TREES``."""

    contract: dict
    trees: DataFrame


def cohorts(rows: DataFrame, gate: DataFrame) -> dict[str, list[str]]:
    """Devices by what the gates say: one name list each (the fleet's device names).

    ``gated_physical`` died within the burn-in, ``gated_loocv`` failed the left-out check,
    ``no_data`` could not be checked and stays; ``production`` are the others of the cohort.
    """
    cells = rows.groupBy("cell_name").agg(F.max("is_healthy").alias("healthy")).join(gate.select("cell_name", "verdict"), "cell_name", "left")
    names = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("cell_name"))))
    healthy, failed = F.col("healthy"), F.col("healthy") & (F.coalesce("verdict", F.lit("")) == "FAIL")
    got = cells.agg(
        names(healthy & ~failed).alias("production"), names(~healthy).alias("gated_physical"), names(failed).alias("gated_loocv"),
        names(healthy & (F.col("verdict") == "NO_DATA")).alias("no_data"),
    )
    return got.first().asDict()


def fit(rows: DataFrame, gate: DataFrame, blocks: int = M.INNER) -> Production:
    """Fit the twin to the mature rows of the production cohort; thresholds from contiguous blocks.

    ``rows`` are screening rows (``models.healthy_twin``), ``gate`` the result of
    ``models.loocv_gate``.  Without training rows there are no trees and the thresholds
    are the absolute floor.
    """
    data = settle(rows)
    spark, named = rows.sparkSession, cohorts(data, gate)
    cohort = spark.createDataFrame([(c,) for c in named["production"]], "cell_name string")
    train = settle(S.contiguous_folds(data.where("is_mature").join(F.broadcast(cohort), "cell_name", "left_semi"), blocks))  # device names
    own = F.col("fold").cast("int") + 1
    others = F.filter(F.sequence(F.lit(0), F.lit(blocks)), lambda s: s != own)
    train = train.withColumns({"trains": others, "asked": F.array(own)})
    metrics = list(M.TWIN)
    models = M.twin_models(blocks + 1)
    got, forest = B.fit_many(train, ["cell_name", "curve"], TWIN_FEATURES, [f"{m}_Relative" for m in metrics], models)
    res = got.where("prediction IS NOT NULL").join(train.select("cell_name", "curve", *[f"{m}_Relative" for m in metrics]), ["cell_name", "curve"])
    truth = F.element_at(F.array(*[f"{m}_Relative" for m in metrics]), F.col("model") % len(metrics) + 1)
    thr = S.residual_threshold(res.select((F.col("model") % len(metrics)).alias("m"), F.abs(F.col("prediction") - truth).alias("r")), "r", ["m"])
    found = {metrics[r["m"]]: r["layered"] for r in thr.collect()}  # one row a metric
    nodes = [(metrics[k % len(metrics)], *rest) for k, *rest in forest.rows() if models[k].set == 0]
    contract = {
        "schema_version": SCHEMA_VERSION, "features": list(TWIN_FEATURES), "burn_in_days": SETTINGS.burn_in_days, **named,
        "thresholds": {m: float(found.get(m, SETTINGS.residual_floor)) for m in metrics},
        "gate_metric": "combined_survival_days", "t80_metric": "survival_days_pce",
    }
    return Production(contract, spark.createDataFrame(nodes, TREES))


def save(model: Production, path: str) -> None:
    """Write a model to a new folder; an existing one is an error."""
    spark = model.trees.sparkSession
    model.trees.write.parquet(f"{path}/trees")
    names = spark.createDataFrame([], CONTRACT).columns
    spark.createDataFrame([tuple(model.contract[n] for n in names)], CONTRACT).write.parquet(f"{path}/contract")


def load(spark: SparkSession, path: str, features: Sequence[str] = tuple(TWIN_FEATURES)) -> Production:
    """Read a stored model; another schema version or other features are an error."""
    row = spark.read.parquet(f"{path}/contract").first()
    if row is None:
        raise ValueError(f"{path}: no contract")
    contract = row.asDict()
    if contract.get("schema_version") != SCHEMA_VERSION:
        raise ValueError(f"{path}: schema version {contract.get('schema_version')}, this library reads {SCHEMA_VERSION}")
    if contract["features"] != list(features):
        raise ValueError(f"{path}: the model has features {contract['features']}")
    return Production(contract, spark.read.schema(TREES).parquet(f"{path}/trees"))


def _scorer(nodes: list[tuple], features: list[str], metrics: list[str], keep: list[str]):
    """Arrow function that adds a prediction a metric; ``nodes`` are rows of ``TREES``."""
    base = {m: v for m, t, _, _, _, v in nodes if t < 0}
    rounds = {m: max((t for x, t, *_ in nodes if x == m), default=-1) + 1 for m in metrics}
    width = max((n for _, _, n, *_ in nodes), default=0) + 1
    trees = {m: (np.full((rounds[m], width), -1), np.zeros((rounds[m], width)), np.zeros((rounds[m], width))) for m in metrics}
    for m, t, node, feature, cut, value in nodes:
        if t >= 0:
            f, c, v = trees[m]
            f[t, node], c[t, node], v[t, node] = features.index(feature) if feature is not None else -1, cut if cut is not None else 0.0, value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features], axis=1)
            blank = np.isnan(x).any(axis=1)
            out = []
            for m in metrics:
                feature, cut, value = trees[m]
                total = np.full(len(x), base.get(m, np.nan))
                for t in range(rounds[m]):
                    node = np.zeros(len(x), dtype=np.int64)
                    while True:
                        f = feature[t, node]
                        if (f < 0).all():
                            break
                        right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[t, node]
                        node = np.where(f >= 0, 2 * node + 1 + right, node)
                    total = total + value[t, node]
                out.append(pa.array(total, mask=blank | np.isnan(total)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *out], [*keep, *[f"{m}_Pred" for m in metrics]])

    return run


def score(model: Production, rows: DataFrame) -> DataFrame:
    """Predictions, shortfalls and alerts of ``rows`` by a stored model.

    Rows with a null feature have NULL predictions and no alert.  Columns of the result's
    names are replaced.
    """
    spark = rows.sparkSession
    ship_code(spark)
    metrics = list(M.TWIN)
    nodes = [tuple(r) for r in model.trees.collect()]  # rounds x nodes of two models
    made = [f"{p}{m}" if p != "_Pred" else f"{m}_Pred" for m in metrics for p in ("_Pred", "Under_", "Alert_")] + ["Digital_Twin_Alert"]
    keep = [c for c in rows.columns if c not in made]
    schema = rows.select(*keep).schema
    for m in metrics:
        schema = schema.add(f"{m}_Pred", "double")
    out = rows.select(*keep).mapInArrow(_scorer(nodes, model.contract["features"], metrics, keep), schema)
    for m in metrics:
        under = F.col(f"{m}_Pred") - F.col(f"{m}_Relative")
        alert = F.col("in_action_window") & F.coalesce(under > F.lit(model.contract["thresholds"][m]), F.lit(False))
        out = out.withColumn(f"Under_{m}", under).withColumn(f"Alert_{m}", alert)
    return out.withColumn("Digital_Twin_Alert", F.col("Alert_PCE") | F.col("Alert_pFF"))
