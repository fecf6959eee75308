"""Clusters are fitted for every count, not given."""

import os
import random

from pyspark.sql import functions as F

from helioframe.operators import models as M, shapes as H


def falling(knee, rng, n=8):
    """A shape of two branches that falls to zero behind the knee."""
    branch = [max(0.0, 1.0 - (i / (n - 1)) ** knee) + rng.gauss(0, 0.002) for i in range(n)]
    return branch + branch


def test_fits_find_the_planted_count(spark):
    rng = random.Random(3)
    rows = [(i, i % 4, falling((0.3, 1.0, 3.0, 20.0)[i % 4], rng)) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, truth int, shape array<double>")
    labels, gaps = M.kmeans_per_k(df.drop("truth"), 8)
    assert {r["k"]: r["n"] for r in labels.groupBy("k").agg(F.countDistinct("label").alias("n")).collect()} == {k: k for k in range(2, 9)}
    four = labels.where("k = 4").join(df.select("vec_id", "truth"), "vec_id")
    assert four.select("label", "truth").distinct().count() == 4
    inertia = [r["inertia"] for r in H.cluster_quality(labels).orderBy("k").collect()]
    assert inertia == sorted(inertia, reverse=True) and all(r["min_delta_pff"] >= 0 for r in gaps.collect())
    assert M.best_k(df.drop("truth"), 8) == 4


def test_labels_of_all_counts_are_stored_with_each_shape_once(spark, monkeypatch):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, falling((0.3, 3.0)[i % 2], rng)) for i in range(40)], "vec_id long, shape array<double>")
    stored, settle = [], M.settle

    def counted(t):
        stored.append(settle(t))
        return stored[-1]

    monkeypatch.setattr(M, "settle", counted)
    labels, _ = M.kmeans_per_k(df, 8, ks=(2, 3), restarts=1)
    assert labels.columns == ["vec_id", "k", "label", "shape"] and labels.count() == 80
    assert [t.count() for t in stored] == [40, 40]


def test_sources_of_a_stage_table_go_with_it(spark):
    from helioframe.functions.stages import settle
    from helioframe.plans.stages import staged

    kept, spent = settle(spark.range(5)), settle(spark.range(7))

    @staged
    def some_stage(spark, sf):
        return spent.where("id < 3"), spent

    assert some_stage(spark, "x").count() == 3 == some_stage(spark, "x").count()
    assert not any(os.path.exists(f.removeprefix("file:").replace("///", "/")) for f in spent.inputFiles())
    assert kept.count() == 5
