"""Quantiles that order only the values near them, and what a stored table leaves behind."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from helioframe.functions import ordered as O, stages


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(2)
    rows = [("a", rng.gauss(0, 1)) for _ in range(3000)] + [("b", float(rng.randrange(4))) for _ in range(1000)]
    rows += [("c", 5.0), ("d", None), ("e", math.nan), ("e", 1.0), ("e", -0.0), ("e", 0.0), (None, 3.0), ("a", 1e300), ("a", None)]
    return stages.settle(spark.createDataFrame(rows, "k string, v double"))


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_near_quantiles_equal_exact_ones(values, keys, accuracy):
    qs = {"low": 0.0, "q": 0.25, "m": 0.5, "high": 0.98}
    df = values.where("k is not null or k is null")
    got, want = (sorted(map(repr, f.select(*keys, *qs, "n").collect())) for f in (O.near_quantiles(df, keys, "v", qs, accuracy), O.exact_quantiles(df, keys, "v", qs)))
    assert got == want and got


def test_near_quantiles_order_few_values(values, monkeypatch):
    stored, settle = [], O.settle

    def counted(df):
        stored.append(settle(df))
        return stored[-1]

    monkeypatch.setattr(O, "settle", counted)
    O.near_quantiles(values.where("k = 'a'"), ["k"], "v", {"m": 0.5}, 1000).collect()
    assert max(t.count() for t in stored) < 60


def test_near_quantiles_of_nothing_and_outside_their_bounds(values, monkeypatch):
    assert O.near_quantiles(values.where("k = 'd'"), [], "v", {"m": 0.5}).collect() == []
    want = O.exact_quantiles(values, ["k"], "v", {"m": 0.5}).where("k = 'a'").first()
    approximate = F.percentile_approx
    monkeypatch.setattr(O.F, "percentile_approx", lambda v, ask, n: approximate(v, [0.9 for _ in ask], n))
    assert O.near_quantiles(values, ["k"], "v", {"m": 0.5}).where("k = 'a'").first() == want


def test_a_stored_table_leaves_no_shuffle_files(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    was, before = spark.conf.get(stages.CLEANUP, None), shuffles()
    held = spark.range(10_000).repartition(4, "id").groupBy((F.col("id") % 100).alias("k")).count()
    t = stages.settle(held)
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before
    assert t.count() == 100 and held.count() == 100
    assert spark.conf.get(stages.CLEANUP, None) == was
