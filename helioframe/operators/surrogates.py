"""Shallow trees that explain a flag of each device, all devices in one pass, and their rules.

Each level is one aggregate: class counts by device, node, feature and bin.  A node table
(a few rows a device) holds the best split of each node; its leaves are the rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from helioframe.config import PHYSICAL_FEATURES
from helioframe.functions.ordered import exact_quantiles
from helioframe.functions.stages import settle

DEPTH, LEAST_ROWS, BINS = 3, 5, 64
IMPORTANCE_MIN = 0.05


def _gini(neg: Column, pos: Column) -> Column:
    """Weighted impurity times weight."""
    total = neg + pos
    return F.when(total > 0, total - (neg * neg + pos * pos) / total).otherwise(0.0)


def _text(value: Column, pattern: str) -> Column:
    return F.call_function("format_number", value, F.lit(pattern))


def binned(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> DataFrame:
    """Add ``edges`` (one array a feature, quantiles of the device's own values) and ``bins``."""
    qs = {f"q{i}": i / bins for i in range(1, bins)}
    long = rows.select("cell_name", *[F.col(f).cast("double").alias(f) for f in features]).unpivot(["cell_name"], list(features), "feature", "v")
    got = exact_quantiles(long, ["cell_name", "feature"], "v", qs)
    got = got.select("cell_name", "feature", F.array_sort(F.array_distinct(F.array(*qs))).alias("e"))
    edges = got.groupBy("cell_name").agg(*[F.max(F.when(F.col("feature") == f, F.col("e"))).alias(f"e{i}") for i, f in enumerate(features)])
    edges = edges.select("cell_name", F.array(*[f"e{i}" for i in range(len(features))]).alias("edges"))

    def below(i: int, value: Column) -> Column:
        return F.size(F.filter(F.get("edges", F.lit(i)), lambda e: e < value))

    place = [below(i, F.col(f)) for i, f in enumerate(features)]
    return rows.join(edges, "cell_name").withColumn("bins", F.array(*place))


def grow(rows: DataFrame, features: Sequence[str], depth: int = DEPTH, least: int = LEAST_ROWS) -> DataFrame:
    """The node table: ``cell_name``, ``node``, ``path``, counts, and ``feature``, ``cut``, ``gain`` where a node splits.

    ``rows`` have ``cell_name``, ``label`` (0 or 1) and the features.  Classes weigh the same
    in a device.  A split leaves ``least`` rows on both sides; of equal ones the first
    feature and lowest bin wins; a pure node is a leaf.
    """
    data = binned(rows.select("cell_name", "label", *features), features)
    weights = rows.groupBy("cell_name").agg(F.count("*").alias("all"), F.sum("label").alias("pos"))
    weights = weights.select("cell_name", (F.col("all") / (2.0 * F.nullif(F.col("all") - F.col("pos"), F.lit(0)))).alias("w0"), (F.col("all") / (2.0 * F.nullif("pos", F.lit(0)))).alias("w1"))
    data = settle(data.select("cell_name", "label", "bins", "edges", F.lit(0).alias("node")))
    edges = settle(data.groupBy("cell_name").agg(F.first("edges").alias("edges")))
    tree, paths = None, data.select("cell_name").distinct().select("cell_name", F.lit(0).alias("node"), F.array().cast("array<string>").alias("path"))
    for level in range(depth + 1):
        here = data.where(F.col("node") >= 2**level - 1)
        stats = here.groupBy("cell_name", "node").agg(F.count("*").alias("n"), F.sum("label").alias("n_positive"))
        stats = stats.join(weights, "cell_name").join(paths, ["cell_name", "node"])
        if level == depth:
            part = stats.select("cell_name", "node", "path", "n", "n_positive", "w0", "w1", *_no_split())
        else:
            cells = here.select("cell_name", "node", "label", F.posexplode("bins").alias("f", "bin"))
            cells = cells.groupBy("cell_name", "node", "f", "bin").agg(F.count("*").alias("c"), F.sum("label").alias("p"))
            upto = W.partitionBy("cell_name", "node", "f").orderBy("bin")  # BINS rows at most
            left = cells.withColumns({"lc": F.sum("c").over(upto), "lp": F.sum("p").over(upto)})
            j = left.join(stats.select("cell_name", "node", "n", "n_positive", "w0", "w1"), ["cell_name", "node"])
            neg, pos = (F.col("n") - F.col("n_positive")) * F.coalesce("w0", F.lit(0.0)), F.col("n_positive") * F.coalesce("w1", F.lit(0.0))
            ln, lp = (F.col("lc") - F.col("lp")) * F.coalesce("w0", F.lit(0.0)), F.col("lp") * F.coalesce("w1", F.lit(0.0))
            gain = F.round(_gini(neg, pos) - _gini(ln, lp) - _gini(neg - ln, pos - lp), 9)
            ok = (F.col("lc") >= least) & (F.col("n") - F.col("lc") >= least)
            best = j.where(ok).withColumn("gain", gain).where("gain > 0")
            best = best.groupBy("cell_name", "node").agg(F.max_by(F.struct("f", "bin", "gain"), F.struct("gain", -F.col("f"), -F.col("bin"))).alias("s"))
            best = best.join(edges, "cell_name").select("cell_name", "node", F.col("s.f").alias("f"), F.col("s.bin").alias("bin"), F.get(F.get("edges", F.col("s.f")), F.col("s.bin")).alias("cut"), F.col("s.gain").alias("gain"))
            part = stats.select("cell_name", "node", "path", "n", "n_positive", "w0", "w1").join(best, ["cell_name", "node"], "left")
        part = settle(part)
        tree = part if tree is None else tree.unionByName(part)
        if level < depth:
            splits = part.where("f IS NOT NULL")
            step = data.join(splits.select("cell_name", "node", "f", "bin"), ["cell_name", "node"], "left")
            right = (F.get("bins", F.col("f")) > F.col("bin")).cast("int")
            data = settle(step.select("cell_name", "label", "bins", F.when(F.col("f").isNotNull(), 2 * F.col("node") + 1 + right).otherwise(F.col("node")).alias("node")))
            name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("f") + 1)
            sides = [(1, "<="), (2, ">")]
            kids = F.array(*[F.struct((2 * F.col("node") + k).alias("node"), F.concat("path", F.array(F.concat(name, F.lit(f" {op} "), _text(F.col("cut"), "0.0###")))).alias("path")) for k, op in sides])
            paths = splits.select("cell_name", F.explode(kids).alias("k")).select("cell_name", "k.*")
    names = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("f") + 1)
    return tree.select("cell_name", "node", "path", "n", "n_positive", "w0", "w1", F.when(F.col("f").isNotNull(), names).alias("feature"), "cut", "gain")


def _no_split() -> list[Column]:
    return [F.lit(None).cast(k).alias(c) for c, k in (("f", "int"), ("bin", "int"), ("cut", "double"), ("gain", "double"))]


def rules(rows: DataFrame, flag: str, day: str, features: Sequence[str] = tuple(PHYSICAL_FEATURES), least: int = LEAST_ROWS) -> DataFrame:
    """One row a rule: ``cell_name``, ``day``, ``outcome``, ``rule``, ``support``, ``share`` of flagged rows and ``importance``.

    ``importance`` maps features above 5 % to their share of the impurity removed.  A device
    whose rows all have one class, has fewer than ``2 * least`` rows, or whose tree does
    not split, is one row with that outcome and no rule.  Rows with a null feature or
    flag are left out; a device without any other row is not reported.
    """
    data = settle(rows.select("cell_name", F.col(flag).cast("int").alias("label"), F.col(day).cast("double").alias("day"), *features).dropna(subset=[*features, "cell_name"]).where("label IS NOT NULL"))
    devices = data.groupBy("cell_name").agg(F.count("*").alias("n"), F.sum("label").alias("n_positive"), F.max("day").alias("day"))
    one = (F.col("n_positive") == 0) | (F.col("n_positive") == F.col("n"))
    devices = settle(devices.withColumn("outcome", F.when(one, F.when(F.col("n_positive") == 0, "never").otherwise("always")).when(F.col("n") < 2 * least, "too few rows")))
    todo = devices.where("outcome IS NULL").select("cell_name")
    tree = settle(grow(data.join(todo, "cell_name", "left_semi"), features, least=least))
    gains = tree.where("feature IS NOT NULL").groupBy("cell_name", "feature").agg(F.sum("gain").alias("g"))
    gains = gains.withColumn("share", F.round(F.col("g") / F.sum("g").over(W.partitionBy("cell_name")), 6)).where(F.col("share") > IMPORTANCE_MIN)
    order = F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), F.col("feature").alias("f"))))
    importance = gains.groupBy("cell_name").agg(F.array_join(F.transform(order, lambda x: F.concat_ws("=", x["f"], _text(-x["s"], "0.000"))), ", ").alias("importance"))
    leaves = tree.where("feature IS NULL AND size(path) > 0").select("cell_name", F.array_join("path", " AND ").alias("rule"), F.col("n").alias("support"), (F.col("n_positive") / F.col("n")).alias("share"))
    out = devices.join(leaves, "cell_name", "left").join(importance, "cell_name", "left")
    outcome = F.coalesce("outcome", F.when(F.col("rule").isNull(), "single node").otherwise("tree"))
    return out.select("cell_name", "n", "n_positive", "day", outcome.alias("outcome"), "rule", "support", "share", "importance")
