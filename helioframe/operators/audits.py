"""Audits of the sweep filter against independent evidence.

All inputs are per-curve tables.  Distribution statistics use exact quantiles
that tolerate groups of any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from helioframe.functions.ordered import CHUNK, exact_quantiles, ordered_scan, range_chunks
from helioframe.functions.stages import settle
from helioframe.operators.curves import RULES, decide


def qc_yield(audit: DataFrame) -> DataFrame:
    """Totals, valid counts and rule counts per device, with a grand-total row."""
    return audit.rollup("cell_name").agg(
        F.count("*").alias("total"),
        F.sum("is_curve_valid").alias("valid"),
        *[F.count_if(r).alias(r) for r in RULES],
        (100.0 * F.sum("is_curve_valid") / F.count("*")).alias("yield_pct"),
    )


def rule_rates(audit: DataFrame) -> DataFrame:
    one = audit.agg(*[F.avg(F.col(r).cast("double")).alias(r) for r in RULES])
    return one.unpivot([], RULES, "rule", "rate")


def score_describe(audit: DataFrame, scores: Sequence[str], by: str = "is_curve_valid") -> DataFrame:
    """Count, mean, spread and quartiles of each score by verdict."""
    long = audit.select(by, *[F.col(s).cast("double").alias(s) for s in scores]).unpivot([by], list(scores), "score", "x")
    basic = long.groupBy(by, "score").agg(
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")
    )
    quart = exact_quantiles(long, [by, "score"], "x", {"p25": 0.25, "p50": 0.50, "p75": 0.75})
    return basic.join(quart, [by, "score"])


def rule_cooccurrence(audit: DataFrame) -> DataFrame:
    """How often two rules fire together on rejected curves; one pass of conditional counts."""
    rejected = audit.where(F.col("is_curve_valid") == 0)
    counts = [F.count_if(F.col(a) & F.col(b)).alias(f"{a}|{b}") for a in RULES for b in RULES]
    long = rejected.agg(*counts).unpivot([], [f"{a}|{b}" for a in RULES for b in RULES], "pair", "n")
    parts = F.split("pair", r"\|")
    return long.select(parts[0].alias("rule_a"), parts[1].alias("rule_b"), "n")


def fired_rules(separator: str = "+") -> Column:
    text = F.concat_ws(separator, *[F.when(F.col(r), F.lit(r.removeprefix("rej_"))) for r in RULES])
    return F.when(text == "", "NONE").otherwise(text)


def rule_overlap(audit: DataFrame) -> DataFrame:
    n = sum((F.col(r).cast("int") for r in RULES[1:]), F.col(RULES[0]).cast("int"))
    rejected = audit.where(F.col("is_curve_valid") == 0)
    return rejected.groupBy(n.alias("n_rules")).agg(F.count("*").alias("n_curves"))


def rule_combo(audit: DataFrame, top: int = 10) -> DataFrame:
    counts = audit.where(F.col("is_curve_valid") == 0).groupBy(fired_rules().alias("combo")).agg(
        F.count("*").alias("n_curves")
    )
    return counts.orderBy(F.desc("n_curves"), "combo").limit(top)


def confusion_matrix(curves: DataFrame) -> DataFrame:
    """Truth by decision; one row per truth class."""
    kept = F.col("is_curve_valid") == 1
    return curves.groupBy("truth").agg(F.count_if(~kept).alias("rejected"), F.count_if(kept).alias("accepted"))


def confusion_metrics(curves: DataFrame) -> DataFrame:
    kept = F.col("is_curve_valid") == 1
    good = F.col("truth") == "accept"
    bad = F.col("truth").isin("reject_bad", "reject_night")
    m = curves.agg(
        F.count_if(good).alias("n_accept"),
        F.count_if(bad).alias("n_reject"),
        F.count_if(good & kept).alias("accept_kept"),
        F.count_if(bad & ~kept).alias("reject_dropped"),
    )
    one = F.lit(1)
    return m.select(
        ((F.col("accept_kept") + F.col("reject_dropped")) / F.nullif(F.col("n_accept") + F.col("n_reject"), F.lit(0))).alias(
            "agreement"
        ),
        (1 - F.col("accept_kept") / F.greatest("n_accept", one)).alias("fn_rate"),
        (1 - F.col("reject_dropped") / F.greatest("n_reject", one)).alias("fp_rate"),
        (F.col("n_accept") - F.col("accept_kept")).alias("valid_lost"),
        (F.col("n_reject") - F.col("reject_dropped")).alias("broken_kept"),
    )


def fp_by_rule(curves: DataFrame) -> DataFrame:
    """Rules fired on physically fine curves that were rejected, with shares."""
    fp = curves.where((F.col("truth") == "accept") & (F.col("is_curve_valid") == 0))
    only_spike = F.col("rej_spike")
    for r in RULES[:-1]:
        only_spike = only_spike & ~F.col(r)
    one = fp.agg(
        F.count("*").alias("n_fp"),
        *[F.count_if(r).alias(r) for r in RULES],
        F.count_if(only_spike).alias("only_spike"),
    )
    return one.unpivot(["n_fp"], [*RULES, "only_spike"], "rule", "n").withColumn(
        "share", F.col("n") / F.nullif(F.col("n_fp"), F.lit(0))
    )


def spike_spectrum(curves: DataFrame) -> DataFrame:
    """Spike counts of fine curves rejected by the spike rule alone."""
    only = (F.col("truth") == "accept") & F.col("rej_spike")
    for r in RULES[:-1]:
        only = only & ~F.col(r)
    return curves.where(only).groupBy("spike_count").agg(F.count("*").alias("n_curves"))


def fn_profile(curves: DataFrame) -> DataFrame:
    """Broken curves per device and the share the filter let through."""
    return (
        curves.where(F.col("truth") == "reject_bad")
        .groupBy("cell_name")
        .agg(F.count("*").alias("total"), F.sum("is_curve_valid").alias("accepted"))
        .withColumn("fn_rate", F.col("accepted") / F.col("total"))
    )


def spike_threshold_sweep(scores: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Kept and leaked curves for every spike limit, from one grouped pass.

    Curves are first counted per (spike count, truth); the cumulative counts
    over the limits come from that small table.
    """
    others = decide(scores, F.lit(1_000_000)).withColumn("pass_rest", F.col("is_curve_valid") == 1)
    hist = others.groupBy("spike_count", "truth").agg(
        F.count_if("pass_rest").alias("n_pass"), F.count("*").alias("n_all")
    )
    grid = hist.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    hit = F.when(F.col("spike_count") <= F.col("k"), F.col("n_pass")).otherwise(0)
    s = grid.groupBy("k").agg(
        F.sum(hit).alias("accepted"),
        F.sum(F.when(F.col("truth") == "accept", hit).otherwise(0)).alias("accept_kept"),
        F.sum(F.when(F.col("truth") == "reject_bad", hit).otherwise(0)).alias("bad_leaked"),
        F.sum(F.when(F.col("truth") == "accept", F.col("n_all")).otherwise(0)).alias("n_accept"),
    )
    one = F.lit(1)
    return s.withColumn(
        "loss_pct", 100.0 * (F.col("n_accept") - F.col("accept_kept")) / F.greatest("n_accept", one)
    ).withColumn("leak_pct", 100.0 * F.col("bad_leaked") / F.greatest("accepted", one))


def marginal_tradeoff(sweep: DataFrame) -> DataFrame:
    """Change from one limit to the next (a handful of sweep rows)."""
    w = W.orderBy("k")
    cols = ["accept_kept", "bad_leaked", "loss_pct", "leak_pct"]
    return sweep.select("k", *[(F.col(c) - F.lag(c).over(w)).alias(f"d_{c}") for c in cols])


def cluster_composition(labelled: DataFrame) -> DataFrame:
    """Share of each truth class per cluster, purity and dominant class; noise (-1) left out."""
    t = F.col("truth")
    c = labelled.where(F.col("label_curve") >= 0).groupBy("label_curve").agg(
        F.count("*").alias("n"),
        *[(F.count_if(t == k) / F.count("*")).alias(k) for k in ("accept", "reject_bad", "gray", "reject_night")],
    )
    return c.withColumn("purity", F.greatest("accept", "reject_bad")).withColumn(
        "dominant", F.when(F.col("accept") > F.col("reject_bad"), "accept").otherwise("reject_bad")
    )


def recovery_rates(labelled: DataFrame) -> DataFrame:
    """Share of each class that sits in a cluster dominated by it."""
    comp = cluster_composition(labelled).select("label_curve", "dominant")
    j = labelled.join(comp, "label_curve", "left")
    return (
        j.where(F.col("truth").isin("accept", "reject_bad"))
        .groupBy("truth")
        .agg(F.count("*").alias("n"), F.count_if(F.col("dominant") == F.col("truth")).alias("n_recovered"))
        .withColumn("recovery_pct", 100.0 * F.col("n_recovered") / F.col("n"))
    )


def adjusted_rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chance-corrected agreement of two labelings from their contingency counts."""

    def pairs(c: Column) -> Column:
        return c * (c - 1) / 2.0

    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("sa"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("sb"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("sab"), pairs(F.sum("n")).alias("total"))
    one = both.crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(cols))  # three one-row aggregates
    expected = F.col("sa") * F.col("sb") / F.col("total")
    top = (F.col("sa") + F.col("sb")) / 2.0
    ari = F.try_divide(F.col("sab") - expected, top - expected)
    return one.select(F.coalesce(ari, F.lit(1.0)).alias("ari"))


def distribution_profile(df: DataFrame, value: str, limits: Sequence[float]) -> DataFrame:
    """Percentiles and exceedance counts, per device and overall (NULL device)."""
    v = F.col(value)
    qs = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    counts = df.rollup("cell_name").agg(
        F.max(v).alias("max"),
        *[F.count_if(v > x).alias(f"above_{str(x).replace('.', '_')}") for x in limits],
    )
    per = exact_quantiles(df, ["cell_name"], value, qs)
    total = exact_quantiles(df, [], value, qs).withColumn("cell_name", F.lit(None).cast("string"))
    return counts.join(per.unionByName(total).withColumnRenamed("cell_name", "c"), F.expr("cell_name <=> c")).drop("c")


def largest_upper_gap(df: DataFrame, value: str, q: float = 0.95) -> DataFrame:
    """Widest gap between neighbouring values at or above a quantile, and its midpoint."""
    v = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v")).distinct()
    edge = exact_quantiles(df, [], value, {"edge": q}).select("edge")
    tail = v.crossJoin(F.broadcast(edge)).where(F.col("v") >= F.col("edge"))  # one-row edge
    tail = range_chunks(tail.select("v", F.lit(1).alias("one")), ["one"], ["v"])
    steps = ordered_scan(tail, ["one"], ["v"], CHUNK, lags={"below": F.col("v")})
    best = F.max_by(F.struct("below", "v"), F.when(F.col("below").isNotNull(), F.struct(F.col("v") - F.col("below"), -F.col("v"))))
    g = steps.agg(best.alias("g")).select(F.col("g.below").alias("gap_lo"), F.col("g.v").alias("gap_hi"))
    return g.withColumn("width", F.col("gap_hi") - F.col("gap_lo")).withColumn(
        "suggested_cap", (F.col("gap_lo") + F.col("gap_hi")) / 2.0
    )


def reject_rate_by_hour(curves: DataFrame) -> DataFrame:
    """Device by local hour: share of rejected curves."""
    rate = 1.0 - F.avg(F.col("is_curve_valid").cast("double"))
    return curves.groupBy("cell_name").pivot("hour", list(range(24))).agg(rate)


def validity_profile(curves: DataFrame, metrics: Sequence[str]) -> DataFrame:
    long = curves.select("cell_name", "is_curve_valid", *metrics).unpivot(
        ["cell_name", "is_curve_valid"], list(metrics), "metric", "x"
    )
    return exact_quantiles(long, ["cell_name", "is_curve_valid", "metric"], "x", {"p10": 0.1, "med": 0.5, "p90": 0.9})


def validity_delta(profile: DataFrame) -> DataFrame:
    """Median of rejected minus median of accepted curves."""
    v = F.col("is_curve_valid")
    d = profile.groupBy("cell_name", "metric").agg(
        F.max(F.when(v == 1, F.col("med"))).alias("accepted"), F.max(F.when(v == 0, F.col("med"))).alias("rejected")
    )
    return d.withColumn("delta", F.col("rejected") - F.col("accepted"))


def plausible_reject_share(curves: DataFrame, voc: float = 0.5, jsc: float = 5.0) -> DataFrame:
    v, j = F.coalesce(F.col("voc") > voc, F.lit(False)), F.coalesce(F.col("jsc") > jsc, F.lit(False))
    pct = lambda c: 100.0 * F.avg(c.cast("double"))
    return curves.where(F.col("is_curve_valid") == 0).groupBy("cell_name").agg(
        F.count("*").alias("n_rejected"), pct(v).alias("voc_ok_pct"), pct(j).alias("jsc_ok_pct"), pct(v & j).alias("both_ok_pct")
    )


def robust_z(curves: DataFrame, metrics: Sequence[str], limit: float = 4.0) -> DataFrame:
    """Distance from the (device, hour) median in scaled median absolute deviations."""
    ids, keys = ["cell_name", "curve", "hour"], ["cell_name", "hour", "metric"]
    long = curves.select(*ids, *metrics).unpivot(ids, list(metrics), "metric", "x")
    med = exact_quantiles(long, keys, "x", {"med": 0.5}).drop("n")
    long = settle(long.join(med, keys, "left").withColumn("dev", F.abs(F.col("x") - F.col("med"))))
    mad = exact_quantiles(long, keys, "dev", {"mad": 0.5}).drop("n")
    z = long.join(mad, keys, "left").withColumn("z", F.col("dev") / (1.4826 * (F.col("mad") + 1e-12)))
    wide = [F.max(F.when(F.col("metric") == m, F.col("z"))).alias(f"z_{m}") for m in metrics]
    far = F.max(F.coalesce(F.col("z") > limit, F.lit(False))).alias("is_outlier")
    return z.groupBy(*ids).agg(*wide, far)


def judge_votes(verdicts: dict[str, DataFrame]) -> DataFrame:
    """Full outer join of per-curve verdict tables; a missing verdict is a no."""
    keys = ["cell_name", "curve"]
    out = None
    for name, df in verdicts.items():
        v = df.select(*keys, F.col(name).cast("boolean").alias(name))
        out = v if out is None else out.join(v, keys, "full_outer")
    votes = F.lit(0)
    for name in verdicts:
        out = out.withColumn(name, F.coalesce(name, F.lit(False)))
        votes = votes + F.col(name).cast("int")
    return out.withColumn("n_votes", votes)


def stratified_sample(df: DataFrame, per_cell: int, key: Column, salts: int = 64) -> DataFrame:
    """The first ``per_cell`` rows of each device in hash order.

    Ranked first inside (device, salt), so that one large device is never
    sorted in a single task; at most ``salts * per_cell`` rows reach the
    second ranking.
    """
    h = df.withColumn("h", F.md5(key)).withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(salts)))
    first = h.withColumn("r", F.row_number().over(W.partitionBy("cell_name", "salt").orderBy("h"))).where(F.col("r") <= per_cell)
    second = first.withColumn("r", F.row_number().over(W.partitionBy("cell_name").orderBy("h")))
    return second.where(F.col("r") <= per_cell).drop("r", "salt", "h")


def sample_n(df: DataFrame, n: int, key: Column) -> DataFrame:
    """The first ``n`` rows in hash order (distributed top-n)."""
    return df.orderBy(F.md5(key)).limit(n)
