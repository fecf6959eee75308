"""Curve-shape clustering: centres, quality, representatives and validity.

Cluster counts are small by construction (k <= 8 in the search), so centres
travel as one array of structs; the shapes themselves are never paired.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def branch_product_max(shape: Column, start: int, n: int) -> Column:
    """Largest ``v * j`` of one branch, with ``v`` evenly spaced on [0, 1]."""
    part = F.slice(shape, start + 1, n)
    return F.array_max(F.transform(part, lambda j, i: j * (i / F.lit(float(n - 1)))))


def pseudo_ff(shape: Column, n: int) -> Column:
    """Mean over both branches of the largest ``v * j`` of a normalised shape."""
    return (branch_product_max(shape, 0, n) + branch_product_max(shape, n, n)) / 2.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def centres(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean shape and size per group (vector sums are combined map-side)."""
    v = df.withColumn("vec", array_to_vector("shape"))
    return v.groupBy(*keys).agg(Summarizer.mean(F.col("vec")).alias("m"), F.count("*").alias("size")).select(
        *keys, vector_to_array("m").alias("centre"), "size"
    )


def cluster_quality(df: DataFrame, k: str = "k", label: str = "label") -> DataFrame:
    """Inertia, silhouette, Calinski-Harabasz and Davies-Bouldin for each ``k``.

    The silhouette uses squared Euclidean distances, whose mean to a whole
    cluster follows from its centre and spread, so it costs one pass.
    """
    c = centres(df, [k, label])
    grand = centres(df, [k]).select(k, F.col("centre").alias("grand"), F.col("size").alias("n_all"))
    d = df.join(F.broadcast(c), [k, label]).withColumn("d2", squared_distance(F.col("shape"), F.col("centre")))
    spread = d.groupBy(k, label).agg(F.sum("d2").alias("ss"), F.avg(F.sqrt("d2")).alias("scatter"))
    stats = c.join(spread, [k, label]).withColumn("var", F.col("ss") / F.col("size"))
    packed = stats.groupBy(k).agg(
        F.collect_list(F.struct(F.col(label).alias("label"), "centre", "size", "var", "scatter", "ss")).alias("cs")
    )
    # -- silhouette: mean squared distance to cluster q is |x - centre_q|^2 + var_q
    p = df.join(F.broadcast(packed), k)
    to = F.transform(
        "cs",
        lambda q: F.struct(
            q["label"].alias("label"), q["size"].alias("size"), (squared_distance(F.col("shape"), q["centre"]) + q["var"]).alias("mean_d")
        ),
    )
    p = p.select(k, label, to.alias("to"))
    own = F.filter("to", lambda q: q["label"] == F.col(label))[0]
    a = own["mean_d"] * own["size"] / F.nullif(own["size"] - 1, F.lit(0))
    b = F.array_min(F.transform(F.filter("to", lambda q: q["label"] != F.col(label)), lambda q: q["mean_d"]))
    s = F.when(own["size"] == 1, 0.0).otherwise((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)))
    sil = p.groupBy(k).agg(F.avg(s).alias("silhouette"))
    # -- Davies-Bouldin and Calinski-Harabasz from the k centres
    worst = F.transform(
        "cs",
        lambda i: F.array_max(
            F.transform(
                F.filter("cs", lambda j: j["label"] != i["label"]),
                lambda j: (i["scatter"] + j["scatter"]) / F.nullif(F.sqrt(squared_distance(i["centre"], j["centre"])), F.lit(0.0)),
            )
        ),
    )
    m = packed.join(grand, k)
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda x, y: x + y)
    n_c = F.size("cs").cast("double")
    within = total(F.transform("cs", lambda q: q["ss"]))
    between = total(F.transform("cs", lambda q: q["size"] * squared_distance(q["centre"], F.col("grand"))))
    m = m.select(
        k, within.alias("inertia"), (total(worst) / n_c).alias("davies_bouldin"),
        ((between / (n_c - 1.0)) / F.nullif(within / (F.col("n_all") - n_c), F.lit(0.0))).alias("calinski_harabasz"),
    )
    return m.join(sil, k)


def min_delta_pff(df: DataFrame, branch: int, k: str = "k", label: str = "label") -> DataFrame:
    """Smallest gap between the pseudo fill factors of the centres of each ``k``."""
    c = centres(df, [k, label]).withColumn("ff", pseudo_ff(F.col("centre"), branch))
    w = W.partitionBy(k).orderBy("ff")  # k centres per partition
    return c.withColumn("gap", F.lead("ff").over(w) - F.col("ff")).groupBy(k).agg(F.min("gap").alias("min_delta_pff"))


def elbow_distance(metrics: DataFrame, k: str = "k") -> DataFrame:
    """Distance of each normalised (k, inertia) point to the line between the ends."""
    one = metrics.agg(
        F.min(k).alias("k0"), F.max(k).alias("k1"), F.min("inertia").alias("i0"), F.max("inertia").alias("i1"),
        F.min_by("inertia", k).alias("first"), F.max_by("inertia", k).alias("last"),
    )
    m = metrics.crossJoin(F.broadcast(one))  # one-row bounds
    ky, span = F.nullif(F.col("k1") - F.col("k0"), F.lit(0)), F.nullif(F.col("i1") - F.col("i0"), F.lit(0.0))
    x, y = (F.col(k) - F.col("k0")) / ky, (F.col("inertia") - F.col("i0")) / span
    y0, y1 = (F.col("first") - F.col("i0")) / span, (F.col("last") - F.col("i0")) / span
    # Ends lie at x = 0 and x = 1.
    dist = F.abs((y1 - y0) * x - y + y0) / F.sqrt((y1 - y0) * (y1 - y0) + 1.0)
    return m.withColumn("elbow", F.coalesce(dist, F.lit(0.0))).drop("k0", "k1", "i0", "i1", "first", "last")


def choose_k(metrics: DataFrame, k: str = "k", min_k: int = 3, min_gap: float = 0.04) -> DataFrame:
    """Elbow among admissible k, overridden when silhouette and Davies-Bouldin agree on another one."""
    one = metrics.agg(
        F.max((((F.col(k) >= min_k) & (F.col("min_delta_pff") >= min_gap))).cast("int")).alias("strict"),
        F.max((F.col(k) >= min_k).cast("int")).alias("loose"),
    )
    m = metrics.crossJoin(F.broadcast(one))  # one-row flags
    ok = (
        F.when(F.col("strict") == 1, (F.col(k) >= min_k) & (F.col("min_delta_pff") >= min_gap))
        .when(F.col("loose") == 1, F.col(k) >= min_k)
        .otherwise(F.lit(True))
    )
    v = m.where(ok).agg(
        F.max_by(k, F.struct("elbow", -F.col(k))).alias("k_elbow"),
        F.max_by(k, F.struct("silhouette", -F.col(k))).alias("k_silhouette"),
        F.min_by(k, F.struct("davies_bouldin", k)).alias("k_davies_bouldin"),
    )
    agree = (F.col("k_silhouette") == F.col("k_davies_bouldin")) & (F.col("k_silhouette") != F.col("k_elbow"))
    return v.withColumn("consensus", agree).withColumn("k", F.when(agree, F.col("k_silhouette")).otherwise(F.col("k_elbow")))


def medoids(df: DataFrame, id_col: str, label: str = "label") -> DataFrame:
    """Representative of each cluster: the member nearest its centre.

    That member has the least total squared distance to its cluster.
    """
    c = centres(df, [label])
    d = df.join(F.broadcast(c), label).withColumn("d2", squared_distance(F.col("shape"), F.col("centre")))
    return d.groupBy(label).agg(F.min_by(F.struct(id_col, "shape"), F.struct("d2", id_col)).alias("m"), F.count("*").alias("size")).select(
        label, F.col(f"m.{id_col}").alias("medoid_id"), F.col("m.shape").alias("medoid"), "size"
    )


def medoid_assign(df: DataFrame, meds: DataFrame, label: str = "label") -> DataFrame:
    """Each shape with its nearest representative (k representatives as one array)."""
    packed = meds.agg(F.collect_list(F.struct(F.col(label).alias("l"), "medoid")).alias("ms"))
    p = df.crossJoin(F.broadcast(packed))  # one row of k representatives
    near = F.array_min(F.transform("ms", lambda m: F.struct(squared_distance(F.col("shape"), m["medoid"]).alias("d2"), m["l"].alias("l"))))
    return p.withColumn("near", near).withColumn("assigned", F.col("near.l")).withColumn("distance", F.sqrt("near.d2")).drop("ms", "near")


def renumber_by_ff(meds: DataFrame, branch: int, label: str = "label") -> DataFrame:
    """Clusters numbered by the pseudo fill factor of their representative, best first."""
    m = meds.withColumn("pseudo_FF", pseudo_ff(F.col("medoid"), branch))
    w = W.orderBy(F.desc("pseudo_FF"), label)  # one row per cluster
    return m.withColumn("label_curve", F.row_number().over(w) - 1)


def medoid_validity(meds: DataFrame, branch: int, label: str = "label") -> DataFrame:
    """Boundary rules on the reverse branch: enough current, a closed end, mostly falling."""
    rev = F.slice("medoid", 1, branch)
    step = F.lit(1.0 / (branch - 1) + 1e-9)
    rises = F.transform(
        F.sequence(F.lit(1), F.lit(branch - 1)),
        lambda i: F.when((F.element_at("rev", i + 1) - F.element_at("rev", i)) / step > 0.05, 1.0).otherwise(0.0),
    )
    m = meds.withColumn("rev", rev)
    m = m.withColumn("j_sc", F.element_at("rev", 1)).withColumn("j_oc", F.element_at("rev", -1))
    m = m.withColumn("positive_slope_ratio", F.aggregate(rises, F.lit(0.0), lambda a, x: a + x) / F.lit(float(branch - 1)))
    ok = (F.col("j_sc") >= 0.5) & (F.col("j_oc") <= 0.3) & (F.col("positive_slope_ratio") <= 0.15)
    return m.withColumn("is_valid", ok).drop("rev")


def cluster_quantile_curves(df: DataFrame, label: str = "label") -> DataFrame:
    """Element-wise quartiles of the shapes of each cluster."""
    from helioframe.functions.ordered import exact_quantiles

    long = df.select(label, F.posexplode("shape").alias("pos", "j"))
    return exact_quantiles(long, [label, "pos"], "j", {"p25": 0.25, "p50": 0.5, "p75": 0.75})


def hourly_mode_label(curves: DataFrame, ts: str = "Timestamp", label: str = "label_curve") -> DataFrame:
    """Most frequent label per device, date and hour; the smallest wins a tie."""
    hour = [F.col("cell_name"), F.to_date(ts).alias("date"), F.hour(ts).alias("hour")]
    n = curves.groupBy(*hour, label).agg(F.count("*").alias("n"))
    best = F.max_by(F.struct(label, "n"), F.struct("n", -F.col(label))).alias("b")
    return n.groupBy("cell_name", "date", "hour").agg(best).select("cell_name", "date", "hour", F.col(f"b.{label}").alias(label), "b.n")
