"""Curve shapes: cluster quality, representatives and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from helioframe.operators import shapes as H
from helioframe.plans.registry import query, view
from helioframe.sources import fixtures

B = 32  # points per branch of the stand-in shapes
view("v_shapes", "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS shape FROM embeddings")
view("v_kshapes", "SELECT vec_id, k, label % k AS label, shape FROM v_shapes, (SELECT unnest(range(2, 9)) AS k)")


def by_k(spark, sf):
    """The given labels folded to k = 2..8 classes."""
    s = fixtures.shapes(spark, sf)
    k = F.explode(F.sequence(F.lit(2), F.lit(8)))
    return s.withColumn("k", k).withColumn("label", F.pmod("label", F.col("k")))


view(
    "v_kcent",
    """SELECT k, label, list(m ORDER BY pos) AS centre, max(n) AS size FROM (
  SELECT k, label, pos, avg(x) AS m, count(*) AS n FROM (
    SELECT k, label, unnest(shape) AS x, generate_subscripts(shape, 1) AS pos FROM v_kshapes) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
view(
    "v_kstat",
    f"""SELECT s.k, s.label, any_value(c.centre) AS centre, count(*) AS size, sum(d2) AS ss, avg(sqrt(d2)) AS scatter, sum(d2) / count(*) AS var
FROM (SELECT s.k, s.label, {D2.format(a='s.shape', b='c.centre')} AS d2 FROM v_kshapes s JOIN v_kcent c USING (k, label)) s
JOIN v_kcent c USING (k, label) GROUP BY 1, 2""",
)
view(
    "v_sil",
    f"""SELECT k, avg(CASE WHEN sz = 1 THEN 0 ELSE (b - a) / nullif(greatest(a, b), 0) END) AS silhouette FROM (
  SELECT k, vec_id, max(CASE WHEN own THEN md * sz / nullif(sz - 1, 0) END) AS a, min(CASE WHEN NOT own THEN md END) AS b, max(CASE WHEN own THEN sz END) AS sz FROM (
    SELECT s.k, s.vec_id, s.label = c.label AS own, {D2.format(a='s.shape', b='c.centre')} + c.var AS md, c.size AS sz
    FROM v_kshapes s JOIN v_kstat c ON s.k = c.k) GROUP BY 1, 2) GROUP BY 1""",
)
view(
    "v_grand",
    """SELECT list(m ORDER BY pos) AS grand, max(n) AS n_all FROM (SELECT pos, avg(x) AS m, count(*) AS n FROM (
  SELECT unnest(shape) AS x, generate_subscripts(shape, 1) AS pos FROM v_shapes) GROUP BY 1)""",
)
view(
    "v_quality",
    f"""SELECT k, inertia, davies_bouldin, (bt / (nc - 1)) / (inertia / (n_all - nc)) AS calinski_harabasz, silhouette FROM (
  SELECT k, sum(ss) AS inertia, count(*) AS nc, sum(size * {D2.format(a='centre', b='grand')}) AS bt, max(n_all) AS n_all FROM v_kstat, v_grand GROUP BY 1)
JOIN (SELECT k, avg(w) AS davies_bouldin FROM (SELECT i.k, i.label, max((i.scatter + j.scatter) / sqrt({D2.format(a='i.centre', b='j.centre')})) AS w
  FROM v_kstat i JOIN v_kstat j ON i.k = j.k AND i.label <> j.label GROUP BY 1, 2) GROUP BY 1) USING (k) JOIN v_sil USING (k)""",
)


@query(
    "m03_cluster_quality",
    "k:i inertia:f davies_bouldin:f calinski_harabasz:f silhouette:f",
    "SELECT * FROM v_quality",
)
def _(spark, sf):
    return H.cluster_quality(by_k(spark, sf))


def _ff(c: str, n: int = B) -> str:
    half = lambda lo: f"list_max(list_transform(list_slice({c}, {lo + 1}, {lo + n}), lambda x, i: x * ((i - 1) / {n - 1}.0::DOUBLE)))"
    return f"({half(0)} + {half(n)}) / 2.0"


view(
    "v_gap",
    f"""SELECT k, min(gap) AS min_delta_pff FROM (SELECT k, lead(ff) OVER (PARTITION BY k ORDER BY ff) - ff AS gap FROM (
  SELECT k, {_ff('centre')} AS ff FROM v_kcent)) GROUP BY 1""",
)


@query("m04_min_delta_pff", "k:i min_delta_pff:f", "SELECT * FROM v_gap")
def _(spark, sf):
    return H.min_delta_pff(by_k(spark, sf), B)


view(
    "v_elbow",
    """SELECT *, abs((y1 - y0) * x - y + y0) / sqrt((y1 - y0) * (y1 - y0) + 1) AS elbow FROM (
  SELECT k, silhouette, davies_bouldin, (k - 2) / 6.0::DOUBLE AS x, (inertia - i0) / (i1 - i0) AS y, (first - i0) / (i1 - i0) AS y0, (last - i0) / (i1 - i0) AS y1
  FROM v_quality, (SELECT min(inertia) AS i0, max(inertia) AS i1, arg_min(inertia, k) AS first, arg_max(inertia, k) AS last FROM v_quality))""",
)


@query("w33_elbow_distance", "k:i elbow:f", "SELECT * FROM v_elbow")
def _(spark, sf):
    return H.elbow_distance(H.cluster_quality(by_k(spark, sf)))


@query(
    "m05_choose_k",
    "k_elbow:i k_silhouette:i k_davies_bouldin:i consensus:b k:i",
    """WITH m AS (SELECT * FROM v_elbow JOIN v_gap USING (k)),
v AS (SELECT * FROM m WHERE CASE WHEN (SELECT bool_or(k >= 3 AND min_delta_pff >= 0.04) FROM m) THEN k >= 3 AND min_delta_pff >= 0.04 ELSE k >= 3 END),
c AS (SELECT arg_max(k, elbow) AS k_elbow, arg_max(k, silhouette) AS k_silhouette, arg_min(k, davies_bouldin) AS k_davies_bouldin FROM v)
SELECT *, k_silhouette = k_davies_bouldin AND k_silhouette <> k_elbow AS consensus,
  CASE WHEN k_silhouette = k_davies_bouldin THEN k_silhouette ELSE k_elbow END AS k FROM c""",
)
def _(spark, sf):
    d = by_k(spark, sf)
    return H.choose_k(H.elbow_distance(H.cluster_quality(d)).join(H.min_delta_pff(d, B), "k"))


view(
    "v_med",
    f"""SELECT label, vec_id AS medoid_id, shape AS medoid, size FROM (
  SELECT s.*, c.size, row_number() OVER (PARTITION BY s.label ORDER BY round({D2.format(a='s.shape', b='c.centre')}, 12), s.vec_id) AS r
  FROM v_shapes s JOIN (SELECT label, list(m ORDER BY pos) AS centre, max(n) AS size FROM (
    SELECT label, pos, avg(x) AS m, count(*) AS n FROM (SELECT label, unnest(shape) AS x, generate_subscripts(shape, 1) AS pos FROM v_shapes) GROUP BY 1, 2)
    GROUP BY 1) c USING (label)) WHERE r = 1""",
)
view(
    "v_assign",
    f"""SELECT vec_id, label, assigned, sqrt(d2) AS distance FROM (
  SELECT s.vec_id, s.label, m.label AS assigned, {D2.format(a='s.shape', b='m.medoid')} AS d2,
    row_number() OVER (PARTITION BY s.vec_id ORDER BY {D2.format(a='s.shape', b='m.medoid')}, m.label) AS r FROM v_shapes s, v_med m) WHERE r = 1""",
)


@query("m06_medoids", "label:i medoid_id:i size:i", "SELECT * FROM v_med")
def _(spark, sf):
    return H.medoids(fixtures.shapes(spark, sf), "vec_id")


@query("m06_medoid_assign", "vec_id:i assigned:i distance:f", "SELECT * FROM v_assign")
def _(spark, sf):
    s = fixtures.shapes(spark, sf)
    return H.medoid_assign(s, H.medoids(s, "vec_id"))


@query("m07_pseudo_ff", "vec_id:i pseudo_FF:f", f"SELECT vec_id, {_ff('shape')} AS pseudo_FF FROM v_shapes")
def _(spark, sf):
    return fixtures.shapes(spark, sf).withColumn("pseudo_FF", H.pseudo_ff(F.col("shape"), B))


@query(
    "m07_renumber_by_ff",
    "label:i label_curve:i pseudo_FF:f",
    f"SELECT label, ff AS pseudo_FF, row_number() OVER (ORDER BY ff DESC, label) - 1 AS label_curve FROM (SELECT label, {_ff('medoid')} AS ff FROM v_med)",
)
def _(spark, sf):
    return H.renumber_by_ff(H.medoids(fixtures.shapes(spark, sf), "vec_id"), B)


@query(
    "m08_medoid_validity",
    "label:i j_sc:f j_oc:f positive_slope_ratio:f is_valid:b",
    f"""SELECT *, j_sc >= 0.5 AND j_oc <= 0.3 AND positive_slope_ratio <= 0.15 AS is_valid FROM (
  SELECT label, medoid[1] AS j_sc, medoid[{B}] AS j_oc,
    len(list_filter(range(1, {B}), lambda i: (medoid[i + 1] - medoid[i]) / (1.0::DOUBLE / {B - 1} + 1e-9) > 0.05)) / {B - 1}.0::DOUBLE AS positive_slope_ratio FROM v_med)""",
)
def _(spark, sf):
    return H.medoid_validity(H.medoids(fixtures.shapes(spark, sf), "vec_id"), B)


@query(
    "a48_cluster_quantile_curves",
    "label:i pos:i n:i p25:f p50:f p75:f",
    """SELECT label, pos - 1 AS pos, count(*) AS n, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75
FROM (SELECT label, unnest(shape) AS x, generate_subscripts(shape, 1) AS pos FROM v_shapes) GROUP BY 1, 2""",
)
def _(spark, sf):
    return H.cluster_quantile_curves(fixtures.shapes(spark, sf))


@query(
    "a26_medoid_label_agreement",
    "ari:f",
    """WITH c AS (SELECT label AS a, assigned AS b, count(*) AS n FROM v_assign GROUP BY 1, 2),
sab AS (SELECT sum(n * (n - 1) / 2.0) AS s, sum(n) * (sum(n) - 1) / 2.0 AS total FROM c),
sa AS (SELECT sum(n * (n - 1) / 2.0) AS s FROM (SELECT a, sum(n) AS n FROM c GROUP BY 1)),
sb AS (SELECT sum(n * (n - 1) / 2.0) AS s FROM (SELECT b, sum(n) AS n FROM c GROUP BY 1))
SELECT (sab.s - sa.s * sb.s / total) / ((sa.s + sb.s) / 2.0 - sa.s * sb.s / total) AS ari FROM sab, sa, sb""",
)
def _(spark, sf):
    from helioframe.operators.audits import adjusted_rand_index

    s = fixtures.shapes(spark, sf)
    return adjusted_rand_index(H.medoid_assign(s, H.medoids(s, "vec_id")), "label", "assigned")


@query(
    "a47_hourly_mode_label",
    "cell_name date:d hour:i label_curve:i n:i",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_name, date, hour ORDER BY n DESC, label_curve) AS r FROM (
  SELECT cell_name, CAST("Timestamp" AS DATE) AS date, hour("Timestamp") AS hour, label_curve, count(*) AS n FROM v_rows GROUP BY ALL)) WHERE r = 1""",
)
def _(spark, sf):
    return H.hourly_mode_label(fixtures.curve_rows(spark, sf))
