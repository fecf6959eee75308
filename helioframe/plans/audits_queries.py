"""Audits of the sweep filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from helioframe.config import SETTINGS
from helioframe.functions import expr as X
from helioframe.operators import asof, audits as A, curves as C
from helioframe.plans import sweeps_queries as S
from helioframe.plans.registry import query, view
from helioframe.plans.stages import staged
from helioframe.plans.telemetry_queries import b10
from helioframe.sources import fixtures

@staged
def curve_table(spark, sf):
    """Stage output shared by the audits: one row per curve."""
    summary, floor, _ = C.sweeps_of_points(fixtures.sweep_points(spark, sf))
    t = C.physics_gate(C.curve_audit(None, stats=summary, floor=floor))
    t = t.withColumn("truth", X.physical_truth(F.col("all_night"), F.col("voc"), F.col("jsc")))
    return t.withColumn("hour", X.local_hour("t_min")).withColumn("label_curve", F.pmod("curve", F.lit(5)) - 1)


view(
    "v_curves",
    """
SELECT g.*, p.ff, p.p_mpp, hour(timezone('Europe/Madrid', t_min AT TIME ZONE 'UTC')) AS hour, g.curve % 5 - 1 AS label_curve,
  CASE WHEN all_night THEN 'reject_night' WHEN g.voc > 0.5 AND g.jsc > 2.0 THEN 'accept'
       WHEN g.voc < 0.4 OR g.jsc < 1.0 THEN 'reject_bad' ELSE 'gray' END AS truth
FROM v_gate g JOIN v_params p USING (cell_name, curve)
""",
)


@query("p22_physical_truth_label", "cell_name curve:i truth", "SELECT * FROM v_curves")
def _(spark, sf):
    return curve_table(spark, sf)


RATES = " UNION ALL ".join(f"SELECT '{r}' AS rule, avg(CAST({r} AS INT)) AS rate FROM v_curves" for r in C.RULES)


@query("a20_rule_rates", "rule rate:f", RATES)
def _(spark, sf):
    return A.rule_rates(curve_table(spark, sf))


SCORES = ["v_span_ratio", "snr_i", "spike_count", "hysteresis_index"]
LONG = " UNION ALL ".join(
    f"SELECT is_curve_valid, '{s}' AS score, CAST({s} AS DOUBLE) AS x FROM v_curves" for s in SCORES
)


@query(
    "a20_score_describe",
    "is_curve_valid:i score n:i mean:f std:f min:f p25:f p50:f p75:f max:f",
    f"""SELECT is_curve_valid, score, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min,
  quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, max(x) AS max
FROM ({LONG}) GROUP BY 1, 2""",
)
def _(spark, sf):
    return A.score_describe(curve_table(spark, sf), SCORES)


COOC = " UNION ALL ".join(
    f"SELECT '{a}' AS rule_a, '{b}' AS rule_b, count(*) FILTER ({a} AND {b}) AS n FROM v_curves WHERE is_curve_valid = 0"
    for a in C.RULES
    for b in C.RULES
)


@query("a21_rule_cooccurrence", "rule_a rule_b n:i", COOC)
def _(spark, sf):
    return A.rule_cooccurrence(curve_table(spark, sf))


NRULES = " + ".join(f"CAST({r} AS INT)" for r in C.RULES)


@query(
    "a22_rule_overlap",
    "n_rules:i n_curves:i",
    f"SELECT {NRULES} AS n_rules, count(*) AS n_curves FROM v_curves WHERE is_curve_valid = 0 GROUP BY 1",
)
def _(spark, sf):
    return A.rule_overlap(curve_table(spark, sf))


COMBO = "concat_ws('+', " + ", ".join(f"CASE WHEN {r} THEN '{r.removeprefix('rej_')}' END" for r in C.RULES) + ")"


@query(
    "a22_rule_combo",
    "combo n_curves:i",
    f"""SELECT CASE WHEN {COMBO} = '' THEN 'NONE' ELSE {COMBO} END AS combo, count(*) AS n_curves FROM v_curves
WHERE is_curve_valid = 0 GROUP BY 1 ORDER BY n_curves DESC, combo LIMIT 10""",
)
def _(spark, sf):
    return A.rule_combo(curve_table(spark, sf))


@query(
    "a23_confusion_matrix",
    "truth rejected:i accepted:i",
    """SELECT truth, count(*) FILTER (is_curve_valid = 0) AS rejected, count(*) FILTER (is_curve_valid = 1) AS accepted
FROM v_curves GROUP BY 1""",
)
def _(spark, sf):
    return A.confusion_matrix(curve_table(spark, sf))


@query(
    "a23_confusion_metrics",
    "agreement:f fn_rate:f fp_rate:f valid_lost:i broken_kept:i",
    """SELECT (ak + rd) / (na + nr) AS agreement, 1 - ak / greatest(na, 1) AS fn_rate, 1 - rd / greatest(nr, 1) AS fp_rate,
  na - ak AS valid_lost, nr - rd AS broken_kept FROM (
  SELECT count(*) FILTER (truth = 'accept') AS na, count(*) FILTER (truth IN ('reject_bad', 'reject_night')) AS nr,
    count(*) FILTER (truth = 'accept' AND is_curve_valid = 1) AS ak,
    count(*) FILTER (truth IN ('reject_bad', 'reject_night') AND is_curve_valid = 0) AS rd FROM v_curves)""",
)
def _(spark, sf):
    return A.confusion_metrics(curve_table(spark, sf))


ONLY = "rej_spike AND NOT (rej_night OR rej_unphysical OR rej_vspan_low OR rej_snr_low)"
FP = " UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) AS n_fp, count(*) FILTER ({c}) AS n FROM v_curves WHERE truth = 'accept' AND is_curve_valid = 0"
    for n, c in [*[(r, r) for r in C.RULES], ("only_spike", ONLY)]
)


@query("a24_fp_by_rule", "rule n_fp:i n:i share:f", f"SELECT *, n / nullif(n_fp, 0) AS share FROM ({FP})")
def _(spark, sf):
    return A.fp_by_rule(curve_table(spark, sf))


@query(
    "a24_spike_spectrum",
    "spike_count:i n_curves:i",
    f"SELECT spike_count, count(*) AS n_curves FROM v_curves WHERE truth = 'accept' AND {ONLY} GROUP BY 1",
)
def _(spark, sf):
    return A.spike_spectrum(curve_table(spark, sf))


@query(
    "a24_fn_profile",
    "cell_name total:i accepted:i fn_rate:f",
    """SELECT cell_name, count(*) AS total, sum(is_curve_valid) AS accepted, sum(is_curve_valid) / count(*) AS fn_rate
FROM v_curves WHERE truth = 'reject_bad' GROUP BY 1""",
)
def _(spark, sf):
    return A.fn_profile(curve_table(spark, sf))


KS = [2, 3, 4, 5, 6, 8, 10, 15, 20, 30]
SWEEP = f"""
SELECT k, accepted, accept_kept, bad_leaked, 100.0 * (n_accept - accept_kept) / greatest(n_accept, 1) AS loss_pct,
  100.0 * bad_leaked / greatest(accepted, 1) AS leak_pct
FROM (SELECT k, count(*) FILTER (ok) AS accepted, count(*) FILTER (ok AND truth = 'accept') AS accept_kept,
    count(*) FILTER (ok AND truth = 'reject_bad') AS bad_leaked, count(*) FILTER (truth = 'accept') AS n_accept
  FROM (SELECT k, truth, NOT rej_night AND NOT rej_unphysical AND NOT rej_vspan_low AND NOT rej_snr_low AND spike_count <= k AS ok
        FROM v_curves, (SELECT unnest({KS}) AS k)) GROUP BY k)
"""
view("v_sweep", SWEEP)


@query(
    "f17_spike_threshold_sweep",
    "k:i accepted:i accept_kept:i bad_leaked:i loss_pct:f leak_pct:f",
    "SELECT * FROM v_sweep",
)
def _(spark, sf):
    return A.spike_threshold_sweep(curve_table(spark, sf), KS)


@query(
    "w29_marginal_tradeoff",
    "k:i d_accept_kept:i d_bad_leaked:i d_loss_pct:f d_leak_pct:f",
    """SELECT k, accept_kept - lag(accept_kept) OVER w AS d_accept_kept, bad_leaked - lag(bad_leaked) OVER w AS d_bad_leaked,
  loss_pct - lag(loss_pct) OVER w AS d_loss_pct, leak_pct - lag(leak_pct) OVER w AS d_leak_pct
FROM v_sweep WINDOW w AS (ORDER BY k)""",
)
def _(spark, sf):
    return A.marginal_tradeoff(A.spike_threshold_sweep(curve_table(spark, sf), KS))


COMP = """
SELECT *, greatest(accept, reject_bad) AS purity, CASE WHEN accept > reject_bad THEN 'accept' ELSE 'reject_bad' END AS dominant
FROM (SELECT label_curve, count(*) AS n, count(*) FILTER (truth = 'accept') / count(*) AS accept,
  count(*) FILTER (truth = 'reject_bad') / count(*) AS reject_bad, count(*) FILTER (truth = 'gray') / count(*) AS gray,
  count(*) FILTER (truth = 'reject_night') / count(*) AS reject_night FROM v_curves WHERE label_curve >= 0 GROUP BY 1)
"""
view("v_comp", COMP)


@query(
    "a25_cluster_composition",
    "label_curve:i n:i accept:f reject_bad:f gray:f reject_night:f purity:f dominant",
    "SELECT * FROM v_comp",
)
def _(spark, sf):
    return A.cluster_composition(curve_table(spark, sf))


@query(
    "a25_recovery_rates",
    "truth n:i n_recovered:i recovery_pct:f",
    """SELECT truth, count(*) AS n, count(*) FILTER (dominant = truth) AS n_recovered,
  100.0 * count(*) FILTER (dominant = truth) / count(*) AS recovery_pct
FROM v_curves LEFT JOIN v_comp USING (label_curve) WHERE truth IN ('accept', 'reject_bad') GROUP BY 1""",
)
def _(spark, sf):
    return A.recovery_rates(curve_table(spark, sf))


@query(
    "a26_adjusted_rand_index",
    "ari:f",
    """WITH c AS (SELECT label_curve AS a, truth AS b, count(*) AS n FROM v_curves GROUP BY 1, 2),
sab AS (SELECT sum(n * (n - 1) / 2.0) AS s, sum(n) * (sum(n) - 1) / 2.0 AS total FROM c),
sa AS (SELECT sum(n * (n - 1) / 2.0) AS s FROM (SELECT a, sum(n) AS n FROM c GROUP BY 1)),
sb AS (SELECT sum(n * (n - 1) / 2.0) AS s FROM (SELECT b, sum(n) AS n FROM c GROUP BY 1))
SELECT (sab.s - sa.s * sb.s / total) / ((sa.s + sb.s) / 2.0 - sa.s * sb.s / total) AS ari FROM sab, sa, sb""",
)
def _(spark, sf):
    return A.adjusted_rand_index(curve_table(spark, sf), "label_curve", "truth")


LIMITS = [0.5, 0.6, 0.7]
PROFILE = ", ".join(
    [f"quantile_cont(pFF, {q}) AS {n}" for n, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999))]
    + [f"count(*) FILTER (pFF > {x}) AS above_{str(x).replace('.', '_')}" for x in LIMITS]
)


@query(
    "a27_distribution_profile",
    "cell_name n:i max:f p50:f p90:f p95:f p99:f p999:f above_0_5:i above_0_6:i above_0_7:i",
    f"""SELECT coalesce(cell_name, '(all)') AS cell_name, count(pFF) AS n, max(pFF) AS max, {PROFILE}
FROM v_rows GROUP BY ROLLUP (cell_name)""",
)
def _(spark, sf):
    rows = fixtures.curve_rows(spark, sf).select("cell_name", "pFF")
    return A.distribution_profile(rows, "pFF", LIMITS).withColumn("cell_name", F.coalesce("cell_name", F.lit("(all)")))


@query(
    "w17_largest_upper_gap",
    "gap_lo:f gap_hi:f width:f suggested_cap:f",
    """SELECT gap_lo, gap_hi, gap_hi - gap_lo AS width, (gap_lo + gap_hi) / 2 AS suggested_cap FROM (
  SELECT v AS gap_lo, lead(v) OVER (ORDER BY v) AS gap_hi FROM (
    SELECT DISTINCT pFF AS v FROM v_rows WHERE pFF >= (SELECT quantile_cont(pFF, 0.95) FROM v_rows)))
WHERE gap_hi IS NOT NULL ORDER BY gap_hi - gap_lo DESC, gap_hi LIMIT 1""",
)
def _(spark, sf):
    return A.largest_upper_gap(fixtures.curve_rows(spark, sf), "pFF")


HOURS = " ".join(f"{h}:f" for h in range(24))
PIVOT = ", ".join(f'1.0 - avg(is_curve_valid) FILTER (hour = {h}) AS "{h}"' for h in range(24))


@query("a28_reject_rate_by_hour", f"cell_name {HOURS}", f"SELECT cell_name, {PIVOT} FROM v_curves GROUP BY 1")
def _(spark, sf):
    return A.reject_rate_by_hour(curve_table(spark, sf))


METRICS = ["voc", "jsc", "ff", "v_span", "i_span"]
MLONG = " UNION ALL ".join(f"SELECT cell_name, is_curve_valid, '{m}' AS metric, {m} AS x FROM v_curves" for m in METRICS)
view(
    "v_profile",
    f"""SELECT cell_name, is_curve_valid, metric, count(x) AS n, quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.5) AS med,
  quantile_cont(x, 0.9) AS p90 FROM ({MLONG}) WHERE x IS NOT NULL GROUP BY 1, 2, 3""",
)


@query(
    "a29_validity_profile",
    "cell_name is_curve_valid:i metric n:i p10:f med:f p90:f",
    "SELECT * FROM v_profile",
)
def _(spark, sf):
    return A.validity_profile(curve_table(spark, sf), METRICS)


@query(
    "a29_validity_delta",
    "cell_name metric accepted:f rejected:f delta:f",
    """SELECT *, rejected - accepted AS delta FROM (SELECT cell_name, metric, max(med) FILTER (is_curve_valid = 1) AS accepted,
  max(med) FILTER (is_curve_valid = 0) AS rejected FROM v_profile GROUP BY 1, 2)""",
)
def _(spark, sf):
    return A.validity_delta(A.validity_profile(curve_table(spark, sf), METRICS))


@query(
    "a29_plausible_reject_share",
    "cell_name n_rejected:i voc_ok_pct:f jsc_ok_pct:f both_ok_pct:f",
    """SELECT cell_name, count(*) AS n_rejected, 100.0 * avg(CAST(coalesce(voc > 0.5, false) AS INT)) AS voc_ok_pct,
  100.0 * avg(CAST(coalesce(jsc > 5, false) AS INT)) AS jsc_ok_pct,
  100.0 * avg(CAST(coalesce(voc > 0.5, false) AND coalesce(jsc > 5, false) AS INT)) AS both_ok_pct
FROM v_curves WHERE is_curve_valid = 0 GROUP BY 1""",
)
def _(spark, sf):
    return A.plausible_reject_share(curve_table(spark, sf))


def _z(m: str) -> str:
    return f"""(SELECT cell_name, curve, abs({m} - med) / (1.4826 * (quantile_cont(abs({m} - med), 0.5) OVER (PARTITION BY cell_name, hour) + 1e-12)) AS z
  FROM (SELECT *, quantile_cont({m}, 0.5) OVER (PARTITION BY cell_name, hour) AS med FROM v_curves WHERE is_curve_valid = 1))"""


view(
    "v_robust",
    f"""SELECT a.cell_name, a.curve, a.z AS z_jsc, b.z AS z_p_mpp, coalesce(a.z > 4, false) OR coalesce(b.z > 4, false) AS is_outlier
FROM {_z('jsc')} a JOIN {_z('p_mpp')} b USING (cell_name, curve)""",
)


def neighbours(spark, sf):
    valid = curve_table(spark, sf).where("is_curve_valid = 1")
    return A.robust_z(valid.select("cell_name", "curve", "hour", "jsc", "p_mpp"), ["jsc", "p_mpp"])


@query("w15_robust_z", "cell_name curve:i z_jsc:f z_p_mpp:f is_outlier:b", "SELECT * FROM v_robust")
def _(spark, sf):
    return neighbours(spark, sf)


view(
    "v_irr",
    """
SELECT cell_name, curve, eff > 30 OR (eff < 0.5 AND poa > 200) AS fn_irr FROM (
  SELECT cell_name, curve, poa, 1000.0 * p_mpp / nullif(poa, 0) AS eff FROM (
    SELECT cell_name, curve, p_mpp,
      CASE WHEN least(coalesce(gb, gf), coalesce(gf, gb)) > 1200000000 THEN NULL
           WHEN gf IS NULL OR gb <= gf THEN poa_b ELSE poa_f END AS poa
    FROM (SELECT b.*, epoch_us(f.bucket) - epoch_us(b.t_min) AS gf, f.POA_Irradiance_W_m2 AS poa_f
      FROM (SELECT c.cell_name, c.curve, c.p_mpp, c.t_min, epoch_us(c.t_min) - epoch_us(d.bucket) AS gb, d.POA_Irradiance_W_m2 AS poa_b
            FROM (SELECT * FROM v_curves WHERE is_curve_valid = 1) c
            ASOF LEFT JOIN v_b10 d ON c.cell_name = d.cell_name AND c.t_min >= d.bucket) b
      ASOF LEFT JOIN v_b10 f ON b.cell_name = f.cell_name AND b.t_min <= f.bucket)))
WHERE poa IS NOT NULL
""",
)


def irradiance_judge(spark, sf):
    valid = curve_table(spark, sf).where("is_curve_valid = 1").select("cell_name", "curve", "p_mpp", "t_min")
    t = b10(spark, sf).withColumn("tie", F.lit(0))
    near = asof.asof_nearest(
        valid, t, ["cell_name"], "t_min", "bucket", ["POA_Irradiance_W_m2"], "tie", SETTINGS.merge_tolerance_seconds
    ).where(F.col("POA_Irradiance_W_m2").isNotNull())
    poa = F.col("POA_Irradiance_W_m2")
    eff = 1000.0 * F.col("p_mpp") / F.nullif(poa, F.lit(0.0))
    return near.select("cell_name", "curve", ((eff > 30) | ((eff < 0.5) & (poa > 200))).alias("fn_irr"))


VOTES = """
SELECT coalesce(fn_irr, false) AS fn_irr, coalesce(fn_neighbor, false) AS fn_neighbor, coalesce(fn_physics, false) AS fn_physics
FROM v_irr FULL JOIN (SELECT cell_name, curve, is_outlier AS fn_neighbor FROM v_robust) USING (cell_name, curve)
FULL JOIN (SELECT cell_name, curve, truth = 'reject_bad' AS fn_physics FROM v_curves) USING (cell_name, curve)
"""


@query(
    "j15_judge_vote_join",
    "n_votes:i fn_irr:i fn_neighbor:i fn_physics:i n_curves:i",
    f"""SELECT n_votes, count(*) FILTER (fn_irr) AS fn_irr, count(*) FILTER (fn_neighbor) AS fn_neighbor,
  count(*) FILTER (fn_physics) AS fn_physics, count(*) AS n_curves
FROM (SELECT *, CAST(fn_irr AS INT) + CAST(fn_neighbor AS INT) + CAST(fn_physics AS INT) AS n_votes FROM ({VOTES})) GROUP BY 1""",
)
def _(spark, sf):
    t = curve_table(spark, sf)
    votes = A.judge_votes(
        {
            "fn_irr": irradiance_judge(spark, sf),
            "fn_neighbor": neighbours(spark, sf).withColumn("fn_neighbor", F.col("is_outlier")),
            "fn_physics": t.withColumn("fn_physics", F.col("truth") == "reject_bad"),
        }
    )
    return votes.groupBy("n_votes").agg(
        *[F.count_if(c).alias(c) for c in ("fn_irr", "fn_neighbor", "fn_physics")], F.count("*").alias("n_curves")
    )


@query(
    "s04_pruned_scan",
    "cell_name curve:i voc:f jsc:f",
    "SELECT cell_name, curve, voc, jsc FROM v_curves WHERE is_curve_valid = 1",
)
def _(spark, sf):
    return curve_table(spark, sf).select("cell_name", "curve", "voc", "jsc", "is_curve_valid").where("is_curve_valid = 1")


@query(
    "s05_valid_counts_json",
    "cell_name n_valid:i",
    "SELECT cell_name, count(DISTINCT curve) AS n_valid FROM v_curves WHERE is_curve_valid = 1 GROUP BY 1",
)
def _(spark, sf):
    from helioframe.plans.sources_queries import scratch
    from helioframe.sources.files import valid_counts_json

    path = scratch(spark, "counts")
    valid_counts_json(curve_table(spark, sf), path)
    return spark.read.schema("cell_name string, n_valid long").json(path)


@query(
    "t04_stratified_sample_by_cell",
    "cell_name curve:i",
    """SELECT cell_name, curve FROM (SELECT *, row_number() OVER (PARTITION BY cell_name
  ORDER BY md5(cell_name || '|' || CAST(curve AS VARCHAR))) AS r FROM v_rows) WHERE r <= 50""",
)
def _(spark, sf):
    key = F.concat_ws("|", "cell_name", F.col("curve").cast("string"))
    return A.stratified_sample(fixtures.curve_rows(spark, sf).select("cell_name", "curve"), 400 // 8, key)


@query(
    "t05_sample_n",
    "cell_name curve:i",
    "SELECT cell_name, curve FROM v_rows ORDER BY md5(cell_name || '|' || CAST(curve AS VARCHAR)) LIMIT 200",
)
def _(spark, sf):
    key = F.concat_ws("|", "cell_name", F.col("curve").cast("string"))
    return A.sample_n(fixtures.curve_rows(spark, sf).select("cell_name", "curve"), 200, key)


@query(
    "j06_semi_join_keys",
    "cell_name curve:i",
    "SELECT cell_name, curve FROM v_rows SEMI JOIN (SELECT * FROM v_curves WHERE is_curve_valid = 1) USING (cell_name, curve)",
)
def _(spark, sf):
    keys = curve_table(spark, sf).where("is_curve_valid = 1")
    return fixtures.curve_rows(spark, sf).join(keys, ["cell_name", "curve"], "left_semi")


@query(
    "j07_label_projection",
    "cell_name curve:i label_curve:i",
    """SELECT c.cell_name, c.curve, coalesce(l.label_curve, -1) AS label_curve FROM v_curves c
LEFT JOIN (SELECT * FROM v_curves WHERE is_curve_valid = 1) l USING (cell_name, curve)""",
)
def _(spark, sf):
    t = curve_table(spark, sf)
    labels = t.where("is_curve_valid = 1").select("cell_name", "curve", "label_curve")
    return t.drop("label_curve").join(labels, ["cell_name", "curve"], "left").withColumn(
        "label_curve", F.coalesce("label_curve", F.lit(-1))
    )


@query(
    "u04_key_intersection",
    "cell_name curve:i",
    """SELECT cell_name, curve FROM v_curves WHERE label_curve >= 0 INTERSECT
SELECT cell_name, curve FROM v_curves WHERE is_curve_valid = 1""",
)
def _(spark, sf):
    t = curve_table(spark, sf)
    k = t.where("label_curve >= 0").select("cell_name", "curve")
    return k.intersect(t.where("is_curve_valid = 1").select("cell_name", "curve"))


@query(
    "u05_drop_duplicates",
    "cell_name curve:i",
    "SELECT DISTINCT cell_name, curve FROM v_seg",
)
def _(spark, sf):
    return S.points(spark, sf).select("cell_name", "curve").dropDuplicates(["cell_name", "curve"])
