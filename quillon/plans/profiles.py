"""Queries over profiles and quality control: boundaries, policies, vetoes, thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boundary, draws, qc
from ..schemas import FOCALITY
from .catalogue import query
from .predictions import _round
from .standins import PROFILE, profile, table

_PREFIX = """pre AS (SELECT user_id, i AS k, value, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, sum(value) OVER (PARTITION BY user_id) AS t, count(*) OVER (PARTITION BY user_id) AS n FROM profile),
rat AS (SELECT *, (s / k) / ((t - s) / (n - k)) AS ratio FROM pre WHERE k > 0),
sc AS (SELECT *, round(abs(ln(ratio)), 9) AS score FROM rat WHERE ratio > 0)"""
_BEST = "best AS (SELECT user_id, n, arg_max(k, (score, -k)) AS k, max(score) AS score FROM sc WHERE k >= floor(n * 0.1) AND k < floor(n * 0.9) GROUP BY 1, 2)"


def _best(spark, d, margin=0.1):
    return boundary.best_split(profile(spark, d), "value", "i", "user_id", margin=margin)


@query("best_split_point", f"WITH {PROFILE}, {_PREFIX}, {_BEST} SELECT user_id, n, k, round(k / n::DOUBLE, 6) AS fraction, round(score, 6) AS score FROM best")
def best_split_point(spark, d):
    return _round(_best(spark, d), "fraction", "score")


@query("ratio_at_midpoint", f"WITH {PROFILE}, {_PREFIX} SELECT user_id, n, k, round(ratio, 6) AS ratio FROM rat WHERE k = greatest(1, least(round_even(n * 0.5::DOUBLE, 0), n - 1))")
def ratio_at_midpoint(spark, d):
    return _round(boundary.ratio_at(profile(spark, d), "value", "i", 0.5, "user_id"), "ratio")


@query("alpha_split", f"WITH {PROFILE}, h AS (SELECT user_id, avg(value) FILTER (i % 2 = 0) AS a, avg(value) FILTER (i % 2 = 1) AS b FROM profile GROUP BY 1) SELECT user_id, round(a / b, 6) AS alpha_ratio, a / b < 1 AS swapped, a / b > 0.7 AND a / b < 1.4 AS ambiguous FROM h")
def alpha_split(spark, d):
    h = profile(spark, d).groupBy("user_id").agg(F.avg(F.when(F.col("i") % 2 == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("i") % 2 == 1, F.col("value"))).alias("b"))
    return _round(boundary.alpha_split(h, "a", "b").drop("a", "b"), "alpha_ratio")


def _cells(rows: str, by: str) -> str:
    return f"(SELECT {by}, k, n, (s / k) / ((t - s) / (n - k)) AS ratio FROM (SELECT {by}, k, coalesce(sum(value) OVER (PARTITION BY {by} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, sum(value) OVER (PARTITION BY {by}) AS t, count(*) OVER (PARTITION BY {by}) AS n FROM {rows}) WHERE k > 0)"


def _splits(rows: str, by: str) -> str:
    return f"(SELECT {by}, n, arg_max(k, (score, -k)) AS k, max(score) AS score FROM (SELECT *, round(abs(ln(ratio)), 9) AS score FROM {_cells(rows, by)} WHERE ratio > 0) WHERE k >= floor(n * 0.1) AND k < floor(n * 0.9) GROUP BY {by}, n)"


_ANALYSIS = f"""{PROFILE}, whole AS (SELECT user_id, i AS k, value FROM profile), half AS (SELECT user_id, CASE i % 2 WHEN 0 THEN 'a' ELSE 'b' END AS half, i // 2 AS k, value FROM profile),
shuffled AS (SELECT user_id, b, value, row_number() OVER (PARTITION BY user_id, b ORDER BY key) - 1 AS k FROM {draws.keys_sql("(SELECT * FROM profile, range(200) t(b))", "event_id", "b", 42)}),
one AS {_splits("whole", "user_id")}, null_ AS {_splits("shuffled", "user_id, b")}, two AS {_splits("half", "user_id, half")}, cell AS {_cells("whole", "user_id")},
p AS (SELECT user_id, (sum((null_.score >= one.score)::INT) + 1) / 201 AS perm_p, median(null_.score) AS perm_null_median FROM null_ JOIN one USING (user_id) GROUP BY user_id),
h AS (SELECT user_id, max(k / n::DOUBLE) FILTER (half = 'a') AS a_frac, max(k / n::DOUBLE) FILTER (half = 'b') AS b_frac FROM two GROUP BY user_id),
mid AS (SELECT user_id, ratio FROM cell WHERE k = greatest(1, least(round_even(n * 0.5::DOUBLE, 0), n - 1))),
v AS (SELECT user_id, n, k, k / n::DOUBLE AS fraction, score, c.ratio AS best_ratio, mid.ratio AS midpoint_ratio, abs(ln(mid.ratio)) AS midpoint_score, perm_p, perm_null_median, a_frac, b_frac, abs(a_frac - b_frac) AS split_half_diff
  FROM one JOIN (SELECT user_id, k, ratio FROM cell) c USING (user_id, k) JOIN mid USING (user_id) JOIN p USING (user_id) LEFT JOIN h USING (user_id)),
w AS (SELECT *, CASE WHEN midpoint_score > 0 THEN score / midpoint_score END AS gain, fraction <= 0.1 + 1e-6 OR fraction >= 0.9 - 1e-6 AS pinned, perm_p < 0.05 AS passes_perm, coalesce(split_half_diff <= 0.08, false) AS passes_split_half, fraction BETWEEN 0.25 AND 0.75 AS plausible FROM v)"""


def _analysis(spark, d):
    """Of a user's events, even and odd ones are the two channels."""
    rows = profile(spark, d)
    half = rows.select("user_id", F.when(F.col("i") % 2 == 0, "a").otherwise("b").alias("half"), F.floor(F.col("i") / 2).alias("i"), "value")
    return boundary.analyse(rows, half, "value", "i", "event_id", "user_id")


@query("boundary_analysis", f"WITH {_ANALYSIS} SELECT user_id, n, k, round(score, 6) AS score, round(best_ratio, 6) AS best_ratio, round(midpoint_ratio, 6) AS midpoint_ratio, round(gain, 6) AS gain, perm_p, round(perm_null_median, 6) AS perm_null_median, round(a_frac, 6) AS a_frac, round(b_frac, 6) AS b_frac, round(split_half_diff, 6) AS split_half_diff, pinned FROM w")
def boundary_analysis(spark, d):
    found = _analysis(spark, d).select("user_id", "n", "k", "score", "best_ratio", "midpoint_ratio", "gain", "perm_p", "perm_null_median", "a_frac", "b_frac", "split_half_diff", "pinned")
    return _round(found, "score", "best_ratio", "midpoint_ratio", "gain", "perm_null_median", "a_frac", "b_frac", "split_half_diff")


@query("boundary_verdict", f"WITH {_ANALYSIS} SELECT user_id, passes_perm, passes_split_half, plausible, passes_perm AND passes_split_half AND plausible AS trusted FROM w")
def boundary_verdict(spark, d):
    return _analysis(spark, d).select("user_id", "passes_perm", "passes_split_half", "plausible", "trusted")


@query("two_vote_agreement", f"WITH {PROFILE}, h AS (SELECT user_id, round(avg(value) FILTER (i % 2 = 0), 9) > round(avg(value) FILTER (i % 2 = 1), 9) AS a, round(avg(value) FILTER (event_type = 'click'), 9) > round(avg(value) FILTER (event_type = 'view'), 9) AS b FROM profile GROUP BY 1), s AS (SELECT count(*) AS n, avg((a = b)::INT) AS agreement FROM h WHERE a IS NOT NULL AND b IS NOT NULL) SELECT n, agreement, CASE WHEN agreement < 0.7 THEN 'abandon' WHEN agreement < 0.85 THEN 'moderate' ELSE 'strong' END AS calibration FROM s")
def two_vote_agreement(spark, d):
    mean = lambda c: F.round(F.avg(F.when(c, F.col("value"))), 9)
    h = profile(spark, d).groupBy("user_id").agg((mean(F.col("i") % 2 == 0) > mean(F.col("i") % 2 == 1)).alias("a"), (mean(F.col("event_type") == "click") > mean(F.col("event_type") == "view")).alias("b"))
    return boundary.two_votes(h.filter("a IS NOT NULL AND b IS NOT NULL"), F.col("a"), F.col("b"))


@query("boundary_moved", f"WITH {PROFILE}, {_PREFIX}, {_BEST}, other AS (SELECT user_id, n, arg_max(k, (score, -k)) AS k FROM sc WHERE k >= floor(n * 0.2) AND k < floor(n * 0.8) GROUP BY 1, 2) SELECT user_id, round(b.k / b.n::DOUBLE, 6) AS fraction_a, round(o.k / o.n::DOUBLE, 6) AS fraction_b, abs(b.k / b.n::DOUBLE - o.k / o.n::DOUBLE) > 0.02 AS moved FROM best b JOIN other o USING (user_id)")
def boundary_moved(spark, d):
    return _round(boundary.moved(_best(spark, d), _best(spark, d, 0.2), "user_id"), "fraction_a", "fraction_b")


@query("boundary_gate", f"WITH {PROFILE}, {_PREFIX}, {_BEST}, other AS (SELECT user_id, n, arg_max(k, (score, -k)) AS k FROM sc WHERE k >= floor(n * 0.2) AND k < floor(n * 0.8) GROUP BY 1, 2), m AS (SELECT abs(b.k / b.n::DOUBLE - o.k / o.n::DOUBLE) > 0.02 AS moved FROM best b JOIN other o USING (user_id)) SELECT count(*) AS n, avg((NOT moved)::INT) AS agree, avg((NOT moved)::INT) >= 0.8 AS passes FROM m")
def boundary_gate(spark, d):
    return boundary.consistency_gate(boundary.moved(_best(spark, d), _best(spark, d, 0.2), "user_id"))


# --- quality control --------------------------------------------------------------------------

_RATES = "rates AS (SELECT user_id, count(*) AS n, count(*) FILTER (value > 60) / count(*)::DOUBLE AS rate, CASE WHEN user_id % 9 = 0 THEN NULL ELSE user_id % 5 = 0 END AS capped FROM events GROUP BY user_id)"


def _rates(spark, d):
    r = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), (F.sum((F.col("value") > 60).cast("long")) / F.count("*")).alias("rate"))
    return r.withColumn("capped", F.when(F.col("user_id") % 9 != 0, F.col("user_id") % 5 == 0))


@query("qc_thresholds", f"WITH {_RATES} SELECT round(quantile_cont(rate, 0.9), 6) AS q90, round(quantile_cont(rate, 0.95), 6) AS q95, round(median(rate), 6) AS q50 FROM rates")
def qc_thresholds(spark, d):
    return _rates(spark, d).agg(*[F.round(F.percentile("rate", q), 6).alias(n) for q, n in ((0.9, "q90"), (0.95, "q95"), (0.5, "q50"))])


_POLICY = f"{_RATES}, c AS (SELECT *, coalesce(capped, false) AS x, coalesce(rate > 0.3, false) AS y FROM rates), pol AS (SELECT 'none' AS policy, * FROM c UNION ALL SELECT 'drop_capped', * FROM c WHERE NOT x UNION ALL SELECT 'drop_tail', * FROM c WHERE NOT y UNION ALL SELECT 'drop_either', * FROM c WHERE NOT (x OR y))"


def _policies(spark, d):
    return qc.policy_table(_rates(spark, d), qc.policies(F.col("capped"), F.col("rate") > 0.3))


@query("qc_policy_counts", f"WITH {_POLICY} SELECT policy, count(*) AS n FROM pol GROUP BY 1")
def qc_policy_counts(spark, d):
    return _policies(spark, d).groupBy("policy").agg(F.count("*").alias("n"))


@query("qc_policy_auc", f"WITH {_POLICY}, p AS (SELECT policy, user_id % 2 AS truth, round(rate, 9) AS s FROM pol), r AS (SELECT *, rank() OVER (PARTITION BY policy ORDER BY s) + (count(*) OVER (PARTITION BY policy, s) - 1) / 2.0 AS k FROM p) SELECT policy, CAST(sum(truth) AS BIGINT) AS n_pos, CAST(sum(1 - truth) AS BIGINT) AS n_neg, round((sum(truth * k) - sum(truth) * (sum(truth) + 1) / 2.0) / (sum(truth) * sum(1 - truth))::DOUBLE, 9) AS auc FROM r GROUP BY 1")
def qc_policy_auc(spark, d):
    from ..operators.metrics import rank_auc

    rows = _policies(spark, d).withColumn("s", F.round("rate", 9))
    return _round(rank_auc(rows, F.col("user_id") % 2 == 1, "s", "policy"), "auc", digits=9)


@query("rejection_triage", f"WITH {_RATES} SELECT CASE WHEN rate > 0.5 THEN 'over_50' WHEN rate > 0.3 THEN '30_to_50' ELSE 'under_30' END AS bucket, count(*) AS n FROM rates GROUP BY 1")
def rejection_triage(spark, d):
    return _rates(spark, d).groupBy(qc.triage(F.col("rate")).alias("bucket")).agg(F.count("*").alias("n"))


@query("qc_response", """WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS n_events_ec, count(*) FILTER (event_type = 'click' AND value <= 60) AS n_kept_ec, count(*) FILTER (event_type = 'view') AS n_events_eo, count(*) FILTER (event_type = 'view' AND value <= 60) AS n_kept_eo, user_id % 5 = 0 AS capped FROM events GROUP BY user_id),
r AS (SELECT *, CASE WHEN n_events_ec > 0 THEN 1 - n_kept_ec / n_events_ec::DOUBLE END AS rate_ec, CASE WHEN n_events_eo > 0 THEN 1 - n_kept_eo / n_events_eo::DOUBLE END AS rate_eo FROM c)
SELECT user_id, round(rate_ec, 6) AS rate_ec, round(rate_eo, 6) AS rate_eo, coalesce((rate_ec > 0.3)::INT, 0) + coalesce((rate_eo > 0.3)::INT, 0) + capped::INT AS n_notes, coalesce(rate_ec > 0.3, false) OR coalesce(rate_eo > 0.3, false) OR capped AS flagged FROM r""")
def qc_response(spark, d):
    on = lambda t, more=F.lit(True): F.sum(((F.col("event_type") == t) & more).cast("long"))
    c = table(spark, d, "events").groupBy("user_id").agg(on("click").alias("n_events_ec"), on("click", F.col("value") <= 60).alias("n_kept_ec"), on("view").alias("n_events_eo"), on("view", F.col("value") <= 60).alias("n_kept_eo"))
    out = qc.quality_notes(c.withColumn("capped", F.col("user_id") % 5 == 0), ["ec", "eo"])
    return _round(out.select("user_id", "rate_ec", "rate_eo", F.size("notes").alias("n_notes"), "flagged"), "rate_ec", "rate_eo")


@query("threshold_solve", """WITH v AS (SELECT user_id, value FROM events), u AS (SELECT DISTINCT value AS t FROM v), r AS (SELECT t, user_id, avg((value > t)::INT) AS r FROM u, v GROUP BY 1, 2), m AS (SELECT t, median(r) AS med FROM r GROUP BY 1)
SELECT min(t) AS threshold, round(arg_min(med, t), 6) AS median_rejection FROM m WHERE round(med, 9) <= 0.2""")
def threshold_solve(spark, d):
    return _round(qc.solve_threshold(table(spark, d, "events"), "value", "user_id", 0.2), "median_rejection")


_WEIGHTS = """w AS (SELECT vec_id, ['Fp1', 'Fp2', 'F7', 'F3', 'Fz', 'F4', 'F8', 'T3', 'C3', 'Cz', 'C4', 'T4', 'T5', 'P3', 'Pz', 'P4', 'T6', 'O1', 'O2'][j] AS channel, embedding[j]::DOUBLE AS weight FROM embeddings, range(1, 20) t(j)),
reg AS (SELECT *, CASE WHEN channel IN ('Fp1', 'Fp2') THEN 'frontopolar' WHEN channel LIKE 'F%' THEN 'frontal' WHEN channel LIKE 'T%' THEN 'temporal' WHEN channel LIKE 'C%' THEN 'central' WHEN channel LIKE 'P%' THEN 'parietal' ELSE 'occipital' END AS region FROM w),
al AS (SELECT vec_id, avg(abs(weight)) AS m FROM reg GROUP BY 1), rel AS (SELECT vec_id, region, avg(abs(weight)) / nullif(any_value(m), 0) AS relative FROM reg JOIN al USING (vec_id) GROUP BY 1, 2),
top AS (SELECT vec_id, arg_min(region, (-round(relative, 9), region)) AS peak_region, arg_min(relative, (-round(relative, 9), region)) AS focality FROM rel GROUP BY 1),
comp AS (SELECT vec_id, CASE label % 3 WHEN 0 THEN 'eog' WHEN 1 THEN 'muscle' ELSE 'other' END AS reason FROM embeddings)"""


def _relative(spark, d):
    from ..schemas import CHANNELS, SCALP_REGIONS

    names = F.array(*map(F.lit, CHANNELS))
    v = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 19)).alias("j", "x"))
    weights = v.select("vec_id", F.get(names, F.col("j")).alias("channel"), F.col("x").cast("double").alias("weight"))
    return qc.region_weights(weights, SCALP_REGIONS, "vec_id")


def _components(spark, d):
    reason = F.when(F.col("label") % 3 == 0, "eog").when(F.col("label") % 3 == 1, "muscle").otherwise("other")
    return table(spark, d, "embeddings").select("vec_id", F.array(reason).alias("reasons"))


@query("region_weights", f"WITH {_WEIGHTS} SELECT vec_id, region, round(relative, 6) AS relative FROM rel")
def region_weights(spark, d):
    return _round(_relative(spark, d), "relative")


@query("topography_veto", f"""WITH {_WEIGHTS} SELECT vec_id, reason, peak_region, round(focality, 6) AS focality, (reason = 'other' OR (reason = 'eog' AND peak_region IN ('frontopolar', 'frontal')) OR (reason = 'muscle' AND peak_region = 'temporal')) AND focality >= 2.0 AS keep FROM top JOIN comp USING (vec_id)""")
def topography_veto(spark, d):
    out = qc.topography_veto(_components(spark, d), _relative(spark, d), "vec_id", focality=FOCALITY)
    return _round(out.select("vec_id", F.col("reasons")[0].alias("reason"), "peak_region", "focality", "keep"), "focality")


@query("veto_rule_table", f"""WITH {_WEIGHTS}, a AS (SELECT * FROM top JOIN comp USING (vec_id)), r AS (
  SELECT 'all' AS rule, true AS keep FROM a UNION ALL SELECT 'focal_1_5', round(focality, 9) >= 1.5 FROM a UNION ALL SELECT 'focal_2', round(focality, 9) >= 2 FROM a UNION ALL SELECT 'not_occipital', peak_region <> 'occipital' FROM a
  UNION ALL SELECT 'eog_frontal', contains(reason, 'eog') AND peak_region IN ('frontopolar', 'frontal') FROM a UNION ALL SELECT 'muscle_temporal', contains(reason, 'muscle') AND peak_region = 'temporal' FROM a UNION ALL SELECT 'frontal_and_focal', peak_region IN ('frontopolar', 'frontal') AND round(focality, 9) >= 1.5 FROM a)
SELECT rule, count(*) FILTER (keep) AS kept, round(count(*) FILTER (keep) / 20.0::DOUBLE, 6) AS per_subject, round(100 * (1 - count(*) FILTER (keep) / count(*)::DOUBLE), 6) AS pct_vetoed FROM r GROUP BY 1""")
def veto_rule_table(spark, d):
    rows = qc.topography_veto(_components(spark, d), _relative(spark, d), "vec_id")
    region, focal, reason = F.col("peak_region"), F.round("focality", 9), F.col("reasons")[0]
    frontal = region.isin("frontopolar", "frontal")
    rules = {
        "all": F.lit(True),
        "focal_1_5": focal >= 1.5,
        "focal_2": focal >= 2,
        "not_occipital": region != "occipital",
        "eog_frontal": F.contains(reason, F.lit("eog")) & frontal,
        "muscle_temporal": F.contains(reason, F.lit("muscle")) & (region == "temporal"),
        "frontal_and_focal": frontal & (focal >= 1.5),
    }
    return _round(qc.rule_table(rows, rules, 20), "per_subject", "pct_vetoed")


@query("peak_rule_table", f"""WITH {_WEIGHTS}, o AS (SELECT vec_id, round(relative, 9) AS occipital FROM rel WHERE region = 'occipital'),
a AS (SELECT round(focality, 9) AS f, occipital, reason = 'other' OR (reason = 'eog' AND peak_region IN ('frontopolar', 'frontal')) OR (reason = 'muscle' AND peak_region = 'temporal') AS fits FROM top JOIN comp USING (vec_id) JOIN o USING (vec_id)),
r AS (SELECT unnest(['none', 'fits', 'above_1_5', 'above_2', 'fits_above_1_5', 'fits_above_2', 'fits_above_1_5_little_occipital']) AS rule, unnest([true, fits, f > 1.5, f > 2, fits AND f > 1.5, fits AND f > 2, fits AND f > 1.5 AND occipital <= 1.5]) AS keep FROM a)
SELECT rule, count(*) FILTER (keep) AS kept, round(count(*) FILTER (keep) / 20.0::DOUBLE, 6) AS per_subject, round(100 * (1 - count(*) FILTER (keep) / count(*)::DOUBLE), 6) AS pct_vetoed FROM r GROUP BY 1""")
def peak_rule_table(spark, d):
    relative = _relative(spark, d)
    rows = qc.topography_veto(_components(spark, d), relative, "vec_id").join(relative.filter("region = 'occipital'").select("vec_id", F.col("relative").alias("w_occipital")), "vec_id")
    return _round(qc.rule_table(rows, qc.peak_rules(F.col("w_occipital")), 20), "per_subject", "pct_vetoed")


_SCORED = "s AS (SELECT vec_id // 12 AS subject_id, vec_id AS component, CASE WHEN label < 2 THEN 'eog' WHEN label < 8 THEN 'muscle' END AS reason, embedding[1]::DOUBLE AS score FROM embeddings WHERE label < 8)"


def _scored(spark, d):
    e = table(spark, d, "embeddings").filter("label < 8")
    return e.select(F.floor(F.col("vec_id") / 12).alias("subject_id"), F.col("vec_id").alias("component"), F.when(F.col("label") < 2, "eog").otherwise("muscle").alias("reason"), F.col("embedding")[0].cast("double").alias("score"))


@query("cap_strongest", f"WITH {_SCORED}, r AS (SELECT *, count(*) FILTER (reason = 'eog') OVER (PARTITION BY subject_id) AS e, count(*) FILTER (reason = 'muscle') OVER (PARTITION BY subject_id) AS m, row_number() OVER (PARTITION BY subject_id, reason ORDER BY abs(score) DESC, component) AS k FROM s) SELECT subject_id, component, reason, m > greatest(0, 5 - e) AS capped FROM r WHERE reason = 'eog' OR k <= greatest(0, 5 - e)")
def cap_strongest(spark, d):
    return qc.cap_strongest(_scored(spark, d), 5, "subject_id").drop("score")


@query("threshold_sweep", "WITH t AS (SELECT threshold, user_id, avg(value) FILTER (value <= threshold) AS v FROM events, (SELECT unnest([60, 70, 80, 90])::DOUBLE AS threshold) GROUP BY 1, 2), m AS (SELECT threshold, median(round(v, 9)) AS median FROM t GROUP BY 1) SELECT threshold, round(median, 6) AS median, round(100 * (median - first_value(median) OVER (ORDER BY threshold)) / first_value(median) OVER (ORDER BY threshold), 6) AS swing_pct FROM m")
def threshold_sweep(spark, d):
    grid = F.explode(F.array(*[F.lit(float(t)) for t in (60, 70, 80, 90)])).alias("threshold")
    rows = table(spark, d, "events").select("user_id", "value", grid)
    v = rows.groupBy("threshold", "user_id").agg(F.round(F.avg(F.when(F.col("value") <= F.col("threshold"), F.col("value"))), 9).alias("v"))
    return _round(qc.sweep(v, "threshold", "v"), "median", "swing_pct")


@query("retention_audit", f"""WITH {_SCORED}, k AS (SELECT subject_id, 'kept_strong' AS rule, avg((abs(score) > 0.1)::INT) AS share FROM s GROUP BY 1 UNION ALL SELECT subject_id, 'kept_eog', avg((reason = 'eog')::INT) FROM s GROUP BY 1), u AS (SELECT subject_id, (subject_id * 29 % 71) / 71.0::DOUBLE AS retained FROM (SELECT DISTINCT subject_id FROM s))
SELECT rule, round(median(1 - (1 - retained) * share), 6) AS median_retention FROM k JOIN u USING (subject_id) GROUP BY 1""")
def retention_audit(spark, d):
    s = _scored(spark, d)
    share = s.groupBy("subject_id").agg(F.avg((F.abs("score") > 0.1).cast("int")).alias("kept_strong"), F.avg((F.col("reason") == "eog").cast("int")).alias("kept_eog"))
    kept = share.unpivot("subject_id", ["kept_strong", "kept_eog"], "rule", "share")
    subjects = s.select("subject_id").distinct().withColumn("retained", (F.col("subject_id") * 29 % 71) / 71.0)
    return _round(qc.estimated_retention(subjects, kept), "median_retention")


@query("component_retention", """WITH e AS (SELECT vec_id // 24 AS subject_id, vec_id, label % 3 = 0 AS kept FROM embeddings WHERE label % 2 = 0), s AS (SELECT DISTINCT vec_id // 24 AS subject_id, 0.4 + (vec_id // 24 % 5) / 10.0::DOUBLE AS retained FROM embeddings)
SELECT e.vec_id, e.subject_id, kept, CASE WHEN e.subject_id % 4 <> 0 THEN round(retained, 6) END AS retained FROM e LEFT JOIN s ON s.subject_id = e.subject_id AND s.subject_id % 4 <> 0""")
def component_retention(spark, d):
    """Excluded components beside their subject's retention, null where a subject was not audited."""
    v = table(spark, d, "embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / 24).cast("long").alias("subject_id"))
    audited = v.filter("subject_id % 4 <> 0").select("subject_id", (0.4 + F.col("subject_id") % 5 / 10.0).alias("retained")).distinct()
    components = v.filter("label % 2 = 0").select("vec_id", "subject_id", (F.col("label") % 3 == 0).alias("kept"))
    return _round(qc.with_subjects(components, audited), "retained")
