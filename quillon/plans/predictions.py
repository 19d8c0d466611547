"""Queries over predictions: roll-ups, metrics, cohorts, arms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohorts, metrics
from .catalogue import query
from .standins import ARMS, EPOCHS, arms, epochs, table

_AUC = """ranked AS (SELECT *, rank() OVER (PARTITION BY {key} ORDER BY p) + (count(*) OVER (PARTITION BY {key}, p) - 1) / 2.0 AS r FROM {rows})
SELECT {key}, CAST(sum(truth) AS BIGINT) AS n_pos, CAST(sum(1 - truth) AS BIGINT) AS n_neg,
  CASE WHEN sum(truth) > 0 AND sum(1 - truth) > 0 THEN (sum(truth * r) - sum(truth) * (sum(truth) + 1) / 2.0) / (sum(truth) * sum(1 - truth))::DOUBLE END AS auc
FROM ranked GROUP BY {key}"""
_CELLS = """count(*) FILTER (t AND y) AS tp, count(*) FILTER (NOT t AND y) AS fp, count(*) FILTER (NOT t AND NOT y) AS tn, count(*) FILTER (t AND NOT y) AS fn,
  count(*) FILTER (t = y) / count(*)::DOUBLE AS accuracy, count(*) FILTER (t AND y) / nullif(count(*) FILTER (t), 0)::DOUBLE AS sensitivity, count(*) FILTER (NOT t AND NOT y) / nullif(count(*) FILTER (NOT t), 0)::DOUBLE AS specificity"""


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("subject_mean_prob", f"WITH {EPOCHS} SELECT subject_id, true_label, round(avg(prob), 9) AS mean_prob, count(*) AS n_epochs, CASE WHEN round(avg(prob), 9) >= 0.5 THEN 'ADHD' ELSE 'Control' END AS pred_label FROM epochs GROUP BY 1, 2")
def subject_mean_prob(spark, d):
    mean = metrics.subject_mean(epochs(spark, d)).withColumn("mean_prob", F.round("mean_prob", 9))
    return mean.withColumn("pred_label", F.when(F.col("mean_prob") >= 0.5, "ADHD").otherwise("Control"))


@query("confusion_metrics", f"WITH {EPOCHS}, s AS (SELECT subject_id, true_label = 'ADHD' AS t, round(avg(prob), 9) >= 0.5 AS y FROM epochs GROUP BY subject_id, true_label) SELECT {_CELLS} FROM s")
def confusion_metrics(spark, d):
    s = metrics.subject_mean(epochs(spark, d))
    return metrics.confusion(s, F.col("true_label") == "ADHD", F.round("mean_prob", 9) >= 0.5)


@query("confusion_by_arm", f"WITH {ARMS}, s AS (SELECT arm, truth = 1 AS t, p >= 0.5 AS y FROM arms) SELECT arm, {_CELLS} FROM s GROUP BY arm")
def confusion_by_arm(spark, d):
    return metrics.confusion(arms(spark, d), F.col("truth") == 1, F.col("p") >= 0.5, "arm")


@query("rank_auc", f"WITH {EPOCHS}, s AS (SELECT 'all' AS cohort, CASE WHEN true_label = 'ADHD' THEN 1 ELSE 0 END AS truth, round(avg(prob), 9) AS p FROM epochs GROUP BY subject_id, true_label), " + _AUC.format(key="cohort", rows="s").replace("AS auc", "AS auc").replace("(sum(truth * r)", "round((sum(truth * r)").replace("::DOUBLE END", "::DOUBLE, 9) END"))
def rank_auc(spark, d):
    s = metrics.subject_mean(epochs(spark, d)).select(F.lit("all").alias("cohort"), "true_label", F.round("mean_prob", 9).alias("p"))
    return _round(metrics.rank_auc(s, F.col("true_label") == "ADHD", "p", "cohort"), "auc", digits=9)


@query("auc_by_arm", f"WITH {ARMS}, " + _AUC.format(key="arm", rows="arms"))
def auc_by_arm(spark, d):
    return metrics.rank_auc(arms(spark, d), F.col("truth") == 1, "p", "arm")


@query("common_cohort", f"WITH {ARMS} SELECT subject_id FROM arms GROUP BY subject_id HAVING count(DISTINCT arm) = 3")
def common_cohort(spark, d):
    return cohorts.common(arms(spark, d))


@query("auc_common_cohort", f"WITH {ARMS}, c AS (SELECT subject_id FROM arms GROUP BY subject_id HAVING count(DISTINCT arm) = 3), i AS (SELECT * FROM arms SEMI JOIN c USING (subject_id)), " + _AUC.format(key="arm", rows="i"))
def auc_common_cohort(spark, d):
    rows = arms(spark, d)
    return metrics.rank_auc(rows.join(cohorts.common(rows), "subject_id", "left_semi"), F.col("truth") == 1, "p", "arm")


@query("cohort_missing", f"WITH {ARMS} SELECT a.arm, s.subject_id FROM (SELECT DISTINCT arm FROM arms) a, (SELECT DISTINCT subject_id FROM arms) s EXCEPT SELECT arm, subject_id FROM arms")
def cohort_missing(spark, d):
    return cohorts.missing(arms(spark, d))


@query("symmetric_diff", f"WITH {ARMS} (SELECT subject_id, 'left' AS side FROM arms WHERE arm = 'hash' AND subject_id NOT IN (SELECT subject_id FROM arms WHERE arm = 'mixed')) UNION ALL (SELECT subject_id, 'right' FROM arms WHERE arm = 'mixed' AND subject_id NOT IN (SELECT subject_id FROM arms WHERE arm = 'hash'))")
def symmetric_diff(spark, d):
    rows = arms(spark, d)
    return cohorts.symmetric_difference(rows.filter("arm = 'hash'"), rows.filter("arm = 'mixed'"), "subject_id")


_PAIRS = "pairs AS (SELECT a.arm AS arm_a, b.arm AS arm_b, a.subject_id, a.truth, (a.p >= 0.5) = (a.truth = 1) AS ok_a, (b.p >= 0.5) = (b.truth = 1) AS ok_b, a.p >= 0.5 AS y_a, b.p >= 0.5 AS y_b FROM arms a JOIN arms b ON a.subject_id = b.subject_id AND a.arm < b.arm)"


def _pairs(spark, d):
    pairs = metrics.checked_truth(metrics.arm_pairs(arms(spark, d)))
    truth = F.col("truth") == 1
    return pairs.withColumns({"y_a": F.col("p_a") >= 0.5, "y_b": F.col("p_b") >= 0.5}).withColumns({"ok_a": F.col("y_a") == truth, "ok_b": F.col("y_b") == truth})


@query("arm_pairs_kappa", f"""WITH {ARMS}, {_PAIRS}, s AS (SELECT arm_a, arm_b, count(*) AS n, avg((y_a = y_b)::INT) AS o, avg(y_a::INT) AS a, avg(y_b::INT) AS b FROM pairs GROUP BY 1, 2)
SELECT arm_a, arm_b, n, round(o, 9) AS agreement, round((o - (a * b + (1 - a) * (1 - b))) / nullif(1 - (a * b + (1 - a) * (1 - b)), 0), 9) AS kappa FROM s""")
def arm_pairs_kappa(spark, d):
    k = _pairs(spark, d).groupBy("arm_a", "arm_b").agg(*metrics.kappa(F.col("y_a"), F.col("y_b")))
    return _round(k.drop("only_a", "only_b"), "agreement", "kappa", digits=9)


@query("mcnemar_counts", f"WITH {ARMS}, {_PAIRS} SELECT arm_a, arm_b, count(*) FILTER (ok_a AND NOT ok_b) AS only_a, count(*) FILTER (ok_b AND NOT ok_a) AS only_b FROM pairs GROUP BY 1, 2")
def mcnemar_counts(spark, d):
    return _pairs(spark, d).groupBy("arm_a", "arm_b").agg(*metrics.kappa(F.col("ok_a"), F.col("ok_b"))).select("arm_a", "arm_b", "only_a", "only_b")


@query("paired_win_rate", "WITH m AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b FROM events GROUP BY user_id) SELECT count(*) AS n, CAST(sum((round(a, 9) > round(b, 9))::INT) AS BIGINT) AS wins, avg((round(a, 9) > round(b, 9))::INT) AS win_rate FROM m WHERE a IS NOT NULL AND b IS NOT NULL")
def paired_win_rate(spark, d):
    means = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.avg("value")).filter("click IS NOT NULL AND view IS NOT NULL")
    win = (F.round("click", 9) > F.round("view", 9)).cast("int")
    return means.agg(F.count("*").alias("n"), F.coalesce(F.sum(win), F.lit(None)).alias("wins"), F.avg(win).alias("win_rate"))


@query("cohens_d", f"""WITH {ARMS}, s AS (SELECT arm, count(*) FILTER (truth = 1) AS n_a, count(*) FILTER (truth = 0) AS n_b, avg(p) FILTER (truth = 1) AS m1, avg(p) FILTER (truth = 0) AS m0, var_samp(p) FILTER (truth = 1) AS v1, var_samp(p) FILTER (truth = 0) AS v0 FROM arms GROUP BY arm)
SELECT arm, n_a, n_b, round((m1 - m0) / nullif(sqrt(((n_a - 1) * v1 + (n_b - 1) * v0) / nullif(n_a + n_b - 2, 0)), 0), 6) AS d FROM s""")
def cohens_d(spark, d):
    return _round(metrics.cohens_d(arms(spark, d), F.col("truth") == 1, "p", "arm"), "d")


@query("describe_by_group", f"WITH {ARMS} SELECT arm, count(p) AS n, round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS sd, min(p) AS least, round(quantile_cont(p, 0.25), 6) AS q25, round(quantile_cont(p, 0.5), 6) AS median, round(quantile_cont(p, 0.75), 6) AS q75, max(p) AS most FROM arms GROUP BY arm")
def describe_by_group(spark, d):
    return _round(metrics.describe(arms(spark, d), "p", "arm"), "mean", "sd", "q25", "median", "q75")


@query("prob_histogram", f"WITH {ARMS} SELECT arm, CAST(least(floor(p * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM arms GROUP BY 1, 2")
def prob_histogram(spark, d):
    return metrics.histogram(arms(spark, d), "p", 20, "arm")


@query("reference_placement", f"WITH {ARMS}, h AS (SELECT subject_id, truth, p FROM arms WHERE arm = 'hash') SELECT a.subject_id, b.truth AS reference_group, count(*) FILTER (b.p >= a.p AND b.subject_id <> a.subject_id) AS n_at_least FROM h a, h b GROUP BY 1, 2")
def reference_placement(spark, d):
    return metrics.placement(arms(spark, d).filter("arm = 'hash'"), "truth", "subject_id", "p")


@query("value_counts", "SELECT c_mktsegment, count(*) AS n, count(DISTINCT c_nationkey) AS n_nations FROM customer GROUP BY 1")
def value_counts(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("n_nations"))


@query("subject_then_cohort_median", f"WITH {EPOCHS}, m AS (SELECT subject_id, true_label, round(avg(prob), 9) AS p FROM epochs GROUP BY 1, 2) SELECT true_label, round(median(p), 6) AS median_prob FROM m GROUP BY 1")
def subject_then_cohort_median(spark, d):
    m = metrics.subject_mean(epochs(spark, d)).withColumn("p", F.round("mean_prob", 9))
    return m.groupBy("true_label").agg(F.round(F.percentile("p", 0.5), 6).alias("median_prob"))


@query("top_subjects", f"WITH {EPOCHS} SELECT subject_id, round(round(avg(prob), 9), 6) AS p FROM epochs GROUP BY 1 ORDER BY round(avg(prob), 9) DESC, subject_id LIMIT 10")
def top_subjects(spark, d):
    m = epochs(spark, d).groupBy("subject_id").agg(F.round(F.avg("prob"), 9).alias("q"))
    return m.orderBy(F.desc("q"), "subject_id").limit(10).select("subject_id", F.round("q", 6).alias("p"))


# --- splits -----------------------------------------------------------------------------------

_SUBJECTS = "subjects AS (SELECT c_custkey AS subject_id, c_mktsegment AS \"group\" FROM customer)"
_SPLIT = _SUBJECTS + """, r AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY md5(subject_id::VARCHAR || ':42'), subject_id) - 1 AS i, count(*) OVER (PARTITION BY "group") AS n FROM subjects),
splits AS (SELECT subject_id, "group", CASE WHEN i < ceil(n * 0.15) THEN 'test' ELSE 'fold_' || ((i - ceil(n * 0.15)::BIGINT) % 5)::VARCHAR END AS split FROM r)"""


def _subjects(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("group"))


@query("stratified_folds", f"WITH {_SPLIT} SELECT * FROM splits")
def stratified_folds(spark, d):
    return cohorts.stratified_split(_subjects(spark, d))


@query("split_summary", f"""WITH {_SPLIT} SELECT split, "group", count(*) AS n FROM splits GROUP BY 1, 2 ORDER BY split <> 'test', split, "group" """)
def split_summary(spark, d):
    s = cohorts.stratified_split(_subjects(spark, d)).groupBy("split", "group").agg(F.count("*").alias("n"))
    return s.orderBy(F.col("split") != "test", "split", "group")


@query("fold_roles", f"""WITH {_SPLIT}, o AS (SELECT 'fold_' || k AS outer_fold, 'fold_' || (k + 1) % 5 AS nxt FROM range(5) t(k))
SELECT outer_fold, split, CASE WHEN split = outer_fold THEN 'score' WHEN split = nxt THEN 'inner' ELSE 'train' END AS role FROM (SELECT DISTINCT split FROM splits WHERE split <> 'test'), o""")
def fold_roles(spark, d):
    return cohorts.fold_roles(cohorts.stratified_split(_subjects(spark, d)))


@query("leakage_violations", f"WITH {_SPLIT}, m AS (SELECT subject_id, split FROM splits UNION ALL SELECT subject_id, 'test' FROM splits WHERE subject_id % 97 = 0) SELECT subject_id, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM m GROUP BY 1 HAVING count(DISTINCT split) > 1")
def leakage_violations(spark, d):
    """Finds the leak that is put in: some subjects are also in the test set."""
    s = cohorts.stratified_split(_subjects(spark, d)).select("subject_id", "split")
    return cohorts.leaks(s.unionByName(s.filter("subject_id % 97 = 0").withColumn("split", F.lit("test"))))


@query("stratified_head", "SELECT subject_id, \"group\", rank_in_group FROM (SELECT c_custkey AS subject_id, c_mktsegment AS \"group\", row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank_in_group FROM customer) WHERE rank_in_group <= 4")
def stratified_head(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("group"), "c_acctbal")
    return cohorts.head_by_group(c, "group", 4, F.desc("c_acctbal"), "subject_id").withColumn("rank_in_group", F.col("rank_in_group").cast("long")).drop("c_acctbal")


@query("paired_units", "WITH u AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('click', 'purchase')) SELECT user_id || CASE event_type WHEN 'click' THEN '-TASK' ELSE '-REST' END AS unit FROM u WHERE user_id IN (SELECT user_id FROM u GROUP BY 1 HAVING count(*) = 2)")
def paired_units(spark, d):
    u = cohorts.two_sided(table(spark, d, "events").select("user_id", "event_type").distinct(), "user_id", "event_type", ["click", "purchase"])
    return u.select(F.concat(F.col("user_id").cast("string"), F.when(F.col("event_type") == "click", "-TASK").otherwise("-REST")).alias("unit"))


@query("predict_answers", f"""WITH {EPOCHS}, e AS (SELECT subject_id, CASE part % 3 WHEN 0 THEN 'EC' WHEN 1 THEN 'EO' ELSE 'VCPT' END AS condition, prob, row_number() OVER (PARTITION BY subject_id, CASE part % 3 WHEN 0 THEN 'EC' WHEN 1 THEN 'EO' ELSE 'VCPT' END ORDER BY epoch, part, prob) - 1 AS pos FROM epochs),
n AS (SELECT subject_id, condition, count(*) AS n FROM e GROUP BY ALL),
p AS (SELECT DISTINCT subject_id, condition, unnest(CASE WHEN n <= 4 THEN list_transform(range(n), lambda j: j::DOUBLE) ELSE list_transform(range(4), lambda j: floor(j * ((n - 1) / 3.0::DOUBLE))) END)::BIGINT AS pos FROM n WHERE condition <> 'VCPT'),
m AS (SELECT subject_id, avg(prob) AS p, count(*) AS n, count(DISTINCT condition) = 2 AS ok, bool_or(condition = 'EC') AS ec, bool_or(condition = 'EO') AS eo FROM e JOIN p USING (subject_id, condition, pos) GROUP BY 1)
SELECT subject_id, CASE WHEN ok THEN 'ok' ELSE 'failed' END AS status, CASE WHEN NOT coalesce(ok, false) THEN 'no epochs of ' || array_to_string(list_filter([CASE WHEN NOT coalesce(ec, false) THEN 'EC' END, CASE WHEN NOT coalesce(eo, false) THEN 'EO' END], lambda x: x IS NOT NULL), ', ') END AS detail,
 CASE WHEN ok THEN CASE WHEN round(p, 9) >= 0.5 THEN 'ADHD' ELSE 'Control' END END AS prediction, CASE WHEN ok THEN round(greatest(p, 1 - p), 6) END AS confidence, CASE WHEN ok THEN round(p, 6) END AS p_adhd, CASE WHEN ok THEN m.n END AS n_epochs
FROM (SELECT DISTINCT subject_id FROM epochs) LEFT JOIN m USING (subject_id)""")
def predict_answers(spark, d):
    """Answers from four epochs of each condition at most."""
    from ..operators import answers

    part = F.col("part") % 3
    e = epochs(spark, d).withColumn("condition", F.when(part == 0, "EC").when(part == 1, "EO").otherwise("VCPT"))
    found = answers.predict(e, most=4, order=("epoch", "part", "prob"))
    label = F.when(F.col("p_adhd").isNotNull(), F.when(F.round("p_adhd", 9) >= 0.5, "ADHD").otherwise("Control"))
    return _round(found.withColumn("prediction", label), "confidence", "p_adhd")
