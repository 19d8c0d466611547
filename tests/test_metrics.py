import math

import numpy as np
import pytest
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import cohorts, merge, metrics, qc, resample, tables


def solve_threshold_windowed(values: DataFrame, value: str, key: str, target: float) -> DataFrame:
    """The same by evaluating all candidates at once: candidates x subjects cells, for tables of that size."""
    rows = values.select(key, F.col(value).alias("v")).filter("v IS NOT NULL")
    counts = rows.groupBy(key, "v").agg(F.count("*").alias("c"))
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    grid = counts.select(F.col("v").alias("t")).distinct().crossJoin(F.broadcast(n))
    at = grid.select(key, F.col("t").alias("v"), "n").join(counts, [key, "v"], "left")
    upto = F.sum(F.coalesce("c", F.lit(0))).over(Window.partitionBy(key).orderBy("v"))
    cells = at.withColumn("r", 1 - upto / F.col("n"))
    by = cells.groupBy("v").agg(F.percentile("r", 0.5).alias("median_rejection")).filter(F.round("median_rejection", 9) <= target)
    return by.agg(F.min("v").alias("threshold"), F.min_by("median_rejection", "v").alias("median_rejection"))


def test_auc_counts_ties_half_and_is_null_without_a_class(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.9), ("a", 1, 0.8), ("a", 0, 0.1), ("b", 1, 0.5), ("b", 1, float("nan"))], "arm string, truth int, p double")
    found = {r.arm: r.auc for r in metrics.rank_auc(df, F.col("truth") == 1, "p", "arm").collect()}
    assert found["a"] == pytest.approx(0.625)
    assert found["b"] is None
    rng = np.random.default_rng(0)
    t, s = rng.integers(0, 2, 200), rng.integers(0, 20, 200)
    pairs = [(x > y) + 0.5 * (x == y) for x in s[t == 1] for y in s[t == 0]]
    assert resample.auc(t, s) == pytest.approx(np.mean(pairs))


def test_confusion_has_null_where_a_class_is_empty(spark):
    df = spark.createDataFrame([(True, True), (True, False)], "t boolean, y boolean")
    r = metrics.confusion(df, F.col("t"), F.col("y")).first()
    assert (r.tp, r.fn, r.sensitivity, r.specificity) == (1, 1, 0.5, None)


def test_truth_that_arms_disagree_on_raises(spark):
    df = spark.createDataFrame([("a", 1, 1, 0.5), ("b", 1, 0, 0.5)], "arm string, subject_id long, truth int, p double")
    with pytest.raises(Exception, match="disagree"):
        metrics.checked_truth(metrics.arm_pairs(df)).collect()


def test_an_injected_leak_is_found(spark):
    df = spark.createDataFrame([(1, "fold_0"), (1, "test"), (2, "fold_1")], "subject_id long, split string")
    assert [tuple(r) for r in cohorts.leaks(df).collect()] == [(1, "fold_0,test")]
    assert cohorts.leaks(df.filter("subject_id = 2")).count() == 0


def test_small_groups_and_repeats_forbid_a_split(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "subject_id long, group string")
    assert {(r.rule, r.what) for r in cohorts.checked_manifest(df, "subject_id", "group", 2).collect()} == {("repeated subject", "1"), ("group smaller than folds", "b")}


def test_split_is_stratified_and_disjoint(spark):
    df = spark.range(103).select(F.col("id").alias("subject_id"), (F.col("id") % 2).alias("group"))
    s = cohorts.stratified_split(df)
    sizes = {(r.split, r.group): r["count"] for r in s.groupBy("split", "group").count().collect()}
    assert max(v for (k, _), v in sizes.items() if k != "test") - min(v for (k, _), v in sizes.items() if k != "test") <= 1
    assert s.select("subject_id").distinct().count() == 103


def test_null_flags_keep_rows(spark):
    df = spark.createDataFrame([(1, None, 0.5), (2, True, None), (3, False, 0.1)], "id long, capped boolean, rate double")
    kept = qc.policy_table(df, qc.policies(F.col("capped"), F.col("rate") > 0.3)).groupBy("policy").count()
    assert {r.policy: r["count"] for r in kept.collect()} == {"none": 3, "drop_capped": 2, "drop_tail": 2, "drop_either": 1}


def test_exactly_the_warning_rate_is_not_flagged_unless_the_float_exceeds_it(spark):
    df = spark.createDataFrame([(100, 70, False), (100, 69, False), (0, 0, None)], "n_events_ec long, n_kept_ec long, capped boolean")
    flags = [r.flagged for r in qc.quality_notes(df, ["ec"]).collect()]
    assert flags == [1 - 70 / 100 > 0.30, True, False]


def test_solved_threshold_is_minimal(spark):
    rng = np.random.default_rng(1)
    rows = [(s, float(v)) for s in range(9) for v in rng.uniform(0, 100, 200)]
    df = spark.createDataFrame(rows, "subject_id long, p2p double")
    both = [f(df, "p2p", "subject_id", 0.20).first() for f in (qc.solve_threshold, solve_threshold_windowed)]
    values = np.array([[v for k, v in rows if k == s] for s in range(9)])
    best = min(t for t in values.ravel() if np.median((values > t).mean(axis=1)) <= 0.2)
    assert [b.threshold for b in both] == [best, best]
    with pytest.raises(ValueError):
        qc.solve_threshold(df, "p2p", "subject_id", -0.1)


def test_cap_depends_on_flags_only(spark):
    rows = [("s", i, "muscle", 1 - i / 20) for i in range(7)] + [("s", 9, "eog", 0.1), ("t", 1, "muscle", 0.5)]
    kept = qc.cap_strongest(spark.createDataFrame(rows, "subject string, component int, reason string, score double"), 5, "subject").collect()
    assert {r.component for r in kept if r.subject == "s"} == {0, 1, 2, 3, 9}
    assert {r.capped for r in kept if r.subject == "s"} == {True} and {r.capped for r in kept if r.subject == "t"} == {False}


def test_imputation_and_scaling_see_training_rows_only(spark):
    df = spark.createDataFrame([(1, "f", 1.0), (2, "f", 2.0), (3, "f", 3.0), (4, "f", 10.0), (5, "f", None), (6, "g", 7.0)], "id long, feature string, value double")
    got = {r.id: r.value for r in tables.impute_median(df, "id <= 4").collect()}
    assert got[5] == 2.5
    scaled = {r.id: r.value for r in tables.standardize(df.filter("feature = 'g'"), "true", "feature").collect()}
    assert scaled[6] == 0.0


def test_merge_is_idempotent_and_atomic(spark, tmp_path):
    new = spark.createDataFrame([(1, "ok"), (2, "failed")], "subject_id long, status string")
    path = f"file://{tmp_path}/log"
    merge.save(path, new, "subject_id")
    merge.save(path, new.filter("subject_id = 2").withColumn("detail", F.lit("x")), "subject_id")
    again = merge.save(path, new.filter("subject_id = 2").withColumn("detail", F.lit("x")), "subject_id")
    assert [tuple(r) for r in again.orderBy("subject_id").select("subject_id", "status", "detail").collect()] == [(1, "ok", None), (2, "failed", "x")]
    assert [r.subject_id for r in merge.pending(new.select("subject_id"), again, "subject_id").collect()] == [2]


def test_pooled_stats_follow_their_conventions():
    t = np.array([1] * 20 + [0] * 20)
    strong = resample.pooled(t, np.linspace(1, 0, 40), bootstraps=200, permutations=200)
    assert strong["auc"] == 1 and strong["p"] == 0 and strong["ci_low"] == 1
    assert math.isnan(resample.auc(np.ones(3, int), np.arange(3.0)))
    assert resample.binomial_two_sided(5, 10) == 1.0 and resample.binomial_two_sided(0, 10) == pytest.approx(2 / 1024)
    assert resample.decision(0.01, 0.51) and not resample.decision(0.02, 0.51) and not resample.decision(0.01, 0.5)


def test_within_subject_permutation_finds_a_paired_effect(spark):
    rng = np.random.default_rng(0)
    base = rng.uniform(0.2, 0.8, 30)
    rows = [("x", i, 1, float(b + 0.05)) for i, b in enumerate(base)] + [("x", i, 0, float(b)) for i, b in enumerate(base)]
    rows += [("y", i, k, float(v)) for k in (0, 1) for i, v in enumerate(rng.uniform(0.2, 0.8, 30))]
    df = spark.createDataFrame(rows, "arm string, subject long, truth int, p double")
    p = {r.arm: r.p for r in resample.within_subject_permutation(df, "truth", "p", "subject", "arm", draws=300).collect()}
    assert p["x"] < 0.01 and p["y"] > 0.05
    ci = {r.arm: (r.ci_low, r.auc, r.ci_high) for r in resample.cluster_bootstrap(df, "truth", "p", "subject", "arm", draws=200).collect()}
    assert all(low <= a <= high for low, a, high in ci.values())


def test_changepoint(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.uniform(3, 5, 60), rng.uniform(0.8, 1.2, 40)))
    rows = [(0, i, float(v)) for i, v in enumerate(x)] + [(1, i, float(v)) for i, v in enumerate(rng.permutation(x))]
    found = {r.user: r for r in resample.changepoint_permutation(spark.createDataFrame(rows, "user long, i long, v double"), "v", "i", "user", draws=100).collect()}
    assert found[0].fraction == 0.6 and found[0].perm_p < 0.05 and found[1].perm_p > 0.05


def test_medians_are_exact_and_rows_stay_where_they_are(spark):
    rng = np.random.default_rng(6)
    values = {"a": np.round(rng.normal(size=501), 2), "b": np.round(rng.normal(size=400), 6), "c": np.array([2.0, 2.0, 7.0, 9.0]), "d": np.array([5.0])}
    rows = [(k, float(v)) for k, x in values.items() for v in x] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "feature string, value double")
    assert {r.feature: r.median for r in tables.medians(df, "value", "feature").collect()} == pytest.approx({k: float(np.median(x)) for k, x in values.items()})
    filled = tables.impute_median(df, "true")
    assert sorted(r.value for r in filled.filter("feature = 'a'").collect())[250] == np.median(values["a"]) and filled.filter("feature = 'e'").first().value is None
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        for made in (tables.impute_median(df, "true"), tables.standardize(df, "true", "feature")):
            # the outermost join, ahead of those that find the medians
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert plan.index("BroadcastHashJoin") < plan.index("Exchange")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
