"""Resampling queries whose draws are hashed, with DuckDB statements that hash alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohorts, draws, metrics
from .catalogue import query
from .inference import _paired_units
from .predictions import _round
from .standins import ARMS, arms

SEED = 42


def _aucs(rows: str, by: str) -> str:
    """AUC of each draw from rows (by, b, p, wp, wn)."""
    return f"""(SELECT {by}, b, sum(sp * (coalesce(below, 0) + sn / 2.0)) / nullif(sum(sp) * sum(sn), 0)::DOUBLE AS auc FROM (
  SELECT *, sum(sn) OVER (PARTITION BY {by}, b ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM (SELECT {by}, b, p, sum(wp) AS sp, sum(wn) AS sn FROM {rows} GROUP BY {by}, b, p)) GROUP BY {by}, b)"""


def _seen(rows: str, by: str) -> str:
    return f"(SELECT {by}, count(*) AS n, (sum(truth * r) - sum(truth) * (sum(truth) + 1) / 2.0) / nullif(sum(truth) * sum(1 - truth), 0)::DOUBLE AS auc FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY p) + (count(*) OVER (PARTITION BY {by}, p) - 1) / 2.0 AS r FROM {rows}) GROUP BY {by})"


def _bootstrap(rows: str, unit: str, by: str, n: int) -> str:
    return _aucs(f"(SELECT *, w * truth AS wp, w * (1 - truth) AS wn FROM {draws.counts_sql(f'(SELECT * FROM {rows}, range({n}) t(b))', unit, 'b', SEED)} WHERE w > 0)", by)


def _pooled(rows: str, by: str, more: str = "") -> str:
    """Statistics of each key of ``rows`` as common table expressions, the last of them ``pooled``."""
    return f"""boot AS {_bootstrap(rows, "subject_id", by, 10_000)},
labelled AS (SELECT {by}, b, p, (row_number() OVER (PARTITION BY {by}, b ORDER BY key) <= np)::INT AS l FROM {draws.keys_sql(f"(SELECT * FROM {rows} JOIN (SELECT {by}, sum(truth) AS np FROM {rows} GROUP BY {by}) USING ({by}), range(5000) t(b))", "subject_id", "b", SEED)}),
null_ AS {_aucs("(SELECT *, l AS wp, 1 - l AS wn FROM labelled)", by)}, seen AS {_seen(rows, by)},
pooled AS (SELECT {by}, n, round(auc, 6) AS auc, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, p{more} FROM seen
JOIN (SELECT {by}, quantile_cont(auc, 0.025) AS ci_low, quantile_cont(auc, 0.975) AS ci_high FROM boot GROUP BY {by}) USING ({by})
JOIN (SELECT {by}, avg((round(n.auc, 12) >= round(s.auc, 12))::INT) AS p FROM null_ n JOIN seen s USING ({by}) GROUP BY {by}) USING ({by}))"""


_POOLED = f"WITH {ARMS}, {_pooled('arms', 'arm')} SELECT * FROM pooled"


@query("pooled_draws", _POOLED)
def pooled_draws(spark, d):
    return _round(draws.pooled(arms(spark, d), "truth", "p", "subject_id", ["arm"], seed=SEED), "auc", "ci_low", "ci_high")


@query("results_table", f"WITH {ARMS}, common AS (SELECT subject_id FROM arms GROUP BY 1 HAVING count(DISTINCT arm) = (SELECT count(DISTINCT arm) FROM arms)), both_ AS (SELECT *, 'own' AS cohort FROM arms UNION ALL SELECT *, 'common' FROM arms WHERE subject_id IN (SELECT subject_id FROM common)), {_pooled('both_', 'arm, cohort')} SELECT * FROM pooled")
def results_table(spark, d):
    """Pooled statistics of each arm on its own subjects and on those that all arms share."""
    own = arms(spark, d)
    both = own.withColumn("cohort", F.lit("own")).unionByName(own.join(cohorts.common(own), "subject_id", "left_semi").withColumn("cohort", F.lit("common")))
    return _round(draws.pooled(both, "truth", "p", "subject_id", ["arm", "cohort"], seed=SEED), "auc", "ci_low", "ci_high")


@query("hypothesis_decisions", _POOLED.replace("SELECT * FROM pooled", "SELECT *, p < 0.05 / 3 AND ci_low > 0.5 AS positive FROM pooled"))
def hypothesis_decisions(spark, d):
    """An arm is positive if p survives the correction for three tests and the interval lies above one half."""
    return pooled_draws(spark, d).withColumn("positive", (F.col("p") < 0.05 / 3) & (F.col("ci_low") > 0.5))


_PAIRED = f"""WITH {ARMS}, pairs AS (SELECT a.arm AS arm_a, b.arm AS arm_b, a.subject_id, a.truth, a.p AS pa, b.p AS pb FROM arms a JOIN arms b ON a.subject_id = b.subject_id AND a.arm < b.arm),
sides AS (SELECT arm_a, arm_b, 'a' AS side, subject_id, truth, pa AS p FROM pairs UNION ALL SELECT arm_a, arm_b, 'b', subject_id, truth, pb FROM pairs),
boot AS {_bootstrap("sides", "subject_id", "arm_a, arm_b, side", 10_000)}, seen AS {_seen("sides", "arm_a, arm_b, side")},
d AS (SELECT arm_a, arm_b, b, round(max(auc) FILTER (side = 'a') - max(auc) FILTER (side = 'b'), 12) AS d FROM boot GROUP BY ALL),
o AS (SELECT arm_a, arm_b, any_value(n) AS n, max(auc) FILTER (side = 'a') - max(auc) FILTER (side = 'b') AS diff FROM seen GROUP BY ALL)
SELECT arm_a, arm_b, n, round(diff, 6) AS diff, round(quantile_cont(d, 0.025), 6) AS ci_low, round(quantile_cont(d, 0.975), 6) AS ci_high, least(1.0, 2 * least(avg((d <= 0)::INT), avg((d >= 0)::INT))) AS p
FROM d JOIN o USING (arm_a, arm_b) WHERE d IS NOT NULL GROUP BY arm_a, arm_b, n, diff"""


@query("paired_draws", _PAIRED)
def paired_draws(spark, d):
    pairs = metrics.checked_truth(metrics.arm_pairs(arms(spark, d)))
    return _round(draws.paired(pairs, "truth", "p_a", "p_b", "subject_id", ["arm_a", "arm_b"], seed=SEED), "diff", "ci_low", "ci_high")


_UNITS = "units AS (SELECT 'all' AS arm, user_id AS unit, (event_type = 'click')::INT AS truth, round(avg(value), 9) AS p FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id, event_type)"


@query("cluster_draws", f"WITH {_UNITS}, boot AS {_bootstrap('units', 'unit', 'arm', 2_000)}, seen AS {_seen('units', 'arm')} SELECT arm, clusters, round(auc, 6) AS auc, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM seen JOIN (SELECT arm, count(DISTINCT unit) AS clusters FROM units GROUP BY arm) USING (arm) JOIN (SELECT arm, quantile_cont(auc, 0.025) AS ci_low, quantile_cont(auc, 0.975) AS ci_high FROM boot GROUP BY arm) USING (arm)")
def cluster_draws(spark, d):
    """Users are drawn with both of their rows."""
    rows = _paired_units(spark, d)
    seen = metrics.rank_auc(rows, F.col("truth") == 1, "p", "arm").select("arm", "auc")
    clusters = rows.groupBy("arm").agg(F.countDistinct("unit").alias("clusters"))
    ci = draws.interval(draws.bootstrap_aucs(rows, "truth", "p", "unit", ["arm"], 2_000, SEED), "auc", "arm")
    return _round(clusters.join(seen, "arm").join(ci, "arm"), "auc", "ci_low", "ci_high")


@query("within_draws", f"""WITH {_UNITS}, labelled AS (SELECT arm, b, p, (row_number() OVER (PARTITION BY arm, unit, b ORDER BY key) <= np)::INT AS l FROM {draws.keys_sql("(SELECT * FROM units JOIN (SELECT arm, unit, sum(truth) AS np FROM units GROUP BY ALL) USING (arm, unit), range(5000) t(b))", "unit * 2 + truth", "b", SEED)}),
null_ AS {_aucs("(SELECT *, l AS wp, 1 - l AS wn FROM labelled)", "arm")}, seen AS {_seen("units", "arm")}
SELECT arm, round(s.auc, 6) AS auc, (sum((round(n.auc, 12) >= round(s.auc, 12))::INT) + 1) / (count(*) + 1) AS p FROM null_ n JOIN seen s USING (arm) GROUP BY arm, s.auc""")
def within_draws(spark, d):
    rows = _paired_units(spark, d).withColumn("row", F.col("unit") * 2 + F.col("truth"))
    seen = metrics.rank_auc(rows, F.col("truth") == 1, "p", "arm").select("arm", "auc")
    null = draws.within_aucs(rows, "truth", "p", "unit", "row", ["arm"], 5_000, SEED)
    return _round(seen.join(draws.share_at_least(null, seen, ["arm"], plus_one=True), "arm"), "auc")


@query("accuracy_draws", f"""WITH {ARMS}, c AS (SELECT arm, subject_id, ((p >= 0.5) = (truth = 1))::INT AS correct FROM arms),
m AS (SELECT arm, b, sum(w * correct) / sum(w)::DOUBLE AS m FROM {draws.counts_sql("(SELECT * FROM c, range(2000) t(b))", "subject_id", "b", SEED)} GROUP BY arm, b)
SELECT arm, round(accuracy, 6) AS accuracy, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, ci_low > 0.758 AS better FROM (SELECT arm, avg(correct) AS accuracy FROM c GROUP BY arm) JOIN (SELECT arm, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM m GROUP BY arm) USING (arm)""")
def accuracy_draws(spark, d):
    rows = arms(spark, d).withColumn("correct", ((F.col("p") >= 0.5) == (F.col("truth") == 1)).cast("int"))
    return _round(draws.accuracy(rows, "correct", "subject_id", ["arm"], 0.758, seed=SEED), "accuracy", "ci_low", "ci_high")
