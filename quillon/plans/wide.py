"""Queries over feature tables and batch logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge, tables
from .catalogue import query
from .predictions import _round
from .standins import table

NAMES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LONG = "f AS (SELECT l_orderkey AS id, l_linenumber AS part, l_returnflag AS grp, unnest(['quantity', 'price', 'discount', 'tax']) AS feature, unnest([CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_quantity END, l_extendedprice, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END, l_tax]) AS value FROM lineitem)"


def _long(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("part"),
        F.col("l_returnflag").alias("grp"),
        F.when(F.col("l_orderkey") % 13 != 0, F.col("l_quantity")).alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("discount"),
        F.col("l_tax").alias("tax"),
    )
    return tables.long(rows, ["id", "part", "grp"], ["quantity", "price", "discount", "tax"])


@query("wide_to_long", f"WITH {_LONG} SELECT id, part, feature, value FROM f")
def wide_to_long(spark, d):
    return _long(spark, d).drop("grp")


@query("long_to_wide", "SELECT user_id, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'view'), 6) AS view_, round(avg(value) FILTER (event_type = 'purchase'), 6) AS purchase FROM events GROUP BY 1")
def long_to_wide(spark, d):
    m = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("value"))
    return _round(tables.wide(m, ["user_id"], "event_type", "value", ["click", "view", "purchase"]).withColumnRenamed("view", "view_"), "click", "view_", "purchase")


@query("shared_features", f"WITH {_LONG} SELECT feature FROM f WHERE value IS NOT NULL GROUP BY 1 HAVING count(DISTINCT part) >= 7")
def shared_features(spark, d):
    return tables.shared_features(_long(spark, d), "feature", "part", 7)


@query("non_null_features", f"WITH {_LONG} SELECT feature, count(value) AS n FROM f GROUP BY 1 HAVING count(value) > 0")
def non_null_features(spark, d):
    return tables.non_null_features(_long(spark, d))


@query("impute_median", f"WITH {_LONG}, m AS (SELECT feature, median(value) AS m FROM f WHERE id % 5 <> 0 GROUP BY 1) SELECT id, part, feature, round(coalesce(value, m), 6) AS value FROM f LEFT JOIN m USING (feature)")
def impute_median(spark, d):
    return _round(tables.impute_median(_long(spark, d), "id % 5 <> 0").select("id", "part", "feature", "value"), "value")


@query("standardize", f"WITH {_LONG}, m AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM f WHERE id % 5 <> 0 GROUP BY 1) SELECT id, part, feature, round((value - m) / s, 6) AS value FROM f JOIN m USING (feature)")
def standardize(spark, d):
    return _round(tables.standardize(_long(spark, d), "id % 5 <> 0", "feature").select("id", "part", "feature", "value"), "value")


@query("standardize_within_dataset", f"WITH {_LONG}, m AS (SELECT grp, feature, avg(value) AS m, stddev_pop(value) AS s FROM f GROUP BY 1, 2) SELECT id, part, feature, round((value - m) / s, 6) AS value FROM f JOIN m USING (grp, feature)")
def standardize_within_dataset(spark, d):
    return _round(tables.standardize(_long(spark, d), "true", "grp", "feature").select("id", "part", "feature", "value"), "value")


@query("anova_f_topk", f"WITH {_LONG}, c AS (SELECT feature, grp, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM f WHERE value IS NOT NULL GROUP BY 1, 2), t AS (SELECT feature, sum(n) AS nn, sum(n * m) / sum(n) AS g, count(*) AS k, sum(n * v) AS w FROM c GROUP BY 1) SELECT feature, round(sum(n * (m - g) ** 2) / (any_value(k) - 1) / (any_value(w) / (any_value(nn) - any_value(k))), 6) AS f FROM c JOIN t USING (feature) GROUP BY 1 ORDER BY f DESC, feature LIMIT 2")
def anova_f_topk(spark, d):
    return _round(tables.top_features(tables.anova_f(_long(spark, d), "grp"), 2), "f")


@query("top_feature_differences", f"WITH {_LONG}, g AS (SELECT feature, avg(value) FILTER (grp = 'A') AS a, avg(value) FILTER (grp = 'R') AS r FROM f GROUP BY 1) SELECT feature, round(a - r, 6) AS mean_difference FROM g")
def top_feature_differences(spark, d):
    of = lambda g: F.avg(F.when(F.col("grp") == g, F.col("value")))
    return _long(spark, d).groupBy("feature").agg(F.round(of("A") - of("R"), 6).alias("mean_difference"))


@query("corr_matrix", "SELECT * FROM (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(l_extendedprice, l_tax), 6) FROM lineitem UNION ALL SELECT 'l_discount', 'l_tax', round(corr(l_discount, l_tax), 6) FROM lineitem)")
def corr_matrix(spark, d):
    return _round(tables.correlations(table(spark, d, "lineitem").select(*NAMES), NAMES), "r")


@query("robust_scale", "WITH r AS (SELECT user_id, abs(value) AS scale, row_number() OVER (PARTITION BY user_id ORDER BY abs(value)) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, scale FROM r WHERE i = floor(n * 0.95::DOUBLE)")
def robust_scale(spark, d):
    return tables.robust_scale(table(spark, d, "events"), "value", "user_id")


_OLD = "old AS (SELECT o_orderkey AS id, 'ok' AS status, o_totalprice AS detail FROM orders WHERE o_orderkey % 3 = 0), new AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'ok' END AS status, o_orderpriority AS note FROM orders WHERE o_orderkey % 2 = 0)"


def _logs(spark, d):
    o = table(spark, d, "orders")
    old = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit("ok").alias("status"), F.col("o_totalprice").alias("detail"))
    new = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 == 0, "failed").otherwise("ok").alias("status"), F.col("o_orderpriority").alias("note"))
    return old, new


@query("keyed_merge", f"WITH {_OLD} SELECT id, status, detail, NULL AS note FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT id, status, NULL, note FROM new")
def keyed_merge(spark, d):
    return merge.keyed_merge(*_logs(spark, d), "id")


@query("resume_pending", f"WITH {_OLD} SELECT id FROM (SELECT o_orderkey AS id FROM orders) WHERE id NOT IN (SELECT id FROM new WHERE status = 'ok')")
def resume_pending(spark, d):
    _, new = _logs(spark, d)
    return merge.pending(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), new, "id")


@query("recovery_merge", f"WITH {_OLD} SELECT coalesce(o.id, n.id) AS id, coalesce(o.status, n.status) AS status FROM new n FULL JOIN old o ON n.id = o.id")
def recovery_merge(spark, d):
    old, new = _logs(spark, d)
    return merge.recover(new.select("id", "status"), old, "id")


@query("replace_key", f"WITH {_OLD} SELECT id, status FROM old WHERE id <> 12 UNION ALL SELECT 12, 'replaced'")
def replace_key(spark, d):
    old, _ = _logs(spark, d)
    return merge.replace_key(old.select("id", "status"), spark.sql("SELECT 12L AS id, 'replaced' AS status"), "id", 12)


@query("run_summary", f"WITH {_OLD} SELECT status, count(*) AS n FROM new GROUP BY 1")
def run_summary(spark, d):
    return merge.run_status(_logs(spark, d)[1])


@query("features_by_condition", """WITH m AS (SELECT user_id, round(avg(value) FILTER (event_type = 'click'), 6) AS mean_c, round(avg(value) FILTER (event_type = 'view'), 6) AS mean_v, max(value) FILTER (event_type = 'click' AND value > 95) AS top_c, max(value) FILTER (event_type = 'view' AND value > 95) AS top_v FROM events WHERE user_id % 3 <> 0 OR event_type <> 'view' GROUP BY 1)
SELECT user_id, 'click' AS condition, mean_c AS mean, top_c AS top FROM m WHERE mean_c IS NOT NULL OR top_c IS NOT NULL UNION ALL SELECT user_id, 'view', mean_v, top_v FROM m WHERE mean_v IS NOT NULL OR top_v IS NOT NULL""")
def features_by_condition(spark, d):
    """Columns that end in a condition, one row a condition; one column lacks a partner, and some users a condition."""
    e = table(spark, d, "events").filter("user_id % 3 <> 0 OR event_type <> 'view'")
    of = lambda k, more=F.lit(True): F.when((F.col("event_type") == k) & more, F.col("value"))
    high = F.col("value") > 95
    rows = e.groupBy("user_id").agg(*[F.round(F.avg(of(k)), 6).alias(f"mean_{k}") for k in ("click", "view")], *[F.max(of(k, high)).alias(f"top_{k}") for k in ("click", "view")], F.min("value").alias("least_click"))
    return tables.by_condition(rows, ["user_id"], {"_click": "click", "_view": "view"})
