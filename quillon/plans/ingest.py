"""Queries over sources, sinks and scalar parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recordings
from ..sources import readers, sinks
from .catalogue import query
from .standins import table


@query("parse_file_names", """WITH n AS (SELECT '/data/' || CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'm' END || c_custkey || '-20240101_' || lpad(c_nationkey::VARCHAR, 6, '0') || CASE WHEN c_custkey % 3 = 0 THEN '.vcpt.EDF' ELSE '-EOEC.edf' END AS path FROM customer)
SELECT upper(regexp_extract(path, '([A-Za-z0-9]+)[._-]([0-9]+)[._-]([0-9]+)[._-]([A-Za-z0-9]+)\\.(edf|EDF)$', 1)) AS subject_id, CASE WHEN upper(regexp_extract(path, '/([^/]*)$', 1)) LIKE 'F%' THEN 'ADHD' ELSE 'Control' END AS "group", '20240101' AS date, regexp_extract(path, '_([0-9]+)[.-]', 1) AS time, upper(regexp_extract(path, '[.-]([A-Za-z]+)\\.(edf|EDF)$', 1)) AS task FROM n""")
def parse_file_names(spark, d):
    c, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    path = F.concat(F.lit("/data/"), F.when(c % 2 == 0, "F").otherwise("m"), c.cast("string"), F.lit("-20240101_"), F.lpad(n, 6, "0"), F.when(c % 3 == 0, ".vcpt.EDF").otherwise("-EOEC.edf"))
    return table(spark, d, "customer").select(readers.parse_name(path).alias("p")).select("p.*")


@query("image_counts", "SELECT o_custkey::VARCHAR AS subject_id, o_orderstatus AS condition, count(*) AS n FROM orders GROUP BY 1, 2")
def image_counts(spark, d):
    path = F.concat(F.lit("/img/train/ADHD/"), F.col("o_custkey").cast("string"), F.lit("_"), "o_orderstatus", F.lit("_"), F.lpad(F.col("o_orderkey").cast("string"), 4, "0"), F.lit(".png"))
    return readers.image_counts(table(spark, d, "orders").select(path.alias("path")))


@query("trusted_boundaries", "SELECT c_custkey::VARCHAR AS subject_id, c_acctbal AS boundary_frac FROM customer WHERE c_custkey % 4 < 2 AND c_custkey % 5 <> 0")
def trusted_boundaries(spark, d):
    c = F.col("c_custkey")
    text = F.when(c % 4 == 0, " True").when(c % 4 == 1, "1").when(c % 4 == 2, "false").otherwise("")
    rows = table(spark, d, "customer").select(c.cast("string").alias("subject_id"), F.when(c % 5 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("boundary_frac"), text.alias("trusted"))
    return readers.trusted(rows)


@query("first_per_subject", "SELECT o_custkey AS subject_id, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_per_subject(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("subject_id"), "o_orderdate", "o_orderkey")
    return readers.first_per_subject(o, "o_orderdate", "o_orderkey").drop("o_orderdate")


@query("resolve_paths", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '/abs/' || c_name WHEN 1 THEN '/root/data/' || c_name END AS path FROM customer")
def resolve_paths(spark, d):
    c = F.col("c_custkey")
    given = F.when(c % 3 == 0, F.concat(F.lit("/abs/"), "c_name")).when(c % 3 == 1, F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", readers.absolute(given, "/root/data").alias("path"))


@query("json_rows", """SELECT '{"s_suppkey":' || s_suppkey || ',"score":' || CASE WHEN s_suppkey % 4 = 0 THEN 'null' ELSE (s_suppkey % 8)::VARCHAR || '.5' END || '}' AS json FROM supplier""")
def json_rows(spark, d):
    s = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select("s_suppkey", F.when(s % 4 == 0, F.lit(float("nan"))).otherwise((s % 8) + F.lit(0.5)).alias("score"))
    return sinks.to_json(rows)


@query("fold_view", """WITH r AS (SELECT c_custkey AS subject_id, c_mktsegment AS g, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey::VARCHAR || ':42'), c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
s AS (SELECT subject_id, CASE WHEN i < ceil(n * 0.15) THEN 'test' ELSE 'fold_' || ((i - ceil(n * 0.15)::BIGINT) % 5)::VARCHAR END AS split FROM r)
SELECT o_orderkey, split, CASE WHEN split = 'fold_1' THEN 'val' ELSE 'train' END AS role FROM orders JOIN s ON o_custkey = subject_id WHERE split <> 'test'""")
def fold_view(spark, d):
    from ..operators.cohorts import stratified_split

    subjects = table(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("group"))
    images = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("subject_id"))
    return sinks.fold_view(images, stratified_split(subjects), "fold_1").select("o_orderkey", "split", "role")


@query("reference_rows", """SELECT c_custkey AS subject_id, c_mktsegment AS "group", c_acctbal AS p_adhd, c_nationkey AS n_epochs FROM customer WHERE c_custkey % 3 <> 0""")
def reference_rows(spark, d):
    c = F.col("c_custkey")
    rows = table(spark, d, "customer").select(c.alias("subject_id"), F.col("c_mktsegment").alias("group"), F.col("c_acctbal").alias("p_adhd"), F.col("c_nationkey").alias("n_epochs"), F.when(c % 3 != 0, "ok").otherwise("failed").alias("status"))
    return sinks.reference(rows)


@query("live_rejection", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(avg((value > 60)::INT), 6) AS rate FROM events GROUP BY 1, 2")
def live_rejection(spark, d):
    """The streaming aggregation on a whole table."""
    from ..streaming import live

    r = live.rejection_rates(table(spark, d, "events"), 60)
    return r.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("rate", 6).alias("rate"))


@query("setting_faults", """WITH n AS (SELECT n_nationkey AS k, 'run_' || n_nationkey AS path FROM nation), f AS (
 SELECT path, 'fliplr' AS key, '0.0' AS wanted, '0.5' AS got, 'wrong' AS fault FROM n WHERE k % 4 = 1 UNION ALL SELECT path, 'mosaic', '0', NULL, 'absent' FROM n WHERE k % 5 = 2 UNION ALL SELECT path, 'auto_augment', 'none', 'randaugment', 'wrong' FROM n WHERE k % 3 = 0)
SELECT * FROM f""")
def setting_faults(spark, d):
    """Runs whose settings differ from what was asked, from their lines."""
    k = F.col("n_nationkey")
    lines = F.array(F.lit("task: classify"), F.when(k % 4 == 1, "fliplr: 0.5").otherwise("fliplr: 0  # off"), F.when(k % 5 != 2, "mosaic: 0.0"), F.when(k % 3 == 0, "auto_augment: 'randaugment'").otherwise('auto_augment: "None"'), F.lit("  nested: 1"))
    rows = table(spark, d, "nation").select(F.concat(F.lit("run_"), k.cast("string")).alias("path"), F.posexplode(F.array_compact(lines)).alias("n", "line"))
    return readers.setting_faults(readers.settings(rows), {"fliplr": "0.0", "mosaic": "0", "auto_augment": "none"})


@query("event_sessions", """WITH g AS (SELECT user_id, ts, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE, true) AS fresh FROM events),
r AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM r GROUP BY user_id, i""")
def event_sessions(spark, d):
    """The streaming sessions on a whole table."""
    from ..streaming import live

    s = live.sessions(table(spark, d, "events").select("user_id", "ts"))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("stream_log", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_log(spark, d):
    """Running means of events that land as four batches, kept in a log with a ledger of batches; a replay changes nothing."""
    from ..shared import fresh
    from ..streaming import ledger, live

    landed = fresh(spark, "landed")
    events = table(spark, d, "events").select("user_id", "value")
    files = max(1, spark.sparkContext.defaultParallelism // 4)  # of a batch
    events.repartition(4 * files).write.parquet(landed)
    log, name = fresh(spark, "log"), "user_id"
    for checkpoint in (fresh(spark, "checkpoint"), fresh(spark, "checkpoint")):  # the second run sends every batch again
        means = live.running_means(live.landing(spark, landed, events.schema, files))
        ledger.start(means, log, name, checkpoint).awaitTermination()
    return ledger.latest(spark, log, name).select(name, "n", F.round(F.col("mean") * F.col("n"), 4).alias("total"))


@query("build_log", """WITH c AS (SELECT c_custkey AS k, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'ADHD' ELSE 'Control' END AS "group" FROM customer),
w AS (SELECT 'C' || k AS subject_id, k, "group", k % 4 <> 0 AS task FROM c UNION ALL SELECT 'N' || n_nationkey, NULL, NULL, NULL FROM nation),
f AS (SELECT *, (k % 30) / 10.0::DOUBLE + 0.1 AS ratio, CASE WHEN k IS NULL THEN 'not found in manifest' WHEN k % 17 = 0 THEN 'preprocessing failed: no recording' WHEN k % 13 = 0 THEN 'preprocessing failed: broken' WHEN task AND k % 23 = 0 THEN 'preprocessing failed: no task recording' WHEN task AND k % 19 = 0 THEN 'preprocessing failed: ' END AS fault FROM w),
g AS (SELECT *, fault IS NULL AS good, ratio > 0.7 AND ratio < 1.4 AS vague FROM f)
SELECT subject_id, coalesce("group", '?') AS "group", CASE WHEN k IS NULL THEN '?' ELSE 'fold_' || k % 5 END AS split, CASE WHEN NOT good THEN 'failed' WHEN vague THEN 'skipped_ambiguous' ELSE 'ok' END AS status,
 CASE WHEN good AND NOT vague THEN least(k % 400, 300) ELSE 0 END::INT AS n_ec, CASE WHEN good AND NOT vague THEN k % 300 ELSE 0 END::INT AS n_eo, CASE WHEN good AND NOT vague AND task THEN k % 200 ELSE 0 END::INT AS n_vcpt,
 CASE WHEN good THEN CASE WHEN k % 3 = 0 THEN 'detected' ELSE 'midpoint' END END AS split_rule, CASE WHEN good THEN CASE WHEN k % 3 = 0 THEN 0.4 ELSE 0.5 END::DOUBLE END AS boundary_frac, coalesce(fault, printf('alpha_ratio=%.2f', ratio)) AS detail,
 CASE WHEN good THEN (k % 50) / 64.0::DOUBLE END AS rej_ec, CASE WHEN good THEN (k % 32) / 64.0::DOUBLE END AS rej_eo, CASE WHEN good AND task THEN (k % 16) / 64.0::DOUBLE END AS rej_vcpt, CASE WHEN good THEN k % 6 = 0 END AS capped_eoec, CASE WHEN good AND task THEN k % 10 = 1 END AS capped_vcpt,
 CASE WHEN good THEN k % 7 END::INT AS muscle_flagged_eoec, CASE WHEN good AND task THEN k % 9 END::INT AS muscle_flagged_vcpt, CASE WHEN good THEN vague END AS eoec_ambiguous FROM g""")
def build_log(spark, d):
    """Customers as subjects, and nations as ids that no manifest has."""
    c = table(spark, d, "customer").withColumn("k", F.col("c_custkey").cast("int"))
    k, text = F.col("k"), F.col("k").cast("string")
    group = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "ADHD").otherwise("Control")
    manifest = c.select(F.concat(F.lit("C"), text).alias("subject_id"), group.alias("group"), F.concat(F.lit("fold_"), (k % 5).cast("string")).alias("split"), F.concat(F.lit("/rest/"), text).alias("eoec_path"), F.when(k % 4 != 0, F.concat(F.lit("/task/"), text)).alias("vcpt_path"))
    ratio = (k % 30) / F.lit(10.0) + 0.1
    none = F.lit(None)
    values = {
        "rest": (k % 17 != 0, F.when(k % 13 == 0, "failed").when((ratio > 0.7) & (ratio < 1.4), "skipped_ambiguous").otherwise("ok"), F.when(k % 13 == 0, "broken"), ratio, F.when(k % 3 == 0, "detected").otherwise("midpoint"), F.when(k % 3 == 0, 0.4).otherwise(0.5), k % 6 == 0, k % 7, k % 400, k % 300, none, (k % 50) / F.lit(64.0), (k % 32) / F.lit(64.0), none),
        "task": (k % 23 != 0, F.when(k % 19 == 0, "failed").otherwise("ok"), none.cast("string"), none, none.cast("string"), none, k % 10 == 1, k % 9, none, none, k % 200, none, none, (k % 16) / F.lit(64.0)),
    }
    kinds = ("string", "string", "double", "string", "double", "boolean", "int", "int", "int", "int", "double", "double", "double")
    names = ("status", "detail", "alpha_ratio", "split_rule", "boundary_frac", "capped", "n_muscle", "n_ec", "n_eo", "n_vcpt", "rej_ec", "rej_eo", "rej_vcpt")
    rest, task = (c.filter(there).select(F.concat(F.lit(f"/{kind}/"), text).alias("path"), *[v.cast(t).alias(n) for v, t, n in zip(v, kinds, names, strict=True)]) for kind, (there, *v) in values.items())
    wanted = manifest.select("subject_id").unionByName(table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("subject_id")))
    return recordings.build_log(manifest, rest.unionByName(task), wanted)
