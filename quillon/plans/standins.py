"""Driver tables in the roles of the domain's tables, each as a DataFrame and as a SQL common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch-level predictions: line items, the order's customer as subject, its market segment as group."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    group = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "ADHD").otherwise("Control")
    return joined.select(F.col("o_custkey").alias("subject_id"), group.alias("true_label"), F.col("l_orderkey").alias("epoch"), F.col("l_linenumber").alias("part"), (F.col("l_discount") * 6 + F.col("l_tax") * 5).alias("prob"))


EPOCHS = """epochs AS (SELECT o_custkey AS subject_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'ADHD' ELSE 'Control' END AS true_label,
  l_orderkey AS epoch, l_linenumber AS part, l_discount * 6 + l_tax * 5 AS prob
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject-level predictions of three model arms over labelled documents; two arms miss some subjects, and ties occur."""
    base = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    d, c = F.col("doc_id"), F.col("n_chars")
    scores = F.array(
        F.struct(F.lit("length").alias("arm"), ((c % 997) / 997.0).alias("p")),
        F.struct(F.lit("hash").alias("arm"), ((d * 7919 % 101) / 101.0).alias("p")),
        F.struct(F.lit("mixed").alias("arm"), (((d * 31 + c) % 53) / 53.0).alias("p")),
    )
    rows = base.select("doc_id", "quality", "toxic", F.explode(scores).alias("s")).select("s.arm", F.col("doc_id").alias("subject_id"), F.col("quality").alias("truth"), "toxic", "s.p")
    return rows.filter(~((F.col("arm") == "hash") & (F.col("subject_id") % 7 == 0)) & ~((F.col("arm") == "mixed") & (F.col("subject_id") % 11 == 0)))


ARMS = """base AS (SELECT doc_id, quality, toxic, n_chars FROM labels JOIN documents USING (doc_id)),
arms AS (SELECT 'length' AS arm, doc_id AS subject_id, quality AS truth, toxic, (n_chars % 997) / 997.0::DOUBLE AS p FROM base
  UNION ALL SELECT 'hash', doc_id, quality, toxic, (doc_id * 7919 % 101) / 101.0::DOUBLE FROM base WHERE doc_id % 7 <> 0
  UNION ALL SELECT 'mixed', doc_id, quality, toxic, ((doc_id * 31 + n_chars) % 53) / 53.0::DOUBLE FROM base WHERE doc_id % 11 <> 0)"""

CHANNEL_NAMES = ["F3", "F4", "Fz", "O1", "O2", "T3", "C3", "P3"]
CONDITIONS = ["ec", "eo", "vcpt"]


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short signals: embeddings as 64 samples at 64 Hz; 24 vectors are 8 channels by 3 conditions of a subject."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        v.alias("signal_id"),
        F.floor(v / 24).cast("long").alias("subject_id"),
        F.element_at(F.array(*map(F.lit, CHANNEL_NAMES)), (v % 8 + 1).cast("int")).alias("channel"),
        F.element_at(F.array(*map(F.lit, CONDITIONS)), (F.floor(v / 8) % 3 + 1).cast("int")).alias("condition"),
        F.col("label").alias("epoch"),
        F.transform("embedding", lambda x: x.cast("double")).alias("samples"),
    )


SIGNALS = """signals AS (SELECT vec_id AS signal_id, vec_id // 24 AS subject_id, ['F3', 'F4', 'Fz', 'O1', 'O2', 'T3', 'C3', 'P3'][vec_id % 8 + 1] AS channel,
  ['ec', 'eo', 'vcpt'][(vec_id // 8) % 3 + 1] AS condition, label AS epoch, embedding::DOUBLE[] AS samples FROM embeddings)"""


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value series per user, in time order from 0."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", (F.row_number().over(order) - 1).alias("i"))


PROFILE = """profile AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"""
