"""Live quality control on streams of events: late data, sliding windows, sessions and running means. An extension of ours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def landing(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Parquet files as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def rejection_rates(events: DataFrame, above: float, late: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Share of values above a limit by key and window; data later than the watermark is left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg((F.col("value") > above).cast("double")).alias("rate")).select("w.start", "event_type", "n", "rate")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", "s.start", "s.end", "n")


def running_means(events: DataFrame) -> DataFrame:
    """After each batch, the mean so far of every key that the batch holds: the sum of its values by all its rows."""
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", "n", (F.col("total") / F.col("n")).alias("mean"))
