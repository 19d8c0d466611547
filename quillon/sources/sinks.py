"""Sinks: CSV, partitioned images, JSON answers, and fold views instead of link trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .readers import null_nan


def write_csv(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").csv(path, header=True)


def write_images(images: DataFrame, path: str) -> None:
    """Binary images by representation, split and label; readers prune by these folders."""
    images.write.mode("overwrite").partitionBy("representation", "split", "label").parquet(path)


def fold_view(images: DataFrame, splits: DataFrame, fold: str, key: str = "subject_id") -> DataFrame:
    """Images of a fold's subjects with their role: a filter and a join, no copies."""
    role = F.when(F.col("split") == fold, "val").otherwise("train")
    return images.drop("split").join(splits.filter("split <> 'test'").select(key, "split"), key).withColumn("role", role)


def to_json(rows: DataFrame, *columns: str) -> DataFrame:
    """One JSON text per row; NaN is written as null, and nulls are written."""
    clean = null_nan(rows)
    return clean.select(F.to_json(F.struct(*(columns or clean.columns)), {"ignoreNullFields": "false"}).alias("json"))


def base64(image: str | Column) -> Column:
    return F.base64(image)


def reference(scores: DataFrame) -> DataFrame:
    """The reference set that a service serves: rows with status ok, and what is shown of them."""
    return scores.filter("status = 'ok'").select("subject_id", "group", "p_adhd", "n_epochs")
