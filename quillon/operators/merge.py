"""Idempotent, resumable batch logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key ``new`` lacks; columns that only one has are null in the other."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def pending(wanted: DataFrame, log: DataFrame, key: str, done: str = "status = 'ok'") -> DataFrame:
    """Keys still to do: not in the log, or there without success."""
    return wanted.join(log.filter(done).select(key).distinct(), key, "left_anti")


def recover(rebuilt: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rebuilt rows overlaid by the existing ones, column by column where those hold a value."""
    columns = [c for c in rebuilt.columns if c != key]
    a = rebuilt.select(key, *[F.col(c).alias(f"__a_{c}") for c in columns])
    b = existing.select(key, *[F.col(c).alias(f"__b_{c}") for c in columns if c in existing.columns])
    both = a.join(b, key, "full_outer")
    pick = lambda c: F.coalesce(f"__b_{c}", f"__a_{c}") if c in existing.columns else F.col(f"__a_{c}")
    return both.select(key, *[pick(c).alias(c) for c in columns])


def replace_key(table: DataFrame, row: DataFrame, key: str, value) -> DataFrame:
    """The table with all rows of one key value replaced."""
    return table.filter(~F.col(key).eqNullSafe(F.lit(value))).unionByName(row, allowMissingColumns=True)


def run_status(results: DataFrame, status: str = "status") -> DataFrame:
    """Counts by status, with totals of the epoch counts."""
    return results.groupBy(status).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("n_ec", "n_eo", "n_vcpt") if c in results.columns])


def backup(spark, path: str, name: str) -> bool:
    """Copy a log beside it as ``<path>.<name>``, over an earlier copy; False where there is no log or the copy fails: best effort."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    source, target, part = hadoop.Path(path), hadoop.Path(f"{path}.{name}"), hadoop.Path(f"{path}.{name}.part")
    try:
        conf = spark._jsc.hadoopConfiguration()
        fs = source.getFileSystem(conf)
        if not fs.exists(source):
            return False
        fs.delete(part, True)
        if not hadoop.FileUtil.copy(fs, source, fs, part, False, conf):
            return False
        fs.delete(target, True)
        return bool(fs.rename(part, target))
    except Exception as e:  # noqa: BLE001 - the run goes on without a copy
        print(f"no copy of {path}: {e}")
        return False


def save(path: str, new: DataFrame, key: str) -> DataFrame:
    """Merge into a Parquet log: write beside it, then swap the folders, so a failed write leaves the old log."""
    spark = new.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    merged = keyed_merge(spark.read.parquet(path), new, key) if fs.exists(target) else new
    fresh, old = hadoop.Path(path + ".new"), hadoop.Path(path + ".old")
    merged.orderBy(key).write.mode("overwrite").parquet(path + ".new")
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(fresh, target)
    fs.delete(old, True)
    return spark.read.parquet(path)
