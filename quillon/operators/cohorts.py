"""Set algebra on cohorts, split manifests and their leakage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def common(arms: DataFrame, key: str = "subject_id", arm: str = "arm") -> DataFrame:
    """Keys that every arm has."""
    n = arms.select(arm).distinct().agg(F.count("*").alias("__of"))
    return arms.groupBy(key).agg(F.count_distinct(arm).alias("__n")).crossJoin(F.broadcast(n)).filter("__n = __of").select(key)


def missing(arms: DataFrame, key: str = "subject_id", arm: str = "arm") -> DataFrame:
    """(arm, key) that some arm has and this one lacks."""
    grid = arms.select(key).distinct().crossJoin(arms.select(arm).distinct())
    return grid.join(arms.select(key, arm).distinct(), [key, arm], "left_anti").select(arm, key)


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    only = lambda x, y, side: x.select(key).distinct().join(y.select(key).distinct(), key, "left_anti").select(key, F.lit(side).alias("side"))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def head_by_group(rows: DataFrame, group: str, n: int, *order: str | Column) -> DataFrame:
    """The first n rows of each group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("rank_in_group", rank).filter(F.col("rank_in_group") <= n)


def stratified_split(subjects: DataFrame, key: str = "subject_id", group: str = "group", test_share: float = 0.15, folds: int = 5, seed: int = 42) -> DataFrame:
    """Assign ``split``: the first share of each group by a seeded hash is the test set, the rest deal into folds.

    Not any library's assignment: where parity matters, read an existing manifest.
    """
    order = Window.partitionBy(group).orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key)
    ranked = subjects.withColumns({"__i": F.row_number().over(order) - 1, "__n": F.count("*").over(Window.partitionBy(group))})
    test = F.ceil(F.col("__n") * test_share)
    split = F.when(F.col("__i") < test, "test").otherwise(F.concat(F.lit("fold_"), ((F.col("__i") - test) % folds).cast("string")))
    return ranked.withColumn("split", split).drop("__i", "__n")


def checked_manifest(subjects: DataFrame, key: str, group: str, folds: int) -> DataFrame:
    """Violations that forbid a split: a repeated key, or a group smaller than the number of folds."""
    repeated = subjects.groupBy(F.col(key).cast("string").alias("what")).count().filter("count > 1").select(F.lit("repeated subject").alias("rule"), "what")
    small = subjects.groupBy(F.col(group).alias("what")).count().filter(F.col("count") < folds).select(F.lit("group smaller than folds").alias("rule"), "what")
    return repeated.unionByName(small)


def leaks(manifest: DataFrame, key: str = "subject_id", split: str = "split") -> DataFrame:
    """Keys in more than one split, with their splits."""
    by_key = manifest.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    return by_key.filter(F.size("splits") > 1).select(key, F.array_join("splits", ",").alias("splits"))


def fold_roles(splits: DataFrame, folds: int = 5) -> DataFrame:
    """For each outer fold the role of every split: itself scored, the next one inner, the others train; test stays out."""
    if folds < 3:
        raise ValueError("nested folds need at least three folds")
    outer = splits.sparkSession.range(folds).select(F.concat(F.lit("fold_"), F.col("id").cast("string")).alias("outer_fold"), F.concat(F.lit("fold_"), ((F.col("id") + 1) % folds).cast("string")).alias("__inner"))
    rows = splits.filter("split <> 'test'").select("split").distinct().crossJoin(F.broadcast(outer))
    role = F.when(F.col("split") == F.col("outer_fold"), "score").when(F.col("split") == F.col("__inner"), "inner").otherwise("train")
    return rows.select("outer_fold", "split", role.alias("role"))


def two_sided(units: DataFrame, key: str, side: str, sides: list[str]) -> DataFrame:
    """Rows of keys that have every side."""
    full = units.filter(F.col(side).isin(sides)).groupBy(key).agg(F.count_distinct(side).alias("__n")).filter(F.col("__n") == len(sides)).select(key)
    return units.filter(F.col(side).isin(sides)).join(full, key, "left_semi")


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row a key; a key that it lacks is an error when read."""
    found = rows.join(table.withColumn("__found", F.lit(True)), key, "left")
    absent = F.raise_error(F.concat(F.lit(f"no such {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return found.withColumn(key, F.when(F.col("__found"), F.col(key)).otherwise(absent.cast(rows.schema[key].dataType))).drop("__found")
