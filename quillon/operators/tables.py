"""Feature tables: reshaping, imputation, scaling and selection, in long form (key, feature, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def wide(long: DataFrame, key: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    return long.groupBy(*key).pivot(name, names).agg(F.first(value))


def long(wide_: DataFrame, key: list[str], names: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    return wide_.unpivot(key, names, name, value)


def shared_features(long_: DataFrame, feature: str, condition: str, k: int) -> DataFrame:
    """Features that occur with a value under at least k conditions."""
    return long_.filter("value IS NOT NULL").groupBy(feature).agg(F.count_distinct(condition).alias("n")).filter(F.col("n") >= k).select(feature)


def stems(columns: list[str], suffixes: list[str]) -> list[str]:
    """Stems of the columns ``<stem><suffix>`` that occur with every suffix, in the order of the columns."""
    held = set(columns)
    first = suffixes[0]
    return [c[: len(c) - len(first)] for c in columns if c.endswith(first) and len(c) > len(first) and all(c[: len(c) - len(first)] + s in held for s in suffixes)]


def any_value(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows in which at least one of the columns holds a value; NaN is none. Without columns no row stays."""
    kinds = dict(rows.dtypes)
    tests = [F.col(f"`{n}`").isNotNull() & (~F.isnan(f"`{n}`") if kinds[n] in ("double", "float") else F.lit(True)) for n in names]
    found = F.lit(False)
    for t in tests:
        found = found | t
    return rows.filter(found)


def by_condition(rows: DataFrame, key: list[str], suffixes: dict[str, str]) -> DataFrame:
    """(key, condition, one column a shared stem): each row once for every condition, whose name the suffix gives.

    Columns whose stem lacks a condition are left out, and rows without any value in a condition.
    """
    names = stems(rows.columns, list(suffixes))
    parts = [any_value(rows.select(*key, F.lit(c).alias("condition"), *[F.col(f"`{n}{s}`").alias(n) for n in names]), names) for s, c in suffixes.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def non_null_features(long_: DataFrame, feature: str = "feature") -> DataFrame:
    return long_.groupBy(feature).agg(F.count("value").alias("n")).filter("n > 0")


def medians(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, median): the exact median of each key's values, from counts of distinct ones summed by ranges; no task holds a key.

    Nulls take no part, and a key without a value has no row.
    """
    from .running import before

    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    sizes = counted.groupBy(*by).agg(F.sum("__c").alias("__n"))
    # a row a key
    ranked = before(counted, value, "__c", *by).join(F.broadcast(sizes), list(by))
    covers = lambda place: F.max(F.when((F.col("__before") <= place) & (place < F.col("__before") + F.col("__c")), F.col(value)))
    middle = ranked.groupBy(*by).agg(covers(F.floor((F.col("__n") - 1) / 2)).alias("__a"), covers(F.floor(F.col("__n") / 2)).alias("__b"))
    return middle.select(*by, ((F.col("__a") + F.col("__b")) / 2).alias("median"))


def impute_median(long_: DataFrame, train: str, feature: str = "feature") -> DataFrame:
    """Null values take their feature's exact median over training rows."""
    median = medians(long_.filter(train), "value", feature).withColumnRenamed("median", "__m")
    # a row a feature: rows stay where they are
    return long_.join(F.broadcast(median), feature, "left").withColumn("value", F.coalesce("value", "__m")).drop("__m")


def standardize(long_: DataFrame, train: str, *by: str) -> DataFrame:
    """Centre and scale by the training rows' mean and population deviation within ``by``; constant features divide by 1."""
    stats = long_.filter(train).groupBy(*by).agg(F.avg("value").alias("__m"), F.stddev_pop("value").alias("__s"))
    scale = F.when(F.col("__s") > 1e-12, F.col("__s")).otherwise(1.0)
    # a row a feature: rows stay where they are
    return long_.join(F.broadcast(stats), [*by]).withColumn("value", (F.col("value") - F.col("__m")) / scale).drop("__m", "__s")


def anova_f(long_: DataFrame, group: str, feature: str = "feature") -> DataFrame:
    """One-way F of each feature over the groups, from group sums."""
    cells = long_.filter("value IS NOT NULL").groupBy(feature, group).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    totals = cells.groupBy(feature).agg(F.sum("n").alias("__n"), F.sum(F.col("n") * F.col("m")).alias("__s"), F.count("*").alias("__k"), F.sum(F.col("n") * F.col("v")).alias("__w"))
    between = cells.join(totals, feature).groupBy(feature, "__n", "__k", "__w").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("__s") / F.col("__n"), 2)).alias("__b"))
    f = F.try_divide(F.col("__b") / (F.col("__k") - 1), F.try_divide(F.col("__w"), (F.col("__n") - F.col("__k")).cast("double")))
    return between.filter("__k > 1").select(feature, f.alias("f"))


def top_features(scores: DataFrame, k: int, feature: str = "feature") -> DataFrame:
    return scores.orderBy(F.desc_nulls_last(F.round("f", 9)), feature).limit(k)


def correlations(wide_: DataFrame, names: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    row = wide_.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("x")).select("x.*")


def robust_scale(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """The value at index floor(.95 n) of the ordered absolute values of each group, from counts of distinct ones summed by ranges."""
    from .running import before

    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.abs(value).alias("scale")).agg(F.count("*").alias("__c"))
    sizes = counted.groupBy(*keys).agg(F.floor(F.sum("__c") * 0.95).alias("__at"))
    ranked = before(counted, "scale", "__c", *keys).join(sizes, list(keys)) if keys else before(counted, "scale", "__c").crossJoin(F.broadcast(sizes))
    return ranked.filter((F.col("__before") <= F.col("__at")) & (F.col("__at") < F.col("__before") + F.col("__c"))).select(*keys, "scale")
