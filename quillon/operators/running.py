"""Running sums over an order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values that are summed apart; a window over them has so many rows a key at most.
RANGES = 64


def before(rows: DataFrame, value: str, count: str, *keys: str) -> DataFrame:
    """``rows`` (one for each ``keys`` and ``value``) with ``__before``: the sum of ``count`` over smaller values of the key.

    Values are cut at approximate quantiles of all rows. Sums inside a range need that range's rows only, and the
    ranges' totals, at most RANGES for a key, are summed up next to them.
    """
    cuts = rows.agg(F.percentile_approx(value, F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)]), 1000).alias("__cuts"))
    ranged = rows.crossJoin(F.broadcast(cuts)).withColumn("__range", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(value))), F.lit(0))).drop("__cuts")
    inside = F.sum(count).over(Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    totals = ranged.groupBy(*keys, "__range").agg(F.sum(count).alias("__sum"))
    offset = F.sum("__sum").over(Window.partitionBy(*keys, F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col("__range").alias("__of"), F.coalesce(offset, F.lit(0)).alias("__offset"))
    same = F.col("__range") == F.col("__of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    joined = ranged.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(totals, same)
    return joined.select(*rows.columns, (F.col("__inside") + F.col("__offset")).alias("__before"))
