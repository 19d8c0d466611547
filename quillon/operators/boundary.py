"""Best split of a profile in two, and the verdicts built on it."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .draws import key_column
from .draws import keys as order_keys
from .sums import lists


def _prefixes(profile: DataFrame, value: str, order: str, *keys: str) -> DataFrame:
    """For each k: sum of the first k values, their count, the total and its count."""
    w = Window.partitionBy(*keys).orderBy(order)
    whole = Window.partitionBy(*keys)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return profile.select(*keys, F.col(order).alias("k"), F.sum(value).over(before).alias("__s"), F.count("*").over(whole).alias("n"), F.sum(value).over(whole).alias("__t"))


def _score(cells: DataFrame) -> DataFrame:
    ratio = (F.col("__s") / F.col("k")) / F.nullif(((F.col("__t") - F.col("__s")) / (F.col("n") - F.col("k"))), F.lit(0.0))
    return cells.withColumn("ratio", ratio).withColumn("score", F.when(F.col("ratio") > 0, F.abs(F.ln("ratio"))))


def best_split(profile: DataFrame, value: str, order: str, *keys: str, margin: float = 0.1) -> DataFrame:
    """(keys, n, k, fraction, score): the k in [margin n, (1 - margin) n) of the largest absolute log ratio of means,
    the first on ties. ``order`` counts from 0. Running sums, so linear in the profile."""
    n = F.col("n")
    inside = _score(_prefixes(profile, value, order, *keys).filter((F.col("k") >= F.floor(n * margin)) & (F.col("k") < F.floor(n * (1 - margin))) & (F.col("k") > 0)))
    best = inside.filter("score IS NOT NULL").groupBy(*keys, "n").agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("k")).alias("k"))).alias("b"))
    return best.select(*keys, "n", (-F.col("b.k")).alias("k"), (-F.col("b.k") / F.col("n")).alias("fraction"), F.col("b.score").alias("score"))


def ratio_at(profile: DataFrame, value: str, order: str, fraction: float, *keys: str) -> DataFrame:
    """Ratio of means before and after a fixed fraction, rounded half to even and kept inside the profile."""
    cells = _score(_prefixes(profile, value, order, *keys).filter("k > 0"))
    k = F.greatest(F.lit(1), F.least(F.bround(F.col("n") * fraction), F.col("n") - 1))
    return cells.filter(F.col("k") == k).select(*keys, "n", "k", "ratio")


def ambiguous(ratio: Column, low: float = 0.7, high: float = 1.4) -> Column:
    return (ratio > low) & (ratio < high)


def alpha_split(halves: DataFrame, first: str, second: str) -> DataFrame:
    """Which half is eyes closed: a ratio below 1 swaps; near 1 it is ambiguous."""
    ratio = F.try_divide(first, second)
    return halves.withColumns({"alpha_ratio": ratio, "swapped": ratio < 1, "ambiguous": ambiguous(ratio)})


def verdict(rows: DataFrame, alpha: float = 0.05, tolerance: float = 0.08, plausible: tuple[float, float] = (0.25, 0.75)) -> DataFrame:
    """All three must hold: permutation p, agreement of two halves, and a plausible place."""
    rows = rows.withColumns({"passes_perm": F.col("perm_p") < alpha, "passes_split_half": F.col("split_half_diff") <= tolerance, "plausible": F.col("fraction").between(*plausible)})
    return rows.withColumn("trusted", F.col("passes_perm") & F.col("passes_split_half") & F.col("plausible"))


def two_votes(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Agreement of two votes, and how far it may be trusted."""
    share = F.avg((a == b).cast("double"))
    return rows.agg(F.count("*").alias("n"), share.alias("agreement")).withColumn("calibration", F.when(F.col("agreement") < 0.70, "abandon").when(F.col("agreement") < 0.85, "moderate").otherwise("strong"))


def moved(a: DataFrame, b: DataFrame, key: str, tolerance: float = 0.02) -> DataFrame:
    """Boundaries found under two constraints, and whether they differ by more than the tolerance."""
    both = a.select(key, F.col("fraction").alias("fraction_a")).join(b.select(key, F.col("fraction").alias("fraction_b")), key)
    return both.withColumn("moved", F.abs(F.col("fraction_a") - F.col("fraction_b")) > tolerance)


def consistency_gate(both: DataFrame, least: float = 0.8) -> DataFrame:
    """Whether enough subjects agree before and after cleaning."""
    return both.agg(F.count("*").alias("n"), F.avg((~F.col("moved")).cast("double")).alias("agree")).withColumn("passes", F.col("agree") >= least)


#: Rows of a profile whose orders a task makes in memory, and cells (draws x rows) that it holds at once; longer profiles go by windows.
PROFILE_ROWS, CELLS = 1 << 18, 1 << 18


def _best_scores(value: np.ndarray, unit: np.ndarray, draws: int, seed: int, margin: float) -> np.ndarray:
    """The best split's score of each order of one profile (in order of ``unit``), -inf where an order has no split."""
    n = len(value)
    k = np.arange(max(1, math.floor(n * margin)), math.floor(n * (1 - margin)))
    if not len(k):
        return np.full(draws, -np.inf)
    found, block = [], max(1, CELLS // n)
    for at in range(0, draws, block):
        draw = np.arange(at, min(draws, at + block), dtype=np.int64)[:, None]
        total = np.cumsum(value[np.argsort(order_keys(unit[None, :], draw, seed), axis=1, kind="stable")], axis=1)
        s, t = total[:, k - 1], total[:, -1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            right = (t - s) / (n - k)
            ratio = (s / k) / right
            score = np.abs(np.log(ratio))
        # a share without a ratio doesn't count; NaN is above every number, as in the windows
        found.append(np.where((right != 0) & ((ratio > 0) | np.isnan(ratio)), score, -np.inf).max(axis=1))
    return np.concatenate(found)


def null_scores(profile: DataFrame, value: str, unit: str, *by: str, draws: int = 200, seed: int = 42, margin: float = 0.1) -> DataFrame:
    """(by, scores): the best split of each of ``draws`` orders of a profile, by hashed keys of ``unit`` (a long, different
    in every row); -inf where an order has no split.

    A task streams profiles and makes the orders of one at a time, so nothing is shuffled once a draw. A profile of
    more than PROFILE_ROWS rows goes by windows over its orders instead.
    """
    types = dict(profile.dtypes)
    sized = profile.select(*by, F.col(unit).cast("long").alias("__u"), F.col(value).cast("double").alias("__v"), F.count("*").over(Window.partitionBy(*by)).alias("__n"))
    # few bytes, but much work: a number of tasks of its own, which is not reduced
    tasks = int(profile.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    short = sized.filter(F.col("__n") <= PROFILE_ROWS).drop("__n").repartition(tasks, *by).sortWithinPartitions(*by, "__u")

    def made(batches):
        key, held, names, kinds = None, [], [], []
        scores: list[np.ndarray] = []

        def close():
            if held:
                names.append(key)
                scores.append(_best_scores(np.concatenate([v for v, _ in held]), np.concatenate([u for _, u in held]), draws, seed, margin))

        def out():
            batch = pa.RecordBatch.from_arrays([*[pa.array([n[i] for n in names], t) for i, t in enumerate(kinds)], lists(scores)], names=[*by, "scores"])
            names.clear()
            scores.clear()
            return batch

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in by]
            of = list(zip(*[batch.column(c).to_pylist() for c in by], strict=True))
            v, u = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("__v", "__u"))
            starts = [i for i in range(len(of)) if i == 0 or of[i] != of[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(of)], strict=True):
                if of[a] != key:
                    close()
                    key, held = of[a], []
                held.append((v[a:b], u[a:b]))
            if names:
                yield out()
        close()
        if names:
            yield out()

    schema = ", ".join(f"`{c}` {types[c]}" for c in by) + ", scores array<double>"
    long = sized.filter(F.col("__n") > PROFILE_ROWS).select(*by, "__u", "__v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))).alias("__draw"))
    placed = long.withColumn("__i", F.row_number().over(Window.partitionBy(*by, "__draw").orderBy(key_column(F.col("__u"), F.col("__draw"), seed), "__u")) - 1)
    found = best_split(placed, "__v", "__i", *by, "__draw", margin=margin).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__draw", "score"))).alias("m"))
    windowed = found.select(*by, F.transform(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long")), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(-math.inf))).alias("scores"))
    return short.mapInArrow(made, schema).withColumn("scores", F.transform("scores", lambda s: F.when(s == -math.inf, s).otherwise(F.round(s, 9)))).unionByName(windowed)


def shuffled_scores(profile: DataFrame, value: str, unit: str, *keys: str, draws: int = 200, seed: int = 42, margin: float = 0.1) -> DataFrame:
    """(keys, draw, score): ``null_scores`` a row each; orders without a split have none."""
    null = null_scores(profile, value, unit, *keys, draws=draws, seed=seed, margin=margin)
    return null.select(*keys, F.posexplode("scores").alias("draw", "score")).filter(F.col("score") > -math.inf).withColumn("draw", F.col("draw").cast("long"))


def analyse(profile: DataFrame, halves: DataFrame, value: str, order: str, unit: str, *keys: str, draws: int = 200, seed: int = 42, margin: float = 0.1) -> DataFrame:
    """All diagnostics of each profile's best split, and the verdict on them.

    ``halves`` has the profiles of two channels apart (keys, half ``a`` or ``b``, order, value), whose best splits should
    agree. p has one added to both counts, so it is never 0. A profile without a split has no row; where one half
    has none, the difference is null and the split is not trusted.
    """
    best = best_split(profile, value, order, *keys, margin=margin)
    cells = _score(_prefixes(profile, value, order, *keys).filter("k > 0"))
    at_best = cells.select(*keys, "k", F.col("ratio").alias("best_ratio"))
    middle = ratio_at(profile, value, order, 0.5, *keys).select(*keys, F.col("ratio").alias("midpoint_ratio"))
    null = null_scores(profile, value, unit, *keys, draws=draws, seed=seed, margin=margin).withColumn("scores", F.filter("scores", lambda s: s > -math.inf)).filter(F.size("scores") > 0).join(best.select(*keys, F.col("score").alias("__seen")), list(keys))
    ordered, n = F.sort_array("scores"), F.size("scores")
    median = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    p = null.select(*keys, ((F.size(F.filter("scores", lambda s: s >= F.col("__seen"))) + 1) / (draws + 1)).alias("perm_p"), median.alias("perm_null_median"))
    two = best_split(halves, value, order, *keys, "half", margin=margin).groupBy(*keys).pivot("half", ["a", "b"]).agg(F.first("fraction")).withColumnsRenamed({"a": "a_frac", "b": "b_frac"})
    rows = best.join(at_best, [*keys, "k"]).join(middle, list(keys)).join(p, list(keys)).join(two, list(keys), "left")
    rows = rows.withColumns({"midpoint_score": F.when(F.col("midpoint_ratio") > 0, F.abs(F.ln("midpoint_ratio"))), "split_half_diff": F.abs(F.col("a_frac") - F.col("b_frac"))})
    rows = rows.withColumns({"gain": F.when(F.col("midpoint_score") > 0, F.col("score") / F.col("midpoint_score")), "pinned": (F.col("fraction") <= margin + 1e-6) | (F.col("fraction") >= 1 - margin - 1e-6)})
    found = verdict(rows)
    return found.withColumns({"passes_split_half": F.coalesce("passes_split_half", F.lit(False)), "trusted": F.coalesce("trusted", F.lit(False))})
