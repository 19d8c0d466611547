"""Quality-control policies, component vetoes and threshold solving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import PEAK_REGIONS, WARN_RATE


def policies(capped: Column, tail: Column) -> dict[str, Column]:
    """Which rows each policy keeps; a null flag counts as false."""
    c, t = F.coalesce(capped, F.lit(False)), F.coalesce(tail, F.lit(False))
    return {"none": F.lit(True), "drop_capped": ~c, "drop_tail": ~t, "drop_either": ~(c | t)}


def policy_table(rows: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """Rows once for every policy that keeps them."""
    names = F.array(*[F.struct(F.lit(n).alias("policy"), m.alias("keep")) for n, m in masks.items()])
    return rows.withColumn("__p", F.explode(F.filter(names, lambda p: p["keep"]))).withColumn("policy", F.col("__p.policy")).drop("__p")


def triage(rate: Column) -> Column:
    return F.when(rate > 0.5, "over_50").when(rate > 0.3, "30_to_50").otherwise("under_30")


def quality_notes(rows: DataFrame, conditions: list[str]) -> DataFrame:
    """Rates of each condition from ``n_events_<c>`` and ``n_kept_<c>``, notes, and a flag strictly above the warning rate."""
    rates = {c: F.when(F.col(f"n_events_{c}") > 0, 1 - F.col(f"n_kept_{c}") / F.col(f"n_events_{c}")) for c in conditions}
    notes = [F.when(r > WARN_RATE, F.concat(F.lit(f"{c}: "), F.format_string("%.0f", r * 100), F.lit("% rejected"))) for c, r in rates.items()]
    notes.append(F.when(F.coalesce(F.col("capped"), F.lit(False)), F.lit("component cap reached")))
    kept = F.array_compact(F.array(*notes))
    return rows.withColumns({f"rate_{c}": r for c, r in rates.items()}).withColumn("notes", kept).withColumn("flagged", F.size("notes") > 0)


def region_weights(weights: DataFrame, regions: dict[str, list[str]], *keys: str) -> DataFrame:
    """Mean absolute weight in each region over the mean of all; null where that mean is not positive."""
    region = F.create_map(*[x for r, cs in regions.items() for c in cs for x in (F.lit(c), F.lit(r))])
    rows = weights.withColumn("region", region[F.col("channel")])
    whole = rows.groupBy(*keys).agg(F.avg(F.abs("weight")).alias("__all"))
    by = rows.filter("region IS NOT NULL").groupBy(*keys, "region").agg(F.avg(F.abs("weight")).alias("__w"))
    return by.join(whole, [*keys]).select(*keys, "region", F.when(F.col("__all") > 0, F.col("__w") / F.col("__all")).alias("relative"))


def topography_veto(components: DataFrame, relative: DataFrame, *keys: str, focality: float = 2.0) -> DataFrame:
    """Keep a component's exclusion iff its peak region ``fits`` one of its reasons and is focal; unknown reasons skip the region test."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("relative", 9)), "region")
    peak = relative.withColumn("__r", F.row_number().over(order)).filter("__r = 1").select(*keys, F.col("region").alias("peak_region"), F.col("relative").alias("focality"))
    known = F.create_map(*[x for r, rs in PEAK_REGIONS.items() for x in (F.lit(r), F.array(*map(F.lit, rs)))])
    expected = F.flatten(F.filter(F.transform("reasons", lambda r: known[r]), lambda a: a.isNotNull()))
    any_unknown = F.exists("reasons", lambda r: ~F.map_contains_key(known, r))
    fits = any_unknown | F.array_contains(expected, F.col("peak_region"))
    return components.join(peak, [*keys]).withColumns({"fits": fits, "keep": fits & (F.col("focality") >= focality)})


def cap_strongest(scores: DataFrame, cap: int, group: str, component: str = "component") -> DataFrame:
    """All ``eog`` components, then the strongest ``muscle`` ones up to the cap; ``capped`` where muscle had to be cut."""
    n_eog = F.sum((F.col("reason") == "eog").cast("int")).over(Window.partitionBy(group))
    n_muscle = F.sum((F.col("reason") == "muscle").cast("int")).over(Window.partitionBy(group))
    rank = F.row_number().over(Window.partitionBy(group, "reason").orderBy(F.desc(F.abs("score")), component))
    room = F.greatest(F.lit(0), cap - F.col("__eog"))
    rows = scores.withColumns({"__eog": n_eog, "__muscle": n_muscle, "__rank": rank})
    return rows.withColumn("capped", F.col("__muscle") > room).filter((F.col("reason") == "eog") | (F.col("__rank") <= room)).drop("__eog", "__muscle", "__rank")


Rule = Callable[[], Column]


def rule_table(components: DataFrame, rules: dict[str, Column], subjects: int, retained: str | None = None) -> DataFrame:
    """For each named rule, in one pass: exclusions kept, kept per subject, share vetoed."""
    named = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("keep")) for n, c in rules.items()])
    rows = components.select(F.explode(named).alias("__r")).select("__r.rule", "__r.keep")
    out = rows.groupBy("rule").agg(F.sum(F.col("keep").cast("long")).alias("kept"), F.count("*").alias("__n"))
    return out.select("rule", "kept", (F.col("kept") / F.lit(float(subjects))).alias("per_subject"), (100 * (1 - F.col("kept") / F.col("__n"))).alias("pct_vetoed"))


def peak_rules(occipital: Column) -> dict[str, Column]:
    """Candidate vetoes for ``rule_table`` on ``fits`` and ``focality``, with strict limits; occipital: relative weight there."""
    fits, focal = F.col("fits"), F.round("focality", 9)
    return {
        "none": F.lit(True),
        "fits": fits,
        "above_1_5": focal > 1.5,
        "above_2": focal > 2.0,
        "fits_above_1_5": fits & (focal > 1.5),
        "fits_above_2": fits & (focal > 2.0),
        "fits_above_1_5_little_occipital": fits & (focal > 1.5) & (F.round(occipital, 9) <= 1.5),
    }


def with_subjects(components: DataFrame, subjects: DataFrame, key: str = "subject_id") -> DataFrame:
    """Every component with its subject's columns, null where the subject is missing; two rows of a subject raise."""
    columns = [c for c in subjects.columns if c != key]
    one = subjects.groupBy(key).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in columns])
    one = one.select(F.when(F.col("__n") > 1, F.raise_error(F.lit("two rows of a subject")).cast(dict(subjects.dtypes)[key])).otherwise(F.col(key)).alias(key), *columns)
    return components.join(one, key, "left")


def estimated_retention(subjects: DataFrame, kept: DataFrame, key: str = "subject_id") -> DataFrame:
    """Median over subjects of 1 - (1 - retained) * share of exclusions kept, by rule; kept: (rule, key, share)."""
    rows = kept.join(subjects.select(key, "retained"), key)
    return rows.groupBy("rule").agg(F.percentile(1 - (1 - F.col("retained")) * F.col("share"), 0.5).alias("median_retention"))


def solve_threshold(values: DataFrame, value: str, key: str, target: float) -> DataFrame:
    """The smallest observed value whose median per-subject share of larger values is at most the target.

    A search over the ranks of the values: a step probes 31 quantiles of what is left in one aggregate
    by subject, so nothing grows with candidates times rows.
    """
    spark = values.sparkSession
    rows = values.select(key, F.col(value).alias("v")).filter("v IS NOT NULL")

    def shares(probes: list[float]) -> list[float]:
        above = [F.avg((F.col("v") > t).cast("double")).alias(f"r{i}") for i, t in enumerate(probes)]
        return list(rows.groupBy(key).agg(*above).agg(*[F.percentile(f"r{i}", 0.5) for i in range(len(probes))]).first())

    low, high = rows.agg(F.min("v"), F.max("v")).first()
    if high is None:
        raise ValueError("no observed value meets the target")
    first, last = shares([low, high])
    if last > target:
        raise ValueError("no observed value meets the target")
    if first <= target:
        return spark.createDataFrame([(float(low), float(first))], "threshold double, median_rejection double")
    while True:  # low fails and high, whose share is last, meets; a step moves them to observed values
        cuts = [i / 32 for i in range(1, 32)]
        inside = rows.filter((F.col("v") > low) & (F.col("v") < high)).agg(F.percentile_approx("v", cuts, 1000)).first()[0]
        if not inside:
            return spark.createDataFrame([(float(high), float(last))], "threshold double, median_rejection double")
        probes = sorted(set(inside))
        for t, r in zip(probes, shares(probes), strict=True):
            if r <= target:
                high, last = t, r
                break
            low = t


def sweep(rows: DataFrame, threshold: str, value: str) -> DataFrame:
    """By threshold the median of a value, and its swing in percent against the smallest threshold's."""
    by = rows.groupBy(threshold).agg(F.percentile(value, 0.5).alias("median"))
    base = by.agg(F.min_by("median", threshold).alias("__b"))
    return by.crossJoin(F.broadcast(base)).select(threshold, "median", (100 * F.try_divide(F.col("median") - F.col("__b"), "__b")).alias("swing_pct"))
