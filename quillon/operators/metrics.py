"""Roll-ups and classification metrics over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import before


def subject_mean(epochs: DataFrame, prob: str = "prob") -> DataFrame:
    """Mean probability of each subject, and the label at 0.5."""
    mean = epochs.groupBy("subject_id", "true_label").agg(F.avg(prob).alias("mean_prob"), F.count("*").alias("n_epochs"))
    return mean.withColumn("pred_label", F.when(F.col("mean_prob") >= 0.5, "ADHD").otherwise("Control"))


def ratio(top: Column, bottom: Column) -> Column:
    """Null where the denominator is 0."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def confusion(rows: DataFrame, truth: Column, predicted: Column, *keys: str) -> DataFrame:
    """Counts, accuracy, sensitivity and specificity; null where a class is empty."""
    count = lambda c: F.sum(c.cast("long"))
    cells = rows.groupBy(*keys).agg(count(truth & predicted).alias("tp"), count(~truth & predicted).alias("fp"), count(~truth & ~predicted).alias("tn"), count(truth & ~predicted).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return cells.withColumns({"accuracy": ratio(tp + tn, tp + fp + tn + fn), "sensitivity": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp)})


def rank_auc(rows: DataFrame, truth: Column, score: str, *keys: str) -> DataFrame:
    """Area under the curve from average ranks, ties one half; null where a class is empty.

    Ranks come from the counts of distinct scores, summed up range by range.
    """
    tied = rows.filter(F.col(score).isNotNull() & ~F.isnan(score)).groupBy(*keys, score).agg(F.sum(truth.cast("long")).alias("__p"), F.count("*").alias("__n"))
    ranked = before(tied, score, "__n", *keys).withColumn("__rank", F.col("__before") + (F.col("__n") + 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("__p") * F.col("__rank")).alias("__s"), F.sum("__p").alias("n_pos"), F.sum(F.col("__n") - F.col("__p")).alias("n_neg"))
    auc = F.try_divide(F.col("__s") - F.col("n_pos") * (F.col("n_pos") + 1) / 2, (F.col("n_pos") * F.col("n_neg")).cast("double"))
    return sums.select(*keys, "n_pos", "n_neg", auc.alias("auc"))


def cohens_d(rows: DataFrame, group: Column, value: str, *keys: str) -> DataFrame:
    """Standardised mean difference with pooled variance; null with fewer than two values or no spread."""
    v = F.col(value)
    side = lambda c: F.when(c, v)
    sums = rows.groupBy(*keys).agg(*[f(side(c)).alias(f"__{n}{i}") for i, c in enumerate((group, ~group)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    n0, n1, v0, v1 = (F.col(f"__{c}") for c in ("n0", "n1", "v0", "v1"))
    pooled = F.sqrt(F.try_divide((n0 - 1) * v0 + (n1 - 1) * v1, (n0 + n1 - 2).cast("double")))
    d = F.when((n0 >= 2) & (n1 >= 2) & (pooled > 0), (F.col("__m0") - F.col("__m1")) / pooled)
    return sums.select(*keys, F.col("__n0").alias("n_a"), F.col("__n1").alias("n_b"), d.alias("d"))


def kappa(a: Column, b: Column) -> list[Column]:
    """Aggregates: agreement, Cohen's kappa and McNemar's discordant counts of two booleans."""
    n = F.count("*").cast("double")
    share = lambda c: F.sum(c.cast("long")) / n
    observed = share(a == b)
    expected = share(a) * share(b) + (1 - share(a)) * (1 - share(b))
    return [
        F.count("*").alias("n"),
        observed.alias("agreement"),
        F.try_divide(observed - expected, 1 - expected).alias("kappa"),
        F.sum((a & ~b).cast("long")).alias("only_a"),
        F.sum((~a & b).cast("long")).alias("only_b"),
    ]


def arm_pairs(arms: DataFrame, key: str = "subject_id") -> DataFrame:
    """Rows of the same subject in two arms, the first arm before the second."""
    a = arms.select(F.col("arm").alias("arm_a"), key, F.col("truth").alias("truth_a"), F.col("p").alias("p_a"))
    b = arms.select(F.col("arm").alias("arm_b"), F.col(key).alias("__key"), F.col("truth").alias("truth_b"), F.col("p").alias("p_b"))
    return a.join(b, (F.col(key) == F.col("__key")) & (F.col("arm_a") < F.col("arm_b"))).drop("__key")


def checked_truth(pairs: DataFrame) -> DataFrame:
    """Raise where two arms disagree on a subject's truth."""
    same = F.when(F.col("truth_a") == F.col("truth_b"), F.col("truth_a")).otherwise(F.raise_error(F.lit("two arms disagree on a subject's truth")))
    return pairs.withColumn("truth", same).drop("truth_a", "truth_b")


def describe(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    d = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("least"), quartiles.alias("q"), F.max(value).alias("most"))
    return d.select(*keys, "n", "mean", "sd", "least", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "most")


def histogram(rows: DataFrame, prob: str, bins: int = 20, *keys: str) -> DataFrame:
    """Counts by equal bins of [0, 1]; 1 falls into the last."""
    bin_ = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"))


def placement(rows: DataFrame, group: str, key: str, prob: str) -> DataFrame:
    """For each subject: how many others of each group score at least as high, by windows over distinct scores."""
    tied = rows.groupBy(group, prob).agg(F.count("*").alias("__n"))
    grid = rows.select(prob).distinct().crossJoin(rows.select(F.col(group).alias("other")).distinct())
    counted = grid.join(tied.withColumnRenamed(group, "other"), ["other", prob], "left")
    down = Window.partitionBy("other").orderBy(F.desc(prob))
    counted = counted.select("other", prob, F.sum(F.coalesce("__n", F.lit(0))).over(down).alias("at_least"))
    placed = rows.select(key, group, prob).join(counted, prob)
    return placed.select(key, F.col("other").alias("reference_group"), (F.col("at_least") - (F.col("other") == F.col(group)).cast("long")).alias("n_at_least"))
