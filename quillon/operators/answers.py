"""What a service answers, as tables: predictions from epochs, and whether attention lies where the task lets expect it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .signals import sample_rows

# Channels of an image's strips from the top, the two sites, and each task's expected one.
STRIPS = ["Fz", "Cz", "Pz", "F3", "F4"]
FRONTAL, CENTRAL_PARIETAL = ["Fz", "F3", "F4"], ["Cz", "Pz"]
EXPECTED = {"EC": "frontal", "EO": "frontal", "VCPT": "central_parietal"}

#: Epochs of a condition that are classified.
EPOCHS_PER_CONDITION = 30


def predict(epochs: DataFrame, conditions: tuple[str, ...] = ("EC", "EO"), most: int = EPOCHS_PER_CONDITION, order: tuple[str, ...] = ("epoch",)) -> DataFrame:
    """(subject_id, status, detail, prediction, confidence, p_adhd, n_epochs): one answer a subject of epochs (subject_id, condition, prob, ...).

    At most ``most`` epochs of each condition count, spread evenly over the recording (positions truncated). A subject
    that lacks a condition is a row with status ``failed``; other conditions are left out.
    """
    held = epochs.filter(F.col("condition").isin(list(conditions)))
    picked = sample_rows(held, list(order), most, "subject_id", "condition", truncate=True)
    means = picked.groupBy("subject_id").agg(F.avg("prob").alias("p"), F.count("*").alias("n"), F.collect_set("condition").alias("have"))
    rows = epochs.select("subject_id").distinct().join(means, "subject_id", "left")
    lacking = F.array_except(F.array(*map(F.lit, conditions)), F.coalesce("have", F.array().cast("array<string>")))
    rows = rows.withColumn("lacking", lacking).withColumn("ok", F.size("lacking") == 0)
    given = lambda c: F.when(F.col("ok"), c)
    p = F.col("p")
    return rows.select(
        "subject_id",
        F.when(F.col("ok"), "ok").otherwise("failed").alias("status"),
        F.when(~F.col("ok"), F.concat(F.lit("no epochs of "), F.array_join("lacking", ", "))).alias("detail"),
        given(F.when(p >= 0.5, "ADHD").otherwise("Control")).alias("prediction"),
        given(F.greatest(p, 1 - p)).alias("confidence"),
        given(p).alias("p_adhd"),
        given(F.col("n")).alias("n_epochs"),
    )


def strip_means(rows: Column, strips: int = len(STRIPS)) -> Column:
    """Means of an image's horizontal strips, from the means of its rows: strips of len // strips rows, the rest belongs to none."""
    height = F.floor(F.size(rows) / strips).cast("int")
    total = lambda i: F.aggregate(F.slice(rows, i * height + 1, height), F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.sequence(F.lit(0), F.lit(strips - 1)), lambda i: F.try_divide(total(i), height))


def plausibility(attention: DataFrame, *keys: str) -> DataFrame:
    """(keys, task, hypothesis, frontal_mean, central_parietal_mean, other_mean, matches) of rows (keys, task, channel, value).

    The expected site must exceed the other, and all other channels where there are any. A finding, not a verdict; an
    unknown task raises, and a site without channels is null and does not match.
    """
    frontal, central = F.col("channel").isin(FRONTAL), F.col("channel").isin(CENTRAL_PARIETAL)
    mean = lambda c: F.avg(F.when(c, F.col("value")))
    sites = attention.groupBy(*keys, "task").agg(mean(frontal).alias("frontal_mean"), mean(central).alias("central_parietal_mean"), mean(~frontal & ~central).alias("other_mean"))
    known = F.coalesce(*[F.when(F.col("task") == t, h) for t, h in EXPECTED.items()], F.raise_error(F.concat(F.lit("no hypothesis for task "), F.col("task"))).cast("string"))
    f, c, o = (F.col(n) for n in ("frontal_mean", "central_parietal_mean", "other_mean"))
    best = F.when(F.col("hypothesis") == "frontal", (f > c) & (o.isNull() | (f > o))).otherwise((c > f) & (o.isNull() | (c > o)))
    return sites.withColumn("hypothesis", known).withColumn("matches", F.coalesce(best, F.lit(False))).select(*keys, "task", "hypothesis", "frontal_mean", "central_parietal_mean", "other_mean", "matches")
