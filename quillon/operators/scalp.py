"""Scalp maps: values at electrodes spread over a grid by inverse distance, with a table of weights of fixed size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RING = {"Fp2": 18, "F8": 54, "T4": 90, "T6": 126, "O2": 162, "O1": 198, "T5": 234, "T3": 270, "F7": 306, "Fp1": 342}


def positions() -> dict[str, tuple[float, float]]:
    """Electrodes in a head of radius 1, nose up: a ring in steps of 36 degrees, the midline, and half-way points."""
    at = {c: (0.8 * math.sin(math.radians(a)), 0.8 * math.cos(math.radians(a))) for c, a in _RING.items()}
    at |= {"Fz": (0.0, 0.4), "Cz": (0.0, 0.0), "Pz": (0.0, -0.4), "C3": (-0.4, 0.0), "C4": (0.4, 0.0)}
    for c, (p, q) in {"F3": ("F7", "Fz"), "F4": ("F8", "Fz"), "P3": ("T5", "Pz"), "P4": ("T6", "Pz")}.items():
        at[c] = ((at[p][0] + at[q][0]) / 2, (at[p][1] + at[q][1]) / 2)
    return at


def weights(spark: SparkSession, size: int) -> DataFrame:
    """(channel, y, x, w) for each electrode and each pixel inside the head: the inverse fourth power of their distance."""
    places = F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(u).alias("u"), F.lit(v).alias("v")) for c, (u, v) in positions().items()])
    pixels = spark.range(size * size).select(F.floor(F.col("id") / size).cast("int").alias("y"), (F.col("id") % size).cast("int").alias("x"))
    u, v = (F.col("x") + 0.5) / size * 2 - 1, 1 - (F.col("y") + 0.5) / size * 2
    inside = pixels.withColumns({"pu": u, "pv": v}).filter(F.col("pu") * F.col("pu") + F.col("pv") * F.col("pv") <= 1).withColumn("e", F.explode(places))
    du, dv = F.col("pu") - F.col("e.u"), F.col("pv") - F.col("e.v")
    d2 = du * du + dv * dv + 1e-4
    return inside.select("e.channel", "y", "x", (1 / (d2 * d2)).alias("w"))


def grid(values: DataFrame, size: int, *keys: str, value: str = "value") -> DataFrame:
    """(keys, y, x, level): maps of ``values`` (keys, channel, value), each scaled by its own least and largest value to 0..1.

    Null values and unknown channels take no part, so a map without some electrodes is spread from the others; a map
    of equal values is 0. The weights are broadcast: size squared times 19 rows.
    """
    held = values.filter(F.col(value).isNotNull() & F.col("channel").isin(list(positions()))).select(*keys, "channel", F.col(value).cast("double").alias("__v"))
    ends = held.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    sums = held.join(F.broadcast(weights(values.sparkSession, size)), "channel").groupBy(*keys, "y", "x").agg((F.sum(F.col("w") * F.col("__v")) / F.sum("w")).alias("__m"))
    span = F.when(F.col("__hi") > F.col("__lo"), F.col("__hi") - F.col("__lo")).otherwise(1.0)
    return sums.join(ends, list(keys)).select(*keys, "y", "x", ((F.col("__m") - F.col("__lo")) / span).alias("level"))
