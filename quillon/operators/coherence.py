"""Imaginary coherence as joins and sums: tapered spectra from a table of fixed size, cross spectra by channel pair."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import dpss
from .signals import explode_windows


def tapers(spark: SparkSession, length: int, bins: list[int]) -> DataFrame:
    """(i, t, f, c, s): taper t times cosine and sine of bin f at sample i; as long as the window allows, whatever the data."""
    values = dpss(length)
    rows = F.array(*[F.struct(F.lit(t).alias("t"), F.array(*map(F.lit, v.tolist())).alias("v")) for t, v in enumerate(values)])
    cells = spark.range(1).select(F.explode(rows).alias("r")).select("r.t", F.posexplode("r.v").alias("i", "v"))
    angle = 2 * math.pi * F.col("f") * F.col("i") / length
    return cells.withColumn("f", F.explode(F.array(*map(F.lit, bins)))).select("i", "t", "f", (F.col("v") * F.cos(angle)).alias("c"), (F.col("v") * F.sin(angle)).alias("s"))


def imaginary_coherence(signals: DataFrame, fs: float, length: int, step: int, bands: dict[str, tuple[float, float]], *keys: str, least: int = 1) -> DataFrame:
    """(keys, a, b, band, value): as ``kernels.coherence_edges``, for every pair of channels, the first name before the second.

    A group with fewer than ``least`` windows has no rows, nor has a band without a bin.
    """
    bins = [k for k in range(length // 2 + 1) if any(lo <= k * fs / length <= hi for lo, hi in bands.values())]
    windows = explode_windows(signals, length, step, *keys, "channel")
    mean = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x) / length
    points = windows.withColumn("__m", mean).select(*keys, "channel", "window", "__m", F.posexplode("samples").alias("i", "x")).withColumn("y", F.col("x") - F.col("__m"))
    spectra = points.join(F.broadcast(tapers(signals.sparkSession, length, bins)), "i").groupBy(*keys, "channel", "window", "t", "f").agg(F.sum(F.col("y") * F.col("c")).alias("re"), (-F.sum(F.col("y") * F.col("s"))).alias("im"))
    # windows and tapers of a channel side by side, in order, so that a pair is a join by bin and two products
    side = spectra.groupBy(*keys, "f", "channel").agg(F.sort_array(F.collect_list(F.struct("window", "t", "re", "im"))).alias("v"), F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p"), F.countDistinct("window").alias("w")).filter(F.col("w") >= max(1, least))
    a = side.select(*keys, "f", F.col("channel").alias("a"), F.col("v").alias("va"), F.col("p").alias("pa"))
    b = side.select(*keys, "f", F.col("channel").alias("b"), F.col("v").alias("vb"), F.col("p").alias("pb"))
    cross = F.aggregate(F.zip_with("va", "vb", lambda x, y: x["im"] * y["re"] - x["re"] * y["im"]), F.lit(0.0), lambda s, x: s + x)
    pairs = a.join(b, [*keys, "f"]).filter("a < b").select(*keys, "a", "b", "f", F.abs(cross / F.sqrt(F.greatest(F.col("pa") * F.col("pb"), F.lit(1e-300)))).alias("q"))
    named = F.array(*[F.struct(F.lit(n).alias("band"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for n, (lo, hi) in bands.items()])
    freq = F.col("f") * fs / length
    return pairs.withColumn("band", F.explode(F.transform(F.filter(named, lambda n: freq.between(n["lo"], n["hi"])), lambda n: n["band"]))).groupBy(*keys, "a", "b", "band").agg(F.avg("q").alias("value"))
