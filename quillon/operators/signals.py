"""Windows, rejection and spectra of array signals.

The native spectrum joins samples with a table of cosines whose size depends on the window alone;
``welch_arrow`` is the FFT path for long windows, and both agree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windows(samples: str, length: int, step: int | None = None, least: int = 0, strict: bool = False) -> Column:
    """Whole windows as an array of (window, samples); the rest at the end is left out.

    A signal with fewer than ``least`` windows has none or, if ``strict``, is an error when read.
    """
    step = step or length
    n = F.size(samples)
    starts = F.when(n >= length, F.sequence(F.lit(0), F.floor((n - length) / step).cast("int"))).otherwise(F.array().cast("array<int>"))
    if least:
        few = F.raise_error(F.concat(F.lit("too few windows: "), F.size(starts).cast("string"))).cast("array<int>") if strict else F.array().cast("array<int>")
        starts = F.when(F.size(starts) >= least, starts).otherwise(few)
    return F.transform(starts, lambda i: F.struct(i.alias("window"), F.slice(samples, i * step + 1, length).alias("samples")))


def explode_windows(signals: DataFrame, length: int, step: int | None = None, *keys: str, least: int = 0, strict: bool = False) -> DataFrame:
    return signals.select(*keys, F.explode(windows("samples", length, step, least, strict)).alias("__w")).select(*keys, "__w.window", "__w.samples")


def peak_to_peak(samples: str = "samples") -> Column:
    return F.array_max(samples) - F.array_min(samples)


def even_stride(n: Column, cap: int) -> Column:
    """Indices of at most ``cap`` of n rows, spread evenly, rounded half to even; all if n <= cap."""
    step = (n - 1) / F.lit(max(1, cap - 1)).cast("double")
    picked = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda i: F.bround(i * step).cast("int"))
    return F.when(n <= cap, F.sequence(F.lit(0), n - 1)).otherwise(picked)


def even_stride_truncated(n: Column, cap: int) -> Column:
    """As ``even_stride``, but truncated: other rows."""
    step = (n - 1) / F.lit(max(1, cap - 1)).cast("double")
    picked = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda i: F.floor(i * step).cast("int"))
    return F.when(n <= cap, F.sequence(F.lit(0), n - 1)).otherwise(picked)


def sample_rows(rows: DataFrame, order: list[str], cap: int, *keys: str, truncate: bool = False) -> DataFrame:
    """Evenly spread rows of each group, at most ``cap``; a join on positions, so it lies before heavy work."""
    from pyspark.sql import Window

    at = rows.withColumn("pos", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("int"))
    n = rows.groupBy(*keys).agg(F.count("*").cast("int").alias("__n"))
    chosen = n.select(*keys, F.explode(F.array_distinct((even_stride_truncated if truncate else even_stride)(F.col("__n"), cap))).alias("pos"))
    return at.join(chosen, [*keys, "pos"])


def decimate(samples: str, k: int) -> Column:
    return F.filter(samples, lambda x, i: i % k == 0)


def reject(epochs: DataFrame, reject_above: float | None, flat_below: float | None, *keys: str) -> DataFrame:
    """Per epoch (``keys``): its worst peak-to-peak, whether it is kept, and the channels that reject it."""
    p2p = peak_to_peak()
    bad = F.lit(False)
    if reject_above is not None:
        bad = bad | (p2p > reject_above)
    if flat_below is not None:
        bad = bad | (p2p < flat_below)
    return epochs.groupBy(*keys).agg(F.max(p2p).alias("worst"), (~F.bool_or(bad)).alias("kept"), F.array_sort(F.collect_set(F.when(bad, F.col("channel")))).alias("culprits"))


def rejection_rate(epochs: DataFrame, *keys: str) -> DataFrame:
    counts = epochs.groupBy(*keys).agg(F.count("*").alias("n_events"), F.sum(F.col("kept").cast("long")).alias("n_kept"))
    return counts.withColumn("rate", 1 - F.col("n_kept") / F.col("n_events"))


def keep_rates(epochs: DataFrame, thresholds: list[float], *keys: str) -> DataFrame:
    """Share of epochs whose worst peak-to-peak is at most each threshold."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    rows = epochs.select(*keys, "worst", grid)
    return rows.groupBy(*keys, "threshold").agg(F.avg((F.col("worst") <= F.col("threshold")).cast("double")).alias("keep_rate"))


def _twiddles(spark, n: int) -> DataFrame:
    """(n, k, window times cosine, window times sine) of a periodic Hann window: n * (n / 2 + 1) rows."""
    i = F.col("i").cast("double")
    hann = 0.5 - 0.5 * F.cos(2 * math.pi * i / n)
    rows = spark.range(n).select(F.col("id").cast("int").alias("i")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n // 2))))
    angle = 2 * math.pi * F.col("k") * i / n
    return rows.select("i", "k", (hann * F.cos(angle)).alias("c"), (hann * F.sin(angle)).alias("s"))


def welch(signals: DataFrame, fs: float, nperseg: int, *keys: str) -> DataFrame:
    """(keys, k, freq, psd): Hann windows, half overlap, constant detrend, one-sided density, mean of segments."""
    spark = signals.sparkSession
    segments = explode_windows(signals, nperseg, nperseg // 2, *keys)
    mean = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x) / nperseg
    rows = segments.withColumn("__m", mean).select(*keys, "window", "__m", F.posexplode("samples").alias("i", "x")).withColumn("y", F.col("x") - F.col("__m"))
    power = sum((0.5 - 0.5 * math.cos(2 * math.pi * i / nperseg)) ** 2 for i in range(nperseg))
    sums = rows.join(F.broadcast(_twiddles(spark, nperseg)), "i").groupBy(*keys, "window", "k").agg(F.sum(F.col("y") * F.col("c")).alias("re"), F.sum(F.col("y") * F.col("s")).alias("im"))
    one = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (fs * power)
    doubled = F.when((F.col("k") == 0) | (F.col("k") == nperseg // 2), one).otherwise(2 * one)
    return sums.groupBy(*keys, "k").agg(F.avg(doubled).alias("psd")).select(*keys, "k", (F.col("k") * fs / nperseg).alias("freq"), "psd")


def welch_numpy(x: np.ndarray, fs: float, nperseg: int) -> np.ndarray:
    """Spectra of rows of x (rows x bins)."""
    step = nperseg // 2
    segments = np.lib.stride_tricks.sliding_window_view(x, nperseg, axis=-1)[..., ::step, :]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)
    spectrum = np.fft.rfft((segments - segments.mean(axis=-1, keepdims=True)) * window, axis=-1)
    psd = (spectrum.real**2 + spectrum.imag**2) / (fs * (window**2).sum())
    psd[..., 1 : -1 if nperseg % 2 == 0 else None] *= 2
    return psd.mean(axis=-2)


def welch_arrow(signals: DataFrame, fs: float, nperseg: int, *keys: str) -> DataFrame:
    """(keys, psd array) by FFT; signals shorter than a window have a null spectrum."""

    @F.pandas_udf("array<double>")
    def spectra(samples: pd.Series) -> pd.Series:
        return samples.map(lambda v: welch_numpy(np.asarray(v, float)[None, :], fs, nperseg)[0] if v is not None and len(v) >= nperseg else None)

    return signals.select(*keys, spectra("samples").alias("psd"))


def trapezoid(spectrum: DataFrame, low: float, high: float, *keys: str) -> DataFrame:
    """Integral of psd over the closed band; null with fewer than two bins. One aggregate, no window: bins are evenly spaced."""
    inside = spectrum.filter(F.col("freq").between(low, high))
    ends = inside.groupBy(*keys).agg(F.sum("psd").alias("__s"), F.min_by("psd", "k").alias("__a"), F.max_by("psd", "k").alias("__b"), F.count("*").alias("bins"), F.min("freq").alias("__l"), F.max("freq").alias("__h"))
    df = F.try_divide(F.col("__h") - F.col("__l"), (F.col("bins") - 1).cast("double"))
    return ends.select(*keys, "bins", F.when(F.col("bins") >= 2, df * (F.col("__s") - (F.col("__a") + F.col("__b")) / 2)).alias("power"))


def band_powers(spectrum: DataFrame, bands: dict[str, tuple[float, float]], *keys: str) -> DataFrame:
    """Trapezoid and mean power of each band in one pass; bands share their edges, so a bin may count in two."""
    named = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for b, (lo, hi) in bands.items()])
    rows = spectrum.withColumn("__b", F.explode(F.filter(named, lambda b: F.col("freq").between(b["lo"], b["hi"])))).withColumn("band", F.col("__b.band"))
    wide = trapezoid(rows, -math.inf, math.inf, *keys, "band")
    return wide.join(rows.groupBy(*keys, "band").agg(F.avg("psd").alias("mean_power")), [*keys, "band"])


def edges(rows: DataFrame, level: Column, order: str, *keys: str) -> DataFrame:
    """Pulses of a boolean level: start and end of each run of true, by position, with its length."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("__on", level).withColumn("__rise", F.col("__on") & ~F.coalesce(F.lag("__on").over(w), F.lit(False)))
    runs = marked.withColumn("__run", F.sum(F.col("__rise").cast("long")).over(w)).filter("__on")
    return runs.groupBy(*keys, F.col("__run").alias("pulse")).agg(F.min(order).alias("start"), F.max(order).alias("stop")).withColumn("duration", F.col("stop") - F.col("start") + 1)


def average_reference(signals: DataFrame, *keys: str) -> DataFrame:
    """Each sample minus the mean over channels at its time."""
    rows = signals.select(*keys, "channel", F.posexplode("samples").alias("__i", "__x"))
    mean = rows.groupBy(*keys, "__i").agg(F.avg("__x").alias("__m"))
    centred = F.struct("__i", (F.col("__x") - F.col("__m")).alias("y"))
    out = rows.join(mean, [*keys, "__i"]).groupBy(*keys, "channel").agg(F.array_sort(F.collect_list(centred)).alias("__s"))
    return out.select(*keys, "channel", F.transform("__s", lambda s: s["y"]).alias("samples"))
