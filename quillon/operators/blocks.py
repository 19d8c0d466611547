"""Long recordings as rows of samples: filters with a halo, and component analysis from sums over blocks.

A row has keys, ``channel``, ``start`` (its first sample's number) and ``samples``; rows of any length may follow each
other. Work goes by blocks of ``size`` samples, whatever the rows' cuts, so a recording of any length spreads over
tasks and none holds more than a block of it with its halo.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialise
from . import kernels
from .sums import arrays, each, lists, partial, sum_arrays

#: States of recordings are broadcast up to this many bytes, and joined by shuffle beyond.
BROADCAST_BYTES = 32 << 20


def extended(rows: DataFrame, size: int, halo: int, *keys: str) -> DataFrame:
    """(keys, channel, block, start, samples): each block of ``size`` samples with up to ``halo`` more at each side.

    One shuffle, of every sample once and of the halos again. A gap in a recording, or samples given twice, raise.
    """
    n = F.size("samples")
    held = rows.filter(n > 0)
    first = F.greatest(F.floor((F.col("start") - halo) / size), F.lit(0))
    last = F.floor((F.col("start") + n - 1 + halo) / size)
    dealt = held.select(*keys, "channel", "start", "samples", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * size - halo)
    high = F.least(F.col("start") + n, (F.col("block") + 1) * size + halo)
    part = F.struct(low.alias("start"), F.slice("samples", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("samples"))
    parts = dealt.select(*keys, "channel", "block", part.alias("part")).groupBy(*keys, "channel", "block").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    whole = parts.select(*keys, "channel", "block", F.col("parts")[0]["start"].alias("start"), F.flatten(F.transform("parts", lambda p: p["samples"])).alias("samples"), F.element_at("parts", -1).alias("end"))
    end = F.col("end")["start"] + F.size(F.col("end")["samples"])
    begins = F.col("start") == F.greatest(F.col("block") * size - halo, F.lit(0))
    even = F.when(begins & (end - F.col("start") == F.size("samples")), F.col("samples")).otherwise(F.raise_error(F.concat(F.lit("a recording has a gap or an overlap near block "), F.col("block").cast("string"))))
    # a block behind the end has a halo only
    return whole.filter(end > F.col("block") * size).select(*keys, "channel", "block", "start", even.alias("samples"))


def map_blocks(rows: DataFrame, run, size: int, halo: int, *keys: str) -> DataFrame:
    """Rows (keys, channel, start, samples) of what ``run`` makes of each block with its halo, cut back to the block."""
    given = extended(rows, size, halo, *keys)

    def blocks(batches):
        for batch in batches:
            out, starts = [], []
            for x, block, start in zip(arrays(batch.column("samples")), batch.column("block").to_pylist(), batch.column("start").to_pylist(), strict=True):
                own = block * size
                out.append(run(x)[own - start : own - start + size])
                starts.append(own)
            columns = [*[batch.column(k) for k in keys], batch.column("channel"), pa.array(starts, pa.int64()), lists(out)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "channel", "start", "samples"])

    types = dict(given.dtypes)
    return given.mapInArrow(blocks, ", ".join(f"`{c}` {types[c]}" for c in (*keys, "channel")) + ", start long, samples array<double>")


def filtered(rows: DataFrame, taps: list[tuple[np.ndarray, bool]], size: int, *keys: str) -> DataFrame:
    """Zero-phase filters one after the other, each (taps, subtract): as of whole recordings, mirrored at their ends.

    A filter reaches half its taps, so what a block's cut ends spoil lies in the halo and goes.
    """

    def run(x: np.ndarray) -> np.ndarray:
        for h, subtract in taps:
            y = kernels.zero_phase(x, h)
            x = x - y if subtract else y
        return x

    return map_blocks(rows, run, size, sum(len(h) // 2 for h, _ in taps), *keys)


def band_pass(rows: DataFrame, fs: float, size: int, *keys: str, low: float = 0.5, high: float = 50.0, notch: float | None = 50.0) -> DataFrame:
    """``kernels.band_pass`` by blocks."""
    taps = [(kernels.fir(fs, low, min(high, fs / 2 * 0.95), transition=min(2 * low, 1.0)), False)]
    if notch is not None and notch < fs / 2 - 1:
        taps.append((kernels.fir(fs, notch - 1, notch + 1, transition=1.0), True))
    return filtered(rows, taps, size, *keys)


# --- components -------------------------------------------------------------------------------


def matrices(rows: DataFrame, channels: list[str], *keys: str) -> DataFrame:
    """(keys, start, x): the samples of all channels over the same rows, channel after channel in the given order.

    Where a row has not all of the channels, or they differ in length, it raises.
    """
    place = F.array_position(F.array(*map(F.lit, channels)), F.col("channel"))
    found = rows.filter(F.col("channel").isin(channels)).groupBy(*keys, "start").agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), "samples"))).alias("c"))
    lengths = F.array_distinct(F.transform("c", lambda c: F.size(c["samples"])))
    fits = (F.size("c") == len(channels)) & (F.size(lengths) == 1)
    flat = F.flatten(F.transform("c", lambda c: c["samples"]))
    return found.select(*keys, "start", F.when(fits, flat).otherwise(F.raise_error(F.concat(F.lit("channels differ at sample "), F.col("start").cast("string")))).alias("x"))


def moments(blocks: DataFrame, channels: int, *keys: str) -> DataFrame:
    """(keys, sums): count, sums and products of all channels, of whole recordings."""

    def run(x):
        x = x.reshape(channels, -1)
        return np.concatenate(([x.shape[1]], x.sum(axis=1), (x @ x.T).ravel()))

    return sum_arrays(partial(blocks.select(*keys, "x"), run, *keys), "sums", *keys)


def _covariance(sums: np.ndarray, channels: int) -> tuple[float, np.ndarray, np.ndarray]:
    n, mean = sums[0], sums[1 : channels + 1] / sums[0]
    return n, mean, (sums[channels + 1 :].reshape(channels, channels) - n * np.outer(mean, mean)) / (n - 1)


def _orthogonal(a: np.ndarray) -> np.ndarray:
    u, _, t = np.linalg.svd(a, full_matrices=False)
    return u @ t


def _joined(blocks: DataFrame, state: DataFrame, row_bytes: int, *keys: str) -> DataFrame:
    """Blocks with their recording's state; broadcast only where its size allows it."""
    return blocks.join(F.broadcast(state) if state.count() * row_bytes <= BROADCAST_BYTES else state, list(keys))


def ica(blocks: DataFrame, channels: int, *keys: str, components: int | None = None, seed: int = 42, steps: int = 400, tolerance: float = 1e-6) -> DataFrame:
    """(keys, n, mean, covariance, unmixing, mixing): ``kernels.ica`` of every recording, all at once, from sums.

    Whitening comes from second moments. A step of the fixed-point iteration is one pass that adds up its
    expectations by block; recordings that have settled drop out. Nothing larger than channels squared is kept for
    a recording, and each step's state is a table of the shared folder.
    """

    def start(sums):
        n, mean, cov = _covariance(sums, channels)
        w, v = np.linalg.eigh(cov)
        keep = np.argsort(-w)[: components or channels]
        keep = keep[w[keep] > w.max() * 1e-12]
        white = (v[:, keep] / np.sqrt(w[keep])).T
        b = _orthogonal(np.random.default_rng(seed).standard_normal((len(keep), len(keep))))
        return {"n": n, "mean": mean, "covariance": cov.ravel(), "white": white.ravel(), "b": b.ravel(), "done": False}

    schema = "n double, mean array<double>, covariance array<double>, white array<double>, b array<double>, done boolean"
    state = materialise(each(moments(blocks, channels, *keys), start, schema, *keys), "ica")
    size = 8 * 3 * channels * channels + 256

    def expectations(x, mean, white, b):
        k = int(np.sqrt(len(b)))
        b, z = b.reshape(k, k), white.reshape(k, channels) @ (x.reshape(channels, -1) - mean[:, None])
        g = np.tanh(b @ z)
        return np.concatenate(((g @ z.T).ravel(), (1 - g * g).sum(axis=1)))

    def step(n, mean, covariance, white, b, done, sums):
        k = int(np.sqrt(len(b)))
        old = b.reshape(k, k)
        new = _orthogonal(sums[: k * k].reshape(k, k) / n - (sums[k * k :] / n)[:, None] * old)
        return {"n": n, "mean": mean, "covariance": covariance, "white": white, "b": new.ravel(), "done": bool(np.abs(np.abs((new * old).sum(axis=1)) - 1).max() < tolerance)}

    for _ in range(steps):
        left = state.filter("NOT done")
        if not left.limit(1).count():
            break
        sums = sum_arrays(partial(_joined(blocks.select(*keys, "x"), left.select(*keys, "mean", "white", "b"), size, *keys), expectations, *keys), "sums", *keys)
        moved = each(left.join(sums, list(keys)), step, schema, *keys)
        state = materialise(state.filter("done").unionByName(moved), "ica")

    def matrices_of(n, mean, covariance, white, b, done):
        k = int(np.sqrt(len(b)))
        unmixing = b.reshape(k, k) @ white.reshape(k, channels)
        return {"n": n, "mean": mean, "covariance": covariance, "unmixing": unmixing.ravel(), "mixing": np.linalg.pinv(unmixing).ravel()}

    return each(state, matrices_of, "n double, mean array<double>, covariance array<double>, unmixing array<double>, mixing array<double>", *keys)


def detectors(rows: DataFrame, fitted: DataFrame, channels: list[str], proxies: list[str], fs: float, size: int, *keys: str, nperseg: int = 512) -> DataFrame:
    """(keys, eog, muscle): scores of every component, as ``kernels.eog_scores`` and ``kernels.muscle_scores``.

    Correlations with the proxies follow from the covariances; the sources' spectra are sums over segments, each
    counted in the block where it begins. ``nperseg`` is even and no longer than the recordings.
    """
    step, c = nperseg // 2, len(channels)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)
    wide = extended(rows, size, nperseg, *keys).withColumnRenamed("start", "low").withColumnRenamed("block", "start")
    blocks = matrices(wide.select(*keys, "channel", "start", "samples"), channels, *keys).withColumnRenamed("start", "block")

    def spectra(x, block, unmixing):
        w = unmixing.reshape(-1, c)
        x = x.reshape(c, -1)
        own = block * size
        low = max(0, own - nperseg)
        starts = np.arange(-(-own // step) * step, own + size, step) - low
        starts = starts[starts + nperseg <= x.shape[1]]
        y = w @ x
        cut = np.stack([y[:, s : s + nperseg] for s in starts]) if len(starts) else np.zeros((0, len(w), nperseg))
        power = np.abs(np.fft.rfft((cut - cut.mean(axis=-1, keepdims=True)) * window, axis=-1)) ** 2
        return np.concatenate(([len(starts)], power.sum(axis=0).ravel()))

    state = fitted.select(*keys, "unmixing")
    sums = sum_arrays(partial(_joined(blocks, state, 8 * c * c + 256, *keys), spectra, *keys), "sums", *keys)
    at = [channels.index(p) for p in proxies if p in channels]

    def scores(covariance, unmixing, sums):
        w, cov = unmixing.reshape(-1, c), covariance.reshape(c, c)
        own = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", w, cov, w), 1e-300))
        eog = np.abs(w @ cov[:, at] / own[:, None] / np.sqrt(np.maximum(np.diag(cov)[at], 1e-300))).max(axis=1) if at else np.zeros(len(w))
        psd = sums[1:].reshape(len(w), -1) / max(1.0, sums[0])
        psd[:, 1:-1] *= 2
        f = np.arange(psd.shape[1]) * fs / nperseg
        use = (f >= 7) & (f <= 45)
        slope = np.polyfit(np.log(f[use]), np.log(np.maximum(psd[:, use] / (fs * (window**2).sum()), 1e-300)).T, 1)[0]
        return {"eog": eog, "muscle": 1 / (1 + np.exp(-2 * slope))}

    return each(fitted.select(*keys, "covariance", "unmixing").join(sums, list(keys)), scores, "eog array<double>, muscle array<double>", *keys)


def remove(blocks: DataFrame, fitted: DataFrame, bad: DataFrame, channels: list[str], *keys: str) -> DataFrame:
    """(keys, channel, start, samples) without the components that ``bad`` (keys, bad: array of int) names; recordings that it lacks stay."""
    c = len(channels)
    state = fitted.select(*keys, "mean", "unmixing", "mixing").join(bad.select(*keys, "bad"), list(keys), "left").withColumn("bad", F.coalesce("bad", F.array().cast("array<int>")))
    joined = _joined(blocks.select(*keys, "start", "x"), state, 8 * 3 * c * c + 256, *keys)
    types = dict(joined.dtypes)

    def clean(batches):
        for batch in batches:
            columns = {n: arrays(batch.column(n)) for n in ("x", "mean", "unmixing", "mixing", "bad")}
            out = []
            for i in range(batch.num_rows):
                x, w = columns["x"][i].reshape(c, -1), columns["unmixing"][i].reshape(-1, c)
                gone = columns["bad"][i].astype(int)
                out += list(x - columns["mixing"][i].reshape(c, -1)[:, gone] @ (w[gone] @ (x - columns["mean"][i][:, None])))
            times = pa.array(np.repeat(np.arange(batch.num_rows), c))
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(times) for k in keys], pa.array(channels * batch.num_rows, pa.string()), batch.column("start").take(times), lists(out)], names=[*keys, "channel", "start", "samples"])

    return joined.mapInArrow(clean, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", channel string, start long, samples array<double>")


# --- spectra, parts and whole recordings ----------------------------------------------------------


def welch(rows: DataFrame, fs: float, nperseg: int, size: int, *keys: str) -> DataFrame:
    """(keys, channel, psd): ``signals.welch_numpy`` of whole recordings, each segment summed in the block where it begins.

    A recording shorter than a segment has no row.
    """
    step = nperseg // 2
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)

    def periodograms(samples, block, start):
        own = block * size
        at = np.arange(-(-own // step) * step, own + size, step) - start
        at = at[at + nperseg <= len(samples)]
        cut = np.stack([samples[a : a + nperseg] for a in at]) if len(at) else np.zeros((0, nperseg))
        power = np.abs(np.fft.rfft((cut - cut.mean(axis=-1, keepdims=True)) * window, axis=-1)) ** 2
        return np.concatenate(([len(at)], power.sum(axis=0)))

    sums = sum_arrays(partial(extended(rows, size, nperseg, *keys), periodograms, *keys, "channel"), "sums", *keys, "channel")
    scale = [(1.0 if k == 0 or (k == nperseg // 2 and nperseg % 2 == 0) else 2.0) / (fs * float((window**2).sum())) for k in range(nperseg // 2 + 1)]
    psd = F.zip_with(F.slice("sums", 2, nperseg // 2 + 1), F.array(*map(F.lit, scale)), lambda p, c: p * c / F.col("sums")[0])
    return sums.filter(F.col("sums")[0] > 0).select(*keys, "channel", psd.alias("psd"))


def part(rows: DataFrame, low: str, high: str) -> DataFrame:
    """The samples from ``low`` to before ``high`` (columns of ``rows``), numbered from 0 again."""
    n = F.size("samples")
    a, b = F.greatest(F.col("start"), F.col(low)), F.least(F.col("start") + n, F.col(high))
    cut = F.slice("samples", (a - F.col("start") + 1).cast("int"), (b - a).cast("int"))
    return rows.filter((F.col("start") + n > F.col(low)) & (F.col("start") < F.col(high))).withColumns({"samples": cut, "start": (a - F.col(low)).cast("long")})


def prepare(rows: DataFrame, channels: list[str], fs: float, *keys: str, size: int, boundaries: DataFrame | None = None, settings=None) -> tuple[DataFrame, DataFrame]:
    """(statuses, epochs) of rest recordings, as ``recordings.prepare`` has them, without a recording in one task.

    Filter, component removal, cut by condition and epoch rejection go block by block; what a recording needs as a
    whole are sums. boundaries: (keys, boundary_frac) of trusted cuts; a cut that leaves too little, or none, is the
    middle. Recordings are of one rate and hold all ``channels``, and their parts last a spectrum segment at least.
    """
    from .. import schemas
    from . import recordings as whole

    s = settings or whole.Settings()
    clean = materialise(band_pass(rows.filter(F.col("channel").isin(channels)), fs, size, *keys, low=s.low, high=s.high, notch=s.notch), "filtered")
    fit = materialise(filtered(clean, [(kernels.fir(fs, 1.0, None), False)], size, *keys), "high-passed")
    fitted = materialise(ica(materialise(matrices(fit, channels, *keys), "matrices"), len(channels), *keys, steps=s.ica_steps), "fitted")
    scores = detectors(fit, fitted, channels, schemas.SCALP_REGIONS["frontopolar"], fs, size, *keys)

    def bad(mixing, eog, muscle):
        gone, capped, n = whole.choose(eog, muscle, mixing.reshape(len(channels), -1), channels, s)
        return {"bad": gone, "n_excluded": len(gone), "n_muscle": n, "capped": capped}

    chosen = materialise(each(fitted.select(*keys, "mixing").join(scores, list(keys)), bad, "bad array<int>, n_excluded int, n_muscle int, capped boolean", *keys), "chosen")
    m = materialise(matrices(clean, channels, *keys), "matrices")
    # components are taken from the filtered signal about its own mean
    mean = moments(m, len(channels), *keys).select(*keys, F.col("sums")[0].cast("long").alias("n"), F.transform(F.slice("sums", 2, len(channels)), lambda v: v / F.col("sums")[0]).alias("mean"))
    cleaned = materialise(remove(m, fitted.drop("mean", "n").join(mean, list(keys)), chosen, channels, *keys), "cleaned")

    trim = int(s.trim_s * fs)
    given = mean.select(*keys, "n")
    given = given.join(boundaries.select(*keys, "boundary_frac"), list(keys), "left") if boundaries is not None else given.withColumn("boundary_frac", F.lit(None).cast("double"))
    cut = F.bround(F.col("boundary_frac") * F.col("n")).cast("long")
    fits = (cut > trim) & (cut < F.col("n") - trim)
    cuts = given.select(*keys, "n", F.when(fits, cut).otherwise(F.floor(F.col("n") / 2)).alias("cut"), F.when(fits, "detected").otherwise("midpoint").alias("split_rule"))
    cuts = materialise(cuts.withColumns({"a0": F.lit(trim).cast("long"), "b1": F.col("n") - trim}), "cuts")

    # occipital alpha before and after the cut
    nperseg = int(4 * fs)
    o = cleaned.filter(F.col("channel").isin(schemas.SCALP_REGIONS["occipital"])).groupBy(*keys, "start").agg(F.sort_array(F.collect_list(F.struct("channel", "samples"))).alias("c"))
    total = F.aggregate("c", F.transform(F.col("c")[0]["samples"], lambda v: F.lit(0.0)), lambda a, c: F.zip_with(a, c["samples"], lambda x, y: x + y))
    o = o.select(*keys, "start", F.transform(total, lambda v: v / F.size("c")).alias("samples")).join(cuts, list(keys))
    sides = part(o.withColumn("channel", F.lit("a")), "a0", "cut").unionByName(part(o.withColumn("channel", F.lit("b")), "cut", "b1"))
    bins = [k for k in range(nperseg // 2 + 1) if 8 <= k * fs / nperseg <= 12]
    psd = welch(sides.select(*keys, "channel", "start", "samples"), fs, nperseg, -(-size // nperseg) * nperseg, *keys)
    alpha = psd.groupBy(*keys).pivot("channel", ["a", "b"]).agg(F.first(sum(F.col("psd")[k] for k in bins) / len(bins)))
    ratio = F.col("a") / F.col("b")
    halves = cuts.join(alpha, list(keys), "left").withColumn("alpha_ratio", ratio).drop("a", "b")
    vague = (F.col("alpha_ratio") > schemas.AMBIGUOUS[0]) & (F.col("alpha_ratio") < schemas.AMBIGUOUS[1])
    status = F.when(F.col("alpha_ratio").isNull(), "failed").when(F.lit(not s.include_ambiguous) & vague, "skipped_ambiguous").otherwise("ok")
    halves = materialise(halves.withColumns({"status": status, "boundary_frac": F.col("cut") / F.col("n"), "zero": F.lit(0).cast("long")}), "halves")

    # epochs of each side, numbered from its beginning
    named = cleaned.join(halves.filter("alpha_ratio IS NOT NULL").select(*keys, "zero", "cut", "n", "alpha_ratio"), list(keys))
    first = F.when(F.col("alpha_ratio") >= 1, "ec").otherwise("eo")
    second = F.when(F.col("alpha_ratio") >= 1, "eo").otherwise("ec")
    both = part(named.withColumn("condition", first), "zero", "cut").unionByName(part(named.withColumn("condition", second), "cut", "n"))
    length = int(s.epoch_s * fs)
    epochs = extended(both.select(*keys, "condition", "channel", "start", "samples"), length, 0, *keys, "condition").filter(F.size("samples") == length)
    p2p = (F.array_max("samples") - F.array_min("samples")) * 1e6
    fine = (p2p <= s.reject_uv if s.reject_uv is not None else F.lit(True)) & (p2p >= s.flat_uv if s.flat_uv is not None else F.lit(True))
    epochs = materialise(epochs.select(*keys, "condition", F.col("block").alias("epoch"), "channel", "samples", fine.alias("fine")), "epochs")
    kept = materialise(epochs.groupBy(*keys, "condition", "epoch").agg(F.min("fine").alias("kept")), "kept")
    c = lambda name: F.col("condition") == name
    count = lambda w: F.sum(w.cast("int"))
    counts = kept.groupBy(*keys).agg(F.count("*").cast("int").alias("n_events"), count(F.col("kept")).cast("int").alias("n_kept"), *[count(c(n) & F.col("kept")).cast("int").alias(f"n_{n}") for n in ("ec", "eo")], *[F.round(1 - F.try_divide(count(c(n) & F.col("kept")).cast("double"), count(c(n)).cast("double")), 4).alias(f"rej_{n}") for n in ("ec", "eo")])
    statuses = halves.select(*keys, "status", "alpha_ratio", "split_rule", "boundary_frac").join(chosen.drop("bad"), list(keys)).join(counts, list(keys), "left")
    good = epochs.join(kept.filter("kept").drop("kept"), [*keys, "condition", "epoch"]).join(halves.filter("status = 'ok'").select(*keys), list(keys), "left_semi")
    return statuses, good.select(*keys, "condition", "epoch", "channel", "samples")
