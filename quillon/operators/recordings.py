"""From raw recordings to kept epochs: filter, clean, split by condition, cut and reject, one recording per group.

A recording that fails, or whose halves can't be told apart, is a row with its status, never a failed
job: ``prepare`` returns epoch rows and one status row for each recording, and ``build_log`` joins these
to the subjects of a manifest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from . import kernels
from .signals import welch_numpy

PREPARED = "path string, status string, detail string, alpha_ratio double, split_rule string, boundary_frac double, n_excluded int, n_muscle int, capped boolean, n_events int, n_kept int, n_ec int, n_eo int, n_vcpt int, rej_ec double, rej_eo double, rej_vcpt double, condition string, epoch int, channel string, samples array<double>"


@dataclass(frozen=True)
class Settings:
    low: float = schemas.BAND_PASS_HZ[0]
    high: float = schemas.BAND_PASS_HZ[1]
    notch: float | None = schemas.NOTCH_HZ
    epoch_s: float = schemas.EPOCH_S
    reject_uv: float | None = schemas.REJECT_UV
    flat_uv: float | None = schemas.FLAT_UV
    max_excluded: int = schemas.MAX_EXCLUDED
    focality: float = schemas.FOCALITY
    muscle: float = schemas.MUSCLE_THRESHOLD
    eog: float = 0.8
    trim_s: float = schemas.BOUNDARY_TRIM_S
    fit_s: float | None = None
    ica_steps: int = 400
    include_ambiguous: bool = False


def peak_region(weights: np.ndarray, channels: list[str]) -> tuple[str | None, float]:
    """The region of the largest mean absolute weight, and that weight over the mean of all."""
    w = np.abs(weights)
    mean = {r: np.mean([w[channels.index(c)] for c in cs if c in channels]) for r, cs in schemas.SCALP_REGIONS.items() if any(c in channels for c in cs)}
    if not mean or w.mean() <= 0:
        return None, 0.0
    best = max(sorted(mean), key=lambda r: mean[r])
    return best, float(mean[best] / w.mean())


def choose(eog: np.ndarray, muscle: np.ndarray, mixing: np.ndarray, channels: list[str], s: Settings) -> tuple[list[int], bool, int]:
    """Components to remove by their scores (detected, capped with the strongest kept, then vetoed by where they peak), whether the cap cut, and the muscle ones found."""
    found = {int(i): "eog" for i in np.flatnonzero(eog > s.eog)}
    strong = [int(i) for i in np.argsort(-muscle, kind="stable") if muscle[i] > s.muscle and int(i) not in found]
    room = max(0, s.max_excluded - len(found))
    capped = len(strong) > room
    found |= {i: "muscle" for i in strong[:room]}
    keep = []
    for i, reason in found.items():
        region, focal = peak_region(mixing[:, i], channels)
        if region in schemas.PEAK_REGIONS[reason] and focal >= s.focality:
            keep.append(i)
    return sorted(keep), capped, len(strong)


def exclusions(sources: np.ndarray, mixing: np.ndarray, channels: list[str], x: np.ndarray, fs: float, s: Settings) -> tuple[list[int], bool, int]:
    """``choose`` with the scores of whole recordings."""
    proxies = [channels.index(c) for c in schemas.SCALP_REGIONS["frontopolar"] if c in channels]
    eog = kernels.eog_scores(sources, x[proxies]) if proxies else np.zeros(len(sources))
    return choose(eog, kernels.muscle_scores(sources, fs), mixing, channels, s)


def alpha_ratio(x: np.ndarray, channels: list[str], fs: float, cut: int, trim: int) -> float:
    """Occipital alpha of the part before the cut over that after, ends trimmed; an error where that leaves nothing of a part."""
    o = x[[channels.index(c) for c in schemas.SCALP_REGIONS["occipital"] if c in channels]].mean(axis=0)
    n = len(o)
    if not trim < cut < n - trim:
        raise ValueError(f"a cut at sample {cut} of {n} leaves nothing of a part after {trim} samples at each end")
    a, b = o[trim:cut], o[cut : n - trim]

    def alpha(v):
        size = int(min(4 * fs, len(v)))
        psd = welch_numpy(v[None, :], fs, size)[0]
        f = np.arange(len(psd)) * fs / size
        return psd[(f >= 8) & (f <= 12)].mean()

    return float(alpha(a) / alpha(b))


def halves(x: np.ndarray, channels: list[str], fs: float, fraction: float | None, s: Settings) -> tuple[int, float, bool]:
    """Sample of the cut, alpha ratio there, and whether the given fraction served; one that leaves too little falls back to the middle."""
    n, trim = x.shape[1], int(s.trim_s * fs)
    if fraction is not None:
        try:
            cut = round(fraction * n)
            return cut, alpha_ratio(x, channels, fs, cut, trim), True
        except ValueError:
            pass
    return n // 2, alpha_ratio(x, channels, fs, n // 2, trim), False


def process(frame: pd.DataFrame, fraction: float | None, task: bool, s: Settings) -> pd.DataFrame:
    """Rows of one recording; frame: channel, sfreq, signal in volts. Skipped recordings keep their diagnostics."""
    path = frame["path"].iloc[0]
    status = {"path": path, "status": "ok"}
    rows: list[dict] = []
    try:
        order = [c for c in schemas.CHANNELS if c in set(frame["channel"])]
        if len(order) < 2:
            raise ValueError(f"no usable channels: {frame['channel'].iloc[0]}")
        by = frame.drop_duplicates("channel").set_index("channel")
        fs = float(by["sfreq"].iloc[0])
        x = np.stack([np.asarray(by["signal"][c], float) for c in order])
        x = kernels.band_pass(x, fs, s.low, s.high, s.notch)
        fit = kernels.zero_phase(x, kernels.fir(fs, 1.0, None))[:, : None if s.fit_s is None else int(s.fit_s * fs)]
        unmixing, mixing = kernels.ica(fit, steps=s.ica_steps)
        bad, capped, n_muscle = exclusions(unmixing @ fit, mixing, order, fit, fs, s)
        x = kernels.remove_components(x, unmixing, mixing, bad)
        status |= {"n_excluded": len(bad), "n_muscle": n_muscle, "capped": capped}
        parts = {"vcpt": x}
        if not task:
            cut, ratio, given = halves(x, order, fs, fraction, s)
            status |= {"alpha_ratio": ratio, "split_rule": "detected" if given else "midpoint", "boundary_frac": cut / x.shape[1]}
            if schemas.AMBIGUOUS[0] < ratio < schemas.AMBIGUOUS[1] and not s.include_ambiguous:
                status["status"] = "skipped_ambiguous"
            first, second = x[:, :cut], x[:, cut:]
            parts = {"ec": first, "eo": second} if ratio >= 1 else {"ec": second, "eo": first}
        size, events, kept = int(s.epoch_s * fs), 0, 0
        for condition, part in parts.items():
            n = part.shape[1] // size
            p2p = np.ptp(part[:, : n * size].reshape(len(order), n, size), axis=2) * 1e6
            good = np.ones(n, bool)
            if s.reject_uv is not None:
                good &= (p2p <= s.reject_uv).all(axis=0)
            if s.flat_uv is not None:
                good &= (p2p >= s.flat_uv).all(axis=0)
            events, kept = events + n, kept + int(good.sum())
            status |= {f"n_{condition}": int(good.sum()), f"rej_{condition}": round(1 - float(good.mean()), 4) if n else None}
            if status["status"] == "ok":
                rows += [{"path": path, "condition": condition, "epoch": e, "channel": c, "samples": v} for e in np.flatnonzero(good).tolist() for c, v in zip(order, part[:, e * size : (e + 1) * size], strict=True)]
        status |= {"n_events": events, "n_kept": kept}
    except (ValueError, np.linalg.LinAlgError) as e:
        rows, status["status"], status["detail"] = [], "failed", str(e)
    return pd.DataFrame([status, *rows])


def prepare(recordings: DataFrame, boundaries: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """Epochs and statuses of recordings (path, channel, sfreq, signal[, task]).

    boundaries: (path, boundary_frac) of trusted splits; other rest recordings are cut in the middle.
    Recordings whose ``task`` is VCPT are one condition.
    """
    columns = [name.split()[0] for name in PREPARED.split(", ")]
    base = recordings if "task" in recordings.columns else recordings.withColumn("task", F.lit("EOEC"))
    if boundaries is not None:
        base = base.join(boundaries.select("path", "boundary_frac"), "path", "left")
    else:
        base = base.withColumn("boundary_frac", F.lit(None).cast("double"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        fraction = frame["boundary_frac"].iloc[0]
        out = process(frame, None if pd.isna(fraction) else float(fraction), frame["task"].iloc[0] == "VCPT", settings)
        out = out.reindex(columns=columns).astype(object)
        return out.where(out.notna(), None)

    return base.select("path", "channel", "sfreq", "signal", "task", "boundary_frac").groupBy("path").applyInPandas(run, PREPARED)


def statuses(prepared: DataFrame) -> DataFrame:
    return prepared.filter("status IS NOT NULL").drop("condition", "epoch", "channel", "samples")


def epochs(prepared: DataFrame) -> DataFrame:
    return prepared.filter("status IS NULL").select("path", "condition", "epoch", "channel", "samples")


def build_log(manifest: DataFrame, statuses: DataFrame, wanted: DataFrame | None = None, cap: int | None = schemas.EPOCH_CAP) -> DataFrame:
    """One row per subject: group, split, status, epochs by condition (at most ``cap``), split rule and quality columns.

    manifest: one row a subject with the paths of its recordings, ``vcpt_path`` null without a task; statuses: one row a
    path; wanted: (subject_id) to log, all of the manifest by default. A subject that the manifest lacks, one without a
    rest recording and one of whose recordings failed are rows with status ``failed``; quality is null there, and a
    condition without a recording is null.
    """
    rest = statuses.select(F.col("path").alias("eoec_path"), F.struct("status", "detail", "alpha_ratio", "split_rule", "boundary_frac", "capped", "n_muscle", "n_ec", "n_eo", "rej_ec", "rej_eo").alias("r"))
    task = statuses.select(F.col("path").alias("vcpt_path"), F.struct("status", "detail", "capped", "n_muscle", "n_vcpt", "rej_vcpt").alias("t"))
    known = manifest.select("subject_id", "group", "split", "eoec_path", "vcpt_path", F.lit(True).alias("known"))
    rows = known if wanted is None else wanted.select("subject_id").distinct().join(known, "subject_id", "left")
    rows = rows.join(rest, "eoec_path", "left").join(task, "vcpt_path", "left")
    fault = (
        F.when(F.col("known").isNull(), "not found in manifest")
        .when(F.col("r").isNull(), "preprocessing failed: no recording")
        .when(F.col("r.status") == "failed", F.concat(F.lit("preprocessing failed: "), F.coalesce("r.detail", F.lit(""))))
        .when(F.col("vcpt_path").isNotNull() & F.col("t").isNull(), "preprocessing failed: no task recording")
        .when(F.col("t.status") == "failed", F.concat(F.lit("preprocessing failed: "), F.coalesce("t.detail", F.lit(""))))
    )
    rows = rows.withColumn("fault", fault)
    good, ok = F.col("fault").isNull(), F.col("fault").isNull() & (F.col("r.status") == "ok")
    count = lambda c: F.when(ok & F.col(c).isNotNull(), F.col(c) if cap is None else F.least(F.col(c), F.lit(cap))).otherwise(0)
    quality = {"rej_ec": "r.rej_ec", "rej_eo": "r.rej_eo", "rej_vcpt": "t.rej_vcpt", "capped_eoec": "r.capped", "capped_vcpt": "t.capped", "muscle_flagged_eoec": "r.n_muscle", "muscle_flagged_vcpt": "t.n_muscle"}
    ratio = F.col("r.alpha_ratio")
    return rows.select(
        "subject_id",
        F.coalesce("group", F.lit("?")).alias("group"),
        F.coalesce("split", F.lit("?")).alias("split"),
        F.when(~good, "failed").otherwise(F.col("r.status")).alias("status"),
        *[count(f"{s}.n_{c}").alias(f"n_{c}") for s, c in (("r", "ec"), ("r", "eo"), ("t", "vcpt"))],
        *[F.when(good, F.col(f"r.{c}")).alias(c) for c in ("split_rule", "boundary_frac")],
        F.coalesce("fault", F.format_string("alpha_ratio=%.2f", ratio)).alias("detail"),
        *[F.when(good, F.col(c)).alias(name) for name, c in quality.items()],
        F.when(good, (ratio > schemas.AMBIGUOUS[0]) & (ratio < schemas.AMBIGUOUS[1])).alias("eoec_ambiguous"),
    )
