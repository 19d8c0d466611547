"""Numerical kernels that have no relational form, and their per-recording DataFrame wrappers.

A task holds one recording (or one channel of it) at a time. The filter, decomposition and taper
designs are this library's own; the tests state what they guarantee (pass band, attenuation, source
recovery, known coupling), not bitwise parity with any other design.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fir(fs: float, low: float | None, high: float | None, transition: float = 1.0) -> np.ndarray:
    """A linear-phase band-pass: the difference of windowed sincs, odd length, Hamming window."""
    n = int(np.ceil(3.3 * fs / transition)) // 2 * 2 + 1
    t = np.arange(n) - n // 2
    window = np.hamming(n)

    def low_pass(f):
        h = 2 * f / fs * np.sinc(2 * f / fs * t) * window
        return h / h.sum()

    h = low_pass(high) if high is not None else (t == 0).astype(float)
    return h - low_pass(low) if low is not None else h


def zero_phase(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Convolve the last axis with a symmetric filter, mirrored at the ends, without delay."""
    k = len(h) // 2
    pad = min(k, x.shape[-1] - 1)
    y = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(pad, pad)], mode="reflect")
    y = np.pad(y, [(0, 0)] * (x.ndim - 1) + [(k - pad, k - pad)])
    size = 1 << (y.shape[-1] + len(h) - 1).bit_length()
    out = np.fft.irfft(np.fft.rfft(y, size) * np.fft.rfft(h, size), size)
    return out[..., 2 * k : 2 * k + x.shape[-1]]


def band_pass(x: np.ndarray, fs: float, low: float = 0.5, high: float = 50.0, notch: float | None = 50.0) -> np.ndarray:
    x = zero_phase(x, fir(fs, low, min(high, fs / 2 * 0.95), transition=min(2 * low, 1.0)))
    if notch is not None and notch < fs / 2 - 1:
        x = x - zero_phase(x, fir(fs, notch - 1, notch + 1, transition=1.0))
    return x


def ica(x: np.ndarray, components: int | None = None, seed: int = 42, steps: int = 400, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Symmetric fixed-point ICA with a tanh contrast: (unmixing, mixing) of rows of channels."""
    x = x - x.mean(axis=1, keepdims=True)
    w, v = np.linalg.eigh(np.cov(x))
    keep = np.argsort(-w)[: components or len(x)]
    keep = keep[w[keep] > w.max() * 1e-12]
    white = (v[:, keep] / np.sqrt(w[keep])).T
    z = white @ x

    def orthogonal(a):
        u, _, t = np.linalg.svd(a, full_matrices=False)
        return u @ t

    b = orthogonal(np.random.default_rng(seed).standard_normal((len(keep), len(keep))))
    for _ in range(steps):
        g = np.tanh(b @ z)
        new = orthogonal(g @ z.T / z.shape[1] - (1 - g * g).mean(axis=1)[:, None] * b)
        done = np.abs(np.abs((new * b).sum(axis=1)) - 1).max() < tolerance
        b = new
        if done:
            break
    unmixing = b @ white
    return unmixing, np.linalg.pinv(unmixing)


def remove_components(x: np.ndarray, unmixing: np.ndarray, mixing: np.ndarray, bad: list[int]) -> np.ndarray:
    """The signal without some components."""
    return x - mixing[:, bad] @ (unmixing[bad] @ (x - x.mean(axis=1, keepdims=True))) if bad else x


def eog_scores(sources: np.ndarray, proxies: np.ndarray) -> np.ndarray:
    """Largest absolute correlation of each source with the frontopolar proxies."""
    return np.abs(np.corrcoef(sources, proxies)[: len(sources), len(sources) :]).max(axis=1)


def muscle_scores(sources: np.ndarray, fs: float, nperseg: int = 512) -> np.ndarray:
    """Between 0 and 1: how far a source's log-log spectrum from 7 to 45 Hz rises instead of falling."""
    from .signals import welch_numpy

    nperseg = min(nperseg, sources.shape[1])
    psd = welch_numpy(sources, fs, nperseg)
    f = np.arange(psd.shape[1]) * fs / nperseg
    use = (f >= 7) & (f <= 45)
    slope = np.polyfit(np.log(f[use]), np.log(np.maximum(psd[:, use], 1e-300)).T, 1)[0]
    return 1 / (1 + np.exp(-2 * slope))


def morlet(x: np.ndarray, fs: float, freqs: np.ndarray, bandwidth: float = 1.5, centre: float = 1.0) -> np.ndarray:
    """Complex Morlet coefficients (frequencies x samples) by FFT."""
    n = len(x)
    out = np.empty((len(freqs), n), complex)
    for i, f in enumerate(freqs):
        scale = centre / f
        half = min(int(np.ceil(4 * scale * np.sqrt(bandwidth) * fs)), 8 * n)
        t = np.arange(-half, half + 1) / fs / scale
        wave = np.exp(-t * t / bandwidth + 2j * np.pi * centre * t) / np.sqrt(np.pi * bandwidth) / np.sqrt(scale * fs)
        size = 1 << (n + len(wave) - 1).bit_length()
        out[i] = np.fft.ifft(np.fft.fft(x, size) * np.fft.fft(np.conj(wave[::-1]), size))[half : half + n]
    return out


def scalogram_rgb(power: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    """(frequencies x samples x 3) bytes: fixed log range, residual of the log-log fit over time means, z over time."""
    log = np.log10(np.maximum(power, 1e-12))
    red = np.clip((log + 1) / 3.5, 0, 1)
    slope, intercept = np.polyfit(np.log10(freqs), log.mean(axis=1), 1)
    green = np.clip((log - (slope * np.log10(freqs) + intercept)[:, None] + 1) / 2, 0, 1)
    sd = power.std(axis=1, keepdims=True)
    z = (power - power.mean(axis=1, keepdims=True)) / np.where(sd > 0, sd, 1)
    blue = (np.clip(z, -3, 3) + 3) / 6
    return np.round(np.stack((red, green, blue), axis=-1) * 255).astype(np.uint8)


def dpss(n: int, half_width: float = 4.0, count: int = 7) -> np.ndarray:
    """Discrete prolate tapers (count x n): top eigenvectors of the tridiagonal problem."""
    w = half_width / n
    i = np.arange(n)
    m = np.diag(((n - 1 - 2 * i) / 2) ** 2 * np.cos(2 * np.pi * w))
    off = i[1:] * (n - i[1:]) / 2
    m += np.diag(off, 1) + np.diag(off, -1)
    v = np.linalg.eigh(m)[1][:, ::-1][:, :count].T
    return v * np.where(v.sum(axis=1, keepdims=True) < 0, -1, 1)


def imaginary_coherence(windows: np.ndarray, fs: float, bands: dict[str, tuple[float, float]]) -> dict[str, np.ndarray]:
    """Band means of the absolute imaginary part of coherency (windows x channels x samples), multitaper, symmetric."""
    n = windows.shape[-1]
    spectra = np.fft.rfft((windows - windows.mean(axis=-1, keepdims=True))[:, None] * dpss(n)[None, :, None, :], axis=-1)
    freqs = np.fft.rfftfreq(n, 1 / fs)
    out = {}
    for band, (low, high) in bands.items():
        s = spectra[..., (freqs >= low) & (freqs <= high)]
        cross = np.einsum("wtaf,wtbf->abf", s, np.conj(s))
        power = np.real(np.einsum("aaf->af", cross))
        coherency = cross / np.sqrt(np.maximum(power[:, None] * power[None, :], 1e-300))
        value = np.abs(coherency.imag).mean(axis=-1) if s.shape[-1] else np.full((windows.shape[1],) * 2, np.nan)
        out[band] = np.maximum(value, value.T)
    return out


def coherence_edges(signals: DataFrame, fs: float, length: int, step: int, bands: dict[str, tuple[float, float]], *keys: str, least: int = 1) -> DataFrame:
    """(keys, a, b, band, value) of every channel pair; groups with fewer than ``least`` windows give no rows."""
    fields = dict(signals.dtypes)

    def edges(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("channel", kind="stable")
        x = np.stack([np.asarray(v, float) for v in frame["samples"]])
        windows = np.lib.stride_tricks.sliding_window_view(x, length, axis=-1)[:, ::step].transpose(1, 0, 2) if x.shape[1] >= length else np.zeros((0, len(x), length))
        rows = []
        if len(windows) >= max(1, least):
            names = frame["channel"].tolist()
            for band, m in imaginary_coherence(windows, fs, bands).items():
                rows += [{**{k: frame[k].iloc[0] for k in keys}, "a": names[i], "b": names[j], "band": band, "value": m[i, j]} for i in range(len(names)) for j in range(i + 1, len(names))]
        return pd.DataFrame(rows, columns=[*keys, "a", "b", "band", "value"])

    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", a string, b string, band string, value double"
    return signals.select(*keys, "channel", "samples").groupBy(*keys).applyInPandas(edges, schema)


def map_signal(signals: DataFrame, run, *keys: str) -> DataFrame:
    """A kernel on each row's samples, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def apply(samples: pd.Series) -> pd.Series:
        return samples.map(lambda v: None if v is None else run(np.asarray(v, float)))

    return signals.select(*keys, apply("samples").alias("samples"))


def png(image: np.ndarray) -> bytes:
    """A PNG file of a (height x width x 3) byte array."""
    import struct
    import zlib

    h, w, _ = image.shape
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(image, np.uint8))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def strip_attention(image: np.ndarray, strips: int = 5) -> np.ndarray:
    """Mean of each horizontal strip of height // strips rows; rows beyond the last strip belong to none."""
    height = image.shape[0] // strips
    return np.array([image[i * height : (i + 1) * height].mean() for i in range(strips)])
