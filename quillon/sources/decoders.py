"""Decoders of recording files: bytes in, one row per channel out. They read European Data Format and MATLAB level 5."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_MARKERS = {"X1", "X2"}


def edf(data: bytes, drop: set[str] = _MARKERS) -> list[tuple[str, float, np.ndarray]]:
    """(channel, sampling rate, signal in volts) of each signal but markers and annotations."""
    if len(data) < 256:
        raise ValueError("not a recording: shorter than a header")
    header = data[:256].decode("latin-1")
    size, records, seconds, count = int(header[184:192]), int(header[236:244]), float(header[244:252]), int(header[252:256])
    fields, at = {}, 256
    for name, width in (("label", 16), ("transducer", 80), ("unit", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8), ("filter", 80), ("n", 8), ("reserved", 32)):
        fields[name] = [data[at + i * width : at + (i + 1) * width].decode("latin-1").strip() for i in range(count)]
        at += width * count
    n = [int(v) for v in fields["n"]]
    whole = sum(n)
    if records < 0:
        records = (len(data) - size) // (2 * whole)
    raw = np.frombuffer(data, "<i2", records * whole, size).reshape(records, whole)
    scale = {"uv": 1e-6, "mv": 1e-3, "v": 1.0}
    out, start = [], 0
    for i in range(count):
        label = fields["label"][i]
        part = raw[:, start : start + n[i]].ravel().astype(float)
        start += n[i]
        if label in drop or label == "EDF Annotations":
            continue
        low, high, first, last = (float(fields[k][i]) for k in ("pmin", "pmax", "dmin", "dmax"))
        volts = (part - first) * (high - low) / (last - first) + low
        out.append((label.removeprefix("EEG ").removesuffix("-Ref"), n[i] / seconds, volts * scale.get(fields["unit"][i].lower().replace("µ", "u"), 1.0)))
    return out


def write_edf(channels: list[tuple[str, np.ndarray]], fs: int, unit: str = "uV", limit: float | None = None) -> bytes:
    """A minimal recording with one-second records, for tests and exports; signals are in volts, clipped at a given limit (in ``unit``)."""
    factor = {"uV": 1e6, "mV": 1e3, "V": 1.0}[unit]
    seconds = len(channels[0][1]) // fs
    put = lambda v, w: str(v)[:w].ljust(w).encode("latin-1")
    limits = [limit or max(1e-6, float(np.abs(x).max()) * factor) for _, x in channels]
    head = put("0", 8) + put("", 80) + put("", 80) + put("01.01.24", 8) + put("00.00.00", 8) + put(256 * (1 + len(channels)), 8) + put("", 44) + put(seconds, 8) + put(1, 8) + put(len(channels), 4)
    head += b"".join(put(c, 16) for c, _ in channels) + b"".join(put("", 80) for _ in channels) + b"".join(put(unit, 8) for _ in channels)
    head += b"".join(put(f"{-m:.6g}", 8) for m in limits) + b"".join(put(f"{m:.6g}", 8) for m in limits)
    head += b"".join(put(-32767, 8) for _ in channels) + b"".join(put(32767, 8) for _ in channels)
    head += b"".join(put("", 80) for _ in channels) + b"".join(put(fs, 8) for _ in channels) + b"".join(put("", 32) for _ in channels)
    digits = [np.clip(np.round(x[: seconds * fs] * factor / float(f"{m:.6g}") * 32767), -32767, 32767).astype("<i2").reshape(seconds, fs) for (_, x), m in zip(channels, limits, strict=True)]
    return head + b"".join(d[r].tobytes() for r in range(seconds) for d in digits)


_MAT = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}


def _element(data: bytes, at: int, order: str) -> tuple[int, bytes, int]:
    """Type, bytes and the next element's place."""
    kind, size = struct.unpack_from(order + "II", data, at)
    if kind >> 16:  # small element
        return kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)], at + 8
    return kind, data[at + 8 : at + 8 + size], at + 8 + size + (-size % 8 if kind != 15 else 0)


def mat(data: bytes) -> dict[str, np.ndarray]:
    """The numeric matrices of a level 5 file, by name."""
    if len(data) < 128:
        raise ValueError("not a matrix file: shorter than a header")
    order = "<" if data[126:128] == b"IM" else ">"
    out, at = {}, 128
    while at + 8 <= len(data):
        kind, body, at = _element(data, at, order)
        if kind == 15:
            kind, body, _ = _element(zlib.decompress(body), 0, order)
        if kind != 14:
            continue
        _, _, p = _element(body, 0, order)
        _, shape, p = _element(body, p, order)
        _, name, p = _element(body, p, order)
        kind, values, p = _element(body, p, order)
        if kind in _MAT:
            dims = np.frombuffer(shape, order + "i4")
            out[name.decode("latin-1")] = np.frombuffer(values, order + _MAT[kind]).reshape(dims, order="F")
    return out


def write_mat(name: str, values: np.ndarray) -> bytes:
    """A level 5 file of one int16 or float64 matrix."""
    kind, cls = {"int16": (3, 10), "float64": (9, 6)}[str(values.dtype)]

    def element(k: int, body: bytes) -> bytes:
        return struct.pack("<II", k, len(body)) + body + b"\0" * (-len(body) % 8)

    body = element(6, struct.pack("<II", cls, 0)) + element(5, struct.pack("<ii", *values.shape)) + element(1, name.encode()) + element(kind, values.tobytes(order="F"))
    return b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + element(14, body)
