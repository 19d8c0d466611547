"""Recording files as Spark data sources: ``spark.read.format("edf")`` and ``spark.read.format("mat")``.

A file is cut by byte ranges, as text files are, so a long recording is read by several tasks and small files
share one. A task reads the header of its file and then only the records that begin in its range; filters on
``channel`` and the option ``channels`` say which channels are decoded. A file that can't be read is one row with an
``error``. Files are opened through Arrow's file systems (local paths, hdfs, s3, gs).

Options: ``path`` (a file or folder), ``glob`` (on file names), ``channels`` (comma-separated), ``split_bytes``,
``block_records`` (records of a row), ``layout`` (edf: ``long``, one row a channel and block, or ``wide``, a column
for each channel of the first file's header), ``sfreq`` and ``columns`` (mat: rate and channel names).
"""

from __future__ import annotations

import fnmatch
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from ..schemas import CHANNELS

LONG = "path string, channel string, sfreq double, start long, samples array<double>, error string"
_LONG = pa.schema([("path", pa.string()), ("channel", pa.string()), ("sfreq", pa.float64()), ("start", pa.int64()), ("samples", pa.list_(pa.float64())), ("error", pa.string())])
SPLIT_BYTES, BLOCK_RECORDS = 32 << 20, 64
_MARKERS = {"X1", "X2", "EDF Annotations"}
_VOLTS = {"uv": 1e-6, "mv": 1e-3, "v": 1.0}


@dataclass
class Ranges(InputPartition):
    """Byte ranges (path, from, to) that one task reads."""

    parts: list[tuple[str, int, int]]


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def found_files(path: str, glob: str) -> list[tuple[str, int]]:
    """(path, bytes) of the file, or of the folder's files whose names match, case ignored; contents are not read."""
    from pyarrow import fs

    system, root = _file_system(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    below = system.get_file_info(fs.FileSelector(root, recursive=True))
    names = sorted((f.path, f.size) for f in below if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name.lower(), glob.lower()))
    base = path.rstrip("/")
    return [(base + p[len(root.rstrip("/")) :], size) for p, size in names]


def ranges(files: list[tuple[str, int]], split: int, whole: bool = False) -> list[Ranges]:
    """Long files cut into ranges of ``split`` bytes, short ones gathered up to as much."""
    out, open_, held = [], [], 0
    for path, size in files:
        if size > split:
            cuts = [0, size] if whole else [*range(0, size, split), size]
            out += [Ranges([(path, a, b)]) for a, b in zip(cuts, cuts[1:], strict=False)]
            continue
        if open_ and held + size > split:
            out.append(Ranges(open_))
            open_, held = [], 0
        open_.append((path, 0, max(size, 1)))
        held += size
    return out + ([Ranges(open_)] if open_ else [])


@dataclass
class Header:
    size: int
    records: int
    seconds: float
    labels: list[str]
    counts: list[int]
    first: list[float]
    scale: list[float]
    offset: list[float]

    @property
    def record_bytes(self) -> int:
        return 2 * sum(self.counts)

    def wanted(self, channels: set[str] | None) -> list[int]:
        return [i for i, c in enumerate(self.labels) if c not in _MARKERS and (channels is None or c in channels)]


def edf_header(file, size: int) -> Header:
    """The header of an open file of ``size`` bytes; ValueError where it is none."""
    fixed = file.read_at(256, 0)
    if len(fixed) < 256:
        raise ValueError("not a recording: shorter than a header")
    text = fixed.decode("latin-1")
    try:
        head, records, seconds, n = int(text[184:192]), int(text[236:244]), float(text[244:252]), int(text[252:256])
    except ValueError as e:
        raise ValueError(f"not a recording: {e}") from None
    if n <= 0 or head != 256 * (n + 1) or seconds <= 0 or size < head:
        raise ValueError("not a recording: its header is cut or contradicts itself")
    rest = file.read_at(256 * n, 256).decode("latin-1")

    def field(start: int, width: int) -> list[str]:
        return [rest[start * n + i * width : start * n + (i + 1) * width].strip() for i in range(n)]

    try:
        low, high, first, last = ([float(v) for v in field(at, 8)] for at in (104, 112, 120, 128))
        counts = [int(v) for v in field(216, 8)]
    except ValueError as e:
        raise ValueError(f"not a recording: {e}") from None
    if min(counts) <= 0 or any(a == b for a, b in zip(first, last, strict=True)):
        raise ValueError("not a recording: a channel without samples or range")
    volts = [_VOLTS.get(u.lower().replace("µ", "u"), 1.0) for u in field(96, 8)]
    scale = [(h - lo) / (b - a) * v for h, lo, a, b, v in zip(high, low, first, last, volts, strict=True)]
    labels = [c.removeprefix("EEG ").removesuffix("-Ref") for c in field(0, 16)]
    held = (size - head) // (2 * sum(counts))
    return Header(head, held if records < 0 else records, seconds, labels, counts, first, scale, [lo * v for lo, v in zip(low, volts, strict=True)])


class _Reader(DataSourceReader):
    glob, whole = "*", False

    def __init__(self, options: dict[str, str]):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("give a path to load")
        given = options.get("channels")
        self.channels = {c.strip() for c in given.split(",")} if given else None
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.block = int(options.get("block_records", BLOCK_RECORDS))
        self.pattern = options.get("glob", self.glob)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and lists on ``channel`` choose what is decoded; Spark still applies them, as errors have no channel."""
        for f in filters:
            names = {f.value} if isinstance(f, EqualTo) and f.attribute == ("channel",) else set(f.value) if isinstance(f, In) and f.attribute == ("channel",) else None
            if names is not None:
                self.channels = names if self.channels is None else self.channels & names
            yield f

    def partitions(self) -> list[Ranges]:
        return ranges(found_files(self.path, self.pattern), self.split, self.whole)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, start, stop in partition.parts:
            try:
                system, local = _file_system(path)
                size = system.get_file_info(local).size
                with system.open_input_file(local) as file:
                    yield from self.rows(path, file, size, start, stop)
            except (ValueError, IndexError, EOFError, struct.error, zlib.error, zipfile.BadZipFile, OSError) as e:
                if start == 0:  # the other ranges of a file say nothing
                    yield self.failed(path, str(e))

    def failed(self, path: str, why: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"path": path, "error": why}], _LONG)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate(values) if values else np.zeros(0))


class EdfReader(_Reader):
    glob = "*.edf"

    def __init__(self, options: dict[str, str], columns: list[str] | None = None):
        super().__init__(options)
        self.columns = columns

    def rows(self, path: str, file, size: int, start: int, stop: int) -> Iterator[pa.RecordBatch]:
        h = edf_header(file, size)
        held = (size - h.size) // h.record_bytes
        # the records that begin in this range
        first, last = (max(0, -(-(at - h.size) // h.record_bytes)) for at in (start, stop))
        use = h.wanted(self.channels if self.columns is None else set(self.columns))
        places = np.concatenate(([0], np.cumsum(h.counts)))
        for at in range(first, min(last, h.records, held), self.block):
            n = min(self.block, last - at, h.records - at, held - at)
            raw = np.frombuffer(file.read_at(n * h.record_bytes, h.size + at * h.record_bytes), "<i2").reshape(n, -1)
            found = [(raw[:, places[i] : places[i + 1]].ravel() - h.first[i]) * h.scale[i] + h.offset[i] for i in use]
            if self.columns is None:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(use), pa.string()),
                        pa.array([h.labels[i] for i in use], pa.string()),
                        pa.array([h.counts[i] / h.seconds for i in use], pa.float64()),
                        pa.array([at * h.counts[i] for i in use], pa.int64()),
                        _lists(found),
                        pa.nulls(len(use), pa.string()),
                    ],
                    schema=_LONG,
                )
            else:
                by = {h.labels[i]: v for i, v in zip(use, found, strict=True)}
                yield pa.RecordBatch.from_pylist([{"path": path, "start_s": at * h.seconds, **{c: by.get(c) for c in self.columns}, "error": None}], self.wide())
        if start == 0 and held < h.records:
            yield self.failed(path, f"cut off: {held} of {h.records} records")

    def wide(self) -> pa.Schema:
        return pa.schema([("path", pa.string()), ("start_s", pa.float64()), *[(c, pa.list_(pa.float64())) for c in self.columns], ("error", pa.string())])

    def failed(self, path: str, why: str) -> pa.RecordBatch:
        return super().failed(path, why) if self.columns is None else pa.RecordBatch.from_pylist([{"path": path, "error": why}], self.wide())


class EdfSource(DataSource):
    """European Data Format; samples in volts, markers and annotations left out."""

    @classmethod
    def name(cls) -> str:
        return "edf"

    def _columns(self) -> list[str] | None:
        if self.options.get("layout", "long") != "wide":
            return None
        reader = EdfReader(self.options)
        for path, size in found_files(reader.path, reader.pattern):
            system, local = _file_system(path)
            with system.open_input_file(local) as file:
                try:
                    h = edf_header(file, size)
                except ValueError:
                    continue
            return list(dict.fromkeys(h.labels[i] for i in h.wanted(reader.channels)))
        return []

    def schema(self) -> str:
        columns = self._columns()
        return LONG if columns is None else ", ".join(["path string", "start_s double", *[f"`{c}` array<double>" for c in columns], "error string"])

    def reader(self, schema: StructType) -> EdfReader:
        wide = self.options.get("layout", "long") == "wide"
        return EdfReader(self.options, [f.name for f in schema if f.name not in ("path", "start_s", "error")] if wide else None)


_MAT = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}


def _tag(file, at: int, order: str) -> tuple[int, int, int, int]:
    """Type, bytes, place of the content and of the next element."""
    head = file.read_at(8, at)
    kind, size = struct.unpack(order + "II", head)
    if kind >> 16:
        return kind & 0xFFFF, kind >> 16, at + 4, at + 8
    return kind, size, at + 8, at + 8 + size + (-size % 8 if kind != 15 else 0)


class MatReader(_Reader):
    """A file has one matrix (samples, channels) in microvolts; it lies column by column, so a plain file is read by channel."""

    glob, whole = "*.mat", True

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.sfreq = float(options.get("sfreq", 128.0))
        self.names = [c.strip() for c in options["columns"].split(",")] if "columns" in options else CHANNELS

    def rows(self, path: str, file, size: int, start: int, stop: int) -> Iterator[pa.RecordBatch]:
        head = file.read_at(128, 0)
        if len(head) < 128 or head[126:128] not in (b"IM", b"MI"):
            raise ValueError("not a matrix file: no header")
        order, at, found = "<" if head[126:128] == b"IM" else ">", 128, []
        while at + 8 <= size:
            kind, length, content, at = _tag(file, at, order)
            source, place = file, content
            if kind == 15:
                source, place = pa.BufferReader(zlib.decompress(file.read_at(length, content))), 0
                kind, length, place, _ = _tag(source, 0, order)
            if kind == 14:
                found.append((source, place))
        if len(found) != 1:
            raise ValueError(f"one matrix is expected, not {len(found)}")
        source, place = found[0]
        _, _, _, place = _tag(source, place, order)
        _, length, content, place = _tag(source, place, order)
        shape = np.frombuffer(source.read_at(length, content), order + "i4")
        _, _, _, place = _tag(source, place, order)
        kind, length, content, _ = _tag(source, place, order)
        if kind not in _MAT or len(shape) != 2 or shape[1] != len(self.names):
            raise ValueError(f"one numeric matrix of {len(self.names)} columns is expected")
        kind = np.dtype(order + _MAT[kind])
        if length < shape[0] * shape[1] * kind.itemsize or source is file and content + length > size:
            raise ValueError("cut off")
        step = self.block * max(1, int(self.sfreq))
        for i, channel in enumerate(self.names):
            if self.channels is not None and channel not in self.channels:
                continue
            for k in range(0, int(shape[0]), step):
                n = min(step, int(shape[0]) - k)
                values = np.frombuffer(source.read_at(n * kind.itemsize, content + (i * int(shape[0]) + k) * kind.itemsize), kind).astype(float) * 1e-6
                yield pa.RecordBatch.from_pylist([{"path": path, "channel": channel, "sfreq": self.sfreq, "start": k, "samples": values}], _LONG)


class MatSource(DataSource):
    """MATLAB level 5 files of one matrix; see ``MatReader``."""

    @classmethod
    def name(cls) -> str:
        return "mat"

    def schema(self) -> str:
        return LONG

    def reader(self, schema: StructType) -> MatReader:
        return MatReader(self.options)


class NpzReader(_Reader):
    """A file has arrays by name; each is a row of its shape and values, in row order."""

    glob, whole = "*.npz", True

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        given = options.get("arrays")
        self.names = {c.strip() for c in given.split(",")} if given else None

    def rows(self, path: str, file, size: int, start: int, stop: int) -> Iterator[pa.RecordBatch]:
        import io

        with np.load(io.BytesIO(file.read_at(size, 0)), allow_pickle=False) as held:
            for name in held.files:
                if self.names is None or name in self.names:
                    v = held[name]
                    if v.dtype.kind not in "fiub":
                        raise ValueError(f"array {name} holds no numbers")
                    yield pa.RecordBatch.from_pylist([{"path": path, "name": name, "shape": list(v.shape), "values": v.astype(float).ravel().tolist(), "error": None}], _NPZ)

    def failed(self, path: str, why: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"path": path, "error": why}], _NPZ)


_NPZ = pa.schema([("path", pa.string()), ("name", pa.string()), ("shape", pa.list_(pa.int64())), ("values", pa.list_(pa.float64())), ("error", pa.string())])


class NpzSource(DataSource):
    """NumPy archives; see ``NpzReader``. Option ``arrays`` names those wanted."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "path string, name string, shape array<bigint>, values array<double>, error string"

    def reader(self, schema: StructType) -> NpzReader:
        return NpzReader(self.options)


def register(spark: SparkSession) -> SparkSession:
    """Make the formats known to a session, with filters pushed down to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (EdfSource, MatSource, NpzSource):
        spark.dataSource.register(source)
    return spark
