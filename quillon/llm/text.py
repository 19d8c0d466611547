"""Arrow and NumPy kernels on columns of whole texts, shared by the corpus operators.

A word is a run of bytes other than space and the controls 9 to 13, as in ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that one step of a kernel takes; a longer single text is taken whole.
CHUNK_BYTES = 2 << 20

_U = np.uint64
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _libc = None


@dataclass
class Tokens:
    """Words of a column: ``codes[offsets[i]:offsets[i+1]]`` index ``words`` for row i."""

    codes: np.ndarray
    offsets: np.ndarray
    words: pa.Array


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``size`` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
        trim()


def trim() -> None:
    """Give freed memory back to the system: workers outlive their tasks, and their heaps would count beside the JVM's."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column without nulls."""
    return pc.fill_null(batch.column(name), "")


def tokenise(column: pa.Array, lower: bool = False) -> Tokens:
    if lower:
        column = pc.ascii_lower(column)
    lists = pc.ascii_split_whitespace(column)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:
        keep = codes != empty
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        codes = codes[keep]
    return Tokens(codes.astype(np.int64), offsets, coded.dictionary)


def split_lines(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines of all rows, and where each row's lines begin; an empty text has one empty line."""
    lists = pc.split_pattern(column, "\n")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten(), offsets - offsets[0]


def line_words(column: pa.Array, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word with A-Z lower-cased, the line it stands in, and where each row's lines begin, as
    ``split_lines`` counts them; straight from the bytes, by the polynomial that ``hashes`` takes."""
    raw, at = byte_view(column)
    rows = np.arange(len(at))
    newline = np.flatnonzero(raw == 10)
    lines_at = np.searchsorted(newline, at) + rows
    space = (raw == 32) | ((raw - np.uint8(9)) < 5)
    # words end with their row
    edge = np.zeros(len(raw) + 1, bool)
    edge[1:] = space
    edge[at] = True
    start = np.flatnonzero(edge[:-1] & ~space)
    edge[:-1] = space
    edge[at] = True
    end = np.flatnonzero(edge[1:] & ~space) + 1
    cuts = np.searchsorted(start, np.sort(np.concatenate((at[:-1], newline + 1))))
    line = np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, len(start))))
    table = _LOWER_BYTES + mix(np.full(1, seed + 1, _U))
    out = np.empty(len(start), _U)
    # blocks of whole words that stay in a core's cache
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + _BLOCK, side="right")))
        first, size = start[a], int(end[b - 1] - start[a])
        up, down = _POWERS if size < _BLOCK + 1 else powers(size + 1, _BASE)
        total = np.zeros(size + 1, _U)
        np.cumsum(table[raw[first : first + size]] * up[:size], out=total[1:])
        s, e = start[a:b] - first, end[a:b] - first
        out[a:b] = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U) * _U(0x9E3779B97F4A7C15))
        a = b
    for k in np.flatnonzero(end - start > _SHORT).tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[start[k] : end[k]].tobytes().lower(), seed)
    return out, line, lines_at


def hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of each string: of short ones in whole arrays, by a polynomial over random values of their bytes."""
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    length = pc.binary_length(words).to_numpy(zero_copy_only=False)
    long = np.flatnonzero(length > _SHORT)
    if len(long):
        out = np.empty(len(words), _U)
        short = np.flatnonzero(length <= _SHORT)
        out[short] = hashes(words.take(pa.array(short)), seed)
        digest = xxhash.xxh3_64_intdigest
        out[long] = np.fromiter((digest(w, seed) for w in words.take(pa.array(long)).to_pylist()), _U, len(long))
        return out
    raw, at = byte_view(words)
    return mix(sequence_hash(_BYTES[raw], at, _BASE) + mix(np.full(1, seed + 1, _U)))


def order_rows(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The order by (row, value)."""
    if len(row) and int(row.max()) < 1 << 24:
        key = (row.astype(_U) << _U(40)) | (value >> _U(24))
        order = np.argsort(key)
        k, v = key[order], value[order]
        if not np.any((k[1:] == k[:-1]) & (v[1:] < v[:-1])):
            return order
    return np.lexsort((value, row))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def row_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values in each row; 0 for empty rows."""
    if values.dtype.kind == "f":
        return np.bincount(row_of(offsets), values, len(offsets) - 1)
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def run_starts(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in an ordered array."""
    if not len(ordered):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i < n; base is odd."""
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, _U(base)), np.full(n, _U(inverse))
    if n:
        up[0] = down[0] = 1
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


def sequence_hash(word_hash: np.ndarray, offsets: np.ndarray, base: int) -> np.ndarray:
    """A hash of the word sequence of each row, from hashes of its words."""
    up, down = powers(len(word_hash) + 1, base)
    total = np.concatenate((np.zeros(1, _U), np.cumsum(word_hash * up[:-1], dtype=_U)))
    with np.errstate(over="ignore"):
        value = (total[offsets[1:]] - total[offsets[:-1]]) * down[offsets[:-1]]
    return mix(value + np.diff(offsets).astype(_U) * _U(0x9E3779B97F4A7C15))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without nulls, and each row's place in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


#: Strings of at most so many bytes are hashed in whole arrays.
_SHORT = 64
_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_LOWER_BYTES = _BYTES[np.frombuffer(bytes(range(256)).lower(), np.uint8)]
_BASE = 0x5DEECE66D1CE4E5B
#: Bytes that ``line_words`` hashes at once, and the powers for them.
_BLOCK = 1 << 16
_POWERS = powers(_BLOCK + 1, _BASE)
