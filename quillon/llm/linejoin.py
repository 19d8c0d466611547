"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct words, A-Z lower-cased. Of lines whose sets have a Jaccard
similarity of at least 80 in 100, every one but the earliest goes: a line is removed if any earlier
line, by (doc_id, line number), matches it. Lines of fewer than ``min_words`` words are never touched.

Tokens are ordered by rarity over all documents. A line posts the tokens of its prefix: of two matching
lines both prefixes hold their first common token. A token that is hot, by its count over all lines,
posts nothing alone: matching lines whose first common token is hot share a second one, hotter still,
within one more place, and meet under the two together. So the group of a hot token splits without losing
a pair. Rows that share a key meet in a task, by whole arrays; a pair passes a length and a positional
filter and one on bit maps of its sets (bits that differ are tokens that differ), before full sets are
compared. Lines with equal sets are one class (by a 128-bit digest), removed but the first without any
comparison.

A line needs one match only, so every row asks a few of its earliest candidates in each group first.
Rows whose candidates all failed ask the next ones, in further rounds, until none has any left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .rarity import BITS, rarity, slots
from .tables import documents, edit_texts, fresh_names, write_table

PERCENT = 80
MIN_WORDS = 3
#: A token that more lines hold than this posts together with a second one.
HOT_LINES = 4096
#: Candidates of a row in a group that the first round compares; the next rounds take sixteen times as many each.
FIRST = 8
#: Lines whose places may be broadcast to a scan (some 30 MB); more are joined by shuffle.
BROADCAST_LINES = 500_000
_U = np.uint64
_LAST = (1 << 63) - 1
_GOLD = _U(0x9E3779B97F4A7C15)


def _by_line(line: np.ndarray, number: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The order by (line, number, token)."""
    if not len(line):
        return np.zeros(0, np.int64)
    high, wide = int(line[-1]).bit_length(), int(number.max()).bit_length()
    if high + wide > 60:
        return np.lexsort((token, number, line))
    rest = 64 - high - wide
    return _settled((line.astype(_U) << _U(64 - high) if high else _U(0)) | (number.astype(_U) << _U(rest) if wide else _U(0)) | (token >> _U(64 - rest)), token)


def _settled(key: np.ndarray, *then: np.ndarray) -> np.ndarray:
    """The order by ``key`` (unsigned 64-bit) and, where keys are equal, by the further arrays."""
    order = np.argsort(key)
    k = key[order]
    same = k[1:] == k[:-1]
    apart = np.zeros(len(same), bool)
    for x in then:
        y = x[order]
        apart |= y[1:] != y[:-1]
    if (same & apart).any():
        start = np.append(True, ~same)
        run = np.cumsum(start) - 1
        mixed = np.zeros(run[-1] + 1, bool)
        mixed[run[1:][same & apart]] = True
        at = np.flatnonzero(mixed[run])
        some = order[at]
        order[at] = some[np.lexsort((*[x[some] for x in reversed(then)], key[some]))]
    return order


class _Lines:
    """The lines of some texts that are long enough, as distinct tokens, the rarest first."""

    def __init__(self, texts: pa.Array, min_words: int, counts: np.ndarray | None = None):
        token, line, self.at = tx.line_words(texts, 51)
        keep = (np.bincount(line, minlength=self.at[-1]) >= max(1, min_words))[line]
        token, line = token[keep], line[keep]
        number = rarity(counts, token).astype(np.int64) if counts is not None else np.zeros(len(token), np.int64)
        order = _by_line(line, number, token)
        token, line, number = token[order], line[order], number[order]
        if len(token):
            fresh = np.append(True, (token[1:] != token[:-1]) | (line[1:] != line[:-1]))
            token, line, number = token[fresh], line[fresh], number[fresh]
        n = np.bincount(line, minlength=self.at[-1])
        #: Which lines these are, and the rows they stand in.
        self.live = np.flatnonzero(n)
        self.row = tx.row_of(self.at)[self.live]
        self.n = n[self.live]
        self.offsets = np.concatenate(([0], np.cumsum(self.n)))
        self.tokens, self.counts = token, number

    def _summed(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate((np.zeros(1, _U), np.cumsum(values, dtype=_U)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def digest(self) -> np.ndarray:
        return tx.mix(self._summed(tx.mix(self.tokens)) ^ (self.n.astype(_U) * _GOLD)).view(np.int64)

    def second(self) -> np.ndarray:
        return tx.mix(self._summed(tx.mix(self.tokens ^ _U(0x5851F42D4C957F2D))) + self.n.astype(_U)).view(np.int64)

    def maps(self) -> list[np.ndarray]:
        """A 128-bit map of each line's tokens as two integers."""
        bit, part = _U(1) << (self.tokens >> _U(58)), (self.tokens >> _U(57)) & _U(1)
        return [np.bitwise_or.reduceat(bit * (part == _U(k)), self.offsets[:-1]).view(np.int64) if len(bit) else np.zeros(0, np.int64) for k in range(2)]


#: Blocks in which a task's counters travel.
_BLOCKS = 64
_COUNTS = "doc_id long, k1 long, k2 long, n int, block int, packed binary"
_COUNT_NAMES = [c.split()[0] for c in _COUNTS.split(", ")]


def _line_counts(min_words: int):
    """A row for each document with its number of lines, and, with ``block``, a task's counters of tokens."""

    def rows(batches):
        total = np.zeros(1 << BITS, np.int64)
        for batch in tx.chunks(batches):
            token, line, at = tx.line_words(tx.texts(batch), 51)
            long = np.bincount(line, minlength=at[-1]) >= max(1, min_words)
            slots(token[long[line]], None, total)
            n, size = tx.sums(long.astype(np.int64), at).astype(np.int32), len(batch)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "k1", "k2")], pa.array(n), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], names=_COUNT_NAMES)
        packed = pa.array([x.astype(np.int32).tobytes() for x in np.split(np.minimum(total, 2**31 - 1), _BLOCKS)], pa.binary())
        yield pa.RecordBatch.from_arrays([*[pa.nulls(_BLOCKS, pa.int64())] * 3, pa.nulls(_BLOCKS, pa.int32()), pa.array(np.arange(_BLOCKS, dtype=np.int32)), packed], names=_COUNT_NAMES)

    return rows


def _summed_blocks(batches):
    """One block of counters from all of its tasks'."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, packed in zip(batch.column("block").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            total[block] = total.get(block, 0) + np.frombuffer(packed, np.int32).astype(np.int64)
    packed = [np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(packed, pa.binary())], names=["block", "packed"])


#: Postings, rows of bytes by bucket: a key's own 32 bits; of its line the first half of the digest, a map of 128 bits, the set's
#: size, the key's place in the prefix, and the line's place (document, hash of the text, number).
_NARROW = np.dtype([("word", "<i4"), ("digest", "<i8"), ("a", "<i8"), ("b", "<i8"), ("n", "<u2"), ("p", "u1"), ("doc", "<u4"), ("hash", "<i4"), ("line", "<u2")])
_WIDE = np.dtype([("word", "<i4"), ("digest", "<i8"), ("a", "<i8"), ("b", "<i8"), ("n", "<i4"), ("p", "<i4"), ("doc", "<i8"), ("hash", "<i4"), ("line", "<i4")])
#: The earliest line of a class in a chunk; and a line that is equal to an earlier one of its chunk.
_HOLDER = np.dtype([(c, "<i8") for c in ("d1", "d2", "doc", "k1", "k2")] + [("line", "<i4")])
_GONE = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("line", "<i4")])
#: Rows of bytes by bucket: postings (narrow or wide), holders, lines that are gone.
_POSTINGS = "bucket int, kind int, packed binary"
_KINDS = [_NARROW, _WIDE, _HOLDER, _GONE]
#: The same as columns, with the hash and the line's number in one.
_COLUMN_TYPES = ["word int", "digest long", "a long", "b long", "n int", "p int", "doc long", "tie long"]
_COLUMNS = [c.split()[0] for c in _COLUMN_TYPES]


def _bytes(c: dict[str, np.ndarray], kind: np.dtype, cuts: np.ndarray) -> pa.Array:
    """Rows as bytes, a run from one cut to the next."""
    rows = np.empty(len(c[kind.names[0]]), kind)
    for k in kind.names:
        rows[k] = c[k]
    places = (cuts * kind.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(places), pa.py_buffer(rows)])


def _pack(c: dict[str, np.ndarray], cuts: np.ndarray) -> tuple[bool, pa.Array]:
    """Postings as bytes, a run from one cut to the next; wide ones if a value needs it."""
    fits = lambda name: not len(c[name]) or (c[name].min() >= 0 and c[name].max() <= np.iinfo(_NARROW[name]).max)
    wide = not all(fits(k) for k in ("n", "p", "doc", "line"))
    return wide, _bytes(c, _WIDE if wide else _NARROW, cuts)


def _unpack(raw: np.ndarray, wide: bool) -> dict[str, np.ndarray]:
    rows = np.frombuffer(raw, _WIDE if wide else _NARROW)
    c = {k: rows[k].astype(_WIDE[k]) for k in _COLUMNS[:-1]}
    c["tie"] = (rows["hash"].astype(np.int64) << 32) | rows["line"]
    return c


def _repeated(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of lines: the earliest of each class, and those that an earlier line of their class makes go. Rows that are equal
    in id and text are one document, so their lines are the same lines."""
    tie = ((c["k1"] >> 32) << 32) | c["line"]
    order = np.lexsort((c["k2"], c["k1"], tie, c["doc"], c["d2"], c["d1"]))
    if not len(order):
        return order, order
    d1, d2 = c["d1"][order], c["d2"][order]
    start = np.flatnonzero(np.append(True, (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])))
    first = np.repeat(order[start], np.diff(np.append(start, len(order))))
    gone = (c["k1"][order] != c["k1"][first]) | (c["k2"][order] != c["k2"][first]) | (c["line"][order] != c["line"][first])
    return order[start], order[gone]


def _prefixes(found: _Lines, lines: np.ndarray, percent: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, place) of what the given lines post."""
    n = found.n[lines]
    # a set can match another one from this size on only
    lines = lines[100 * n >= percent * (n + 1)]
    n = found.n[lines]
    prefix = n - -(-percent * n // 100) + 1
    near = np.minimum(n, prefix + 1)  # where two common tokens lie
    step = np.arange(near.sum()) - np.repeat(np.cumsum(near) - near, near)
    line = np.repeat(lines, near)
    at = found.offsets[line] + step
    token, hot = found.tokens[at], found.counts[at] > most
    alone = ~hot & (step < np.repeat(prefix, near))
    out = [(line[alone], token[alone], step[alone])]
    # hot tokens are the last ones of a prefix; each with each later one
    line, token, step = line[hot], token[hot], step[hot]
    a = np.arange(len(line))
    for k in range(1, int(near.max(initial=1))):
        a = a[a + k < len(line)]
        a = a[line[a] == line[a + k]]
        if not len(a):
            break
        out.append((line[a], tx.mix(token[a] * _U(3) + tx.mix(token[a + k])), step[a + k] - 1))
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def _postings(shared, buckets: int, min_words: int, percent: int, most: int):
    of = lambda key: (key >> _U(33)).astype(np.int64) % buckets

    def rows(kind: int, bucket: np.ndarray, packed: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(np.full(len(bucket), kind, np.int32)), packed], names=["bucket", "kind", "packed"])

    def dealt(bucket: np.ndarray, *columns: np.ndarray):
        order = np.argsort(bucket, kind="stable")
        start = tx.run_starts(bucket[order])
        return bucket[order][start], np.append(start, len(order)), [x[order] for x in columns]

    def post(batches):
        for batch in tx.chunks(batches):
            found = _Lines(tx.texts(batch), min_words, shared.value)
            if not len(found.live):
                continue
            number = found.live - found.at[found.row]
            c = {k: batch.column(k).to_numpy()[found.row] for k in ("doc", "k1", "k2")} | {"line": number, "d1": found.digest(), "d2": found.second()}
            # each class once in a chunk, at its earliest place
            lone, gone = _repeated(c)
            if len(gone):
                yield rows(3, of(c["k1"][gone[:1]].view(_U)), _bytes({k: c[k][gone] for k in _GONE.names}, _GONE, np.array([0, len(gone)])))
            bucket, cuts, (line,) = dealt(of(c["d1"][lone].view(_U)), lone)
            yield rows(2, bucket, _bytes({k: c[k][line] for k in _HOLDER.names}, _HOLDER, cuts))
            line, key, place = _prefixes(found, lone, percent, most)
            bucket, cuts, (line, key, place) = dealt(of(key), line, key, place)
            a, b = found.maps()
            columns = {"word": key.astype(np.uint32).view(np.int32), "digest": c["d1"][line], "a": a[line], "b": b[line], "n": found.n[line], "p": place, "doc": c["doc"][line], "hash": c["k1"][line] >> 32, "line": number[line]}
            wide, packed = _pack(columns, cuts)
            yield rows(int(wide), bucket, packed)

    return post


def _may_match(c: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Length, positional and map filters on rows x and y of one group, whose lines share its key first at places p;
    where they pass."""
    n, m = c["n"][x].astype(np.int64), c["n"][y].astype(np.int64)
    at = np.flatnonzero(100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    n, m, x, y = n[at], m[at], x[at], y[at]
    near = np.flatnonzero(1 + np.minimum(n - c["p"][x] - 1, m - c["p"][y] - 1) >= -(-percent * (n + m) // (100 + percent)))
    at, both, x, y = at[near], (n + m)[near], x[near], y[near]
    for k in "ab":
        # bits apart so far are tokens apart
        apart = np.bitwise_count((c[k][x] ^ c[k][y]).view(_U)).astype(np.int64) + (apart if k == "b" else 0)
        near = np.flatnonzero(apart * (100 + percent) <= both * (100 - percent))
        at, both, x, y, apart = at[near], both[near], x[near], y[near], apart[near]
    return at


#: A pair (u before v) of classes with their earliest places; a row of a group in which rows have more candidates, where
#: ``more`` marks those; a line that is gone.
_MET = "kind int, u long, u_doc long, u_tie long, v long, v_doc long, v_tie long, bucket int, " + ", ".join(_COLUMN_TYPES) + ", more boolean, k1 long, k2 long, line int"
_MET_TYPES = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}


def _met_rows(kind: int, **columns: np.ndarray) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    columns["kind"] = np.full(size, kind)
    of = [c.split() for c in _MET.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[k], _MET_TYPES[t]) if k in columns else pa.nulls(size, _MET_TYPES[t]) for k, t in of], names=[k for k, _ in of])


def _groups(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rows whose key other lines post too, each class once at its earliest place, ordered by key and place."""
    pick = lambda at: {k: x[at] for k, x in c.items()}
    # most keys have one line: those without company in a table of counts go before anything is ordered
    slot = c["word"].astype(np.int64) & ((4 << len(c["word"]).bit_length()) - 1)
    c = pick(np.flatnonzero(np.bincount(slot)[slot] > 1)) if len(slot) else c
    word = c["word"].view(np.uint32).astype(_U) << _U(32)
    order = _settled(word | (c["digest"].view(_U) >> _U(32)), c["digest"])
    word, digest = c["word"][order], c["digest"][order]
    same = (word[1:] == word[:-1]) & (digest[1:] == digest[:-1])
    if same.any():
        # a class that several chunks have posted
        often = np.zeros(len(order), bool)
        often[1:] |= same
        often[:-1] |= same
        some = order[often]
        some = some[np.lexsort((c["tie"][some], c["doc"][some], c["digest"][some], c["word"][some]))]
        first = np.append(True, (c["word"][some][1:] != c["word"][some][:-1]) | (c["digest"][some][1:] != c["digest"][some][:-1]))
        once = np.zeros(len(order), bool)
        once[order[~often]] = True
        once[some[first]] = True
        order = order[once[order]]
    size = np.diff(np.append(tx.run_starts(c["word"][order]), len(order)))
    c = pick(order[np.repeat(size > 1, size)])
    word = c["word"].view(np.uint32).astype(_U) << _U(32)
    if len(word) and c["doc"].min() >= 0 and c["doc"].max() < 1 << 32:
        return pick(_settled(word | c["doc"].astype(_U), c["tie"], c["digest"]))
    return pick(np.lexsort((c["digest"], c["tie"], c["doc"], c["word"])))


def _earliest(c: dict[str, np.ndarray], low: int, high: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each active row the candidates before it in its group, from the ``low``-th to before the ``high``-th; and
    the rows that may have more."""
    start = tx.run_starts(c["word"])
    head = np.repeat(start, np.diff(np.append(start, len(c["word"]))))
    left = np.flatnonzero(c["active"] & (np.arange(len(head)) > head))
    met = np.zeros(len(head), np.int64)
    us, vs, more = [], [], []
    step = 0
    while len(left):
        u = head[left] + step
        hit = _may_match(c, u, left, percent)
        step += 1
        here = left[hit]
        took = met[here] >= low
        us.append(u[hit[took]])
        vs.append(here[took])
        met[here] += 1
        still = head[left] + step < left
        full = here[met[here] >= high]
        more.append(full[head[full] + step < full])
        if len(full):
            still[hit[met[here] >= high]] = False
        left = left[still]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs, more))


def _meet(low: int, high: int, percent: int):
    """Candidate pairs of rows ordered by bucket, the groups in which rows have more of them, and lines that are gone.

    Rows with ``asks`` only name, by key and digest, the rows of a later round that want candidates; in the first
    round, whose rows are packed, all rows do.
    """

    def flush(bucket: int, parts: list[dict[str, np.ndarray]]):
        c = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        if "asks" in c:
            name = tx.mix(c["digest"].view(_U)) ^ c["word"].astype(_U)
            asks = c.pop("asks")
            c["active"] = np.isin(name, name[asks])
            rows = ~asks & np.isin(c["word"], c["word"][asks])
            c = {k: x[rows] for k, x in c.items()}
        else:
            c["active"] = np.ones(len(c["word"]), bool)
        c = _groups(c)
        u, v, more = _earliest(c, low, high, percent)
        # a pair once a bucket
        _, at = np.unique(tx.mix(c["digest"][u].view(_U)) ^ c["digest"][v].view(_U), return_index=True)
        u, v = u[at], v[at]
        if len(u):
            yield _met_rows(0, **{name + k: c[x][at] for name, at in (("u", u), ("v", v)) for k, x in (("", "digest"), ("_doc", "doc"), ("_tie", "tie"))})
        if len(more):
            marked = np.zeros(len(c["word"]), bool)
            marked[more] = True
            rows = np.flatnonzero(np.isin(c["word"], c["word"][more]))
            yield _met_rows(1, bucket=np.full(len(rows), bucket), **{x: c[x][rows] for x in _COLUMNS}, more=marked[rows])

    def equal(parts: list[np.ndarray]):
        rows = np.concatenate(parts)
        c = {k: rows[k].astype(np.int64) for k in _HOLDER.names}
        _, gone = _repeated(c)
        if len(gone):
            yield _met_rows(2, **{k: c[k][gone] for k in _GONE.names})

    def meet(batches):
        now, parts, holders = None, [], []
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            packed = "packed" in batch.schema.names
            if packed:
                raw, places = tx.byte_view(batch.column("packed"))
                kinds = batch.column("kind").to_numpy()
            cuts = [*tx.run_starts(buckets.astype(np.int64) * 4 + kinds if packed else buckets).tolist(), len(buckets)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if buckets[a] != now:
                    if parts:
                        yield from flush(now, parts)
                    if holders:
                        yield from equal(holders)
                    parts, holders = [], []
                now = int(buckets[a])
                if not packed:
                    parts.append({k: batch.column(k).slice(a, b - a).to_numpy(zero_copy_only=False) for k in batch.schema.names if k != "bucket"})
                    continue
                piece, kind = raw[places[a] : places[b]], int(kinds[a])
                if kind < 2:
                    parts.append(_unpack(piece, bool(kind)))
                elif kind == 2:
                    holders.append(np.frombuffer(piece.tobytes(), _HOLDER))
                else:
                    rows = np.frombuffer(piece, _GONE)
                    yield _met_rows(2, **{k: rows[k].astype(np.int64) for k in _GONE.names})
        if parts:
            yield from flush(now, parts)
        if holders:
            yield from equal(holders)
        tx.trim()

    return meet


#: The full set of a wanted line, by the class's first digest half and place; and the line itself.
_SETS = "digest long, doc long, tie long, k1 long, k2 long, line int, set binary"
_SET_NAMES = [c.split()[0] for c in _SETS.split(", ")]


def _sets(min_words: int):
    def sets(batches):
        for batch in tx.chunks(batches):
            # only the wanted lines of each document
            lines, at = tx.split_lines(tx.texts(batch))
            wanted = batch.column("wanted")
            row = np.repeat(np.arange(len(batch)), pc.list_value_length(wanted).to_numpy())
            number = wanted.flatten().to_numpy()
            # a text that only shares its hash with the wanted one may be shorter
            have = number < np.diff(at)[row]
            row, number = row[have], number[have]
            found = _Lines(lines.take(pa.array(at[row] + number)), min_words)
            row, number = row[found.live], number[found.live]
            data = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((found.offsets * 8).astype(np.int32)), pa.py_buffer(found.tokens)])
            doc, k1, k2 = (batch.column(c).to_numpy()[row] for c in ("doc", "k1", "k2"))
            tie = ((k1 >> 32) << 32) | number
            yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in (found.digest(), doc, tie, k1, k2, number)], data], names=_SET_NAMES)

    return sets


#: A class that an earlier one matches, and its earliest line.
_MATCHED = "digest long, k1 long, k2 long, line int"


def _confirm(percent: int):
    def confirm(batches):
        for batch in tx.chunks(tx.chunks(batches, "set_u"), "set_v"):
            sets = [tx.byte_view(batch.column(s)) for s in ("set_u", "set_v")]
            size = [np.diff(at) // 8 for _, at in sets]
            pair = np.concatenate([np.repeat(np.arange(len(batch)), n) for n in size])
            token = np.concatenate([np.frombuffer(raw.tobytes(), _U) for raw, _ in sets])
            order = tx.order_rows(pair, token)
            pair, token = pair[order], token[order]
            common = np.bincount(pair[1:][(token[1:] == token[:-1]) & (pair[1:] == pair[:-1])], minlength=len(batch))
            keep = np.flatnonzero(100 * common >= percent * (size[0] + size[1] - common))
            yield batch.select([c.split()[0] for c in _MATCHED.split(", ")]).take(pa.array(keep))

    return confirm


def _matches(met: DataFrame, docs: DataFrame, percent: int, min_words: int) -> DataFrame:
    """The classes that an earlier one matches, by the first halves of their digests, with their earliest lines; of
    candidate pairs (u, v)."""
    place = ["digest", "doc", "tie"]
    names = {s: [F.col(c).alias(k) for c, k in zip((s, f"{s}_doc", f"{s}_tie"), place, strict=True)] for s in "uv"}
    pairs = write_table(met.filter("kind = 0").select(*[c for s in "uv" for c in (s, f"{s}_doc", f"{s}_tie")]).distinct(), "pairs")
    ends = pairs.select(F.explode(F.array(*[F.struct(*names[s]) for s in "uv"])).alias("end")).select("end.doc", "end.tie")
    lines = F.collect_set(F.col("tie").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("wanted")
    wanted = write_table(ends.groupBy(F.col("doc").alias("at"), F.shiftright("tie", 32).alias("hash")).agg(lines), "wanted")
    few = (wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0) <= BROADCAST_LINES
    asked = _named(docs.withColumn("doc", _place(docs)).join(F.broadcast(wanted) if few else wanted, F.col("doc") == F.col("at")), "doc", "hash", "wanted")
    sets = asked.filter(F.shiftright("k1", 32) == F.col("hash")).select("doc", "k1", "k2", "text", "wanted").mapInArrow(_sets(min_words), _SETS)
    sets = write_table(sets.groupBy(*_SET_NAMES[:-1]).agg(F.first("set").alias("set")), "sets")
    v = sets.select(*[F.col(k).alias(c) for k, c in zip(place, ("v", "v_doc", "v_tie"), strict=True)], "k1", "k2", "line", F.col("set").alias("set_v"))
    u = sets.select(*[F.col(k).alias(c) for k, c in zip(place, ("u", "u_doc", "u_tie"), strict=True)], F.col("set").alias("set_u"))
    full = pairs.join(v, ["v", "v_doc", "v_tie"]).join(u, ["u", "u_doc", "u_tie"])
    return write_table(full.select(F.col("v").alias("digest"), "k1", "k2", "line", "set_u", "set_v").mapInArrow(_confirm(percent), _MATCHED).distinct(), "matched")


def _key(docs: DataFrame) -> list[Column]:
    """128 bits that name a document by its id and text."""
    return [F.xxhash64(F.lit(k), docs["doc_id"].cast("long"), docs["text"]) for k in (1, 2)]


def _place(docs: DataFrame) -> Column:
    return F.coalesce("doc_id", F.lit(_LAST)).cast("long")


def _named(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*[k.alias(c) for k, c in zip(_key(docs), ("k1", "k2"), strict=True)], "text", *more)


def removed_lines(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, k2, n): every row of ``docs`` by ``_key`` with its number of lines of at least ``min_words`` words; and
    (k1, k2, removed): documents that lose some, with the line numbers (from 0) that go."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = write_table(_named(docs, "doc_id").mapInArrow(_line_counts(min_words), _COUNTS), "lines")
    blocks = rows.filter("block IS NOT NULL").select("block", "packed").repartition("block").mapInArrow(_summed_blocks, "block int, packed binary").toArrow().sort_by("block")
    shared = spark.sparkContext.broadcast(np.concatenate([np.frombuffer(x, np.int32) for x in blocks["packed"].to_pylist()]) if len(blocks) else np.zeros(1 << BITS, np.int32))

    buckets = 8 * max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = _named(docs.withColumn("doc", _place(docs)), "doc")
    postings = texts.mapInArrow(_postings(shared, buckets, min_words, percent, HOT_LINES), _POSTINGS)
    meet = lambda table, low, high: write_table(table.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet(low, high, percent), _MET), "met")
    met = meet(postings, 0, FIRST)
    equal = met.filter("kind = 2").select("k1", "k2", "line")
    matched = _matches(met, docs, percent, min_words)
    low, high = FIRST, 16 * FIRST
    while True:
        # rows that have more candidates and no match yet; they meet their groups again
        groups = met.filter("kind = 1")
        asks = write_table(groups.filter("more").select("bucket", "word", "digest").join(matched.select("digest").distinct(), "digest", "left_anti"), "open")
        if not asks.limit(1).count():
            break
        named = asks.select("bucket", *[F.col(c) if c in ("word", "digest") else F.lit(0).cast(groups.schema[c].dataType).alias(c) for c in _COLUMNS], F.lit(True).alias("asks"))
        met = meet(groups.select("bucket", *_COLUMNS, F.lit(False).alias("asks")).unionByName(named), low, high)
        matched = matched.unionByName(_matches(met, docs, percent, min_words))
        low, high = high, 16 * high

    gone = equal.unionByName(matched.select("k1", "k2", "line"))
    removed = gone.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    return rows.filter("block IS NULL").select("doc_id", "k1", "k2", "n"), removed


def _without(text: str, hits: list[int]) -> str:
    gone = set(hits)
    return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)


def drop_lines(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, least_words: int = 0) -> DataFrame:
    """``docs`` without the lines that match an earlier one; columns as given (``n_chars`` follows the text).

    Documents come in the order of their ids, a null id last; different texts under one id (or none) are documents
    of their own, ordered by a hash of the text. Rows with the same id and text are one document and keep the same
    lines. Null and empty texts have no lines. A document that loses lines and has fewer than ``least_words`` words
    left goes; with 0 it stays, with an empty text if all its lines went. Other columns may have any names. No rows
    give no rows.
    """
    _, removed = removed_lines(docs, percent, min_words)
    a, b, hits = fresh_names(docs, "k1", "k2", "removed")
    found = removed.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("removed").alias(hits))
    k1, k2 = _key(docs)
    named = [F.col(f"`{c}`") for c in docs.columns]
    out = edit_texts(docs.withColumns({a: k1, b: k2}).join(found, [a, b], "left").select(*named, hits), hits, _without)
    if least_words:
        left = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
        out = out.filter(F.col(hits).isNull() | (left >= least_words))
    out = out.select(*named)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op10_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 3 words and lines removed, by document, over all documents; with a hash of the line numbers removed."""
    docs = documents(spark, sf_dir)
    lines, removed = removed_lines(docs)
    rows = lines.join(removed, ["k1", "k2"], "left")
    numbers = F.coalesce("removed", F.array().cast("array<int>"))
    return rows.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), F.col("n").cast("long").alias("n_lines"), F.size(numbers).cast("long").alias("n_removed"), F.sha2(F.array_join(numbers.cast("array<string>"), ","), 256).alias("removed_sha256"))
