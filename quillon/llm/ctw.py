"""Language-model scoring by context-tree weighting.

The model predicts the bytes of a lower-cased text, and one end byte, from the bytes before. A byte
is decomposed into eight binary decisions; each decision has a context tree over the last DEPTH
bytes. A node estimates its next bit by Krichevsky and Trofimov from its counts, and weighs its own
block probability against the product of its children's, half and half; so a prediction mixes the
estimates of all depths by how well each has coded the training texts. Counts determine the weights
whatever the order of the texts, so training is counting.

Both the byte-gram counts and the word counts of the base model grow with the corpus, and neither is
ever broadcast. Documents come in blocks: a block asks for the distinct grams and words that it
holds, the answers are computed where their keys lie and sent to the block, and the block's
documents are read against them. What may be collected are the two top levels of the trees, at most
256 contexts of 255 decisions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .labelled import remainder
from .tables import documents, write_table

DEPTH = 4
#: Bytes of text of a block, about; a longer single text is taken whole.
BLOCK_BYTES = 16 << 20
#: Grams that a task weighs at once, if no two context bytes have more.
_WEIGHED = 300_000
_U = np.uint64
_HALF = math.log(0.5)
#: The end token; no word is empty.
_END = int(tx.hashes(pa.array([""]), 41).view(np.int64)[0])
_CHUNK = 2 << 20


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The DEPTH bytes before and the byte itself as one integer, for each byte and the end of each text; offsets."""
    raw, at = tx.byte_view(column)
    n = len(column)
    length = np.diff(at)
    # each text lies behind DEPTH zero bytes and before one
    place = at[:-1] + np.arange(n) * (DEPTH + 1) + DEPTH
    buffer = np.zeros(len(raw) + n * (DEPTH + 1), _U)
    buffer[np.arange(len(raw)) + np.repeat(place - at[:-1], length)] = raw
    size = max(0, len(buffer) - DEPTH)
    key = np.zeros(size, _U)
    for k in range(DEPTH + 1):
        key = (key << _U(8)) | buffer[k : k + size]
    offsets = np.concatenate(([0], np.cumsum(length + 1)))
    return key[np.arange(offsets[-1]) + np.repeat(np.arange(n) * DEPTH, length + 1)], offsets


def _distinct(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        keys = np.sort(keys)
        at = tx.run_starts(keys)
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = tx.run_starts(keys)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


_HELD = 600_000


def _ask(batches):
    """Distinct words (kind 0) and grams (kind 1) by block, with their training counts."""
    held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def out(keep: bool):
        nonlocal size
        size = 0
        for (block, kind), parts in held.items():
            keys, counts = _distinct(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            held[block, kind] = [(keys, counts)]
            size += len(keys)
        if keep and size < _HELD:
            return
        for (block, kind), parts in held.items():
            keys, counts = parts[0]
            for a in range(0, len(keys), 100_000):
                part = keys[a : a + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, np.int64)), pa.array(np.full(len(part), kind, np.int32)), pa.array(part), pa.array(counts[a : a + 100_000])], names=["block", "kind", "key", "n"])
        held.clear()
        size = 0

    for batch in tx.chunks(batches, size=_CHUNK):
        blocks, train = batch.column("block").to_numpy(), batch.column("train").to_numpy(zero_copy_only=False)
        column = pc.ascii_lower(tx.texts(batch))
        for block in np.unique(blocks).tolist():
            for trained in (True, False):
                mine = np.flatnonzero((blocks == block) & (train == trained))
                if not len(mine):
                    continue
                some = column.take(pa.array(mine))
                words = tx.tokenise(some)
                used = np.bincount(words.codes, minlength=len(words.words))
                at = np.flatnonzero(used)
                hashed = np.append(tx.hashes(words.words.take(pa.array(at)), 41), np.array([_END], np.int64).view(_U))
                number = np.append(used[at], len(mine))
                keys, counts = _distinct(grams(some)[0])
                for kind, k, c in ((0, hashed, number), (1, keys, counts)):
                    held.setdefault((block, kind), []).append((k, c * int(trained)))
                    size += len(k)
        if size > 2 * _HELD:
            yield from out(keep=True)
    yield from out(keep=False)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, by Stirling's series after eight steps up."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    low = y < 8
    for _ in range(8):
        shift[low] += np.log(y[low])
        y[low] += 1
        low = y < 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Krichevsky and Trofimov's log probability of any sequence with a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - math.log(math.pi)


def weigh(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, pd.DataFrame]:
    """For grams that share no second context byte with others: their bits' probabilities mixed over depths 2 and
    more (grams x 8), and for each (last byte, decision) the counts and log weighted probabilities summed up."""
    out = np.empty((len(keys), 8))
    symbol = (keys & _U(255)).astype(np.int64)
    context = keys >> _U(8)
    n = n.astype(np.float64)
    top = []
    for k in range(8):
        node = ((1 << k) | (symbol >> (8 - k))).astype(_U)
        bit = (symbol >> (7 - k)) & 1
        below = None
        levels = []
        for d in range(DEPTH, 1, -1):
            own = ((context & _U((1 << (8 * d)) - 1)) << _U(8)) | node
            ids, inverse = np.unique(own, return_inverse=True)
            a, b = np.bincount(inverse, n * (bit == 0), len(ids)), np.bincount(inverse, n * bit, len(ids))
            alone = log_kt(a, b)
            if below is None:
                weighted, share = alone, np.ones(len(ids))
            else:
                child_ids, child_weight = below
                parent = (((child_ids >> _U(8)) & _U((1 << (8 * d)) - 1)) << _U(8)) | (child_ids & _U(255))
                children = np.bincount(np.searchsorted(ids, parent), child_weight, len(ids))
                weighted = _HALF + np.logaddexp(alone, children)
                share = np.exp(_HALF + alone - weighted)
            estimate = (np.where(bit == 1, b[inverse], a[inverse]) + 0.5) / (a + b + 1)[inverse]
            levels.append((share[inverse], estimate))
            below = ids, weighted
        mixed = levels[0][1]
        for share, estimate in levels[1:]:
            mixed = share * estimate + (1 - share) * mixed
        out[:, k] = mixed
        ids, weighted = below
        last = (((ids >> _U(8)) & _U(255)) << _U(8)) | (ids & _U(255))
        top.append(pd.DataFrame({"key": last.astype(np.int64), "a": a, "b": b, "w": weighted}))
    return out, pd.concat(top).groupby("key", as_index=False).sum()


_MODEL = "kind int, key long, bits binary, a double, b double, w double"


def _weigh_task(batches):
    """Grams ordered by their last two context bytes, in runs that share no such pair with others. A pair has 2**24 grams at most."""
    names = ["kind", "key", "bits", "a", "b", "w"]
    none = pa.nulls

    def flush(parts):
        keys, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        bits, top = weigh(keys, n)
        for at in range(0, len(keys), 50_000):
            part = [x.tobytes() for x in bits[at : at + 50_000]]
            size = len(part)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, 1, np.int32)), pa.array(keys[at : at + size].view(np.int64)), pa.array(part, pa.binary()), *[none(size, pa.float64())] * 3], names=names)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), 2, np.int32)), pa.array(top["key"].to_numpy()), none(len(top), pa.binary()), *[pa.array(top[c].to_numpy()) for c in "abw"]], names=names)

    held, size = [], 0
    for batch in batches:
        keys, n, pair = batch.column("key").to_numpy().view(_U), batch.column("n").to_numpy(), batch.column("pair").to_numpy()
        if not len(keys):
            continue
        last = 0
        if size + len(keys) > _WEIGHED:
            # up to the last change of pair
            cuts = np.flatnonzero(np.diff(pair)) + 1
            if held and pair[0] != now:
                cuts = np.append(0, cuts)
            if len(cuts):
                last = int(cuts[-1])
                yield from flush([*held, (keys[:last], n[:last])])
                held, size = [], 0
        held.append((keys[last:], n[last:]))
        size += len(keys) - last
        now = pair[-1]
    if held:
        yield from flush(held)
    tx.trim()


def top_levels(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Weights and estimates at depths 1 (context, decision, bit) and 0 (decision, bit), from sums by (last byte, decision)."""
    a, b, w = (np.zeros((256, 256)) for _ in range(3))
    at = rows["key"].to_numpy(np.int64)
    for x, c in ((a, "a"), (b, "b"), (w, "w")):
        x[at >> 8, at & 255] = rows[c]
    alone = log_kt(a, b)
    weighted = _HALF + np.logaddexp(alone, w)
    share1 = np.exp(_HALF + alone - weighted)
    used = a + b > 0
    a0, b0, w0 = a.sum(axis=0), b.sum(axis=0), np.where(used, weighted, 0.0).sum(axis=0)
    alone0 = log_kt(a0, b0)
    share0 = np.exp(_HALF + alone0 - (_HALF + np.logaddexp(alone0, w0)))
    kt = lambda zeros, ones: np.stack([(zeros + 0.5) / (zeros + ones + 1), (ones + 0.5) / (zeros + ones + 1)], axis=-1)
    return share1, kt(a, b), share0, kt(a0, b0)


def log_probability(keys: np.ndarray, bits: np.ndarray, top: tuple[np.ndarray, ...]) -> np.ndarray:
    """log10 of each gram's last byte after the bytes before it."""
    share1, kt1, share0, kt0 = top
    symbol, last = (keys & _U(255)).astype(np.int64), ((keys >> _U(8)) & _U(255)).astype(np.int64)
    total = np.zeros(len(keys))
    for k in range(8):
        node, bit = (1 << k) | (symbol >> (8 - k)), (symbol >> (7 - k)) & 1
        one = share1[last, node] * kt1[last, node, bit] + (1 - share1[last, node]) * bits[:, k]
        total += np.log10(share0[node] * kt0[node, bit] + (1 - share0[node]) * one)
    return total


def _answer(top):
    def answer(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy().view(_U)
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.float64).reshape(-1, 8)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(log_probability(keys, bits, top.value))], names=["key", "value"])

    return answer


class Lookup:
    """Distinct unsigned keys with numbers, in order of key: 16 bytes a key; read in whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys) and len(keys):
            raise KeyError("a key that its block did not ask for")
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        if (self.keys[at] != keys).any():
            raise KeyError("a key that its block did not ask for")
        return self.values[at]


SCORES = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"


def _read(totals: tuple[int, int]):
    tokens, vocabulary = totals

    def read(batches):
        block = None
        held: dict[int, list] = {}
        tables: dict[int, Lookup] = {}
        for batch in batches:
            kinds, blocks = batch.column("kind").to_numpy(), batch.column("block").to_numpy()
            cut = np.flatnonzero(np.diff(kinds) | np.diff(blocks)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(kinds)], strict=True):
                if a == b:
                    continue
                part, kind = batch.slice(a, b - a), int(kinds[a])
                if blocks[a] != block:
                    block, held, tables = blocks[a], {0: [], 1: []}, {}
                    tx.trim()
                if kind < 2:
                    # copies: a view keeps the whole batch
                    held[kind].append((part.column("key").to_numpy().view(_U).copy(), part.column("value").to_numpy().copy()))
                    continue
                if not tables:
                    for k in (0, 1):
                        parts = held.pop(k)
                        tables[k] = Lookup(np.concatenate([h[0] for h in parts]), np.concatenate([h[1] for h in parts]))
                        del parts
                for rows in tx.chunks([part], size=_CHUNK):
                    column = pc.ascii_lower(tx.texts(rows))
                    words = tx.tokenise(column)
                    count = tables[0](tx.hashes(words.words, 41))  # an empty string among them asks for the end token, and no word is it
                    end = tables[0](np.array([_END], np.int64).view(_U))[0]
                    by_word = np.log10((count + 1) / (tokens + vocabulary + 1))
                    key, offsets = grams(column)
                    yield pa.RecordBatch.from_arrays(
                        [
                            rows.column("doc_id"),
                            rows.column("train"),
                            pa.array(np.diff(words.offsets) + 1),
                            pa.array(tx.sums((count > 0)[words.codes], words.offsets) + int(end > 0)),
                            pa.array(tx.sums(by_word[words.codes], words.offsets) + math.log10((end + 1) / (tokens + vocabulary + 1))),
                            pa.array(tx.sums(tables[1](key), offsets)),
                            pa.array(np.diff(offsets)),
                        ],
                        names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score", "n_bytes"],
                    )

    return read


def _in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with ``block``: about BLOCK_BYTES of text each, however ids lie. Runs of neighbouring ids, which usually
    lie in one file, share a block, so that a task asks for few; where one gets too many bytes (null or equal ids,
    long texts), it is split by a hash of the texts."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(1))).first()
    blocks, length = max(1, -(-total // BLOCK_BYTES)), max(1, n * BLOCK_BYTES // max(1, total))
    rows = rows.withColumn("run", F.pmod(F.floor(F.coalesce("doc_id", F.lit(0)) / length).cast("long"), F.lit(blocks)))
    heavy = rows.groupBy("run").agg(F.sum(size).alias("bytes")).filter(F.col("bytes") > 1.5 * BLOCK_BYTES)
    heavy = write_table(heavy.select("run", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("long").alias("parts")), "heavy")
    part = F.pmod(F.xxhash64("text", "doc_id"), F.coalesce("parts", F.lit(1)))
    return rows.join(heavy, "run", "left").select("doc_id", "text", (F.shiftleft("run", 24) + part).alias("block"), "train")


def score(docs: DataFrame, train) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    ``train`` is a boolean column of ``docs``: the rows to learn from. ``base_score`` is the add-one
    word model's, ``score`` this model's log10 probability of the whole lower-cased text and its end.
    Null and empty texts are an end alone. Repeated rows count and are scored one by one; other
    columns are ignored; no rows give no rows, and no training rows the uniform model.
    """
    spark = docs.sparkSession
    rows = _in_blocks(docs.select("doc_id", "text", train.alias("train")))
    asked = write_table(rows.mapInArrow(_ask, "block long, kind int, key long, n long"), "asked")

    words = write_table(asked.filter("kind = 0").groupBy("key").agg(F.sum("n").alias("c")), "words")
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()

    counted = asked.filter("kind = 1").groupBy("key").agg(F.sum("n").alias("n"))
    dealt = counted.withColumn("pair", F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)).cast("int")).repartition("pair").sortWithinPartitions("pair")
    model = write_table(dealt.mapInArrow(_weigh_task, _MODEL), "contexts")
    top = model.filter("kind = 2").groupBy("key").agg(*[F.sum(c).alias(c) for c in "abw"]).toArrow().to_pandas()
    shared = spark.sparkContext.broadcast(top_levels(top))  # 256 contexts x 255 decisions
    answers = model.filter("kind = 1").select("key", "bits").mapInArrow(_answer(shared), "key long, value double")

    for_words = asked.filter("kind = 0").select("block", "kind", "key").join(words, "key").select("block", "kind", "key", F.col("c").cast("double").alias("value"))
    for_grams = asked.filter("kind = 1").select("block", "kind", "key").join(answers, "key").select("block", "kind", "key", "value")
    none = [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("boolean").alias("train")]
    # a block that two tasks have met asks twice and is told the same
    replies = for_words.unionByName(for_grams).select("block", "kind", "key", "value", *none)
    texts = rows.select("block", F.lit(2).alias("kind"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("value"), "doc_id", "text", "train")
    met = replies.unionByName(texts).repartition("block").sortWithinPartitions("block", "kind")
    scored = met.mapInArrow(_read((int(totals[0]), int(totals[1]))), SCORES)
    bits = -F.col("score") * math.log2(10) / F.col("n_bytes")
    return scored.select("doc_id", "train", "n_tokens", "n_known", F.lit(int(totals[0])).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and context-tree scores of all documents, learnt from those outside remainder 2 of 7."""
    held_out = remainder("doc_id", 7) == 2
    scored = score(documents(spark, sf_dir), ~held_out)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
