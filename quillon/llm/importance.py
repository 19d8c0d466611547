"""Target-distribution importance resampling: array-scored weights, winners by distributed quickselect.

Features are runs of one and two words, counted in ``BUCKETS`` hashed buckets over all texts and over the target.
A text's weight is the mean gain of its features, looked up in one array of gains. Gumbel noise makes the draw of
the highest scores a draw without replacement by weight. The k-th composite key is found by quickselect: random
rows are pivots, exact counts of the rows before, at and after each pivot tell between which two the k-th lies, and
only these rows go on. Only the winners are sorted, by ranges, and ranked by the rows in the ranges before.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .tables import documents, write_table

BUCKETS = 10_000
#: Pivots of one round of the selection.
PIVOTS = 63
#: A word of more bytes is hashed by itself, not in whole arrays.
_LONG = 48

_U = np.uint32


def _byte_table() -> np.ndarray:
    """crc32 by one zero byte and the values of each byte: the state's linear step."""
    value = np.arange(256, dtype=_U)
    for _ in range(8):
        value = np.where(value & _U(1), (value >> _U(1)) ^ _U(0xEDB88320), value >> _U(1))
    return value


_STEP = _byte_table()


def _shift_tables() -> np.ndarray:
    """``[n, j, b]``: what byte j of a crc, of value b, becomes when n bytes follow."""
    out = np.empty((_LONG + 1, 4, 256), _U)
    out[0] = np.arange(256, dtype=_U)[None, :] << (8 * np.arange(4, dtype=_U))[:, None]
    for n in range(1, _LONG + 1):
        out[n] = (out[n - 1] >> _U(8)) ^ _STEP[out[n - 1] & _U(255)]
    return out


_SHIFT = _shift_tables()


def _crc(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words.cast(pa.binary()).to_pylist()), _U, len(words))


def _after(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part of crc32(a + b) that a, with this crc, adds to crc32(b) of n bytes."""
    out = _SHIFT[n, 0, crc & _U(255)]
    for j in range(1, 4):
        out = out ^ _SHIFT[n, j, (crc >> _U(8 * j)) & _U(255)]
    return out


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of the words of all rows, where rows begin, and the distinct words."""
    clean = pc.replace_substring_regex(pc.ascii_lower(column), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    lists = pc.split_pattern(clean, " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    keep = codes != empty
    return codes[keep], np.concatenate(([0], np.cumsum(keep)))[offsets - offsets[0]], coded.dictionary


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words by row, and of all features the row and the bucket."""
    codes, offsets, words = _words(column)
    row = tx.row_of(offsets)
    crc = _crc(words)
    spaced = _STEP[(crc ^ _U(0xFFFFFFFF) ^ _U(32)) & _U(255)] ^ ((crc ^ _U(0xFFFFFFFF)) >> _U(8)) ^ _U(0xFFFFFFFF)
    length = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
    a, b = codes[first], codes[first + 1]
    pair = _after(spaced[a], np.minimum(length[b], _LONG)) ^ crc[b]
    far = np.flatnonzero(length[b] > _LONG)
    if len(far):
        wanted = words.take(pa.array(b[far])).cast(pa.binary()).to_pylist()
        pair[far] = np.fromiter((zlib.crc32(w, int(c)) for w, c in zip(wanted, spaced[a[far]], strict=True)), _U, len(far))
    return np.diff(offsets), np.concatenate((row, row[first])), np.concatenate((crc[codes], pair)).astype(np.int64) % BUCKETS


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all texts in each bucket; tasks add up their own rows first, so few rows are shuffled."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in tx.chunks(batches):
            total += np.bincount(_features(tx.texts(batch))[2], minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # at most BUCKETS rows
        out[bucket] = n
    return out


def gains(all_counts: np.ndarray, target_counts: np.ndarray) -> np.ndarray:
    s, t = all_counts.astype(float), target_counts.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def _score(gain: np.ndarray):
    def score(batches):
        for batch in tx.chunks(batches):
            n, row, bucket = _features(tx.texts(batch))
            features = np.where(n > 0, 2 * n - 1, 0)
            total = np.zeros(len(n), np.int64)
            for part in (slice(None, len(row) - int((features - n).sum())), slice(len(row) - int((features - n).sum()), None)):
                total += tx.sums(gain[bucket[part]], np.concatenate(([0], np.cumsum(np.bincount(row[part], minlength=len(n))))))
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(n), pa.array(features), pa.array(weight)], names=["doc_id", "tie", "n_words", "n_features", "weight"])

    return score


def noise(doc_id: Column, seed: int = 7) -> Column:
    """Gumbel noise by id, in thousandths; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(2.0**32))))


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, tie, n_words, n_features, weight, score, rid), written once; ``rid`` numbers the rows.

    Null texts count as empty: no words, weight 0. Rows with equal ids are rows of their own. Without target
    texts all counts of the target are 0. Other columns of either table are ignored.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("tie"), "text")
    scored = rows.mapInArrow(_score(gain), "doc_id long, tie string, n_words long, n_features long, weight long")
    return write_table(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"))).withColumn("rid", F.monotonically_increasing_id()), "scored")


def _composite() -> Column:
    """Smallest first: high scores, then small ids (null last), then texts, then rows; no two rows are equal."""
    return F.struct((-F.col("score")).alias("s"), F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "tie", "rid")


def _literal(key: tuple) -> Column:
    s, none, doc, tie, rid = key
    return F.struct(F.lit(s).cast("long").alias("s"), F.lit(none).alias("none"), F.lit(doc).cast("long").alias("id"), F.lit(tie).alias("tie"), F.lit(rid).cast("long").alias("rid"))


def kth_key(keyed: DataFrame, k: int, pivots: int = PIVOTS) -> tuple | None:
    """The k-th smallest ``key`` (from 1) of a table whose keys differ; None if it has fewer rows.

    A round draws pivots at random among the rows that are left, counts the rows between and at them, and keeps the
    rows between the two that enclose the k-th. Rows shrink by about the number of pivots in each round.
    """
    low = high = None
    round_no = 0
    while True:
        left = keyed
        if low is not None:
            left = left.filter(F.col("key") > _literal(low))
        if high is not None:
            left = left.filter(F.col("key") < _literal(high))
        drawn = sorted(tuple(r.key) for r in left.orderBy(F.xxhash64(F.lit(round_no), "key.rid", "key.id"), "key").limit(pivots).collect())
        if not drawn:
            return None
        chosen = F.array(*[_literal(p) for p in drawn])
        # 2 i for the rows before pivot i, 2 i + 1 for pivot i itself
        place = left.select((F.size(F.filter(chosen, lambda p: p < F.col("key"))) * 2 + F.array_contains(chosen, F.col("key")).cast("int")).alias("place"))
        counts = dict(place.groupBy("place").count().collect())  # at most 2 * pivots + 1 rows
        for i in range(2 * len(drawn) + 1):
            n = counts.get(i, 0)
            if k <= n:
                break
            k -= n
        else:
            return None
        if i % 2:
            return drawn[i // 2]
        low, high = (drawn[i // 2 - 1] if i else low), (drawn[i // 2] if i // 2 < len(drawn) else high)
        round_no += 1


def _numbered(batches):
    at = 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at + 1, at + 1 + batch.num_rows))], names=[*batch.schema.names, "place"])
        at += batch.num_rows


def draw(scored: DataFrame, percent: int = 25, min_words: int = 20) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3, ... of the highest scores of ``percent`` of the rows with enough words, else null."""
    able = scored.filter(F.col("n_words") >= min_words).withColumn("key", _composite())
    k = able.count() * percent // 100
    worst = kth_key(able.select("key"), k) if k else None
    none = F.lit(None).cast("long")
    if worst is None:
        return scored.withColumn("rank", none)
    wins = (F.col("n_words") >= min_words) & (_composite() <= _literal(worst))
    columns = scored.columns
    ranges = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["_s", "_none", "_id", "tie", "rid"]
    winners = scored.filter(wins).withColumns({"_s": -F.col("score"), "_none": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0))})
    ranged = winners.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    ranged = ranged.select(*columns, "range")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema)
    # written once: the ranges are drawn by sampling, and both uses below must see the same ones
    placed = write_table(ranged.mapInArrow(_numbered, schema + ", place long"), "winners")
    sizes = dict(placed.groupBy("range").count().collect())  # one row a range
    before, total = [], 0
    for r in range(ranges):
        before.append(total)
        total += sizes.get(r, 0)
    rank = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("range") + 1) + F.col("place")
    return placed.select(*columns, rank.alias("rank")).unionByName(scored.filter(~wins).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``; see ``score`` and ``draw``."""
    return draw(score(docs, target), percent, min_words).drop("tie", "rid")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document against ``benchmark``. Nulls and repeats as in ``score``; no rows give none."""
    drawn = resample(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
