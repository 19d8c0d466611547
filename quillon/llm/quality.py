"""Quality rules by cross-document line frequency.

Every line is normalised (A-Z lower-cased, digits to 0, white space collapsed) and hashed to 128
bits. A line that occurs in more distinct documents of one host than the limit allows is
boilerplate of that host and is removed; a document that loses too much of itself is rejected, as
is one that fails the base rules. Exact copies of a text count as one document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .tables import documents, edit_texts, fresh_names, write_table


@dataclass(frozen=True)
class Limits:
    #: A line may be in this many distinct documents of a host, however large the host.
    documents: int = 10
    #: A document is depleted if less than this share of its words is left.
    left: float = 0.3
    min_words: int = 50
    max_repeat_percent: int = 50


_FEATURES = "doc_id long, host long, t1 long, t2 long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<a:long,b:long,words:long>>"
_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = 1
_IN_WORD = np.ones(256, np.int64)
_IN_WORD[[0x20, 9, 10, 11, 12, 13]] = 0
_IN_WORD[0x80:0xC0] = 0  # later bytes of a code point


def _repeated(codes: np.ndarray, offsets: np.ndarray, vocabulary: int) -> np.ndarray:
    """Per row, words inside 3-word windows that occur twice or more in the row."""
    n = len(codes)
    if n < 3:
        return np.zeros(len(offsets) - 1, np.int64)
    row = tx.row_of(offsets)
    at = np.flatnonzero(row[2:] == row[:-2])
    a, b, c, d = codes[at], codes[at + 1], codes[at + 2], row[at]
    u = np.uint64
    key = tx.mix(a.astype(u) * u(0x9E3779B97F4A7C15) + b.astype(u) * u(0xC2B2AE3D27D4EB4F) + c.astype(u) * u(0x165667B19E3779F9) + d.astype(u) * u(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    a, b, c, d = a[order], b[order], c[order], d[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (c[1:] == c[:-1]) & (d[1:] == d[:-1])
    if np.any((key[order][1:] == key[order][:-1]) != same):  # two windows share a hash: order by the windows
        order = np.lexsort((codes[at + 2], codes[at + 1], codes[at], row[at]))
        a, b, c, d = codes[at][order], codes[at + 1][order], codes[at + 2][order], row[at][order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (c[1:] == c[:-1]) & (d[1:] == d[:-1])
    twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
    start = at[order[twice]]
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[start + k] = True
    return tx.sums(covered, offsets)


def _line_hashes(words: tx.Tokens, seed: int, base: int) -> np.ndarray:
    normal = pc.replace_substring_regex(pc.ascii_lower(words.words), "[0-9]", "0")
    return tx.sequence_hash(tx.hashes(normal, seed)[words.codes], words.offsets, base)


def _signatures(lines: pa.Array) -> tuple[tx.Tokens, np.ndarray, np.ndarray]:
    words = tx.tokenise(lines)
    return words, _line_hashes(words, 1, 0x5851F42D4C957F2D).view(np.int64), _line_hashes(words, 2, 0x2545F4914F6CDD1D).view(np.int64)


def _features(batches):
    for batch in tx.chunks(batches):
        column = tx.texts(batch)
        lines, line_at = tx.split_lines(column)
        words, a, b = _signatures(lines)
        offsets = words.offsets[line_at]
        raw, at = tx.byte_view(column)
        n = np.diff(words.offsets)
        doc = tx.row_of(line_at)
        # lines equal to an earlier line of the same document
        code = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        with_word = np.flatnonzero(n)
        _, first = np.unique(doc[with_word] * (len(lines) + 1) + code[with_word], return_index=True)
        again = np.zeros(len(lines), np.int64)
        again[with_word] = 1
        again[with_word[first]] = 0
        # distinct normalised lines of each document, with the words they hold in it
        order = with_word[np.lexsort((b[with_word], a[with_word], doc[with_word]))]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (doc[order][1:] != doc[order][:-1]) | (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        start = np.flatnonzero(fresh)
        held = np.add.reduceat(n[order], start) if len(start) else np.zeros(0, np.int64)
        keep = order[start]
        struct = pa.StructArray.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(held.astype(np.int64))], ["a", "b", "words"])
        places = np.searchsorted(doc[keep], np.arange(len(column) + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("host"),
                batch.column("t1"),
                batch.column("t2"),
                pa.array(np.diff(offsets)),
                pa.array(tx.sums(_IN_WORD[raw], at)),
                pa.array(tx.sums(_SYMBOLS[raw], at)),
                pa.array(tx.sums(again, line_at)),
                pa.array(_repeated(words.codes, offsets, len(words.words))),
                pa.ListArray.from_arrays(pa.array(places), struct),
            ],
            names=["doc_id", "host", "t1", "t2", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
        )


def _text_key() -> list[Column]:
    """128 bits that name a text."""
    return [F.xxhash64(F.lit(k), F.col("text")) for k in (1, 2)]


def measure(docs: DataFrame) -> DataFrame:
    """One row per document with its base counts and its distinct line hashes, written once."""
    t1, t2 = _text_key()
    rows = docs.select("doc_id", F.xxhash64(F.col("source")).alias("host"), t1.alias("t1"), t2.alias("t2"), "text")
    return write_table(rows.mapInArrow(_features, _FEATURES).withColumn("rid", F.monotonically_increasing_id()), "quality")


def frequent_lines(measured: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(host, a, b) of lines in more distinct documents of a host than the limit allows."""
    lines = measured.select("host", "t1", "t2", F.explode("lines").alias("l")).select("host", "t1", "t2", "l.a", "l.b")
    return lines.distinct().groupBy("host", "a", "b").agg(F.count("*").alias("n")).filter(F.col("n") > limits.documents).select("host", "a", "b")


def verdicts(measured: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``measured`` with ``base_failed``, ``kept`` and ``removed`` (hashes of its removed lines, null if none)."""
    lines = measured.select("rid", "host", F.explode("lines").alias("l")).select("rid", "host", "l.a", "l.b", "l.words")
    lost = (
        lines.join(frequent_lines(measured, limits), ["host", "a", "b"])
        .groupBy("rid")
        .agg(F.sum("words").alias("lost"), F.collect_list(F.struct("a", "b")).alias("removed"))
    )
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    return measured.drop("lines").join(lost, "rid", "left").withColumn("base_failed", failed).withColumn("kept", ~failed & (left >= limits.left * F.col("n_words")))


def _strip(text: str, hits: list[dict]) -> str:
    gone = {(x["a"], x["b"]) for x in hits}
    parts = text.split("\n")
    _, a, b = _signatures(pa.array(parts, pa.string()))
    return "\n".join(p for p, x, y in zip(parts, a.tolist(), b.tolist(), strict=True) if (x, y) not in gone)


def clean(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Documents that stay, without their boilerplate lines; columns as given (``n_chars`` follows the text).

    Null texts count as empty and so are rejected. Rows with the same ``doc_id``, ``source`` and text share a
    verdict and all of them stay or go. Other columns may have any names. A table without rows gives a table
    without rows.
    """
    judged = verdicts(measure(docs), limits).filter("kept").groupBy("doc_id", "host", "t1", "t2").agg(F.first("removed").alias("removed"))
    i, h, a, b, hits, none = fresh_names(docs, "id", "host", "t1", "t2", "removed", "null")
    # a null id is joined as an id of its own, so that a group of null ids is dealt by its texts
    found = judged.select(F.coalesce("doc_id", F.lit(0)).alias(i), F.col("doc_id").isNull().alias(none), F.col("host").alias(h), F.col("t1").alias(a), F.col("t2").alias(b), F.col("removed").alias(hits))
    t1, t2 = _text_key()
    keyed = docs.withColumns({i: F.coalesce("doc_id", F.lit(0)).cast("long"), none: F.col("doc_id").isNull(), h: F.xxhash64(F.col("source")), a: t1, b: t2})
    joined = keyed.join(found, [i, none, h, a, b])
    named = [F.col(f"`{c}`") for c in docs.columns]
    out = edit_texts(joined.select(*named, hits), hits, _strip).select(*named)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document. Null text: no words. Rows are judged one by one, repeats included."""
    judged = verdicts(measure(documents(spark, sf_dir)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.coalesce("lost", F.lit(0)).alias("boilerplate_words"))
