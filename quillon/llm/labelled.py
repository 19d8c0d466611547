"""Which labelled rows a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import write_table

#: Bytes of text that a sample holds at most, about.
MAX_BYTES = 256 << 20
_STEPS = 1 << 40


def remainder(doc_id: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % of


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, most: int, most_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, text, y) of about ``most`` labelled training texts and ``most_bytes`` at most, those of the lowest hash of id and text.

    Rows with remainder 0 are held out. Null labels are ignored; of several labels of one id the largest counts. Rows
    equal in id and text are one; an id may have several texts, each with its label. The bounds hold for rows, however
    they are spread over ids. Null texts count as empty.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder("doc_id", folds) != 0))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), *[F.xxhash64(F.lit(k), text).alias(f"k{k}") for k in (1, 2)])
    # what can be chosen, without its texts
    able = keyed.select("doc_id", "k1", "k2", F.octet_length("text").alias("size")).join(known, "doc_id").groupBy("doc_id", "k1", "k2").agg(F.first("y").alias("y"), F.first("size").alias("size"))
    able = write_table(able, "labelled")
    rows, size = able.agg(F.count("*"), F.sum(F.col("size").cast("long"))).first()
    share = min(1.0, most / max(1, rows), most_bytes / max(1, size or 0))
    if share < 1:
        able = able.filter(F.pmod(F.xxhash64("doc_id", "k1", "k2", F.lit(5)), F.lit(_STEPS)) < int(share * _STEPS))
    chosen = able.select("doc_id", "k1", "k2", "y")  # bounded by ``most``
    return keyed.join(F.broadcast(chosen), ["doc_id", "k1", "k2"]).groupBy("doc_id", "k1", "k2").agg(F.first("text").alias("text"), F.first("y").alias("y")).select("doc_id", "text", "y")
