"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document's set are its distinct word shingles. Sketch: in round i every element of the set is
thrown into one of T bins with a hash value and a bin keeps its smallest value of the first round
that reaches it; after T random rounds, T more rounds each aim all elements at one bin, so every bin
fills. Equal coordinates of two sketches estimate the Jaccard similarity, with the concentration of
independent trials. Bands of coordinates make candidates; each is confirmed on the full sets.

Documents with equal sets form a class, of which one representative is sketched. Inside a bucket
candidates are not paired all with all: everything is compared with one pivot, then with another
what the links so far leave in different components. Pairs inside a component need no test, as a
further link would not change it. What is left across components is paired at once where it is
little; else (many documents that share a passage, say) by an exact prefix filter: shingles are
ordered by rarity, and two sets as similar as wanted share one of their rarest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .components import components
from .rarity import counters, rarity
from .tables import documents, fresh_names, write_table

#: 42 bands of 6: a pair at the least similarity of 0.8 shares no band with probability 2.8e-6.
BANDS, ROWS = 42, 6
BINS = BANDS * ROWS
#: Ids that may be broadcast to a scan (16 MB); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ordered distinct shingle hashes of all rows (A-Z lower-cased), and offsets by row.

    A text with fewer words than ``width`` has its whole word sequence as its one shingle; a text
    without words has none.
    """
    words = tx.tokenise(column, lower=True)
    hashed = tx.hashes(words.words, 31)[words.codes]
    row, n = tx.row_of(words.offsets), np.diff(words.offsets)
    whole = np.zeros(0, np.int64)
    value = np.zeros(0, _U)
    if len(hashed) >= width:
        whole = np.flatnonzero(row[width - 1 :] == row[: len(row) - width + 1])
        total = np.zeros(len(whole), _U)
        for k in range(width):
            total += hashed[whole + k] * _ODD[k]
        value = tx.mix(total)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        sequence = tx.sequence_hash(hashed, words.offsets, 0x5851F42D4C957F2D)[short]
        rows = np.concatenate((row[whole], short))
        value = np.concatenate((value, sequence))
    else:
        rows = row[whole]
    order = tx.order_rows(rows, value)
    rows, value = rows[order], value[order]
    fresh = np.ones(len(value), bool)
    if len(value):
        fresh[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
    rows, value = rows[fresh], value[fresh]
    return value, np.searchsorted(rows, np.arange(len(column) + 1))


def sketch(values: np.ndarray, offsets: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Sketches (rows x bins) of sets given as flat values; rows of empty sets hold the largest integer."""
    n = len(offsets) - 1
    empty = _U(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * bins, empty, _U)
    row = tx.row_of(offsets)
    values, row = values.copy(), row.copy()
    for i in range(2 * bins):
        if not len(values):
            break
        h = tx.mix(values ^ tx.mix(np.full(1, i + 1, _U) * _ODD[0]))
        where = np.int64(i - bins) if i >= bins else ((h >> _U(32)) * _U(bins) >> _U(32)).astype(np.int64)
        slot = row * bins + where
        # a bin that an earlier round has reached stays as it is
        free = out[slot] == empty
        slot = slot[free]
        np.minimum.at(out, slot, (h[free] & _U(0xFFFFFFFF)) | _U(i << 32))
        open_ = np.zeros(n, bool)
        rows = np.unique(row)
        open_[rows] = (out.reshape(n, bins)[rows] == empty).any(axis=1)
        if not open_[rows].all():
            keep = open_[row]
            values, row = values[keep], row[keep]
    return out.reshape(n, bins)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit key by row and band; the band is part of it."""
    cut = sketches.reshape(len(sketches), BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=_U)[None, :] * _ODD[6]
    for k in range(ROWS):
        total = total + tx.mix(cut[:, :, k] + _ODD[7]) * _ODD[k]
    return tx.mix(total)


def _digests(values: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each set: equal for equal sets only, but for chance."""
    out = []
    for k in (0, 1):
        total = np.concatenate((np.zeros(1, _U), np.cumsum(tx.mix(values ^ _ODD[k]), dtype=_U)))
        out.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return out


def _sign(width: int):
    def sign(batches):
        for batch in tx.chunks(batches):
            values, offsets = shingles(tx.texts(batch), width)
            n = np.diff(offsets)
            d1, d2 = _digests(values, offsets)
            full = np.flatnonzero(n)
            keys = band_keys(sketch(values, np.concatenate(([0], np.cumsum(n[full]))))).view(np.int64)
            places = np.concatenate(([0], np.cumsum(n > 0))) * BANDS
            bands = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(n), pa.array(d1), pa.array(d2), bands], names=["doc_id", "k1", "k2", "n", "d1", "d2", "bands"])

    return sign


def _sets(width: int):
    def sets(batches):
        for batch in tx.chunks(batches):
            values, offsets = shingles(tx.texts(batch), width)
            d1, d2 = _digests(values, offsets)
            data = [values[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(d1), pa.array(d2), pa.array(data, pa.binary())], names=["doc_id", "d1", "d2", "set"])

    return sets


def _confirm(percent: int):
    def confirm(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("set_u").to_pylist(), batch.column("set_v").to_pylist(), strict=True)):
                a, b = np.frombuffer(x, _U), np.frombuffer(y, _U)
                a, b = (a, b) if len(a) <= len(b) else (b, a)
                if 100 * len(a) < percent * len(b):
                    continue
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                common = int(np.count_nonzero(b[at] == a))
                if 100 * common >= percent * (len(a) + len(b) - common):
                    keep.append(i)
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    return confirm


def _shingle_counts(batches):
    for batch in batches:
        data = batch.column("set").to_pylist()
        if data:
            value, count = np.unique(np.frombuffer(b"".join(data), _U), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count)], names=["item", "n"])


def _prefixes(counts, percent: int):
    def prefixes(batches):
        for batch in batches:
            n = batch.column("n").to_numpy()
            for i, data in enumerate(batch.column("set").to_pylist()):
                own = np.frombuffer(data, _U)
                k = int(n[i] - -(-percent * n[i] // 100) + 1)
                first = own[np.lexsort((own, rarity(counts.value, own)))[:k]]
                one = pa.array(np.zeros(k, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), *[batch.column(c).slice(i, 1).take(one) for c in ("rep", "component", "n")], pa.array(np.arange(k, dtype=np.int32))], names=["shingle", "rep", "component", "n", "p"])

    return prefixes


@dataclass
class _Search:
    """The state of one search: bucket members, sets of their representatives, and pairs tested so far."""

    members: DataFrame  # key, rep
    sets: DataFrame  # rep, n, set
    percent: int
    tested: DataFrame | None = None
    labels: DataFrame | None = None  # node, component

    def test(self, pairs: DataFrame) -> None:
        """Confirm new pairs (u, v), and merge the components that they link."""
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v").distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["u", "v"], "left_anti")
        pairs = write_table(pairs, "pairs")
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        of = lambda c: self.sets.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("set").alias(f"set_{c}"))
        near = 100 * F.least("n_u", "n_v") >= self.percent * F.greatest("n_u", "n_v")
        sized = pairs.join(of("u").drop("set_u"), "u").join(of("v").drop("set_v"), "v").filter(near).select("u", "v")
        links = sized.join(of("v").drop("n_v"), "v").join(of("u").drop("n_u"), "u").select("u", "v", "set_u", "set_v").mapInArrow(_confirm(self.percent), "u long, v long")
        links = write_table(links, "links")
        if self.labels is None:
            self.labels = write_table(components(links), "labels")
            return
        to = lambda c: self.labels.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
        across = links.join(to("u"), "u", "left").join(to("v"), "v", "left").select(F.coalesce("c_u", "u").alias("u"), F.coalesce("c_v", "v").alias("v"))
        moved = components(across).select(F.col("node").alias("component"), F.col("component").alias("to"))
        every = self.labels.unionByName(across.select(F.col("u").alias("node")).unionByName(across.select(F.col("v").alias("node"))).distinct().join(self.labels, "node", "left_anti").select("node", F.col("node").alias("component")))
        self.labels = write_table(every.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")

    def across(self, left: DataFrame) -> DataFrame:
        """Pairs across components among the members ``left`` that share a shingle of their prefixes."""
        rows = write_table(left.select("rep", "component").distinct().join(self.sets, "rep"), "left")
        counts = counters(rows.select("set").mapInArrow(_shingle_counts, "item long, n long"))
        shared = rows.sparkSession.sparkContext.broadcast(counts)
        posted = write_table(rows.mapInArrow(_prefixes(shared, self.percent), "shingle long, rep long, component long, n long, p int"), "prefixes")
        other = posted.select("shingle", F.col("rep").alias("v"), F.col("component").alias("c"), F.col("n").alias("m"), F.col("p").alias("q"))
        need = F.ceil(F.lit(self.percent) * (F.col("n") + F.col("m")) / F.lit(100 + self.percent))
        fine = (100 * F.least("n", "m") >= self.percent * F.greatest("n", "m")) & (1 + F.least(F.col("n") - F.col("p") - 1, F.col("m") - F.col("q") - 1) >= need)
        return posted.join(other, "shingle").filter((F.col("component") < F.col("c")) & fine).select(F.col("rep").alias("u"), "v")

    def open(self) -> DataFrame:
        """Members of the buckets that hold more than one component."""
        now = self.members.join(self.labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
        mixed = now.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("m")).filter("a <> b").select("key", "m")
        return write_table(now.join(mixed, "key"), "open")


def _few(left: DataFrame) -> bool:
    """Whether all pairs of the open buckets are not many more than their members."""
    size = left.agg(F.count("*").alias("n"), F.sum("m").alias("pairs")).first()
    return not size.n or size.pairs <= 8 * size.n


def _key() -> list[Column]:
    """128 bits that name a document by its id and text."""
    return [F.xxhash64(F.lit(k), F.col("doc_id").cast("long"), F.col("text")) for k in (1, 2)]


def _labelled(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, k1, k2, n, component) of every row; a component is named by its smallest id, null for null ids."""
    k1, k2 = _key()
    texts = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), "text")
    signed = write_table(texts.mapInArrow(_sign(width), "doc_id long, k1 long, k2 long, n long, d1 long, d2 long, bands array<long>"), "signatures")
    live = signed.filter("n > 0 AND doc_id IS NOT NULL")
    # a class is a set; its number is fixed once written
    classes = live.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("doc_id")).withColumn("rep", F.monotonically_increasing_id())
    classes = write_table(classes, "classes")
    first = live.join(classes.select("doc_id", "d1", "d2", "rep"), ["doc_id", "d1", "d2"]).dropDuplicates(["rep"])
    posted = first.select("rep", F.explode("bands").alias("key"))
    buckets = posted.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).filter("pivot <> last").select("key", "pivot")
    members = write_table(posted.join(buckets, "key"), "members")
    ids = write_table(members.select("rep").distinct().join(classes, "rep"), "candidates")
    some = ids.select("doc_id")
    some = F.broadcast(some) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else some
    found = texts.select("doc_id", "text").join(some, "doc_id", "left_semi").mapInArrow(_sets(width), "doc_id long, d1 long, d2 long, set binary")
    sets = write_table(found.join(ids, ["doc_id", "d1", "d2"]).dropDuplicates(["rep"]).select("rep", "n", "set"), "sets")

    search = _Search(members.select("key", "rep"), sets, percent)
    search.test(members.select(F.col("pivot").alias("u"), F.col("rep").alias("v")))
    left = search.open()
    if not _few(left):
        pick = F.xxhash64("rep", F.lit(1))
        chosen = left.groupBy("key").agg(F.min(pick).alias("pick"))
        pivots = left.withColumn("pick", pick).join(chosen, ["key", "pick"]).select("key", F.col("rep").alias("u"), F.col("component").alias("c"))
        search.test(left.join(pivots, "key").filter("component <> c").select("u", F.col("rep").alias("v")))
        left = search.open()
    if not _few(left):
        search.test(search.across(left))
    elif left.limit(1).count():
        other = left.select("key", F.col("rep").alias("v"), F.col("component").alias("c"))
        search.test(left.join(other, "key").filter("component < c").select(F.col("rep").alias("u"), "v"))

    named = classes.join(search.labels.withColumnRenamed("node", "rep"), "rep", "left")
    heads = named.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("head"))
    named = named.join(heads, "component", "left").select("d1", "d2", "n", F.coalesce("head", "doc_id").alias("component"))
    rows = signed.select("doc_id", "k1", "k2", "n", "d1", "d2").join(named, ["d1", "d2", "n"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return rows.select("doc_id", "k1", "k2", "n", F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Rows are linked where their sets' Jaccard similarity is at least ``percent`` in 100; a component
    is named by its smallest doc_id, and that document is kept. Null, empty and blank texts have no
    shingles, link with nothing and are kept. A null doc_id stays out of all links, has a null
    component and is kept. Repeated rows share a component; different texts under one id are linked
    each by its own set, and a row is kept if its id names its component. Other columns are ignored;
    no rows give no rows.
    """
    kept = F.col("component").isNull() | (F.col("doc_id") == F.col("component"))
    return _labelled(docs, width, percent).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates, columns as given.

    The row of the smallest id stays, of several texts under that id the one of the smallest hash, of
    rows equal in id and text one. Rows without words and rows without an id all stay. Other columns
    may have any names.
    """
    rows = _labelled(docs, width, percent).filter("n > 0 AND doc_id = component")
    a, b = fresh_names(docs, "k1", "k2")
    first = rows.groupBy("component").agg(F.min(F.struct("k1", "k2")).alias("k")).select(F.col("k.k1").alias(a), F.col("k.k2").alias(b))
    has = F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]")) & F.col("doc_id").isNotNull()
    k1, k2 = _key()
    linked = docs.filter(has).withColumns({a: k1, b: k2}).join(first, [a, b], "left_semi").dropDuplicates([a, b])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return linked.select(*columns).unionByName(docs.filter(~has).select(*columns))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents on 4-word shingles at a Jaccard similarity of 80 in 100."""
    return near_duplicates(documents(spark, sf_dir), width=4, percent=80)
