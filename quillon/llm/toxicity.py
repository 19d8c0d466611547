"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded sample of labelled rows. Terms are words without the punctuation around them;
the vocabulary are those whose presence goes with the label (log-likelihood ratio), and their
document frequencies are counted over all documents. Every other word lengthens a text's vector at
weight 1 and matches nothing, so a long text with one such term is near to no example. Examples
lie in blocks, and the inverted index keeps each word's largest weight per block. A query adds up
these maxima to bound every block, visits blocks from the highest bound down, and stops when no
bound exceeds its k-th best cosine, so the k nearest are exact. Their similarity-weighted vote is
calibrated by a logistic curve fitted to the examples' own leave-one-out votes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .labelled import bounded_sample, remainder
from .tables import documents, write_table

#: Labelled rows of the index, by hash of their ids.
MAX_EXAMPLES = 10_000
MIN_EXAMPLES_WITH_WORD = 3
NEIGHBOURS = 15
BLOCK = 256
PRIOR_VOTE = 1.0
_TRIM = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _term_hashes(words: pa.Array) -> np.ndarray:
    return tx.hashes(pc.ascii_trim(words, characters=_TRIM), 21)


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct terms of each row, in order."""
    words = tx.tokenise(column, lower=True)
    term, row = _term_hashes(words.words)[words.codes], tx.row_of(words.offsets)
    order = tx.order_rows(row, term)
    term, row = term[order], row[order]
    fresh = np.ones(len(term), bool)
    if len(term):
        fresh[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
    return row[fresh], term[fresh]


def _known_terms(column: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the sorted vocabulary and count of those terms of each row that it holds; words by row."""
    words = tx.tokenise(column, lower=True)
    n_words = np.diff(words.offsets)
    if not len(vocabulary) or not len(words.codes):
        return *(np.zeros(0, np.int64),) * 3, n_words
    hashed = _term_hashes(words.words)
    place = np.searchsorted(vocabulary, hashed)
    place[place == len(vocabulary)] = 0
    at = np.flatnonzero((vocabulary[place] == hashed)[words.codes])
    key = np.sort(tx.row_of(words.offsets)[at] * len(vocabulary) + place[words.codes[at]])
    start = tx.run_starts(key)
    row, term = np.divmod(key[start], len(vocabulary))
    return row, term, np.diff(np.append(start, len(key))), n_words


def _example_terms(batches):
    for batch in tx.chunks(batches):
        row, term = _terms(tx.texts(batch))
        yield pa.RecordBatch.from_arrays([batch.column("y").take(pa.array(row)), pa.array(term.view(np.int64))], names=["y", "term"])


def choose_vocabulary(sample: DataFrame) -> np.ndarray:
    """Sorted hashes of the terms that go with the label; at most as many as the bounded sample has terms."""
    y = F.col("y") == 1
    totals = sample.agg(F.count("*").alias("n"), F.sum(y.cast("long")).alias("p")).first()
    n, p = totals.n, totals.p or 0
    if not 0 < p < n:
        return np.zeros(0, np.uint64)
    counts = sample.mapInArrow(_example_terms, "y int, term long").groupBy("term").agg(F.count("*").alias("df"), F.sum(y.cast("long")).alias("a")).filter(F.col("df") >= MIN_EXAMPLES_WITH_WORD)
    a, df = F.col("a").cast("double"), F.col("df").cast("double")

    def part(seen, expected):
        return F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)

    ratio = 2 * (part(a, df * p / n) + part(df - a, df * (n - p) / n) + part(p - a, (n - df) * p / n) + part(n - p - df + a, (n - df) * (n - p) / n))
    counts = write_table(counts, "terms")
    # of T terms without any bearing on the label, about one passes; unlike chi-squared, the ratio holds for rare terms
    least = 2 * np.log(max(1, counts.count())) - 2
    chosen = counts.filter((df < n) & (a * n > df * p)).filter(ratio >= float(least)).select("term").collect()
    return np.sort(np.array([r.term for r in chosen], np.int64).view(np.uint64))


def _frequencies(vocabulary):
    def count(batches):
        total = np.zeros(len(vocabulary.value), np.int64)
        rows = 0
        for batch in tx.chunks(batches):
            _, term, _, _ = _known_terms(tx.texts(batch), vocabulary.value)
            total += np.bincount(term, minlength=len(total))
            rows += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(total)), -1)), pa.array(np.append(total, rows))], names=["term", "df"])

    return count


def _weighted(row, term, count, idf, n_words):
    weight = (1 + np.log(count)) * idf[term]
    others = n_words - np.bincount(row, count, len(n_words))
    norm = np.sqrt(np.bincount(row, weight * weight, len(n_words)) + others)
    return weight / norm[row]


@dataclass
class Index:
    """Examples with at least one term, in blocks: weights by (block, example, term) and the maxima of each block."""

    vocabulary: np.ndarray
    idf: np.ndarray
    doc_id: np.ndarray
    y: np.ndarray
    terms: list[np.ndarray]  # by block: the terms it holds
    weights: list[np.ndarray]  # by block: terms x examples
    maxima: np.ndarray  # terms x blocks
    prior: float  # of a text without any term
    curve: tuple[float, float] = (0.0, 1.0)

    def __post_init__(self):
        self.places = {d: i for i, d in enumerate(self.doc_id.tolist())}

    def nearest(self, terms: np.ndarray, weights: np.ndarray, own, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples (not ``own``), nearest first, ties to the earlier one."""
        bounds = weights @ self.maxima[terms]
        best, found = np.zeros(0), np.zeros(0, np.int64)
        for b in np.argsort(-bounds, kind="stable").tolist():
            if bounds[b] <= 1e-12 or (len(best) == k and bounds[b] < best[-1] - 1e-12):
                break
            held = self.terms[b]
            at = np.searchsorted(held, terms)
            at[at == len(held)] = 0
            same = held[at] == terms
            score = weights[same] @ self.weights[b][at[same]]
            if own is not None and own in self.places and self.places[own] // BLOCK == b:
                score[self.places[own] % BLOCK] = 0
            least = best[-1] if len(best) == k else 0.0
            place = np.flatnonzero(score > least) if least else np.flatnonzero(score)
            if len(place) > 4 * k:  # ties to the k-th stay in
                cut = np.partition(score[place], len(place) - k)[len(place) - k]
                place = place[score[place] >= cut]
            best, found = np.concatenate((best, score[place])), np.concatenate((found, b * BLOCK + place))
            order = np.lexsort((found, -best))[:k]
            best, found = best[order], found[order]
        return found, best

    def probability(self, found: np.ndarray, cosine: np.ndarray) -> float:
        if not len(found):
            return self.prior
        return float(1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * _vote(self.y[found], cosine, self.prior)))))


def _vote(y, cosine, prior) -> float:
    """Log-odds of the similarity-weighted vote, with a prior vote of weight PRIOR_VOTE."""
    p = (float(y @ cosine) + PRIOR_VOTE * prior) / (float(cosine.sum()) + PRIOR_VOTE)
    return float(np.log(p / (1 - p)))


def build_index(vocabulary: np.ndarray, idf: np.ndarray, doc_id: np.ndarray, y: np.ndarray, row: np.ndarray, term: np.ndarray, count: np.ndarray, n_words: np.ndarray) -> Index:
    """The index of a bounded sample: ids, labels, (row, term, count) in order, and words by row."""
    n = len(doc_id)
    weight = _weighted(row, term, count, idf, n_words)
    has = np.zeros(n, bool)
    has[row] = True
    bare = y[~has]
    prior = float((bare.sum() + 0.5 * y.mean() if n else 0.5) / (len(bare) + 0.5)) if n else 0.5
    prior = min(max(prior, 1e-4), 0.9)
    # neighbours in a block share their heaviest term, so that its bounds are tight
    dense = np.zeros((n, 0))
    top = np.zeros(n, np.int64)
    order = np.lexsort((weight, row))
    top[row[order]] = term[order]
    kept = np.flatnonzero(has)
    kept = kept[np.lexsort((doc_id[kept], top[kept]))]
    place = np.full(n, -1)
    place[kept] = np.arange(len(kept))
    blocks = -(-len(kept) // BLOCK)
    maxima = np.zeros((len(vocabulary), blocks))
    at = place[row]
    terms, weights = [], []
    for b in range(blocks):
        mine = np.flatnonzero(at // BLOCK == b)
        held, column_of = np.unique(term[mine], return_inverse=True)
        dense = np.zeros((BLOCK, len(held)))
        dense[at[mine] % BLOCK, column_of] = weight[mine]
        maxima[held, b] = dense.max(axis=0)
        terms.append(held)
        weights.append(np.ascontiguousarray(dense.T))
    index = Index(vocabulary, idf, doc_id[kept], y[kept].astype(float), terms, weights, maxima, prior)
    votes, truth = [], []
    start = np.searchsorted(row, np.arange(n + 1))
    for i in kept.tolist():
        mine = slice(start[i], start[i + 1])
        found, cosine = index.nearest(term[mine], weight[mine], doc_id[i])
        if len(found):
            votes.append(_vote(index.y[found], cosine, prior))
            truth.append(y[i])
    index.curve = _logistic(np.array(votes), np.array(truth, float))
    return index


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps, drawn to (0, 1) by a small penalty."""
    theta = np.array([0.0, 1.0])
    for _ in range(30 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(theta[0] + theta[1] * x, -35, 35)))
        g = np.array([np.sum(p - y), np.sum((p - y) * x)]) + (theta - [0.0, 1.0])
        h = p * (1 - p)
        step = np.linalg.solve(np.array([[h.sum() + 1, (h * x).sum()], [(h * x).sum(), (h * x * x).sum() + 1]]), g)
        theta = theta - step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(max(theta[1], 0.05))


def _sample_parts(vocabulary):
    def parts(batches):
        for batch in tx.chunks(batches):
            row, term, count, n_words = _known_terms(tx.texts(batch), vocabulary.value)
            n = batch.num_rows
            places = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(places, pa.array(x.astype(np.int64))) for x in (term, count)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *lists, pa.array(n_words)], names=["doc_id", "y", "terms", "counts", "n_words"])

    return parts


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, most: int = MAX_EXAMPLES) -> Index:
    """The index of a bounded sample; document frequencies of its vocabulary come from all documents."""
    spark = docs.sparkSession
    sample = write_table(bounded_sample(docs, labels, label, folds, most), "examples")
    vocabulary = choose_vocabulary(sample)
    shared = spark.sparkContext.broadcast(vocabulary)
    counted = docs.select("text").mapInArrow(_frequencies(shared), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = {r.term: r.df for r in counted}
    idf = np.log((1 + df.get(-1, 0)) / (1 + np.array([df.get(i, 0) for i in range(len(vocabulary))], float))) + 1
    rows = sample.mapInArrow(_sample_parts(shared), "doc_id long, y int, terms array<long>, counts array<long>, n_words long").toArrow().to_pandas()
    rows = rows.iloc[sorted(range(len(rows)), key=lambda i: (rows["doc_id"].iloc[i], tuple(rows["terms"].iloc[i]), tuple(rows["counts"].iloc[i]), rows["n_words"].iloc[i]))]
    n = rows["terms"].map(len).to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64)
    flat = [np.concatenate(rows[c].tolist()).astype(np.int64) if len(rows) else np.zeros(0, np.int64) for c in ("terms", "counts")]
    return build_index(vocabulary, idf, rows["doc_id"].to_numpy(np.int64), rows["y"].to_numpy(np.int64), np.repeat(np.arange(len(rows)), n), *flat, rows["n_words"].to_numpy(np.int64))


SCORED = "doc_id long, score double, evidence array<struct<doc_id:long,similarity:double,label:int>>"


def _scorer(model):
    def score(batches):
        index: Index = model.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))
        for batch in tx.chunks(batches):
            row, term, count, n_words = _known_terms(tx.texts(batch), index.vocabulary)
            weight = _weighted(row, term, count, index.idf, n_words)
            scores = np.full(batch.num_rows, index.prior)
            start = np.searchsorted(row, np.arange(batch.num_rows + 1))
            ids = batch.column("doc_id").to_pylist()
            near, cosines, size = [np.zeros(0, np.int64)], [np.zeros(0)], np.zeros(batch.num_rows, np.int64)
            for i in np.unique(row).tolist():
                mine = slice(start[i], start[i + 1])
                found, cosine = index.nearest(term[mine], weight[mine], ids[i])
                scores[i] = index.probability(found, cosine)
                near.append(found)
                cosines.append(cosine)
                size[i] = len(found)
            near = np.concatenate(near)
            entries = [pa.array(index.doc_id[near]), pa.array(np.concatenate(cosines)), pa.array(index.y[near].astype(np.int32))]
            places = pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32))
            evidence = pa.ListArray.from_arrays(places, pa.StructArray.from_arrays(entries, fields=list(kind.value_type)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), evidence], names=["doc_id", "score", "evidence"])

    return score


def score(docs: DataFrame, index: Index) -> DataFrame:
    """Score and evidence of every row. Texts without any known term, null and empty ones too, get the prior."""
    model = docs.sparkSession.sparkContext.broadcast(index)  # bounded by MAX_EXAMPLES and their chosen terms
    return docs.select("doc_id", "text").mapInArrow(_scorer(model), SCORED)


def op6_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from labels outside remainder 0 of 5.

    Rows are scored one by one, repeats and equal ids included; null and empty texts and those without a known term get
    the prior. A null id counts as empty text in the remainder. Without rows there are no scores.
    """
    docs = documents(spark, sf_dir)
    scored = score(docs, train(docs, documents(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("evidence").alias("n_neighbours"))
