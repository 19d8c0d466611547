"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree gives a vector a string of 64 bits, the signs of random hyperplanes, and keeps the strings
of its vectors sorted. A query descends every tree to the longest prefix that it shares with some
vector, then all trees ascend together, one bit at a time, each widening its range of the sorted
array, until they have met enough distinct candidates; these are ranked by their true inner product.

Index vectors are dealt at random into shards of bounded size, each with a forest of its own, and
queries come in blocks of bounded size; every block meets every shard, and the best of all shards
are merged. How far to ascend is fitted: the share of a shard that a query must meet for the wanted
recall is measured against brute force on a bounded sample, so the work follows the data (vectors
that cluster need a small share, vectors without any structure a large one).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import documents, write_table

TREES = 16
BITS = 64
SHARD_ROWS = 8192
QUERY_ROWS = 8192
#: Rows on which the share of candidates is fitted, and queries among them.
SAMPLE_ROWS, SAMPLE_QUERIES = 4096, 128
#: Recall that the fit aims at, above what is promised (0.9).
AIM = 0.95
_U = np.uint64


def planes(dimensions: int, seed: int = 3) -> np.ndarray:
    """Hyperplanes of all trees: dimensions x (trees * bits)."""
    return np.random.default_rng(seed).standard_normal((dimensions, TREES * BITS))


def codes(vectors: np.ndarray, hyper: np.ndarray) -> np.ndarray:
    """Hash strings (rows x trees) as unsigned integers, first bit highest."""
    bits = (vectors @ hyper > 0).reshape(len(vectors), TREES, BITS)
    return np.packbits(bits, axis=2).reshape(len(vectors), TREES, 8).view(">u8")[:, :, 0].astype(_U)


class Forest:
    """Sorted hash strings of one shard. The longest vectors count as unit; shorter ones are lifted by one more dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float):
        self.ids, self.vectors = ids, vectors
        self.hyper = planes(vectors.shape[1] + 1)
        scaled = vectors / longest
        lift = np.sqrt(np.maximum(0.0, 1 - (scaled * scaled).sum(axis=1)))
        own = codes(np.column_stack((scaled, lift)), self.hyper)
        self.order = np.argsort(own, axis=0, kind="stable")
        self.sorted = np.take_along_axis(own, self.order, axis=0)

    def candidates(self, queries: np.ndarray, least: int) -> list[np.ndarray]:
        """Places of at least ``least`` distinct candidates (or all) for each query, by synchronous ascent."""
        norm = np.sqrt((queries * queries).sum(axis=1, keepdims=True))
        asked = codes(np.column_stack((queries / norm, np.zeros(len(queries)))), self.hyper)
        n = len(self.ids)
        out: list[np.ndarray] = [np.arange(n)] * len(queries)
        if least >= n:
            return out
        waiting = np.arange(len(queries))
        for depth in range(BITS, 0, -1):
            shift = _U(BITS - depth)
            low = np.empty((len(waiting), TREES), np.int64)
            high = np.empty_like(low)
            for t in range(TREES):
                prefix = asked[waiting, t] >> shift << shift
                low[:, t] = np.searchsorted(self.sorted[:, t], prefix)
                high[:, t] = np.searchsorted(self.sorted[:, t], prefix | (_U((1 << (BITS - depth)) - 1)), side="right")
            enough = []
            for k in np.flatnonzero((high - low).sum(axis=1) >= least).tolist():
                met = np.zeros(n, bool)
                for t in range(TREES):
                    met[self.order[low[k, t] : high[k, t], t]] = True
                if np.count_nonzero(met) >= least:
                    out[waiting[k]] = np.flatnonzero(met)
                    enough.append(k)
            waiting = np.delete(waiting, enough)
            if not len(waiting):
                break
        return out

    def search(self, places: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, least: int) -> pd.DataFrame:
        """The k candidates of the largest inner product for each query, itself left out, ties to the smaller id."""
        rows = []
        for i, met in enumerate(self.candidates(queries, least)):
            met = met[self.ids[met] != query_ids[i]]
            near = self.vectors[met] @ queries[i]
            if len(met) > k:
                # every candidate that may be among the k; then exact sums, the same for equal vectors
                cut = np.partition(near, len(met) - k)[len(met) - k]
                met = met[near >= cut - 1e-9 * max(1.0, abs(cut))]
            score = (self.vectors[met] * queries[i]).sum(axis=1)
            best = np.lexsort((self.ids[met], -score))[:k]
            rows.append(pd.DataFrame({"row": places[i], "query_id": query_ids[i], "vec_id": self.ids[met][best], "score": score[best]}))
        return pd.concat(rows) if rows else pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []})


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame, dimensions: int) -> DataFrame:
    """(vec_id, v) of vectors of doubles that have the dimension, a length, and no null or non-finite component."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select("vec_id", v.alias("v")).filter(F.col("vec_id").isNotNull() & (F.size("v") == dimensions)).filter(fine)


def fit_share(sample: np.ndarray, longest: float, k: int, aim: float = AIM) -> float:
    """The least share of a shard that queries must meet so that a sample's recall is at least ``aim``."""
    if len(sample) <= 4 * k:
        return 1.0
    ids = np.arange(len(sample))
    forest = Forest(ids, sample, longest)
    asked = ids[:: max(1, len(ids) // SAMPLE_QUERIES)]
    near = sample[asked] @ sample.T
    near[np.arange(len(asked)), asked] = -np.inf
    true = np.argsort(-near, axis=1, kind="stable")[:, :k]
    low, high = 1 / 64, 1.0
    for _ in range(6):
        share = (low * high) ** 0.5
        met = forest.candidates(sample[asked], int(np.ceil(share * len(ids))))
        recall = np.mean([np.isin(t, m).mean() for t, m in zip(true, met, strict=True)])
        low, high = (low, share) if recall >= aim else (share, high)
    return high


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, share: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each query, all candidates if fewer.

    ``queries`` and ``vectors`` have vec_id and embedding. The dimension is the one that most vectors
    have (of several, the smallest); others, and vectors that are null, zero or hold null or
    non-finite components, take no part. Repeated rows are candidates of their own; a query given
    several times with the same vector is one query, with another vector a query of its own under the
    same id. Other columns are ignored. No rows give no rows.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    shapes = vectors.filter("size(embedding) > 0").groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    shape = shapes.agg(F.max(F.struct("n", -F.col("d")))).first()[0]
    if shape is None:
        return spark.createDataFrame([], schema)
    dimensions = -shape[1]
    base = write_table(usable(vectors, dimensions), "vectors")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, longest = base.agg(F.count("*"), F.max(length)).first()
    if not n:
        return spark.createDataFrame([], schema)
    if share is None:
        # by id and vector, so that the vectors of one id are drawn apart; equal rows are one
        draw = F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(1 << 40))
        sample = base if n <= SAMPLE_ROWS else base.filter(draw < int((1 << 40) * SAMPLE_ROWS / n)).distinct()
        share = fit_share(_matrix(sample.toArrow().to_pandas().sort_values("vec_id")["v"]), longest, k)
    asked = write_table(usable(queries, dimensions).distinct().withColumn("row", F.monotonically_increasing_id()), "queries")
    shards = -(-n // SHARD_ROWS)
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    part = lambda seed, of: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(of)).cast("int")
    left = base.select("vec_id", "v", part(2, shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    right = asked.select("vec_id", "row", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block.alias("block"))

    def meet(index: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(query):
            return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}).astype({"row": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})
        index = index.sort_values("vec_id", kind="stable")
        forest = Forest(index["vec_id"].to_numpy(np.int64), _matrix(index["v"]), longest)
        return forest.search(query["row"].to_numpy(np.int64), query["vec_id"].to_numpy(np.int64), _matrix(query["v"]), k, int(np.ceil(share * len(index))))

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(meet, "row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20, among all other vectors."""
    vectors = documents(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)
