"""Lexical retrieval packing.

Texts are encoded once, into a table. Document frequencies and the mean length are counted over all of
it. Every document has two routes, drawn from its terms so that documents that share rare terms often draw
the same ones; tokens are counted by route, and routes form shards of a bounded number of tokens by these
counts alone, so that the same documents give the same shards and sequences on every run. A shard builds a BM25 inverted index of its documents; the first unused document
seeds a window, its best unused neighbours fill the window in order of BM25 score, and the last of them
is cut where the window ends, its rest seeding the next window. Where no scored neighbour is left, the
next unused document follows. So only the last window of a shard is padded. A route of more tokens is split by
second routes, and where both are shared by more, by documents.
"""

from __future__ import annotations

import json
import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as tx
from .tables import documents, write_table

WINDOW = 4096
END_ID = 2
#: Tokens of a shard; a longer document makes a larger shard.
SHARD_TOKENS = 1_000_000
_K1, _B = 1.2, 0.75
#: Words whose ids a worker remembers; a full memory keeps those that it has met in several chunks.
_CACHE = 400_000
_CHUNK = 1 << 20
#: Words that are encoded in one call, with a mark between each two.
_JOINED = 512
_MARK = "~"
#: A word that ends in symbols after a Latin letter or a digit: its symbols are a token run of their own.
_TAILED = "^(?P<core>.*[A-Za-z0-9\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F])(?P<tail>[!-&(-/:-@\\[-`{-~]+)$"
_SYMBOL = np.array([33 <= c < 127 and c != 39 and not chr(c).isalnum() for c in range(256)])
#: Pairs of routes longer than a shard that are broadcast; more are joined by shuffle.
MAX_BROADCAST_PAIRS = 50_000
#: Terms whose postings are added up at once.
_SPANS = 64

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts, from ids of their words.

    The tokenizer folds case and never joins across white space, so a text's ids are the ids of its
    words in order, and symbols at the end of a word are tokens of their own. Texts that may hold a
    special token go through the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._encode([_MARK])[0]
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # tokens that end a word, where the vocabulary says so
        self.final = np.array([bool(suffix) and (self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(size)])
        self._reset([], np.zeros(0, np.int64), np.zeros(0, np.int32))

    def _reset(self, names: list[str], lengths: np.ndarray, pool: np.ndarray) -> None:
        self.known = dict(zip(names, range(len(names)), strict=True))
        self.lengths, self.starts, self.pool = lengths, np.cumsum(lengths) - lengths, pool
        self.met = np.ones(len(names), np.int32)

    def _encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in turn, and how many each has.

        Words of letters alone are one run of tokens each, the last of which ends a word; others are told apart by marks.
        """
        lettered = pc.match_substring_regex(pa.array(words, pa.string()), r"^\p{L}+$").to_numpy(zero_copy_only=False)
        if self.final.any() and lettered.all():
            parts = self._encode([" ".join(words[i : i + _JOINED]) for i in range(0, len(words), _JOINED)])
            ids = np.concatenate([np.array(p, np.int32) for p in parts])
            ends = np.flatnonzero(self.final[ids])
            if len(ends) == len(words) and ends[-1] == len(ids) - 1:
                return ids, np.diff(ends, prepend=-1)
        if len(self.mark) == 1 and not any(_MARK in w for w in words):
            gap = f" {_MARK} "
            parts = self._encode([gap.join(words[i : i + _JOINED]) + gap for i in range(0, len(words), _JOINED)])
            ids = np.concatenate([np.array(p, np.int32) for p in parts])
            marks = np.flatnonzero(ids == self.mark[0])
            if len(marks) == len(words):
                return ids[ids != self.mark[0]], np.diff(marks, prepend=-1) - 1
        parts = self._encode(words)
        return np.concatenate([np.array(p, np.int32) for p in parts]), np.array([len(p) for p in parts], np.int64)

    def _places(self, names: list[str]) -> np.ndarray:
        """Where the ids of each of some distinct words lie in ``pool``."""
        if len(self.known) + len(names) > _CACHE:
            often = np.flatnonzero(self.met > 1)
            if len(often) > _CACHE // 2:
                often = often[:0]
            n = self.lengths[often]
            every = list(self.known)  # in the order of their places
            self._reset([every[i] for i in often.tolist()], n, self.pool[_spread(self.starts[often], n)])
        place = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        fresh = np.flatnonzero(place < 0)
        words = [names[i] for i in fresh.tolist()]
        # words of letters, other words, and words with the mark itself, in calls of their own
        kind = np.array([2 if _MARK in w else 0 if w.isalpha() else 1 for w in words], np.int8)
        for some in (fresh[kind == 0], fresh[kind == 1], fresh[kind == 2]):
            if not len(some):
                continue
            words = [names[i] for i in some.tolist()]
            ids, n = self._joined(words)
            first = len(self.lengths)
            place[some] = np.arange(first, first + len(words))
            self.known.update(zip(words, range(first, first + len(words)), strict=True))
            self.lengths = np.concatenate((self.lengths, n))
            self.starts = np.cumsum(self.lengths) - self.lengths
            self.pool = np.concatenate((self.pool, ids))
            self.met = np.concatenate((self.met, np.zeros(len(n), np.int32)))
        self.met[place] += 1
        return place

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (int32) with the end id after each text, and offsets by text."""
        special = pc.match_substring(column, "<|").to_numpy(zero_copy_only=False)
        words = tx.tokenise(pc.if_else(pa.array(special), "", column), lower=True)
        # each distinct word as a core and a tail of symbols, which may be empty
        names = words.words
        raw, ends = tx.byte_view(names)
        tailed = (np.diff(ends) > 0) & _SYMBOL[raw[np.maximum(ends[1:] - 1, 0)]] if len(raw) else np.zeros(len(names), bool)
        split = pc.extract_regex(names.filter(pa.array(tailed)), _TAILED)
        tailed[np.flatnonzero(tailed)[split.is_null().to_numpy(zero_copy_only=False)]] = False
        cores, tails = (pc.struct_field(split, k).drop_null() for k in range(2))
        cores = pc.replace_with_mask(names, pa.array(tailed), cores)
        tails = tails.dictionary_encode()
        coded = cores.dictionary_encode()
        own = len(coded.dictionary)
        # a tail that is a word as well is asked for once
        both = pa.concat_arrays([coded.dictionary, tails.dictionary, pa.array([""], names.type)]).dictionary_encode()
        found = self._places(both.dictionary.to_numpy(zero_copy_only=False).tolist())[both.indices.to_numpy()]
        place = np.full((len(names), 2), found[-1])
        place[:, 0] = found[coded.indices.to_numpy()]
        place[tailed, 1] = found[own + tails.indices.to_numpy()]
        place = place.ravel()
        n = self.lengths[place]
        pool = self.pool[_spread(self.starts[place], n)]
        size = n.reshape(-1, 2).sum(1)
        starts = np.cumsum(size) - size
        # every text is its words and one end
        length = size[words.codes]
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(length)))
        offsets = total[words.offsets] + np.arange(len(column) + 1)
        out = np.full(int(offsets[-1]), END_ID, np.int32)
        filled = np.ones(len(out), bool)
        filled[offsets[1:] - 1] = False
        out[filled] = pool[_spread(starts[words.codes], length)]
        if special.any():
            whole = dict(zip(np.flatnonzero(special).tolist(), self._encode(column.filter(pa.array(special)).to_pylist()), strict=True))
            parts = [np.array([*whole[i], END_ID], np.int32) if i in whole else out[offsets[i] : offsets[i + 1]] for i in range(len(column))]
            return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return out, offsets


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... up to lengths[i] places, for all i in turn."""
    total = np.cumsum(lengths)
    n = int(total[-1]) if len(total) else 0
    kind = np.int32 if n < 1 << 31 and (not len(starts) or int(starts.max()) + n < 1 << 31) else np.int64
    return np.arange(n, dtype=kind) + np.repeat((starts - (total - lengths)).astype(kind), lengths)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker process's encoder, with the words that its earlier tasks have met."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def inverse(df: np.ndarray, n: int) -> np.ndarray:
    """BM25's inverse document frequency of terms in ``df`` of ``n`` documents."""
    return np.log1p((n - df + 0.5) / (df + 0.5))


class Index:
    """BM25 postings of a shard's documents.

    ``corpus`` tells the inverse document frequency of each term and the mean length; without it the
    given documents are the corpus.
    """

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, corpus: tuple[np.ndarray, float] | None = None):
        n = len(offsets) - 1
        doc = tx.row_of(offsets)
        key = np.sort(ids.astype(np.int64) * n + doc)
        at = tx.run_starts(key)
        count = np.diff(np.append(at, len(key)))
        term, place = np.divmod(key[at], n)
        self.doc = place.astype(np.int32)
        del key, at, doc, place
        starts = tx.run_starts(term)
        self.bounds = np.append(starts, len(term))
        terms = term[starts]
        del term
        df = np.diff(self.bounds)
        idf = inverse(df, n) if corpus is None else corpus[0][terms]
        length = np.diff(offsets) / max(1.0, len(ids) / n if corpus is None else corpus[1])
        self.weight = np.repeat(idf, df) * count * (_K1 + 1) / (count + _K1 * (1 - _B + _B * length[self.doc]))
        # the terms that each document asks with; a term of one document finds nothing
        useful = np.repeat(df > 1, df)
        holder = self.doc[useful]
        order = np.argsort(holder, kind="stable")
        self.asks = np.repeat(np.arange(len(df), dtype=np.int32), df)[useful][order]
        self.ask_bounds = np.concatenate(([0], np.cumsum(np.bincount(holder, minlength=n))))
        self.n = n

    def neighbours(self, d: int, unused: np.ndarray):
        """Unused documents with a positive score, best first, ties to the earlier document."""
        spans = [slice(self.bounds[t], self.bounds[t + 1]) for t in self.asks[self.ask_bounds[d] : self.ask_bounds[d + 1]].tolist()]
        if not spans:
            return
        score = np.zeros(self.n)
        for at in range(0, len(spans), _SPANS):
            some = spans[at : at + _SPANS]
            score += np.bincount(np.concatenate([self.doc[s] for s in some]), np.concatenate([self.weight[s] for s in some]), self.n)
        score[~unused] = 0
        found = np.flatnonzero(score)
        if len(found) > 16:
            best = found[np.argpartition(-score[found], 15)[:16]]
            cut = score[best].min()
            best = found[score[found] >= cut]
            yield from best[np.argsort(-score[best], kind="stable")].tolist()
            found = found[score[found] < cut]
        yield from found[np.argsort(-score[found], kind="stable")].tolist()


def arrange(ids: np.ndarray, offsets: np.ndarray, window: int = WINDOW, corpus: tuple[np.ndarray, float] | None = None) -> np.ndarray:
    """Pieces (document, start, length, sequence, offset) of one shard."""
    n = len(offsets) - 1
    index = Index(ids, offsets, corpus)
    unused = np.ones(n, bool)
    sizes = np.diff(offsets).tolist()
    out: list[tuple[int, int, int, int, int]] = []
    sequence = filled = first = 0
    seed: tuple[int, int] | None = None

    def put(d: int, start: int) -> int:
        """Lay down what fits and return where the rest begins."""
        nonlocal filled
        take = min(sizes[d] - start, window - filled)
        out.append((d, start, take, sequence, filled))
        filled += take
        return start + take

    while True:
        if seed is None:
            while first < n and not unused[first]:
                first += 1
            if first == n:
                break
            seed = (first, 0)
            unused[first] = False
        d, rest = seed[0], put(*seed)
        seed = (d, rest) if rest < sizes[d] else None
        if filled < window:
            for other in index.neighbours(d, unused):
                unused[other] = False
                rest = put(other, 0)
                if filled == window:
                    seed = (other, rest) if rest < sizes[other] else None
                    break
        if filled == window:
            sequence, filled = sequence + 1, 0
    return np.array(out, np.int64).reshape(-1, 5)


_ENCODED = "doc_id long, ids binary, r1 long, r2 long, place long, terms array<int>, counts array<long>"


def routes(term: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two draws of a term for each document, from its distinct terms (``term[offsets[i]:offsets[i+1]]``), as hashes.

    A term is drawn in proportion to its rank in the vocabulary, which puts frequent pieces first; all
    documents draw by the same random values, so the more rare terms two documents share, the likelier
    they draw the same.
    """
    out = []
    for seed in (1, 2):
        value = tx.mix(term.astype(np.uint64) * np.uint64(2) + np.uint64(seed << 40))
        race = -np.log(((value >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / (term + 1.0)
        least = np.minimum.reduceat(race, offsets[:-1])
        won = np.flatnonzero(race == np.repeat(least, np.diff(offsets)))
        # equal races are as good as impossible; the earlier term wins
        first = won[np.searchsorted(won, offsets[:-1])]
        out.append(tx.mix(value[first]).view(np.int64))
    return out


def _encoded(path: str):
    """Rows of documents, with their ids and routes; and a row of each task's counts: terms by documents, -1: tokens, -2: documents."""

    def encode_task(batches):
        encode = encoder(path)
        size = encode.tokenizer.get_vocab_size(with_added_tokens=True)
        kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        df, tokens, place = np.zeros(size, np.int64), 0, TaskContext.get().partitionId() << 36
        seen = 0
        for batch in tx.chunks(batches, size=_CHUNK):
            ids, offsets = encode(tx.texts(batch))
            n = batch.num_rows
            key = np.sort(tx.row_of(offsets) * size + ids)
            doc, term = np.divmod(key[tx.run_starts(key)], size)
            df += np.bincount(term, minlength=size)
            tokens += len(ids)
            bounds = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n))))
            r1, r2 = routes(term, bounds)
            data = ids.astype(kind)
            ends = offsets * kind.itemsize
            if int(ends[-1]) < 1 << 31:
                column = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            else:
                column = pa.array([data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())
            at = np.arange(place + seen, place + seen + n)
            seen += n
            none = [pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column, pa.array(r1), pa.array(r2), pa.array(at), *none], names=_ENCODED_NAMES)
        terms = np.flatnonzero(df)
        counts = [np.append(terms, (-1, -2)).tolist()], [np.append(df[terms], (tokens, seen)).tolist()]
        lists = [pa.array(counts[0], pa.list_(pa.int32())), pa.array(counts[1], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *[pa.nulls(1, pa.int64())] * 3, *lists], names=_ENCODED_NAMES)

    return encode_task


_ENCODED_NAMES = [c.split()[0] for c in _ENCODED.split(", ")]


def _corpus(table: DataFrame) -> tuple[np.ndarray, float]:
    """Inverse document frequencies by term, as long as the vocabulary, and the mean length."""
    pairs = table.filter("terms IS NOT NULL").select(F.explode(F.arrays_zip("terms", "counts")).alias("c"))
    found = pairs.groupBy(F.col("c.terms").alias("term")).agg(F.sum("c.counts").alias("n")).toArrow()
    term, n = found["term"].to_numpy(), found["n"].to_numpy()
    tokens, docs = (int(n[term == k].sum()) for k in (-1, -2))
    real = term >= 0
    df = np.zeros(int(term[real].max(initial=0)) + 1, np.int64)
    df[term[real]] = n[real]
    return inverse(df, docs), tokens / max(1, docs)


def _shards(docs: DataFrame, tokens: int) -> DataFrame:
    """``docs`` (r1, r2, size and whatever) with ``shard``, by exact counts of tokens.

    Routes that fit share shards in order. A longer one has shards of its own, dealt by second routes; a pair of routes
    that is longer than a shard is dealt by the hash of id and content. Documents are not shuffled for it.
    """
    by = docs.groupBy("r1").agg(F.sum("size").alias("held"))
    # as long as the vocabulary: one row for each term that is a route
    order = Window.partitionBy((F.col("held") > tokens).alias("long")).orderBy("r1")
    before = F.sum("held").over(order) - F.col("held")
    long = F.col("held") > tokens
    base = F.when(long, F.row_number().over(order).cast("long") * (1 << 24)).otherwise(F.floor(before / tokens))
    first = by.select("r1", base.alias("base"), F.when(long, F.ceil(F.col("held") / tokens)).otherwise(1).alias("parts"))
    # at most one row for each shard's worth of tokens
    hot = write_table(docs.groupBy("r1", "r2").agg(F.sum("size").alias("held")).filter(F.col("held") > tokens).select("r1", "r2", F.ceil(F.col("held") / tokens).alias("split")), "pairs")
    placed = docs.join(F.broadcast(first), "r1").join(F.broadcast(hot) if hot.count() <= MAX_BROADCAST_PAIRS else hot, ["r1", "r2"], "left")
    piece = F.pmod(F.xxhash64("r2", F.pmod(F.xxhash64("doc_id", "k1", "k2"), F.col("split"))), F.lit(1 << 23)) + (1 << 23)
    within = F.when(F.col("split").isNotNull(), piece).when(F.col("parts") > 1, F.pmod(F.xxhash64("r2"), F.col("parts"))).otherwise(0)
    return placed.withColumn("shard", F.col("base") + within).drop("base", "parts", "split")


def _packer(shared, kind: str, window: int):
    def pack_task(batches):
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        shard = None

        def flush():
            doc_ids = pa.concat_arrays([h[0] for h in held])
            ids = np.concatenate([h[1] for h in held])
            offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(h[2]) for h in held]))])
            held.clear()
            pieces = arrange(ids, offsets, window, shared.value)
            sequences = (shard << 22) + pieces[:, 3]
            for at in range(0, len(pieces), 2000):
                p = pieces[at : at + 2000]
                begin = offsets[p[:, 0]] + p[:, 1]
                data = [ids[b : b + k].astype("<u4").tobytes() for b, k in zip(begin.tolist(), p[:, 2].tolist(), strict=True)]
                columns = [doc_ids.take(pa.array(p[:, 0])), p[:, 1], p[:, 2], np.diff(offsets)[p[:, 0]], sequences[at : at + 2000], p[:, 4], pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            of = batch.column("shard").to_numpy()
            cuts = [*np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))).tolist(), len(of)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if shard != of[a] and held:
                    yield from flush()
                    tx.trim()
                shard = int(of[a])
                for part in tx.chunks(iter([batch.slice(a, b - a)]), text="ids", size=_CHUNK):
                    raw, at = tx.byte_view(part.column("ids"))
                    held.append((part.column("doc_id"), raw.view(kind).astype(np.int32), at // np.dtype(kind).itemsize))
        if held:
            yield from flush()

    return pack_task


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of all documents; ``ids`` are little-endian unsigned 32-bit token ids.

    The same documents give the same pieces and sequence ids, however they are partitioned. Null and empty texts are
    the end id alone. Repeated rows and equal ids are documents of their own. Other columns are ignored. A table
    without rows gives no pieces.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    kind = "<u2" if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
    table = write_table(docs.select("doc_id", "text").mapInArrow(_encoded(path), _ENCODED), "encoded")
    shared = spark.sparkContext.broadcast(_corpus(table))
    size = (F.octet_length("ids") / np.dtype(kind).itemsize).cast("long")
    rows = table.filter("ids IS NOT NULL").select("doc_id", "ids", "r1", "r2", size.alias("size"), F.xxhash64(F.lit(1), "ids").alias("k1"), F.xxhash64(F.lit(2), "ids").alias("k2"))
    dealt = _shards(rows, shard_tokens).repartition("shard").sortWithinPartitions("shard", "r1", "r2", "doc_id", "k1", "k2")
    return dealt.select("doc_id", "ids", "shard").mapInArrow(_packer(shared, kind, window), PIECES)


def op8_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 4096 tokens, ids by their CRC-32."""
    pieces = pack(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
