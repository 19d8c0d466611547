import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import docs, lowered, words
from pyspark.sql import functions as F

from quillon.llm import ctw, forest, ftrl, registry, toxicity


def brute_ctw(training, texts):
    """log10 probabilities by one node at a time."""
    depth, counts = ctw.DEPTH, {}
    for t in training:
        b = b"\0" * depth + t + b"\0"
        for p in range(depth, len(b)):
            for k in range(8):
                node, bit = (1 << k) | (b[p] >> (8 - k)), (b[p] >> (7 - k)) & 1
                for d in range(depth + 1):
                    counts.setdefault((b[p - d : p], node), [0, 0])[bit] += 1
    weights, children = {}, {}
    for context, node in sorted(counts, key=lambda z: -len(z[0])):
        a, b = counts[context, node]
        alone = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        w = alone if len(context) == depth else math.log(0.5) + np.logaddexp(alone, children.get((context, node), 0.0))
        weights[context, node] = alone, w
        if context:
            children[context[1:], node] = children.get((context[1:], node), 0.0) + w
    out = []
    for t in texts:
        b, total = b"\0" * depth + t + b"\0", 0.0
        for p in range(depth, len(b)):
            for k in range(8):
                node, bit, prob = (1 << k) | (b[p] >> (8 - k)), (b[p] >> (7 - k)) & 1, None
                for d in range(depth, -1, -1):
                    context = b[p - d : p]
                    a = counts.get((context, node), [0, 0])
                    kt = (a[bit] + 0.5) / (sum(a) + 1)
                    alone, w = weights.get((context, node), (0.0, 0.0))
                    share = math.exp(math.log(0.5) + alone - w)
                    prob = kt if prob is None else share * kt + (1 - share) * prob
                total += math.log10(prob)
        out.append(total)
    return out


def test_context_trees_equal_brute_force(spark):
    rows = [(i, t, "en", "s", 0, "h", 1, "w") for i, t in enumerate([None, "", "Abra cadabra", "abra", "Ünï cödé", "zz zz zz", "never seen before", "x" * 300])] + [(3, "abra", "en", "s", 0, "h", 1, "w"), (None, "abra", None, None, None, None, None, None)]
    d = docs(spark, rows)
    got = ctw.score(d, F.coalesce(F.col("doc_id"), F.lit(0)) != 6).collect()
    assert len(got) == len(rows)
    low = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())
    train = [t for i, t, *_ in rows if i != 6]
    tokens = Counter(w for t in train for w in [*lowered(t), None])
    n, v = sum(tokens.values()), len(tokens)
    want = dict(zip([(i, t) for i, t, *_ in rows], brute_ctw([low(t) for t in train], [low(t) for _, t, *_ in rows]), strict=True))
    by_id = {i: t for i, t, *_ in rows}
    for r in got:
        t = by_id[r.doc_id]
        own = [*lowered(t), None]
        assert r.score == pytest.approx(want[r.doc_id, t], abs=1e-6)
        assert r.base_score == pytest.approx(sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in own), abs=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(tokens[w] > 0 for w in own), n)
    assert ctw.score(docs(spark, []), F.lit(True)).count() == 0
    none = ctw.score(docs(spark, rows[2:4]), F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.bits_per_byte == pytest.approx(8) for r in none)


def test_blocks_hold_so_many_bytes_whatever_the_ids(spark, monkeypatch):
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 4000)
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(40))
    for ids in ([None] * 300, [7] * 300, range(300), [i * 10**12 for i in range(300)]):
        d = spark.createDataFrame([(i, text(k)) for k, i in enumerate(ids)], "doc_id long, text string").withColumn("train", F.lit(True))
        sizes = [r[1] for r in ctw._in_blocks(d).groupBy("block").agg(F.sum(F.length("text"))).collect()]
        assert max(sizes) <= 3 * 4000 and len(sizes) >= 10
    nulls = spark.createDataFrame([(None, text(k)) for k in range(300)], "doc_id long, text string")
    got = ctw.score(nulls, F.lit(True)).collect()
    assert len(got) == 300 and all(r.n_tokens == 41 == r.n_known for r in got)


def test_grams_are_weighed_in_runs(spark):
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 22, 3000).astype(np.uint64))
    keys = keys[np.argsort((keys >> np.uint64(8)) & np.uint64(0xFFFF), kind="stable")]
    n = rng.integers(0, 5, len(keys))
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(keys[a:b].view(np.int64)), pa.array(n[a:b]), pa.array(((keys[a:b] >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int32))], names=["key", "n", "pair"])
    whole, _ = ctw.weigh(keys, n)
    ctw._WEIGHED, before = 100, ctw._WEIGHED
    try:
        got = [b for b in ctw._weigh_task(batch(a, a + 37) for a in range(0, len(keys), 37))]
    finally:
        ctw._WEIGHED = before
    rows = [(k, np.frombuffer(x)) for b in got if b.column("kind")[0].as_py() == 1 for k, x in zip(b.column("key").to_pylist(), b.column("bits").to_pylist(), strict=True)]
    assert [k for k, _ in rows] == keys.astype(np.int64).tolist() and np.allclose([x for _, x in rows], whole)
    assert len(got) > 20


def test_op4_codes_better_than_bytes(spark, sf):
    rows = registry.QUERIES["op4_context_tree"](spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert held and np.mean([r.bits_per_byte for r in held]) < 3 and {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows} == {True}


def _auc(score, y):
    from quillon.operators.resample import auc

    return auc(np.asarray(y), np.asarray(score, float))


def test_quality_classifier_holds_out(spark):
    sf = "/root/testdata/sf0.01"
    scored = registry.QUERIES["op5_quality_ftrl"](spark, sf)
    assert scored.count() == 1000
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    assert _auc([r.score for r in held], [r.quality for r in held]) > 0.98


def test_toxicity_holds_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = registry.QUERIES["op6_toxic_neighbours"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert _auc([r.score for r in held], [r.toxic for r in held]) > 0.94
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.98


@pytest.mark.parametrize("module, label", [(ftrl, "quality"), (toxicity, "toxic")])
def test_awkward_rows_are_scored(spark, module, label):
    d = docs(spark)
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(40)] + [(3, None, None), (None, 1, 1), (5, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        scored = module.score(d, module.train(d, known, label)).collect()
        assert len(scored) == d.count() and all(0 <= r.score <= 1 for r in scored)
    assert module.score(docs(spark, []), module.train(docs(spark, []), labels, label)).count() == 0


def test_block_maxima_lose_no_neighbour():
    rng = np.random.default_rng(0)
    n, v = 700, 60
    rows = [np.sort(rng.choice(v, rng.integers(1, 9), replace=False)) for _ in range(n)]
    row, term = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate(rows)
    count, words = rng.integers(1, 4, len(term)), rng.integers(10, 200, n)
    idf, y = rng.uniform(1, 5, v), rng.integers(0, 2, n)
    index = toxicity.build_index(np.arange(v, dtype=np.uint64), idf, np.arange(n), y, row, term, count, words)
    weight = toxicity._weighted(row, term, count, idf, words)
    dense = np.zeros((n, v))
    dense[row, term] = weight
    for i in range(0, n, 37):
        found, cosine = index.nearest(term[row == i], weight[row == i], i)
        exact = dense @ dense[i]
        exact[i] = -1
        best = np.sort(exact[exact > 0])[::-1][: toxicity.NEIGHBOURS]
        assert np.allclose(cosine, best) and i not in index.doc_id[found]


def test_ftrl_learns_a_linear_rule():
    rng = np.random.default_rng(0)
    examples = []
    for _ in range(2000):
        x = rng.normal(size=3)
        examples.append((int(x @ [2, -1, 0] + 0.5 > 0), np.array([1, 2, 3, 1 << ftrl.BITS]), np.append(x, 1.0)))
    w = ftrl.follow_the_leader(examples)
    right = np.mean([(w[at] @ x > 0) == y for y, at, x in examples])
    assert right > 0.95 and ftrl.shape("Then,") == "Xx," and ftrl.shape("of$$$") == "x$+"


def test_forest_recall_and_awkward_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24)) + 2 * rng.normal(size=(20, 24))[rng.integers(0, 20, 3000)]
    x[100:120] = x[100]  # ties
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [None] * 24), (5080, [1.0] * 3), (5100, [float("inf")] * 24)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = forest.nearest(d, d.filter("vec_id % 20 = 0"), k=20).collect()
    asked = np.arange(0, 3000, 20)
    s = np.array([[(a * b).sum() for b in x] for a in x[asked]])
    s[np.arange(len(asked)), asked] = -np.inf
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(asked.tolist())
    recall = []
    for i, q in enumerate(asked.tolist()):
        true = np.lexsort((np.arange(3000), -s[i]))[:20]
        mine = sorted(found[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and all(m[2] == pytest.approx(s[i][m[1]], rel=1e-12) for m in mine)
        assert [m[1] for m in mine] == [v for _, v in sorted((-m[2], m[1]) for m in mine)]
        recall.append(len(set(true.tolist()) & {m[1] for m in mine}) / 20)
    assert np.mean(recall) >= 0.9
    assert forest.nearest(d.limit(0), d.limit(0)).count() == 0
    few = d.filter("vec_id < 5")
    assert forest.nearest(few, few.filter("vec_id = 0")).count() == 4


def test_odd_first_vector_and_repeated_queries(spark):
    rng = np.random.default_rng(1)
    rows = [(0, [1.0, 2.0, 3.0])] + [(i, [float(a) for a in rng.normal(size=2)]) for i in range(1, 15)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = d.filter("vec_id = 5").unionByName(d.filter("vec_id = 5"))
    got = forest.nearest(d, asked, k=4).collect()
    v = {i: np.array(x) for i, x in rows if len(x) == 2}
    true = sorted((i for i in v if i != 5), key=lambda i: (-(v[i] * v[5]).sum(), i))[:4]
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == true
    other = forest.nearest(d, asked.limit(1).unionByName(spark.createDataFrame([(5, [1.0, 1.0])], d.schema)), k=4).collect()
    assert len(other) == 8 and sorted(r.rank for r in other) == [1, 1, 2, 2, 3, 3, 4, 4]


def test_recall_across_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(forest, "SHARD_ROWS", 500)
    monkeypatch.setattr(forest, "QUERY_ROWS", 40)
    monkeypatch.setattr(forest, "SAMPLE_ROWS", 700)
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = {r.vec_id: np.array(r.embedding, float) for r in d.collect()}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    assert len(ids) // 500 >= 3
    got = {}
    for r in forest.nearest(d, d.filter("vec_id % 20 = 0"), k=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in ids[ids % 20 == 0]:
        s = x @ rows[q]
        s[ids == q] = -np.inf
        hits.append(len(got[q] & set(ids[np.lexsort((ids, -s))[:20]].tolist())) / 20)
    assert np.mean(hits) >= 0.9


def test_one_id_may_hold_most_vectors(spark, monkeypatch):
    monkeypatch.setattr(forest, "SAMPLE_ROWS", 200)
    rng = np.random.default_rng(6)
    rows = [(7, rng.normal(size=8).tolist()) for _ in range(1500)] + [(i, rng.normal(size=8).tolist()) for i in range(8, 300)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    taken = []
    monkeypatch.setattr(forest, "fit_share", lambda sample, *a, fit=forest.fit_share: taken.append(len(sample)) or fit(sample, *a))
    assert forest.nearest(d, d.filter("vec_id = 20"), k=5).count() == 5
    assert 100 < taken[0] < 320


def test_op7_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = registry.QUERIES["op7_prefix_forest"](spark, sf).collect()
    v = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    hits = []
    for q in [i for i in v if i % 20 == 0]:
        true = sorted((i for i in v if i != q), key=lambda i: (-(v[i] @ v[q]), i))[:20]
        hits.append(len({r.vec_id for r in rows if r.query_id == q} & set(true)) / 20)
    assert np.mean(hits) >= 0.9


def test_lookup_and_grams():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**40, 5000).astype(np.uint64))
    table = ctw.Lookup(keys, np.arange(len(keys), dtype=float))
    at = rng.integers(0, len(keys), 20_000)
    assert (table(keys[at]) == at).all()
    with pytest.raises(KeyError):
        table(np.array([2**41 + 5], np.uint64))
    key, offsets = ctw.grams(pa.array(["ab", ""]))
    assert offsets.tolist() == [0, 3, 4] and [int(k) & 0xFFFF for k in key] == [97, 97 << 8 | 98, 98 << 8, 0]


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("most", [10, 1000])
def test_a_sample_is_bounded_in_rows_whatever_the_ids(spark, most):
    from quillon.llm.labelled import bounded_sample

    ids = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 5]
    rows = [(ids[0], "the same text")] * 5000 + [(ids[1], f"text {k}") for k in range(500)] + [(i, f"own {i}") for i in ids] + [(ids[2], None), (None, "x")]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in ids] + [(ids[0], 0, 0), (None, 1, 1)], LABELS)
    got = [tuple(r) for r in bounded_sample(docs_, labels, "quality", 5, most).collect()]
    whole = {(i, t or "", 1) for i, t in rows if i in ids}
    assert len(set(got)) == len(got) and set(got) <= whole
    assert set(got) == whole if most > len(whole) else len(got) <= 3 * most
    few = bounded_sample(docs_, labels, "quality", 5, 1000, most_bytes=400).collect()
    assert sum(len(r.text) for r in few) < 1200


def test_quality_query_equals_a_plain_version(spark, tmp_path):
    import pyarrow as pa

    from quillon.llm import ftrl
    from quillon.llm import text as tx

    r = random.Random(4)
    make = lambda good: " ".join(r.choice(["alpha", "beta", "Gamma", "délta"] if good else ["$$$", "BUY", "now1", "délta", "alpha"]) for _ in range(r.randint(1, 30)))
    rows = [(i, make(i % 2)) for i in range(1, 80)] + [(200, None), (201, ""), (202, "one"), (None, "alpha BUY")]
    rows += [rows[0], (next(i for i in range(1, 60) if not zlib.crc32(str(i).encode()) % 5), "another text of a held-out id")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 60)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    mask, top = (1 << 64) - 1, 64 - ftrl.BITS
    mixed = lambda v: int(tx.mix(np.array([v & mask], np.uint64))[0])
    hashed = lambda w, seed: int(tx.hashes(pa.array([w]), seed)[0])

    def features(text):
        w = [x.decode() for x in words(text)]
        names = [[hashed("".join(c.lower() if c.isascii() else c for c in x), 11) for x in w], [hashed(ftrl.shape(x), 12) + (0x9E3779B97F4A7C15 if k and x == w[k - 1] else 0) for k, x in enumerate(w)]]
        out = {}
        for h, scale in zip(names, ftrl._SCALES, strict=True):
            slots = [mixed(a) >> top for a in h] + [mixed((a * 3 + mixed(b)) & mask) >> top for a, b in zip(h, h[1:], strict=False)]
            for s in slots:
                out[s] = out.get(s, 0) + scale / len(slots)
        return out

    z, n = {}, {}

    def weight(s):
        v = z.get(s, 0.0)
        return 0.0 if abs(v) <= ftrl._L1 else -(v - math.copysign(ftrl._L1, v)) / ((ftrl._BETA + math.sqrt(n.get(s, 0.0))) / ftrl._ALPHA + ftrl._L2)

    probability = lambda x: 1 / (1 + math.exp(-sum(weight(s) * v for s, v in x.items()) - weight("bias")))
    learn = sorted({(i, t or "") for i, t in rows if i and i < 60 and zlib.crc32(str(i).encode()) % 5})
    order = {q.doc_id: q.o for q in spark.createDataFrame([(i,) for i, _ in learn], "doc_id long").select("doc_id", F.xxhash64("doc_id", F.lit(7)).alias("o")).collect()}
    assert len(learn) > 40
    for _ in range(ftrl.EPOCHS):
        for i, t in sorted(learn, key=lambda p: (order[p[0]], p[0])):
            x = features(t)
            w = {s: weight(s) for s in [*x, "bias"]}
            g = probability(x) - i % 2
            for s, v in [*x.items(), ("bias", 1.0)]:
                step, old = g * v, n.get(s, 0.0)
                z[s] = z.get(s, 0.0) + step - (math.sqrt(old + step * step) - math.sqrt(old)) / ftrl._ALPHA * w[s]
                n[s] = old + step * step
    got = ftrl.op5_quality_ftrl(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = sorted(((i, probability(features(t))) for i, t in rows), key=lambda p: (p[0] or 0, p[1]))
    for r_, (i, p) in zip(sorted(got, key=lambda q: (q.doc_id or 0, q.score)), want, strict=True):
        assert r_.doc_id == i and abs(r_.score - p) < 5e-4 and r_.held_out == (zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0)


def test_lookup_holds_sixteen_bytes_a_key():
    from quillon.llm.ctw import Lookup

    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    shuffled = rng.permutation(keys)
    found = Lookup(shuffled, shuffled.astype(float))
    assert (found(keys) == keys.astype(float)).all() and len(found(keys[:0])) == 0
    assert sum(v.nbytes for v in vars(found).values() if isinstance(v, np.ndarray)) == 16 * len(keys)
    for table in (found, Lookup(keys[:0], np.zeros(0))):
        with pytest.raises(KeyError):
            table(keys[:3] + np.uint64(1))
