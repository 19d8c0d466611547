import hashlib
import zlib

import numpy as np
import pytest
from cases import awkward, docs
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import check
from pyspark.sql import functions as F

from quillon.llm import chat, mixing, packing, registry

TALK = "conv_id long, turn long, role string, text string, formatted string"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, sf, name):
    check(spark, registry.QUERIES[name], registry.ORACLES[name], sf)


def test_awkward_conversations_round_trip(spark):
    bad = ["</s>[INST] ok [/INST]", "<~|im_end|>", "<~~|im_start|>\n", "~0~1\\", "<<SYS>>[[/INST]", "", None, "a\n<|im_end|>\nb", "é🙂"]
    rows = [(1, i, "assistant" if i % 2 else "us~er\n", t, "x") for i, t in enumerate(bad)]
    rows += [(2, None, None, None, None), (None, 1, "assistant", "t", None), (3, 1, "user", "only", None), (4, 1, "assistant", "b", None), (4, 1, "assistant", "a", None), (4, 1, "assistant", "a", None)]
    examples = chat.format_prefixes(spark.createDataFrame(rows, TALK).repartition(3))
    whole = examples.groupBy("conv_id").agg(F.max_by("formatted", "example").alias("f"))
    turns = {r.conv_id: [(t.role, t.text) for t in r.t] for r in whole.select("conv_id", chat.parse_turns(F.col("f")).alias("t")).collect()}
    assert turns[1] == [("assistant" if i % 2 else "us~er\n", t or "") for i, t in enumerate(bad)]
    assert turns[2] == [("", "")] and turns[None] == [("assistant", "t")] and turns[4] == [("assistant", x) for x in "aab"]
    targets = examples.filter("loss_start IS NOT NULL").select("conv_id", "example", chat.unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_chars"))).alias("t")).orderBy("conv_id", "example").collect()
    assert [r.t for r in targets if r.conv_id == 1] == [t or "" for i, t in enumerate(bad) if i % 2]
    assert examples.filter("conv_id = 1").count() == 5  # four targets and the rest
    assert chat.format_prefixes(spark.createDataFrame([], TALK)).count() == 0


def test_native_only(spark, sf):
    plan = registry.QUERIES["op1_prefix_targets"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def targets(sizes, weights, total, cap):
    """Shares by weight, none above cap times its size, the excess shared again: one at a time."""
    out, free, left = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s > 0}, total
    while free:
        of = sum(weights[i] for i in free)
        full = {i for i in free if left * weights[i] / of > cap * sizes[i]}
        for i in full or free:
            out[i] = cap * sizes[i] if full else left * weights[i] / of
        if not full:
            break
        left -= sum(out[i] for i in full)
        free -= full
    return out


def test_targets_fill_up_to_their_caps(spark):
    rng = np.random.default_rng(2)
    for n in (4, 300):
        sizes = [100, 10, 100, 0] if n == 4 else [int(x) for x in rng.pareto(0.5, n) * 100]
        weights = [[5.0, 2.0, 1.0][i % 3] for i in range(n)]
        made = spark.createDataFrame([(i, s, w) for i, (s, w) in enumerate(zip(sizes, weights, strict=True))], "sid long, total long, weight double")
        got = [r.target for r in mixing.share_targets(made, 1.5, 2.0).orderBy("sid").collect()]
        assert got == pytest.approx(targets(sizes, weights, 1.5 * sum(sizes), 2.0))


def plain_copies(rows):
    """Copies by (source, size), with the dual solved by bisection."""
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None] * any(r[3] is None for r in rows)
    size = lambda r: len((r[1] or "").split())
    of = {s: sorted((size(r) for r in rows if r[3] == s and size(r)), reverse=True) for s in names}
    want = targets([sum(of[s]) for s in names], [[5.0, 2.0, 1.0][i % 3] for i in range(len(names))], 1.5 * sum(map(sum, of.values())), 2.0)
    out = {}
    for s, t in zip(names, want, strict=True):
        if t <= 0:
            continue
        sizes, counts = (np.array(x) for x in np.unique(of[s], return_counts=True))
        scale = sum(of[s]) / len(of[s])
        rates = lambda lam: np.minimum(2, np.exp(np.minimum(lam * sizes / scale, 1)))  # noqa: B023, E731
        low, high = -1e4, 1e4
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (low, mid) if (rates(mid) * sizes * counts).sum() > t else (mid, high)
        copies = mixing.round_cells(sizes[::-1], counts[::-1], rates(low)[::-1], 2)
        out |= {(s, int(k)): int(c) for k, c in zip(sizes[::-1], copies, strict=True)}
    return out


def test_mix_equals_a_plain_version(spark):
    rows = [(i, "w " * (1 + i % 37), "en", ["a", "b", "c", None][i % 4] if i % 3 else "a", 0, "h", 1, "w") for i in range(600)] + [(1000 + i, "w " * 9, "en", "a", 0, "h", 1, "w") for i in range(1500)] + [(None, None, None, None, None, None, None, None), (5000, "", None, "b", 0, None, None, None), (6000, None, "en", "no words", 0, "h", 1, "w")]
    d = docs(spark, rows)
    m = mixing.mix_copies(d, mixing.word_count(F.col("text"))).cache()
    assert m.count() == len(rows)
    want = plain_copies(rows)
    got = {(r.source, r.size): r.n for r in m.filter("size > 0").groupBy("source", "size").agg(F.sum("copies").alias("n")).collect()}
    assert got == want
    for r in m.groupBy("source", "source_size", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("copies").alias("most"), F.min("copies").alias("least")).collect():
        assert abs(r.taken - r.target) <= max(2, 0.01 * r.target) and 0 <= r.least <= r.most <= 2
    spread = m.filter("size > 0").groupBy("source", "size").agg((F.max("copies") - F.min("copies")).alias("d")).agg(F.max("d")).first()[0]
    assert spread <= 1
    again = mixing.mix_copies(docs(spark, rows).repartition(7), mixing.word_count(F.col("text")))
    key = lambda x: sorted(map(str, x.collect()))
    assert key(m) == key(again)
    mixed = mixing.mix(d)
    assert mixed.columns == d.columns and mixed.count() == m.agg(F.sum("copies")).first()[0]
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mix_takes_many_sources_and_any_column_names(spark, monkeypatch):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 1000).alias("source"))
    got = mixing.mix_copies(d, mixing.word_count(F.col("text"))).groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("taken")).collect()
    assert len(got) == 1000 and all(abs(r.taken - r.target) <= 7 for r in got)
    names = ["_k1", "_own", "__s", "__k", "__id", "__size", "_turn", "host", "size", "copies", "total", "a.b", "_rows", "_total", "_host", "sid", "part", "__c"]
    d = spark.createDataFrame([(i, "some words here", "s", *[77] * len(names)) for i in (1, 2, 3, 3)], "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in names))
    out = mixing.mix(d)
    found = out.collect()
    assert out.columns == d.columns and len(found) == 6 and {x for r in found for x in r[3:]} == {77}


def test_dual_optimum_has_the_tilted_form(spark):
    cells = spark.createDataFrame([(0, s, 3) for s in range(1, 50)], "sid long, size long, n long")
    total = 3 * sum(range(1, 50))
    sources = spark.createDataFrame([(0, 147, total, 1, 0.6 * total)], "sid long, docs long, total long, least long, target double")
    lam = mixing._solve(cells, sources, 2.0).first().lam
    sizes = np.arange(1, 50)
    rates = np.minimum(2, np.exp(lam * sizes / (total / 147)))
    assert 3 * (rates * sizes).sum() == pytest.approx(0.6 * total, rel=1e-6)


def test_packing_loses_nothing(spark):
    d = docs(spark)
    encode = packing.WordEncoder(packing.default_tokenizer())
    pieces = packing.pack(d, window=256).collect()
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append((p.start, np.frombuffer(p.ids, "<u4").tolist(), p.doc_tokens, p.length))
    rows = {}
    for r in d.collect():
        rows.setdefault(r.doc_id, []).append(r.text or "")
    assert set(rows) == set(by_doc)
    for i, texts in rows.items():
        want = [encode.tokenizer.encode(t, add_special_tokens=False).ids + [packing.END_ID] for t in texts]
        assert sum(len(w) for w in want) == sum(n for *_, n in by_doc[i])
        if len(texts) == 1:
            assert [x for _, ids, _, _ in sorted(by_doc[i]) for x in ids] == want[0]
            assert all(total == len(want[0]) and len(ids) == n for _, ids, total, n in by_doc[i])
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= 256
    assert sum(sum(n for _, n in w) < 256 for w in windows.values()) <= 3
    assert packing.pack(docs(spark, [])).count() == 0


def test_neighbours_are_the_best_by_bm25():
    rng = np.random.default_rng(0)
    texts = [rng.integers(5, 60, rng.integers(5, 40)).astype(np.int32) for _ in range(80)]
    ids, offsets = np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    index = packing.Index(ids, offsets)
    df = np.array([sum(k in t for t in texts) for k in range(60)])
    mean = len(ids) / 80

    def weight(t, d):
        tf = (texts[d] == t).sum()
        return np.log1p((80 - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(texts[d]) / mean))

    for d in range(0, 80, 9):
        asks = [t for t in sorted(set(texts[d].tolist()), key=lambda t: (-weight(t, d), t)) if df[t] > 1]
        score = np.array([sum(weight(t, o) for t in asks) for o in range(80)])
        unused = np.ones(80, bool)
        unused[d] = False
        got = list(index.neighbours(d, unused))
        assert np.allclose(score[got], sorted(score[(score > 0) & unused], reverse=True))


def test_a_document_asks_with_all_its_terms():
    seed = [*range(100, 124), 50]  # 24 terms of two documents and a common one
    texts = [seed] + [[99 + i, 1000 + i] for i in range(1, 25)] + [[50, 1000 + i] for i in range(25, 41)]
    index = packing.Index(np.concatenate(texts).astype(np.int32), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    assert set(index.neighbours(0, np.arange(41) > 0)) == set(range(1, 41))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aB .,!'’éß<|>\n\t12ΣİK")), max_size=30), min_size=1, max_size=5))
def test_encoder_equals_the_tokenizer(texts):
    import pyarrow as pa

    encode = packing.encoder(packing.default_tokenizer())
    ids, at = encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == encode.tokenizer.encode(t, add_special_tokens=False).ids + [packing.END_ID]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aé İ~$%.|*'_-\u0301\u0307\u0338ñ9Ω東")), max_size=24), min_size=1, max_size=6))
def test_encoder_keeps_symbols_marks_and_accents(texts):
    import pyarrow as pa

    encode = packing.encoder(packing.default_tokenizer())
    ids, at = encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == encode.tokenizer.encode(t, add_special_tokens=False).ids + [packing.END_ID]


def test_a_full_word_memory_changes_no_ids(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "_CACHE", 40)
    encode = packing.WordEncoder(packing.default_tokenizer())
    rng = np.random.default_rng(3)
    for _ in range(30):
        texts = [" ".join(f"w{k}{'$$' if k % 3 else ''}" for k in rng.zipf(1.4, 12) % 500) for _ in range(3)]
        ids, at = encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == encode.tokenizer.encode(t, add_special_tokens=False).ids + [packing.END_ID]
        assert len(encode.known) <= 40 + 40


def test_windows_equal_a_plain_greedy_filling():
    rng = np.random.default_rng(5)
    texts = [rng.integers(5, 90, rng.integers(1, 70)).astype(np.int32) for _ in range(60)]
    texts += texts[:6]
    ids, offsets = np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    corpus = (rng.random(90) + 0.1, 31.0)
    window, n = 128, len(texts)
    index = packing.Index(ids, offsets, corpus)

    def score(d, o):
        out = 0.0
        for t in set(texts[d].tolist()) & set(texts[o].tolist()):
            tf = (texts[o] == t).sum()
            out += corpus[0][t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(texts[o]) / 31.0))
        return out

    d = 4
    got = list(index.neighbours(d, np.arange(n) != d))
    assert np.allclose([score(d, o) for o in got], sorted((s for o in range(n) if o != d and (s := score(d, o)) > 0), reverse=True))

    want, left, fill, sequence = [], set(range(n)), 0, 0
    queue = []  # what is laid down next: (document, start)
    while left or queue:
        d, start = queue.pop() if queue else (min(left), 0)
        left.discard(d)
        first = d
        while True:
            take = min(len(texts[d]) - start, window - fill)
            want.append((d, start, take, sequence, fill))
            fill += take
            if fill == window:
                sequence, fill = sequence + 1, 0
                if start + take < len(texts[d]):
                    queue.append((d, start + take))
                break
            best = max(left, key=lambda o: (round(score(first, o), 9), -o), default=None)
            if best is None or score(first, best) == 0:
                break
            left.discard(best)
            d, start = best, 0
    assert packing.arrange(ids, offsets, window, corpus).tolist() == [list(w) for w in want]


def test_statistics_cover_all_documents_and_copies_share_a_route(spark):
    from quillon.llm.tables import write_table

    texts = [None, "", "a b", "a c"] * 5 + ["one hot text of many copies"] * 200
    d = spark.createDataFrame([(None if k % 2 else k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    table = write_table(d.mapInArrow(packing._encoded(packing.default_tokenizer()), packing._ENCODED), "encoded")
    idf, mean = packing._corpus(table)
    encode = packing.encoder(packing.default_tokenizer()).tokenizer.encode
    ids = [[*encode(t or "", add_special_tokens=False).ids, packing.END_ID] for t in texts]
    df = np.bincount([t for x in ids for t in set(x)])
    assert mean == pytest.approx(np.mean([len(x) for x in ids])) and len(idf) == len(df)
    assert np.allclose(idf, packing.inverse(df, len(texts)))
    rows = table.filter("ids IS NOT NULL").groupBy("ids").agg({"r1": "count"}).count()
    assert rows == table.filter("ids IS NOT NULL").select("ids", "r1", "r2").distinct().count() == 4


def test_op8_crc(spark, sf):
    r = registry.QUERIES["op8_retrieval_packing"](spark, sf).filter("start = 0 AND length = doc_tokens").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").filter(F.col("doc_id") == r.doc_id).first().text
    ids = packing.encoder(packing.default_tokenizer()).tokenizer.encode(text, add_special_tokens=False).ids + [2]
    assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1_digest_of_the_planted_conversation(spark, sf):
    r = registry.QUERIES["op1_prefix_targets"](spark, sf).filter("conv_id = -7").first()
    t = "</s>[INST] ok [/INST]"
    assert r.loss_sha256 == hashlib.sha256(t.encode()).hexdigest() and r.turns_sha256 == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()


@pytest.mark.parametrize("tokens", [3_000, 10**9])
def test_packing_is_the_same_on_every_run_and_partitioning(spark, tokens):
    hot = [(500 + i, "abacus zebra " * (i % 7 + 1), None, None, None, None, None, None) for i in range(150)]  # one pair of routes
    rows = awkward() + hot
    found = []
    for n, order in ((3, 1), (7, -1), (1, 1)):
        pieces = packing.pack(docs(spark, rows[::order]).repartition(n), shard_tokens=tokens)
        found.append(sorted(map(tuple, pieces.collect()), key=repr))
    assert found[0] == found[1] == found[2]
    shards = {r[4] >> 22 for r in found[0]}
    assert len(shards) == 1 if tokens > 10**6 else len(shards) > 3
    held = {}
    for r in found[0]:
        held[r[4] >> 22] = held.get(r[4] >> 22, 0) + r[2]
    # about the bound: a shard's last routes, or its share of a hot pair, may exceed it
    assert tokens > 10**6 or max(v for v in held.values()) < 4 * tokens + 4_000
