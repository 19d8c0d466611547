import random

import numpy as np
import pyarrow as pa
from cases import awkward, base_counts, docs, lowered, near_components, removed_lines
from pyspark.sql import functions as F

from quillon.llm import components, linejoin, minhash, quality, registry
from quillon.llm import text as tx


def test_quality_counts_and_verdicts(spark):
    d = docs(spark)
    got = quality.verdicts(quality.measure(d)).join(d.select(F.col("doc_id").alias("id"), F.col("text").alias("t")).distinct(), F.col("doc_id").eqNullSafe(F.col("id"))).collect()
    assert len(got) >= len(awkward()) - 3
    for r in got:
        want = base_counts(r.t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)
    assert quality.clean(docs(spark, [])).count() == 0


def test_boilerplate_goes_and_depleted_documents_are_rejected(spark):
    line = " ".join(f"boiler{i}" for i in range(40))
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(60))
    rows = [(i, f"{line}\n{own(i)}", "en", "big", 0, "h", 1, "w") for i in range(30)]
    rows += [(100 + i, f"{line} {i % 2}\n{line}\n{line}\nfew own{i} words here", "en", "big", 0, "h", 1, "w") for i in range(30)]
    rows += [(200, f"{line}\n{own(200)}", "en", "small", 0, "h", 1, "w")] + [(300 + i, f"{own(300)}", "en", "big", 0, "h", 1, "w") for i in range(50)]
    d = docs(spark, rows)
    limits = quality.Limits(documents=20, max_repeat_percent=90)
    kept = {r.doc_id: r.text for r in quality.clean(d, limits).collect()}
    assert all(kept[i] == own(i) for i in range(30))
    assert not any(i in kept for i in range(100, 130))  # depleted
    assert line in kept[200]  # another host
    assert sum(i in kept for i in range(300, 350)) == 50  # exact copies are one document
    assert quality.clean(d, limits).columns == d.columns


def test_near_duplicates_equal_brute_force(spark):
    d = docs(spark)
    rows = [(r.doc_id, r.text) for r in d.collect()]
    for width in (4, 5):
        want, sets = near_components(rows, width)
        got = minhash.near_duplicates(d, width).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert r.component_id == want[r.doc_id] and r.n_shingles == len(sets[r.doc_id]) and r.kept == (want[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    first = minhash.keep_first(d, 5)
    want, _ = near_components(rows, 5)
    assert first.columns == d.columns and sorted(r.doc_id for r in first.collect() if r.doc_id is not None) == sorted({v for v in want.values()})


def test_texts_under_one_id_are_linked_each_by_its_own_set(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    row = lambda i, t: (i, t, "en", "s", 0, "h", 1, "w")
    rows = [row(7, one), row(7, two), row(7, two), row(9, one + " more"), row(5, two + " more"), row(8, "a lone text of its own and no other")]
    got = sorted((r.doc_id, r.text) for r in minhash.keep_first(docs(spark, rows)).collect())
    assert got == [(5, two + " more"), (7, one), (8, "a lone text of its own and no other")]
    found = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert found == {(7, 7), (7, 5), (9, 7), (5, 5), (8, 8)}


def test_rings_of_near_copies_and_a_shared_passage(spark, monkeypatch):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    base = [word() for _ in range(200)]
    rows = []
    for i in range(60):  # edits pile up, so only neighbours in the chain are near
        base[int(rng.integers(200))] = word()
        base[int(rng.integers(200))] = word()
        rows.append((i, " ".join(base), "en", "s", 0, "h", 1, "w"))
    passage = [word() for _ in range(60)]
    rows += [(100 + i, " ".join(passage + [word() for _ in range(25)]), "en", "s", 0, "h", 1, "w") for i in range(60)]
    want, _ = near_components([(r[0], r[1]) for r in rows], 5)
    for few in (True, False):  # pairs at once, or the prefix filter
        monkeypatch.setattr(minhash, "_few", lambda left, few=few: few)
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows), 5).collect()}
        assert got == want


def test_sketches_estimate_similarity_and_fill():
    rng = np.random.default_rng(0)
    whole = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for n, shared in ((1, 1), (50, 40), (800, 640), (2000, 1900)):
        a, b = whole[:n], np.concatenate((whole[:shared], whole[n : 2 * n - shared]))
        s = minhash.sketch(np.concatenate((np.sort(a), np.sort(b))), np.array([0, n, 2 * n]))
        assert (s != np.uint64(2**64 - 1)).all()
        true = shared / (2 * n - shared)
        assert abs((s[0] == s[1]).mean() - true) <= 4 * (true * (1 - true) / minhash.BINS) ** 0.5 + 1e-9


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def dropped(spark, rows, **options):
    return [(r.doc_id, r.text) for r in linejoin.drop_lines(docs(spark, rows), **options).collect()]


def test_line_join_equals_brute_force(spark):
    d = docs(spark)
    rows = sorted({(r.doc_id, r.text) for r in d.collect()}, key=repr)
    want = removed_lines(rows)
    assert sum(map(len, want.values())) >= 5
    out = linejoin.drop_lines(d)
    assert out.columns == d.columns and out.count() == d.count()
    for r in out.collect():
        source = next(t for i, t in rows if i == r.doc_id)
        assert r.text == (source and "\n".join(x for k, x in enumerate(source.split("\n")) if k not in want[r.doc_id]))
        assert r.n_chars == (None if source is None else len(r.text))
    assert linejoin.drop_lines(docs(spark, [])).count() == 0


def test_unique_lines_stay_under_repeated_and_null_ids(spark):
    common = "alpha beta gamma delta eps zeta"
    texts = [(1, common), (None, "unique one two three four five"), (None, common), (7, "seven unique words here right now"), (7, common), (None, "null text of its own\n" + common), (2**63 - 1, "the largest id of all")]
    got = dropped(spark, [(i, t, "en", "s", 0, "h", 1, "w") for i, t in texts])
    want = [(1, common), (None, "unique one two three four five"), (None, ""), (7, "seven unique words here right now"), (7, ""), (None, "null text of its own"), (2**63 - 1, "the largest id of all")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    # the same row twice is one document
    twice = [(5, f"first line of all\n{common}\n{common}", "en", "s", 0, "h", 1, "w")] * 2
    assert dropped(spark, twice) == [(5, f"first line of all\n{common}")] * 2
    assert dropped(spark, [(i, f"{common}\nfew words {i}", "en", "s", 0, "h", 1, "w") for i in (1, 2)], least_words=5) == [(1, f"{common}\nfew words 1")]


def test_line_join_with_large_groups_and_chains(spark, monkeypatch):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    start = ["first", "second", "third", "fourth", "fifth"]
    rows, line = [], start + [word() for _ in range(25)]
    common = [word() for _ in range(9)]
    for i in range(80):
        line[int(rng.integers(5, 30))] = word()
        short = [common[k] for k in rng.permutation(9)[: int(rng.integers(4, 8))]]
        rows.append((i, " ".join(line) + "\n" + " ".join(start + [word() for _ in range(12)]) + "\n" + " ".join(short), "en", "s", 0, "h", 1, "w"))
    want = removed_lines([(r[0], r[1]) for r in rows])
    shown = lambda r: "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in want[r[0]])
    for hot, first in ((4096, 8), (10, 1), (0, 2)):
        monkeypatch.setattr(linejoin, "HOT_LINES", hot)
        monkeypatch.setattr(linejoin, "FIRST", first)
        assert sorted(dropped(spark, rows)) == sorted((r[0], shown(r)) for r in rows)


def test_a_failed_first_candidate_does_not_hide_a_later_one():
    # maps that collide: every earlier row is a candidate, and rounds hand over each one once
    n = 40
    c = {"word": np.zeros(n, np.int32), "digest": np.arange(n), "a": np.zeros(n, np.int64), "b": np.zeros(n, np.int64), "n": np.full(n, 9, np.int32), "p": np.zeros(n, np.int32), "doc": np.arange(n), "tie": np.zeros(n, np.int64), "active": np.ones(n, bool)}
    met = []
    for low, high in ((0, 8), (8, 64)):
        u, v, more = linejoin._earliest(linejoin._groups(c), low, high, 80)
        met += list(zip(u.tolist(), v.tolist(), strict=True))
    assert sorted(met) == [(a, b) for a in range(n) for b in range(a + 1, n)] and not len(more)
    assert set(linejoin._earliest(linejoin._groups(c), 0, 8, 80)[2].tolist()) == set(range(9, n))
    # one of the earlier rows is far: it is passed over
    c["a"][3] = -1
    u, v, more = linejoin._earliest(linejoin._groups(c), 0, 8, 80)
    assert sorted(zip(u.tolist(), v.tolist(), strict=True)) == sorted((a, b) for b in range(n) for a in [a for a in range(b) if 3 not in (a, b)][:8])


def test_any_column_names(spark):
    rows = [(i, "some words that many documents share\n" + " ".join(f"w{i}x{k}" for k in range(60)), "src") for i in range(4)]
    names = ["_k1", "k1", "_removed", "__removed", "__id", "d1", "hits", "_K2", "wanted", "at", "a.b", "_null", "_host", "_t1", "id", "n", "c0", "rid", "component", "__digest", "__d", "lines"]
    d = spark.createDataFrame([(*r, *[7] * len(names)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in names))
    for out in (linejoin.drop_lines(d), minhash.keep_first(d), quality.clean(d)):
        assert out.columns == d.columns
        found = out.collect()
        assert len(found) == 4 and {x for r in found for x in r[3:]} == {7}


def test_queries_on_the_small_tables(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want, _ = near_components(rows, 4)
    assert {r.doc_id: r.component_id for r in registry.QUERIES["op9_minhash"](spark, sf).collect()} == want
    gone = removed_lines(rows)
    assert {r.doc_id: r.n_removed for r in registry.QUERIES["op10_line_join"](spark, sf).collect()} == {k: len(v) for k, v in gone.items()}
    for r in registry.QUERIES["op3_quality_rules"](spark, sf).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(dict(rows)[r.doc_id])


def test_pipeline_line_dedup_compares_words(spark):
    import corpus_pipeline

    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    common, rows = [word() for _ in range(12)], []
    for i in range(60):
        line = [word() for _ in range(12)]
        changed, turned = [*line[:6], word(), *line[7:]], line[::-1]
        rows.append((i, "\n".join(" ".join(x) for x in (line, changed, turned, [*rng.permutation(common)[:10], word()], [word() for _ in range(60)])), "en", "s", 0, "h", 1, "w"))
    want = removed_lines([(r[0], r[1]) for r in rows])
    assert all({1, 2} <= set(v) for v in want.values())  # one inner word of 12 changed; another order
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs(spark, rows), "").collect()}
    assert got == {r[0]: "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in want[r[0]]) for r in rows}


def test_pipeline_boilerplate_limit_is_the_same_at_every_size(spark):
    import corpus_pipeline

    letters = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))  # noqa: E731  (digits are one in a line's normal form)
    own = lambda i: " ".join(f"own{letters(i)}x{letters(k)}" for k in range(60))
    row = lambda i, text, host: (i, text, "en", host, 0, "h", 1, "w")
    rows = [row(i, f"a line of the small host\n{own(i)}" if i < 30 else own(i), "small") for i in range(200)]
    rows += [row(i, f"a line of the hot host\n{own(i)}" if i < 1110 else own(i), "hot") for i in range(1000, 3500)]
    rows += [row(i, f"a line of few\n{own(i)}", "few") for i in range(4000, 4010)]
    kept = {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, docs(spark, rows), "").collect()}
    assert all(kept[i] == own(i) for i in (*range(200), *range(1000, 3500)))
    assert all(kept[i] == f"a line of few\n{own(i)}" for i in range(4000, 4010))


def test_limits_act_on_the_shipped_tables(spark):
    got = registry.QUERIES["op3_quality_rules"](spark, "/root/testdata/sf0.01")
    assert got.filter("boilerplate_words > 0").count() >= 10
    assert got.filter("NOT base_failed AND NOT kept").count() == 0  # no clean document of these is depleted


def test_a_posting_is_a_few_bytes_and_comes_back_whole():
    """41 bytes a posting where ids and sizes are usual; any id, place or size comes back as it was."""
    big = {"n": 1 << 20, "p": 300, "doc": (1 << 63) - 1, "line": 70_000}
    usual = {"word": [-5, 7, 8], "digest": [-1, 2, 1 << 62], "a": [-1, 0, 3], "b": [4, -9, 1], "n": [3, 411, 65_535], "p": [0, 255, 9], "doc": [0, 5, 2**32 - 1], "hash": [-(2**31), 2**31 - 1, 0], "line": [0, 65_535, 2]}
    for changed in (None, *big):
        c = {k: np.array(v, np.int64) for k, v in usual.items()}
        if changed:
            c[changed][1] = big[changed]
        wide, packed = linejoin._pack(c, np.array([0, 1, 3]))
        assert wide == bool(changed) and len(packed) == 2
        if not wide:
            assert len(packed[1].as_py()) == 2 * 41
        found = [linejoin._unpack(np.frombuffer(x.as_py(), np.uint8), wide) for x in packed]
        found = {k: np.concatenate([f[k] for f in found]) for k in linejoin._COLUMNS}
        assert all((found[k] == c[k]).all() for k in linejoin._COLUMNS[:-1])
        assert (found["tie"] == (c["hash"] << 32 | c["line"])).all()

def test_words_of_lines_come_from_the_bytes():
    """The same words, lines and rows as split and tokenised texts have, whatever the bytes."""
    rng = random.Random(3)
    parts = [" ", "\n", "\t", "\x0b", "\x0c", "\r", "a", "B", "é", "漢", "\x00", "\x1f", "\x85", "\xa0", "Z", "z", "x" * 70, "K" * 70, "q" * 70_000]
    for k in range(60):
        column = pa.array(["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 20]))) for _ in range(rng.choice([0, 1, 3, 8]))], pa.string())
        column = column.slice(1) if k % 2 and len(column) else column
        hashed, line, at = tx.line_words(column, 51)
        lines, places = tx.split_lines(column)
        words = tx.tokenise(lines, lower=True)
        assert (at == places).all() and (line == tx.row_of(words.offsets)).all()
        names = [words.words[int(c)].as_py() for c in words.codes]
        assert len(set(names)) == len(set(hashed.tolist())) == len(set(zip(names, hashed.tolist(), strict=True)))


def test_an_equal_line_is_settled_in_its_chunk():
    """Copies of a line leave one holder a chunk, the others go there and then; lines of equal rows are the same lines."""
    texts = ["one two three four", "other words stand here\none two three four", "one two three four", "ONE two three\tfour one"]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 7, 9]), pa.array([1, 2, 1, 3]), pa.array([5, 6, 5, 4]), pa.array(texts)], names=["doc", "k1", "k2", "text"])

    class Shared:
        value = np.ones(1 << linejoin.BITS, np.int32)

    out = pa.Table.from_batches(list(linejoin._postings(Shared, 4, 3, 80, 4096)(iter([batch])))).to_pylist()
    holders = np.concatenate([np.frombuffer(r["packed"], linejoin._HOLDER) for r in out if r["kind"] == 2])
    assert sorted((r["doc"], r["line"]) for r in holders) == [(7, 0), (8, 0)]
    gone = np.concatenate([np.frombuffer(r["packed"], linejoin._GONE) for r in out if r["kind"] == 3])
    assert sorted((r["k1"], r["k2"], r["line"]) for r in gone) == [(2, 6, 1), (3, 4, 0)]
    # two chunks meet: the later holder of each class goes
    twice = [r | {"bucket": 0} for r in out if r["kind"] == 2] + [{"bucket": 0, "kind": 2, "packed": np.array([(*h.tolist()[:2], 11, 12, 13, 14) for h in holders], linejoin._HOLDER).tobytes()}]
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("packed", pa.binary())])
    met = pa.Table.from_batches(list(linejoin._meet(0, 8, 80)(iter(pa.Table.from_pylist(twice, schema).combine_chunks().to_batches())))).to_pylist()
    assert [(r["kind"], r["k1"], r["k2"], r["line"]) for r in met] == [(2, 12, 13, 14)] * 2


def test_orders_settle_equal_keys():
    rng = np.random.default_rng(5)
    key, a, b = (rng.integers(0, 6, 500) for _ in range(3))
    got = linejoin._settled(key.astype(np.uint64), a, b)
    want = np.lexsort((b, a, key))
    assert all((x[got] == x[want]).all() for x in (key, a, b))
    line, token = np.sort(key), rng.integers(0, 4, 500).astype(np.uint64)
    for most in (1, 5, 1 << 31, 1 << 60):
        number = rng.integers(0, most, 500)
        got, want = linejoin._by_line(line, number, token), np.lexsort((token, number, line))
        assert all((x[got] == x[want]).all() for x in (line, number, token))


def test_line_join_reads_no_table_of_classes(spark, monkeypatch):
    """Every line once more as a row of tables was half of the time: pairs carry the places of their classes instead."""
    names, write = [], linejoin.write_table
    monkeypatch.setattr(linejoin, "write_table", lambda df, name: names.append((name, df.columns)) or write(df, name))
    texts = [(1, "a b c d e\nx y z"), (2, "a b c d e\na b c d f g h i j k"), (3, "a b c d f g h i j k l\nx y Z"), (3, "a b c d f g h i j k l\nx y Z"), (None, "X y z"), (4, None)]
    _, removed = linejoin.removed_lines(docs(spark, [(i, t, "en", "s", 0, "h", 1, "w") for i, t in texts]))
    assert sorted(r.removed for r in removed.collect()) == [[0], [0], [0, 1]]
    assert "classes" not in [n for n, _ in names] and "lines" not in dict(names)["lines"]
