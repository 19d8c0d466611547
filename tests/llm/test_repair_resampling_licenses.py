import duckdb
import numpy as np
import pytest
from cases import CONVERSATIONS, DOCS, conversations, docs, importance, repaired_digests
from oracle import rows as plain_rows
from pyspark.sql import functions as F

from quillon.llm import importance as imp
from quillon.llm import licenses, repair
from quillon.llm.oracles import OP11_SQL, OP12_SQL
from quillon.llm.tables import write_table


@pytest.fixture(scope="module")
def talks(spark):
    return write_table(spark.createDataFrame(conversations(), CONVERSATIONS).repartition(3), "talks")


def duck(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(f"{name}_", df.toArrow())
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_")
    found = con.execute(sql)
    return plain_rows([c[0] for c in found.description], found.fetchall())


# --- op11 -------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [repair.RUN, 5])
def test_repair_equals_a_plain_search(talks, size):
    got = {r.conv_id: tuple(r)[1:] for r in repair.digests(talks, size).collect()}
    assert got == repaired_digests(conversations())


def test_repair_equals_sql(talks):
    got = repair.digests(talks)
    assert plain_rows(got.columns, got.collect()) == duck(OP11_SQL, conversations=talks.filter("conv_id IS NULL OR conv_id <> 99").select("conv_id", "turn", "role", "text").unionByName(talks.filter("conv_id = 99").select("conv_id", "turn", "role", "text")))


def test_repaired_rows_alternate(talks):
    found = repair.repair(talks, 7).orderBy("position").collect()
    by = {}
    for r in found:
        by.setdefault(r.conv_id, []).append(r)
    assert len(by) > 30
    for rows in by.values():
        first = "".join(r.role[0] for r in rows)
        assert first.removeprefix("s") == "ua" * (len(first) // 2) and len({r.position for r in rows}) == len(rows)
        assert all(r.text == "" for r in rows if r.edit == "I")


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], CONVERSATIONS)
    assert repair.digests(none).count() == repair.repair(none).count() == 0
    # a row whose key drops it leaves a conversation without rows
    gone = next(k for k in range(1000) if not repaired_digests([(k, 0, "user", "a.")])[k][6])
    row = repair.digests(spark.createDataFrame([(gone, 0, "user", "a.")], "conv_id long, turn long, role string, text string")).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")


def test_ranked_paths_are_least():
    r = np.random.default_rng(3)
    codes = r.integers(0, 12, (50, 9))
    codes[:10, :4] = repair._PAD
    behind = np.tile(repair._END, (50, 1))
    letters, *_ = repair.least_paths(codes, behind, np.ones(50, bool), [0])
    cost = (repair.run_matrices(codes) + behind[:, None, :]).min(-1)[:, 0]

    def every(code, state, budget):
        """All audits of a cost."""
        if budget < 0:
            return []
        out = [""] if not len(code) and state in (0, 3) and budget == 0 else []
        out += ["I" + x for x in every(code, repair._NEXT[state], budget - 3)]
        if len(code):
            for k in (0, 2, 3):
                c = repair._COST[code[0], state, k]
                if c <= budget:
                    out += ["DIKR"[k] + x for x in every(code[1:], repair._TO[code[0], state, k], budget - c)]
        return out

    for i in range(0, 20, 2):
        c = codes[i][codes[i] != repair._PAD][-4:]
        one = np.full((1, 9), repair._PAD)
        one[0, -len(c) :] = c
        total = int((repair.run_matrices(one) + behind[:1, None, :]).min(-1)[0, 0])
        spelled = "".join("_DIKR"[k] for k in repair.least_paths(one, behind[:1], np.ones(1, bool), [0])[0][0, 0] if k)
        assert spelled == min(every(c, 0, total))
    assert letters.shape[0] == 50 and (cost >= 0).all()


# --- op12 -------------------------------------------------------------------------------------


def test_weights_scores_and_ranks(spark):
    d = docs(spark)
    target = spark.createDataFrame([(0, "abc def one two words"), (1, None), (2, "changed shared " * 9)], "item_id long, text string")
    want = importance([(r.doc_id, r.text) for r in d.collect()], [r.text for r in target.collect()])
    got = imp.resample(d, target).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert sum(r[4] is not None for r in want) >= 5
    assert plain_rows(got.columns, got.collect()) == duck(OP12_SQL, documents=d.select("doc_id", "text"), benchmark=target)


def test_many_rows_under_one_id(spark):
    rows = [(None, "word " * 30)] * 40 + [(1, " ".join(f"w{k}" for k in range(25)))] * 40 + [(k, f"x{k} " * 21) for k in range(2, 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([("w1 w2",)], "text string")
    got = imp.resample(d, target).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == importance(rows, ["w1 w2"])


def test_long_and_odd_words_are_hashed_whole(spark):
    texts = ["é" * 60 + " b " + "z" * 500 + " c", "\x00a\x7fb", "A-Z" * 3, "ß ŉ İ"]
    rows = [(i, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = imp.resample(d, d).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == importance(rows, texts)


@pytest.mark.parametrize("pivots", [1, 3, 63])
def test_selection_finds_every_place(spark, pivots):
    scored = spark.createDataFrame([(i % 9 or None, "t", 30, 1, 0, i % 4, i) for i in range(60)], "doc_id long, tie string, n_words long, n_features long, weight long, score long, rid long")
    keyed = write_table(scored.select(imp._composite().alias("key")), "keyed")
    want = sorted(tuple(r.key) for r in keyed.collect())
    for k in (1, 2, 17, 59, 60):
        assert imp.kth_key(keyed, k, pivots) == want[k - 1]
    assert imp.kth_key(keyed, 61, pivots) is None


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert imp.resample(none, none).count() == 0
    few = imp.resample(docs(spark).limit(3), none).collect()
    assert all(r["rank"] is None for r in few)


# --- op13 -------------------------------------------------------------------------------------

MIT = licenses.NOTICES[0].text
BSD = licenses.NOTICES[3].text


def licensed(spark):
    w = MIT.split()
    broken = " ".join([*w[:12], "and", "some", *w[12:]])
    texts = [
        "Released under the MIT License, not the Apache-License. mit license",
        "GNU General Public\nLicense general public licence",
        "MIT license " * 3 + "mit",
        f"one two {broken.upper()} three",
        f"{' '.join(w[:9])} and no more of it",
        f"{BSD}\n{BSD}",
        "Licensed under CC BY-NC 4.0.",
        "mit",
        "Mit" + "é license mit license",
    ]
    return docs(spark).select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(1000 + i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string"))


def test_labels_equal_sql(spark, tmp_path):
    d = licensed(spark)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = licenses.op13_diagonal_voting(spark, str(tmp_path))
    assert plain_rows(got.columns, got.collect()) == duck(licenses.OP13_SQL, documents=d)
    by = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    assert (by[1000].base_labels, by[1000].n_base, by[1000].first_word) == ("apache,mit", 3, 3)
    assert by[1001].base_labels == "gpl" and by[1002].n_base == 3
    assert by[1003].labels == "mit" and by[1003].base_labels == "" and by[1003].score >= 0.9
    assert by[1004].labels == "" and 0 < by[1004].score < 0.7
    assert (by[1005].labels, by[1006].labels, by[1007].labels) == ("bsd", "cc-by-nc", "")
    assert by[0].n_words == 0 and by[0].score == 0


def test_spans_name_their_words(spark):
    spans = {r.doc_id: r.spans for r in licenses.scan(licensed(spark)).collect() if r.doc_id in (1003, 1005)}
    assert [(s.first, s.last) for s in spans[1003] if s.stands] == [(2, 2 + len(MIT.split()) + 1)]
    assert [s.first for s in spans[1005] if s.stands] == [0, len(BSD.split())]


def test_no_python_in_the_scan(spark, sf):
    plan = licenses.op13_diagonal_voting(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_scan_of_nothing(spark):
    assert licenses.scan(spark.createDataFrame([], DOCS)).count() == 0
    assert licenses.scan(docs(spark).select("doc_id", F.lit(None).cast("string").alias("text"))).filter("n_words = 0").count() == docs(spark).count()
