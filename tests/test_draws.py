import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import boundary, draws, resample
from quillon.shared import materialise


@pytest.fixture(scope="module")
def arm(spark):
    rng = np.random.default_rng(5)
    truth = rng.integers(0, 2, 180)
    score = np.round(rng.normal(0, 1, 180) + 0.35 * truth, 1)  # with ties
    rows = [("x", i * 7919 + 3, int(t), float(s)) for i, (t, s) in enumerate(zip(truth, score, strict=True))] + [("y", i, 1, 0.5) for i in range(3)]
    return materialise(spark.createDataFrame(rows, "arm string, unit long, truth int, p double").repartition(6), "arm"), truth, score


def test_hashes_are_uniform_and_counts_poisson():
    unit, draw = np.arange(2000)[:, None] * 31, np.arange(500)[None, :]
    x = draws.mix(unit, draw, 42)
    assert np.abs(np.histogram(x, 20, (0, 2**31))[0] / x.size - 0.05).max() < 0.002
    w = draws.counts(unit, draw, 42)
    assert abs(w.mean() - 1) < 0.005 and abs(w.var() - 1) < 0.02
    assert np.abs(np.corrcoef(w[:200])[np.triu_indices(200, 1)]).mean() < 0.05 and np.abs(np.corrcoef(w.T[:200])[np.triu_indices(200, 1)]).mean() < 0.05
    k = draws.keys(unit, draw, 42)
    assert all(len(set(c)) == len(c) for c in k.T[:50])


def test_the_column_hash_is_the_same(spark):
    rows = spark.range(0, 10**12, 10**10 + 7).withColumn("d", (F.col("id") % 991).cast("long"))
    for r in rows.select("id", "d", draws.mix_column(F.col("id"), F.col("d"), 9).alias("m"), draws.key_column(F.col("id"), F.col("d"), 9).alias("k")).collect():
        assert r.m == draws.mix(np.int64(r.id), np.int64(r.d), 9) and r.k == draws.keys(np.int64(r.id), np.int64(r.d), 9)


@pytest.mark.parametrize("size", [20_000, 30])
def test_each_draw_is_the_auc_of_its_counts(arm, monkeypatch, size):
    monkeypatch.setattr(draws, "RANGE_ROWS", size)
    rows, truth, score = arm
    unit = np.arange(180) * 7919 + 3
    got = {(r.arm, r.draw): r.auc for r in draws.bootstrap_aucs(rows, "truth", "p", "unit", ["arm"], 40).collect()}
    w = draws.counts(unit[:, None], np.arange(40)[None, :], 42).astype(int)
    for b in range(40):
        at = np.repeat(np.arange(180), w[:, b])
        assert got["x", b] == pytest.approx(resample.auc(truth[at], score[at]), abs=1e-12) and got["y", b] is None
    null = {(r.arm, r.draw): r.auc for r in draws.permuted_aucs(rows, "truth", "p", "unit", ["arm"], 40).collect()}
    k = draws.keys(unit[:, None], np.arange(40)[None, :], 42)
    for b in range(40):
        label = (np.argsort(np.argsort(k[:, b])) < truth.sum()).astype(int)
        assert null["x", b] == pytest.approx(resample.auc(label, score), abs=1e-12)


def test_pooled_agrees_with_the_generator(arm):
    rows, truth, score = arm
    want = resample.pooled(truth, score, bootstraps=4000, permutations=4000)
    got = {r.arm: r for r in draws.pooled(rows, "truth", "p", "unit", ["arm"], 4000, 4000).collect()}["x"]
    assert got.n == 180 and got.auc == pytest.approx(want["auc"], abs=1e-12)
    assert abs(got.ci_low - want["ci_low"]) < 0.012 and abs(got.ci_high - want["ci_high"]) < 0.012
    assert abs(got.p - want["p"]) < 4 * np.sqrt(max(want["p"], 1e-3) / 4000) + 1e-3


def test_units_are_drawn_and_permuted_whole(spark):
    rng = np.random.default_rng(2)
    rows = [("x", u, u * 4 + j, int(j < 1 + u % 3), float(np.round(rng.normal() + 0.4 * (j < 1 + u % 3), 1))) for u in range(50) for j in range(4)]
    df = spark.createDataFrame(rows, "arm string, unit long, row long, truth int, p double")
    truth, score, unit, row = (np.array([r[i] for r in rows]) for i in (3, 4, 1, 2))
    got = {r.draw: r.auc for r in draws.bootstrap_aucs(df, "truth", "p", "unit", ["arm"], 20).collect()}
    w = draws.counts(unit[:, None], np.arange(20)[None, :], 42).astype(int)
    null = {r.draw: r.auc for r in draws.within_aucs(df, "truth", "p", "unit", "row", ["arm"], 20).collect()}
    k = draws.keys(row[:, None], np.arange(20)[None, :], 42)
    for b in range(20):
        at = np.repeat(np.arange(200), w[:, b])
        assert got[b] == pytest.approx(resample.auc(truth[at], score[at]), abs=1e-12)
        label = np.zeros(200, int)
        for u in range(50):
            mine = np.flatnonzero(unit == u)
            label[mine[np.argsort(k[mine, b])[: truth[mine].sum()]]] = 1
        assert null[b] == pytest.approx(resample.auc(label, score), abs=1e-12)


def test_one_key_may_hold_the_rows_and_one_score_most_of_them(spark, monkeypatch):
    monkeypatch.setattr(draws, "RANGE_ROWS", 50)
    rows = [("x", i, i % 2, 0.5 if i % 5 else i / 900) for i in range(900)]
    df = spark.createDataFrame(rows, "arm string, unit long, truth int, p double")
    truth, score = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    w = draws.counts(np.arange(900)[:, None], np.arange(10)[None, :], 42).astype(int)
    for r in draws.bootstrap_aucs(df, "truth", "p", "unit", ["arm"], 10).collect():
        at = np.repeat(np.arange(900), w[:, r.draw])
        assert r.auc == pytest.approx(resample.auc(truth[at], score[at]), abs=1e-12)


def test_split_scores_of_shuffled_profiles(spark):
    rng = np.random.default_rng(3)
    x = np.round(np.concatenate((rng.gamma(4, 1, 25), rng.gamma(4, 2, 35))), 3)
    df = spark.createDataFrame([(1, i, 100 + i, float(v)) for i, v in enumerate(x)], "user long, i long, unit long, value double")
    got = {r.draw: r.score for r in boundary.shuffled_scores(df, "value", "unit", "user", draws=30).collect()}
    k = draws.keys(np.arange(100, 160)[:, None], np.arange(30)[None, :], 42)
    for b in range(30):
        assert got[b] == pytest.approx(resample.split_score(x[np.argsort(k[:, b])])[1], abs=1e-8)
    half = df.select("user", F.when(F.col("i") % 2 == 0, "a").otherwise("b").alias("half"), F.floor(F.col("i") / 2).alias("i"), "value")
    row = boundary.analyse(df, half, "value", "i", "unit", "user").first()
    assert row.perm_p < 0.05 and row.passes_perm and abs(row.fraction - 25 / 60) < 0.1
    assert row.a_frac == pytest.approx(resample.split_score(x[::2])[0] / 30) and row.gain >= 1 - 1e-9
    alone = boundary.analyse(df, half.filter("half = 'a'"), "value", "i", "unit", "user").first()
    assert alone.split_half_diff is None and not alone.trusted


def test_orders_of_profiles_are_not_shuffled_and_long_ones_agree(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(u, i, u * 1000 + i, None if i == 7 else float(np.round(rng.gamma(3, 1), 3))) for u in range(30) for i in range(1 if u == 3 else 15 + u)]
    df = materialise(spark.createDataFrame(rows, "user long, i long, unit long, value double"), "profiles")
    null = boundary.shuffled_scores(df, "value", "unit", "user", draws=50)
    short = sorted((r.user, r.draw, r.score) for r in null.collect())
    half = df.select("user", F.when(F.col("i") % 2 == 0, "a").otherwise("b").alias("half"), F.floor(F.col("i") / 2).alias("i"), "value")
    whole = [tuple(r) for r in boundary.analyse(df, half, "value", "i", "unit", "user", draws=50).orderBy("user").collect()]
    monkeypatch.setattr(boundary, "PROFILE_ROWS", 25)
    # a cell of 40 rows holds one order of a longer profile
    monkeypatch.setattr(boundary, "CELLS", 40)
    assert sorted((r.user, r.draw, r.score) for r in boundary.shuffled_scores(df, "value", "unit", "user", draws=50).collect()) == short
    assert [tuple(r) for r in boundary.analyse(df, half, "value", "i", "unit", "user", draws=50).orderBy("user").collect()] == whole


def test_thresholds_travel_once_a_range(spark, monkeypatch):
    rows = materialise(spark.createDataFrame([("x", i, i % 2, (i * 31 % 97) / 97) for i in range(3000)], "arm string, unit long, truth int, p double"), "arms")
    seen = {}
    dealt = draws.draw_aucs

    def taken(given, *a, **k):
        seen["columns"] = given.columns
        return dealt(given, *a, **k)

    monkeypatch.setattr(draws, "draw_aucs", taken)
    monkeypatch.setattr(draws, "RANGE_ROWS", 500)
    got = {r.draw: r.auc for r in draws.permuted_aucs(rows, "truth", "p", "unit", ["arm"], 20).collect()}
    assert "thresholds" not in seen["columns"]
    k = draws.keys(np.arange(3000)[:, None], np.arange(20)[None, :], 42)
    score = np.array([(i * 31 % 97) / 97 for i in range(3000)])
    for b in range(20):
        assert got[b] == pytest.approx(resample.auc((np.argsort(np.argsort(k[:, b])) < 1500).astype(int), score), abs=1e-12)
