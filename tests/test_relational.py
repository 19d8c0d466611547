"""Relational forms against the versions in memory: coherence, scalp maps, exact ranks."""

import itertools

import numpy as np
import pytest

from quillon.operators import coherence, kernels, resample, scalp

BANDS = {"theta": (4, 8), "alpha": (8, 12), "none": (100, 200)}


def test_coherence_equals_the_kernel(spark):
    rng = np.random.default_rng(0)
    t = np.arange(200) / 64
    rows = []
    for g in range(3):
        a = rng.normal(0, 1, 200)
        chans = {"O1": a, "C3": np.roll(a, 2) + 0.3 * rng.normal(0, 1, 200), "T3": np.sin(2 * np.pi * 10 * t) + rng.normal(0, 1, 200)}
        rows += [(g, c, x.tolist()) for c, x in chans.items()]
    rows += [(9, "O1", [1.0] * 10), (9, "C3", [2.0] * 10)]
    df = spark.createDataFrame(rows, "g long, channel string, samples array<double>").repartition(3)
    key = lambda r: (r.g, r.a, r.b, r.band)
    got = {key(r): r.value for r in coherence.imaginary_coherence(df, 64.0, 32, 16, BANDS, "g").collect()}
    want = {key(r): r.value for r in kernels.coherence_edges(df, 64.0, 32, 16, BANDS, "g").collect() if r.value is not None and r.value == r.value}
    assert set(got) == set(want) and len(got) == 3 * 3 * 2 and max(abs(got[k] - want[k]) for k in got) < 1e-9
    assert coherence.imaginary_coherence(df, 64.0, 32, 16, BANDS, "g", least=50).count() == 0


def test_scalp_maps(spark):
    spots = scalp.positions()
    assert len(spots) == 19 and all(u * u + v * v <= 1 for u, v in spots.values())
    assert np.allclose(spots["Fp1"], (-spots["Fp2"][0], spots["Fp2"][1])) and np.allclose(spots["O1"], (spots["Fp1"][0], -spots["Fp1"][1]))
    rng = np.random.default_rng(1)
    maps = {0: dict(zip(spots, rng.random(19).tolist(), strict=True)), 1: {c: 5.0 for c in spots}, 2: dict(zip(list(spots)[:7], rng.random(7).tolist(), strict=True))}
    rows = [(k, c, v) for k, m in maps.items() for c, v in m.items()] + [(2, "O1", None), (2, "XX", 9.0)]
    got = {(r.k, r.y, r.x): r.level for r in scalp.grid(spark.createDataFrame(rows, "k long, channel string, value double"), 12, "k").collect()}
    for k, m in maps.items():
        lo, hi = min(m.values()), max(m.values())
        for y in range(12):
            for x in range(12):
                u, v = (x + 0.5) / 6 - 1, 1 - (y + 0.5) / 6
                if u * u + v * v > 1:
                    assert (k, y, x) not in got
                    continue
                w = {c: 1 / ((u - spots[c][0]) ** 2 + (v - spots[c][1]) ** 2 + 1e-4) ** 2 for c in m}
                want = (sum(w[c] * m[c] for c in m) / sum(w.values()) - lo) / ((hi - lo) or 1)
                assert got[k, y, x] == pytest.approx(want, abs=1e-9)


def test_exact_rank_sums_by_enumeration(spark):
    rng = np.random.default_rng(2)
    rows = [(k, int(g), float(v)) for k in range(30) for g, v in zip(rng.integers(0, 2, 3 + k % 8), rng.integers(0, 6, 3 + k % 8), strict=True)]
    df = spark.createDataFrame(rows + [(99, 1, 1.0), (99, None, 2.0), (98, 0, None)], "k long, g int, v double")
    got = {r.k: r for r in resample.exact_rank_sums(df, "g", "v", "k").collect()}
    seen = 0
    for k in range(30):
        mine = [(g, v) for i, g, v in rows if i == k]
        n, taken = len(mine), sum(g for g, _ in mine)
        if not 0 < taken < n:
            assert k not in got
            continue
        rank = [sum(w < v for _, w in mine) + (sum(w == v for _, w in mine) + 1) / 2 for _, v in mine]
        observed = sum(r for r, (g, _) in zip(rank, mine, strict=True) if g)
        sums = [sum(c) for c in itertools.combinations(rank, taken)]
        want = min(1, 2 * min(np.mean([s <= observed + 1e-9 for s in sums]), np.mean([s >= observed - 1e-9 for s in sums])))
        assert got[k].p == pytest.approx(want, abs=1e-12) and got[k].u == observed - taken * (taken + 1) / 2
        seen += 1
    assert seen > 20 and 99 not in got and 98 not in got
    few = resample.mann_whitney(spark.createDataFrame([(1, 1.0), (1, 2.0), (0, 3.0), (0, 4.0), (0, 5.0)], "g int, v double"), "g", "v").first()
    assert few.p == pytest.approx(0.2)


def test_exact_signed_ranks_by_enumeration(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(v)) for k in range(20) for v in rng.integers(-4, 5, 2 + k % 9)]
    got = {r.k: r for r in resample.exact_signed_ranks(spark.createDataFrame(rows, "k long, d double"), "d", "k").collect()}
    for k in range(20):
        d = [v for i, v in rows if i == k and v]
        if not d:
            assert k not in got
            continue
        rank = [sum(abs(w) < abs(v) for w in d) + (sum(abs(w) == abs(v) for w in d) + 1) / 2 for v in d]
        observed = sum(r for r, v in zip(rank, d, strict=True) if v > 0)
        sums = [sum(r for r, s in zip(rank, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(d))]
        want = min(1, 2 * min(np.mean([s <= observed + 1e-9 for s in sums]), np.mean([s >= observed - 1e-9 for s in sums])))
        assert got[k].p == pytest.approx(want, abs=1e-12) and got[k].w == observed
    few = resample.wilcoxon(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (-0.5,)], "d double"), "d").first()
    assert few.p == pytest.approx(0.25)
