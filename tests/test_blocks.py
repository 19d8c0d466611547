import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import blocks, kernels
from quillon.shared import materialise

FS = 128.0
SCHEMA = "rec string, channel string, start long, samples array<double>"


def pieces(name, x, channels, rng):
    """Rows of uneven length, in no order."""
    rows = []
    for c, v in zip(channels, x, strict=True):
        cuts = np.unique(np.concatenate(([0, len(v)], rng.integers(1, len(v), 7))))
        rows += [(name, c, int(a), v[a:b].tolist()) for a, b in zip(cuts, cuts[1:], strict=False)]
    return rows


def gathered(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.start):
        v = out.setdefault((r.rec, r.channel), [])
        assert r.start == len(v)
        v += r.samples
    return {k: np.array(v) for k, v in out.items()}


@pytest.mark.parametrize("size", [64, 1000, 100_000])
def test_filter_by_blocks_equals_the_whole_signal(spark, size):
    rng = np.random.default_rng(0)
    signals = {"a": rng.normal(0, 1, (2, 5000)), "b": rng.normal(0, 1, (2, 999)), "short": rng.normal(0, 1, (2, 40))}
    rows = [r for n, x in signals.items() for r in pieces(n, x, ["O1", "O2"], rng)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = gathered(blocks.band_pass(df, FS, size, "rec"))
    for n, x in signals.items():
        want = kernels.band_pass(x, FS)
        for i, c in enumerate(("O1", "O2")):
            assert np.abs(got[n, c] - want[i]).max() < 1e-12


def test_blocks_spread_over_tasks_and_stay_small(spark):
    rows = spark.createDataFrame([("long", "O1", k * 6400, np.sin(np.arange(6400) + k).tolist()) for k in range(60)], SCHEMA)
    e = materialise(blocks.extended(rows, 1000, 200, "rec"), "e")
    sizes = [len(r.samples) for r in e.collect()]
    assert len(sizes) == 384 and max(sizes) == 1400 and sum(sizes) == 384_000 + 2 * 383 * 200
    with pytest.raises(Exception, match="gap or an overlap"):
        blocks.extended(rows.filter("start <> 6400"), 10_000, 10, "rec").collect()
    assert blocks.extended(rows.limit(0), 10, 5, "rec").count() == 0


def mixed(n, seed):
    rng = np.random.default_rng(seed)
    t = np.arange(n) / FS
    blink = (np.sin(2 * np.pi * 0.3 * t) > 0.95) * 8.0
    sources = np.stack([np.sign(np.sin(2 * np.pi * 3 * t)), ((t * 5) % 1) - 0.5, rng.laplace(0, 1, n) * np.sqrt(np.arange(n) % 50 + 1), blink + rng.normal(0, 0.1, n)])
    mixing = rng.normal(0, 1, (4, 4)) + 2 * np.eye(4)
    return sources, mixing @ sources + 3.0


def test_components_from_sums(spark):
    channels = ["Fp1", "C3", "O1", "O2"]
    rng = np.random.default_rng(1)
    data = {"x": mixed(4000, 1), "y": mixed(2500, 2)}
    rows = materialise(spark.createDataFrame([r for n, (_, x) in data.items() for r in pieces(n, x, channels, rng)], SCHEMA), "rows")
    even = blocks.map_blocks(rows, lambda v: v, 512, 0, "rec")
    m = materialise(blocks.matrices(even, channels, "rec"), "m")
    fitted = materialise(blocks.ica(m, 4, "rec", tolerance=1e-7), "fit")
    scores = {r.rec: r for r in blocks.detectors(rows, fitted, channels, ["Fp1"], FS, 700, "rec").collect()}
    bad = spark.createDataFrame([("x", [1, 2])], "rec string, bad array<int>")
    cleaned = gathered(blocks.remove(m, fitted, bad, channels, "rec"))
    for r in fitted.collect():
        s, x = data[r.rec]
        w, a = np.array(r.unmixing).reshape(4, 4), np.array(r.mixing).reshape(4, 4)
        want_w, want_a = kernels.ica(x, tolerance=1e-7)
        assert np.abs(w - want_w).max() < 1e-6 and np.abs(a - want_a).max() < 1e-6
        assert np.abs(np.corrcoef(w @ x, s)[:4, 4:]).max(axis=0).min() > 0.97
        y = w @ x
        assert np.allclose(scores[r.rec].eog, kernels.eog_scores(y, x[:1]), atol=1e-9)
        assert np.allclose(scores[r.rec].muscle, kernels.muscle_scores(y, FS), atol=1e-9)
        want = kernels.remove_components(x, w, a, [1, 2] if r.rec == "x" else [])
        assert all(np.abs(cleaned[r.rec, c] - want[i]).max() < 1e-9 for i, c in enumerate(channels))


def test_missing_channels_raise(spark):
    rows = spark.createDataFrame([("a", "O1", 0, [1.0, 2.0]), ("a", "O2", 0, [1.0])], SCHEMA)
    with pytest.raises(Exception, match="channels differ"):
        blocks.matrices(rows, ["O1", "O2"], "rec").collect()


def test_whole_recordings_by_blocks(spark):
    from test_recordings import raw

    from quillon.operators import recordings
    from quillon.schemas import CHANNELS

    rng = np.random.default_rng(0)
    given = raw("/closed_first", rng, 4.0) + raw("/closed_last", rng, 0.25) + raw("/same", rng, 1.0)
    df = spark.createDataFrame([(p, c, fs, x) for p, c, fs, x in given], "path string, channel string, sfreq double, signal array<double>")
    fractions = spark.createDataFrame([("/closed_first", 0.45), ("/same", 0.01)], "path string, boundary_frac double")
    few = recordings.Settings(ica_steps=4, muscle=0.3, eog=0.3, focality=1.2)
    want_all = materialise(recordings.prepare(df, fractions, few), "want")
    want = {r.path: r for r in recordings.statuses(want_all).collect()}
    cut = df.select("path", "channel", F.lit(0).cast("long").alias("start"), F.col("signal").alias("samples"))
    statuses, epochs = blocks.prepare(blocks.map_blocks(cut, lambda v: v, 3000, 0, "path"), CHANNELS, 250.0, "path", size=4096, boundaries=fractions, settings=few)
    got = {r.path: r for r in statuses.collect()}
    assert set(got) == set(want)
    for p, r in got.items():
        w = want[p]
        assert abs(r.alpha_ratio - w.alpha_ratio) < 1e-6
        for c in ("status", "split_rule", "boundary_frac", "n_excluded", "n_muscle", "capped", "n_events", "n_kept", "n_ec", "n_eo", "rej_ec", "rej_eo"):
            assert getattr(r, c) == getattr(w, c), (p, c)
    key = lambda r: (r.path, r.condition, r.epoch, r.channel)
    mine = {key(r): r.samples for r in epochs.collect()}
    theirs = {key(r): r.samples for r in recordings.epochs(want_all).collect()}
    assert set(mine) == set(theirs) and max(np.abs(np.subtract(mine[k], theirs[k])).max() for k in mine) < 1e-9
