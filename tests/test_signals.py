import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import features, kernels, models, signals


def tones(fs=500, seconds=30, channels=("F3", "F4", "Fz", "O1", "O2"), amplitudes=((6, 20.0), (10, 10.0), (20, 5.0))):
    t = np.arange(fs * seconds) / fs
    x = sum(a * np.sin(2 * np.pi * f * t) for f, a in amplitudes)
    return [(0, "ec", c, x.tolist()) for c in channels]


SCHEMA = "subject_id long, condition string, channel string, samples array<double>"


def test_welch_of_tones_has_known_band_powers(spark):
    df = spark.createDataFrame(tones(), SCHEMA)
    native = signals.welch(df, 500.0, 500, "subject_id", "condition", "channel").cache()
    power = {(r.channel, r.band): r.power for r in signals.band_powers(native, {"theta": (4, 8), "alpha": (8, 12), "beta": (12, 30)}, "subject_id", "condition", "channel").collect()}
    assert power["F3", "theta"] == pytest.approx(200, rel=1e-3) and power["F3", "alpha"] == pytest.approx(50, rel=1e-3)
    tbr = features.theta_beta_ratio(native, "subject_id", "condition").first().tbr
    assert tbr == pytest.approx(200 / 12.5, rel=1e-2)
    loud = signals.welch(spark.createDataFrame(tones(amplitudes=((6, 2.0), (10, 10.0))), SCHEMA), 500.0, 500, "subject_id", "condition", "channel")
    assert features.peak_frequency(loud, "subject_id", "condition").first().iaf == 10
    fft = signals.welch_arrow(df, 500.0, 500, "channel").first().psd
    same = [r.psd for r in native.filter("channel = 'F3'").orderBy("k").collect()]
    assert np.allclose(fft, same, rtol=1e-9, atol=1e-12)


def test_aperiodic_exponent_ignores_an_alpha_bump(spark):
    f = np.arange(1, 50)
    for bump in (0.0, 5.0):
        psd = f**-1.6 * (1 + bump * np.exp(-((f - 10) ** 2) / 2))
        df = spark.createDataFrame([(0, int(k), float(k), float(p)) for k, p in zip(f, psd, strict=True)], "subject_id long, k int, freq double, psd double")
        assert features.aperiodic(df, "subject_id").first().exponent == pytest.approx(1.6, abs=0.02)


def test_windows_are_whole_and_rejection_names_channels(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 20, (3, 100))
    x[1, 30:35] += 400
    rows = [(0, c, v.tolist()) for c, v in zip("abc", x, strict=True)]
    df = spark.createDataFrame(rows, "subject_id long, channel string, samples array<double>")
    epochs = signals.explode_windows(df, 15, None, "subject_id", "channel")
    assert epochs.count() == 18
    r = signals.reject(epochs, 250.0, 0.1, "subject_id", "window").orderBy("window").collect()
    assert [x.kept for x in r] == [True, True, False, True, True, True] and r[2].culprits == ["b"]
    off = signals.reject(epochs, None, None, "subject_id", "window")
    assert off.filter("kept").count() == 6
    assert signals.explode_windows(df, 101, None, "subject_id").count() == 0


def test_even_strides_round_and_truncate(spark):
    df = spark.range(1).select(signals.even_stride(F.lit(10), 4).alias("a"), signals.even_stride_truncated(F.lit(10), 4).alias("b"), signals.even_stride(F.lit(3), 4).alias("c"), signals.even_stride(F.lit(9), 1).alias("d"))
    r = df.first()
    assert list(r.a) == np.round(np.linspace(0, 9, 4)).astype(int).tolist() and list(r.b) == np.linspace(0, 9, 4, dtype=int).tolist()
    assert list(r.c) == [0, 1, 2] and list(r.d) == [0]


def test_pulse_edges(spark):
    level = [0, 1, 1, 0, 1, 0, 0, 1]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(level)], "r long, i long, v int")
    got = [(r.start, r.duration) for r in signals.edges(df, F.col("v") == 1, "i", "r").orderBy("start").collect()]
    assert got == [(1, 2), (4, 1), (7, 1)]


def test_average_reference_sums_to_zero(spark):
    df = spark.createDataFrame([(0, "a", [1.0, 2.0]), (0, "b", [3.0, 6.0])], "s long, channel string, samples array<double>")
    out = {r.channel: list(r.samples) for r in signals.average_reference(df, "s").collect()}
    assert out == {"a": [-1.0, -2.0], "b": [1.0, 2.0]}


def test_filter_keeps_its_band_without_delay():
    fs, t = 500.0, np.arange(10_000) / 500.0
    inside, outside, hum = np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 90 * t), np.sin(2 * np.pi * 50 * t)
    y = kernels.band_pass(np.stack((inside, outside, hum, np.full(len(t), 3.0))), fs)
    mid = slice(2000, 8000)
    assert np.abs(y[0, mid] - inside[mid]).max() < 0.01
    assert all(np.abs(v[mid]).max() < 0.02 for v in y[1:])


def test_ica_recovers_sources():
    rng = np.random.default_rng(0)
    t = np.arange(4000) / 500
    s = np.stack((np.sign(np.sin(2 * np.pi * 3 * t)), np.sin(2 * np.pi * 7 * t) ** 3, rng.laplace(size=4000)))
    x = rng.normal(size=(3, 3)) @ s
    unmixing, mixing = kernels.ica(x)
    c = np.abs(np.corrcoef(unmixing @ x, s)[:3, 3:])
    assert c.max(axis=1).min() > 0.95 and np.allclose(mixing @ unmixing, np.eye(3), atol=1e-6)


def test_imaginary_coherence_sees_lags_only():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 1100))
    x = np.stack((base[:, :1000], base[:, :1000] + 0.1 * rng.normal(size=(40, 1000)), base[:, 12:1012], rng.normal(size=(40, 1000))), axis=1)
    m = kernels.imaginary_coherence(x, 500.0, {"alpha": (8, 12)})["alpha"]
    assert m[0, 2] > 0.5 and m[0, 1] < 0.05 and m[0, 3] < 0.2 and np.allclose(m, m.T)
    tapers = kernels.dpss(128)
    assert np.allclose(tapers @ tapers.T, np.eye(len(tapers)), atol=1e-9)


def test_scalogram_peaks_at_the_tone_and_encodes():
    freqs = np.linspace(0.5, 50, 40)
    t = np.arange(750) / 500
    power = np.abs(kernels.morlet(np.sin(2 * np.pi * 20 * t), 500.0, freqs))
    assert abs(freqs[power[:, 300:450].mean(axis=1).argmax()] - 20) < 2
    image = kernels.scalogram_rgb(power * 100, freqs)
    assert image.dtype == np.uint8 and image.shape == (40, 750, 3) and kernels.png(image)[:4] == b"\x89PNG"
    assert len(kernels.strip_attention(np.ones((224, 224)))) == 5


def test_covariances_are_definite_and_scale_free():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(192, 19))
    x[:, -1] = x[:, 0]
    assert np.linalg.eigvalsh(models.oas(x)).min() > 0
    cs = np.stack([models.oas(rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))) for _ in range(12)])
    a, b = (models.tangent(c, models.geometric_mean(c)) for c in (cs, 9 * cs))
    assert np.allclose(a, b, atol=1e-6) and np.allclose(a.mean(axis=0), 0, atol=1e-6)


def test_models_do_not_leak_and_transfer_ignores_gain():
    import pandas as pd

    rng = np.random.default_rng(0)
    y = np.arange(60) % 2
    x = rng.normal(size=(60, 6)) + y[:, None]
    frame = pd.DataFrame(x, columns=[f"f{i}" for i in range(6)]).assign(subject_id=np.arange(60), truth=y, fold=[f"fold_{i % 5}" for i in (np.arange(60) // 2)])
    cols = [f"f{i}" for i in range(6)]
    oof = models.two_way_folds(frame, cols).set_index("subject_id").prob
    changed = frame.copy()
    changed.loc[0, "f0"] += 100
    other = models.two_way_folds(changed, cols).set_index("subject_id").prob
    mates = frame[(frame.fold == frame.fold[0]) & (frame.subject_id != 0)].subject_id
    assert np.allclose(oof[mates], other[mates]) and not np.isclose(oof[0], other[0])
    nested = models.nested_folds(frame, cols, [(3, 1.0), (6, 1.0)])
    from quillon.operators.resample import auc

    assert auc(nested.truth.to_numpy(), nested.prob.to_numpy()) > 0.85
    far = frame.copy()
    far[cols] = far[cols] * 7 + 3
    assert np.allclose(models.transfer(frame, frame, cols), models.transfer(frame, far, cols))


def test_too_few_windows_are_none_or_an_error(spark):
    from pyspark.errors import PySparkException

    df = spark.createDataFrame([(1, [0.0] * 10), (2, [0.0] * 20), (3, None)], "id int, samples array<double>")
    assert {r.id for r in signals.explode_windows(df, 4, 2, "id", least=5).collect()} == {2}
    assert signals.explode_windows(df.filter("id = 2"), 4, 2, "id", least=9, strict=True).count() == 9
    with pytest.raises(PySparkException, match="too few windows: 4"):
        signals.explode_windows(df.filter("id = 1"), 4, 2, "id", least=5, strict=True).collect()


def test_a_model_learnt_once_is_the_optimum_of_the_other_rows():
    import pandas as pd

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    y = (x[:, 0] + rng.normal(size=60) > 0).astype(int)
    x[5, 1] = np.nan
    frame = pd.DataFrame(x, columns=["a", "b", "c"]).assign(subject_id=range(60), truth=y, fold=["test" if i % 4 == 0 else "fold_0" for i in range(60)])
    frame["c"] = np.where(frame["fold"] == "test", frame["c"], np.nan)  # nothing to learn from
    out = models.train_once(frame, ["a", "b", "c"])
    assert out["subject_id"].tolist() == list(range(0, 60, 4))
    test = np.arange(60) % 4 == 0
    z = x[:, :2].copy()
    z[5, 1] = np.nanmedian(x[~test, 1])
    z = (z - z[~test].mean(axis=0)) / z[~test].std(axis=0)
    d = np.column_stack((z, np.ones(60)))
    margin = np.log(out["prob"] / (1 - out["prob"])).to_numpy()
    w, *_ = np.linalg.lstsq(d[test], margin, rcond=None)
    assert np.allclose(d[test] @ w, margin, atol=1e-8)
    p = 1 / (1 + np.exp(-d[~test] @ w))
    assert np.allclose(d[~test].T @ (p - y[~test]) + np.append(w[:2], 0), 0, atol=1e-6)
    assert models.train_once(frame.assign(truth=1), ["a"]).empty and models.train_once(frame.assign(fold="fold_0"), ["a"]).empty
