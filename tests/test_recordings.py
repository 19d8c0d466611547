import numpy as np
import pytest

from quillon.operators import recordings
from quillon.schemas import CHANNELS


def raw(path, rng, factor, fs=250, seconds=80):
    n = fs * seconds
    t = np.arange(n) / fs
    alpha = np.where(t < seconds / 2, factor, 1.0) * np.sin(2 * np.pi * 10 * t) * 8e-6
    rows = []
    for c in CHANNELS:
        x = rng.normal(0, 6e-6, n) + (alpha if c in ("O1", "O2") else 0.2 * alpha)
        if c == "C3":
            x[30 * fs : 30 * fs + 20] += 900e-6
        rows.append((path, c, float(fs), x.tolist()))
    return rows


def test_recordings_become_epochs_and_statuses(spark):
    rng = np.random.default_rng(0)
    rows = raw("/closed_first", rng, 4.0) + raw("/closed_last", rng, 0.25) + raw("/same", rng, 1.0) + [("/broken", "error: not a recording", None, None)]
    df = spark.createDataFrame(rows, "path string, channel string, sfreq double, signal array<double>")
    out = recordings.prepare(df).cache()
    status = {r.path: r for r in recordings.statuses(out).collect()}
    assert {p: r.status for p, r in status.items()} == {"/closed_first": "ok", "/closed_last": "ok", "/same": "skipped_ambiguous", "/broken": "failed"}
    assert status["/closed_first"].alpha_ratio > 1.4 and status["/closed_last"].alpha_ratio < 0.7 and "usable" in status["/broken"].detail
    assert 0 < status["/closed_first"].n_kept < status["/closed_first"].n_events == 52
    for r in status.values():
        if r.status != "failed":
            assert r.n_ec + r.n_eo == r.n_kept and r.rej_ec == round(1 - r.n_ec / 26, 4) and r.rej_eo == round(1 - r.n_eo / 26, 4)
            assert r.n_vcpt is None and r.rej_vcpt is None and r.n_muscle >= 0 and (r.split_rule, r.boundary_frac) == ("midpoint", 0.5)
    assert out.filter("path = '/same' AND status IS NULL").count() == 0
    e = recordings.epochs(out)
    assert {r.condition for r in e.select("condition").distinct().collect()} == {"ec", "eo"}
    power = {(r.path, r.condition): np.mean(np.square(r.samples)) for r in e.filter("channel = 'O1' AND epoch = 3").collect()}
    assert power["/closed_first", "ec"] > 3 * power["/closed_first", "eo"] and power["/closed_last", "ec"] > 3 * power["/closed_last", "eo"]


def test_cuts_and_their_fallback():
    rng, s = np.random.default_rng(1), recordings.Settings()
    rows = raw("/r", rng, 3.0)
    channels, x = [r[1] for r in rows], np.array([r[3] for r in rows])
    n = x.shape[1]
    assert recordings.halves(x, channels, 250.0, 0.4, s)[::2] == (round(0.4 * n), True)
    middle = recordings.halves(x, channels, 250.0, None, s)
    assert middle[0] == n // 2 and middle[1] > 1.4 and not middle[2]
    assert recordings.halves(x, channels, 250.0, 0.05, s) == middle  # within the trimmed end
    with pytest.raises(ValueError):
        recordings.halves(x[:, : 250 * 20], channels, 250.0, 0.5, s)


def test_peak_regions_and_vetoes():
    w = np.full(19, 0.1)
    w[:2] = 2.0
    assert recordings.peak_region(w, CHANNELS)[0] == "frontopolar" and recordings.peak_region(w, CHANNELS)[1] > 2
    assert recordings.peak_region(np.zeros(19), CHANNELS) == (None, 0.0)
