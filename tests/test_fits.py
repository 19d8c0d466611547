import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.operators import fits, models
from quillon.shared import materialise

FEATURES = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(0)
    n = 240
    x = rng.normal(0, 1, (n, 5)) * [1, 30, 0.01, 1, 1] + [0, 500, 0, 2, 0]
    truth = (x[:, 0] + (x[:, 1] - 500) / 40 + rng.normal(0, 1.5, n) > 0).astype(int)
    x[rng.random((n, 5)) < 0.1] = np.nan
    x[:, 3] = 7.0  # constant
    x[:, 4] = np.nan  # without a value
    fold = np.array([f"fold_{i % 4}" if i % 9 else "test" for i in range(n)])
    one = pd.DataFrame(x, columns=FEATURES).assign(subject_id=np.arange(n), truth=truth, fold=fold, arm="x")
    single = one.head(6).assign(arm="single", truth=1)
    return pd.concat([one, single], ignore_index=True)


@pytest.fixture(scope="module")
def rows(spark, frame):
    given = [(r.arm, int(r.subject_id), r.fold, int(r.truth), [None if np.isnan(v) else float(v) for v in r[FEATURES].to_numpy(float)]) for _, r in frame.iterrows()]
    return materialise(spark.createDataFrame(given, "arm string, subject_id long, fold string, truth int, x array<double>").repartition(5), "given")


def close(df, want, arm="x"):
    got = {(r.subject_id, r.fold): r.prob for r in df.collect() if r.arm == arm}
    expected = {(r.subject_id, r.fold): r.prob for r in want.itertuples()}
    assert set(got) == set(expected) and max(abs(got[k] - expected[k]) for k in got) < 1e-7


@pytest.mark.parametrize("scale", [True, False])
def test_out_of_fold_equals_the_solver_in_memory(rows, frame, scale):
    got = fits.out_of_fold(fits.leave_one_out(rows, "fold", "arm"), "arm", scale=scale)
    assert got.filter("arm = 'single'").count() == 0
    close(got, models.two_way_folds(frame[frame["arm"] == "x"], FEATURES, scale=scale))


def test_weights_equal_the_solver_in_memory(rows, frame):
    learn = rows.filter("arm = 'x' AND fold <> 'test'")
    stats = fits.statistics(learn, "arm")
    got = fits.logistic(fits.scaled(learn, stats, "arm"), "arm")[("x",)]
    x = frame[(frame["arm"] == "x") & (frame["fold"] != "test")]
    z = models.impute_scale(x[FEATURES].to_numpy(float), x[FEATURES].to_numpy(float))[0]
    assert np.abs(got - models.logistic(z, x["truth"].to_numpy())).max() < 1e-8


def test_one_test_split_and_transfer(rows, frame):
    mine = frame[frame["arm"] == "x"]
    close(fits.out_of_fold(fits.train_and_test(rows, "fold", "arm"), "arm"), models.train_once(mine, FEATURES))
    here = mine["fold"].isin(["fold_0", "fold_1"]).to_numpy()
    want = mine[~here].assign(prob=models.transfer(mine[here], mine[~here], FEATURES))
    got = fits.transfer(rows.filter("arm = 'x'").withColumn("here", F.col("fold").isin("fold_0", "fold_1")), "here", "arm")
    close(got, want)


def test_tangent_space_equals_the_version_in_memory(spark):
    rng = np.random.default_rng(1)
    channels = ["O2", "C3", "O1"]
    given, flat = [], []
    for i in range(36):
        x = rng.normal(0, 1, (50, 3)) @ np.diag([1, 1 + i % 2, 0.5]) @ rng.normal(0, 1, (3, 3))
        given += [(i, c, x[:, j].tolist()) for j, c in enumerate(channels)]
        flat.append(models.oas(x).ravel())
    given.append((99, "O1", [1.0, 2.0]))
    df = spark.createDataFrame(given, "subject_id long, channel string, samples array<double>").repartition(4)
    cov = {r.subject_id: r["cov"] for r in fits.covariances(df, channels, "subject_id").collect()}
    assert set(cov) == set(range(36)) and max(np.abs(np.array(cov[i]) - flat[i]).max() for i in cov) < 1e-12
    frame = pd.DataFrame({"subject_id": range(36), "cov": flat, "truth": [i % 2 for i in range(36)], "fold": [f"fold_{i // 2 % 3}" for i in range(36)]})
    rows = fits.covariances(df, channels, "subject_id").select("subject_id", "cov", (F.col("subject_id") % 2).cast("int").alias("truth"), F.concat(F.lit("fold_"), (F.floor(F.col("subject_id") / 2) % 3).cast("string")).alias("fold"), F.lit("x").alias("arm"))
    close(fits.tangent_out_of_fold(rows, 3, "arm"), models.tangent_folds(frame, 3))


def test_nothing_to_fit(spark):
    none = spark.createDataFrame([], "arm string, subject_id long, fold string, truth int, x array<double>")
    assert fits.out_of_fold(fits.leave_one_out(none, "fold", "arm"), "arm").count() == 0


def test_the_grid_by_cells_equals_nested_folds(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (45, 6))
    truth = (x[:, 2] + 0.5 * x[:, 4] + rng.normal(0, 0.7, 45) > 0).astype(int)
    frame = pd.DataFrame(x, columns=list("abcdef")).assign(subject_id=range(45), truth=truth, fold=[f"fold_{i % 5}" for i in range(45)])
    rows = spark.createDataFrame([("x", i, f"fold_{i % 5}", int(truth[i]), x[i].tolist()) for i in range(45)], "arm string, subject_id long, fold string, truth int, x array<double>")
    grid = [(k, c) for k in (2, 4) for c in (0.1, 1.0)]
    close(models.nested_grid(rows, "arm", grid, [f"fold_{i}" for i in range(5)]), models.nested_folds(frame, list("abcdef"), grid))


def test_the_registered_grid_is_whole():
    from quillon.plans import inference

    assert inference.KERNEL_GRID == [(k, c) for k in (10, 20, 40, 80) for c in (0.1, 1.0, 10.0)] and len(inference.KERNEL_FOLDS) == 5


def test_a_machine_keeps_a_bounded_part_of_its_pairs(monkeypatch):
    rng = np.random.default_rng(6)
    x, other = rng.normal(0, 1, (90, 4)), rng.normal(0, 1, (20, 4))
    y = (x[:, 0] + rng.normal(0, 0.5, 90) > 0).astype(int)
    want = models.KernelMachine(1.0).fit(x, y).probability(other)
    sizes, kernel = [], models.KernelMachine._kernel
    monkeypatch.setattr(models, "BLOCK_VALUES", 900)
    monkeypatch.setattr(models.KernelMachine, "_kernel", lambda self, a, b: sizes.append(len(a) * len(b)) or kernel(self, a, b))
    got = models.KernelMachine(1.0, kept=90 * 8 * 30).fit(x, y).probability(other)
    assert np.abs(got - want).max() < 1e-9 and max(sizes) <= 900


def test_a_task_trains_one_machine_of_a_cell(monkeypatch):
    rng = np.random.default_rng(7)
    frame = pd.DataFrame({"fold": [f"fold_{i % 5}" for i in range(60)], "truth": [i % 2 for i in range(60)], "x": [rng.normal(i % 2, 1, 3).tolist() for i in range(60)]})
    train, trained, rows = models.KernelMachine._train, [], []
    monkeypatch.setattr(models.KernelMachine, "_train", lambda self, x, y: trained.append(len(y)) or train(self, x, y))
    for part in range(models.PARTS + 1):
        at, margin = models._cell(frame, 2, 1.0, ["fold_0", "fold_1", "fold_2"], "fold_3", part)
        rows.append(at.tolist())
        assert len(trained) == part + 1 and len(at) == len(margin) == 12
    assert sorted(sum(rows[:-1], [])) == np.flatnonzero(frame["fold"].isin(["fold_0", "fold_1", "fold_2"])).tolist()
    assert rows[-1] == np.flatnonzero(frame["fold"] == "fold_3").tolist()
