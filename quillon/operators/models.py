"""Classifiers over subject feature tables in memory, and the kernel machine's nested grid.

``fits`` has the same logistic models, scaling and tangent space by sums over rows, which the queries use; here are
the versions of one frame, which tests hold them against. A kernel machine needs all pairs of its cohort, so
``nested_grid`` deals out folds and cells. Every statistic is fitted on training rows only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "subject_id long, fold string, truth int, prob double"


def impute_scale(train: np.ndarray, other: np.ndarray, scale: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Medians and population deviations of the training rows; columns without a value become 0, constant ones divide by 1."""
    with np.errstate(all="ignore"):
        import warnings

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            median = np.nanmedian(train, axis=0)
    median = np.where(np.isfinite(median), median, 0.0)
    train, other = (np.where(np.isfinite(x), x, median) for x in (train, other))
    if not scale:
        return train, other
    mean, sd = train.mean(axis=0), train.std(axis=0)
    sd = np.where(sd > 1e-12, sd, 1.0)
    return (train - mean) / sd, (other - mean) / sd


def anova_f(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    groups = [x[y == c] for c in np.unique(y)]
    mean, n = x.mean(axis=0), len(x)
    between = sum(len(g) * (g.mean(axis=0) - mean) ** 2 for g in groups) / (len(groups) - 1)
    within = sum(((g - g.mean(axis=0)) ** 2).sum(axis=0) for g in groups) / max(1, n - len(groups))
    return np.where(within > 0, between / np.where(within > 0, within, 1), 0.0)


def logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights and intercept of an L2-penalised logistic regression (sum of losses, intercept free), by damped Newton."""
    z = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    penalty = np.append(np.full(x.shape[1], 1 / c), 0.0)

    def loss(v):
        m = z @ v
        return np.sum(np.logaddexp(0, m) - y * m) + 0.5 * np.sum(penalty * v * v)

    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ w))
        g = z.T @ (p - y) + penalty * w
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-10)
        step = np.linalg.solve(h, g)
        t, now = 1.0, loss(w)
        while loss(w - t * step) > now - 1e-4 * t * (g @ step) and t > 1e-6:
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-10:
            break
    return w


def predict_logistic(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))


#: Bytes of a machine's matrix that a task keeps; further columns are made again when they are asked for.
KEPT_BYTES = 512 << 20
#: Values of the matrix that are made at once.
BLOCK_VALUES = 1 << 20
#: Thirds of the training rows that are held out in turn.
PARTS = 3


class _Columns:
    """Columns of a machine's symmetric dual matrix, made by blocks when one is asked for."""

    def __init__(self, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, s: np.ndarray, room: int):
        self.kernel, self.x, self.s, self.room = kernel, x, s, room
        self.width = max(1, min(256, BLOCK_VALUES // max(1, len(x))))
        self.kept: dict[int, np.ndarray] = {}
        self.last: tuple[int, np.ndarray | None] = (-1, None)

    def __getitem__(self, i: int) -> np.ndarray:
        number, at = divmod(i, self.width)
        block = self.kept.get(number)
        if block is None:
            if self.last[0] != number:
                some = slice(number * self.width, (number + 1) * self.width)
                made = self.kernel(self.x[some], self.x)
                made += 1
                made *= self.s[some][:, None]
                made *= self.s[None, :]
                self.last = number, made
            block = self.last[1]
            if block.nbytes <= self.room:
                self.kept[number] = block
                self.room -= block.nbytes
        return block[at]


class KernelMachine:
    """A soft-margin machine with a radial kernel, balanced class weights and a logistic curve on its margins."""

    def __init__(self, c: float, sweeps: int = 200, kept: int = KEPT_BYTES):
        self.c, self.sweeps, self.kept = c, sweeps, kept

    def _scale(self, x):
        self.gamma = 1 / (x.shape[1] * max(x.var(), 1e-12))

    def _kernel(self, a, b):
        d = a @ (-2 * b.T)
        d += (a * a).sum(axis=1)[:, None]
        d += (b * b).sum(axis=1)[None, :]
        np.maximum(d, 0, out=d)
        d *= -self.gamma
        return np.exp(d, out=d)

    def _train(self, x, y):
        """Dual coordinate ascent; the bias is the kernel's constant, added to it. A row's own entry is 1 + 1."""
        s = np.where(y == 1, 1.0, -1.0)
        share = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
        top, q = self.c * share, _Columns(self._kernel, x, s, self.kept)
        a, g, step = np.zeros(len(y)), -np.ones(len(y)), np.empty(len(y))
        for _ in range(self.sweeps):
            moved = 0.0
            for i in range(len(y)):
                new = min(max(a[i] - g[i] / 2, 0.0), top[i])
                if new != a[i]:
                    np.multiply(q[i], new - a[i], out=step)
                    g += step
                    moved = max(moved, abs(new - a[i]))
                    a[i] = new
            if moved < 1e-6 * self.c:
                break
        return a * s

    def _margins(self, x, of, a):
        """Margins of rows ``x`` by weights ``a`` of rows ``of``, some rows at a time."""
        width = max(1, BLOCK_VALUES // max(1, len(of)))
        return np.concatenate([np.zeros(0)] + [(self._kernel(x[i : i + width], of) + 1) @ a for i in range(0, len(x), width)])

    def margins(self, x: np.ndarray, y: np.ndarray, part: int, other: np.ndarray | None = None) -> np.ndarray:
        """Margins of one third of the training rows by a machine of the rest, or with ``other`` of these by one of all."""
        self._scale(x)
        if other is not None:
            return self._margins(other, x, self._train(x, y))
        rest = np.arange(len(y)) % PARTS != part
        if not 0 < y[rest].sum() < rest.sum():
            return np.zeros(int((~rest).sum()))
        return self._margins(x[~rest], x[rest], self._train(x[rest], y[rest]))

    def fit(self, x: np.ndarray, y: np.ndarray) -> KernelMachine:
        self._scale(x)
        self.x, self.a = x, self._train(x, y)
        # margins for the curve come from rows held out in turn
        margin = np.zeros(len(y))
        for k in range(PARTS):
            margin[np.arange(len(y)) % PARTS == k] = self.margins(x, y, k)
        self.curve = logistic(margin[:, None], y, c=1e3)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return predict_logistic(self.curve, self._margins(x, self.x, self.a)[:, None])


def nested_folds(frame: pd.DataFrame, features: list[str], grid: list[tuple[int, float]]) -> pd.DataFrame:
    """Outer fold scored, next fold inner, rest train; the first best (k, C) by inner accuracy refits on train and inner."""
    folds = sorted(f for f in frame["fold"].unique() if f != "test")
    x, y = frame[features].to_numpy(float), frame["truth"].to_numpy(np.int64)
    out = []
    for i, outer in enumerate(folds):
        inner = folds[(i + 1) % len(folds)]
        test, valid = (frame["fold"] == outer).to_numpy(), (frame["fold"] == inner).to_numpy()
        train = ~test & ~valid & (frame["fold"] != "test").to_numpy()
        best, chosen = -1.0, grid[0]
        if 0 < y[train].sum() < train.sum():
            a, b = impute_scale(x[train], x[valid])
            rank = np.argsort(-anova_f(a, y[train]), kind="stable")
            for k, c in grid:
                use = rank[:k]
                right = float(((KernelMachine(c).fit(a[:, use], y[train]).probability(b[:, use]) >= 0.5) == y[valid]).mean())
                if right > best:
                    best, chosen = right, (k, c)
        both = train | valid
        if not 0 < y[both].sum() < both.sum():
            continue
        a, b = impute_scale(x[both], x[test])
        use = np.argsort(-anova_f(a, y[both]), kind="stable")[: chosen[0]]
        prob = KernelMachine(chosen[1]).fit(a[:, use], y[both]).probability(b[:, use])
        out.append(pd.DataFrame({"subject_id": frame["subject_id"].to_numpy()[test], "fold": outer, "truth": y[test], "prob": prob}))
    return pd.concat(out) if out else pd.DataFrame({"subject_id": [], "fold": [], "truth": [], "prob": []})


def _cell(frame: pd.DataFrame, k: int, c: float, learn: list[str], score: str, part: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, margins) of one training of a cell, of the best k features: of the scored fold's rows by a machine of the
    other folds' if ``part`` is ``PARTS``, else of a third of the training rows; none with one class."""
    x, y = np.stack([np.asarray(v, float) for v in frame["x"]]), frame["truth"].to_numpy(np.int64)
    train, test = frame["fold"].isin(learn).to_numpy(), (frame["fold"] == score).to_numpy()
    if not 0 < y[train].sum() < train.sum() or not test.any():
        return np.zeros(0, int), np.zeros(0)
    a, b = impute_scale(x[train], x[test])
    use = np.argsort(-anova_f(a, y[train]), kind="stable")[:k]
    if part == PARTS:
        return np.flatnonzero(test), KernelMachine(c).margins(a[:, use], y[train], part, b[:, use])
    return np.flatnonzero(train)[part::PARTS], KernelMachine(c).margins(a[:, use], y[train], part)


def nested_grid(table: DataFrame, arm: str, grid: list[tuple[int, float]], folds: list[str]) -> DataFrame:
    """(arm, subject_id, fold, truth, prob): ``nested_folds`` with a task for each training of an outer fold's cells.

    A kernel machine sees all pairs of its subjects, so a task holds a cohort and at most ``KEPT_BYTES`` of its pairs. What is
    dealt out are folds, cells, and a cell's four trainings; its curve needs their margins only.
    """
    from pyspark.sql import functions as F

    from ..shared import materialise

    held = materialise(table.select(arm, "subject_id", "fold", "truth", "x").filter(F.col("fold").isin(folds)), "held")
    inner = {f: folds[(i + 1) % len(folds)] for i, f in enumerate(folds)}
    rest = {f: [g for g in folds if g not in (f, inner[f])] for f in folds}
    key = [arm, "outer", "cell"]
    each = lambda rows, name, n: rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    outer = held.withColumn("outer", F.explode(F.array(*map(F.lit, folds))))
    place = F.array_position(F.array(*map(F.lit, folds)), F.col("outer")).cast("int") - 1

    def scored(dealt: DataFrame, tasks: int, task, learn: dict[str, list[str]], score: dict[str, str]) -> DataFrame:
        """Rows of each cell's scored fold with their probabilities."""

        def train(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("subject_id", kind="stable").reset_index(drop=True)
            fold, part = frame["outer"].iloc[0], int(frame["part"].iloc[0])
            at, margin = _cell(frame, *grid[int(frame["cell"].iloc[0])], learn[fold], score[fold], part)
            return frame.iloc[at][[*key, "subject_id", "fold", "truth"]].assign(part=part, margin=margin)

        def curve(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["subject_id", "fold"], kind="stable")
            learnt, rows = frame[frame["part"] < PARTS], frame[frame["part"] == PARTS]
            w = logistic(learnt["margin"].to_numpy()[:, None], learnt["truth"].to_numpy(np.int64), c=1e3)
            return rows[[*key, "subject_id", "fold", "truth"]].assign(prob=predict_logistic(w, rows["margin"].to_numpy()[:, None]))

        # one training a task, dealt by number
        dealt = each(dealt, "part", PARTS + 1).withColumn("task", (task * (PARTS + 1) + F.col("part")).cast("int"))
        row = f"{arm} string, outer string, cell int, subject_id long, fold string, truth int"
        margins = dealt.repartitionById(tasks * (PARTS + 1), F.col("task")).groupBy(*key, "part", "task").applyInPandas(train, f"{row}, part int, margin double")
        return materialise(margins, "margins").groupBy(*key).applyInPandas(curve, f"{row}, prob double")

    cells = each(outer.filter(F.col("outer") != F.col("fold")), "cell", len(grid))
    rated = scored(cells, len(folds) * len(grid), place * len(grid) + F.col("cell"), rest, inner)
    right = rated.groupBy(*key).agg(F.avg(((F.col("prob") >= 0.5) == (F.col("truth") == 1)).cast("double")).alias("right"))
    # the first best cell, the first one where none could be rated
    best = right.groupBy(arm, "outer").agg((-F.max(F.struct("right", (-F.col("cell")).alias("c")))["c"]).alias("cell"))
    whole = outer.join(F.broadcast(best), [arm, "outer"], "left").withColumn("cell", F.coalesce("cell", F.lit(0)))
    found = scored(whole, len(folds), place, {f: [g for g in folds if g != f] for f in folds}, {f: f for f in folds})
    return found.select(arm, "subject_id", "fold", "truth", "prob")


def two_way_folds(frame: pd.DataFrame, features: list[str], scale: bool = True, c: float = 1.0) -> pd.DataFrame:
    """Each fold scored by a logistic regression of the others; folds with one training class are left out."""
    x, y = frame[features].to_numpy(float), frame["truth"].to_numpy(np.int64)
    out = []
    for fold in sorted(f for f in frame["fold"].unique() if f != "test"):
        test = (frame["fold"] == fold).to_numpy()
        train = ~test & (frame["fold"] != "test").to_numpy()
        if not 0 < y[train].sum() < train.sum():
            continue
        use = np.isfinite(x[train | test]).any(axis=0)
        a, b = impute_scale(x[train][:, use], x[test][:, use], scale)
        out.append(pd.DataFrame({"subject_id": frame["subject_id"].to_numpy()[test], "fold": fold, "truth": y[test], "prob": predict_logistic(logistic(a, y[train], c), b)}))
    return pd.concat(out) if out else pd.DataFrame({"subject_id": [], "fold": [], "truth": [], "prob": []})


def train_once(frame: pd.DataFrame, features: list[str], c: float = 1.0) -> pd.DataFrame:
    """Learnt once on every row outside the test split, then scored once on it; columns without a value outside it are left out."""
    x, y, test = frame[features].to_numpy(float), frame["truth"].to_numpy(np.int64), (frame["fold"] == "test").to_numpy()
    if not 0 < y[~test].sum() < (~test).sum() or not test.any():
        return pd.DataFrame({"subject_id": [], "fold": [], "truth": [], "prob": []})
    use = np.isfinite(x[~test]).any(axis=0)
    a, b = impute_scale(x[~test][:, use], x[test][:, use])
    return pd.DataFrame({"subject_id": frame["subject_id"].to_numpy()[test], "fold": "test", "truth": y[test], "prob": predict_logistic(logistic(a, y[~test], c), b)})


def transfer(train: pd.DataFrame, other: pd.DataFrame, features: list[str], c: float = 1.0) -> np.ndarray:
    """Train on one dataset, score another; each is imputed and scaled by itself, so gains and offsets cancel."""
    a = impute_scale(train[features].to_numpy(float), train[features].to_numpy(float))[0]
    b = impute_scale(other[features].to_numpy(float), other[features].to_numpy(float))[0]
    return predict_logistic(logistic(a, train["truth"].to_numpy(np.int64), c), b)


# --- covariances ------------------------------------------------------------------------------


def oas(x: np.ndarray) -> np.ndarray:
    """Oracle-approximating shrinkage covariance of rows of observations: positive definite even for dependent columns."""
    n, p = x.shape
    s = np.cov(x, rowvar=False, bias=True)
    mu, alpha = np.trace(s) / p, np.mean(s * s)
    down = (n + 1.0) * (alpha - mu * mu / p)
    shrink = 1.0 if down == 0 else min((alpha + mu * mu) / down, 1.0)
    return (1 - shrink) * s + shrink * mu * np.eye(p)


def _power(c: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    w, v = np.linalg.eigh(c)
    return (v * f(np.maximum(w, 1e-300))) @ v.T


def geometric_mean(cs: np.ndarray, steps: int = 50, tolerance: float = 1e-9) -> np.ndarray:
    """The affine-invariant mean of positive definite matrices."""
    mean = cs.mean(axis=0)
    for _ in range(steps):
        half, back = _power(mean, np.sqrt), _power(mean, lambda w: 1 / np.sqrt(w))
        tangent = np.mean([_power(back @ c @ back, np.log) for c in cs], axis=0)
        mean = half @ _exp(tangent) @ half
        if np.linalg.norm(tangent) < tolerance:
            break
    return mean


def _exp(a: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh(a)
    return (v * np.exp(w)) @ v.T


def tangent(cs: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Log maps at the mean, upper triangles with off-diagonals times the square root of 2."""
    back = _power(mean, lambda w: 1 / np.sqrt(w))
    i, j = np.triu_indices(cs.shape[-1])
    weight = np.where(i == j, 1.0, np.sqrt(2))
    return np.stack([_power(back @ c @ back, np.log)[i, j] * weight for c in cs])


def tangent_folds(frame: pd.DataFrame, size: int) -> pd.DataFrame:
    """Out-of-fold logistic regression in tangent space; the mean comes from training rows only. ``cov``: flat matrices."""
    cs = np.stack([np.asarray(c, float).reshape(size, size) for c in frame["cov"]])
    y, out = frame["truth"].to_numpy(np.int64), []
    for fold in sorted(f for f in frame["fold"].unique() if f != "test"):
        test = (frame["fold"] == fold).to_numpy()
        train = ~test & (frame["fold"] != "test").to_numpy()
        if not 0 < y[train].sum() < train.sum():
            continue
        mean = geometric_mean(cs[train])
        a, b = impute_scale(tangent(cs[train], mean), tangent(cs[test], mean))
        out.append(pd.DataFrame({"subject_id": frame["subject_id"].to_numpy()[test], "fold": fold, "truth": y[test], "prob": predict_logistic(logistic(a, y[train]), b)}))
    return pd.concat(out) if out else pd.DataFrame({"subject_id": [], "fold": [], "truth": [], "prob": []})
