"""Logistic models, scaling and tangent space fitted by sums over rows: no group holds an arm.

A model is a key (say arm and left-out fold). Rows are dealt to the models that learn from them or score them;
statistics are aggregates by model, and a Newton step of all models is one pass that adds up their losses, gradients
and Hessians by task. The driver keeps a model's few numbers, as many models as arms have folds. The optimum is that
of ``models.logistic``, which has the rows of one model in memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialise
from . import models as dense
from .sums import arrays, lists, sum_arrays
from .tables import medians


def leave_one_out(rows: DataFrame, fold: str, *by: str) -> DataFrame:
    """Rows once for each fold of their key: ``out`` names the fold left out, ``role`` says learn or score. The fold
    ``test`` takes no part; a model whose rows to learn from are of one class is left out (``truth`` is 0 or 1)."""
    held = rows.filter(F.col(fold) != "test")
    cells = held.groupBy(*by, fold).agg(F.count("*").alias("__n"), F.sum("truth").alias("__p"))
    whole = cells.groupBy(*by).agg(F.sum("__n").alias("__all"), F.sum("__p").alias("__pos"))
    # what a model learns from is all of its key less the fold
    learnt = cells.join(whole, list(by)).withColumns({"__n": F.col("__all") - F.col("__n"), "__p": F.col("__pos") - F.col("__p")})
    outs = learnt.filter("__p > 0 AND __p < __n").select(*by, F.col(fold).alias("out"))
    # as many rows as models
    return held.join(F.broadcast(outs), list(by)).withColumn("role", F.when(F.col(fold) == F.col("out"), "score").otherwise("learn"))


def train_and_test(rows: DataFrame, fold: str, *by: str) -> DataFrame:
    """As ``leave_one_out`` with one model a key: the fold ``test`` is scored, all others are learnt from."""
    sides = rows.groupBy(*by).agg(*[F.sum(F.when(F.col(fold) != "test", c)).alias(n) for n, c in (("__n", F.lit(1)), ("__p", F.col("truth")))], F.max((F.col(fold) == "test").cast("int")).alias("__t"))
    keep = sides.filter("__p > 0 AND __p < __n AND __t = 1").select(*by, F.lit("test").alias("out"))
    return rows.join(F.broadcast(keep), list(by)).withColumn("role", F.when(F.col(fold) == "test", "score").otherwise("learn"))


def statistics(rows: DataFrame, *by: str, scale: bool = True) -> DataFrame:
    """(by, median, mean, sd): arrays by feature of ``x``; a feature without a value has median 0, a constant one sd 1."""
    long = rows.select(*by, F.posexplode("x").alias("p", "v")).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    every = long.select(*by, "p").distinct()
    middle = every.join(medians(long, "v", *by, "p"), [*by, "p"], "left")
    held = materialise(middle.select(*by, "p", F.coalesce("median", F.lit(0.0)).alias("m")), "medians")
    # a row a model and feature, as the driver keeps weights
    filled = long.join(F.broadcast(held), [*by, "p"]).withColumn("v", F.coalesce("v", "m"))
    cells = filled.groupBy(*by, "p").agg(F.first("m").alias("median"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))
    fit = {"mean": F.col("mean"), "sd": F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0)} if scale else {"mean": F.lit(0.0), "sd": F.lit(1.0)}
    parts = cells.withColumns(fit).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("p", "median", "mean", "sd"))).alias("s"))
    return parts.select(*by, "s.median", "s.mean", "s.sd")


def scaled(rows: DataFrame, stats: DataFrame, *by: str) -> DataFrame:
    """``rows`` with ``x`` imputed and scaled by their key's statistics."""
    named = stats.select(*by, F.struct("median", "mean", "sd").alias("__s"))
    cell = lambda v, i: (F.coalesce(F.when(~F.isnan(v), v), F.get(F.col("__s.median"), i)) - F.get(F.col("__s.mean"), i)) / F.get(F.col("__s.sd"), i)
    # a row a model
    return rows.join(F.broadcast(named), list(by)).withColumn("x", F.transform("x", cell)).drop("__s")


def _by_model(batch: pa.RecordBatch, by: tuple[str, ...]):
    """(key, rows) of each model in a batch."""
    names = list(zip(*[batch.column(k).to_pylist() for k in by], strict=True))
    places: dict[tuple, list[int]] = {}
    for i, name in enumerate(names):
        places.setdefault(name, []).append(i)
    return places.items()


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(arrays(column)) if len(column) else np.zeros((0, 0))


def logistic(rows: DataFrame, *by: str, c: float = 1.0, steps: int = 100) -> dict[tuple, np.ndarray]:
    """Weights and intercept by key of rows (by, truth, x): the optimum of ``models.logistic``, by damped Newton steps.

    A step that does not lower a model's loss enough is halved and tried in the next pass, beside the other models.
    """
    spark, types = rows.sparkSession, dict(rows.dtypes)
    kept = materialise(rows.select(*by, "truth", "x"), "learn")
    sizes = {tuple(r[k] for k in by): r.d for r in kept.groupBy(*by).agg(F.max(F.size("x")).alias("d")).collect()}
    state = {k: {"w": np.zeros(d + 1), "step": None, "t": 1.0, "loss": None, "slope": 0.0, "try": np.zeros(d + 1)} for k, d in sizes.items()}
    penalty = {k: np.append(np.full(d, 1 / c), 0.0) for k, d in sizes.items()}
    schema = ", ".join(f"`{k}` {types[k]}" for k in by) + ", sums array<double>"
    open_ = set(state)

    for _ in range(steps):
        if not open_:
            break
        weights = spark.sparkContext.broadcast({k: state[k]["try"] for k in open_})

        def sums(batches, weights=weights):
            total: dict[tuple, np.ndarray] = {}
            kinds = []
            for batch in batches:
                kinds = [batch.schema.field(k).type for k in by]
                truth = batch.column("truth").to_numpy(zero_copy_only=False).astype(float)
                for key, at in _by_model(batch, by):
                    w = weights.value.get(key)
                    if w is None:
                        continue
                    at = np.array(at)
                    z = np.column_stack((_matrix(batch.column("x").take(pa.array(at))), np.ones(len(at))))
                    y, m = truth[at], z @ w
                    p = 1 / (1 + np.exp(-m))
                    found = np.concatenate(([np.sum(np.logaddexp(0, m) - y * m)], z.T @ (p - y), ((z * (p * (1 - p))[:, None]).T @ z).ravel()))
                    total[key] = total[key] + found if key in total else found
            if total:
                yield pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in total], t) for i, t in enumerate(kinds)], lists(list(total.values()))], names=[*by, "sums"])

        added = sum_arrays(kept.mapInArrow(sums, schema), "sums", *by).collect()  # a row a model
        weights.unpersist()
        for r in added:
            key = tuple(r[k] for k in by)
            s, v = state[key], np.array(r.sums)
            w, pen, d = s["try"], penalty[key], len(s["try"])
            loss = v[0] + 0.5 * np.sum(pen * w * w)
            if s["loss"] is not None and loss > s["loss"] - 1e-4 * s["t"] * s["slope"] and s["t"] > 1e-6:
                s["t"] /= 2
                s["try"] = s["w"] - s["t"] * s["step"]
                continue
            moved = np.inf if s["step"] is None else np.abs(s["t"] * s["step"]).max()
            s["w"] = w
            if moved < 1e-10:
                open_.discard(key)
                continue
            g, h = v[1 : d + 1] + pen * w, v[d + 1 :].reshape(d, d) + np.diag(pen + 1e-10)
            step = np.linalg.solve(h, g)
            s.update(loss=loss, step=step, t=1.0, slope=float(g @ step))
            s["try"] = w - step
            if np.abs(step).max() < 1e-10:
                s["w"] = s["try"]
                open_.discard(key)
    return {k: s["w"] for k, s in state.items()}


def probabilities(rows: DataFrame, weights: dict[tuple, np.ndarray], *by: str) -> DataFrame:
    """``rows`` with ``prob`` in place of ``x``; rows of a key without a model go."""
    given = rows.sparkSession.sparkContext.broadcast(weights)
    rest = [c for c in rows.columns if c != "x"]
    types = dict(rows.dtypes)

    def score(batches):
        for batch in batches:
            prob = np.full(batch.num_rows, np.nan)
            for key, at in _by_model(batch, by):
                if key in given.value:
                    prob[at] = dense.predict_logistic(given.value[key], _matrix(batch.column("x").take(pa.array(np.array(at)))))
            keep = pa.array(np.flatnonzero(~np.isnan(prob)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(keep) for c in rest], pa.array(prob).take(keep)], names=[*rest, "prob"])

    return rows.mapInArrow(score, ", ".join(f"`{c}` {types[c]}" for c in rest) + ", prob double")


def out_of_fold(dealt: DataFrame, *by: str, scale: bool = True, c: float = 1.0) -> DataFrame:
    """(by, subject_id, fold, truth, prob): dealt rows (by, out, role, subject_id, fold, truth, x) scored by models that learnt without them."""
    key = (*by, "out")
    dealt = materialise(dealt, "dealt")
    learn, test = dealt.filter("role = 'learn'"), dealt.filter("role = 'score'")
    stats = materialise(statistics(learn, *key, scale=scale), "statistics")
    weights = logistic(scaled(learn, stats, *key), *key, c=c)
    return probabilities(scaled(test, stats, *key).select(*key, "subject_id", "fold", "truth", "x"), weights, *key).drop("out")


def transfer(rows: DataFrame, learnt: str, *by: str, c: float = 1.0) -> DataFrame:
    """(by, subject_id, fold, truth, prob) of the rows where the column ``learnt`` is false, by a model of the others; each side is scaled by itself."""
    sides = materialise(rows.select(*by, F.col(learnt).alias("__side"), "subject_id", "fold", "truth", "x"), "sides")
    even = materialise(scaled(sides, statistics(sides, *by, "__side"), *by, "__side"), "scaled")
    weights = logistic(even.filter("__side"), *by, c=c)
    return probabilities(even.filter("NOT __side").drop("__side"), weights, *by)


# --- tangent space ----------------------------------------------------------------------------


def covariances(rows: DataFrame, channels: list[str], *by: str) -> DataFrame:
    """(by, cov): shrunk covariances of ``samples`` by channel, as ``models.oas``; flat, in the order of ``channels``.

    Channel pairs are native sums of products; a key that lacks a channel has no row. Channels are of one length.
    """
    place = F.array_position(F.array(*map(F.lit, channels)), F.col("channel")).cast("int")
    mean = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x) / F.size("samples")
    flat = rows.filter(F.col("channel").isin(channels)).select(*by, place.alias("i"), "samples", mean.alias("m")).select(*by, "i", F.size("samples").alias("n"), F.transform("samples", lambda x: x - F.col("m")).alias("y"))
    other = flat.select(*by, F.col("i").alias("j"), F.col("y").alias("z"))
    dot = F.aggregate(F.zip_with("y", "z", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) / F.col("n")
    p = len(channels)
    cells = flat.join(other, list(by)).filter("i <= j").select(*by, "n", "i", "j", dot.alias("s"))
    twice = cells.unionByName(cells.filter("i < j").select(*by, "n", F.col("j").alias("i"), F.col("i").alias("j"), "s"))
    sums = twice.groupBy(*by).agg(F.first("n").alias("n"), F.count("*").alias("cells"), (F.sum(F.when(F.col("i") == F.col("j"), F.col("s"))) / p).alias("mu"), F.avg(F.col("s") * F.col("s")).alias("alpha"), F.sort_array(F.collect_list(F.struct("i", "j", "s"))).alias("c")).filter(F.col("cells") == p * p)
    down = (F.col("n") + 1.0) * (F.col("alpha") - F.col("mu") * F.col("mu") / p)
    shrink = F.when(down == 0, 1.0).otherwise(F.least((F.col("alpha") + F.col("mu") * F.col("mu")) / down, F.lit(1.0)))
    shrunk = sums.withColumn("shrink", shrink)
    return shrunk.select(*by, F.transform("c", lambda e: (1 - F.col("shrink")) * e["s"] + F.when(e["i"] == e["j"], F.col("shrink") * F.col("mu")).otherwise(0.0)).alias("cov"))


def tangent_means(rows: DataFrame, size: int, *by: str, steps: int = 50, tolerance: float = 1e-9) -> dict[tuple, np.ndarray]:
    """The affine-invariant mean of ``cov`` by key: each step adds up logarithms at the present means, in one pass for all keys."""
    types = dict(rows.dtypes)
    kept = materialise(rows.select(*by, "cov"), "covariances")
    first = sum_arrays(kept.withColumn("cov", F.concat(F.array(F.lit(1.0)), "cov")), "cov", *by).collect()
    means = {tuple(r[k] for k in by): np.array(r["cov"][1:]).reshape(size, size) / r["cov"][0] for r in first}
    counts = {tuple(r[k] for k in by): r["cov"][0] for r in first}
    schema, open_ = ", ".join(f"`{k}` {types[k]}" for k in by) + ", sums array<double>", set(means)
    for _ in range(steps):
        if not open_:
            break
        now = {k: (dense._power(means[k], np.sqrt), dense._power(means[k], lambda w: 1 / np.sqrt(w))) for k in open_}

        def logs(batches, now=now):
            total: dict[tuple, np.ndarray] = {}
            kinds = []
            for batch in batches:
                kinds = [batch.schema.field(k).type for k in by]
                for key, at in _by_model(batch, by):
                    if key in now:
                        back = now[key][1]
                        for c in arrays(batch.column("cov").take(pa.array(np.array(at)))):
                            found = dense._power(back @ c.reshape(size, size) @ back, np.log)
                            total[key] = total[key] + found if key in total else found
            if total:
                yield pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in total], t) for i, t in enumerate(kinds)], lists([v.ravel() for v in total.values()])], names=[*by, "sums"])

        for r in sum_arrays(kept.mapInArrow(logs, schema), "sums", *by).collect():  # a row a key
            key = tuple(r[k] for k in by)
            tangent = np.array(r.sums).reshape(size, size) / counts[key]
            half = now[key][0]
            means[key] = half @ dense._exp(tangent) @ half
            if np.linalg.norm(tangent) < tolerance:
                open_.discard(key)
    return means


def tangents(rows: DataFrame, means: dict[tuple, np.ndarray], size: int, *by: str) -> DataFrame:
    """``rows`` with ``x`` in place of ``cov``: the tangent vectors at their key's mean."""
    rest = [c for c in rows.columns if c != "cov"]
    types = dict(rows.dtypes)

    def project(batches):
        for batch in batches:
            out: list = [None] * batch.num_rows
            for key, at in _by_model(batch, by):
                cs = np.stack(arrays(batch.column("cov").take(pa.array(np.array(at))))).reshape(-1, size, size)
                for i, v in zip(at, dense.tangent(cs, means[key]), strict=True):
                    out[i] = v
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], lists(out)], names=[*rest, "x"])

    return rows.mapInArrow(project, ", ".join(f"`{c}` {types[c]}" for c in rest) + ", x array<double>")


def tangent_out_of_fold(rows: DataFrame, size: int, *by: str, c: float = 1.0) -> DataFrame:
    """(by, subject_id, fold, truth, prob) of rows (by, subject_id, fold, truth, cov): means come from the rows learnt from only."""
    dealt = materialise(leave_one_out(rows, "fold", *by), "dealt")
    means = tangent_means(dealt.filter("role = 'learn'"), size, *by, "out")
    return out_of_fold(tangents(dealt, means, size, *by, "out"), *by, c=c)
