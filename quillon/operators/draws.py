"""Resampling as a relational dimension: every draw's counts are functions of (draw, unit), so no group holds an arm.

A bootstrap counts a unit (subject or cluster) Poisson(1) times in each draw; a permutation gives the label 1 to the
units of the smallest hashed keys of a draw, as many as there were. Both come from one integer hash, which SQL can
compute too. Rows go by ranges of scores: a task streams its range in order of score and keeps running counts of
all draws, so its memory is that of the draws; ranges are then put together by blocks of draws. ``resample`` has the
same statistics with the draws of a seeded generator, an arm at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import materialise

_P = 2_147_483_647
_ROUNDS = ((15, 1_103_515_245), (13, 1_664_525), (16, 1_812_433_253))
#: A hash below so many of 2^31 has at least k counts: the upper tail of a Poisson variable of mean 1.
_TAILS = (1_357_468_564, 567_453_479, 172_445_937, 40_776_756, 7_859_461, 1_276_002, 178_759, 22_010, 2_416, 239, 22)
#: Rows of a score range, draws of a block, rows of a step of the kernel.
RANGE_ROWS, BLOCK, STEP = 20_000, 500, 16
#: How many standard deviations about its expectation a draw's label threshold is looked for.
_SIGMAS = 8.0


def mix(unit, draw, seed: int):
    """A hash of integers below 2^31; arrays broadcast."""
    x = (unit % _P * 48_271 + draw * 69_621 + seed * 16_807 + 11) % _P
    for shift, factor in _ROUNDS:
        x = (x ^ (x >> shift)) * factor
        # the remainder by 2^31 - 1, folded
        x = (x & _P) + (x >> 31)
        x = (x & _P) + (x >> 31)
        x = x - _P * (x >= _P)
    return x


def mix_column(unit: Column, draw: Column, seed: int) -> Column:
    """The same of long columns, without Python."""
    x = (unit % _P * 48_271 + draw * 69_621 + F.lit(seed * 16_807 + 11).cast("long")) % _P
    for shift, factor in _ROUNDS:
        x = x.bitwiseXOR(F.shiftright(x, shift)) * F.lit(factor).cast("long") % _P
    return x


def key_column(unit: Column, draw: Column, seed: int) -> Column:
    return mix_column(unit, draw, seed + 1) * F.lit(2**31).cast("long") + mix_column(unit, draw, seed + 2)


def mix_sql(source: str, unit: str, draw: str, seed: int, out: str) -> str:
    """DuckDB: the rows of ``source`` with the same hash as column ``out``."""
    q = f"SELECT *, (({unit}) % {_P} * 48271 + ({draw}) * 69621 + {seed * 16_807 + 11}) % {_P} AS {out} FROM {source}"
    for shift, factor in _ROUNDS:
        q = f"SELECT * REPLACE (xor({out}, {out} >> {shift}) * {factor} % {_P} AS {out}) FROM ({q})"
    return f"({q})"


def counts(unit, draw, seed: int) -> np.ndarray:
    """How often a draw takes a unit."""
    x = mix(unit, draw, seed).astype(np.int32)
    w = (x < _TAILS[0]).view(np.uint8)
    for t in _TAILS[1:]:
        w += (x < t).view(np.uint8)
    return w.astype(np.float32)


def counts_sql(source: str, unit: str, draw: str, seed: int) -> str:
    return f"(SELECT *, {' + '.join(f'(x < {t})::INT' for t in _TAILS)} AS w FROM {mix_sql(source, unit, draw, seed, 'x')})"


def keys(unit, draw, seed: int):
    """Sort keys of a permutation."""
    return mix(unit, draw, seed + 1) * 2**31 + mix(unit, draw, seed + 2)


def keys_sql(source: str, unit: str, draw: str, seed: int) -> str:
    return f"(SELECT *, x * 2147483648 + y AS key FROM {mix_sql(mix_sql(source, unit, draw, seed + 1, 'x'), unit, draw, seed + 2, 'y')})"


def _tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ranged(rows: DataFrame, score: str, by: list[str]) -> DataFrame:
    """``rows`` with ``__range``: cut at approximate quantiles of all scores, about RANGE_ROWS to a range."""
    n = rows.count()
    number = max(1, -(-n // RANGE_ROWS), min(n // 200, _tasks(rows)))
    if number == 1:
        return rows.withColumn("__range", F.lit(0))
    cuts = rows.approxQuantile(score, [i / number for i in range(1, number)], min(0.01, 0.2 / number))
    chosen = F.array(*map(F.lit, sorted(set(cuts))))
    return rows.withColumn("__range", F.size(F.filter(chosen, lambda c: c < F.col(score))))


class _Curve:
    """Running counts of all draws along a range in order of score."""

    def __init__(self, draws: int):
        self.p, self.n, self.area = (np.zeros(draws) for _ in range(3))
        self.open_p, self.open_n, self.score = np.zeros(draws), np.zeros(draws), None

    def close(self) -> None:
        self.area += self.open_p * (self.n + self.open_n / 2)
        self.p += self.open_p
        self.n += self.open_n
        self.open_p, self.open_n = np.zeros_like(self.p), np.zeros_like(self.p)

    def add(self, score: np.ndarray, p: np.ndarray, n: np.ndarray) -> None:
        """Weights (rows x draws) of rows in order of score."""
        starts = np.flatnonzero(np.concatenate(([True], score[1:] != score[:-1])))
        p, n = np.add.reduceat(p, starts, axis=0), np.add.reduceat(n, starts, axis=0)
        if self.score is not None and score[0] == self.score:
            self.open_p, self.open_n = self.open_p + p[0], self.open_n + n[0]
            p, n = p[1:], n[1:]
        if len(p):
            self.close()
            before = self.n + np.cumsum(n, axis=0) - n
            self.area += (p[:-1] * (before[:-1] + n[:-1] / 2)).sum(axis=0)
            self.p, self.n = self.p + p[:-1].sum(axis=0), self.n + n[:-1].sum(axis=0)
            self.open_p, self.open_n = p[-1].astype(float), n[-1].astype(float)
        self.score = score[-1]


def draw_aucs(rows: DataFrame, score: str, by: list[str], draws: int, weigh, *columns: str, shared: DataFrame | None = None) -> DataFrame:
    """(by, draw, auc): of each draw; null where a draw has one class only.

    ``weigh(draw, columns...)`` gives the weights (rows x draws) of label 1 and of label 0 from arrays of the columns.
    With ``shared`` (by, thresholds), its first column argument is the key's array: it travels once a range, ahead of
    its rows, and not with every row.
    """
    ranged = _ranged(rows.select(*by, score, *columns), score, by)
    types = dict(rows.dtypes)
    leads = shared is not None
    if leads:
        ahead = ranged.select(*by, "__range").distinct().join(shared, by)
        ranged = ranged.withColumn("thresholds", F.lit(None).cast("array<bigint>")).unionByName(ahead, allowMissingColumns=True)
    # few bytes, but much work: a number of tasks of its own, which is not reduced
    order = [F.col("thresholds").isNull()] if leads else []
    dealt = ranged.repartition(_tasks(rows), *by, "__range").sortWithinPartitions(*by, "__range", *order, score)
    group = [*by, "__range"]
    all_draws = np.arange(draws, dtype=np.int64)[None, :]

    def out(key: dict, c: _Curve, schema: list):
        c.close()
        for at in range(0, draws, BLOCK):
            cut = slice(at, at + BLOCK)
            yield pa.RecordBatch.from_arrays([*[pa.array([key[k]], t) for k, t in zip(group, schema, strict=True)], pa.array([at], pa.int64()), *[pa.array([v[cut].tolist()], pa.list_(pa.float64())) for v in (c.p, c.n, c.area)]], names=[*group, "block", "p", "n", "area"])

    def curves(batches):
        key, curve, schema, common = None, None, [], []
        for batch in batches:
            schema = [batch.schema.field(k).type for k in group]
            names = list(zip(*[batch.column(k).to_pylist() for k in group], strict=True))
            scores = batch.column(score).to_numpy(zero_copy_only=False)
            given = {c: batch.column(c) for c in columns}
            ahead = batch.column("thresholds").is_valid().to_pylist() if leads else [False] * len(names)
            at = 0
            while at < len(names):
                stop = at + 1
                while not ahead[at] and stop < len(names) and stop - at < STEP and names[stop] == names[at]:
                    stop += 1
                if names[at] != key:
                    if curve is not None:
                        yield from out(dict(zip(group, key, strict=True)), curve, schema)
                    key, curve = names[at], _Curve(draws)
                if ahead[at]:
                    common = [batch.column("thresholds")[at].values.to_numpy()]
                    at = stop
                    continue
                p, n = weigh(all_draws, *common, *[given[c].slice(at, stop - at) for c in columns])
                curve.add(scores[at:stop], p, n)
                at = stop
        if curve is not None:
            yield from out(dict(zip(group, key, strict=True)), curve, schema)

    found = dealt.mapInArrow(curves, ", ".join(f"`{k}` {types[k]}" for k in by) + ", __range int, block long, p array<double>, n array<double>, area array<double>")

    def joined(batches):
        for batch in batches:
            rows_ = batch.column("r").to_pylist()
            aucs = []
            for parts in rows_:
                p, n, area = (np.array([r[c] for r in parts]) for c in ("p", "n", "area"))
                total = (area + p * (np.cumsum(n, axis=0) - n)).sum(axis=0)
                down = p.sum(axis=0) * n.sum(axis=0)
                aucs.append(np.where(down > 0, total / np.where(down > 0, down, 1), np.nan))
            lengths = [len(a) for a in aucs]
            take = pa.array(np.repeat(np.arange(len(aucs)), lengths))
            draw = np.concatenate([b + np.arange(n) for b, n in zip(batch.column("block").to_pylist(), lengths, strict=True)]) if aucs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in by], pa.array(draw.astype(np.int64)), pa.array(np.concatenate(aucs) if aucs else np.zeros(0))], names=[*by, "draw", "auc"])

    blocks = found.groupBy(*by, "block").agg(F.sort_array(F.collect_list(F.struct("__range", "p", "n", "area"))).alias("r"))
    aucs = blocks.mapInArrow(joined, ", ".join(f"`{k}` {types[k]}" for k in by) + ", draw long, auc double")
    return aucs.withColumn("auc", F.when(~F.isnan("auc"), F.col("auc")))


def _integers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)[:, None]


def bootstrap_aucs(rows: DataFrame, truth: str, score: str, unit: str, by: list[str], draws: int, seed: int = 42) -> DataFrame:
    """AUC of each draw; a unit's rows are drawn together."""

    def weigh(draw, t, u):
        w, t = counts(_integers(u), draw, seed), _integers(t)
        return w * t, w * (1 - t)

    return draw_aucs(rows, score, by, draws, weigh, truth, unit)


def label_thresholds(rows: DataFrame, truth: str, unit: str, by: list[str], draws: int, seed: int = 42) -> DataFrame:
    """(by, thresholds): by draw the key up to which units get label 1, so that as many do as had it.

    Keys are uniform, so the threshold is near the share of label 1: keys below that stretch are counted, and those
    within it, about the square root of the rows, are sorted by (by, draw).
    """
    sizes = rows.groupBy(*by).agg(F.count("*").alias("__n"), F.sum(F.col(truth).cast("long")).alias("__p"))
    q = F.col("__p") / F.col("__n")
    # at least a whole row's share to each side
    reach = _SIGMAS * F.sqrt((q * (1 - q) + 1 / F.col("__n")) / F.col("__n")) + 2 / F.col("__n")
    ends = sizes.select(*by, "__p", F.greatest(q - reach, F.lit(0.0)).alias("__low"), F.least(q + reach, F.lit(1.0)).alias("__high"))
    types = dict(rows.dtypes)
    all_draws = np.arange(draws, dtype=np.int64)[None, :]

    def near(batches):
        # keys below the stretch are counted by task, so that a row gives only the few keys within it
        under: dict[tuple, np.ndarray] = {}
        kinds = []
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in by]
            parts: dict[tuple, list] = {}
            for at in range(0, batch.num_rows, STEP):
                b = batch.slice(at, STEP)
                k = keys(_integers(b.column(unit)), all_draws, seed)
                low, high = (np.floor(b.column(c).to_numpy(zero_copy_only=False)[:, None] * 2.0**62) for c in ("__low", "__high"))
                below, within = k < low, (k >= low) & (k <= high)
                names = list(zip(*[b.column(c).to_pylist() for c in by], strict=True))
                for name in dict.fromkeys(names):
                    mine = np.array([n == name for n in names])
                    row, draw = np.nonzero(within & mine[:, None])
                    under.setdefault(name, np.zeros(draws, np.int64))
                    under[name] += below[mine].sum(axis=0)
                    parts.setdefault(name, []).append((draw, k[row, draw]))
            for name, pairs in parts.items():
                yield cells(name, kinds, np.concatenate([d for d, _ in pairs]), None, np.concatenate([v for _, v in pairs]))
        for name, counted in under.items():
            yield cells(name, kinds, all_draws[0], counted, None)

    def cells(name, kinds, draw, below, key):
        n = len(draw)
        given = [pa.array(v) if v is not None else pa.nulls(n, pa.int64()) for v in (draw.astype(np.int64), below, key)]
        return pa.RecordBatch.from_arrays([*[pa.array([v] * n, t) for v, t in zip(name, kinds, strict=True)], *given], names=[*by, "draw", "below", "key"])

    # a row a key, as are the thresholds
    found = rows.select(*by, unit).join(F.broadcast(ends), by).repartition(_tasks(rows)).mapInArrow(near, ", ".join(f"`{k}` {types[k]}" for k in by) + ", draw long, below long, key long")
    per = found.groupBy(*by, "draw").agg(F.sum("below").alias("below"), F.sort_array(F.collect_list("key")).alias("keys")).join(ends.select(*by, "__p"), by)
    place = (F.col("__p") - F.col("below")).cast("int")
    inside = (place >= 1) & (place <= F.size("keys"))
    threshold = F.when(F.col("__p") == 0, F.lit(-1)).when(inside, F.try_element_at("keys", place)).otherwise(F.raise_error(F.lit("a label threshold lies outside its stretch")).cast("long"))
    return per.select(*by, "draw", threshold.alias("t")).groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("draw", "t"))), lambda s: s["t"]).alias("thresholds"))


def permuted_aucs(rows: DataFrame, truth: str, score: str, unit: str, by: list[str], draws: int, seed: int = 42) -> DataFrame:
    """AUC of each draw of labels over all units of a key; units don't repeat."""
    given = materialise(label_thresholds(rows, truth, unit, by, draws, seed), "thresholds")

    def weigh(draw, thresholds, u):
        label = (keys(_integers(u), draw, seed) <= thresholds[None, :]).astype(np.float32)
        return label, 1 - label

    return draw_aucs(rows, score, by, draws, weigh, unit, shared=given)


def within_aucs(rows: DataFrame, truth: str, score: str, unit: str, row: str, by: list[str], draws: int, seed: int = 42) -> DataFrame:
    """AUC of each draw when labels change places inside each unit only; ``row`` numbers all rows."""
    cells = rows.groupBy(*by, unit).agg(F.collect_list(F.struct(row, score)).alias("m"), F.sum(F.col(truth).cast("long")).alias("__p"))
    alone = cells.select(*by, "__p", F.explode("m").alias("s"), F.transform("m", lambda s: s[row]).alias("mates")).select(*by, "__p", f"s.{row}", f"s.{score}", "mates")

    def weigh(draw, own, mates, p):
        k = keys(_integers(own), draw, seed)
        ends, values = mates.offsets.to_numpy(), mates.values.to_numpy()
        rank = np.zeros(k.shape, np.int64)
        # a row's place among its unit's keys
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            for m in values[a:b]:
                rank[i] += (keys(np.int64(m), draw, seed) < k[i])[0]
        label = (rank < _integers(p)).astype(np.float32)
        return label, 1 - label

    return draw_aucs(alone, score, by, draws, weigh, row, "mates", "__p")


def interval(draws: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, ci_low, ci_high): the middle 95 of 100 draws."""
    return draws.groupBy(*by).agg(F.percentile(value, 0.025).alias("ci_low"), F.percentile(value, 0.975).alias("ci_high"))


def share_at_least(draws: DataFrame, observed: DataFrame, by: list[str], plus_one: bool = False) -> DataFrame:
    """(by, p): the share of draws not below the observed AUC, or with one added to both counts."""
    hit = F.sum((F.round("auc", 12) >= F.round("observed", 12)).cast("long"))
    p = (hit + 1) / (F.count("auc") + 1) if plus_one else hit / F.count("auc")
    return draws.join(observed.select(*by, F.col("auc").alias("observed")), by).groupBy(*by).agg(p.alias("p"))


def pooled(rows: DataFrame, truth: str, score: str, unit: str, by: list[str], bootstraps: int = 10_000, permutations: int = 5_000, seed: int = 42) -> DataFrame:
    """(by, n, auc, ci_low, ci_high, p), as ``resample.pooled_stats``; one-class draws are left out."""
    from .metrics import rank_auc

    rows = materialise(rows.select(*by, unit, F.col(truth).cast("int").alias(truth), F.col(score).cast("double").alias(score)), "rows")
    seen = materialise(rank_auc(rows, F.col(truth) == 1, score, *by).select(*by, (F.col("n_pos") + F.col("n_neg")).alias("n"), "auc"), "seen")
    ci = interval(bootstrap_aucs(rows, truth, score, unit, by, bootstraps, seed), "auc", *by)
    p = share_at_least(permuted_aucs(rows, truth, score, unit, by, permutations, seed), seen, by)
    return seen.join(ci, by).join(p, by)


def paired(pairs: DataFrame, truth: str, a: str, b: str, unit: str, by: list[str], draws: int = 10_000, seed: int = 42) -> DataFrame:
    """(by, n, diff, ci_low, ci_high, p): both scores of a pair are drawn together; p is twice the smaller tail, at most 1."""
    from .metrics import rank_auc

    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).cast("double").alias("score")) for s, c in (("a", a), ("b", b))])
    long = materialise(pairs.select(*by, unit, F.col(truth).cast("int").alias(truth), F.explode(sides).alias("s")).select(*by, unit, truth, "s.side", "s.score"), "pairs")
    both = lambda df, *more: df.groupBy(*by, *more).pivot("side", ["a", "b"]).agg(F.first("auc")).withColumn("d", F.round(F.col("a") - F.col("b"), 12))
    seen = both(rank_auc(long, F.col(truth) == 1, "score", *by, "side")).select(*by, F.col("d").alias("diff"))
    n = pairs.groupBy(*by).agg(F.count("*").alias("n"))
    d = both(bootstrap_aucs(long, truth, "score", unit, [*by, "side"], draws, seed), "draw").filter("d IS NOT NULL")
    tails = d.groupBy(*by).agg(F.percentile("d", 0.025).alias("ci_low"), F.percentile("d", 0.975).alias("ci_high"), F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double")))).alias("p"))
    return n.join(seen, by).join(tails, by)


def accuracy(rows: DataFrame, correct: str, unit: str, by: list[str], baseline: float, draws: int = 2_000, seed: int = 42) -> DataFrame:
    """(by, accuracy, ci_low, ci_high, better): weighted means by draw, added up by task before the shuffle."""
    types = dict(rows.dtypes)
    all_draws = np.arange(draws, dtype=np.int64)[None, :]

    def sums(batches):
        total: dict[tuple, list[np.ndarray]] = {}
        kinds = []
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in by]
            for at in range(0, batch.num_rows, STEP):
                b = batch.slice(at, STEP)
                w, c = counts(_integers(b.column(unit)), all_draws, seed), b.column(correct).to_numpy(zero_copy_only=False).astype(float)[:, None]
                names = list(zip(*[b.column(k).to_pylist() for k in by], strict=True))
                for name in dict.fromkeys(names):
                    mine = np.array([n == name for n in names])
                    held = total.setdefault(name, [np.zeros(draws), np.zeros(draws)])
                    held[0] += (w[mine] * c[mine]).sum(axis=0)
                    held[1] += w[mine].sum(axis=0, dtype=float)
        for name, (hit, n) in total.items():
            yield pa.RecordBatch.from_arrays([*[pa.array([v] * draws, t) for v, t in zip(name, kinds, strict=True)], pa.array(np.arange(draws)), pa.array(hit), pa.array(n)], names=[*by, "draw", "hit", "n"])

    found = rows.select(*by, unit, correct).mapInArrow(sums, ", ".join(f"`{k}` {types[k]}" for k in by) + ", draw long, hit double, n double")
    means = found.groupBy(*by, "draw").agg(F.try_divide(F.sum("hit"), F.sum("n")).alias("m"))
    seen = rows.groupBy(*by).agg(F.avg(correct).alias("accuracy"))
    return seen.join(interval(means, "m", *by), by).withColumn("better", F.col("ci_low") > baseline)
