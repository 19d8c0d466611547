"""Queries that resample, fit models or run kernels; SQL can't express most of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import coherence, cohorts, fits, kernels, metrics, models, resample
from .catalogue import query
from .predictions import _round
from .standins import ARMS, PROFILE, SIGNALS, arms, profile, signals, table

KEYS = ["subject_id", "condition", "channel"]


@query("pooled_stats")
def pooled_stats(spark, d):
    return resample.pooled_stats(arms(spark, d), "truth", "p", "arm", "subject_id")


@query("paired_bootstrap")
def paired_bootstrap(spark, d):
    pairs = metrics.checked_truth(metrics.arm_pairs(arms(spark, d)))
    return resample.paired_bootstrap(pairs, "truth", "p_a", "p_b", ["arm_a", "arm_b"], "subject_id")


def _paired_units(spark, d):
    """Two scored rows per user: the mean of clicks is the task, of views the rest."""
    e = table(spark, d, "events").filter("event_type IN ('click', 'view')")
    return e.groupBy("user_id", "event_type").agg(F.avg("value").alias("p")).select(F.lit("all").alias("arm"), F.col("user_id").alias("unit"), (F.col("event_type") == "click").cast("int").alias("truth"), F.round("p", 9).alias("p"))


@query("cluster_bootstrap")
def cluster_bootstrap(spark, d):
    return resample.cluster_bootstrap(_paired_units(spark, d), "truth", "p", "unit", "arm")


@query("within_subject_perm")
def within_subject_perm(spark, d):
    return resample.within_subject_permutation(_paired_units(spark, d), "truth", "p", "unit", "arm")


@query("accuracy_bootstrap")
def accuracy_bootstrap(spark, d):
    rows = arms(spark, d).withColumn("correct", ((F.col("p") >= 0.5) == (F.col("truth") == 1)).cast("double"))
    return resample.accuracy_bootstrap(rows, "correct", "arm", 0.758)


@query("changepoint_perm")
def changepoint_perm(spark, d):
    return resample.changepoint_permutation(profile(spark, d), "value", "i", "user_id")


_MW = """r AS (SELECT truth, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS k FROM arms WHERE arm = 'hash'),
t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY p)),
s AS (SELECT CAST(sum(truth) AS BIGINT) AS n_a, CAST(sum(1 - truth) AS BIGINT) AS n_b, CAST(sum(truth * k) - sum(truth) * (sum(truth) + 1) / 2.0 AS DOUBLE) AS u FROM r),
z AS (SELECT n_a, n_b, u, (u - n_a * n_b / 2.0 - 0.5 * sign(u - n_a * n_b / 2.0)) / sqrt(n_a * n_b / 12.0 * (n_a + n_b + 1 - ties / ((n_a + n_b) * (n_a + n_b - 1.0)))) AS z FROM s, t)
SELECT n_a, n_b, u, z, {tail} AS p FROM z"""
#: The two tails of the normal distribution beyond z, by Simpson's rule.
_TAIL = "greatest(0, 1 - sqrt(2 / pi()) * abs(z) / 6000 * (SELECT sum(exp(-0.5 * pow(abs(z) * i / 2000, 2)) * CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) FROM range(2001) r(i)))"


@query("mann_whitney", f"WITH {ARMS}, {_MW.format(tail=f'round({_TAIL}, 6)')}")
def mann_whitney(spark, d):
    return resample.mann_whitney(arms(spark, d).filter("arm = 'hash'"), "truth", "p").withColumn("p", F.round("p", 6))


#: Counts of signed-rank sums of up to 50 ranks.
_SUMS = "sums AS (SELECT 0 AS step, 0 AS v, 1::DOUBLE AS c UNION ALL SELECT step + 1, v + add * (step + 1), sum(c) FROM sums, (VALUES (0), (1)) a(add) WHERE step < 50 GROUP BY step, v + add * (step + 1))"


@query("wilcoxon", f"""WITH RECURSIVE {_SUMS}, m AS (SELECT user_id, round(avg(value) FILTER (event_type = 'click') - avg(value) FILTER (event_type = 'view'), 6) AS x FROM events GROUP BY 1),
r AS (SELECT x, rank() OVER (ORDER BY abs(x)) + (count(*) OVER (PARTITION BY abs(x)) - 1) / 2.0 AS k FROM m WHERE x <> 0), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM m WHERE x <> 0 GROUP BY abs(x))),
s AS (SELECT count(*) AS n, CAST(sum(k) FILTER (x > 0) AS DOUBLE) AS w FROM r),
z AS (SELECT n, w, (w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48) AS z, ties = 0 AND n <= 50 AS exact FROM s, t),
e AS (SELECT sum((v <= (SELECT w FROM z))::INT * c) / sum(c) AS low, sum((v >= (SELECT w FROM z))::INT * c) / sum(c) AS high FROM sums WHERE step = (SELECT n FROM z))
SELECT n, w, z, round(CASE WHEN exact THEN least(1, 2 * least(low, high)) ELSE {_TAIL} END, 6) AS p FROM z, e""")
def wilcoxon(spark, d):
    m = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.avg("value"))
    return resample.wilcoxon(m.select(F.round(F.col("click") - F.col("view"), 6).alias("x")), "x").withColumn("p", F.round("p", 6))


def _few(spark, d):
    """The first 10 events of each user; clicks against the others."""
    return profile(spark, d).filter("i < 10").select("user_id", (F.col("event_type") == "click").cast("int").alias("g"), F.round("value", 0).alias("v"))


_FEW = f"""{PROFILE}, few AS (SELECT user_id, (event_type = 'click')::INT AS g, round(value, 0) AS v FROM profile WHERE i < 10),
r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY v) + (count(*) OVER (PARTITION BY user_id, v) - 1) / 2.0 AS k, row_number() OVER (PARTITION BY user_id ORDER BY v, g) - 1 AS j FROM few)"""


@query("mann_whitney_exact", f"""WITH {_FEW}, s AS (SELECT user_id, count(*) AS n, sum(g) AS n_a, sum(k * g) AS seen FROM r GROUP BY 1 HAVING sum(g) BETWEEN 1 AND count(*) - 1),
every AS (SELECT s.user_id, m, sum(k) AS v FROM s JOIN r USING (user_id), range(1024) t(m) WHERE m < (1 << n) AND bit_count(m) = n_a AND (m >> j) & 1 = 1 GROUP BY ALL),
p AS (SELECT user_id, avg((v <= seen)::INT) AS low, avg((v >= seen)::INT) AS high FROM every JOIN s USING (user_id) GROUP BY 1)
SELECT user_id, n_a::BIGINT AS n_a, (n - n_a)::BIGINT AS n_b, (seen - n_a * (n_a + 1) / 2)::DOUBLE AS u, round(least(1, 2 * least(low, high)), 9) AS p FROM s JOIN p USING (user_id)""")
def mann_whitney_exact(spark, d):
    """Against all choices of as many ranks."""
    return _round(resample.exact_rank_sums(_few(spark, d), "g", "v", "user_id"), "p", digits=9)


@query("wilcoxon_exact", f"""WITH {PROFILE}, few AS (SELECT user_id, round(value, 0) - 50 AS d FROM profile WHERE i < 10), x AS (SELECT *, abs(d) AS v FROM few WHERE d <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY v) + (count(*) OVER (PARTITION BY user_id, v) - 1) / 2.0 AS k, row_number() OVER (PARTITION BY user_id ORDER BY v) - 1 AS j FROM x),
s AS (SELECT user_id, count(*) AS n, coalesce(sum(k) FILTER (d > 0), 0) AS w FROM r GROUP BY 1),
every AS (SELECT s.user_id, m, sum(k * ((m >> j) & 1)) AS v FROM s JOIN r USING (user_id), range(1024) t(m) WHERE m < (1 << n) GROUP BY ALL),
p AS (SELECT user_id, avg((v <= w)::INT) AS low, avg((v >= w)::INT) AS high FROM every JOIN s USING (user_id) GROUP BY 1)
SELECT user_id, n, w::DOUBLE AS w, round(least(1, 2 * least(low, high)), 9) AS p FROM s JOIN p USING (user_id)""")
def wilcoxon_exact(spark, d):
    """Against all choices of signs."""
    rows = profile(spark, d).filter("i < 10").select("user_id", (F.round("value", 0) - 50).alias("d"))
    return _round(resample.exact_signed_ranks(rows, "d", "user_id"), "p", digits=9)


@query("mcnemar_exact")
def mcnemar_exact(spark, d):
    pairs = metrics.checked_truth(metrics.arm_pairs(arms(spark, d))).withColumns({c: (F.col(f"p_{c}") >= 0.5) == (F.col("truth") == 1) for c in "ab"})
    counts = pairs.groupBy("arm_a", "arm_b").agg(*metrics.kappa(F.col("a"), F.col("b"))).select("arm_a", "arm_b", "only_a", "only_b")

    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([resample.binomial_two_sided(int(min(x, y)), int(x + y)) for x, y in zip(a, b, strict=True)])

    return counts.withColumn("p", p("only_a", "only_b"))


def _feature_table(spark, d):
    """All labelled documents as subjects: six numeric features, folds, and quality as truth."""
    t = F.col("text")
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    rows = docs.select(
        F.col("doc_id").alias("subject_id"),
        F.col("quality").alias("group"),
        F.log1p(F.length(t).cast("double")).alias("f0"),
        F.try_divide(F.regexp_count(t, F.lit("[|#$%&]")).cast("double"), F.length(t).cast("double")).alias("f1"),
        F.try_divide(F.regexp_count(t, F.lit("[A-Z]")).cast("double"), F.length(t).cast("double")).alias("f2"),
        F.try_divide(F.size(F.array_distinct(F.split(t, " "))).cast("double"), F.size(F.split(t, " ")).cast("double")).alias("f3"),
        F.when(F.col("doc_id") % 10 != 0, F.regexp_count(t, F.lit("\n")).cast("double")).alias("f4"),
        F.pmod(F.hash("doc_id"), F.lit(97)).cast("double").alias("f5"),
    )
    return cohorts.stratified_split(rows, test_share=0.1).withColumnsRenamed({"split": "fold", "group": "truth"}).withColumn("arm", F.lit("engineered"))


FEATURES = [f"f{i}" for i in range(6)]


def _arrays(table_, *names):
    return table_.withColumn("x", F.array(*[F.col(n).cast("double") for n in names])).select("arm", "subject_id", "fold", F.col("truth").cast("int").alias("truth"), "x")


@query("logreg_oof")
def logreg_oof(spark, d):
    rows = _arrays(_feature_table(spark, d), *FEATURES)
    return _round(fits.out_of_fold(fits.leave_one_out(rows, "fold", "arm"), "arm"), "prob", digits=6)


_FOLDS = """base AS (SELECT doc_id AS subject_id, quality AS truth, text AS t, doc_id FROM documents JOIN labels USING (doc_id)),
x AS (SELECT subject_id, truth, md5(subject_id::VARCHAR || ':42') AS h, ln(1 + length(t)) AS f0, length(t) AS n, CASE WHEN doc_id % 10 <> 0 THEN length(t) - length(replace(t, chr(10), '')) END::DOUBLE AS f4 FROM base),
o AS (SELECT *, row_number() OVER (PARTITION BY truth ORDER BY h, subject_id) - 1 AS i, count(*) OVER (PARTITION BY truth) AS c FROM x),
s AS (SELECT *, CASE WHEN i < ceil(c * 0.1) THEN 'test' ELSE 'fold_' || ((i - ceil(c * 0.1)::BIGINT) % 5)::VARCHAR END AS fold FROM o),
long AS (SELECT fold, 0 AS p, f0 AS v FROM s WHERE fold <> 'test' UNION ALL SELECT fold, 4, f4 FROM s WHERE fold <> 'test'),
dealt AS (SELECT f.fold AS out, p, v FROM long l, (SELECT DISTINCT fold FROM long) f WHERE f.fold <> l.fold),
m AS (SELECT out, p, coalesce(median(v), 0) AS median FROM dealt GROUP BY ALL)"""


@query("fold_statistics", f"WITH {_FOLDS} SELECT out, p AS feature, round(any_value(median), 6) AS median, round(avg(coalesce(v, median)), 6) AS mean, round(CASE WHEN stddev_pop(coalesce(v, median)) > 1e-12 THEN stddev_pop(coalesce(v, median)) ELSE 1 END, 6) AS sd FROM dealt JOIN m USING (out, p) GROUP BY out, p")
def fold_statistics(spark, d):
    """What each left-out fold's model imputes and scales by, of the text's length and its lines."""
    dealt = fits.leave_one_out(_arrays(_feature_table(spark, d), *FEATURES), "fold", "arm")
    stats = fits.statistics(dealt.filter("role = 'learn'"), "arm", "out")
    long = stats.select("out", F.posexplode(F.arrays_zip("median", "mean", "sd")).alias("feature", "s")).select("out", "feature", "s.*").filter("feature IN (0, 4)")
    return _round(long, "median", "mean", "sd")


KERNEL_FOLDS = [f"fold_{i}" for i in range(5)]
KERNEL_GRID = [(k, c) for k in (10, 20, 40, 80) for c in (0.1, 1.0, 10.0)]


@query("kernel_oof")
def kernel_oof(spark, d):
    """Nested folds over all subjects of the signals: 120 amplitudes, by channel, condition and quarter, the whole grid."""
    from ..operators import signals as sig
    from .standins import CHANNEL_NAMES, CONDITIONS

    names = [f"{c}_{k}" for c in CHANNEL_NAMES for k in CONDITIONS]
    quarters = F.transform(sig.windows("samples", 16), lambda w: F.array_max(w["samples"]) - F.array_min(w["samples"]))
    long = signals(spark, d).select("subject_id", F.concat_ws("_", "channel", "condition").alias("name"), F.concat(F.array(sig.peak_to_peak()), quarters).alias("v"))
    wide = long.groupBy("subject_id").pivot("name", names).agg(F.first("v"))
    none = F.array(*[F.lit(None).cast("double")] * 5)
    rows = wide.select("subject_id", (F.col("subject_id") % 2).cast("int").alias("truth"), F.concat(*[F.coalesce(F.col(n), none) for n in names]).alias("x"))
    folds = cohorts.stratified_split(rows, group="truth", test_share=0.1, folds=5).withColumnRenamed("split", "fold").withColumn("arm", F.lit("amplitudes"))
    return _round(models.nested_grid(folds, "arm", KERNEL_GRID, KERNEL_FOLDS), "prob", digits=6)


@query("fusion_oof")
def fusion_oof(spark, d):
    """Features joined with another arm's predictions, scaled and not, and scaled features alone."""
    other = arms(spark, d).filter("arm = 'length'").select("subject_id", F.col("p").alias("f6"))
    base = _feature_table(spark, d).join(other, "subject_id")
    fused = lambda arm, *names: _arrays(base.withColumn("arm", F.lit(arm)), *FEATURES, *names)
    dealt = fits.leave_one_out(fused("scaled", "f6").unionByName(fused("features")), "fold", "arm")
    plain = fits.leave_one_out(fused("unscaled", "f6"), "fold", "arm")
    return _round(fits.out_of_fold(dealt, "arm").unionByName(fits.out_of_fold(plain, "arm", scale=False)), "prob", digits=6)


@query("holdout_once")
def holdout_once(spark, d):
    """Learnt on all folds, scored once on the test split."""
    rows = _arrays(_feature_table(spark, d), *FEATURES)
    return _round(fits.out_of_fold(fits.train_and_test(rows, "fold", "arm"), "arm"), "prob", digits=6)


@query("transfer_oof")
def transfer_oof(spark, d):
    """Learnt on folds 0 to 2, scored on the others, each side standardised by itself."""
    rows = _arrays(_feature_table(spark, d), *FEATURES).withColumn("here", F.col("fold").isin("fold_0", "fold_1", "fold_2"))
    return _round(fits.transfer(rows, "here", "arm"), "prob", digits=6)


@query("scalogram_rgb")
def scalogram_rgb(spark, d):
    """Mean colour of each signal's encoded scalogram, and the length of its image file."""

    @F.pandas_udf("red double, green double, blue double, bytes long")
    def encode(samples: pd.Series) -> pd.DataFrame:
        freqs = np.linspace(2, 30, 24)
        images = [kernels.scalogram_rgb(np.abs(kernels.morlet(np.asarray(v, float), 64.0, freqs)) * 100, freqs) for v in samples]
        means = np.array([i.reshape(-1, 3).mean(axis=0) for i in images]).reshape(-1, 3)
        return pd.DataFrame({"red": means[:, 0], "green": means[:, 1], "blue": means[:, 2], "bytes": [len(kernels.png(i)) for i in images]})

    return signals(spark, d).select("signal_id", encode("samples").alias("e")).select("signal_id", "e.*")


_BANDS = {"theta": (4, 8), "alpha": (8, 12), "beta": (12, 30)}
_TAPERS = ", ".join(f"({t}, {i}, {v!r})" for t, row in enumerate(kernels.dpss(32).tolist()) for i, v in enumerate(row))


@query("imag_coherence", f"""WITH {SIGNALS}, seg AS (SELECT subject_id, condition, channel, w, samples[w * 16 + 1 : w * 16 + 32] AS s FROM signals, range(3) r(w)),
pt AS (SELECT subject_id, condition, channel, w, generate_subscripts(s, 1) - 1 AS i, unnest(s) - list_avg(s) AS y FROM seg), tp AS (SELECT * FROM (VALUES {_TAPERS}) v(t, i, h)),
z AS (SELECT subject_id, condition, channel, w, t, f, sum(y * h * cos(2 * pi() * f * i / 32)) AS re, -sum(y * h * sin(2 * pi() * f * i / 32)) AS im FROM pt JOIN tp USING (i), range(2, 16) r(f) GROUP BY ALL),
p AS (SELECT subject_id, condition, channel, f, sum(re * re + im * im) AS p FROM z GROUP BY ALL),
x AS (SELECT a.subject_id, a.condition, a.channel AS a, b.channel AS b, a.f, sum(a.im * b.re - a.re * b.im) AS c FROM z a JOIN z b ON a.subject_id = b.subject_id AND a.condition = b.condition AND a.w = b.w AND a.t = b.t AND a.f = b.f AND a.channel < b.channel GROUP BY ALL),
q AS (SELECT x.*, abs(c / sqrt(pa.p * pb.p)) AS q FROM x JOIN p pa ON pa.subject_id = x.subject_id AND pa.condition = x.condition AND pa.channel = a AND pa.f = x.f JOIN p pb ON pb.subject_id = x.subject_id AND pb.condition = x.condition AND pb.channel = b AND pb.f = x.f)
SELECT subject_id, condition, a, b, band, round(avg(q), 9) AS value FROM q JOIN (VALUES ('theta', 4, 8), ('alpha', 8, 12), ('beta', 12, 30)) n(band, lo, hi) ON f * 2 BETWEEN lo AND hi GROUP BY ALL""")
def imag_coherence(spark, d):
    return _round(coherence.imaginary_coherence(signals(spark, d), 64.0, 32, 16, _BANDS, "subject_id", "condition"), "value", digits=9)


@query("filtered_power")
def filtered_power(spark, d):
    """Variance before and after a 2 to 20 Hz band-pass."""
    h = kernels.fir(64.0, 2.0, 20.0, transition=4.0)
    out = kernels.map_signal(signals(spark, d), lambda x: kernels.zero_phase(x, h), "signal_id")
    return out.select("signal_id", F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x).alias("energy"))


_OAS = """c AS (SELECT subject_id, condition, channel, list_transform(samples, lambda v: v - list_avg(samples)) AS y FROM signals),
s AS (SELECT a.subject_id, a.condition, a.channel AS a, b.channel AS b, list_dot_product(a.y, b.y) / 64 AS s FROM c a JOIN c b ON a.subject_id = b.subject_id AND a.condition = b.condition),
k AS (SELECT subject_id, condition, sum(s) FILTER (a = b) / 8 AS mu, avg(s * s) AS alpha FROM s GROUP BY ALL HAVING count(*) = 64),
r AS (SELECT *, CASE WHEN alpha = mu * mu / 8 THEN 1 ELSE least((alpha + mu * mu) / (65 * (alpha - mu * mu / 8)), 1) END AS shrink FROM k)"""


@query("oas_covariance", f"WITH {SIGNALS}, {_OAS} SELECT subject_id, condition, a, b, round((1 - shrink) * s + CASE WHEN a = b THEN shrink * mu ELSE 0 END, 9) AS cov FROM s JOIN r USING (subject_id, condition) WHERE a <= b")
def oas_covariance(spark, d):
    """Shrunk covariances of channel pairs."""
    from .standins import CHANNEL_NAMES

    order = sorted(CHANNEL_NAMES)
    names = F.array(*map(F.lit, order))
    cov = fits.covariances(signals(spark, d), order, "subject_id", "condition").select("subject_id", "condition", F.posexplode("cov").alias("p", "cov"))
    pairs = cov.select("subject_id", "condition", F.get(names, F.floor(F.col("p") / 8).cast("int")).alias("a"), F.get(names, F.col("p") % 8).alias("b"), F.round("cov", 9).alias("cov"))
    return pairs.filter("a <= b")


@query("tangent_space")
def tangent_space(spark, d):
    from .standins import CHANNEL_NAMES

    cov = fits.covariances(signals(spark, d).filter("condition = 'ec'"), CHANNEL_NAMES, "subject_id")
    rows = cov.select("subject_id", "cov", (F.col("subject_id") % 2).cast("int").alias("truth"), F.concat(F.lit("fold_"), (F.floor(F.col("subject_id") / 2) % 3).cast("string")).alias("fold"), F.lit("ec").alias("arm"))
    return _round(fits.tangent_out_of_fold(rows, 8, "arm"), "prob", digits=6)


@query("welch_arrow_matches", "SELECT count(*) AS n, true AS same FROM embeddings")
def welch_arrow_matches(spark, d):
    """The native spectrum and the FFT path agree on every signal."""
    from ..operators import signals as sig

    native = sig.welch(signals(spark, d), 64.0, 32, "signal_id").groupBy("signal_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "psd"))), lambda s: s["psd"]).alias("a"))
    arrow = sig.welch_arrow(signals(spark, d), 64.0, 32, "signal_id")
    gap = F.array_max(F.zip_with("a", "psd", lambda x, y: F.abs(x - y)))
    return native.join(arrow, "signal_id").agg(F.count("*").alias("n"), (F.max(gap) < 1e-12).alias("same"))
