"""Queries over signals: windows, rejection, spectra and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, scalp, signals as sig
from .catalogue import ORACLES, query
from .predictions import _round
from .standins import CHANNEL_NAMES, CONDITIONS, PROFILE, SIGNALS, profile, signals, table

BANDS = {"delta": (1.0, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 12.0), "beta": (12.0, 30.0)}
FS, SEGMENT = 64.0, 32
KEYS = ["subject_id", "condition", "channel"]

_WELCH = """seg AS (SELECT {keys}, w, samples[w * 16 + 1 : w * 16 + 32] AS s FROM signals, range(3) t(w)),
pt AS (SELECT {keys}, w, generate_subscripts(s, 1) - 1 AS i, unnest(s) - list_avg(s) AS y FROM seg),
dft AS (SELECT {keys}, w, k, sum(y * (0.5 - 0.5 * cos(2 * pi() * i / 32)) * cos(2 * pi() * k * i / 32)) AS re, sum(y * (0.5 - 0.5 * cos(2 * pi() * i / 32)) * sin(2 * pi() * k * i / 32)) AS im FROM pt, range(17) u(k) GROUP BY ALL),
spectra AS (SELECT {keys}, k, k * 2.0::DOUBLE AS freq, avg((re * re + im * im) / (64.0 * 12.0) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END) AS psd FROM dft GROUP BY {keys}, k)""".format(keys="subject_id, condition, channel")
_TRAPZ = "(sum(psd) - (arg_min(psd, k) + arg_max(psd, k)) / 2) * 2.0"


def spectra(spark, d):
    return sig.welch(signals(spark, d), FS, SEGMENT, *KEYS)


@query("epoch_windows", f"WITH {SIGNALS} SELECT signal_id, CAST(w AS INTEGER) AS \"window\", round(list_sum(samples[w * 24 + 1 : w * 24 + 24]), 6) AS total FROM signals, range(2) t(w)")
def epoch_windows(spark, d):
    w = sig.explode_windows(signals(spark, d), 24, None, "signal_id")
    return w.select("signal_id", "window", F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("overlap_windows", f"WITH {SIGNALS} SELECT signal_id, CAST(w AS INTEGER) AS \"window\", samples[w * 16 + 1] AS first_sample, samples[w * 16 + 32] AS last_sample FROM signals, range(3) t(w)")
def overlap_windows(spark, d):
    w = sig.explode_windows(signals(spark, d), 32, 16, "signal_id")
    return w.select("signal_id", "window", F.col("samples")[0].alias("first_sample"), F.col("samples")[31].alias("last_sample"))


@query("even_stride_sample", f"WITH {PROFILE}, n AS (SELECT user_id, count(*) AS n FROM profile GROUP BY 1), p AS (SELECT user_id, unnest(CASE WHEN n <= 30 THEN list_transform(range(n), lambda j: j::DOUBLE) ELSE list_transform(range(30), lambda j: round_even(j * (n - 1) / 29.0::DOUBLE, 0)) END)::BIGINT AS i FROM n) SELECT user_id, event_id, CAST(i AS INTEGER) AS pos FROM profile JOIN (SELECT DISTINCT * FROM p) USING (user_id, i)")
def even_stride_sample(spark, d):
    return sig.sample_rows(table(spark, d, "events").select("user_id", "ts", "event_id"), ["ts", "event_id"], 30, "user_id").select("user_id", "event_id", "pos")


@query("even_stride_truncated", f"WITH {PROFILE}, n AS (SELECT user_id, count(*) AS n FROM profile GROUP BY 1), p AS (SELECT user_id, unnest(CASE WHEN n <= 30 THEN list_transform(range(n), lambda j: j::DOUBLE) ELSE list_transform(range(30), lambda j: floor(j * ((n - 1) / 29.0::DOUBLE))) END)::BIGINT AS i FROM n) SELECT user_id, event_id, CAST(i AS INTEGER) AS pos FROM profile JOIN (SELECT DISTINCT * FROM p) USING (user_id, i)")
def even_stride_truncated(spark, d):
    return sig.sample_rows(table(spark, d, "events").select("user_id", "ts", "event_id"), ["ts", "event_id"], 30, "user_id", truncate=True).select("user_id", "event_id", "pos")


@query("decimate", f"WITH {SIGNALS} SELECT signal_id, [samples[i * 4 + 1] for i in range(16)] AS thin FROM signals".replace("SELECT signal_id, [", "SELECT signal_id, array_to_string(list_transform([").replace("] AS thin", "], lambda v: round(v * 1000000)::BIGINT), ',') AS thin"))
def decimate(spark, d):
    thin = F.transform(sig.decimate("samples", 4), lambda v: F.round(v * 1000000).cast("long").cast("string"))
    return signals(spark, d).select("signal_id", F.array_join(thin, ",").alias("thin"))


@query("peak_to_peak", f"WITH {SIGNALS} SELECT signal_id, round(list_max(samples) - list_min(samples), 6) AS p2p FROM signals")
def peak_to_peak(spark, d):
    return signals(spark, d).select("signal_id", F.round(sig.peak_to_peak(), 6).alias("p2p"))


_REJECT = """ep AS (SELECT subject_id, condition, w, max(p) AS worst, NOT bool_or(p > 0.55 OR p < 0.3) AS kept, list_sort(list_distinct(list(channel) FILTER (p > 0.55 OR p < 0.3))) AS culprits
  FROM (SELECT subject_id, condition, channel, w, list_max(samples[w * 16 + 1 : w * 16 + 16]) - list_min(samples[w * 16 + 1 : w * 16 + 16]) AS p FROM signals, range(4) t(w)) GROUP BY 1, 2, 3)"""


def _rejected(spark, d):
    e = sig.explode_windows(signals(spark, d), 16, None, *KEYS)
    return sig.reject(e, 0.55, 0.3, "subject_id", "condition", "window")


@query("reject_epochs", f"WITH {SIGNALS}, {_REJECT} SELECT subject_id, condition, CAST(w AS INTEGER) AS \"window\", round(worst, 6) AS worst, kept, coalesce(array_to_string(culprits, ','), '') AS culprits FROM ep")
def reject_epochs(spark, d):
    return _round(_rejected(spark, d), "worst").withColumn("culprits", F.array_join("culprits", ","))


@query("rejection_rate", f"WITH {SIGNALS}, {_REJECT} SELECT subject_id, condition, count(*) AS n_events, count(*) FILTER (kept) AS n_kept, round(1 - count(*) FILTER (kept) / count(*)::DOUBLE, 6) AS rate FROM ep GROUP BY 1, 2")
def rejection_rate(spark, d):
    return _round(sig.rejection_rate(_rejected(spark, d), "subject_id", "condition"), "rate")


@query("keep_rate_grid", f"WITH {SIGNALS}, {_REJECT} SELECT condition, threshold, round(avg((worst <= threshold)::INT), 6) AS keep_rate FROM ep, (SELECT unnest([0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.8])::DOUBLE AS threshold) GROUP BY 1, 2")
def keep_rate_grid(spark, d):
    return _round(sig.keep_rates(_rejected(spark, d), [0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.8], "condition"), "keep_rate")


@query("culprit_channels", f"WITH {SIGNALS}, {_REJECT} SELECT channel, count(*) AS n FROM (SELECT unnest(culprits) AS channel FROM ep) GROUP BY 1 ORDER BY n DESC, channel LIMIT 3")
def culprit_channels(spark, d):
    c = _rejected(spark, d).select(F.explode("culprits").alias("channel")).groupBy("channel").agg(F.count("*").alias("n"))
    return c.orderBy(F.desc("n"), "channel").limit(3)


@query("median_worst_p2p", f"WITH {SIGNALS}, {_REJECT} SELECT subject_id, condition, CASE WHEN count(*) >= 4 THEN round(median(worst), 6) END AS artifact FROM ep GROUP BY 1, 2")
def median_worst_p2p(spark, d):
    return _rejected(spark, d).groupBy("subject_id", "condition").agg(F.when(F.count("*") >= 4, F.round(F.percentile("worst", 0.5), 6)).alias("artifact"))


@query("welch_psd", f"WITH {SIGNALS}, {_WELCH} SELECT subject_id, condition, channel, CAST(k AS INTEGER) AS k, freq, round(psd, 9) AS psd FROM spectra")
def welch_psd(spark, d):
    return _round(spectra(spark, d), "psd", digits=9)


_BANDED = "banded AS (SELECT * FROM spectra, (VALUES ('delta', 1.0, 4.0), ('theta', 4.0, 8.0), ('alpha', 8.0, 12.0), ('beta', 12.0, 30.0)) b(band, lo, hi) WHERE freq BETWEEN lo AND hi)"


@query("band_power_trapz", f"WITH {SIGNALS}, {_WELCH}, {_BANDED} SELECT subject_id, condition, channel, band, count(*) AS bins, round(CASE WHEN count(*) >= 2 THEN {_TRAPZ} END, 9) AS power FROM banded GROUP BY 1, 2, 3, 4")
def band_power_trapz(spark, d):
    return _round(sig.band_powers(spectra(spark, d), BANDS, *KEYS), "power", digits=9).drop("mean_power")


@query("band_power_mean", f"WITH {SIGNALS}, {_WELCH}, {_BANDED} SELECT subject_id, condition, channel, band, round(avg(psd), 9) AS mean_power FROM banded GROUP BY 1, 2, 3, 4")
def band_power_mean(spark, d):
    return _round(sig.band_powers(spectra(spark, d), BANDS, *KEYS), "mean_power", digits=9).select(*KEYS, "band", "mean_power")


@query("relative_power", f"""WITH {SIGNALS}, {_WELCH}, {_BANDED}, whole AS (SELECT subject_id, condition, channel, {_TRAPZ} AS total FROM spectra WHERE freq BETWEEN 0.5 AND 30 GROUP BY 1, 2, 3),
b AS (SELECT subject_id, condition, channel, band, {_TRAPZ} AS power FROM banded GROUP BY 1, 2, 3, 4) SELECT subject_id, condition, channel, band, round(power / total, 6) AS relpow FROM b JOIN whole USING (subject_id, condition, channel)""")
def relative_power(spark, d):
    return _round(features.relative_power(spectra(spark, d), BANDS, (0.5, 30.0), *KEYS), "relpow")


_MEAN = "mean AS (SELECT subject_id, condition, k, freq, avg(psd) AS psd FROM spectra WHERE channel IN ({}) GROUP BY 1, 2, 3, 4)"
_FRONTAL, _OCCIPITAL = _MEAN.format("'F3', 'F4', 'Fz'"), _MEAN.format("'O1', 'O2'")


@query("tbr", f"WITH {SIGNALS}, {_WELCH}, {_FRONTAL}, t AS (SELECT subject_id, condition, {_TRAPZ} AS theta FROM mean WHERE freq BETWEEN 4 AND 8 GROUP BY 1, 2), b AS (SELECT subject_id, condition, {_TRAPZ} AS beta FROM mean WHERE freq BETWEEN 12 AND 30 GROUP BY 1, 2) SELECT subject_id, condition, round(CASE WHEN beta > 0 THEN theta / beta END, 6) AS tbr FROM t JOIN b USING (subject_id, condition)")
def tbr(spark, d):
    return _round(features.theta_beta_ratio(spectra(spark, d), "subject_id", "condition"), "tbr")


@query("tbr_variants", f"""WITH {SIGNALS}, {_WELCH}, t AS (SELECT subject_id, condition, channel, count(*) AS bins_theta, {_TRAPZ} AS theta, avg(psd) AS m_theta FROM spectra WHERE freq BETWEEN 4 AND 8 GROUP BY 1, 2, 3), b AS (SELECT subject_id, condition, channel, count(*) AS bins_beta, {_TRAPZ} AS beta, avg(psd) AS m_beta FROM spectra WHERE freq BETWEEN 12 AND 30 GROUP BY 1, 2, 3)
SELECT subject_id, condition, channel, '32' AS variant, bins_theta, bins_beta, round(theta / beta, 6) AS ratio_trapz, round(m_theta / m_beta, 6) AS ratio_mean FROM t JOIN b USING (subject_id, condition, channel)""")
def tbr_variants(spark, d):
    return _round(features.theta_beta_variants(spectra(spark, d), "32", *KEYS), "ratio_trapz", "ratio_mean")


@query("iaf", f"WITH {SIGNALS}, {_WELCH}, {_OCCIPITAL} SELECT subject_id, condition, CASE WHEN count(*) >= 3 THEN arg_max(freq, (psd, -freq)) END AS iaf FROM mean WHERE freq BETWEEN 7 AND 13 GROUP BY 1, 2")
def iaf(spark, d):
    return features.peak_frequency(spectra(spark, d), "subject_id", "condition")


@query("aperiodic_fit", f"WITH {SIGNALS}, {_WELCH} SELECT subject_id, condition, channel, round(CASE WHEN count(*) >= 10 THEN -regr_slope(log10(psd), log10(freq)) END, 6) AS exponent, round(CASE WHEN count(*) >= 10 THEN regr_intercept(log10(psd), log10(freq)) END, 6) AS \"offset\" FROM spectra WHERE freq BETWEEN 1 AND 45 AND NOT freq BETWEEN 7 AND 13 AND psd > 0 GROUP BY 1, 2, 3")
def aperiodic_fit(spark, d):
    return _round(features.aperiodic(spectra(spark, d), *KEYS), "exponent", "offset")


@query("asymmetry", f"WITH {SIGNALS}, {_WELCH}, a AS (SELECT subject_id, condition, channel, ln({_TRAPZ}) AS p FROM spectra WHERE channel IN ('F3', 'F4') AND freq BETWEEN 8 AND 12 GROUP BY 1, 2, 3) SELECT subject_id, condition, round(max(p) FILTER (channel = 'F4') - max(p) FILTER (channel = 'F3'), 6) AS asymmetry FROM a GROUP BY 1, 2")
def asymmetry(spark, d):
    return _round(features.alpha_asymmetry(spectra(spark, d), "subject_id", "condition"), "asymmetry")


@query("reactivity", f"WITH {SIGNALS}, {_WELCH}, {_OCCIPITAL}, a AS (SELECT subject_id, condition, ln({_TRAPZ}) AS p FROM mean WHERE freq BETWEEN 8 AND 12 GROUP BY 1, 2) SELECT subject_id, round(max(p) FILTER (condition = 'ec') - max(p) FILTER (condition = 'eo'), 6) AS reactivity FROM a GROUP BY 1")
def reactivity(spark, d):
    return _round(features.reactivity(spectra(spark, d), "subject_id"), "reactivity")


@query("alpha_power", f"WITH {SIGNALS}, {_WELCH}, {_OCCIPITAL} SELECT subject_id, condition, round(avg(psd), 9) AS alpha FROM mean WHERE freq BETWEEN 8 AND 12 GROUP BY 1, 2")
def alpha_power(spark, d):
    rows = spectra(spark, d).filter(F.col("channel").isin("O1", "O2")).groupBy("subject_id", "condition", "k", "freq").agg(F.avg("psd").alias("psd"))
    return rows.filter(F.col("freq").between(8, 12)).groupBy("subject_id", "condition").agg(F.round(F.avg("psd"), 9).alias("alpha"))


@query("channel_corr", f"WITH {SIGNALS}, pt AS (SELECT subject_id, condition, channel, generate_subscripts(samples, 1) AS i, unnest(samples) AS x FROM signals) SELECT a.subject_id, a.condition, a.channel AS a, b.channel AS b, round(corr(a.x, b.x), 6) AS value FROM pt a JOIN pt b ON a.subject_id = b.subject_id AND a.condition = b.condition AND a.i = b.i AND a.channel < b.channel GROUP BY 1, 2, 3, 4")
def channel_corr(spark, d):
    return _round(_edges(spark, d), "value")


def _edges(spark, d):
    a = signals(spark, d).select("subject_id", "condition", "channel", "samples")
    pairs = a.withColumnRenamed("channel", "a").join(a.select("subject_id", "condition", F.col("channel").alias("b"), F.col("samples").alias("y")), ["subject_id", "condition"]).filter("a < b")
    rows = pairs.select("subject_id", "condition", "a", "b", F.explode(F.arrays_zip("samples", "y")).alias("z"))
    return rows.groupBy("subject_id", "condition", "a", "b").agg(F.corr("z.samples", "z.y").alias("value"))


@query("connectivity_features", f"""WITH {SIGNALS}, pt AS (SELECT subject_id, condition, channel, generate_subscripts(samples, 1) AS i, unnest(samples) AS x FROM signals),
e AS (SELECT a.subject_id, a.condition, a.channel AS a, b.channel AS b, corr(a.x, b.x) AS value FROM pt a JOIN pt b ON a.subject_id = b.subject_id AND a.condition = b.condition AND a.i = b.i AND a.channel < b.channel GROUP BY 1, 2, 3, 4),
g AS (SELECT *, map {{'F3': 'frontal', 'F4': 'frontal', 'Fz': 'frontal', 'O1': 'occipital', 'O2': 'occipital', 'T3': 'temporal', 'C3': 'central', 'P3': 'parietal'}} AS m, ['F3', 'O1', 'T3', 'C3', 'P3'] AS l, ['F4', 'O2'] AS r FROM e),
f AS (SELECT subject_id, condition, value, 'coh_' || least(m[a], m[b]) || '_' || greatest(m[a], m[b]) AS feature FROM g
 UNION ALL SELECT subject_id, condition, value, 'intra_left' FROM g WHERE a IN (SELECT unnest(l)) AND b IN (SELECT unnest(l))
 UNION ALL SELECT subject_id, condition, value, 'intra_right' FROM g WHERE a IN (SELECT unnest(r)) AND b IN (SELECT unnest(r))
 UNION ALL SELECT subject_id, condition, value, 'interhemi' FROM g WHERE (list_contains(l, a) AND list_contains(r, b)) OR (list_contains(r, a) AND list_contains(l, b))
 UNION ALL SELECT subject_id, condition, value, 'overall' FROM g)
SELECT subject_id, condition, feature, round(avg(value), 6) AS value FROM f GROUP BY 1, 2, 3""".replace("a IN (SELECT unnest(l)) AND b IN (SELECT unnest(l))", "list_contains(l, a) AND list_contains(l, b)").replace("a IN (SELECT unnest(r)) AND b IN (SELECT unnest(r))", "list_contains(r, a) AND list_contains(r, b)"))
def connectivity_features(spark, d):
    regions = {"frontal": ["F3", "F4", "Fz"], "occipital": ["O1", "O2"], "temporal": ["T3"], "central": ["C3"], "parietal": ["P3"]}
    return _round(features.connectivity_summary(_edges(spark, d), regions, ["F3", "O1", "T3", "C3", "P3"], ["F4", "O2"], "subject_id", "condition"), "value")


@query("average_reference", f"WITH {SIGNALS}, pt AS (SELECT subject_id, condition, channel, generate_subscripts(samples, 1) AS i, unnest(samples) AS x FROM signals), c AS (SELECT *, x - avg(x) OVER (PARTITION BY subject_id, condition, i) AS y FROM pt) SELECT subject_id, condition, channel, round(max(y) - min(y), 6) AS p2p FROM c GROUP BY 1, 2, 3")
def average_reference(spark, d):
    r = sig.average_reference(signals(spark, d), "subject_id", "condition")
    return r.select("subject_id", "condition", "channel", F.round(sig.peak_to_peak(), 6).alias("p2p"))


@query("edge_durations", f"""WITH {PROFILE}, l AS (SELECT *, value > 50 AS on_ FROM profile), r AS (SELECT *, on_ AND NOT coalesce(lag(on_) OVER (PARTITION BY user_id ORDER BY i), false) AS rise FROM l),
g AS (SELECT *, sum(rise::INT) OVER (PARTITION BY user_id ORDER BY i) AS pulse FROM r), p AS (SELECT user_id, pulse, max(i) - min(i) + 1 AS d FROM g WHERE on_ GROUP BY 1, 2)
SELECT user_id, count(*) AS pulses, round(avg(d), 6) AS mean_duration, round(stddev_pop(d), 6) AS sd_duration FROM p GROUP BY 1""")
def edge_durations(spark, d):
    p = sig.edges(profile(spark, d), F.col("value") > 50, "i", "user_id")
    return p.groupBy("user_id").agg(F.count("*").alias("pulses"), F.round(F.avg("duration"), 6).alias("mean_duration"), F.round(F.stddev_pop("duration"), 6).alias("sd_duration"))


@query("row_zscore", f"WITH {SIGNALS}, pt AS (SELECT signal_id, generate_subscripts(samples, 1) - 1 AS i, unnest(samples) AS x FROM signals) SELECT signal_id, CAST(i AS INTEGER) AS i, round(least(greatest((x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0), -3), 3), 6) AS z FROM pt WINDOW w AS (PARTITION BY signal_id)")
def row_zscore(spark, d):
    x = signals(spark, d).select("signal_id", "samples", F.aggregate("samples", F.lit(0.0), lambda a, v: a + v).alias("s"), F.size("samples").alias("n"))
    x = x.withColumn("m", F.col("s") / F.col("n")).withColumn("sd", F.sqrt(F.aggregate("samples", F.lit(0.0), lambda a, v: a + (v - F.col("m")) * (v - F.col("m"))) / F.col("n")))
    return x.select("signal_id", F.posexplode(F.transform("samples", lambda v: F.round(F.least(F.greatest(F.try_divide(v - F.col("m"), F.col("sd")), F.lit(-3.0)), F.lit(3.0)), 6))).alias("i", "z"))


@query("least_windows", f"WITH {SIGNALS}, v AS (SELECT signal_id, samples, 16 + signal_id % 49 AS n FROM signals) SELECT signal_id, CAST(w AS INTEGER) AS \"window\", samples[w * 8 + 1] AS first_sample FROM v, range(7) t(w) WHERE n >= 48 AND w * 8 + 16 <= n")
def least_windows(spark, d):
    """Half-overlapping windows of signals of 16 to 64 samples that have at least five."""
    short = signals(spark, d).withColumn("samples", F.slice("samples", F.lit(1), (16 + F.col("signal_id") % 49).cast("int")))
    return sig.explode_windows(short, 16, 8, "signal_id", least=5).select("signal_id", "window", F.col("samples")[0].alias("first_sample"))


SUBJECT_FEATURES = features.feature_names(CHANNEL_NAMES, list(BANDS), CONDITIONS, ["frontal", "occipital", "temporal", "central", "parietal"], ["all"], CONDITIONS)
_LONG = f"""SELECT subject_id, 'tbr_' || condition AS feature, tbr AS value FROM ({ORACLES["tbr"]})
UNION ALL SELECT subject_id, 'iaf_' || condition, iaf FROM ({ORACLES["iaf"]})
UNION ALL SELECT subject_id, 'aperiodic_' || what || '_' || condition, value FROM (WITH {SIGNALS}, {_WELCH}, m AS (SELECT subject_id, condition, k, freq, avg(psd) AS psd FROM spectra GROUP BY 1, 2, 3, 4), f AS (SELECT subject_id, condition, count(*) AS n, -regr_slope(log10(psd), log10(freq)) AS e, regr_intercept(log10(psd), log10(freq)) AS o FROM m WHERE freq BETWEEN 1 AND 45 AND NOT freq BETWEEN 7 AND 13 AND psd > 0 GROUP BY 1, 2)
  SELECT subject_id, condition, 'exponent' AS what, CASE WHEN n >= 10 THEN e END AS value FROM f UNION ALL SELECT subject_id, condition, 'offset', CASE WHEN n >= 10 THEN o END FROM f)
UNION ALL SELECT subject_id, 'frontal_alpha_asym_' || condition, asymmetry FROM ({ORACLES["asymmetry"]})
UNION ALL SELECT subject_id, 'relpow_' || channel || '_' || band || '_' || condition, relpow FROM ({ORACLES["relative_power"]})
UNION ALL SELECT subject_id, CASE WHEN feature LIKE 'coh%' THEN '' ELSE 'coh_' END || feature || '_all_' || condition, value FROM ({ORACLES["connectivity_features"]})
UNION ALL SELECT subject_id, 'alpha_reactivity', reactivity FROM ({ORACLES["reactivity"]})"""


@query("subject_feature_table", f"WITH long AS ({_LONG}), n AS (SELECT vec_id // 24 AS subject_id, count(*) AS n FROM embeddings GROUP BY 1) SELECT n.subject_id, CASE WHEN n < 24 THEN 'only ' || n || ' of 24 signals' END AS error, " + ", ".join(f"round(max(value) FILTER (feature = '{n}' AND n = 24), 6) AS \"{n}\"" for n in SUBJECT_FEATURES) + ", " + ", ".join(f"NULL::DOUBLE AS {n}" for n in features.PLACEHOLDERS) + " FROM n LEFT JOIN long USING (subject_id) GROUP BY n.subject_id, n")
def subject_feature_table(spark, d):
    """The wide table of all features; a subject that lacks a signal has an error instead."""
    regions = {"frontal": ["F3", "F4", "Fz"], "occipital": ["O1", "O2"], "temporal": ["T3"], "central": ["C3"], "parietal": ["P3"]}
    edges = features.connectivity_summary(_edges(spark, d), regions, ["F3", "O1", "T3", "C3", "P3"], ["F4", "O2"], "subject_id", "condition").withColumn("band", F.lit("all"))
    long = features.subject_features(spectra(spark, d), edges, BANDS, (0.5, 30.0))
    n = signals(spark, d).groupBy("subject_id").agg(F.count("*").alias("n"))
    errors = n.filter("n < 24").select("subject_id", F.concat(F.lit("only "), F.col("n").cast("string"), F.lit(" of 24 signals")).alias("error"))
    return _round(features.subject_table(n.select("subject_id"), long, SUBJECT_FEATURES, errors), *SUBJECT_FEATURES)


_SPOTS = ", ".join(f"('{c}', {u!r}, {v!r})" for c, (u, v) in scalp.positions().items())


@query("scalp_grid", f"""WITH w AS (SELECT vec_id, ['Fp1', 'Fp2', 'F7', 'F3', 'Fz', 'F4', 'F8', 'T3', 'C3', 'Cz', 'C4', 'T4', 'T5', 'P3', 'Pz', 'P4', 'T6', 'O1', 'O2'][j] AS channel, abs(embedding[j]::DOUBLE) AS v FROM embeddings, range(1, 20) t(j) WHERE vec_id % 7 <> 0 OR j <> 3),
e AS (SELECT * FROM (VALUES {_SPOTS}) s(channel, eu, ev)), px AS (SELECT i // 16 AS y, i % 16 AS x, (i % 16 + 0.5) / 8.0::DOUBLE - 1 AS u, 1 - (i // 16 + 0.5) / 8.0::DOUBLE AS v FROM range(256) r(i)),
k AS (SELECT channel, y, x, 1 / pow(pow(u - eu, 2) + pow(v - ev, 2) + 1e-4, 2) AS k FROM px, e WHERE u * u + v * v <= 1),
m AS (SELECT vec_id, y, x, sum(k * v) / sum(k) AS m FROM w JOIN k USING (channel) GROUP BY ALL), b AS (SELECT vec_id, min(v) AS lo, max(v) AS hi FROM w GROUP BY 1)
SELECT vec_id, y::INT AS y, x::INT AS x, round((m - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 6) AS level FROM m JOIN b USING (vec_id)""")
def scalp_grid(spark, d):
    """The first 19 numbers of each vector as powers of the electrodes; a seventh of the maps lack one."""
    from ..schemas import CHANNELS

    v = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 19)).alias("j", "x"))
    values = v.filter((F.col("vec_id") % 7 != 0) | (F.col("j") != 2)).select("vec_id", F.get(F.array(*map(F.lit, CHANNELS)), F.col("j")).alias("channel"), F.abs(F.col("x").cast("double")).alias("value"))
    return _round(scalp.grid(values, 16, "vec_id"), "level")


@query("attention_sites", """WITH v AS (SELECT vec_id, ['EC', 'EO', 'VCPT'][vec_id % 3 + 1] AS task, embedding[1:23]::DOUBLE[] AS r FROM embeddings),
s AS (SELECT vec_id, task, ['Fz', 'Cz', 'Pz', 'F3', 'F4'][i + 1] AS channel, list_sum(r[i * 4 + 1 : i * 4 + 4]) / 4 AS value FROM v, range(5) t(i)),
m AS (SELECT vec_id, task, avg(value) FILTER (channel IN ('Fz', 'F3', 'F4')) AS f, avg(value) FILTER (channel IN ('Cz', 'Pz')) AS c FROM s GROUP BY ALL)
SELECT vec_id, task, CASE task WHEN 'VCPT' THEN 'central_parietal' ELSE 'frontal' END AS hypothesis, round(f, 6) AS frontal_mean, round(c, 6) AS central_parietal_mean, NULL::DOUBLE AS other_mean, CASE task WHEN 'VCPT' THEN c > f ELSE f > c END AS matches FROM m""")
def attention_sites(spark, d):
    """The first 23 numbers of each vector as the rows of an image: five strips of four."""
    from ..operators import answers

    v = table(spark, d, "embeddings").select("vec_id", F.element_at(F.array(*map(F.lit, answers.EXPECTED)), (F.col("vec_id") % 3 + 1).cast("int")).alias("task"), F.transform(F.slice("embedding", 1, 23), lambda x: x.cast("double")).alias("r"))
    strips = v.select("vec_id", "task", F.posexplode(answers.strip_means(F.col("r"))).alias("i", "value"))
    named = strips.select("vec_id", "task", F.get(F.array(*map(F.lit, answers.STRIPS)), F.col("i")).alias("channel"), "value")
    return _round(answers.plausibility(named, "vec_id"), "frontal_mean", "central_parietal_mean")
