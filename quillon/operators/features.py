"""Subject features from one shared table of spectra (keys, channel, k, freq, psd)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .signals import band_powers, trapezoid

# Columns that wait for data
PLACEHOLDERS = ["p300_latency_ms", "p300_amplitude", "omission_errors", "commission_errors", "reaction_time_ms"]


def _mean_spectrum(spectra: DataFrame, channels: list[str] | None, *keys: str) -> DataFrame:
    rows = spectra if channels is None else spectra.filter(F.col("channel").isin(channels))
    return rows.groupBy(*keys, "k", "freq").agg(F.avg("psd").alias("psd"))


def theta_beta_ratio(spectra: DataFrame, *keys: str, channels: list[str] = ("F3", "F4", "Fz")) -> DataFrame:
    """Spectra averaged over epochs and frontal channels, then theta over beta integral; null if beta is not positive."""
    mean = _mean_spectrum(spectra, list(channels), *keys)
    theta, beta = trapezoid(mean, 4, 8, *keys), trapezoid(mean, 12, 30, *keys)
    both = theta.select(*keys, F.col("power").alias("theta")).join(beta.select(*keys, F.col("power").alias("beta")), [*keys])
    return both.select(*keys, F.when(F.col("beta") > 0, F.col("theta") / F.col("beta")).alias("tbr"))


def theta_beta_variants(spectra: DataFrame, label: str, *keys: str) -> DataFrame:
    """Mean-based and integral-based ratios with the number of bins in each band, for spectra of one window length."""
    both = band_powers(spectra, {"theta": (4, 8), "beta": (12, 30)}, *keys)
    of = lambda b: both.filter(F.col("band") == b).select(*keys, *[F.col(c).alias(f"{c}_{b}") for c in ("bins", "power", "mean_power")])
    d = of("theta").join(of("beta"), [*keys])
    return d.select(*keys, F.lit(label).alias("variant"), "bins_theta", "bins_beta", F.try_divide("power_theta", "power_beta").alias("ratio_trapz"), F.try_divide("mean_power_theta", "mean_power_beta").alias("ratio_mean"))


def relative_power(spectra: DataFrame, bands: dict[str, tuple[float, float]], total: tuple[float, float], *keys: str) -> DataFrame:
    powers = band_powers(spectra, bands, *keys).select(*keys, "band", "power")
    whole = trapezoid(spectra, *total, *keys).select(*keys, F.col("power").alias("total"))
    return powers.join(whole, [*keys]).select(*keys, "band", F.try_divide("power", "total").alias("relpow"))


def peak_frequency(spectra: DataFrame, *keys: str, channels: list[str] = ("O1", "O2"), low: float = 7, high: float = 13) -> DataFrame:
    """Frequency of the largest mean occipital power, the lowest on ties; null with fewer than three bins."""
    inside = _mean_spectrum(spectra, list(channels), *keys).filter(F.col("freq").between(low, high))
    best = inside.groupBy(*keys).agg(F.count("*").alias("bins"), F.max(F.struct("psd", (-F.col("freq")).alias("f"))).alias("b"))
    return best.select(*keys, F.when(F.col("bins") >= 3, -F.col("b.f")).alias("iaf"))


def aperiodic(spectra: DataFrame, *keys: str, low: float = 1, high: float = 45, without: tuple[float, float] = (7, 13), least: int = 10) -> DataFrame:
    """Exponent and offset of a log-log fit outside the alpha range; null with too few bins."""
    x, y = F.log10("freq"), F.log10("psd")
    use = spectra.filter(F.col("freq").between(low, high) & ~F.col("freq").between(*without) & (F.col("psd") > 0))
    fit = use.groupBy(*keys).agg(F.count("*").alias("bins"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    enough = F.col("bins") >= least
    return fit.select(*keys, F.when(enough, -F.col("slope")).alias("exponent"), F.when(enough, F.col("intercept")).alias("offset"))


def alpha_asymmetry(spectra: DataFrame, *keys: str) -> DataFrame:
    """Log right minus log left frontal alpha."""
    alpha = trapezoid(spectra.filter(F.col("channel").isin("F3", "F4")), 8, 12, *keys, "channel")
    side = lambda c: F.max(F.when(F.col("channel") == c, F.when(F.col("power") > 0, F.ln("power"))))
    return alpha.groupBy(*keys).agg((side("F4") - side("F3")).alias("asymmetry"))


def reactivity(spectra: DataFrame, *keys: str) -> DataFrame:
    """Log occipital alpha, eyes closed minus eyes open."""
    mean = _mean_spectrum(spectra, ["O1", "O2"], *keys, "condition")
    alpha = trapezoid(mean, 8, 12, *keys, "condition")
    of = lambda c: F.max(F.when(F.col("condition") == c, F.when(F.col("power") > 0, F.ln("power"))))
    return alpha.groupBy(*keys).agg((of("ec") - of("eo")).alias("reactivity"))


def connectivity_summary(pairs: DataFrame, regions: dict[str, list[str]], left: list[str], right: list[str], *keys: str) -> DataFrame:
    """Means of edge values (channel a, b, value; each edge once) by region pair, hemisphere and overall."""
    region = F.create_map(*[x for r, cs in regions.items() for c in cs for x in (F.lit(c), F.lit(r))])
    is_left, is_right = (lambda c, s=s: F.col(c).isin(s) for s in (left, right))
    ra, rb = region[F.col("a")], region[F.col("b")]
    names = F.array_compact(
        F.array(
            F.when(ra.isNotNull() & rb.isNotNull(), F.concat_ws("_", F.lit("coh"), F.least(ra, rb), F.greatest(ra, rb))),
            F.when(is_left("a") & is_left("b"), F.lit("intra_left")),
            F.when(is_right("a") & is_right("b"), F.lit("intra_right")),
            F.when((is_left("a") & is_right("b")) | (is_right("a") & is_left("b")), F.lit("interhemi")),
            F.lit("overall"),
        )
    )
    return pairs.filter("a <> b").withColumn("feature", F.explode(names)).groupBy(*keys, "feature").agg(F.avg("value").alias("value"))


def feature_table(long: DataFrame, names: list[str], key: str = "subject_id") -> DataFrame:
    """Wide features from (key, feature, value), with always-null placeholders for schema stability."""
    wide = long.groupBy(key).pivot("feature", names).agg(F.first("value"))
    return wide.withColumns({c: F.lit(None).cast("double") for c in PLACEHOLDERS})


def feature_names(channels: list[str], bands: list[str], conditions: list[str], regions: list[str], edge_bands: list[str], edge_conditions: list[str]) -> list[str]:
    """Columns of a subject table, so that its schema depends on no data."""
    pairs = sorted({"_".join(("coh", *sorted((a, b)))) for a in regions for b in regions})
    names = [f"{n}_{c}" for c in conditions for n in ("tbr", "iaf", "aperiodic_exponent", "aperiodic_offset", "frontal_alpha_asym")]
    names += [f"relpow_{ch}_{b}_{c}" for c in conditions for ch in channels for b in bands]
    names += [f"{n}_{b}_{c}" for c in edge_conditions for b in edge_bands for n in (*pairs, "coh_intra_left", "coh_intra_right", "coh_interhemi", "coh_overall")]
    return [*names, "alpha_reactivity"]


def subject_features(spectra: DataFrame, edges: DataFrame, bands: dict[str, tuple[float, float]], total: tuple[float, float], key: str = "subject_id") -> DataFrame:
    """(key, feature, value) of every subject.

    spectra: (key, condition, channel, k, freq, psd), read once for each family, so pass a stored table where it is
    costly; edges: (key, condition, band, feature, value) as ``connectivity_summary`` gives them.
    """
    by = (key, "condition")
    named = lambda rows, value, *parts: rows.select(key, F.concat_ws("_", *parts, "condition").alias("feature"), F.col(value).alias("value"))
    fit = aperiodic(_mean_spectrum(spectra, None, *by), *by)
    edge = F.when(F.startswith("feature", F.lit("coh_")), F.col("feature")).otherwise(F.concat(F.lit("coh_"), "feature"))
    parts = [
        named(theta_beta_ratio(spectra, *by), "tbr", F.lit("tbr")),
        named(peak_frequency(spectra, *by), "iaf", F.lit("iaf")),
        named(fit, "exponent", F.lit("aperiodic_exponent")),
        named(fit, "offset", F.lit("aperiodic_offset")),
        named(alpha_asymmetry(spectra, *by), "asymmetry", F.lit("frontal_alpha_asym")),
        named(relative_power(spectra, bands, total, *by, "channel"), "relpow", F.lit("relpow"), "channel", "band"),
        named(edges.withColumn("feature", edge), "value", "feature", "band"),
        reactivity(spectra, key).select(key, F.lit("alpha_reactivity").alias("feature"), F.col("reactivity").alias("value")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def subject_table(subjects: DataFrame, long: DataFrame, names: list[str], errors: DataFrame | None = None, key: str = "subject_id") -> DataFrame:
    """Every subject of the manifest with its features; one with an error (key, error) has that and no features."""
    wide = subjects.join(feature_table(long, names, key), key, "left")
    if errors is None:
        return wide.withColumn("error", F.lit(None).cast("string"))
    wide = wide.join(errors.groupBy(key).agg(F.min("error").alias("error")), key, "left")
    return wide.withColumns({n: F.when(F.col("error").isNull(), F.col(n)) for n in names})
