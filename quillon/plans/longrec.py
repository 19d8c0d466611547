"""Queries over long recordings: files written from the given tables and read back, filters, components, whole recordings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import blocks, kernels, recordings, sums
from ..shared import fresh, materialise, write_files
from ..sources import decoders, formats
from .catalogue import query
from .predictions import _round
from .standins import CHANNEL_NAMES, table

FS = 64.0
#: Physical range of the written files, in microvolts.
LIMIT = 8.0


def long_rows(spark, d):
    """Two recordings of 8 channels: every 16 vectors are the next 64 samples of both; an incomplete end is left out."""
    v = F.col("vec_id")
    rows = table(spark, d, "embeddings").select(
        F.concat(F.lit("R"), (F.floor(v / 8) % 2).cast("string")).alias("rec"),
        F.element_at(F.array(*map(F.lit, CHANNEL_NAMES)), (v % 8 + 1).cast("int")).alias("channel"),
        (F.floor(v / 16) * 64).cast("long").alias("start"),
        F.transform("embedding", lambda x: x.cast("double")).alias("samples"),
    )
    whole = rows.groupBy("rec", "start").agg(F.count("*").alias("n")).filter(f"n = {len(CHANNEL_NAMES)}").select("rec", "start")
    return rows.join(whole, ["rec", "start"], "left_semi")


LONG = """raw AS (SELECT 'R' || (vec_id // 8) % 2 AS rec, ['F3', 'F4', 'Fz', 'O1', 'O2', 'T3', 'C3', 'P3'][vec_id % 8 + 1] AS channel, (vec_id // 16) * 64 AS start, embedding::DOUBLE[] AS samples FROM embeddings),
long AS (SELECT * FROM raw JOIN (SELECT rec, start FROM raw GROUP BY ALL HAVING count(*) = 8) USING (rec, start)),
point AS (SELECT rec, channel, start + generate_subscripts(samples, 1) - 1 AS i, unnest(samples) AS x FROM long)"""


def written(spark, d):
    """A folder with one file a recording, in microvolts, and one that can't be read."""

    @F.pandas_udf("binary")
    def content(channels: pd.Series) -> pd.Series:
        return pd.Series([decoders.write_edf([(c["channel"], c["samples"] * 1e-6) for c in row], int(FS), limit=LIMIT) for row in channels])

    pieces = long_rows(spark, d).groupBy("rec", "channel").agg(F.sort_array(F.collect_list(F.struct("start", "samples"))).alias("p"))
    whole = pieces.select("rec", F.struct("channel", F.flatten(F.transform("p", lambda p: p["samples"])).alias("samples")).alias("c"))
    files = whole.groupBy("rec").agg(F.sort_array(F.collect_list("c")).alias("c")).select(F.concat("rec", F.lit("-20240101-120000-EOEC.edf")).alias("name"), content("c").alias("content"))
    broken = spark.range(1).select(F.lit("R9-20240101-120000-EOEC.edf").alias("name"), F.encode(F.lit("broken"), "UTF-8").alias("content"))
    root = fresh(spark, "edf")
    write_files(files.unionByName(broken), root)
    return root


_QUANTISED = f"""q AS (SELECT rec, channel, i, greatest(-32767, least(32767, round_even(x / {LIMIT} * 32767, 0))) * {LIMIT} / 32767 AS y FROM point)"""


@query("edf_scan", f"WITH {LONG}, {_QUANTISED} SELECT rec || '-20240101-120000-EOEC.edf' AS file, channel, 64.0::DOUBLE AS sfreq, count(*) AS n, round(sum(y), 4) AS total, round(sum(y * y), 4) AS energy, NULL::VARCHAR AS error FROM q GROUP BY ALL UNION ALL SELECT 'R9-20240101-120000-EOEC.edf', NULL, NULL, NULL, NULL, NULL, 'not a recording: shorter than a header'")
def edf_scan(spark, d):
    """Files of the recordings, read by ranges of 20 kB."""
    rows = formats.register(spark).read.format("edf").option("split_bytes", 20_000).option("block_records", 4).load(written(spark, d))
    y = lambda f: F.sum(F.aggregate("samples", F.lit(0.0), lambda a, x: a + f(x * 1e6)))
    by = rows.groupBy(F.element_at(F.split("path", "/"), -1).alias("file"), "channel", "sfreq", "error").agg(F.sum(F.size("samples")).alias("n"), F.round(y(lambda v: v), 4).alias("total"), F.round(y(lambda v: v * v), 4).alias("energy"))
    return by.select("file", "channel", "sfreq", F.when(F.col("error").isNull(), F.col("n")).alias("n"), F.when(F.col("error").isNull(), F.col("total")).alias("total"), F.when(F.col("error").isNull(), F.col("energy")).alias("energy"), "error")


_SINC = "CASE WHEN t = 0 THEN 1 ELSE sin(pi() * 2 * {f} / 64 * t) / (pi() * 2 * {f} / 64 * t) END"
_TAPS = """w AS (SELECT t - 26 AS t, 0.54 - 0.46 * cos(2 * pi() * t / 52) AS w FROM range(53) r(t)),
lp AS (SELECT t, {hi} * w AS hi, {lo} * w AS lo FROM w),
taps AS (SELECT t, hi / (SELECT sum(hi) FROM lp) - lo / (SELECT sum(lo) FROM lp) AS h FROM lp)""".format(hi=_SINC.format(f="20.0"), lo=_SINC.format(f="2.0"))
_FILTERED = f"""{_TAPS}, n AS (SELECT rec, channel, max(i) AS last FROM point GROUP BY ALL),
moved AS (SELECT p.rec, p.channel, p.i, h, CASE WHEN i - t < 0 THEN t - i WHEN i - t > last THEN 2 * last - i + t ELSE i - t END AS j FROM point p JOIN n USING (rec, channel), taps),
y AS (SELECT m.rec, m.channel, m.i, sum(m.h * p.x) AS y FROM moved m JOIN point p ON p.rec = m.rec AND p.channel = m.channel AND p.i = m.j GROUP BY ALL)"""


@query("filtered_blocks", f"WITH {LONG}, {_FILTERED} SELECT rec, channel, count(*) AS n, round(sum(y * y), 6) AS energy, round(max(y), 6) AS peak, round(min(y), 6) AS trough FROM y GROUP BY ALL")
def filtered_blocks(spark, d):
    """A 2 to 20 Hz band-pass by blocks of 100 samples, over recordings as long as the table."""
    out = blocks.filtered(long_rows(spark, d), [(kernels.fir(FS, 2.0, 20.0, transition=4.0), False)], 100, "rec")
    by = out.select("rec", "channel", F.size("samples").alias("n"), F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x).alias("e"), F.array_max("samples").alias("hi"), F.array_min("samples").alias("lo"))
    return _round(by.groupBy("rec", "channel").agg(F.sum("n").alias("n"), F.sum("e").alias("energy"), F.max("hi").alias("peak"), F.min("lo").alias("trough")), "energy", "peak", "trough")


def _even(spark, d):
    return materialise(blocks.map_blocks(long_rows(spark, d), lambda v: v, 256, 0, "rec"), "even")


@query("block_components")
def block_components(spark, d):
    """How far the components of each recording are uncorrelated, of unit variance, and complete; and their scores."""
    rows = _even(spark, d)
    m = materialise(blocks.matrices(rows, CHANNEL_NAMES, "rec"), "matrices")
    fitted = materialise(blocks.ica(m, len(CHANNEL_NAMES), "rec", steps=12), "fitted")
    scores = blocks.detectors(rows, fitted, CHANNEL_NAMES, ["F3", "F4"], FS, 256, "rec", nperseg=128)

    def white(covariance, unmixing, mixing):
        import numpy as np

        w, c, a = unmixing.reshape(-1, 8), covariance.reshape(8, 8), mixing.reshape(8, -1)
        return {"components": len(w), "off": float(np.round(np.abs(w @ c @ w.T - np.eye(len(w))).max(), 6)), "lost": float(np.round(np.abs(a @ w - np.eye(8)).max(), 6))}

    checks = sums.each(fitted.select("rec", "covariance", "unmixing", "mixing"), white, "components int, off double, lost double", "rec")
    least = lambda c: F.round(F.array_min(c), 3)
    return checks.join(scores, "rec").select("rec", "components", "off", "lost", least("eog").alias("least_eog"), least("muscle").alias("least_muscle"), F.size("eog").alias("scored"))


@query("prepare_edf")
def prepare_edf(spark, d):
    """Recordings from files to statuses: filter, components, cut, epochs, all by blocks; a broken file is a failed row."""
    rows = formats.register(spark).read.format("edf").load(written(spark, d))
    name = F.element_at(F.split("path", "/"), -1)
    rows = materialise(rows.select(name.alias("rec"), "channel", "start", "samples", "error"), "scanned")
    s = recordings.Settings(low=1.0, high=28.0, notch=None, trim_s=1.0, epoch_s=1.0, reject_uv=8.0, ica_steps=6, include_ambiguous=True)
    statuses, _ = blocks.prepare(rows.filter("error IS NULL").drop("error"), CHANNEL_NAMES, FS, "rec", size=512, settings=s)
    failed = rows.filter("error IS NOT NULL").select("rec", F.lit("failed").alias("status"), F.col("error").alias("detail"))
    return _round(statuses, "alpha_ratio", "boundary_frac").unionByName(failed, allowMissingColumns=True)
