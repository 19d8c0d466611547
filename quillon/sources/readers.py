"""Sources: recordings, discovery of subjects, CSV with fixed schemas, and build logs."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import CHANNELS, RECORDING
from . import decoders

NAME = r"(?i)^([A-Za-z0-9]+)[._-]([0-9]+)[._-]([0-9]+)[._-]([A-Za-z0-9]+)\.edf$"


def csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A CSV with a header and a fixed schema; a row that does not fit it fails."""
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST")


def trusted(boundaries: DataFrame) -> DataFrame:
    """(subject_id, boundary_frac) of trusted rows with a number; text columns as read."""
    fraction = F.col("boundary_frac").try_cast("double") if hasattr(Column, "try_cast") else F.expr("try_cast(boundary_frac AS double)")
    return boundaries.filter(F.lower(F.trim("trusted")).isin("true", "1")).select("subject_id", fraction.alias("boundary_frac")).filter("boundary_frac IS NOT NULL")


def truth(text: Column) -> Column:
    """Text as a boolean; null stays null."""
    return F.when(text.isNotNull(), F.lower(F.trim(text)).isin("true", "1"))


def null_nan(rows: DataFrame) -> DataFrame:
    """NaN as null in every floating-point column."""
    return rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in rows.dtypes if t in ("double", "float")})


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parse_name(path: Column, strict: bool = True) -> Column:
    """Struct of subject, group, date, time and task from a file name; a name that does not fit raises, or is null."""
    name = base_name(path)
    part = lambda i: F.regexp_extract(name, NAME, i)
    subject = F.upper(part(1))
    parsed = F.struct(subject.alias("subject_id"), F.when(subject.startswith("F"), "ADHD").otherwise("Control").alias("group"), part(2).alias("date"), part(3).alias("time"), F.upper(part(4)).alias("task"))
    fits = F.regexp_like(name, F.lit(NAME))
    return F.when(fits, parsed).otherwise(F.raise_error(F.concat(F.lit("unexpected file name: "), name))) if strict else F.when(fits, parsed)


def parse_image_name(path: Column) -> Column:
    """Subject and condition of ``<subject>_<condition>_<index>.png``."""
    parts = F.split(base_name(path), "_")
    return F.struct(parts[0].alias("subject_id"), parts[1].alias("condition"))


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Paths below a folder, by name only: no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length")


def discover(spark: SparkSession, root: str, pattern: str = "*.[eE][dD][fF]") -> DataFrame:
    """(subject_id, group, eoec_path, vcpt_path): one row per subject; a subject with two rest files raises."""
    found = files(spark, root, pattern).select("path", parse_name(F.col("path"), strict=False).alias("n")).filter("n IS NOT NULL").select("path", "n.*").dropDuplicates(["path"])
    by = found.groupBy("subject_id", "group").agg(
        F.sum((F.col("task") == "EOEC").cast("int")).alias("__n"),
        F.min(F.when(F.col("task") == "EOEC", F.col("path"))).alias("eoec_path"),
        F.min(F.when(F.col("task") == "VCPT", F.col("path"))).alias("vcpt_path"),
    )
    one = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("two rest recordings of "), F.col("subject_id")))).otherwise(F.col("eoec_path"))
    return by.filter("__n > 0").select("subject_id", "group", one.alias("eoec_path"), "vcpt_path")


def near_misses(spark: SparkSession, root: str, pattern: str = "*.[eE][dD][fF]") -> DataFrame:
    """Paths that match the pattern but whose names do not parse."""
    return files(spark, root, pattern).filter(parse_name(F.col("path"), strict=False).isNull()).select("path")


def discover_folders(spark: SparkSession, root: str, pattern: str = "*.mat") -> DataFrame:
    """(subject_id, group, path) where the group is named by a folder's beginning."""
    found = files(spark, root, pattern)
    group = F.regexp_extract("path", r"/(ADHD|Control)[^/]*/", 1)
    return found.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("subject_id"), group.alias("group"), "path").filter("group <> ''")


def first_per_subject(rows: DataFrame, *order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("subject_id").orderBy(*order))
    return rows.withColumn("__r", rank).filter("__r = 1").drop("__r")


def image_counts(paths: DataFrame) -> DataFrame:
    return paths.select(parse_image_name(F.col("path")).alias("n")).groupBy("n.subject_id", "n.condition").agg(F.count("*").alias("n"))


def recordings(spark: SparkSession, root: str, pattern: str = "*.[eE][dD][fF]") -> DataFrame:
    """(path, channel, sfreq, signal) of every recording; a file that does not decode has one row with a null signal."""

    def decode(batches):
        for frame in batches:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += [(path, name, fs, x) for name, fs, x in decoders.edf(content)]
                except (ValueError, IndexError) as e:
                    rows.append((path, f"error: {e}", None, None))
            yield pd.DataFrame(rows, columns=["path", "channel", "sfreq", "signal"])

    return _binary(spark, root, pattern).mapInPandas(decode, RECORDING)


def matrices(spark: SparkSession, root: str, fs: float = 128.0, pattern: str = "*.mat") -> DataFrame:
    """As ``recordings``, for files of one (samples, 19) matrix in microvolts."""

    def decode(batches):
        for frame in batches:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    found = list(decoders.mat(content).values())
                    if len(found) != 1 or found[0].ndim != 2 or found[0].shape[1] != len(CHANNELS):
                        raise ValueError("one matrix of 19 columns is expected")
                    rows += [(path, c, fs, found[0][:, i].astype(float) * 1e-6) for i, c in enumerate(CHANNELS)]
                except (ValueError, IndexError) as e:
                    rows.append((path, f"error: {e}", None, None))
            yield pd.DataFrame(rows, columns=["path", "channel", "sfreq", "signal"])

    return _binary(spark, root, pattern).mapInPandas(decode, RECORDING)


def _binary(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "content")


def log_lines(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """Fields of the lines that match, under the first encoding that yields any."""
    for encoding in ("UTF-8", "UTF-16", "ISO-8859-1"):
        # the CSV reader knows encodings; a separator that no log holds keeps a line whole
        lines = spark.read.option("encoding", encoding).option("sep", "\u0001").option("quote", "").schema("line string").csv(path)
        hit = lines.filter(F.regexp_like("line", F.lit(pattern)))
        if hit.limit(1).count():
            return hit.select(*[F.regexp_extract("line", pattern, i).alias(n) for i, n in enumerate(names, 1)])
    return spark.createDataFrame([], ", ".join(f"{n} string" for n in names))


def settings(lines: DataFrame) -> DataFrame:
    """(path, key, value) of flat ``key: value`` lines (path, line), values as text without quotes and comments; nested lines are left out.

    The last of several lines of a key in a file counts where ``lines`` has a column ``n``; null and ``~`` are null.
    """
    pattern = r"^([A-Za-z_][A-Za-z0-9_]*)\s*:(?:\s+(.*?))?\s*$"
    hit = lines.filter(F.regexp_like("line", F.lit(pattern)))
    raw = F.regexp_replace(F.regexp_extract("line", pattern, 2), r"\s+#.*$", "")
    bare = F.regexp_replace(raw, r"^(['\"])(.*)\1$", "$2")
    value = F.when(~raw.isin("", "~", "null"), bare)
    order = "n" if "n" in lines.columns else None
    rows = hit.select("path", F.regexp_extract("line", pattern, 1).alias("key"), value.alias("value"), *([order] if order else []))
    return rows.groupBy("path", "key").agg((F.max_by("value", order) if order else F.first("value")).alias("value"))


def setting_files(spark: SparkSession, path: str) -> DataFrame:
    """``settings`` of YAML files as runs leave them."""
    text = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    return settings(text)


def setting_faults(found: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """(path, key, wanted, got, fault) of settings that did not take: absent, or of another value (numbers by value, text ignoring case)."""
    want = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("wanted")) for k, v in wanted.items()]))
    asked = found.select("path").distinct().select("path", want.alias("w")).select("path", "w.key", "w.wanted")
    held = found.select("path", "key", F.col("value").alias("got"), F.lit(True).alias("__there"))
    rows = asked.join(held, ["path", "key"], "left")
    number = lambda c: F.expr(f"try_cast({c} AS double)")
    same = F.coalesce(number("wanted") == number("got"), F.lower("wanted") == F.lower("got"), F.lit(False))
    fault = F.when(F.col("__there").isNull(), "absent").when(~same, "wrong")
    return rows.withColumn("fault", fault).filter("fault IS NOT NULL").select("path", "key", "wanted", "got", "fault")


def data_root(given: str | None, variable: str = "QUILLON_DATA_ROOT") -> str:
    """A given root, else the environment's, else an error."""
    found = given or os.environ.get(variable)
    if not found:
        raise ValueError(f"give a data root or set {variable}")
    return found.rstrip("/")


def absolute(path: Column, root: str) -> Column:
    """Absolute paths pass, relative ones go below the root, null stays null."""
    return F.when(path.startswith("/") | path.contains("://"), path).when(path.isNotNull(), F.concat(F.lit(root.rstrip("/") + "/"), path))


def relative(path: Column, root: str) -> Column:
    """Paths below the root without it; others pass."""
    start = root.rstrip("/") + "/"
    return F.when(path.startswith(start), F.substring(path, len(start) + 1, 2**31 - 1)).otherwise(path)


def synthetic_subjects(spark: SparkSession, adhd: int = 49, control: int = 54, seed: int = 42) -> DataFrame:
    """Seeded subjects with ids of letters and digits only."""
    n = adhd + control
    group = F.when(F.col("id") < adhd, "ADHD").otherwise("Control")
    mark = F.when(F.col("id") < adhd, "F").otherwise("M")
    return spark.range(n).select(F.concat(mark, F.lpad(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(100_000)).cast("string"), 5, "0"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("subject_id"), group.alias("group"))
