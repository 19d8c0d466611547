"""A streaming sink whose keyed log is the same after kills and replays.

A batch is written beside the log and then renamed to ``batch=<id>``. The rename is its commit: that folder is both the
data and the ledger's entry, so there is no moment at which one exists without the other. A batch that a restarted
query sends again finds its entry and writes nothing; what a killed writer left beside the log is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path
    return p, p(path).getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, path: str) -> list[int]:
    """Ids of the batches in the log, in order."""
    p, fs = _file_system(spark, path)
    if not fs.exists(p(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p(path))]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def append_once(path: str, key: str, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: each batch's rows, one a key, become one entry of the log at ``path``.

    Rows of a key within a batch are one row already, or ``prepare`` makes them so. A batch without rows is an
    entry too (its schema is kept). Two writers of one log are not foreseen, as a streaming query is one.
    """

    def write(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        p, fs = _file_system(spark, path)
        target = p(f"{path}/batch={batch}")
        if fs.exists(target):
            # the rows are read all the same: state behind them is committed by their tasks
            rows.write.format("noop").mode("overwrite").save()
            return
        beside = f"{path}/_writing-{batch}-{uuid.uuid4().hex}"
        made = prepare(rows)
        if key not in made.columns:
            raise ValueError(f"the log's key {key} is missing")
        made.write.parquet(beside)
        if not fs.rename(p(beside), target):
            raise OSError(f"batch {batch} was not committed to {path}")

    return write


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The log: of each key the row of its last batch."""
    ids = committed(spark, path)
    if not ids:
        raise ValueError(f"no batch is committed at {path}")
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/batch={i}" for i in ids])
    columns = [c for c in rows.columns if c not in (key, "batch")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("__r"))
    return last.select(key, "__r.*")


def start(rows: DataFrame, path: str, key: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows, mode: str = "update"):
    """Run a stream into the log until what has landed is used up; the returned query ends by itself."""
    return rows.writeStream.outputMode(mode).foreachBatch(append_once(path, key, prepare)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
