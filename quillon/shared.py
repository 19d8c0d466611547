"""Files and tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a temporary folder only where it is unset on a local master (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="quillon-")
    return _own[app]


def fresh(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{folder(spark)}/quillon/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: its lineage ends in files that outlive executors."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """(path, length) of files written from rows (name, content), by the tasks; a repeated task writes the same file."""

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            out = []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                target = f"{base}/{name}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as f:
                    f.write(content)
                system.move(part, target)
                out.append({"path": f"{root}/{name}", "length": len(content)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("length", pa.int64())]))

    return materialise(rows.select("name", "content").mapInArrow(write, "path string, length long"), "files")
