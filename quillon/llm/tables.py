"""Shared tables: how the corpus operators cut lineage.

Intermediate results go as Parquet into the folder that ``spark.checkpoint.dir`` names, which
driver and executors share, so a lost executor never loses them.
"""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where the setting is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="quillon-")
    return _own[app]


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while f"_{name}" in taken:
            name = f"_{name}"
        out.append(f"_{name}")
        taken.add(f"_{name}")
    return out


def edit_texts(df: DataFrame, hits: str, edit: Callable) -> DataFrame:
    """``df`` with the texts of rows whose ``hits`` is not null replaced by ``edit(text, hits)``; columns of any names."""
    import pyarrow as pa

    names = df.columns
    text, hit = names.index("text"), names.index(hits)

    def edited(batches):
        for batch in batches:
            found = batch.column(hit)
            touched = [i for i, valid in enumerate(found.is_valid().to_pylist()) if valid]
            if touched:
                column = batch.column(text).to_pylist()
                for i in touched:
                    column[i] = edit(column[i], found[i].as_py())
                field = batch.schema.field(text)
                batch = batch.set_column(text, field, pa.array(column, field.type))
            yield batch

    # names of their own for the task: mapInArrow takes a dot for a field
    renamed = df.toDF(*[f"c{i}" for i in range(len(names))])
    return renamed.mapInArrow(edited, renamed.schema).toDF(*names)
