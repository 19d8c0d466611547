"""Arrays added up by key: per-batch sums, partial aggregates before the shuffle, and small steps on the results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def arrays(column: pa.Array) -> list[np.ndarray]:
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate(values).astype(float) if values else np.zeros(0))


def sum_arrays(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, value): arrays added up place by place, with partial sums before the shuffle."""
    places = rows.select(*keys, F.posexplode(value).alias("p", "v")).groupBy(*keys, "p").agg(F.sum("v").alias("v"))
    return places.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias(value))


def partial(rows: DataFrame, run, *keys: str) -> DataFrame:
    """(keys, sums): ``run`` of each row's columns as arrays, added up within a batch for each key."""
    types = dict(rows.dtypes)
    rest = [c for c in rows.columns if c not in keys]

    def sums(batches):
        for batch in batches:
            names = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
            columns = [arrays(batch.column(c)) if pa.types.is_list(batch.column(c).type) else batch.column(c).to_pylist() for c in rest]
            total: dict[tuple, np.ndarray] = {}
            for name, *values in zip(names, *columns, strict=True):
                found = run(**dict(zip(rest, values, strict=True)))
                total[name] = total[name] + found if name in total else found
            held = list(total)
            named = [pa.array([h[i] for h in held], batch.schema.field(k).type) for i, k in enumerate(keys)]
            yield pa.RecordBatch.from_arrays([*named, lists(list(total.values()))], names=[*keys, "sums"])

    return rows.mapInArrow(sums, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", sums array<double>")


def each(rows: DataFrame, run, schema: str, *keys: str) -> DataFrame:
    """Rows (keys and what ``run`` gives, a dict) of one row each; a row is a recording's sums, of fixed size."""
    types = dict(rows.dtypes)
    rest = [c for c in rows.columns if c not in keys]

    def all_(batches):
        for frame in batches:
            out = []
            for r in frame.itertuples(index=False):
                row = r._asdict()
                out.append({**{k: row[k] for k in keys}, **run(**{c: np.asarray(row[c]) if isinstance(row[c], np.ndarray | list) else row[c] for c in rest})})
            if out:
                import pandas as pd

                yield pd.DataFrame(out)

    return rows.mapInPandas(all_, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + schema)
