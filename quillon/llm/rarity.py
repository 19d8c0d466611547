"""A global order of items by rarity that fits one broadcast.

Occurrences are counted over all rows into a fixed number of counters, the item's hash choosing
one; an item's counter is at least its count, so common items never look rare. Ordering by (counter,
hash) is the same everywhere, which is all that prefix filters need to be exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 18
_MASK = np.uint64((1 << BITS) - 1)


def counters(counts: DataFrame) -> np.ndarray:
    """2**BITS counters (1 MB) of a table of (item: long, n: long); an item may be given as its slot."""
    summed = counts.groupBy(F.col("item").bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias("slot")).agg(F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n"))
    rows = summed.toArrow()
    out = np.zeros(1 << BITS, np.int32)
    out[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    return out


def slots(items: np.ndarray, n: np.ndarray | None, into: np.ndarray) -> None:
    """Add counts of items (unsigned 64-bit) to a task's own counters."""
    into += np.bincount((items & _MASK).astype(np.int64), n, 1 << BITS).astype(np.int64)


def rarity(counts: np.ndarray, items: np.ndarray) -> np.ndarray:
    """The counter of each item (unsigned 64-bit)."""
    return counts[(items & _MASK).astype(np.int64)]
