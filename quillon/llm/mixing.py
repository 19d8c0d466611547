"""Mixing sources to target weights by entropy balancing.

Among all document rates r with ``sum(r * size) = target`` for every source and ``0 <= r <= cap``,
take the ones nearest to 1 in Kullback-Leibler divergence. The convex dual has one variable per
source and its optimum tilts the rates exponentially: ``r = min(cap, exp(lambda * size / scale))``.
Newton steps on the dual are sums over the table of distinct (source, size) pairs with their
counts, which determines them exactly. Sources, targets and dual variables are tables too, as many
as there may be; the driver holds a few sums. Rates are then rounded to whole copies, largest sizes
first and carrying the error along, so that a source's total differs from its target by about the
size of its smallest documents.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import documents, fresh_names, write_table

WEIGHTS = (5.0, 2.0, 1.0)
#: Documents of equal source and size that one task ranks.
CELL_ROWS = 1_000
#: Cells above the share 1/HEAVY_CELLS of all documents are at most this many; their list is broadcast.
HEAVY_CELLS = 10_000
_TOLERANCE = 1e-9


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` (from 0) in the code point order of ``source``, null last: ranges are sorted, and each
    is offset by the rows before it, a sum over as many rows as there are ranges."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = write_table(ranged.select("*", F.shiftright("at", 33).alias("range")), "ranges")
    before = F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranged.groupBy("range").agg(F.count("*").alias("rows")).select("range", F.coalesce(before, F.lit(0)).alias("before"))
    return ranged.join(ranges, "range").withColumn("rank", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "range", "before")


def share_targets(sources: DataFrame, epochs: float, cap: float) -> DataFrame:
    """``sources`` (total, weight) with ``target``: ``epochs`` times all sizes split by weight; no target exceeds ``cap``
    times its size, the excess goes to the others by weight. A step is one aggregate over all sources."""
    size, weight = F.col("total"), F.col("weight")
    whole = sources.agg(F.sum(size), F.sum(F.when((size > 0) & (weight > 0), weight))).first()
    left, of = epochs * (whole[0] or 0), whole[1] or 0.0
    full = None
    while of:
        free = (size > 0) & (weight > 0) & ~(F.lit(float(left)) * weight / F.lit(float(of)) > cap * size)
        step = sources.agg(F.count(F.when(~free & (size > 0) & (weight > 0), 1)), F.sum(F.when(free, weight)), F.sum(F.when(~free & (weight > 0), cap * size))).first()
        if step[0] == full or not step[1]:
            break
        full, of, left = step[0], step[1], epochs * whole[0] - (step[2] or 0.0)
    # once a target is full it stays so, as what is left by weight only grows
    share = F.least(F.lit(float(left)) * weight / F.lit(float(of or 1.0)), cap * size)
    return sources.withColumn("target", F.when((size > 0) & (weight > 0), share).otherwise(0.0))


def _solve(cells: DataFrame, sources: DataFrame, cap: float, steps: int = 60) -> DataFrame:
    """(sid, lam, scale): the dual variables, from (sid, size, n) cells and sources (sid, docs, total, least, target).

    Newton on each coordinate (the Hessian is diagonal: a document has one source), kept inside a
    bracket. A step is one aggregate over the cells of the sources that are not solved yet.
    """
    top = math.log(cap)
    scale, total, target = F.col("total") / F.col("docs"), F.col("total"), F.col("target")
    high = F.lit(top) * scale / F.col("least")
    most = target >= cap * total * (1 - _TOLERANCE)
    state = sources.filter((total > 0) & (target > 0)).select("sid", scale.alias("scale"), "target", (-F.col("docs") * scale / (math.e * target) - 1).alias("low"), high.alias("high"), F.when(most, high).otherwise(F.least(high, F.log(target / total))).alias("lam"), most.alias("done"))
    state = write_table(state, "dual")
    u = F.col("size") / F.col("scale")
    tilt = F.exp(F.least(F.col("lam") * u, F.lit(top)))
    taken = tilt * F.col("size") * F.col("n")
    slope = F.when(F.col("lam") * u < top, taken * u).otherwise(0.0)
    for _ in range(steps):
        if not state.filter("NOT done").limit(1).count():
            break
        sums = cells.join(state.filter("NOT done").select("sid", "lam", "scale"), "sid").groupBy("sid").agg(F.sum(taken).alias("taken"), F.sum(slope).alias("slope"))
        gap = F.col("taken") - F.col("target")
        met = F.abs(gap) <= _TOLERANCE * F.col("target")
        step = F.col("lam") - F.try_divide(gap, F.col("slope"))
        now = state.join(sums, "sid", "left").withColumns({"low": F.when(gap <= 0, F.col("lam")).otherwise(F.col("low")), "high": F.when(gap > 0, F.col("lam")).otherwise(F.col("high")), "step": step})
        inside = (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
        after = F.when(F.col("done") | met, F.col("lam")).when(inside, F.col("step")).otherwise((F.col("low") + F.col("high")) / 2)
        state = write_table(now.select("sid", "scale", "target", "low", "high", after.alias("lam"), (F.col("done") | met).alias("done")), "dual")
    return state.select("sid", "lam", "scale")


def round_cells(sizes: np.ndarray, counts: np.ndarray, rates: np.ndarray, most: int) -> np.ndarray:
    """Whole copies of cells of ``counts`` documents each, from the largest size down, carrying the words that rounding leaves over."""
    copies, carry = np.zeros(len(sizes), np.int64), 0.0
    for i, (size, n, rate) in enumerate(zip(sizes.tolist(), counts.tolist(), rates.tolist(), strict=True)):
        want = n * rate * size + carry
        copies[i] = min(max(round(want / size), 0), most * n)
        carry = want - int(copies[i]) * size
    return copies


def _round(cap: float):
    """A source's cells, of which there is one for each distinct size: no more than its longest document has words."""

    def rounded(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("size", ascending=False, kind="stable")
        rates = np.exp(np.minimum(cells["lam"].to_numpy() * cells["size"].to_numpy() / cells["scale"].to_numpy(), math.log(cap)))
        return cells.assign(copies=round_cells(cells["size"].to_numpy(), cells["n"].to_numpy(), rates, int(cap)))[["sid", "size", "copies"]]

    return rounded


def mix_copies(docs: DataFrame, size: Column, weights: Sequence[float] = WEIGHTS, epochs: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(doc_id, source, k1, k2, size, source_size, target, copies) of every row.

    Sources in code point order, null last, take ``weights`` in turn, repeating. Sizes of 0 are never taken. Repeated
    rows are documents of their own. Of documents of one source and size the first by a hash of id and text get a
    copy more where copies don't come out even, so reruns agree. A table without rows gives none.
    """
    k1, k2 = _key()
    rows = write_table(docs.select("doc_id", "source", k1.alias("k1"), k2.alias("k2"), size.alias("size")), "sizes")
    cells = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    live = F.when(F.col("size") > 0, F.col("n"))
    sources = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("total"), F.sum(live).alias("docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = write_table(_ranked(sources).withColumn("weight", weight).withColumnRenamed("rank", "sid"), "sources")
    sources = write_table(share_targets(sources, epochs, cap), "targets")
    key = sources.select("sid", F.col("source").alias("key"), F.col("total").alias("source_size"), "target")
    cells = write_table(cells.filter("size > 0").join(key.select("sid", "key"), F.col("source").eqNullSafe(F.col("key"))).select("sid", "size", "n"), "cells")
    dual = _solve(cells, sources, cap)
    copies = cells.join(dual, "sid").groupBy("sid").applyInPandas(_round(cap), "sid long, size long, copies long")
    # a source without a target has no dual variable, and no copies
    copies = write_table(cells.join(copies, ["sid", "size"], "left").withColumn("copies", F.coalesce("copies", F.lit(0))), "copies")

    # documents of one cell differ by at most one copy: the first by hash get one more; large cells are ranked in parts
    of = sources.agg(F.sum("docs")).first()[0] or 0
    limit = max(CELL_ROWS, math.ceil(of / HEAVY_CELLS))
    heavy = copies.filter(F.col("n") > limit).select("sid", "size", F.ceil(F.col("n") / limit).cast("long").alias("parts"))
    keyed = rows.join(key, F.col("source").eqNullSafe(F.col("key"))).drop("key")
    # a cell without a number of parts is ranked as one
    keyed = keyed.join(F.broadcast(heavy), ["sid", "size"], "left").withColumn("part", F.coalesce(F.pmod("k1", "parts"), F.lit(0)).cast("int")).drop("parts")
    parts = keyed.filter("size > 0").groupBy("sid", "size", "part").agg(F.count("*").alias("here"))
    before = F.sum("here").over(Window.partitionBy("sid", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("before", F.coalesce(before, F.lit(0))).join(copies, ["sid", "size"])
    ranked = keyed.join(parts, ["sid", "size", "part"], "left")
    rank = F.row_number().over(Window.partitionBy("sid", "size", "part").orderBy("k1", "k2", "doc_id")) + F.col("before") - 1
    whole = F.floor(F.col("copies") / F.col("n")).cast("long")
    count = F.when(F.col("size") > 0, whole + (rank < F.col("copies") - whole * F.col("n")).cast("long")).otherwise(0)
    return ranked.withColumn("own", count).select("doc_id", "source", "k1", "k2", "size", "source_size", "target", F.col("own").alias("copies"))


def _key() -> list[Column]:
    """128 bits that name a document by its id and text."""
    return [F.xxhash64(F.lit(k), F.col("doc_id").cast("long"), F.col("text")) for k in (1, 2)]


def mix(docs: DataFrame, size: Column | None = None, **options) -> DataFrame:
    """The mixed table: each document as often as it has copies, columns as given and of any names.

    Rows equal in id, text and source share their copies out in the order of a hash of all columns.
    """
    size = word_count(F.col("text")) if size is None else size
    named = [F.col(f"`{c}`") for c in docs.columns]
    a, b, host, total, rows, own, turn = fresh_names(docs, "k1", "k2", "host", "total", "rows", "own", "turn")
    copies = mix_copies(docs, size, **options).groupBy("k1", "k2", "source").agg(F.sum("copies").alias(total), F.count("*").alias(rows)).filter(F.col(total) > 0)
    copies = copies.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("source").alias(host), total, rows)
    k1, k2 = _key()
    joined = docs.withColumns({a: k1, b: k2}).join(copies, [a, b]).filter(F.col("source").eqNullSafe(F.col(host)))
    alone = joined.filter(F.col(rows) == 1).withColumn(own, F.col(total))
    hashable = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    rank = F.row_number().over(Window.partitionBy(a, b, host).orderBy(F.xxhash64(*hashable))) - 1
    whole = F.floor(F.col(total) / F.col(rows))
    repeated = joined.filter(F.col(rows) > 1).withColumn(own, whole + (rank < F.col(total) - whole * F.col(rows)).cast("long"))
    taken = alone.select(*named, own).unionByName(repeated.select(*named, own)).filter(F.col(own) > 0)
    return taken.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(own).cast("int")))).select(*named)


def op2_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents to 5 : 2 : 1 by source, 1.5 times their words in all, none more than twice."""
    docs = documents(spark, sf_dir)
    mixed = mix_copies(docs, word_count(F.col("text")))
    return mixed.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
