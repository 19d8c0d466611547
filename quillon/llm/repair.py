"""Conversation structure repair: cheapest edits by a cost DP, the least audit by prefix-doubling path ranking.

A repaired conversation reads ``(system? (user assistant)+)?`` by the first letters of its roles. Edits are
Delete, Insert, Keep and Rerole; the audit is their initials in order. Nodes are (rows read, state of that
pattern). Costs to the end come from a DP over whole arrays; the arcs that reach them are ranked by the first
1, 2, 4, ... letters of their audits: a node's rank at a length of 2n is that of the pair (its rank at n, the
rank at n of the node that its n-step pointer names), and pointers double with the lengths. An edit leads from
a node to one node only, so the pointers of least letters are unique, and following them spells the least audit.

Long conversations are cut into runs of ``RUN`` rows, so that none is held whole: each run has a min-plus matrix
of 4 x 4 states, the matrices give the costs behind every run, runs are solved apart for each entry state, and
the entry states follow run by run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import documents, write_table

#: Rows of a conversation that are solved together.
RUN = 1024
#: Nodes that one step of a task works on.
NODES = 1 << 18

#: States: nothing yet, after a system row, after a user row, after an assistant row.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = np.array([_USER, _USER, _ASSISTANT, _USER])  # what an inserted or reroled row makes of a state
_LETTERS = "DIKR"  # in ASCII order
_NEVER = 1 << 40
_COSTS = {"D": 4, "I": 3, "K": 0, "R": 3}
_TRUNCATED = 3
#: A row's code is 3 times its role (system, user, assistant, other) and its fault (none, truncated, must go).
_PAD = 12


def _arcs() -> tuple[np.ndarray, np.ndarray]:
    """Cost and target state by (code, state, letter)."""
    cost = np.full((13, 4, 4), _NEVER)
    to = np.tile(np.arange(4)[:, None], (13, 1, 4))
    for code in range(12):
        role, fault = divmod(code, 3)
        for s in range(4):
            cost[code, s, 0] = _COSTS["D"]
            cost[code, s, 1], to[code, s, 1] = _COSTS["I"], _NEXT[s]
            if fault == 2:
                continue
            extra = _TRUNCATED * (fault == 1)
            after = _SYSTEM if (role, s) == (0, _START) else _USER if role == 1 and s != _USER else _ASSISTANT if (role, s) == (2, _USER) else None
            if after is not None:
                cost[code, s, 2], to[code, s, 2] = _COSTS["K"] + extra, after
            cost[code, s, 3], to[code, s, 3] = _COSTS["R"] + extra, _NEXT[s]
    return cost, to


_COST, _TO = _arcs()


def _min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(-2), _NEVER)


def _row_matrices() -> np.ndarray:
    """By code, the cheapest way from state to state over the inserts before a row and the row itself."""
    insert = np.where(np.eye(4, dtype=bool), 0, _NEVER)
    insert[np.arange(4), _NEXT] = np.minimum(insert[np.arange(4), _NEXT], _COSTS["I"])
    inserts = _min_plus(insert, insert)
    row = np.full((13, 4, 4), _NEVER)
    for letter in (0, 2, 3):
        for s in range(4):
            at = (np.arange(13), s, _TO[:, s, letter])
            row[at] = np.minimum(row[at], _COST[:, s, letter])
    out = _min_plus(np.broadcast_to(inserts, (13, 4, 4)), row)
    out[_PAD] = np.where(np.eye(4, dtype=bool), 0, _NEVER)
    return out


_ROW = _row_matrices()
#: Costs from each state when no row is left.
_END = np.array([0, 2 * _COSTS["I"], _COSTS["I"], 0])


def run_matrices(codes: np.ndarray) -> np.ndarray:
    """Min-plus products (n, 4, 4) of runs given as rows of codes, padded in front."""
    out = _ROW[np.full(len(codes), _PAD)]
    for i in range(codes.shape[1] - 1, -1, -1):
        out = _min_plus(_ROW[codes[:, i]], out)
    return out


def least_paths(codes: np.ndarray, behind: np.ndarray, last: np.ndarray, entries: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least audits of runs: (letters from 1, 0 after the end; positions; states before and after) by (run, entry, step).

    ``codes`` (runs, rows) is padded in front, ``behind`` (runs, 4) has the costs from each state at the end of
    a run, ``last`` says which runs end a conversation; further inserts are allowed there.
    """
    runs, rows = codes.shape
    left = np.empty((runs, rows + 1, 4), np.int64)
    left[:, rows] = behind
    for i in range(rows - 1, -1, -1):
        left[:, i] = (_ROW[codes[:, i]] + left[:, i + 1, None, :]).min(-1)
    # optimal arcs: those whose cost and the cost behind them are the cost of the node
    padded = np.concatenate((codes, np.full((runs, 1), _PAD)), 1)
    cost, to = _COST[padded], _TO[padded]
    cost[last, rows, :, 1] = _COSTS["I"]
    to[last, rows, :, 1] = _NEXT
    layer = np.arange(rows + 1)[None, :, None, None] + np.array([1, 0, 1, 1])
    layer = np.broadcast_to(np.minimum(layer, rows), cost.shape)
    run = np.arange(runs)[:, None, None, None]
    best = (cost + left[run, layer, to]) == left[..., None]
    letter = np.where(best.any(-1), best.argmax(-1) + 1, 0).ravel()
    target = np.take_along_axis((run * (rows + 1) + layer) * 4 + to, best.argmax(-1)[..., None], -1)[..., 0].ravel()
    here = np.arange(len(letter))
    pointer = np.where(letter > 0, target, here)
    # prefix doubling
    rank, pointers = letter.astype(np.int64), [pointer]
    while True:
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[pointer], return_inverse=True)[1]
        doubled = pointer[pointer]
        if np.array_equal(doubled, pointer):
            break
        pointer = doubled
        pointers.append(pointer)
    start = np.arange(runs) * (rows + 1) + (codes == _PAD).sum(1)
    path = (start[:, None] * 4 + np.array(entries))[..., None]
    for pointer in reversed(pointers):
        path = np.stack((path, pointer[path]), -1).reshape(runs, len(entries), -1)
    return letter[path], path // 4 % (rows + 1), path % 4, pointers[0][path] % 4


def _batched(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of runs of like length, so many that their nodes stay bounded."""
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * (int(lengths[order[stop]]) + 1) * 4 <= NODES and lengths[order[stop]] <= 2 * max(8, lengths[order[at]]):
            stop += 1
        yield order[at:stop]
        at = stop


def _padded(lists: pa.Array, which: np.ndarray) -> np.ndarray:
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    n = offsets[which + 1] - offsets[which]
    out = np.full((len(which), int(n.max(initial=0))), _PAD)
    for row, (i, k) in enumerate(zip(which, n, strict=True)):
        if k:
            out[row, -k:] = values[offsets[i] : offsets[i] + k]
    return out


def _lengths(lists: pa.Array) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy())


def _matrices(batches):
    for batch in batches:
        codes = batch.column("codes")
        out = np.empty((batch.num_rows, 16), np.int64)
        for which in _batched(_lengths(codes)):
            out[which] = run_matrices(_padded(codes, which)).reshape(-1, 16)
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("run"), pa.ListArray.from_arrays(np.arange(0, 16 * batch.num_rows + 1, 16, dtype=np.int32), out.ravel())], names=["k", "run", "matrix"])


def _costs_behind(batches):
    """From a conversation's matrices in order, the costs behind every run."""
    for batch in batches:
        for k, runs in zip(batch.column("k").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            behind, out = _END, []
            for r in reversed(runs):
                out.append(behind.tolist())
                behind = (np.array(r["matrix"]).reshape(4, 4) + behind).min(-1)
            yield pa.RecordBatch.from_pylist([{"k": k, "run": r["run"], "behind": b} for r, b in zip(runs, reversed(out), strict=True)], pa.schema([("k", pa.string()), ("run", pa.int64()), ("behind", pa.list_(pa.int64()))]))


_SOLVED = "k string, run long, entry int, exit int, cost long, audit string, steps array<struct<row:long,edit:string,becomes:string>>"
_STEP = pa.struct([("row", pa.int64()), ("edit", pa.string()), ("becomes", pa.string())])
_SPELL = np.array(["", *_LETTERS])


def _solve(entries: list[int], size: int):
    """Least audits and edits of runs of ``size`` rows from each entry state; rows count from the first of the conversation."""

    def solve(batches):
        for batch in batches:
            codes = batch.column("codes")
            runs, last = batch.column("run").to_numpy(), batch.column("last").to_numpy(zero_copy_only=False)
            behind = np.array(batch.column("behind").to_pylist(), np.int64).reshape(-1, 4)
            keys, lengths = batch.column("k"), _lengths(codes)
            for which in _batched(lengths):
                c = _padded(codes, which)
                letters, places, _, after = least_paths(c, behind[which], last[which], entries)
                rows = runs[which][:, None, None] * size + places - (c.shape[1] - lengths[which])[:, None, None]
                # costs by the whole run, from its matrix
                costs = (run_matrices(c) + behind[which][:, None, :]).min(-1)
                live = letters > 0
                n = live.sum(-1)
                flat = live.reshape(-1, live.shape[-1])
                edits = _SPELL[letters.reshape(flat.shape)[flat]]
                becomes = np.where(after.reshape(flat.shape)[flat] == _USER, "user", "assistant")
                row = rows.reshape(flat.shape)[flat]
                ends = np.concatenate(([0], np.cumsum(n.ravel()))).astype(np.int32)
                spelled = "".join(edits.tolist())
                state = np.take_along_axis(after, np.maximum(n - 1, 0)[..., None], -1)[..., 0]
                state = np.where(n > 0, state, np.array(entries)[None, :])
                steps = pa.StructArray.from_arrays([pa.array(row), pa.array(edits.tolist(), pa.string()), pa.array(becomes.tolist(), pa.string())], fields=list(_STEP))
                where = np.repeat(which, len(entries))
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(where)),
                        pa.array(runs[where]),
                        pa.array(np.tile(np.array(entries, np.int32), len(which))),
                        pa.array(state.ravel().astype(np.int32)),
                        pa.array(costs[:, entries].ravel()),
                        pa.array([spelled[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string()),
                        pa.ListArray.from_arrays(ends, steps),
                    ],
                    names=["k", "run", "entry", "exit", "cost", "audit", "steps"],
                )

    return solve


def _entries(batches):
    """From the exit states of a conversation's runs, the entry state of each."""
    for batch in batches:
        for k, runs in zip(batch.column("k").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            entry, out = _START, []
            for r in runs:
                out.append({"k": k, "run": r["run"], "entry": entry})
                entry = r["exits"][entry]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("k", pa.string()), ("run", pa.int64()), ("entry", pa.int32())]))


def _is_blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def _key(column: str = "conv_id") -> Column:
    """A name of a conversation that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def mark(conversations: DataFrame) -> DataFrame:
    """Rows by conversation with ``row`` (from 0), ``fault`` (blank, duplicate, truncated or null), ``illegal`` (after
    the row before it) and what the solver reads; written once.

    Rows are ordered by turn (nulls first), then role, then text; null roles and texts count as one space; a null
    conv_id is one conversation; equal rows are rows of their own. Other columns are ignored.
    """
    space = F.lit(" ")
    rows = conversations.select(_key().alias("k"), "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    rows = rows.withColumns({"d1": F.xxhash64(F.lit(1), "role", "text"), "d2": F.xxhash64(F.lit(2), "role", "text"), "first": F.substring("role", 1, 1)})
    order = Window.partitionBy("k").orderBy("turn", "role", "text")
    again = Window.partitionBy("k", "d1", "d2").orderBy("row")
    rows = rows.withColumns({"row": F.row_number().over(order).cast("long") - 1, "before": F.lag("first").over(order), "last": F.lead("first").over(order).isNull()})
    rows = rows.withColumn("again", F.row_number().over(again) > 1)
    fault = F.when(_is_blank(F.col("text")), "blank").when(F.col("again"), "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    role = F.when(F.col("first") == "s", 0).when(F.col("first") == "u", 1).when(F.col("first") == "a", 2).otherwise(3)
    rows = rows.withColumn("fault", fault).withColumns(
        {
            "illegal": F.col("before").isNotNull() & ~F.concat("before", "first").isin("su", "ua", "au"),
            "code": role * 3 + F.when(F.col("fault") == "truncated", 1).when(F.col("fault").isNotNull(), 2).otherwise(0),
        }
    )
    return write_table(rows.select("k", "conv_id", "row", "turn", "role", "text", "fault", "illegal", "last", F.col("code").cast("long").alias("code")), "marked")


def plan(marked: DataFrame, size: int = RUN) -> DataFrame:
    """(k, run, entry, exit, cost, audit, steps): the least audit of every conversation, in pieces of ``size`` rows."""
    runs = marked.groupBy("k", F.floor(F.col("row") / size).cast("long").alias("run")).agg(F.sort_array(F.collect_list(F.struct("row", "code"))).alias("rows"), F.max("last").alias("last"))
    runs = write_table(runs.select("k", "run", "last", F.transform("rows", lambda r: r["code"]).alias("codes")), "runs")
    end = F.array(*[F.lit(int(x)).cast("long") for x in _END])
    whole = (F.col("run") == 0) & F.col("last")
    single = runs.filter(whole).withColumn("behind", end).mapInArrow(_solve([_START], size), _SOLVED)
    long = runs.filter(~whole)
    by_run = lambda df, *c: df.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("run", *c))).alias("runs")).select("k", "runs")
    matrices = long.mapInArrow(_matrices, "k string, run long, matrix array<long>")
    behind = by_run(matrices, "matrix").mapInArrow(_costs_behind, "k string, run long, behind array<long>")
    solved = write_table(long.join(behind, ["k", "run"]).select("k", "run", "last", "codes", "behind").mapInArrow(_solve([0, 1, 2, 3], size), _SOLVED), "solved")
    exits = solved.groupBy("k", "run").agg(F.transform(F.sort_array(F.collect_list(F.struct("entry", "exit"))), lambda r: r["exit"]).alias("exits"))
    taken = by_run(exits, "exits").mapInArrow(_entries, "k string, run long, entry int")
    return write_table(single.unionByName(solved.join(taken, ["k", "run", "entry"]).select(*single.columns)), "plan")


def repaired(marked: DataFrame, planned: DataFrame) -> DataFrame:
    """(k, run, step, row, edit, role, text) of every row that stays or is inserted, in order by (run, step)."""
    steps = planned.select("k", "run", F.posexplode("steps").alias("step", "s")).select("k", "run", "step", F.when(F.col("s.edit") != "I", F.col("s.row")).alias("row"), "s.edit", "s.becomes")
    kept = steps.filter(F.col("edit").isin("K", "R")).join(marked.select("k", "row", "role", "text"), ["k", "row"])
    kept = kept.select("k", "run", "step", "row", "edit", F.when(F.col("edit") == "R", F.col("becomes")).otherwise(F.col("role")).alias("role"), "text")
    made = steps.filter("edit = 'I'").select("k", "run", "step", "row", "edit", F.col("becomes").alias("role"), F.lit("").alias("text"))
    return kept.unionByName(made)


def repair(conversations: DataFrame, size: int = RUN) -> DataFrame:
    """(conv_id, position, role, text, edit): the repaired conversations, row by row; positions grow, with gaps.

    A conversation whose rows are all deleted has no rows. A table without rows gives none. See ``mark`` for
    nulls, ties and repeated rows.
    """
    marked = mark(conversations)
    ids = marked.filter("row = 0").select("k", "conv_id")
    out = repaired(marked, plan(marked, size)).join(ids, "k")
    return out.select("conv_id", (F.col("run") * (4 * size) + F.col("step")).alias("position"), "role", "text", "edit")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, stripped of sentence ends, repeated or given the role user, by crc32 of ``conv_id:turn``."""
    space = F.lit(" ")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("how", F.crc32(F.encode(key, "UTF-8")) % 20).filter("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("how") == 4, "user").otherwise(F.col("role"))})
    copies = F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(copies)).select("conv_id", "turn", "role", "text")


def digests(given: DataFrame, size: int = RUN) -> DataFrame:
    """Faults, cost, audit and digest of every conversation of ``given`` after damage."""
    marked = mark(damage(given))
    planned = plan(marked, size)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    turns = marked.groupBy("k", "turn").agg(*[F.sum((F.col("fault") == f).cast("long")).alias(f) for f in ("blank", "duplicate", "truncated")], F.sum(F.col("illegal").cast("long")).alias("illegal"))
    counts = turns.groupBy("k").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    pieces = planned.groupBy("k").agg(F.min_by("cost", "run").alias("cost"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", "audit"))), lambda r: r["audit"]), "").alias("audit"))
    lines = repaired(marked, planned).select("k", F.struct("run", "step", F.concat("role", F.lit(":"), "text").alias("line")).alias("line"))
    texts = lines.groupBy("k").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda r: r["line"]), "\n"), 256).alias("sha"))
    ids = given.select(_key().alias("k"), "conv_id").distinct()
    joined = ids.join(counts, "k", "left").join(pieces, "k", "left").join(texts, "k", "left")
    return joined.select(
        "conv_id",
        *[zero(F.col(c)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations; see ``mark`` for nulls, ties and repeated rows. An empty table gives no rows."""
    return digests(documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
