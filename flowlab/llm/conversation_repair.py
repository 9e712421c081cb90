"""Conversation structure repair: cheapest edits, least audit among them.

A conversation's rows, in order of turn, are kept (K, 0), given the role that
is due (R, 2) or deleted (D, 3), and empty rows may be inserted (I, 2), so
that the roles read ``system? (user assistant)+`` or nothing.  A node is
(rows done, grammar state); the cost dynamic programme gives every node its
cost to the end, and an arc is optimal where its cost is the difference.

The audit is the edits' initials; among the cheapest the ASCII-least is
chosen by prefix doubling: nodes get the rank of their first letter and a
pointer one arc on, then again and again the rank of the pair (own rank, rank
at the pointer) and the pointer's pointer, so ranks compare audits of 1, 2, 4,
... edits.  Every node takes its optimal arc with the least (letter, rank of
its end), and the nodes of a path are read off the doubled pointers.

Nothing holds a conversation in one task but the digest of its text.  Rows go
in ranges of the whole order; a block is the part of one conversation in one
Arrow batch (at most BLOCK rows).  A block's costs are a 4 x 4 min-plus
matrix, its least paths a map from entry to exit state; only these, one row a
block, are walked through conversation by conversation, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import SPACES, cut, small_batches

BLOCK = 4096                    # rows of a block at most
SOLVE_ROWS = 1 << 16            # rows whose nodes are ranked together
FAR = np.int64(1) << 60         # cost of what can't be done

# grammar states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant (0 and 3 may end)
NEXT = np.array([2, 2, 3, 2])   # state after the role that is due
DUE = np.array([2, 2, 3, 2])    # that role's code: 1 system, 2 user, 3 assistant, 0 any other
ROLE = {2: "user", 3: "assistant"}
END = np.array([0, 4, 2, 0])    # cost of the inserts that end a conversation
OK, TRUNCATED, BLANK, DUPLICATE = range(4)
LETTERS = np.frombuffer(b"DIKR", np.uint8)      # in ASCII order: an edit's code is its rank
D, I, K, R = range(4)


# ---------------------------------------------------------------- costs and ranks

def edit_costs(role: np.ndarray, fault: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(delete, keep or rerole to the due role by state, keep as system) of
    rows; each stands for ``n`` equal rows of which all but the first are
    duplicates, deleted right after the first's edit."""
    delete = 3 * n
    stay = np.where(fault >= BLANK, FAR, (fault == TRUNCATED) + 3 * (n - 1))
    due = np.minimum(stay[:, None] + 2 * (role[:, None] != DUE[None, :]), FAR)
    return delete, due, np.where(role == 1, stay, FAR)


def costs_to_go(role: np.ndarray, fault: np.ndarray, n: np.ndarray, bounds: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Cost from every node to the end, rows + blocks x 4 x c, when the nodes
    past block b cost ``after[b]`` (4 x c); block b has the rows
    ``bounds[b]:bounds[b + 1]`` and its nodes start at row ``bounds[b] + b``."""
    delete, due, system = edit_costs(role, fault, n)
    blocks = len(bounds) - 1
    out = np.empty((len(role) + blocks, *after.shape[1:]), np.int64)
    h = after.copy()
    last = bounds[1:] + np.arange(blocks)
    out[last] = h
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    for t in range(1, int(size.max(initial=0)) + 1):
        b = order[:np.searchsorted(-size[order], -t, "right")]      # blocks with t rows or more
        r = bounds[b + 1] - t
        x = h[b]
        y = np.minimum(delete[r][:, None, None] + x, due[r][:, :, None] + x[:, NEXT])
        y[:, 0] = np.minimum(y[:, 0], system[r][:, None] + x[:, 1])
        y = np.minimum(y, np.minimum(2 + y[:, NEXT], 4 + y[:, NEXT[NEXT]]))     # inserts before the row
        y = np.minimum(y, FAR)
        h[b] = y
        out[last[b] - t] = y
    return out


class Paths(NamedTuple):
    edits: list[list[bytes]]    # by block and entry state: one letter a row, or an I
    exits: np.ndarray           # blocks x 4: state after the block


def least_paths(role: np.ndarray, fault: np.ndarray, n: np.ndarray, bounds: np.ndarray, after: np.ndarray,
                final: np.ndarray) -> Paths:
    """The ASCII-least cheapest path through every block from every state;
    ``final`` blocks end their conversation."""
    h = costs_to_go(role, fault, n, bounds, after[:, :, None])[:, :, 0]
    blocks, nodes = len(bounds) - 1, h.size
    node = np.arange(nodes).reshape(-1, 4)
    last = bounds[1:] + np.arange(blocks)
    inner = np.ones(len(h), bool)
    inner[last] = False
    first = bounds[:-1] + np.arange(blocks)
    delete, due, system = edit_costs(role, fault, n)

    # arcs by letter: whether one is optimal, and where it leads
    opt, to = np.zeros((4, len(h), 4), bool), np.zeros((4, len(h), 4), np.int64)
    here, there = h[inner], h[np.flatnonzero(inner) + 1]
    below = node[np.flatnonzero(inner) + 1]
    opt[D, inner], to[D, inner] = here == delete[:, None] + there, below
    kept = role[:, None] == DUE[None, :]
    onward = here == due + there[:, NEXT]
    opt[K, inner], to[K, inner] = onward & kept, below[:, NEXT]
    opt[R, inner], to[R, inner] = onward & ~kept, below[:, NEXT]
    as_system = here[:, 0] == system + there[:, 1]
    rows = np.flatnonzero(inner)[as_system]
    opt[K, rows, 0], to[K, rows, 0] = True, node[rows + 1, 1]
    may = inner.copy()
    may[last[final]] = True         # inserts past the last row; elsewhere they are the next block's
    opt[I] = (h == 2 + h[:, NEXT]) & may[:, None]
    to[I] = node[:, NEXT]
    opt &= h < FAR
    opt[:, last[final]] &= h[last[final]] > 0
    opt, to = opt.reshape(4, -1), to.reshape(4, -1)
    stays = ~opt.any(axis=0)        # exits, and nodes that no path can leave

    # ranks of audits of 1, 2, 4, ... edits; pointers as far
    each = np.arange(nodes)
    letter = np.where(stays, 0, opt.argmax(axis=0) + 1)
    rank, ahead = letter.copy(), np.where(stays, each, to[opt.argmax(axis=0), each])
    while True:
        rank = np.unique(rank * (nodes + 5) + rank[ahead], return_inverse=True)[1]
        if (ahead == ahead[ahead]).all():
            break
        ahead = ahead[ahead]

    # the optimal arc with the least (letter, rank of its end); the grammar gives a letter one end only
    key = np.where(opt, np.arange(4)[:, None] * nodes + rank[to], np.iinfo(np.int64).max)
    take = key.argmin(axis=0)
    step = np.where(stays, each, to[take, each])
    jumps, length = [step], (~stays).astype(np.int64)
    while (jumps[-1] != jumps[-1][jumps[-1]]).any():
        length = length + length[jumps[-1]]
        jumps.append(jumps[-1][jumps[-1]])

    start = node[first].ravel()
    count = length[start]
    at = np.concatenate([[0], np.cumsum(count)])
    place = np.arange(at[-1]) - np.repeat(at[:-1], count)
    found = np.repeat(start, count)
    for level, jump in enumerate(jumps):
        found = np.where((place >> level) & 1, jump[found], found)
    text = LETTERS[take[found]].tobytes()
    cutter = at.tolist()
    edits = [[text[cutter[4 * b + s]:cutter[4 * b + s + 1]] for s in range(4)] for b in range(blocks)]
    return Paths(edits, (jumps[-1][start] % 4).reshape(-1, 4))


# ---------------------------------------------------------------- rows and blocks

def _codes(roles: list[str]) -> np.ndarray:
    return np.array([{"s": 1, "u": 2, "a": 3}.get(x[:1], 0) for x in roles], np.int64)


def faulty_rows(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number ``n`` and fault.  ``rows`` has conv,
    turn, role, text and no nulls in the last two."""
    text = F.rtrim("text", F.lit(SPACES))
    light = rows.select("conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), text.alias("t")).select(
        "conv", "turn", "role", "digest", (F.col("t") == "").alias("blank"),
        (~F.substring("t", -1, 1).isin(".", "!", "?")).alias("open"))
    row = ["conv", "turn", "role", "digest"]
    equal = light.groupBy(*row).agg(F.count("*").alias("n"), F.max("blank").alias("blank"), F.max("open").alias("open"))
    # the earliest row of every (role, text): least struct, null turn first
    order = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    first = equal.groupBy("conv", "role", "digest").agg(F.min(order).alias("first")).select(
        "conv", F.col("first.turn").alias("turn"), "role", "digest", F.lit(0).cast("long").alias("n"),
        F.lit(False).alias("blank"), F.lit(False).alias("open"), F.lit(True).alias("first"))
    both = equal.withColumn("first", F.lit(False)).unionByName(first).groupBy(*row).agg(
        F.sum("n").alias("n"), F.max("blank").alias("blank"), F.max("open").alias("open"), F.max("first").alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(~F.col("first"), DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(OK)
    return both.select(*row, "n", fault.alias("fault"))


def blocks_of(rows: DataFrame) -> DataFrame:
    """``faulty_rows`` in order (turn, nulls first; rows of one turn by role,
    then digest), cut into blocks; numbers of blocks ascend in that order."""
    order = ["conv", "turn", "role", "digest"]
    conv = rows.schema["conv"].dataType.simpleString()
    names = ["conv", "block", "turns", "roles", "digests", "faults", "n", "matrix", "first_turn", "last_turn", "low_turn",
             "first_role", "last_role", "turns_seen", "blank", "duplicate", "truncated", "illegal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            convs = batch.column(0).to_pylist()
            start = np.array([i for i in range(rows) if i == 0 or convs[i] != convs[i - 1]])
            bounds = np.append(start, rows)
            turn = batch.column(1).fill_null(0).to_numpy()
            told = ~np.asarray(batch.column(1).is_null())
            role = _codes(batch.column(2).to_pylist())
            n, fault = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            unit = np.where(np.eye(4, dtype=bool), 0, FAR)
            h = costs_to_go(role, fault, n, bounds, np.broadcast_to(unit, (len(start), 4, 4)).copy())
            matrix = h[start + np.arange(len(start))].reshape(len(start), 16)
            opens = np.zeros(rows, bool)
            opens[start] = True
            before = np.roll(role, 1)
            legal = ((before == 1) & (role == 2)) | ((before == 2) & (role == 3)) | ((before == 3) & (role == 2))
            fresh = told & (opens | ~np.roll(told, 1) | (turn != np.roll(turn, 1)))
            end = bounds[1:] - 1

            def total(x):
                return pa.array(np.add.reduceat(x.astype(np.int64), start))

            def turn_at(at):
                return pa.array(turn[at], mask=~told[at])
            low = np.minimum.reduceat(np.where(told, turn, np.iinfo(np.int64).max), start)
            offsets = pa.array(bounds, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, c) for c in (batch.column(1), batch.column(2), batch.column(3),
                                                                    batch.column(5), batch.column(4))]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(start)), pa.array(number + np.arange(len(start))), *lists,
                pa.array(matrix.tolist(), pa.list_(pa.int64())), turn_at(start), turn_at(end),
                pa.array(low, mask=~np.logical_or.reduceat(told, start)), pa.array(role[start]), pa.array(role[end]),
                total(fresh), total(n * (fault == BLANK)),
                total(np.where(fault == DUPLICATE, n, np.where(fault == BLANK, 0, n - 1))), total(fault == TRUNCATED),
                total((~legal & ~opens) + n - 1)], names)
            number += len(start)

    ordered = rows.select(*order, "n", F.col("fault").cast("int").alias("fault"))
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order)
    with small_batches(rows.sparkSession, BLOCK):
        return cut(ordered.mapInArrow(run, (
            f"conv {conv}, block bigint, turns array<bigint>, roles array<string>, digests array<binary>, "
            "faults array<int>, n array<bigint>, matrix array<bigint>, first_turn bigint, last_turn bigint, "
            "low_turn bigint, first_role bigint, last_role bigint, turns_seen bigint, blank bigint, duplicate bigint, "
            "truncated bigint, illegal bigint")))


def _walk(blocks: DataFrame, descending: bool) -> DataFrame:
    """Blocks of a conversation one after the other in one task."""
    order = F.desc("block") if descending else F.asc("block")
    return blocks.repartition(F.col("conv")).sortWithinPartitions("conv", order)


def costs_after(blocks: DataFrame) -> DataFrame:
    """block, after (cost of every state behind it), final, and the whole
    conversation's cost on its first block (else 0).  A stream from the last
    block to the first that holds four numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far, known, conv, h, held = int(FAR), False, None, [], None

        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int64()))],
                ["block", "after", "final", "cost"])
        for batch in batches:
            out = []
            for c, block, m in zip(*(batch.column(k).to_pylist() for k in range(3))):
                final = not known or c != conv
                if held:
                    out.append((*held, h[0] if final else 0))
                if final:
                    known, conv, h = True, c, [int(x) for x in END]
                held = (block, h, final)
                h = [min(min(m[4 * s + k] + h[k] for k in range(4)), far) for s in range(4)]
            if out:
                yield batch_of(out)
        if held:
            yield batch_of([(*held, h[0])])

    rows = _walk(blocks.select("conv", "block", "matrix"), True)
    return rows.mapInArrow(run, "block bigint, after array<bigint>, final boolean, cost bigint")


def solved(blocks: DataFrame, after: DataFrame) -> DataFrame:
    """conv, block, cost, paths (edits by entry state), exits and what two
    neighbouring blocks compare."""
    conv = blocks.schema["conv"].dataType.simpleString()
    passed = ["conv", "block", "cost", "first_turn", "last_turn", "first_role", "last_role"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.diff(whole.column(len(passed)).offsets.to_numpy().astype(np.int64))
            part = (np.cumsum(sizes) - sizes) // SOLVE_ROWS
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                batch = whole.slice(lo, hi - lo)
                roles, faults, n, after, final = batch.columns[len(passed):]
                bounds = np.concatenate([[0], np.cumsum(sizes[lo:hi])])
                paths = least_paths(_codes(roles.flatten().to_pylist()), faults.flatten().to_numpy(), n.flatten().to_numpy(),
                                    bounds, np.array(after.to_pylist(), np.int64), np.array(final.to_pylist(), bool))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:len(passed)],
                     pa.array([[x.decode() for x in b] for b in paths.edits], pa.list_(pa.string())),
                     pa.array(paths.exits.tolist(), pa.list_(pa.int64()))], [*passed, "paths", "exits"])

    rows = blocks.join(after, "block").select(*passed, "roles", "faults", "n", "after", "final")
    with small_batches(blocks.sparkSession):
        return cut(rows.mapInArrow(run, (
            f"conv {conv}, block bigint, cost bigint, first_turn bigint, last_turn bigint, first_role bigint, "
            "last_role bigint, paths array<string>, exits array<bigint>")))


def entries(paths: DataFrame) -> DataFrame:
    """block, entry (state before it), and against the block before: whether
    the turn goes on (same_turn) and the roles don't (illegal_border)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, conv, state, turn, role = False, None, 0, None, 0
        for batch in batches:
            out = []
            for c, block, exits, t0, t1, r0, r1 in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if not known or c != conv:
                    known, conv, state = True, c, 0
                    out.append((block, 0, 0, 0))
                else:
                    out.append((block, state, int(t0 is not None and t0 == turn),
                                int((role, r0) not in ((1, 2), (2, 3), (3, 2)))))
                state, turn, role = exits[state], t1, r1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)],
                                                 ["block", "entry", "same_turn", "illegal_border"])

    rows = _walk(paths.select("conv", "block", "exits", "first_turn", "last_turn", "first_role", "last_role"), False)
    return rows.mapInArrow(run, "block bigint, entry bigint, same_turn bigint, illegal_border bigint")


def applied(blocks: DataFrame, paths: DataFrame, entry: DataFrame) -> DataFrame:
    """Per block: its statistics, audit and the rows that stay, as (place,
    edit, role after, turn, role, digest); inserted rows have no digest."""
    conv = blocks.schema["conv"].dataType.simpleString()
    passed = ["conv", "block", "cost", "turns_seen", "same_turn", "low_turn", "last_turn", "blank", "duplicate",
              "truncated", "illegal"]
    kept = pa.list_(pa.struct([("place", pa.int64()), ("edit", pa.string()), ("now", pa.string()), ("turn", pa.int64()),
                               ("role", pa.string()), ("digest", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits, stays = [], []
            for edits, state, turns, roles, digests, n in zip(*(c.to_pylist() for c in batch.columns[len(passed):])):
                audit, rows, i = [], [], 0
                for edit in edits:
                    if edit == "K" and roles[i][:1] == "s":
                        state = 1
                    elif edit != "D":
                        state = int(NEXT[state])
                    if edit == "I":
                        rows.append((len(rows), edit, ROLE[state], None, None, None))
                    elif edit != "D":
                        rows.append((len(rows), edit, roles[i] if edit == "K" else ROLE[state], turns[i], roles[i], digests[i]))
                    audit.append(edit)
                    if edit != "I":
                        audit.append("D" * (n[i] - 1))
                        i += 1
                audits.append("".join(audit))
                stays.append([dict(zip(("place", "edit", "now", "turn", "role", "digest"), r)) for r in rows])
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(passed)], pa.array(audits, pa.string()),
                                              pa.array(stays, kept)], [*passed, "audit", "rows"])

    rows = blocks.join(paths.select("block", "cost", "paths"), "block").join(entry, "block")
    rows = rows.withColumn("illegal", F.col("illegal") + F.col("illegal_border")).select(
        *passed, F.col("paths")[F.col("entry").cast("int")].alias("edits"), "entry", "turns", "roles", "digests", "n")
    with small_batches(blocks.sparkSession):
        return cut(rows.mapInArrow(run, (
            f"conv {conv}, " + ", ".join(f"{c} bigint" for c in passed[1:]) + ", audit string, rows array<struct<"
            "place:bigint,edit:string,now:string,turn:bigint,role:string,digest:binary>>")))


class Repair(NamedTuple):
    report: DataFrame           # one row a conversation
    rows: DataFrame             # the repaired conversations' rows


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> Repair:
    """``report``: conv, gaps, blank, duplicate, truncated, illegal, cost and
    audit of every conversation.  ``rows``: conv, block, place, edit, role and
    text of the repaired rows, in order of block and place.

    Null roles and texts are one space.  A null conversation id is an id, null
    turns come first and count in no gap.  Rows of one turn go by role, then
    text digest; equal rows of a turn stand together (the later ones are
    duplicates).  An empty role, or one that starts with another letter, is
    never legal.  Conversations and texts may have any length; extra columns
    are ignored; an empty table gives no rows."""
    plain = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                        F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("text"))
    blocks = blocks_of(faulty_rows(plain))
    paths = solved(blocks, costs_after(blocks))
    done = applied(blocks, paths, entries(paths))

    wide = "decimal(20,0)"      # the span of two longs
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    report = done.groupBy("conv").agg(
        F.min("low_turn").cast(wide).alias("low"), F.max("last_turn").cast(wide).alias("high"),
        (F.sum("turns_seen") - F.sum("same_turn")).alias("seen"), *sums,
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    gaps = F.coalesce((F.col("high") - F.col("low") + 1 - F.col("seen")).cast("long"), F.lit(0))
    report = report.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    # a row that stays meets its text again: at most one of them under each of these keys
    staying = done.select("conv", "block", F.explode("rows").alias("r")).select(
        "conv", "block", "r.place", "r.edit", "r.now", "r.turn", "r.role", "r.digest")
    inserted = staying.where("edit = 'I'").select("conv", "block", "place", "edit", F.col("now").alias("role"),
                                                  F.lit("").alias("text"))
    texts = plain.select("conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text").withColumn(
        "row", F.lit(None).cast("struct<block:bigint,place:bigint,edit:string,now:string>"))
    found = staying.where("edit <> 'I'").select("conv", "turn", "role", "digest", F.lit(None).cast("string").alias("text"),
                                                F.struct("block", "place", "edit", "now").alias("row"))
    found = found.unionByName(texts).groupBy("conv", "turn", "role", "digest").agg(
        F.max("text").alias("text"), F.max("row").alias("row")).where("row IS NOT NULL")
    found = found.select("conv", "row.block", "row.place", "row.edit", F.col("row.now").alias("role"), "text")
    return Repair(report, found.unionByName(inserted))


def transcript_digests(rows: DataFrame) -> DataFrame:
    """conv and the sha256 of its ``role:text`` lines, newline-joined.  One hash
    runs over one conversation from start to end, so its rows are read in order
    in one task, as a stream of batches; Spark sorts and spills them."""
    conv = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = None, None
        for batch in batches:
            convs, digests = [], []
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if state is None or c != current:
                    if state is not None:
                        convs.append(current)
                        digests.append(state.hexdigest())
                    state, current = hashlib.sha256(), c
                else:
                    state.update(b"\n")
                state.update(role.encode() + b":" + text.encode())
            if convs:
                yield pa.RecordBatch.from_arrays([pa.array(convs, batch.column(0).type), pa.array(digests)], ["conv", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], batch.column(0).type), pa.array([state.hexdigest()])],
                                             ["conv", "sha256"])

    ordered = rows.repartition(F.col("conv")).sortWithinPartitions("conv", "block", "place")
    return ordered.select("conv", "role", "text").mapInArrow(run, f"conv {conv}, sha256 string")


def repair_report(rows: DataFrame, everything: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """The report and ``repaired_sha256`` of every conversation of
    ``everything``; those without rows have zeros and the hash of ''."""
    result = repair(rows, conv_col)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    zero = [F.lit(0).cast("long").alias(c) for c in numbers]
    none = F.sha2(F.lit(""), 256)
    # every part has one row a conversation; null ids group like any other
    parts = result.report.withColumn("sha256", F.lit(None).cast("string")).unionByName(
        transcript_digests(result.rows).select("conv", *zero, F.lit("").alias("audit"), "sha256")).unionByName(
        everything.select(F.col(f"`{conv_col}`").alias("conv")).distinct().select(
            "conv", *zero, F.lit("").alias("audit"), F.lit(None).cast("string").alias("sha256")))
    return parts.groupBy("conv").agg(*[F.max(c).alias(c) for c in (*numbers, "audit")],
                                     F.coalesce(F.max("sha256"), none).alias("repaired_sha256")).withColumnRenamed("conv", conv_col)


# ---------------------------------------------------------------- damage

def damage(rows: DataFrame) -> DataFrame:
    """Damage rows of (conv_id, turn, role, text) by crc32 of ``conv_id:turn``
    modulo 20: 0 drops the row, 1 empties its text, 2 removes its sentence
    ends, 3 repeats it, 4 sets role user.  Nulls read as one space."""
    def plain(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), kind.alias("kind"))
    out = out.where("kind <> 0").withColumn("text", text).withColumn(
        "role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return out.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")
