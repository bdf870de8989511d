"""Cheapest repair of the turns of conversations, by the method of the Four Russians.

A row is a symbol: one that must go, or its role's initial with or without a truncated text. What the rest of a conversation
costs depends on what the roles so far ask for next, so it is a vector of four costs. Less their least, only a few such vectors
can occur. Tables built once hold, for every block of ``BLOCK_ROWS`` symbols and every vector after it, the vector before it
and the costs between. Costs are found from the end by one lookup a block. Edits are then read from the start: each block is
expanded backward into the vectors between its rows, which show every cheapest edit, and the ASCII-least one is taken.

Rows are range-sorted, so a conversation of any length is spread over tasks in chunks. A conversation within one chunk is
finished where it is read. For others, each chunk gives the effect it has on every vector, a short scan over chunks gives the
vector after each and the state before each, and chunks are traced apart. Only the digest of the repaired text must see a
conversation in order; it streams.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.llm.common import read_table, settle

RULES = 20
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLOCK_ROWS = 4
CHUNK_ROWS = 4096
CHUNK_BYTES = 1 << 22
#: What may follow: from nothing, after the system's turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
MADE = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
KEPT, BLANK, DUPLICATE, CUT = range(4)
#: Symbols: a row that must go; a whole or a cut row of ``s``, ``u``, ``a`` or another initial; and no row.
GONE, PAD, SYMBOLS = 0, 9, 10
FAR = 1 << 20


def symbol(initial: str, fault: int) -> int:
    """Symbol of a row."""
    if fault in (BLANK, DUPLICATE):
        return GONE
    return (5 if fault == CUT else 1) + "sua".find(initial if initial in ("s", "u", "a") else "-") % 4


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    for _ in range(3):
        costs = [min(c, INSERT + costs[FOLLOWS[q][MADE[q]]]) for q, c in enumerate(costs)]
    return tuple(costs)


END = _with_inserts([0, FAR, FAR, 0])


def before(after: tuple[int, ...], sym: int) -> tuple[int, ...]:
    """Costs from each state on, before a row, from those after it."""
    if sym == PAD:
        return after
    costs = [DELETE + c for c in after]
    if sym != GONE:
        more = TRUNCATED if sym > 4 else 0
        own = "sua-"[(sym - 1) % 4]
        for q, follows in enumerate(FOLLOWS):
            if own in follows:
                costs[q] = min(costs[q], more + after[follows[own]])
            costs[q] = min(costs[q], more + REROLE + after[follows[MADE[q]]])
    return _with_inserts(costs)


class Tables(NamedTuple):
    vectors: list[tuple[int, ...]]
    step: np.ndarray
    step_cost: np.ndarray
    block: np.ndarray
    block_cost: np.ndarray
    end: int


@functools.cache
def tables() -> Tables:
    """Vectors less their least, and the steps of single symbols and of whole blocks between them."""
    number, vectors, steps = {END: 0}, [END], []
    for vector in vectors:
        row = []
        for sym in range(SYMBOLS):
            costs = before(vector, sym)
            low = min(costs)
            lower = tuple(c - low for c in costs)
            if lower not in number:
                number[lower] = len(vectors)
                vectors.append(lower)
            row.append((number[lower], low))
        steps.append(row)
    step, cost = (np.array([[s[k] for s in row] for row in steps], dtype=np.int64).T for k in (0, 1))
    block, block_cost = np.arange(len(vectors))[None, :], np.zeros((1, len(vectors)), dtype=np.int64)
    for _ in range(BLOCK_ROWS):
        block_cost = np.concatenate([block_cost + cost[s][block] for s in range(SYMBOLS)])
        block = np.concatenate([step[s][block] for s in range(SYMBOLS)])
    return Tables(vectors, step, cost, block, block_cost, 0)


@functools.cache
def edit(sym: int, after: int, state: int) -> tuple[str, str, int]:
    """ASCII-least cheapest edits up to and with a row, the roles they give, and the state after them.

    Roles are ``k`` for a row that is kept and ``-`` for one that goes.
    """
    t = tables()
    then = t.vectors[after]
    now = before(then, sym)
    own, more = ("sua-"[(sym - 1) % 4], TRUNCATED if sym > 4 else 0) if sym != GONE else ("-", FAR)
    edits = roles = ""
    while True:
        made = MADE[state]
        if now[state] == DELETE + then[state]:
            return edits + "D", roles + "-", state
        if now[state] == INSERT + now[FOLLOWS[state][made]]:
            edits, roles, state = edits + "I", roles + made, FOLLOWS[state][made]
        elif own in FOLLOWS[state] and now[state] == more + then[FOLLOWS[state][own]]:
            return edits + "K", roles + "k", FOLLOWS[state][own]
        else:
            return edits + "R", roles + made, FOLLOWS[state][made]


def closing(state: int) -> tuple[str, str]:
    """Turns to insert at the end of a conversation, and their roles."""
    roles = ""
    while END[state] > 0:
        roles, state = roles + MADE[state], FOLLOWS[state][MADE[state]]
    return "I" * len(roles), roles


def _codes(symbols: bytes) -> np.ndarray:
    padded = bytes([PAD]) * (-len(symbols) % BLOCK_ROWS) + symbols
    digits = np.frombuffer(padded, dtype=np.uint8).reshape(-1, BLOCK_ROWS).astype(np.int64)
    return digits @ (SYMBOLS ** np.arange(BLOCK_ROWS - 1, -1, -1))


def effect(symbols: bytes) -> np.ndarray:
    """For every vector after the rows, the vector before them."""
    t = tables()
    at = np.arange(len(t.vectors))
    for code in _codes(symbols)[::-1]:
        at = t.block[code, at]
    return at


def trace(symbols: bytes, after: int, state: int) -> tuple[list[tuple[str, str]], int, int, int]:
    """Edits and roles of each row, the state after the rows, and vector and costs before them."""
    t = tables()
    codes = _codes(symbols)
    ends, vector, cost = [], after, 0
    for code in codes[::-1].tolist():
        ends.append(vector)
        cost += int(t.block_cost[code, vector])
        vector = int(t.block[code, vector])
    out, first = [], -len(symbols) % BLOCK_ROWS
    for k, end in enumerate(reversed(ends)):
        part = symbols[max(0, k * BLOCK_ROWS - first) : (k + 1) * BLOCK_ROWS - first]
        inner = [end]
        for sym in part[:0:-1]:
            inner.append(int(t.step[sym, inner[-1]]))
        for sym, then in zip(part, reversed(inner)):
            edits, roles, state = edit(sym, then, state)
            out.append((edits, roles))
    return out, state, vector, cost


def repaired(rows: list[tuple[str, str]], steps: list[tuple[str, str]], end: str) -> list[str]:
    """Lines ``role:text`` of the repaired conversation."""
    lines = []
    for (role, text), (edits, roles) in zip(rows, steps):
        for e, r in zip(edits, roles):
            if e != "D":
                lines.append(f"{role if e == 'K' else NAMES[r]}:{'' if e == 'I' else text}")
    return lines + [f"{NAMES[r]}:" for r in end]


FIGURES = ["blank", "duplicate", "truncated", "illegal", "turns"]
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Chunk(NamedTuple):
    """Rows of one conversation that follow each other: their symbols, roles and texts, and what they count."""

    symbols: bytes
    rows: list[tuple[str, str]]
    figures: list[int]
    first: str
    last: str
    low: int | None
    high: int | None


def _chunk(rows: list[tuple]) -> _Chunk:
    initials = [role[:1] for role, _, _, _ in rows]
    faults = [fault for _, _, fault, _ in rows]
    turns = [turn for _, _, _, turn in rows if turn is not None]
    figures = [faults.count(k) for k in (BLANK, DUPLICATE, CUT)]
    figures.append(sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])))
    figures.append(len(set(turns)))
    symbols = bytes(map(symbol, initials, faults))
    low, high = (turns[0], turns[-1]) if turns else (None, None)
    return _Chunk(symbols, [(role, text) for role, text, _, _ in rows], figures, initials[0], initials[-1], low, high)


class _Report:
    """The result of one conversation, chunk after chunk."""

    def __init__(self) -> None:
        self.figures, self.last, self.low, self.high = [0] * len(FIGURES), None, None, None
        self.audit: list[str] = []
        self.digest, self.lines, self.cost = hashlib.sha256(), 0, 0

    def add(self, chunk: _Chunk, steps: list[tuple[str, str]], end: tuple[str, str], cost: int) -> None:
        self.figures = [a + b for a, b in zip(self.figures, chunk.figures)]
        if self.last is not None:
            self.figures[3] += self.last + chunk.first not in LEGAL
        if chunk.low is not None:
            self.figures[4] -= chunk.low == self.high
            self.low, self.high = chunk.low if self.low is None else self.low, chunk.high
        self.last = chunk.last
        self.cost += cost
        self.audit.extend(e for e, _ in steps)
        self.audit.append(end[0])
        for line in repaired(chunk.rows, steps, end[1]):
            self.digest.update(("\n" if self.lines else "").encode() + line.encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.figures[4]
        return gaps, *self.figures[:4], self.cost, "".join(self.audit), self.digest.hexdigest()


CHUNK = (
    "pid int, no int, whole boolean, figures array<long>, first string, last string, low long, high long, symbols binary, "
    f"roles array<string>, texts array<string>, at array<int>, {RESULT}"
)


def _schema(kind: pa.DataType) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in CHUNK.split(", ")]
    return pa.schema([("conv_id", kind)] + [(n, kinds.get(t) or pa.list_(kinds[t[6:-1]])) for n, t in fields])


def _cut(chunk_rows: int):
    """Sorted rows to chunks; conversations surely within one chunk are finished at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, no, schema, out = TaskContext.get().partitionId(), 0, None, []
        rows: list[tuple] = []
        conv, opened, size = None, False, 0

        def close(last: bool) -> None:
            nonlocal no, rows, size, opened
            chunk = _chunk(rows)
            whole = last and opened
            if whole:
                report = _Report()
                steps, state, vector, cost = trace(chunk.symbols, tables().end, START)
                report.add(chunk, steps, closing(state), cost + tables().vectors[vector][START])
                rest = [[], "", "", None, None, b"", [], [], [], *report.row()]
            else:
                roles, texts = (list(c) for c in zip(*chunk.rows))
                rest = [chunk.figures, *chunk[3:7], chunk.symbols, roles, texts, effect(chunk.symbols).tolist()] + [None] * 8
            out.append([conv, pid, no, whole, *rest])
            no, rows, size = no + 1, [], 0

        def ready() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out), schema)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            schema = schema or _schema(batch.schema.field(0).type)
            for this, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and this != conv:
                    close(True)
                    opened = True
                elif len(rows) >= chunk_rows or size >= CHUNK_BYTES:
                    close(False)
                    opened = False
                conv = this
                rows.append((role, text, fault, turn))
                size += len(text)
                if len(out) >= 1024 or sum(len(o[10]) for o in out[-1:]) > 256:
                    yield ready()
        if rows:
            close(False)
        if out:
            yield ready()

    return run


def _right_vectors(group: pa.Table) -> pa.Table:
    """The vector after each chunk of a conversation, and whether it is the last."""
    group = group.sort_by([("pid", "ascending"), ("no", "ascending")])
    after, vector = [], tables().end
    for at in reversed(group.column("at").to_pylist()):
        after.append(vector)
        vector = at[vector]
    after.reverse()
    last = [False] * (len(after) - 1) + [True]
    return pa.table([group.column("pid"), group.column("no"), pa.array(after, pa.int32()), pa.array(last)], ["pid", "no", "after", "is_last"])


def _left_states(group: pa.Table) -> pa.Table:
    """The state before each chunk of a conversation."""
    group = group.sort_by([("pid", "ascending"), ("no", "ascending")])
    states, state = [], START
    for then in group.column("then").to_pylist():
        states.append(state)
        state = then[state]
    return pa.table([group.column("pid"), group.column("no"), pa.array(states, pa.int32())], ["pid", "no", "state"])


def _through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State after a chunk for each state before it."""
    for batch in batches:
        pairs = zip(batch.column(4).to_pylist(), batch.column(3).to_pylist())
        then = [[trace(s, after, q)[1] for q in range(len(FOLLOWS))] for s, after in pairs]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(then, pa.list_(pa.int32()))], ["conv_id", "pid", "no", "then"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of conversations in order to results."""
    report, conv, names, kind = None, None, [f.split()[0] for f in RESULT.split(", ")], None

    def done() -> pa.RecordBatch:
        types = [kind] + [pa.int64()] * 6 + [pa.string()] * 2
        columns = [pa.array([v], t) for v, t in zip((conv, *report.row()), types)]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", *names])

    for batch in batches:
        kind = batch.schema.field(0).type
        for r in batch.to_pylist():
            if report is not None and r["conv_id"] != conv:
                yield done()
                report = None
            report, conv = report or _Report(), r["conv_id"]
            rows = list(zip(r["roles"], r["texts"]))
            chunk = _Chunk(r["symbols"], rows, r["figures"], r["first"], r["last"], r["low"], r["high"])
            steps, state, vector, cost = trace(chunk.symbols, r["after"], r["state"])
            opening = tables().vectors[vector][START] if not report.audit else 0
            report.add(chunk, steps, closing(state) if r["is_last"] else ("", ""), cost + opening)
    if report is not None:
        yield done()


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` after the damage that the checksum of a row's place names; nulls read as a space."""
    def known(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rule = F.crc32(F.concat_ws(":", known("conv_id"), known("turn"))) % RULES
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), known("role").alias("role"), known("text").alias("text"), rule.alias("rule"))
    text = F.when(F.col("rule") == 1, "").when(F.col("rule") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("rule") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("rule") == 3, 2).otherwise(1)))
    return rows.where("rule <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("one")).drop("one")


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Faults and cheapest repair of every conversation of ``rows(conv_id, turn, role, text)``.

    Rows follow each other by turn (nulls first), then by role and a digest of the text, so repeated rows are neighbours and rows of
    one turn have a fixed order. A null role or text counts as one space, which is blank and no role to keep. Null conversation ids
    are one conversation. Texts are never cut; other columns are not read; an empty table gives an empty result.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    some = r"[^\x20\x09-\x0D]"
    filled = [F.coalesce(F.col(n).cast("string"), F.lit(" ")).alias(n) for n in ("role", "text")]
    named = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *filled)
    named = settle(named.withColumn("key", F.md5(F.concat_ws(":", "role", "text"))).withColumn("rid", F.monotonically_increasing_id()), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "key", "rid")
    firsts = named.where(F.col("text").rlike(some)).groupBy("conv_id", "role", "key").agg(F.min(place)["rid"].alias("rid"))
    fault = (
        F.when(~F.col("text").rlike(some), BLANK).when(F.col("first").isNull(), DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(KEPT)
    )
    judged = named.join(firsts.select("rid", F.lit(True).alias("first")), "rid", "left").withColumn("fault", fault)
    judged = settle(judged.select("conv_id", "turn", "role", "text", "fault", "key", "rid"), "judged")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "key", "rid"]
    ordered = judged.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "fault")
    chunks = settle(ordered.mapInArrow(_cut(chunk_rows), f"conv_id {kind}, {CHUNK}"), "chunks")
    parts = chunks.where("NOT whole")
    after = settle(parts.select("conv_id", "pid", "no", "at").groupBy("conv_id").applyInArrow(_right_vectors, "pid int, no int, after int, is_last boolean"), "after")
    seen = parts.select("conv_id", "pid", "no", "symbols").join(after, ["pid", "no"]).select("conv_id", "pid", "no", "after", "symbols")
    then = seen.mapInArrow(_through, f"conv_id {kind}, pid int, no int, then array<int>")
    states = then.groupBy("conv_id").applyInArrow(_left_states, "pid int, no int, state int")
    placed = parts.drop("at", *(f.split()[0] for f in RESULT.split(", "))).join(after, ["pid", "no"]).join(states, ["pid", "no"])
    placed = placed.select("conv_id", *(c for c in placed.columns if c != "conv_id"))
    streamed = placed.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "pid", "no")
    result = chunks.where("whole").select("conv_id", *(f.split()[0] for f in RESULT.split(", ")))
    return result.union(streamed.mapInArrow(_finish, f"conv_id {kind}, {RESULT}"))


def op12_four_russians(spark, sf_dir: str) -> DataFrame:
    """Faults and repair of every conversation after damage."""
    given = read_table(spark, sf_dir, "conversations")
    found = repair(damaged(given))
    every = given.select(F.col("conv_id").alias("given")).distinct()
    joined = every.join(found, F.col("given").eqNullSafe(F.col("conv_id")), "left")
    numbers = [F.coalesce(n, F.lit(0)).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
    return joined.select(F.col("given").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), nothing)
