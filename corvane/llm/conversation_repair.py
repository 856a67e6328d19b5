"""Operator 13. Conversation structure repair by lazy weighted determinisation.

A conversation is legal when its roles' initials read ``(s?(ua)+)?``.  Cheapest edits make it so: keep a row (0), give it the role
user or assistant (2), delete it (3; must be for a blank row or a duplicate), insert an empty row of user or assistant (2); a truncated row
that stays adds 1.  Of equally cheap edits the one whose letters (D, I, K, R) read least is taken; its letters also fix all roles.

Method: the places in the pattern are four states (nothing yet, after s, after u, after a).  From the last row to the first, the
vector of the states' costs up to the end, less its minimum, is a state of a deterministic automaton; these are made when they are first met
and kept with their transitions in a table, a few dozen in all, as costs of states differ by a bounded amount.  So the scan is one
look-up a row, and what the minima have lost adds up to the cost.  The trace then walks the scanned states back, from the first row on, along
arcs that are tight (cost before = cost of the edit + cost after), the least letter first; its steps are kept in the table too.

Plan: faults are found on the JVM; duplicates by a hash of role and text, so texts do not move for it.  Rows are then dealt by
conversation and sorted, and the scan holds a byte a row and a byte an edit of one conversation at a time, whatever its size.  Texts are dealt
once, behind their conversation's edits in one sorted stream, and repaired and hashed as they pass.  One conversation's rows do stream through one task: a
SHA-256 over its text is sequential.

Defined cases: null role and text are one space, as null ``conv_id`` and ``turn`` are in the key that decides damage; rows whose id is null
are one conversation; rows stand by turn, nulls first, and within a turn by a 128-bit hash of role and text, equal rows side by side; rows that
repeat are duplicates; empty texts are blank; a conversation without rows costs 0 and has an empty audit; very long texts are read whole; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm._common import cut

INK = r"[^\x20\x09-\x0D]"
RETYPE, DELETE, INSERT, CLIPPED = 2, 3, 2, 1
#: Next state by state (nothing yet, after s, after u, after a) and emitted initial; -1: not legal.
STEP = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
#: The only initial that can be inserted or given in a state.
NEXT = "uuau"
ROLE = {"u": "user", "a": "assistant"}
#: Row symbols: 2 * place in SUAX + truncated; from 8 on the row must go, 8 + 2 * place + duplicate; 255: no row.
SUAX, GONE, NO_ROW = "suax", 8, 255


class Automaton:
    """The deterministic automaton, made as far as it is used."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.ids: dict[tuple[int, ...], int] = {}
        self.table: list[list[int]] = []  # by state and symbol: the state before the row; -1: not made yet
        self.lost: list[list[int]] = []  # what the minimum lost on that way
        self.steps: list[dict[int, tuple[str, int]]] = []  # by state after the row, and symbol * 4 + state: letters, next state
        self.end, self.end_cost = self._state(self._inserted([0, 99, 99, 0]))

    @staticmethod
    def _inserted(costs: list[int]) -> list[int]:
        for _ in range(3):
            costs = [min(costs[q], INSERT + costs[STEP[NEXT[q]][q]]) for q in range(4)]
        return costs

    def _state(self, costs: list[int]) -> tuple[int, int]:
        low = min(costs)
        key = tuple(c - low for c in costs)
        if key not in self.ids:
            self.ids[key] = len(self.vectors)
            self.vectors.append(key)
            self.table.append([-1] * 9)
            self.lost.append([0] * 9)
            self.steps.append({})
        return self.ids[key], low

    @staticmethod
    def _consuming(after: tuple[int, ...], symbol: int, q: int) -> list[tuple[str, int, int]]:
        """Edits that use up a row in state q: letter, cost to the end, next state; letters ascend."""
        out = [("D", DELETE + after[q], q)]
        if symbol < GONE:
            clipped = CLIPPED * (symbol & 1)
            own = STEP.get(SUAX[symbol >> 1], (-1,) * 4)[q]
            if own >= 0:
                out.append(("K", clipped + after[own], own))
            to = STEP[NEXT[q]][q]
            out.append(("R", RETYPE + clipped + after[to], to))
        return out

    def before(self, state: int, symbol: int) -> int:
        after = self.vectors[state]
        costs = self._inserted([min(c for _, c, _ in self._consuming(after, symbol, q)) for q in range(4)])
        self.table[state][symbol], self.lost[state][symbol] = made, _ = self._state(costs)
        return made

    def step(self, after: int, symbol: int, q: int) -> tuple[str, int]:
        """Letters up to the edit of this row, the least along tight arcs, and the state behind it."""
        vector = self.vectors[after]
        costs = self._inserted([min(c for _, c, _ in self._consuming(vector, symbol, p)) for p in range(4)])
        letters, p = "", q
        while True:
            tight = {e: to for e, c, to in self._consuming(vector, symbol, p) if c == costs[p]}
            to = STEP[NEXT[p]][p]
            if "D" not in tight and costs[p] == INSERT + costs[to]:
                letters, p = letters + "I", to
                continue
            edit = min(tight)
            made = letters + edit, tight[edit]
            self.steps[after][symbol * 4 + q] = made
            return made

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """Cost and letters of the least cheapest repair of rows with these symbols (0..8)."""
        states, at, cost = [self.end], self.end, self.end_cost
        for s in reversed(symbols):
            made = self.table[at][s]
            if made < 0:
                made = self.before(at, s)
            cost += self.lost[at][s]
            at = made
            states.append(at)
        cost += self.vectors[at][0]
        q, out = 0, []
        for i, s in enumerate(symbols):
            after = states[len(symbols) - 1 - i]
            letters, q = self.steps[after].get(s * 4 + q) or self.step(after, s, q)
            out.append(letters)
        while self.vectors[self.end][q]:
            out.append("I")
            q = STEP[NEXT[q]][q]
        return cost, "".join(out)


_AUTOMATON = Automaton()  # one a worker: batches share what is made

_TO_TABLE = bytes(min(i, GONE) for i in range(256))
_LEGAL = np.zeros((4, 4), dtype=bool)
for _pair in ("su", "ua", "au"):
    _LEGAL[SUAX.index(_pair[0]), SUAX.index(_pair[1])] = True


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, there``: the rows with damage done by a hash of their key; dropped ones have ``there`` false."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("there"), F.explode(copies).alias("copy")).drop("copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """With two hashes of the conversation and two of role and text, by which rows are dealt and sorted."""
    two = lambda *c: (F.xxhash64(*c), F.xxhash64(F.lit("2"), *c))
    k1, k2 = two(F.col("conv_id").isNull(), "conv_id")
    r1, r2 = two("role", "text")
    return rows.withColumns({"k1": k1, "k2": k2, "r1": r1, "r2": r2})


def faults(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, k1, k2, r1, r2, symbol`` of damaged rows; the symbol has the row's initial and first fault."""
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank = ~F.col("text").rlike(INK)
    clipped = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    seen = F.row_number().over(Window.partitionBy("k1", "k2", "r1", "r2", "there").orderBy(F.col("turn").asc_nulls_first())) > 1
    bare = _keyed(rows).select("conv_id", "turn", "k1", "k2", "r1", "r2", "there", place.alias("place"), blank.alias("blank"), clipped.alias("clipped"))
    symbol = (
        F.when(~F.col("there"), NO_ROW)
        .when(F.col("blank"), GONE + 2 * F.col("place"))
        .when(seen, GONE + 2 * F.col("place") + 1)
        .otherwise(2 * F.col("place") + F.col("clipped").cast("int"))
    )
    return bare.select("conv_id", "turn", "k1", "k2", "r1", "r2", symbol.cast("short").alias("symbol"))


AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _summary(symbols: bytearray, turns: tuple[int, int, int] | None) -> tuple:
    """What one conversation's row says, without its id."""
    codes = np.frombuffer(bytes(symbols), dtype=np.uint8)
    gone = codes >= GONE
    place = (codes & 7) >> 1
    odd = (codes & 1).astype(bool)
    cost, letters = _AUTOMATON.repair(bytes(symbols).translate(_TO_TABLE))
    gaps = 0 if turns is None else turns[1] - turns[0] + 1 - turns[2]
    return gaps, int((gone & ~odd).sum()), int((gone & odd).sum()), int((~gone & odd).sum()), int((~_LEGAL[place[:-1], place[1:]]).sum()), cost, letters


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and place to one row a conversation; only the open one's symbols are held."""
    key, symbols, turns, first, last = None, bytearray(), None, None, None
    schema = None

    def closed() -> tuple:
        return *key, *_summary(symbols, turns)

    for batch in batches:
        if not batch.num_rows:
            continue
        b = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        k1, k2 = b["k1"].to_numpy(), b["k2"].to_numpy()
        sym = b["symbol"].to_numpy().astype(np.uint8)
        valid = np.asarray(b["turn"].is_valid()) & (sym != NO_ROW)
        turn = b["turn"].fill_null(0).to_numpy()
        new = np.ones(len(k1), dtype=bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        starts = np.append(np.flatnonzero(new), len(k1))
        done = []
        for a, e in zip(starts[:-1], starts[1:], strict=True):
            own = (int(k1[a]), int(k2[a]))
            if key is not None and key[:2] != own:
                done.append(closed())
                key = None
            if key is None:
                key, symbols, turns, last = (*own, b["conv_id"][int(a)].as_py()), bytearray(), None, None
            part = sym[a:e]
            symbols += part[part != NO_ROW].tobytes()
            t = turn[a:e][valid[a:e]]
            if len(t):
                fresh = int((t[1:] != t[:-1]).sum()) + (last is None or last != t[0])
                turns = (int(t[0]), int(t[-1]), fresh) if turns is None else (turns[0], int(t[-1]), turns[2] + fresh)
                last = t[-1]
        schema = schema or _schema(batch.schema.field("conv_id").type)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(closed(), schema, strict=True)], schema=schema)


def _schema(kind: pa.DataType) -> pa.Schema:
    longs = [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("conv_id", kind), *longs, ("audit", pa.string())])


def audits(rows: DataFrame) -> DataFrame:
    """``k1, k2, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of each conversation of damaged (or any) rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    dealt = faults(rows).repartition("k1", "k2").sortWithinPartitions("k1", "k2", F.col("turn").asc_nulls_first(), "r1", "r2", "symbol")
    return dealt.select("k1", "k2", "conv_id", "turn", "symbol").mapInArrow(_scan, f"k1 long, k2 long, conv_id {kind}, {AUDIT}")


def _repaired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stream of conversations, each its audit and then its rows, to the repaired rows in order."""
    letters, at, q, own, place = "", 0, 0, None, 0
    names = ["k1", "k2", "place", "edit", "role", "text"]
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("place", pa.int64()), *[(n, pa.string()) for n in names[3:]]])

    def inserts(out: list[tuple]) -> None:
        nonlocal at, q, place
        while at < len(letters) and letters[at] == "I":
            out.append((*own, place, "I", ROLE[NEXT[q]], ""))
            at, q, place = at + 1, STEP[NEXT[q]][q], place + 1

    for batch in batches:
        out: list[tuple] = []
        for k1, k2, audit, role, text in zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("k1", "k2", "audit", "role", "text")], strict=True):
            if audit is not None:
                if own is not None:
                    inserts(out)
                letters, at, q, own, place = audit, 0, 0, (k1, k2), 0
                continue
            inserts(out)
            edit = letters[at]
            at += 1
            if edit == "D":
                continue
            role = ROLE[NEXT[q]] if edit == "R" else role
            q = STEP[role[0]][q]
            out.append((*own, place, edit, role, text))
            place += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    out = []
    if own is not None:
        inserts(out)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``k1, k2, place, edit, role, text``: the repaired conversations' rows, a conversation's side by side and in order."""
    none = F.lit(None).cast("string")
    texts = _keyed(rows.filter("there")).select("k1", "k2", none.alias("audit"), "turn", "r1", "r2", "role", "text")
    heads = found.select("k1", "k2", "audit", F.lit(None).cast("long").alias("turn"), *[F.lit(None).cast("long").alias(c) for c in ("r1", "r2")], none.alias("role"), none.alias("text"))
    dealt = texts.unionByName(heads).repartition("k1", "k2")
    dealt = dealt.sortWithinPartitions("k1", "k2", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "r1", "r2")
    return dealt.select("k1", "k2", "audit", "role", "text").mapInArrow(_repaired, "k1 long, k2 long, place long, edit string, role string, text string")


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order to each conversation's SHA-256 of ``role:text`` lines; nothing but the hash is held."""
    own, sha, done = None, None, []

    def pack() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done])], names=["k1", "k2", "sha"])

    for batch in batches:
        done = []
        for k1, k2, role, text in zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("k1", "k2", "role", "text")], strict=True):
            if own != (k1, k2):
                if own is not None:
                    done.append((*own, sha.hexdigest()))
                own, sha = (k1, k2), hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        if done:
            yield pack()
    if own is not None:
        done = [(*own, sha.hexdigest())]
        yield pack()


def digests(lines: DataFrame) -> DataFrame:
    """``k1, k2, sha`` of what ``repaired`` gives; it must come straight from there, as it relies on the order."""
    return lines.select("k1", "k2", "role", "text").mapInArrow(_hashed, "k1 long, k2 long, sha string")


def repair(rows: DataFrame) -> DataFrame:
    """``conv_id``, faults, cost, audit and ``repaired_sha256`` of each conversation of rows as ``damage`` gives them."""
    found = cut(audits(rows))
    sha: Column = F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest()))
    met = found.join(digests(repaired(rows, found)), ["k1", "k2"], "left")
    return met.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", sha.alias("repaired_sha256"))
