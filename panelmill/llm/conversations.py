"""Conversation structure repair by a run-length dynamic program.

A conversation is repaired by the cheapest edits that make its role initials match (s?(ua)+)?: Keep 0, Rerole to user or
assistant 3, Delete 4, Insert an empty user or assistant turn 3; a blank or duplicate turn has to be deleted, a truncated one that stays
costs 3 more. Of equally cheap edits the ASCII-least string of initials counts; it fixes the repaired roles.

Every turn is a symbol (class of its role, fault). Equal consecutive symbols are one run. A symbol is a min-plus matrix over
the four states of the pattern; its powers of two are made once a process, so a run of n turns advances the costs in log n steps.
Costs go backwards over the runs; forwards, choices are unrolled to an edit string a turn, and inside a run the costs are again taken
from the powers, halving the run.

The turns of all conversations are sorted by (conversation, turn) over range partitions, without their texts, so a long
conversation lies in several partitions. What a partition holds of a conversation is a fragment with a 4 x 4 matrix of its own.
Only fragments of conversations that cross a partition's edge (at most two a partition) meet on the driver: their matrices give the costs
behind each of them, and a second pass the state before each. Then all fragments are unrolled side by side.

Defined results: null roles and texts are one blank, as are null numbers in the key that deals out damage; a null conv_id is a conversation of its own; turns
go by number, nulls first, equal numbers by role and digest of the text; equal rows are adjacent, and all but the first are duplicates; an empty role has no
initial and is never kept; an empty table gives an empty result. Columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import stored

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: States of the pattern: begin, behind s, behind u, behind a. It may end in the first and the last.
STATES = 4
FAR = 1 << 40
ENDING = (0, FAR, FAR, 0)
#: Next state for the role initials s, u, a (-1: not allowed), and what is inserted in a state.
NEXT = ((1, 2, -1), (-1, 2, -1), (-1, -1, 3), (-1, 2, -1))
INSERTED = (1, 1, 2, 1)
ROLES = ("system", "user", "assistant")
#: Symbols: 0 to 3 are s, u, a and other roles; 4 to 7 the same, truncated; 8 has to be deleted.
CONDEMNED = 8
PART_BITS = 33
EDITS = "conv_id long, place long, turn long, initial string, fault int, copies long, opening boolean, edits string, k1 long, k2 long"
DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


# --- damage --------------------------------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """The turns (conv_id, turn, role, text, copies) after damage by crc32 of "conv_id:turn" modulo 20.

    0 drops a turn, 1 empties its text, 2 removes its sentence marks, 3 repeats it, 4 makes it the user's.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    return turns.where(kind != 0).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(blank("role")).alias("role"),
        text.alias("text"),
        F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


# --- costs ---------------------------------------------------------------------------------------------


def _inserts() -> np.ndarray:
    """Least cost of inserted turns between two states."""
    out = np.full((STATES, STATES), FAR, dtype=np.int64)
    for state in range(STATES):
        at, cost = state, 0
        while cost < out[state, at]:
            out[state, at] = cost
            at, cost = NEXT[at][INSERTED[at]], cost + INSERT
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product of two matrices, or of a matrix and costs."""
    if b.ndim == 1:
        return np.minimum((a + b).min(axis=1), FAR)
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), FAR)


INSERTS = _inserts()


def options(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """What can be done with a turn in a state, in the order of initials: (initial, cost, next state)."""
    out = [("D", DELETE, state)]
    if symbol != CONDEMNED:
        role, extra = symbol % 4, CUT if symbol >= 4 else 0
        if role < 3 and NEXT[state][role] >= 0:
            out.append(("K", KEEP + extra, NEXT[state][role]))
        out.append(("R", REROLE + extra, NEXT[state][INSERTED[state]]))
    return out


@functools.cache
def power(symbol: int, log: int) -> np.ndarray:
    """The matrix of 2 ** log turns of one symbol, each with the inserts before it."""
    if log:
        half = power(symbol, log - 1)
        return product(half, half)
    step = np.full((STATES, STATES), FAR, dtype=np.int64)
    for state in range(STATES):
        for _, cost, to in options(symbol, state):
            step[state, to] = min(step[state, to], cost)
    return product(INSERTS, step)


def advance(symbol: int, length: int, behind: np.ndarray) -> np.ndarray:
    """Costs (or a matrix) before a run, from those behind it."""
    for log in range(length.bit_length()):
        if length >> log & 1:
            behind = product(power(symbol, log), behind)
    return behind


@functools.lru_cache(maxsize=1 << 16)
def _choice(symbol: int, state: int, behind: tuple[int, ...]) -> tuple[str, int]:
    """The ASCII-least cheapest edits of one turn (inserts before it, then its own) and the state behind it."""
    before, edits = product(power(symbol, 0), np.array(behind)), ""
    while True:
        best = before[state]
        moves = {letter: (to, cost + behind[to]) for letter, cost, to in options(symbol, state)}
        added = NEXT[state][INSERTED[state]]
        if moves["D"][1] == best:
            return edits + "D", moves["D"][0]
        if INSERT + before[added] == best:
            edits, state = edits + "I", added
            continue
        letter = next(k for k in ("K", "R") if k in moves and moves[k][1] == best)
        return edits + letter, moves[letter][0]


def unroll(symbol: int, length: int, state: int, behind: np.ndarray, out: list[str]) -> int:
    """Append the edits of each turn of a run to out; returns the state behind it."""
    if length > 32:
        first = length // 2
        state = unroll(symbol, first, state, advance(symbol, length - first, behind), out)
        return unroll(symbol, length - first, state, behind, out)
    costs = [behind]
    for _ in range(length - 1):
        costs.append(product(power(symbol, 0), costs[-1]))
    for after in reversed(costs):
        # Only differences count, so equal ones are looked up.
        edits, state = _choice(symbol, state, tuple((after - after.min()).tolist()))
        out.append(edits)
    return state


def closing(state: int) -> str:
    """Inserts after the last turn."""
    out, left = "", product(INSERTS, np.array(ENDING))
    while left[state]:
        out, state = out + "I", NEXT[state][INSERTED[state]]
    return out


#: Costs behind the last turn of a conversation.
END = product(INSERTS, np.array(ENDING))


def unroll_runs(runs: list[tuple[int, int]], state: int, behind: np.ndarray) -> tuple[list[str], int]:
    """Edits of all turns of a fragment and the state behind it."""
    costs = [behind]
    for symbol, length in reversed(runs[1:]):
        costs.append(advance(symbol, length, costs[-1]))
    out: list[str] = []
    for (symbol, length), after in zip(runs, reversed(costs), strict=True):
        state = unroll(symbol, length, state, after, out)
    return out, state


# --- fragments -----------------------------------------------------------------------------------------


class _Fragment:
    """The turns of a conversation in one partition: their rows, and their runs of equal symbols."""

    def __init__(self, key: int | None, part: int):
        self.key, self.part, self.rows, self.runs = key, part, [], []

    def add(self, rows: pa.RecordBatch, kinds: np.ndarray, copies: np.ndarray) -> None:
        """Rows of (symbol, copies, whether the first copy is judged by itself)."""
        self.rows.append(rows)
        for symbol, n in zip(kinds.tolist(), copies.tolist(), strict=True):
            for s, length in (((symbol, 1), (CONDEMNED, n - 1)) if symbol != CONDEMNED else ((symbol, n),)):
                if length and self.runs and self.runs[-1][0] == s:
                    self.runs[-1] = (s, self.runs[-1][1] + length)
                elif length:
                    self.runs.append((s, length))


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[_Fragment]:
    """Fragments from rows in order of place."""
    last: _Fragment | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column("conv_id")
        key, null = column.fill_null(0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
        part, symbol, copies = batch.column("place").to_numpy() >> PART_BITS, batch.column("symbol").to_numpy(), batch.column("copies").to_numpy()
        edge = np.flatnonzero((key[1:] != key[:-1]) | (null[1:] != null[:-1]) | (part[1:] != part[:-1])) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(key)], strict=True):
            mine = (None if null[a] else int(key[a]), int(part[a]))
            if last is None or (last.key, last.part) != mine:
                if last is not None:
                    yield last
                last = _Fragment(*mine)
            last.add(batch.slice(a, b - a), symbol[a:b], copies[a:b])
    if last is not None:
        yield last


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matrix of each fragment."""
    for fragment in _fragments(batches):
        matrix = np.where(np.eye(STATES, dtype=bool), 0, FAR)
        for symbol, length in reversed(fragment.runs):
            matrix = advance(symbol, length, matrix)
        yield pa.RecordBatch.from_arrays([pa.array([fragment.key], pa.int64()), pa.array([fragment.part]), pa.array([matrix.ravel().tolist()], pa.list_(pa.int64()))], ["conv_id", "part", "matrix"])


def _states(shipped):
    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        behind = shipped.value
        for fragment in _fragments(batches):
            after = [unroll_runs(fragment.runs, state, np.array(behind[fragment.key, fragment.part]))[1] for state in range(STATES)]
            yield pa.RecordBatch.from_arrays([pa.array([fragment.key], pa.int64()), pa.array([fragment.part]), pa.array([after], pa.list_(pa.int64()))], ["conv_id", "part", "after"])

    return states


def _edits(shipped):
    names = [f.split()[0] for f in EDITS.split(", ")]

    def together(rows: list[pa.RecordBatch], parts: list[str]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).append_column("edits", pa.array(parts, pa.string()))
        yield from table.select(names).combine_chunks().to_batches()

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows, parts = shipped.value, [], []
        for fragment in _fragments(batches):
            state, behind, ends = known.get((fragment.key, fragment.part), (0, END.tolist(), True))
            done, state = unroll_runs(fragment.runs, state, np.array(behind))
            if ends:
                done[-1] += closing(state)
            at = 0
            for batch in fragment.rows:
                for n in batch.column("copies").to_pylist():
                    parts.append(done[at] if n == 1 else "".join(done[at : at + n]))
                    at += n
            rows += fragment.rows
            if len(parts) >= 8192:
                yield from together(rows, parts)
                rows, parts = [], []
        if rows:
            yield from together(rows, parts)

    return edits


def _digest_of(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.col("conv_id").isNull(), F.coalesce("conv_id", F.lit(0)), *columns)


def _symbols(turns: DataFrame) -> DataFrame:
    """One row per distinct damaged turn, without its text: place gives the order of all."""
    letters = F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", "")
    truncated = ~F.substring(letters, -1, 1).isin(".", "!", "?")
    rows = turns.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "role", _digest_of(1, "role", "text").alias("k1"), _digest_of(2, "role", "text").alias("k2"), (letters == "").alias("blank"), truncated.alias("cut"), "copies")
    distinct = rows.groupBy("conv_id", "turn", "initial", "role", "k1", "k2", "blank", "cut").agg(F.sum("copies").alias("copies"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("k1").asc(), F.col("k2").asc()]
    placed = stored(distinct.repartitionByRange(*order).sortWithinPartitions(*order).drop("role").withColumn("place", F.monotonically_increasing_id()))
    # Copies within a row are known by their number; a join is only needed for texts that stand at several turns.
    again = placed.groupBy("k1", "k2").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("seen")).where("seen > 1").select("k1", "k2", "first")
    later = F.col("first").isNotNull() & (F.col("place") > F.col("first"))
    # 1: blank, 2: duplicate, 3: truncated.
    fault = F.when(F.col("blank"), 1).when(later, 2).when(F.col("cut"), 3).otherwise(0)
    role = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    symbol = F.when(F.col("fault").isin(1, 2), CONDEMNED).otherwise(role + F.when(F.col("fault") == 3, 4).otherwise(0))
    return placed.join(again, ["k1", "k2"], "left").withColumn("fault", fault).withColumn("symbol", symbol.cast("int")).select("conv_id", "place", "turn", "initial", "fault", "symbol", "copies", F.lit(False).alias("opening"), "k1", "k2")


def _in_place(rows: DataFrame) -> DataFrame:
    """The rows with each fragment in one task, in order."""
    part = F.shiftright("place", PART_BITS)
    return rows.repartition(part).sortWithinPartitions("place")


def plan_repair(turns: DataFrame) -> DataFrame:
    """One row per distinct turn of damaged(...): its place in the order of all, its fault and its edits.

    edits has, for each copy, the initials of inserts before it and its own; the last turn's end with the inserts behind it.
    Columns: conv_id, place, turn, initial, fault (0 none, 1 blank, 2 duplicate, 3 truncated; for the first copy), copies, opening (false), edits, k1, k2
    (the digest of conversation, role and text).
    """
    spark = turns.sparkSession
    rows = stored(_symbols(turns))
    context = spark.sparkContext
    # Conversations that cross an edge of a partition: their fragments are at most two a partition, so they may come to the driver.
    edges = rows.groupBy(F.shiftright("place", PART_BITS).alias("part")).agg(F.min_by("conv_id", "place").alias("a"), F.max_by("conv_id", "place").alias("b"))
    ends = edges.select("part", F.explode(F.array_distinct(F.array("a", "b"))).alias("conv_id"))
    crossing = ends.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("conv_id", F.lit(True).alias("crosses"))
    found: dict[tuple, tuple] = {}
    split = rows.join(crossing, rows["conv_id"].eqNullSafe(crossing["conv_id"]), "left_semi")
    matrices = _in_place(split).mapInArrow(_matrices, "conv_id long, part long, matrix array<long>").collect()
    if matrices:
        chains: dict[int | None, list] = {}
        for r in sorted(matrices, key=lambda r: r["part"]):
            chains.setdefault(r["conv_id"], []).append((r["part"], np.array(r["matrix"]).reshape(STATES, STATES)))
        behind: dict[tuple, list[int]] = {}
        for key, chain in chains.items():
            costs = END
            for part, matrix in reversed(chain):
                behind[key, part] = costs.tolist()
                costs = product(matrix, costs)
        shipped = context.broadcast(behind)
        after = {(r["conv_id"], r["part"]): r["after"] for r in _in_place(split).mapInArrow(_states(shipped), "conv_id long, part long, after array<long>").collect()}
        for key, chain in chains.items():
            state = 0
            for part, _ in chain:
                found[key, part] = (state, behind[key, part], part == chain[-1][0])
                state = after[key, part][state]
    return _in_place(rows).mapInArrow(_edits(context.broadcast(found)), EDITS)


def repair(turns: DataFrame) -> DataFrame:
    """plan_repair(turns) with role and text of every row that stays (null for one whose copies all go)."""
    texts = turns.select(_digest_of(1, "role", "text").alias("k1"), _digest_of(2, "role", "text").alias("k2"), "role", "text").dropDuplicates(["k1", "k2"])
    stays = F.col("edits").rlike("[KR]")
    return plan_repair(turns).join(texts, ["k1", "k2"], "left").withColumns({"role": F.when(stays, F.col("role")), "text": F.when(stays, F.col("text"))})


# --- digests -------------------------------------------------------------------------------------------


class _Conversation:
    """Counts and digests of a conversation whose rows come in order."""

    def __init__(self, key: int | None):
        self.key, self.low, self.high, self.turns, self.last = key, None, None, 0, None
        self.counts = [0, 0, 0, 0]
        self.illegal = self.cost = self.state = 0
        self.audit, self.repaired, self.lines, self.initial = [], hashlib.sha256(), 0, None

    def line(self, initial: int, role: str | None, text: str) -> None:
        """A repaired turn: the role of its initial, or its own."""
        self.repaired.update((("\n" if self.lines else "") + (ROLES[initial] if role is None else role) + ":" + text).encode())
        self.lines += 1
        self.state = NEXT[self.state][initial]

    def add(self, turn: int | None, initial: str, fault: int, copies: int, edits: str, role: str | None, text: str | None) -> None:
        if turn is not None:
            if turn != self.last:
                self.turns, self.last = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.counts[fault] += 1
        self.counts[1 if fault == 1 else 2] += copies - 1
        self.illegal += (self.initial is not None and self.initial + initial not in ("su", "ua", "au")) + (copies - 1 if initial + initial not in ("su", "ua", "au") else 0)
        self.initial = initial
        self.audit.append(edits)
        self.cost += DELETE * edits.count("D") + INSERT * edits.count("I") + REROLE * edits.count("R")
        for letter in edits if text is not None else edits.replace("D", ""):
            if letter == "I":
                self.line(INSERTED[self.state], None, "")
            elif letter == "K":
                self.line("sua".index(initial), role, text)
                self.cost += CUT if fault == 3 else 0
            elif letter == "R":
                self.line(INSERTED[self.state], None, text)
                self.cost += CUT if fault == 3 else 0

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.key, gaps, *self.counts[1:], self.illegal, self.cost, "".join(self.audit), self.repaired.hexdigest())


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = [f.split()[0] for f in DIGEST.split(", ")], [pa.string() if f.endswith("string") else pa.int64() for f in DIGEST.split(", ")]
    last: _Conversation | None = None
    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if last is None or last.key != r["conv_id"]:
                if last is not None:
                    done.append(last.row())
                last = _Conversation(r["conv_id"])
            if not r["opening"]:
                last.add(r["turn"], r["initial"], r["fault"], r["copies"], r["edits"], r["role"], r["text"])
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(last.row(), kinds, strict=True)], names)


def repair_digests(turns: DataFrame) -> DataFrame:
    """One row per conversation of turns, from its repair after damage: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A digest needs the texts of a conversation one after the other, so its rows stream through one task, which holds a batch and the
    conversation's edits (a byte a turn).
    """
    fixed = repair(damaged(turns))
    # Each conversation opens with a row of its own, so that one whose turns were all dropped is there, too.
    opening = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumns({"place": F.lit(-1).cast("long"), "opening": F.lit(True)})
    rows = fixed.select("conv_id", "place", "turn", "initial", "fault", "copies", "opening", "edits", "role", "text").unionByName(opening, allowMissingColumns=True)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_summaries, DIGEST)
