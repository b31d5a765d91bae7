"""Cheapest repair of conversations so that their roles read (s?(ua)+)?, by block tables.

A row is kept (free), given the role user or assistant, deleted, or a row without text is inserted
before it; the costs are below. Blank and repeated rows must go, a truncated row that stays costs
extra. What a row offers depends only on the initial of its role and its fault, so a conversation
is a string over ten symbols, and the costs to finish it from the four states (nothing yet, after
s, after u, after a) are a vector. Less their minimum these vectors are few. `Tables` holds, for every
such vector behind a block of four symbols, the vector before it and the cost in between: a
conversation is read backward by one lookup a block. The edits are then read forward: each block is
expanded backward from the vector behind it, and the edit whose initial comes first in ASCII
is taken among those that keep the least cost, so ties always give the least audit.

Rows are judged where they lie; what is shuffled first is a digest and a few small numbers a row.
Repeats are found by a window per conversation and digest. One row per conversation, with its
audit, then leads the conversation's texts through a second shuffle. Both steps stream sorted rows:
a task holds no more of a conversation than its symbols and its audit, a byte a row, however long
it is. A conversation is read by one task, since its hash has to be taken in order.

Defined results: a missing role or text is one space; a missing conv_id is a conversation of its
own; a missing turn comes first and has no part in gaps. Rows of equal turn are in the order of the MD5
of role and text. Roles other than s, u or a by initial, and empty ones, can't be kept as they are.
Texts and conversations of any length are read whole. Other columns are ignored, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from areascope.llm.text import SPACE, partitions

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLOCK = 4

# faults of a row
SOUND, CUT, BLANK, REPEAT = 0, 1, 2, 3
GONE = 4  # a row that damage dropped; it only names its conversation

# states: nothing yet, after s, after u, after a
STATES = range(4)
AFTER_INSERT = {0: 2, 1: 2, 2: 3, 3: 2}
AFTER_KEEP = [{0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {}]  # by initial: s, u, a, other
TAIL = ["", "II", "I", ""]  # rows inserted at the end
END = tuple(INSERT * len(tail) for tail in TAIL)
ROLE_AFTER = {2: "user", 3: "assistant"}

# symbols: initial, initial of a truncated row, a row that must go, padding
MUST_GO, PAD, SYMBOLS = 8, 9, 10

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, next state) of what may become of the row, without insertions."""
    if symbol == PAD:
        return [("", 0, state)]
    out = [("D", DELETE, state)]
    if symbol != MUST_GO:
        extra = TRUNCATED if symbol >= 4 else 0
        kept = AFTER_KEEP[symbol % 4]
        if state in kept:
            out.append(("K", extra, kept[state]))
        out.append(("R", REROLE + extra, AFTER_INSERT[state]))
    return out


def before(costs: tuple, symbol: int) -> tuple:
    """Costs to finish from each state before a row, given those behind it."""
    out = [min(c + costs[s] for _, c, s in edits(symbol, state)) for state in STATES]
    if symbol != PAD:
        for _ in STATES:
            out = [min(out[s], INSERT + out[AFTER_INSERT[s]]) for s in STATES]
    return tuple(out)


def normal(costs: tuple) -> tuple[tuple, int]:
    least = min(costs)
    return tuple(c - least for c in costs), least


class Tables:
    """Transitions of normalised cost vectors over every block of `length` symbols."""

    def __init__(self, length: int = BLOCK):
        self.length = length
        self.vectors, number, row = [END], {END: 0}, 0
        to, off = [], []
        while row < len(self.vectors):
            steps = [normal(before(self.vectors[row], symbol)) for symbol in range(SYMBOLS)]
            for vector, _ in steps:
                if vector not in number:
                    number[vector] = len(self.vectors)
                    self.vectors.append(vector)
            to.append([number[vector] for vector, _ in steps])
            off.append([least for _, least in steps])
            row += 1
        one_to, one_off = np.array(to), np.array(off)
        to, off = one_to, one_off
        for _ in range(length - 1):  # one symbol more in front of every block
            off = np.concatenate([off + one_off[to, s] for s in range(SYMBOLS)], axis=1)
            to = np.concatenate([one_to[to, s] for s in range(SYMBOLS)], axis=1)
        self.to, self.off = to.tolist(), off.tolist()
        self.place = SYMBOLS ** np.arange(length - 1, -1, -1)
        self.expanded: dict[tuple, tuple[str, int]] = {}

    def codes(self, symbols: np.ndarray) -> list[int]:
        """One number per block, the first symbol in the highest place."""
        padded = np.full(-(-len(symbols) // self.length) * self.length, PAD, dtype=np.int64)
        padded[: len(symbols)] = symbols
        return (padded.reshape(-1, self.length) @ self.place).tolist()

    def expand(self, behind: int, code: int, state: int) -> tuple[str, int]:
        """The edits of a block from a state, and the state behind it."""
        key = (behind, code, state)
        if key in self.expanded:
            return self.expanded[key]
        symbols = [code // int(p) % SYMBOLS for p in self.place]
        costs = [self.vectors[behind]]
        for symbol in reversed(symbols):
            costs.append(before(costs[-1], symbol))
        costs.reverse()
        out = ""
        for i, symbol in enumerate(symbols):
            initial = "I"
            while initial == "I":
                options = [
                    (x, s) for x, c, s in edits(symbol, state)
                    if c + costs[i + 1][s] == costs[i][state]
                ]
                inserted = AFTER_INSERT[state]
                if symbol != PAD and INSERT + costs[i][inserted] == costs[i][state]:
                    options.append(("I", inserted))
                initial, state = min(options)
                out += initial
        self.expanded[key] = out, state
        return out, state

    def repair(self, symbols: np.ndarray) -> tuple[int, str]:
        """The least cost and its ASCII-least edits."""
        codes = self.codes(symbols)
        behind, cost, vector = [], 0, 0
        for code in reversed(codes):
            behind.append(vector)
            cost += self.off[vector][code]
            vector = self.to[vector][code]
        behind.reverse()
        cost += self.vectors[vector][0]
        out, state = [], 0
        for vector, code in zip(behind, codes, strict=True):
            part, state = self.expand(vector, code, state)
            out.append(part)
        return cost, "".join(out) + TAIL[state]


@lru_cache
def tables(length: int = BLOCK) -> Tables:
    return Tables(length)


LEGAL = [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]  # su, ua, au


class Conversation:
    """What is kept of a conversation while its rows go by: one symbol a row."""

    def __init__(self, key):
        self.key, self.symbols = key, []
        self.counts = np.zeros(GONE + 1, dtype=np.int64)
        self.illegal, self.last = 0, None
        self.turns, self.first_turn, self.last_turn = 0, None, None

    def add(self, turns: np.ndarray, known: np.ndarray, fault: np.ndarray, initial: np.ndarray):
        here = fault != GONE
        turns, fault, initial = turns[here & known], fault[here], initial[here].astype(np.int64)
        if not len(fault):
            return
        self.counts += np.bincount(fault, minlength=GONE + 1)
        symbol = np.where(fault >= BLANK, MUST_GO, initial + 4 * (fault == CUT))
        self.symbols.append(symbol.astype(np.uint8))
        if self.last is not None:
            initial = np.concatenate([[self.last], initial])
        self.illegal += int((~np.isin(initial[:-1] * 4 + initial[1:], LEGAL)).sum())
        self.last = int(initial[-1])
        if len(turns):
            self.turns += int((np.diff(turns) != 0).sum()) + (self.last_turn != int(turns[0]))
            self.first_turn = int(turns[0]) if self.first_turn is None else self.first_turn
            self.last_turn = int(turns[-1])

    def row(self) -> list:
        symbols = np.concatenate(self.symbols) if self.symbols else np.zeros(0, dtype=np.uint8)
        cost, audit = tables().repair(symbols)
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        gaps = min(gaps, (1 << 63) - 1)
        counts = [int(self.counts[f]) for f in (BLANK, REPEAT, CUT)]
        return [self.key, gaps, *counts, self.illegal, cost, audit]


def _changes(keys: pa.Array) -> np.ndarray:
    """Places where a run of equal keys begins; missing keys are equal."""
    code = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))


def _audits(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("conv_id")
            starts = _changes(keys).tolist()
            turns = batch.column("turn")
            columns = [
                turns.fill_null(0).to_numpy(zero_copy_only=False),
                turns.is_valid().to_numpy(zero_copy_only=False),
                batch.column("fault").to_numpy(zero_copy_only=False),
                batch.column("initial").to_numpy(zero_copy_only=False),
            ]
            done = []
            for start, stop in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                key = keys[start].as_py()
                if now is None or now.key != key:
                    if now is not None:
                        done.append(now.row())
                    now = Conversation(key)
                now.add(*[c[start:stop] for c in columns])
            if done:
                yield _batch(done, schema)
        if now is not None:
            yield _batch([now.row()], schema)

    return run


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _clean(conversations: DataFrame, times: str | None) -> DataFrame:
    """conv_id, turn, role, text, times (how often the row is there; 0 only names its conversation)."""
    times = F.col(times) if times else F.lit(1)
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), times.cast("int").alias("times"),
    )


def digest() -> Column:
    """Tells role and text apart from any others in 16 bytes."""
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


def audits(conversations: DataFrame, times: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, the counts of its faults, cost and audit.

    A column named by `times` says how often a row is there, one after the other.
    """
    rows = _clean(conversations, times)
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    end = F.substring(trimmed, -1, 1)
    fault = (
        F.when(F.col("times") == 0, GONE).when(trimmed == "", BLANK)
        .when(end.isin(".", "!", "?"), SOUND).otherwise(CUT)
    )
    initial = F.instr(F.lit("sua"), F.substring("role", 1, 1)) - 1
    initial = F.when(F.col("role") == "", 3).when(initial < 0, 3).otherwise(initial)
    copies = F.explode(F.array_repeat(F.lit(0), F.greatest("times", F.lit(1))))
    small = rows.select(
        "conv_id", "turn", digest().alias("digest"), fault.cast("byte").alias("fault"),
        initial.cast("byte").alias("initial"), copies.alias("copy"),
    ).drop("copy")
    # one shuffle: rows placed by conversation are also placed by conversation and digest
    placed = small.repartition(partitions(rows), "conv_id")
    order = W.partitionBy("conv_id", "digest", F.col("fault") == GONE).orderBy(
        F.col("turn").asc_nulls_first()
    )
    again = (F.row_number().over(order) > 1) & F.col("fault").isin(SOUND, CUT)
    marked = placed.withColumn("fault", F.when(again, F.lit(REPEAT).cast("byte")).otherwise(F.col("fault")))
    schema = T.StructType(
        [rows.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in COUNTS],
         T.StructField("audit", T.StringType())]
    )
    return marked.sortWithinPartitions(
        F.col("conv_id"), F.col("turn").asc_nulls_first(), "digest"
    ).mapInArrow(_audits(to_arrow_schema(schema)), schema)


def _led(conversations: DataFrame, times: str | None) -> DataFrame:
    """The texts of each conversation in order behind the row of its audit."""
    rows = _clean(conversations, times)
    heads = audits(conversations, times).withColumn("lead", F.lit(0))
    texts = rows.where("times > 0").withColumns({"lead": F.lit(1), "digest": digest()})
    both = heads.unionByName(texts, allowMissingColumns=True)
    return (
        both.repartition(partitions(rows), "conv_id")
        .sortWithinPartitions("conv_id", "lead", F.col("turn").asc_nulls_first(), "digest")
        .drop("turn", "digest")
    )


class Walk:
    """Applies an audit to the rows of its conversation, one after the other."""

    def __init__(self, head: dict):
        self.head, self.audit, self.at, self.state = head, head["audit"], 0, 0

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = AFTER_INSERT[self.state]
            yield "I", ROLE_AFTER[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the rows that take this row's place."""
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = AFTER_KEEP["sua".index(role[0])][self.state]
            yield edit, role, text
        elif edit == "R":
            self.state = AFTER_INSERT[self.state]
            yield edit, ROLE_AFTER[self.state], text

    def rest(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


def _walks(batches: Iterator[pa.RecordBatch], columns: list[str]):
    """(walk, rows) for each bit of a conversation in turn; rows is None when it begins."""
    now = None
    for batch in batches:
        data = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        for i in range(batch.num_rows):
            if data["lead"][i] == 0:
                if now is not None:
                    yield now, now.rest()
                now = Walk({c: data[c][i] for c in columns})
                yield now, None
            else:
                for _ in range(data["times"][i]):
                    yield now, now.row(data["role"][i], data["text"][i])
    if now is not None:
        yield now, now.rest()


FLUSH_BYTES = 16 << 20


def repaired_rows(conversations: DataFrame, times: str | None = None) -> DataFrame:
    """(conv_id, position, edit, role, text): the repaired conversations, row by row from position 0."""
    schema = T.StructType(
        [conversations.schema["conv_id"], T.StructField("position", T.LongType()),
         *[T.StructField(c, T.StringType()) for c in ("edit", "role", "text")]]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, position = [], 0, 0
        for walk, rows in _walks(batches, ["conv_id", "audit"]):
            if rows is None:
                position = 0
                continue
            for edit, role, text in rows:
                held.append([walk.head["conv_id"], position, edit, role, text])
                position, size = position + 1, size + 100 + 4 * len(text)
            if size > FLUSH_BYTES:
                yield _batch(held, arrow)
                held, size = [], 0
        if held:
            yield _batch(held, arrow)

    return _led(conversations, times).mapInArrow(run, schema)


def repaired_hashes(conversations: DataFrame, times: str | None = None) -> DataFrame:
    """The audits with repaired_sha256: SHA-256 of the repaired `role:text`, newline-joined."""
    names = ["conv_id", *COUNTS, "audit"]
    schema = T.StructType(
        [conversations.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in COUNTS],
         T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, sha, first = [], None, None, True
        for walk, rows in _walks(batches, names):
            if rows is None:
                if last is not None:
                    held.append([*last.head.values(), sha.hexdigest()])
                last, sha, first = walk, hashlib.sha256(), True
                if len(held) >= 10_000:
                    yield _batch(held, arrow)
                    held = []
                continue
            for _, role, text in rows:
                sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        if last is not None:
            held.append([*last.head.values(), sha.hexdigest()])
            yield _batch(held, arrow)

    return _led(conversations, times).mapInArrow(run, schema)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by the CRC-32 of `conv_id:turn` modulo 20, with `times`: 0 drops a row, 1 takes
    its text, 2 its full stops and marks, 3 repeats it, 4 makes its role user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.coalesce("text", F.lit(" "))
    return conversations.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )
