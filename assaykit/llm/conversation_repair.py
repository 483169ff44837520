"""Conversation structure repair (operator 11).

A conversation is sound when its turns' role initials read ``(s?(ua)+)?`` and no turn is blank,
a repeat or cut off. Edits have costs: Keep 0, Rerole to user or assistant 2, Delete 3 (forced
for blank and repeated turns), Insert an empty user or assistant turn 2; a truncated turn that
stays costs 1 more. The cheapest edits are found by dynamic programming over four states
(nothing yet, after a system, a user, an assistant turn); of equally cheap ones the edit letters
that come first in ASCII win.

Turns are partitioned by conversation and sorted by turn; ``mapInPandas`` streams them and
carries the four states across Arrow batches. Ordinary conversations are held until they end.
Giant ones (by the stated limits) hold nothing: their backpointers, four bytes a turn, leave in
blocks as rows of a table in the shared folder, are traced back from the last block, and the
edits are joined to the turns by position. Both ways give the same rows.

Comparing letters needs no strings: two ways that have taken in the same turns, both ending
with a turn's own edit, are never prefixes of each other, so four ranks say which is less.

Order and odd rows: turns sort by (turn, role, text), null turns first. Null role or text count
as one space (so such a text is blank). A null conversation id is one conversation. Roles whose
initial is not s, u or a can only be changed or deleted. Equal rows of one turn are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm.shared import written

REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"
HELD_TURNS, HELD_CHARS = 1 << 16, 1 << 23   # a conversation beyond either is giant
BLOCK = 1 << 14                             # turns in a block of backpointers
BATCH = 1 << 12                             # rows in an output batch

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER},
          "a": {USER: ASSISTANT}}
_INSERTED = [USER, USER, ASSISTANT, USER]   # the state that an inserted turn leads to
_TO_END = [0, 2, 1, 0]                      # insertions until a sound conversation
_LETTERS = "DKR"
_FAR = DELETE + INSERT                      # no state's rest costs more than another's plus this

SUMMARY = T.StructType([T.StructField(n, T.LongType()) for n in (
    "gaps", "blank", "duplicate", "truncated", "illegal", "cost")])
EDITS = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("position", T.LongType()),
    T.StructField("sub", T.LongType()), T.StructField("edit", T.StringType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    *SUMMARY.fields])
BLOCKS = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("block", T.LongType()),
    T.StructField("back", T.BinaryType()), T.StructField("state", T.LongType()),
    T.StructField("n", T.LongType()), *SUMMARY.fields])
PLANS = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("position", T.LongType()),
    T.StructField("edits", T.StringType()), T.StructField("roles", T.StringType())])


@cache
def moves(kind: str) -> list[tuple[int, int, int, str]]:
    """(state, next state, cost, letters) of all ways to take in a turn of this kind.

    ``kind`` is the role's initial (``-`` if none of s, u, a), then ``x`` for a turn that must go,
    ``t`` for a truncated and ``o`` for a good one. More than two insertions in a row return
    to a state that was there before, so they are never cheapest.
    """
    initial, fault = kind
    cut = CUT if fault == "t" else 0
    out = []
    for start in range(4):
        state = start
        for k in range(3):
            cost, letters = k * INSERT, "I" * k
            out.append((start, state, cost + DELETE, letters + "D"))
            if fault != "x":
                kept = _AFTER.get(initial, {}).get(state)
                if kept is not None:
                    out.append((start, kept, cost + cut, letters + "K"))
                for role in "ua":
                    if state in _AFTER[role]:
                        out.append((start, _AFTER[role][state], cost + REROLE + cut, letters + "R"))
            state = _INSERTED[state]
    return out


START = ((0, 0), None, None, None)          # (cost above the cheapest, rank) of each state


@cache
def step(states: tuple, kind: str) -> tuple[tuple, int, bytes]:
    """(states after a turn, cost added to the cheapest, backpointers of the four states).

    States that cost more than ``_FAR`` above the cheapest can never win again and go, so
    there are few different ``states`` and each is worked out once.
    """
    best: dict[int, tuple] = {}
    for state, after, cost, letters in moves(kind):
        if states[state] is not None:
            c, rank = states[state]
            best[after] = min(best.get(after, (1 << 30,)), (c + cost, rank, letters, state))
    least = min(b[0] for b in best.values())
    best = {q: b for q, b in best.items() if b[0] <= least + _FAR}
    ranks = {q: k for k, q in enumerate(sorted(best, key=lambda q: best[q][1:3]))}
    after = tuple((best[q][0] - least, ranks[q]) if q in best else None for q in range(4))
    back = bytes(best[q][3] | (len(best[q][2]) - 1) << 2 | _LETTERS.index(best[q][2][-1]) << 4
                 if q in best else 255 for q in range(4))
    return after, least, back


def ending(states: tuple) -> tuple[int, int]:
    """(cost added by the end, state before the closing insertions)."""
    cost, _, closing, state = min((c[0] + INSERT * _TO_END[q], c[1], "I" * _TO_END[q], q)
                                  for q, c in enumerate(states) if c is not None)
    return cost, state


def inserted_roles(state: int, k: int) -> tuple[str, int]:
    """Initials of ``k`` turns inserted after ``state``, and the state they lead to."""
    roles = ""
    for _ in range(k):
        state = _INSERTED[state]
        roles += "u" if state == USER else "a"
    return roles, state


def traced(back: bytes, state: int) -> tuple[list[tuple[str, str]], int]:
    """(edit letters, their roles' initials) of each turn of a block that ends in ``state``, and
    the state before the block. A kept or deleted turn's own role is ``-``."""
    out = []
    for at in range(len(back) - 4, -1, -4):
        code = back[at + state]
        before, k, letter = code & 3, code >> 2 & 3, _LETTERS[code >> 4]
        roles = inserted_roles(before, k)[0]
        own = "-" if letter != "R" else "u" if state == USER else "a"
        out.append(("I" * k + letter, roles + own))
        state = before
    return out[::-1], state


class Conversation:
    """What is carried of one conversation: states, counts and backpointers."""

    def __init__(self, key: str | None):
        self.key, self.states, self.cost = key, START, 0
        self.back, self.turns, self.n, self.block = bytearray(), [], 0, 0
        self.counts = {"x": 0, "d": 0, "t": 0}
        self.illegal = self.distinct = 0
        self.first = self.last = self.initial = None

    def take(self, turn: str | None, initial: str, fault: str) -> None:
        self.n += 1
        if fault in self.counts:
            self.counts[fault] += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None:
            at = int(turn)
            if self.last is None or at != self.last:
                self.distinct += 1
            self.first, self.last = at if self.first is None else self.first, at
        kind = (initial if initial in ("s", "u", "a") else "-") + ("x" if fault == "d" else fault)
        self.states, cost, back = step(self.states, kind)
        self.cost += cost
        self.back += back

    def summary(self) -> tuple[int, ...]:
        gaps = 0 if self.last is None else self.last - self.first + 1 - self.distinct
        return (gaps, self.counts["x"], self.counts["d"], self.counts["t"], self.illegal,
                self.cost + ending(self.states)[0])

    def edits(self) -> Iterator[tuple]:
        """The rows of a held conversation, then its summary row."""
        state = ending(self.states)[1]
        plan = traced(bytes(self.back), state)[0]
        plan.append(("I" * _TO_END[state], inserted_roles(state, _TO_END[state])[0]))
        for at, (letters, roles) in enumerate(plan):
            for sub, (letter, initial) in enumerate(zip(letters, roles, strict=True)):
                role, text = ("", "") if letter == "I" else self.turns[at]
                role = {"u": "user", "a": "assistant"}.get(initial, role)
                yield (self.key, at + 1, sub, letter, role, text) + (None,) * 6
        yield (self.key, self.n + 2, 0, None, None, None) + self.summary()


def conversations_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[Conversation, tuple | None]]:
    """(conversation, row) in order; a row of None ends its conversation."""
    own = None
    for batch in batches:
        for row in batch.itertuples(index=False):
            if own is None or row.key != own.key:
                if own is not None:
                    yield own, None
                own = Conversation(row.key)
            own.take(row.turn, row.initial, row.fault)
            yield own, row
    if own is not None:
        yield own, None


def frames(rows: Iterator[tuple], schema: T.StructType) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []

    def frame():
        return pd.DataFrame(held, columns=schema.names, dtype=object)

    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield frame()
            held = []
    if held:
        yield frame()


def repaired_held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows():
        for own, row in conversations_of(batches):
            if row is None:
                yield from own.edits()
            else:
                own.turns.append((row.role, row.text))
    return frames(rows(), EDITS)


def spilled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of backpointers; a conversation's last block carries its end."""
    def rows():
        for own, row in conversations_of(batches):
            if row is None or len(own.back) == 4 * BLOCK:
                end = (ending(own.states)[1], own.n, *own.summary()) if row is None else (None,) * 8
                yield (own.key, own.block, bytes(own.back), *end)
                own.back, own.block = bytearray(), own.block + 1
    return frames(rows(), BLOCKS)


def planned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edits by position, from blocks that come last first."""
    def rows():
        state = 0
        for batch in batches:
            for b in batch.itertuples(index=False):
                if not pd.isna(b.state):
                    state = int(b.state)
                    k = _TO_END[state]
                    if k:
                        yield b.key, int(b.n) + 1, "I" * k, inserted_roles(state, k)[0]
                plan, state = traced(bytes(b.back), state)
                for at, (letters, roles) in enumerate(plan):
                    yield b.key, int(b.block) * BLOCK + at + 1, letters, roles
    return frames(rows(), PLANS)


def faults(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Turns with key, role, text, initial and first fault (x blank, d repeat, t truncated, o none),
    partitioned by conversation and sorted.

    Repeats are found by a sorted window within the same partitioning, not by a set that grows.
    """
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(
        F.col(conv).cast("string").alias("key"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), text.alias("text")).repartition("key")
    again = F.row_number().over(W.partitionBy("key", "role", "text").orderBy("turn")) > 1
    body = F.rtrim("text", F.lit(SPACE))
    fault = (F.when(body == "", "x").when(F.col("_again"), "d")
             .when(F.substring(body, -1, 1).isin(".", "!", "?"), "o").otherwise("t"))
    return (rows.withColumn("_again", again)
            .select("key", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"),
                    fault.alias("fault"), "_again")
            .sortWithinPartitions("key", F.asc_nulls_first("turn"), "role", "text", "_again")
            .select("key", F.col("turn").cast("string").alias("turn"), "role", "text", "initial",
                    "fault"))


def _giants(conversations: DataFrame, conv: str, turns: int, chars: int) -> DataFrame:
    sizes = conversations.groupBy(F.col(conv).cast("string").alias("_key")).agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return written(sizes.where((F.col("n") > turns) | (F.col("chars") > chars)).select("_key"),
                   "giant-conversations")


def repair(conversations: DataFrame, conv: str = "conv_id", held_turns: int = HELD_TURNS,
           held_chars: int = HELD_CHARS) -> DataFrame:
    """The edited turns of every conversation (conv_id, turn, role, text; other columns go).

    Rows: ``conv``, ``position`` (of the turn, or the one an insertion precedes), ``sub``
    (order within it), ``edit`` (K, R, D or I), ``role`` and ``text`` after the edit (a deleted
    turn keeps its own), then one row per conversation with ``edit`` null and the counts
    ``gaps, blank, duplicate, truncated, illegal, cost``. All rows of a conversation lie in
    one partition, in order. No rows give no rows.
    """
    giants = _giants(conversations, conv, held_turns, held_chars)
    if giants.isEmpty():
        out = faults(conversations, conv).mapInPandas(repaired_held, EDITS)
    else:
        giant = F.col(conv).cast("string").eqNullSafe(F.col("_key"))
        held = conversations.join(giants, giant, "left_anti")
        out = (faults(held, conv).mapInPandas(repaired_held, EDITS)
               .union(_repair_giants(conversations.join(giants, giant, "left_semi"), conv)))
    kind = conversations.schema[conv].dataType
    return out.select(F.col("key").cast(kind).alias(conv), *EDITS.names[1:])


def _repair_giants(conversations: DataFrame, conv: str) -> DataFrame:
    blocks = written(faults(conversations, conv).drop("role", "text").mapInPandas(spilled, BLOCKS),
                     "backpointers")
    plans = (blocks.repartition("key").sortWithinPartitions("key", F.desc("block"))
             .mapInPandas(planned, PLANS))
    order = W.partitionBy("key").orderBy(F.asc_nulls_first("at"), "role", "text", F.desc("good"))
    # the order of ``faults``: of equal rows the repeat comes last
    turns = (faults(conversations, conv)
             .select(F.col("key").alias("_key"), "key", F.col("turn").cast("long").alias("at"),
                     "role", "text", (F.col("fault") != "d").alias("good"))
             .select("_key", F.row_number().over(order).cast("long").alias("_position"),
                     F.col("role").alias("_role"), F.col("text").alias("_text")))
    joined = plans.join(turns, F.col("key").eqNullSafe(F.col("_key"))
                        & (F.col("position") == F.col("_position")), "left")
    each = joined.select("key", "position", "roles", "_role", "_text",
                         F.posexplode(F.split("edits", "")).alias("sub", "edit"))
    initial = F.substring(F.col("roles"), F.col("sub") + 1, F.lit(1))
    inserted = F.col("edit") == "I"
    nothing = [F.lit(None).cast("long").alias(f.name) for f in SUMMARY.fields]
    edits = each.select(
        "key", "position", F.col("sub").cast("long").alias("sub"), "edit",
        F.when(initial == "u", "user").when(initial == "a", "assistant")
        .otherwise(F.col("_role")).alias("role"),
        F.when(inserted, "").otherwise(F.col("_text")).alias("text"), *nothing)
    none = F.lit(None).cast("string")
    ends = blocks.where(F.col("n").isNotNull()).select(
        "key", (F.col("n") + 2).alias("position"), F.lit(0).cast("long").alias("sub"),
        none.alias("edit"), none.alias("role"), none.alias("text"), *SUMMARY.names)
    return (edits.union(ends).repartition("key")
            .sortWithinPartitions("key", "position", "sub"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by crc32(``conv_id:turn``) % 20; null values become one space.

    0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it a user's.
    """
    def part(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = conversations.select(
        "conv_id", "turn", part("role").alias("role"), part("text").alias("text"),
        (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).alias("_fault"))
    fault = F.col("_fault")
    text = (F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text")))
    return (rows.where(fault != 0)
            .select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
                    text.alias("text"),
                    F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))).alias("_"))
            .drop("_"))
