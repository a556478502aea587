"""Conversation structure repair: cheapest edits by cost layers of bitsets.

A conversation is right when its role initials are nothing, or an optional ``s`` and then pairs
``ua``.  Four states of that grammar tell what may follow.  For each cost 0, 1, 2, ... a layer
holds, for every place between turns, the set of states (four bits) from which the rest of the
turns can be brought to an end at no more than that cost.  A layer follows from the layers of the
costs below it by table look-ups.  The first layer that has the start state at the first place
gives the cost of the repair, and reading the bits from there forwards gives its edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._common import arrow_schema, map_arrow

#: Edits and what they cost; a truncated turn that stays costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

#: States: nothing yet, after the system turn, after a user's turn, after an assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}

#: The one state that a turn of a made role leads to.
MADE = [next(STEPS[x][s] for x in "ua" if s in STEPS[x]) for s in range(4)]

#: For each set of states, the states that a kept turn, or a turn of a made role, leads into it.
NOWHERE = bytes(16)
KEPT = {x: bytes(sum(1 << s for s, t in step.items() if goal >> t & 1) for goal in range(16)) for x, step in STEPS.items()}
LED = bytes(sum(1 << s for s in range(4) if goal >> MADE[s] & 1) for goal in range(16))

#: Turns whose layers are held at once; longer conversations are looked at in such parts.
BLOCK = 64

SOUND, CUT, GONE = 0, 1, 2  # kinds of turns: may stay, may stay at a price, must go
SPACES = r"\x20\x09-\x0D"
WIDE = T.StructType([T.StructField("conv_id", T.LongType())] + [T.StructField(x, T.LongType()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
LARGEST = (1 << 63) - 1

Turn = tuple[str, int]  # initial, kind


def cost_layers(turns: Sequence[Turn], after: Sequence[int], wanted: int = 15) -> list[list[int]]:
    """Layers of the costs 0, 1, ... up to the one that has all ``wanted`` states at the first place.

    ``after`` has the cost of what follows the turns, for each state.
    """
    n = len(turns)
    layers: list[list[int]] = []
    none = [0] * (n + 1)
    while not layers or layers[-1][0] & wanted != wanted:
        c = len(layers)
        last, three, four, six = (layers[c - k] if c >= k else none for k in (1, 3, 4, 6))
        now = [0] * (n + 1)
        now[n] = last[n] | LED[three[n]] | sum(1 << s for s in range(4) if after[s] == c)
        for i in range(n - 1, -1, -1):
            initial, kind = turns[i]
            goal = last[i] | four[i + 1] | LED[three[i]]
            if kind == SOUND:
                goal |= KEPT.get(initial, NOWHERE)[now[i + 1]] | LED[three[i + 1]]
            elif kind == CUT:
                goal |= KEPT.get(initial, NOWHERE)[three[i + 1]] | LED[six[i + 1]]
            now[i] = goal
        layers.append(now)
    return layers


def _first(layers: list[list[int]], state: int) -> int:
    return next(c for c, layer in enumerate(layers) if layer[0] >> state & 1)


def trace(turns: Sequence[Turn], layers: list[list[int]], state: int, cost: int) -> tuple[str, int, int]:
    """Edits from ``state`` to the last place, least first, the state there and the cost that is left."""
    out, i = [], 0
    while i < len(turns):
        initial, kind = turns[i]
        made = MADE[state]
        more = TRUNCATED if kind == CUT else 0
        kept = STEPS.get(initial, {}).get(state) if kind != GONE else None
        if cost >= DELETE and layers[cost - DELETE][i + 1] >> state & 1:
            out.append("D")
            cost, i = cost - DELETE, i + 1
        elif cost >= INSERT and layers[cost - INSERT][i] >> made & 1:
            out.append("I")
            cost, state = cost - INSERT, made
        elif kept is not None and cost >= KEEP + more and layers[cost - KEEP - more][i + 1] >> kept & 1:
            out.append("K")
            cost, state, i = cost - KEEP - more, kept, i + 1
        else:
            out.append("R")
            cost, state, i = cost - REROLE - more, made, i + 1
    return "".join(out), state, cost


def cheapest_edits(turns: Sequence[Turn], block: int = BLOCK) -> tuple[int, str]:
    """Cost and edits (K keep, R rerole, D delete, I insert) of the cheapest repair, the ASCII-least of them.

    Layers are made for ``block`` turns at a time, from the last block to the first, and once more
    on the way back, so that time and memory grow with the number of turns.
    """
    closing = [0 if s in ENDS else INSERT if MADE[s] in ENDS else 2 * INSERT for s in range(4)]
    starts = range(0, len(turns), block)
    if not starts:
        return 0, ""
    after, base, total = [], [], 0
    rest = closing
    layers: list[list[int]] = []
    for lo in reversed(starts):
        least = min(rest)
        total += least
        after.append([x - least for x in rest])
        base.append(least)
        layers = cost_layers(turns[lo : lo + block], after[-1], 15 if lo else 1)
        rest = [_first(layers, s) for s in range(4)] if lo else [_first(layers, START)]
    total += rest[0]
    audit, state, cost = [], START, rest[0]
    for lo, ends, least in zip(starts, reversed(after), reversed(base), strict=True):
        part = turns[lo : lo + block]
        if lo:
            layers = cost_layers(part, ends, 1 << state)
        edits, state, cost = trace(part, layers, state, cost)
        audit.append(edits)
        cost += least
    return total, "".join(audit) + "I" * (cost // INSERT)


class Repair:
    """One conversation: first its turns without texts, then its texts, both in order."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.turns: list[Turn] = []
        self.seen: set[bytes] = set()
        self.least = self.most = self.last = None
        self.n_turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.audit: str | None = None
        self.at, self.state, self.cost = 0, START, 0
        self.digest, self.begun = hashlib.sha256(), False

    def turn(self, turn: int | None, initial: str, blank: bool, cut: bool, name: bytes) -> None:
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.n_turns += self.last is None or turn != self.last
            self.most = self.last = turn
        if self.turns and self.turns[-1][0] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        kind = SOUND
        if blank:
            self.blank, kind = self.blank + 1, GONE
        elif name in self.seen:
            self.duplicate, kind = self.duplicate + 1, GONE
        elif cut:
            self.truncated, kind = self.truncated + 1, CUT
        self.seen.add(name)
        self.turns.append((initial, kind))

    def _plan(self) -> str:
        if self.audit is None:
            self.cost, self.audit = cheapest_edits(self.turns)
            self.seen = set()
        return self.audit

    def _line(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.begun else "") + role + ":" + text).encode())
        self.begun = True

    def _inserted(self, audit: str) -> None:
        while self.at < len(audit) and audit[self.at] == "I":
            self.state = MADE[self.state]
            self._line(ROLES[self.state], "")
            self.at += 1

    def text(self, role: str, text: str) -> None:
        audit = self._plan()
        self._inserted(audit)
        edit = audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = STEPS[role[0]][self.state]
            self._line(role, text)
        elif edit == "R":
            self.state = MADE[self.state]
            self._line(ROLES[self.state], text)

    def row(self) -> tuple:
        audit = self._plan()
        self._inserted(audit)
        gaps = 0 if self.least is None else min(LARGEST, self.most - self.least + 1 - self.n_turns)
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, audit, self.digest.hexdigest()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(WIDE)
    held: Repair | None = None
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        rows.clear()
        return out

    for b in batches:
        for conv_id, phase, turn, role, name, blank, cut, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held is None or held.conv_id != conv_id:
                if held is not None:
                    rows.append(held.row())
                held = Repair(conv_id)
            if phase == 1:
                held.turn(turn, role[:1], blank, cut, name)
            elif phase == 2:
                held.text(role, text)
        if len(rows) >= 1000:
            yield batch()
    if held is not None:
        rows.append(held.row())
    if rows:
        yield batch()


def damage(conversations: DataFrame) -> DataFrame:
    """Turns as ``conversations`` has them, damaged by number: conv_id, turn, role, text, copies.

    The CRC-32 of ``conv_id:turn`` modulo 20 decides: 0 drops the turn (copies 0), 1 empties its
    text, 2 removes its full stops, exclamation and question marks, 3 repeats it (copies 2), 4
    gives it to the user.  Null ids and turns count as one space, null roles and texts are one space.
    """
    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def repair_structure(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``turns`` has conv_id, turn, role, text and, if wanted, ``copies`` (how often a turn stands
    there; 0: only its conversation does).  Turns are in order of turn (null first), then role,
    then the SHA-256 of role and text; equal rows are turns of their own, side by side.  The first
    fault of a turn counts: blank text, role and text of an earlier turn, no full stop at the end.
    ``illegal``: neighbours whose initials are not su, ua or au.  ``gaps``: numbers missing between
    the least and the largest turn, at most the largest long.  ``audit``: the edits in order.
    Null conv_id: a conversation like others.  Null role or text: one space.  No turns: zeros, an
    empty audit and the hash of nothing.  Empty table: no rows.

    One exchange, by conversation.  Each turn travels twice, without and with its text: the sort
    puts the short rows of a conversation before its texts, so that the edits are known when the
    texts pass by and no texts are held.  A conversation is one task, as its audit and hash are
    each one value; a task holds 32 bytes of hash and an initial for each of its turns.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    copies = F.col("copies") if "copies" in turns.columns else F.lit(1)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))
    name = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    blank = ~F.col("text").rlike(f"[^{SPACES}]")
    cut = ~F.col("text").rlike(rf"[.!?][{SPACES}]*\z")
    rows = rows.select("conv_id", "turn", "role", "text", "copies", name.alias("name"), blank.alias("blank"), cut.alias("cut"))
    phases = F.when(F.col("copies") == 0, F.array(F.lit(0))).otherwise(F.concat(F.array_repeat(F.lit(1), F.col("copies").cast("int")), F.array_repeat(F.lit(2), F.col("copies").cast("int"))))
    rows = rows.withColumn("phase", F.explode(phases))
    rows = rows.select("conv_id", "phase", "turn", "role", "name", "blank", "cut", F.when(F.col("phase") == 2, F.col("text")).alias("text"))
    sorted_rows = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "phase", F.col("turn").asc_nulls_first(), "role", "name")
    return map_arrow(sorted_rows, _repaired, WIDE)
