"""Repair of conversations: cheapest edits to a legal order of roles, found in sorted streams."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What a turn is: the first letter of its role (s, u, a, other) and what is wrong with it.
INITIALS = "sua"
SOUND, TRUNCATED, DUPLICATE, BLANK = range(4)
#: Where a repaired conversation can be: empty, after a system, a user or an assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
KEEP_TO = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = (USER, USER, ASSISTANT, USER)  # where an inserted or renamed turn leads
EDITS = "DIKR"  # in ASCII order: of equally cheap edits the first is taken
DELETE, INSERT, RENAME, UNFINISHED = 4, 3, 3, 3
NEVER = 1 << 30
#: Cost of what is left to insert after the last turn.
AT_END = (0, 2 * INSERT, INSERT, 0)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
_FLUSH = 1000  # conversations or turns given out at once


@cache
def step(kind: int, after: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """The best edit of a turn at each place, two bits each, and the cost from there to the end.

    `kind` is 4 * initial + fault; `after` has the cost of all that follows for each place.
    Costs are given less their minimum: only differences decide, so few cases exist and each is
    worked out once. Of equally cheap ways the one whose first edit comes first in ASCII is
    taken; as an edit's letter decides where it leads, the whole list of edits is the least.
    """
    initial, fault = INITIALS[kind // 4 : kind // 4 + 1], kind % 4
    extra = UNFINISHED if fault == TRUNCATED else 0
    ways = []
    for place in range(4):
        way = {"D": DELETE + after[place]}
        if fault < DUPLICATE:
            way["R"] = RENAME + extra + after[NEXT[place]]
            if (place, initial) in KEEP_TO:
                way["K"] = extra + after[KEEP_TO[place, initial]]
        ways.append(way)
    best = [min(w.values()) for w in ways]
    for _ in range(3):  # an insertion leaves the turn to be dealt with from the next place
        best = [min(best[p], INSERT + best[NEXT[p]]) for p in range(4)]
    policy = 0
    for place, way in enumerate(ways):
        way["I"] = INSERT + best[NEXT[place]]
        policy |= next(i for i, e in enumerate(EDITS) if way.get(e, NEVER) == best[place]) << 2 * place
    return policy, tuple(b - min(best) for b in best)


def _policies(batches):
    """Turns of each conversation from the last to the first; the costs go from batch to batch."""
    last, costs = object(), AT_END
    for batch in batches:
        out = bytearray(batch.num_rows)
        for at, (conv, kind) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
            if conv != last:
                last, costs = conv, AT_END
            if kind is not None:
                out[at], costs = step(kind, costs)
        policy = pa.array(np.frombuffer(out, np.uint8).astype(np.int16))
        yield pa.RecordBatch.from_arrays([*batch.columns, policy], names=[*batch.schema.names, "policy"])


class Walk:
    """A conversation from the first turn to the last, edited as its policies say."""

    def __init__(self, conv):
        self.conv, self.place, self.role = conv, EMPTY, None
        self.faults, self.illegal, self.cost, self.audit = [0] * 4, 0, 0, bytearray()
        self.low = self.high = None
        self.turns, self.digest, self.empty = 0, hashlib.sha256(), True

    def _insert(self):
        self.place = NEXT[self.place]
        self.cost += INSERT
        self.audit += b"I"
        return self._out("I", ROLES[self.place], "")

    def _out(self, edit, role, text):
        self.digest.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False
        return edit, role, text

    def turn(self, kind, policy, turn, role, text):
        """The repaired turns that this one gives, inserted ones before it included."""
        self.illegal += self.role is not None and self.role[:1] + role[:1] not in LEGAL
        self.role = role
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        fault = kind % 4
        self.faults[fault] += 1
        while (edit := EDITS[policy >> 2 * self.place & 3]) == "I":
            yield self._insert()
        self.audit += edit.encode()
        if edit == "D":
            self.cost += DELETE
            return
        self.cost += UNFINISHED if fault == TRUNCATED else 0
        if edit == "K":
            self.place = KEEP_TO[self.place, role[:1]]
        else:
            self.cost += RENAME
            self.place = NEXT[self.place]
            role = ROLES[self.place]
        yield self._out(edit, role, text)

    def end(self):
        """Turns inserted after the last one."""
        while self.place in (SYSTEM, USER):
            yield self._insert()

    def summary(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal,
                self.cost, self.audit.decode(), self.digest.hexdigest())


def _walks(batches):
    """Each conversation's walk with each repaired turn, then with None at its end."""
    walk = None
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "kind", "policy", "turn", "role", "text"))
        for conv, kind, *row in zip(*columns, strict=True):
            if walk is None or conv != walk.conv:
                if walk:
                    yield from ((walk, out) for out in walk.end())
                    yield walk, None
                walk = Walk(conv)
            if kind is not None:
                yield from ((walk, out) for out in walk.turn(kind, *row))
    if walk:
        yield from ((walk, out) for out in walk.end())
        yield walk, None


def _gather(names: list[str], kinds: list[pa.DataType], rows):
    def batch(some):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=names)

    some = []
    for row in rows:
        some.append(row)
        if len(some) == _FLUSH:
            yield batch(some)
            some = []
    if some:
        yield batch(some)


_SUMMARY = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _summaries(batches):
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    yield from _gather(_SUMMARY, kinds, (walk.summary() for walk, out in _walks(batches) if out is None))


def _turns(batches):
    def rows():
        last, place = None, 0
        for walk, out in _walks(batches):
            if out:
                place = place + 1 if walk is last else 0
                last = walk
                yield walk.conv, place, *out

    yield from _gather(["conv_id", "place", "edit", "role", "text"], [pa.int64()] * 2 + [pa.string()] * 3, rows())


def damage(conversations: DataFrame) -> DataFrame:
    """Turns with known faults, one in five rows hurt: (conv_id, turn, role, text, present).

    Nulls in role and text, and in the key that decides, count as one space. crc32 of
    `conv_id:turn` modulo 20 decides: 0 drops the row (`present` is false, so that its conversation is still known),
    1 empties the text, 2 removes its `.!?`, 3 repeats the row, 4 makes the role user.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % 20).alias("hurt"),
    )
    text = F.when(F.col("hurt") == 1, "").when(F.col("hurt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("hurt") == 4, "user").otherwise(F.col("role"))})
    twice = F.explode(F.array_repeat(F.lit(0), F.when(F.col("hurt") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", "role", "text", (F.col("hurt") != 0).alias("present"), twice.alias("copy")).drop("copy")


_ROW = "conv_id long, turn long, role string, text string, copy int, kind int"


def _decided(turns: DataFrame) -> DataFrame:
    """The turns with what each is and its policy, each conversation in order in one partition."""
    if "present" not in turns.columns:
        turns = turns.withColumn("present", F.lit(True))
    white = " \t\n\x0b\x0c\r"
    last = F.substring(F.rtrim("text", F.lit(white)), -1, 1)
    first = F.substring("role", 1, 1)
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), F.coalesce("present", F.lit(False)).alias("present"),
    ).repartition("conv_id")
    # The rows of a conversation are in one partition already: the window and the sorts below move nothing.
    seen = Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    fault = F.when(last == "", BLANK).when(F.col("copy") > 1, DUPLICATE).when(last.isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    rows = rows.withColumn("copy", F.row_number().over(seen)).withColumn("kind", F.when(F.col("present"), 4 * initial + fault))
    order = ["turn", "role", "text", "copy"]
    rows = rows.drop("present").sortWithinPartitions("conv_id", *(F.col(c).desc_nulls_last() for c in order))
    decided = rows.mapInArrow(_policies, f"{_ROW}, policy short")
    return decided.sortWithinPartitions("conv_id", *(F.col(c).asc_nulls_first() for c in order))


def repair(turns: DataFrame) -> DataFrame:
    """The cheapest repair of each conversation, a row for each conv_id.

    `turns` needs (conv_id, turn, role, text); where it has `present`, rows without it only make
    their conversation known. Other columns are ignored. A null role or text counts as one space,
    a null conv_id is a conversation, a null turn comes first. Rows of one turn are in the order
    of role and text; repeated rows stand beside each other.

    A turn's first fault counts: blank (nothing but white space), duplicate (its role and text
    came earlier), truncated (it ends in none of `.!?`). Roles are known by their first letter.
    Edits: Keep costs nothing, Rerole to user or assistant 3, Delete 4 (blank and duplicate turns
    must go), Insert an empty user or assistant turn 3; a truncated turn that stays costs 3. The
    result is empty or a system turn at most, then user and assistant in turn. Of equally cheap
    repairs the one whose edits' initials are least in ASCII is taken.

    Returns conv_id, gaps (turn numbers missing between the least and the greatest), blank,
    duplicate, truncated, illegal (neighbours in an order that cannot be), cost, audit (the
    edits' initials) and repaired_sha256 (of the lines role:text). A conversation without turns
    has zeros, an empty audit and the digest of nothing. An empty table gives an empty one.

    Conversations are dealt to partitions once and sorted there. Backwards, the cost from each
    turn to the end is carried from batch to batch: four numbers, however long the conversation.
    What is left behind is a byte a turn, the best edit at each place; the rows with it are sorted
    again by Spark, which spills what does not fit, and forwards the edits follow the bytes. No
    conversation is held in memory; one of a third of all rows takes one task's time, not its memory.
    """
    return _decided(turns).mapInArrow(_summaries, ", ".join(f"{c} {'string' if c in _SUMMARY[-2:] else 'long'}" for c in _SUMMARY))


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The turns that `repair` leaves: conv_id, place (from 0), edit (K, R or I), role, text."""
    return _decided(turns).mapInArrow(_turns, "conv_id long, place long, edit string, role string, text string")
