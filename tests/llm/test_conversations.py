"""Repair of conversations against a search of all edits."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

from dashloom.llm import conversations
from dashloom.llm.queries import op12_repair
from dashloom.llm.registry import table
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"
R = random.Random(3)


def damaged(rows):
    """Turns by conversation in order, after the damage."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: in_order(own) for c, own in out.items()}


def in_order(own):
    return sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults(own):
    seen, out = set(), []
    for _, role, text in own:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def by_hand(own, search):
    found = faults(own)
    turns = [t for t, _, _ in own if t is not None]
    cost, audit, left = search(tuple((role[:1], role, text, f) for (_, role, text), f in zip(own, found, strict=True)))
    lines = "\n".join(f"{role}:{text}" for role, text in left)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, found.count("blank"), found.count("duplicate"),
            found.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256(lines.encode()).hexdigest())


def every_edit(turns):
    """The least of all edits with up to two insertions in each gap."""
    gaps = ["", "u", "a", "uu", "ua", "au", "aa"]
    name = {"u": ("user", ""), "a": ("assistant", "")}
    ways = []
    for initial, role, text, fault in turns:
        extra = 3 * (fault == "truncated")
        own = [(4, "D", "", None)]
        if fault not in ("blank", "duplicate"):
            own += [(extra, "K", initial if initial else "-", (role, text)), (3 + extra, "R", "u", ("user", text)), (3 + extra, "R", "a", ("assistant", text))]
        ways.append(own)
    best = None
    for steps in itertools.product(*ways):
        for put in itertools.product(gaps, repeat=len(turns) + 1):
            roles = put[0] + "".join(s[2] + p for s, p in zip(steps, put[1:], strict=True))
            if re.fullmatch("(s?(ua)+)?", roles):
                audit = "I" * len(put[0]) + "".join(s[1] + "I" * len(p) for s, p in zip(steps, put[1:], strict=True))
                cost = sum(s[0] for s in steps) + 3 * sum(map(len, put))
                if best is None or (cost, audit) < best[:2]:
                    left = [name[x] for x in put[0]]
                    for s, p in zip(steps, put[1:], strict=True):
                        left += ([s[3]] if s[3] else []) + [name[x] for x in p]
                    best = cost, audit, left
    return best


def by_whole_strings(turns):
    """The same by comparing whole lists of edits; for longer conversations."""
    to = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    @cache
    def best(i, place, put):
        ways = []
        if put < 2:
            cost, audit, left = best(i, after[place], put + 1)
            ways.append((3 + cost, "I" + audit, ((name[after[place]], ""), *left)))
        if i == len(turns):
            if place in ("", "a"):
                ways.append((0, "", ()))
        else:
            initial, role, text, fault = turns[i]
            extra = 3 * (fault == "truncated")
            cost, audit, left = best(i + 1, place, 0)
            ways.append((4 + cost, "D" + audit, left))
            if fault not in ("blank", "duplicate"):
                cost, audit, left = best(i + 1, after[place], 0)
                ways.append((3 + extra + cost, "R" + audit, ((name[after[place]], text), *left)))
                if (place, initial) in to:
                    cost, audit, left = best(i + 1, to[place, initial], 0)
                    ways.append((extra + cost, "K" + audit, ((role, text), *left)))
        return min(ways, default=(10**9, "", ()))

    return best(0, "", 0)


def result(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_query_by_hand(spark, sf):
    for folder in (sf, "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
        want = {c: by_hand(own, by_whole_strings) for c, own in damaged(rows).items()}
        got = op12_repair(spark, folder)
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert result(got) == want


def made(n, most):
    """Conversations with every fault, ties, nulls and odd roles."""
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]
    texts = ["Yes.", "No!", "cut", "", " \t", None, "Yes.", "é?", "a:b\nc."]
    return [(c, R.choice([None, t, t, t + 3]), R.choice(roles), R.choice(texts)) for c in range(n) for t in range(R.randrange(most + 1))]


def test_all_edits(spark):
    rows = made(60, 3)
    own = {}
    for c, *row in rows:
        own.setdefault(c, []).append((row[0], row[1] if row[1] is not None else " ", row[2] if row[2] is not None else " "))
    want = {c: by_hand(in_order(turns), every_edit) for c, turns in own.items()}
    assert result(conversations.repair(spark.createDataFrame(rows, SCHEMA))) == want
    assert want == {c: by_hand(in_order(turns), by_whole_strings) for c, turns in own.items()}


def test_batches_and_long_conversations(spark):
    """State goes over the borders of batches; a conversation of thousands of turns is one like others."""
    rows = made(40, 12) + [(None, t, "user", "Yes.") for t in range(5)]
    rows += [(77, t, R.choice(["user", "assistant", "system"]), R.choice(["ok.", "cut", "", f"{t}."])) for t in range(150)]
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({"kind": F.lit("x"), "policy": F.lit(1), "copy": F.lit(2), "hurt": F.lit(0)})
    want = {c: by_hand(own, by_whole_strings) for c, own in damaged(rows).items()}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("3", old):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert result(conversations.repair(conversations.damage(clash))) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_giant_conversation(spark):
    turns = spark.range(60_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                       F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    row, = conversations.repair(turns).collect()
    assert row["cost"] == 0 and row["audit"] == "K" * 60_000 and row["gaps"] == 0
    row, = conversations.repair(turns.where("turn != 31")).collect()
    assert (row["cost"], row["gaps"], row["audit"]) == (3, 1, "K" * 31 + "I" + "K" * 59_968)


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "tool", "x."), (1, 2, "assistant", ""), (2, 0, "system", "S.")]
    got = conversations.repaired_turns(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "place").collect()
    # The tool turn becomes the user's that an assistant must answer.
    want = by_whole_strings((("a", "assistant", "Hi.", ""), ("t", "tool", "x.", ""), ("a", "assistant", "", "blank")))
    assert [(r["role"], r["text"]) for r in got if r["conv_id"] == 1] == list(want[2])
    assert [r["place"] for r in got if r["conv_id"] == 1] == list(range(len(want[2])))
    assert "".join(r["edit"] for r in got if r["conv_id"] == 1) == want[1].replace("D", "")
    assert not [r for r in got if r["conv_id"] == 2]


def test_nothing_left(spark):
    nothing = hashlib.sha256(b"").hexdigest()
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = conversations.repair(conversations.damage(spark.createDataFrame([(gone, 0, "user", "x")], SCHEMA)))
    assert [tuple(r) for r in got.collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", nothing)]
    assert conversations.repair(conversations.damage(spark.createDataFrame([], SCHEMA))).count() == 0
    assert conversations.repaired_turns(spark.createDataFrame([], SCHEMA)).count() == 0
