from __future__ import annotations

import hashlib
import re
import zlib
from functools import cache

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.tables import SMALL, by_id
from tidemark.llm import repair

NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NAMES = {"u": "user", "a": "assistant"}


def least_edits(turns):
    """Cost, audit and lines by plain recursion; ``turns`` have role, text, kind."""

    @cache
    def best(i, state, inserted):
        ways = [(0, "", ())] if i == len(turns) and state in ("", "a") else []
        made = "a" if state == "u" else "u"
        if inserted < 2:
            c, a, t = best(i, made, inserted + 1) or (None, None, None)
            if c is not None:
                ways.append((c + 3, "I" + a, (NAMES[made] + ":", *t)))
        if i < len(turns):
            role, text, kind = turns[i]
            after = [(4, "D", (), state)]
            more = 3 if kind == 1 else 0
            if kind != 2:
                after.append((3 + more, "R", (NAMES[made] + ":" + text,), made))
                if role[:1] in NEXT[state]:
                    after.append((more, "K", (role + ":" + text,), NEXT[state][role[:1]]))
            for cost, letter, line, to in after:
                found = best(i + 1, to, 0)
                if found:
                    ways.append((found[0] + cost, letter + found[1], line + found[2]))
        return min(ways) if ways else None

    return best(0, "", 0)


def brute(rows):
    """``rows`` of one conversation after damage: turn, role, text."""
    name = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], name(r)))
    seen, turns, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        kind = 0
        if not re.search(r"[^\x20\x09-\x0D]", text):
            counts[0], kind = counts[0] + 1, 2
        elif (role, text) in seen:
            counts[1], kind = counts[1] + 1, 2
        elif re.findall(r"[^\x20\x09-\x0D]", text)[-1] not in ".!?":
            counts[2], kind = counts[2] + 1, 1
        seen.add((role, text))
        turns.append((role, text, kind))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    numbers = {r[0] for r in rows if r[0] is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    cost, audit, lines = least_edits(tuple(turns))
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def check(spark, table):
    got = by_id(repair.repair_structure(repair.damage(table)), "conv_id")
    want = damaged([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table.collect()])
    assert set(got) == set(want)
    for conv, rows in want.items():
        assert tuple(got[conv])[1:] == brute(rows)


def test_real_conversations(spark):
    check(spark, spark.read.parquet(f"{SMALL}/conversations.parquet"))


def test_edges(spark):
    long = [(7, k, "user" if k % 3 else "assistant", f"turn {k % 90}" + "." * (k % 2)) for k in range(200)]
    rows = [
        (0, 0, "system", "Be brief."), (0, 1, "user", "hi?"), (0, 2, "assistant", "yes."), (1, None, None, None), (1, None, "tool", "x."), (1, 5, "", ""), (1, 5, "user", "é. \t\n"),
        (2, 3, "user", "same."), (2, 3, "user", "same."), (2, 3, "assistant", "tie."), (None, 1, "assistant", "lost."), (None, None, "system", "late."),
        (3, -5, "usher", "a word " * 20_000), (3, 9, "assistant", "b\n."), (4, 0, "user", "ends in a blank line.\n\n"), (4, 1, "assistant", "no "), *long,
    ]
    table = spark.createDataFrame([(*r, 5, 5) for r in rows], "conv_id long, turn long, role string, text string, name int, phase int")
    check(spark, table)
    assert repair.repair_structure(repair.damage(table.limit(0))).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    only = repair.repair_structure(repair.damage(spark.createDataFrame([(gone, 0, "user", "x")], "conv_id long, turn long, role string, text string"))).first()
    assert tuple(only) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "x", ""]), st.integers(0, 2)), max_size=14), st.integers(1, 5))
def test_layers_equal_recursion(turns, block):
    want = least_edits(tuple((role, "", kind) for role, kind in turns))
    assert repair.cheapest_edits(turns, block) == want[:2]
    assert repair.cheapest_edits(turns) == want[:2]


def test_long_conversations_in_parts():
    turns = [("usa"[(k * k + k // 7) % 3], (k // 5) % 3) for k in range(3000)]
    assert repair.cheapest_edits(turns, 50) == repair.cheapest_edits(turns, 3)
