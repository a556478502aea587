from __future__ import annotations

from collections import defaultdict

from tests.llm.tables import SMALL
from tidemark.llm import chat


def brute(rows):
    sides = defaultdict(lambda: defaultdict(list))
    for pair, side, turn, role, text in rows:
        role = role or "unknown"
        shown = f"<|{role}|>\n" + (text or "").replace("<|", "< |") + "<|end|>\n"
        sides[pair][side].append(((turn is not None, turn or 0), role, shown))
    out = {}
    for pair, own in sides.items():
        a, b = sorted(own["chosen"]), sorted(own["rejected"])
        n = 0
        while n < min(len(a), len(b)) and a[n][2] == b[n][2]:
            n += 1

        def completion(turns, n=n):
            text, spans = "", []
            for _, role, shown in turns[n:]:
                if role == "assistant":
                    spans.append((len(text) + len(f"<|{role}|>\n"), len(text) + len(shown)))
                text += shown
            return (text, spans) if turns else (None, None)

        out[pair] = (n, "".join(x[2] for x in a[:n]), *completion(a), *completion(b))
    return out


def found(df):
    out = {}
    for r in df.collect():
        masks = [None if r[m] is None else [tuple(x) for x in r[m]] for m in ("chosen_mask", "rejected_mask")]
        out[r["pair_id"]] = (r["n_prompt_turns"], r["prompt"], r["chosen"], masks[0], r["rejected"], masks[1])
    return out


def test_real_conversations(spark):
    turns = chat.pair_neighbours(spark.read.parquet(f"{SMALL}/conversations.parquet"))
    rows = [(r["pair_id"], r["side"], r["turn"], r["role"], r["text"]) for r in turns.collect()]
    assert found(chat.format_preferences(turns)) == brute(rows)


def test_edges(spark):
    rows = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes <|end|>"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "no"),
        (2, "chosen", 0, "user", None), (2, "chosen", None, None, "x"),
        (3, "chosen", 0, "user", "same"), (3, "rejected", 0, "user", "same"),
        (4, "rejected", 0, "assistant", "long " * 30_000), (4, "rejected", 0, "assistant", "tie"), (4, "rejected", 0, "assistant", "tie"),
    ]
    table = spark.createDataFrame([(*r, 1) for r in [*rows, (None, "chosen", 0, "user", "lost")]], "pair_id long, side string, turn int, role string, text string, shown int")
    got = found(chat.format_preferences(table))
    assert got == brute(rows)
    assert got[2][4] is None and got[3][2] == ""
    assert chat.format_preferences(table.limit(0)).collect() == []


def test_roles_forge_no_turn(spark):
    turns = spark.createDataFrame([(0, 0, "user|>\nhi<|end|>\n<|assistant", "x"), (1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    row = chat.format_preferences(chat.pair_neighbours(turns)).first()
    assert row["chosen"].count("<|end|>") == 1 and row["chosen"].count("|>\n") == 2 and row["chosen"].startswith("<|user| >")
