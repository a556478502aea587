from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from tests.llm.tables import SMALL, documents, prose
from tidemark.llm import packing


def check(rows, texts):
    """Ids, cuts and places of a packing; the number of its sequences."""
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    of, places = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(of) == set(texts)
    for doc_id, own in of.items():
        ids = np.array([*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 2048 for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return len(places)


def test_real_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = packing.pack(docs).collect()
    n = check(rows, texts)
    assert n <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_odd_texts(spark):
    texts = [None, "", " ", "a  b", "\n\n x\t y \n", "<|endoftext|> x", "naïve 中文 \u00a0 z", prose(3, 30_000, 10**6), "x" * 9000, "same", "same"]
    docs = documents(spark, texts, more="length piece rank sequence_id")
    check(packing.pack(docs).collect(), dict(enumerate(texts)))
    assert packing.pack(docs.limit(0)).collect() == []


def test_ids_by_words_are_those_of_whole_texts(monkeypatch):
    """Every kind of white space, letter, number and sign beside each other, and the small documents."""
    tokenizer = packing.ByteTokenizer(packing.default_tokenizer())
    rng = random.Random(11)
    signs = [" ", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u200b", "\u2028", "\u202f", "\u2060", "\u3000", "\ufeff", "a", "Zz", "é", "中", "ǅ", "1", "२", "½", "Ⅷ", "'s", "'ll", "'", "don't", "-", "€", "😀", "\u0301", "_", "\0", "<|endoftext|>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 30))) for _ in range(20_000)]
    texts += ["".join(map(chr, range(a, a + 16))) + " " + " ".join(map(chr, range(a, a + 16))) for a in range(0, 0x3100, 16)]
    assert tokenizer.by_words and tokenizer.ids(texts) == tokenizer.whole(texts)
    assert np.frombuffer(tokenizer.ids(["x", "hello <|endoftext|> world"])[1], "<u4").tolist() == [31373, 220, 50256, 995]
    monkeypatch.setattr(packing, "KNOWN_BYTES", 100)
    for k in (0, 50, 25, 100):
        assert tokenizer.ids(texts[k : k + 50]) == tokenizer.whole(texts[k : k + 50]) and not tokenizer.known and tokenizer.older


def test_letters_are_encoded_once_whatever_marks_follow(monkeypatch):
    """Only a word's letters are new; marks behind them, and letters that are no plain ones, get the ids of the whole text."""
    tokenizer = packing.ByteTokenizer(packing.default_tokenizer())
    got, encode = [], tokenizer._words
    monkeypatch.setattr(tokenizer, "_words", lambda words: got.extend(words) or encode(words))
    marks = [*packing.MARKS, "...", ",&&&", "!?", "'", "''", "$$$.", "\"),", "'.", "-'s", "'s,"]
    texts = ["x " + " ".join(w + m for m in marks) for w in ("laenvienpa", "ciónasmiñ", "straße")]
    texts += ["x osarciue", "x\nosarciue, osarciue.", " ".join(["x", *marks]), "x 中文, ǅa. a1, 1. ª! µ? ÷, ×. a÷. é\u0301,"]
    assert tokenizer.ids(texts) == tokenizer.whole(texts)
    for w in ("laenvienpa", "ciónasmiñ", "straße"):
        assert sorted(x for x in got if w in x) == sorted([w, w + "-'s", w + "'s,"])
    got.clear()
    texts = ["x osarciue! laenvienpa?! straße;", "x laenvienpa?! straße; straße"]
    assert tokenizer.ids(texts) == tokenizer.whole(texts) and not got
    monkeypatch.setattr(packing, "MARKS_KNOWN", 1)
    texts = ["x osarciue& straße&&", "x laenvienpa&&& straße;;"]
    assert tokenizer.ids(texts) == tokenizer.whole(texts)


def test_null_ids_and_repeated_rows_are_packed(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b"), (3, "a b"), (4, None)], "doc_id long, text string")
    rows = packing.pack(docs).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 3), (0, 3), (3, 3), (3, 3), (4, 1)]
    assert sorted(r["offset"] for r in rows)[0] == 0 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 5


def optimum(lengths: list[int], room: int) -> int:
    best, lengths = len(lengths), sorted(lengths, reverse=True)

    def go(k: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for b in {x: i for i, x in enumerate(bins)}.values():
            if bins[b] >= lengths[k]:
                bins[b] -= lengths[k]
                go(k + 1, bins)
                bins[b] += lengths[k]
        bins.append(room - lengths[k])
        go(k + 1, bins)
        bins.pop()

    go(0, [])
    return best


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(4)
    for _ in range(60):
        lengths = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 11))]
        counts = {x: lengths.count(x) for x in lengths}
        plan, proven = packing.bin_completion(counts, 60)
        assert proven
        used = defaultdict(int)
        for pattern, times in plan:
            assert sum(pattern) <= 60
            for x in pattern:
                used[x] += times
        assert used == counts
        assert sum(n for _, n in plan) == optimum(lengths, 60)
