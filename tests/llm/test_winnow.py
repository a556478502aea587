from __future__ import annotations

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.tables import SMALL, by_id, documents, prose
from tidemark.llm import winnow

K, W = 4, 5


def naive(text, k=winnow.K, w=winnow.W):
    """Positions by a window at a time."""
    if not text:
        return []
    if len(text) < k:
        return [0]
    hashes = [int(winnow.gram_hashes(winnow._points(text[i : i + k]), k)[0]) for i in range(len(text) - k + 1)]
    chosen = set()
    for lo in range(max(1, len(hashes) - w + 1)):
        window = hashes[lo : lo + w]
        chosen.add(lo + max(i for i, h in enumerate(window) if h == min(window)))
    return sorted(chosen)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abé\U0001f600", max_size=60), max_size=6), st.integers(6, 40))
def test_chosen_positions(texts, part):
    for text, (hashes, places) in zip(texts, winnow.winnow(texts, K, W, part), strict=True):
        assert places.tolist() == naive(text, K, W)
        if len(text) >= K:
            assert hashes.tolist() == winnow.gram_hashes(winnow._points(text), K)[places].tolist()


def test_match_guarantee():
    rng = random.Random(3)
    for _ in range(50):
        shared = "".join(rng.choices("abcdef ", k=winnow.K + winnow.W - 1))
        a, b = prose(rng.random(), 40) + shared + prose(rng.random(), 30), prose(rng.random(), 9) + shared + prose(rng.random(), 50)
        (ha, pa), (hb, pb) = winnow.winnow([a, b])
        common = set(ha.tolist()) & set(hb.tolist())
        start = a.index(shared)
        assert any(h in common and start <= p < start + winnow.W for h, p in zip(ha.tolist(), pa.tolist(), strict=True))


def brute(rows):
    """``rows``: doc_id, text."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for i, (doc, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        marks = [winnow.winnow([x])[0] for x in (text, edited, following)]
        sets = [set(m[0].tolist()) for m in marks]
        near = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        strings = ["".join(f"{h:08x}" for h in m[0].tolist()) for m in marks[:2]]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), *strings, *near))
    return out


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def test_real_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert key(winnow.fingerprint_edits(docs).collect()) == key(want)
    assert key(winnow.fingerprint_edits(docs, buckets=100).collect()) == key(want)
    found = by_id(winnow.fingerprints(docs))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for doc, row in list(found.items())[:40]:
        assert row["positions"] == naive(texts[doc])


def test_edges(spark):
    texts = ["", None, "é", "short", "a" * 100_000, prose(1, 60_000), prose(1, 60_000), " \n" * 40, "\U0001f600" * 50, prose(2, 12)]
    docs = documents(spark, texts, more="bucket own hashes")
    rows = docs.select("doc_id", "text").collect()
    for buckets in (1, 3, 50):
        got = winnow.fingerprint_edits(docs, buckets=buckets).collect()
        assert key(got) == key(brute([(r["doc_id"], r["text"]) for r in rows]))
    odd = docs.selectExpr("nullif(doc_id, 3) as doc_id", "text", "lang").unionByName(docs.selectExpr("doc_id % 2 as doc_id", "text", "lang")).unionByName(docs.selectExpr("doc_id", "text", "lang"))
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for buckets in (1, 4):
        assert key(winnow.fingerprint_edits(odd, buckets=buckets).collect()) == key(brute(rows))
    one = winnow.fingerprint_edits(docs.filter("doc_id = 9")).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == len(texts[9])
    assert winnow.fingerprint_edits(docs.limit(0)).collect() == [] and winnow.fingerprints(docs.limit(0)).collect() == []
    empty = by_id(winnow.fingerprints(docs))
    assert empty[0]["hashes"] == empty[1]["positions"] == [] and empty[2]["positions"] == [0]


def test_window_minima():
    values = np.random.default_rng(0).integers(0, 50, 200).astype(np.uint64)
    for w in (1, 2, 3, 7, 32):
        assert winnow.window_minima(values, w).tolist() == [values[i : i + w].min() for i in range(len(values) - w + 1)]
