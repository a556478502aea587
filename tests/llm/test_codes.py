from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.tables import SMALL
from tidemark.llm import codes


def brute(rows, entries=256, parts=4, rounds=4):
    """``rows``: vec_id, vector, label; plain integers."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == d]
    limit = codes.largest_component(d)
    cut = [[[max(-limit, min(limit, x)) for x in r[1][d * p // parts : d * (p + 1) // parts]] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for c in cut:
                own[nearest(p, c[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(own[k]) for x in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(x[0] for x in f) for f in found]
    by_label = defaultdict(int)
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{x[1]:02x}" for x in f), e, by_label[r[2]] if by_label[r[2]] < 1 << 63 else None, sha) for r, f, e in zip(kept, found, errors, strict=True)), key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_real_vectors(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    assert found(codes.compress_vectors(table, entries=40, rounds=2)) == brute(rows, entries=40, rounds=2)


def test_edges(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=10).tolist(), k % 3 or None) for k in range(30)]
    rows += [(40, None, 1), (41, [], 1), (42, [1.0] * 9 + [None], 1), (43, [float("nan")] * 10, 1), (44, [float("-inf")] + [0.0] * 9, 1), (45, [1.0] * 7, 1)]
    rows += [(None, [0.5] * 10, 2), (7, rows[7][1], 2), (7, rows[7][1], 2), (46, [0.0] * 10, None), (47, [-1e-9] * 10, None), (48, [1e300] * 10, 9), (49, [-1e300] * 10, 9), (50, [3e9] * 5 + [-3e9] * 5, 9)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, code int, `group` string")
    for entries in (3, 256):
        assert found(codes.compress_vectors(table, entries=entries)) == brute(rows, entries=entries)
    assert codes.compress_vectors(table.limit(0)).collect() == []
    assert codes.compress_vectors(table.filter("vec_id = 43")).collect() == []
    assert codes.compress_vectors(table.drop("label")).count() == len(brute(rows))


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 40), st.integers(1, 6), st.integers(1, 30), st.integers(0, 10_000))
def test_bounds_lose_no_nearest_entry(n, d, queries, seed):
    rng = np.random.default_rng(seed)
    entries, asked = rng.integers(-9, 9, (n, d)), rng.integers(-12, 12, (queries, d))
    best, error = codes.VaFile(entries).nearest(asked)
    distance = ((asked[:, None] - entries[None]) ** 2).sum(axis=2)
    assert best.tolist() == distance.argmin(axis=1).tolist() and error.tolist() == distance.min(axis=1).tolist()


def test_bounds_leave_few_candidates():
    rng = np.random.default_rng(1)
    entries, asked = rng.normal(0, 128, (256, 16)).astype(np.int64), rng.normal(0, 128, (500, 16)).astype(np.int64)
    assert len(codes.VaFile(entries).candidates(asked)[0]) < 500 * 256 / 4
