from __future__ import annotations

import math

import numpy as np

from tests.llm.tables import SMALL, by_id
from tidemark.llm import blocks, embeddings


def brute(vectors: list[list[float] | None], threshold: float = 0.95) -> list[tuple[int, int]]:
    n = len(vectors)
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.array(v, float) / max(map(abs, v)) if g else None for v, g in zip(vectors, good, strict=True)]
    unit = [u / np.linalg.norm(u) if g else None for u, g in zip(unit, good, strict=True)]
    links = [[j for j in range(n) if j != i and good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i], *[label[j] for j in links[i]]]) for i in range(n)]
        if new == label:
            break
        label = new
    return [(len(links[i]), label[i]) for i in range(n)]


def found(df) -> list[tuple[int, int]]:
    return [(r["n_links"], r["component_id"]) for _, r in sorted(by_id(df, "vec_id").items())]


def test_real_vectors(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    got, want = found(embeddings.similar_vectors(table)), brute([r["embedding"] for r in rows])
    assert all(g[0] <= w[0] for g, w in zip(got, want, strict=True))  # none below the threshold
    assert sum(g[0] for g in got) >= 0.99 * sum(w[0] for w in want)


def test_groups_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    vectors: list = [None, [], [0.0] * 32, [float("nan")] * 32, [None, *[1.0] * 31]]
    vectors += [[x] * 32 for x in (1e300, 2e300, 1.0, 1e-300, 5e-324, -1e300)] + [[1.0] * 31, [1e308] + [0.0] * 31, [1.0] + [1e-200] * 31, [1.0, 2.0], [2.0, 4.0]]
    for _ in range(8):
        centre = rng.standard_normal(32)
        vectors += [(centre + 0.08 * rng.standard_normal(32)).tolist() for _ in range(10)] + [centre.tolist()] * 3
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, copies int, bands int")
    for block in (4, 384):
        assert found(embeddings.similar_vectors(table, block=block)) == brute(vectors)
    assert embeddings.similar_vectors(table.limit(0)).collect() == []


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (7, [0.0, 1.0])]
    got = embeddings.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in got) == [(0, 2, 1), (1, 2, 1), (1, 2, 1), (7, 0, 7)]


def test_pairs_of_tasks():
    task, side = np.array([1, 1, 1, 2, 2, 2, 3, 4, 4, 5, 5, 6, 6]), np.array([2, 2, 2, 0, 1, 1, 2, 2, 2, 0, 0, 1, 1])
    for most in (1, 2, 100):
        got = [(a, b) for i, j in blocks.task_pairs(task, side, most) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        assert got == [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (7, 8)]
    assert blocks.smallest_linked(6, np.array([5, 4, 1]), np.array([4, 3, 2])).tolist() == [0, 1, 1, 3, 3, 3]


def test_estimates_are_close_and_their_bounds_hold():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes = embeddings.Codes(*embeddings.signs_of(x, 64, 64))
    i, j = np.nonzero(~np.eye(200, dtype=bool))
    error = codes.estimates(i, j) - np.einsum("ij,ij->i", x[i], x[j])
    assert abs(error.mean()) < 0.01
    assert (np.abs(error) <= embeddings.DEVIATIONS * codes.spread[i] / math.sqrt(63) + 0.02).mean() > 0.999
