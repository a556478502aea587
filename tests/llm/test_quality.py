from __future__ import annotations

import math
import zlib

import numpy as np

from tests.llm.tables import documents, prose
from tidemark.llm import quality

FOLDER = "/root/testdata/sf0.01"


def auc(score: np.ndarray, label: np.ndarray) -> float:
    ones, zeros = score[label == 1], score[label == 0]
    return float(((ones[:, None] > zeros[None, :]).mean() + 0.5 * (ones[:, None] == zeros[None, :]).mean()))


def test_held_out_accuracy_and_fold(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = quality.score_quality(docs, quality.train_quality(docs, labels)).collect()
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    assert len(scored) == docs.count()
    for r in scored:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["score"], known[r["doc_id"]]) for r in scored if r["held_out"] and r["doc_id"] in known]
    assert auc(np.array([s for s, _ in held]), np.array([y for _, y in held])) > 0.9


def brute_features(text: str) -> list[float]:
    raw = text.encode()
    size, words, lines = max(len(raw), 1), raw.split(), [x for x in raw.split(b"\n") if x]
    groups = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"*$%&#@^~=+<>\\{}[]_", b"|", b"!", b".,;:?", b"'\"()-/`", bytes(range(128, 256))]
    n_words, n_lines = max(len(words), 1), max(len(lines), 1)
    out = [math.log1p(len(raw)), *[sum(raw.count(c) for c in g) / size for g in groups]]
    out += [sum(map(len, words)) / n_words, math.log1p(sum(map(len, lines)) / n_lines), len(set(words)) / n_words]
    out += [sum(a == b for a, b in zip(words, words[1:], strict=False)) / n_words, len(set(lines)) / n_lines]
    odd = set(groups[2] + groups[3] + groups[4])
    return [*out, sum(any(c in odd for c in w) for w in words) / n_words, math.log1p(max(map(len, words), default=0))]


def brute_score(model: quality.AdditiveModel, text: str) -> float:
    """Bins found by counting edges, entries of the tables added one by one."""
    at = [sum(e <= x for e in edges) for edges, x in zip(model.edges, brute_features(text), strict=True)]
    total = model.intercept + sum(t[k] for t, k in zip(model.tables, at, strict=True))
    return 1 / (1 + math.exp(-total - sum(t[at[a], at[b]] for (a, b), t in zip(model.pairs, model.pair_tables, strict=True))))


def test_scores_equal_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train_quality(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    far = [d for d, t in texts.items() if abs(got[d] - brute_score(model, t)) > 1e-9]
    assert len(model.pairs) == 6 and got.keys() == texts.keys() and far == []
    assert all(t.shape == (len(model.edges[a]) + 1, len(model.edges[b]) + 1) for (a, b), t in zip(model.pairs, model.pair_tables, strict=True))


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string")
    model = quality.train_quality(docs, spark.createDataFrame([(3, 1), (3, 1), (None, 0)], "doc_id long, quality int"))
    rows = quality.score_quality(docs, model).collect()
    assert len(rows) == 3 and len({r["score"] for r in rows}) == 1


def test_equal_texts_score_alike_and_odd_rows(spark):
    texts = [None, "", "a b", "a b", prose(1, 40_000), "*** $$$ !!! ||| BUY NOW"] + [prose(k, 60) for k in range(40)] + [f"{k} ###|||$$$ WIN {k}" for k in range(40)]
    docs = documents(spark, texts, more="score features quality")
    labels = spark.createDataFrame([(k, 1) for k in range(6, 46)] + [(k, 0) for k in range(46, 86)] + [(None, 1), (7, None)], "doc_id long, quality int")
    model = quality.train_quality(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    assert scores[2] == scores[3] and len(scores) == len(texts)
    assert min(scores[k] for k in range(6, 46)) > 0.5 > max(scores[k] for k in range(46, 86))
    good = quality.keep_good(docs, model)
    assert good.columns == docs.columns
    assert {r["doc_id"] for r in good.collect()} == {k for k, s in scores.items() if s >= 0.3}
    assert quality.score_quality(docs.limit(0), model).collect() == []


def test_without_labels_or_with_one_class():
    x = np.random.default_rng(1).random((20, len(quality.FEATURES)))
    assert quality.fit(x[:0], np.zeros(0)).score(x).tolist() == [0.5] * 20
    assert (quality.fit(x, np.ones(20)).score(x) > 0.9).all()
