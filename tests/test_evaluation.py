"""Folds fitted together against each fold fitted alone."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import evaluation, model
from tidemark.plans import evaluation_queries, model_queries

FOLDER = "/root/testdata/sf0.001"


def test_folds_together_are_folds_alone(spark):
    rows = evaluation_queries.hourly_examples(spark, FOLDER)
    _, origins = evaluation_queries.folded(rows)
    together = evaluation.fit_folds(rows, origins, model_queries.FEATURES, "event", "exposure", "known")
    assert len(together) >= 2 and set(together) == set(origins)
    for fold, origin in origins.items():
        alone = model.fit(rows.filter(F.col("known") <= F.lit(origin)), model_queries.FEATURES, "event", "exposure")
        own = together[fold]
        assert own.converged == alone.converged
        assert np.allclose(own.means, alone.means) and np.allclose(own.scales, alone.scales)
        assert np.allclose(own.weights, alone.weights, atol=1e-6) and np.allclose(own.covariance, alone.covariance, rtol=1e-4, atol=1e-8)


def test_jobs_do_not_grow_with_folds(spark, monkeypatch):
    rows = evaluation_queries.hourly_examples(spark, FOLDER)
    _, origins = evaluation_queries.folded(rows)
    calls = []
    steps = evaluation.fold_likelihoods
    monkeypatch.setattr(evaluation, "fold_likelihoods", lambda r, m, w: (calls.append(len(w)), steps(r, m, w))[1])
    numbers = {}
    for fold in origins:
        calls.clear()
        evaluation.fit_folds(rows, {fold: origins[fold]}, model_queries.FEATURES, "event", "exposure", "known")
        numbers[fold] = len(calls)
    calls.clear()
    evaluation.fit_folds(rows, origins, model_queries.FEATURES, "event", "exposure", "known")
    assert len(calls) <= max(numbers.values()) + 2 and calls[0] == len(origins)


def test_no_folds_and_no_examples(spark):
    rows = evaluation_queries.hourly_examples(spark, FOLDER)
    assert evaluation.fit_folds(rows, {}, model_queries.FEATURES, "event", "exposure", "known") == {}
    tests = rows.limit(3).withColumn("fold", F.lit(0))
    assert evaluation.score_folds(tests, {}).collect() == []
    import datetime as dt

    assert evaluation.fit_folds(rows, {0: dt.datetime(1999, 1, 1)}, model_queries.FEATURES, "event", "exposure", "known") == {}


def test_shared_events(spark):
    """Hours that may hold the same event count as one, in every fold that knows them."""
    table = [(h, None if h % 5 else h // 10, 1.0 if h % 5 else 0.5, float(h % 7), h) for h in range(120)]
    rows = spark.createDataFrame(table, "hour int, event int, exposure double, x double, known int")
    together = evaluation.fit_folds(rows, {3: 60, 4: 119}, ["x"], "event", "exposure", "known")
    for fold, last in ((3, 60), (4, 119)):
        alone = model.fit(rows.filter(F.col("known") <= last), ["x"], "event", "exposure")
        assert np.allclose(together[fold].weights, alone.weights, atol=1e-6)


def test_paired_deltas(spark):
    rng = np.random.default_rng(2)
    table = [(k % 3, float(rng.random()), None if k == 7 else float(rng.random()), int(rng.random() < 0.3)) for k in range(90)]
    got = {r["k"]: r for r in evaluation.paired_deltas(spark.createDataFrame(table, "k int, p double, c double, y int"), ["k"], "p", "c", "y").collect()}
    for k in range(3):
        p, c, y = np.array([r[1:] for r in table if r[0] == k and r[2] is not None]).T
        d = (p - y) ** 2 - (c - y) ** 2
        assert got[k]["n"] == len(d) and np.isclose(got[k]["brier_delta"], d.mean()) and np.isclose(got[k]["brier_error"], d.std(ddof=1) / np.sqrt(len(d)))
        loss = np.log(np.where(y == 1, c, 1 - c)) - np.log(np.where(y == 1, p, 1 - p))
        assert np.isclose(got[k]["log_loss_delta"], loss.mean()) and np.isclose(got[k]["better_share"], (d < 0).mean())
