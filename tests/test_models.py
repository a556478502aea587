"""Fitted models against the same objectives in plain numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import metrics, model
from tidemark.plans import metric_queries, model_queries

FOLDER = "/root/testdata/sf0.001"


def newton(gradient, w: np.ndarray) -> np.ndarray:
    """Root of a gradient by Newton steps with numerical derivatives."""
    for _ in range(60):
        g = gradient(w)
        h = np.stack([(gradient(w + d) - gradient(w - d)) / 2e-5 for d in np.eye(len(w)) * 1e-5])
        step = np.linalg.solve(h, g)
        w = w - step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-10:
            break
    return w


def test_platt(spark):
    rows = [(r["p"], r["y"]) for r in metric_queries.rows(spark, FOLDER).collect()]
    p, y = np.array(rows, float).T
    x = np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))

    def gradient(w):
        q = 1 / (1 + np.exp(-(w[0] + w[1] * x)))
        return np.array([(y - q).sum(), ((y - q) * x).sum()])

    got = metric_queries.platt_fit(spark, FOLDER).first()
    assert np.allclose([got["intercept"], got["slope"]], newton(gradient, np.array([-1.0, 0.0])), atol=2e-6)
    assert metrics.platt_fit(spark.createDataFrame([], "p double, y int"), "p", "y") == (None, None)


def examples(spark, before: str | None = None):
    df = model_queries._examples(spark, FOLDER)
    rows = (df.filter(F.col("hour") < F.lit(before).cast("timestamp_ntz")) if before else df).collect()
    x = np.array([[r[c] for c in model_queries.FEATURES] for r in rows])
    mean, scale = x.mean(0), x.std(0)
    z = np.clip((x - mean) / np.where(scale < 1e-8, 1, scale), -3, 3)
    event = np.array([r["event"] is not None for r in rows])
    return np.column_stack([np.ones(len(z)), z]), event, mean, scale


def hazard_weights(x: np.ndarray, event: np.ndarray) -> np.ndarray:
    """Each hour with an event holds one of its own, so that its part is log p; the others add log(1 - p)."""

    def gradient(w):
        p = 1 / (1 + np.exp(-x @ w))
        return ((event - p)[:, None] * x).sum(0) - np.concatenate([[0], w[1:]])

    return newton(gradient, np.zeros(x.shape[1]))


def test_hazard_fit(spark):
    x, event, _, _ = examples(spark)
    got = [r["weight"] for r in model_queries.hazard_fit(spark, FOLDER).collect()]
    assert np.allclose(got, hazard_weights(x, event), atol=1e-3)
    fitted = model.fit(model_queries._examples(spark, FOLDER), model_queries.FEATURES, "event", "exposure")
    p = 1 / (1 + np.exp(-x @ np.array(fitted.weights)))
    information = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.0, 1, 1, 1])
    assert np.allclose(np.linalg.inv(information), fitted.covariance, rtol=1e-2, atol=1e-5)


def test_issued_forecast(spark):
    """Hazards by numpy weights, damped and multiplied out, are the forecast's."""
    x, event, mean, scale = examples(spark, model_queries.CUTOFF)
    w = hazard_weights(x, event)
    known = model_queries._load(model_queries._known(spark, FOLDER)).withColumnRenamed("hour", "target")
    slots = model_queries.features.calendar(model_queries._targets(spark), "target").join(known, "target", "left").orderBy("target").collect()
    z = np.clip((np.array([[r[c] or 0.0 for c in model_queries.FEATURES] for r in slots]) - mean) / scale, -3, 3)
    hazard = 1 / (1 + np.exp(-(w[0] + z @ w[1:])))
    rows = sorted(model_queries.issued_forecast(spark, FOLDER).collect(), key=lambda r: r["target"])
    late = [k for k in range(168) if k > 150]  # long after the last outcome nothing is damped
    assert np.allclose([rows[k]["hazard"] for k in late], hazard[late], atol=2e-4)
    assert all(a["by_end_probability"] <= b["by_end_probability"] for a, b in zip(rows, rows[1:], strict=False))


def test_exact_quantiles_by_nested_histograms(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.exponential(1e-6, 3000), np.full(2000, 0.25), rng.random(1001), [1e9, -1e-300]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    shares = (0.0, 0.1, 0.25, 0.5, 0.61, 0.999, 1.0)
    assert np.allclose(metrics.quantiles(df, "v", shares), np.quantile(values, shares), rtol=1e-12)
    ordered = np.sort(values)
    assert metrics.order_statistics(df, "v", [5, 3500, 6002], bins=8, few=3) == [ordered[k] for k in (5, 3500, 6002)]
    assert metrics.quantiles(df.filter("false"), "v", (0.5,)) == [None]


def test_ranks_of_hot_values(spark, monkeypatch):
    """Most rows share one probability; ranks are still those of one sort."""
    rows = [(k, 0.001 if k % 3 else (k % 100) / 1e5, int(k % 7 == 0)) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, p double, y int")
    want = {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    for together in (10_000, 100):  # in one bucket, and in many
        monkeypatch.setattr(metrics, "RANKED_TOGETHER", together)
        assert {r["id"]: r["rank"] for r in metrics.ranked(df, "p", "id", {}, buckets=16).collect()} == want
