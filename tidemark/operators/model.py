"""Ridge logistic hazard with interval-censored events: fitted by aggregations, scored by columns."""

from __future__ import annotations

from collections.abc import Generator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.math import clamp, dot, quadratic_form, sigmoid, winsorised
from tidemark.operators.metrics import standardisation


@dataclass
class HazardModel:
    """Weights on winsorised z-scores, the intercept first, and the covariance of their estimates."""

    features: list[str]
    means: list[float]
    scales: list[float]
    weights: list[float]
    covariance: list[list[float]] = field(default_factory=list)
    converged: bool = True
    clip: float = 3.0

    def row(self) -> Column:
        z = [winsorised(F.col(c).cast("double"), m, s, self.clip) for c, m, s in zip(self.features, self.means, self.scales, strict=True)]
        return F.array(F.lit(1.0), *z)


def score(df: DataFrame, model: HazardModel, z: float = 1.2815515655446004) -> DataFrame:
    """``df`` with hazard and, where the model has a covariance, its 80 % interval (hazard_low, hazard_high)."""
    rows = df.withColumn("__x", model.row())
    eta = dot(F.col("__x"), model.weights)
    out = {"hazard": clamp(sigmoid(eta), 1e-9, 1 - 1e-9)}
    if model.covariance:
        spread = z * F.sqrt(F.greatest(F.lit(0.0), quadratic_form(F.col("__x"), model.covariance)))
        out |= {"hazard_low": sigmoid(eta - spread), "hazard_high": sigmoid(eta + spread)}
    return rows.withColumns(out).drop("__x")


def _likelihood(rows: DataFrame, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood and gradient in one job: quiet hours by row, events by the group of hours that may hold them."""
    n = len(weights)
    p = clamp(sigmoid(dot(F.col("x"), weights.tolist())), 1e-12, 1 - 1e-12)
    scored = rows.select("event", "exposure", "x", p.alias("p"))
    part = scored.groupBy("event").agg(F.sum(F.col("exposure") * F.log1p(-F.col("p"))).alias("l"), *[F.sum(-F.col("exposure") * F.col("p") * F.col("x")[k]).alias(f"g{k}") for k in range(n)])
    quiet = F.col("event").isNull()
    stay = F.exp(F.least(F.col("l"), F.lit(-1e-12)))
    value = F.when(quiet, F.col("l")).otherwise(F.log(F.greatest(1 - stay, F.lit(1e-300))))
    factor = F.when(quiet, 1.0).otherwise(-stay / F.greatest(1 - stay, F.lit(1e-300)))
    total = part.agg(F.sum(value), *[F.sum(factor * F.col(f"g{k}")) for k in range(n)]).first()
    return float(total[0] or 0.0), np.array([float(x or 0.0) for x in total[1:]])


def first_weights(features: int, events: int, exposure: float | None) -> np.ndarray:
    """Only an intercept: the events in an hour of exposure."""
    rate = min(0.5, max(1e-6, events / max(float(exposure or 1), 1.0)))
    return np.array([np.log(rate / (1 - rate)), *[0.0] * features])


def ascent(w: np.ndarray, ridge: float, iterations: int = 60, tolerance: float = 1e-5) -> Generator[np.ndarray, tuple[float, np.ndarray], tuple[np.ndarray, bool, list[list[float]]]]:
    """BFGS with Armijo steps, as a dialogue: it yields weights and is sent their log-likelihood and gradient.

    Ends with weights, whether they converged, and their covariance (empty where the information
    is not positive definite).  Who asks decides how many such searches share a job.
    """
    penalty = np.array([0.0] + [ridge] * (len(w) - 1))

    def penalised(at: np.ndarray, found: tuple[float, np.ndarray]) -> tuple[float, np.ndarray]:
        return -found[0] + 0.5 * float(penalty @ (at * at)), -found[1] + penalty * at

    h = np.eye(len(w))
    value, gradient = penalised(w, (yield w))
    converged = False
    for _ in range(iterations):
        if np.abs(gradient).max() < tolerance:
            converged = True
            break
        step = -h @ gradient
        if step @ gradient >= 0:
            h, step = np.eye(len(w)), -gradient
        size = 1.0
        while size > 1e-8:
            new_value, new_gradient = penalised(w + size * step, (yield w + size * step))
            if new_value <= value + 1e-4 * size * (step @ gradient):
                break
            size /= 2
        else:
            break
        s, y = size * step, new_gradient - gradient
        if s @ y > 1e-12:
            rho, eye = 1 / (s @ y), np.eye(len(w))
            h = (eye - rho * np.outer(s, y)) @ h @ (eye - rho * np.outer(y, s)) + rho * np.outer(s, s)
        w, value, gradient = w + s, new_value, new_gradient
    # observed information by central differences of the gradient
    information = np.zeros((len(w), len(w)))
    for k in range(len(w)):
        move = np.zeros(len(w))
        move[k] = 1e-4
        above = penalised(w + move, (yield w + move))[1]
        information[k] = (above - penalised(w - move, (yield w - move))[1]) / 2e-4
    information = (information + information.T) / 2
    values, vectors = np.linalg.eigh(information)
    return w, converged, ((vectors / values) @ vectors.T).tolist() if values.min() > 1e-10 * max(values.max(), 1e-300) else []


def fit(examples: DataFrame, features: Sequence[str], event: str, exposure: str, ridge: float = 1.0, iterations: int = 60, tolerance: float = 1e-5) -> HazardModel:
    """Maximise the penalised likelihood by BFGS with Armijo steps; only sums go to the driver.

    ``event`` is null for hours without an event; hours that share a value may hold that event, of
    which ``exposure`` says how much of the hour does.  Features of about no variance keep scale 1.
    """
    stats = {r["feature"]: r for r in standardisation(examples, features).collect()}  # one row a feature
    model = HazardModel(list(features), [float(stats[c]["mean"] or 0) for c in features], [float(stats[c]["scale"] or 1) for c in features], [0.0] * (len(features) + 1))
    rows = examples.select(F.col(event).alias("event"), F.col(exposure).cast("double").alias("exposure"), model.row().alias("x")).persist()
    try:
        counts = examples.agg(F.countDistinct(event), F.sum(exposure)).first()
        search = ascent(first_weights(len(features), counts[0], counts[1]), ridge, iterations, tolerance)
        w = next(search)
        while True:
            try:
                w = search.send(_likelihood(rows, w))
            except StopIteration as end:
                w, model.converged, model.covariance = end.value
                break
        model.weights = w.tolist()
    finally:
        rows.unpersist()
    return model
