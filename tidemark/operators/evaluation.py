"""Walk-forward evaluation with the hazard model: all folds fitted together, paired with a champion.

Each fold learns from what was known at its origin.  The searches of all folds advance side by
side: one aggregation by fold answers the step that each of them asks for, and a fold that has
converged asks no more.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.math import clamp, sigmoid
from tidemark.operators.metrics import bin_by_edges
from tidemark.operators.model import HazardModel, ascent, first_weights


def _rows_by_fold(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Each row once for every fold of ``folds`` that may learn from it."""
    return rows.withColumn("fold", F.explode(F.sequence("first", "last"))).join(F.broadcast(folds), "fold")  # a row a fold


def _standardised(features: Sequence[str], clip: float) -> list[Column]:
    z = [(F.col(c).cast("double") - F.get("means", F.lit(k))) / F.get("scales", F.lit(k)) for k, c in enumerate(features)]
    return [F.lit(1.0), *[F.least(F.greatest(x, F.lit(-clip)), F.lit(clip)) for x in z]]


def _total(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def _parameters(rows: DataFrame, models: Mapping[int, HazardModel], weights: Mapping[int, np.ndarray]) -> DataFrame:
    table = [(k, models[k].means, models[k].scales, [float(x) for x in w]) for k, w in sorted(weights.items())]
    return rows.sparkSession.createDataFrame(table, "fold int, means array<double>, scales array<double>, weights array<double>")


def fold_likelihoods(rows: DataFrame, models: Mapping[int, HazardModel], weights: Mapping[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
    """Log-likelihood and gradient of each fold at its own weights, in one job."""
    features = next(iter(models.values())).features
    n = len(features) + 1
    met = _rows_by_fold(rows, _parameters(rows, models, weights))
    x = [f"__x{k}" for k in range(n)]
    met = met.select("fold", "event", "exposure", "weights", *[c.alias(name) for c, name in zip(_standardised(features, next(iter(models.values())).clip), x, strict=True)])
    p = clamp(sigmoid(_total([F.get("weights", F.lit(k)) * F.col(c) for k, c in enumerate(x)])), 1e-12, 1 - 1e-12)
    scored = met.select("fold", "event", "exposure", p.alias("p"), *x)
    part = scored.groupBy("fold", "event").agg(F.sum(F.col("exposure") * F.log1p(-F.col("p"))).alias("l"), *[F.sum(-F.col("exposure") * F.col("p") * F.col(c)).alias(f"g{k}") for k, c in enumerate(x)])
    quiet = F.col("event").isNull()
    stay = F.exp(F.least(F.col("l"), F.lit(-1e-12)))
    value = F.when(quiet, F.col("l")).otherwise(F.log(F.greatest(1 - stay, F.lit(1e-300))))
    factor = F.when(quiet, 1.0).otherwise(-stay / F.greatest(1 - stay, F.lit(1e-300)))
    found = part.groupBy("fold").agg(F.sum(value).alias("l"), *[F.sum(factor * F.col(f"g{k}")).alias(f"g{k}") for k in range(n)]).collect()  # a row a fold
    return {r["fold"]: (float(r["l"]), np.array([float(r[f"g{k}"]) for k in range(n)])) for r in found}


def fit_folds(examples: DataFrame, origins: Mapping[int, object], features: Sequence[str], event: str, exposure: str, known: str, ridge: float = 1.0, iterations: int = 60, tolerance: float = 1e-5) -> dict[int, HazardModel]:
    """A hazard model for each fold, fitted on the examples whose ``known`` time is at most its origin.

    ``origins``: the origin of each fold, later folds having later ones.  Weights are those that
    ``model.fit`` finds on each fold's examples alone.  The number of jobs is that of the slowest
    fold, whatever the number of folds.  A fold without examples has no model.
    """
    numbers = sorted(origins)
    if not numbers:
        return {}
    times = F.array(*[F.lit(origins[k]) for k in numbers])
    first = F.size(F.filter(times, lambda o: o < F.col(known)))
    rows = examples.select(first.alias("place"), F.col(event).alias("event"), F.col(exposure).cast("double").alias("exposure"), *features).filter(F.col("place") < len(numbers))
    rows = rows.withColumn("first", F.get(F.array(*[F.lit(k) for k in numbers]), F.col("place"))).withColumn("last", F.lit(numbers[-1])).drop("place").persist()
    try:
        every = rows.sparkSession.createDataFrame([(k,) for k in numbers], "fold int")
        sums = [f(c).alias(f"{name}_{c}") for c in features for name, f in (("m", F.avg), ("s", F.stddev_pop))]
        stats = _rows_by_fold(rows, every).groupBy("fold").agg(F.countDistinct("event").alias("events"), F.sum("exposure").alias("exposure"), *sums).collect()
        models, searches, asked = {}, {}, {}
        for r in stats:
            k = r["fold"]
            scales = [1.0 if (r[f"s_{c}"] or 0) < 1e-8 else float(r[f"s_{c}"]) for c in features]
            models[k] = HazardModel(list(features), [float(r[f"m_{c}"] or 0) for c in features], scales, [], converged=False)
            searches[k] = ascent(first_weights(len(features), r["events"], r["exposure"]), ridge, iterations, tolerance)
            asked[k] = next(searches[k])
        while asked:
            found = fold_likelihoods(rows, models, asked)
            for k in list(asked):
                try:
                    asked[k] = searches[k].send(found[k])
                except StopIteration as end:
                    w, models[k].converged, models[k].covariance = end.value
                    models[k].weights = w.tolist()
                    del asked[k]
    finally:
        rows.unpersist()
    return models


def base_rates(examples: DataFrame, origins: Mapping[int, object], event: str, exposure: str, known: str) -> DataFrame:
    """fold and rate: events in an hour of exposure of what was known at the fold's origin."""
    folds = F.explode(F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(o).alias("origin")) for k, o in sorted(origins.items())]))
    rows = examples.groupBy(F.date_trunc("hour", F.col(known)).alias("known")).agg(F.count(event).alias("__y"), F.sum(exposure).alias("__e"))  # a row an hour
    rows = rows.withColumn("__f", folds).filter(F.col("known") <= F.col("__f.origin"))
    return rows.groupBy(F.col("__f.fold").alias("fold")).agg(clamp(F.sum("__y") / F.sum("__e"), 1e-6, 0.5).alias("rate"))


def score_folds(tests: DataFrame, models: Mapping[int, HazardModel], name: str = "hazard") -> DataFrame:
    """``tests`` with the hazard that its fold's model gives; rows of folds without a model fall away."""
    if not models:
        return tests.limit(0).withColumn(name, F.lit(None).cast("double"))
    features, clip = next(iter(models.values())).features, next(iter(models.values())).clip
    met = tests.join(F.broadcast(_parameters(tests, models, {k: np.array(m.weights) for k, m in models.items()})), "fold")  # a row a fold
    eta = _total([F.get("weights", F.lit(k)) * x for k, x in enumerate(_standardised(features, clip))])
    return met.withColumn(name, clamp(sigmoid(eta), 1e-9, 1 - 1e-9)).select(*tests.columns, name)


def log_loss(p: Column, label: Column) -> Column:
    q = clamp(p, 1e-12, 1 - 1e-12)
    return -F.when(label == 1, F.log(q)).otherwise(F.log1p(-q))


def paired_deltas(rows: DataFrame, keys: Sequence[str], p: str, champion: str, label: str) -> DataFrame:
    """Challenger less champion over the same rows: mean Brier and log-loss deltas, their standard errors, the share of rows that got better.

    Rows that either side has no forecast for are no pairs.  A negative delta is better.  Standard
    errors are null for fewer than two rows.
    """
    y = F.col(label)
    paired = rows.filter(F.col(p).isNotNull() & F.col(champion).isNotNull() & y.isNotNull())
    brier = F.pow(F.col(p) - y, F.lit(2.0)) - F.pow(F.col(champion) - y, F.lit(2.0))
    loss = log_loss(F.col(p), y) - log_loss(F.col(champion), y)
    d = paired.select(*keys, brier.alias("__b"), loss.alias("__l"))
    error = [(F.stddev_samp(c) / F.sqrt(F.count(F.lit(1)))).alias(n) for c, n in (("__b", "brier_error"), ("__l", "log_loss_error"))]
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("__b").alias("brier_delta"), F.avg("__l").alias("log_loss_delta"), *error, F.avg((F.col("__b") < 0).cast("double")).alias("better_share"))


def rows_hash(line: Column) -> Column:
    """Hash of a multiset of lines, whatever their order: the SHA-256 of their number and of the sum of sixty bits of each one's MD5."""
    bits = F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.count(F.lit(1)).cast("string"), F.lit(":"), F.sum(bits).cast("string")), 256))


def fold_metrics(rows: DataFrame, keys: Sequence[str], p: str, label: str, line: Column, bins: int = 10) -> DataFrame:
    """n, expected calibration error over ``bins`` equal bins, and rows_hash of the lines of each key."""
    kept = rows.select(*keys, F.col(p).alias("__p"), F.col(label).alias("__y"), bin_by_edges(F.col(p), bins).alias("__bin"), line.alias("__line"))
    gaps = kept.groupBy(*keys, "__bin").agg(F.abs(F.sum("__p") - F.sum("__y")).alias("__gap"))
    ece = gaps.groupBy(*keys).agg(F.sum("__gap").alias("__gap"))
    whole = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), rows_hash(F.col("__line")).alias("rows_hash"))
    return whole.join(ece, list(keys)).select(*keys, "n", (F.col("__gap") / F.col("n")).alias("ece"), "rows_hash")


def fold_recall(events: DataFrame, alerts: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Events of each fold, those that an alert of the fold foresaw, and recall (0 without events).

    ``events`` has keys, fold, an id and ``time``; ``alerts`` has keys, fold, window_start and
    window_end.  An alert counts that began before the event and whose window holds its time.
    """
    on = [F.col(f"e.{c}") == F.col(f"a.{c}") for c in [*keys, "fold"]]
    at = F.col(f"e.{time}")
    own = events.select(*keys, "fold", time)
    met = own.alias("e").join(alerts.alias("a"), [*on, F.col("a.window_start") < at, F.col("a.window_end") > at], "left_semi")  # alerts of a fold are a budget
    counts = own.groupBy(*keys, "fold").agg(F.count(F.lit(1)).alias("events"))
    hits = met.groupBy(*keys, "fold").agg(F.count(F.lit(1)).alias("hits"))
    out = counts.join(hits, [*keys, "fold"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long"))
    return out.withColumn("recall", F.when(F.col("events") > 0, F.col("hits") / F.col("events")).otherwise(0.0))
