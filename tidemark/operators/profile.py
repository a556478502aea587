"""Whole reports: a threshold profile, impact episodes, a trained challenger, a consistent set of served views."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.hashing import canonical_json
from tidemark.functions.time import from_micros, micros
from tidemark.operators import metrics, model
from tidemark.operators.episodes import milestones, pressure_at, window_classes
from tidemark.operators.linking import sample_times, scored_clusters
from tidemark.operators.sequences import non_overlapping
from tidemark.session import stored

# Why a window has no label, as ``window_classes`` says it.
EXCLUSIONS = ("immature", "censored_anchor_inside_outcome", "censored_ambiguous_outcome", "censored_incomplete_coverage")

#: What states weigh in an episode's pressure; others weigh 1.
STATE_WEIGHTS = {"resolved": 0.2, "mitigating": 0.6}


def labelled_windows(windows: DataFrame, outcomes: DataFrame, coverage: DataFrame, on: Sequence[str], ids: Sequence[str], cutoff: Column, bin_hours: float) -> DataFrame:
    """``windows`` with status and y: 1 or 0 where there is a label, null where a window is excluded."""
    classes = window_classes(windows, outcomes, coverage, on, ids, cutoff, bin_hours)
    return classes.withColumn("y", F.when(F.col("status") == "positive", 1).when(F.col("status") == "negative", 0))


def threshold_profile(rows: DataFrame, events: DataFrame, keys: Sequence[str], p: str, minimum_windows: int = 1008, minimum_events: int = 20) -> DataFrame:
    """One row a key: status, reason, sample and event counts, gate, exclusions, moments and Brier score.

    ``rows`` has status and y (see ``labelled_windows``); ``events`` has a row for each distinct
    outcome that some labelled window holds.
    """
    used = F.col("y").isNotNull()
    se = F.pow(F.col(p) - F.col("y"), F.lit(2.0))
    out = rows.groupBy(*keys).agg(
        F.count_if(used).alias("sample_count"), F.avg(F.when(used, F.col(p))).alias("mean"), F.stddev_pop(F.when(used, F.col(p))).alias("deviation"), F.avg(F.when(used, se)).alias("brier"), *[F.count_if(F.col("status") == name).alias(name) for name in EXCLUSIONS]
    )
    out = out.join(events.groupBy(*keys).agg(F.count(F.lit(1)).alias("event_count")), list(keys), "left").withColumn("event_count", F.coalesce("event_count", F.lit(0).cast("long")))
    passed = (F.col("sample_count") >= minimum_windows) & (F.col("event_count") >= minimum_events)
    status = F.when(F.col("sample_count") == 0, "insufficient").when(passed, "available").otherwise("preliminary")
    reason = F.when(F.col("sample_count") == 0, "no_labelled_windows").when(~passed, "sample_gate_not_met")
    return out.withColumns({"passed": passed, "status": status, "reason": reason})


def _edge(p: str, steps: int) -> Column:
    """The highest k with k / steps below p, as ``metrics.threshold_sweep`` has it."""
    return (F.ceil(F.col(p) * steps - 1e-12) - 1).cast("int")


def profile_curve(windows: DataFrame, held: DataFrame, p: str, start: str, tie: str, event: str, hours: float, least: int = 20) -> DataFrame:
    """One row for each per cent from 0 to 100: what windows with a probability above it came to.

    ``windows`` have a label y each (several of one start differ in ``tie``); ``held`` has the
    events in positive windows with the window's probability.  alerts and hits of all windows;
    chosen and chosen_hits of a chronological choice of windows of ``hours`` that do not overlap,
    with rate and Wilson interval; confidence, the rate where at least ``least`` were chosen;
    events_hit and recall of the events that can be hit; density of the probabilities.

    A window reaches each threshold below it, at most 100; the choice is made by threshold, over
    windows of one report, whose number the hours of its time bound.
    """
    sweep = metrics.threshold_sweep(windows, p, "y").withColumnRenamed("precision", "window_rate")
    k = "threshold_percent"
    above = windows.select(start, tie, "y", F.explode(F.when(_edge(p, 100) >= 0, F.sequence(F.lit(0), _edge(p, 100)))).alias(k))
    apart = non_overlapping(above, [k], start, tie, hours).filter("chosen = 1")
    rates = metrics.wilson_rates(apart, [k], "y").select(k, F.col("n").alias("chosen"), F.col("hits").alias("chosen_hits"), "low", "high")
    best = held.groupBy(event).agg(F.max(_edge(p, 100)).alias("__k")).groupBy("__k").agg(F.count(F.lit(1)).alias("__n"))  # at most 101 rows
    reached = best.withColumn(k, F.explode(F.when(F.col("__k") >= 0, F.sequence(F.lit(0), F.col("__k"))))).groupBy(k).agg(F.sum("__n").alias("events_hit"))
    total = best.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__events"))
    out = sweep.join(F.broadcast(rates), k, "left").join(F.broadcast(reached), k, "left").crossJoin(F.broadcast(total))  # 101 rows, and a single one
    out = out.join(F.broadcast(metrics.density(windows, p).select(F.col("i").alias(k), "density")), k, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("chosen", "chosen_hits", "events_hit")})
    rate = F.when(F.col("chosen") > 0, F.col("chosen_hits") / F.col("chosen"))
    recall = F.when(F.col("__events") > 0, F.col("events_hit") / F.col("__events"))
    return out.select(k, "alerts", "hits", "window_rate", "chosen", "chosen_hits", rate.alias("rate"), "low", "high", F.when(F.col("chosen") >= least, rate).alias("confidence"), "events_hit", recall.alias("recall"), F.coalesce("density", F.lit(0.0)).alias("density"))


def whole_profile(rows: DataFrame, held: DataFrame, p: str, start: str, tie: str, event: str, hours: float, minimum_windows: int = 1008, minimum_events: int = 20) -> DataFrame:
    """The whole report as one row: ``threshold_profile`` with positives, negatives, first and last window, both gates, summary, distribution (20 bins) and curve (101 points).

    content names the labelled windows, whatever their order: the sum of their hashes.  Without a
    labelled window the counts are 0, and what they would average is null.
    """
    used = stored(rows.filter(F.col("y").isNotNull()).select(start, tie, p, "y"), "windows")
    one = F.lit(1).alias("__one")
    base = threshold_profile(rows.select("*", one), held.select(event, one).distinct(), ["__one"], p, minimum_windows, minimum_events).drop("__one", "mean", "deviation")
    content = F.sum(F.xxhash64(start, tie, p, "y").cast("decimal(38,0)")).cast("string")
    more = used.agg(F.count_if(F.col("y") == 1).alias("positive"), F.count_if(F.col("y") == 0).alias("negative"), F.min(start).alias("first_start"), F.max(start).alias("last_start"), content.alias("content"))
    summary = metrics.distribution_summary(used, p).select(F.struct("*").alias("summary"))
    bins = metrics.histogram(used, p, "y").agg(F.array_sort(F.collect_list(F.struct("*"))).alias("distribution"))  # 20 bins
    curve = profile_curve(used, held, p, start, tie, event, hours).agg(F.array_sort(F.collect_list(F.struct("*"))).alias("curve"))  # 101 points
    out = base
    for part in (more, summary, bins, curve):
        out = out.crossJoin(F.broadcast(part))  # a single row each
    gates = {"windows_passed": F.col("sample_count") >= minimum_windows, "events_passed": F.col("event_count") >= minimum_events}
    return out.withColumns(gates)


def compact_profile(profile: DataFrame, curve: DataFrame, keys: Sequence[str], percents: Sequence[int]) -> DataFrame:
    """The columns of a profile that a reader is shown, with the points of some thresholds as one array."""
    points = metrics.compact_points(curve).filter(F.col("threshold_percent").isin(*percents))
    packed = points.agg(F.array_sort(F.collect_list(F.struct("threshold_percent", "alerts", "precision", "low", "high"))).alias("points"))  # as many as asked for
    return profile.select(*keys, "status", "reason", "sample_count", "event_count").crossJoin(F.broadcast(packed))


def impact_episodes(entries: DataFrame, keys: Sequence[str], tie: str, severity: str, official: Column, at: Column, gap_hours: float, ttl_hours: float, half_life_hours: float, weights: Mapping[str, float] = STATE_WEIGHTS) -> DataFrame:
    """Episodes of evidence (see ``scored_clusters``; with state and ``severity`` from 0 to 1) as they stand at a time.

    Hull, number, surfaces and milestones; state, active spell and pressure of the folded lifecycle
    (see ``pressure_at``), and the highest pressure that it ever had, at the times at which it can
    peak.  Each entry is a source of its own.
    """
    clustered = stored(scored_clusters(entries, keys, "first_at", "last_at", tie, "category", "surfaces", "tokens", "followup", gap_hours), "clustered")  # folded once, read many times
    own = [*keys, "cluster"]
    hull = clustered.groupBy(*own).agg(F.min("first_at").alias("start"), F.max("last_at").alias("end"), F.count(F.lit(1)).alias("n"), F.size(F.array_distinct(F.flatten(F.collect_set("surfaces")))).alias("n_surfaces"))
    marks = milestones(clustered, own, "first_at", "state", official)
    updates = clustered.withColumns({"__scope": F.least(F.lit(1.0), F.size("surfaces") / 5), "__workaround": F.lit(0.5)})
    samples = sample_times(updates, own, "last_at", at, ttl_hours)
    levels = pressure_at(updates, samples, own, "last_at", tie, tie, "state", severity, "__scope", "__workaround", "category", weights, ttl_hours, half_life_hours)
    now = F.col("sample") == micros(at)
    shown = {c: F.max(F.when(now, F.col(c))) for c in ("state", "severity", "pressure")}
    spell = from_micros(F.max(F.when(now, F.col("spell_start"))))
    assessed = levels.groupBy(*own).agg(*[c.alias(n) for n, c in shown.items()], spell.alias("spell_start"), F.max("pressure").alias("peak_pressure"))
    return hull.join(marks, own).join(assessed, own)


def train_challenger(examples: DataFrame, features: Sequence[str], event: str, exposure: str, lineage: Mapping[str, object]) -> dict[str, object]:
    """A fitted model with its lineage and the hash that names it: weights, scales and lineage in canonical form."""
    fitted = model.fit(examples, features, event, exposure)
    artifact: dict[str, object] = {"features": list(features), "means": fitted.means, "scales": fitted.scales, "weights": fitted.weights, "clip": fitted.clip, "converged": fitted.converged, "lineage": dict(lineage)}
    return {**artifact, "artifact_hash": "sha256:" + hashlib.sha256(canonical_json(artifact).encode()).hexdigest()}


def artifact_is_intact(artifact: Mapping[str, object]) -> bool:
    """Whether an artifact still has the hash that it states."""
    own = {k: v for k, v in artifact.items() if k != "artifact_hash"}
    return artifact.get("artifact_hash") == "sha256:" + hashlib.sha256(canonical_json(own).encode()).hexdigest()


def watermark(df: DataFrame, time: str, key: str) -> str:
    """A hash that changes when rows are added, changed or repeated: their number, last time and the sum of the hashes of all their columns."""
    whole = F.xxhash64(key, *df.columns).cast("decimal(38,0)")
    r = df.agg(F.count(F.lit(1)).alias("n"), F.max(time).cast("string").alias("t"), F.sum(whole).cast("string").alias("x")).first()
    return hashlib.sha256(f"{r['n']}|{r['t']}|{r['x']}".encode()).hexdigest()


def serve(spark: SparkSession, source: str, views: Mapping[str, object], time: str, key: str, path: str, attempts: int = 3) -> bool:
    """Write views, functions of one table, that belong together; whether the table held still for one of the ``attempts``.

    The table's files are listed once an attempt, so that all views read the same rows; if its
    watermark has moved when they are written, they are written again.
    """
    for _ in range(attempts):
        pinned = spark.read.parquet(*spark.read.parquet(source).inputFiles())
        before = watermark(pinned, time, key)
        for name, view in views.items():
            view(pinned).withColumn("watermark", F.lit(before)).write.mode("overwrite").parquet(f"{path}/{name}")
        spark.catalog.refreshByPath(source)
        if watermark(spark.read.parquet(source), time, key) == before:
            return True
    return False
