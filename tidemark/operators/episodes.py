"""Episodes and their assessment: states of candidates, ranges, milestones, pressure, revisions, labels of windows, alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.math import clamp
from tidemark.functions.time import HOUR_US, micros
from tidemark.operators.intervals import contained, overlap_join

# What each part of an episode weighs in its pressure, and the corroboration of one source and of each further one.
PARTS = {"severity": 0.4, "scope": 0.25, "persistence": 0.1, "corroboration": 0.15, "workaround": 0.1}
ONE_SOURCE, EACH_FURTHER = 0.4, 0.2


def candidate_states(signals: DataFrame, keys: Sequence[str], phase: str, stance: str) -> DataFrame:
    """state of each candidate: closed by a completed signal, else contradicted, supported or open by its stances."""
    votes = signals.groupBy(*keys).agg(F.count_if(F.col(phase) == "completed").alias("done"), F.count_if(F.col(stance) == "supports").alias("for_"), F.count_if(F.col(stance) == "contradicts").alias("against"))
    state = F.when(F.col("done") > 0, "closed").when(F.col("against") > F.col("for_"), "contradicted").when(F.col("for_") > 0, "supported").otherwise("open")
    return votes.select(*keys, state.alias("state"))


def hypothesised_ranges(ranges: DataFrame, keys: Sequence[str], start: str, end: str, precision: str) -> DataFrame:
    """The hull of each key's ranges, its precision where all agree and ``unknown`` otherwise."""
    some = ranges.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    alike = F.min(precision).eqNullSafe(F.max(precision)) & (F.count(precision) == F.count(F.lit(1)))
    return some.groupBy(*keys).agg(F.min(start).alias(start), F.max(end).alias(end), F.when(alike, F.min(precision)).otherwise("unknown").alias(precision))


def milestones(updates: DataFrame, keys: Sequence[str], time: str, state: str, official: Column) -> DataFrame:
    """acknowledged_at (first official update), mitigated_at and resolved_at (last of their state) of each episode."""
    return updates.groupBy(*keys).agg(
        F.min(F.when(official, F.col(time))).alias("acknowledged_at"),
        F.max(F.when(F.col(state) == "mitigating", F.col(time))).alias("mitigated_at"),
        F.max(F.when(F.col(state) == "resolved", F.col(time))).alias("resolved_at"),
    )


def peak_impact(updates: DataFrame, keys: Sequence[str], ranks: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """The update of the highest ``ranks`` of each episode; among equals the one of the smallest ``tie``."""
    best = Window.partitionBy(*keys).orderBy(*[F.desc(r) for r in ranks], *tie)
    return updates.withColumn("__rank", F.row_number().over(best)).filter("__rank = 1").drop("__rank")


def persistence(active_hours: Column, ttl_hours: float) -> Column:
    """Share, from 0 to 1, that whole active hours reach on a curve that saturates at ``ttl_hours``."""
    whole = F.floor(clamp(active_hours, 0.0, ttl_hours))
    return F.expm1(-3 * whole / F.lit(ttl_hours)) / F.expm1(F.lit(-3.0))


def freshness(idle_hours: Column, ttl_hours: float, half_life_hours: float) -> Column:
    """1 until ``ttl_hours`` without an update, then halved with each half-life; whole hours count."""
    return F.pow(F.lit(0.5), F.floor(F.greatest(F.lit(0.0), idle_hours - ttl_hours)) / F.lit(half_life_hours))


def pressure(parts: Mapping[str, Column], lifecycle: Column, sources: Column, active_hours: Column, idle_hours: Column, ttl_hours: float, half_life_hours: float) -> Column:
    """Pressure of an episode, from 0 to 1.

    ``parts`` has severity, scope and workaround as weights from 0 to 1, ``lifecycle`` that of the
    state; ``sources`` counts independent evidence.
    """
    corroboration = F.least(F.lit(1.0), ONE_SOURCE + EACH_FURTHER * F.greatest(F.lit(0), sources - 1))
    every = {**parts, "persistence": persistence(active_hours, ttl_hours), "corroboration": corroboration}
    base = sum((every[k] * w for k, w in PARTS.items()), F.lit(0.0))
    return clamp(base * lifecycle * freshness(idle_hours, ttl_hours, half_life_hours), 0.0, 1.0)


def pressure_at(
    updates: DataFrame, samples: DataFrame, keys: Sequence[str], time: str, tie: str, group: str, state: str, severity: str, scope: str, workaround: str, category: str, weights: Mapping[str, float], ttl_hours: float, half_life_hours: float, bucket_hours: float = 24.0
) -> DataFrame:
    """State and pressure of each episode at each of its sample times (keys, sample in microseconds), by what was known then.

    The state is that of the last update, but ``reopened`` for one that is not resolved after any
    that was.  Its active spell begins with the first update after a resolved one and ends with the
    last resolved one, or at the sample.  Severity and scope are those of the highest update of the
    first one's category, workaround is the last one's, and sources are distinct groups.
    ``weights`` says what states weigh (1 where it doesn't).  Samples before the first update fall
    away.

    A sweep over updates and samples together.  Episodes are cut at buckets of time: what is
    carried over (sums and maxima) comes from the buckets' totals, so that no task sorts more than
    a bucket of an episode.
    """
    width = int(bucket_hours * HOUR_US)
    t = micros(F.col(time))
    columns = {"__t": t, "__tie": F.col(tie), "__state": F.col(state), "__sev": F.col(severity).cast("double"), "__scope": F.col(scope).cast("double"), "__work": F.col(workaround).cast("double"), "__cat": F.col(category), "__group": F.col(group)}
    rows = updates.select(*keys, *[c.alias(n) for n, c in columns.items()]).withColumn("__bucket", F.floor(F.col("__t") / width))
    order = F.struct("__t", "__tie")
    first = rows.groupBy(*keys).agg(F.min_by("__cat", order).alias("__first_cat"))
    ends = rows.groupBy(*keys, "__bucket").agg(F.max_by("__state", order).alias("__end_state"))
    ends = ends.withColumn("__before", F.lag("__end_state").over(Window.partitionBy(*keys).orderBy("__bucket"))).drop("__end_state")
    own = [*keys, "__bucket"]
    rows = rows.join(ends, own).join(first, list(keys))
    within = Window.partitionBy(*own).orderBy("__t", "__tie")
    was = F.coalesce(F.lag("__state").over(within), F.col("__before"))
    begins = was.isNull() | ((was == "resolved") & (F.col("__state") != "resolved"))
    no = F.lit(None)
    facts = rows.select(
        *own, "__t", F.lit(0).alias("__side"), "__tie",
        F.struct("__t", "__tie", "__state", "__work").alias("__last"),
        F.when(F.col("__cat").eqNullSafe(F.col("__first_cat")), F.struct("__sev", "__scope")).alias("__peak"),
        F.when(begins, F.col("__t")).alias("__start"),
        (F.col("__state") == "resolved").alias("__done"),
        F.lit(0).cast("long").alias("__new"),
    )
    types = dict(facts.dtypes)
    empty = {n: no.cast(types[n]).alias(n) for n in ("__tie", "__last", "__peak", "__start", "__done")}
    groups = rows.groupBy(*keys, "__group").agg(F.min("__t").alias("__t")).withColumn("__bucket", F.floor(F.col("__t") / width))
    groups = groups.select(*own, "__t", F.lit(0).alias("__side"), *empty.values(), F.lit(1).cast("long").alias("__new"))
    asked = samples.select(*keys, F.col("sample").cast("long").alias("__t")).withColumn("__bucket", F.floor(F.col("__t") / width))
    asked = asked.select(*own, "__t", F.lit(1).alias("__side"), *empty.values(), F.lit(0).cast("long").alias("__new"))
    swept = facts.unionByName(groups).unionByName(asked)
    carried = {"__last": F.max, "__peak": F.max, "__start": F.max, "__done": F.max, "__new": F.sum}
    totals = swept.groupBy(*own).agg(*[f(n).alias(n) for n, f in carried.items()])
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*own, *[f(n).over(earlier).alias(f"{n}_p") for n, f in carried.items()])
    so_far = Window.partitionBy(*own).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    met = swept.select(*own, "__t", "__side", *[f(n).over(so_far).alias(n) for n, f in carried.items()]).filter("__side = 1").join(totals, own)
    both = {n: (F.coalesce(n, F.lit(0)) + F.coalesce(f"{n}_p", F.lit(0)) if n == "__new" else F.greatest(n, f"{n}_p")) for n in carried}
    met = met.select(*keys, F.col("__t").alias("sample"), *[c.alias(n) for n, c in both.items()]).filter("__last is not null")
    last = F.col("__last.__state")
    found = met.select(
        *keys, "sample",
        F.when((last != "resolved") & F.col("__done"), "reopened").otherwise(last).alias("state"),
        F.col("__new").alias("sources"),
        F.col("__start").alias("spell_start"),
        F.when(last == "resolved", F.col("__last.__t")).otherwise(F.col("sample")).alias("spell_end"),
        F.col("__last.__t").alias("last_update"),
        F.col("__peak.__sev").alias("severity"), F.col("__peak.__scope").alias("scope"), F.col("__last.__work").alias("workaround"),
    )
    weight = F.lit(1.0)
    for name, w in weights.items():
        weight = F.when(F.col("state") == name, float(w)).otherwise(weight)
    active = clamp((F.col("spell_end") - F.col("spell_start")) / F.lit(float(HOUR_US)), 0.0, ttl_hours)
    idle = F.greatest(F.lit(0.0), (F.col("sample") - F.col("last_update")) / F.lit(float(HOUR_US)))
    level = pressure({k: F.col(k) for k in ("severity", "scope", "workaround")}, weight, F.col("sources"), active, idle, ttl_hours, half_life_hours)
    return found.withColumns({"active_hours": active, "idle_hours": idle, "pressure": level})


def revision_kinds(versions: DataFrame, keys: Sequence[str], order: str, state: str, ranks: Sequence[str], evidence: str, level: str, material: float = 0.005) -> DataFrame:
    """kind and trend of each version beside the one before.

    ``evidence`` is an array of groups, ``level`` the pressure, of which a change below
    ``material`` is stable.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    was = {c: F.lag(c).over(w) for c in (state, evidence, level, *ranks)}
    first = F.lag(order).over(w).isNull()
    higher = F.lit(False)
    for r in ranks:
        higher |= F.col(r) > was[r]
    kind = (
        F.when(first, "opened")
        .when((was[state] == "resolved") & (F.col(state) == "reopened"), "reopened")
        .when((F.col(state) == "resolved") & (was[state] != "resolved"), "resolved")
        .when((F.col(state) == "mitigating") & (was[state] != "mitigating"), "mitigated")
        .when(higher, "escalated")
        .when(F.size(F.array_except(evidence, was[evidence])) > 0, "evidence_added")
        .when(F.col(evidence) != was[evidence], "evidence_updated")
        .otherwise("recomputed")
    )
    change = F.col(level) - was[level]
    trend = (
        F.when(F.col(state).isin("resolved", "unknown"), F.col(state))
        .when((F.col(state) == "reopened"), "rising")
        .when(F.col(state) == "mitigating", "falling")
        .when(first | (change >= material), "rising")
        .when(change <= -material, "falling")
        .otherwise("stable")
    )
    return versions.withColumns({"kind": kind, "trend": trend})


def window_classes(windows: DataFrame, outcomes: DataFrame, coverage: DataFrame, on: Sequence[str], ids: Sequence[str], cutoff: Column, bin_hours: float) -> DataFrame:
    """status of each window (start, end): its label, or why it has none.

    ``outcomes`` has from_, to and ambiguous; ``coverage`` merged, non-overlapping intervals
    covered_from and covered_to.  A window is immature beyond the cutoff; censored where it starts
    inside an outcome, meets an ambiguous one, or is not covered; positive where an outcome starts
    in it; else negative.
    """
    pairs = overlap_join(windows.select(*dict.fromkeys([*on, *ids, "start", "end"])), outcomes.select(*on, "from_", "to", "ambiguous"), on, ("start", "end"), ("from_", "to"), bin_hours)
    seen = pairs.groupBy(*ids).agg(F.bool_or(F.col("from_") <= F.col("start")).alias("inside"), F.bool_or("ambiguous").alias("unclear"), F.bool_or(~F.col("ambiguous") & (F.col("from_") > F.col("start"))).alias("hit"))
    open_ = contained(windows.select(*dict.fromkeys([*on, *ids, "start", "end"])), coverage, on, ("start", "end"), ("covered_from", "covered_to"), "left_anti", bucket="day").select(*ids, F.lit(True).alias("open"))
    status = (
        F.when(F.col("end") > cutoff, "immature")
        .when(F.col("inside"), "censored_anchor_inside_outcome")
        .when(F.col("unclear"), "censored_ambiguous_outcome")
        .when(F.col("hit"), "positive")
        .when(F.col("open"), "censored_incomplete_coverage")
        .otherwise("negative")
    )
    return windows.join(seen, list(ids), "left").join(open_, list(ids), "left").withColumn("status", status).drop("inside", "unclear", "hit", "open")


def alert_matches(events: DataFrame, alerts: DataFrame, on: Sequence[str], ids: Sequence[str], bin_hours: float) -> DataFrame:
    """For each event (start, end): how many alert windows (alert_start, alert_end, p) that began before it overlap it, the highest p, the longest lead."""
    pairs = overlap_join(events.select(*dict.fromkeys([*on, *ids, "start", "end"])), alerts.select(*on, "alert_start", "alert_end", "p"), on, ("start", "end"), ("alert_start", "alert_end"), bin_hours)
    lead = (micros(F.col("start")) - micros(F.col("alert_start"))) / HOUR_US
    found = pairs.filter(F.col("alert_start") < F.col("start")).groupBy(*ids).agg(F.count(F.lit(1)).alias("n_alerts"), F.max("p").alias("best_p"), F.max(lead).alias("lead_hours"))
    return events.join(found, list(ids), "left").withColumn("n_alerts", F.coalesce("n_alerts", F.lit(0).cast("long")))


def provider_status(enabled: Column, success: Column, failure: Column, error: Column, now: Column, most_hours: float) -> Column:
    """disabled, error (unless a success came after it), unknown (never a success), stale or fresh."""
    failing = error.isNotNull() & (failure.isNull() | success.isNull() | (failure >= success))
    age = F.greatest(F.lit(0.0), (micros(now) - micros(success)) / HOUR_US)
    return F.when(~enabled, "disabled").when(failing, "error").when(success.isNull(), "unknown").when(age > most_hours, "stale").otherwise("fresh")


def group_status(providers: DataFrame, keys: Sequence[str], enabled: str, status: str, required: str) -> DataFrame:
    """One status for each group of providers: the worst that a required one causes, else the best reading of the enabled ones."""
    on = F.col(enabled)
    some = {s: F.count_if(on & (F.col(status) == s)) for s in ("fresh", "degraded", "error", "stale", "unknown")}
    counts = providers.groupBy(*keys).agg(F.count_if(F.col(required) & ~on).alias("missing"), F.count_if(on).alias("n"), *[c.alias(s) for s, c in some.items()])
    out = F.when(F.col("missing") > 0, "unavailable").when((F.col("n") > 0) & (F.col("fresh") == F.col("n")), "fresh").when((F.col("fresh") > 0) | (F.col("degraded") > 0), "degraded")
    for s in ("error", "stale", "unknown"):
        out = out.when(F.col(s) > 0, s)
    return counts.select(*keys, out.otherwise("disabled").alias("status"))


def waiting_rollup(reports: DataFrame, keys: Sequence[str], provider: str, now: Column) -> DataFrame:
    """Of the latest report of each provider (observed_at, candidates, first_at, recheck_at): sums and extremes of each group."""
    last = reports.groupBy(*keys, provider).agg(F.max(F.struct("observed_at", "candidates", "first_at", "recheck_at")).alias("r"))
    return last.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_providers"), F.sum("r.candidates").alias("candidates"), F.min("r.first_at").alias("first_at"), F.min("r.recheck_at").alias("recheck_at"), F.max("r.observed_at").alias("observed_at"), (F.min("r.recheck_at") <= now).alias("recheck_due"))
