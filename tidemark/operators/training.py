"""Training rows, walk-forward folds and the scoring of issued forecasts, all as known at the time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.math import clamp
from tidemark.functions.time import HOUR_US, exposure, floor_hour, from_micros, hours_between, micros, week_start
from tidemark.operators.intervals import asof_join, overlap_join, overlapping_hours

DAY_US = 24 * HOUR_US


def covered_slots(merged: DataFrame, keys: Sequence[str], cutoff: Column, most_days: int) -> DataFrame:
    """slot, the start of each full hour that one merged interval (start, end) covers, in the ``most_days`` before the cutoff."""
    low = F.greatest(micros(F.col("start")), micros(cutoff) - most_days * DAY_US)
    high = F.least(micros(F.col("end")), micros(cutoff))
    first, last = F.ceil(low / HOUR_US), F.floor(high / HOUR_US) - 1
    hours = F.when(first <= last, F.sequence(first, last))
    return merged.select(*keys, F.explode(hours).alias("__h")).select(*keys, from_micros(F.col("__h") * HOUR_US).alias("slot"))


def hourly_decay(evidence: DataFrame, keys: Sequence[str], time: str, half_life: float, hours: int) -> DataFrame:
    """decayed: for each full hour (slot) within ``hours`` of evidence, the sum of 2 ** (-age / half_life) of what came before it.

    Decay is linear, so that evidence is summed up by hour first; each hour's sum then reaches the
    slots after it, whose number does not depend on how much evidence there is.
    """
    ahead = F.lit(HOUR_US) - F.pmod(micros(F.col(time)), F.lit(HOUR_US))
    weight = F.pow(F.lit(2.0), -ahead / F.lit(float(HOUR_US)) / half_life)
    sums = evidence.groupBy(*keys, floor_hour(F.col(time)).alias("__hour")).agg(F.sum(weight).alias("__sum"))
    later = sums.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(hours))))
    slot = from_micros(micros(F.col("__hour")) + F.col("__k") * HOUR_US).alias("slot")
    share = F.pow(F.lit(2.0), -(F.col("__k") - 1) / F.lit(float(half_life)))
    return later.groupBy(*keys, slot).agg(F.sum(F.col("__sum") * share).alias("decayed"))


def training_rows(slots: DataFrame, outcomes: DataFrame, keys: Sequence[str], outcome_id: str, features: DataFrame, names: Sequence[str], own: DataFrame) -> DataFrame:
    """Rows of an interval-censored fit: kind (negative or event), slot, outcome, exposure and features.

    An outcome (from_, to, ambiguous) becomes one row for each hour it touches, weighed by the
    share of the hour that it covers.  Hours that any outcome touches are no negatives; ambiguous
    outcomes only censor.  ``features`` has ``names`` by key and slot, 0 where there is no row.
    ``own`` has, by outcome and slot, what of each feature came from the outcome's own source;
    it is taken off, so that what confirmed an event can't predict it.
    """
    touched = overlapping_hours(outcomes, "from_", "to")
    busy = touched.select(*keys, "slot").distinct()
    quiet = slots.join(busy, [*keys, "slot"], "left_anti").select(*keys, "slot", F.lit("negative").alias("kind"), F.lit(None).cast(outcomes.schema[outcome_id].dataType).alias(outcome_id), F.lit(1.0).alias("exposure"))
    share = exposure(F.col("slot"), F.col("slot") + F.expr("interval 1 hour"), F.col("from_"), F.col("to"))
    events = touched.filter(~F.col("ambiguous")).select(*keys, "slot", F.lit("event").alias("kind"), outcome_id, share.alias("exposure")).filter("exposure > 0")
    with_own = own.select(outcome_id, "slot", *[F.col(n).alias(f"__own_{n}") for n in names])
    rows = quiet.unionByName(events).join(features.select(*keys, "slot", *names), [*keys, "slot"], "left").join(with_own, [outcome_id, "slot"], "left")
    values = [(F.coalesce(n, F.lit(0.0)) - F.coalesce(f"__own_{n}", F.lit(0.0))).alias(n) for n in names]
    return rows.select(*keys, "slot", "kind", outcome_id, "exposure", *values)


def folds(anchors: DataFrame, keys: Sequence[str], anchor: str, burn_in_days: int, fold_days: int = 7, window_hours: int = 4) -> DataFrame:
    """``anchors`` with fold (from 0) and origin: consecutive folds after the burn-in of each key.

    An anchor whose window leaves its fold belongs to none and falls away.
    """
    first = anchors.groupBy(*keys).agg(floor_hour(F.min(anchor)).alias("__first"))
    rows = anchors.crossJoin(F.broadcast(first)) if not keys else anchors.join(first, list(keys))
    begin = micros(F.col("__first")) + burn_in_days * DAY_US
    number = F.floor((micros(F.col(anchor)) - begin) / (fold_days * DAY_US))
    rows = rows.withColumn("fold", number.cast("int")).withColumn("origin", from_micros(begin + number * fold_days * DAY_US))
    inside = micros(F.col(anchor)) + window_hours * HOUR_US <= micros(F.col("origin")) + fold_days * DAY_US
    return rows.filter((F.col("fold") >= 0) & inside).drop("__first")


def refit_rates(history: DataFrame, tests: DataFrame, keys: Sequence[str], cell: str, time: str, label: str, window_hours: int = 4, prior: float = 1.0, prior_rate: float = 0.05) -> DataFrame:
    """``tests`` (with fold and origin) with p and baseline, refitted for each fold on what had settled by its origin.

    p is the smoothed rate of the row's cell, baseline that of all cells.  ``history`` has key,
    cell, time and label; a row settles ``window_hours`` after its time.  Rates of all folds come
    from one pass: rows are summed up by the fold after which they count, then added up.
    """
    origins = tests.select(*keys, "fold", "origin").distinct()
    settled = from_micros(micros(F.col(time)) + window_hours * HOUR_US)
    cells = history.select(*keys, cell).distinct()
    by_time = history.groupBy(*keys, cell, settled.alias("__at")).agg(F.sum(label).alias("__y"), F.count(F.lit(1)).alias("__n"))
    so_far = Window.partitionBy(*keys, cell).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    running = by_time.select(*keys, cell, "__at", F.sum("__y").over(so_far).alias("__y"), F.sum("__n").over(so_far).alias("__n"))
    grid = asof_join(origins.join(cells, list(keys)), running, [*keys, cell], "origin", "__at", ["__y", "__n"], strict=False)
    grid = grid.withColumns({"__y": F.coalesce("__y", F.lit(0)), "__n": F.coalesce("__n", F.lit(0))})
    whole = Window.partitionBy(*keys, "fold")
    all_y, all_n = F.sum("__y").over(whole), F.sum("__n").over(whole)
    base = (all_y + prior * prior_rate) / (all_n + prior)
    rates = grid.withColumn("baseline", base).withColumn("p", (F.col("__y") + prior * F.col("baseline")) / (F.col("__n") + prior))
    return tests.join(rates.select(*keys, "fold", cell, "p", "baseline"), [*keys, "fold", cell])


def paired_scores(rows: DataFrame, keys: Sequence[str], p: str, baseline: str, label: str) -> DataFrame:
    """n, events, Brier scores of forecast and baseline, skill, log loss and mean paired improvement by key."""
    se, base = F.pow(F.col(p) - F.col(label), F.lit(2.0)), F.pow(F.col(baseline) - F.col(label), F.lit(2.0))
    q = clamp(F.col(p), 1e-12, 1 - 1e-12)
    loss = -F.when(F.col(label) == 1, F.log(q)).otherwise(F.log1p(-q))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("events"), F.avg(se).alias("brier"), F.avg(base).alias("baseline_brier"), F.avg(loss).alias("log_loss"), F.avg(base - se).alias("improvement"))
    return out.withColumn("brier_skill", F.when(F.col("baseline_brier") > 0, 1 - F.col("brier") / F.col("baseline_brier")))


def fold_dispositions(anchors: DataFrame, keys: Sequence[str], covered: str) -> DataFrame:
    """required and covered anchors of each fold, their share, and status: eligible only where every anchor is covered."""
    out = anchors.groupBy(*keys, "fold").agg(F.count(F.lit(1)).alias("required"), F.count_if(F.col(covered)).alias("covered"))
    return out.withColumns({"fraction": F.col("covered") / F.col("required"), "status": F.when(F.col("covered") == F.col("required"), "eligible").otherwise("rejected")})


def disposition_summary(dispositions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of folds, of rejected ones, a hash of all dispositions in order, and passed: none was rejected."""
    line = F.concat_ws(":", F.col("fold").cast("string"), "status", F.col("covered").cast("string"), F.col("required").cast("string"))
    lines = F.array_sort(F.collect_list(F.struct("fold", line.alias("line"))))  # one entry a fold
    out = dispositions.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), 256)).alias("disposition_hash"))
    return out.withColumn("passed", F.col("rejected") == 0)


def baselines_as_of(rows: DataFrame, outcomes: DataFrame, merged: DataFrame, keys: Sequence[str], cutoff: str, days: int, window_hours: int = 4) -> DataFrame:
    """``rows`` with outcomes (known by the cutoff, in the ``days`` before it), hours (covered then) and baseline.

    ``outcomes`` has known_at, ``merged`` start and end of covered time.  Both counts come from
    running sums read at the window's two ends, so that no row meets more than four others.
    """
    ordered = Window.partitionBy(*keys)
    known = outcomes.groupBy(*keys, "known_at").agg(F.count(F.lit(1)).alias("__n"))
    known = known.select(*keys, "known_at", F.sum("__n").over(ordered.orderBy("known_at").rowsBetween(Window.unboundedPreceding, 0)).alias("__seen"))
    spans = merged.select(*keys, "start", "end", F.coalesce(F.sum(hours_between(F.col("end"), F.col("start"))).over(ordered.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__before"))
    spans = spans.withColumnsRenamed({"start": "__start", "end": "__end"})
    rows = rows.withColumn("__low", from_micros(micros(F.col(cutoff)) - days * DAY_US))
    out = rows
    for side, at in (("hi", cutoff), ("lo", "__low")):
        out = asof_join(out, known, keys, at, "known_at", ["__seen"], strict=False).withColumnRenamed("__seen", f"__seen_{side}")
        out = asof_join(out, spans.withColumn("__from", F.col("__start")), keys, at, "__from", ["__start", "__end", "__before"], strict=False)
        clipped = F.greatest(F.lit(0.0), hours_between(F.least("__end", at), F.col("__start")))
        out = out.withColumn(f"__hours_{side}", F.coalesce(F.col("__before") + clipped, F.lit(0.0))).drop("__start", "__end", "__before")
    seen = F.coalesce("__seen_hi", F.lit(0)) - F.coalesce("__seen_lo", F.lit(0))
    hours = F.col("__hours_hi") - F.col("__hours_lo")
    rate = clamp(F.when(hours > 0, seen / hours).otherwise(0.0), 1e-6, 0.25)
    kept = [F.col(c) for c in rows.columns if c != "__low"]
    return out.select(*kept, seen.alias("outcomes"), hours.alias("hours"), (1 - F.pow(1 - rate, F.lit(float(window_hours)))).alias("baseline"))


def event_scores(events: DataFrame, rows: DataFrame, alerts: DataFrame, keys: Sequence[str], event_id: str, bin_hours: float = 6.0) -> DataFrame:
    """For each event (start, end): hit, lead, highest prior window and the week's alert peak before it.

    ``rows`` and ``alerts`` have window_start, window_end and p; a window counts that began before
    the event and overlaps it.  The peak is the most probable alert of the event's week that began
    before it, whether it overlaps or not; peak_error is the distance of its middle from the event.
    """
    own = events.select(*dict.fromkeys([*keys, event_id, "start", "end"]))
    before = F.col("window_start") < F.col("start")
    best = F.max_by(F.struct("p", "window_start"), F.struct("p", -micros(F.col("window_start"))))
    met = overlap_join(own, rows.select(*keys, "window_start", "window_end", "p"), keys, ("start", "end"), ("window_start", "window_end"), bin_hours)
    prior = met.filter(before).groupBy(event_id).agg(best.alias("__prior"))
    hits = overlap_join(own, alerts.select(*keys, "window_start", "window_end", "p"), keys, ("start", "end"), ("window_start", "window_end"), bin_hours)
    lead = F.max(hours_between(F.col("start"), F.col("window_start")))
    hit = hits.filter(before).groupBy(event_id).agg(lead.alias("lead_hours"))
    # alerts of a week are few: their number is a budget
    weekly = alerts.select(*keys, week_start(F.col("window_start")).alias("__week"), "window_start", "window_end", "p")
    peak = own.withColumn("__week", week_start(F.col("start"))).join(weekly, [*keys, "__week"]).filter(before)
    peak = peak.groupBy(event_id).agg(F.max_by(F.struct("p", "window_start", "window_end"), F.struct("p", -micros(F.col("window_start")))).alias("__peak"))
    middle = (micros(F.col("__peak.window_start")) + micros(F.col("__peak.window_end"))) / 2
    out = events.join(prior, event_id, "left").join(hit, event_id, "left").join(peak, event_id, "left")
    error = F.abs(middle - micros(F.col("start"))) / HOUR_US
    return out.select(*events.columns, F.col("lead_hours").isNotNull().alias("hit"), "lead_hours", F.coalesce("__prior.p", F.lit(0.0)).alias("highest_prior"), F.col("__prior.window_start").alias("prior_start"), F.col("__peak.p").alias("peak_p"), error.alias("peak_error"))


def promotion_reasons(row: Mapping[str, Column], tolerance: float = 1e-12, least_rows: int = 1008, least_events: int = 20, most_ece: float = 0.10, least_recall: float = 0.8) -> Column:
    """Why a challenger (n, events, brier, champion_brier, brier_skill, ece, recall) may not replace the champion; empty: it may."""
    from tidemark.operators.coverage import reasons

    return reasons(
        {
            "sample_too_small": (row["n"] < least_rows) | (row["events"] < least_events),
            "no_skill": ~F.coalesce(row["brier_skill"] > 0, F.lit(False)),
            "badly_calibrated": row["ece"] > most_ece,
            "recall_too_low": ~F.coalesce(row["recall"] >= least_recall, F.lit(False)),
            "worse_than_champion": row["brier"] > row["champion_brier"] + tolerance,
        }
    )


def live_guard(slots: DataFrame, keys: Sequence[str], hour: str, hazard: str, baseline: str, limits: Mapping[int, float], surge: float) -> DataFrame:
    """Cumulative probabilities of a forecast at the hours of ``limits``, and the limits it breaks.

    violations: cumulative_N above the limit for N hours; surge_N where it is more than ``surge``
    times the baseline's.  Hazards of 1 count as certain.
    """
    order = Window.partitionBy(*keys).orderBy(hour)
    ranked = slots.withColumn("__k", F.row_number().over(order))
    logs = {name: F.when(F.col(c) < 1, F.log1p(-F.col(c))).otherwise(F.lit(-1e9)) for name, c in (("f", hazard), ("b", baseline))}
    sums = [F.sum(F.when(F.col("__k") <= n, logs[name])).alias(f"__{name}{n}") for n in limits for name in ("f", "b")]
    out = ranked.groupBy(*keys).agg(*sums)
    tests = []
    for n, most in limits.items():
        p, q = -F.expm1(F.col(f"__f{n}")), -F.expm1(F.col(f"__b{n}"))
        tests += [F.when(p > most, F.lit(f"cumulative_{n}")), F.when(p > surge * q, F.lit(f"surge_{n}"))]
    return out.select(*keys, *[(-F.expm1(F.col(f"__f{n}"))).alias(f"cumulative_{n}") for n in limits], F.array_compact(F.array(*tests)).alias("violations"))
