"""Queries over hourly hazards, probabilities and ordered events, with their oracles.

An event's probability is (event_id * 37 mod 1000) / 1000 and its label is "it is a purchase";
an hour's hazard is c / (c + 10) for its c errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import math as mt
from tidemark.functions import time as tm
from tidemark.operators import hazard, intervals, metrics, revisions, sequences
from tidemark.session import table


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", "event_type", "value", (F.col("event_id") * 37 % 1000 / F.lit(1000.0)).alias("p"), (F.col("event_type") == "purchase").cast("int").alias("y"))


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hour from the first to the last event: hour, errors, hazard."""
    e = table(spark, sf_dir, "events")
    counts = e.filter("event_type = 'error'").groupBy(tm.floor_hour(F.col("ts")).alias("hour")).agg(F.count(F.lit(1)).alias("errors"))
    span = e.agg(tm.floor_hour(F.min("ts")).alias("a"), tm.floor_hour(F.max("ts")).alias("b"))
    grid = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("hour"))
    c = F.coalesce("errors", F.lit(0))
    return grid.join(counts, "hour", "left").select("hour", c.alias("errors"), (c / (c + F.lit(10.0))).alias("hazard"))


ROWS = "e AS (SELECT event_id, ts, user_id, event_type, value, CAST(event_id * 37 % 1000 AS DOUBLE) / 1000 AS p, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y FROM events)"
HOURS = """c AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT date_trunc('hour', min(ts)) FROM events), (SELECT date_trunc('hour', max(ts)) FROM events), INTERVAL 1 HOUR)) AS hour),
h AS (SELECT g.hour, coalesce(n, 0) AS errors, coalesce(n, 0) / CAST(coalesce(n, 0) + 10 AS DOUBLE) AS hazard FROM g LEFT JOIN c ON g.hour = c.hour)"""


def r6(c: str | Column, name: str | None = None) -> Column:
    # adding zero makes -0.0 and 0.0 one value
    return (F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0).alias(name or c)


def daily_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hours(spark, sf_dir).withColumn("day", tm.day_key(F.col("hour")))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hour, p (four-hour-ahead probability), y (a purchase of 200 or more within four hours)."""
    ahead = Window.orderBy("hour").rowsBetween(0, 3)  # hours of the data's span: one row for each
    curve = hours(spark, sf_dir).withColumn("p", F.when(F.count("hazard").over(ahead) == 4, 1 - F.product(1 - F.col("hazard")).over(ahead))).filter("p is not null")
    big = table(spark, sf_dir, "events").filter("event_type = 'purchase' and value >= 200")
    # an event at t makes the anchors in (t - 4 h, t] positive: at most four full hours
    hit = big.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: tm.from_micros(tm.micros(tm.floor_hour(F.col("ts"))) - k * tm.HOUR_US))).alias("hour")).distinct()
    return curve.join(hit.withColumn("y", F.lit(1)), "hour", "left").select("hour", "p", F.coalesce("y", F.lit(0)).alias("y"))


ANCHORS = f"""{HOURS}, w AS (SELECT hour, 1 - product(1 - hazard) OVER x AS p, count(*) OVER x AS k FROM h WINDOW x AS (ORDER BY hour ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
a AS (SELECT hour, p, CASE WHEN EXISTS (SELECT 1 FROM events WHERE event_type = 'purchase' AND value >= 200 AND ts >= hour AND ts < hour + INTERVAL 4 HOUR) THEN 1 ELSE 0 END AS y FROM w WHERE k = 4)"""


def calibration_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten reliability bins of the four-hour-ahead forecast, with each bin's Brier score."""
    a = anchors(spark, sf_dir).withColumn("se", F.pow(F.col("p") - F.col("y"), F.lit(2.0)))
    bins = metrics.reliability(a, "p", "y", metrics.bin_by_edges(F.col("p")), extra={"brier": F.avg("se")})
    return bins.select("bin", "n", r6("mean_probability"), r6("observed_rate"), r6("brier"))


def survival_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hazard.survival_curve(daily_hours(spark, sf_dir), ["day"], "hour")
    return out.select("hour", r6("survival"), r6("first_probability"), r6("by_end_probability"), r6("rolling_probability"))


def log_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hazard.log_cumulative(daily_hours(spark, sf_dir), ["day"], "hour").select("hour", r6("cumulative"))


def first_event_mass_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    mass = hazard.no_event_mass(hazard.first_event_mass(daily_hours(spark, sf_dir), ["day"], "hour"), ["day"])
    return hazard.hazards_of_mass(mass.drop("hazard"), ["day"], "hour", no_event="no_event").select("hour", r6("mass"), r6("hazard"))


def refractory_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = daily_hours(spark, sf_dir)
    # of each hour only the last purchase can be the last one before a full hour, so that the carry sees one row an hour
    bought = table(spark, sf_dir, "events").filter("event_type = 'purchase' and value >= 200").groupBy(tm.floor_hour(F.col("ts"))).agg(F.max("ts").alias("at")).select("at")
    out = intervals.asof_join(h, bought, [], "hour", "at", ["at"], bucket="day")
    factor = hazard.refractory(tm.hours_between(F.col("hour"), F.col("at")))
    return out.select("hour", r6(factor, "factor"), r6(F.col("hazard") * factor, "hazard_after"))


def authority_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = daily_hours(spark, sf_dir)
    share = tm.exposure(F.col("hour"), F.col("hour") + F.expr("interval 1 hour"), F.date_trunc("day", "hour") + F.expr("interval 6 hours 30 minutes"), F.date_trunc("day", "hour") + F.expr("interval 11 hours"))
    return hazard.authority_mixture(h, ["day"], "hour", share, 0.6).select("hour", r6("hazard_mixed"))


def settlement_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each hourly four-hour window: pending, positive, then negative only where covered, else censored."""
    h = hours(spark, sf_dir).select("hour", (F.col("hour") + F.expr("interval 4 hours")).alias("until"), F.lit(1).alias("all"))
    big = table(spark, sf_dir, "events").filter("event_type = 'purchase' and value >= 200").select(F.lit(1).alias("all"), F.col("ts").alias("at"), (F.col("ts") + F.expr("interval 1 microsecond")).alias("at_end"))
    hit = intervals.overlap_join(h, big, ["all"], ("hour", "until"), ("at", "at_end"), 4).select("hour").distinct().withColumn("hit", F.lit(True))
    seen = table(spark, sf_dir, "events").filter("event_type = 'view'").select(F.lit(1).alias("all"), F.col("ts").alias("s"), (F.col("ts") + F.expr("interval 30 minutes")).alias("e"))
    merged = intervals.merge_intervals(seen, ["all"], "s", "e").select("all", F.col("s").alias("ms"), F.col("e").alias("me"))
    covered = intervals.contained(h, merged, ["all"], ("hour", "until"), ("ms", "me"), bucket="day").select("hour").withColumn("covered", F.lit(True))
    cutoff = F.lit("2024-01-29").cast("timestamp_ntz")
    status = F.when(F.col("until") > cutoff, "pending").when(F.col("hit"), "positive").when(F.col("covered"), "negative").otherwise("censored")
    return h.join(hit, "hour", "left").join(covered, "hour", "left").select("hour", status.alias("status"))


def reliability_bins_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.reliability(rows(spark, sf_dir), "p", "y", metrics.bin_by_edges(F.col("p"))).select("bin", "n", r6("mean_probability"), r6("observed_rate"))


def reliability_bins_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.reliability(rows(spark, sf_dir), "p", "y", metrics.bin_by_floor(F.col("p"))).select("bin", "n", r6("mean_probability"), r6("observed_rate"))


def brier_logloss_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = rows(spark, sf_dir).withColumn("b", F.lit(0.2)).withColumn("flagged", F.col("p") >= 0.5)
    out = metrics.sample_gate(metrics.scores(base, "p", "y", "b", hit="flagged"))
    return out.select("n", "events", *[r6(c) for c in ("brier", "baseline_brier", "brier_skill", "log_loss", "ece", "recall")], "sample_sufficient")


def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(rows(spark, sf_dir), "p", "y", "event_id").select("positives", r6("average_precision"))


def platt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = metrics.platt_fit(rows(spark, sf_dir), "p", "y")
    return spark.createDataFrame([(round(a, 6), round(b, 6))], "intercept double, slope double")


def wilson_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir).withColumn("hit", (F.col("value") >= 50).cast("int"))
    return metrics.wilson_rates(r, ["event_type"], "hit").select("event_type", "n", "hits", r6("low"), r6("high"))


def histogram20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(rows(spark, sf_dir), "p", "y").select("bin", "n", "events", r6("density"), r6("event_rate"))


def distribution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.distribution_summary(rows(spark, sf_dir).withColumn("q", F.col("p") * 0.1 + 0.3), "q")
    return out.select("n", r6("mean"), r6("deviation"), r6("minimum"), r6("maximum"), "low_percent", "high_percent", "threshold_percent")


def quantile_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bandwidth(rows(spark, sf_dir), "p").select("n", r6("q25"), r6("q75"), r6("bandwidth"))


def kernel_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.density(rows(spark, sf_dir), "p").select("i", r6("density"))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.threshold_sweep(rows(spark, sf_dir), "p", "y", "user_id")
    return out.select("threshold_percent", "alerts", "hits", "events_hit", r6("precision"))


def threshold_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.compact_points(metrics.threshold_sweep(rows(spark, sf_dir), "p", "y"), 500)
    return out.select("threshold_percent", "alerts", r6("precision"), r6("low"), r6("high"))


def alerts_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.alerts_by_month(rows(spark, sf_dir), "ts", "p", "y", 0.8)


def weighted_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("double").alias("x"), F.col("l_discount").cast("double").alias("y"), F.col("l_quantity").cast("double").alias("w"))
    return metrics.weighted_correlation(lines, "x", "y", "w").select(r6("correlation"))


def standardise_and_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic score of each order's lines from winsorised z-scores of two columns."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("x"))
    s = metrics.standardisation(lines, ["q", "x"]).agg(*[F.max(F.when(F.col("feature") == c, F.col(v))).alias(f"{v}_{c}") for c in ("q", "x") for v in ("mean", "scale")])  # a single row
    z = [mt.winsorised(F.col(c), F.col(f"mean_{c}"), F.col(f"scale_{c}")) for c in ("q", "x")]
    score = mt.sigmoid(F.lit(-1.0) + 0.5 * z[0] + 0.25 * z[1])
    return lines.crossJoin(F.broadcast(s)).groupBy("l_orderkey").agg(F.round(F.avg(score), 6).alias("score"))


def top_per_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.top_per_week(rows(spark, sf_dir), "ts", "p", 36, "event_id").select("event_id", "week", "rank")


def latest_per_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir).withColumn("anchor", tm.floor_hour(F.col("ts")))
    return sequences.latest_per_anchor(r, ["anchor"], "ts", "event_id").select("anchor", "event_id", "excluded")


def rank_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.ranked(rows(spark, sf_dir), "p", "event_id", {})
    return out.filter("y = 1").select("event_id", F.col("rank").cast("long").alias("rank"))


def peak_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = hazard.survival_curve(daily_hours(spark, sf_dir), ["day"], "hour").withColumn("rolling", F.round("rolling_probability", 9))
    return sequences.peak_window(curve, ["day"], "rolling", "hour").select("day", "peak_start", r6("peak_value"))


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.keyset_page(rows(spark, sf_dir), "event_id", 500, 100, F.col("event_type") == "error").select("event_id", "next_after")


def non_overlapping_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequences.non_overlapping(rows(spark, sf_dir).select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id", 4)
    return out.select("user_id", "event_id", "chosen")


def gap_span_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequences.gap_span_clusters(rows(spark, sf_dir).select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id", 3, 6)
    return out.groupBy("user_id", "cluster_start").agg(F.count(F.lit(1)).alias("n"))


def session_gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequences.gap_sessions(rows(spark, sf_dir), ["user_id"], "ts", "event_id", 2)
    return out.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"))


def lifecycle_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = F.when(F.col("event_type") == "signup", "resolved").when(F.col("event_type") == "click", "mitigated").otherwise("active")
    out = sequences.lifecycle(rows(spark, sf_dir).withColumn("phase", phase), ["user_id"], "ts", "event_id", "phase")
    return out.groupBy("user_id", "state").agg(F.count(F.lit(1)).alias("n"), F.max("spell").alias("spell"))


def change_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequences.flips(rows(spark, sf_dir).withColumn("unhealthy", F.col("event_type") == "error"), ["user_id"], "ts", "event_id", "unhealthy")
    return out.select("event_id", "unhealthy")


def streak_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opened, escalated and recovered capacity incidents from hourly error counts."""
    h = daily_hours(spark, sf_dir)
    bad = sequences.streaks(h, ["day"], "hour", F.col("errors") >= 3, "strained")
    both = sequences.streaks(bad, ["day"], "hour", F.col("errors") < 3, "healthy")
    return sequences.capacity_states(both, ["day"], "hour", "strained", "healthy").select("hour", "event")


def dod_median7(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = rows(spark, sf_dir).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return sequences.day_over_day(daily, ["event_type"], "day", "n").select("event_type", "day", "n", "previous", "median7")


def gap_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = tm.hours_between(F.col("ts"), F.lag("ts").over(w))
    return rows(spark, sf_dir).filter("y = 1").select("event_id", r6(gap, "gap_hours"))


def exposure_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rate of large purchases per covered hour of each user, clamped, over a four-hour window."""
    cover = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("s"), (F.col("ts") + F.expr("interval 6 hours")).alias("e"))
    merged = intervals.merge_intervals(cover, ["user_id"], "s", "e")
    exposed = merged.groupBy("user_id").agg(F.sum(tm.hours_between(F.col("e"), F.col("s"))).alias("hours"))
    found = rows(spark, sf_dir).groupBy("user_id").agg(F.sum(((F.col("y") == 1) & (F.col("value") >= 100)).cast("int")).alias("outcomes"))
    rate = mt.clamp(F.col("outcomes") / F.col("hours"), 1e-6, 0.25)
    return exposed.join(found, "user_id").select("user_id", "outcomes", r6("hours"), r6(1 - F.pow(1 - rate, F.lit(4.0)), "baseline"))


def hour_of_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir).withColumn("slot", tm.hour_of_week(F.col("ts")))
    distance = F.round(F.avg(tm.circular_distance(F.col("slot"), F.lit(12), 168)), 6).alias("distance")
    return r.groupBy(tm.week_start(F.col("ts")).alias("week"), (F.col("slot") % 24).alias("hour")).agg(F.count(F.lit(1)).alias("n"), distance)


def decayed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user at one cutoff: decayed sum of errors (half-life 24 h), decayed maximum of views (36 h), 14 days at most."""
    cutoff = F.lit("2024-01-20").cast("timestamp_ntz")
    r = rows(spark, sf_dir).withColumn("age", tm.hours_between(cutoff, F.col("ts"))).filter("age >= 0 and age <= 336")
    incident = F.sum(F.when(F.col("event_type") == "error", tm.decay(F.col("age"), 24)))
    rival = F.max(F.when(F.col("event_type") == "view", tm.decay(F.col("age"), 36)))
    return r.groupBy("user_id").agg(F.round(F.coalesce(incident, F.lit(0.0)), 6).alias("incident"), F.round(F.coalesce(rival, F.lit(0.0)), 6).alias("competitor"))


def current_signal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current row by a dotted version, in which 10 comes after 9."""
    r = rows(spark, sf_dir).select("user_id", "event_id", F.concat_ws(".", F.lit("1"), (F.col("event_id") % 12).cast("string"), (F.col("event_id") % 5).cast("string")).alias("version"))
    out = revisions.latest_by(r, ["user_id"], [revisions.version_key(F.col("version")), "event_id"])
    return out.select("user_id", "event_id", "version")


QUERIES = {f.__name__: f for f in (calibration_flagship, survival_curve, log_cumulative, first_event_mass_roundtrip, refractory_multiplier, authority_mixture, settlement_labels, reliability_bins_edge, reliability_bins_floor, brier_logloss_ece, average_precision, platt_fit, wilson_by_type, histogram20, distribution_summary, quantile_bandwidth, kernel_density, threshold_sweep, threshold_points, alerts_by_month, weighted_corr, standardise_and_score, top_per_week, latest_per_anchor, rank_lookup, peak_window, keyset_page, non_overlapping_greedy, gap_span_clusters, session_gap_clusters, lifecycle_state, change_flips, streak_events, dod_median7, gap_list, exposure_baseline, hour_of_week, decayed_evidence, current_signal_order)}

_DAY = "PARTITION BY CAST(hour AS DATE) ORDER BY hour"
_EDGE = "CASE WHEN p < 0.1::DOUBLE THEN 0 WHEN p < 0.2::DOUBLE THEN 1 WHEN p < CAST(0.3 AS DOUBLE) THEN 2 WHEN p < 0.4::DOUBLE THEN 3 WHEN p < 0.5::DOUBLE THEN 4 WHEN p < 0.6::DOUBLE THEN 5 WHEN p < 0.7::DOUBLE THEN 6 WHEN p < 0.8::DOUBLE THEN 7 WHEN p < 0.9::DOUBLE THEN 8 ELSE 9 END"
_WILSON = "CASE WHEN {n} > 0 AND {k} = 0 THEN 0.0 WHEN {n} > 0 THEN greatest(0.0, (({k} / {n}::DOUBLE) + 3.841458820694124 / (2 * {n}) - 1.959963984540054 * sqrt(({k} / {n}::DOUBLE) * (1 - {k} / {n}::DOUBLE) / {n} + 3.841458820694124 / (4.0 * {n} * {n}))) / (1 + 3.841458820694124 / {n})) END"
_WILSON_HIGH = "CASE WHEN {n} > 0 AND {k} = {n} THEN 1.0 WHEN {n} > 0 THEN least(1.0, (({k} / {n}::DOUBLE) + 3.841458820694124 / (2 * {n}) + 1.959963984540054 * sqrt(({k} / {n}::DOUBLE) * (1 - {k} / {n}::DOUBLE) / {n} + 3.841458820694124 / (4.0 * {n} * {n}))) / (1 + 3.841458820694124 / {n})) END"
_SWEEP = "t AS (SELECT CAST(i AS INTEGER) AS k, i / 100.0::DOUBLE AS x FROM range(101) r(i)), s AS (SELECT k AS threshold_percent, count(event_id) AS alerts, CAST(coalesce(sum(y), 0) AS BIGINT) AS hits, count(DISTINCT user_id) AS events_hit FROM t LEFT JOIN e ON p > x GROUP BY k)"
_SESSIONS = "x AS (SELECT *, CASE WHEN lag(ts) OVER v IS NULL OR ts > lag(ts) OVER v + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW v AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM x)"
_ORDERED = "o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"

ORACLES = {
    "calibration_flagship": f"WITH {ANCHORS}, b AS (SELECT {_EDGE} AS bin, count(*) AS n, avg(p) AS m, avg(CAST(y AS DOUBLE)) AS o, avg((p - y) * (p - y)) AS s FROM a GROUP BY 1) SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n, round(m, 6) AS mean_probability, round(o, 6) AS observed_rate, round(s, 6) AS brier FROM range(10) r(i) LEFT JOIN b ON b.bin = i",
    "survival_curve": f"WITH {HOURS}, s AS (SELECT hour, hazard, product(1 - hazard) OVER ({_DAY} ROWS UNBOUNDED PRECEDING) AS survival, coalesce(product(1 - hazard) OVER ({_DAY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS b, product(1 - hazard) OVER ({_DAY} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS r, count(*) OVER ({_DAY} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS k FROM h) SELECT hour, round(survival, 6) AS survival, round(b * hazard, 6) AS first_probability, round(1 - survival, 6) AS by_end_probability, CASE WHEN k = 4 THEN round(1 - r, 6) END AS rolling_probability FROM s",
    "log_cumulative": f"WITH {HOURS} SELECT hour, round(1 - product(1 - hazard) OVER ({_DAY} ROWS UNBOUNDED PRECEDING), 6) AS cumulative FROM h",
    "first_event_mass_roundtrip": f"WITH {HOURS} SELECT hour, round(coalesce(product(1 - hazard) OVER ({_DAY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) * hazard, 6) AS mass, round(hazard, 6) AS hazard FROM h",
    "refractory_multiplier": f"WITH {HOURS}, l AS (SELECT hour, hazard, (SELECT max(ts) FROM events WHERE event_type = 'purchase' AND value >= 200 AND ts < hour) AS t FROM h), m AS (SELECT hour, hazard, (epoch_us(hour) - epoch_us(t)) / 3.6e9 AS x FROM l), f AS (SELECT *, CASE WHEN x IS NULL THEN 1.0 WHEN x <= 24 THEN x * 0.25 / 24 WHEN x <= 72 THEN 0.25 + (x - 24) * 0.5 / 48 WHEN x <= 168 THEN 0.75 + (x - 72) * 0.25 / 96 ELSE 1.0 END AS f FROM m) SELECT hour, round(f, 6) AS factor, round(hazard * f, 6) AS hazard_after FROM f",
    "authority_mixture": f"WITH {HOURS}, m AS (SELECT hour, CAST(hour AS DATE) AS d, coalesce(product(1 - hazard) OVER ({_DAY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) * hazard AS mass, greatest(0, least(epoch_us(hour) + 3600000000, epoch_us(date_trunc('day', hour) + INTERVAL 11 HOUR)) - greatest(epoch_us(hour), epoch_us(date_trunc('day', hour) + INTERVAL 390 MINUTE))) / 3.6e9 AS share FROM h), t AS (SELECT *, share * mass AS i, sum(share * mass) OVER (PARTITION BY d) AS si, sum(share) OVER (PARTITION BY d) AS ss FROM m), x AS (SELECT *, CASE WHEN ss > 0 THEN 0.4::DOUBLE * mass + 0.6::DOUBLE * (CASE WHEN si > 0 THEN i / si ELSE share / ss END) ELSE mass END AS q FROM t), z AS (SELECT hour, q, 1 - coalesce(sum(q) OVER ({_DAY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM x) SELECT hour, round(CASE WHEN rest <= 1e-12 THEN 0 ELSE least(1, q / rest) END, 6) AS hazard_mixed FROM z",
    "settlement_labels": f"WITH {HOURS}, v AS (SELECT ts AS s, ts + INTERVAL 30 MINUTE AS e FROM events WHERE event_type = 'view'), m AS (SELECT *, max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM v), i AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m), u AS (SELECT min(s) AS s, max(e) AS e FROM i GROUP BY k) SELECT hour, CASE WHEN hour + INTERVAL 4 HOUR > TIMESTAMP '2024-01-29' THEN 'pending' WHEN EXISTS (SELECT 1 FROM events WHERE event_type = 'purchase' AND value >= 200 AND ts >= hour AND ts < hour + INTERVAL 4 HOUR) THEN 'positive' WHEN EXISTS (SELECT 1 FROM u WHERE u.s <= hour AND u.e >= hour + INTERVAL 4 HOUR) THEN 'negative' ELSE 'censored' END AS status FROM h",
    "reliability_bins_edge": f"WITH {ROWS}, b AS (SELECT {_EDGE} AS bin, count(*) AS n, avg(p) AS m, avg(CAST(y AS DOUBLE)) AS o FROM e GROUP BY 1) SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n, round(m, 6) AS mean_probability, round(o, 6) AS observed_rate FROM range(10) r(i) LEFT JOIN b ON b.bin = i",
    "reliability_bins_floor": f"WITH {ROWS}, b AS (SELECT least(9, CAST(floor(p * 10) AS INTEGER)) AS bin, count(*) AS n, avg(p) AS m, avg(CAST(y AS DOUBLE)) AS o FROM e GROUP BY 1) SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n, round(m, 6) AS mean_probability, round(o, 6) AS observed_rate FROM range(10) r(i) LEFT JOIN b ON b.bin = i",
    "brier_logloss_ece": f"WITH {ROWS}, q AS (SELECT *, greatest(1e-12, least(1 - 1e-12, p)) AS c FROM e), b AS (SELECT abs(sum(p) - sum(y)) AS g FROM e GROUP BY {_EDGE}) SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS events, round(avg((p - y) * (p - y)), 6) AS brier, round(avg((0.2::DOUBLE - y) * (0.2::DOUBLE - y)), 6) AS baseline_brier, round(1 - avg((p - y) * (p - y)) / avg((0.2::DOUBLE - y) * (0.2::DOUBLE - y)), 6) AS brier_skill, round(avg(-(y * ln(c) + (1 - y) * ln(1 - c))), 6) AS log_loss, round((SELECT sum(g) FROM b) / count(*), 6) AS ece, round(count(*) FILTER (WHERE y = 1 AND p >= 0.5) / sum(y)::DOUBLE, 6) AS recall, count(*) >= 1008 AND sum(y) >= 20 AS sample_sufficient FROM q",
    "average_precision": f"WITH {ROWS}, k AS (SELECT y, row_number() OVER v AS r, sum(y) OVER v AS f FROM e WINDOW v AS (ORDER BY p DESC, event_id ROWS UNBOUNDED PRECEDING)) SELECT CAST(sum(y) AS BIGINT) AS positives, round(avg(f / CAST(r AS DOUBLE)) FILTER (WHERE y = 1), 6) AS average_precision FROM k",
    "wilson_by_type": f"WITH g AS (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value >= 50) AS hits FROM events GROUP BY 1) SELECT event_type, n, hits, round({_WILSON.format(n='n', k='hits')}, 6) AS low, round({_WILSON_HIGH.format(n='n', k='hits')}, 6) AS high FROM g",
    "histogram20": f"WITH {ROWS}, b AS (SELECT least(19, CAST(floor(p * 20) AS INTEGER)) AS bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS y FROM e GROUP BY 1) SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n, coalesce(y, 0) AS events, round(coalesce(n, 0) / CAST((SELECT count(*) FROM e) AS DOUBLE) * 20, 6) AS density, round(y / CAST(n AS DOUBLE), 6) AS event_rate FROM range(20) r(i) LEFT JOIN b ON b.bin = i",
    "distribution_summary": f"WITH {ROWS}, s AS (SELECT count(*) AS n, avg(p * 0.1::DOUBLE + 0.3::DOUBLE) AS m, stddev_pop(p * 0.1::DOUBLE + 0.3::DOUBLE) AS d, min(p * 0.1::DOUBLE + 0.3::DOUBLE) AS a, max(p * 0.1::DOUBLE + 0.3::DOUBLE) AS z FROM e), l AS (SELECT *, greatest(0, floor((m - 4 * d) * 100 + 1e-10)) AS lo, least(100, ceil((m + 4 * d) * 100 - 1e-10)) AS hi FROM s), k AS (SELECT *, greatest(0, lo - floor(greatest(0, 5 - (hi - lo)) / 2)) AS lo2 FROM l) SELECT n, round(m, 6) AS mean, round(d, 6) AS deviation, round(a, 6) AS minimum, round(z, 6) AS maximum, CAST(lo2 AS INTEGER) AS low_percent, CAST(least(100, greatest(hi, lo2 + 5)) AS INTEGER) AS high_percent, CAST(least(100, ceil((m + 2 * d) * 100 - 1e-10)) AS INTEGER) AS threshold_percent FROM k",
    "quantile_bandwidth": f"WITH {ROWS}, s AS (SELECT count(*) AS n, stddev_pop(p) AS d, quantile_cont(p, 0.25) AS a, quantile_cont(p, 0.75) AS b FROM e) SELECT n, round(a, 6) AS q25, round(b, 6) AS q75, round(greatest(0.01::DOUBLE, least(0.15::DOUBLE, 0.9 * least(d, (b - a) / 1.34::DOUBLE) * pow(n, -0.2))), 6) AS bandwidth FROM s",
    "kernel_density": f"WITH {ROWS}, s AS (SELECT count(*) AS n, stddev_pop(p) AS d, quantile_cont(p, 0.25) AS a, quantile_cont(p, 0.75) AS b FROM e), w AS (SELECT n, greatest(0.01::DOUBLE, least(0.15::DOUBLE, 0.9 * least(d, (b - a) / 1.34::DOUBLE) * pow(n, -0.2))) AS h FROM s), q AS (SELECT p, count(*) AS k FROM e GROUP BY p) SELECT CAST(i AS INTEGER) AS i, round(sum(k * (exp(-0.5 * pow((i / 100.0::DOUBLE - p) / h, 2)) + exp(-0.5 * pow((i / 100.0::DOUBLE + p) / h, 2)) + exp(-0.5 * pow((i / 100.0::DOUBLE - 2 + p) / h, 2)))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density FROM range(101) r(i), q, w GROUP BY i",
    "threshold_sweep": f"WITH {ROWS}, {_SWEEP} SELECT threshold_percent, alerts, hits, events_hit, round(hits / nullif(alerts, 0)::DOUBLE, 6) AS precision FROM s",
    "threshold_points": f"WITH {ROWS}, {_SWEEP} SELECT threshold_percent, alerts, CASE WHEN alerts >= 500 THEN round(hits / alerts::DOUBLE, 6) END AS precision, CASE WHEN alerts >= 500 THEN round({_WILSON.format(n='alerts', k='hits')}, 6) END AS low, CASE WHEN alerts >= 500 THEN round({_WILSON_HIGH.format(n='alerts', k='hits')}, 6) END AS high FROM s",
    "alerts_by_month": f"WITH {ROWS} SELECT strftime(ts, '%Y-%m') AS month, count(*) FILTER (WHERE p >= 0.8::DOUBLE AND y = 0) AS false_alerts FROM e GROUP BY 1",
    "weighted_corr": "WITH l AS (SELECT CAST(l_extendedprice AS DOUBLE) AS x, CAST(l_discount AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS w FROM lineitem), m AS (SELECT sum(w * x) / sum(w) AS a, sum(w * y) / sum(w) AS b FROM l) SELECT round(sum(w * (x - a) * (y - b)) / sqrt(sum(w * (x - a) * (x - a)) * sum(w * (y - b) * (y - b))), 6) AS correlation FROM l, m",
    "standardise_and_score": "WITH l AS (SELECT l_orderkey, CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem), m AS (SELECT avg(q) AS mq, stddev_pop(q) AS sq, avg(x) AS mx, stddev_pop(x) AS sx FROM l) SELECT l_orderkey, round(avg(1 / (1 + exp(1.0 - 0.5 * greatest(-3, least(3, (q - mq) / sq)) - 0.25 * greatest(-3, least(3, (x - mx) / sx))))), 6) AS score FROM l, m GROUP BY l_orderkey",
    "top_per_week": f"WITH {ROWS}, k AS (SELECT event_id, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, CAST(row_number() OVER (PARTITION BY date_trunc('week', ts) ORDER BY p DESC, ts, event_id) AS INTEGER) AS rank FROM e) SELECT * FROM k WHERE rank <= 36",
    "latest_per_anchor": "SELECT date_trunc('hour', ts) AS anchor, max_by(event_id, (ts, -event_id)) AS event_id, count(*) - 1 AS excluded FROM events GROUP BY 1",
    "rank_lookup": f"WITH {ROWS}, k AS (SELECT event_id, y, row_number() OVER (ORDER BY p DESC, event_id) AS rank FROM e) SELECT event_id, rank FROM k WHERE y = 1",
    "peak_window": f"WITH {HOURS}, s AS (SELECT hour, round(1 - product(1 - hazard) OVER v, 9) AS r, count(*) OVER v AS k FROM h WINDOW v AS ({_DAY} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) SELECT strftime(hour, '%Y-%m-%d') AS day, max_by(hour, (r, -epoch_us(hour))) AS peak_start, round(max(r), 6) AS peak_value FROM s WHERE k = 4 GROUP BY 1",
    "keyset_page": "WITH p AS (SELECT * FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100) SELECT event_id, (SELECT max(event_id) FROM p) AS next_after FROM p WHERE event_type = 'error'",
    "non_overlapping_greedy": f"WITH RECURSIVE {_ORDERED}, r AS (SELECT user_id, event_id, k, ts + INTERVAL 4 HOUR AS free, CAST(1 AS BIGINT) AS chosen FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.event_id, o.k, CASE WHEN o.ts >= r.free THEN o.ts + INTERVAL 4 HOUR ELSE r.free END, CASE WHEN o.ts >= r.free THEN 1 ELSE 0 END FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1) SELECT user_id, event_id, chosen FROM r",
    "gap_span_clusters": f"WITH RECURSIVE {_ORDERED}, r AS (SELECT user_id, event_id, k, ts AS last, ts AS first FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.event_id, o.k, o.ts, CASE WHEN o.ts > r.last + INTERVAL 3 HOUR OR o.ts > r.first + INTERVAL 6 HOUR THEN o.ts ELSE r.first END FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1) SELECT user_id, first AS cluster_start, count(*) AS n FROM r GROUP BY user_id, first",
    "session_gap_clusters": f'WITH {_SESSIONS} SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM s GROUP BY user_id, session',
    "lifecycle_state": "WITH x AS (SELECT *, CASE event_type WHEN 'signup' THEN 'resolved' WHEN 'click' THEN 'mitigated' ELSE 'active' END AS phase FROM events), y AS (SELECT *, CAST(coalesce(sum(CASE WHEN phase = 'resolved' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS spell FROM x) SELECT user_id, CASE WHEN phase <> 'resolved' AND spell > 0 THEN 'reopened' ELSE phase END AS state, count(*) AS n, max(spell) AS spell FROM y GROUP BY 1, 2",
    "change_flips": "WITH x AS (SELECT event_id, event_type = 'error' AS unhealthy, coalesce(lag(event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS b FROM events) SELECT event_id, unhealthy FROM x WHERE unhealthy <> b",
    "streak_events": f"WITH {HOURS}, x AS (SELECT hour, errors >= 3 AS bad, row_number() OVER ({_DAY}) - row_number() OVER (PARTITION BY CAST(hour AS DATE), errors >= 3 ORDER BY hour) AS k FROM h), y AS (SELECT hour, bad, row_number() OVER (PARTITION BY CAST(hour AS DATE), bad, k ORDER BY hour) AS n FROM x) SELECT hour, CASE WHEN bad AND n = 2 THEN 'opened' WHEN bad AND n = 4 THEN 'escalated' ELSE 'recovered' END AS event FROM y WHERE bad AND n IN (2, 4) OR NOT bad AND n = 3",
    "dod_median7": "WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, day, n, lag(n) OVER v AS previous, median(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS median7 FROM d WINDOW v AS (PARTITION BY event_type ORDER BY day)",
    "gap_list": "SELECT event_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 3.6e9, 6) AS gap_hours FROM events WHERE event_type = 'purchase'",
    "exposure_baseline": "WITH c AS (SELECT user_id, ts AS s, ts + INTERVAL 6 HOUR AS e FROM events), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM c), x AS (SELECT user_id, sum(CASE WHEN r IS NULL OR s > r THEN epoch_us(e) - epoch_us(s) ELSE epoch_us(greatest(e, r)) - epoch_us(r) END) / 3.6e9 AS hours FROM m GROUP BY user_id), o AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase' AND value >= 100) AS outcomes FROM events GROUP BY user_id) SELECT x.user_id, outcomes, round(hours, 6) AS hours, round(1 - pow(1 - greatest(1e-6, least(0.25::DOUBLE, outcomes / hours)), 4), 6) AS baseline FROM x JOIN o ON x.user_id = o.user_id",
    "hour_of_week": "WITH x AS (SELECT ts, (CAST(isodow(ts) AS INTEGER) - 1) * 24 + CAST(hour(ts) AS INTEGER) AS slot FROM events) SELECT CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, slot % 24 AS hour, count(*) AS n, round(avg(least(abs(slot - 12) % 168, 168 - abs(slot - 12) % 168)), 6) AS distance FROM x GROUP BY 1, 2",
    "decayed_evidence": "WITH x AS (SELECT *, (epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts)) / 3.6e9 AS age FROM events) SELECT user_id, round(coalesce(sum(pow(2, -age / 24)) FILTER (WHERE event_type = 'error'), 0), 6) AS incident, round(coalesce(max(pow(2, -age / 36)) FILTER (WHERE event_type = 'view'), 0), 6) AS competitor FROM x WHERE age >= 0 AND age <= 336 GROUP BY user_id",
    "current_signal_order": "SELECT user_id, max_by(event_id, (event_id % 12, event_id % 5, event_id)) AS event_id, max_by('1.' || (event_id % 12)::VARCHAR || '.' || (event_id % 5)::VARCHAR, (event_id % 12, event_id % 5, event_id)) AS version FROM events GROUP BY user_id",
}
