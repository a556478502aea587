"""Queries over whole reports, with their oracles: the scopes, outcomes and forecasts of the training queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import intervals, metrics, profile
from tidemark.plans import link_queries, training_queries
from tidemark.plans.metric_queries import r6

CUTOFF = "2024-01-29"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = training_queries._forecasts(spark, sf_dir).select("scope", "hour", "p", F.col("hour").alias("start"), F.col("window_end").alias("end"))
    outcomes = training_queries._outcomes(spark, sf_dir).select("scope", "from_", "to", "ambiguous")
    covered = training_queries._merged(spark, sf_dir).select("scope", F.col("start").alias("covered_from"), F.col("end").alias("covered_to"))
    return profile.labelled_windows(windows, outcomes, covered, ["scope"], ["scope", "hour"], F.lit(CUTOFF).cast("timestamp_ntz"), 4)


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct outcomes in positive windows."""
    windows = _labelled(spark, sf_dir).filter("y = 1").select("scope", "start", "end")
    outcomes = training_queries._outcomes(spark, sf_dir).filter("not ambiguous").select("scope", "event_id", "from_", "to")
    pairs = intervals.overlap_join(windows, outcomes, ["scope"], ("start", "end"), ("from_", "to"), 4)
    return pairs.filter("from_ > start").select("scope", "event_id").distinct()


def window_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("scope", "hour", "status", "y")


def threshold_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.threshold_profile(_labelled(spark, sf_dir), _held(spark, sf_dir), ["scope"], "p", 100, 10)
    return out.select("scope", "status", "reason", "sample_count", "event_count", "passed", *profile.EXCLUSIONS, r6("mean"), r6("deviation"), r6("brier"))


def compact_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = profile.threshold_profile(_labelled(spark, sf_dir), _held(spark, sf_dir), ["scope"], "p", 100, 10)
    curve = metrics.threshold_sweep(_labelled(spark, sf_dir).filter("y is not null"), "p", "y")
    out = profile.compact_profile(whole, curve, ["scope"], (5, 10, 20, 40))
    shown = F.transform("points", lambda x: F.concat_ws(":", x["threshold_percent"].cast("string"), x["alerts"].cast("string")))
    return out.select("scope", "status", "sample_count", F.array_join(shown, ",").alias("points"))


def _events_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes with the probability of each positive window that holds them."""
    windows = _labelled(spark, sf_dir).filter("y = 1").select("scope", "start", "end", "p")
    outcomes = training_queries._outcomes(spark, sf_dir).filter("not ambiguous").select("scope", "event_id", "from_", "to")
    pairs = intervals.overlap_join(windows, outcomes, ["scope"], ("start", "end"), ("from_", "to"), 4)
    return pairs.filter("from_ > start").select("event_id", "p")


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.whole_profile(_labelled(spark, sf_dir), _events_held(spark, sf_dir), "p", "hour", "scope", "event_id", 4.0, 100, 10)


def profile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report of all scopes' windows, its bins and points counted."""
    out = _whole(spark, sf_dir)
    s = F.col("summary")
    return out.select("status", "reason", "sample_count", "event_count", "windows_passed", "events_passed", "passed", *profile.EXCLUSIONS, "positive", "negative", "first_start", "last_start", r6("brier"), r6(s["mean"], "mean"), r6(s["minimum"], "minimum"), r6(s["maximum"], "maximum"), F.array_join(F.transform("distribution", lambda b: F.concat_ws("/", b["events"].cast("string"), b["n"].cast("string"))), ",").alias("bins"), F.size("curve").alias("points"))


def profile_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's curve, a row a threshold."""
    c = _whole(spark, sf_dir).select(F.explode("curve").alias("c")).select("c.*")
    return c.select("threshold_percent", "alerts", "hits", r6("window_rate"), "chosen", "chosen_hits", r6("rate"), r6("low"), r6("high"), r6("confidence"), "events_hit", r6("recall"), r6("density"))


def impact_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of each user's events with state and pressure now."""
    e = link_queries._entries(spark, sf_dir).withColumns({"severity": F.least(F.lit(1.0), F.size("tokens") / 4.0 + (F.col("event_id") % 5) / 10.0), "state": F.when(F.col("event_id") % 6 == 0, "resolved").when(F.col("followup"), "mitigating").otherwise("active")})
    out = profile.impact_episodes(e, ["user_id"], "event_id", "severity", F.col("event_id") % 4 == 0, F.lit("2024-02-01").cast("timestamp_ntz"), 20.0, 72.0, 36.0)
    return out.select("user_id", "cluster", "start", "end", "n", "state", "n_surfaces", r6("severity"), "acknowledged_at", "resolved_at", "spell_start", r6("pressure"), r6("peak_pressure"))


QUERIES = {f.__name__: f for f in (window_labels, threshold_profile, compact_profile, profile_report, profile_curve, impact_episodes)}

_LABELS = f"""{training_queries.BASE}, {training_queries.FORECASTS},
lb AS (SELECT scope, hour, p, window_end, CASE WHEN window_end > TIMESTAMP '{CUTOFF}' THEN 'immature' WHEN EXISTS (SELECT 1 FROM o WHERE o.scope = w.scope AND f <= hour AND t > hour) THEN 'censored_anchor_inside_outcome' WHEN EXISTS (SELECT 1 FROM o WHERE o.scope = w.scope AND ambiguous AND f < window_end AND t > hour) THEN 'censored_ambiguous_outcome'
  WHEN EXISTS (SELECT 1 FROM o WHERE o.scope = w.scope AND NOT ambiguous AND f > hour AND f < window_end) THEN 'positive' WHEN NOT EXISTS (SELECT 1 FROM m WHERE m.scope = w.scope AND m.s <= hour AND m.e >= window_end) THEN 'censored_incomplete_coverage' ELSE 'negative' END AS status FROM w),
la AS (SELECT *, CASE status WHEN 'positive' THEN 1 WHEN 'negative' THEN 0 END AS y FROM lb)"""
_PROFILE = f"""{_LABELS}, ev AS (SELECT la.scope, count(DISTINCT event_id) AS k FROM la JOIN o ON o.scope = la.scope AND NOT ambiguous AND y = 1 AND f > hour AND f < window_end GROUP BY 1),
pf AS (SELECT la.scope, count(y) AS sample_count, coalesce(min(k), 0) AS event_count, count(y) >= 100 AND coalesce(min(k), 0) >= 10 AS passed, {', '.join(f"count(*) FILTER (WHERE status = '{n}') AS {n}" for n in profile.EXCLUSIONS)}, avg(p) FILTER (WHERE y IS NOT NULL) AS mean, stddev_pop(p) FILTER (WHERE y IS NOT NULL) AS deviation, avg(pow(p - y, 2)) AS brier FROM la LEFT JOIN ev ON ev.scope = la.scope GROUP BY la.scope)"""
_STATUS = "CASE WHEN sample_count = 0 THEN 'insufficient' WHEN passed THEN 'available' ELSE 'preliminary' END AS status"

_Z = "1.959963984540054::DOUBLE"
_Q = "(SELECT quantile_cont(p, {0}) FROM u)"

ORACLES = {
    "profile_report": f"""WITH {_LABELS}, ev AS (SELECT count(DISTINCT event_id) AS k FROM la JOIN o ON o.scope = la.scope AND NOT ambiguous AND y = 1 AND f > hour AND f < window_end),
b AS (SELECT string_agg(coalesce(e, 0) || '/' || coalesce(n, 0), ',' ORDER BY i) AS bins FROM range(20) r(i) LEFT JOIN (SELECT least(19, CAST(floor(p * 20) AS BIGINT)) AS i, sum(y) AS e, count(*) AS n FROM la WHERE y IS NOT NULL GROUP BY 1) USING (i)),
r AS (SELECT count(y) AS sample_count, {', '.join(f"count(*) FILTER (WHERE status = '{n}') AS {n}" for n in profile.EXCLUSIONS)}, count(*) FILTER (WHERE y = 1) AS positive, count(*) FILTER (WHERE y = 0) AS negative, min(hour) FILTER (WHERE y IS NOT NULL) AS first_start, max(hour) FILTER (WHERE y IS NOT NULL) AS last_start, round(avg(pow(p - y, 2)), 6) AS brier, round(avg(p) FILTER (WHERE y IS NOT NULL), 6) AS mean, round(min(p) FILTER (WHERE y IS NOT NULL), 6) AS minimum, round(max(p) FILTER (WHERE y IS NOT NULL), 6) AS maximum FROM la)
SELECT CASE WHEN sample_count >= 100 AND k >= 10 THEN 'available' ELSE 'preliminary' END AS status, CASE WHEN sample_count < 100 OR k < 10 THEN 'sample_gate_not_met' END AS reason, r.*, k AS event_count, sample_count >= 100 AS windows_passed, k >= 10 AS events_passed, sample_count >= 100 AND k >= 10 AS passed, bins, 101 AS points FROM r, ev, b""",
    "profile_curve": f"""WITH RECURSIVE {_LABELS}, u AS (SELECT scope, hour, p, y FROM la WHERE y IS NOT NULL), ks AS (SELECT CAST(k AS INTEGER) AS k FROM range(101) r(k)), s AS (SELECT k, u.* FROM ks JOIN u ON p > k / 100.0::DOUBLE),
g AS (SELECT k, min({{'h': hour, 's': scope}}) AS x FROM s GROUP BY k UNION ALL SELECT g.k, min({{'h': hour, 's': scope}}) FROM g JOIN s ON s.k = g.k AND s.hour >= g.x.h + INTERVAL 4 HOUR GROUP BY g.k),
c AS (SELECT g.k, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS m FROM g JOIN u ON u.hour = g.x.h AND u.scope = g.x.s GROUP BY 1),
a AS (SELECT k, count(*) AS alerts, sum(y) AS hits FROM s GROUP BY 1),
he AS (SELECT event_id, max(p) AS p FROM la JOIN o ON o.scope = la.scope AND NOT ambiguous AND y = 1 AND f > hour AND f < window_end GROUP BY 1),
eh AS (SELECT k, count(*) AS events_hit FROM ks JOIN he ON p > k / 100.0::DOUBLE GROUP BY 1),
bw AS (SELECT count(*) AS n, least(0.15, greatest(0.01, 0.9 * CASE WHEN {_Q.format(0.75)} > {_Q.format(0.25)} THEN least(stddev_pop(p), ({_Q.format(0.75)} - {_Q.format(0.25)}) / 1.34) ELSE stddev_pop(p) END * pow(count(*), -0.2))) AS h FROM u),
d AS (SELECT k, sum(exp(-0.5 * pow((k / 100.0::DOUBLE - p) / h, 2)) + exp(-0.5 * pow((k / 100.0::DOUBLE + p) / h, 2)) + exp(-0.5 * pow((k / 100.0::DOUBLE - 2 + p) / h, 2))) / (min(n) * min(h) * sqrt(2 * pi())) AS density FROM ks, u, bw GROUP BY k),
wl AS (SELECT *, (m / n + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) AS mid, {_Z} * sqrt(m / n * (1 - m / n) / n + {_Z} * {_Z} / (4 * n * n)) / (1 + {_Z} * {_Z} / n) AS half FROM c)
SELECT ks.k AS threshold_percent, coalesce(alerts, 0) AS alerts, coalesce(hits, 0) AS hits, round(hits / alerts, 6) AS window_rate, CAST(coalesce(n, 0) AS BIGINT) AS chosen, CAST(coalesce(m, 0) AS BIGINT) AS chosen_hits, round(m / n, 6) AS rate, round(CASE WHEN m = 0 THEN 0 ELSE mid - half END, 6) + 0.0 AS low, round(CASE WHEN m = n THEN 1 ELSE mid + half END, 6) AS high, CASE WHEN n >= 20 THEN round(m / n, 6) END AS confidence, coalesce(events_hit, 0) AS events_hit, round(coalesce(events_hit, 0) / (SELECT count(*) FROM he), 6) AS recall, round(density, 6) AS density
FROM ks LEFT JOIN a ON a.k = ks.k LEFT JOIN wl ON wl.k = ks.k LEFT JOIN eh ON eh.k = ks.k LEFT JOIN d ON d.k = ks.k""",
    "window_labels": f"WITH {_LABELS} SELECT scope, hour, status, y FROM la",
    "threshold_profile": f"WITH {_PROFILE} SELECT scope, {_STATUS}, CASE WHEN sample_count = 0 THEN 'no_labelled_windows' WHEN NOT passed THEN 'sample_gate_not_met' END AS reason, sample_count, event_count, passed, {', '.join(profile.EXCLUSIONS)}, round(mean, 6) + 0.0 AS mean, round(deviation, 6) + 0.0 AS deviation, round(brier, 6) + 0.0 AS brier FROM pf",
    "compact_profile": f"WITH {_PROFILE}, c AS (SELECT string_agg(k || ':' || n, ',' ORDER BY k) AS points FROM (SELECT k, (SELECT count(*) FROM la WHERE y IS NOT NULL AND p > k / 100.0::DOUBLE) AS n FROM (VALUES (5), (10), (20), (40)) v(k))) SELECT scope, {_STATUS}, sample_count, points FROM pf, c",
}
