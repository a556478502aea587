"""Queries over episodes, labels of windows, alerts and freshness, with their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import time as tm
from tidemark.functions.time import HOUR_US, micros
from tidemark.operators import episodes, intervals, linking
from tidemark.plans.metric_queries import HOURS, hours, r6
from tidemark.session import table

NOW = "2024-01-29"


def _now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("event_type") == "signup", "resolved").when(F.col("event_type") == "click", "mitigating").otherwise("active")
    return table(spark, sf_dir, "events").withColumn("state", state)


def candidate_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    stance = F.when(F.col("event_type").isin("view", "purchase"), "supports").when(F.col("event_type") == "error", "contradicts")
    phase = F.when((F.col("event_type") == "signup") & (F.col("value") > 200), "completed").otherwise("expected")
    return episodes.candidate_states(e.withColumns({"stance": stance, "phase": phase}), ["user_id"], "phase", "stance")


def hypothesised_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumns({"day": tm.day_key(F.col("ts")), "start": F.col("ts"), "end": tm.add_hours(F.col("ts"), 2)})
    out = episodes.hypothesised_ranges(e, ["user_id", "day"], "start", "end", "event_type")
    return out.select("user_id", "start", "end", F.col("event_type").alias("precision"))


def episode_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.milestones(_kinds(spark, sf_dir), ["user_id"], "ts", "state", F.col("value") >= 100)


def peak_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumns({"severity": F.floor(F.col("value") / 100), "scope": F.col("event_id") % 4})
    return episodes.peak_impact(e, ["user_id"], ["severity", "scope"], ["ts", "event_id"]).select("user_id", "event_id", "severity", "scope")


def episode_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _kinds(spark, sf_dir).filter(F.col("ts") <= _now())
    g = e.groupBy("user_id").agg(F.max("value").alias("top"), F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("sources"), F.min("ts").alias("a"), F.max("ts").alias("b"), F.max_by("state", F.struct("ts", "event_id")).alias("state"))
    parts = {"severity": F.least(F.lit(1.0), F.col("top") / 300), "scope": F.col("n") / (F.col("n") + 10), "workaround": F.lit(0.5)}
    state = F.when(F.col("state") == "resolved", 0.2).when(F.col("state") == "mitigating", 0.6).otherwise(1.0)
    active, idle = (micros(F.col("b")) - micros(F.col("a"))) / HOUR_US, (micros(_now()) - micros(F.col("b"))) / HOUR_US
    return g.select("user_id", F.round(episodes.pressure(parts, state, F.col("sources"), active, idle, 72.0, 36.0), 6).alias("pressure"))


def revision_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _kinds(spark, sf_dir).withColumn("day", F.to_date("ts"))
    v = e.groupBy("user_id", "day").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.max(F.floor(F.col("value") / 100)).alias("severity"), F.array_sort(F.collect_set("event_type")).alias("evidence"), F.max("value").alias("level"))
    out = episodes.revision_kinds(v, ["user_id"], "day", "state", ["severity"], "evidence", "level", 20.0)
    return out.select("user_id", "day", "kind", "trend")


def window_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    one = F.lit(0).alias("scope")
    windows = hours(spark, sf_dir).select(one, "hour", F.col("hour").alias("start"), tm.add_hours(F.col("hour"), 4).alias("end"))
    unclear = F.col("event_type") == "signup"
    outcomes = e.filter("event_type in ('purchase', 'signup') and value >= 240").select(one, F.col("ts").alias("from_"), tm.add_hours(F.col("ts"), 1).alias("to"), unclear.alias("ambiguous"))
    covered = e.filter("event_type = 'view'").select(one, F.col("ts").alias("covered_from"), tm.add_hours(F.col("ts"), 6).alias("covered_to"))
    merged = intervals.merge_intervals(covered, ["scope"], "covered_from", "covered_to")
    return episodes.window_classes(windows, outcomes, merged, ["scope"], ["hour"], _now(), 4).select("hour", "status")


def alert_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    events = e.filter("event_type = 'purchase'").select("user_id", "event_id", F.col("ts").alias("start"), tm.add_hours(F.col("ts"), 1).alias("end"))
    alerts = e.filter("event_type = 'error'").select("user_id", F.col("ts").alias("alert_start"), tm.add_hours(F.col("ts"), 12).alias("alert_end"), F.col("value").alias("p"))
    out = episodes.alert_matches(events, alerts, ["user_id"], ["event_id"], 12)
    return out.select("event_id", "n_alerts", "best_p", r6("lead_hours"))


def _providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("ts") <= _now())
    p = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("success"), F.max(F.when((F.col("event_type") == "error") & (F.col("value") > 150), F.col("ts"))).alias("failure"))
    error = F.when(F.col("failure").isNotNull(), "failed")
    status = episodes.provider_status(F.col("user_id") % 5 != 0, F.col("success"), F.col("failure"), error, _now(), 60.0)
    return p.select("user_id", (F.col("user_id") % 5 != 0).alias("enabled"), status.alias("status"))


def provider_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _providers(spark, sf_dir).select("user_id", "status")


def freshness_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _providers(spark, sf_dir).withColumns({"role": F.col("user_id") % 9, "required": F.col("user_id") % 15 == 0})
    return episodes.group_status(p, ["role"], "enabled", "status", "required")


def coverage_waiting(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("role"), "user_id", F.col("ts").alias("observed_at"), (F.col("event_id") % 7).alias("candidates"), tm.add_hours(F.col("ts"), -6).alias("first_at"), tm.add_hours(F.col("ts"), 36).alias("recheck_at"))
    return episodes.waiting_rollup(reports, ["role"], "user_id", _now())


WEIGHTS = {"resolved": 0.2, "mitigating": 0.6, "investigating": 0.9, "reopened": 1.0}
TTL, HALF_LIFE = 12.0, 6.0


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as updates of one episode: states, weights and independence groups by number."""
    e = table(spark, sf_dir, "events").filter(F.col("ts") <= _now())
    state = F.element_at(F.array(*[F.lit(x) for x in ("resolved", "mitigating", "investigating", "active", "active", "active")]), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select("user_id", "event_id", "ts", state.alias("state"), (F.col("event_id") % 5 / 4.0).alias("severity"), (F.col("event_id") % 4 / 3.0).alias("scope"), (F.col("event_id") % 3 / 2.0).alias("workaround"), F.col("event_type").alias("category"), (F.col("event_id") % 7).alias("origin"))


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = updates(spark, sf_dir)
    samples = linking.sample_times(rows, ["user_id"], "ts", _now(), TTL)
    return episodes.pressure_at(rows, samples, ["user_id"], "ts", "event_id", "origin", "state", "severity", "scope", "workaround", "category", WEIGHTS, TTL, HALF_LIFE)


def pressure_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State, sources, spell and pressure of each user's episode at every time at which it can peak."""
    return _sampled(spark, sf_dir).select("user_id", "sample", "state", "sources", "spell_start", r6("active_hours"), r6("idle_hours"), r6("pressure"))


def sampled_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir).groupBy("user_id").agg(F.max("pressure").alias("peak"), F.count(F.lit(1)).alias("n")).select("user_id", r6("peak"), "n")


QUERIES = {f.__name__: f for f in (pressure_samples, sampled_peaks, candidate_states, hypothesised_ranges, episode_milestones, peak_impacts, episode_pressure, revision_kinds, window_classes, alert_matches, provider_freshness, freshness_groups, coverage_waiting)}

_STATE = "CASE event_type WHEN 'signup' THEN 'resolved' WHEN 'click' THEN 'mitigating' ELSE 'active' END"
_PROVIDERS = f"""g AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'view') AS success, max(ts) FILTER (WHERE event_type = 'error' AND value > 150) AS failure FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY user_id),
p AS (SELECT user_id, user_id % 5 <> 0 AS enabled, CASE WHEN user_id % 5 = 0 THEN 'disabled' WHEN failure IS NOT NULL AND (success IS NULL OR failure >= success) THEN 'error' WHEN success IS NULL THEN 'unknown' WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us(success) > 60 * 3600000000 THEN 'stale' ELSE 'fresh' END AS status FROM g)"""

_SAMPLED = f"""e AS (SELECT user_id, event_id, epoch_us(ts) AS t, ['resolved', 'mitigating', 'investigating', 'active', 'active', 'active'][CAST(event_id % 6 + 1 AS INTEGER)] AS state, event_id % 5 / 4.0::DOUBLE AS sev, event_id % 4 / 3.0::DOUBLE AS scope, event_id % 3 / 2.0::DOUBLE AS work, event_type, event_id % 7 AS origin
  FROM events WHERE ts <= TIMESTAMP '{NOW}'),
u AS (SELECT *, first_value(event_type) OVER w = event_type AS own, lag(state) OVER w AS was, min(t) OVER (PARTITION BY user_id) AS t0 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT DISTINCT user_id, unnest([epoch_us(TIMESTAMP '{NOW}'), t, CASE WHEN t > t0 THEN t - 1000 END, least(epoch_us(TIMESTAMP '{NOW}'), t + CAST({TTL} * 3.6e9 AS BIGINT))]) AS sample FROM u),
g AS (SELECT s.user_id, sample, arg_max({{'state': state, 'work': work, 't': t}}, {{'t': t, 'i': event_id}}) AS l, bool_or(state = 'resolved') AS done, count(DISTINCT origin) AS sources, max({{'sev': sev, 'scope': scope}}) FILTER (WHERE own) AS p,
  max(t) FILTER (WHERE was IS NULL OR (was = 'resolved' AND state <> 'resolved')) AS spell_start FROM s JOIN u ON u.user_id = s.user_id AND u.t <= s.sample WHERE sample IS NOT NULL GROUP BY 1, 2),
q AS (SELECT *, CASE WHEN l.state <> 'resolved' AND done THEN 'reopened' ELSE l.state END AS st, least({TTL}, greatest(0, ((CASE WHEN l.state = 'resolved' THEN l.t ELSE sample END) - spell_start) / 3.6e9)) AS active, greatest(0, (sample - l.t) / 3.6e9) AS idle FROM g),
pr AS (SELECT *, least(1, greatest(0, (p.sev * 0.4 + p.scope * 0.25 + 0.1 * (1 - exp(-3 * floor(active) / {TTL})) / (1 - exp(-3.0::DOUBLE)) + 0.15 * least(1, 0.4 + 0.2 * greatest(0, sources - 1)) + l.work * 0.1)
  * CASE st WHEN 'resolved' THEN 0.2 WHEN 'mitigating' THEN 0.6 WHEN 'investigating' THEN 0.9 ELSE 1 END * pow(0.5, floor(greatest(0, idle - {TTL})) / {HALF_LIFE}))) AS pressure FROM q)"""

ORACLES = {
    "pressure_samples": f"WITH {_SAMPLED} SELECT user_id, sample, st AS state, sources, spell_start, round(active, 6) + 0.0 AS active_hours, round(idle, 6) + 0.0 AS idle_hours, round(pressure, 6) + 0.0 AS pressure FROM pr",
    "sampled_peaks": f"WITH {_SAMPLED} SELECT user_id, round(max(pressure), 6) + 0.0 AS peak, count(*) AS n FROM pr GROUP BY user_id",
    "candidate_states": "WITH v AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'signup' AND value > 200) AS d, count(*) FILTER (WHERE event_type IN ('view', 'purchase')) AS f, count(*) FILTER (WHERE event_type = 'error') AS a FROM events GROUP BY user_id) SELECT user_id, CASE WHEN d > 0 THEN 'closed' WHEN a > f THEN 'contradicted' WHEN f > 0 THEN 'supported' ELSE 'open' END AS state FROM v",
    "hypothesised_ranges": 'SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) ELSE \'unknown\' END AS precision FROM events GROUP BY user_id, CAST(ts AS DATE)',
    "episode_milestones": "SELECT user_id, min(ts) FILTER (WHERE value >= 100) AS acknowledged_at, max(ts) FILTER (WHERE event_type = 'click') AS mitigated_at, max(ts) FILTER (WHERE event_type = 'signup') AS resolved_at FROM events GROUP BY user_id",
    "peak_impacts": "SELECT user_id, event_id, CAST(floor(value / 100) AS BIGINT) AS severity, event_id % 4 AS scope FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY floor(value / 100) DESC, event_id % 4 DESC, ts, event_id) = 1",
    "episode_pressure": f"""WITH g AS (SELECT user_id, max(value) AS top, CAST(count(*) AS DOUBLE) AS n, count(DISTINCT event_type) AS sources, epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b, max_by({_STATE}, (ts, event_id)) AS state FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY user_id),
x AS (SELECT *, floor(least(72.0::DOUBLE, (b - a) / 3.6e9)) AS active, floor(greatest(0.0::DOUBLE, (epoch_us(TIMESTAMP '{NOW}') - b) / 3.6e9 - 72)) AS old FROM g)
SELECT user_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.4::DOUBLE * least(1.0::DOUBLE, top / 300) + 0.25::DOUBLE * n / (n + 10) + 0.1::DOUBLE * (1 - exp(-3 * active / 72)) / (1 - exp(-3::DOUBLE)) + 0.15::DOUBLE * least(1.0::DOUBLE, 0.2::DOUBLE + 0.2::DOUBLE * sources) + 0.05::DOUBLE) * CASE state WHEN 'resolved' THEN 0.2::DOUBLE WHEN 'mitigating' THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END * pow(0.5::DOUBLE, old / 36))), 6) AS pressure FROM x""",
    "revision_kinds": f"""WITH v AS (SELECT user_id, CAST(ts AS DATE) AS day, max_by({_STATE}, (ts, event_id)) AS state, max(floor(value / 100)) AS severity, list_sort(list(DISTINCT event_type)) AS evidence, max(value) AS level FROM events GROUP BY 1, 2),
x AS (SELECT *, lag(state) OVER w AS s, lag(severity) OVER w AS r, lag(evidence) OVER w AS g, lag(level) OVER w AS l FROM v WINDOW w AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, day, CASE WHEN s IS NULL THEN 'opened' WHEN state = 'resolved' AND s <> 'resolved' THEN 'resolved' WHEN state = 'mitigating' AND s <> 'mitigating' THEN 'mitigated' WHEN severity > r THEN 'escalated' WHEN len(list_filter(evidence, lambda e: NOT list_contains(g, e))) > 0 THEN 'evidence_added' WHEN evidence <> g THEN 'evidence_updated' ELSE 'recomputed' END AS kind,
CASE WHEN state = 'resolved' THEN 'resolved' WHEN state = 'mitigating' THEN 'falling' WHEN s IS NULL OR level - l >= 20 THEN 'rising' WHEN level - l <= -20 THEN 'falling' ELSE 'stable' END AS trend FROM x""",
    "window_classes": f"""WITH {HOURS}, o AS (SELECT ts AS f, ts + INTERVAL 1 HOUR AS t, event_type = 'signup' AS u FROM events WHERE event_type IN ('purchase', 'signup') AND value >= 240),
k AS (SELECT ts AS f, ts + INTERVAL 6 HOUR AS t FROM events WHERE event_type = 'view'), r AS (SELECT *, max(t) OVER (ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM k),
i AS (SELECT *, sum(CASE WHEN m IS NULL OR f > m THEN 1 ELSE 0 END) OVER (ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS n FROM r), j AS (SELECT min(f) AS f, max(t) AS t FROM i GROUP BY n)
SELECT hour, CASE WHEN hour + INTERVAL 4 HOUR > TIMESTAMP '{NOW}' THEN 'immature' WHEN EXISTS (SELECT 1 FROM o WHERE f <= hour AND hour < t) THEN 'censored_anchor_inside_outcome' WHEN EXISTS (SELECT 1 FROM o WHERE u AND f < hour + INTERVAL 4 HOUR AND t > hour) THEN 'censored_ambiguous_outcome' WHEN EXISTS (SELECT 1 FROM o WHERE NOT u AND f > hour AND f < hour + INTERVAL 4 HOUR) THEN 'positive' WHEN NOT EXISTS (SELECT 1 FROM j WHERE f <= hour AND t >= hour + INTERVAL 4 HOUR) THEN 'censored_incomplete_coverage' ELSE 'negative' END AS status FROM h""",
    "alert_matches": "WITH a AS (SELECT user_id, ts AS s, ts + INTERVAL 12 HOUR AS t, value AS p FROM events WHERE event_type = 'error') SELECT e.event_id, count(a.s) AS n_alerts, max(p) AS best_p, round(max((epoch_us(e.ts) - epoch_us(a.s)) / 3.6e9), 6) AS lead_hours FROM events e LEFT JOIN a ON a.user_id = e.user_id AND a.s < e.ts AND a.t > e.ts WHERE e.event_type = 'purchase' GROUP BY e.event_id",
    "provider_freshness": f"WITH {_PROVIDERS} SELECT user_id, status FROM p",
    "freshness_groups": f"WITH {_PROVIDERS}, c AS (SELECT user_id % 9 AS role, count(*) FILTER (WHERE user_id % 15 = 0 AND NOT enabled) AS m, count(*) FILTER (WHERE enabled) AS n, count(*) FILTER (WHERE status = 'fresh') AS f, count(*) FILTER (WHERE status = 'error') AS e, count(*) FILTER (WHERE status = 'stale') AS s, count(*) FILTER (WHERE status = 'unknown') AS u FROM p GROUP BY 1) SELECT role, CASE WHEN m > 0 THEN 'unavailable' WHEN n > 0 AND f = n THEN 'fresh' WHEN f > 0 THEN 'degraded' WHEN e > 0 THEN 'error' WHEN s > 0 THEN 'stale' WHEN u > 0 THEN 'unknown' ELSE 'disabled' END AS status FROM c",
    "coverage_waiting": f"WITH l AS (SELECT user_id, max_by(event_id, (ts, event_id % 7)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id) SELECT user_id % 3 AS role, count(*) AS n_providers, CAST(sum(event_id % 7) AS BIGINT) AS candidates, min(ts) - INTERVAL 6 HOUR AS first_at, min(ts) + INTERVAL 36 HOUR AS recheck_at, max(ts) AS observed_at, min(ts) + INTERVAL 36 HOUR <= TIMESTAMP '{NOW}' AS recheck_due FROM l GROUP BY 1",
}
