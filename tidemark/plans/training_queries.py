"""Queries over training rows, folds and issued forecasts, with their oracles.

Five scopes (user_id modulo 5); an outcome is a purchase of 100 or more, which lasts 30 minutes, or
an error of 150 or more, which is ambiguous; views cover the five hours after them.  An hour's
forecast is n / (n + 8) for the n events of its scope.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import time as tm
from tidemark.operators import intervals, metrics, sequences, training
from tidemark.plans.metric_queries import r6
from tidemark.session import table

CUTOFF = "2024-01-27"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("scope", F.col("user_id") % 5)


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = F.expr("(event_type = 'purchase' and value >= 100) or (event_type = 'error' and value >= 150)")
    return _events(spark, sf_dir).filter(big).select("scope", "user_id", "event_id", F.col("ts").alias("from_"), (F.col("ts") + F.expr("interval 30 minutes")).alias("to"), (F.col("event_type") == "error").alias("ambiguous"))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _events(spark, sf_dir).filter("event_type = 'view'").select("scope", F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 5 hours")).alias("end"))
    return intervals.merge_intervals(seen, ["scope"])


def _forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scope, hour, p, window_end and y (an unambiguous outcome starts in the four hours from the hour on)."""
    counts = _events(spark, sf_dir).groupBy("scope", tm.floor_hour(F.col("ts")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    hits = _outcomes(spark, sf_dir).filter("not ambiguous").select("scope", F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: tm.from_micros(tm.micros(tm.floor_hour(F.col("from_"))) - k * tm.HOUR_US))).alias("hour")).distinct()
    rows = counts.join(hits.withColumn("y", F.lit(1)), ["scope", "hour"], "left")
    return rows.select("scope", "hour", (F.col("hour") + F.expr("interval 4 hours")).alias("window_end"), (F.col("n") / (F.col("n") + 8.0)).alias("p"), F.coalesce("y", F.lit(0)).alias("y"))


BASE = """e AS (SELECT *, user_id % 5 AS scope FROM events),
o AS (SELECT scope, user_id, event_id, ts AS f, ts + INTERVAL 30 MINUTE AS t, event_type = 'error' AS ambiguous FROM e WHERE (event_type = 'purchase' AND value >= 100) OR (event_type = 'error' AND value >= 150)),
v AS (SELECT scope, ts AS s, ts + INTERVAL 5 HOUR AS e FROM e WHERE event_type = 'view'),
v1 AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY scope ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM v),
v2 AS (SELECT *, sum(fresh) OVER (PARTITION BY scope ORDER BY s, e) AS g FROM v1),
m AS (SELECT scope, min(s) AS s, max(e) AS e FROM v2 GROUP BY scope, g)"""
FORECASTS = """n AS (SELECT scope, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) AS n FROM e GROUP BY 1, 2),
w AS (SELECT scope, hour, hour + INTERVAL 4 HOUR AS window_end, n / (n + 8.0::DOUBLE) AS p, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.scope = n.scope AND NOT ambiguous AND f >= hour AND f < hour + INTERVAL 4 HOUR) THEN 1 ELSE 0 END AS y FROM n)"""


def covered_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.covered_slots(_merged(spark, sf_dir), ["scope"], F.lit(CUTOFF).cast("timestamp_ntz"), 20)


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the decayed number of errors and clicks as features, less those of the outcome's own user."""
    e = _events(spark, sf_dir)
    cutoff = F.lit(CUTOFF).cast("timestamp_ntz")
    outcomes = _outcomes(spark, sf_dir).filter(F.col("to") <= cutoff)
    parts = {"errors": e.filter("event_type = 'error'"), "clicks": e.filter("event_type = 'click'")}
    features, own = None, None
    users = outcomes.select("event_id", "user_id", F.explode(F.array(tm.floor_hour(F.col("from_")), tm.floor_hour(F.col("to")))).alias("slot")).distinct()
    for name, rows in parts.items():
        one = training.hourly_decay(rows, ["scope"], "ts", 24.0, 72).withColumnRenamed("decayed", name)
        mine = training.hourly_decay(rows, ["user_id"], "ts", 24.0, 72).withColumnRenamed("decayed", name)
        mine = users.join(mine, ["user_id", "slot"]).select("event_id", "slot", name)
        features = one if features is None else features.join(one, ["scope", "slot"], "full")
        own = mine if own is None else own.join(mine, ["event_id", "slot"], "full")
    out = training.training_rows(covered_slots(spark, sf_dir), outcomes, ["scope"], "event_id", features, list(parts), own)
    return out.select("scope", "slot", "kind", "event_id", r6("exposure"), *[r6(n) for n in parts])


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.folds(_forecasts(spark, sf_dir).withColumn("cell", F.hour("hour") % 6), ["scope"], "hour", 9)


def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each weekly fold of rates by time of day, refitted on what had settled by the fold's origin."""
    history = _forecasts(spark, sf_dir).withColumn("cell", F.hour("hour") % 6)
    scored = training.refit_rates(history, _tests(spark, sf_dir).drop("p"), ["scope"], "cell", "hour", "y")
    out = training.paired_scores(scored, ["scope", "fold"], "p", "baseline", "y")
    return out.select("scope", "fold", "n", "events", *[r6(c) for c in ("brier", "baseline_brier", "log_loss", "improvement", "brier_skill")])


def _covered_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = _tests(spark, sf_dir).select("scope", "fold", "hour", "window_end")
    held = intervals.contained(tests, _merged(spark, sf_dir).select("scope", F.col("start").alias("ms"), F.col("end").alias("me")), ["scope"], ("hour", "window_end"), ("ms", "me")).select("scope", "hour", F.lit(True).alias("covered"))
    return tests.join(held, ["scope", "hour"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def fold_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = training.fold_dispositions(_covered_tests(spark, sf_dir), ["scope"], "covered")
    return out.select("scope", "fold", "required", "covered", r6("fraction"), "status")


def disposition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.disposition_summary(training.fold_dispositions(_covered_tests(spark, sf_dir), ["scope"], "covered"), ["scope"])


def _issued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of issued forecasts with their as-of baseline: known an hour after they happen, in ten days."""
    outcomes = _outcomes(spark, sf_dir).filter("not ambiguous").select("scope", (F.col("from_") + F.expr("interval 1 hour")).alias("known_at"))
    return training.baselines_as_of(_forecasts(spark, sf_dir), outcomes, _merged(spark, sf_dir), ["scope"], "hour", 10)


def issued_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issued(spark, sf_dir).select("scope", "hour", "y", r6("p"), F.col("outcomes").cast("long"), r6("hours"), r6("baseline"))


def issued_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = training.paired_scores(_issued(spark, sf_dir), ["scope"], "p", "baseline", "y")
    return out.select("scope", "n", "events", *[r6(c) for c in ("brier", "baseline_brier", "log_loss", "improvement", "brier_skill")])


def _scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _forecasts(spark, sf_dir).select("scope", F.col("hour").alias("window_start"), "window_end", "p")
    keyed = rows.withColumn("tie", F.col("scope") * 1000000 + tm.micros(F.col("window_start")) / tm.HOUR_US)
    alerts = sequences.top_per_week(keyed, "window_start", "p", 36, "tie")
    events = _outcomes(spark, sf_dir).filter("not ambiguous").select("scope", "event_id", F.col("from_").alias("start"), F.col("to").alias("end"))
    return training.event_scores(events, rows, alerts, ["scope"], "event_id")


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_events(spark, sf_dir).select("event_id", "hit", r6("lead_hours"), r6("highest_prior"), "prior_start", r6("peak_p"), r6("peak_error"))


def median_peak_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_events(spark, sf_dir).groupBy("scope").agg(F.round(F.median("peak_error"), 6).alias("median_error"), F.count("peak_error").alias("n"))


def evaluation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that an evaluation names, and the confirmed ones of now, with their score where there is one."""
    scored = _scored_events(spark, sf_dir).filter(F.col("start") < F.lit(CUTOFF).cast("timestamp_ntz")).select("event_id", "hit", "lead_hours")
    confirmed = _outcomes(spark, sf_dir).filter("user_id % 2 = 0").select("event_id")
    both = scored.select("event_id").unionByName(confirmed).distinct()
    return both.join(scored, "event_id", "left").select("event_id", "hit", r6("lead_hours"))


def promotion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scope's forecast against a champion that always says one tenth; ECE and recall from its own rows."""
    rows = _issued(spark, sf_dir)
    own = training.paired_scores(rows, ["scope"], "p", "baseline", "y").select("scope", "n", "events", "brier", "brier_skill")
    champion = rows.groupBy("scope").agg(F.avg(F.pow(0.1 - F.col("y"), F.lit(2.0))).alias("champion_brier"), F.try_divide(F.count_if((F.col("y") == 1) & (F.col("p") >= 0.2)), F.sum("y")).alias("recall"))
    bins = rows.groupBy("scope", metrics.bin_by_edges(F.col("p")).alias("bin")).agg(F.abs(F.sum("p") - F.sum("y")).alias("gap"), F.count(F.lit(1)).alias("k"))
    ece = bins.groupBy("scope").agg((F.sum("gap") / F.sum("k")).alias("ece"))
    all_ = own.join(champion, "scope").join(ece, "scope")
    found = training.promotion_reasons({c: F.col(c) for c in all_.columns}, least_rows=100)
    return all_.select("scope", F.array_join(found, ",").alias("reasons"))


def live_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hazards of each scope's hours from the cutoff on against a flat baseline."""
    slots = _forecasts(spark, sf_dir).filter(F.col("hour") >= F.lit(CUTOFF).cast("timestamp_ntz")).withColumns({"hazard": F.col("p") / 8, "flat": F.lit(0.01)})
    out = training.live_guard(slots, ["scope"], "hour", "hazard", "flat", {4: 0.08, 24: 0.4, 72: 0.6}, 1.5)
    return out.select("scope", *[r6(f"cumulative_{n}") for n in (4, 24, 72)], F.array_join("violations", ",").alias("violations"))


def frozen_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that a frozen artifact states (here wrong for scope 3), computed anew and compared, with the hash of its rows."""
    rows = _forecasts(spark, sf_dir)
    anew = rows.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2.0))), 9).alias("brier"))
    # rows are hashed one by one; the sorted digests of a day, then of all days, make the whole
    line = F.sha2(F.concat_ws("|", F.date_format("hour", "yyyy-MM-dd HH"), F.col("y").cast("string")), 256)
    days = rows.groupBy("scope", F.to_date("hour").alias("day")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256).alias("h"))  # at most 24 rows a day
    hashed = days.groupBy("scope").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("rows_hash"))  # one digest a day
    stated = rows.groupBy("scope").agg(F.round(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2.0))) + F.when(F.col("scope") == 3, 0.01).otherwise(0.0), 9).alias("stated"))
    return anew.join(hashed, "scope").join(stated, "scope").select("scope", "n", "rows_hash", (F.abs(F.col("brier") - F.col("stated")) <= 1e-9).alias("verified"))


QUERIES = {f.__name__: f for f in (covered_slots, training_rows, walk_forward_folds, fold_dispositions, disposition_summary, issued_rows, issued_scores, event_scores, median_peak_error, evaluation_events, promotion_reasons, live_guard, frozen_scores)}

_SLOTS = f"""c AS (SELECT scope, h AS slot FROM (SELECT DISTINCT CAST(date_trunc('hour', x) AS TIMESTAMP) AS h FROM (SELECT unnest(generate_series(TIMESTAMP '{CUTOFF}' - INTERVAL 20 DAY, TIMESTAMP '{CUTOFF}' - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS x)) g JOIN m ON m.s <= h AND m.e >= h + INTERVAL 1 HOUR)"""
_OWN = """(SELECT coalesce(sum(pow(2, -(epoch_us(slot) - epoch_us(ts)) / 3.6e9 / 24)), 0) FROM e WHERE {cond} AND event_type = '{kind}' AND ts < slot AND date_trunc('hour', ts) >= slot - INTERVAL 72 HOUR)"""
_FOLDS = """a0 AS (SELECT scope, CAST(date_trunc('hour', min(hour)) AS TIMESTAMP) + INTERVAL 9 DAY AS b FROM w GROUP BY scope),
x AS (SELECT w.*, hour(hour) % 6 AS cell, CAST(floor((epoch_us(hour) - epoch_us(b)) / 6.048e11) AS INTEGER) AS fold, b FROM w JOIN a0 USING (scope)),
tests AS (SELECT *, b + to_days(7 * fold) AS origin FROM x WHERE fold >= 0 AND window_end <= b + to_days(7 * fold) + INTERVAL 7 DAY)"""
_SCORES = """count(*) AS n, sum(y) AS events, round(avg(pow(p - y, 2)), 6) + 0.0 AS brier, round(avg(pow(baseline - y, 2)), 6) + 0.0 AS baseline_brier,
  round(avg(CASE WHEN y = 1 THEN -ln(greatest(p, 1e-12)) ELSE -ln(1 - least(p, 1 - 1e-12)) END), 6) + 0.0 AS log_loss, round(avg(pow(baseline - y, 2) - pow(p - y, 2)), 6) + 0.0 AS improvement, round(1 - avg(pow(p - y, 2)) / nullif(avg(pow(baseline - y, 2)), 0), 6) + 0.0 AS brier_skill"""
_ISSUED = """q AS (SELECT w.*, (SELECT count(*) FROM o WHERE o.scope = w.scope AND NOT ambiguous AND f + INTERVAL 1 HOUR <= hour AND f + INTERVAL 1 HOUR > hour - INTERVAL 10 DAY) AS outcomes,
  coalesce((SELECT sum(greatest(0, epoch_us(least(m.e, hour)) - epoch_us(greatest(m.s, hour - INTERVAL 10 DAY)))) FROM m WHERE m.scope = w.scope AND m.s <= hour AND m.e > hour - INTERVAL 10 DAY), 0) / 3.6e9 AS hours FROM w),
i AS (SELECT *, 1 - pow(1 - greatest(1e-6, least(0.25, CASE WHEN hours > 0 THEN outcomes / hours ELSE 0 END)), 4) AS baseline FROM q)"""
_EVENTS = """al AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('week', hour) ORDER BY p DESC, hour, scope) AS r FROM w) WHERE r <= 36),
ev AS (SELECT scope, event_id, f, t FROM o WHERE NOT ambiguous),
pr AS (SELECT event_id, max(p) AS p, arg_max(hour, p * 1e6 - epoch_us(hour) / 1e16) AS h FROM ev JOIN w ON w.scope = ev.scope AND hour < f AND window_end > f GROUP BY event_id),
hi AS (SELECT event_id, max(epoch_us(f) - epoch_us(hour)) / 3.6e9 AS lead FROM ev JOIN al ON al.scope = ev.scope AND hour < f AND window_end > f GROUP BY event_id),
pk AS (SELECT * FROM (SELECT event_id, p, abs((epoch_us(hour) + epoch_us(window_end)) / 2 - epoch_us(f)) / 3.6e9 AS err, row_number() OVER (PARTITION BY event_id ORDER BY p DESC, hour) AS r FROM ev JOIN al ON al.scope = ev.scope AND date_trunc('week', hour) = date_trunc('week', f) AND hour < f) WHERE r = 1),
es AS (SELECT ev.*, hi.lead IS NOT NULL AS hit, hi.lead, coalesce(pr.p, 0) AS highest, pr.h, pk.p AS peak_p, pk.err FROM ev LEFT JOIN pr USING (event_id) LEFT JOIN hi USING (event_id) LEFT JOIN pk USING (event_id))"""
_DISPOSITIONS = """cv AS (SELECT t.scope, fold, EXISTS (SELECT 1 FROM m WHERE m.scope = t.scope AND m.s <= hour AND m.e >= window_end) AS c FROM tests t),
di AS (SELECT scope, fold, count(*) AS required, count(*) FILTER (WHERE c) AS covered, CASE WHEN bool_and(c) THEN 'eligible' ELSE 'rejected' END AS status FROM cv GROUP BY scope, fold)"""

ORACLES = {
    "covered_slots": f"WITH {BASE}, {_SLOTS} SELECT scope, slot FROM c",
    "training_rows": f"""WITH {BASE}, {_SLOTS}, k AS (SELECT *, unnest(CASE WHEN date_trunc('hour', f) = date_trunc('hour', t - INTERVAL 1 MICROSECOND) THEN [CAST(date_trunc('hour', f) AS TIMESTAMP)] ELSE [CAST(date_trunc('hour', f) AS TIMESTAMP), CAST(date_trunc('hour', t) AS TIMESTAMP)] END) AS slot FROM o WHERE t <= TIMESTAMP '{CUTOFF}'),
r AS (SELECT scope, slot, 'negative' AS kind, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS u, 1.0::DOUBLE AS exposure FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.scope = c.scope AND k.slot = c.slot)
  UNION ALL SELECT scope, slot, 'event', event_id, user_id, (epoch_us(least(t, slot + INTERVAL 1 HOUR)) - epoch_us(greatest(f, slot))) / 3.6e9 FROM k WHERE NOT ambiguous)
SELECT scope, slot, kind, event_id, round(exposure, 6) + 0.0 AS exposure, """
    + ", ".join(f"round({_OWN.format(cond='e.scope = r.scope', kind=k)} - {_OWN.format(cond='e.user_id = r.u', kind=k)}, 6) + 0.0 AS {n}" for k, n in (("error", "errors"), ("click", "clicks")))
    + " FROM r",
    "walk_forward_folds": f"""WITH {BASE}, {FORECASTS}, {_FOLDS}, oc AS (SELECT DISTINCT scope, fold, origin FROM tests),
cl AS (SELECT oc.scope, oc.fold, x.cell, count(*) FILTER (WHERE x.window_end <= oc.origin) AS n, coalesce(sum(x.y) FILTER (WHERE x.window_end <= oc.origin), 0) AS s FROM oc JOIN x ON x.scope = oc.scope GROUP BY 1, 2, 3),
bs AS (SELECT *, (sum(s) OVER (PARTITION BY scope, fold) + 0.05) / (sum(n) OVER (PARTITION BY scope, fold) + 1.0) AS baseline FROM cl),
sc AS (SELECT t.scope, t.fold, t.y, baseline, (s + baseline) / (n + 1.0) AS p FROM tests t JOIN bs USING (scope, fold, cell))
SELECT scope, fold, {_SCORES} FROM sc GROUP BY scope, fold""",
    "fold_dispositions": f"WITH {BASE}, {FORECASTS}, {_FOLDS}, {_DISPOSITIONS} SELECT scope, fold, required, covered, round(covered / required, 6) + 0.0 AS fraction, status FROM di",
    "disposition_summary": f"WITH {BASE}, {FORECASTS}, {_FOLDS}, {_DISPOSITIONS} SELECT scope, count(*) AS count, count(*) FILTER (WHERE status = 'rejected') AS rejected, 'sha256:' || sha256(string_agg(fold || ':' || status || ':' || covered || ':' || required, chr(10) ORDER BY fold)) AS disposition_hash, bool_and(status = 'eligible') AS passed FROM di GROUP BY scope",
    "issued_rows": f"WITH {BASE}, {FORECASTS}, {_ISSUED} SELECT scope, hour, y, round(p, 6) + 0.0 AS p, outcomes, round(hours, 6) + 0.0 AS hours, round(baseline, 6) + 0.0 AS baseline FROM i",
    "issued_scores": f"WITH {BASE}, {FORECASTS}, {_ISSUED} SELECT scope, {_SCORES} FROM i GROUP BY scope",
    "event_scores": f"WITH {BASE}, {FORECASTS}, {_EVENTS} SELECT event_id, hit, round(lead, 6) + 0.0 AS lead_hours, round(highest, 6) + 0.0 AS highest_prior, h AS prior_start, round(peak_p, 6) + 0.0 AS peak_p, round(err, 6) + 0.0 AS peak_error FROM es",
    "median_peak_error": f"WITH {BASE}, {FORECASTS}, {_EVENTS} SELECT scope, round(median(err), 6) AS median_error, count(err) AS n FROM es GROUP BY scope",
    "evaluation_events": f"WITH {BASE}, {FORECASTS}, {_EVENTS}, s AS (SELECT * FROM es WHERE f < TIMESTAMP '{CUTOFF}') SELECT event_id, hit, round(lead, 6) + 0.0 AS lead_hours FROM (SELECT event_id FROM s UNION SELECT event_id FROM o WHERE user_id % 2 = 0) b LEFT JOIN s USING (event_id)",
    "promotion_reasons": f"""WITH {BASE}, {FORECASTS}, {_ISSUED}, bn AS (SELECT scope, least(9, CAST(floor(p * 10 + 1e-12) AS INTEGER)) AS b, abs(sum(p) - sum(y)) AS gap, count(*) AS k FROM i GROUP BY 1, 2), ec AS (SELECT scope, sum(gap) / sum(k) AS ece FROM bn GROUP BY scope),
g AS (SELECT scope, count(*) AS n, sum(y) AS events, avg(pow(p - y, 2)) AS brier, 1 - avg(pow(p - y, 2)) / nullif(avg(pow(baseline - y, 2)), 0) AS skill, avg(pow(0.1 - y, 2)) AS champion, count(*) FILTER (WHERE y = 1 AND p >= 0.2) / nullif(sum(y), 0) AS recall FROM i GROUP BY scope)
SELECT scope, concat_ws(',', CASE WHEN n < 100 OR events < 20 THEN 'sample_too_small' END, CASE WHEN NOT coalesce(skill > 0, false) THEN 'no_skill' END, CASE WHEN ece > 0.1 THEN 'badly_calibrated' END, CASE WHEN NOT coalesce(recall >= 0.8, false) THEN 'recall_too_low' END, CASE WHEN brier > champion + 1e-12 THEN 'worse_than_champion' END) AS reasons FROM g JOIN ec USING (scope)""",
    "live_guard": f"""WITH {BASE}, {FORECASTS}, l AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY hour) AS k FROM w WHERE hour >= TIMESTAMP '{CUTOFF}'),
c AS (SELECT scope, """
    + ", ".join(f"1 - product(1 - p / 8) FILTER (WHERE k <= {n}) AS c{n}, 1 - pow(0.99, count(*) FILTER (WHERE k <= {n})) AS b{n}" for n in (4, 24, 72))
    + """ FROM l GROUP BY scope) SELECT scope, """
    + ", ".join(f"round(c{n}, 6) + 0.0 AS cumulative_{n}" for n in (4, 24, 72))
    + ", concat_ws(',', "
    + ", ".join(f"CASE WHEN c{n} > {m} THEN 'cumulative_{n}' END, CASE WHEN c{n} > 1.5 * b{n} THEN 'surge_{n}' END" for n, m in ((4, 0.08), (24, 0.4), (72, 0.6)))
    + ") AS violations FROM c",
    "frozen_scores": f"""WITH {BASE}, {FORECASTS}, d AS (SELECT scope, CAST(hour AS DATE) AS day, sha256(string_agg(h, '' ORDER BY h)) AS h FROM (SELECT scope, hour, sha256(strftime(hour, '%Y-%m-%d %H') || '|' || y) AS h FROM w) GROUP BY 1, 2), r AS (SELECT scope, sha256(string_agg(h, '' ORDER BY h)) AS rows_hash FROM d GROUP BY scope)
SELECT scope, count(*) AS n, min(rows_hash) AS rows_hash, scope <> 3 AS verified FROM w JOIN r USING (scope) GROUP BY scope""",
}
