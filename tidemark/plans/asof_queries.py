"""Training rows with the whole vector as known at each row's own cutoff, with an oracle by brute force.

Five scopes (user_id modulo 5), groups are users.  Outcomes are purchases of 150 or more, known 1 to 7
hours after they end; every tenth is withdrawn three days later.  Errors are incidents, views of 80 or
more rivals, clicks of 60 or more assert a range; each is known 0 to 80 minutes later, and every
fourth is revised after 30 hours to say nothing of that kind any more.  Signups are no evidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import time as tm
from tidemark.operators import asof_features, features, revisions
from tidemark.plans import training_queries
from tidemark.plans.metric_queries import r6
from tidemark.session import table


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type in ('error', 'view', 'click')")
    number = F.explode(F.when(F.col("event_id") % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    r = e.withColumn("revision", number).withColumn("available_at", tm.from_micros(tm.micros(F.col("ts")) + F.when(F.col("revision") == 1, F.col("event_id") % 5 * 20 * 60_000_000).otherwise(30 * tm.HOUR_US)))
    seen = revisions.validity(r, ["event_id"], "available_at", created=None)
    first = F.col("revision") == 1
    claims = first & (F.col("event_type") == "click") & (F.col("value") >= 60)
    return seen.select((F.col("user_id") % 5).alias("scope"), F.col("user_id").alias("group"), F.col("ts").alias("time"), "visible_from", "visible_to", (first & (F.col("event_type") == "error")).alias("incident"), (first & (F.col("event_type") == "view") & (F.col("value") >= 80)).alias("rival"), F.when(claims, tm.add_hours(F.col("ts"), 2)).alias("start"), F.when(claims, tm.add_hours(F.col("ts"), F.col("value") / 4)).alias("end"), F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(0.35).alias("weight"))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "events").filter("event_type = 'purchase' and value >= 150")
    to = F.col("ts") + F.expr("interval 90 minutes")
    known = tm.from_micros(tm.micros(to) + (F.col("event_id") % 7 + 1) * tm.HOUR_US)
    return o.select((F.col("user_id") % 5).alias("scope"), F.col("event_id").alias("outcome_id"), F.col("user_id").alias("group"), F.col("ts").alias("from_"), to.alias("to"), known.alias("visible_from"), F.when(F.col("event_id") % 10 == 0, F.col("ts") + F.expr("interval 3 days")).alias("visible_to"))


def asof_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = _outcomes(spark, sf_dir)
    cutoff = F.lit(training_queries.CUTOFF).cast("timestamp_ntz")
    labels = outcomes.filter((F.col("to") <= cutoff) & (F.col("visible_from") <= cutoff)).select("scope", "outcome_id", "group", "from_", "to", (F.coalesce(F.col("visible_to") <= cutoff, F.lit(False))).alias("ambiguous"))
    out = asof_features.asof_training_rows(training_queries.covered_slots(spark, sf_dir), labels, _evidence(spark, sf_dir), outcomes, ["scope"])
    return out.select("scope", "slot", "cutoff", "kind", "own_outcome", r6("exposure"), *[r6(c) for c in features.VECTOR])


QUERIES = {"asof_training_rows": asof_training_rows}

_CUT = f"TIMESTAMP '{training_queries.CUTOFF}'"
_WEIGHT = "CASE WHEN v.grp = l.lineage OR v.grp = t.own_group THEN 0 WHEN v.ts < l.anchor THEN 0.5 ELSE 1 END::DOUBLE"
_AGE = "(epoch_us(t.slot) - epoch_us(v.ts)) / 3.6e9"


def _ring(a: str, b: str, period: int) -> str:
    return f"least(abs({a} - ({b})), {period} - abs({a} - ({b})))"


_OF_DAY = "(hour({0}) + minute({0}) / 60.0::DOUBLE)"
_OF_WEEK = "((isodow({0}) - 1) * 24 + hour({0}) + minute({0}) / 60.0::DOUBLE)"

ORACLES = {
    "asof_training_rows": f"""WITH {training_queries.BASE}, {training_queries._SLOTS},
h AS (SELECT user_id % 5 AS scope, event_id AS id, user_id AS grp, ts AS f, ts + INTERVAL 90 MINUTE AS u, ts + INTERVAL 45 MINUTE AS mid, ts + INTERVAL 90 MINUTE + to_hours(CAST(event_id % 7 + 1 AS INTEGER)) AS seen, CASE WHEN event_id % 10 = 0 THEN ts + INTERVAL 3 DAY END AS gone FROM events WHERE event_type = 'purchase' AND value >= 150),
lb AS (SELECT *, coalesce(gone <= {_CUT}, false) AS odd FROM h WHERE u <= {_CUT} AND seen <= {_CUT}),
tt AS (SELECT *, CAST(date_trunc('hour', f) AS TIMESTAMP) + to_hours(CAST(k AS INTEGER)) AS slot FROM lb, range(3) r(k) WHERE CAST(date_trunc('hour', f) AS TIMESTAMP) + to_hours(CAST(k AS INTEGER)) < u),
t AS (SELECT scope, slot, slot AS cut, 'negative' AS kind, NULL::BIGINT AS own, NULL::BIGINT AS own_group, 1.0::DOUBLE AS exposure FROM c WHERE NOT EXISTS (SELECT 1 FROM tt WHERE tt.scope = c.scope AND tt.slot = c.slot)
  UNION ALL SELECT scope, slot, least(slot, CAST(date_trunc('hour', f) AS TIMESTAMP)), 'event', id, grp, (least(epoch_us(u), epoch_us(slot) + 3600000000) - greatest(epoch_us(f), epoch_us(slot))) / 3.6e9 FROM tt WHERE NOT odd),
k AS (SELECT t.scope, t.slot, t.own, h.*, row_number() OVER w AS n, h.mid - lag(h.mid) OVER w AS gap, last(h.mid) OVER (PARTITION BY t.scope, t.slot, t.own ORDER BY h.f, h.id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM t JOIN h ON h.scope = t.scope AND seen <= cut AND (gone IS NULL OR gone > cut) AND (t.own IS NULL OR t.own <> h.id) WINDOW w AS (PARTITION BY t.scope, t.slot, t.own ORDER BY h.f, h.id)),
l AS (SELECT scope, slot, own, coalesce(avg(CASE WHEN last <= slot AND gap IS NOT NULL THEN exp(-0.5 * pow(ln(1 + (epoch_us(slot) - epoch_us(last)) / 3.6e9) - ln(1 + epoch_us(TIMESTAMP '1970-01-01' + gap) / 3.6e9), 2)) END), 0)
    + avg(exp(-0.5 * pow({_ring(_OF_DAY.format('slot'), _OF_DAY.format('mid'), 24)} / 6, 2))) + 0.5 * avg(exp(-0.5 * pow({_ring(_OF_WEEK.format('slot'), _OF_WEEK.format('mid'), 168)} / 36, 2))) AS combined,
  max(u) FILTER (WHERE mid < slot) AS anchor, arg_max(grp, f) FILTER (WHERE mid < slot) AS lineage FROM k GROUP BY ALL),
ev AS (SELECT *, user_id % 5 AS scope, user_id AS grp, ts + to_minutes(CAST(event_id % 5 * 20 AS INTEGER)) AS seen, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 30 HOUR END AS gone FROM events WHERE event_type IN ('error', 'view', 'click')),
s AS (SELECT t.scope, t.slot, t.own, sum(CASE WHEN event_type = 'error' AND {_AGE} BETWEEN 0 AND 336 THEN pow(2, -{_AGE} / 24) * {_WEIGHT} END) AS i, max(CASE WHEN event_type = 'view' AND value >= 80 AND {_AGE} BETWEEN 0 AND 336 THEN pow(2, -{_AGE} / 36) * {_WEIGHT} END) AS r,
  sum(CASE WHEN event_type = 'click' AND value >= 60 AND v.ts + INTERVAL 2 HOUR < t.slot + INTERVAL 1 HOUR AND epoch_us(v.ts) + CAST(round(value / 4 * 3.6e9) AS BIGINT) > epoch_us(t.slot) THEN CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.35 END * {_WEIGHT} END) AS a
  FROM t JOIN ev v ON v.scope = t.scope AND v.seen <= t.cut AND (v.gone IS NULL OR v.gone > t.cut) LEFT JOIN l ON l.scope = t.scope AND l.slot = t.slot AND l.own IS NOT DISTINCT FROM t.own GROUP BY 1, 2, 3),
z AS (SELECT t.*, (isodow(t.slot) - 1) * 24 + hour(t.slot) AS p, hour(t.slot) AS q, coalesce(combined, 0) AS combined, coalesce(a, 0) AS a, coalesce(i, 0) AS i, coalesce(r, 0) AS r FROM t LEFT JOIN l ON l.scope = t.scope AND l.slot = t.slot AND l.own IS NOT DISTINCT FROM t.own LEFT JOIN s ON s.scope = t.scope AND s.slot = t.slot AND s.own IS NOT DISTINCT FROM t.own)
SELECT scope, slot, cut AS cutoff, kind, own AS own_outcome, round(exposure, 6) + 0.0 AS exposure, {', '.join(f'round({f}(2 * pi() * {k} * p / 168), 6) + 0.0 AS weekly_{f}_{k}' for k in (1, 2, 3) for f in ('sin', 'cos'))}, {', '.join(f'round({f}(2 * pi() * {k} * q / 24), 6) + 0.0 AS daily_{f}_{k}' for k in (1, 2) for f in ('sin', 'cos'))}, round(combined, 6) + 0.0 AS combined, round(a, 6) + 0.0 AS asserted, round(i, 6) + 0.0 AS incident_decay, round(r, 6) + 0.0 AS rival_decay FROM z""",
}
