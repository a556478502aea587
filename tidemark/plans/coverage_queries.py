"""Queries over coverage and labels that change with it, with their oracles.

A user's events of a day are the revisions of an assertion about that day: a view or purchase
vouches for it, a click speaks of outcomes only, an error revokes it.  It is made 30 hours after
its event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import time as tm
from tidemark.operators import coverage, intervals
from tidemark.session import table

CUTOFFS = ("2024-01-08 06:00:00", "2024-01-15 12:00:00", "2024-01-22 00:00:00", "2024-01-29 18:00:00")


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("start", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    w = Window.partitionBy("user_id", "start").orderBy("ts", "event_id")
    asserted = tm.add_hours(F.col("ts"), 30)
    eligible = F.col("event_type").isin("view", "purchase", "error")
    return e.select(
        F.concat_ws("@", F.col("user_id").cast("string"), tm.day_key(F.col("ts"))).alias("assertion_id"), "user_id", "event_id", F.row_number().over(w).alias("revision"), "start", (F.col("start") + F.expr("interval 1 day")).alias("end"), "ts",
        asserted.alias("asserted_at"), F.when(F.col("event_type") == "purchase", F.col("start") + F.expr("interval 26 hours")).alias("replay_available_at"), F.when(eligible, coverage.ELIGIBLE).otherwise("outcome_only").alias("adequacy"), (F.col("event_type") == "error").alias("revoked"), "event_type", "value",
    )


ASSERTIONS = """a AS (SELECT user_id || '@' || strftime(ts, '%Y-%m-%d') AS assertion_id, user_id, event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS revision,
  CAST(date_trunc('day', ts) AS TIMESTAMP) AS s, CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY AS e, ts, ts + INTERVAL 30 HOUR AS asserted_at, event_type, value, event_type IN ('view', 'purchase', 'error') AS eligible, event_type = 'error' AS revoked,
  CASE WHEN event_type = 'purchase' THEN CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 26 HOUR END AS replay_at FROM events)"""
_CUTOFFS = "k AS (SELECT unnest([" + ", ".join(f"TIMESTAMP '{c}'" for c in CUTOFFS) + "]) AS cutoff)"


def cutoffs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CUTOFFS], "c string").select(F.col("c").cast("timestamp_ntz").alias("cutoff"))


def _available(a: DataFrame, mode: str) -> DataFrame:
    known = coverage.assertion_available(mode, F.col("asserted_at"), F.col("replay_available_at"), F.col("event_type") == "purchase", F.col("start"), (F.col("revision") == 1) & (F.col("event_type") == "view"))
    return a.withColumn("available_at", known)


def assertion_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assertions(spark, sf_dir)
    live, archive, synthetic = (_available(a, m).select("event_id", F.col("available_at").alias(m)) for m in ("live", "archive_replay", "synthetic_replay"))
    return live.join(archive, "event_id").join(synthetic, "event_id")


def coverage_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged covered intervals of each user at four cutoffs, as an archive replay would have known them."""
    return coverage.covered_as_of(_available(assertions(spark, sf_dir), "archive_replay"), cutoffs(spark), ["user_id"])


def adequate_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage.adequate_as_of(_available(assertions(spark, sf_dir), "live"), cutoffs(spark))
    return out.select("cutoff", "assertion_id", "revision")


def assertion_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules for each assertion, some of which the shifted clocks break; its evidence is the hash of its event's type."""
    a = assertions(spark, sf_dir)
    shifted = {
        "start": F.col("start"), "end": F.when(F.col("event_id") % 17 == 0, F.col("start")).otherwise(F.col("end")), "asserted_at": tm.add_hours(F.col("ts"), F.col("value") / 5), "adequacy": F.when(F.col("event_id") % 19 == 0, "other").otherwise(F.col("adequacy")),
        "replay_available_at": F.col("replay_available_at"), "evidence_hash": F.concat(F.lit("sha256:"), F.when(F.col("value") > 20, F.sha2(F.col("event_type"), 256)).otherwise("none")), "exhausted_at": tm.add_hours(F.col("ts"), F.col("value") / 6),
    }
    rows = a.select("event_id", *[c.alias(k) for k, c in shifted.items()])
    return rows.select("event_id", F.array_join(coverage.assertion_faults({k: F.col(k) for k in shifted}), ",").alias("faults"))


def coverage_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions of each user in the order of arrival, which a third of them reach late."""
    e = table(spark, sf_dir, "events").withColumn("asserted", F.when(F.col("event_id") % 3 == 0, tm.add_hours(F.col("ts"), -48)).otherwise(F.col("ts")))
    return coverage.append_assertions(e, "user_id", "event_type", "asserted", "event_id").select("event_id", "outcome", "revision")


def coverage_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions whose evidence, a document's text, is missing or has another hash than they name, are revoked."""
    docs = table(spark, sf_dir, "documents")
    blobs = docs.select(F.col("doc_id").alias("ref"), F.coalesce("text", F.lit("")).alias("content"))
    named = docs.select(F.col("doc_id").alias("ref"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))
    a = assertions(spark, sf_dir).select("event_id", "revoked", (F.col("event_id") * 2).alias("ref"))
    a = a.join(named, "ref", "left").withColumn("digest", F.concat(F.lit("sha256:"), F.when(F.col("event_id") % 5 == 0, "0").otherwise(F.coalesce("h", F.lit("1")))))
    return coverage.verified_evidence(a.drop("h"), blobs, "ref", "digest").select("event_id", "revoked")


def multi_interval_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the day after each purchase is covered by its user's events, each of which covers 20 hours."""
    e = table(spark, sf_dir, "events")
    windows = e.filter("event_type = 'purchase'").select("user_id", "event_id", F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 1 day")).alias("end"))
    seen = e.select("user_id", F.col("ts").alias("from_"), (F.col("ts") + F.expr("interval 20 hours")).alias("to"))
    return coverage.cover_gaps(windows, seen, ["user_id"], ("start", "end"), ("from_", "to")).select("event_id", "covered")


def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'view'")
    return e.select("user_id", "event_id", F.date_sub(F.to_date("ts"), 3).alias("day"), F.col("ts").alias("seen"), F.when(F.col("value") > 60, "b").otherwise("a").alias("ledger"))


def day_maturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledgers of a day (here: of three days ago) as each view sees them."""
    out = coverage.matured_days(_sightings(spark, sf_dir), ["user_id"], "day", "seen", "ledger", 48.0, 3.0)
    return out.select("event_id", "status")


def recheck_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _sightings(spark, sf_dir).groupBy("user_id", "day").agg(F.min("seen").alias("first_seen"))
    return coverage.recheck_times(first, "day", "first_seen", 72.0, 6.0).select("user_id", F.col("recheck_at"))


def attestation_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attestations of the customers' orders, checked for a year against what each order's line needs."""
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate")
    row = {
        "hash": F.when(F.col("o_orderkey") % 11 != 0, F.sha2(F.col("o_orderpriority"), 256)), "target": F.col("o_orderstatus"), "identities": F.array(F.col("o_orderpriority"), F.lit("1-URGENT")),
        "valid_from": day, "valid_to": day + F.expr("interval 400 days"), "expires_at": day + F.expr("interval 900 days"),
    }
    found = coverage.attestation_reasons(row, F.lit("F"), F.array(F.lit("1-URGENT"), F.lit("5-LOW")), F.lit("1995-06-01").cast("timestamp_ntz"), F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-06-01").cast("timestamp_ntz"), F.sha2(F.lit("5-LOW"), 256))
    return o.select("o_orderkey", F.array_join(found, ",").alias("reasons"))


def replay_backdating(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = assertions(spark, sf_dir)
    seen = tm.add_hours(F.col("ts"), F.col("value") / 40 - 0.1)
    recorded = tm.add_hours(F.col("ts"), F.col("value") / 20)
    back = coverage.replay_backdating(F.col("revision") == 1, F.col("event_type") == "view", F.col("ts"), seen, recorded)
    return a.select("event_id", back.alias("replay_at"))


def settlement_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of each user's days at four cutoffs: a new revision only where the decision changes.

    A purchase of 100 or more by the user makes a day positive once it is two days old; a day is
    covered by what was asserted about it.
    """
    days = assertions(spark, sf_dir).groupBy("user_id", "start").agg(F.max("end").alias("end"))
    hits = table(spark, sf_dir, "events").filter("event_type = 'purchase' and value >= 100").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("start")).agg(tm.add_hours(F.min("ts"), 48).alias("known"))
    at = days.crossJoin(F.broadcast(cutoffs(spark)))  # four rows
    merged = coverage.covered_as_of(_available(assertions(spark, sf_dir), "live"), cutoffs(spark), ["user_id"])
    held = intervals.contained(at, merged.select("cutoff", "user_id", F.col("start").alias("cs"), F.col("end").alias("ce")), ["cutoff", "user_id"], ("start", "end"), ("cs", "ce")).select("cutoff", "user_id", "start", F.lit(True).alias("covered"))
    rows = at.join(hits, ["user_id", "start"], "left").join(held, ["cutoff", "user_id", "start"], "left")
    labelled = coverage.label_at(rows, "end", F.col("cutoff"), F.coalesce(F.col("known") <= F.col("cutoff"), F.lit(False)), F.lit(False), F.coalesce("covered", F.lit(False)))
    out = coverage.decision_revisions(labelled, ["user_id", "start"], "cutoff", ["status"])
    return out.select("user_id", "start", "cutoff", "status", "revision", "retracts")


QUERIES = {f.__name__: f for f in (assertion_availability, coverage_as_of, adequate_assertions, assertion_faults, coverage_append, coverage_evidence, multi_interval_cover, day_maturation, recheck_times, attestation_reasons, replay_backdating, settlement_revisions)}

_LATEST = """v AS (SELECT * FROM (SELECT k.cutoff, a.*, row_number() OVER (PARTITION BY k.cutoff, assertion_id ORDER BY revision DESC) AS rn FROM k JOIN a ON {available} <= k.cutoff) WHERE rn = 1 AND eligible AND NOT revoked)"""
_ISLANDS = """i AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY cutoff, user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM v),
j AS (SELECT *, sum(fresh) OVER (PARTITION BY cutoff, user_id ORDER BY s, e) AS g FROM i),
m AS (SELECT cutoff, user_id, min(s) AS s, max(e) AS e FROM j GROUP BY cutoff, user_id, g)"""

ORACLES = {
    "assertion_availability": f"WITH {ASSERTIONS} SELECT event_id, asserted_at AS live, coalesce(replay_at, asserted_at) AS archive_replay, CASE WHEN revision = 1 AND event_type = 'view' THEN s ELSE asserted_at END AS synthetic_replay FROM a",
    "coverage_as_of": f"WITH {ASSERTIONS}, {_CUTOFFS}, {_LATEST.format(available='coalesce(replay_at, asserted_at)')}, {_ISLANDS} SELECT cutoff, user_id, s AS start, e AS end FROM m",
    "adequate_assertions": f"WITH {ASSERTIONS}, {_CUTOFFS}, {_LATEST.format(available='asserted_at')} SELECT cutoff, assertion_id, revision FROM v",
    "assertion_faults": f"""WITH {ASSERTIONS}, x AS (SELECT event_id, s, CASE WHEN event_id % 17 = 0 THEN s ELSE e END AS e, epoch_us(ts) + CAST(round(value / 5 * 3.6e9) AS BIGINT) AS asserted, epoch_us(ts) + CAST(round(value / 6 * 3.6e9) AS BIGINT) AS exhausted, epoch_us(replay_at) AS replay, CASE WHEN event_id % 19 = 0 THEN 'other' WHEN eligible THEN 'yes' ELSE 'no' END AS adequacy, value > 20 AS hashed FROM a)
SELECT event_id, concat_ws(',', CASE WHEN s >= e THEN 'interval_empty' END, CASE WHEN epoch_us(e) > asserted THEN 'ends_after_assertion' END, CASE WHEN adequacy = 'other' THEN 'unknown_adequacy' END,
  CASE WHEN replay IS NOT NULL AND (adequacy <> 'yes' OR replay < epoch_us(e) OR replay > asserted) THEN 'replay_time_out_of_bounds' END,
  CASE WHEN adequacy = 'yes' AND NOT (hashed AND exhausted >= epoch_us(e) AND exhausted <= asserted) THEN 'completeness_evidence_missing' END) AS faults FROM x""",
    "coverage_append": """WITH x AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL 48 HOUR ELSE ts END AS asserted FROM events),
l AS (SELECT *, coalesce(max(asserted) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > asserted, false) AS late FROM x),
o AS (SELECT *, CASE WHEN late THEN 'out_of_order' WHEN event_type IS NOT DISTINCT FROM last_value(CASE WHEN NOT late THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'unchanged' ELSE 'appended' END AS outcome FROM l)
SELECT event_id, outcome, CASE WHEN outcome = 'appended' THEN CAST(sum(CASE WHEN outcome = 'appended' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) END AS revision FROM o""",
    "coverage_evidence": "SELECT e.event_id, e.event_type = 'error' OR d.doc_id IS NULL OR e.event_id % 5 = 0 AS revoked FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id * 2",
    "multi_interval_cover": """WITH w AS (SELECT event_id, user_id, ts AS s, ts + INTERVAL 1 DAY AS e FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts AS f, ts + INTERVAL 20 HOUR AS t FROM events),
g AS (SELECT event_id, w.s, w.e, f, t, max(t) OVER (PARTITION BY event_id ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w JOIN c ON c.user_id = w.user_id AND f < w.e AND t > w.s)
SELECT event_id, bool_and(f <= coalesce(reach, s)) AND max(t) >= min(e) AS covered FROM g GROUP BY event_id""",
    "day_maturation": """WITH x AS (SELECT event_id, user_id, CAST(ts AS DATE) - 3 AS d, ts, CASE WHEN value > 60 THEN 'b' ELSE 'a' END AS l FROM events WHERE event_type = 'view'),
c AS (SELECT *, ts >= CAST(d AS TIMESTAMP) + INTERVAL 69 HOUR AS counted FROM x),
h AS (SELECT *, counted AND l IS DISTINCT FROM lag(CASE WHEN counted THEN l END) OVER w AS changed FROM c WINDOW w AS (PARTITION BY user_id, d ORDER BY ts, l)),
r AS (SELECT *, sum(CAST(changed AS INTEGER)) OVER (PARTITION BY user_id, d ORDER BY ts, l ROWS UNBOUNDED PRECEDING) AS run FROM h),
f AS (SELECT *, counted AND ts >= min(CASE WHEN counted THEN ts END) OVER (PARTITION BY user_id, d, run) + INTERVAL 3 HOUR AND ts >= CAST(d AS TIMESTAMP) + INTERVAL 72 HOUR AS stable FROM r),
b AS (SELECT *, coalesce(lag(stable) OVER (PARTITION BY user_id, d ORDER BY ts, l), false) AS was FROM f)
SELECT event_id, CASE WHEN NOT counted THEN 'early' WHEN changed AND was THEN 'revoked' WHEN stable THEN 'eligible' ELSE 'candidate' END AS status FROM b""",
    "recheck_times": "SELECT user_id, greatest(min(ts) + INTERVAL 6 HOUR, CAST(CAST(ts AS DATE) - 3 AS TIMESTAMP) + INTERVAL 96 HOUR) AS recheck_at FROM events WHERE event_type = 'view' GROUP BY user_id, CAST(ts AS DATE)",
    "attestation_reasons": """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 11 = 0 THEN 'attestation_missing' END, CASE WHEN o_orderkey % 11 <> 0 AND o_orderpriority <> '5-LOW' THEN 'hash_not_pinned' END, CASE WHEN o_orderstatus <> 'F' THEN 'target_mismatch' END,
  CASE WHEN o_orderpriority <> '5-LOW' THEN 'identities_missing' END, CASE WHEN o_orderdate > TIMESTAMP '1995-06-01' OR o_orderdate + INTERVAL 400 DAY < TIMESTAMP '1996-01-01' THEN 'interval_not_contained' END, CASE WHEN o_orderdate + INTERVAL 900 DAY <= TIMESTAMP '1997-06-01' THEN 'attestation_expired' END) AS reasons FROM orders""",
    "replay_backdating": f"""WITH {ASSERTIONS}, x AS (SELECT *, epoch_us(ts) AS p, epoch_us(ts) + CAST(round((value / 40 - 0.1) * 3.6e9) AS BIGINT) AS q, epoch_us(ts) + CAST(round(value / 20 * 3.6e9) AS BIGINT) AS r FROM a)
SELECT event_id, CASE WHEN revision = 1 AND event_type = 'view' AND p <= q AND q <= r AND q - p <= 3600000000 AND r - q <= 3600000000 THEN ts END AS replay_at FROM x""",
    "settlement_revisions": f"""WITH {ASSERTIONS}, {_CUTOFFS}, {_LATEST.format(available='asserted_at')}, {_ISLANDS},
d AS (SELECT user_id, s, max(e) AS e FROM a GROUP BY user_id, s), h AS (SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS s, min(ts) + INTERVAL 48 HOUR AS known FROM events WHERE event_type = 'purchase' AND value >= 100 GROUP BY 1, 2),
l AS (SELECT d.user_id, d.s, k.cutoff, CASE WHEN d.e > k.cutoff THEN 'pending' WHEN h.known <= k.cutoff THEN 'positive' WHEN EXISTS (SELECT 1 FROM m WHERE m.cutoff = k.cutoff AND m.user_id = d.user_id AND m.s <= d.s AND m.e >= d.e) THEN 'negative' ELSE 'censored' END AS status FROM d CROSS JOIN k LEFT JOIN h ON h.user_id = d.user_id AND h.s = d.s),
p AS (SELECT *, lag(status) OVER (PARTITION BY user_id, s ORDER BY cutoff) AS before FROM l)
SELECT user_id, s AS start, cutoff, status, row_number() OVER (PARTITION BY user_id, s ORDER BY cutoff) AS revision, before AS retracts FROM p WHERE before IS NULL OR before <> status""",
}
