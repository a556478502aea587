"""Queries over revisions, references and intervals, with their oracles.

A user's events are a revision chain (record_id, revision by time); an event is available some
hours after it was created, later ones sometimes earlier.  An event also covers six hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import time as tm
from tidemark.operators import intervals, revisions
from tidemark.session import table


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("record_id"), F.row_number().over(w).alias("revision"), F.col("ts").alias("created_at"), tm.add_hours(F.col("ts"), (F.col("event_id") * 13 % 97).cast("double")).alias("known_at"), tm.add_hours(F.col("ts"), F.lit(-5.0)).alias("replay_at"), "event_id", "event_type", "value")


CHAIN = """chain AS (SELECT user_id AS record_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS revision, ts AS created_at,
  ts + to_hours(CAST(event_id * 13 % 97 AS INTEGER)) AS known_at, ts - INTERVAL 5 HOUR AS replay_at, event_id, event_type, value FROM events)"""

COVER = "cover AS (SELECT user_id, event_id, event_type, ts AS s, ts + INTERVAL 6 HOUR AS e FROM events)"


def _cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", "event_type", F.col("ts").alias("s"), (F.col("ts") + F.expr("interval 6 hours")).alias("e"))


def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.latest_by(chain(spark, sf_dir), ["record_id"], ["revision"]).select("record_id", "revision", "event_id")


def latest_as_of_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cutoffs = spark.range(10).select((F.lit("2024-01-03").cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int") * 2)).alias("cutoff"))
    found = revisions.as_of_cutoffs(chain(spark, sf_dir), cutoffs, ["record_id"], "known_at")
    return found.select("cutoff", "record_id", "revision", "event_id")


def latest_by_availability_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chain(spark, sf_dir)
    seen = revisions.available_at("archive_replay", F.col("known_at"), F.col("replay_at"), F.col("revision"))
    found = revisions.as_of(rows.withColumn("available_at", seen), F.lit("2024-01-10").cast("timestamp_ntz"), ["record_id"], "available_at", created=None)
    return found.select("record_id", "revision", "event_id")


def exact_ref_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") % 200).alias("record_id"), (F.col("o_orderkey") % 90 + 1).cast("int").alias("revision"))
    return revisions.exact_refs(chain(spark, sf_dir), refs, ["record_id", "revision"]).select("pos", "record_id", "revision", "event_id")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = chain(spark, sf_dir).select("record_id", "revision", "event_id", "event_type", F.sha2(F.concat_ws("|", "event_id", "event_type"), 256).alias("digest"))
    stored = rows.filter("event_id % 2 = 0")
    bent = F.when(F.col("event_id") % 10 == 0, F.sha2(F.concat(F.lit("x"), F.col("digest")), 256)).otherwise(F.col("digest"))
    return stored, rows.filter("event_id % 3 = 0").withColumn("digest", bent)


def append_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, incoming = _halves(spark, sf_dir)
    return revisions.split_append(incoming, stored, ["record_id", "revision"], "digest").select("record_id", "revision", "event_id", "outcome")


def append_or_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chain(spark, sf_dir).select("record_id", "revision", "event_id", "event_type")
    stored = revisions.latest_by(rows.filter("event_type = 'purchase' and record_id % 2 = 0"), ["record_id"], ["revision"])
    incoming = revisions.latest_by(rows, ["record_id"], ["revision"])
    return revisions.append_or_reuse(incoming, stored, "record_id").select("record_id", "revision", "event_id", "reused")


def change_detect_scd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chain(spark, sf_dir).withColumn("digest", F.col("event_type")).withColumn("first_seen_at", F.col("created_at"))
    stored = revisions.latest_by(rows.filter("created_at < timestamp_ntz'2024-01-15'"), ["record_id"], ["revision"])
    incoming = revisions.latest_by(rows, ["record_id"], ["revision"])
    out = revisions.changed_revisions(incoming, stored, "record_id", "digest", "first_seen_at")
    return out.select("record_id", "revision", "supersedes", "first_seen_at", "event_id")


def interval_merge_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_intervals(_cover(spark, sf_dir), ["user_id"], "s", "e")


def _whole_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cover(spark, sf_dir).withColumn("s", tm.floor_hour(F.col("s"))).withColumn("e", F.col("s") + F.expr("interval 2 hours")).withColumn("event", F.col("event_type") == "purchase")


def interval_merge_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert episodes: windows that only touch stay apart; does any hold an event?"""
    return intervals.merge_intervals(_whole_hours(spark, sf_dir), ["user_id"], "s", "e", touching=False, flags=["event"])


def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cover(spark, sf_dir)
    errors = rows.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("s").alias("es"), F.col("e").alias("ee"))
    bought = rows.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("s").alias("ps"), F.col("e").alias("pe"))
    return intervals.overlap_join(errors, bought, ["user_id"], ("es", "ee"), ("ps", "pe"), 6).select("user_id", "error_id", "purchase_id")


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'click'")
    return e.select("user_id", F.col("event_id").alias("window_id"), F.col("ts").alias("ws"), (F.col("ts") + F.expr("interval 2 hours")).alias("we"))


def _errors_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = intervals.merge_intervals(_cover(spark, sf_dir).filter("event_type <> 'click'"), ["user_id"], "s", "e")
    return merged.select("user_id", F.col("s").alias("ms"), F.col("e").alias("me"))


def interval_containment_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.contained(_windows(spark, sf_dir), _errors_merged(spark, sf_dir), ["user_id"], ("ws", "we"), ("ms", "me")).select("user_id", "window_id")


def interval_exposure_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = intervals.exposure_hours(_windows(spark, sf_dir), _errors_merged(spark, sf_dir), ["user_id"], ["user_id", "window_id"], ("ws", "we"), ("ms", "me"), 6)
    return out.select("user_id", "window_id", F.round("covered_hours", 6).alias("covered_hours"))


def consumed_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks that no later purchase of the user within a day consumes."""
    e = table(spark, sf_dir, "events")
    out = intervals.next_after(e, ["user_id"], "ts", "event_id", F.col("event_type") == "purchase", "next_purchase")
    live = F.col("next_purchase").isNull() | (F.col("next_purchase") > F.col("ts") + F.expr("interval 24 hours"))
    return out.filter((F.col("event_type") == "click") & live).select("user_id", "event_id")


def asof_latest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    bought = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought_at"), F.col("event_id").alias("purchase_id"))
    errors = e.filter("event_type = 'error'").select("user_id", "event_id", "ts")
    return intervals.asof_join(errors, bought, ["user_id"], "ts", "bought_at", ["bought_at", "purchase_id"]).select("user_id", "event_id", "purchase_id")


def leakage_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence before each purchase without what confirms it: its own record and its group until they are known."""
    e = table(spark, sf_dir, "events")
    targets = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("target_id"), F.col("ts").alias("ts_target"), (F.col("event_id") % 5).alias("target_group"), (F.col("ts") - F.expr("interval 12 hours")).alias("from"))
    proof = e.filter("event_type <> 'purchase'").select("user_id", "event_id", F.col("ts").alias("at"), (F.col("ts") + F.expr("interval 1 microsecond")).alias("until"), (F.col("event_id") % 5).alias("group"))
    pairs = intervals.overlap_join(targets, proof, ["user_id"], ("from", "ts_target"), ("at", "until"), 12)
    return pairs.filter(F.col("group") != F.col("target_group")).groupBy("target_id").agg(F.count(F.lit(1)).alias("evidence"))


def ranked_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best evidence of each user and day: by type rank, then value, then time."""
    e = table(spark, sf_dir, "events")
    rank = F.element_at(F.create_map(*[x for k, v in (("purchase", 4), ("signup", 3), ("click", 2), ("view", 1)) for x in (F.lit(k), F.lit(v))]), F.col("event_type"))
    rows = e.withColumn("day", tm.day_key(F.col("ts"))).withColumn("rank", F.coalesce(rank, F.lit(0)))
    return revisions.latest_by(rows.select("user_id", "day", "rank", "value", "ts", "event_id"), ["user_id", "day"], ["rank", "value", "ts", "event_id"]).select("user_id", "day", "event_id")


def current_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("day", tm.day_key(F.col("ts"))).select("user_id", "day", "ts", "event_id", "event_type")
    return revisions.current_then_filter(rows, ["user_id", "day"], ["ts", "event_id"], F.col("event_type") != "error").select("user_id", "day", "event_id")


def nested_evidence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines (nested evidence) meet returned parts: the best line of each supplier nation."""
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_suppkey", "l_quantity")
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey").join(nations, "l_suppkey")
    best = revisions.latest_by(rows.select("o_orderkey", "nation", "l_linenumber", "l_quantity"), ["o_orderkey", "nation"], ["l_quantity", -F.col("l_linenumber")])
    return best.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("roots"), F.min("l_linenumber").cast("int").alias("first_line"))


def ambiguous_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    eligible = e.filter("value >= 50")
    return e.filter("event_type = 'purchase'").join(eligible.select("event_id"), "event_id", "left_anti").select("user_id", "event_id")


def union_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    both = e.filter("event_type = 'error'").withColumn("tier", F.lit("a")).unionByName(e.filter("event_type in ('error', 'view') and event_id % 4 = 0").withColumn("tier", F.lit("b")))
    return both.groupBy("event_id").agg(F.max("tier").alias("tier"), F.count(F.lit(1)).alias("copies"))


def reference_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference of a line must name something: what would be missing had the store lost some rows."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    parts = table(spark, sf_dir, "part").filter("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("l_partkey"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    out = None
    for name, store in (("l_orderkey", orders), ("l_partkey", parts), ("l_suppkey", suppliers)):
        missing = revisions.unresolved(lines.select(name), store, [name]).select(F.lit(name).alias("reference"), F.col(name).alias("id"))
        out = missing if out is None else out.unionByName(missing)
    return out


def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return rows.cube("o_orderstatus", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (latest_revision, latest_as_of_cutoffs, latest_by_availability_replay, exact_ref_lookup, append_conflicts, append_or_reuse, change_detect_scd2, interval_merge_touching, interval_merge_strict, interval_overlap_join, interval_containment_semi, interval_exposure_hours, consumed_anti_join, asof_latest_before, leakage_exclusion, ranked_dedup, current_then_filter, nested_evidence_join, ambiguous_except, union_partitions, reference_closure, grouping_sets)}

_ISLANDS = """m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {0}),
i AS (SELECT *, sum(CASE WHEN r IS NULL OR s {1} r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)"""
_MERGED = f"WITH {COVER}, other AS (SELECT * FROM cover WHERE event_type <> 'click'), {_ISLANDS.format('other', '>')}, merged AS (SELECT user_id, min(s) AS ms, max(e) AS me FROM i GROUP BY user_id, k), win AS (SELECT user_id, event_id AS window_id, ts AS ws, ts + INTERVAL 2 HOUR AS we FROM events WHERE event_type = 'click')"

ORACLES = {
    "latest_revision": f"WITH {CHAIN} SELECT record_id, max(revision) AS revision, max_by(event_id, revision) AS event_id FROM chain GROUP BY record_id",
    "latest_as_of_cutoffs": f"WITH {CHAIN}, c AS (SELECT TIMESTAMP '2024-01-03' + to_days(CAST(2 * i AS INTEGER)) AS cutoff FROM range(10) t(i)) SELECT cutoff, record_id, max(revision) AS revision, max_by(event_id, revision) AS event_id FROM c JOIN chain ON known_at <= cutoff AND created_at <= cutoff GROUP BY cutoff, record_id",
    "latest_by_availability_replay": f"WITH {CHAIN} SELECT record_id, max(revision) AS revision, max_by(event_id, revision) AS event_id FROM chain WHERE (CASE WHEN revision = 1 THEN replay_at ELSE known_at END) <= TIMESTAMP '2024-01-10' GROUP BY record_id",
    "exact_ref_lookup": f"WITH {CHAIN} SELECT o_orderkey AS pos, record_id, revision, event_id FROM orders JOIN chain ON record_id = o_custkey % 200 AND revision = o_orderkey % 90 + 1",
    "append_conflicts": f"WITH {CHAIN} SELECT record_id, revision, event_id, CASE WHEN event_id % 2 = 1 THEN 'insert' WHEN event_id % 10 = 0 THEN 'conflict' ELSE 'duplicate' END AS outcome FROM chain WHERE event_id % 3 = 0",
    "append_or_reuse": f"WITH {CHAIN}, l AS (SELECT record_id, max(revision) AS revision, max_by(event_id, revision) AS event_id FROM chain GROUP BY record_id), p AS (SELECT record_id, max(revision) AS revision, max_by(event_id, revision) AS event_id FROM chain WHERE event_type = 'purchase' AND record_id % 2 = 0 GROUP BY record_id) SELECT l.record_id, coalesce(p.revision, l.revision) AS revision, coalesce(p.event_id, l.event_id) AS event_id, p.record_id IS NOT NULL AS reused FROM l LEFT JOIN p ON l.record_id = p.record_id",
    "change_detect_scd2": f"WITH {CHAIN}, a AS (SELECT record_id, max(revision) AS revision, max_by(event_type, revision) AS t, max_by(created_at, revision) AS f FROM chain WHERE created_at < TIMESTAMP '2024-01-15' GROUP BY record_id), b AS (SELECT record_id, max_by(event_type, revision) AS t, max_by(created_at, revision) AS f, max_by(event_id, revision) AS event_id FROM chain GROUP BY record_id) SELECT b.record_id, coalesce(a.revision, 0) + 1 AS revision, a.revision AS supersedes, coalesce(a.f, b.f) AS first_seen_at, b.event_id FROM b LEFT JOIN a ON a.record_id = b.record_id WHERE a.t IS NULL OR a.t <> b.t",
    "interval_merge_touching": f"WITH {COVER}, {_ISLANDS.format('cover', '>')} SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n FROM i GROUP BY user_id, k",
    "interval_merge_strict": f"WITH w AS (SELECT user_id, date_trunc('hour', ts) AS s, date_trunc('hour', ts) + INTERVAL 2 HOUR AS e, event_type = 'purchase' AS event FROM events), {_ISLANDS.format('w', '>=')} SELECT user_id, min(s) AS s, max(e) AS e, count(*) AS n, bool_or(event) AS event FROM i GROUP BY user_id, k",
    "interval_overlap_join": f"WITH {COVER} SELECT a.user_id, a.event_id AS error_id, b.event_id AS purchase_id FROM cover a JOIN cover b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND a.s < b.e AND a.e > b.s",
    "interval_containment_semi": f"{_MERGED} SELECT user_id, window_id FROM win WHERE EXISTS (SELECT 1 FROM merged WHERE merged.user_id = win.user_id AND ms <= ws AND me >= we)",
    "interval_exposure_hours": f"{_MERGED} SELECT win.user_id, window_id, round(coalesce(sum(CASE WHEN ms IS NULL THEN 0 ELSE epoch_us(least(we, me)) - epoch_us(greatest(ws, ms)) END), 0) / 3.6e9, 6) AS covered_hours FROM win LEFT JOIN merged ON merged.user_id = win.user_id AND ms < we AND me > ws GROUP BY win.user_id, window_id",
    "consumed_anti_join": "SELECT user_id, event_id FROM events a WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND (b.ts > a.ts OR b.ts = a.ts AND b.event_id > a.event_id) AND b.ts <= a.ts + INTERVAL 24 HOUR)",
    "asof_latest_before": "SELECT e.user_id, e.event_id, max_by(p.event_id, (p.ts, p.event_id)) AS purchase_id FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts < e.ts WHERE e.event_type = 'error' GROUP BY e.user_id, e.event_id",
    "leakage_exclusion": "SELECT t.event_id AS target_id, count(*) AS evidence FROM events t JOIN events p ON p.user_id = t.user_id AND t.event_type = 'purchase' AND p.event_type <> 'purchase' AND p.ts < t.ts AND p.ts + INTERVAL 1 MICROSECOND > t.ts - INTERVAL 12 HOUR AND p.event_id % 5 <> t.event_id % 5 GROUP BY t.event_id",
    "ranked_dedup": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, max_by(event_id, (CASE event_type WHEN 'purchase' THEN 4 WHEN 'signup' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END, value, ts, event_id)) AS event_id FROM events GROUP BY user_id, day",
    "current_then_filter": "WITH c AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS t FROM events GROUP BY user_id, day) SELECT user_id, day, event_id FROM c WHERE t <> 'error'",
    "nested_evidence_join": "WITH r AS (SELECT o_orderkey, s_nationkey AS nation, l_linenumber, row_number() OVER (PARTITION BY o_orderkey, s_nationkey ORDER BY l_quantity DESC, l_linenumber) AS k FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R') SELECT o_orderkey, count(*) AS roots, CAST(min(l_linenumber) AS INTEGER) AS first_line FROM r WHERE k = 1 GROUP BY o_orderkey",
    "ambiguous_except": "SELECT user_id, event_id FROM events WHERE event_type = 'purchase' AND NOT value >= 50",
    "union_partitions": "WITH u AS (SELECT event_id, 'a' AS tier FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'b' FROM events WHERE event_type IN ('error', 'view') AND event_id % 4 = 0) SELECT event_id, max(tier) AS tier, count(*) AS copies FROM u GROUP BY event_id",
    "reference_closure": "SELECT DISTINCT 'l_orderkey' AS reference, l_orderkey AS id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0) UNION ALL SELECT DISTINCT 'l_partkey', l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 11 <> 0) UNION ALL SELECT DISTINCT 'l_suppkey', l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)",
    "grouping_sets": "SELECT o_orderstatus, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (o_orderstatus, c_mktsegment)",
}
