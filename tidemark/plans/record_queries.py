"""Queries over records, their rules and the predicates on them, with their oracles.

An event is a record of its user; what the tables lack (roles, hashes, contracts) follows by rule
from its columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import arrays, hashing
from tidemark.functions import time as tm
from tidemark.operators import records
from tidemark.plans.metric_queries import r6
from tidemark.session import table

NOW = "2024-01-25"


def _now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def record_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _events(spark, sf_dir).withColumn("revision", F.row_number().over(w))
    own = records.envelope("normalized_signal", "sig", F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.col("ts"), ("normalizer", "1.0"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")), F.struct("value"), F.col("revision"))
    return e.select("event_id", own.alias("r")).select("event_id", "r.record_type", "r.record_id", "r.revision", F.col("r.supersedes.revision").alias("supersedes"), "r.created_at", "r.producer.config_hash", "r.data.value")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    relation = F.struct(F.when(F.col("doc_id") % 3 == 0, "reply").alias("type"), (F.col("doc_id") / 2).cast("long").alias("target"))
    items = docs.select(F.col("doc_id").alias("item_id"), F.concat(F.lit("https://example.org/"), "source").alias("url"), F.lit("2024-01-01 00:00:00.5").cast("timestamp_ntz").alias("published"), _now().alias("seen"), "text", F.col("lang").alias("language"), F.when(F.col("doc_id") % 2 == 0, F.array(relation)).alias("relations"))
    out = records.observation(items, "archive")
    return out.select("item_id", "published_at", "content_hash", F.col("material_hash").startswith("sha256:").alias("hashed"), F.size("relations").alias("n_relations"), F.get("relations", F.lit(0))["type"].alias("first_type"))


def record_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "quantity_positive": F.col("l_quantity") > 0,
        "quantity_most": F.col("l_quantity") <= 45,
        "discount_range": F.col("l_discount").between(0, 0.08),
        "known_flag": F.col("l_returnflag").isin("A", "N", "R"),
        "shipped": F.col("l_shipdate") < F.lit("1998-06-01").cast("timestamp_ntz"),
    }
    lines = table(spark, sf_dir, "lineitem").withColumn("line", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")))
    return records.violations(lines, "line", rules).groupBy("line", "rule").agg(F.count(F.lit(1)).alias("n"))


def episode_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of episodes: a user's events, an error being a resolution and some pressures out of range."""
    w = Window.partitionBy("user_id")
    e = _events(spark, sf_dir).withColumns({"first_at": F.min("ts").over(w), "last_at": F.max("ts").over(w)})
    e = e.select("event_id", F.when(F.col("event_type") == "error", "resolved").when(F.col("event_type") == "view", "odd").otherwise("active").alias("state"), F.when(F.col("value") > 90, "up").otherwise("stable").alias("trend"), (F.col("value") / 120).alias("pressure"), "first_at", "last_at", F.when(F.col("value") > 5, F.col("ts")).alias("resolved_at"), F.col("ts").alias("as_of"), F.when(F.col("event_id") % 9 != 0, F.array("event_type", F.lit("view"))).otherwise(F.array().cast("array<string>")).alias("roots"))
    return records.violations(e, "event_id", records.episode_rules(("active", "resolved", "reopened"), ("rising", "stable", "falling")))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    kind = F.when(F.col("event_type").isin("purchase", "view"), "quota_reset").when(F.col("event_type") == "click", "quota_refill").otherwise(F.col("event_type"))
    ranged = F.col("value") > 20
    return e.select(
        F.col("event_id").alias("signal_id"), "user_id", F.col("ts").alias("published"), kind.alias("event_type"), F.when(F.col("value") > 60, "scheduled").otherwise("expected").alias("phase"), F.when(F.col("user_id") % 3 == 0, "official").otherwise("community").alias("role"),
        F.lit("primary_statement").alias("derivation"), F.lit("text/plain").alias("media_type"), (F.col("event_id") % 5 != 0).alias("eligible"), (F.col("event_id") % 7 == 0).alias("synthetic"), F.lit("supports").alias("stance"), F.col("event_type").isin("purchase", "click").alias("in_target"),
        F.when(ranged, tm.add_hours(F.col("ts"), 2)).alias("range_start"), F.when(ranged, tm.add_hours(F.col("ts"), F.col("value"))).alias("range_end"), F.when(F.col("event_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))).alias("products"),
    )


def timing_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _signals(spark, sf_dir)
    return s.select("signal_id", records.timing_candidate({c: F.col(c) for c in s.columns}, ["official"], ["scheduled", "expected"]).alias("candidate"))


def active_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals active at a time; purchases of 80 or more are outcomes that use up earlier signals of their user."""
    outcomes = _events(spark, sf_dir).filter("event_type = 'purchase' and value >= 80").select("user_id", tm.add_hours(F.col("ts"), 1).alias("ended"), F.when(F.col("event_id") % 3 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("products"))
    return records.active_signals(_signals(spark, sf_dir), outcomes, ["user_id"], _now()).select("signal_id")


def contract_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    own = F.struct(F.col("c_mktsegment").alias("segment"), (F.col("c_nationkey") % 3).alias("version"), F.when(F.col("c_acctbal") > 0, "x").alias("note"))
    return c.select("c_custkey", records.same_contract(own, {"segment": "BUILDING", "version": 1, "note": None}).alias("matches"), records.same_contract(own, None).alias("any"))


def target_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    several = F.when(F.col("p_size") % 2 == 0, F.array(F.col("p_brand"), F.lit("Brand#11"), F.col("p_brand")))
    scope = {"vendor": F.substring("p_type", 1, 3), "population": F.when(F.col("p_size") > 10, "all").otherwise("few"), "product": F.col("p_brand"), "products": several}
    return p.select("p_partkey", records.in_target(scope, "STA", "Brand#11", "all").alias("in_target"), F.array_join(records.products_of(F.col("p_brand"), several), ",").alias("products"))


def primary_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = tm.add_hours(F.col("ts"), F.col("value"))
    ok = records.primary_evidence(F.col("event_type"), F.col("ts"), later, F.when(F.col("event_id") % 4 == 0, tm.add_hours(F.col("ts"), 100)), F.col("ts"), F.lit("2024-01-15").cast("timestamp_ntz"), ["view", "click"])
    return _events(spark, sf_dir).select("event_id", ok.alias("allowed"))


def eligible_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes (orders) verified by exact revisions of their lines, current ones being those with the largest number."""
    lines = table(spark, sf_dir, "lineitem")
    part = F.struct(F.col("l_partkey").alias("observation"), F.col("l_linenumber").alias("revision"), F.col("l_returnflag").alias("contract"))
    verified = lines.groupBy(F.col("l_orderkey").alias("outcome_id")).agg(F.collect_list(part).alias("verification"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("outcome_id"), F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("open").alias("status"))
    current = lines.groupBy(F.col("l_partkey").alias("observation")).agg(F.max("l_linenumber").alias("revision"))
    signals = lines.select(F.col("l_partkey").alias("observation"), F.col("l_returnflag").alias("contract"), F.when(F.col("l_quantity") > 25, "completed").otherwise("expected").alias("phase"))
    return records.eligible_outcomes(orders.join(verified, "outcome_id"), current, signals)


def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 rows of orders that a history shows first, with the customer as source where it is known."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("outcome_id"), F.lit(1).alias("revision"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("interval 1 day")).alias("end"), tm.add_hours(F.col("o_orderdate"), F.col("o_totalprice") % 50).alias("known_at"), F.col("o_custkey").alias("observation"))
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("observation"), F.col("c_name").alias("url"), F.col("c_mktsegment").alias("author"))
    return records.history_rows(o, c).limit(40).select("outcome_id", "start", F.col("source.url").alias("url"), F.col("source").isNotNull().alias("known_source"))


def evidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six latest events of each tier, known by now or pending."""
    e = _events(spark, sf_dir).withColumn("tier", records.evidence_tier(F.col("event_type") == "error", F.col("event_type") == "view", F.col("value") > 50))
    out = records.per_tier(e, "tier", [F.desc("ts"), F.col("event_id")], "ts", _now())
    return out.select("event_id", "tier", "part", "rank")


def evaluation_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots (users) of event revisions, some of which are gone or superseded."""
    e = _events(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    chain = e.select(F.col("user_id").alias("record_id"), F.row_number().over(w).alias("revision"))
    named = e.select((F.col("event_id") % 40).alias("snapshot"), F.col("user_id").alias("record_id"), (F.col("event_id") % 30 + 1).cast("int").alias("revision"))
    out = records.compatibility_reasons(named, chain, "snapshot")
    return out.select("snapshot", F.array_join("reasons", ",").alias("reasons"), "compatible")


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status row from the state of three tables."""
    from tidemark.operators.coverage import reasons

    fresh = _events(spark, sf_dir).agg(F.max("ts").alias("last_event")).withColumn("blockers", reasons({"events_stale": F.col("last_event") < F.lit("2024-02-10").cast("timestamp_ntz")}))
    sample = table(spark, sf_dir, "labels").agg(F.count("quality").alias("labelled")).withColumn("blockers", reasons({"too_few_labels": F.col("labelled") < 50, "no_labels": F.col("labelled") == 0}))
    vectors = table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("vectors")).withColumn("blockers", reasons({"too_few_vectors": F.col("vectors") < 10_000}))
    return records.readiness([fresh, sample, vectors]).select("last_event", "labelled", "vectors", F.array_join("blockers", ",").alias("blockers"), "status")


def readiness_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored blockers of each event, those that depend on time judged anew."""
    stored = F.array_compact(F.array(F.when(F.col("value") > 30, F.lit("stale")), F.when(F.col("event_type") == "error", F.lit("failed")), F.when(F.col("event_id") % 2 == 0, F.lit("expired"))))
    age = tm.hours_between(_now(), F.col("ts"))
    now = records.with_time_blockers(stored, {"stale": age > 300, "expired": age > 600})
    served = records.serving_current(age, 24.0, F.col("event_type") != "click", F.col("event_id") % 3 != 0)
    return _events(spark, sf_dir).select("event_id", F.array_join(F.array_sort(now), ",").alias("blockers"), served.alias("served"))


def operator_confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = F.when(F.col("event_id") % 3 == 0, tm.add_hours(F.col("ts"), 1)).otherwise(F.col("ts"))
    o = {"producer": F.when(F.col("event_type") == "purchase", "console").otherwise("feed"), "text": F.col("event_type"), "content_hash": F.when(F.col("value") > 10, hashing.label(F.col("event_type"))).otherwise("x"), "media_type": F.lit("text/plain"), "relations": F.col("event_id") % 2, "url": F.when(F.col("event_id") % 5 == 0, "u"), "published": F.col("ts"), "seen": F.col("ts"), "fetched": same, "created": same}
    return _events(spark, sf_dir).select("event_id", records.operator_confirmation(o, "console").alias("confirmed"))


def impact_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    ok = records.impact_policy({"contract": F.col("p_brand"), "size": F.col("p_size").cast("double"), "ttl": F.when(F.col("p_size") > 10, 24.0)}, "Brand#10", {"ttl": 24.0})
    return p.select("p_partkey", ok.alias("matches"))


def canonical_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    doc = F.concat(F.lit('{"z": [1.0, {"b": 2, "a": '), F.col("event_id").cast("string"), F.lit('}], "a": '), "props", F.when(F.col("event_id") % 10 == 0, "").otherwise("}"))
    return e.select("event_id", records.canonical_document(doc).alias("canonical"), hashing.label(F.col("props")).alias("props_hash"))


def nested_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in JSON texts, by event: two levels deep, with some that are none."""
    e = _events(spark, sf_dir)
    ref = F.concat(F.lit('{"record_id": "u'), F.col("user_id").cast("string"), F.lit('", "revision": '), (F.col("event_id") % 4).cast("string"), F.lit("}"))
    doc = F.concat(F.lit('{"a": ['), ref, F.lit(', {"x": {"y": '), ref, F.lit('}}], "b": {"record_id": 7, "revision": 1}, "c": '), F.when(F.col("event_type") == "view", "null").otherwise("{}"), F.lit("}"))
    found = e.select("event_id", F.posexplode(records.exact_references(doc)).alias("pos", "r"))
    return found.select("event_id", "pos", "r.record_id", "r.revision")


def quarantine_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    text = F.when(F.col("event_type") == "error", F.lit("not json")).when(F.col("event_type") == "view", F.lit("[1]")).otherwise(F.concat(F.lit('{"reason": "'), "event_type", F.lit('", "item": '), F.col("event_id").cast("string"), F.lit("}")))
    q = records.quarantined(text)
    return e.select("event_id", q.isNotNull().alias("readable"), q["reason"].alias("reason"), q["item"].alias("item"))


def health_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags and numbers of JSON health reports: true, false, missing, or unreadable."""
    e = _events(spark, sf_dir)
    text = F.when(F.col("event_type") == "error", F.lit("{broken")).when(F.col("event_type") == "view", F.col("props")).otherwise(F.concat(F.lit('{"ok": '), (F.col("value") > 20).cast("string"), F.lit("}")))
    return e.select("event_id", arrays.json_flag(text).alias("ok"), arrays.json_number(F.col("props"), "$.k").alias("k"))


def normalised_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of orders: their lines as (part, number) tokens; a quantity above 49 breaks one."""
    token = F.struct(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id"), F.when(F.col("l_quantity") > 49, 0).otherwise(F.col("l_linenumber")).alias("revision"))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(token).alias("tokens"))
    shown = F.transform(records.normalised_gate(F.col("tokens")), lambda t: F.concat_ws("@", t["id"], t["revision"].cast("string")))
    return g.select("l_orderkey", F.array_join(shown, ",").alias("gate"))


def outcome_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).filter("event_type in ('purchase', 'error')")
    rows = e.select("user_id", F.col("event_id").alias("id"), (F.col("event_id") % 3 + 1).alias("revision"), F.when(F.col("event_type") == "purchase", "confirmed").otherwise("retracted").alias("status"), F.col("ts").alias("known_at"))
    return records.outcome_gate(rows, ["user_id"])


def time_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clock functions on each event's time."""
    ts = F.col("ts")
    slots = tm.hour_slots(tm.floor_hour(ts), F.col("event_id") % 3 + 1)
    whole = tm.half_open_range(ts, tm.add_days(ts, 1.5), "hour")
    a, b = tm.minute_range(ts)
    return _events(spark, sf_dir).select(
        "event_id", tm.iso_ms(ts).alias("iso"), tm.ceil_hour(ts).alias("ceil"), tm.add_days(ts, -0.25).alias("earlier"), tm.minute_key(ts).alias("minute"), tm.shifted_day(tm.day_key(ts), -7).alias("week_ago"), F.size(slots).alias("n_slots"),
        F.element_at(slots, -1)["end"].alias("last_end"), whole["end"].alias("range_end"), tm.midpoint(ts, whole["end"]).alias("middle"), a.alias("minute_start"), b.alias("minute_end"),
    )


def touched_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators import intervals

    e = _events(spark, sf_dir).withColumn("until", tm.add_hours(F.col("ts"), F.col("value") / 50))
    return intervals.overlapping_hours(e, "ts", "until").select("event_id", "slot")


def scope_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of scopes and families of types, as sets that are compared."""
    e = _events(spark, sf_dir)
    from tidemark.functions import text as tx

    kind = F.when(F.col("event_type") == "view", "quota_reset").when(F.col("event_type") == "click", "quota_refill").otherwise(F.col("event_type"))
    one = arrays.scope_products(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, F.array(F.lit("view"), F.col("event_type"))))
    return e.select("event_id", tx.event_family(kind).alias("family"), F.array_join(one, ",").alias("products"), tx.surfaces_overlap(one, F.array(F.lit("view"), F.when(F.col("value") > 100, "unknown").otherwise("error"))).alias("overlap"), r6(F.col("value") / 3, "third"))


QUERIES = {f.__name__: f for f in (record_envelopes, observations, record_violations, episode_violations, timing_candidates, active_signals, contract_filter, target_scope, primary_evidence, eligible_outcomes, history_rows, evidence_tiers, evaluation_compatibility, readiness, readiness_overlay, operator_confirmations, impact_policies, canonical_documents, nested_references, quarantine_payloads, health_flags, normalised_gates, outcome_gates, time_scalars, touched_hours, scope_families)}


ORACLES = {
    "record_envelopes": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT event_id, 'normalized_signal' AS record_type, 'sig_' || substr(sha256('user:' || user_id), 1, 24) AS record_id, n AS revision, CASE WHEN n > 1 THEN n - 1 END AS supersedes, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS created_at, CASE WHEN event_id % 2 = 0 THEN 'sha256:' || sha256(event_type) END AS config_hash, value FROM r",
    "observations": "SELECT CAST(doc_id AS VARCHAR) AS item_id, '2024-01-01T00:00:00.500Z' AS published_at, 'sha256:' || sha256(coalesce(text, '')) AS content_hash, true AS hashed, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS n_relations, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'reply' ELSE 'unknown' END END AS first_type FROM documents",
    "record_violations": "WITH l AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS line, unnest([CASE WHEN NOT l_quantity > 0 THEN 'quantity_positive' END, CASE WHEN NOT l_quantity <= 45 THEN 'quantity_most' END, CASE WHEN NOT l_discount BETWEEN 0 AND 0.08::DOUBLE THEN 'discount_range' END, CASE WHEN l_returnflag NOT IN ('A', 'N', 'R') THEN 'known_flag' END, CASE WHEN NOT l_shipdate < TIMESTAMP '1998-06-01' THEN 'shipped' END]) AS rule FROM lineitem) SELECT line, rule, count(*) AS n FROM l WHERE rule IS NOT NULL GROUP BY 1, 2",
    "episode_violations": """WITH e AS (SELECT *, max(ts) OVER (PARTITION BY user_id) AS last_at FROM events),
v AS (SELECT event_id, unnest([CASE WHEN event_type = 'view' THEN 'state' END, CASE WHEN value > 90 THEN 'trend' END, CASE WHEN value > 120 THEN 'pressure' END, CASE WHEN last_at > ts THEN 'clock_order' END, CASE WHEN event_type = 'error' AND value <= 5 THEN 'resolved_clock' END, CASE WHEN event_id % 9 <> 0 AND event_type = 'view' THEN 'roots_unique' END, CASE WHEN event_id % 9 = 0 THEN 'roots_present' END]) AS rule FROM e) SELECT * FROM v WHERE rule IS NOT NULL""",
    "timing_candidates": "SELECT event_id AS signal_id, event_type IN ('purchase', 'click') AND user_id % 3 = 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0 AND (value <= 20 OR CAST(round(value * 3.6e9) AS BIGINT) - 7200000000 BETWEEN 1 AND 172800000000) AS candidate FROM events",
    "active_signals": f"""WITH s AS (SELECT *, CASE WHEN value > 20 THEN ts + INTERVAL 2 HOUR END AS rs, CASE WHEN value > 20 THEN epoch_us(ts) + CAST(round(value * 3.6e9) AS BIGINT) END AS re FROM events)
SELECT event_id AS signal_id FROM s WHERE ts <= TIMESTAMP '{NOW}' AND (re IS NULL OR re > epoch_us(TIMESTAMP '{NOW}')) AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_type = 'purchase' AND o.value >= 80 AND o.user_id = s.user_id AND o.ts + INTERVAL 1 HOUR <= TIMESTAMP '{NOW}' AND o.ts + INTERVAL 1 HOUR > s.ts AND (s.rs IS NULL OR o.ts + INTERVAL 1 HOUR > s.rs) AND (s.event_id % 2 = 0 OR o.event_id % 3 <> 0))""",
    "contract_filter": "SELECT c_custkey, c_mktsegment = 'BUILDING' AND c_nationkey % 3 = 1 AND NOT c_acctbal > 0 AS matches, true AS any FROM customer",
    "target_scope": "SELECT p_partkey, p_type[:3] = 'STA' AND p_size > 10 AND (p_brand = 'Brand#11' OR p_size % 2 = 0) AS in_target, CASE WHEN p_size % 2 = 0 AND p_brand <> 'Brand#11' THEN least('Brand#11', p_brand) || ',' || greatest('Brand#11', p_brand) ELSE p_brand END AS products FROM part",
    "primary_evidence": "SELECT event_id, event_type IN ('view', 'click') OR greatest(epoch_us(ts) + CAST(round(value * 3.6e9) AS BIGINT), CASE WHEN event_id % 4 = 0 THEN epoch_us(ts) + 360000000000 ELSE 0 END) < epoch_us(TIMESTAMP '2024-01-15') AS allowed FROM events",
    "eligible_outcomes": "WITH c AS (SELECT l_partkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1) SELECT DISTINCT l.l_orderkey AS outcome_id FROM lineitem l JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F' JOIN c ON c.l_partkey = l.l_partkey AND n = l.l_linenumber WHERE EXISTS (SELECT 1 FROM lineitem s WHERE s.l_partkey = l.l_partkey AND s.l_returnflag = l.l_returnflag AND s.l_quantity > 25)",
    "history_rows": "WITH o AS (SELECT *, epoch_us(o_orderdate) + CAST(round(o_totalprice % 50 * 3.6e9) AS BIGINT) AS known FROM orders ORDER BY o_orderdate DESC, known DESC, o_orderkey LIMIT 40) SELECT o_orderkey AS outcome_id, o_orderdate AS start, c_name AS url, c_custkey IS NOT NULL AS known_source FROM o LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0",
    "evidence_tiers": f"WITH e AS (SELECT event_id, ts, CASE WHEN event_type = 'error' THEN 'experience' WHEN event_type = 'view' THEN 'competition' WHEN value > 50 THEN 'core' ELSE 'other_context' END AS tier, CASE WHEN ts <= TIMESTAMP '{NOW}' THEN 'current' ELSE 'pending' END AS part FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY tier, part ORDER BY ts DESC, event_id) AS rank FROM e) SELECT event_id, tier, part, rank FROM r WHERE rank <= 6",
    "evaluation_compatibility": "WITH n AS (SELECT user_id, count(*) AS latest FROM events GROUP BY 1), s AS (SELECT event_id % 40 AS snapshot, CASE WHEN event_id % 30 + 1 > latest THEN 'missing' WHEN event_id % 30 + 1 < latest THEN 'superseded' END AS reason FROM events JOIN n USING (user_id)) SELECT snapshot, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason), '') AS reasons, count(*) FILTER (WHERE reason = 'missing') = 0 AS compatible FROM s GROUP BY snapshot",
    "readiness": "WITH x AS (SELECT (SELECT max(ts) FROM events) AS last_event, (SELECT count(quality) FROM labels) AS labelled, (SELECT count(*) FROM embeddings) AS vectors), b AS (SELECT *, concat_ws(',', CASE WHEN last_event < TIMESTAMP '2024-02-10' THEN 'events_stale' END, CASE WHEN labelled < 50 THEN 'too_few_labels' END, CASE WHEN labelled = 0 THEN 'no_labels' END, CASE WHEN vectors < 10000 THEN 'too_few_vectors' END) AS blockers FROM x) SELECT *, CASE WHEN blockers = '' THEN 'ready' ELSE 'blocked' END AS status FROM b",
    "readiness_overlay": f"WITH e AS (SELECT *, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 3.6e9 AS age FROM events) SELECT event_id, concat_ws(',', CASE WHEN age > 600 THEN 'expired' END, CASE WHEN event_type = 'error' THEN 'failed' END, CASE WHEN age > 300 THEN 'stale' END) AS blockers, event_type <> 'click' AND event_id % 3 <> 0 AND age BETWEEN 0 AND 72 AS served FROM e",
    "operator_confirmations": "SELECT event_id, event_type = 'purchase' AND value > 10 AND event_id % 2 = 0 AND event_id % 5 <> 0 AND event_id % 3 <> 0 AS confirmed FROM events",
    "impact_policies": "SELECT p_partkey, p_brand = 'Brand#10' AND p_size > 10 AS matches FROM part",
    "canonical_documents": """SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN '{"a":' || replace(props, ' ', '') || ',"z":[1,{"a":' || event_id || ',"b":2}]}' END AS canonical, 'sha256:' || sha256(props) AS props_hash FROM events""",
    "nested_references": "SELECT event_id, k AS pos, 'u' || user_id AS record_id, CAST(event_id % 4 AS INTEGER) AS revision FROM events, range(2) r(k)",
    "quarantine_payloads": "SELECT event_id, event_type NOT IN ('error', 'view') AS readable, CASE WHEN event_type NOT IN ('error', 'view') THEN event_type END AS reason, CASE WHEN event_type NOT IN ('error', 'view') THEN CAST(event_id AS VARCHAR) END AS item FROM events",
    "health_flags": "SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view') AND value > 20 THEN 1 ELSE 0 END AS ok, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events",
    "normalised_gates": "WITH t AS (SELECT DISTINCT l_orderkey, 'p' || l_partkey AS id, l_linenumber AS n FROM lineitem) SELECT t.l_orderkey, CASE WHEN (SELECT max(l_quantity) FROM lineitem l WHERE l.l_orderkey = t.l_orderkey) <= 49 THEN string_agg(id || '@' || n, ',' ORDER BY id, n) END AS gate FROM t GROUP BY t.l_orderkey",
    "outcome_gates": "WITH t AS (SELECT user_id, ts, event_type, sha256(event_id || '@' || (event_id % 3 + 1) || '@' || CASE WHEN event_type = 'purchase' THEN 'confirmed' ELSE 'retracted' END) AS h FROM events WHERE event_type IN ('purchase', 'error')) SELECT user_id, 'sha256:' || sha256(string_agg(h, '' ORDER BY h)) AS gate, max(ts) AS max_known, bool_or(event_type = 'purchase') AS any_confirmed FROM t GROUP BY user_id",
    "time_scalars": """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS iso, CASE WHEN date_trunc('hour', ts) = ts THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS ceil, ts - INTERVAL 6 HOUR AS earlier, strftime(ts, '%Y-%m-%dT%H:%M') AS minute, strftime(ts - INTERVAL 7 DAY, '%Y-%m-%d') AS week_ago, CAST(event_id % 3 + 1 AS INTEGER) AS n_slots,
  date_trunc('hour', ts) + to_hours(CAST(event_id % 3 + 1 AS INTEGER)) AS last_end, ts + INTERVAL 36 HOUR AS range_end, ts + INTERVAL 18 HOUR AS middle, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS minute_start, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS minute_end FROM events""",
    "touched_hours": "WITH e AS (SELECT event_id, epoch_us(ts) AS a, epoch_us(ts) + CAST(round(value / 50 * 3.6e9) AS BIGINT) AS b FROM events) SELECT event_id, make_timestamp(h * 3600000000) AS slot FROM (SELECT event_id, unnest(range(a // 3600000000, (b - 1) // 3600000000 + 1)) AS h FROM e WHERE b > a)",
    "scope_families": "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'quota_restoration' ELSE event_type END AS family, CASE WHEN event_id % 2 = 0 AND event_type < 'view' THEN event_type || ',view' ELSE event_type END AS products, event_id % 2 = 0 OR event_type = 'view' OR (event_type = 'error' AND value <= 100) OR value > 100 AS overlap, round(value / 3, 6) + 0.0 AS third FROM events",
}
