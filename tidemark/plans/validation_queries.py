"""Validation of mixed records made of events, with an oracle.

An event is an observation, a candidate or a settlement by its number; every record states the
event's own time, type and value, and some of them are faulty: that is what the rules are to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import time as tm
from tidemark.operators import validation
from tidemark.session import table


def record_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of each event's record."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_id") % 3
    at = tm.iso_ms(F.col("ts"))
    span = F.struct(at.alias("start"), tm.iso_ms(tm.add_hours(F.col("ts"), F.col("value") / 24 - 1)).alias("end"), F.lit("[start,end)").alias("boundary"))
    ref = F.struct(F.col("user_id").cast("string").alias("record_id"), (F.col("event_id") % 5).cast("int").alias("revision"))
    assertion = F.struct(F.lit("a").alias("assertion_id"), F.lit(1).alias("revision"))
    observation = F.struct(
        F.col("event_type").alias("ingest_provider"), F.when(F.col("value") > 10, F.col("event_id").cast("string")).alias("provider_item_id"), at.alias("published_at"), at.alias("first_seen_at"), F.when(F.col("event_type") == "error", F.lit("unknown")).otherwise(at).alias("fetched_at"),
        F.struct(F.col("user_id").cast("string").alias("id")).alias("author"), F.array().cast("array<struct<type:string>>").alias("native_relations"), F.struct(F.sha2("props", 256).alias("content_hash")).alias("content"),
    )
    scope = F.struct(F.lit("v").alias("vendor"), F.when(F.col("event_type") == "view", "multi_product").otherwise("one").alias("product"), F.lit("all").alias("population"), F.array(F.lit("a"), F.when(F.col("value") > 50, "a").otherwise("b")).alias("products"))
    candidate = F.struct(at.alias("as_of"), F.col("user_id").cast("string").alias("event_cluster_id"), scope.alias("scope"), span.alias("hypothesized_time_range"), F.array().cast("array<string>").alias("evidence"))
    settlement = F.struct(
        ref.alias("prediction_ref"), F.floor("value").cast("int").alias("slot_index"), span.alias("window"), F.lit("PT4H").alias("display_horizon"), F.when(F.col("event_type") == "purchase", "positive").when(F.col("event_type") == "click", "negative").otherwise(F.col("event_type")).alias("status"), at.alias("settled_at"),
        F.lit("live").alias("outcome_as_of_mode"), F.lit("live").alias("coverage_as_of_mode"), F.array(ref).alias("outcome_refs"), F.array(assertion, assertion).alias("coverage_assertion_refs"), F.concat(F.lit("sha256:"), F.sha2("props", 256)).alias("coverage_assertion_snapshot_hash"), F.struct(F.lit(True).alias("complete"), F.array(F.lit("p")).alias("providers")).alias("coverage"), F.col("event_type").alias("reason"),
    )
    rows = e.select(
        F.lit("tidemark/1").alias("schema_version"), F.when(kind == 0, "raw_observation").when(kind == 1, "event_candidate").otherwise("prediction_settlement").alias("record_type"), F.col("event_id").cast("string").alias("record_id"), (F.col("event_id") % 11).cast("int").alias("revision"), at.alias("created_at"),
        F.struct(F.lit("p").alias("name"), F.lit("1").alias("version")).alias("producer"), F.when(F.col("event_id") % 11 > 1, F.struct(F.col("event_id").cast("string").alias("record_id"), (F.col("event_id") % 11 - 1).cast("int").alias("revision"))).alias("supersedes"),
        F.when(kind == 0, F.to_json(observation)).when(kind == 1, F.to_json(candidate)).otherwise(F.to_json(settlement)).alias("data"),
    )
    return validation.record_violations(rows)


QUERIES = {"record_validation": record_validation}

ORACLES = {
    "record_validation": """WITH e AS (SELECT *, CAST(round((value / 24 - 1) * 3.6e9) AS BIGINT) AS w, epoch_us(ts) AS u FROM events),
s AS (SELECT *, (u + w) // 1000 <= u // 1000 AS empty FROM e),
v AS (SELECT CASE event_id % 3 WHEN 0 THEN 'raw_observation' WHEN 1 THEN 'event_candidate' ELSE 'prediction_settlement' END AS record_type, CAST(event_id AS VARCHAR) AS record_id, CAST(event_id % 11 AS INTEGER) AS revision,
  unnest([CASE WHEN event_id % 11 = 0 THEN 'revision' END] || CASE event_id % 3
    WHEN 0 THEN [CASE WHEN value <= 10 THEN 'identity' END, CASE WHEN event_type = 'error' THEN 'collected_at' END]
    WHEN 1 THEN [CASE WHEN event_type = 'view' AND value > 50 THEN 'scope' END, CASE WHEN empty THEN 'time_range' END]
    ELSE [CASE WHEN event_id % 5 = 0 THEN 'prediction_ref' END, CASE WHEN value < 0 OR value >= 168 THEN 'slot_index' END, CASE WHEN empty THEN 'window' END, CASE WHEN event_type NOT IN ('purchase', 'click') THEN 'status' END, CASE WHEN event_id % 5 = 0 THEN 'outcome_refs' END, 'coverage_unique'] END) AS rule FROM s)
SELECT record_type, record_id, revision, rule FROM v WHERE rule IS NOT NULL""",
}
