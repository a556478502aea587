"""Queries over forecasts that are issued from stored inputs, published once and computed again.

A prediction is a scope (user_id modulo 5) and a model; its snapshot has 24 hours from the cutoff
on, with the errors of the scope in the same hour of all days before and the hour's number as features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import time as tm
from tidemark.operators import issuance
from tidemark.plans.metric_queries import r6
from tidemark.session import stored, table, work_folder

CUTOFF, SLOTS, FEATURES, TOLD = "2024-01-20", 24, ("errors", "number"), 0.5
MODELS = (("m0", [4.0, 11.5], [3.0, 7.0], [-3.0, 0.5, -0.25]), ("m1", [2.0, 10.0], [2.0, 5.0], [-2.0, 0.25, 0.125]))


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "model string, means array<double>, scales array<double>, weights array<double>")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scope's slots: told is the part of slots 6 to 8 (and half of 9); since counts from its last purchase of 250 or more."""
    cutoff = F.lit(CUTOFF).cast("timestamp_ntz")
    e = table(spark, sf_dir, "events").withColumn("scope", F.col("user_id") % 5).filter(F.col("ts") < cutoff)
    counts = e.filter("event_type = 'error'").groupBy("scope", F.hour("ts").alias("slot")).agg(F.count(F.lit(1)).alias("errors"))
    last = e.groupBy("scope").agg(F.max(F.when((F.col("event_type") == "purchase") & (F.col("value") >= 250), F.col("ts"))).alias("last"))
    grid = last.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    rows = grid.join(counts, ["scope", "slot"], "left")
    since = tm.hours_between(cutoff, F.col("last")) + F.col("slot")
    told = F.when(F.col("scope") == 2, 0.0).when(F.col("slot").between(6, 8), 1.0).when(F.col("slot") == 9, 0.5).otherwise(0.0)
    return rows.select(F.concat(F.lit("s"), F.col("scope").cast("string")).alias("snapshot"), "slot", F.coalesce("errors", F.lit(0)).alias("errors"), F.col("slot").alias("number"), since.alias("since"), told.alias("told"))


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = snapshots(spark, sf_dir).select("snapshot").distinct()
    return scopes.crossJoin(F.broadcast(models(spark).select("model"))).select(F.concat_ws(":", "snapshot", "model").alias("prediction"), "model", "snapshot")  # two models


def issued_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = issuance.issue_slots(lineage(spark, sf_dir), snapshots(spark, sf_dir), models(spark), FEATURES, told_weight=TOLD)
    return out.select("prediction", "slot", *[r6(c) for c in issuance.STATED])


def published_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forecasts as a reader finds them, after each model's was published twice under its key; the second time with other numbers."""
    root = work_folder(spark, "forecasts")
    slots = issuance.issue_slots(lineage(spark, sf_dir), snapshots(spark, sf_dir), models(spark), FEATURES, told_weight=TOLD)
    for again in (0.0, 1.0):
        for name, *_ in MODELS:
            own = slots.filter(F.col("prediction").endswith(f":{name}")).withColumn("hazard", F.col("hazard") + again)
            issuance.publish_once(root, (CUTOFF, name, SLOTS), own)
    out = spark.read.parquet(*[issuance.forecast_folder(root, CUTOFF, name, SLOTS) for name, *_ in MODELS])
    return out.select("prediction", "slot", *[r6(c) for c in issuance.STATED])


def recomputed_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored forecasts of which some were tampered with, computed again from their snapshots and models.

    s1 lost a slot, a hazard of s3 was changed, s4 names a model that isn't stored.
    """
    inputs, named = stored(snapshots(spark, sf_dir), "snapshots"), lineage(spark, sf_dir)
    issued = issuance.issue_slots(named, inputs, models(spark), FEATURES, told_weight=TOLD)
    scope = F.substring_index("prediction", ":", 1)
    kept = issued.filter(~((scope == "s1") & (F.col("slot") == 5)))
    stated = stored(kept.withColumn("hazard", F.when((scope == "s3") & (F.col("slot") == 7), F.col("hazard") + 0.001).otherwise(F.col("hazard"))), "stated")
    named = named.withColumn("model", F.when((scope == "s4") & (F.col("model") == "m1"), "m9").otherwise(F.col("model")))
    out = issuance.integrity(stated, named, inputs, models(spark), FEATURES, told_weight=TOLD)
    return out.select("prediction", r6("largest"), issuance.shown_reasons())


def served_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two views of the same events, published as two versions; readers get both from the last one."""
    root = work_folder(spark, "views")
    e = table(spark, sf_dir, "events")
    for before in ("2024-01-10", CUTOFF):
        known = e.filter(F.col("ts") < F.lit(before).cast("timestamp_ntz"))
        issuance.publish_views(spark, root, {"kinds": known.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "users": known.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))})
    views = issuance.read_views(spark, root, ["kinds", "users"])
    return views["kinds"].select(F.lit("kind").alias("view"), F.col("event_type").alias("key"), "n").unionByName(views["users"].select(F.lit("user").alias("view"), F.col("user_id").cast("string").alias("key"), "n"))


QUERIES = {f.__name__: f for f in (issued_slots, published_forecast, recomputed_integrity, served_views)}

_MODELS = ", ".join(f"('{m}', {a[0]}, {a[1]}, {s[0]}, {s[1]}, {w[0]}, {w[1]}, {w[2]})" for m, a, s, w in MODELS)
_ISSUED = f"""e AS (SELECT *, user_id % 5 AS scope FROM events WHERE ts < TIMESTAMP '{CUTOFF}'), m AS (SELECT * FROM (VALUES {_MODELS}) v(model, a0, a1, s0, s1, w0, w1, w2)),
l AS (SELECT scope, (epoch_us(TIMESTAMP '{CUTOFF}') - epoch_us(max(ts) FILTER (WHERE event_type = 'purchase' AND value >= 250))) / 3.6e9 AS since FROM e GROUP BY scope),
c AS (SELECT scope, hour(ts) AS slot, count(*) AS n FROM e WHERE event_type = 'error' GROUP BY 1, 2),
x AS (SELECT 's' || l.scope || ':' || model AS prediction, CAST(k AS INTEGER) AS slot, since + k AS since, CASE WHEN l.scope = 2 THEN 0.0 WHEN k BETWEEN 6 AND 8 THEN 1.0 WHEN k = 9 THEN 0.5 ELSE 0.0 END::DOUBLE AS told,
  w0 + w1 * least(3, greatest(-3, (coalesce(c.n, 0) - a0) / s0)) + w2 * least(3, greatest(-3, (k - a1) / s1)) AS eta FROM l, m, range({SLOTS}) r(k) LEFT JOIN c ON c.scope = l.scope AND c.slot = k),
h AS (SELECT prediction, slot, told, CAST(1 / (1 + exp(-eta::DOUBLE)) * CASE WHEN since IS NULL THEN 1 WHEN since <= 24 THEN since / 24 * 0.25 WHEN since <= 72 THEN 0.25 + (since - 24) / 48 * 0.5 WHEN since <= 168 THEN 0.75 + (since - 72) / 96 * 0.25 ELSE 1 END AS DOUBLE) AS hz FROM x),
ms AS (SELECT *, hz * coalesce(product(1 - hz) OVER (PARTITION BY prediction ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS mass FROM h),
mx AS (SELECT *, CASE WHEN sum(told) OVER p > 0 THEN (1 - {TOLD}) * mass + {TOLD} * told * mass / sum(told * mass) OVER p ELSE mass END AS mixed FROM ms WINDOW p AS (PARTITION BY prediction)),
hm AS (SELECT prediction, slot, least(1, mixed / (1 - coalesce(sum(mixed) OVER (PARTITION BY prediction ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS hazard FROM mx),
iss AS (SELECT *, coalesce(product(1 - hazard) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) * hazard AS first_probability, 1 - product(1 - hazard) OVER (w ROWS UNBOUNDED PRECEDING) AS by_end_probability,
  CASE WHEN count(*) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) = 4 THEN 1 - product(1 - hazard) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) END AS rolling_probability FROM hm WINDOW w AS (PARTITION BY prediction ORDER BY slot))"""
_SLOTS_SQL = f"WITH {_ISSUED} SELECT prediction, slot, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in issuance.STATED)} FROM iss"

ORACLES = {
    "issued_slots": _SLOTS_SQL,
    "published_forecast": _SLOTS_SQL,
    "recomputed_integrity": f"""WITH {_ISSUED}, p AS (SELECT DISTINCT prediction FROM iss)
SELECT prediction, CASE WHEN prediction = 's4:m1' THEN NULL WHEN prediction LIKE 's3:%' THEN 0.001::DOUBLE ELSE 0.0::DOUBLE END AS largest,
  CASE WHEN prediction = 's4:m1' THEN 'model_missing' WHEN prediction LIKE 's1:%' THEN 'slot_missing' WHEN prediction LIKE 's3:%' THEN 'hazard_differs' ELSE '' END AS reasons FROM p""",
    "served_views": f"SELECT 'kind' AS view, event_type AS key, count(*) AS n FROM events WHERE ts < TIMESTAMP '{CUTOFF}' GROUP BY event_type UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), count(*) FROM events WHERE ts < TIMESTAMP '{CUTOFF}' GROUP BY user_id",
}
