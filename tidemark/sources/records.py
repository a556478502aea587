"""Reading records: JSON lines with a given schema, timelines, feed snapshots, synthetic history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Media types that carry claims (fixed values).
MEDIA_TYPES = ("text/plain", "application/vnd.x-search-summary+text")

TIMELINE = "platform string, id string, handle string, url string, published_at string, text string, language string"
FEED = "version string, title string, items array<struct<id: string, url: string, content_html: string, date_published: string, relations: array<struct<type: string, target: string>>>>"


def json_records(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """Rows of JSON lines; a line that does not parse fails the read, or (not strict) becomes nulls."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "PERMISSIVE")


def timeline(spark: SparkSession, path: str) -> DataFrame:
    """Posts of an exported timeline, one object a line.

    A line without platform, id, handle or time, an address of another post, and an id that stands
    twice fail the import when rows are used.  Reposts are marked ineligible.
    """
    rows = json_records(spark, path, TIMELINE)
    copies = rows.groupBy("platform", "id").agg(F.count(F.lit(1)).alias("__copies"))
    missing = F.col("id").isNull() | F.col("platform").isNull() | F.col("handle").isNull() | F.col("published_at").isNull()
    elsewhere = ~F.coalesce(F.col("url").endswith(F.concat(F.lit("/status/"), F.col("id"))), F.lit(True))
    checked = F.when(missing, F.raise_error(F.lit("timeline line lacks a field")).cast("string")).when(elsewhere, F.raise_error(F.concat(F.lit("address names another post: "), F.col("url"))).cast("string")).when(F.col("__copies") > 1, F.raise_error(F.concat(F.lit("post stands twice: "), F.col("id"))).cast("string")).otherwise(F.col("id"))
    out = rows.join(copies, ["platform", "id"]).withColumn("id", checked).drop("__copies")
    return out.withColumn("published_at", F.to_timestamp("published_at")).withColumn("feature_eligible", ~F.coalesce("text", F.lit("")).startswith("RT @"))


def feed_items(snapshots: DataFrame, text: str = "value") -> DataFrame:
    """Items of JSON feed documents, with outcome: item, or quarantine where a marker and the relations disagree.

    A reply marker ("Re ...") or repost marker ("RT ...") must come with exactly one relation of its kind.
    """
    feed = snapshots.select(F.from_json(F.col(text), FEED, {"mode": "FAILFAST"}).alias("feed"))
    items = feed.select(F.explode("feed.items").alias("item")).select("item.*")
    marker = F.when(F.col("content_html").rlike(r"^\s*(?:<[^>]+>)*\s*RT\b"), "repost").when(F.col("content_html").rlike(r"^\s*(?:<[^>]+>)*\s*Re\b"), "reply")
    exact = F.size(F.filter(F.coalesce("relations", F.array().cast("array<struct<type:string,target:string>>")), lambda r: r["type"] == marker))
    return items.withColumn("marker", marker).withColumn("outcome", F.when(marker.isNotNull() & (exact != 1), "quarantine").otherwise("item"))


def conflicting_items(items: DataFrame) -> DataFrame:
    """Ids that stand with different contents."""
    return items.groupBy("id").agg(F.count_distinct(F.sha2(F.coalesce("content_html", F.lit("")), 256)).alias("contents")).filter("contents > 1")


def synthetic_history(spark: SparkSession, days: int = 140, start: str = "2026-01-01") -> DataFrame:
    """Posts of a made-up history: five of each cycle, cycles 8, 8 and 10 days apart in turn."""
    cycles = spark.range(days).withColumn("day", (F.floor(F.col("id") / 3) * 26 + F.element_at(F.array(F.lit(0), F.lit(8), F.lit(16)), (F.col("id") % 3 + 1).cast("int"))).cast("int")).filter(F.col("day") < days)
    kinds = F.array(*[F.struct(F.lit(k).alias("post"), F.lit(h).alias("offset_hours"), F.lit(t).alias("text")) for k, h, t in ((0, -30, "Investigating degraded capacity."), (1, -20, "Claude announced a new model."), (2, -6, "A usage limit reset will land later today."), (3, 0, "We have reset usage limits for everyone."), (4, 12, "Capacity restored."))])
    rows = cycles.select("id", "day", F.explode(kinds).alias("k"))
    at = F.to_timestamp(F.lit(start)) + F.make_dt_interval(F.col("day"), F.lit(18)) + F.make_dt_interval(F.lit(0), F.col("k.offset_hours"))
    return rows.select(F.concat_ws("-", F.lit("demo"), F.col("id").cast("string"), F.col("k.post").cast("string")).alias("post_id"), F.col("id").alias("cycle"), at.cast("timestamp_ntz").alias("published_at"), F.col("k.text").alias("text"))
