"""Rows of foreign documents as items: archives of pages, search payloads, gateway events, fixtures, audit logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.functions.text import status_id
from tidemark.functions.time import micros, snowflake_time

SEARCH = "data array<struct<id: string, author: string, text: string, created_at: string, referenced: array<struct<type: string, id: string>>, links: array<string>>>, users array<struct<id: string, username: string>>"

# Relation types of search payloads and the names that items use for them.
RELATIONS = {"retweeted": "repost", "quoted": "quote", "replied_to": "reply"}


def audit_log(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Events of an audit log of JSON lines, in the order of their sequence; a broken line fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST").orderBy("sequence")


def audit_faults(log: DataFrame, sequence: str, event: str) -> DataFrame:
    """Entries of a log that don't follow on the one before by one, or whose event stands twice."""
    nearby = log.select((F.col(sequence) + 1).alias(sequence), F.lit(True).alias("__has"))
    first = log.agg(F.min(sequence).alias("__first"))
    again = log.groupBy(event).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(event, F.lit(True).alias("__twice"))
    joined = log.join(nearby.distinct(), sequence, "left").join(again, event, "left").crossJoin(F.broadcast(first))  # a single row
    fault = F.when(F.col("__twice"), "repeated").when(F.col("__has").isNull() & (F.col(sequence) > F.col("__first")), "gap")
    return joined.withColumn("fault", fault).filter("fault is not null").select(*log.columns, "fault")


def fixture(spark: SparkSession, rows: Sequence[Mapping[str, object]], schema: T.StructType | str, covered: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """Given rows as items, and the one interval that they declare as covered."""
    items = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    start, end = (F.lit(x).cast("timestamp_ntz") for x in covered)
    manifest = spark.range(1).select(start.alias("start"), end.alias("end"), F.lit("fixture_declared_complete").alias("mode"), F.sha2(F.lit(repr(sorted(map(str, rows)))), 256).alias("manifest_hash"))
    return items, manifest


def search_items(payloads: DataFrame, text: str = "value") -> DataFrame:
    """Items of search payloads: posts with their authors' names, relations renamed, links appended as relations."""
    doc = payloads.select(F.from_json(F.col(text), SEARCH, {"mode": "FAILFAST"}).alias("p"))
    names = F.map_from_entries(F.transform("p.users", lambda u: F.struct(u["id"], u["username"])))
    rows = doc.select(names.alias("names"), F.explode("p.data").alias("d"))
    kinds = F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv])
    referenced = F.transform(F.coalesce("d.referenced", F.array().cast("array<struct<type:string,id:string>>")), lambda r: F.struct(F.coalesce(kinds[r["type"]], F.lit("unknown")).alias("type"), r["id"].alias("target")))
    links = F.transform(F.coalesce("d.links", F.array().cast("array<string>")), lambda u: F.struct(F.lit("links").alias("type"), u.alias("target")))
    handle = F.try_element_at("names", F.col("d.author"))
    return rows.select(F.col("d.id").alias("item_id"), F.coalesce(handle, F.lit("i")).alias("handle"), F.to_timestamp("d.created_at").cast("timestamp_ntz").alias("published"), F.coalesce("d.text", F.lit("")).alias("text"), F.concat(referenced, links).alias("relations"))


def recheck_ids(items: DataFrame, item: str, published: str, limit: int = 25) -> DataFrame:
    """The most recent items, whose texts are to be read again: numeric ids only."""
    return items.filter(F.col(item).rlike(r"^\d+$")).orderBy(F.desc(published), F.desc(F.col(item).cast("decimal(38,0)"))).limit(limit).select(item)


def gateway_items(events: DataFrame, summary: Column, sequence: Column | None = None) -> DataFrame:
    """Gateway events (event_id, id, url, handle, text, seen) as items: the post's number from the first of url, event_id and id that has one, its time from the number.

    ``sequence``: see ``snowflake_time``.
    """
    number = F.coalesce(status_id(F.col("url")), status_id(F.col("event_id")), status_id(F.col("id")))
    handle = F.nullif(F.regexp_replace(F.coalesce("handle", F.lit("")), "^@", ""), F.lit(""))
    own = F.when(number.isNotNull(), F.concat(F.lit("https://posts.example/"), F.coalesce(handle, F.lit("i")), F.lit("/status/"), number))
    relations = F.when(summary & number.isNotNull(), F.array(F.struct(F.lit("links").alias("type"), number.alias("target")))).otherwise(F.array().cast("array<struct<type:string,target:string>>"))
    media = F.when(summary, "application/vnd.x-search-summary+text").otherwise("text/plain")
    return events.select(F.coalesce(number, F.col("id")).alias("item_id"), F.coalesce(own, F.col("url")).alias("url"), snowflake_time(number, sequence).alias("published"), handle.alias("handle"), media.alias("media_type"), relations.alias("relations"), F.when(summary, "gateway_first_seen").otherwise("provider_first_seen").alias("availability"))


def last_of_each(items: DataFrame, item: str, ordinal: str) -> DataFrame:
    """Of items that several queries brought, the one that came last."""
    return items.groupBy(item).agg(F.max_by(F.struct(*items.columns), F.col(ordinal)).alias("r")).select("r.*")


def archive_items(pages: DataFrame, page: str, html: str) -> DataFrame:
    """Items of archive pages: page, id, published and text of each list entry.

    An entry is ``<li data-id="..." data-time="..."><p>...</p></li>``; attributes may stand in any order.
    """
    entries = pages.select(page, F.explode(F.regexp_extract_all(html, F.lit(r"(?s)(<li\b[^>]*\bdata-id=.*?</li>)"), F.lit(1))).alias("e"))
    body = F.regexp_replace(F.regexp_extract("e", r"(?s)<p\b[^>]*>(.*?)</p>", 1), r"<[^>]*>", "")
    return entries.select(page, F.regexp_extract("e", r'\bdata-id="([^"]*)"', 1).alias("id"), F.try_to_timestamp(F.regexp_extract("e", r'\bdata-time="([^"]*)"', 1)).cast("timestamp_ntz").alias("published"), F.trim(F.regexp_replace(body, r"\s+", " ")).alias("text"))


def archive_grid(pages: DataFrame, page: str, html: str) -> DataFrame:
    """page, day and count of the grid of days that archive pages state (``data-day="..." data-count="..."``)."""
    cells = pages.select(page, F.explode(F.regexp_extract_all(html, F.lit(r'(data-day="\d{4}-\d{2}-\d{2}"\s+data-count="\d+")'), F.lit(1))).alias("c")).distinct()
    return cells.select(page, F.to_date(F.regexp_extract("c", r'data-day="([^"]*)"', 1)).alias("day"), F.regexp_extract("c", r'data-count="(\d+)"', 1).cast("long").alias("count"))


def archive_faults(items: DataFrame, grid: DataFrame, page: str, drift_seconds: float = 1.0) -> DataFrame:
    """What is wrong with the days of archive pages: conflict (two counts), gap (a day is missing before), mismatch (other than the items), outside (items without a cell), drift (an item's clock is not its number's)."""
    counts = grid.groupBy(page, "day").agg(F.max("count").alias("stated"), F.count_distinct("count").alias("n"))
    w = Window.partitionBy(page).orderBy("day")
    counts = counts.withColumn("before", F.lag("day").over(w))
    drift = F.abs(micros(F.col("published")) - micros(snowflake_time(F.col("id")))) > int(drift_seconds * 1e6)
    found = items.groupBy(page, F.to_date("published").alias("day")).agg(F.count(F.lit(1)).alias("parsed"), F.bool_or(drift).alias("drift"))
    joined = counts.join(found, [page, "day"], "full")
    faults = F.array_compact(F.array(F.when(F.col("n") > 1, "conflict"), F.when(F.datediff("day", "before") > 1, "gap"), F.when(F.col("stated").isNotNull() & (F.col("stated") != F.coalesce("parsed", F.lit(0))), "mismatch"), F.when(F.col("stated").isNull(), "outside"), F.when(F.col("drift"), "drift")))
    return joined.select(page, "day", faults.alias("faults")).filter(F.size("faults") > 0)


def import_counts(incoming: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """One row: how many rows of an import are inserted, changed or unchanged against the stored latest ones."""
    old = stored.select(key, F.col(digest).alias("__digest"))
    joined = incoming.join(old, key, "left")
    return joined.agg(F.count_if(F.col("__digest").isNull()).alias("inserted"), F.count_if(F.col("__digest") != F.col(digest)).alias("changed"), F.count_if(F.col("__digest") == F.col(digest)).alias("unchanged"))
