"""Queries over documents as sources of items, and over what is kept, paged and retried, with their oracles.

JSON and HTML documents are made of the events, so that what is read back can be held against them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import time as tm
from tidemark.operators import revisions
from tidemark.sources import records, rows
from tidemark.streaming import delivery
from tidemark.session import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def search_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of ten users each: events as posts, clicks as replies, errors with a link."""
    e = _events(spark, sf_dir)
    referenced = F.when(F.col("event_type") == "click", F.array(F.struct(F.lit("replied_to").alias("type"), (F.col("event_id") - 1).cast("string").alias("id"))))
    post = F.struct(_text("event_id").alias("id"), _text("user_id").alias("author"), F.col("event_type").alias("text"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), referenced.alias("referenced"), F.when(F.col("event_type") == "error", F.array(F.lit("u"))).alias("links"))
    user = F.struct(_text("user_id").alias("id"), F.concat(F.lit("n"), _text("user_id")).alias("username"))
    pages = e.groupBy(F.floor(F.col("event_id") / 50).alias("page")).agg(F.to_json(F.struct(F.collect_list(post).alias("data"), F.collect_set(F.when(F.col("user_id") % 4 != 0, user)).alias("users"))).alias("value"))
    out = rows.search_items(pages)
    return out.select(F.col("item_id").cast("long").alias("event_id"), "handle", "published", "text", F.array_join(F.transform("relations", lambda r: F.concat_ws(":", r["type"], r["target"])), ",").alias("relations"))


def gateway_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = ((F.lit(410000000000) + F.col("event_id") * 977) * 4194304 + F.col("event_id")).cast("string")
    e = _events(spark, sf_dir).select("event_type", F.col("event_id").alias("sequence"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("https://posts.example/a/status/"), number)).otherwise("https://posts.example/about").alias("url"), F.when(F.col("event_id") % 3 == 1, number).otherwise("none").alias("event_id"), F.concat(F.lit("g"), _text("event_id")).alias("id"), F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("@h"), _text("user_id"))).alias("handle"))
    out = rows.gateway_items(e, F.col("event_type") == "view", F.col("sequence"))
    return out.select("item_id", "url", "published", "handle", "media_type", F.size("relations").alias("n_relations"), "availability")


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of fifty events each, some with markers that no relation backs."""
    e = _events(spark, sf_dir)
    html = F.when(F.col("event_type") == "click", F.lit("<p>Re hello</p>")).when(F.col("event_type") == "view", F.lit("RT this")).otherwise(F.col("event_type"))
    relation = F.when(F.col("event_id") % 3 != 0, F.array(F.struct(F.when(F.col("event_id") % 2 == 0, "reply").otherwise("repost").alias("type"), F.lit("x").alias("target"))))
    item = F.struct(_text("event_id").alias("id"), html.alias("content_html"), relation.alias("relations"))
    feeds = e.groupBy(F.floor(F.col("event_id") / 50).alias("page")).agg(F.to_json(F.struct(F.lit("1.1").alias("version"), F.collect_list(item).alias("items"))).alias("value"))
    return records.feed_items(feeds).select(F.col("id").cast("long").alias("event_id"), "marker", "outcome")


def conflicting_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(_text("user_id").alias("id"), F.when(F.col("user_id") % 3 == 0, "same").otherwise(F.col("event_type")).alias("content_html"))
    return records.conflicting_items(e)


def last_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.last_of_each(_events(spark, sf_dir).select("user_id", "event_id", "event_type"), "user_id", "event_id")


def recheck_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(F.when(F.col("event_id") % 4 != 0, _text("event_id")).otherwise("x").alias("item"), "ts")
    return rows.recheck_ids(e, "item", "ts")


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page a user: entries for its views, a grid of the days with their number, one day in nine wrong."""
    e = _events(spark, sf_dir).filter("event_type = 'view'").withColumn("day", F.to_date("ts"))
    at = F.date_trunc("second", "ts")
    number = ((tm.micros(at) / 1000).cast("long") - F.lit(tm.SNOWFLAKE_EPOCH_MS)) * 4194304 + F.col("event_id") % 1000
    shown = F.date_format(F.when(F.col("event_id") % 11 == 0, at + F.expr("interval 2 seconds")).otherwise(at), "yyyy-MM-dd HH:mm:ss")
    entry = F.concat(F.lit('<li class="x" data-id="'), number.cast("string"), F.lit('" data-time="'), shown, F.lit('"><b>.</b><p class="t">Seen  <i>'), _text("event_id"), F.lit("</i></p></li>"))
    lists = e.groupBy("user_id").agg(F.concat_ws("\n", F.collect_list(entry)).alias("items"))
    days = e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))
    cell = F.concat(F.lit('<td data-day="'), F.date_format("day", "yyyy-MM-dd"), F.lit('" data-count="'), (F.col("n") + F.when(F.day("day") % 9 == 0, 1).otherwise(0)).cast("string"), F.lit('"></td>'))
    grids = days.filter(F.day("day") % 10 != 0).groupBy("user_id").agg(F.concat_ws("", F.collect_list(cell)).alias("cells"))
    return lists.join(grids, "user_id").select("user_id", F.concat(F.lit("<html><table>"), "cells", F.lit("</table><ul>"), "items", F.lit("</ul></html>")).alias("html"))


def archive_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rows.archive_items(_archives(spark, sf_dir), "user_id", "html")
    return out.select("user_id", "published", "text", tm.snowflake_time(F.col("id")).alias("at"))


def archive_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _archives(spark, sf_dir)
    out = rows.archive_faults(rows.archive_items(pages, "user_id", "html"), rows.archive_grid(pages, "user_id", "html"), "user_id")
    return out.select("user_id", "day", F.array_join("faults", ",").alias("faults"))


def import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as an import over what a store holds: those of four sources, some with other texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    stored = docs.filter("source in ('src0', 'src1', 'src2', 'src3')").withColumn("digest", F.when(F.col("source") == "src3", "old").otherwise(F.col("digest")))
    return rows.import_counts(docs.drop("source"), stored, "doc_id", "digest")


def audit_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as entries of a log: numbers are missing between them; events of a user and hour stand twice."""
    log = _events(spark, sf_dir).filter("event_type <> 'error'").select(F.col("event_id").alias("sequence"), F.concat_ws("@", _text("user_id"), tm.iso_ms(tm.floor_hour(F.col("ts")))).alias("event"))
    return rows.audit_faults(log, "sequence", "event").select("sequence", "fault")


def appended_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of all events over a store of the purchases: what is to be appended."""
    e = _events(spark, sf_dir).select("event_id", "event_type", F.md5("props").alias("digest"))
    return revisions.append_records(e, e.filter("event_type = 'purchase'").drop("event_type"), ["event_id"], "digest").select("event_id")


def retained_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that some line of 45 or more refers to, and the five latest of each customer."""
    o = table(spark, sf_dir, "orders")
    refs = table(spark, sf_dir, "lineitem").filter("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    kept = revisions.retain(o, refs, ["o_orderkey"]).select("o_orderkey", F.lit("referenced").alias("why"))
    newest = revisions.keep_latest(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5).select("o_orderkey", F.lit("latest").alias("why"))
    return kept.unionByName(newest)


def forecast_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 512 forecast inputs: an input that repeats the id of the one before is skipped; numbers go on."""
    e = _events(spark, sf_dir).select(F.col("event_id").alias("arrival"), F.floor(F.col("event_id") / 3).alias("id"), "value")
    return delivery.input_ring(e, "arrival", "id", 512).select("arrival", "id", "sequence")


def input_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages after cursors: inside, ahead of the tail, and before what is kept."""
    e = _events(spark, sf_dir).select(F.col("event_id").alias("arrival"), F.floor(F.col("event_id") / 3).alias("id"), "value")
    ring = delivery.input_ring(e, "arrival", "id", 200)
    pages = [delivery.input_page(ring, "sequence", after, 4).select(F.lit(after).alias("after"), "status", "sequence") for after in (1, 250, 10_000_000)]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


def alert_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages of alerts of which only the durable ones, up to a number, are shown."""
    e = _events(spark, sf_dir).filter("event_type = 'error'").select("event_id", "ts")
    return delivery.alert_page(e, "event_id", 100, 20, 400).select("event_id")


def retry_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of a delivery: by status code and number of attempts."""
    e = _events(spark, sf_dir)
    code = F.element_at(F.array(*[F.lit(x) for x in (200, 404, 410, 429, 500, 400, 0)]), (F.col("event_id") % 7 + 1).cast("int"))
    d = delivery.retry_decision(code, (F.col("event_id") % 9 + 1).cast("int"), F.col("ts"), 30.0, 3600.0, 6)
    return e.select("event_id", d["action"].alias("action"), d["at"].alias("at"))


def outbox_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that enter an outbox: once for each id and each semantic key."""
    e = _events(spark, sf_dir)
    jobs = e.select(F.col("event_id").alias("arrival"), (F.col("event_id") - F.col("event_id") % 2).cast("string").alias("id"), F.concat_ws("|", _text("user_id"), "event_type", tm.day_key(F.col("ts"))).alias("semantic_key"))
    return delivery.outbox(jobs, "arrival").select("arrival")


def publication_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes (users) as each of their events leaves them: what is published when the status or the row changes."""
    status = F.when(F.col("event_type") == "purchase", "confirmed").when(F.col("event_type") == "error", "retracted").when(F.col("event_type") == "signup", "withdrawn").otherwise("pending")
    e = _events(spark, sf_dir).select("user_id", "event_id", "ts", status.alias("status"), F.floor(F.col("value") / 50).alias("row"))
    return delivery.publication_changes(e, ["user_id"], "ts", "event_id", "status", "row").select("event_id", "kind")


def watch_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A watch on each user's values: it opens at 60 and closes at 10 or less, the first one making a silent baseline."""
    e = _events(spark, sf_dir).select("user_id", "event_id", "ts", "value")
    return delivery.watch_changes(e, ["user_id"], "ts", "event_id", "value", 60.0, 10.0).select("event_id", "change")


def publication_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of each event as a publication, and how many events go out under one delivery key."""
    e = _events(spark, sf_dir)
    keyed = e.select(delivery.event_key(F.col("event_type"), _text("user_id"), _text("event_id"), F.lit("p1")).alias("event_key"), delivery.delivery_key(F.col("event_type"), _text("user_id"), F.when(F.col("value") > 10, F.floor(F.col("value") / 50).cast("string"))).alias("delivery_key"))
    return keyed.groupBy("delivery_key").agg(F.count(F.lit(1)).alias("n"), F.min("event_key").alias("first_key"))


def source_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role of each supplier by its nation, ``community`` where the nation has none; nations are a fixed small table."""
    roles = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), F.when(F.col("n_regionkey") == 0, "official").otherwise("media").alias("role"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return s.join(F.broadcast(roles), "s_nationkey", "left").select("s_suppkey", F.coalesce("role", F.lit("community")).alias("role"))  # at most 25 rows


QUERIES = {f.__name__: f for f in (search_items, gateway_items, feed_items, conflicting_items, last_of_each, recheck_ids, archive_items, archive_faults, import_counts, audit_faults, appended_records, retained_records, forecast_inputs, input_pages, alert_pages, retry_decisions, outbox_jobs, publication_changes, watch_changes, publication_keys, source_roles)}

_NUMBER = "CAST((410000000000 + event_id * 977)::BIGINT * 4194304 + event_id AS VARCHAR)"
_VIEWS = "v AS (SELECT user_id, event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS t0, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'view'), u AS (SELECT DISTINCT user_id FROM v WHERE day(day) % 10 <> 0)"
_RING = "x AS (SELECT event_id AS arrival, event_id // 3 AS id FROM events), k AS (SELECT *, id IS DISTINCT FROM lag(id) OVER (ORDER BY arrival) AS new FROM x), s AS (SELECT arrival, id, row_number() OVER (ORDER BY arrival) AS sequence FROM k WHERE new)"

ORACLES = {
    "publication_keys": "WITH k AS (SELECT 'pub_' || substr(sha256(event_type || chr(31) || user_id || chr(31) || event_id || chr(31) || 'p1'), 1, 24) AS e, event_type, user_id, CASE WHEN value > 10 THEN CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) END AS m FROM events) SELECT 'sha256:' || sha256(encode(event_type || chr(31) || user_id || chr(31)) || coalesce(encode(m), '\\x00'::BLOB)) AS delivery_key, count(*) AS n, min(e) AS first_key FROM k GROUP BY event_type, user_id, m",
    "source_roles": "SELECT s_suppkey, CASE WHEN n_regionkey = 0 THEN 'official' WHEN n_regionkey < 3 THEN 'media' ELSE 'community' END AS role FROM supplier JOIN nation ON n_nationkey = s_nationkey",
    "search_items": "SELECT event_id, CASE WHEN user_id % 4 <> 0 THEN 'n' || user_id ELSE 'i' END AS handle, CAST(date_trunc('second', ts) AS TIMESTAMP) AS published, event_type AS text, CASE event_type WHEN 'click' THEN 'reply:' || (event_id - 1) WHEN 'error' THEN 'links:u' ELSE '' END AS relations FROM events",
    "gateway_items": f"WITH x AS (SELECT *, CASE WHEN event_id % 3 < 2 THEN {_NUMBER} END AS n, CASE WHEN event_id % 5 <> 0 THEN 'h' || user_id END AS h FROM events) SELECT coalesce(n, 'g' || event_id) AS item_id, CASE WHEN n IS NOT NULL THEN 'https://posts.example/' || coalesce(h, 'i') || '/status/' || n ELSE 'https://posts.example/about' END AS url, CASE WHEN n IS NOT NULL THEN epoch_ms(410000000000 + event_id * 977 + 1288834974657) END AS published, h AS handle, CASE WHEN event_type = 'view' THEN 'application/vnd.x-search-summary+text' ELSE 'text/plain' END AS media_type, CASE WHEN event_type = 'view' AND n IS NOT NULL THEN 1 ELSE 0 END AS n_relations, CASE WHEN event_type = 'view' THEN 'gateway_first_seen' ELSE 'provider_first_seen' END AS availability FROM x",
    "feed_items": "SELECT event_id, CASE event_type WHEN 'click' THEN 'reply' WHEN 'view' THEN 'repost' END AS marker, CASE WHEN event_type = 'click' AND NOT (event_id % 3 <> 0 AND event_id % 2 = 0) OR event_type = 'view' AND NOT (event_id % 3 <> 0 AND event_id % 2 = 1) THEN 'quarantine' ELSE 'item' END AS outcome FROM events",
    "conflicting_items": "SELECT CAST(user_id AS VARCHAR) AS id, count(DISTINCT event_type) AS contents FROM events WHERE user_id % 3 <> 0 GROUP BY user_id HAVING count(DISTINCT event_type) > 1",
    "last_of_each": "SELECT user_id, event_id, event_type FROM events e WHERE event_id = (SELECT max(event_id) FROM events x WHERE x.user_id = e.user_id)",
    "recheck_ids": "SELECT CAST(event_id AS VARCHAR) AS item FROM events WHERE event_id % 4 <> 0 ORDER BY ts DESC, event_id DESC LIMIT 25",
    "archive_items": f"WITH {_VIEWS} SELECT user_id, CASE WHEN event_id % 11 = 0 THEN t0 + INTERVAL 2 SECOND ELSE t0 END AS published, 'Seen ' || event_id AS text, t0 AS at FROM v WHERE user_id IN (SELECT user_id FROM u)",
    "archive_faults": f"""WITH {_VIEWS}, g AS (SELECT user_id, day, count(*) + CASE WHEN day(day) % 9 = 0 THEN 1 ELSE 0 END AS stated FROM v WHERE day(day) % 10 <> 0 GROUP BY 1, 2), b AS (SELECT *, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS before FROM g),
f AS (SELECT user_id, CAST(CASE WHEN event_id % 11 = 0 THEN t0 + INTERVAL 2 SECOND ELSE t0 END AS DATE) AS day, count(*) AS parsed, bool_or(event_id % 11 = 0) AS drift FROM v WHERE user_id IN (SELECT user_id FROM u) GROUP BY 1, 2),
j AS (SELECT coalesce(b.user_id, f.user_id) AS user_id, coalesce(b.day, f.day) AS day, concat_ws(',', CASE WHEN b.day - before > 1 THEN 'gap' END, CASE WHEN stated IS NOT NULL AND stated <> coalesce(parsed, 0) THEN 'mismatch' END, CASE WHEN stated IS NULL THEN 'outside' END, CASE WHEN drift THEN 'drift' END) AS faults FROM b FULL JOIN f ON b.user_id = f.user_id AND b.day = f.day) SELECT * FROM j WHERE faults <> ''""",
    "import_counts": "SELECT count(*) FILTER (WHERE coalesce(source, '') NOT IN ('src0', 'src1', 'src2', 'src3')) AS inserted, count(*) FILTER (WHERE source = 'src3') AS changed, count(*) FILTER (WHERE source IN ('src0', 'src1', 'src2')) AS unchanged FROM documents",
    "audit_faults": "WITH l AS (SELECT event_id AS sequence, user_id, date_trunc('hour', ts) AS h FROM events WHERE event_type <> 'error'), c AS (SELECT *, count(*) OVER (PARTITION BY user_id, h) AS n, lag(sequence) OVER (ORDER BY sequence) AS p FROM l) SELECT sequence, CASE WHEN n > 1 THEN 'repeated' ELSE 'gap' END AS fault FROM c WHERE n > 1 OR sequence - p > 1",
    "appended_records": "SELECT event_id FROM events WHERE event_type <> 'purchase'",
    "retained_records": "SELECT o_orderkey, 'referenced' AS why FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45) UNION ALL SELECT o_orderkey, 'latest' FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 5",
    "forecast_inputs": f"WITH {_RING} SELECT arrival, id, sequence FROM s WHERE sequence > (SELECT max(sequence) FROM s) - 512",
    "input_pages": f"""WITH {_RING}, r AS (SELECT * FROM s WHERE sequence > (SELECT max(sequence) FROM s) - 200), c AS (SELECT unnest([1, 250, 10000000]) AS after), t AS (SELECT min(sequence) AS lo, max(sequence) AS hi FROM r),
p AS (SELECT after, CASE WHEN after > hi THEN 'ahead_of_tail' WHEN after < lo - 1 THEN 'retention_gap' ELSE 'ok' END AS status, lo FROM c, t)
SELECT after, status, q.sequence FROM p LEFT JOIN LATERAL (SELECT sequence FROM r WHERE p.status = 'ok' AND sequence > p.after ORDER BY sequence LIMIT 4) q ON true""",
    "alert_pages": "SELECT event_id FROM events WHERE event_type = 'error' AND event_id > 100 AND event_id <= 400 ORDER BY event_id LIMIT 20",
    "retry_decisions": """WITH x AS (SELECT event_id, ts, [200, 404, 410, 429, 500, 400, 0][CAST(event_id % 7 + 1 AS INTEGER)] AS code, event_id % 9 + 1 AS n FROM events), d AS (SELECT *, CASE WHEN code BETWEEN 200 AND 299 THEN 'done' WHEN code IN (404, 410) THEN 'delete' WHEN code IN (429, 0) OR code >= 500 THEN CASE WHEN n < 6 THEN 'retry' ELSE 'disable' END ELSE 'disable' END AS action FROM x)
SELECT event_id, action, CASE WHEN action = 'retry' THEN ts + to_seconds(CAST(least(3600, 30 * pow(2, n - 1)) AS INTEGER)) END AS at FROM d""",
    "outbox_jobs": "WITH j AS (SELECT event_id AS arrival, event_id - event_id % 2 AS id, user_id || '|' || event_type || '|' || strftime(ts, '%Y-%m-%d') AS k FROM events), a AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY arrival) AS r FROM j), b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY arrival) AS q FROM a WHERE r = 1) SELECT arrival FROM b WHERE q = 1",
    "publication_changes": """WITH x AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'confirmed' WHEN 'error' THEN 'retracted' WHEN 'signup' THEN 'withdrawn' ELSE 'pending' END AS s, floor(value / 50) AS r FROM events),
d AS (SELECT *, last_value(CASE WHEN s <> 'pending' THEN s END IGNORE NULLS) OVER w AS ps, last_value(CASE WHEN s <> 'pending' THEN r END IGNORE NULLS) OVER w AS pr FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, CASE WHEN s = 'confirmed' AND ps IS DISTINCT FROM 'confirmed' THEN 'confirmed' WHEN s = 'confirmed' THEN 'corrected' ELSE s END AS kind FROM d WHERE (s = 'confirmed' AND (ps IS DISTINCT FROM 'confirmed' OR pr <> r)) OR (s IN ('retracted', 'withdrawn') AND ps = 'confirmed')""",
    "watch_changes": """WITH x AS (SELECT *, CASE WHEN value >= 60 THEN 1 WHEN value <= 10 THEN 0 END AS m FROM events), s AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS on_, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM x),
c AS (SELECT *, lag(on_) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM s) SELECT event_id, CASE WHEN on_ = 1 THEN 'opened' ELSE 'closed' END AS change FROM c WHERE n > 1 AND on_ <> was""",
}
