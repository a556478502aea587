"""Queries over evidence that is linked, matched and reconciled, with their oracles.

Events are signals of their user; an event's observation is its hour, its group the day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import time as tm
from tidemark.operators import identity, linking, training
from tidemark.plans.metric_queries import r6
from tidemark.session import table

NOW = "2024-01-28"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _now():  # noqa: ANN202
    return F.lit(NOW).cast("timestamp_ntz")


def speaking_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumns({"observation": F.concat_ws("@", F.col("user_id").cast("string"), tm.day_key(F.col("ts"))), "rev": F.floor(F.col("value") / 40)})
    out = linking.speaking_signals(e, "observation", "rev", F.col("event_type") != "view", F.col("event_type").isin("purchase", "click"), F.col("event_id") % 3 == 0, "ts", "event_id", _now())
    return out.select("observation", "event_id")


def collapsed_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of each user's day: events of one type and tens of value are one."""
    e = _events(spark, sf_dir).withColumns({"group": F.concat_ws("@", F.col("user_id").cast("string"), tm.day_key(F.col("ts"))), "tens": F.floor(F.col("value") / 10), "tokens": F.array(F.col("event_type"), (F.col("event_id") % 4).cast("string"))})
    out = linking.collapsed_updates(e, "group", ["event_type", "tens"], "ts", "event_id", "tokens")
    return out.withColumn("tokens", F.array_join("tokens", ","))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select(
        "user_id", "event_id", F.col("ts").alias("first_at"), tm.add_hours(F.col("ts"), F.col("value") / 100).alias("last_at"), F.when(F.col("event_type").isin("error", "view"), "availability").when(F.col("event_type") == "click", "other").otherwise("performance").alias("category"),
        F.when(F.col("event_id") % 7 == 0, F.array(F.lit("unknown"))).otherwise(F.array(F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")))).alias("surfaces"), F.array(F.concat(F.lit("t"), (F.col("event_id") % 4).cast("string")), F.concat(F.lit("u"), (F.col("event_id") % 2).cast("string")), F.when(F.col("value") > 60, "timeout").otherwise("common")).alias("tokens"), (F.col("event_type") == "click").alias("followup"),
    )


def scored_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linking.scored_clusters(_entries(spark, sf_dir), ["user_id"], "first_at", "last_at", "event_id", "category", "surfaces", "tokens", "followup", 20.0)
    return out.select("user_id", "event_id", "cluster")


def _orders_and_suppliers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders, their lines' groups, and suppliers with all groups of theirs and their first day.

    Groups are those of parts.  Orders' groups stay a row a line: an order is a handful of lines,
    and nothing reads them together.
    """
    lines = table(spark, sf_dir, "lineitem")
    o, s, group = F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_partkey") % 400
    members = lines.select((o % 10).alias("scope"), o.alias("cluster"), F.array(group).alias("groups"))
    met = lines.groupBy((s % 10).alias("scope"), s.alias("supplier"), group.alias("group")).agg(F.min("l_shipdate").alias("created"))
    suppliers = met.repartition("scope", "supplier").groupBy("scope", "supplier").agg(F.collect_list("group").alias("groups"), F.min("created").alias("created"))
    return members.select("scope", "cluster").distinct(), members, suppliers


def claimed_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as clusters of parts, and suppliers' lines as what was there before: who goes on what."""
    orders, members, suppliers = _orders_and_suppliers(spark, sf_dir)
    members = members.withColumn("order", F.col("cluster"))
    return linking.claimed_identities(orders, suppliers.withColumnRenamed("supplier", "prior"), ["scope"], "cluster", "order", "groups", "prior", "created", members).select("cluster", "identity")


def cluster_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with default and split identities: three orders share a default, and a quarter of the priors have one for a name."""
    orders, members, suppliers = _orders_and_suppliers(spark, sf_dir)
    c, s = F.col("cluster"), F.col("supplier")
    clusters = orders.select("scope", "cluster", c.alias("turn"), F.concat(F.lit("d"), F.floor(c / 30).cast("string")).alias("default_id"), F.concat(F.lit("s"), c.cast("string")).alias("split_id"))
    priors = suppliers.withColumn("prior", F.concat(F.when(s % 4 == 0, "d").otherwise("p"), s.cast("string")))
    return identity.identities(clusters, priors, ["scope"], members=members.withColumn("turn", c)).select("cluster", "identity", "source")


def uncancelled_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    out = linking.uncancelled(e.filter("event_type in ('purchase', 'view')"), e.filter("event_type = 'error' and value >= 60"), ["user_id"], "ts", F.col("value") >= 10, "event_id")
    return out.select("user_id", "event_id")


def pending_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that no processed line (of a part's first halves) names in exact part, number and flag."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_returnflag").alias("signature"))
    done = table(spark, sf_dir, "lineitem").filter("l_quantity > 25").select("l_partkey", "l_linenumber", F.col("l_returnflag").alias("signature"))
    return linking.pending(lines, done, ["l_partkey", "l_linenumber"], "signature").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))


def reconciled_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type against the one before it, by value in tens."""
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    e = _events(spark, sf_dir).withColumns({"n": F.row_number().over(w), "key": F.concat_ws(":", F.col("user_id").cast("string"), "event_type"), "payload": F.floor(F.col("value") / 10)})
    out = linking.reconciled(e.filter("n = 1").select("key", "payload"), e.filter("n = 2").select("key", "payload", (F.col("event_id") % 5 + 1).alias("revision")), "key", "payload")
    return out.select("key", "action", "revision")


def matching_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order with a line of a part of each brand, by brands, parts and lines."""
    part, lines, orders = (table(spark, sf_dir, t) for t in ("part", "lineitem", "orders"))
    evidence = lines.groupBy(F.col("l_orderkey").alias("candidate")).agg(F.collect_set("l_partkey").alias("evidence")).join(orders.select(F.col("o_orderkey").alias("candidate"), F.col("o_orderdate").alias("as_of")), "candidate")
    statuses = part.select(F.col("p_brand").alias("status_id"))
    return linking.matching_plans(statuses, part.select(F.col("p_brand").alias("status_id"), F.col("p_partkey").alias("observation")), part.select(F.col("p_partkey").alias("observation"), F.col("p_partkey").alias("signal")), evidence)


def confirmation_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    observations = e.select((F.col("event_id") / 3).cast("long").alias("status_id"), F.col("event_id").alias("observation"), F.floor(F.col("value") / 50).alias("rank"), F.col("ts").alias("seen"), F.col("ts").alias("published"))
    signals = e.filter("event_type <> 'click'").select(F.col("event_id").alias("observation"), (F.col("event_id") + 7).alias("signal"), (F.col("event_id") % 11).alias("available"))
    return linking.confirmation_timeline(observations, signals).select("status_id", "observation", "signal", "first_seen")


def continuity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    out = linking.continuity_order(e, "user_id", "event_id", F.col("event_type") == "purchase", F.col("value") > 30, F.col("ts") > _now())
    return out.select("user_id", "event_id", "continuity", "tier")


def source_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).filter("event_type = 'purchase'")
    rows = e.select("user_id", F.col("event_id").cast("string").alias("record"), F.when(F.col("event_id") % 2 == 0, F.array((F.col("event_id") % 50).cast("string"))).alias("refs"), F.array(F.when(F.col("value") > 20, F.concat(F.lit("g"), (F.col("event_id") % 3).cast("string")))).alias("groups"))
    out = linking.source_exclusions(rows, "user_id", "record", "refs", "groups")
    return out.select("user_id", F.array_join("records", ",").alias("records"), F.array_join("groups", ",").alias("groups"))


def historical_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).filter(F.col("ts") <= _now()).withColumn("w", F.col("value") / 500)
    out = linking.historical_peaks(e, ["user_id"], "ts", "w", _now(), 12.0, 6.0)
    return out.select("user_id", r6("peak"))


def linked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event candidates of each user: clusters in time, with state and hull."""
    e = _events(spark, sf_dir).withColumns({"phase": F.when(F.col("value") > 150, "completed").otherwise("expected"), "stance": F.when(F.col("event_type") == "error", "contradicts").otherwise("supports"), "until": tm.add_hours(F.col("ts"), F.col("value") / 30)})
    return linking.linked_events(e.select("user_id", "event_id", "ts", "until", "phase", "stance"), ["user_id"], "ts", "until", "event_id", "phase", "stance", 6.0, 12.0)


def horizon_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decayed evidence of five scopes for the 168 hours after a cutoff, from hourly sums of what was known then."""
    cutoff = F.lit("2024-01-21").cast("timestamp_ntz")
    e = _events(spark, sf_dir).filter(F.col("ts") < cutoff).withColumn("scope", F.col("user_id") % 5)
    out = training.hourly_decay(e.filter("event_type = 'error'"), ["scope"], "ts", 24.0, 336)
    return out.filter((F.col("slot") >= cutoff) & (F.col("slot") < cutoff + F.expr("interval 168 hours"))).select("scope", "slot", r6("decayed"))


def operator_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmations of operators that add an outcome: once for each user and day, unless one is stored for the day."""
    e = _events(spark, sf_dir)
    keyed = e.withColumn("natural_key", F.concat_ws("|", F.col("user_id").cast("string"), tm.day_key(F.col("ts"))))
    stored = keyed.filter("event_type = 'purchase'").select("natural_key").distinct()
    new = keyed.filter("event_type = 'click'").join(stored, "natural_key", "left_anti")
    return new.groupBy("natural_key").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.min("ts").alias("occurred"))


def largest_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numerically largest id of each type; ids are texts of up to 25 digits."""
    text = F.concat((F.col("event_id") + 1).cast("string"), F.lit("00000000000000000000"))
    return _events(spark, sf_dir).groupBy("event_type").agg(F.max(text.cast("decimal(38,0)")).cast("string").alias("cursor"))


def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight episodes (users) of the highest pressure, null ones last, then by last update; with their place."""
    e = _events(spark, sf_dir).groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", F.col("value"))).alias("pressure"), F.max("ts").alias("updated"))
    top = e.orderBy(F.desc_nulls_last("pressure"), F.desc("updated"), "user_id").limit(8)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("pressure"), F.desc("updated"), "user_id")))  # eight rows


QUERIES = {f.__name__: f for f in (speaking_signals, collapsed_updates, scored_clusters, claimed_identities, cluster_identities, uncancelled_supports, pending_observations, reconciled_signals, matching_plans, confirmation_timeline, continuity_order, source_exclusions, historical_peaks, linked_events, horizon_features, operator_outcomes, largest_cursors, display_order)}

_CLAIMS = """c AS (SELECT l_orderkey % 10 AS scope, l_orderkey AS cluster, list(DISTINCT l_partkey % 400) AS groups, 'd' || (l_orderkey // 30) AS default_id FROM lineitem GROUP BY 1, 2),
p AS (SELECT l_suppkey % 10 AS scope, CASE WHEN l_suppkey % 4 = 0 THEN 'd' ELSE 'p' END || l_suppkey AS prior, list(DISTINCT l_partkey % 400) AS groups, min(l_shipdate) AS created FROM lineitem GROUP BY 1, 2),
ow AS (SELECT scope, default_id AS prior, min(cluster) AS owner FROM c GROUP BY 1, 2),
n AS (SELECT c.*, row_number() OVER (PARTITION BY scope ORDER BY cluster) AS n FROM c),
f AS MATERIALIZED (SELECT n.scope, n.n, list(p.prior ORDER BY p.created, p.prior) AS fit FROM n JOIN p ON n.scope = p.scope AND list_has_any(n.groups, p.groups) LEFT JOIN ow ON ow.scope = p.scope AND ow.prior = p.prior WHERE ow.owner IS NULL OR ow.owner = n.cluster GROUP BY 1, 2),
m AS MATERIALIZED (SELECT n.scope, n.n, n.cluster, n.default_id, coalesce(f.fit, []) AS fit FROM n LEFT JOIN f ON n.scope = f.scope AND n.n = f.n),
r AS (SELECT scope, 0::BIGINT AS n, 0::BIGINT AS cluster, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS own, CAST(NULL AS VARCHAR) AS source FROM (SELECT DISTINCT scope FROM c)
  UNION ALL SELECT scope, n, cluster, list_append(taken, own), own, source FROM (
    SELECT *, coalesce(chosen, CASE WHEN list_contains(taken, default_id) THEN 's' || cluster ELSE default_id END) AS own, CASE WHEN chosen IS NOT NULL THEN 'prior' WHEN list_contains(taken, default_id) THEN 'split' ELSE 'default' END AS source
    FROM (SELECT m.scope, m.n, m.cluster, m.default_id, r.taken, list_filter(m.fit, lambda x: NOT list_contains(r.taken, x))[1] AS chosen FROM r JOIN m ON r.scope = m.scope AND m.n = r.n + 1)))"""

ORACLES = {
    "cluster_identities": f"WITH RECURSIVE {_CLAIMS} SELECT cluster, own AS identity, source FROM r WHERE n > 0",
    "speaking_signals": f"SELECT observation, event_id FROM (SELECT user_id || '@' || strftime(ts, '%Y-%m-%d') AS observation, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY floor(value / 40) DESC, event_type IN ('purchase', 'click') DESC, event_id % 3 = 0 DESC, ts DESC, event_id) AS r FROM events WHERE event_type <> 'view' AND ts <= TIMESTAMP '{NOW}') WHERE r = 1",
    "collapsed_updates": """WITH x AS (SELECT user_id || '@' || strftime(ts, '%Y-%m-%d') AS g, event_type, floor(value / 10) AS tens, ts, event_id FROM events), u AS (SELECT g, event_type, tens, min(ts) AS t, arg_min(event_id, ts) AS i FROM x GROUP BY 1, 2, 3),
k AS (SELECT g, string_agg(DISTINCT w, ',' ORDER BY w) AS tokens FROM (SELECT g, unnest([event_type, CAST(event_id % 4 AS VARCHAR)]) AS w FROM x) GROUP BY g)
SELECT u.g AS "group", min(t) AS first_at, max(t) AS last_at, arg_min(i, t) AS anchor_tie, arg_max(i, t) AS signal_tie, count(*) AS n_updates, min(tokens) AS tokens FROM u JOIN k ON u.g = k.g GROUP BY u.g""",
    "uncancelled_supports": "WITH a AS (SELECT user_id, max(ts) AS t FROM events WHERE event_type = 'error' AND value >= 60 GROUP BY 1), s AS (SELECT e.user_id, event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY ts DESC, event_id DESC) AS r FROM events e LEFT JOIN a ON a.user_id = e.user_id WHERE event_type IN ('purchase', 'view') AND (t IS NULL OR ts > t) AND value >= 10) SELECT user_id, event_id FROM s WHERE r = 1",
    "pending_observations": "SELECT l_partkey, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_quantity > 25 AND d.l_partkey = l.l_partkey AND d.l_linenumber = l.l_linenumber AND d.l_returnflag = l.l_returnflag) GROUP BY 1",
    "reconciled_signals": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n, user_id || ':' || event_type AS key, floor(value / 10) AS p FROM events)
SELECT a.key, CASE WHEN b.key IS NULL THEN 'new' WHEN a.p = b.p THEN 'kept' ELSE 'revised' END AS action, CAST(CASE WHEN b.key IS NULL THEN 1 WHEN a.p = b.p THEN b.event_id % 5 + 1 ELSE b.event_id % 5 + 2 END AS INTEGER) AS revision FROM r a LEFT JOIN r b ON b.key = a.key AND b.n = 2 WHERE a.n = 1""",
    "matching_plans": "SELECT p_brand AS status_id, l_orderkey AS candidate FROM (SELECT p_brand, l_orderkey, row_number() OVER (PARTITION BY p_brand ORDER BY o_orderdate DESC, l_orderkey DESC) AS r FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey) WHERE r = 1",
    "confirmation_timeline": """WITH o AS (SELECT event_id // 3 AS s, event_id, floor(value / 50) AS rk, ts, event_type FROM events), b AS (SELECT s, min(ts) AS first_seen, max(ts) AS p FROM o GROUP BY s), f AS (SELECT s, event_id FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY rk DESC, ts DESC, event_id DESC) AS r FROM o) WHERE r = 1),
g AS (SELECT s, event_id + 7 AS signal FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY event_id % 11 DESC, event_id DESC) AS r FROM o WHERE event_type <> 'click') WHERE r = 1)
SELECT b.s AS status_id, f.event_id AS observation, signal, first_seen FROM b JOIN f USING (s) LEFT JOIN g USING (s) ORDER BY p DESC, b.s LIMIT 12""",
    "continuity_order": f"SELECT user_id, event_id, CAST((event_type = 'purchase') AS INTEGER) * 4 + CAST((value > 30) AS INTEGER) * 2 + CAST((ts > TIMESTAMP '{NOW}') AS INTEGER) AS continuity, 8 - continuity AS tier FROM events e WHERE event_id = (SELECT max(event_id) FROM events x WHERE x.user_id = e.user_id)",
    "source_exclusions": "WITH p AS (SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase'), r AS (SELECT DISTINCT user_id, unnest(CASE WHEN event_id % 2 = 0 THEN [CAST(event_id AS VARCHAR), CAST(event_id % 50 AS VARCHAR)] ELSE [CAST(event_id AS VARCHAR)] END) AS x FROM p), g AS (SELECT DISTINCT user_id, 'g' || (event_id % 3) AS x FROM p WHERE value > 20) SELECT r.user_id, string_agg(x, ',' ORDER BY x) AS records, coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM g WHERE g.user_id = r.user_id), '') AS groups FROM r GROUP BY r.user_id",
    "historical_peaks": f"""WITH e AS (SELECT user_id, epoch_us(ts) AS t, value / 500 AS w FROM events WHERE ts <= TIMESTAMP '{NOW}'), n AS (SELECT epoch_us(TIMESTAMP '{NOW}') AS now),
s AS (SELECT DISTINCT user_id, unnest([now, t, CASE WHEN t > (SELECT min(t) FROM e x WHERE x.user_id = e.user_id) THEN t - 1000 END, least(now, t + 43200000000)]) AS a FROM e, n),
c AS (SELECT s.user_id, a, max(w) AS top, max(t) AS seen FROM s JOIN e ON e.user_id = s.user_id AND t <= a WHERE a IS NOT NULL GROUP BY 1, 2)
SELECT user_id, round(max(top * pow(0.5, floor(greatest(0, (a - seen) / 3.6e9 - 12)) / 6)), 6) + 0.0 AS peak FROM c GROUP BY user_id""",
    "linked_events": """WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, value > 150 AS done, event_type = 'error' AS against, epoch_us(ts) + CAST(round(value / 30 * 3.6e9) AS BIGINT) AS until FROM events),
f AS (SELECT user_id, n, ts, ts AS c FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, e.ts, CASE WHEN e.ts - f.ts > INTERVAL 6 HOUR OR e.ts - f.c > INTERVAL 12 HOUR THEN e.ts ELSE f.c END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, c AS cluster_start, make_timestamp(max(until)) AS cluster_end, count(*) AS n, CASE WHEN bool_or(done) THEN 'closed' WHEN count(*) FILTER (WHERE against) > count(*) FILTER (WHERE NOT against) THEN 'contradicted' WHEN bool_or(NOT against) THEN 'supported' ELSE 'open' END AS state FROM f JOIN e USING (user_id, n) GROUP BY user_id, c""",
    "horizon_features": "WITH s AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-21', TIMESTAMP '2024-01-27 23:00:00', INTERVAL 1 HOUR)) AS slot) SELECT user_id % 5 AS scope, slot, round(sum(pow(2, -(epoch_us(slot) - epoch_us(ts)) / 3.6e9 / 24)), 6) + 0.0 AS decayed FROM events JOIN s ON date_trunc('hour', ts) >= slot - INTERVAL 336 HOUR WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-21' GROUP BY 1, 2",
    "operator_outcomes": "WITH k AS (SELECT *, user_id || '|' || strftime(ts, '%Y-%m-%d') AS natural_key FROM events) SELECT natural_key, arg_min(event_id, ts) AS event_id, min(ts) AS occurred FROM k WHERE event_type = 'click' AND natural_key NOT IN (SELECT natural_key FROM k WHERE event_type = 'purchase') GROUP BY natural_key",
    "largest_cursors": "SELECT event_type, max(event_id + 1) || '00000000000000000000' AS cursor FROM events GROUP BY 1",
    "display_order": "WITH u AS (SELECT user_id, max(value) FILTER (WHERE event_type = 'error') AS pressure, max(ts) AS updated FROM events GROUP BY 1) SELECT *, row_number() OVER (ORDER BY pressure DESC NULLS LAST, updated DESC, user_id) AS place FROM u ORDER BY place LIMIT 8",
}
