"""Queries over what streams keep: publications with their state, with oracles.

Subjects are user_id modulo 50.  Purchases are outcomes of their user, whose event number gives
the status; views are probabilities; clicks name the authority window of their day, which ends one
to three days later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import time as tm
from tidemark.operators import coverage
from tidemark.plans import coverage_queries
from tidemark.plans.coverage_queries import _CUTOFFS, _ISLANDS, _LATEST, ASSERTIONS
from tidemark.session import table, work_folder
from tidemark.streaming import projector, ring, settlement


def facts(events: DataFrame) -> DataFrame:
    ts, kind = F.col("ts").cast("timestamp"), F.col("event_type")
    is_outcome, is_authority = kind == "purchase", kind == "click"
    status = F.element_at(F.array(*[F.lit(x) for x in ("pending", "confirmed", "retracted", "withdrawn", "confirmed")]), (F.col("event_id") % 5 + 1).cast("int"))
    ends = F.expr("timestampadd(DAY, cast(1 + user_id % 3 as int), date_trunc('DAY', cast(ts as timestamp)))")
    return events.filter(kind.isin("purchase", "view", "click")).select(
        (F.col("user_id") % 50).alias("subject"),
        ts.alias("at"),
        F.col("event_id").alias("tie"),
        F.when(is_outcome, "outcome").when(is_authority, "authority").otherwise("probability").alias("kind"),
        F.when(is_outcome, F.col("user_id").cast("string")).when(is_authority, F.date_format("ts", "yyyy-MM-dd")).alias("entity"),
        F.when(is_outcome, status).alias("status"),
        F.when(~(kind == "view"), F.floor("value").cast("string")).alias("row"),
        F.when(kind == "view", F.col("event_id") * 37 % 1000 / F.lit(1000.0)).alias("value"),
        F.when(is_authority, ends).alias("ends"),
    )


def _until(rows: DataFrame) -> DataFrame:
    """Facts with the watermark that a stream over them ends with: an hour behind the last."""
    last = rows.agg(F.date_trunc("MILLISECOND", F.max("at")).alias("until")).select((F.col("until") - F.expr("interval 1 hour")).alias("until"))
    return rows.crossJoin(F.broadcast(last))  # a single row


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = projector.publications(_until(facts(table(spark, sf_dir, "events"))), "until")
    return out.withColumn("at", F.col("at").cast("timestamp_ntz"))


def streamed_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream with state and timers leaves it, over the table's files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = facts(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"))
    folder = work_folder(spark, "publications")
    run_stream(spark, projector.publication_stream(stream), f"{folder}/table", f"{folder}/checkpoint")
    return spark.read.schema(projector.OUTPUT).parquet(f"{folder}/table").withColumn("at", F.col("at").cast("timestamp_ntz"))


def run_stream(spark: SparkSession, out: DataFrame, path: str, checkpoint: str, tasks: int | None = None) -> None:
    """All that a stream with state has now, appended to a Parquet table; a new checkpoint's state is dealt over ``tasks``, or as the session has it."""
    settings = projector.PROVIDER | ({"spark.sql.shuffle.partitions": str(tasks)} if tasks else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def settlement_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of ``coverage_queries`` as windows, its assertions as coverage, purchases of 100 or more as outcomes known two days later.

    The revisions of an assertion are known in their order, when it was asserted.
    """
    a = coverage_queries.assertions(spark, sf_dir)
    eligible = (F.col("adequacy") == coverage.ELIGIBLE) & ~F.col("revoked")
    days = a.groupBy("user_id", "start").agg(F.max("end").alias("end"))
    hits = table(spark, sf_dir, "events").filter("event_type = 'purchase' and value >= 100")
    none = F.lit(0).cast("long")
    parts = [
        days.select(F.col("user_id").alias("subject"), F.col("start").alias("at"), none.alias("tie"), F.lit("window").alias("kind"), F.date_format("start", "yyyy-MM-dd").alias("entity"), none.alias("revision"), "start", "end", F.lit(None).cast("string").alias("status")),
        a.select(F.col("user_id").alias("subject"), F.col("asserted_at").alias("at"), F.col("event_id").alias("tie"), F.lit("coverage").alias("kind"), F.col("assertion_id").alias("entity"), F.col("revision").cast("long").alias("revision"), "start", "end", F.when(eligible, "eligible").otherwise("other").alias("status")),
        hits.select(F.col("user_id").alias("subject"), tm.add_hours(F.col("ts"), 48).alias("at"), F.col("event_id").alias("tie"), F.lit("outcome").alias("kind"), F.col("event_id").cast("string").alias("entity"), none.alias("revision"), F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 1 microsecond")).alias("end"), F.lit("confirmed").alias("status")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("subject", F.col("at").cast("timestamp").alias("at"), "tie", "kind", "entity", "revision", F.col("start").cast("timestamp").alias("start"), F.col("end").cast("timestamp").alias("end"), "status")


def _as_of(spark: SparkSession, facts_: DataFrame, history: DataFrame) -> DataFrame:
    local = history.withColumn("at", F.col("at").cast("timestamp_ntz"))
    windows = facts_.filter("kind = 'window'").select("subject", F.col("entity").alias("window"))
    return settlement.status_as_of(local, coverage_queries.cutoffs(spark), windows)


def settled_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses at four cutoffs, read from the history of all revisions."""
    facts_ = settlement_facts(spark, sf_dir)
    return _as_of(spark, facts_, settlement.settlement_history(facts_))


def streamed_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the revisions that a stream with state has written, its facts arriving as files in two parts.

    Some fifty users share a lane, and a core has four tasks, as each costs time in every batch.
    """
    folder = work_folder(spark, "settlement")
    facts_ = settlement_facts(spark, sf_dir)
    lanes = 1 + table(spark, sf_dir, "events").agg(F.approx_count_distinct("user_id")).first()[0] // 50
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    parts = facts_.withColumn("part", (F.col("at") >= F.lit("2024-01-16").cast("timestamp")).cast("int"))
    parts.write.partitionBy("part").parquet(f"{folder}/facts")
    for arrived in ("/part=0*", ""):  # a pattern, as there may be none; then all, of which the stream has seen the first
        stream = spark.readStream.schema(facts_.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/facts{arrived}").filter("at is not null")
        run_stream(spark, settlement.settlement_stream(stream, lanes=lanes), f"{folder}/table", f"{folder}/checkpoint", tasks)
    written = spark.read.schema(facts_.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/facts")
    return _as_of(spark, written, spark.read.schema(settlement.OUTPUT).parquet(f"{folder}/table"))


KEEP = 40


def ring_facts(events: DataFrame) -> DataFrame:
    """Topics are user_id modulo 20; errors set the gate of their day, other events are inputs keyed by tens of their value."""
    gate = F.col("event_type") == "error"
    return events.select(
        (F.col("user_id") % 20).alias("topic"),
        F.col("ts").cast("timestamp").alias("at"),
        F.col("event_id").alias("tie"),
        F.when(gate, "gate").otherwise("input").alias("kind"),
        F.when(gate, F.when(F.col("value") >= 5, F.date_format("ts", "yyyy-MM-dd"))).otherwise(F.floor(F.col("value") / 10).cast("string")).alias("key"),
        F.when(~gate, F.col("event_id").cast("string")).alias("payload"),
        F.when(gate, F.expr("cast(ts as timestamp) + make_dt_interval(0, cast(event_id % 5 - 2 as int))")).alias("known_at"),
    )


def _shown(ring_: DataFrame) -> DataFrame:
    return ring_.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("at", "gate_at")})


def input_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(ring.numbered(ring_facts(table(spark, sf_dir, "events")), KEEP))


def streamed_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream with state leaves it, over the table's files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = ring_facts(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"))
    folder = work_folder(spark, "inputs")
    run_stream(spark, ring.numbered_stream(stream, KEEP), f"{folder}/table", f"{folder}/checkpoint")
    return _shown(spark.read.schema(ring.OUTPUT).parquet(f"{folder}/table"))


def ring_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of five for readers with cursors near both ends of what is kept, and beyond them."""
    found = ring.numbered(ring_facts(table(spark, sf_dir, "events")), KEEP)
    ends = ring.bounds(found).withColumn("reader", F.explode(F.sequence(F.lit(0), F.lit(5))))
    after = F.element_at(F.array(F.col("floor") - 2, F.col("floor") - 1, F.col("tail") - 3, F.col("tail"), F.col("tail") + 1, F.col("floor") + 10), F.col("reader") + 1)
    return ring.ring_pages(found, ends.select("reader", "topic", after.alias("after")), 5)


QUERIES = {f.__name__: f for f in (publications, streamed_publications, settled_as_of, streamed_settlement, input_sequence, streamed_inputs, ring_pages)}

_PUBLICATIONS = """
WITH f AS (SELECT user_id % 50 AS subject, ts AS "at", event_id AS tie, event_type, CAST(user_id AS VARCHAR) AS entity, ['pending', 'confirmed', 'retracted', 'withdrawn', 'confirmed'][CAST(event_id % 5 + 1 AS INTEGER)] AS status,
  CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS "row", event_id * 37 % 1000 / 1000.0::DOUBLE AS v, strftime(ts, '%Y-%m-%d') AS day, CAST(date_trunc('day', ts) AS TIMESTAMP) + to_days(CAST(1 + user_id % 3 AS INTEGER)) AS ends FROM events),
u AS (SELECT date_trunc('millisecond', max("at")) - INTERVAL 1 HOUR AS until FROM f WHERE event_type IN ('purchase', 'view', 'click')),
o AS (SELECT *, lag(status) OVER w AS was, lag("row") OVER w AS was_row FROM f WHERE event_type = 'purchase' AND status <> 'pending' WINDOW w AS (PARTITION BY subject, entity ORDER BY "at", tie)),
k AS (SELECT *, CASE WHEN status = 'confirmed' AND coalesce(was <> 'confirmed', true) THEN 'confirmed' WHEN status = 'confirmed' AND was_row <> "row" THEN 'corrected' WHEN status <> 'confirmed' AND was = 'confirmed' THEN status END AS kind FROM o),
p AS (SELECT *, coalesce(last_value(CASE WHEN v >= 0.5 THEN 1 WHEN v <= 0.3 THEN 0 END IGNORE NULLS) OVER (PARTITION BY subject ORDER BY "at", tie ROWS UNBOUNDED PRECEDING), 0) AS active FROM f WHERE event_type = 'view'),
c AS (SELECT *, lag(active) OVER (PARTITION BY subject ORDER BY "at", tie) AS before FROM p),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, day, ends ORDER BY "at", tie) AS n FROM f WHERE event_type = 'click') WHERE n = 1)
SELECT subject, "at", kind, entity, "row" FROM k WHERE kind IS NOT NULL
UNION ALL SELECT subject, "at", CASE WHEN active = 1 THEN 'opened' ELSE 'closed' END, NULL, NULL FROM c WHERE before <> active
UNION ALL SELECT subject, "at", 'authority_opened', day, "row" FROM a
UNION ALL SELECT subject, ends, 'authority_ended', day, "row" FROM a, u WHERE ends <= until"""

_SETTLED = f"""WITH {ASSERTIONS}, {_CUTOFFS}, {_LATEST.format(available='asserted_at')}, {_ISLANDS},
d AS (SELECT user_id, s, max(e) AS e FROM a GROUP BY user_id, s), h AS (SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS s, min(ts) + INTERVAL 48 HOUR AS known FROM events WHERE event_type = 'purchase' AND value >= 100 GROUP BY 1, 2)
SELECT k.cutoff, d.user_id AS subject, strftime(d.s, '%Y-%m-%d') AS window, CASE WHEN d.e > k.cutoff THEN 'pending' WHEN h.known <= k.cutoff THEN 'positive' WHEN EXISTS (SELECT 1 FROM m WHERE m.cutoff = k.cutoff AND m.user_id = d.user_id AND m.s <= d.s AND m.e >= d.e) THEN 'negative' ELSE 'censored' END AS status
FROM d CROSS JOIN k LEFT JOIN h ON h.user_id = d.user_id AND h.s = d.s"""

_RING = f"""f AS (SELECT user_id % 20 AS topic, ts, event_id, event_type = 'error' AS gate, CASE WHEN event_type <> 'error' THEN CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) WHEN value >= 5 THEN strftime(ts, '%Y-%m-%d') END AS key, ts + to_hours(CAST(event_id % 5 - 2 AS INTEGER)) AS known FROM events),
g AS (SELECT * FROM (SELECT *, row_number() OVER w AS n, lag(key) OVER w AS was FROM f WHERE gate WINDOW w AS (PARTITION BY topic ORDER BY ts, event_id)) WHERE was IS DISTINCT FROM key),
i AS (SELECT topic, ts, event_id, key, row_number() OVER (PARTITION BY topic ORDER BY ts, event_id) AS sequence FROM (SELECT *, lag(key) OVER (PARTITION BY topic ORDER BY ts, event_id) AS was FROM f WHERE NOT gate) WHERE was IS NULL OR was <> key),
c AS (SELECT i.*, (SELECT arg_max({{'gate': g.key, 'gate_at': CASE WHEN g.key IS NOT NULL THEN greatest(g.known, g.ts) END}}, {{'t': g.ts, 'i': g.event_id}}) FROM g WHERE g.topic = i.topic AND (g.ts < i.ts OR (g.ts = i.ts AND g.event_id < i.event_id))) AS gt FROM i),
rg AS (SELECT topic, sequence, ts AS "at", key, CAST(event_id AS VARCHAR) AS payload, greatest(1, sequence - {KEEP} + 1) AS floor, gt.gate AS gate, gt.gate_at AS gate_at FROM c)"""

ORACLES = {
    "input_sequence": f"WITH {_RING} SELECT * FROM rg",
    "streamed_inputs": f"WITH {_RING} SELECT * FROM rg",
    "ring_pages": f"""WITH {_RING}, b AS (SELECT topic, max(floor) AS fl, max(sequence) AS tl FROM rg GROUP BY topic),
k AS (SELECT topic, fl, tl, CAST(r AS INTEGER) AS reader, [fl - 2, fl - 1, tl - 3, tl, tl + 1, fl + 10][r + 1] AS after FROM b, range(6) x(r)),
s AS (SELECT *, CASE WHEN after > tl THEN 'ahead_of_tail' WHEN after < fl - 1 THEN 'retention_gap' ELSE 'ok' END AS status FROM k)
SELECT reader, s.topic, status, sequence, key, payload FROM s LEFT JOIN rg ON rg.topic = s.topic AND sequence > after AND sequence <= after + 5 AND status = 'ok'""",
    "settled_as_of": _SETTLED, "streamed_settlement": _SETTLED, "publications": _PUBLICATIONS, "streamed_publications": _PUBLICATIONS}
