"""Queries over features, models, traffic and stateful operators, with oracles where SQL has them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import time as tm
from tidemark.operators import features, hazard, model, training
from tidemark.plans.metric_queries import hours, r6
from tidemark.session import stored, table, work_folder
from tidemark.sources import records
from tidemark.streaming import ledger, subscriptions, traffic

CUTOFF = "2024-01-22"


def _targets(spark: SparkSession) -> DataFrame:
    start = F.lit(CUTOFF).cast("timestamp_ntz")
    return spark.range(168).select((start + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("target"))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(F.col("ts") <= F.lit(CUTOFF).cast("timestamp_ntz"))


def renewal_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = _known(spark, sf_dir).filter("event_type = 'purchase' and value >= 250")
    out = features.recurrence(_targets(spark), outcomes, "target", "ts")
    return out.select("target", r6("renewal"), r6("daily"), r6("weekly"), r6("combined"))


def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _known(spark, sf_dir)
    out = features.decayed(_targets(spark), known, "target", "ts", F.col("event_type") == "error", (F.col("event_type") == "view") & (F.col("value") >= 100))
    out = features.calendar(out, "target")
    return out.select("target", r6("incident_decay"), r6("rival_decay"), r6("weekly_sin_1"), r6("weekly_cos_3"), r6("daily_sin_2"))


def full_feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fourteen features of each target hour; asserted ranges are those of large clicks, two hours to a day ahead."""
    known = _known(spark, sf_dir)
    ranges = known.filter("event_type = 'click' and value >= 40").select(tm.add_hours(F.col("ts"), 2).alias("from_"), tm.add_hours(F.col("ts"), F.col("value") / 4).alias("to"), (F.col("event_id") % 10 / 10.0).alias("w"))
    out = features.recurrence(_targets(spark), known.filter("event_type = 'purchase' and value >= 250"), "target", "ts")
    out = features.decayed(out, known, "target", "ts", F.col("event_type") == "error", (F.col("event_type") == "view") & (F.col("value") >= 100))
    out = features.calendar(features.asserted_overlap(out, ranges, "target", "from_", "to", "w"), "target")
    return out.select("target", *[r6(c) for c in features.VECTOR])


def quality_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    q = features.data_quality(F.col("value") / 10, F.col("event_id") % 40, F.lit(None).cast("double"))
    return e.select("event_id", q.alias("q")).select("event_id", "q.coverage", "q.max_delay_seconds", r6("q.sample_sufficiency", "sufficiency"), "q.out_of_distribution")


def _load(evidence: DataFrame) -> DataFrame:
    """hour and load: decayed errors that were known at each full hour."""
    return training.hourly_decay(evidence.filter("event_type = 'error'"), [], "ts", 24.0, 240).withColumnsRenamed({"slot": "hour", "decayed": "load"})


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with what was known at their start; the event of an hour is its first purchase of 250 or more."""
    h = features.calendar(hours(spark, sf_dir), "hour").join(_load(table(spark, sf_dir, "events")), "hour", "left").withColumn("load", F.coalesce("load", F.lit(0.0)))
    hit = table(spark, sf_dir, "events").filter("event_type = 'purchase' and value >= 250").groupBy(tm.floor_hour(F.col("ts")).alias("hour")).agg(F.min("event_id").alias("event"))
    return h.join(hit, "hour", "left").withColumn("exposure", F.lit(1.0))


FEATURES = ("load", "daily_sin_1", "daily_cos_1")


def hazard_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model.fit(_examples(spark, sf_dir), FEATURES, "event", "exposure")
    rows = [(name, round(w, 3)) for name, w in zip(("intercept", *FEATURES), m.weights, strict=True)]
    return spark.createDataFrame(rows, "name string, weight double")


def issued_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit before the cutoff, score 168 target hours, damp after the last outcome, derive the probability slots."""
    cutoff = F.lit(CUTOFF).cast("timestamp_ntz")
    examples = _examples(spark, sf_dir)
    m = model.fit(examples.filter(F.col("hour") < cutoff), FEATURES, "event", "exposure")
    known = _load(_known(spark, sf_dir)).withColumnRenamed("hour", "target")
    slots = features.calendar(_targets(spark), "target").join(known, "target", "left").withColumn("load", F.coalesce("load", F.lit(0.0)))
    scored = model.score(slots, m)
    last = _known(spark, sf_dir).filter("event_type = 'purchase' and value >= 250").agg(F.max("ts").alias("last"))
    damped = scored.crossJoin(F.broadcast(last)).withColumn("hazard", F.col("hazard") * hazard.refractory(tm.hours_between(F.col("target"), F.col("last"))))
    curve = hazard.survival_curve(damped.withColumn("forecast", F.lit(1)), ["forecast"], "target")
    return curve.select("target", F.round("hazard", 4).alias("hazard"), F.round("by_end_probability", 4).alias("by_end_probability"), F.round("rolling_probability", 4).alias("rolling_probability"))


def minute_latency_hist_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily 95th percentiles from merged minute histograms, values taken as latencies."""
    minutes = traffic.minute_metrics(table(spark, sf_dir, "events"), "ts", "value", F.col("event_type") == "error")
    days = traffic.rollup(minutes, [], F.to_date("window_start"))
    return days.select(F.col("period").alias("day"), "requests", "failures", traffic.percentile(F.col("latency"), 0.95, F.col("largest")).alias("p95"))


def sliding_5min(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = traffic.minute_metrics(table(spark, sf_dir, "events"), "ts", "value", F.col("event_type") == "error", width="5 minutes", slide="1 minute")
    return out.select("window_start", "requests", "failures", "largest")


def _forecast_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    us = tm.micros(F.col("ts"))
    outcome = (us / F.lit(5 * 24 * tm.HOUR_US)).cast("long")  # the known outcomes change every five days
    return e.select(F.col("user_id").alias("subscriber"), F.col("event_id").cast("string").alias("prediction"), us.alias("issued"), us.alias("emitted"), (us + 6 * tm.HOUR_US).alias("expires"), us.alias("cutoff"), (F.col("event_id") * 37 % 1000 / F.lit(1000.0)).alias("probability"), outcome.cast("string").alias("outcome"), F.lit(-1).cast("long").alias("outcome_known"), (us + 60_000_000).alias("now"), F.lit(0.7).alias("threshold"))


def hysteresis_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = subscriptions.replay(_forecast_inputs(spark, sf_dir))
    return out.filter("announcement is not null").select("subscriber", "prediction", "reason", "announcement")


def publication_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors published in two batches, one entry a user and day; the second batch repeats part of the first."""
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    c = e.select(F.col("event_id").cast("string").alias("event_id"), F.concat_ws("|", F.col("user_id").cast("string"), tm.day_key(F.col("ts"))).alias("delivery_key"), "ts", F.col("event_id").alias("n"))
    first = stored(ledger.next_entries(c.filter("ts < timestamp_ntz'2024-01-15'"), None, ["ts", "n"]), "ledger")
    second = ledger.next_entries(c.filter("ts >= timestamp_ntz'2024-01-10'"), first, ["ts", "n"])
    return first.unionByName(second).select("event_id", "delivery_key", "sequence")


def synthetic_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.synthetic_history(spark).select("post_id", "cycle", "published_at")


def streamed_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly metrics as a stream leaves them: files in, changed windows out as Parquet, everything processed."""
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = work_folder(spark, "minutes")
    windows = traffic.minute_metrics(stream, "ts", "value", F.col("event_type") == "error", width="1 hour", late="10 minutes")
    traffic.keep_windows(windows, f"{folder}/table", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = traffic.latest_windows(spark.read.parquet(f"{folder}/table"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "requests", "failures", "largest")


def window_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each hour's number of requests changed from the hour with requests before it."""
    hourly = traffic.minute_metrics(table(spark, sf_dir, "events"), "ts", "value", F.col("event_type") == "error", keys=["event_type"], width="1 hour")
    return traffic.rate_of_change(hourly, ["event_type"], "window_start", "requests").select("window_start", "event_type", "change")


QUERIES = {f.__name__: f for f in (renewal_kernel, feature_vector, full_feature_vector, quality_steps, hazard_fit, issued_forecast, minute_latency_hist_p95, sliding_5min, hysteresis_crossings, publication_ledger, synthetic_history, streamed_minutes, window_changes)}

_TARGETS = f"t AS (SELECT TIMESTAMP '{CUTOFF}' + to_hours(CAST(i AS INTEGER)) AS target FROM range(168) r(i))"
_DIST = "least(abs({a} - {b}) % {p}, {p} - abs({a} - {b}) % {p})"
_BUCKETS = [None, *traffic.BOUNDS, None]
_P95 = "CASE " + " ".join(f"WHEN count(*) FILTER (WHERE value <= {b}) >= ceil(count(*) * 0.95::DOUBLE) THEN least({b}::DOUBLE, max(value))" for b in traffic.BOUNDS) + " ELSE max(value) END"

_KERNELS = f"""{_TARGETS}, o AS (SELECT epoch_us(ts) / 3.6e9 AS h, floor(epoch_us(ts) / 6e7) / 60 AS m FROM events WHERE event_type = 'purchase' AND value >= 250 AND ts <= TIMESTAMP '{CUTOFF}'),
g AS (SELECT h - lag(h) OVER (ORDER BY h) AS g FROM o), x AS (SELECT target, epoch_us(target) / 3.6e9 AS a FROM t),
r AS (SELECT target, avg(exp(-0.5 * pow(ln(1 + a - (SELECT max(h) FROM o)) - ln(1 + g), 2))) AS renewal FROM x, g WHERE g IS NOT NULL GROUP BY target, a),
d AS (SELECT target, avg(exp(-0.5 * pow({_DIST.format(a='a % 24', b='m % 24', p=24)} / 6, 2))) AS daily, avg(exp(-0.5 * pow({_DIST.format(a='(a + 72) % 168', b='(m + 72) % 168', p=168)} / 36, 2))) AS weekly FROM x, o GROUP BY target)"""

ORACLES = {
    "renewal_kernel": f"""WITH {_KERNELS} SELECT d.target, round(coalesce(renewal, 0), 6) AS renewal, round(daily, 6) AS daily, round(weekly, 6) AS weekly, round(coalesce(renewal, 0) + daily + 0.5 * weekly, 6) AS combined FROM d LEFT JOIN r ON d.target = r.target""",
    "feature_vector": f"""WITH {_TARGETS}, e AS (SELECT *, (epoch_us(target) - epoch_us(ts)) / 3.6e9 AS age FROM t JOIN events ON ts <= TIMESTAMP '{CUTOFF}' AND ts <= target AND ts >= target - INTERVAL 14 DAY),
s AS (SELECT target, sum(pow(2, -age / 24)) FILTER (WHERE event_type = 'error') AS i, max(pow(2, -age / 36)) FILTER (WHERE event_type = 'view' AND value >= 100) AS r FROM e GROUP BY target)
SELECT t.target, round(coalesce(i, 0), 6) AS incident_decay, round(coalesce(r, 0), 6) AS rival_decay, round(sin(2 * pi() * ((isodow(t.target) - 1) * 24 + hour(t.target)) / 168), 6) + 0.0 AS weekly_sin_1, round(cos(6 * pi() * ((isodow(t.target) - 1) * 24 + hour(t.target)) / 168), 6) + 0.0 AS weekly_cos_3, round(sin(4 * pi() * hour(t.target) / 24), 6) + 0.0 AS daily_sin_2 FROM t LEFT JOIN s ON t.target = s.target""",
    "full_feature_vector": f"""WITH {_KERNELS}, e AS (SELECT *, (epoch_us(target) - epoch_us(ts)) / 3.6e9 AS age FROM t JOIN events ON ts <= TIMESTAMP '{CUTOFF}' AND ts <= target AND ts >= target - INTERVAL 14 DAY),
s AS (SELECT target, sum(pow(2, -age / 24)) FILTER (WHERE event_type = 'error') AS i, max(pow(2, -age / 36)) FILTER (WHERE event_type = 'view' AND value >= 100) AS r FROM e GROUP BY target),
c AS (SELECT epoch_us(ts) + 7200000000 AS f, epoch_us(ts) + CAST(round(value / 4 * 3.6e9) AS BIGINT) AS u, event_id % 10 / 10.0::DOUBLE AS w FROM events WHERE event_type = 'click' AND value >= 40 AND ts <= TIMESTAMP '{CUTOFF}'),
v AS (SELECT target, sum(w * (least(u, epoch_us(target) + 3600000000) - greatest(f, epoch_us(target))) / 3.6e9) AS a FROM t JOIN c ON f < epoch_us(target) + 3600000000 AND u > epoch_us(target) AND u - f BETWEEN 1 AND 172800000000 GROUP BY target),
z AS (SELECT t.target, (isodow(t.target) - 1) * 24 + hour(t.target) AS p, hour(t.target) AS q, coalesce(renewal, 0) + coalesce(daily, 0) + 0.5 * coalesce(weekly, 0) AS k, coalesce(a, 0) AS a, coalesce(i, 0) AS i, coalesce(s.r, 0) AS r FROM t LEFT JOIN d ON d.target = t.target LEFT JOIN r ON r.target = t.target LEFT JOIN s ON s.target = t.target LEFT JOIN v ON v.target = t.target)
SELECT target, {', '.join(f'round({f}(2 * pi() * {k} * p / 168), 6) + 0.0 AS weekly_{f}_{k}' for k in (1, 2, 3) for f in ('sin', 'cos'))}, {', '.join(f'round({f}(2 * pi() * {k} * q / 24), 6) + 0.0 AS daily_{f}_{k}' for k in (1, 2) for f in ('sin', 'cos'))}, round(k, 6) + 0.0 AS combined, round(a, 6) + 0.0 AS asserted, round(i, 6) + 0.0 AS incident_decay, round(r, 6) + 0.0 AS rival_decay FROM z""",
    "quality_steps": "WITH q AS (SELECT event_id, value / 10 AS d, event_id % 40 AS n, CASE WHEN value / 10 <= 2 THEN 1.0 WHEN value / 10 <= 6 THEN 0.8 WHEN value / 10 <= 24 THEN 0.4 ELSE 0.1 END::DOUBLE AS coverage FROM events) SELECT event_id, coverage, CAST(round(least(d, 168) * 3600) AS BIGINT) AS max_delay_seconds, round(least(1, n / 20.0::DOUBLE), 6) AS sufficiency, n < 20 OR d > 6 OR coverage < 0.5 AS out_of_distribution FROM q",
    "hysteresis_crossings": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_id * 37 % 1000 / 1000.0::DOUBLE AS p, epoch_us(ts) // 432000000000 AS o, row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS n FROM events),
w AS (SELECT user_id, event_id, n, t, o, p > 0.7::DOUBLE AS active, false AS told, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS announcement FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN e.t <= w.t THEN w.t ELSE e.t END, CASE WHEN e.t <= w.t THEN w.o ELSE e.o END,
    CASE WHEN e.t <= w.t THEN w.active WHEN w.active AND e.o <> w.o THEN false WHEN NOT w.active AND e.p > 0.7::DOUBLE THEN true WHEN w.active AND e.p <= 0.7::DOUBLE - 0.05::DOUBLE THEN false ELSE w.active END,
    CASE WHEN e.t <= w.t THEN w.told WHEN w.active AND e.o <> w.o THEN false WHEN NOT w.active AND e.p > 0.7::DOUBLE THEN true WHEN w.active AND e.p <= 0.7::DOUBLE - 0.05::DOUBLE THEN false ELSE w.told END,
    CASE WHEN e.t <= w.t THEN NULL WHEN w.active AND e.o <> w.o THEN 'outcome_revision_closed_episode' WHEN NOT w.active AND e.p > 0.7::DOUBLE THEN 'probability_above_threshold' WHEN w.active AND e.p <= 0.7::DOUBLE - 0.05::DOUBLE THEN 'probability_below_hysteresis_threshold' END,
    CASE WHEN e.t <= w.t THEN NULL WHEN w.active AND (e.o <> w.o OR e.p <= 0.7::DOUBLE - 0.05::DOUBLE) THEN CASE WHEN w.told THEN 'closed' END WHEN NOT w.active AND e.p > 0.7::DOUBLE THEN 'opened' END
  FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id AS subscriber, CAST(event_id AS VARCHAR) AS prediction, reason, announcement FROM w WHERE announcement IS NOT NULL""",
    "minute_latency_hist_p95": f"SELECT CAST(ts AS DATE) AS day, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS failures, {_P95} AS p95 FROM events GROUP BY 1",
    "sliding_5min": "SELECT date_trunc('minute', ts) - to_minutes(CAST(k AS INTEGER)) AS window_start, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS failures, max(value) AS largest FROM events, range(5) r(k) GROUP BY 1",
    "publication_ledger": "WITH c AS (SELECT event_id, user_id || '|' || strftime(ts, '%Y-%m-%d') AS delivery_key, ts FROM events WHERE event_type = 'error'), f AS (SELECT *, row_number() OVER (PARTITION BY delivery_key ORDER BY ts, event_id) AS k FROM c) SELECT CAST(event_id AS VARCHAR) AS event_id, delivery_key, row_number() OVER (ORDER BY ts, event_id) AS sequence FROM f WHERE k = 1",
    "window_changes": "WITH h AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT window_start, event_type, n - lag(n) OVER (PARTITION BY event_type ORDER BY window_start) AS change FROM h",
    "synthetic_history": "WITH c AS (SELECT i AS id, (i // 3) * 26 + CASE i % 3 WHEN 0 THEN 0 WHEN 1 THEN 8 ELSE 16 END AS day FROM range(140) r(i)) SELECT 'demo-' || id || '-' || k AS post_id, id AS cycle, TIMESTAMP '2026-01-01 18:00:00' + to_days(CAST(day AS INTEGER)) + to_hours(h) AS published_at FROM c, (VALUES (0, -30), (1, -20), (2, -6), (3, 0), (4, 12)) v(k, h) WHERE day < 140",
    "streamed_minutes": "SELECT date_trunc('hour', ts) AS window_start, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS failures, max(value) AS largest FROM events GROUP BY 1",
}
