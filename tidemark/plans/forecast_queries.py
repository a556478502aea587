"""Queries over forecasts as arrays of slots, with their oracles.

A day's forecast has its hours as slots, hazards as in the other queries; some are damaged on
purpose: hour 5 of days divisible by 3 misses, hour 7 of those divisible by 5 has another hazard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import arrays
from tidemark.functions import math as mt
from tidemark.functions import time as tm
from tidemark.operators import forecasts, hazard
from tidemark.plans.metric_queries import HOURS, daily_hours, r6
from tidemark.session import table


def _forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a day: slots as issued, from hazards that were later damaged."""
    curve = hazard.survival_curve(daily_hours(spark, sf_dir), ["day"], "hour")
    number = F.day("hour")
    kept = curve.filter(~((number % 3 == 0) & (F.hour("hour") == 5)))
    damaged = F.when((number % 5 == 0) & (F.hour("hour") == 7), F.col("hazard") + 0.001).otherwise(F.col("hazard"))
    slot = F.struct(F.col("hour").alias("start"), (F.col("hour") + F.expr("interval 1 hour")).alias("end"), damaged.alias("hazard"), F.col("first_probability").alias("first"), F.col("by_end_probability").alias("by_end"), F.col("rolling_probability").alias("rolling"))
    return kept.groupBy("day").agg(F.array_sort(F.collect_list(slot)).alias("slots"))  # at most 24 slots a day


def prediction_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forecasts(spark, sf_dir).select("day", F.array_join(forecasts.slot_faults(F.col("slots"), 1e-8), ",").alias("faults"))


def prediction_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = forecasts.largest_difference(F.col("slots"))
    return _forecasts(spark, sf_dir).select("day", (far <= 1e-10).alias("intact"), r6(far, "largest"))


def well_formed_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = F.to_date("day").cast("timestamp_ntz")
    rows = _forecasts(spark, sf_dir)
    return rows.select("day", *[forecasts.well_formed(F.col("slots"), anchor, anchor + F.expr(f"interval {late} minutes"), h).alias(f"h{h}") for h, late in ((4, 0), (24, -30), (25, 0))])


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("anchor"), tm.add_hours(F.date_trunc("day", "ts").cast("timestamp_ntz"), -(F.col("event_id") * 7 % 50) / 2).alias("issued"), (F.col("value") >= 10).alias("well"), F.concat(F.lit("model-"), (F.col("event_id") % 3).cast("string")).alias("release"))


def latest_by_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = forecasts.latest_by_anchor(_predictions(spark, sf_dir), "anchor", "issued", "event_id", F.col("well"), F.col("release") == "model-1")
    return out.select("anchor", "event_id", "malformed", "other_release", "superseded")


def usable_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    row = {"hash": F.sha2("event_type", 256), "stated_hash": F.when(F.col("event_id") % 7 == 0, "x").otherwise(F.sha2("event_type", 256)), "serving": F.col("event_type") != "error", "synthetic": F.col("event_type") == "signup", "cutoff": F.col("ts"), "issued": tm.add_hours(F.col("ts"), F.col("value") / 100), "expires": tm.add_hours(F.col("ts"), 30)}
    return e.select("event_id", forecasts.is_usable(row, F.lit("2024-01-20").cast("timestamp_ntz"), 24.0).alias("usable"))


def sparse_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = F.transform("slots", lambda s: s["by_end"])
    rows = _forecasts(spark, sf_dir).select("day", curve.alias("curve"))
    rows = rows.select("day", "curve", F.inline(forecasts.sparse_curve(F.col("curve"), (1, 4, 12, 23, 24, 48))))
    return rows.select("day", "horizon", r6("probability"))


def curve_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = F.transform("slots", lambda s: s["by_end"])
    rows = _forecasts(spark, sf_dir).select("day", curve.alias("curve"))
    rows = rows.withColumn("sparse", arrays.at_horizons(F.col("curve"), (4, 24)))
    found = forecasts.at_horizon(F.slice("curve", 1, 3), F.col("sparse"), F.lit(4))
    return rows.select("day", r6(found, "p4"), r6(forecasts.at_horizon(F.slice("curve", 1, 3), F.col("sparse"), F.lit(2)), "p2"), forecasts.at_horizon(F.slice("curve", 1, 3), F.col("sparse"), F.lit(7)).alias("p7"), arrays.is_monotone(F.col("curve")).alias("monotone"))


def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events' probabilities lie above each threshold of the grid, from one pass over counts by percent."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") * 37 % 1000).alias("k"))
    counts = e.groupBy("k").agg(F.count(F.lit(1)).alias("n"))  # at most a thousand rows
    grid = spark.range(1).select(F.explode(arrays.threshold_grid()).alias("threshold"))
    return grid.join(F.broadcast(counts), F.col("k") / 1000.0 > F.col("threshold"), "left").groupBy("threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def math_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial exposure, weight after an outcome, and halves that go up, of each event."""
    e = table(spark, sf_dir, "events")
    p = F.col("event_id") % 101 / 100.0
    weight = mt.post_outcome_weight(F.col("event_type") == "error", F.col("ts"), F.lit("2024-01-15").cast("timestamp_ntz"))
    half = F.col("event_id") % 8 / 8.0 - 0.5
    return e.select("event_id", r6(mt.exposure_hazard(p, F.col("event_id") % 5 / 4.0), "part"), weight.alias("weight"), mt.round_half_up(half, 2).alias("half_up"))


def contiguity_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of a user's events that do not follow on one another."""
    from tidemark.operators import sequences

    e = table(spark, sf_dir, "events").select("user_id", tm.floor_hour(F.col("ts")).alias("start")).distinct().withColumn("end", F.col("start") + F.expr("interval 1 hour"))
    return sequences.contiguity_breaks(e, ["user_id"], "start", "end").select("user_id", "start", "previous_end")


QUERIES = {f.__name__: f for f in (prediction_faults, prediction_integrity, well_formed_predictions, latest_by_anchor, usable_forecasts, sparse_horizons, curve_lookup, threshold_grid, math_scalars, contiguity_breaks)}

_CURVE = f"""{HOURS}, d0 AS (SELECT CAST(hour AS TIMESTAMP) AS hour, strftime(hour, '%Y-%m-%d') AS day, hazard FROM h),
d1 AS (SELECT *, coalesce(product(1 - hazard) OVER (PARTITION BY day ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS sp, product(1 - hazard) OVER (PARTITION BY day ORDER BY hour) AS sv, product(1 - hazard) OVER (PARTITION BY day ORDER BY hour ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS r4, count(*) OVER (PARTITION BY day ORDER BY hour ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS c4 FROM d0),
d2 AS (SELECT hour, day, hour(hour) AS hh, day(hour) AS dd, sp * hazard AS fst, 1 - sv AS bye, CASE WHEN c4 = 4 THEN 1 - r4 END AS rol, CASE WHEN day(hour) % 5 = 0 AND hour(hour) = 7 THEN hazard + 0.001 ELSE hazard END AS hz FROM d1),
d3 AS (SELECT * FROM d2 WHERE NOT (dd % 3 = 0 AND hh = 5))"""
_ANEW = """n1 AS (SELECT *, coalesce(product(1 - hz) OVER (PARTITION BY day ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS sp, product(1 - hz) OVER (PARTITION BY day ORDER BY hour ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS r4, count(*) OVER (PARTITION BY day ORDER BY hour ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS c4, lag(hour) OVER (PARTITION BY day ORDER BY hour) AS ph FROM d3),
n2 AS (SELECT day, dd, ph, hour, abs(fst - sp * hz) AS a, abs(bye - (1 - sp * (1 - hz))) AS b, CASE WHEN c4 = 4 THEN abs(rol - (1 - r4)) END AS c, (c4 = 4) <> (rol IS NOT NULL) AS cn FROM n1)"""

ORACLES = {
    "prediction_faults": f"WITH {_CURVE}, {_ANEW} SELECT day, concat_ws(',', CASE WHEN bool_or(ph + INTERVAL 1 HOUR <> hour) THEN 'slots_not_contiguous' END, CASE WHEN bool_or(a > 1e-8) THEN 'first_differs' END, CASE WHEN bool_or(b > 1e-8) THEN 'by_end_differs' END, CASE WHEN bool_or(cn OR c > 1e-8) THEN 'rolling_differs' END) AS faults FROM n2 GROUP BY day",
    "prediction_integrity": f"WITH {_CURVE}, {_ANEW} SELECT day, max(greatest(a, b, coalesce(c, 0))) <= 1e-10 AS intact, round(max(greatest(a, b, coalesce(c, 0))), 6) + 0.0 AS largest FROM n2 GROUP BY day",
    "well_formed_predictions": f"WITH {_CURVE}, x AS (SELECT day, count(*) FILTER (WHERE hh < 4) AS c4, count(*) AS c24 FROM d3 GROUP BY day) SELECT day, c4 = 4 AS h4, c24 = 24 AS h24, false AS h25 FROM x",
    "latest_by_anchor": """WITH p AS (SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS anchor, event_id * 7 % 50 AS back, value >= 10 AS well, event_id % 3 = 1 AS rel FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY anchor, well AND rel ORDER BY back, event_id) AS n FROM p), c AS (SELECT anchor, count(*) FILTER (WHERE NOT well) AS malformed, count(*) FILTER (WHERE well AND NOT rel) AS other_release, greatest(count(*) FILTER (WHERE well AND rel) - 1, 0) AS superseded FROM p GROUP BY anchor)
SELECT r.anchor, event_id, malformed, other_release, superseded FROM r JOIN c USING (anchor) WHERE n = 1 AND well AND rel""",
    "usable_forecasts": "WITH x AS (SELECT *, epoch_us(ts) + CAST(round(value / 100 * 3.6e9) AS BIGINT) AS issued, epoch_us(TIMESTAMP '2024-01-20') AS now FROM events) SELECT event_id, event_id % 7 <> 0 AND event_type NOT IN ('error', 'signup') AND issued <= now AND epoch_us(ts) + 108000000000 > now AND now - issued <= 86400000000 AS usable FROM x",
    "sparse_horizons": f"WITH {_CURVE}, k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY hour) AS horizon FROM d3) SELECT day, CAST(horizon AS INTEGER) AS horizon, round(bye, 6) + 0.0 AS probability FROM k WHERE horizon IN (1, 4, 12, 23, 24, 48)",
    "curve_lookup": f"WITH {_CURVE}, k AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY hour) AS n, lag(bye) OVER (PARTITION BY day ORDER BY hour) AS pb FROM d3) SELECT day, round(max(bye) FILTER (WHERE n = 4), 6) + 0.0 AS p4, round(max(bye) FILTER (WHERE n = 2), 6) + 0.0 AS p2, CAST(NULL AS DOUBLE) AS p7, coalesce(bool_and(pb <= bye), true) AS monotone FROM k GROUP BY day",
    "threshold_grid": "WITH g AS (SELECT i / 100.0::DOUBLE AS threshold FROM range(101) r(i)) SELECT threshold, count(event_id) AS n FROM g LEFT JOIN events ON event_id * 37 % 1000 / 1000.0::DOUBLE > threshold GROUP BY threshold",
    "math_scalars": "SELECT event_id, round(CASE WHEN event_id % 101 = 100 THEN 1 ELSE 1 - pow(1 - event_id % 101 / 100.0::DOUBLE, event_id % 5 / 4.0::DOUBLE) END, 6) + 0.0 AS part, CASE WHEN event_type = 'error' THEN 0.0 WHEN ts < TIMESTAMP '2024-01-15' THEN 0.5 ELSE 1.0 END::DOUBLE AS weight, floor((event_id % 8 / 8.0::DOUBLE - 0.5) * 100 + 0.5) / 100 AS half_up FROM events",
    "contiguity_breaks": "WITH h AS (SELECT DISTINCT user_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start FROM events), l AS (SELECT *, lag(start) OVER (PARTITION BY user_id ORDER BY start) + INTERVAL 1 HOUR AS previous_end FROM h) SELECT user_id, start, previous_end FROM l WHERE previous_end <> start",
}
