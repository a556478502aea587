"""Queries over walk-forward folds of the hazard model and over challengers paired with a champion.

Where SQL judges, the challenger is the refitted rate by time of day of ``training_queries`` and
the champion is n / (n + 8) for the n events of a scope's hour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import time as tm
from tidemark.operators import evaluation, training
from tidemark.plans import model_queries, training_queries
from tidemark.plans.metric_queries import r6
from tidemark.plans.training_queries import _FOLDS, BASE, FORECASTS

HORIZON = 4  # hours of a window


def hourly_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with features and the event that they hold, known an hour later, and y: an event within HORIZON hours."""
    rows = model_queries._examples(spark, sf_dir)
    ahead = rows.filter("event is not null").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(HORIZON - 1)), lambda k: tm.from_micros(tm.micros(F.col("hour")) - k * tm.HOUR_US))).alias("hour")).distinct()
    rows = rows.join(ahead.withColumn("y", F.lit(1)), "hour", "left").withColumn("y", F.coalesce("y", F.lit(0)))
    return rows.withColumns({"known": tm.add_hours(F.col("hour"), 1), "window_end": tm.add_hours(F.col("hour"), HORIZON)})


def folded(rows: DataFrame) -> tuple[DataFrame, dict[int, object]]:
    """Test rows with their fold, and the origins; the first nine days only teach."""
    tests = training.folds(rows, [], "hour", 9)
    return tests, {r["fold"]: r["origin"] for r in tests.select("fold", "origin").distinct().collect()}  # a row a week


def walk_forward_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fold, hour, y, and the window's probability by the fold's model, its base rate and the first fold's model (the champion)."""
    examples = hourly_examples(spark, sf_dir)
    tests, origins = folded(examples)
    models = evaluation.fit_folds(examples, origins, model_queries.FEATURES, "event", "exposure", "known")
    scored = evaluation.score_folds(tests, models)
    if models:
        scored = evaluation.score_folds(scored, dict.fromkeys(models, models[min(models)]), "champion")
    rates = evaluation.base_rates(examples, origins, "event", "exposure", "known")
    met = scored.join(F.broadcast(rates), "fold")  # a row a fold
    window = {n: 1 - F.pow(1 - F.col(c), F.lit(float(HORIZON))) for n, c in (("p", "hazard"), ("baseline", "rate"), ("champion", "champion"))}
    return met.select("fold", "hour", "window_end", "y", *[c.alias(n) for n, c in window.items()])


def walk_forward_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each weekly fold of the hazard model, refitted for each, its calibration, and its deltas to the champion on the same rows."""
    rows = walk_forward_rows(spark, sf_dir)
    own = training.paired_scores(rows, ["fold"], "p", "baseline", "y")
    line = F.concat_ws("|", F.date_format("hour", "yyyy-MM-dd HH"), F.col("y").cast("string"))
    more = evaluation.fold_metrics(rows, ["fold"], "p", "y", line).drop("n")
    deltas = evaluation.paired_deltas(rows, ["fold"], "p", "champion", "y").drop("n")
    out = own.join(more, "fold").join(deltas, "fold")
    return out.select("fold", "n", "events", "rows_hash", *[F.round(c, 4).alias(c) for c in ("brier", "baseline_brier", "brier_skill", "log_loss", "ece", "brier_delta", "log_loss_delta", "brier_error")])


def _challenger(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = training_queries._forecasts(spark, sf_dir).withColumn("cell", F.hour("hour") % 6)
    tests = training_queries._tests(spark, sf_dir).withColumnRenamed("p", "champion")
    return training.refit_rates(history, tests, ["scope"], "cell", "hour", "y")


def paired_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.paired_deltas(_challenger(spark, sf_dir), ["scope", "fold"], "p", "champion", "y")
    return out.select("scope", "fold", "n", *[r6(c) for c in ("brier_delta", "log_loss_delta", "brier_error", "log_loss_error", "better_share")])


def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("|", F.date_format("hour", "yyyy-MM-dd HH"), F.col("y").cast("string"))
    out = evaluation.fold_metrics(_challenger(spark, sf_dir), ["scope", "fold"], "p", "y", line)
    return out.select("scope", "fold", "n", r6("ece"), "rows_hash")


def fold_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The champion's windows of at least one third are the alerts, outcomes in the folds' hours the events."""
    tests = _challenger(spark, sf_dir)
    alerts = tests.filter("champion >= 1.0 / 3").select("scope", "fold", F.col("hour").alias("window_start"), "window_end")
    hours = tests.select("scope", "fold", "hour")
    events = training_queries._outcomes(spark, sf_dir).filter("not ambiguous").select("scope", F.col("from_").alias("at"), tm.floor_hour(F.col("from_")).alias("hour")).join(hours, ["scope", "hour"])
    return evaluation.fold_recall(events, alerts, ["scope"], "at").select("scope", "fold", "events", "hits", r6("recall"))


QUERIES = {f.__name__: f for f in (walk_forward_model, paired_deltas, fold_metrics, fold_recall)}

_SCORED = f"""{BASE}, {FORECASTS}, {_FOLDS}, oc AS (SELECT DISTINCT scope, fold, origin FROM tests),
cl AS (SELECT oc.scope, oc.fold, x.cell, count(*) FILTER (WHERE x.window_end <= oc.origin) AS n, coalesce(sum(x.y) FILTER (WHERE x.window_end <= oc.origin), 0) AS s FROM oc JOIN x ON x.scope = oc.scope GROUP BY 1, 2, 3),
bs AS (SELECT *, (sum(s) OVER (PARTITION BY scope, fold) + 0.05) / (sum(n) OVER (PARTITION BY scope, fold) + 1.0) AS baseline FROM cl),
sc AS (SELECT t.scope, t.fold, t.hour, t.window_end, t.y, t.p AS champion, (s + baseline) / (n + 1.0) AS p FROM tests t JOIN bs USING (scope, fold, cell))"""
_LOSS = "(CASE WHEN y = 1 THEN -ln(greatest({0}, 1e-12)) ELSE -ln(1 - least({0}, 1 - 1e-12)) END)"

ORACLES = {
    "paired_deltas": f"""WITH {_SCORED}, d AS (SELECT scope, fold, pow(p - y, 2) - pow(champion - y, 2) AS b, {_LOSS.format("p")} - {_LOSS.format("champion")} AS l FROM sc)
SELECT scope, fold, count(*) AS n, round(avg(b), 6) + 0.0 AS brier_delta, round(avg(l), 6) + 0.0 AS log_loss_delta, round(stddev_samp(b) / sqrt(count(*)), 6) + 0.0 AS brier_error,
  round(stddev_samp(l) / sqrt(count(*)), 6) + 0.0 AS log_loss_error, round(count(*) FILTER (WHERE b < 0) / count(*), 6) + 0.0 AS better_share FROM d GROUP BY scope, fold""",
    "fold_metrics": f"""WITH {_SCORED}, gp AS (SELECT scope, fold, least(9, CAST(floor(p * 10 + 1e-12) AS INTEGER)) AS b, abs(sum(p) - sum(y)) AS gap FROM sc GROUP BY 1, 2, 3),
gs AS (SELECT scope, fold, sum(gap) AS gap FROM gp GROUP BY 1, 2)
SELECT scope, fold, count(*) AS n, round(min(gap) / count(*), 6) + 0.0 AS ece,
  'sha256:' || sha256(count(*) || ':' || CAST(sum(CAST('0x' || substr(md5(strftime(hour, '%Y-%m-%d %H') || '|' || y), 1, 15) AS BIGINT)) AS VARCHAR)) AS rows_hash
FROM sc JOIN gs USING (scope, fold) GROUP BY scope, fold""",
    "fold_recall": f"""WITH {_SCORED}, ev AS (SELECT o.scope, sc.fold, o.f, EXISTS (SELECT 1 FROM sc a WHERE a.scope = o.scope AND a.fold = sc.fold AND a.champion >= 1.0 / 3 AND a.hour < o.f AND a.window_end > o.f) AS hit
  FROM o JOIN sc ON sc.scope = o.scope AND sc.hour = date_trunc('hour', o.f) WHERE NOT o.ambiguous)
SELECT scope, fold, count(*) AS events, count(*) FILTER (WHERE hit) AS hits, round(count(*) FILTER (WHERE hit) / count(*), 6) + 0.0 AS recall FROM ev GROUP BY scope, fold""",
}
