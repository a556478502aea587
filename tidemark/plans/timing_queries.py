"""Queries over the times that posts state, with their oracle: a cascade of one rule after the other.

An event is a post: one of the phrases, with numbers of the event in it, in one of four frames; its
phase follows from the event's type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import timephrases as tp
from tidemark.session import table

PHRASES = (
    "in the next {a} minutes", "within {a} minutes", "back in a few minutes", "next few minutes", "in the next {a} to {b} hours", "next {a}-{b} hours",
    "in {b} hours", "over {b} hours", "give us {b} hours", "over the next {b} hours", "in the next hour", "within the next couple of hours",
    "see you in a few hours", "tomorrow morning", "tomorrow", "this evening", "later today", "on Friday", "in a bit", "now",
    "in {b} hours, or in the next {a} minutes", "soon", "have been reset", "",
)
FRAMES = ("The quota reset lands {p}. Thanks!", "Login is fixed. Limits are coming back {p}", "Lunch {p}?\nThe refill is on its way", "Hello {p}")
PHASES = {"view": "scheduled", "click": "started", "purchase": "completed", "error": "expected"}


def _post(event: Column, user: Column) -> Column:
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (event % len(PHRASES) + 1).cast("int"))
    phrase = F.replace(F.replace(phrase, F.lit("{a}"), (event % 11 * 7).cast("string")), F.lit("{b}"), (user % 60).cast("string"))
    frame = F.element_at(F.array(*map(F.lit, FRAMES)), (F.floor(event / len(PHRASES)) % len(FRAMES) + 1).cast("int"))
    return F.replace(frame, F.lit("{p}"), phrase)


def stated_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range that each post states, with and without named weekdays."""
    e = table(spark, sf_dir, "events")
    phase = F.lit("rumor")
    for kind, name in PHASES.items():
        phase = F.when(F.col("event_type") == kind, name).otherwise(phase)
    posts = e.select("event_id", "ts", phase.alias("phase"), _post(F.col("event_id"), F.col("user_id")).alias("text"))
    # a column of its own before the fields are taken, so that the grammar is applied once
    said = posts.withColumn("r", tp.stated_range(F.col("text"), F.col("ts"), F.col("phase"))).withColumn("w", tp.stated_range(F.col("text"), F.col("ts"), F.col("phase"), weekdays=True))
    return said.select("event_id", "r.start", "r.end", "r.precision", F.col("w.start").alias("weekday_start"), F.col("w.end").alias("weekday_end"))


QUERIES = {"stated_times": stated_times}


def _quoted(text: str) -> str:
    return "'" + text.replace("\n", "' || chr(10) || '") + "'"


def _case(column: str, texts: tuple[str, ...]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN {_quoted(t)}" for i, t in enumerate(texts)) + " END"


_WORDS = "next|within|over|in|later|tomorrow|tonight|evening|morning|monday|tuesday|wednesday|thursday|friday|saturday|sunday|minutes?|hours?|soon|incoming"
_ACTS = "land(?:s|ing)?|arriv(?:es?|ing)|coming|showing|back|return(?:s|ed|ing)?|give us"
_CASCADE = (
    (r"next\s+([0-9]{1,3})\s+minutes?", "to_minutes(CAST(nullif({x}, '0') AS INTEGER))", "minute"),
    (r"(back in|within|in|over)\s+(?:the next\s+)?(?:a\s+)?few minutes", "INTERVAL 30 MINUTE", "minute"),
    (r"next\s+[0-9]{1,3}\s*(?:-|to)\s*([0-9]{1,3})\s+hours?", "to_hours(CAST(CASE WHEN CAST({x} AS INTEGER) >= CAST({low} AS INTEGER) AND CAST({low} AS INTEGER) > 0 THEN {x} END AS INTEGER))", "hour"),
    (r"(?:next|in|within|give us)\s+([0-9]{1,3})\s+hours?", "to_hours(CAST(nullif({x}, '0') AS INTEGER))", "hour"),
    (r"(next hour)", "INTERVAL 1 HOUR", "hour"),
    (r"(next (?:few|couple of) hours|(?:back|see you) in (?:a )?few hours)", "INTERVAL 3 HOUR", "hour"),
)


def _cascade(weekday: bool) -> str:
    day = "date_trunc('day', ts)"
    rules = []
    for pattern, length, precision in _CASCADE:
        x = f"nullif(regexp_extract(said, '(?i)\\b{pattern}\\b', 1), '')"
        low = "regexp_extract(said, '(?i)next\\s+([0-9]{1,3})\\s*(?:-|to)', 1)"
        end = f"ts + {length.format(x=x, low=low)}"
        rules.append(f"WHEN {x} IS NOT NULL AND {end} IS NOT NULL THEN {{'s': ts, 'e': {end}, 'p': '{precision}'}}")
    for word, start, end, precision in (("tomorrow morning", "ts + INTERVAL 4 HOUR", "ts + INTERVAL 24 HOUR", "part_of_day"), ("tomorrow", "ts + INTERVAL 1 HOUR", "ts + INTERVAL 30 HOUR", "day"), ("this evening|tonight", "ts", "ts + INTERVAL 24 HOUR", "part_of_day"), ("later today", "ts", f"{day} + INTERVAL 1 DAY", "part_of_day")):
        rules.append(f"WHEN regexp_matches(said, '(?i)\\b(?:{word})\\b') THEN {{'s': {start}, 'e': {end}, 'p': '{precision}'}}")
    if weekday:
        ahead = f"{day} + to_days(CAST((12 - isodow(ts)) % 7 AS INTEGER))"  # Friday is day 5
        rules.append(f"WHEN regexp_matches(said, '(?i)\\bon friday\\b') THEN {{'s': greatest(ts, {ahead}), 'e': {ahead} + INTERVAL 1 DAY, 'p': 'day'}}")
    rules.append("WHEN regexp_matches(said, '(?i)\\bin a bit\\b') THEN {'s': ts, 'e': ts + INTERVAL 6 HOUR, 'p': 'hour'}")
    hour = "date_trunc('hour', ts)"
    done = f"CASE WHEN phase IN ('started', 'completed') AND regexp_matches(said, '(?i)\\b(?:now|have been reset)\\b') THEN {{'s': {hour}, 'e': {hour} + INTERVAL 1 HOUR, 'p': 'hour'}} END"
    return f"coalesce(CASE WHEN phase IN ('scheduled', 'started', 'expected') THEN CASE {' '.join(rules)} END END, {done})"


ORACLES = {
    "stated_times": f"""WITH p AS (SELECT event_id, ts, CASE event_type WHEN 'view' THEN 'scheduled' WHEN 'click' THEN 'started' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'expected' ELSE 'rumor' END AS phase,
  replace({_case(f'event_id // {len(PHRASES)} % {len(FRAMES)}', FRAMES)}, '{{p}}', replace(replace({_case(f'event_id % {len(PHRASES)}', PHRASES)}, '{{a}}', CAST(event_id % 11 * 7 AS VARCHAR)), '{{b}}', CAST(user_id % 60 AS VARCHAR))) AS text FROM events),
q AS (SELECT *, [x for x in [trim(x) for x in regexp_split_to_array(regexp_replace(text, '([.!?])', '\\1' || chr(10), 'g'), '\\n+')] if x <> '' and (regexp_matches(x, '(?i)\\b(?:reset|refill)\\b') or (regexp_matches(x, '(?i)\\b(?:{_WORDS})\\b') and (regexp_matches(x, '(?i)\\b(?:limits?|quota|credits)\\b') or regexp_matches(x, '(?i)\\b(?:{_ACTS})\\b'))))] AS parts FROM p),
z AS (SELECT event_id, ts, phase, CASE WHEN len(parts) > 0 THEN array_to_string(parts, chr(10)) ELSE text END AS said FROM q),
r AS (SELECT event_id, {_cascade(False)} AS r, {_cascade(True)} AS w FROM z)
SELECT event_id, CAST(r.s AS TIMESTAMP) AS start, CAST(r.e AS TIMESTAMP) AS "end", r.p AS precision, CAST(w.s AS TIMESTAMP) AS weekday_start, CAST(w.e AS TIMESTAMP) AS weekday_end FROM r""",
}
