"""Stated times against ranges written by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import timephrases as tp

POSTED = dt.datetime(2024, 5, 1, 10, 20)  # a Wednesday
H = dt.timedelta(hours=1)
HOUR = dt.datetime(2024, 5, 1, 10)

CASES = [
    ("The reset lands over the next 45 minutes.", "started", (POSTED, POSTED + 0.75 * H, "minute")),
    ("The reset lands in 45 minutes.", "started", None),  # without "next" minutes say nothing
    ("Your limits are back in a few minutes", "scheduled", (POSTED, POSTED + 0.5 * H, "minute")),
    ("Reset within the next 2 to 3 hours", "scheduled", (POSTED, POSTED + 3 * H, "hour")),
    ("Reset in the next 2–5 hours", "scheduled", (POSTED, POSTED + 5 * H, "hour")),
    ("Reset in the next 5 to 3 hours", "scheduled", None),
    ("Reset in 0 hours", "scheduled", None),
    ("A reset: give us 12 hours", "scheduled", (POSTED, POSTED + 12 * H, "hour")),
    ("A reset over 12 hours", "scheduled", None),
    ("The reset comes next hour", "expected", (POSTED, POSTED + H, "hour")),
    ("The reset comes in the next couple of hours", "expected", (POSTED, POSTED + 3 * H, "hour")),
    ("A reset, see you in a few hours", "expected", (POSTED, POSTED + 3 * H, "hour")),
    ("A reset in 5 hours, or in the next 30 minutes", "expected", (POSTED, POSTED + 0.5 * H, "minute")),  # minutes go before hours
    ("A reset in 5 hours, or within 2 hours", "expected", (POSTED, POSTED + 5 * H, "hour")),  # then the earlier one
    ("Reset tomorrow morning", "scheduled", (POSTED + 4 * H, POSTED + 24 * H, "part_of_day")),
    ("Reset tomorrow", "scheduled", (POSTED + H, POSTED + 30 * H, "day")),
    ("Reset tonight", "scheduled", (POSTED, POSTED + 24 * H, "part_of_day")),
    ("Reset later today", "scheduled", (POSTED, dt.datetime(2024, 5, 2), "part_of_day")),
    ("Reset incoming", "scheduled", (POSTED, POSTED + 6 * H, "hour")),
    ("Reset soon", "scheduled", None),
    ("Lunch tomorrow? The reset is real.", "scheduled", None),  # another sentence's time
    ("Lunch. Your quota is coming back tomorrow", "scheduled", (POSTED + H, POSTED + 30 * H, "day")),
    ("Hello tomorrow", "scheduled", (POSTED + H, POSTED + 30 * H, "day")),  # no sentence dates it: the whole text does
    ("Reset tomorrow", "completed", None),  # what is over has no forward time
    ("Reset tomorrow", "rumor", None),
    ("Limits have been reset", "completed", (HOUR, HOUR + H, "hour")),
    ("The reset is under way now", "started", (HOUR, HOUR + H, "hour")),
    ("Limits have been reset", "scheduled", None),
    ("", "scheduled", None),
    (None, "scheduled", None),
    ("Reset tomorrow", None, None),
]


def ranges(spark, cases, **options):
    rows = spark.createDataFrame([(i, t, p, POSTED) for i, (t, p) in enumerate(cases)], "i int, text string, phase string, ts timestamp_ntz")
    out = rows.select("i", tp.stated_range(F.col("text"), F.col("ts"), F.col("phase"), **options).alias("r")).orderBy("i").collect()
    return [None if r["r"] is None else tuple(r["r"]) for r in out]


def test_stated_ranges(spark):
    assert ranges(spark, [c[:2] for c in CASES]) == [c[2] for c in CASES]


@pytest.mark.parametrize(("day", "want"), [("Wednesday", (POSTED, dt.datetime(2024, 5, 2), "day")), ("friday", (dt.datetime(2024, 5, 3), dt.datetime(2024, 5, 4), "day")), ("Monday", (dt.datetime(2024, 5, 6), dt.datetime(2024, 5, 7), "day"))])
def test_weekdays_count_only_where_allowed(spark, day, want):
    text = f"The reset lands on {day}"
    assert ranges(spark, [(text, "scheduled")], weekdays=True) == [want]
    assert ranges(spark, [(text, "scheduled")]) == [None]


def test_long_texts_without_a_post_time(spark):
    rows = spark.createDataFrame([("word " * 200_000 + ". Reset in the next hour", None), ("in the next " * 50_000 + "hour", POSTED)], "text string, ts timestamp_ntz")
    out = [r["r"] for r in rows.select(tp.stated_range(F.col("text"), F.col("ts"), F.lit("scheduled")).alias("r")).collect()]
    assert out[0] is None and tuple(out[1]) == (POSTED, POSTED + H, "hour")
