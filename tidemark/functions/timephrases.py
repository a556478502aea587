"""The range of time that a post's words mean, by a small grammar.

A span is ``[lead] [next] [amount] unit``: "over the next 2 to 3 hours", "back in a few minutes".
All spans of the text are found at once, each is weighed by its parts, and the one of best rank
counts, the earlier one among equals.  Words for days follow after the spans.  Empty and null
texts, and texts without such words, mean null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.extraction import TOOLS, Vocabulary
from tidemark.functions.text import matches, segments
from tidemark.functions.time import HOUR_US, from_micros, micros

MINUTE_US = 60_000_000
DAY_US = 24 * HOUR_US

# What vague amounts and words for days mean, as hours after the post, and the name of their precision.
FEW_MINUTES, FEW_HOURS = 30, 3
DAY_WORDS = (
    (r"\btomorrow morning\b", 4, 24, "part_of_day"),
    (r"\btomorrow\b", 1, 30, "day"),
    (r"\b(?:this evening|tonight)\b", 0, 24, "part_of_day"),
)
SHORTLY = (0, 6, "hour")
FORWARD = ("scheduled", "expected", "started")
REPORTED = ("started", "completed")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

#: Words that speak of a time, and words of arrival; a sentence that has a time needs one of these or an allowance.
TIME_WORDS = r"\b(?:next|within|over|in|later|tomorrow|tonight|evening|morning|" + "|".join(WEEKDAYS) + r"|minutes?|hours?|soon|incoming)\b"
ARRIVAL = r"\b(?:land(?:s|ing)?|arriv(?:es?|ing)|coming|showing|back|return(?:s|ed|ing)?|give us)\b"
JUST_NOW = r"\b(?:now|currently|ha(?:ve|s)(?: been)? reset)\b"

_LEAD = r"(?:(?:(?:back|see\s+you)\s+)?(?:in|over|within)|give\s+us)"
_DASH = r"(?:[-\x{2010}-\x{2015}\x{2212}]|\bto\b)"
_AMOUNT = rf"(?:\d{{1,3}}(?:\s*{_DASH}\s*\d{{1,3}})?|(?:a\s+)?(?:few|couple\s+of))"
SPAN = rf"(?i)\b((?:{_LEAD}\s+)?(?:the\s+)?(?:next\s+)?(?:{_AMOUNT}\s+)?(?:minutes?|hours?))\b"


def timing_text(text: Column, v: Vocabulary = TOOLS) -> Column:
    """The sentences that can date the event: those that name it, and those with a time beside an allowance or an arrival; the whole text if there are none."""
    dating = F.filter(segments(text), lambda s: matches(s, v.restore) | (matches(s, TIME_WORDS) & (matches(s, v.allowance) | matches(s, ARRIVAL))))
    return F.when(F.size(dating) > 0, F.array_join(dating, "\n")).otherwise(text)


def _weighed(span: Column, position: Column) -> Column:
    """rank, position, us (length from the post on) and precision of a span; null for one that means no time."""
    hours, ahead = matches(span, "hour"), matches(span, r"\bnext\b")
    low = F.regexp_extract(span, r"(\d+)", 1).try_cast("bigint")
    high = F.regexp_extract(span, r"\d\D+(\d+)", 1).try_cast("bigint")
    few, couple = matches(span, r"\bfew\b"), matches(span, r"\bcouple\b")
    single = high.isNull() & (low > 0)

    def lead(words: str) -> Column:
        return matches(span, rf"^(?:{words})\b")

    def means(rank: int, us: Column, precision: str) -> Column:
        return F.struct(F.lit(rank).alias("rank"), position.cast("int").alias("position"), us.cast("long").alias("us"), F.lit(precision).alias("precision"))

    by_minutes = F.when(single & ahead, means(0, low * MINUTE_US, "minute"))
    by_minutes = by_minutes.when(few & lead(r"back\s+in|within|in|over"), means(1, F.lit(FEW_MINUTES * MINUTE_US), "minute"))
    by_hours = F.when(high.isNotNull() & ahead & (low > 0) & (high >= low), means(2, high * HOUR_US, "hour"))
    by_hours = by_hours.when(single & (ahead | lead(r"(?:(?:back|see\s+you)\s+)?(?:in|within)|give\s+us")), means(3, low * HOUR_US, "hour"))
    by_hours = by_hours.when(matches(span, r"\bnext\s+hour$"), means(4, F.lit(HOUR_US), "hour"))
    by_hours = by_hours.when(((few | couple) & ahead) | (few & lead(r"(?:back|see\s+you)\s+in")), means(5, F.lit(FEW_HOURS * HOUR_US), "hour"))
    return F.when(hours, by_hours).otherwise(by_minutes)


def span_meant(text: Column) -> Column:
    """rank, position, us and precision of the span that counts; null where the text has none."""
    found = F.regexp_extract_all(text, F.lit(SPAN), F.lit(1))
    return F.array_min(F.filter(F.transform(found, _weighed), lambda x: x.isNotNull()))


def stated_range(text: Column, published: Column, phase: Column, v: Vocabulary = TOOLS, weekdays: bool = False) -> Column:
    """start, end (half open) and precision; null when the words date nothing, or there is no post time.

    Spans and words for days count for what is ``FORWARD``, "on Friday" only with ``weekdays``
    (that day, or what is left of today); a report of what has just been done is dated to the
    hour of the post.
    """
    said = timing_text(text, v)
    us = micros(published)
    today = F.floor(us / DAY_US) * DAY_US
    span = span_meant(said)

    def meant(start: Column, end: Column, precision: Column | str) -> Column:
        name = precision if isinstance(precision, Column) else F.lit(precision)
        return F.struct(from_micros(start).alias("start"), from_micros(end).alias("end"), name.alias("precision"))

    forward = F.when(span.isNotNull(), meant(us, us + span["us"], span["precision"]))
    for pattern, start, end, precision in DAY_WORDS:
        forward = forward.when(matches(said, pattern), meant(us + start * HOUR_US, us + end * HOUR_US, precision))
    forward = forward.when(matches(said, r"\blater (?:in the day|today)\b"), meant(us, today + DAY_US, "part_of_day"))
    if weekdays:
        named = F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.lower(F.regexp_extract(said, rf"(?i)\bon\s+({'|'.join(WEEKDAYS)})\b", 1))).cast("int")
        day = today + F.pmod(named - 1 - F.weekday(published), F.lit(7)) * DAY_US
        forward = forward.when(named > 0, meant(F.greatest(us, day), day + DAY_US, "day"))
    start, end, precision = SHORTLY
    forward = forward.when(matches(said, rf"(?:{v.restore} incoming\b|\bin a bit\b)"), meant(us + start * HOUR_US, us + end * HOUR_US, precision))
    hour = F.floor(us / HOUR_US) * HOUR_US
    reported = F.when(phase.isin(*REPORTED) & matches(said, JUST_NOW), meant(hour, hour + HOUR_US, "hour"))
    return F.when(us.isNotNull(), F.coalesce(F.when(phase.isin(*FORWARD), forward), reported))
