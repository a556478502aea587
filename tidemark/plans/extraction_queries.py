"""Queries over what posts say, with their oracles.

An event is a post: one of twelve texts by event_id, prefixed by a mention where divisible by 5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import extraction as ex
from tidemark.functions import text as tx
from tidemark.session import table

POSTS = (
    "The Tidewriter API is down for all users. We are investigating.",
    "Login fails for me since this morning, my quota is lost",
    "Tidewriter: a reset of all limits is coming in 2 hours for everyone",
    "We have reset the limits of team plans. Back to work on Friday!",
    "Rival launches a new coding preview, reportedly",
    "There is no reset of the quota today.\nNot for everyone, not for TW Desk",
    "The editor extension is slow for some users, we are working on it",
    "Fixed: the web login is back to normal",
    "Deploying a new build of TW Agent tomorrow and on Monday",
    "I will reset it tonight. Expect it within 5 hours",
    "Inkbot lowers its limits; Tidewriter should keep its credits in 45 minutes",
    "Stored resets for your quota? Please, in 3 days or next week, soon",
)


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    body = F.element_at(F.array(*[F.lit(p) for p in POSTS]), (F.col("event_id") % len(POSTS) + 1).cast("int"))
    mention = F.when(F.col("event_id") % 5 == 0, F.lit("@team ")).when(F.col("event_id") % 7 == 0, F.lit("@a @b  ")).otherwise("")
    return e.select("event_id", "ts", "event_type", F.concat(mention, body).alias("text"), (F.col("user_id") % 3 == 0).alias("official"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_POSTS = "p AS (SELECT event_id, ts, event_type, user_id % 3 = 0 AS official, CASE WHEN event_id % 5 = 0 THEN '@team ' WHEN event_id % 7 = 0 THEN '@a @b  ' ELSE '' END || CASE event_id % 12 " + " ".join(f"WHEN {i} THEN {_sql(t)}" for i, t in enumerate(POSTS)) + " END AS text FROM events)"


def _m(pattern: str, text: str = "text") -> str:
    return f"regexp_matches({text}, '(?i){pattern.replace(chr(39), chr(39) * 2)}')"


def _first(rules, default: str, text: str = "text") -> str:  # noqa: ANN001
    return "CASE " + " ".join(f"WHEN {_m(p, text)} THEN '{label}'" for p, label in rules) + f" ELSE {default} END"


V = ex.TOOLS
_EVENT = "CASE " + " ".join("WHEN " + " AND ".join(_m(p) for p in ps) + f" THEN '{label}'" for ps, label in V.events()) + " END"
_KIND = f"k AS (SELECT *, {_EVENT} AS kind FROM p)"
_PHASE = f"coalesce({_first(V.phases, 'NULL')}, CASE WHEN {_m(V.unsure)} THEN 'rumor' WHEN kind = 'issue' THEN 'started' WHEN kind IN ('recovery', 'release', 'development', 'rival_limits', 'rival_release') THEN 'completed' ELSE 'rumor' END)"
_SEGMENTS = "[trim(x) for x in regexp_split_to_array(regexp_replace({t}, '([.!?])', '\\1' || chr(10), 'g'), '\\s*\\n+\\s*') if trim(x) <> '']"


def _same(one: str, other: str, text: str = "text") -> str:
    return f"len([x for x in {_SEGMENTS.format(t=text)} if {_m(one, 'x')} and {_m(other, 'x')}]) > 0"


def _any(pattern: str, text: str = "text") -> str:
    return f"len([x for x in {_SEGMENTS.format(t=text)} if {_m(pattern, 'x')}]) > 0"


def event_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _posts(spark, sf_dir)
    kind = ex.event_of(F.col("text"))
    return p.select("event_id", kind.alias("kind"), ex.phase_of(F.col("text"), kind).alias("phase"))


def impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = ex.impact_of(F.col("text"), ex.event_of(F.col("text")), F.col("official"))
    p = _posts(spark, sf_dir).select("event_id", i.alias("i"))
    return p.filter("i is not null").select("event_id", *[F.col(f"i.{c}") for c in ("category", "scope", "lifecycle", "severity", "basis")], F.array_join("i.surfaces", ",").alias("surfaces"))


def rivalries(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ex.rivalry_of(F.col("text"), ex.event_of(F.col("text")))
    return _posts(spark, sf_dir).select("event_id", r.alias("r")).filter("r is not null").select("event_id", "r.kind", "r.relevance", "r.stage")


def product_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ex.products_in(F.col("text"))
    return _posts(spark, sf_dir).select("event_id", s["vendor"].alias("vendor"), s["product"].alias("product"), F.array_join(s["products"], ",").alias("products"))


def scope_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ex.scope_predicates(F.col("text"))
    kind = ex.event_of(F.col("text"))
    allowed = ex.generic_scope_allowed(kind, ex.phase_of(F.col("text"), kind), F.lit("primary_statement"), F.lit("text/plain"), F.when(F.col("official"), "lead").otherwise("aggregator"), F.col("event_type"), ["view", "click", "error"], s, ex.products_in(F.col("text")), "writer")
    return _posts(spark, sf_dir).select("event_id", s["whole"].alias("whole"), s["narrow"].alias("narrow"), s["stored_only"].alias("stored_only"), allowed.alias("allowed"))


def _context(event_id: Column) -> Column:
    return F.when(event_id % 4 == 0, F.lit("When will the Tidewriter quota come back?")).when(event_id % 4 == 1, F.lit("Nice weather"))


def topic_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ex.relevance(F.col("text"), _context(F.col("event_id")), F.col("official"), F.col("event_id") % 2 == 0)
    return _posts(spark, sf_dir).select("event_id", r["decision"].alias("decision"), r["reason"].alias("reason"), ex.operational_match(F.col("text")).alias("own_match"), ex.terminal_reason(F.col("text")).alias("terminal"))


def reply_commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posts(spark, sf_dir).select("event_id", ex.reply_commitment(F.col("text")).alias("promise"))


def single_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations by event: replies and reposts to events near it."""
    one = F.struct(F.when(F.col("event_type") == "view", "repost").otherwise("reply").alias("type"), (F.col("event_id") - 1).alias("target"))
    two = F.struct(F.when(F.col("event_id") % 2 == 0, "reply").otherwise("quote").alias("type"), (F.col("event_id") - 2).alias("target"))
    return table(spark, sf_dir, "events").select("event_id", ex.single_reply(F.array(one, two), F.col("event_id") - 1).alias("single"))


def evidence_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    def text(n: int) -> Column:
        return (F.col("event_id") - n).cast("string")

    r = ex.evidence_root(F.when(F.col("event_type") == "view", text(1)), F.when(F.col("event_id") % 3 == 0, text(2)), F.when(F.col("value") > 40, text(3)), text(0))
    return table(spark, sf_dir, "events").select("event_id", r["root"].alias("root"), r["derivation"].alias("derivation"))


def comparable_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posts(spark, sf_dir).select("event_id", tx.comparable_post(F.col("text")).alias("comparable"), tx.redact(F.col("text"), ["Tidewriter", "quota", "Tide", ""], "[x]").alias("redacted"))


def phase_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which proposed phases the words support, and whether a post itself completes a reset."""
    p = _posts(spark, sf_dir)
    cues = [ex.cue_supports(F.col("text"), F.lit(label)).alias(label) for label in ("denied", "completed", "scheduled", "expected", "rumor")]
    return p.select("event_id", *cues, ex.own_completion(F.col("text"), F.col("event_id") % 3 == 0).alias("own_completion"))


def horizon_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizons from texts: plain numbers, padded, signed, too large, and words."""
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("+"), F.col("event_id").cast("string"))).when(F.col("event_id") % 7 == 0, F.lit("many")).when(F.col("event_id") % 3 == 0, F.lpad(F.col("event_id").cast("string"), 6, "0")).otherwise(F.col("event_id").cast("string"))
    return e.select("event_id", ex.horizon_hours(text).alias("horizon"))


def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _posts(spark, sf_dir)
    r = ex.asserted_range(F.col("text"), F.col("ts"), ex.phase_of(F.col("text"), ex.event_of(F.col("text"))))
    return p.select("event_id", r["start"].alias("start"), r["end"].alias("end"), r["precision"].alias("precision"))


def allocation_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole hours from an anchor that each event's range touches, and the next run after it."""
    from tidemark.functions import time as tm

    e = table(spark, sf_dir, "events")
    o = ex.allocation_offsets(F.col("ts"), tm.add_hours(F.col("ts"), F.col("value") / 20), F.lit("2024-01-15").cast("timestamp_ntz"))
    run = ex.next_run(F.col("ts"), 10, 2, tm.add_hours(F.col("ts"), (F.col("event_id") % 5 - 1) / 20.0))
    return e.select("event_id", o["first"].alias("first"), o["count"].alias("count"), run.alias("next_run"))


def extracted_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _posts(spark, sf_dir).select("event_id", ex.signal_of(F.col("text"), F.col("ts"), F.col("official")).alias("s")).filter("s is not null")
    return s.select("event_id", "s.event_type", "s.phase", F.col("s.impact.severity").alias("severity"), F.col("s.product.product").alias("product"), F.col("s.scope.whole").alias("whole"), F.col("s.range.start").alias("start"))


QUERIES = {f.__name__: f for f in (event_phases, impacts, rivalries, product_scopes, scope_predicates, topic_relevance, reply_commitments, single_replies, evidence_roots, comparable_posts, phase_cues, horizon_values, relative_times, allocation_offsets, extracted_signals)}

_SCOPE = f"CASE WHEN {_m(V.everyone)} THEN 'everyone' WHEN {_m(V.narrow)} THEN 'some' WHEN {_m(chr(92) + 'b(?:i|me|my)' + chr(92) + 'b')} THEN 'one' ELSE 'unknown' END"
_LIFE = f"CASE WHEN kind = 'recovery' OR {_m(V.recovered)} THEN 'resolved' WHEN {_m(V.mitigating)} THEN 'mitigating' WHEN {_m(V.investigating)} THEN 'investigating' WHEN kind = 'issue' THEN 'active' ELSE 'unknown' END"
_IMPACTS = f"""i AS (SELECT *, {_first(V.categories, "'other'")} AS category, {_SCOPE} AS scope, {_LIFE} AS lifecycle FROM k),
j AS (SELECT *, CASE WHEN lifecycle = 'resolved' THEN 'unknown' WHEN category IN ('security', 'data', 'availability', 'auth') THEN CASE scope WHEN 'everyone' THEN 'critical' WHEN 'some' THEN 'high' ELSE 'medium' END WHEN category = 'performance' THEN 'low' ELSE 'unknown' END AS severity FROM i)"""
_OWN = f"[x for x in [CASE WHEN {_m(V.second_product)} THEN 'desk' END, CASE WHEN {_m(V.rival)} THEN 'rival_tool' END, CASE WHEN {_m(V.product)} THEN 'writer' END] if x IS NOT NULL]"
_PRODUCTS = "CASE WHEN len(own) > 1 THEN 'multi' ELSE coalesce(own[1], 'unknown') END"
_GIVEN = _m(V.given)
_STORED = f"({_m(V.stored)} AND NOT {_GIVEN})"


def _match(text: str) -> str:
    return f"CASE WHEN {text} IS NULL THEN NULL WHEN {_same(V.product, V.restore, text)} THEN 'product_reset' WHEN {_same(V.product, V.allowance, text)} THEN 'product_allowance' WHEN {_same(V.product, V.trouble, text)} THEN 'product_trouble' END"


_TERMINAL = f"CASE WHEN {_any(V.asks)} AND NOT {_any(V.given)} THEN 'request_or_wish' WHEN {_any(V.own_quota)} AND {_any(V.trouble)} THEN 'own_allowance' END"
_BODY = "regexp_replace(text, '^\\s*@\\w+\\s*', '')"
_PROMISES = f"[x for x in {_SEGMENTS.format(t=_BODY)} if {_m(V.first_person, 'x')} and {_m(V.restore, 'x')} and not {_m(V.unsure, 'x')} and not suffix(x, '?')]"
_PROMISE = f"CASE WHEN len(regexp_extract_all(text, '@\\w+')) = 1 AND regexp_matches(text, '^\\s*@\\w+') AND len({_PROMISES}) = 1 THEN ({_PROMISES})[1] END"
_DAY = "CAST(date_trunc('day', ts) AS TIMESTAMP)"


def _number(unit: str) -> str:
    return f"CAST(nullif(regexp_extract(text, '(?i)\\b{unit}\\b', 1), '') AS INTEGER)"


_WEEKDAY = "CASE " + " ".join(f"WHEN {_m(chr(92) + 'bon ' + n + chr(92) + 'b')} THEN {i}" for i, n in enumerate(("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"))) + " END"
_RANGES = f"""n AS (SELECT *, {_number('in ([0-9]{1,3}) minutes?')} AS mi, {_number('in ([0-9]{1,3}) hours?')} AS ho, {_number('in ([0-9]{1,3}) days?')} AS da, {_number('within ([0-9]{1,3}) hours?')} AS wi, {_WEEKDAY} AS wd, isodow(ts) - 1 AS dow, {_PHASE} AS phase FROM k),
r AS (SELECT *, CASE WHEN mi IS NOT NULL THEN {{'s': ts + to_minutes(mi), 'e': ts + to_minutes(mi + 10), 'p': 'minute'}} WHEN wi IS NOT NULL THEN {{'s': ts, 'e': ts + to_hours(wi), 'p': 'window'}} WHEN ho IS NOT NULL THEN {{'s': ts + to_hours(ho), 'e': ts + to_hours(ho + 1), 'p': 'hour'}}
  WHEN da IS NOT NULL THEN {{'s': {_DAY} + to_days(da), 'e': {_DAY} + to_days(da + 1), 'p': 'day'}} WHEN {_m(chr(92) + 'bnext hour' + chr(92) + 'b')} THEN {{'s': ts, 'e': ts + INTERVAL 2 HOUR, 'p': 'hour'}} WHEN {_m('this morning')} THEN {{'s': {_DAY} + INTERVAL 6 HOUR, 'e': {_DAY} + INTERVAL 12 HOUR, 'p': 'part_of_day'}}
  WHEN {_m('this evening')} THEN {{'s': {_DAY} + INTERVAL 17 HOUR, 'e': {_DAY} + INTERVAL 22 HOUR, 'p': 'part_of_day'}} WHEN {_m('tonight')} THEN {{'s': {_DAY} + INTERVAL 18 HOUR, 'e': {_DAY} + INTERVAL 24 HOUR, 'p': 'part_of_day'}} WHEN {_m('tomorrow')} THEN {{'s': {_DAY} + INTERVAL 1 DAY, 'e': {_DAY} + INTERVAL 2 DAY, 'p': 'day'}}
  WHEN wd IS NOT NULL THEN {{'s': {_DAY} + to_days(CAST((wd - dow + 6) % 7 + 1 AS INTEGER)), 'e': {_DAY} + to_days(CAST((wd - dow + 6) % 7 + 2 AS INTEGER)), 'p': 'day'}} WHEN {_m('next week')} THEN {{'s': {_DAY} + to_days(CAST(7 - dow AS INTEGER)), 'e': {_DAY} + to_days(CAST(14 - dow AS INTEGER)), 'p': 'week'}}
  WHEN {_m(chr(92) + 'bsoon' + chr(92) + 'b')} THEN {{'s': ts, 'e': ts + INTERVAL 6 HOUR, 'p': 'vague'}} WHEN phase = 'completed' THEN {{'s': ts - INTERVAL 1 HOUR, 'e': ts, 'p': 'before_post'}} END AS r FROM n)"""
_CONTEXT = "CASE event_id % 4 WHEN 0 THEN 'When will the Tidewriter quota come back?' WHEN 1 THEN 'Nice weather' END"

ORACLES = {
    "event_phases": f"WITH {_POSTS}, {_KIND} SELECT event_id, kind, {_PHASE} AS phase FROM k",
    "impacts": f"WITH {_POSTS}, {_KIND}, {_IMPACTS} SELECT event_id, category, scope, lifecycle, severity, CASE WHEN official THEN 'official' ELSE 'report' END AS basis, coalesce(nullif(concat_ws(',', " + ", ".join(f"CASE WHEN {_m(p)} THEN '{label}' END" for p, label in V.surfaces) + "), ''), 'unknown') AS surfaces FROM j WHERE kind IN ('issue', 'recovery')",
    "rivalries": f"WITH {_POSTS}, {_KIND} SELECT event_id, CASE WHEN kind = 'rival_limits' THEN 'limits' WHEN {_m('coding')} THEN 'coding_tool' ELSE 'other_tool' END AS kind, CASE WHEN {_m('coding')} THEN 'direct' ELSE 'adjacent' END AS relevance, {_first(V.stages, chr(39) + 'announced' + chr(39))} AS stage FROM k WHERE kind IN ('rival_limits', 'rival_release')",
    "product_scopes": f"WITH {_POSTS}, o AS (SELECT *, {_OWN} AS own FROM p) SELECT event_id, CASE WHEN list_contains(own, 'rival_tool') THEN CASE WHEN len(own) > 1 THEN 'several' ELSE 'other' END ELSE 'tidewriter' END AS vendor, {_PRODUCTS} AS product, array_to_string(own, ',') AS products FROM o",
    "scope_predicates": f"WITH {_POSTS}, {_KIND}, s AS (SELECT *, {_same(V.restore, V.everyone)} AS whole, {_same(V.restore, V.narrow)} AS narrow, {_STORED} AS stored_only, {_OWN} AS own, {_PHASE} AS phase FROM k) SELECT event_id, whole, narrow, stored_only, coalesce(kind = 'quota_reset', false) AND phase <> 'rumor' AND official AND event_type IN ('view', 'click', 'error') AND NOT narrow AND NOT stored_only AND list_contains(own, 'writer') AS allowed FROM s",
    "topic_relevance": f"""WITH {_POSTS}, c AS (SELECT *, {_CONTEXT} AS context FROM p), m AS (SELECT *, {_match('text')} AS own, {_TERMINAL} AS ended, {_match('context')} AS via, {_PROMISE} IS NOT NULL AND official AND event_id % 2 = 0 AS promise, {_m(V.restore)} OR {_m(V.trouble)} AS vague FROM c)
SELECT event_id, CASE WHEN ended IS NOT NULL THEN 'irrelevant' WHEN own IS NOT NULL OR promise OR (official AND vague) OR (vague AND via IS NOT NULL) THEN 'relevant' WHEN vague AND context IS NULL AND event_id % 2 = 0 THEN 'pending' ELSE 'irrelevant' END AS decision,
  CASE WHEN ended IS NOT NULL THEN ended WHEN own IS NOT NULL THEN own WHEN promise THEN 'reply_commitment' WHEN official AND vague THEN 'authority' WHEN vague AND via IS NOT NULL THEN 'context_' || via WHEN vague AND context IS NULL AND event_id % 2 = 0 THEN 'context_unknown' ELSE 'no_match' END AS reason, own AS own_match, ended AS terminal FROM m""",
    "reply_commitments": f"WITH {_POSTS} SELECT event_id, {_PROMISE} AS promise FROM p",
    "single_replies": "SELECT event_id, event_type <> 'view' AND event_id % 2 <> 0 AS single FROM events",
    "evidence_roots": "SELECT event_id, CAST(event_id - CASE WHEN event_type = 'view' THEN 1 WHEN event_id % 3 = 0 THEN 2 WHEN value > 40 THEN 3 ELSE 0 END AS VARCHAR) AS root, CASE WHEN event_type = 'view' THEN 'summary' WHEN event_id % 3 = 0 THEN 'quotes' WHEN value > 40 THEN 'links' ELSE 'primary_statement' END AS derivation FROM events",
    "comparable_posts": f"WITH {_POSTS} SELECT event_id, trim(regexp_replace(regexp_replace(text, '^(\\s*@\\w+)+', ''), '\\s+', ' ', 'g')) AS comparable, replace(replace(replace(text, 'Tidewriter', '[x]'), 'quota', '[x]'), 'Tide', '[x]') AS redacted FROM p",
    "phase_cues": f"WITH {_POSTS} SELECT event_id, {_m(V.phases[0][0])} AS denied, {_GIVEN} AS completed, {_m(V.phases[4][0])} AS scheduled, {_m(V.phases[5][0])} AS expected, false AS rumor, ({_GIVEN} OR ({_m(V.restore)} AND event_id % 3 = 0)) AND NOT {_m(chr(92) + 'b(?:will|tomorrow|tonight)' + chr(92) + 'b')} AND NOT {_m(V.phases[0][0])} AND NOT {_same(V.restore, V.narrow)} AS own_completion FROM p",
    "horizon_values": "SELECT event_id, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id BETWEEN 1 AND 168 THEN CAST(event_id AS INTEGER) END AS horizon FROM events",
    "relative_times": f"WITH {_POSTS}, {_KIND}, {_RANGES} SELECT event_id, r.s AS start, r.e AS end, r.p AS precision FROM r",
    "allocation_offsets": """WITH x AS (SELECT *, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15') AS a, CAST(round(value / 20 * 3.6e9) AS BIGINT) AS w, epoch_us(ts) AS u, CAST(round((event_id % 5 - 1) / 20.0::DOUBLE * 3.6e9) AS BIGINT) AS k FROM events),
y AS (SELECT *, greatest(0, CAST(floor(a / 3.6e9) AS BIGINT)) AS f, CAST(ceil((a + w) / 3.6e9) AS BIGINT) AS l, (u // 600000000 + 1) * 600000000 + 120000000 AS b FROM x)
SELECT event_id, CASE WHEN l > f THEN f END AS first, CASE WHEN l > f THEN l - f END AS count, make_timestamp(CASE WHEN k > 0 AND u + k < b THEN u + k ELSE b END) AS next_run FROM y""",
    "extracted_signals": f"WITH {_POSTS}, {_KIND}, {_RANGES}, i AS (SELECT *, {_first(V.categories, chr(39) + 'other' + chr(39))} AS category, {_SCOPE} AS scope, {_LIFE} AS lifecycle, {_OWN} AS own FROM r) SELECT event_id, kind AS event_type, phase, CASE WHEN kind IN ('issue', 'recovery') THEN CASE WHEN lifecycle = 'resolved' THEN 'unknown' WHEN category IN ('security', 'data', 'availability', 'auth') THEN CASE scope WHEN 'everyone' THEN 'critical' WHEN 'some' THEN 'high' ELSE 'medium' END WHEN category = 'performance' THEN 'low' ELSE 'unknown' END END AS severity, {_PRODUCTS} AS product, {_same(V.restore, V.everyone)} AS whole, r.s AS start FROM i WHERE kind IS NOT NULL",
}
