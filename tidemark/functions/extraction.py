"""What a post says: its event, phase, impact, scope, relevance and the time it speaks of.

All rules are data: a ``Vocabulary`` holds patterns and ordered rules, and the functions only apply
them.  The default one speaks of hosted developer tools; another domain passes its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import Rule, all_rules, any_segment, first_rule, matches, same_segment, segments
from tidemark.functions.time import HOUR_US, from_micros, micros

#: Patterns that must all match, and the label that follows.
Joint = tuple[tuple[str, ...], str]


@dataclass(frozen=True)
class Vocabulary:
    """Patterns (case is ignored) and ordered rules of a domain."""

    product: str = r"\b(?:tidewriter|tw agent)\b"
    second_product: str = r"\btw desk\b"
    rival: str = r"\b(?:rival|copydeck|inkbot)\b"
    restore: str = r"\b(?:reset|refill|topped up)\b"
    allowance: str = r"\b(?:limits?|quota|credits)\b"
    launch: str = r"\b(?:launch(?:es|ed)?|ships|unveils)\b"
    trouble: str = r"\b(?:down|outage|fails?|slow|broken|lost)\b"
    recovered: str = r"\b(?:fixed|back to normal|recovered)\b"
    mitigating: str = r"\b(?:rolling back|working on it|patching)\b"
    investigating: str = r"\binvestigating\b"
    build: str = r"\b(?:deploying|merged|new build)\b"
    everyone: str = r"\b(?:all users|everyone|worldwide)\b"
    narrow: str = r"\b(?:some users|team plans|my account|beta testers)\b"
    stored: str = r"\b(?:stored resets?|vouchers?)\b"
    given: str = r"\b(?:we have reset|was reset|has been reset)\b"
    first_person: str = r"\b(?:i|we)(?:'ll| will)\b"
    unsure: str = r"\b(?:rumou?r|reportedly|maybe)\b"
    asks: str = r"(?:\?|\bplease\b|\bif only\b)"
    own_quota: str = r"\bmy (?:limits?|quota|credits)\b"
    phases: tuple[Rule, ...] = (
        (r"\b(?:no|not|never)\b[^.!?]{0,30}\breset\b", "denied"),
        (r"\b(?:called off|postponed)\b", "cancelled"),
        (r"\b(?:we have reset|was reset|has been reset)\b", "completed"),
        (r"\b(?:resetting|rolling out)\b", "started"),
        (r"\b(?:will|tonight|tomorrow|coming|in \d+ (?:hours?|minutes?))\b", "scheduled"),
        (r"\b(?:expect|should|likely)\b", "expected"),
    )
    categories: tuple[Rule, ...] = (
        (r"\b(?:leak(?:ed)?|exposed)\b", "security"),
        (r"\blost\b", "data"),
        (r"\b(?:down|outage)\b", "availability"),
        (r"\bslow\b", "performance"),
        (r"\blogin\b", "auth"),
        (r"\b(?:limits?|quota|credits)\b", "quota"),
    )
    surfaces: tuple[Rule, ...] = ((r"\bcli\b", "cli"), (r"\b(?:editor|extension)\b", "editor"), (r"\bapi\b", "api"), (r"\bweb\b", "web"), (r"\blogin\b", "auth"))
    stages: tuple[Rule, ...] = ((r"\b(?:rumou?r|reportedly)\b", "rumor"), (r"\b(?:generally available|for everyone)\b", "general"), (r"\b(?:preview|beta)\b", "preview"), (r"\b(?:launched|ships)\b", "released"))

    def events(self) -> tuple[Joint, ...]:
        """Event rules; the first whose patterns all match decides."""
        return (
            ((self.restore, self.allowance), "quota_reset"),
            ((self.rival, self.allowance), "rival_limits"),
            ((self.rival, self.launch), "rival_release"),
            ((self.trouble, self.recovered), "recovery"),
            ((self.trouble,), "issue"),
            ((self.recovered,), "recovery"),
            ((self.launch,), "release"),
            ((self.build,), "development"),
        )


TOOLS = Vocabulary()

IMPACTS = ("issue", "recovery")
RIVALS = ("rival_limits", "rival_release")


def event_of(text: Column, v: Vocabulary = TOOLS) -> Column:
    """Type of the event that a post speaks of; null when no rule holds."""
    out = None
    for patterns, label in v.events():
        every = F.lit(True)
        for p in patterns:
            every = every & matches(text, p)
        out = F.when(every, label) if out is None else out.when(every, label)
    return out


def phase_of(text: Column, kind: Column, v: Vocabulary = TOOLS) -> Column:
    """Phase of the event: by the words of the post, else by its kind (what happened is over, what breaks has begun), rumors first."""
    said = first_rule(text, v.phases)
    by_kind = F.when(matches(text, v.unsure), "rumor").when(kind.isin("issue"), "started").when(kind.isin("recovery", "release", "development", *RIVALS), "completed").otherwise("rumor")
    return F.coalesce(said, by_kind)


def scope_of(text: Column, v: Vocabulary = TOOLS) -> Column:
    return F.when(matches(text, v.everyone), "everyone").when(matches(text, v.narrow), "some").when(matches(text, r"\b(?:i|me|my)\b"), "one").otherwise("unknown")


def lifecycle_of(text: Column, kind: Column, v: Vocabulary = TOOLS) -> Column:
    return F.when((kind == "recovery") | matches(text, v.recovered), "resolved").when(matches(text, v.mitigating), "mitigating").when(matches(text, v.investigating), "investigating").when(kind == "issue", "active").otherwise("unknown")


def impact_of(text: Column, kind: Column, official: Column, v: Vocabulary = TOOLS) -> Column:
    """category, scope, lifecycle, severity, surfaces and basis of an issue or recovery; null for other events."""
    category, scope, life = first_rule(text, v.categories, "other"), scope_of(text, v), lifecycle_of(text, kind, v)
    heavy = category.isin("security", "data", "availability", "auth")
    severity = F.when(life == "resolved", "unknown").when(heavy & (scope == "everyone"), "critical").when(heavy & (scope == "some"), "high").when(heavy, "medium").when(category == "performance", "low").otherwise("unknown")
    basis = F.when(official, "official").otherwise("report")
    whole = F.struct(category.alias("category"), scope.alias("scope"), life.alias("lifecycle"), severity.alias("severity"), all_rules(text, v.surfaces).alias("surfaces"), basis.alias("basis"))
    return F.when(kind.isin(*IMPACTS), whole)


def rivalry_of(text: Column, kind: Column, v: Vocabulary = TOOLS, coding: str = r"\bcoding\b") -> Column:
    """kind, relevance and stage of what a rival does; null for other events."""
    direct = matches(text, coding)
    what = F.when(kind == "rival_limits", "limits").when(direct, "coding_tool").otherwise("other_tool")
    return F.when(kind.isin(*RIVALS), F.struct(what.alias("kind"), F.when(direct, "direct").otherwise("adjacent").alias("relevance"), first_rule(text, v.stages, "announced").alias("stage")))


def products_in(text: Column, v: Vocabulary = TOOLS, vendor: str = "tidewriter") -> Column:
    """vendor, product and products of a post: several products, or a rival beside an own one, are multi."""
    own = F.array_compact(F.array(F.when(matches(text, v.second_product), "desk"), F.when(matches(text, v.rival), "rival_tool"), F.when(matches(text, v.product), "writer")))
    rival = F.array_contains(own, "rival_tool")
    several = F.size(own) > 1
    maker = F.when(rival & several, "several").when(rival, "other").otherwise(vendor)
    return F.struct(maker.alias("vendor"), F.when(several, "multi").otherwise(F.coalesce(F.get(own, F.lit(0)), F.lit("unknown"))).alias("product"), own.alias("products"))


def scope_predicates(text: Column, v: Vocabulary = TOOLS) -> Column:
    """whole: some sentence about a reset names everyone; narrow: some names a part; stored_only: stored resets, none given."""
    return F.struct(same_segment(text, v.restore, v.everyone).alias("whole"), same_segment(text, v.restore, v.narrow).alias("narrow"), (matches(text, v.stored) & ~matches(text, v.given)).alias("stored_only"))


def generic_scope_allowed(kind: Column, phase: Column, root: Column, media: Column, role: Column, author: Column, authorities: Sequence[str], scope: Column, product: Column, wanted: str) -> Column:
    """Whether a statement of an authority that names no scope may stand for all: a reset, first hand, as text, not narrowed, of the product."""
    ok = (kind == "quota_reset") & phase.isin("completed", "scheduled", "expected", "started", "denied", "cancelled") & (root == "primary_statement") & (media == "text/plain") & (role != "aggregator")
    return F.coalesce(ok & author.isin(*authorities) & ~scope["narrow"] & ~scope["stored_only"] & ((product["product"] == wanted) | F.array_contains(product["products"], wanted)), F.lit(False))


def operational_match(text: Column, v: Vocabulary = TOOLS) -> Column:
    """Why a post is about operations: reset, allowance or trouble in one sentence with the product; null: it is not."""
    return F.when(same_segment(text, v.product, v.restore), "product_reset").when(same_segment(text, v.product, v.allowance), "product_allowance").when(same_segment(text, v.product, v.trouble), "product_trouble")


def terminal_reason(text: Column, v: Vocabulary = TOOLS) -> Column:
    """Why a post can't count whatever its context: it asks or wishes, or speaks of the author's own allowance."""
    return F.when(any_segment(text, v.asks) & ~any_segment(text, v.given), "request_or_wish").when(any_segment(text, v.own_quota) & any_segment(text, v.trouble), "own_allowance")


def reply_commitment(text: Column, v: Vocabulary = TOOLS) -> Column:
    """The sentence in which a reply to exactly one account promises a reset in the first person; null: there is none."""
    mentions = F.size(F.regexp_extract_all(text, F.lit(r"(@\w+)"), F.lit(1)))
    body = F.regexp_replace(text, r"^\s*@\w+\s*", "")
    found = F.filter(segments(body), lambda x: matches(x, v.first_person) & matches(x, v.restore) & ~matches(x, v.unsure) & ~x.endswith("?"))
    return F.when((mentions == 1) & text.rlike(r"^\s*@\w+") & (F.size(found) == 1), F.get(found, F.lit(0)))


def single_reply(relations: Column, parent: Column) -> Column:
    """Whether relations (type, target) are one reply, to the parent, and no repost."""
    replies = F.filter(relations, lambda r: r["type"] == "reply")
    reposts = F.exists(relations, lambda r: r["type"] == "repost")
    return F.coalesce((F.size(replies) == 1) & ~reposts & (F.get(F.transform(replies, lambda r: r["target"]), F.lit(0)) == parent), F.lit(False))


def relevance(text: Column, context: Column, authority: Column, is_reply: Column, v: Vocabulary = TOOLS) -> Column:
    """decision and reason, by the first that holds: a match of its own, a terminal reason, a promise in reply, an authority, the context, else nothing.

    A post that needs a context which is not known yet is pending.
    """
    own, ended = operational_match(text, v), terminal_reason(text, v)
    promise = authority & is_reply & reply_commitment(text, v).isNotNull()
    by_context = operational_match(context, v)
    vague = matches(text, v.restore) | matches(text, v.trouble)
    decision = F.when(ended.isNotNull(), "irrelevant").when(own.isNotNull() | promise | (authority & vague), "relevant").when(vague & by_context.isNotNull(), "relevant").when(vague & context.isNull() & is_reply, "pending").otherwise("irrelevant")
    reason = F.when(ended.isNotNull(), ended).when(own.isNotNull(), own).when(promise, "reply_commitment").when(authority & vague, "authority").when(vague & by_context.isNotNull(), F.concat(F.lit("context_"), by_context)).when(vague & context.isNull() & is_reply, "context_unknown").otherwise("no_match")
    return F.struct(decision.alias("decision"), reason.alias("reason"))


def evidence_root(summary_of: Column, quoted: Column, linked: Column, own: Column) -> Column:
    """root and derivation: what a post rests on, the first there is of a summarised, quoted or linked post, else itself."""
    kind = F.when(summary_of.isNotNull(), "summary").when(quoted.isNotNull(), "quotes").when(linked.isNotNull(), "links").otherwise("primary_statement")
    return F.struct(F.coalesce(summary_of, quoted, linked, own).alias("root"), kind.alias("derivation"))


def cue_supports(text: Column, phase: Column, v: Vocabulary = TOOLS) -> Column:
    """Whether the words around a claim support a proposed phase."""
    rules = dict((label, pattern) for pattern, label in v.phases)
    out = F.lit(False)
    for label, pattern in rules.items():
        out = F.when(phase == label, matches(text, pattern)).otherwise(out)
    return out


def own_completion(text: Column, context_done: Column, v: Vocabulary = TOOLS) -> Column:
    """Whether a post itself says that a reset was done, or its context does, without future, denial or narrow scope."""
    future = matches(text, r"\b(?:will|tomorrow|tonight)\b")
    denied = matches(text, v.phases[0][0])
    return F.coalesce((matches(text, v.given) | (matches(text, v.restore) & context_done)) & ~future & ~denied & ~same_segment(text, v.restore, v.narrow), F.lit(False))


def horizon_hours(value: Column, most: int = 168) -> Column:
    """A whole number of hours from 1 to ``most``; null for anything else."""
    n = F.when(value.rlike(r"^\d{1,9}$"), value.try_cast("int"))
    return F.when(n.between(1, most), n)


def allocation_offsets(start: Column, end: Column, anchor: Column) -> Column:
    """first and count of the whole hours from an anchor on that a range touches; null where none lies ahead."""
    first = F.greatest(F.lit(0), F.floor((micros(start) - micros(anchor)) / HOUR_US))
    last = F.ceil((micros(end) - micros(anchor)) / HOUR_US)
    return F.when(last > first, F.struct(first.alias("first"), (last - first).alias("count")))


def next_run(now: Column, cadence_minutes: int, delay_minutes: int, wake_up: Column) -> Column:
    """The next boundary of the cadence plus a delay, or an earlier wake-up that is still ahead."""
    width = cadence_minutes * 60_000_000
    boundary = from_micros((F.floor(micros(now) / width) + 1) * width + delay_minutes * 60_000_000)
    return F.when((wake_up > now) & (wake_up < boundary), wake_up).otherwise(boundary)


def asserted_range(text: Column, published: Column, phase: Column) -> Column:
    """The half-open range (start, end, precision) that a post's words of time mean; null when they mean none.

    The first rule that matches decides.  A completed event without words of time happened in the
    hour before its post.
    """
    us, hour, day = micros(published), HOUR_US, 24 * HOUR_US
    today = F.floor(us / day) * day

    def number(pattern: str) -> Column:
        return F.regexp_extract(text, f"(?i){pattern}", 1).try_cast("long")

    minutes, hours, days = (number(rf"\bin (\d{{1,3}}) {unit}s?\b") for unit in ("minute", "hour", "day"))
    within = number(r"\bwithin (\d{1,3}) hours?\b")
    names = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    weekday = F.coalesce(*[F.when(matches(text, rf"\bon {n}\b"), F.lit(i)) for i, n in enumerate(names)])
    ahead = F.pmod(weekday - F.weekday(published) - 1, F.lit(7)) + 1
    rules = [
        (minutes.isNotNull(), us + minutes * 60_000_000, us + minutes * 60_000_000 + 10 * 60_000_000, "minute"),
        (within.isNotNull(), us, us + within * hour, "window"),
        (hours.isNotNull(), us + hours * hour, us + (hours + 1) * hour, "hour"),
        (days.isNotNull(), today + days * day, today + (days + 1) * day, "day"),
        (matches(text, r"\bnext hour\b"), us, us + 2 * hour, "hour"),
        (matches(text, r"\bthis morning\b"), today + 6 * hour, today + 12 * hour, "part_of_day"),
        (matches(text, r"\bthis evening\b"), today + 17 * hour, today + 22 * hour, "part_of_day"),
        (matches(text, r"\btonight\b"), today + 18 * hour, today + day, "part_of_day"),
        (matches(text, r"\btomorrow\b"), today + day, today + 2 * day, "day"),
        (weekday.isNotNull(), today + ahead * day, today + (ahead + 1) * day, "day"),
        (matches(text, r"\bnext week\b"), today + (7 - F.weekday(published)) * day, today + (14 - F.weekday(published)) * day, "week"),
        (matches(text, r"\bsoon\b"), us, us + 6 * hour, "vague"),
        (phase == "completed", us - hour, us, "before_post"),
    ]
    out = None
    for holds, start, end, precision in rules:
        value = F.struct(from_micros(start).alias("start"), from_micros(end).alias("end"), F.lit(precision).alias("precision"))
        out = F.when(holds, value) if out is None else out.when(holds, value)
    return out


def signal_of(text: Column, published: Column, official: Column, v: Vocabulary = TOOLS, dated: Callable[[Column, Column, Column], Column] = asserted_range) -> Column:
    """Everything a post claims, as one struct; null when it claims no event.

    ``dated`` finds the range from text, post time and phase; ``timephrases.stated_range`` is the fuller grammar.
    """
    kind = event_of(text, v)
    phase = phase_of(text, kind, v)
    whole = F.struct(kind.alias("event_type"), phase.alias("phase"), impact_of(text, kind, official, v).alias("impact"), rivalry_of(text, kind, v).alias("rivalry"), products_in(text, v).alias("product"), scope_predicates(text, v).alias("scope"), dated(text, published, phase).alias("range"))
    return F.when(kind.isNotNull(), whole)
