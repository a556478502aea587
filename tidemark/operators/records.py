"""Records: envelopes, observations, rules that they must keep, and the predicates that choose among them."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import hashing
from tidemark.functions.text import event_family
from tidemark.functions.time import HOUR_US, iso_ms, micros
from tidemark.operators.coverage import reasons


def envelope(kind: str, prefix: str, natural_key: Column, created: Column, producer: tuple[str, str], config: Column, data: Column, revision: Column | None = None) -> Column:
    """The struct that every record is: who made which revision of what, when, and its data."""
    number = revision if revision is not None else F.lit(1)
    own = hashing.record_id(prefix, natural_key)
    before = F.when(number > 1, F.struct(own.alias("record_id"), (number - 1).alias("revision")))
    made_by = F.struct(F.lit(producer[0]).alias("name"), F.lit(producer[1]).alias("version"), F.when(config.isNotNull(), hashing.label(config)).alias("config_hash"))
    return F.struct(F.lit(kind).alias("record_type"), own.alias("record_id"), number.alias("revision"), before.alias("supersedes"), iso_ms(created).alias("created_at"), made_by.alias("producer"), data.alias("data"))


def observation(items: DataFrame, provider: str) -> DataFrame:
    """Items (item_id, url, published, seen, text, language, relations) as observations.

    Missing texts are empty, missing media types plain; relations are normalised and, for the
    material hash, sorted; content_hash is of the text alone.
    """
    text = F.coalesce("text", F.lit(""))
    relations = F.transform(F.coalesce("relations", F.array().cast(items.schema["relations"].dataType)), lambda r: F.struct(F.coalesce(r["type"], F.lit("unknown")).alias("type"), r["target"].cast("string").alias("target")))
    fields = [F.col("url"), iso_ms(F.col("published")), text, F.col("language"), F.to_json(F.array_sort(relations))]
    return items.select(
        F.lit(provider).alias("ingest_provider"), F.col("item_id").cast("string").alias("item_id"), "url", iso_ms(F.col("published")).alias("published_at"), iso_ms(F.col("seen")).alias("first_seen_at"),
        relations.alias("relations"), text.alias("text"), "language", hashing.label(text).alias("content_hash"), hashing.material_hash(*fields).alias("material_hash"),
    )


def violations(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """key and rule, a row for each rule that a record breaks; a rule that is null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def episode_rules(states: Sequence[str], trends: Sequence[str], field: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """What an episode (state, trend, pressure, first_at, last_at, resolved_at, as_of, roots) must keep; ``field`` finds a field's column."""
    return {
        "state": field("state").isin(*states),
        "trend": field("trend").isin(*trends),
        "pressure": field("pressure").between(0.0, 1.0),
        "clock_order": (field("first_at") <= field("last_at")) & (field("last_at") <= field("as_of")),
        "resolved_clock": F.when(field("state") == "resolved", field("resolved_at").isNotNull() & (field("resolved_at") <= field("as_of"))).otherwise(F.lit(True)),
        "roots_unique": F.size(F.array_distinct(field("roots"))) == F.size(field("roots")),
        "roots_present": F.size(field("roots")) > 0,
    }


def same_contract(actual: Column, expected: Mapping[str, object] | None) -> Column:
    """Whether a contract struct has every expected value; without an expectation all do."""
    out = F.lit(True)
    for name, value in (expected or {}).items():
        out = out & actual[name].eqNullSafe(F.lit(value))
    return out


def products_of(product: Column, products: Column) -> Column:
    """Sorted distinct products of a scope that names one, or several."""
    return F.array_sort(F.array_distinct(F.coalesce(products, F.array(product))))


def in_target(scope: Mapping[str, Column], vendor: str, product: str, population: str) -> Column:
    """Whether a scope (vendor, population, product, products) is of the vendor and population and has the product."""
    return (scope["vendor"] == vendor) & (scope["population"] == population) & F.array_contains(products_of(scope["product"], scope["products"]), product)


def timing_candidate(s: Mapping[str, Column], roles: Sequence[str], phases: Sequence[str], most_hours: float = 48.0) -> Column:
    """Whether a signal can time an event: a direct, eligible, text statement of a known source about the family, with no range or one of (0, most_hours]."""
    length = micros(s["range_end"]) - micros(s["range_start"])
    ranged = (s["range_start"].isNull() & s["range_end"].isNull()) | F.coalesce((length > 0) & (length <= int(most_hours * HOUR_US)), F.lit(False))
    own = event_family(s["event_type"]) == "quota_restoration"
    return F.coalesce(own & s["phase"].isin(*phases) & s["role"].isin(*roles) & (s["derivation"] == "primary_statement") & (s["media_type"] == "text/plain") & s["eligible"] & ~s["synthetic"] & (s["stance"] == "supports") & s["in_target"], F.lit(False)) & ranged


def active_signals(signals: DataFrame, outcomes: DataFrame, on: Sequence[str], at: Column) -> DataFrame:
    """Signals (published, range_start, range_end, products) that are active at a time: published, not over, and not used up.

    An outcome (ended, products) uses up a signal of a common product that was published before
    the outcome's end, unless that end is after ``at`` or not after the start of the signal's range.
    """
    open_ = signals.filter((F.col("published") <= at) & (F.col("range_end").isNull() | (F.col("range_end") > at)))
    done = outcomes.filter(F.col("ended") <= at).select(*on, F.explode("products").alias("__product"), "ended").groupBy(*on, "__product").agg(F.max("ended").alias("__ended"))
    # the last outcome of a product is the one that uses up most
    used = open_.withColumn("__product", F.explode("products")).join(done, [*on, "__product"]).filter((F.col("__ended") > F.col("published")) & (F.col("range_start").isNull() | (F.col("__ended") > F.col("range_start"))))
    return open_.join(used.select("signal_id").distinct(), "signal_id", "left_anti")


def primary_evidence(provider: Column, created: Column, seen: Column, fetched: Column, at: Column, effective: Column, primary: Sequence[str]) -> Column:
    """Whether an observation counts as evidence: from ``effective`` on only those of primary providers do, by when they were learnt."""
    learnt = F.greatest(created, seen, fetched)
    return learnt.isNotNull() & ((F.greatest(learnt, at) < effective) | provider.isin(*primary))


def eligible_outcomes(outcomes: DataFrame, observations: DataFrame, signals: DataFrame) -> DataFrame:
    """outcome_id of confirmed outcomes (verification: array of observation, revision, contract) of which some verification holds.

    It holds where the exact revision is current (observations: observation, revision) and a
    current signal of that observation was made under the same contract and says completed.
    """
    one = outcomes.filter("status = 'confirmed'").select("outcome_id", F.explode("verification").alias("v")).select("outcome_id", "v.observation", "v.revision", "v.contract")
    current = one.join(observations.select("observation", "revision"), ["observation", "revision"], "left_semi")
    backed = current.join(signals.filter("phase = 'completed'").select("observation", "contract"), ["observation", "contract"], "left_semi")
    return backed.select("outcome_id").distinct()


def history_rows(outcomes: DataFrame, sources: DataFrame) -> DataFrame:
    """Public rows of outcomes with their source, null where it is unknown, in display order: last start, last known, id, last revision first."""
    joined = outcomes.join(sources.select("observation", F.col("url").alias("__url"), F.col("author").alias("__author")), "observation", "left")
    source = F.when(F.col("__url").isNotNull(), F.struct(F.col("__url").alias("url"), F.col("__author").alias("author")))
    rows = joined.select("outcome_id", "revision", "start", "end", "known_at", source.alias("source"))
    return rows.orderBy(F.desc("start"), F.desc("known_at"), "outcome_id", F.desc("revision"))


def evidence_tier(impact: Column, competitive: Column, core: Column) -> Column:
    return F.when(impact, "experience").when(competitive, "competition").when(core, "core").otherwise("other_context")


def per_tier(rows: DataFrame, tier: str, order: Sequence[Column], available: str, cutoff: Column, limit: int = 6) -> DataFrame:
    """The first ``limit`` rows of each tier, of those known by the cutoff (current) and of later ones (pending)."""
    from pyspark.sql.window import Window

    part = F.when(F.col(available) <= cutoff, "current").otherwise("pending")
    ranked = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy(tier, "part").orderBy(*order)))
    return ranked.filter(F.col("rank") <= limit)


def compatibility_reasons(snapshot: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """key, reasons and compatible: how the exact revisions that a snapshot names (key, record_id, revision) stand now.

    missing: the exact revision is gone; superseded: a later one of the record exists.
    """
    latest = records.groupBy("record_id").agg(F.max("revision").alias("__latest"))
    exact = records.select("record_id", "revision").distinct().withColumn("__there", F.lit(True))
    joined = snapshot.join(exact, ["record_id", "revision"], "left").join(latest, "record_id", "left")
    reason = F.when(F.col("__there").isNull(), "missing").when(F.col("__latest") > F.col("revision"), "superseded")
    found = joined.groupBy(key).agg(F.array_sort(F.collect_set(reason)).alias("reasons"))  # at most two values
    return found.withColumn("compatible", ~F.array_contains("reasons", "missing"))


def readiness(parts: Sequence[DataFrame]) -> DataFrame:
    """One row from the single rows of ``parts`` (each with a column blockers, an array): status and all blockers."""
    out = None
    for i, p in enumerate(parts):
        own = p.withColumnRenamed("blockers", f"__b{i}")
        out = own if out is None else out.crossJoin(F.broadcast(own))  # single rows
    blockers = F.flatten(F.array(*[F.col(f"__b{i}") for i in range(len(parts))]))
    names = [c for c in out.columns if not c.startswith("__b")]
    return out.select(*names, blockers.alias("blockers"), F.when(F.size(blockers) == 0, "ready").otherwise("blocked").alias("status"))


def with_time_blockers(blockers: Column, timed: Mapping[str, Column]) -> Column:
    """Blockers of a stored row with those that depend on time replaced by what holds now."""
    kept = F.array_except(blockers, F.array(*[F.lit(n) for n in timed]))
    return F.array_union(kept, reasons(timed))


def serving_current(age_hours: Column, cadence_hours: float, same_config: Column, same_watermark: Column) -> Column:
    """Whether a stored view may be served as current: same settings, at most three cadences old, and the inputs have not moved."""
    return F.coalesce(same_config & same_watermark & (age_hours >= 0) & (age_hours <= 3 * cadence_hours), F.lit(False))


def operator_confirmation(o: Mapping[str, Column], producer: str) -> Column:
    """Whether an observation is an operator's confirmation: made by the console, of its own text, with clocks that agree."""
    same_clock = (micros(o["published"]) == micros(o["seen"])) & (micros(o["seen"]) == micros(o["fetched"])) & (micros(o["fetched"]) == micros(o["created"]))
    return F.coalesce((o["producer"] == producer) & (o["content_hash"] == hashing.label(o["text"])) & (o["media_type"] == "text/plain") & (F.length(o["text"]) > 0) & (o["relations"] == 0) & o["url"].isNull() & same_clock, F.lit(False))


def impact_policy(episode: Mapping[str, Column], contract: str, parameters: Mapping[str, float]) -> Column:
    """Whether an episode was computed under a contract and with these parameters."""
    out = episode["contract"] == contract
    for name, value in parameters.items():
        out = out & episode[name].eqNullSafe(F.lit(value))
    return F.coalesce(out, F.lit(False))


@F.pandas_udf(T.StringType())
def canonical_document(text: pd.Series) -> pd.Series:
    """JSON texts with sorted keys, no spaces and whole numbers without a point; null for what is no JSON."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else hashing.canonical_json(json.loads(x))
        except ValueError:
            return None

    return text.map(one)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("record_id", T.StringType()), T.StructField("revision", T.IntegerType())])))
def exact_references(text: pd.Series) -> pd.Series:
    """Every {record_id, revision} anywhere in a JSON text, in the order in which they stand there."""

    def walk(x: object, out: list) -> list:
        if isinstance(x, dict):
            if isinstance(x.get("record_id"), str) and isinstance(x.get("revision"), int) and not isinstance(x["revision"], bool):
                out.append({"record_id": x["record_id"], "revision": x["revision"]})
            for v in x.values():
                walk(v, out)
        elif isinstance(x, list):
            for v in x:
                walk(v, out)
        return out

    def one(x: str | None) -> list:
        try:
            return walk(json.loads(x), []) if x is not None else []
        except ValueError:
            return []

    return text.map(one)


def quarantined(text: Column, reason: str = "$.reason", post: str = "$.item") -> Column:
    """(reason, item) of a quarantined payload; null where it is no JSON object."""
    doc = F.try_parse_json(text)
    return F.when(F.substring(F.trim(text), 1, 1).eqNullSafe("{") & doc.isNotNull(), F.struct(F.try_variant_get(doc, reason, "string").alias("reason"), F.try_variant_get(doc, post, "string").alias("item")))


def normalised_gate(tokens: Column) -> Column:
    """(id, revision) structs of a gate, sorted, once each; null where one lacks an id or has no positive revision."""
    bad = F.exists(tokens, lambda t: t["id"].isNull() | (t["id"] == "") | F.coalesce(t["revision"] < 1, F.lit(True)))
    return F.when(~F.coalesce(bad, F.lit(True)), F.array_sort(F.array_distinct(tokens)))


def outcome_gate(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """gate: one hash of all (id, revision, status) of each key, with max_known and any_confirmed."""
    token = F.concat_ws("@", F.col("id").cast("string"), F.col("revision").cast("string"), "status")
    # outcomes of a key are few; their digests are what is sorted, not the rows
    out = outcomes.groupBy(*keys).agg(F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2(token, 256))), ""), 256)).alias("gate"), F.max("known_at").alias("max_known"), F.bool_or(F.col("status") == "confirmed").alias("any_confirmed"))
    return out
