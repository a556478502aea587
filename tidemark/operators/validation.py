"""Rules of all eight record types, checked in one pass over a table of mixed records.

A record is an envelope (schema_version, record_type, record_id, revision, created_at, producer,
supersedes) with its data as JSON.  Data is read with the schema of its type; a field of another
type reads as null, and a rule that is null is broken.  Numbers are taken where texts are due.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.records import episode_rules

_REFS, _COVERAGE = "array<struct<record_id:string,revision:int>>", "array<struct<assertion_id:string,revision:int>>"
_REF, _RANGE = "struct<record_id:string,revision:int>", "struct<start:string,end:string,boundary:string>"
_SCOPE = "struct<vendor:string,product:string,population:string,products:array<string>>"
_QUALITY = "struct<score:double,provider_coverage:double,outcome_sample_count:int,sample_sufficiency:double>"

# The types of records, the fields of each that rules look at, and the values that fields can have.
FIELDS = {
    "raw_observation": "ingest_provider string, provider_item_id string, published_at string, first_seen_at string, fetched_at string, author struct<id:string>, native_relations array<struct<type:string>>, content struct<content_hash:string>, availability_attestation struct<available_at:string,verified_at:string,basis:string,attestor_url:string,verification:string>",
    "normalized_signal": f"available_at string, observation_refs {_REFS}, claim struct<scope:{_SCOPE},asserted_time_range:{_RANGE},impact:struct<category:string,severity:string,lifecycle:string,affected_scope:string,surfaces:array<string>>,competitive_context:struct<kind:string,relevance:string,stage:string>>, extraction struct<confidence:double,semantic_policy_hash:string,relevance:struct<policy_version:string,decision:string,reason_code:string,basis:string,matched_segments:array<string>,context_refs:{_REFS}>>, provenance struct<root_evidence_id:string,independence_group_id:string,feature_eligible:boolean>",
    "event_candidate": f"as_of string, event_cluster_id string, scope {_SCOPE}, hypothesized_time_range {_RANGE}, evidence array<string>",
    "impact_episode": "state string, trend string, pressure double, first_at timestamp, last_at timestamp, resolved_at timestamp, as_of timestamp, roots array<string>",
    "reset_outcome": f"known_at string, replay_available_at string, scope {_SCOPE}, occurred_time_range {_RANGE}, status string, label_policy_version string, label_grade string, event_identity string, candidate_refs {_REFS}, verification array<struct<kind:string,independence_group_id:string,observation_ref:{_REF}>>",
    "feature_snapshot": f"knowledge_cutoff string, config_hash string, feature_schema_version string, taxonomy_version string, deduplication_version string, timezone_database_version string, extractor_model string, extractor_model_version string, extractor_prompt_version string, extractor_semantic_policy_hash string, target struct<start:string,end:string,base_slot:string,display_horizon:string>, data_quality {_QUALITY}, source_record_refs {_REFS}, coverage_assertion_refs {_COVERAGE}",
    "prediction": f"issued_at string, knowledge_cutoff string, horizon {_RANGE}, scope {_SCOPE}, base_slot string, display_horizon string, slots array<struct<start:string,end:string,hazard:double,first_reset_probability:double,reset_by_end_probability:double,rolling_4h_probability:double>>, no_reset_probability double, data_quality {_QUALITY}, feature_snapshot_refs {_REFS}, recurrence_anchor struct<outcome_ref:{_REF},occurred_time_range:{_RANGE}>, model struct<family:string,version:string,artifact_hash:string,model_contract_hash:string,training_cutoff:string>",
    "prediction_settlement": f"prediction_ref {_REF}, slot_index int, window {_RANGE}, display_horizon string, status string, settled_at string, outcome_as_of_mode string, coverage_as_of_mode string, outcome_refs {_REFS}, coverage_assertion_refs {_COVERAGE}, coverage_assertion_snapshot_hash string, coverage struct<complete:boolean,providers:array<string>>, reason string",
}
ATTESTED_BY = ("direct_source_publication", "archive_snapshot", "provider_first_seen")
CATEGORIES = ("availability", "performance", "correctness", "tool_execution", "session_state", "quota_accounting", "auth", "client_ux", "security_privacy", "data_integrity", "compatibility", "other")
SEVERITIES = ("critical", "high", "medium", "low", "unknown")
LIFECYCLES = ("active", "investigating", "mitigating", "resolved", "unknown")
AFFECTED = ("individual", "multiple_users", "platform", "unknown")
SURFACES = ("cli", "ide", "api", "web", "agent_loop", "tool_use", "mcp", "auth", "fast_mode", "unknown")
CONTEXT_KINDS = ("model_release", "coding_agent_release", "capability_release", "limit_change", "pricing_change")
CONTEXT_RELEVANCE = ("direct", "adjacent", "weak", "unknown")
CONTEXT_STAGES = ("announced", "preview", "general_availability", "rolled_out", "rumor")
DECISIONS = ("relevant", "irrelevant", "pending_context")
BASES = ("self", "reply_parent", "quote", "unresolved_context")
SETTLED = ("positive", "negative", "pending", "censored")
GRADE_OF = {"official_confirmation": "gold", "operator_confirmation": "silver"}


@dataclass(frozen=True)
class Contract:
    """What records of one deployment must state: versions, the adjudicator of outcomes, states of episodes, resolution."""

    schema: str = "tidemark/1"
    outcome_policy: str = "outcomes/1"
    adjudicator: tuple[str, str] = ("adjudicator", "1")
    states: Sequence[str] = ("active", "resolved", "reopened")
    trends: Sequence[str] = ("rising", "stable", "falling")
    base_slot: str = "PT1H"
    display_horizon: str = "PT4H"
    most_slots: int = 168
    rolling: int = 4
    tolerance: float = 1e-8


def utc(text: Column) -> Column:
    return text.endswith("Z") & text.try_cast("timestamp").isNotNull()


def _time(text: Column) -> Column:
    return text.try_cast("timestamp")


def said(text: Column) -> Column:
    return F.length(text) > 0


def sha_label(text: Column) -> Column:
    return text.rlike("^sha256:[a-f0-9]{64}$")


def half_open(r: Column) -> Column:
    return utc(r["start"]) & utc(r["end"]) & (_time(r["start"]) < _time(r["end"])) & (r["boundary"] == "[start,end)")


def share(p: Column) -> Column:
    return p.between(0.0, 1.0)  # NaN is above every number


def refers(ref: Column, key: str = "record_id") -> Column:
    return said(ref[key]) & (ref["revision"] >= 1)


def all_refer(refs: Column, key: str = "record_id") -> Column:
    return F.forall(refs, lambda r: F.coalesce(refers(r, key), F.lit(False)))


def distinct(values: Column) -> Column:
    return F.size(F.array_distinct(values)) == F.size(values)


def whole_scope(s: Column, several: str = "multi_product") -> Column:
    members = (F.size(s["products"]) >= 2) & distinct(s["products"])
    return said(s["vendor"]) & said(s["product"]) & said(s["population"]) & F.when(s["product"] == several, members).otherwise(F.lit(True))


def unless_null(value: Column, holds: Column) -> Column:
    return F.when(value.isNull(), F.lit(True)).otherwise(holds)


def _quality(q: Column) -> Column:
    return share(q["provider_coverage"]) & share(q["sample_sufficiency"]) & (q["outcome_sample_count"] >= 0)


def _observation(d: Column, c: Contract) -> dict[str, Column]:
    a = d["availability_attestation"]
    vouched = utc(a["available_at"]) & utc(a["verified_at"]) & (_time(a["available_at"]) <= _time(d["fetched_at"])) & a["basis"].isin(*ATTESTED_BY) & said(a["attestor_url"]) & said(a["verification"])
    return {
        "identity": said(d["ingest_provider"]) & said(d["provider_item_id"]),
        "published_at": unless_null(d["published_at"], utc(d["published_at"])),
        "collected_at": utc(d["first_seen_at"]) & utc(d["fetched_at"]),
        "attestation": unless_null(a, vouched),
        "body": d["author"].isNotNull() & d["native_relations"].isNotNull() & said(d["content"]["content_hash"]),
    }


def _signal(d: Column, c: Contract) -> dict[str, Column]:
    claim, x, p = d["claim"], d["extraction"], d["provenance"]
    impact, rival, relevance = claim["impact"], claim["competitive_context"], x["relevance"]
    return {
        "available_at": utc(d["available_at"]),
        "observation_refs": (F.size(d["observation_refs"]) > 0) & all_refer(d["observation_refs"]),
        "scope": whole_scope(claim["scope"]),
        "asserted_range": unless_null(claim["asserted_time_range"], half_open(claim["asserted_time_range"])),
        "impact": unless_null(impact, impact["category"].isin(*CATEGORIES) & impact["severity"].isin(*SEVERITIES) & impact["lifecycle"].isin(*LIFECYCLES) & impact["affected_scope"].isin(*AFFECTED) & (F.size(impact["surfaces"]) > 0) & (F.size(F.array_except(impact["surfaces"], F.array(*map(F.lit, SURFACES)))) == 0)),
        "competitive_context": unless_null(rival, rival["kind"].isin(*CONTEXT_KINDS) & rival["relevance"].isin(*CONTEXT_RELEVANCE) & rival["stage"].isin(*CONTEXT_STAGES)),
        "confidence": share(x["confidence"]),
        "policy_hash": sha_label(x["semantic_policy_hash"]),
        "relevance": unless_null(relevance, relevance["policy_version"].isNotNull() & relevance["decision"].isin(*DECISIONS) & relevance["reason_code"].isNotNull() & relevance["basis"].isin(*BASES) & relevance["matched_segments"].isNotNull() & all_refer(relevance["context_refs"])),
        "eligibility": unless_null(relevance, (relevance["decision"] == "relevant") | F.coalesce(~p["feature_eligible"], F.lit(False))),
        "provenance": said(p["root_evidence_id"]) & said(p["independence_group_id"]),
    }


def _candidate(d: Column, c: Contract) -> dict[str, Column]:
    return {
        "identity": utc(d["as_of"]) & said(d["event_cluster_id"]),
        "scope": whole_scope(d["scope"]),
        "time_range": unless_null(d["hypothesized_time_range"], half_open(d["hypothesized_time_range"])),
        "evidence": d["evidence"].isNotNull(),
    }


def _outcome(d: Column, c: Contract) -> dict[str, Column]:
    name, version = c.adjudicator
    graded = F.forall(d["verification"], lambda v: F.coalesce(_grade(v["kind"]) == d["label_grade"], F.lit(False)) & F.coalesce(said(v["independence_group_id"]), F.lit(False)))
    whole = (d["label_policy_version"] == c.outcome_policy) & said(d["event_identity"]) & d["occurred_time_range"].isNotNull() & (F.size(d["candidate_refs"]) > 0) & graded
    made = (F.col("producer.name") == name) & (F.col("producer.version") == version)
    return {
        "known_at": utc(d["known_at"]),
        "replay_available_at": unless_null(d["replay_available_at"], utc(d["replay_available_at"])),
        "scope": whole_scope(d["scope"]),
        "time_range": unless_null(d["occurred_time_range"], half_open(d["occurred_time_range"])),
        "verification": (F.size(d["verification"]) > 0) & all_refer(F.transform(d["verification"], lambda v: v["observation_ref"])),
        "confirmed": F.when(d["status"] == "confirmed", whole & made).otherwise(F.lit(True)),
    }


def _grade(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, grade in GRADE_OF.items():
        out = F.when(kind == k, grade).otherwise(out)
    return out


def _snapshot(d: Column, c: Contract) -> dict[str, Column]:
    versions = ("feature_schema_version", "taxonomy_version", "deduplication_version", "timezone_database_version", "extractor_model", "extractor_model_version", "extractor_prompt_version")
    stated = sha_label(d["config_hash"]) & sha_label(d["extractor_semantic_policy_hash"])
    for v in versions:
        stated = stated & said(d[v])
    return {
        "cutoff": utc(d["knowledge_cutoff"]),
        "versions": stated,
        "target": utc(d["target"]["start"]) & utc(d["target"]["end"]),
        "resolution": (d["target"]["base_slot"] == c.base_slot) & (d["target"]["display_horizon"] == c.display_horizon),
        "quality": _quality(d["data_quality"]),
        "source_refs": all_refer(d["source_record_refs"]),
        "coverage_refs": all_refer(d["coverage_assertion_refs"], "assertion_id"),
        "coverage_unique": distinct(d["coverage_assertion_refs"]),
    }


def _prediction(d: Column, c: Contract) -> dict[str, Column]:
    slots, n = d["slots"], F.size(d["slots"])
    issued, cutoff, model = _time(d["issued_at"]), _time(d["knowledge_cutoff"]), d["model"]
    number = F.sequence(F.lit(0), n - 1)

    def close(a: Column, b: Column) -> Column:
        return F.abs(a - b) <= c.tolerance

    def step(acc: Column, s: Column) -> Column:
        left = acc["left"] * (1 - s["hazard"])
        ok = acc["ok"] & F.coalesce(close(s["first_reset_probability"], acc["left"] * s["hazard"]) & close(s["reset_by_end_probability"], 1 - left), F.lit(False))
        return F.struct(left.alias("left"), ok.alias("ok"))

    run = F.aggregate(slots, F.struct(F.lit(1.0).alias("left"), F.lit(True).alias("ok")), step)

    def hour(i: Column) -> Column:
        s = F.get(slots, i)
        follows = (i == 0) | (s["start"] == F.get(slots, i - 1)["end"])
        return F.coalesce(utc(s["start"]) & utc(s["end"]) & (_time(s["end"]) == _time(s["start"]) + F.expr("interval 1 hour")) & follows, F.lit(False))

    def rolling(i: Column) -> Column:
        window = F.slice(slots, i + 1, c.rolling)
        none = F.aggregate(window, F.lit(1.0), lambda acc, s: acc * (1 - s["hazard"]))
        value = F.get(slots, i)["rolling_4h_probability"]
        return F.when(F.size(window) < c.rolling, value.isNull()).otherwise(F.coalesce(share(value) & close(value, 1 - none), F.lit(False)))

    def shares(s: Column) -> Column:
        return F.coalesce(share(s["hazard"]) & share(s["first_reset_probability"]) & share(s["reset_by_end_probability"]), F.lit(False))

    some = n.between(1, c.most_slots)
    anchor = d["recurrence_anchor"]
    return {
        "clocks": utc(d["issued_at"]) & utc(d["knowledge_cutoff"]) & (cutoff <= issued) & (issued <= _time(d["horizon"]["start"])),
        "horizon": half_open(d["horizon"]),
        "scope": whole_scope(d["scope"]),
        "resolution": (d["base_slot"] == c.base_slot) & (d["display_horizon"] == c.display_horizon),
        "slot_count": some,
        "slots_cover": (F.get(slots, F.lit(0))["start"] == d["horizon"]["start"]) & (F.get(slots, n - 1)["end"] == d["horizon"]["end"]),
        "slot_hours": F.when(some, F.forall(number, hour)),
        "slot_shares": F.forall(slots, shares),
        "slot_identities": run["ok"],
        "rolling": F.when(some, F.forall(number, rolling)),
        "no_event": share(d["no_reset_probability"]) & close(d["no_reset_probability"], run["left"]),
        "anchor": unless_null(anchor, refers(anchor["outcome_ref"]) & half_open(anchor["occurred_time_range"])),
        "quality": share(d["data_quality"]["score"]) & _quality(d["data_quality"]),
        "feature_refs": (F.size(d["feature_snapshot_refs"]) == n) & all_refer(d["feature_snapshot_refs"]) & distinct(d["feature_snapshot_refs"]),
        "model": said(model["family"]) & said(model["version"]) & model["artifact_hash"].rlike("^[a-f0-9]{64}$") & model["model_contract_hash"].startswith("sha256:") & utc(model["training_cutoff"]),
        "trained_before": _time(model["training_cutoff"]) <= cutoff,
    }


def _settlement(d: Column, c: Contract) -> dict[str, Column]:
    return {
        "prediction_ref": refers(d["prediction_ref"]),
        "slot_index": d["slot_index"].between(0, c.most_slots - 1),
        "window": half_open(d["window"]),
        "resolution": d["display_horizon"] == c.display_horizon,
        "status": d["status"].isin(*SETTLED),
        "settled_at": utc(d["settled_at"]),
        "modes": (d["outcome_as_of_mode"] == "live") & (d["coverage_as_of_mode"] == "live"),
        "outcome_refs": all_refer(d["outcome_refs"]),
        "coverage_refs": all_refer(d["coverage_assertion_refs"], "assertion_id"),
        "coverage_unique": distinct(d["coverage_assertion_refs"]),
        "snapshot_hash": sha_label(d["coverage_assertion_snapshot_hash"]),
        "coverage": d["coverage"]["complete"].isNotNull() & d["coverage"]["providers"].isNotNull(),
        "reason": said(d["reason"]),
    }


RULES: Mapping[str, Callable[[Column, Contract], dict[str, Column]]] = {
    "raw_observation": _observation,
    "normalized_signal": _signal,
    "event_candidate": _candidate,
    "impact_episode": lambda d, c: episode_rules(c.states, c.trends, lambda name: d[name]),
    "reset_outcome": _outcome,
    "feature_snapshot": _snapshot,
    "prediction": _prediction,
    "prediction_settlement": _settlement,
}


def record_violations(rows: DataFrame, contract: Contract = Contract()) -> DataFrame:
    """record_type, record_id, revision and rule, a row for each rule that a record breaks; rows kept are those of no rule.

    A row is checked by the rules of the envelope and, where its type is known and its data is a
    JSON object, by those of its type.  Other columns do not matter.  Equal rows answer each.
    """
    parsed = {kind: F.when(F.col("record_type") == kind, F.from_json("data", fields)) for kind, fields in FIELDS.items()}
    object_ = F.col("data").rlike(r"(?s)^\s*\{.*\}\s*$") & F.try_parse_json("data").isNotNull()
    slim = rows.select("schema_version", "record_type", "record_id", "revision", "created_at", "producer", "supersedes", object_.alias("__object"), *[p.alias(f"__{k}") for k, p in parsed.items()])
    envelope = {
        "schema_version": F.col("schema_version") == contract.schema,
        "record_type": F.col("record_type").isin(*FIELDS),
        "record_id": said(F.col("record_id")),
        "revision": F.col("revision") >= 1,
        "created_at": utc(F.col("created_at")),
        "producer": said(F.col("producer.name")) & said(F.col("producer.version")),
        "supersedes": unless_null(F.col("supersedes"), refers(F.col("supersedes"))),
        "data": F.col("__object"),
    }

    def broken(rules: Mapping[str, Column]) -> Column:
        return F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()]))

    of_type = F.array().cast("array<string>")
    for kind, rules in RULES.items():
        of_type = F.when((F.col("record_type") == kind) & F.col("__object"), broken(rules(F.col(f"__{kind}"), contract))).otherwise(of_type)
    return slim.select("record_type", "record_id", "revision", F.explode(F.concat(broken(envelope), F.coalesce(of_type, F.array().cast("array<string>")))).alias("rule"))
