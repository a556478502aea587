"""A sound record of each type breaks no rule; each fault breaks the rules written beside it."""

from __future__ import annotations

import copy
import json

from pyspark.sql import functions as F

from tidemark.operators import validation as va

AT, LATER, LAST = "2024-01-01T00:00:00.000Z", "2024-01-01T01:00:00.000Z", "2024-01-01T02:00:00.000Z"
RANGE = {"start": AT, "end": LATER, "boundary": "[start,end)"}
SCOPE = {"vendor": "v", "product": "p", "population": "all"}
REF, ASSERTION, SHA = {"record_id": "r", "revision": 1}, {"assertion_id": "a", "revision": 1}, "sha256:" + "0" * 64
QUALITY = {"score": 0.5, "provider_coverage": 1.0, "outcome_sample_count": 3, "sample_sufficiency": 0.2}


def slot(start, end, left):
    return {"start": start, "end": end, "hazard": 0.5, "first_reset_probability": left * 0.5, "reset_by_end_probability": 1 - left * 0.5, "rolling_4h_probability": None}


SOUND = {
    "raw_observation": {"ingest_provider": "x", "provider_item_id": "1", "published_at": None, "first_seen_at": AT, "fetched_at": AT, "author": {"id": "u"}, "native_relations": [], "content": {"content_hash": SHA}, "availability_attestation": {"available_at": AT, "verified_at": AT, "basis": "archive_snapshot", "attestor_url": "u", "verification": "v"}},
    "normalized_signal": {"available_at": AT, "observation_refs": [REF], "claim": {"scope": SCOPE, "asserted_time_range": None, "impact": {"category": "auth", "severity": "low", "lifecycle": "active", "affected_scope": "platform", "surfaces": ["cli"]}}, "extraction": {"confidence": 0.5, "semantic_policy_hash": SHA, "relevance": {"policy_version": "1", "decision": "irrelevant", "reason_code": "none", "basis": "self", "matched_segments": [], "context_refs": []}}, "provenance": {"root_evidence_id": "e", "independence_group_id": "g", "feature_eligible": False}},
    "event_candidate": {"as_of": AT, "event_cluster_id": "c", "scope": SCOPE, "hypothesized_time_range": RANGE, "evidence": []},
    "impact_episode": {"state": "active", "trend": "rising", "pressure": 0.5, "first_at": AT, "last_at": AT, "resolved_at": None, "as_of": LATER, "roots": ["a"]},
    "reset_outcome": {"known_at": AT, "scope": SCOPE, "occurred_time_range": RANGE, "status": "confirmed", "label_policy_version": "outcomes/1", "label_grade": "gold", "event_identity": "e", "candidate_refs": [REF], "verification": [{"kind": "official_confirmation", "independence_group_id": "g", "observation_ref": REF}]},
    "feature_snapshot": {"knowledge_cutoff": AT, "config_hash": SHA, **{k: "1" for k in ("feature_schema_version", "taxonomy_version", "deduplication_version", "timezone_database_version", "extractor_model", "extractor_model_version", "extractor_prompt_version")}, "extractor_semantic_policy_hash": SHA, "target": {"start": AT, "end": LATER, "base_slot": "PT1H", "display_horizon": "PT4H"}, "data_quality": QUALITY, "source_record_refs": [], "coverage_assertion_refs": [ASSERTION]},
    "prediction": {"issued_at": AT, "knowledge_cutoff": AT, "horizon": {**RANGE, "end": LAST}, "scope": SCOPE, "base_slot": "PT1H", "display_horizon": "PT4H", "slots": [slot(AT, LATER, 1.0), slot(LATER, LAST, 0.5)], "no_reset_probability": 0.25, "data_quality": QUALITY, "feature_snapshot_refs": [REF, {**REF, "revision": 2}], "recurrence_anchor": None, "model": {"family": "f", "version": "1", "artifact_hash": "0" * 64, "model_contract_hash": SHA, "training_cutoff": AT}},
    "prediction_settlement": {"prediction_ref": REF, "slot_index": 0, "window": RANGE, "display_horizon": "PT4H", "status": "pending", "settled_at": AT, "outcome_as_of_mode": "live", "coverage_as_of_mode": "live", "outcome_refs": [], "coverage_assertion_refs": [ASSERTION], "coverage_assertion_snapshot_hash": SHA, "coverage": {"complete": True, "providers": []}, "reason": "r"},
}
# type, path of the field, its wrong value, the rules that breaks
FAULTS = [
    ("raw_observation", "provider_item_id", "", {"identity"}),
    ("raw_observation", "published_at", "2024-01-01", {"published_at"}),
    ("raw_observation", "first_seen_at", "neverZ", {"collected_at"}),
    ("raw_observation", "fetched_at", "2023-12-31T00:00:00Z", {"attestation"}),
    ("raw_observation", "availability_attestation.basis", "hearsay", {"attestation"}),
    ("raw_observation", "native_relations", None, {"body"}),
    ("normalized_signal", "observation_refs", [], {"observation_refs"}),
    ("normalized_signal", "observation_refs", [{"record_id": "r", "revision": 0}], {"observation_refs"}),
    ("normalized_signal", "claim.scope.product", "multi_product", {"scope"}),
    ("normalized_signal", "claim.asserted_time_range", {**RANGE, "end": AT}, {"asserted_range"}),
    ("normalized_signal", "claim.impact.surfaces", ["cli", "moon"], {"impact"}),
    ("normalized_signal", "claim.competitive_context", {"kind": "gift"}, {"competitive_context"}),
    ("normalized_signal", "extraction.confidence", 1.5, {"confidence"}),
    ("normalized_signal", "extraction.confidence", "high", {"confidence"}),
    ("normalized_signal", "extraction.semantic_policy_hash", "0", {"policy_hash"}),
    ("normalized_signal", "extraction.relevance.basis", "guess", {"relevance"}),
    ("normalized_signal", "provenance.feature_eligible", None, {"eligibility"}),
    ("normalized_signal", "provenance.independence_group_id", "", {"provenance"}),
    ("event_candidate", "event_cluster_id", None, {"identity"}),
    ("event_candidate", "hypothesized_time_range.boundary", "(start,end)", {"time_range"}),
    ("event_candidate", "evidence", None, {"evidence"}),
    ("impact_episode", "state", "odd", {"state"}),
    ("impact_episode", "last_at", LAST, {"clock_order"}),
    ("impact_episode", "state", "resolved", {"resolved_clock"}),
    ("impact_episode", "roots", ["a", "a"], {"roots_unique"}),
    ("reset_outcome", "known_at", None, {"known_at"}),
    ("reset_outcome", "replay_available_at", "soon", {"replay_available_at"}),
    ("reset_outcome", "label_grade", "silver", {"confirmed"}),
    ("reset_outcome", "occurred_time_range", None, {"confirmed"}),
    ("reset_outcome", "verification", [], {"verification"}),
    ("feature_snapshot", "taxonomy_version", "", {"versions"}),
    ("feature_snapshot", "target.base_slot", "PT2H", {"resolution"}),
    ("feature_snapshot", "data_quality.outcome_sample_count", 1.5, {"quality"}),
    ("feature_snapshot", "coverage_assertion_refs", [ASSERTION, ASSERTION], {"coverage_unique"}),
    ("prediction", "knowledge_cutoff", LATER, {"clocks"}),
    ("prediction", "slots", [], {"slot_count", "slots_cover", "slot_hours", "rolling", "no_event", "feature_refs"}),
    ("prediction", "slots.1.start", AT, {"slot_hours"}),
    ("prediction", "slots.1.hazard", 2.0, {"slot_shares", "slot_identities", "no_event"}),
    ("prediction", "slots.1.reset_by_end_probability", 0.7, {"slot_identities"}),
    ("prediction", "slots.0.rolling_4h_probability", 0.7, {"rolling"}),
    ("prediction", "horizon.end", "2024-01-01T03:00:00.000Z", {"slots_cover"}),
    ("prediction", "no_reset_probability", 0.3, {"no_event"}),
    ("prediction", "feature_snapshot_refs", [REF, REF], {"feature_refs"}),
    ("prediction", "model.training_cutoff", LATER, {"trained_before"}),
    ("prediction", "recurrence_anchor", {"outcome_ref": REF}, {"anchor"}),
    ("prediction_settlement", "slot_index", 168, {"slot_index"}),
    ("prediction_settlement", "status", "maybe", {"status"}),
    ("prediction_settlement", "outcome_as_of_mode", "archive_replay", {"modes"}),
    ("prediction_settlement", "outcome_refs", None, {"outcome_refs"}),
    ("prediction_settlement", "coverage.complete", "yes", {"coverage"}),
    ("prediction_settlement", "reason", "", {"reason"}),
]
SCHEMA = "schema_version string, record_type string, record_id string, revision int, created_at string, producer struct<name:string,version:string>, supersedes struct<record_id:string,revision:int>, data string, rule int, `__object` int"


def record(kind, data, name, **other):
    row = {"schema_version": "tidemark/1", "record_type": kind, "record_id": name, "revision": 1, "created_at": AT, "producer": ("adjudicator", "1"), "supersedes": None, "data": data if isinstance(data, str | None) else json.dumps(data), "rule": 0, "__object": 0} | other
    return tuple(row.values())


def faulty(kind, path, value):
    data = copy.deepcopy(SOUND[kind])
    *way, last = [int(p) if p.isdigit() else p for p in path.split(".")]
    at = data
    for p in way:
        at = at[p]
    at[last] = value
    return data


def found(spark, rows):
    out = {}
    for r in va.record_violations(spark.createDataFrame(rows, SCHEMA)).collect():
        out.setdefault(r["record_id"], set()).add(r["rule"])
    return out


def test_each_fault_breaks_its_rules(spark):
    assert set(SOUND) == set(va.RULES) == set(va.FIELDS)
    rows = [record(k, d, f"sound-{k}") for k, d in SOUND.items()]
    rows += [record(k, faulty(k, p, v), f"{i}") for i, (k, p, v, _) in enumerate(FAULTS)]
    got = found(spark, rows)
    assert {k: v for k, v in got.items() if k.startswith("sound")} == {}
    assert got == {str(i): rules for i, (*_, rules) in enumerate(FAULTS)}


def test_envelopes(spark):
    data = SOUND["event_candidate"]
    rows = [record("event_candidate", data, "a", schema_version="other"), record("novel", data, "b"), record("event_candidate", data, "c", revision=0), record("event_candidate", data, "d", created_at=None), record("event_candidate", data, "e", producer=("x", None)), record("event_candidate", data, "f", supersedes=("f", 0)), record("event_candidate", "[1]", "g"), record("event_candidate", None, "h"), record("event_candidate", '{"as_of": ', "i"), record(None, "{}", "j"), record("reset_outcome", SOUND["reset_outcome"], "k", producer=("x", "1"))]
    want = dict(zip("abcdefghijk", ("schema_version", "record_type", "revision", "created_at", "producer", "supersedes", "data", "data", "data", "record_type", "confirmed"), strict=True))
    assert found(spark, rows) == {k: {v} for k, v in want.items()}


def test_repeated_long_and_no_records(spark):
    long = {**SOUND["prediction_settlement"], "reason": "x" * 3_000_000, "status": "maybe"}
    rows = [record("prediction_settlement", long, "long")] * 2
    assert va.record_violations(spark.createDataFrame(rows, SCHEMA)).filter(F.col("rule") == "status").count() == 2
    assert va.record_violations(spark.createDataFrame([], SCHEMA)).count() == 0
