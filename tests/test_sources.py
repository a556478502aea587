"""Files that are read, and reports that are written and read back."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.operators import profile
from tidemark.plans import model_queries, profile_queries
from tidemark.sources import records, rows

FOLDER = "/root/testdata/sf0.001"


def lines(path, docs):
    path.write_text("\n".join(d if isinstance(d, str) else json.dumps(d) for d in docs) + "\n")
    return str(path)


def post(number, **more):
    return {"platform": "x", "id": str(number), "handle": "a", "url": f"https://p/a/status/{number}", "published_at": "2024-01-01T00:00:00Z", "text": "t", "language": "en"} | more


def test_json_records_fail_or_become_null(spark, tmp_path):
    good, bad = lines(tmp_path / "good", [{"a": 1}, {"a": 2, "b": 3}]), lines(tmp_path / "bad", [{"a": 1}, '{"a": '])
    assert sorted(r["a"] for r in records.json_records(spark, good, "a int").collect()) == [1, 2]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        records.json_records(spark, bad, "a int").collect()
    assert sorted(r["a"] or 0 for r in records.json_records(spark, bad, "a int", strict=False).collect()) == [0, 1]


def test_timeline_import(spark, tmp_path):
    got = {r["id"]: r for r in records.timeline(spark, lines(tmp_path / "t", [post(1), post(2, text="RT @b hi"), post(3, text=None)])).collect()}
    assert {k: r["feature_eligible"] for k, r in got.items()} == {"1": True, "2": False, "3": True}
    for name, docs, said in (("twice", [post(1), post(1, text="u")], "stands twice"), ("url", [post(1, url="https://p/a/status/2")], "another post"), ("field", [post(1, handle=None)], "lacks a field")):
        with pytest.raises(Exception, match=said):
            records.timeline(spark, lines(tmp_path / name, docs)).collect()


def test_audit_log_and_fixture(spark, tmp_path):
    log = rows.audit_log(spark, lines(tmp_path / "log", [{"sequence": 2, "event": "b"}, {"sequence": 1, "event": "a"}, {"sequence": 4, "event": "a"}]), "sequence long, event string")
    assert [r["sequence"] for r in log.collect()] == [1, 2, 4]
    assert {(r["sequence"], r["fault"]) for r in rows.audit_faults(log, "sequence", "event").collect()} == {(1, "repeated"), (4, "repeated")}
    items, manifest = rows.fixture(spark, [{"id": "1", "text": "x"}], "id string, text string", ("2024-01-01", "2024-01-02"))
    assert items.collect() == [("1", "x")] and manifest.first()["mode"] == "fixture_declared_complete"


def test_canonical_json():
    assert hashing.canonical_json({"b": [1.0, 2.5, None, True], "a": {"z": "é", "y": 1e21}}) == '{"a":{"y":1e+21,"z":"é"},"b":[1,2.5,null,true]}'


def test_challenger_has_a_hash_of_what_it_is(spark):
    examples = model_queries._examples(spark, FOLDER)
    one = profile.train_challenger(examples, model_queries.FEATURES, "event", "exposure", {"rows": 3})
    assert profile.artifact_is_intact(one) and not profile.artifact_is_intact(one | {"clip": 2.0}) and one["lineage"] == {"rows": 3}


def test_served_views_belong_together(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).select("id", F.col("id").alias("t")).write.parquet(source)
    views = {"count": lambda df: df.agg(F.count(F.lit(1)).alias("n")), "last": lambda df: df.agg(F.max("t").alias("t"))}
    assert profile.serve(spark, source, views, "t", "id", out)
    a, b = spark.read.parquet(f"{out}/count").first(), spark.read.parquet(f"{out}/last").first()
    assert (a["n"], b["t"]) == (10, 9) and a["watermark"] == b["watermark"]

    def moving(df):
        spark.range(10, 11).select("id", F.col("id").alias("t")).write.mode("append").parquet(source)
        return views["count"](df)

    assert not profile.serve(spark, source, {"count": moving}, "t", "id", out)


def test_episodes_hold_their_entries(spark):
    from tidemark.plans import link_queries

    members = {}
    for r in link_queries.scored_clusters(spark, FOLDER).collect():
        members.setdefault((r["user_id"], r["cluster"]), []).append(r["event_id"])
    at = {r["event_id"]: r for r in link_queries._entries(spark, FOLDER).collect()}
    got = {(r["user_id"], r["cluster"]): r for r in profile_queries.impact_episodes(spark, FOLDER).collect()}
    assert got.keys() == members.keys()
    for key, own in members.items():
        r, last = got[key], max(own, key=lambda e: (at[e]["last_at"], e))
        assert (r["n"], r["start"], r["end"]) == (len(own), min(at[e]["first_at"] for e in own), max(at[e]["last_at"] for e in own))
        timeline = [("resolved" if e % 6 == 0 else "mitigating" if at[e]["followup"] else "active", at[e]["last_at"]) for e in sorted(own, key=lambda e: (at[e]["last_at"], e))]
        done, spell, was = False, None, None
        for state, t in timeline:
            done |= state == "resolved"
            spell = t if was is None or (was == "resolved" and state != "resolved") else spell
            was = state
        assert r["state"] == ("reopened" if done and was != "resolved" else was) and r["spell_start"] == spell
        assert 0 <= r["pressure"] <= r["peak_pressure"] <= 1
