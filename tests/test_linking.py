"""Ordered folds of linking against the same rules written out over lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import DISTINCTIVE
from tidemark.operators import linking
from tidemark.plans import link_queries

FOLDER = "/root/testdata/sf0.001"


def test_scored_clusters(spark):
    rows = sorted((r for r in link_queries._entries(spark, FOLDER).collect()), key=lambda r: (r["user_id"], r["first_at"], r["event_id"]))
    want, clusters = {}, []
    for r in rows:
        scores = []
        for k, own in enumerate(clusters):
            if own[0]["user_id"] != r["user_id"] or (r["first_at"] - max(x["last_at"] for x in own)).total_seconds() > 20 * 3600:
                continue
            surfaces = any("unknown" in x["surfaces"] or "unknown" in r["surfaces"] or set(x["surfaces"]) & set(r["surfaces"]) for x in own)
            shared = set(r["tokens"]) & {t for x in own for t in x["tokens"]}
            same = own[0]["category"] == r["category"]
            if same and surfaces and (len(shared) > 1 or shared & set(DISTINCTIVE)):
                scores.append((4, max(x["last_at"] for x in own), k))
            elif r["followup"] and surfaces and (same or r["category"] == "other" or "unknown" in r["surfaces"]):
                scores.append((1, max(x["last_at"] for x in own), k))
        best = max(scores, default=None)
        if best is None or (best[0] == 1 and len(scores) > 1):
            clusters.append([r])
            want[r["event_id"]] = r["event_id"]
        else:
            clusters[best[2]].append(r)
            want[r["event_id"]] = clusters[best[2]][0]["event_id"]
    got = {r["event_id"]: r["cluster"] for r in link_queries.scored_clusters(spark, FOLDER).collect()}
    assert got == want and 1 < len(set(got.values())) < len(got)


def test_claimed_identities(spark):
    clusters = [(0, 1, 5, ["a"]), (0, 2, 1, ["a", "b"]), (0, 3, 9, ["b"]), (0, 4, 10, ["b"]), (1, 5, 0, ["a"]), (0, 6, 2, ["z"])]
    priors = [(0, "old", 1, ["a"]), (0, "mid", 2, ["b"]), (0, "new", 3, ["b", "a"]), (1, "other", 9, ["q"])]
    a = spark.createDataFrame(clusters, "scope int, cluster int, turn int, groups array<string>")
    b = spark.createDataFrame(priors, "scope int, prior string, created int, groups array<string>")
    got = {r["cluster"]: r["identity"] for r in linking.claimed_identities(a, b, ["scope"], "cluster", "turn", "groups", "prior", "created").collect()}
    assert got == {2: "old", 1: "new", 3: "mid", 4: None, 5: None, 6: None}


def test_claims_of_real_rows(spark):
    rows = link_queries.claimed_identities(spark, FOLDER).filter(F.col("identity").isNotNull()).collect()
    assert rows and len({r["identity"] for r in rows}) == len(rows)


def test_claims_of_clusters_in_several_rows(spark):
    """Groups a row each; a cluster of one name in two keys is two clusters."""
    names = "scope int, cluster int, turn int"
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 1, 1)], names)
    rows = spark.createDataFrame([(0, 1, 1, ["b"]), (0, 1, 1, ["a"]), (0, 2, 2, ["a"]), (0, 2, 2, ["c"]), (1, 1, 1, ["a"])], names + ", groups array<string>")
    b = spark.createDataFrame([(0, "old", 1, ["a"]), (0, "mid", 2, ["b"]), (0, "new", 3, ["c"]), (1, "far", 9, ["a"])], "scope int, prior string, created int, groups array<string>")
    got = linking.claimed_identities(a, b, ["scope"], "cluster", "turn", "groups", "prior", "created", rows).collect()
    assert sorted((r["scope"], r["cluster"], r["identity"]) for r in got) == [(0, 1, "old"), (0, 2, "new"), (1, 1, "far")]
