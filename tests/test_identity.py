"""Identities by rounds against one cluster after the other."""

from __future__ import annotations

import random

from tidemark.operators import identity

C = "k int, cluster int, turn int, groups array<string>, default_id string, split_id string"
P = "k int, prior string, created int, groups array<string>"


def sequential(clusters, priors):
    out, taken, owner = {}, set(), {}
    ids = {(p[0], p[1]) for p in priors}
    ordered = sorted(clusters, key=lambda c: (c[0], c[2], c[1]))
    for c in ordered:
        if (c[0], c[4]) in ids:
            owner.setdefault((c[0], c[4]), c[1])
    for k, name, _, groups, default, split in ordered:
        fit = [p for p in priors if p[0] == k and set(p[3]) & set(groups) and (k, p[1]) not in taken and owner.get((k, p[1]), name) == name]
        if fit:
            chosen, source = min(fit, key=lambda p: (p[2], p[1]))[1], "prior"
        elif (k, default) not in taken:
            chosen, source = default, "default"
        else:
            chosen, source = split, "split"
        taken.add((k, chosen))
        out[k, name] = (chosen, source)
    return out


def tables(seed, n, m, groups, keys=2):
    rng = random.Random(seed)
    clusters = [(rng.randrange(keys), c, rng.randrange(n), rng.sample(groups, rng.randrange(1, 4)), f"p{rng.randrange(2 * m)}", f"s{c}") for c in range(n)]
    priors = [(rng.randrange(keys), f"p{p}", rng.randrange(m), rng.sample(groups, rng.randrange(0, 3))) for p in range(m)]
    return clusters, priors


def check(spark, clusters, priors, block):
    found = identity.identities(spark.createDataFrame(clusters, C), spark.createDataFrame(priors, P), ["k"], block).collect()
    assert {(r["k"], r["cluster"]): (r["identity"], r["source"]) for r in found} == sequential(clusters, priors)
    assert len(found) == len(clusters)


def test_identities(spark):
    check(spark, *tables(1, 40, 30, list("abcdefgh")), 1000)
    check(spark, *tables(2, 60, 25, [f"g{k}" for k in range(60)]), 1000)


def test_a_hot_group_goes_by_blocks(spark):
    clusters, priors = tables(3, 70, 50, ["hot", "x", "y"], 1)
    check(spark, [(*c[:3], [*c[3], "hot"], *c[4:]) for c in clusters], [(*p[:3], [*p[3], "hot"]) for p in priors], 16)


def test_nothing_to_claim(spark):
    clusters = [(0, 1, 0, ["a"], "d", "s1"), (0, 2, 1, ["a"], "d", "s2"), (1, 3, 0, [], "d", "s3")]
    check(spark, clusters, [], 10)
    check(spark, clusters, [(0, "d", 5, ["z"]), (1, "d", 5, [])], 10)


def test_revisions_only_on_change(spark):
    found = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None), ("d", None)], "id string, payload string")
    before = spark.createDataFrame([("a", "x", 3), ("b", "z", 1), ("c", None, 2)], "id string, payload string, revision int")
    got = {tuple(r) for r in identity.identity_revisions(found, before, "id", "payload", "revision").collect()}
    assert got == {("b", "y", 2, "revised"), ("d", None, 1, "new")}


def test_blocks_write_only_what_they_decide(spark, monkeypatch):
    """A hot group's clusters and priors are written again for rounds, which get rarer, and not for each block."""
    names, keep = [], identity.stored
    monkeypatch.setattr(identity, "stored", lambda df, name="table": names.append(name) or keep(df, name))
    clusters = [(0, c, c, ["hot"], f"d{c}", f"s{c}") for c in range(60)]
    check(spark, clusters, [(0, f"p{p:02}", p, ["hot"]) for p in range(50)], 2)
    assert names.count("clusters") <= 10 and names.count("priors") <= 10


def test_a_key_that_fits_a_block_is_decided_at_once(spark, monkeypatch):
    """Even in a hot group: nothing is written again, and no rounds are tried."""
    names, keep = [], identity.stored
    monkeypatch.setattr(identity, "stored", lambda df, name="table": names.append(name) or keep(df, name))
    clusters = [(k % 2, k, -k, ["hot"], f"d{k}", f"s{k}") for k in range(60)]
    check(spark, clusters, [(p % 2, f"p{p:02}", p, ["hot", "x"]) for p in range(50)], 1000)
    assert names.count("claims") == 1 and "clusters" not in names


def test_small_blocks_and_rounds_give_the_same(spark):
    check(spark, *tables(4, 90, 60, [f"g{k}" for k in range(30)], 1), 4)


def test_groups_of_a_cluster_in_several_rows(spark):
    clusters, priors = tables(5, 40, 30, list("abcdef"))
    one = spark.createDataFrame(clusters, C)
    members = spark.createDataFrame([(k, c, t, [g]) for k, c, t, groups, *_ in clusters for g in [*groups, groups[0], None]], "k int, cluster int, turn int, groups array<string>")
    found = identity.identities(one.drop("groups"), spark.createDataFrame(priors, P), ["k"], members=members).collect()
    assert {(r["k"], r["cluster"]): (r["identity"], r["source"]) for r in found} == sequential(clusters, priors)


def test_edges_are_about_a_block(spark):
    rows = spark.range(9000).selectExpr("cast(id % 2 as int) as k", "-id as turn", "id as cluster").filter("k = 0 or cluster < 100")
    edges = {r["k"]: r["__edge"] for r in identity._edges(rows, ["k"], 2000).collect()}
    assert edges[1] is None and 1600 <= (8998 - edges[0]["cluster"]) // 2 + 1 <= 2400
