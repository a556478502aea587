from __future__ import annotations

import itertools
import random
import zlib
from collections import defaultdict

import pytest

from tests.llm.tables import SMALL, documents, prose
from tidemark.llm import sharding


def test_flow_is_cheapest():
    rng = random.Random(1)
    for _ in range(20):
        supplies, capacities = [rng.randrange(4) for _ in range(3)], [rng.randrange(5) for _ in range(3)]
        cost = [[rng.randrange(4) for _ in range(3)] for _ in range(3)]
        flow = sharding.min_cost_flow(supplies, capacities, cost)
        units = [i for i, s in enumerate(supplies) for _ in range(s)]
        most, best = -1, 0
        for to in itertools.product([0, 1, 2, None], repeat=len(units)):
            if any(to.count(j) > capacities[j] for j in range(3)):
                continue
            sent, price = sum(j is not None for j in to), sum(cost[i][j] for i, j in zip(units, to, strict=True) if j is not None)
            if (sent, -price) > (most, -best):
                most, best = sent, price
        assert sum(map(sum, flow)) == most
        assert sum(f * c for a, b in zip(flow, cost, strict=True) for f, c in zip(a, b, strict=True)) == best


def test_least_bytes_move():
    """What leaves a shard is what it holds above its capacity, up to a block a shard, as blocks are not divided."""
    rng = random.Random(7)
    for old, new in ((3, 5), (6, 4), (12, 16)):
        sizes = {(i, b): rng.randrange(1, 400) for i in range(old) for b in range(64) if rng.random() < 0.9}
        capacities = sharding.even_capacities(sum(sizes.values()), new)
        plan = sharding.plan_blocks(sizes, old, capacities)
        held = [sum(n for (i, _), n in sizes.items() if i == j) for j in range(old)]
        must = sum(max(0, n - (capacities[j] if j < new else 0)) for j, n in enumerate(held))
        moved = sum(n for key, n in sizes.items() if plan[key] != key[0])
        assert plan.keys() == sizes.keys() and abs(moved - must) <= max(old, new) * max(sizes.values())


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a", None), (None, "a", None), (1, None, "s")], "doc_id long, text string, source string")
    rows = sharding.reshard_documents(docs).collect()
    assert len(rows) == 3 and all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows))) for s in range(16))


def check(rows, texts, shards=16):
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw)) and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_real_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = sharding.reshard_documents(docs).collect()
    sizes = check(rows, texts)
    even = sum(sizes.values()) / 16
    assert len(rows) == len(texts) and max(sizes.values()) <= even + max(r["size"] for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sharding.reshard_documents(docs.repartition(5)).collect()))


def test_edges(spark):
    texts = [None, "", "é", "same", "same", prose(1, 50_000)] + [prose(k, 30) for k in range(60)]
    docs = documents(spark, texts, ["hot" if k % 3 else None for k in range(66)], more="size shard slot block old_shard")
    check(sharding.reshard_documents(docs).collect(), dict(enumerate(texts)))
    assert len(sharding.reshard_documents(docs.union(docs)).collect()) == 132
    assert sharding.reshard_documents(docs.limit(0)).collect() == []


def test_only_touched_shards_are_written(spark, tmp_path):
    docs = documents(spark, [prose(k, 20) for k in range(80)], [f"s{k % 9}" for k in range(80)])
    plan = {r["doc_id"]: r["shard"] for r in sharding.reshard_documents(docs).collect()}
    touched = sharding.rewrite_shards(docs, str(tmp_path / "out"))
    got = {r["doc_id"]: r["shard"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {d: s for d, s in plan.items() if s in touched}


@pytest.mark.parametrize("old", [3, 4])
def test_rewrite_keeps_untouched_shards_of_an_old_layout(spark, tmp_path, old):
    """Old shard 0 gains, 1 stays, 2 loses; 3, where there is one, goes."""
    names = [next(f"s{k}" for k in range(99) if zlib.crc32(f"s{k}".encode()) % old == j) for j in range(old)]
    sources = [n for n, k in zip(names, (20, 40, 60) if old == 3 else (20, 40, 40, 20), strict=True) for _ in range(k)]
    docs = documents(spark, [f"text {k:04d}" for k in range(120)], sources)
    path = str(tmp_path / "layout")
    docs.withColumn("shard", sharding.source_layout(docs["source"], old)).write.partitionBy("shard").parquet(path)
    before = {j: sorted(p.name for p in (tmp_path / "layout" / f"shard={j}").glob("*.parquet")) for j in range(3)}
    touched = sharding.rewrite_shards(spark.read.parquet(path).drop("shard"), path, old, 3)
    assert 0 in touched and 1 not in touched
    assert sorted(p.name for p in (tmp_path / "layout" / "shard=1").glob("*.parquet")) == before[1]
    want = {r["doc_id"]: r["shard"] for r in sharding.reshard_documents(docs, old, 3).collect()}
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 120 and {r["doc_id"]: r["shard"] for r in rows} == want
    assert not (tmp_path / "layout" / "shard=3").exists()
