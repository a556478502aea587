from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from tests.llm.tables import SMALL, documents, prose
from tidemark.llm import mixing


def brute_targets(sizes: dict, share: float = 1.5, weights=(3, 1, 2)) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    budget, capped = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        level = (budget - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if weight[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= over


def brute(rows: list[tuple]) -> dict[int, int]:
    """Copies of each (doc_id, text, source), doc_ids being distinct."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows}
    of = defaultdict(list)
    for d, t, s in rows:
        of[s].append((int(hashlib.md5(f"{d}:{t or ''}".encode()).hexdigest()[:15], 16), d))
    target = brute_targets({s: sum(size[d] for _, d in own) for s, own in of.items()})
    out = {}
    for s, own in of.items():
        whole = sum(size[d] for _, d in own)
        epochs = int(target[s] // whole) if whole else 0
        rest, taken, open_ = target[s] - epochs * whole, 0, True
        for _, d in sorted(own):
            if size[d] and open_ and not (taken + size[d] <= rest or rest - taken >= size[d] / 2):
                open_ = False
            more = open_ and taken <= rest
            out[d] = epochs + bool(more)
            if more:
                taken += size[d]
                open_ = taken <= rest
    return out


def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    want = brute(rows)
    for r in mixing.mix_plan(docs).collect():
        assert r["taken"] == want[r["doc_id"]] * r["size"]


def test_near_targets_and_rerun(spark):
    texts = [prose(k, 5 + k % 40) for k in range(400)] + [None, "", prose(1, 9000)]
    sources = ["hot" if k % 3 else ["a", None, "b", "Ä"][k % 4] for k in range(403)]
    docs = documents(spark, texts, sources, more="size h skey target copies")
    plan = mixing.mix_plan(docs).collect()
    by = defaultdict(list)
    for r in plan:
        by[r["source"]].append(r)
        assert r["taken"] <= 2 * r["size"]
    want = brute_targets({s: own[0]["source_size"] for s, own in by.items()})
    for s, own in by.items():
        assert abs(own[0]["target"] - want[s]) < 1e-6
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, plan)) == sorted(map(key, mixing.mix_plan(docs.repartition(7)).collect()))


def test_budgets_nest(spark):
    docs = documents(spark, [prose(k, 20) for k in range(200)])
    small, large = ({r["doc_id"] for r in mixing.mix_plan(docs, share=s).collect() if r["copies"]} for s in (0.3, 0.6))
    assert small < large


def test_mix_repeats_rows_and_keeps_wordless_ones(spark):
    docs = documents(spark, [prose(k, 10) for k in range(50)] + [None, " "], more="size __x")
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(docs).collect()} | {50: 1, 51: 1}
    counts = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in copies.items() if v}
    assert mixing.mix(docs.limit(0)).collect() == [] and mixing.mix_plan(docs.limit(0)).collect() == []
