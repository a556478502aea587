from __future__ import annotations

import re

from tests.llm.tables import SMALL, by_id, documents, prose
from tidemark.llm import jaccard


def grams(text: str | None) -> set[tuple[str, ...]]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(texts: list[str | None]) -> list[tuple[int, int]]:
    """Class and number of links of each document."""
    sets, n = [grams(t) for t in texts], len(texts)
    links = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or (sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                links[i].append(j)
                links[j].append(i)
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i], *[label[j] for j in links[i]]]) for i in range(n)]
        if new == label:
            break
        label = new
    return [(label[i], len(links[i])) for i in range(n)]


def found(df) -> list[tuple[int, int]]:
    return [(r["class_id"], r["n_links"]) for _, r in sorted(by_id(df).items())]


def test_real_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    assert found(jaccard.similar_documents(docs)) == brute(texts)


def test_edges_ties_and_blocks(spark):
    base = prose(1, 200).split()
    texts: list[str | None] = [None, "", " \n", " \n", "one two", "one  two", "one two three four five", prose(9, 30_000)]
    texts += [" ".join([*base[:k], "new", *base[k + 1 :]]) for k in range(0, 200, 4)] + [" ".join(base)] * 3
    docs = documents(spark, texts, more="text_key bands copies task")
    for block in (5, 384):
        assert found(jaccard.similar_documents(docs, block=block)) == brute(texts)


def test_keep_one(spark):
    base = prose(2, 100)
    docs = documents(spark, [base, base, base + " end", prose(3, 50), None, ""], more="key links")
    got = jaccard.keep_one(docs.union(docs))
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 3, 4]
    assert jaccard.keep_one(docs.limit(0)).collect() == []


def test_bands_reach_the_recall():
    bands, rows = jaccard.choose_bands(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 160
