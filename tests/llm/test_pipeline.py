"""The pipeline against its stages done by brute force."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm import test_jaccard, test_mixing, test_packing
from tests.llm.tables import SMALL, by_id, documents
from tidemark.llm import quality


def covered(items: dict[int, list], size: int) -> dict[int, list[tuple[int, int]]]:
    """The runs of items that sequences of ``size`` cover which start in more than one place."""
    seen = Counter(tuple(x[k : k + size]) for x in items.values() for k in range(len(x) - size + 1))
    out: dict[int, list[tuple[int, int]]] = {}
    for d, x in items.items():
        runs: list[tuple[int, int]] = []
        for k in range(len(x) - size + 1):
            if seen[tuple(x[k : k + size])] > 1:
                if runs and k <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], k + size)
                else:
                    runs.append((k, k + size))
        out[d] = runs
    return out


def cut(texts: dict[int, str | None], length: int = 400, words: int = 50) -> dict[int, str | None]:
    raw = {k: (t or "").encode() for k, t in texts.items()}
    spans = {d: [m.span() for m in re.finditer(rb"[^\t-\r ]+", t)] for d, t in raw.items()}
    of_words = covered({d: [raw[d][a:b] for a, b in s] for d, s in spans.items()}, words)
    out = {}
    for d, at in covered({d: list(t) for d, t in raw.items()}, length).items():
        at += [(spans[d][a][0], spans[d][b - 1][1]) for a, b in of_words[d] if b - a > words]
        gone = bytearray(len(raw[d]))
        for a, b in at:
            gone[a:b] = b"\1" * (b - a)
        out[d] = bytes(c for c, g in zip(raw[d], gone, strict=True) if not g).decode("utf-8", "ignore") if at else texts[d]
    return out


def test_equals_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    good = {r["doc_id"] for r in quality.score_quality(docs, quality.train_quality(docs, labels)).collect() if r["predicted"]}
    ids = sorted(good)
    classes = test_jaccard.brute([rows[d]["text"] for d in ids])
    kept = [d for k, d in enumerate(ids) if classes[k][0] == k]
    texts = cut({d: rows[d]["text"] for d in kept})
    copies = test_mixing.brute([(d, texts[d], rows[d]["source"]) for d in kept])
    copies |= {d: 1 for d in kept if not (texts[d] or "").strip(" \t\n\v\f\r")}
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    first = Counter(r["doc_id"] for r in pieces if r["piece"] == 0)
    assert first == Counter({d: n for d, n in copies.items() if n})
    once = defaultdict(list)
    places = defaultdict(list)
    for r in pieces:
        once[r["doc_id"], r["piece"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(len(v) == first[d] for (d, _), v in once.items())
    for own in places.values():
        assert sum(n for _, n in own) <= 2048 and len({o for o, _ in own}) == len(own)
    test_packing.check([{**v[0].asDict(), "sequence_id": k, "offset": 0} for k, v in enumerate(once.values())], {d: texts[d] for d in first})


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns


def test_stages_take_odd_tables(spark):
    """Nulls in any column, repeated rows, clashing names and no rows at all."""
    rows = [(None, None, None, None, None, 1), (1, "a b c", "en", "s", 5, 2), (1, "a b c", "en", "s", 5, 2), (2, "", None, "s", 0, None), (3, "x" * 5000, "en", None, 5000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int").selectExpr("*", "1 as score", "2 as key", "3 as copies", "4 as spans", "5 as text_key", "6 as band", "7 as shard")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.count() <= 2 * len(rows)
        assert stage(spark, docs.limit(0), SMALL).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() >= 5


def test_passages_of_more_than_50_words_go(spark):
    """51 words go although they are shorter than 400 bytes; 50 words stay, and so does text that stands once."""
    rng = random.Random(5)
    word = iter(["".join(p) for p in rng.sample(list(itertools.product("abcdefghij", repeat=4)), 2000)])
    long, short, tiny = (" ".join(next(word)[:n] + tail for _ in range(k)) for n, k, tail in ((4, 51, "é"), (4, 50, ""), (4, 60, "")))
    own = [" ".join(next(word) for _ in range(30)) for _ in range(8)]
    texts = [f"{own[0]} {long} {own[1]}", f"{own[2]}\n{long.replace(' ', chr(10))}\t{own[3]}", f"{own[4]} {short} {own[5]}", f"{own[6]} {short} {own[7]}", tiny, None, ""]
    assert len(long.encode()) < 400
    got = by_id(corpus_pipeline.without_repeats(spark, documents(spark, texts), SMALL))
    assert [got[d]["text"] for d in range(2, 7)] == texts[2:]
    assert got[0]["text"] == f"{own[0]}  {own[1]}" and got[1]["text"] == f"{own[2]}\n\t{own[3]}"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values() if r["text"])
