from __future__ import annotations

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.tables import SMALL, by_id, documents
from tests.llm.test_pipeline import cut
from tidemark.llm import suffix


def brute(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[k : k + length] for t in raw for k in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t) + 1)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(t)) if gone[k] and (not k or not gone[k - 1]))
        kept = bytes(c for c, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found(df) -> list[tuple[int, int, int, str]]:
    rows = by_id(df)
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for _, r in sorted(rows.items())]


def mixture(seed: int, n: int) -> list[str | None]:
    """Texts that share passages, in whole and in part, with edges of every kind."""
    rng = random.Random(seed)
    letters = "abcdé \n"
    passages = ["".join(rng.choice(letters) for _ in range(rng.randrange(30, 160))) for _ in range(6)]
    out: list[str | None] = [None, "", "a", "a" * 300, passages[0], passages[0]]
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p) // 2)
            parts += ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))), p[a : rng.randrange(a, len(p) + 1)]]
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("limit", [2, 256])
@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, limit):
    texts = mixture(seed, 60)
    got = suffix.repeat_report(documents(spark, texts, more="key context keys copies base"), 40, 16, limit)
    assert found(got) == brute(texts, 40)


def test_hot_passage_between_distinct_neighbours(spark):
    """One passage in hundreds of documents whose own text touches it: many contexts of one sample."""
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh") for _ in range(500))
    texts = ["".join(rng.choice("ijklmnop") for _ in range(300)) + passage + "".join(rng.choice("qrstuv") for _ in range(300)) for _ in range(330)]
    assert found(suffix.repeat_report(documents(spark, texts))) == brute(texts, 400)


def test_real_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    assert found(suffix.repeat_report(docs)) == brute(texts, 400)
    got = suffix.repeat_report(docs, words=50)
    assert found(got) == brute(texts, 400)
    assert {d: r["text"] for d, r in by_id(got).items()} == cut(dict(enumerate(texts)))


def test_text_of_many_parts(spark, monkeypatch):
    """A text that is looked at in parts gives the samples of a whole one."""
    rng = np.random.default_rng(9)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    whole = suffix.Samples(data, np.array([0, 5000]), 400, 256)
    monkeypatch.setattr(suffix, "PART_BYTES", 300)
    parts = suffix.Samples(data, np.array([0, 5000]), 400, 256)
    for name in ("place", "reach", "key", "owner"):
        assert (getattr(whole, name) == getattr(parts, name)).all()


def peak_of(function) -> tuple[object, int]:
    tracemalloc.start()
    try:
        return function(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_sampling_needs_no_fresh_arrays():
    """A run of texts is sampled in the arrays of the run before, beside the hashes of its prefixes."""
    data = np.random.default_rng(4).integers(97, 123, suffix.RUN_BYTES).astype(np.uint8)
    offsets = np.arange(0, len(data) + 1, len(data) // 64)
    once = suffix.Samples(data, offsets, 400, 256)
    again, peak = peak_of(lambda: suffix.Samples(data, offsets, 400, 256))
    assert len(once.place) and (once.place == again.place).all() and (once.key == again.key).all()
    assert peak < 24 * len(data)


def test_marks_are_laid_down_as_runs(spark, monkeypatch):
    """Marks become removed runs without a number for each string that starts somewhere."""
    rng = random.Random(6)
    monkeypatch.setattr(suffix, "map_arrow", lambda _, run, __: run)
    rows = []
    for n_places, full in [(10_000, True), (2, False), (3, False)]:
        parts = [{"base": base, "marks": np.packbits([full or k == 63 or rng.random() < 0.1 for k in range(64)]).tobytes()} for base in (0, 64, 128)]
        rows.append([{"places": [256 + rng.randrange(90_000) for _ in range(n_places)], "parts": parts[k:]} for k in range(2)])
    kind = pa.list_(pa.struct([("places", pa.list_(pa.int64())), ("parts", pa.list_(pa.struct([("base", pa.int32()), ("marks", pa.binary())])))]))
    batch = pa.RecordBatch.from_arrays([pa.array([b"a", b"a", b"b"]), pa.array([False, True, False]), pa.array(rows, kind)], ["text_key", "in_words", "found"])
    for own in (batch, batch.slice(1)):
        out, peak = peak_of(lambda own=own: list(suffix._marked_runs(None, 400)([own]))[0].to_pylist())
        assert peak < 30 << 20
        for got, contexts in zip(out, own.column("found").to_pylist(), strict=True):
            gone = np.zeros(100_000, np.int8)
            for c in contexts:
                for place in c["places"]:
                    for x in c["parts"]:
                        for k in np.flatnonzero(np.unpackbits(np.frombuffer(x["marks"], np.uint8))):
                            gone[place - x["base"] - k : place - x["base"] - k + 400] = 1
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
            assert (got["spans"], got["n_removed"], got["n_spans"]) == (edges.tolist(), int(gone.sum()), len(edges) // 2)


def test_null_ids_count_as_rows(spark):
    text = "".join(map(chr, range(200, 500)))
    docs = spark.createDataFrame([(None, text), (None, text), (1, "x"), (None, None)], "doc_id long, text string")
    got = suffix.repeat_report(docs, words=50).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in got) == [(0, 0, 0), (0, 600, 600), (0, 600, 600), (1, 1, 0)]


def test_repeated_row_repeats_itself_and_empty_table(spark):
    docs = documents(spark, ["x" * 10 + "".join(map(chr, range(200, 500)))])
    assert {r["n_removed"] for r in suffix.repeat_report(docs.union(docs)).collect()} == {610}
    assert suffix.repeat_report(docs.limit(0)).collect() == []
    assert suffix.cut_repeats(docs.limit(0)).collect() == []


def test_cut_keeps_columns_and_whole_characters(spark):
    shared = "é" * 250
    docs = documents(spark, ["head " + shared + " tail", "other " + shared, None, "alone"], more="key kept")
    got = by_id(suffix.cut_repeats(docs))
    assert suffix.cut_repeats(docs).columns == docs.columns
    assert got[2]["text"] is None and got[3]["text"] == "alone" and got[3]["n_chars"] == 5
    assert got[0]["text"] == "head  tail" or got[0]["text"].startswith("head")
    assert "é" * 200 not in got[0]["text"] + got[1]["text"] and got[0]["n_chars"] == len(got[0]["text"])
