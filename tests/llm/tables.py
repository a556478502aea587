"""Small tables for the tests of this folder."""

from __future__ import annotations

import random

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None, more=""):
    """Documents 0, 1, ...; ``more``: further columns, whose names clash with those that operators use."""
    rows = [(i, t, "en", sources[i] if sources else "web", None if t is None else len(t)) for i, t in enumerate(texts)]
    names = more.split()
    return spark.createDataFrame([(*r, *[7] * len(names)) for r in rows], DOCS + "".join(f", {n} int" for n in names))


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
