"""Mixing sources to target weights by hash-threshold histograms.

Each document gets a 60-bit hash of its doc_id and text.  Words are summed by source and hash
bucket; the bucket in which a source's budget runs out is the only one that is split further,
twelve bits at a time, until it holds one hash.  What remains is one threshold for each source,
and the mix is a filter ``hash < threshold``: no sort, no exchange of texts.  Budgets nest: a
smaller budget takes a subset of what a larger one takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm._common import join_small, ordered_rank, written

#: Bits of hash in all, and bits that one level of the histogram resolves.
HASH_BITS, LEVEL_BITS = 60, 12

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    """Runs of characters other than ASCII white space; null and empty texts have none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    """60 bits of the MD5 of doc_id and text, as SQL engines can also compute it."""
    whole = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row a source: skey, source_size, target.

    ``share`` times all words are dealt out by weight (the sources in code-point order, null last,
    take ``weights`` in turn).  A target above ``most`` times its source's size stops there and
    the excess is dealt out again by weight, until no target is above.
    """
    by_source = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    ranked = ordered_rank(by_source, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    table = written(ranked.select("skey", "source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap")))
    budget = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, held = None, -1
    while True:  # each round stops at least one more source at its cap, or ends
        capped = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("cap")
        row = table.agg(F.sum(F.when(capped, F.col("cap"))).alias("cap"), F.sum(F.when(~capped, F.col("weight"))).alias("weight"), F.count_if(capped).alias("n")).first()
        if row["n"] == held or not row["weight"]:
            break
        held, level = row["n"], (budget - (row["cap"] or 0.0)) / row["weight"]
    target = F.least(F.col("cap"), F.col("weight") * F.lit(float(level or 0.0)))
    return table.select("skey", "source", "source_size", target.alias("target"))


def _thresholds(sizes: DataFrame, targets: DataFrame, n_sources: int) -> DataFrame:
    """skey, source_size, target, epochs and the hash below which a document is taken once more."""
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets.select("skey", "source_size", "target", epochs.alias("epochs"))
    state = written(state.select("*", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest")))
    open_ = state.select("skey", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("base"))
    resolved = None
    for level in range(HASH_BITS // LEVEL_BITS):
        above, below = HASH_BITS - LEVEL_BITS * level, HASH_BITS - LEVEL_BITS * (level + 1)
        inside = join_small(sizes, open_, ["skey"], n_sources).filter(F.shiftright("h", above) == F.col("prefix"))
        buckets = inside.groupBy("skey", "rest", "base", F.shiftright("h", below).alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        placed = buckets.withColumn("under", F.col("base") + F.coalesce(F.sum("words").over(before), F.lit(0)))
        boundary = written(placed.filter((F.col("under") <= F.col("rest")) & (F.col("rest") < F.col("under") + F.col("words"))))
        last = below == 0
        single = (F.col("lo") == F.col("hi")) | F.lit(last)
        # the boundary hash goes in when that brings the source nearer to its target
        nearer = F.col("rest") - F.col("under") >= F.col("words") / 2
        found = boundary.filter(single).select("skey", F.when(nearer, F.col("hi") + 1).otherwise(F.col("lo")).alias("threshold"))
        resolved = found if resolved is None else resolved.unionByName(found)
        open_ = boundary.filter(~single).select("skey", "rest", F.col("bucket").alias("prefix"), F.col("under").alias("base"))
        if last or open_.isEmpty():
            break
    return state.join(resolved, "skey", "left").select("skey", "source_size", "target", "epochs", F.coalesce("threshold", F.lit(0)).alias("threshold"))


def _prepare(docs: DataFrame, weights: Sequence[float], share: float, most: float) -> tuple[DataFrame, DataFrame, int]:
    sizes = written(docs.select("doc_id", "source", _source_key().alias("skey"), word_count().alias("size"), document_hash().alias("h")))
    targets = written(source_targets(sizes, weights, share, most))
    n_sources = targets.count()
    return sizes, written(_thresholds(sizes, targets, n_sources)), n_sources


def mix_plan(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, h, source, size, source_size, target, copies and taken (words) of every document.

    A target of ``e`` whole sizes and a rest takes every document ``e`` times and the documents
    whose hash is below the source's threshold once more.  A source's taken words differ from its
    target by at most half of one document (of one group of rows equal in doc_id and text, which
    go in or out together).  Null text: size 0, taken 0.  Null source: a source of its own, last
    in order.  Null doc_id: hashed as empty.  Empty table: no rows.
    """
    sizes, limits, n_sources = _prepare(docs, weights, share, most)
    copies = F.col("epochs") + (F.col("h") < F.col("threshold")).cast("long")
    joined = join_small(sizes, limits, ["skey"], n_sources)
    return joined.select("doc_id", "h", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: the columns of ``docs``; a document taken twice stands there twice.

    Documents without a word weigh nothing in any budget and stay once.
    """
    _, limits, n_sources = _prepare(docs, weights, share, most)
    limits = limits.select(F.col("skey").alias("__skey"), F.col("epochs").alias("__epochs"), F.col("threshold").alias("__threshold"))
    hashed = docs.withColumn("__skey", _source_key()).withColumn("__h", document_hash())
    copies = F.col("__epochs") + (F.col("__h") < F.col("__threshold")).cast("long")
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    times = F.when(wordless, 1).otherwise(copies).cast("int")
    joined = join_small(hashed, limits, ["__skey"], n_sources)
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), times))).select(*[F.col(f"`{c}`") for c in docs.columns])
