"""N-gram Jaccard join by MinHash banding.

Texts are sets of word five-grams.  Equal texts are one class from the start.  Signatures of
minima are cut into bands, whose number and length follow from the recall wanted at the
threshold; classes that agree in a band meet in a task, where their full five-gram sets, taken
from the whole texts, decide.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._common import arrow_schema, byte_slices, grouped_batches, map_arrow, mix64, prefix_hash, span_hash, units, written
from tidemark.llm.blocks import BLOCK, block_tasks, link_groups, new_pairs
from tidemark.llm.graph import components

WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5  # similarity of 4/5 or more

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def choose_bands(threshold: float, recall: float = 0.999, hashes: int = 160) -> tuple[int, int]:
    """Bands and rows: the longest rows whose bands, enough for ``recall`` at the threshold, need at most ``hashes`` minima."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, hashes):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of a run of texts, and the text of each.

    Words are runs of anything but ASCII white space.  A text of fewer words has one n-gram, all
    of them; a text without words has none.
    """
    starts, ends, owner = units(SPACE[data], offsets)
    value = span_hash(prefix_hash(data), starts, ends)
    factors = [np.uint64(pow(0xD1342543DE82EF95, words - k, 1 << 64)) for k in range(words)]
    n = len(value)
    if n >= words:
        total = np.zeros(n - words + 1, np.uint64)
        for k in range(words):
            total += value[k : n - words + 1 + k] * factors[k]
        whole = owner[: n - words + 1] == owner[words - 1 :]
        out, of = mix64(total[whole]), owner[: n - words + 1][whole]
    else:
        out, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        first = np.searchsorted(owner, short)
        total = counts[short].astype(np.uint64)
        for k in range(words - 1):
            has = counts[short] > k
            total[has] += value[first[has] + k] * factors[k]
        out, of = np.concatenate([out, mix64(total)]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray, owner: np.ndarray, n: int, bands: int, rows: int) -> np.ndarray:
    """A row of band keys for each text; texts without n-grams have zeros."""
    out = np.zeros((n, bands), np.uint64)
    if not len(hashes):
        return out
    cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    present = owner[cuts]
    product = np.empty_like(hashes)
    for b in range(bands):
        key = np.full(len(cuts), np.uint64(b + 1))
        for a in multipliers(bands * rows)[b * rows : (b + 1) * rows]:
            np.multiply(hashes, a, out=product)
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(product, cuts))
        out[present, b] = key
    return out


def text_signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key (MD5 of the text) and bands (null where a text has no word) of every row."""
    schema = T.StructType.fromDDL("doc_id long, text_key binary, bands array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for batch in batches:
            for lo, hi, data, offsets in byte_slices(batch.column("text")):
                raw, n = data.tobytes(), hi - lo
                keys = band_keys(*shingles(data, offsets), n, bands, rows)
                empty = ~keys.any(axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).ravel()), mask=pa.array(empty)).cast(target.field(2).type)
                digests = [hashlib.md5(raw[offsets[k] : offsets[k + 1]]).digest() for k in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), pa.array(digests, pa.binary()), lists], schema=target)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), run, schema)


def _intersections(sets: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the wanted pairs of sorted distinct hashes."""
    n = len(sets)
    out = np.zeros((n, n), np.int64)
    if n <= 12:
        for i, j in zip(*np.nonzero(wanted), strict=True):
            small, large = (i, j) if len(sets[i]) <= len(sets[j]) else (j, i)
            at = np.searchsorted(sets[large], sets[small])
            at[at == len(sets[large])] = 0
            out[i, j] = np.count_nonzero(sets[large][at] == sets[small]) if len(sets[large]) else 0
        return out
    value, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    first = np.concatenate([[True], value[1:] != value[:-1]])
    column = np.cumsum(first) - 1
    shared = np.bincount(column) > 1  # the others are in no intersection
    keep = shared[column]
    owner, column = owner[keep], (np.cumsum(shared) - 1)[column[keep]]
    total = np.zeros((n, n), np.float64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        part = np.zeros((n, 4096), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        total += part @ part.T
    return np.rint(total).astype(np.int64)


def _verify(members: DataFrame) -> DataFrame:
    """text_key, root_key, links of the members of each task that have links there."""
    schema = T.StructType.fromDDL("text_key binary, root_key binary, links long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        keys_out: list[bytes] = []
        roots_out: list[bytes] = []
        links_out: list[int] = []
        for table in grouped_batches(batches, "task"):
            names = table.column("text_key").to_pylist()
            at = list({k: i for i, k in enumerate(names)}.values())  # a repeated row counts once
            if len(at) < 2:
                continue
            table, names = table.take(at), [names[i] for i in at]
            n = len(names)
            bands = np.array(table.column("bands").to_pylist(), np.int64)
            wanted = new_pairs(bands, table.column("band")[0].as_py(), table.column("side").to_numpy())
            if not wanted.any():
                continue
            sets: list[np.ndarray] = []
            for lo, hi, data, offsets in byte_slices(table.column("text")):
                hashes, owner = shingles(data, offsets)
                cuts = np.searchsorted(owner, np.arange(hi - lo + 1))
                sets += [np.unique(hashes[cuts[k] : cuts[k + 1]]) for k in range(hi - lo)]
            sizes = np.array([len(s) for s in sets])
            both = sizes[:, None] + sizes[None, :]
            # sets of very different sizes can't reach the threshold
            wanted &= DENOMINATOR * np.minimum(sizes[:, None], sizes[None, :]) >= NUMERATOR * np.maximum(sizes[:, None], sizes[None, :])
            common = _intersections(sets, wanted)
            linked = wanted & (DENOMINATOR * common >= NUMERATOR * (both - common)) & (common > 0)
            if not linked.any():
                continue
            linked |= linked.T
            roots = link_groups(linked)
            links = linked @ table.column("copies").to_numpy().astype(np.int64)
            for i in np.flatnonzero(linked.any(axis=1)):
                keys_out.append(names[i])
                roots_out.append(names[roots[i]])
                links_out.append(int(links[i]))
            if len(keys_out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(keys_out, pa.binary()), pa.array(roots_out, pa.binary()), pa.array(links_out, pa.int64())], schema=target)
                keys_out, roots_out, links_out = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(keys_out, pa.binary()), pa.array(roots_out, pa.binary()), pa.array(links_out, pa.int64())], schema=target)

    spread = members.repartition("task").sortWithinPartitions("task")
    return map_arrow(spread, run, schema)


def similar_documents(docs: DataFrame, recall: float = 0.999, block: int = BLOCK) -> DataFrame:
    """doc_id, text_key, copy_of, class_id, n_links of every row.

    Two texts are linked when the Jaccard similarity of their sets of word five-grams is 0.8 or
    more; equal texts always are.  copy_of: the smallest doc_id with an equal text.  class_id: the
    smallest doc_id reachable by links.  n_links: rows linked directly with this one, copies
    included.  Texts without words (null, empty, white space) are linked with equal texts only.
    Null doc_ids count as rows; they never are the smallest unless a class has no other.
    Similarity is exact; a link at similarity 0.8 is found with probability ``recall``, one at
    0.9 all but surely.
    """
    bands, rows = choose_bands(NUMERATOR / DENOMINATOR, recall)
    signatures = written(text_signatures(docs, bands, rows))
    reps = written(signatures.groupBy("text_key").agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")))
    tasks = written(block_tasks(reps.filter(F.col("bands").isNotNull()), "text_key", block))
    active = reps.join(tasks.select("text_key").distinct(), "text_key").select("text_key", "rep_id", "copies", "bands")
    # copies of one text have different doc_ids, so that joining on both keys spreads them
    texts = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("own_key"), "text")
    with_text = written(active.join(texts, (F.col("text_key") == F.col("own_key")) & F.col("rep_id").eqNullSafe(F.col("own_id"))).select("text_key", "copies", "bands", "text"))
    found = written(_verify(tasks.join(with_text, "text_key")))
    roots = components(found.select(F.col("text_key").alias("a"), F.col("root_key").alias("b")))
    links = found.groupBy("text_key").agg(F.sum("links").alias("links"))
    named = reps.select("text_key", "rep_id", "copies").join(roots.withColumnRenamed("node", "text_key"), "text_key", "left").join(links, "text_key", "left")
    named = named.select("text_key", "rep_id", F.coalesce("root", "text_key").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = written(named)
    smallest = named.groupBy("root").agg(F.min("rep_id").alias("class_id"), F.min(F.struct(F.col("rep_id").isNull(), "rep_id", "text_key"))["text_key"].alias("kept_key"))
    by_text = named.join(smallest, "root").select("text_key", F.col("rep_id").alias("copy_of"), "class_id", "kept_key", "n_links")
    return signatures.select("doc_id", "text_key").join(by_text, "text_key").select("doc_id", "text_key", "copy_of", "class_id", "n_links", "kept_key")


def keep_one(docs: DataFrame, recall: float = 0.999) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id, in all its columns.

    Rows that repeat it go as well.
    """
    classes = similar_documents(docs, recall)
    chosen = classes.filter((F.col("text_key") == F.col("kept_key")) & F.col("doc_id").eqNullSafe(F.col("class_id")))
    chosen = chosen.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__chosen")).distinct()
    keyed = docs.withColumn("__key", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    joined = keyed.join(chosen, (F.col("__key") == F.col("__chosen")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")))
    return joined.dropDuplicates(["__key", "__id"]).select(*[F.col(f"`{c}`") for c in docs.columns])
