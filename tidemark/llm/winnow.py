"""Document fingerprints by winnowing.

Every run of K code points has a rolling hash.  Of every window of W neighbouring hashes the
smallest one is chosen, of equal ones the rightmost, with its position.  Two texts that share a
passage of W + K - 1 code points therefore share a chosen hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._common import arrow_schema, map_arrow, prefix_hash, span_hash

#: Code points of a gram, and grams of a window.
K, W = 16, 32

#: Code points that one numpy step works on.
PART = 1 << 18

#: Buckets of neighbouring ids, at most; each is read in order by one task.
BUCKETS = 1024

FINGERPRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("hashes", T.ArrayType(T.LongType(), False)), T.StructField("positions", T.ArrayType(T.LongType(), False))])
EDITED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])

Marks = tuple[np.ndarray, np.ndarray]  # hashes of 32 bits, positions


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """32 bits of the rolling hash of each run of ``k`` code points."""
    if len(points) < k:
        return np.zeros(0, np.uint64)
    at = np.arange(len(points) - k + 1)
    return span_hash(prefix_hash(points), at, at + k) >> np.uint64(32)


def window_minima(keys: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every ``w`` neighbours, by doubling."""
    out, have = keys, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _chosen(hashes: np.ndarray, w: int, bounds: np.ndarray) -> np.ndarray:
    """Places of the chosen ones among the grams of several texts; ``bounds`` are where each text's grams begin, and the end."""
    n = len(hashes)
    keys = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    sizes = np.diff(bounds)
    least = []
    if n >= w:
        minima = window_minima(keys, w)
        inside = np.ones(len(minima), bool)
        for step in bounds[1:-1]:  # windows that reach over the end of a text
            inside[max(0, step - w + 1) : step] = False
        least.append(minima[inside])
    short = np.flatnonzero((sizes > 0) & (sizes < w))
    if len(short):  # fewer grams than a window: one window
        least += [keys[bounds[j] : bounds[j + 1]].min(keepdims=True) for j in short]
    if not least:
        return np.zeros(0, np.int64)
    return np.unique((np.uint64(0xFFFFFFFF) - (np.concatenate(least) & np.uint64(0xFFFFFFFF))).astype(np.int64))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def winnow_long(text: str, k: int = K, w: int = W, part: int = PART) -> Marks:
    """Chosen hashes and positions of one text, looked at in parts that overlap by a window less one gram."""
    n = len(text) - k + 1
    if n <= 0:
        if not text:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return gram_hashes(_points(text), len(text)), np.zeros(1, np.int64)  # a text shorter than a gram is one gram
    hashes, places = [], []
    lo = 0
    while True:
        hi = min(n, lo + max(part, w) + w - 1)
        own = gram_hashes(_points(text[lo : hi + k - 1]), k)
        at = _chosen(own, w, np.array([0, len(own)]))
        hashes.append(own[at])
        places.append(at + lo)
        if hi == n:
            break
        lo = hi - w + 1
    place, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[first], place


def winnow(texts: Sequence[str], k: int = K, w: int = W, part: int = PART) -> list[Marks]:
    """Chosen hashes and positions of each text; short texts are worked on side by side."""
    out: list[Marks | None] = [None] * len(texts)
    run: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not run:
            return
        points = _points("".join(texts[j] for j in run))
        all_hashes = gram_hashes(points, k)
        begins = np.cumsum([0, *(len(texts[j]) for j in run)])
        grams = np.array([len(texts[j]) - k + 1 for j in run])
        bounds = np.concatenate([[0], np.cumsum(grams)])
        own = np.concatenate([all_hashes[b : b + g] for b, g in zip(begins, grams, strict=False)])
        at = _chosen(own, w, bounds)
        cuts = np.searchsorted(at, bounds)
        for x, j in enumerate(run):
            mine = at[cuts[x] : cuts[x + 1]]
            out[j] = own[mine], mine - bounds[x]
        run.clear()
        size = 0

    for j, text in enumerate(texts):
        if len(text) < k or len(text) > part:
            out[j] = winnow_long(text, k, w, part)
            continue
        if size + len(text) > part:
            flush()
        run.append(j)
        size += len(text)
    flush()
    return [m for m in out if m is not None]


def likeness(a: Marks, b: Marks) -> float:
    """Jaccard similarity of two sets of chosen hashes; two empty ones are alike."""
    x, y = np.unique(a[0]), np.unique(b[0])
    both = len(np.intersect1d(x, y, assume_unique=True))
    every = len(x) + len(y) - both
    return both / every if every else 1.0


def as_string(marks: Marks) -> str:
    """The chosen hashes in order of position, eight hex digits each."""
    return marks[0].astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, hashes and positions (code points, ascending) that winnowing chooses in every text.

    Null text: as empty, and both arrays are empty.  A text shorter than a gram is one gram, one
    with fewer grams than a window is one window.  Repeated rows each have a row.  No exchange.
    """
    schema = arrow_schema(FINGERPRINTS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = winnow([t or "" for t in b.column("text").to_pylist()], k, w)
            sizes = np.cumsum([0, *(len(m[0]) for m in marks)])
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([m[x] for m in marks] or [np.zeros(0)]).astype(np.int64)), type=schema.field(x + 1).type) for x in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *lists], schema=schema)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, FINGERPRINTS)


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows bucket, own, doc_id, text such that each row's next one follows it in the order of its bucket.

    The order is by descending doc_id (null last), then text; after the last row comes the first.
    Buckets are ranges of doc_id, cut at quantiles of that column alone.  The first rows of each
    bucket stand at the end of the one before as well (own false), so that one exchange is enough
    and no task sees more than its bucket.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if buckets is None:
        buckets = min(BUCKETS, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / buckets for i in range(1, buckets)]
    found = rows.agg(F.percentile_approx("doc_id", shares, 100 * buckets).alias("q")).first()["q"] if shares else None
    edges = sorted(set(found or []), reverse=True)
    step = 32

    def reached(of: Column) -> Column:
        return F.size(F.filter(of, lambda e: e >= F.col("doc_id")))

    def longs(values: list[int]) -> Column:
        return F.array(*[F.lit(e) for e in values]).cast("array<bigint>")

    coarse = reached(longs(edges[::step]))  # edges are descending, and a bucket begins at an edge
    fine = F.when(coarse > 0, (coarse - 1) * step + reached(F.slice(longs(edges), (coarse - 1) * step + 1, step))).otherwise(0)
    placed = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), len(edges) + 1).otherwise(fine).cast("int"))
    heads = sorted((r["bucket"], r["top"]) for r in placed.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect())
    if not heads:
        return placed.select("bucket", F.lit(True).alias("own"), "doc_id", "text")
    table = spark.createDataFrame([(b, top, heads[i - 1][0]) for i, (b, top) in enumerate(heads)], "bucket int, top long, before int")  # at most `buckets` rows
    joined = placed.join(F.broadcast(table), "bucket")
    stays = F.struct(F.col("bucket").alias("bucket"), F.lit(True).alias("own"))
    goes = F.struct(F.col("before").alias("bucket"), F.lit(False).alias("own"))
    twice = F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(stays, goes)).otherwise(F.array(stays))
    return joined.select(F.explode(twice).alias("place"), "doc_id", "text").select("place.bucket", "place.own", "doc_id", "text")


def fingerprint_edits(docs: DataFrame, k: int = K, w: int = W, buckets: int | None = None) -> DataFrame:
    """Every document's fingerprint beside that of its edited text and of the next document.

    The edited text has, in place of its last half (rounded down), the first as many code points
    of the next document by descending doc_id.  Likeness is that of the sets of chosen hashes.
    Null text: as empty.  Null doc_id: last in the order.  Equal doc_ids: in order of their texts.
    Repeated rows: each has a row, and one may follow the other.  One document: it is its own next.
    Empty table: no rows.
    """
    schema = arrow_schema(EDITED)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # bucket, doc_id, text, marks of the last own row, which waits for its next
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            texts = columns[3]
            marks = winnow(texts, k, w)
            done = []
            for bucket, own, doc_id, text, mark in zip(*columns, marks, strict=True):
                if held is not None and held[0] == bucket:
                    half = len(held[2]) // 2
                    done.append((held[1], held[2], held[3], held[2][: len(held[2]) - half] + text[:half], mark))
                    held = None
                if own:
                    held = bucket, doc_id, text, mark
            if done:
                changed = winnow([d[3] for d in done], k, w)
                columns = [
                    [d[0] for d in done],
                    [len(d[1]) for d in done],
                    [hashlib.sha256(d[3].encode("utf-8", "surrogatepass")).hexdigest() for d in done],
                    [as_string(d[2]) for d in done],
                    [as_string(m) for m in changed],
                    [likeness(d[2], m) for d, m in zip(done, changed, strict=True)],
                    [likeness(d[2], d[4]) for d in done],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    ordered = with_next(docs, buckets).repartition("bucket").sortWithinPartitions("bucket", F.col("own").desc(), F.col("doc_id").desc_nulls_last(), "text")
    return map_arrow(ordered, work, EDITED)
