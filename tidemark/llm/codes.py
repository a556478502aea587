"""Vector code compression: product codes whose nearest entries are found by VA-file filtering.

A vector of integers is cut into parts, each part is replaced by the number of the nearest entry
of its codebook.  Entry coordinates are quantised to a few bits; the cell that a coordinate falls
into has a least and a largest value.  For a part that asks for its nearest entry, small tables
give the least and the largest possible contribution of each cell; sums over the coordinates bound
the distance of each entry from below and above.  Only entries whose lower bound does not exceed
the smallest upper bound are refined with integer distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._common import arrow_schema, join_small, map_arrow, written

#: Integers a unit, parts of a vector, entries of a codebook, rounds, and bits of a cell.
SCALE, PARTS, ENTRIES, ROUNDS, BITS = 1024.0, 4, 256, 4, 4

#: Vectors that one numpy step works on.
STEP = 1024

SUMS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType(), False))])
CODES = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("entries", T.ArrayType(T.IntegerType(), False)), T.StructField("error", T.LongType())])


def largest_component(dimension: int) -> int:
    """Components beyond this are set to it, so that squared distances of whole vectors fit a long."""
    return isqrt((1 << 62) // max(1, dimension)) // 2


def whole_vectors(column: pa.Array | pa.ChunkedArray, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold a vector of finite components (of ``dimension``, where given), and their integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(pa.float64()))
    n = len(column)
    sizes = np.asarray(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False))
    flat = column.flatten()  # leaves the values of null lists out
    values = np.where(flat.is_null().to_numpy(zero_copy_only=False), np.nan, flat.fill_null(0.0).to_numpy(zero_copy_only=False))
    begins = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
    if dimension is None:
        dimension = next((int(s) for s in sizes if s > 0), 0)
    rows = np.flatnonzero((sizes == dimension) & (dimension > 0)) if n else np.zeros(0, np.int64)
    vectors = values[begins[rows][:, None] + np.arange(dimension)]
    finite = np.isfinite(vectors).all(axis=1)
    limit = float(largest_component(dimension))
    with np.errstate(over="ignore"):
        return rows[finite], np.clip(np.floor(vectors[finite] * SCALE), -limit, limit).astype(np.int64)


def part_bounds(dimension: int, parts: int = PARTS) -> list[int]:
    return [dimension * k // parts for k in range(parts + 1)]


@dataclass
class VaFile:
    """Entries of one codebook with the cells of their coordinates."""

    entries: np.ndarray  # entry x coordinate

    def __post_init__(self) -> None:
        n, d = self.entries.shape
        cells = min(1 << BITS, n)
        order = np.argsort(self.entries, axis=0, kind="stable")
        cell = np.empty((n, d), np.int64)
        np.put_along_axis(cell, order, np.broadcast_to((np.arange(n) * cells // max(n, 1))[:, None], (n, d)), axis=0)
        self.low, self.high = np.empty((d, cells)), np.empty((d, cells))
        for c in range(cells):
            inside = cell == c
            self.low[:, c] = np.where(inside, self.entries, np.iinfo(np.int64).max).min(axis=0)
            self.high[:, c] = np.where(inside, self.entries, np.iinfo(np.int64).min).max(axis=0)
        self.member = np.zeros((d * cells, n), np.float32)  # which cell of each coordinate an entry lies in
        self.member[(np.arange(d) * cells + cell).ravel(), np.repeat(np.arange(n), d)] = 1.0

    def candidates(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query and entry numbers, by query, that bounds can't part."""
        asked = queries[:, :, None].astype(float)
        below, above = self.low - asked, asked - self.high
        nearest, farthest = np.maximum(np.maximum(below, above), 0.0), np.maximum(np.abs(below), np.abs(above))
        lower, upper = ((x * x).astype(np.float32).reshape(len(queries), -1) @ self.member for x in (nearest, farthest))
        # terms are rounded to 24 bits and none is negative: the slack is above the rounding of a sum
        slack = np.float32(1e-7 * (self.entries.shape[1] + 8))
        return np.nonzero(lower * (1 - slack) <= upper.min(axis=1, keepdims=True) * (1 + slack))

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry (the lower one of equals) and its squared distance, as integers."""
        best, error = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        for lo in range(0, len(queries), STEP):
            part = queries[lo : lo + STEP]
            asked, entry = self.candidates(part)
            distance = ((part[asked] - self.entries[entry]) ** 2).sum(axis=1)
            first = np.searchsorted(asked, np.arange(len(part)))
            least = np.minimum.reduceat(distance, first)
            hit = np.flatnonzero(distance == least[asked])
            best[lo : lo + STEP] = entry[hit[np.searchsorted(asked[hit], np.arange(len(part)))]]
            error[lo : lo + STEP] = least
        return best, error


Codebooks = list[np.ndarray]  # of each part: entry x coordinate


def _assign(vectors: np.ndarray, files: list[VaFile], bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    found = [f.nearest(vectors[:, a:b]) for f, a, b in zip(files, bounds, bounds[1:], strict=False)]
    return np.stack([f[0] for f in found], axis=1), np.sum([f[1] for f in found], axis=0)


def first_codebooks(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> Codebooks:
    """The parts of the vectors with the smallest ids.

    The dimension is that of the first of them.  At most ``entries`` rows reach the driver.
    """
    kept = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    ids = kept.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    first = ids.orderBy(*order).limit(1).collect()
    if not first:
        return []
    dimension = len(first[0]["embedding"])
    rows = ids.filter(F.size("embedding") == dimension).orderBy(*order).limit(entries).collect()
    whole = whole_vectors(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64())), dimension)[1]
    bounds = part_bounds(dimension, parts)
    return [whole[:, a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def refined(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part goes to its nearest entry, every entry becomes the floor of the mean of its parts."""
    bounds = np.cumsum([0, *(b.shape[1] for b in books)]).tolist()
    schema = arrow_schema(SUMS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [VaFile(b) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            whole = whole_vectors(batch.column("embedding"), bounds[-1])[1]
            entries = _assign(whole, files, bounds)[0]
            for p, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                counts[p] += np.bincount(entries[:, p], minlength=len(counts[p]))
                np.add.at(sums[p], entries[:, p], whole[:, a:b])
        rows = [(p, e, int(counts[p][e]), sums[p][e].tolist()) for p in range(len(books)) for e in np.flatnonzero(counts[p]).tolist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    wide = max(b.shape[1] for b in books)
    partial = map_arrow(vectors.select("embedding"), work, SUMS)  # one row an entry and task at most
    totals = [F.sum(F.get("sums", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(wide)]
    out = [b.copy() for b in books]
    for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():  # parts x entries rows
        out[r["part"]][r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(books[r["part"]].shape[1])]
    return out


def train_codebooks(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of each part after ``rounds`` of assignment and means over all vectors; none where no vector is whole."""
    books = first_codebooks(vectors, entries, parts)
    for _ in range(rounds if books else 0):
        books = refined(vectors, books)
    return books


def encode_vectors(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, entries (an int a part) and error (squared distance, summed over parts) of every whole vector."""
    bounds = np.cumsum([0, *(b.shape[1] for b in books)]).tolist()
    schema = arrow_schema(CODES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [VaFile(b) for b in books]
        for batch in batches:
            rows, whole = whole_vectors(batch.column("embedding"), bounds[-1])
            if not len(rows):
                continue
            entries, error = _assign(whole, files, bounds)
            kept = batch.take(pa.array(rows))
            offsets = pa.array(np.arange(len(rows) + 1) * len(books), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(entries.ravel().astype(np.int32)), type=schema.field("entries").type)
            yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), lists, pa.array(error)], schema=schema)

    label = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), "embedding")
    return map_arrow(rows if books else rows.limit(0), work, CODES)


def codebooks_sha256(books: Codebooks) -> str:
    """Hash of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress_vectors(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every whole vector.

    Left out: vectors that are null or empty, or hold null or non-finite components, and those
    whose length differs from that of the smallest vec_id (null ids count as largest; equal ids
    are ordered by their vectors).  Components become integers, floor(1024 x); beyond
    ``largest_component`` they are set to it (|x| above 131,072 at 64 dimensions), so that errors
    fit a long.  A length that parts do not divide is cut as evenly as can be.  Fewer vectors than
    entries: smaller codebooks.  Repeated rows each have a row.  label_error: sum over equal
    labels, null ones together; null where it exceeds a long.  Empty table: no rows.

    Each round reads the vectors once; tasks add up their own parts and exchange one row an entry.
    The driver holds the codebooks, ``entries`` rows, and the sums of a round.
    """
    books = train_codebooks(vectors, entries, parts, rounds)
    coded = written(encode_vectors(vectors, books).withColumn("group", F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))))
    by_label = written(coded.groupBy("group").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")))
    hexes = F.transform("entries", lambda e: F.lower(F.lpad(F.hex(e), 2, "0")))
    joined = join_small(coded, by_label, ["group"], by_label.count())
    return joined.select("vec_id", F.array_join(hexes, "").alias("code"), "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
