"""Embedding near-duplicates by randomised-rotation binary codes.

A vector is turned by fixed random rotations and kept as signs, with a correction factor: the
inner product of the signs with the vector itself.  From the signs of one vector and a four-bit
version of another, bit counts give an unbiased estimate of their inner product, and the factor a
bound on its error.  Pairs whose bound excludes the threshold are dropped; the others are
computed again exactly, in double precision.

Pairs are met in buckets of equal sign groups (bands), as many as the recall needs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._common import arrow_schema, map_arrow, mix64, written
from tidemark.llm.blocks import BLOCK, block_tasks, smallest_linked, task_pairs
from tidemark.llm.graph import components

#: Standard deviations of the estimate's error that the bound allows for.
DEVIATIONS = 5.0

#: Levels of the coarse version of a vector that meets another's signs.
LEVEL_BITS = 4

#: Members that are compared together, whole tasks of them, and pairs that are looked at in one step.
MEMBERS_TOGETHER, PAIRS_TOGETHER = 8192, 1 << 18


def choose_bands(count: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bands and signs a band: signs grow with the logarithm of the count, so that buckets of unrelated vectors stay small."""
    agree = 1 - math.acos(threshold) / math.pi
    signs = min(24, max(8, round(math.log2(max(count, 1) / 6))))
    return math.ceil(math.log(1 - recall) / math.log(1 - agree**signs)), signs


@lru_cache(maxsize=4)
def rotations(dim: int, count: int) -> np.ndarray:
    """(dim, count * dim): random orthogonal matrices side by side, the same wherever they are made."""
    rng = np.random.default_rng([20240531, dim])
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)], axis=1)


def signs_of(unit: np.ndarray, dim: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The turned vectors (unit length) and their signs, at least ``bits`` of them."""
    turned = unit @ rotations(dim, max(1, -(-bits // dim)))
    turned /= math.sqrt(max(1, -(-bits // dim)))
    return turned, turned >= 0


def sign_bands(signs: np.ndarray, bands: int, width: int, dim: int) -> np.ndarray:
    out = np.empty((len(signs), bands), np.uint64)
    weights = np.uint64(1) << np.arange(width, dtype=np.uint64)
    for b in range(bands):
        code = (signs[:, b * width : (b + 1) * width] * weights).sum(axis=1, dtype=np.uint64)
        out[:, b] = mix64(code + np.uint64(b << 32) + np.uint64(dim << 44))
    return out


class Codes:
    """Signs, correction factors and coarse versions of turned vectors, for estimates of inner products."""

    def __init__(self, turned: np.ndarray, signs: np.ndarray) -> None:
        self.dims = turned.shape[1]
        self.factor = np.abs(turned).sum(axis=1) / math.sqrt(self.dims)  # inner product of the signs' unit vector and the vector
        self.spread = np.sqrt(np.maximum(1 - self.factor**2, 0)) / self.factor
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / (2**LEVEL_BITS - 1), 1e-30)
        levels = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        pad = -self.dims % 64

        def packed(bits: np.ndarray) -> np.ndarray:
            return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1).view(np.uint64)

        self.signs, self.ones = packed(signs), signs.sum(axis=1)
        self.planes = [packed((levels >> p) & 1) for p in range(LEVEL_BITS)]
        self.whole = self.dims * self.low + self.step * levels.sum(axis=1)

    def estimates(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Estimated inner products of pairs: signs of i, coarse version of j."""
        inner = np.zeros(len(i), np.int64)
        for p, plane in enumerate(self.planes):
            inner += np.bitwise_count(self.signs[i] & plane[j]).sum(axis=1, dtype=np.int64) << p
        on = self.low[j] * self.ones[i] + self.step[j] * inner  # sum of the coarse values where the sign is positive
        return (2 * on - self.whole[j]) / math.sqrt(self.dims) / self.factor[i]

    def slack(self, i: np.ndarray, threshold: float) -> np.ndarray:
        """How far below the threshold an estimate may be; at the threshold the error shrinks with the sine of the angle."""
        return DEVIATIONS * self.spread[i] / math.sqrt(max(self.dims - 1, 1)) * math.sqrt(1 - threshold**2) + 0.02


def scaled(v: np.ndarray) -> np.ndarray:
    """A finite vector times a power of two, so that its largest component is near one and its square can't overflow."""
    return np.ldexp(v, -np.frexp(np.abs(v).max())[1])


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors as scaled doubles, None for those that link with nothing."""
    out: list[np.ndarray | None] = []
    for x in column:
        raw = x.values
        if raw is None or raw.null_count or not len(raw):
            out.append(None)
            continue
        v = raw.to_numpy(zero_copy_only=False).astype(np.float64)
        out.append(scaled(v) if np.isfinite(v).all() and v.any() else None)
    return out


def vector_signatures(vectors: DataFrame, bands: int, width: int) -> DataFrame:
    """vec_id, vec_key (digest of the scaled components; null for vectors that link with nothing), vector (as bytes), bands."""
    schema = T.StructType.fromDDL("vec_id long, vec_key binary, vector binary, bands array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for batch in batches:
            found = _vectors(batch.column("embedding"))
            keys: list = [None] * len(found)
            codes: list = [None] * len(found)
            for dim in {len(v) for v in found if v is not None}:
                at = [i for i, v in enumerate(found) if v is not None and len(v) == dim]
                unit = np.stack([found[i] for i in at])
                unit = unit / np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
                _, signs = signs_of(unit, dim, bands * width)
                for i, code in zip(at, sign_bands(signs, bands, width, dim).view(np.int64), strict=True):
                    keys[i], codes[i] = hashlib.md5(found[i].tobytes()).digest(), code
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), *[pa.array(x, f.type) for x, f in zip((keys, [None if v is None else v.tobytes() for v in found], codes), list(target)[1:], strict=True)]], schema=target)

    return map_arrow(vectors.select("vec_id", "embedding"), run, schema)


def _linked(x: np.ndarray, bands: np.ndarray, task: np.ndarray, band: np.ndarray, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs among the members of whole tasks, which are in order of task and side."""
    norms = np.sqrt(np.einsum("ij,ij->i", x, x))
    codes = Codes(*signs_of(x / norms[:, None], x.shape[1], x.shape[1]))
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i, j in task_pairs(task, side, PAIRS_TOGETHER):
        earlier = np.arange(bands.shape[1])[None, :] < band[i][:, None]
        near = ~((bands[i] == bands[j]) & earlier).any(axis=1)
        if x.shape[1] >= 16:  # of fewer dimensions the bound says too little
            near &= codes.estimates(i, j) >= threshold - codes.slack(i, threshold)
        i, j = i[near], j[near]
        close = np.einsum("ij,ij->i", x[i], x[j]) / (norms[i] * norms[j]) >= threshold
        found.append((i[close], j[close]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _verify(members: DataFrame, threshold: float) -> DataFrame:
    """vec_key, root_key, links of the members of each task that have links there."""
    schema = T.StructType.fromDDL("vec_key binary, root_key binary, links long")

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        sizes = pc.binary_length(table.column("vector")).to_numpy()
        for size in np.unique(sizes):  # vectors of other lengths are in other tasks
            own = table.filter(pa.array(sizes == size)) if len(np.unique(sizes)) > 1 else table
            x = np.frombuffer(b"".join(own.column("vector").to_pylist()), np.float64).reshape(own.num_rows, -1)
            bands = np.array(own.column("bands").combine_chunks().flatten()).reshape(own.num_rows, -1)
            i, j = _linked(x, bands, *[own.column(c).to_numpy() for c in ("task", "band", "side")], threshold)
            if not len(i):
                continue
            copies = own.column("copies").to_numpy()
            links = np.bincount(i, copies[j], own.num_rows) + np.bincount(j, copies[i], own.num_rows)
            roots, at = smallest_linked(own.num_rows, i, j), np.flatnonzero(links)
            names = own.column("vec_key").combine_chunks()
            yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), names.take(pa.array(roots[at])), pa.array(links[at].astype(np.int64))], schema=arrow_schema(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) < MEMBERS_TOGETHER:
                continue
            table = pa.concat_tables(held)
            tasks = table.column("task").to_numpy()
            whole = int(np.searchsorted(tasks, tasks[-1]))  # the last task may go on
            yield from compare(table.slice(0, whole)) if whole else ()
            held = [table.slice(whole)]
        if held:
            yield from compare(pa.concat_tables(held))

    return map_arrow(members.repartition("task").sortWithinPartitions("task", "side"), run, schema)


def similar_vectors(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.999, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id of every row.

    n_links: other rows at a cosine of ``threshold`` or more, equal vectors included.
    component_id: the smallest vec_id reachable by links, itself included.  Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing; their component is
    themselves.  Finite vectors link whatever their size.  Vectors of different lengths never
    link.  A null vec_id counts as a row; among others it is no component's smallest.  No link is reported below the
    threshold; one at it is found with probability ``recall``, closer ones more surely.
    """
    count = vectors.count()
    bands, width = choose_bands(count, threshold, recall)
    signatures = written(vector_signatures(vectors, bands, width))
    reps = signatures.filter(F.col("vec_key").isNotNull()).groupBy("vec_key").agg(F.min("vec_id").alias("rep_id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"), F.first("bands").alias("bands"))
    reps = written(reps)
    tasks = block_tasks(reps, "vec_key", block)
    found = written(_verify(tasks.join(reps.drop("rep_id"), "vec_key"), threshold))
    roots = components(found.select(F.col("vec_key").alias("a"), F.col("root_key").alias("b")))
    links = found.groupBy("vec_key").agg(F.sum("links").alias("links"))
    named = reps.select("vec_key", "rep_id", "copies").join(roots.withColumnRenamed("node", "vec_key"), "vec_key", "left").join(links, "vec_key", "left")
    named = written(named.select("vec_key", "rep_id", F.coalesce("root", "vec_key").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    smallest = named.groupBy("root").agg(F.min("rep_id").alias("component_id"))
    by_vector = named.join(smallest, "root").select("vec_key", "component_id", "n_links")
    # rows without a key are no group: they join nothing and go past the exchange of keys
    linking = signatures.filter(F.col("vec_key").isNotNull()).select("vec_id", "vec_key").join(by_vector, "vec_key").select("vec_id", "n_links", "component_id")
    alone = signatures.filter(F.col("vec_key").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linking.unionByName(alone)
