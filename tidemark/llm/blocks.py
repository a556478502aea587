"""Comparing the members of hash buckets in blocks of bounded size, without rows for pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import written

#: Members of a bucket that one block holds, about.
BLOCK = 384


def block_tasks(bands: DataFrame, member: str, block: int = BLOCK) -> DataFrame:
    """member, task, band, side: which members meet in which task.

    ``bands`` has a row for each member: ``member`` and ``bands``, an array with a key for each
    band.  Members with an equal key in a band share a bucket.  Buckets with the same members in
    several bands count once, at their first band.  A bucket's members are dealt into chunks by
    hash; each two chunks (sides 0 and 1), and each chunk with itself (side 2), are one task, so
    that no task grows with its bucket.  What a task must still check is that a pair has no equal
    key in an earlier band; then each pair is met exactly once.
    """
    exploded = bands.select(member, F.posexplode("bands").alias("band", "key"))
    buckets = exploded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(member)).alias("marks"))
    buckets = buckets.filter("n > 1").groupBy("n", "marks").agg(F.min(F.struct("band", "key")).alias("first"))
    active = written(buckets.select("first.band", "first.key", "n"))
    met = exploded.join(active, ["band", "key"])
    chunks = F.ceil(F.col("n") / block).cast("int")
    met = met.select(member, "band", "key", chunks.alias("chunks"), F.pmod(F.xxhash64(member, F.lit(7)), chunks).cast("int").alias("own"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return met.select(member, F.xxhash64("band", "key", low, high).alias("task"), "band", F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int")).alias("side"))


def new_pairs(keys: np.ndarray, band: int, side: np.ndarray) -> np.ndarray:
    """Boolean matrix over a task's members: pairs i < j that this task has to compare."""
    n = len(keys)
    out = np.triu(np.ones((n, n), bool), 1) if n and side[0] == 2 else side[:, None] < side[None, :]
    for k in range(band):
        out &= keys[:, k][:, None] != keys[:, k][None, :]
    return out


def link_groups(linked: np.ndarray) -> np.ndarray:
    """For each member the smallest member that it reaches by links (a symmetric boolean matrix)."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1, initial=n))
        if (new == label).all():
            return label
        label = new


def task_pairs(task: np.ndarray, side: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs that tasks compare, about ``most`` at a time; rows are in order of task and side.

    Each row of side 0 meets each of side 1; rows of side 2 meet each other.
    """
    n = len(task)
    if not n:
        return
    starts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
    sizes = np.diff(np.append(starts, n))
    ones = np.add.reduceat((side == 1).astype(np.int64), starts)
    end = np.repeat(starts + sizes, sizes)
    first = np.where(side == 2, np.arange(n) + 1, np.repeat(starts + sizes - ones, sizes))
    number = np.where(side == 1, 0, end - first)
    total = np.cumsum(number)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        i = np.repeat(np.arange(lo, hi), number[lo:hi])
        if len(i):
            before = np.repeat(total[lo:hi] - number[lo:hi], number[lo:hi])
            yield i, first[i] + np.arange(total[hi - 1] - len(i), total[hi - 1]) - before
        lo = hi


def smallest_linked(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n members the smallest one that it reaches by the links (i, j)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new
