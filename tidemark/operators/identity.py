"""Identities of clusters: each goes on what was there before, greedily, without pairs and without a task a key.

In order, each cluster takes the oldest earlier entity (prior) that shares a group with it and is
free.  A cluster and a prior that are each other's first choice among what is left are a pair of
that result, whatever the others do, so that rounds of mutual first choices give it.  First choices
are minima over shared groups: a cluster's is the least of its groups' oldest priors.  The first
clusters of a key are decided by themselves, whatever comes after them, so that blocks give it too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.session import dropped, stored


def _mutual(clusters: DataFrame, priors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """cluster and prior of the pairs that are each other's first choice.

    Only the earliest cluster and the oldest prior of some group can be one of a pair, so only those choose.
    """
    on = [*keys, "g"]
    oldest = priors.groupBy(*on).agg(F.min(F.struct("created", "prior")).alias("best"))
    earliest = clusters.groupBy(*on).agg(F.min(F.struct("turn", "cluster")).alias("best"))
    first = clusters.join(earliest.select(*keys, F.col("best.cluster").alias("cluster")).distinct(), [*keys, "cluster"], "left_semi")
    wish = first.join(oldest, on).groupBy(*keys, "cluster").agg(F.min("best").alias("best")).select(*keys, "cluster", F.col("best.prior").alias("prior"))
    eldest = priors.join(oldest.select(*keys, F.col("best.prior").alias("prior")).distinct(), [*keys, "prior"], "left_semi")
    asked = eldest.join(earliest, on).groupBy(*keys, "prior").agg(F.min("best").alias("best")).select(*keys, "prior", F.col("best.cluster").alias("cluster"))
    return wish.join(asked, [*keys, "cluster", "prior"])


class _Held:
    """Clusters of a block in order, with the earliest free one of each group.

    Priors come by age, and each takes the earliest free cluster that shares a group: the same
    pairs as when clusters, in order, take the oldest prior, as both sides agree on who is first.
    """

    def __init__(self) -> None:
        self.codes: dict[Any, int] = {}
        self.names: list[Any] = []
        self.at: list[int] = []
        self.groups: list[int] = []
        self.head: np.ndarray | None = None

    def hold(self, name: Any, group: Any) -> None:
        if not self.names or self.names[-1] != name:
            self.names.append(name)
        self.at.append(len(self.names) - 1)
        self.groups.append(self.codes.setdefault(group, len(self.codes)))

    def seal(self) -> None:
        at, groups = np.array(self.at, dtype=np.int32), np.array(self.groups, dtype=np.int32)
        order = np.argsort(groups, kind="stable")
        self.queue = at[order]
        self.start = np.searchsorted(groups[order], np.arange(len(self.codes) + 1))
        self.next = self.start[:-1].copy()
        self.own, self.own_start = groups, np.searchsorted(at, np.arange(len(self.names) + 1))
        self.none = len(self.names)
        self.head = np.append(self.queue[self.start[:-1]], self.none)  # the last one, -1, is of groups that none has
        self.taken = np.zeros(len(self.names), dtype=bool)
        self.left = len(self.names)
        self.at, self.groups = [], []

    def take(self, groups: np.ndarray) -> Any:
        """The earliest free cluster of some groups (by code), which is free no more; or None."""
        if not self.left or not len(groups) or (found := int(self.head[groups].min())) == self.none:
            return None
        self.taken[found], self.left = True, self.left - 1
        for g in self.own[self.own_start[found] : self.own_start[found + 1]].tolist():
            k, end = int(self.next[g]), int(self.start[g + 1])
            while k < end and self.taken[self.queue[k]]:
                k += 1
            self.next[g], self.head[g] = k, self.queue[k] if k < end else self.none
        return self.names[found]


def _block(clusters: DataFrame, priors: DataFrame, keys: Sequence[str], spread: int) -> DataFrame:
    """keys, cluster and prior of what the ``clusters`` of a block take, decided one after the other.

    A task holds a key's clusters, a row a group, and meets its priors by age, one at a time with
    their groups; what it does grows with both, not with their pairs.
    """
    rows = clusters.select(*keys, "turn", "cluster", F.array("g").alias("groups"), F.lit(0).alias("side")).unionByName(priors.select(*keys, "created", "prior", "groups", F.lit(1).alias("side")), allowMissingColumns=True)
    # a number of tasks, as a key is work for one of them however few bytes it has
    tasks = min(int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions")), spread)
    rows = rows.select(*keys, "side", "turn", "cluster", "created", "prior", "groups").repartition(tasks, *keys).sortWithinPartitions(*keys, "side", "turn", "cluster", "created", "prior")
    schema = T.StructType([*[rows.schema[k] for k in keys], rows.schema["cluster"], rows.schema["prior"]])
    names = schema.names

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, waiting, shared, out = None, _Held(), None, [], []

        def decide() -> None:
            found = held.take(np.concatenate(shared))
            if found is not None:
                out.append((*key, found, waiting[1]))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, types[n]) for n, c in zip(names, columns, strict=True)], names)

        types = {}
        for part in parts:
            types = {f.name: f.type for f in part.schema}
            groups = part.column("groups")
            flat = groups.flatten().dictionary_encode()
            values, index = flat.dictionary.to_pylist(), flat.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            ends = np.cumsum(groups.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            owns = zip(*[part.column(k).to_pylist() for k in keys], strict=True)
            begin, codes = 0, None
            for own, side, cluster, created, prior, end in zip(owns, *[part.column(c).to_pylist() for c in ("side", "cluster", "created", "prior")], ends, strict=True):
                if waiting is not None and (own != key or (created, prior) != waiting):
                    decide()
                    waiting = None
                if own != key:
                    key, held, codes = own, _Held(), None
                if not side:
                    held.hold(cluster, values[index[begin]])
                elif held.names:
                    if held.head is None:
                        held.seal()
                    if codes is None:
                        codes = np.array([*(held.codes.get(v, -1) for v in values), -1], dtype=np.int32)  # the last one is of null
                    if waiting is None:
                        waiting, shared = (created, prior), []
                    shared.append(codes[index[begin:end]])
                begin = end
            if out:
                yield flush()
        if waiting is not None:
            decide()
        if out:
            yield flush()

    return rows.mapInArrow(run, schema)


def _edges(rows: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """The keys of ``rows`` with the (turn, cluster) that about ``size`` clusters of the key don't come after; null where it has fewer.

    Found among every so manieth cluster by hash, so that no task sorts a key; which clusters come
    up to an edge is exact, only their number is about ``size``.
    """
    step = max(1, size // 512)
    some = rows.filter(F.pmod(F.xxhash64("cluster"), F.lit(step)) == 0).select(*keys, "turn", "cluster")
    order = Window.partitionBy(*keys).orderBy("turn", "cluster")
    last = some.withColumn("n", F.dense_rank().over(order)).filter(F.col("n") == size // step).select(*keys, F.struct("turn", "cluster").alias("__edge")).distinct()
    return rows.select(*keys).distinct().join(last, list(keys), "left")


#: Blocks have no fewer clusters unless they are asked for.
LEAST_BLOCK = 1000

#: How many times its first size a block may have, as blocks double while rounds don't pay.
LARGEST_BLOCK = 4


def claims(clusters: DataFrame, priors: DataFrame, keys: Sequence[str], block: int = 50_000, least_share: float = 0.05) -> DataFrame:
    """keys, cluster and prior of each cluster that takes one.

    ``clusters``: keys, cluster, turn, g, a row a group; ``priors``: keys, prior, created, groups.
    Both are read several times.

    A block of about the next ``block`` clusters of each key, or twice as many as a key has priors
    if that is less, is decided in order; keys with no more are done.  Of the others only clusters are written again, and only groups, that still have a
    prior.  Where that leaves more than a block, rounds of mutual first choices go on while they
    settle at least ``least_share`` of the clusters, then 1, 2, 4, ... blocks come before the next.
    """
    spark = clusters.sparkSession
    found: list[DataFrame] = []
    settled_: list[DataFrame] = []  # since left and free were written
    left = clusters.dropna(subset=list(keys)).select(*keys, "turn", "cluster", "g").filter("g is not null")
    free = priors.dropna(subset=list(keys)).select(*keys, "created", "prior", "groups")
    written: list[DataFrame] = []
    edges: DataFrame | None = None
    waits, pause, factor = 1, 1, 1
    priors_of_key = free.groupBy(*keys).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    block = min(block, max(LEAST_BLOCK, 2 * priors_of_key))  # no more can take one
    while True:
        behind, still_free = left, free
        if edges is not None:
            behind = behind.join(edges, list(keys)).filter(F.struct("turn", "cluster") > F.col("__edge")).drop("__edge")
        if settled_:
            done = settled_[0]
            for more in settled_[1:]:
                done = done.unionByName(more)
            behind = behind.join(done.select(*keys, "cluster"), [*keys, "cluster"], "left_anti")
            still_free = free.join(done.select(*keys, "prior"), [*keys, "prior"], "left_anti")
        if waits:
            edges = stored(_edges(behind, keys, block * factor), "edges")
            here = behind.join(edges, list(keys)).filter(F.col("__edge").isNull() | (F.struct("turn", "cluster") <= F.col("__edge"))).drop("__edge")
            settled = stored(_block(here, still_free, keys, 3 * edges.count() or 1), "claims")
            waits, factor = waits - 1, min(2 * factor, LARGEST_BLOCK)
            found.append(settled)
            settled_.append(settled)
            if edges.filter("__edge is not null").isEmpty():
                break
            continue
        still_open = still_free.select(*keys, F.explode("groups").alias("g")).distinct()
        left, free = stored(behind.join(still_open, [*keys, "g"], "left_semi"), "clusters"), stored(still_free, "priors")
        for old in written:
            dropped(spark, old)
        written, settled_, edges = [left, free], [], None
        n, most = left.groupBy(*keys).agg(F.count_distinct("cluster").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        if not n:
            break
        if most <= block * factor:
            waits = 1
            continue
        settled = stored(_mutual(left, free.withColumn("g", F.explode("groups")).drop("groups"), keys), "claims")
        found.append(settled)
        settled_.append(settled)
        if settled.count() >= least_share * n:
            pause, factor = 1, 1
        else:
            waits, pause = pause, 2 * pause
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(*keys, "cluster", "prior")


def identities(clusters: DataFrame, priors: DataFrame, keys: Sequence[str], block: int = 50_000, members: DataFrame | None = None) -> DataFrame:
    """keys, cluster, identity and source (prior, default or split) of every cluster.

    ``clusters``: keys, cluster, turn, groups, default_id, split_id; ``priors``: keys, prior,
    created, groups.  ``members``, where clusters have no groups: keys, cluster, turn and groups,
    which a cluster may have in several rows; it is read several times.  A prior that is a cluster's default identity is reserved for the first such
    cluster.  Who takes no prior has its default identity, unless one before it in turn has it;
    then its split identity.  Clusters of a key are settled in order of turn, then cluster.
    """
    if members is None:
        members = stored(clusters.select(*keys, "cluster", "turn", "groups"), "members")
    clusters, priors = stored(clusters.select(*keys, "cluster", "turn", "default_id", "split_id"), "named"), stored(priors.select(*keys, "prior", "created", "groups"), "before")
    ours = clusters.join(priors.select(*keys, F.col("prior").alias("default_id")), [*keys, "default_id"], "left_semi")
    owners = ours.groupBy(*keys, F.col("default_id").alias("prior")).agg(F.min(F.struct("turn", "cluster")).alias("o")).select(*keys, "prior", F.col("o.cluster").alias("owner"))
    owners = stored(owners, "owners")  # of reserved priors, no more rows than priors, and without groups
    own = priors.join(owners, [*keys, "prior"], "left")

    def hub(*parts: Column) -> Column:
        return F.concat_ws("\x1f", *parts)

    hubs = F.transform(F.array_distinct(F.array_compact("groups")), lambda g: hub(F.lit("g"), g.cast("string")))
    open_groups = stored(own.filter("owner is null").select(*keys, "prior", "created", hubs.alias("groups")), "open")
    # a reserved prior meets nobody but its owner, and that only if they share a group
    mine = members.join(owners.withColumnRenamed("owner", "cluster"), [*keys, "cluster"])
    mates = mine.join(priors.select(*keys, "prior", "created", F.col("groups").alias("theirs")), [*keys, "prior"]).filter(F.arrays_overlap("groups", "theirs"))
    reserved = stored(mates.select(*keys, "prior", "created", "cluster", "turn").distinct().withColumn("g", hub(F.lit("r"), F.col("prior").cast("string"))), "reserved")
    rows = members.select(*keys, "cluster", "turn", F.explode("groups").alias("g")).filter("g is not null").withColumn("g", hub(F.lit("g"), F.col("g").cast("string")))
    rows = rows.unionByName(reserved.select(*keys, "cluster", "turn", "g"))
    taken = claims(rows, open_groups.unionByName(reserved.select(*keys, "prior", "created", F.array("g").alias("groups"))), keys, block)
    met = clusters.join(taken, [*keys, "cluster"], "left")
    claimed = taken.select(*keys, F.col("prior").alias("default_id"), F.lit(True).alias("__claimed"))
    rest = met.join(claimed, [*keys, "default_id"], "left")
    in_turn = Window.partitionBy(*keys, "default_id", F.col("prior").isNull()).orderBy("turn", "cluster")
    first = F.row_number().over(in_turn) == 1
    source = F.when(F.col("prior").isNotNull(), "prior").when(first & F.col("__claimed").isNull(), "default").otherwise("split")
    named = rest.withColumn("source", source)
    identity = F.when(F.col("source") == "prior", F.col("prior")).when(F.col("source") == "default", F.col("default_id")).otherwise(F.col("split_id"))
    return named.select(*keys, "cluster", identity.alias("identity"), "source")


def identity_revisions(found: DataFrame, stored_: DataFrame, identity: str, payload: str, revision: str) -> DataFrame:
    """identity, payload, revision and action: new, or revised where the payload is another; unchanged ones make no revision."""
    before = stored_.select(F.col(identity), F.col(payload).alias("__was"), F.col(revision).alias("__n"))
    met = found.join(before, identity, "left")
    changed = met.filter(F.col("__n").isNull() | ~F.col("__was").eqNullSafe(F.col(payload)))
    action = F.when(F.col("__n").isNull(), "new").otherwise("revised")
    return changed.select(*found.columns, (F.coalesce("__n", F.lit(0)) + 1).cast("int").alias(revision), action.alias("action"))
