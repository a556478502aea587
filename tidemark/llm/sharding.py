"""Minimum-cost-flow resharding.

The sizes of the old shards and the capacities of the new ones make a transport network in which
bytes that stay where they are cost nothing and moved bytes cost one each.  Its minimum-cost flow
says how many bytes go from where to where; blocks (hash buckets of an old shard) realise it.
Shards and blocks are as many as the parameters say, whatever the data, so the network is solved
on the driver; the rows never go there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import gapless_rank, salt_of, written

#: Rows of a shard that a window numbers together, about.
RANKED_TOGETHER = 100_000

#: Blocks that an old shard is divided into.
BLOCKS = 256


def min_cost_flow(supplies: Sequence[int], capacities: Sequence[int], cost: Sequence[Sequence[int]]) -> list[list[int]]:
    """Flow from each supply to each capacity at the least cost: successive shortest augmenting paths."""
    n, m = len(supplies), len(capacities)
    source, sink = n + m, n + m + 1
    edges: list[list[int]] = []  # to, room, cost
    at: list[list[int]] = [[] for _ in range(n + m + 2)]

    def add(a: int, b: int, room: int, price: int) -> None:
        at[a].append(len(edges))
        edges.append([b, room, price])
        at[b].append(len(edges))
        edges.append([a, 0, -price])

    for i, s in enumerate(supplies):
        add(source, i, s, 0)
    for j, c in enumerate(capacities):
        add(n + j, sink, c, 0)
    first = len(edges)
    for i in range(n):
        for j in range(m):
            add(i, n + j, min(supplies[i], capacities[j]), cost[i][j])
    while True:
        far: list[float] = [float("inf")] * len(at)
        by: list[int] = [-1] * len(at)
        far[source], queue, queued = 0, [source], {source}
        while queue:
            a = queue.pop(0)
            queued.discard(a)
            for e in at[a]:
                b, room, price = edges[e]
                if room and far[a] + price < far[b]:
                    far[b], by[b] = far[a] + price, e
                    if b not in queued:
                        queued.add(b)
                        queue.append(b)
        if by[sink] < 0:
            break
        path, b = [], sink
        while b != source:
            path.append(by[b])
            b = edges[by[b] ^ 1][0]
        most = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= most
            edges[e ^ 1][1] += most
    return [[edges[(first + 2 * (i * m + j)) ^ 1][1] for j in range(m)] for i in range(n)]


def even_capacities(total: int, shards: int) -> list[int]:
    return [total * (j + 1) // shards - total * j // shards for j in range(shards)]


def plan_blocks(blocks: dict[tuple[int, int], int], old: int, capacities: Sequence[int]) -> dict[tuple[int, int], int]:
    """New shard of every block (old shard, bucket), given the bytes of each.

    Blocks, largest first, follow the minimum-cost flow of their old shard; then single blocks
    move from the fullest shard to the emptiest as long as that evens them out.
    """
    supplies = [0] * old
    for (i, _), size in blocks.items():
        supplies[i] += size
    flow = min_cost_flow(supplies, capacities, [[int(i != j) for j in range(len(capacities))] for i in range(old)])
    over = [-c for c in capacities]  # bytes beyond capacity
    placed: dict[tuple[int, int], int] = {}
    for key, size in sorted(blocks.items(), key=lambda x: (-x[1], x[0])):
        room = flow[key[0]]
        j = max(range(len(room)), key=lambda k: (room[k], k == key[0], -over[k], -k))
        room[j] -= size
        over[j] += size
        placed[key] = j
    members: list[set[tuple[int, int]]] = [set() for _ in capacities]
    for key, j in placed.items():
        members[j].add(key)
    for _ in range(4 * len(blocks)):
        high, low = max(range(len(over)), key=lambda k: (over[k], -k)), min(range(len(over)), key=lambda k: (over[k], k))
        gap = over[high] - over[low]
        fits = [k for k in members[high] if 0 < blocks[k] < gap]
        if not fits:
            break
        key = min(fits, key=lambda k: (abs(2 * blocks[k] - gap), k[0] == high, k))
        members[high].remove(key)
        members[low].add(key)
        placed[key], over[high], over[low] = low, over[high] - blocks[key], over[low] + blocks[key]
    return placed


def reshard(rows: DataFrame, old: int, new: int, order: Sequence[str], capacities: Sequence[int] | None = None, blocks: int = BLOCKS) -> DataFrame:
    """``rows`` (with columns old_shard and size) with shard, slot (0, 1, ... in each shard) and moved.

    The capacities are near equal unless given.  Only ``old * blocks`` sums go to the driver.
    Rows that agree in the ``order`` columns are interchangeable.
    """
    rows = written(rows.withColumn("block", salt_of(*[F.col(c) for c in order], salts=blocks)))
    sums = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    sizes = {(r["old_shard"], r["block"]): r["size"] for r in sums}
    plan = plan_blocks(sizes, old, capacities or even_capacities(sum(sizes.values()), new))
    spark = rows.sparkSession
    lookup = spark.createDataFrame([(i, b, j) for (i, b), j in sorted(plan.items())], "old_shard int, block int, shard int")
    placed = rows.join(F.broadcast(lookup), ["old_shard", "block"])  # at most old * blocks rows
    salts = max(blocks, sum(r["n"] for r in sums) // max(1, new) // RANKED_TOGETHER)
    ranked = gapless_rank(placed, ["shard"], list(order), "slot", salts=salts)
    return ranked.withColumn("moved", F.col("old_shard") != F.col("shard"))


def source_layout(source: Column, shards: int) -> Column:
    """The old layout that a corpus often has: files by source."""
    return F.pmod(F.crc32(F.coalesce(source, F.lit("")).cast("binary")), F.lit(shards)).cast("int")


def reshard_documents(docs: DataFrame, old: int = 12, new: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot, moved: documents laid out by source, dealt into even shards.

    Size is UTF-8 bytes of the text (null: none) plus 1.  Null doc_id or source: as any value.
    Repeated rows take slots of their own.  Empty table: no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), source_layout(F.col("source"), old).alias("old_shard"))
    return reshard(rows, old, new, ["doc_id", "text_crc32", "size"])


def rewrite_shards(docs: DataFrame, path: str, old: int = 12, new: int = 16) -> list[int]:
    """Write the new shards that gain or lose rows, as ``path/shard=N``; the numbers of those.

    A shard that keeps exactly its old rows is left as it is.  Where ``path`` holds the old layout,
    only the folders of the other shards are replaced; those of shards that end empty, or that the
    new layout has not, are removed.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.withColumns({"__size": (F.octet_length(text) + 1).cast("long"), "__crc": F.crc32(text), "__old": source_layout(F.col("source"), old)})
    rows = keyed.select(F.col("doc_id"), F.col("__crc").alias("text_crc32"), F.col("__size").alias("size"), F.col("__old").alias("old_shard"))
    plan = reshard(rows, old, new, ["doc_id", "text_crc32", "size"]).select("old_shard", "block", "shard").distinct()
    moves = [(r["old_shard"], r["block"], r["shard"]) for r in plan.collect()]  # at most old * blocks rows
    touched = sorted({j for i, _, j in moves if i != j} | {i for i, _, j in moves if i != j and i < new})
    block = salt_of(F.col("doc_id"), F.col("__crc"), F.col("__size"), salts=BLOCKS)
    lookup = docs.sparkSession.createDataFrame(moves, "__old int, __block int, shard int").filter(F.col("shard").isin(touched or [-1]))
    out = keyed.withColumn("__block", block).join(F.broadcast(lookup), ["__old", "__block"])
    # a few writers a shard, so that no shard passes through one task
    spread = out.repartition(F.col("shard"), F.pmod("__block", F.lit(8)))
    columns = [*[F.col(f"`{c}`") for c in docs.columns], F.col("shard")]
    # the rows may come from the very files that are replaced, so they are complete elsewhere first
    staged = written(spread.select(*columns, F.pmod("__block", F.lit(8)).alias("__writer")))
    filled = {r["shard"] for r in staged.select("shard").distinct().collect()}  # at most new rows
    staged.repartition(F.col("shard"), F.col("__writer")).select(*columns).write.partitionBy("shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    context = docs.sparkSession.sparkContext
    for j in sorted({*touched, *range(new, old)} - filled):
        folder = context._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={j}")
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
    return touched
