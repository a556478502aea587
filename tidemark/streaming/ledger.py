"""A publication ledger: dense sequence numbers, nothing twice, written from batches or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.window import Window

from tidemark.functions.time import micros


KEYS = ("event_id", "delivery_key")


def _numbered(candidates: DataFrame, last: Column, order: list[str]) -> DataFrame:
    """``candidates`` numbered on from ``last`` (a column of a single row beside each): range partitions, their counts, a window in each.

    The partition of a row follows from edges that are read once, so that a recomputed task
    numbers its rows as before.
    """
    edges = candidates.agg(F.percentile_approx(micros(F.col(order[0])), F.array(*[F.lit(k / 64) for k in range(1, 64)]), 1000).alias("__edges"))
    placed = candidates.crossJoin(F.broadcast(edges))  # a single row
    placed = placed.withColumn("__part", F.size(F.filter(F.coalesce("__edges", F.array().cast("array<bigint>")), lambda e: e < micros(F.col(order[0]))))).drop("__edges")
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # at most 64 rows
    firsts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    own = Window.partitionBy("__part").orderBy(*order)
    return placed.join(F.broadcast(firsts), "__part").withColumn("sequence", (last + F.col("__first") + F.row_number().over(own)).cast("long")).drop("__part", "__first")


def next_entries(candidates: DataFrame, ledger: DataFrame | None, order: list[str]) -> DataFrame:
    """The candidates to publish, numbered on from the ledger's last sequence.

    A candidate whose event_id or delivery_key is in the ledger, or earlier among the candidates,
    is not published again.  What is left is numbered in ``order``, whose first column is a time.
    """
    for key in KEYS:
        first = Window.partitionBy(key).orderBy(*order)
        candidates = candidates.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
        if ledger is not None:
            candidates = candidates.join(ledger.select(key).distinct(), key, "left_anti")
    if ledger is None:
        return _numbered(candidates, F.lit(0), order)
    last = ledger.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("__last"))
    return _numbered(candidates.crossJoin(F.broadcast(last)), F.col("__last"), order).drop("__last")  # a single row


def _last_batch(spark: SparkSession, path: str, number: int) -> int | None:
    """The last batch before this one that has written a folder."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return None
    names = [f.getPath().getName() for f in files.listStatus(root)]
    known = [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")]
    return max((k for k in known if k < number), default=None)


def publish(stream: DataFrame, path: str, order: list[str], checkpoint: str) -> DataStreamWriter:
    """Writer that publishes each micro-batch of ``stream`` into the table at ``path``, a folder a batch.

    What was published is known from the stream's state (keys of event_id and delivery_key), so
    that no batch reads the ledger, but for the last sequence in the folder of the batch before.
    A batch that is replayed writes its own folder anew, with the same numbers.  The state keeps
    every key for good, as an entry may never be published again: two short strings an entry.
    """

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = F.lit(0)
        before = _last_batch(spark, path, number)
        if before is not None:
            last = F.lit(spark.read.parquet(f"{path}/batch={before}").agg(F.max("sequence")).first()[0])
        for key in KEYS[1:]:  # rows of one batch: the state lets any of them pass first, the order decides
            first = Window.partitionBy(key).orderBy(*order)
            batch = batch.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
        numbered = _numbered(batch, last, order)
        if not numbered.isEmpty():  # every folder has a last sequence
            numbered.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.dropDuplicates([KEYS[0]]).dropDuplicates([KEYS[1]]).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)


def page(ledger: DataFrame, after: int, limit: int, topics: list[str] | None = None) -> DataFrame:
    """Entries after a cursor: the limit counts before the topics are looked at, and next_after moves past what was left out."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    head = ledger.filter(F.col("sequence") > after).orderBy("sequence").limit(limit)
    end = head.agg(F.coalesce(F.max("sequence"), F.lit(after)).alias("next_after"))
    wanted = head.filter(F.col("topic").isin(topics)) if topics else head
    return wanted.crossJoin(F.broadcast(end))  # a single row
