"""Traffic metrics over event time: tumbling minutes, sliding views, mergeable latency histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.window import Window

#: Upper bounds of the latency buckets; one more bucket takes what is above.
BOUNDS = (5, 10, 25, 50, 75, 100, 150, 200, 300, 500)


def histogram(value: Column, bounds: Sequence[float] = BOUNDS) -> Column:
    """Counts by bucket, as an array; histograms of parts add up to that of the whole."""
    low = [None, *bounds]
    counts = []
    for a, b in zip(low, [*bounds, None], strict=True):
        inside = F.lit(True)
        inside = inside & (value > a) if a is not None else inside
        inside = inside & (value <= b) if b is not None else inside
        counts.append(F.count_if(inside))
    return F.array(*counts)


def merged(histograms: Column, size: int) -> Column:
    """Sum of an array of histograms."""
    return F.aggregate(histograms, F.array_repeat(F.lit(0).cast("long"), size), lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b))


def percentile(counts: Column, share: float, largest: Column, bounds: Sequence[float] = BOUNDS) -> Column:
    """Upper bound of the bucket that the share falls into, the largest value for the last one; null without values."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda acc, x: acc + x)
    running = F.lit(0).cast("long")
    out = F.when(total == 0, F.lit(None).cast("double"))
    for k, bound in enumerate(bounds):
        running = running + F.get(counts, F.lit(k))
        out = out.when(running >= F.ceil(total * share), F.least(F.lit(float(bound)), largest))
    return out.otherwise(largest)


def minute_metrics(events: DataFrame, time: str, value: str, failed: Column, keys: Sequence[str] = (), width: str = "1 minute", slide: str | None = None, late: str | None = None) -> DataFrame:
    """window_start, requests, failures, largest and latency histogram of each window; batch or stream.

    ``late`` sets the watermark: how late a row of a stream may come.
    """
    rows = events.withWatermark(time, late) if late else events
    win = F.window(time, width, slide) if slide else F.window(time, width)
    out = rows.groupBy(win, *keys).agg(F.count(F.lit(1)).alias("requests"), F.count_if(failed).alias("failures"), F.max(value).alias("largest"), histogram(F.col(value)).alias("latency"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "requests", "failures", "largest", "latency")


def rollup(minutes: DataFrame, keys: Sequence[str], period: Column) -> DataFrame:
    """Minutes merged into longer periods without their rows: counters add, gauges take the maximum, histograms merge."""
    size = len(BOUNDS) + 1
    parts = [F.sum(F.get("latency", F.lit(k))).alias(f"b{k}") for k in range(size)]
    out = minutes.groupBy(period.alias("period"), *keys).agg(F.sum("requests").alias("requests"), F.sum("failures").alias("failures"), F.max("largest").alias("largest"), *parts)
    return out.withColumn("latency", F.array(*[F.col(f"b{k}") for k in range(size)])).drop(*[f"b{k}" for k in range(size)])


def keep_windows(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writer that keeps changed windows as Parquet, a folder a batch; a replayed batch writes its own folder anew.

    The stream runs in update mode: state of windows behind the watermark goes, and nothing but
    what a batch changed is written.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def latest_windows(kept: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The last state of each window of a table that ``keep_windows`` wrote."""
    columns = [c for c in kept.columns if c != "batch"]
    return kept.groupBy("window_start", *keys).agg(F.max_by(F.struct(*columns), "batch").alias("r")).select("r.*")


def rate_of_change(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """``df`` with change: the value less that of the row before."""
    w = Window.partitionBy(*keys).orderBy(time)
    return df.withColumn("change", F.col(value) - F.lag(value).over(w))
