"""Algebra of half-open intervals: merging, overlap, containment, exposure, neighbours in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.time import HOUR_US, micros, overlap_hours


def _islands(df: DataFrame, keys: Sequence[str], partition: Sequence[str], start: str, end: str, touching: bool, flags: Sequence[str]) -> DataFrame:
    in_time = Window.partitionBy(*partition).orderBy(start, end)
    reach = F.max(end).over(in_time.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col(start) > F.col("__reach") if touching else F.col(start) >= F.col("__reach")
    marked = df.withColumn("__reach", reach).withColumn("__new", F.when(F.col("__reach").isNull() | apart, 1).otherwise(0))
    marked = marked.withColumn("__island", F.sum("__new").over(in_time))
    extra = [F.max(f).alias(f) for f in flags]
    return marked.groupBy(*partition, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("__n").alias("__n"), *extra).select(*keys, start, end, "__n", *flags)


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", touching: bool = True, flags: Sequence[str] = (), bucket: str = "day") -> DataFrame:
    """Maximal intervals of each key with the number of merged ones (n); ``flags`` are or-ed (maximum).

    ``touching``: whether intervals that only touch are one.  Empty intervals fall away.  Intervals
    are merged within the time buckets of their starts first, so that a key with very many of them
    reaches the second step as a few.
    """
    some = df.filter(F.col(end) > F.col(start)).select(*keys, start, end, *flags, F.lit(1).cast("long").alias("__n"), F.date_trunc(bucket, F.col(start)).alias("__bucket"))
    local = _islands(some, keys, [*keys, "__bucket"], start, end, touching, flags)
    return _islands(local, keys, list(keys), start, end, touching, flags).withColumnRenamed("__n", "n")


def _bins(start: Column, end: Column, hours: float) -> Column:
    width = F.lit(int(hours * HOUR_US))
    return F.sequence(F.floor(micros(start) / width), F.floor((micros(end) - 1) / width))


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_range: tuple[str, str], right_range: tuple[str, str], bin_hours: float) -> DataFrame:
    """Pairs that overlap, as an equi-join on ``on`` and time bins; a pair is kept in the bin where its overlap starts.

    The columns of the ranges must have different names.  Choose ``bin_hours`` near the usual length.
    """
    (ls, le), (rs, re) = left_range, right_range
    a = left.filter(F.col(le) > F.col(ls)).withColumn("__bin", F.explode(_bins(F.col(ls), F.col(le), bin_hours)))
    b = right.filter(F.col(re) > F.col(rs)).withColumn("__bin", F.explode(_bins(F.col(rs), F.col(re), bin_hours)))
    joined = a.join(b, [*on, "__bin"])
    first = F.floor(F.greatest(micros(F.col(ls)), micros(F.col(rs))) / F.lit(int(bin_hours * HOUR_US)))
    return joined.filter((F.col(ls) < F.col(re)) & (F.col(le) > F.col(rs)) & (F.col("__bin") == first)).drop("__bin")


def contained(windows: DataFrame, merged: DataFrame, on: Sequence[str], window_range: tuple[str, str], merged_range: tuple[str, str], how: str = "left_semi", bucket: str | None = None) -> DataFrame:
    """Windows inside one merged interval (or, with left_anti, those that are not).

    Merged intervals of a key do not overlap, so only the last that starts by the window's start
    can hold it: a backward as-of search, not a range join.  ``bucket``: see ``asof_join``.
    """
    (ws, we), (ms, me) = window_range, merged_range
    found = asof_join(windows, merged.select(*on, F.col(ms).alias("__ms"), F.col(me).alias("__me")), on, ws, "__ms", ["__me"], strict=False, bucket=bucket)
    inside = F.coalesce(F.col("__me") >= F.col(we), F.lit(False))
    return found.filter(inside if how == "left_semi" else ~inside).drop("__me")


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, values: Sequence[str], strict: bool = True, bucket: str | None = None) -> DataFrame:
    """``left`` with ``values`` of the last right row of the same key before (or, unless strict, at) its time.

    One exchange: both sides are sorted together and the last value is carried on.  Among right
    rows of one time the one with the greatest values counts.

    ``bucket``, such as day: for keys with very many rows, or none at all.  Rows are sorted within
    buckets of time, and the last right row of each bucket (one row a bucket) is carried over.
    """
    packed = F.struct(*[F.col(v) for v in values])
    a = left.select(*on, F.col(left_time).alias("__t"), F.lit(0 if strict else 1).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(packed.alias("x")).schema[0].dataType).alias("__right"))
    b = right.select(*on, F.col(right_time).alias("__t"), F.lit(1 if strict else 0).alias("__side"), F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), packed.alias("__right"))
    both = a.unionByName(b)
    if bucket is None:
        in_time = Window.partitionBy(*on).orderBy("__t", "__side", "__right").rowsBetween(Window.unboundedPreceding, 0)
        carried = both.withColumn("__last", F.last("__right", ignorenulls=True).over(in_time))
    else:
        both = both.withColumn("__bucket", F.date_trunc(bucket, "__t"))
        ends = both.groupBy(*on, "__bucket").agg(F.max(F.when(F.col("__right").isNotNull(), F.struct("__t", "__right"))).alias("__end"))
        earlier = Window.partitionBy(*on).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*on, "__bucket", F.last("__end", ignorenulls=True).over(earlier)["__right"].alias("__before"))
        in_time = Window.partitionBy(*on, "__bucket").orderBy("__t", "__side", "__right").rowsBetween(Window.unboundedPreceding, 0)
        carried = both.withColumn("__own", F.last("__right", ignorenulls=True).over(in_time)).join(ends, [*on, "__bucket"])
        carried = carried.withColumn("__last", F.coalesce("__own", "__before"))
    return carried.filter(F.col("__left").isNotNull()).select("__left.*", *[F.col(f"__last.{v}").alias(v) for v in values])


def next_after(df: DataFrame, keys: Sequence[str], time: str, tie: str, when: Column, name: str) -> DataFrame:
    """``df`` with the time of the next later row of its key for which ``when`` holds."""
    later = Window.partitionBy(*keys).orderBy(time, tie).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(name, F.min(F.when(when, F.col(time))).over(later))


def exposure_hours(windows: DataFrame, merged: DataFrame, on: Sequence[str], ids: Sequence[str], window_range: tuple[str, str], merged_range: tuple[str, str], bin_hours: float) -> DataFrame:
    """Hours of each window that the merged intervals cover; windows without any have 0."""
    pairs = overlap_join(windows.select(*dict.fromkeys([*on, *ids, *window_range])), merged.select(*on, *merged_range), on, window_range, merged_range, bin_hours)
    hours = overlap_hours(*[F.col(c) for c in (*window_range, *merged_range)])
    sums = pairs.groupBy(*ids).agg(F.sum(hours).alias("covered_hours"))
    return windows.join(sums, list(ids), "left").withColumn("covered_hours", F.coalesce("covered_hours", F.lit(0.0)))


def overlapping_hours(df: DataFrame, start: str, end: str, slot: str = "slot") -> DataFrame:
    """One row for each UTC hour that the interval touches."""
    bins = _bins(F.col(start), F.col(end), 1)
    at = F.explode(F.when(F.col(end) > F.col(start), bins))
    return df.withColumn(slot, at).withColumn(slot, F.timestamp_micros(F.col(slot) * HOUR_US).cast("timestamp_ntz"))
