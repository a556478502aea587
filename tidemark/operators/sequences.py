"""Ordered operators: latest per anchor, top per week, greedy choices, clusters, states, streaks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.functions.time import HOUR_US, micros, week_start


def latest_per_anchor(df: DataFrame, anchor: Sequence[str], issued: str, tie: str) -> DataFrame:
    """The last issued row of each anchor (ties: smallest ``tie``) and how many others there were (excluded)."""
    best = F.min_by(F.struct(*df.columns), F.struct((-micros(F.col(issued))).alias("t"), F.col(tie)))
    return df.groupBy(*anchor).agg(best.alias("__row"), (F.count(F.lit(1)) - 1).alias("excluded")).select("__row.*", "excluded")


def top_per_week(df: DataFrame, time: str, p: str, budget: int, tie: str) -> DataFrame:
    """The ``budget`` most probable rows of each UTC Monday week, earlier ones first among equals."""
    week = week_start(F.col(time))
    order = Window.partitionBy("week").orderBy(F.col(p).desc(), F.col(time), F.col(tie))
    return df.withColumn("week", week).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= budget)


def peak_window(df: DataFrame, keys: Sequence[str], value: str, start: str) -> DataFrame:
    """The largest value of each key and where it starts first."""
    best = F.max_by(F.struct(start, value), F.struct(F.col(value), -micros(F.col(start))))
    return df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(best.alias("__best")).select(*keys, F.col(f"__best.{start}").alias("peak_start"), F.col(f"__best.{value}").alias("peak_value"))


def keyset_page(df: DataFrame, order: str, after: int, limit: int, wanted: Column) -> DataFrame:
    """One page after a cursor: the limit comes before the filter, so that a page can be empty and still move on (next_after)."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    page = df.filter(F.col(order) > after).orderBy(order).limit(limit)
    end = page.agg(F.coalesce(F.max(order), F.lit(after)).alias("next_after"))
    return page.filter(wanted).crossJoin(F.broadcast(end))  # a single row


def contiguity_breaks(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Rows that don't start where the row before ends."""
    w = Window.partitionBy(*keys).orderBy(start)
    return df.withColumn("previous_end", F.lag(end).over(w)).filter(F.col("previous_end").isNotNull() & (F.col("previous_end") != F.col(start)))


def gap_sessions(df: DataFrame, keys: Sequence[str], time: str, tie: str, hours: float, name: str = "session") -> DataFrame:
    """Number (from 1) of the run of rows less than or exactly ``hours`` apart."""
    w = Window.partitionBy(*keys).orderBy(time, tie)
    gap = micros(F.col(time)) - F.lag(micros(F.col(time))).over(w)
    new = F.when(gap.isNull() | (gap > int(hours * HOUR_US)), 1).otherwise(0)
    return df.withColumn("__new", new).withColumn(name, F.sum("__new").over(w)).drop("__new")


def _fold(df: DataFrame, keys: Sequence[str], time: str, tie: str, starts: Column, name: str, kind: T.DataType, stepper) -> DataFrame:  # noqa: ANN001
    """A column of what ``stepper()`` says of each row in order, given its time (micros), whether a piece starts there, and its tie.

    Rows are dealt by key and sorted (where the window that found the pieces has done so already,
    that costs nothing); a task folds its rows in one pass and holds one batch of them, however
    long a key's history is.
    """
    marked = df.withColumn("__starts", starts).repartition(*keys).sortWithinPartitions(*keys, time, tie)
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = stepper()
        for part in parts:
            times = part[time].to_numpy().astype("datetime64[us]").astype("int64").tolist()
            part[name] = [step(*x) for x in zip(times, part["__starts"].tolist(), part[tie].tolist(), strict=True)]
            yield part[[f.name for f in schema.fields]]

    return marked.mapInPandas(run, schema)


def _after_gap(keys: Sequence[str], time: str, tie: str, hours: float) -> Column:
    """Is the row the first of its key, or more than ``hours`` after the one before?"""
    gap = micros(F.col(time)) - F.lag(micros(F.col(time))).over(Window.partitionBy(*keys).orderBy(time, tie))
    return gap.isNull() | (gap > int(hours * HOUR_US))


def non_overlapping(df: DataFrame, keys: Sequence[str], start: str, tie: str, hours: float) -> DataFrame:
    """Greedy choice of windows of one width: a row is taken when it starts at or after the last taken one's end (chosen 1, else 0)."""
    width = int(hours * HOUR_US)

    def stepper():  # noqa: ANN202
        free = 0

        def step(t: int, starts: bool, _: object) -> int:
            nonlocal free
            take = starts or t >= free
            free = t + width if take else free
            return int(take)

        return step

    return _fold(df, keys, start, tie, _after_gap(keys, start, tie, hours), "chosen", T.LongType(), stepper)


def _first_within(span: int, tied: bool):  # noqa: ANN202
    """Steps that give the first row's tie, or its time, of pieces that last ``span`` at most."""

    def stepper():  # noqa: ANN202
        first, name = 0, None

        def step(t: int, starts: bool, own: object) -> object:
            nonlocal first, name
            if starts or t - first > span:
                first, name = t, own
            return name if tied else first

        return step

    return stepper


def gap_span_clusters(df: DataFrame, keys: Sequence[str], time: str, tie: str, gap_hours: float = 2.0, span_hours: float = 6.0) -> DataFrame:
    """Clusters of rows at most ``gap_hours`` after the one before and ``span_hours`` after the first: cluster_start."""
    out = _fold(df, keys, time, tie, _after_gap(keys, time, tie, gap_hours), "__first", T.LongType(), _first_within(int(span_hours * HOUR_US), tied=False))
    return out.withColumn("cluster_start", F.timestamp_micros("__first").cast("timestamp_ntz")).drop("__first")


def copy_waves(df: DataFrame, content: str, time: str, tie: str, restart: Column, hours: float = 72.0) -> DataFrame:
    """wave_root: the ``tie`` of the first row of the wave of equal contents that a row belongs to.

    A wave ends ``hours`` after its first row; a row for which ``restart`` holds begins a new one.
    """
    starts = F.coalesce(restart, F.lit(False)) | _after_gap([content], time, tie, hours)
    return _fold(df, [content], time, tie, starts, "wave_root", df.schema[tie].dataType, _first_within(int(hours * HOUR_US), tied=True))


def lifecycle(df: DataFrame, keys: Sequence[str], time: str, tie: str, phase: str, resolved: str = "resolved") -> DataFrame:
    """state of each row: its phase, but "reopened" for one that is not resolved and follows a resolved one; spell: number of resolutions before."""
    before = Window.partitionBy(*keys).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.sum((F.col(phase) == resolved).cast("int")).over(before), F.lit(0))
    state = F.when((F.col(phase) != resolved) & (done > 0), "reopened").otherwise(F.col(phase))
    return df.withColumn("spell", done.cast("int")).withColumn("state", state)


def flips(df: DataFrame, keys: Sequence[str], time: str, tie: str, flag: str) -> DataFrame:
    """Rows whose flag differs from the row before (a first row counts when its flag is set)."""
    w = Window.partitionBy(*keys).orderBy(time, tie)
    before = F.coalesce(F.lag(flag).over(w), F.lit(False))
    return df.withColumn("before", before).filter(F.col("before") != F.col(flag))


def streaks(df: DataFrame, keys: Sequence[str], order: str, flag: Column, name: str = "streak") -> DataFrame:
    """Length so far of the run of rows for which ``flag`` holds; 0 elsewhere."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("__flag", flag.cast("int")).withColumn("__run", F.sum(1 - F.col("__flag")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(*keys, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(name, F.sum("__flag").over(own).cast("int")).drop("__flag", "__run")


def capacity_states(df: DataFrame, keys: Sequence[str], order: str, streak: str, healthy: str, opens: int = 2, escalates: int = 4, recovers: int = 3) -> DataFrame:
    """event: opened, escalated or recovered where a streak reaches its length."""
    event = F.when(F.col(streak) == opens, "opened").when(F.col(streak) == escalates, "escalated").when(F.col(healthy) == recovers, "recovered")
    return df.withColumn("event", event).filter(F.col("event").isNotNull())


def day_over_day(df: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """previous (the row before) and median7 (of the seven rows before, null without any)."""
    w = Window.partitionBy(*keys).orderBy(day)
    return df.withColumn("previous", F.lag(value).over(w)).withColumn("median7", _median(F.collect_list(value).over(w.rowsBetween(-7, -1))))


def _median(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    middle = (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, (F.floor(n / 2) + 1).cast("int"))) / 2.0
    return F.when(n > 0, middle)
