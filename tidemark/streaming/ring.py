"""Sequenced inputs of topics with a bounded past: numbered in batch or as a stream, read by cursors that fail closed.

A fact has topic, at, tie, kind, key, payload and known_at.  ``input`` facts become inputs of their
topic, but for one that repeats the key of the input before.  ``gate`` facts say which outcome
revisions are known (key names them, null for none): when that changes, inputs from then on must
know of it, from the later of its own time and the time it was seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from tidemark.streaming import subscriptions

FACT = "topic long, at timestamp, tie long, kind string, key string, payload string, known_at timestamp"
OUTPUT = "topic long, sequence long, at timestamp, key string, payload string, floor long, gate string, gate_at timestamp"
HEAD = "last long, key string, gate string, gate_at long"
KEEP = 512


def numbered(facts: DataFrame, keep: int = KEEP) -> DataFrame:
    """topic, sequence, at, key, payload of each input, floor (the first sequence kept once it was there), gate and gate_at then."""
    w = Window.partitionBy("topic").orderBy("at", "tie")
    gates = facts.filter("kind = 'gate'").withColumn("__was", F.lag("key").over(w)).filter(~F.col("__was").eqNullSafe(F.col("key")))
    seen = F.when(F.col("key").isNotNull(), F.greatest("known_at", "at"))
    gates = gates.select("topic", "at", "tie", F.struct(F.col("key").alias("gate"), seen.alias("gate_at")).alias("__gate"))
    inputs = facts.filter("kind = 'input'").withColumn("__was", F.lag("key").over(w)).filter(F.col("__was").isNull() | ~F.col("__was").eqNullSafe(F.col("key")))
    inputs = inputs.withColumn("sequence", F.row_number().over(w).cast("long"))
    both = inputs.select("topic", "at", "tie", "sequence", "key", "payload").unionByName(gates, allowMissingColumns=True)
    carried = both.withColumn("__gate", F.last("__gate", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("sequence is not null")
    floor = F.greatest(F.lit(1), F.col("sequence") - keep + 1).cast("long")
    return carried.select("topic", "sequence", "at", "key", "payload", floor.alias("floor"), F.col("__gate.gate").alias("gate"), F.col("__gate.gate_at").alias("gate_at"))


class Sequencer(StatefulProcessor):
    """State of a topic: its last sequence and key, and the gate."""

    def __init__(self, keep: int = KEEP) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", HEAD)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows), ignore_index=True).sort_values(["at", "tie"], kind="stable")
        last, before, gate, gate_at = self.head.get() if self.head.exists() else (0, None, None, None)
        texts = {c: own[c].astype(object).where(own[c].notna(), None) for c in ("key", "payload")}
        out = []
        for at, kind, name, payload, known in zip(own["at"], own["kind"], texts["key"], texts["payload"], own["known_at"], strict=True):
            if kind == "gate" and name != gate:
                gate, gate_at = name, None if name is None else max(at.value, at.value if pd.isna(known) else known.value) // 1000
            elif kind == "input" and (last == 0 or before is None or name != before):
                last, before = last + 1, name
                out.append((key[0], last, at, name, payload, max(1, last - self.keep + 1), gate, None if gate_at is None else pd.Timestamp(gate_at * 1000)))
        self.head.update((last, before, gate, gate_at))
        found = pd.DataFrame(out, columns=["topic", "sequence", "at", "key", "payload", "floor", "gate", "gate_at"])
        for c in ("at", "gate_at"):
            found[c] = pd.to_datetime(found[c]).astype("datetime64[us]")
        yield found

    def close(self) -> None:
        pass


def numbered_stream(facts: DataFrame, keep: int = KEEP) -> DataFrame:
    """The same over a stream, whose facts come in order of their time.  Needs the RocksDB state store; a topic's state is one row."""
    return facts.groupBy("topic").transformWithStateInPandas(statefulProcessor=Sequencer(keep), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def bounds(ring: DataFrame) -> DataFrame:
    """topic, floor (the first sequence that is kept) and tail (the last one)."""
    return ring.groupBy("topic").agg(F.max("floor").alias("floor"), F.max("sequence").alias("tail"))


def cursor_status(after: Column, floor: Column, tail: Column) -> Column:
    """ok; ahead_of_tail for a cursor that nothing has reached; retention_gap for one whose next input is gone."""
    return F.when(after > F.coalesce(tail, F.lit(0)), "ahead_of_tail").when(after < F.coalesce(floor, F.lit(1)) - 1, "retention_gap").otherwise("ok")


def ring_pages(ring: DataFrame, cursors: DataFrame, limit: int) -> DataFrame:
    """The next page of every reader (reader, topic, after): status, and sequence, key and payload of at most ``limit`` inputs.

    A reader whose cursor is not ok, or that has read everything, has one row without an input.
    """
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    known = cursors.join(bounds(ring), "topic", "left").withColumn("status", cursor_status(F.col("after"), F.col("floor"), F.col("tail")))
    rows = ring.select("topic", "sequence", "key", "payload").alias("r")
    met = known.alias("k").join(rows, (F.col("k.topic") == F.col("r.topic")) & (F.col("r.sequence") > F.col("k.after")) & (F.col("r.sequence") <= F.col("k.after") + limit) & (F.col("k.status") == "ok"), "left")
    return met.select("k.reader", "k.topic", "k.status", "r.sequence", "r.key", "r.payload")


def replay_after(inputs: DataFrame, cursors: DataFrame, floors: DataFrame) -> DataFrame:
    """``subscriptions.replay`` of the inputs (with sequence) after each subscriber's cursor; where its next input is gone, one row that says so.

    ``cursors``: subscriber and after; ``floors``: subscriber, floor and tail.  A subscriber with a
    gap gets no transitions, as a missing input may have been one.
    """
    known = cursors.join(floors, "subscriber", "left").withColumn("status", cursor_status(F.col("after"), F.col("floor"), F.col("tail")))
    sound = inputs.join(known.filter("status = 'ok'").select("subscriber", "after"), "subscriber").filter(F.col("sequence") > F.col("after"))
    found = subscriptions.replay(sound.select("subscriber", *subscriptions.COLUMNS, "now", "threshold"))
    closed = known.filter("status <> 'ok'").select("subscriber", F.lit(None).cast("string").alias("prediction"), F.lit(None).cast("long").alias("emitted"), F.col("status").alias("reason"), F.lit(None).cast("string").alias("announcement"), F.lit(None).cast("boolean").alias("active"))
    return found.unionByName(closed)
