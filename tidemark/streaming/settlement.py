"""Settlement as a stream: windows get a status when they are over, and a new revision when late evidence changes it.

A fact has subject, at (when it was known), tie, kind, entity, revision, start, end and status:
``window`` facts name windows, ``outcome`` facts are revisions of outcomes (confirmed, ambiguous,
or anything else for one that no longer counts), ``coverage`` facts revisions of assertions
(eligible, or anything else for one that doesn't count).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from tidemark.functions.time import HOUR_US, micros

FACT = "subject long, at timestamp, tie long, kind string, entity string, revision long, start timestamp, end timestamp, status string"
OUTPUT = "subject long, window string, start timestamp, end timestamp, at timestamp, status string, revision int, retracts string"
STATE = "desks string"  # JSON: by subject [clock, windows, outcomes, coverage] of its Desk

Fact = tuple[int, str, str, int, int, int, str]  # at, kind, entity, revision, start, end, status; times in microseconds


@dataclass
class Desk:
    """What is known of the windows of a subject that start in one bucket of time."""

    clock: int = -1 << 62
    windows: dict[str, tuple[int, int, str, int]] = field(default_factory=dict)  # start, end, status, revision
    outcomes: dict[str, tuple[int, int, int, str]] = field(default_factory=dict)  # revision, start, end, status
    coverage: dict[str, tuple[int, int, int, str]] = field(default_factory=dict)

    def status(self, start: int, end: int) -> str:
        """Confirmed outcomes make it positive, others censored; then whole coverage makes it negative."""
        met = {x[3] for x in self.outcomes.values() if x[1] < end and x[2] > start}
        if "confirmed" in met:
            return "positive"
        if "ambiguous" in met:
            return "censored"
        reach = start
        for _, s, e, _ in sorted((x for x in self.coverage.values() if x[3] == "eligible"), key=lambda x: x[1]):
            if s <= reach:
                reach = max(reach, e)
        return "negative" if reach >= end > start else "censored"

    def settle(self, until: int, spans: Sequence[tuple[int, int]]) -> Iterator[tuple]:
        """Decisions of windows that are over by ``until``, where they are new or, as what changed in ``spans`` has it, others than before."""
        for name, (start, end, before, revision) in list(self.windows.items()):
            if end > until or (before and not any(s < end and e > start for s, e in spans)):
                continue
            now = self.status(start, end)
            if now != before:
                self.windows[name] = (start, end, now, revision + 1)
                yield name, start, end, max(end, self.clock), now, revision + 1, before or None

    def _mature(self, until: int) -> Iterator[tuple]:
        """Windows that are over by ``until`` and have no decision yet, each as of its end."""
        over = [(end, name, start, revision) for name, (start, end, before, revision) in self.windows.items() if not before and end <= until]
        for end, name, start, revision in sorted(over, key=lambda x: x[0]):
            now = self.status(start, end)
            self.windows[name] = (start, end, now, revision + 1)
            yield name, start, end, end, now, revision + 1, None

    def advance(self, facts: Iterable[Fact]) -> Iterator[tuple]:
        """Decisions as the facts, in order of their time, become known; facts of one time count together."""
        held: list[Fact] = []
        for fact in facts:
            if held and fact[0] != held[0][0]:
                yield from self._apply(held)
                held = []
            held.append(fact)
        if held:
            yield from self._apply(held)

    def _apply(self, facts: list[Fact]) -> Iterator[tuple]:
        yield from self._mature(facts[0][0] - 1)  # what is over before these were known
        self.clock = max(self.clock, facts[0][0])
        spans: list[tuple[int, int]] = []
        for _, kind, entity, revision, start, end, status in facts:
            if kind == "window":
                self.windows.setdefault(entity, (start, end, "", 0))
            elif kind in ("outcome", "coverage"):
                table = self.outcomes if kind == "outcome" else self.coverage
                if entity not in table or revision >= table[entity][0]:
                    if entity in table:
                        spans.append(table[entity][1:3])  # a window that the fact no longer reaches
                    table[entity] = (revision, start, end, status)
                    spans.append((start, end))
        yield from self.settle(self.clock, spans)

    def expire(self, until: int) -> Iterator[tuple]:
        """Decisions of windows that no fact came after."""
        yield from self._mature(until)

    def due(self) -> int | None:
        """The end of the first window that nothing has decided yet."""
        return min((end for _, end, status, _ in self.windows.values() if not status), default=None)


def in_buckets(facts: DataFrame, bucket_hours: float = 24.0, longest_hours: float = 24.0) -> DataFrame:
    """Facts with the buckets of the windows that they may touch, so that a busy subject is many small keys.

    A window is at home in the bucket of its start and at most ``longest_hours`` long; other facts
    go to each bucket whose windows they may overlap.
    """
    width, longest = int(bucket_hours * HOUR_US), int(longest_hours * HOUR_US)
    first = F.floor((micros(F.col("start")) - F.when(F.col("kind") == "window", 0).otherwise(longest)) / width)
    last = F.when(F.col("kind") == "window", first).otherwise(F.floor((micros(F.col("end")) - 1) / width))
    return facts.filter(F.col("start") < F.col("end")).withColumn("bucket", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def _facts(rows: pd.DataFrame) -> dict[int, list[Fact]]:
    """Facts of each subject in order of their time, then tie."""
    at, start, end = (rows[c].astype("datetime64[us]").astype("int64").tolist() for c in ("at", "start", "end"))
    ties = zip(at, rows["tie"].tolist(), strict=True)
    facts = zip(at, rows["kind"].tolist(), rows["entity"].tolist(), rows["revision"].tolist(), start, end, rows["status"].tolist(), strict=True)
    out: dict[int, list[Fact]] = {}
    for _, subject, fact in sorted(zip(ties, rows["subject"].tolist(), facts, strict=True), key=lambda x: x[0]):
        out.setdefault(subject, []).append(fact)
    return out


def _rows(found: Iterable[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(found, columns=["subject", "window", "start", "end", "at", "status", "revision", "retracts"])
    for c in ("start", "end", "at"):
        out[c] = pd.to_datetime(out[c], unit="us").astype("datetime64[us]")
    out["revision"] = out["revision"].astype("int32")
    return out


def settlement_history(facts: DataFrame, until: str | None = None, bucket_hours: float = 24.0, longest_hours: float = 24.0) -> DataFrame:
    """All revisions of each window's status: subject, window, start, end, at, status, revision, retracts.

    A first revision is made as of the window's end, unless ``until`` (a column of one time for
    all rows) has not reached it and no later fact came.  Spark sorts the facts; a task holds those of one subject about one bucket
    of time.
    """
    rows = in_buckets(facts, bucket_hours, longest_hours).withColumn("until", micros(F.col(until)) if until else F.lit(None).cast("long"))
    rows = rows.withColumns({c: micros(F.col(c)) for c in ("at", "start", "end")}).repartition("subject", "bucket").sortWithinPartitions("subject", "bucket", "at", "tie")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own, end, out = None, [], None, []

        def settle() -> None:
            desk = Desk()
            out.extend((held[0], *x) for x in desk.advance(own))
            out.extend((held[0], *x) for x in desk.expire(1 << 62 if end is None else end))

        for part in parts:
            for subject, bucket, until_, *fact in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (subject, bucket) != held:
                    if held is not None:
                        settle()
                    held, own, end = (subject, bucket), [], until_
                own.append(tuple(fact))
            if out:
                yield _arrow(out)
                out.clear()
        if held is not None:
            settle()
        if out:
            yield _arrow(out)

    raw = "subject long, window string, start long, end long, at long, status string, revision int, retracts string"
    columns = ["subject", "bucket", "until", "at", "kind", "entity", "revision", "start", "end", "status"]
    found = rows.select(*columns).mapInArrow(run, raw)
    return found.withColumns({c: F.timestamp_micros(c) for c in ("start", "end", "at")})


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    names = ["subject", "window", "start", "end", "at", "status", "revision", "retracts"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


class Settler(StatefulProcessor):
    """The Desks of a lane's subjects as one state, with a timer at the first end of a window that nothing has decided yet."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("desks", STATE)

    def _load(self) -> dict[int, Desk]:
        if not self.state.exists():
            return {}
        kept = json.loads(self.state.get()[0])
        return {subject: Desk(clock, *[{x[0]: tuple(x[1:]) for x in part} for part in parts]) for subject, clock, *parts in kept}

    def _keep(self, desks: dict[int, Desk]) -> None:
        """Store the desks, and have them called when the next window is over."""
        kept = [(subject, d.clock, *[[(k, *v) for k, v in part.items()] for part in (d.windows, d.outcomes, d.coverage)]) for subject, d in desks.items()]
        self.state.update((json.dumps(kept, separators=(",", ":")),))
        due = min((t for d in desks.values() if (t := d.due()) is not None), default=None)
        if due is not None:
            self.handle.registerTimer(-(-due // 1000))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        desks = self._load()
        found = []
        for subject, facts in _facts(pd.concat(list(rows), ignore_index=True)).items():
            desk = desks.setdefault(subject, Desk())
            found.extend((subject, *x) for x in desk.advance(facts))
        self._keep(desks)
        if found:
            yield _rows(found)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """All that is over by the watermark, so that one timer serves many windows."""
        desks = self._load()
        until = 1000 * max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        found = [(subject, *x) for subject, desk in desks.items() for x in desk.expire(until)]
        if found:
            self._keep(desks)
            yield _rows(found)

    def close(self) -> None:
        pass


def settlement_stream(facts: DataFrame, late: str = "1 hour", bucket_hours: float = 168.0, longest_hours: float = 24.0, lanes: int = 256) -> DataFrame:
    """The same over a stream of facts, with a revision as soon as its evidence is known.  Needs the RocksDB state store.

    Facts behind the watermark are dropped.  A key is a lane of subjects and a bucket, as each key
    costs calls to Python and the state store, and its state is read and written whole where one
    of its subjects has facts: choose ``lanes`` so that some fifty subjects share one, whatever
    their number.  A bucket is a week here, as facts near a bucket's edge go to two.  Results
    depend on neither; both must stay the same over a checkpoint.
    """
    dealt = in_buckets(facts.withWatermark("at", late), bucket_hours, longest_hours).withColumn("lane", F.pmod(F.xxhash64("subject"), F.lit(lanes)))
    return dealt.groupBy("lane", "bucket").transformWithStateInPandas(statefulProcessor=Settler(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def status_as_of(history: DataFrame, cutoffs: DataFrame, windows: DataFrame) -> DataFrame:
    """cutoff, subject, window and status of every window at every cutoff: its last revision known by then, else pending."""
    w = Window.partitionBy("cutoff", "subject", "window").orderBy(F.col("revision").desc_nulls_last())
    grid = windows.select("subject", "window").distinct().crossJoin(F.broadcast(cutoffs))  # a few cutoffs
    met = grid.alias("g").join(history.alias("h"), (F.col("g.subject") == F.col("h.subject")) & (F.col("g.window") == F.col("h.window")) & (F.col("h.at") <= F.col("g.cutoff")), "left")
    last = met.select("g.cutoff", "g.subject", "g.window", "h.revision", "h.status").withColumn("__n", F.row_number().over(w)).filter("__n = 1")
    return last.select("cutoff", "subject", "window", F.coalesce("status", F.lit("pending")).alias("status"))
