"""What a subject's facts make public: outcomes and their corrections, watches, authority windows; in batch and as a stream.

A fact has subject, at, tie, kind, entity, status, row, value and ends.  ``outcome`` facts give an
entity's status and row, ``probability`` facts a value, ``authority`` facts a window that ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from tidemark.streaming.delivery import publication_changes, watch_changes

#: A watch opens at and above the first and closes at and below the second probability.
OPENS, CLOSES = 0.5, 0.3

#: Keys that a subject's outcomes, and its authority windows, are dealt over in a stream.
LANES = 8

FACT = "subject long, at timestamp, tie long, kind string, entity string, status string, row string, value double, ends timestamp"
OUTPUT = "subject long, at timestamp, kind string, entity string, row string"
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def publications(facts: DataFrame, until: str | None = None, opens: float = OPENS, closes: float = CLOSES) -> DataFrame:
    """subject, at, kind, entity and row of all that is published, by windows over the facts.

    Outcomes: confirmed, corrected, retracted, withdrawn as ``publication_changes`` has them.
    Watches: opened, closed.  Authority windows: authority_opened once, at the first fact that
    names one before it ends, and authority_ended at its end, if ``until`` (a column of one time
    for all rows) has reached it.
    """
    said = publication_changes(facts.filter("kind = 'outcome'").withColumnRenamed("kind", "__kind"), ["subject", "entity"], "at", "tie", "status", "row")
    watched = watch_changes(facts.filter("kind = 'probability' and value is not null"), ["subject"], "at", "tie", "value", opens, closes)
    first = Window.partitionBy("subject", "entity", "ends").orderBy("at", "tie")
    windows = facts.filter("kind = 'authority' and ends > at").withColumn("__n", F.row_number().over(first)).filter("__n = 1")
    parts = [
        said.select("subject", "at", "kind", "entity", "row"),
        watched.select("subject", "at", F.col("change").alias("kind"), F.lit(None).cast("string").alias("entity"), F.lit(None).cast("string").alias("row")),
        windows.select("subject", "at", F.lit("authority_opened").alias("kind"), "entity", "row"),
        windows.filter(F.col("ends") <= F.col(until) if until else F.lit(True)).select("subject", F.col("ends").alias("at"), F.lit("authority_ended").alias("kind"), "entity", "row"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _millis(at: pd.Timestamp) -> int:
    """Milliseconds, rounded up, so that a timer never fires before its time."""
    return -(-at.value // 1_000_000)


class Projector(StatefulProcessor):
    """State of a subject's lane: rows of its outcomes that are confirmed, the watch, and the authority windows that are open.

    The rows of a batch are compared with each other first, so that state is read and written once
    for an outcome or window, not once for a row.  An outcome that is not confirmed has no state.
    """

    def __init__(self, opens: float = OPENS, closes: float = CLOSES) -> None:
        self.opens, self.closes = opens, closes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.outcomes = handle.getMapState("outcomes", "entity string", "row string")
        self.watch = handle.getValueState("watch", "active boolean")
        self.windows = handle.getMapState("windows", "entity string, ends long", "row string")

    def _outcomes(self, own: pd.DataFrame) -> Iterator[tuple]:
        own = own.sort_values(["at", "tie"], kind="stable")
        codes, names = pd.factorize(_or_none(own["entity"]), use_na_sentinel=False)
        order = np.argsort(codes, kind="stable")
        own, codes = own.iloc[order], codes[order]
        keys = [(None if pd.isna(x) else x,) for x in names]
        known = [self.outcomes.getValue(k) for k in keys] if self.outcomes.exists() else [None] * len(keys)
        status, row = own["status"].to_numpy(object), _or_none(own["row"])
        confirmed, first = status == "confirmed", np.diff(codes, prepend=-1) > 0
        was, was_row = np.roll(confirmed, 1), np.roll(row, 1)
        was[first], was_row[first] = [x is not None for x in known], [x and x[0] for x in known]
        said = np.where(confirmed, ~was | (row != was_row), was & np.isin(status.astype(str), ("retracted", "withdrawn")))
        kinds = np.where(confirmed & was, "corrected", status)
        at, entity = own["at"].tolist(), _or_none(own["entity"])
        last = np.append(first[1:], True)
        for k, before, now, its in zip(keys, known, confirmed[last], row[last], strict=True):
            if now and (before is None or before[0] != its):
                self.outcomes.updateValue(k, (its,))
            elif before is not None and not now:
                self.outcomes.removeKey(k)
        return ((at[k], kinds[k], entity[k], row[k]) for k in np.flatnonzero(said).tolist())

    def _watch(self, own: pd.DataFrame) -> Iterator[tuple]:
        own = own.sort_values(["at", "tie"], kind="stable")
        known = self.watch.exists()
        before = bool(self.watch.get()[0]) if known else False
        value = own["value"].to_numpy(float)
        marked = np.maximum.accumulate(np.where((value >= self.opens) | (value <= self.closes), np.arange(len(value)), -1))
        on = np.where(marked >= 0, value[marked] >= self.opens, before)
        changed = np.diff(on, prepend=before)
        changed[0] &= known  # the first value is a silent baseline
        if not known or on[-1] != before:
            self.watch.update((bool(on[-1]),))
        at = own["at"].tolist()
        return ((at[k], "opened" if on[k] else "closed", None, None) for k in np.flatnonzero(changed).tolist())

    def _windows(self, own: pd.DataFrame) -> Iterator[tuple]:
        some, timers = self.windows.exists(), set()
        for at, entity, row, ends in zip(own["at"], _or_none(own["entity"]), _or_none(own["row"]), own["ends"], strict=True):
            key = (entity, ends.value // 1000)
            if some and self.windows.containsKey(key):
                continue
            self.windows.updateValue(key, (row,))
            if (end := _millis(ends)) not in timers:
                self.handle.registerTimer(end)
                timers.add(end)
            yield at, "authority_opened", entity, row

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        outcomes, values, windows = [], [], []
        for part in rows:
            kind = part["kind"]
            outcomes.append(part.loc[(kind == "outcome") & part["status"].notna() & (part["status"] != "pending"), ["at", "tie", "entity", "status", "row"]])
            values.append(part.loc[(kind == "probability") & part["value"].notna(), ["at", "tie", "value"]])
            named = part.loc[(kind == "authority") & (part["ends"] > part["at"]), ["at", "tie", "entity", "row", "ends"]]
            windows = [_first_named([*windows, named])]
        found = []
        for publish, parts in ((self._outcomes, outcomes), (self._watch, values), (self._windows, windows)):
            own = pd.concat(parts, ignore_index=True)
            if len(own):
                found += [(key[0], *x) for x in publish(own)]
        if found:
            yield _published(found)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        over = [(k, v) for k, v in self.windows.iterator() if k[1] <= now]
        for k, _ in over:
            self.windows.removeKey(tuple(k))
        if over:
            yield _published([(key[0], pd.Timestamp(k[1] * 1000), "authority_ended", k[0], v[0]) for k, v in over])

    def close(self) -> None:
        pass


def _or_none(column: pd.Series) -> np.ndarray:
    """Its values, None where they are null."""
    return column.astype(object).where(column.notna(), None).to_numpy(object)


def _first_named(parts: list[pd.DataFrame]) -> pd.DataFrame:
    """The first fact of each authority window."""
    return pd.concat(parts, ignore_index=True).sort_values(["at", "tie"], kind="stable").drop_duplicates(["entity", "ends"])


def _published(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["subject", "at", "kind", "entity", "row"])
    out["at"] = pd.to_datetime(out["at"]).astype("datetime64[us]")
    return out


def publication_stream(facts: DataFrame, late: str = "1 hour", opens: float = OPENS, closes: float = CLOSES, lanes: int = LANES) -> DataFrame:
    """The same over a stream of facts.  Needs the state store of PROVIDER.

    A subject's outcomes go by lanes of their entities, its authority windows by lanes of their
    ends, its values are one more lane; each lane is a key of its own, so that a busy subject is
    many small ones.  Results do not depend on ``lanes``, which must stay the same over a checkpoint.  Facts of a lane are taken
    in order of time inside a batch; ones behind the watermark are dropped.  An authority window
    ends by a timer when the watermark passes its end, and is then forgotten.  Confirmed outcomes
    and watches stay in the state, one small row each.
    """
    kind, dealt = F.col("kind"), lambda c: F.pmod(F.xxhash64(c), F.lit(lanes))
    lane = F.when(kind == "outcome", dealt("entity")).when(kind == "authority", lanes + dealt("ends")).otherwise(2 * lanes)
    grouped = facts.withWatermark("at", late).withColumn("lane", lane).groupBy("subject", "lane")
    return grouped.transformWithStateInPandas(statefulProcessor=Projector(opens, closes), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
