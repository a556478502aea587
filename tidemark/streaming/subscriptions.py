"""Threshold subscriptions over a stream of forecasts: one transition, folded in batch or kept as state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A watch opens above its threshold and closes this much below it.
MARGIN = 0.05


class Watch(NamedTuple):
    """What is kept for a subscriber; empty strings and -1 stand for "none"."""

    active: bool
    announced: bool
    prediction: str
    issued: int
    emitted: int
    outcome: str


class Input(NamedTuple):
    """One forecast as a subscriber sees it; times in microseconds.  outcome names the known outcome revisions."""

    prediction: str
    issued: int
    emitted: int
    expires: int
    cutoff: int
    probability: float
    outcome: str
    outcome_known: int


def transition(watch: Watch | None, x: Input, now: int, threshold: float, margin: float = MARGIN) -> tuple[Watch | None, str, str | None]:
    """The next watch, what happened, and the announcement (opened or closed), if any.

    The first forecast makes a silent baseline.  Future, expired, repeated and older forecasts,
    and those that don't know the latest outcome, change nothing.  A new outcome ends an episode.
    """
    if x.emitted > now:
        return watch, "snapshot_from_future", None
    if x.expires <= now:
        return watch, "snapshot_expired", None
    if x.outcome_known >= 0 and x.cutoff < x.outcome_known:
        return watch, "outcome_revision_not_in_knowledge_cutoff", None
    above = x.probability > threshold

    def kept(active: bool, announced: bool) -> Watch:
        return Watch(active, announced, x.prediction, x.issued, x.emitted, x.outcome)

    if watch is None:
        return kept(above, False), "baseline_initialized", None
    if x.prediction == watch.prediction:
        return watch, "duplicate_prediction", None
    if x.issued < watch.issued or x.emitted <= watch.emitted:
        return watch, "historical_prediction", None
    if watch.active and x.outcome != watch.outcome:
        return kept(False, False), "outcome_revision_closed_episode", "closed" if watch.announced else None
    if not watch.active and above:
        return kept(True, True), "probability_above_threshold", "opened"
    if watch.active and x.probability <= max(0.0, threshold - margin):
        return kept(False, False), "probability_below_hysteresis_threshold" if watch.announced else "watch_unchanged", "closed" if watch.announced else None
    return kept(watch.active, watch.announced), "watch_unchanged", None


OUTPUT = "subscriber long, prediction string, emitted long, reason string, announcement string, active boolean"
STATE = "active boolean, announced boolean, prediction string, issued long, emitted long, outcome string"
COLUMNS = ("prediction", "issued", "emitted", "expires", "cutoff", "probability", "outcome", "outcome_known")


def _steps(watch: Watch | None, rows: pd.DataFrame, subscriber: Any) -> tuple[Watch | None, list[tuple]]:
    out = []
    for r in rows.sort_values(["emitted", "prediction"], kind="stable").itertuples():
        x = Input(*[getattr(r, c) for c in COLUMNS])
        watch, reason, announcement = transition(watch, x, r.now, r.threshold)
        out.append((subscriber, x.prediction, x.emitted, reason, announcement, bool(watch and watch.active)))
    return watch, out


NAMES = ["subscriber", "prediction", "emitted", "reason", "announcement", "active"]


def replay(inputs: DataFrame) -> DataFrame:
    """All transitions of each subscriber, in batch.  A subscriber's forecasts are one ordered fold.

    Spark sorts them (and spills); a task holds one batch of rows and one watch, however long a
    subscriber's history is.
    """
    marked = inputs.withColumns({"__id": F.coalesce("subscriber", F.lit(0)), "__none": F.col("subscriber").isNull()}).drop("subscriber")
    rows = marked.repartition("__id", "__none").sortWithinPartitions("__id", "__none", F.col("emitted").asc_nulls_last(), F.col("prediction").asc_nulls_last())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, watch = None, None
        for part in parts:
            out = []
            keys = zip(part.pop("__id").tolist(), part.pop("__none").tolist(), strict=True)
            for key, r in zip(keys, part.itertuples(index=False), strict=True):
                watch = watch if key == last else None
                last, x = key, Input(*[getattr(r, c) for c in COLUMNS])
                watch, reason, announcement = transition(watch, x, r.now, r.threshold)
                out.append((None if key[1] else key[0], x.prediction, x.emitted, reason, announcement, bool(watch and watch.active)))
            yield pd.DataFrame(out, columns=NAMES)

    return rows.mapInPandas(run, OUTPUT)


def watch_stream(inputs: DataFrame) -> DataFrame:
    """The same over a stream, with the watch as state: equal transitions, however the input is cut into batches."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watch = Watch(*state.get) if state.exists else None
        rows = pd.concat(list(batches), ignore_index=True)
        watch, out = _steps(watch, rows, key[0])
        if watch is not None:
            state.update(tuple(watch))
        yield pd.DataFrame(out, columns=NAMES)

    return inputs.groupBy("subscriber").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
