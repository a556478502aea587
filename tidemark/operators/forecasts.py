"""Forecasts as arrays of hourly slots: their identities, integrity, curves and the rows that show them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.time import HOUR_US, micros
from tidemark.operators.coverage import reasons

SLOT = ("start", "end", "hazard", "first", "by_end", "rolling")


def _close(a: Column, b: Column, tolerance: float) -> Column:
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= tolerance)


def derived_slots(slots: Column, ahead: int = 4) -> Column:
    """first, by_end and rolling (over ``ahead`` slots, null where fewer are left) of each slot, computed from the hazards alone."""
    hazards = F.transform(slots, lambda s: s["hazard"])

    def surviving(upto: Column, n: Column) -> Column:
        return F.aggregate(F.slice(hazards, upto, n), F.lit(1.0), lambda acc, h: acc * (1 - h))

    def one(s: Column, i: Column) -> Column:
        before = surviving(F.lit(1), i)
        rolling = F.when(i + ahead <= F.size(hazards), 1 - surviving(i + 1, F.lit(ahead)))
        return F.struct((before * s["hazard"]).alias("first"), (1 - before * (1 - s["hazard"])).alias("by_end"), rolling.alias("rolling"))

    return F.transform(slots, one)


def slot_faults(slots: Column, tolerance: float = 1e-8, ahead: int = 4) -> Column:
    """What is wrong with a forecast's slots (see SLOT); empty: nothing."""
    anew = F.zip_with(slots, derived_slots(slots, ahead), lambda s, d: F.struct(s.alias("s"), d.alias("d")))
    steps = F.zip_with(F.slice(slots, 1, F.greatest(F.size(slots) - 1, F.lit(0))), F.slice(slots, 2, F.greatest(F.size(slots) - 1, F.lit(0))), lambda a, b: a["end"] == b["start"])

    def differs(c: str) -> Column:
        return F.exists(anew, lambda x: ~_close(x["s"][c], x["d"][c], tolerance))

    return reasons(
        {
            "no_slots": F.size(slots) == 0,
            "slots_not_contiguous": F.exists(steps, lambda x: ~x),
            "slot_not_one_hour": F.exists(slots, lambda s: micros(s["end"]) - micros(s["start"]) != HOUR_US),
            "hazard_out_of_range": F.exists(slots, lambda s: (s["hazard"] < 0) | (s["hazard"] > 1)),
            **{f"{c}_differs": differs(c) for c in SLOT[3:]},
        }
    )


def largest_difference(slots: Column, ahead: int = 4) -> Column:
    """The largest distance between what a forecast states and what follows from its hazards."""
    far = F.zip_with(slots, derived_slots(slots, ahead), lambda s, d: F.greatest(*[F.coalesce(F.abs(s[c] - d[c]), F.lit(0.0)) for c in SLOT[3:]]))
    return F.array_max(far)


def well_formed(slots: Column, anchor: Column, issued: Column, horizon: int) -> Column:
    """Whether the first ``horizon`` slots stand hour by hour from the anchor on, with possible hazards, and were issued by then."""
    head = F.slice(slots, 1, horizon)
    placed = F.transform(head, lambda s, i: (micros(s["start"]) == micros(anchor) + i * HOUR_US) & s["hazard"].between(0.0, 1.0))
    return (F.size(head) == horizon) & F.forall(placed, lambda x: x) & (issued <= anchor)


def latest_by_anchor(predictions: DataFrame, anchor: str, issued: str, tie: str, well: Column, release: Column) -> DataFrame:
    """The last well-formed prediction of the wanted release of each anchor, and how many were left out: malformed, other_release, superseded."""
    good = well & release
    order = Window.partitionBy(anchor).orderBy(F.desc(issued), tie)
    counts = predictions.groupBy(anchor).agg(F.count_if(~well).alias("malformed"), F.count_if(well & ~release).alias("other_release"), F.greatest(F.count_if(good) - 1, F.lit(0)).alias("superseded"))
    chosen = predictions.filter(good).withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
    return chosen.join(counts, anchor)


def is_usable(row: dict[str, Column], now: Column, most_hours: float) -> Column:
    """Whether a forecast may be published: its parts name each other, it is served and real, and its clocks are in order and fresh."""
    ordered = (row["cutoff"] <= row["issued"]) & (row["issued"] <= now) & (row["expires"] > now)
    fresh = micros(now) - micros(row["issued"]) <= int(most_hours * HOUR_US)
    return F.coalesce((row["hash"] == row["stated_hash"]) & row["serving"] & ~row["synthetic"] & ordered & fresh, F.lit(False))


def sparse_curve(curve: Column, horizons: Sequence[int]) -> Column:
    """(horizon, probability) at the wanted horizons that the dense curve reaches."""
    every = F.array(*[F.struct(F.lit(h).alias("horizon"), F.get(curve, F.lit(h - 1)).alias("probability")) for h in horizons])
    return F.filter(every, lambda x: x["probability"].isNotNull())


def at_horizon(curve: Column, sparse: Column, horizon: Column) -> Column:
    """Probability at a horizon from a dense curve, else from a sparse one; null where neither has it."""
    found = F.filter(sparse, lambda x: x["horizon"] == horizon)
    return F.coalesce(F.get(curve, horizon - 1), F.get(F.transform(found, lambda x: x["probability"]), F.lit(0)))
