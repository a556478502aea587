"""Discrete-time hazards over hourly slots: survival, first-event mass, conditioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidemark.functions.math import piecewise_linear

#: Knots of the default multiplier after an outcome: hours since, factor (a parameter, not data).
REFRACTORY_KNOTS = ((0.0, 0.0), (24.0, 0.25), (72.0, 0.75), (168.0, 1.0))


def _slots(keys: Sequence[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def survival_curve(df: DataFrame, keys: Sequence[str], order: str, hazard: str = "hazard", window: int = 4) -> DataFrame:
    """Per slot: survival, first_probability, by_end_probability, and rolling_probability over ``window`` slots ahead.

    The rolling value is null where fewer slots are left.
    """
    slots = _slots(keys, order)
    stay = 1 - F.col(hazard)
    upto, ahead = slots.rowsBetween(Window.unboundedPreceding, 0), slots.rowsBetween(0, window - 1)
    before = F.coalesce(F.product(stay).over(slots.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    survival = F.product(stay).over(upto)
    rolling = F.when(F.count(hazard).over(ahead) == window, 1 - F.product(stay).over(ahead))
    return df.withColumns({"survival": survival, "first_probability": before * F.col(hazard), "by_end_probability": 1 - survival, "rolling_probability": rolling})


def log_cumulative(df: DataFrame, keys: Sequence[str], order: str, hazard: str = "hazard") -> DataFrame:
    """Probability of an event by each slot's end, summed in logarithms; a sure slot makes it 1 from there on."""
    upto = _slots(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    logs = F.sum(F.when(F.col(hazard) < 1, F.log1p(-F.col(hazard))).otherwise(0.0)).over(upto)
    return df.withColumn("cumulative", F.when(F.max(hazard).over(upto) >= 1, 1.0).otherwise(-F.expm1(logs)))


def first_event_mass(df: DataFrame, keys: Sequence[str], order: str, hazard: str = "hazard", name: str = "mass") -> DataFrame:
    before = _slots(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.product(1 - F.col(hazard)).over(before), F.lit(1.0)) * F.col(hazard))


def no_event_mass(df: DataFrame, keys: Sequence[str], hazard: str = "hazard", name: str = "no_event") -> DataFrame:
    """The mass of no event in any slot of the key, beside each of its slots: with the masses of the slots it makes 1."""
    return df.withColumn(name, F.product(1 - F.col(hazard)).over(Window.partitionBy(*keys)))


def hazards_of_mass(df: DataFrame, keys: Sequence[str], order: str, mass: str = "mass", name: str = "hazard", no_event: str | None = None) -> DataFrame:
    """Hazards back from masses: mass over what remains, 0 where nothing does.

    ``no_event``: the mass that is left after the last slot (see ``no_event_mass``).  What remains
    is then summed from the end, which stays exact however little that is; without it, 1 minus the
    masses before is lost in rounding below 1e-12.
    """
    if no_event:
        left = F.sum(mass).over(_slots(keys, order).rowsBetween(0, Window.unboundedFollowing)) + F.col(no_event)
        return df.withColumn(name, F.when(left <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.col(mass) / left)))
    before = _slots(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    left = 1 - F.coalesce(F.sum(mass).over(before), F.lit(0.0))
    return df.withColumn(name, F.when(left <= 1e-12, 0.0).otherwise(F.least(F.lit(1.0), F.col(mass) / left)))


def refractory(elapsed_hours: Column, knots: Sequence[tuple[float, float]] = REFRACTORY_KNOTS) -> Column:
    """Multiplier of the hazard after an outcome; 1 without one."""
    return F.when(elapsed_hours.isNull(), 1.0).otherwise(piecewise_linear(elapsed_hours, knots))


def authority_mixture(df: DataFrame, keys: Sequence[str], order: str, share: Column, weight: float, temper: float = 1.0, hazard: str = "hazard") -> DataFrame:
    """Hazards conditioned on a stated time range: hazard_mixed.

    ``share`` is the part of each slot inside the range.  The first-event mass inside the range,
    raised to ``temper`` and normalised, is mixed with the whole mass as (1 - weight) and weight;
    where the range has no mass it is spread evenly over the range.
    """
    parts = Window.partitionBy(*keys)
    own = first_event_mass(df, keys, order, hazard, "__mass").withColumn("__share", share)
    inside = F.when(F.col("__share") > 0, F.col("__share") * F.pow(F.col("__mass"), F.lit(float(temper)))).otherwise(0.0)
    own = own.withColumn("__in", inside)
    total, slots = F.sum("__in").over(parts), F.sum("__share").over(parts)
    even = F.when(slots > 0, F.col("__share") / slots).otherwise(0.0)
    told = F.when(total > 0, F.col("__in") / total).otherwise(even)
    mixed = F.when(slots > 0, (1 - weight) * F.col("__mass") + weight * told).otherwise(F.col("__mass"))
    return hazards_of_mass(own.withColumn("__mixed", mixed), keys, order, "__mixed", "hazard_mixed").drop("__mass", "__share", "__in", "__mixed")

