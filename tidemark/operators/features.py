"""Point-in-time features of target hours: recurrence kernels, decayed evidence, data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.math import fourier
from tidemark.functions.time import HOUR_US, circular_distance, decay, exposure, floor_hour, hour_of_week, hours_between, micros
from tidemark.operators.intervals import asof_join, overlapping_hours
from tidemark.operators.training import hourly_decay

#: Targets that are sent to every task at most; each is two numbers.
BROADCAST_ROWS = 100_000


def _bell(distance: Column) -> Column:
    return F.exp(-0.5 * distance * distance)


def recurrence(targets: DataFrame, outcomes: DataFrame, target: str, occurred: str) -> DataFrame:
    """``targets`` with renewal, daily, weekly and combined kernels of the outcomes' midpoints.

    renewal compares the logarithm of the age of the last outcome with those of past gaps; daily
    and weekly compare the time of day (deviation 6 h) and of week (36 h).  Without outcomes, or
    with a last one after the target, what needs it is 0.

    Targets are few (a horizon).  Outcomes are summed up by minute of the week, which they count
    in, and gaps are found day by day, the first of a day from the day before; each gap meets the
    targets where it is, in partial averages.
    """
    few = targets.select(target, (micros(F.col(target)) / F.lit(float(HOUR_US))).alias("__at")).distinct()
    small = F.broadcast if few.count() <= BROADCAST_ROWS else (lambda df: df)
    times = outcomes.select(F.col(occurred).alias("__t"), F.date_trunc("day", occurred).alias("__day"))
    days = times.groupBy("__day").agg(F.max("__t").alias("__last"))
    last_before = F.max("__last").over(Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1))  # a row a day
    days = days.select("__day", last_before.alias("__before"))
    own = Window.partitionBy("__day").orderBy("__t")
    with_gaps = times.join(days, "__day").withColumn("__from", F.coalesce(F.lag("__t").over(own), "__before"))
    gaps = with_gaps.filter("__from is not null").select(((micros(F.col("__t")) - micros(F.col("__from"))) / F.lit(float(HOUR_US))).alias("__gap"))
    last = times.agg((micros(F.max("__t")) / F.lit(float(HOUR_US))).alias("__last"))
    aged = few.crossJoin(F.broadcast(last)).withColumn("__age", F.col("__at") - F.col("__last")).filter("__age >= 0")  # a single row
    renewal = gaps.crossJoin(small(aged)).groupBy(target).agg(F.avg(_bell(F.log1p("__age") - F.log1p("__gap"))).alias("renewal"))
    # hour 0 of the epoch was a Thursday, 72 hours after a Monday
    minute = F.pmod(F.floor(micros(F.col("__t")) / 60_000_000 + 1e-6) + 72 * 60, F.lit(168 * 60))
    weekly = times.groupBy((minute / 60).alias("__m")).agg(F.count(F.lit(1)).alias("__k"))  # at most 10,080 rows
    week = F.pmod(F.col("__at") + 72, F.lit(168.0))
    near = {"daily": _bell(circular_distance(week % 24, F.col("__m") % 24, 24) / 6), "weekly": _bell(circular_distance(week, F.col("__m"), 168) / 36)}
    kernels = weekly.crossJoin(small(few)).groupBy(target).agg(*[(F.sum(F.col("__k") * k) / F.sum("__k")).alias(n) for n, k in near.items()])
    out = targets.join(renewal, target, "left").join(kernels, target, "left")
    out = out.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in ("renewal", "daily", "weekly")})
    return out.withColumn("combined", F.col("renewal") + F.col("daily") + 0.5 * F.col("weekly"))


def decayed(targets: DataFrame, evidence: DataFrame, target: str, time: str, incident: Column, rival: Column, days: int = 14) -> DataFrame:
    """``targets`` (full hours) with incident (sum, half-life 24 h) and rival (maximum, 36 h) of evidence at most ``days`` old.

    The sum comes from hourly sums, as decay is linear; the maximum from the last rival before the
    target alone, as nothing decays less.  Evidence counts from the moment after it on.
    """
    sums = hourly_decay(evidence.filter(incident), [], time, 24.0, days * 24).withColumnsRenamed({"slot": target, "decayed": "incident_decay"})
    last = evidence.filter(rival).groupBy(floor_hour(F.col(time))).agg(F.max(time).alias("__rival")).select("__rival")
    out = asof_join(targets.join(sums, target, "left"), last, [], target, "__rival", ["__rival"], bucket="day")
    age = hours_between(F.col(target), F.col("__rival"))
    rival_decay = F.when(age <= days * 24, decay(age, 36)).otherwise(0.0)
    return out.withColumns({"incident_decay": F.coalesce("incident_decay", F.lit(0.0)), "rival_decay": F.coalesce(rival_decay, F.lit(0.0))}).drop("__rival")


def calendar(df: DataFrame, target: str) -> DataFrame:
    """Three weekly and two daily harmonics of the target hour."""
    names = [f"weekly_{f}_{k}" for k in (1, 2, 3) for f in ("sin", "cos")] + [f"daily_{f}_{k}" for k in (1, 2) for f in ("sin", "cos")]
    waves = fourier(hour_of_week(F.col(target)), 168, (1, 2, 3)) + fourier(F.hour(F.col(target)), 24, (1, 2))
    return df.withColumns(dict(zip(names, waves, strict=True)))


def asserted_overlap(targets: DataFrame, ranges: DataFrame, target: str, start: str, end: str, weight: str, most_hours: float = 48.0) -> DataFrame:
    """``targets`` (full hours) with asserted: the weights of the ranges that touch the hour, each by the share of the hour that it covers.

    Ranges of more than ``most_hours`` say too little and are left out, so that none reaches many hours.
    """
    length = hours_between(F.col(end), F.col(start))
    hours = overlapping_hours(ranges.filter((length > 0) & (length <= most_hours)), start, end, target)
    share = exposure(F.col(target), F.col(target) + F.expr("interval 1 hour"), F.col(start), F.col(end))
    sums = hours.groupBy(target).agg(F.sum(F.col(weight) * share).alias("asserted"))
    return targets.join(sums, target, "left").withColumn("asserted", F.coalesce("asserted", F.lit(0.0)))


#: The features of a target hour, in the order in which a model takes them.
VECTOR = (*(f"weekly_{f}_{k}" for k in (1, 2, 3) for f in ("sin", "cos")), *(f"daily_{f}_{k}" for k in (1, 2) for f in ("sin", "cos")), "combined", "asserted", "incident_decay", "rival_decay")


def data_quality(delay_hours: Column, outcomes: Column, health: Column) -> Column:
    """coverage by delay (1, 0.8, 0.4, 0.1), sample sufficiency out of 20, and whether the target is out of distribution."""
    coverage = F.when(delay_hours <= 2, 1.0).when(delay_hours <= 6, 0.8).when(delay_hours <= 24, 0.4).otherwise(0.1)
    odd = (outcomes < 20) | (delay_hours > 6) | (F.coalesce(health, coverage) < 0.5)
    return F.struct(coverage.alias("coverage"), F.round(F.least(delay_hours, F.lit(168.0)) * 3600).cast("long").alias("max_delay_seconds"), F.least(F.lit(1.0), outcomes / F.lit(20.0)).alias("sample_sufficiency"), odd.alias("out_of_distribution"))
