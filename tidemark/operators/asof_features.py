"""The whole feature vector of many target hours, each from what was known at its own cutoff.

Evidence is never paired with targets row by row.  It is summed up by cells first: the hour it
happened in, the hours between which it was known, and the outcome before it.  Cells grow with
hours and with the delays that occur, not with rows.  Targets of one key, slot and cutoff are one
case, unless an own outcome that was known by then sets them apart: a case's history is weighed
once, over outcomes that are put in order once a cutoff, so that pairs grow with outcomes times
hours.  Only what a target's own group takes from its case is found target by target.

Cutoffs and slots are full hours.  Rows without a key, time or first hour of being known say
nothing and fall away; a key without evidence or outcomes has features of 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.time import HOUR_US, circular_distance, exposure, floor_hour, hours_between, micros, midpoint
from tidemark.operators import features
from tidemark.operators.intervals import asof_join, overlapping_hours
from tidemark.session import stored


@dataclass(frozen=True)
class Carryover:
    """What evidence from before the latest known outcome still weighs, and whether that outcome's own source is used up."""

    before: float = 0.5
    consume_lineage: bool = True


#: Most days that evidence counts for, and the half-lives in hours of incidents and rivals.
DAYS, INCIDENT_HALF_LIFE, RIVAL_HALF_LIFE = 14, 24.0, 36.0

_MAX = 2**62


def _hour(ts: Column) -> Column:
    """Number of the first full hour at or after a time."""
    return F.ceil(micros(ts) / HOUR_US)


def _decay(hours: Column, half_life: float) -> Column:
    return F.pow(F.lit(2.0), -hours / F.lit(half_life))


def contexts(targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys, slot, cutoff, own_outcome and own_group, with __row, which names them."""
    names = [*keys, "slot", "cutoff", "own_outcome", "own_group"]
    return targets.select(*names).distinct().withColumn("__row", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))


def _known() -> Column:
    return (F.col("visible_from") <= F.col("cutoff")) & F.coalesce(F.col("visible_to") > F.col("cutoff"), F.lit(True))


def _cases(rows: DataFrame, outcomes: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with __case, and the cases: __case, keys, slot, cutoff and own_outcome, which only a case has that would know it."""
    name = [*keys, "slot", "cutoff", "own_outcome"]
    versions = outcomes.select(*keys, F.col("outcome_id").alias("own_outcome"), "visible_from", "visible_to")
    known = rows.join(versions, [*keys, "own_outcome"]).filter(_known()).select("__row", F.lit(True).alias("__self")).distinct()
    kept = rows.join(known, "__row", "left").withColumn("__own", F.when(F.col("__self"), F.col("own_outcome"))).drop("__self")
    named = kept.withColumn("__name", F.to_json(F.struct(*keys, "slot", "cutoff", F.col("__own").alias("own_outcome")), {"ignoreNullFields": "false"}))
    cases = named.select("__name", *keys, "slot", "cutoff", F.col("__own").alias("own_outcome")).distinct()
    cases = stored(cases.withColumn("__case", F.monotonically_increasing_id()), "cases")
    return named.join(cases.select("__name", "__case"), "__name").drop("__name", "__own"), cases.select("__case", *name)


def outcome_history(rows: DataFrame, outcomes: DataFrame, keys: Sequence[str], case: str = "__row") -> DataFrame:
    """By ``case``: renewal, daily, weekly and combined kernels of the outcomes known then, and end (anchor) and group (lineage) of the latest whose midpoint is before the slot.

    ``outcomes``: keys, outcome_id, group, from_, to, visible_from, visible_to.  The row's own
    outcome is left out.  Outcomes are ordered by their start, then their id; a later start with an
    earlier midpoint makes a gap of 0.  Cases of one cutoff share the order.
    """
    timed = outcomes.filter("from_ is not null and to is not null").withColumn("__mid", midpoint(F.col("from_"), F.col("to")))
    named = rows.select(case, *keys, "slot", "cutoff", "own_outcome").withColumn("__name", F.to_json(F.struct(*keys, "cutoff", "own_outcome"), {"ignoreNullFields": "false"}))
    sets = stored(named.select("__name", *keys, "cutoff", "own_outcome").distinct().withColumn("__set", F.monotonically_increasing_id()), "sets")
    asked = named.join(sets.select("__name", "__set"), "__name").select("__set", case, "slot")
    other = F.coalesce(F.col("outcome_id") != F.col("own_outcome"), F.lit(True))
    met = sets.drop("__name").join(timed, list(keys)).filter(_known() & other).select("__set", "from_", "outcome_id", "to", "group", "__mid")
    ordered = Window.partitionBy("__set").orderBy("from_", "outcome_id")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pairs = met.withColumns({"__before": F.lag("__mid").over(ordered), "__last": F.last("__mid").over(whole)}).join(asked, "__set")
    age, gap = hours_between(F.col("slot"), F.col("__last")), F.greatest(hours_between(F.col("__mid"), F.col("__before")), F.lit(0.0))

    def bell(distance: Column) -> Column:
        return F.exp(-0.5 * distance * distance)

    def of_day(ts: Column) -> Column:
        return F.hour(ts) + F.minute(ts) / F.lit(60.0)

    def of_week(ts: Column) -> Column:
        return F.weekday(ts) * 24 + of_day(ts)

    slot, mid = F.col("slot"), F.col("__mid")
    renewal = F.avg(F.when((age >= 0) & F.col("__before").isNotNull(), bell(F.log1p(age) - F.log1p(gap))))
    latest = F.max(F.when(mid < slot, F.struct("from_", "outcome_id", F.col("to").alias("anchor"), F.col("group").alias("lineage"))))
    out = pairs.groupBy(case).agg(F.coalesce(renewal, F.lit(0.0)).alias("renewal"), F.avg(bell(circular_distance(of_day(slot), of_day(mid), 24) / 6)).alias("daily"), F.avg(bell(circular_distance(of_week(slot), of_week(mid), 168) / 36)).alias("weekly"), latest.alias("__latest"))
    out = out.withColumn("combined", F.col("renewal") + F.col("daily") + 0.5 * F.col("weekly"))
    return out.select(case, "renewal", "daily", "weekly", "combined", "__latest.anchor", "__latest.lineage")


def _cells(evidence: DataFrame, anchors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Evidence with __hour, __last (hours from and to which it counts), __known, __gone (hours between which it is known) and __epoch (the anchor at or before it)."""
    some = evidence.filter("time is not null and visible_from is not null")
    dated = asof_join(some, anchors, keys, "time", "anchor", ["anchor"], strict=False, bucket="day").withColumnRenamed("anchor", "__epoch")
    hour = _hour(F.col("time"))
    sharp = micros(F.col("time")) == hour * HOUR_US
    last = F.floor(micros(F.col("time")) / HOUR_US) + DAYS * 24
    return dated.withColumns({"__hour": hour, "__last": F.when(sharp, hour + DAYS * 24).otherwise(last), "__known": _hour(F.col("visible_from")), "__gone": F.coalesce(_hour(F.col("visible_to")), F.lit(_MAX))})


def _met(cells: DataFrame, rows: DataFrame, keys: Sequence[str], first: str, last: str) -> DataFrame:
    """Each cell beside the rows whose slot it reaches and whose cutoff knows it, with __share: what the carryover leaves of it.

    Where the keys have the group, its few cells meet its own rows; else cells go to each slot that they reach.
    """
    asked = rows.withColumns({"__slot": F.floor(micros(F.col("slot")) / HOUR_US), "__cut": F.floor(micros(F.col("cutoff")) / HOUR_US)})
    if "group" in keys:
        both = cells.join(asked, list(keys)).filter(F.col("__slot").between(F.greatest(first, "__known"), F.col(last)))
    else:
        low = F.greatest(first, "__known")
        both = cells.withColumn("__slot", F.explode(F.when(low <= F.col(last), F.sequence(low, last)))).join(asked, [*keys, "__slot"])
    return both.filter((F.col("__known") <= F.col("__cut")) & (F.col("__cut") < F.col("__gone")))


def _share(carryover: Carryover) -> Column:
    older = F.col("anchor").isNotNull() & (F.col("__epoch").isNull() | (F.col("__epoch") < F.col("anchor")))
    return F.when(older, F.lit(carryover.before)).otherwise(F.lit(1.0))


def _sums(cells: DataFrame, rows: DataFrame, keys: Sequence[str], carryover: Carryover, by: str) -> DataFrame:
    """By ``by``: incident_decay and asserted, both linear in evidence, so that what comes from one group can be taken off."""
    life = ["__known", "__gone", "__epoch"]
    fresh = _decay((F.col("__hour") * HOUR_US - micros(F.col("time"))) / F.lit(float(HOUR_US)), INCIDENT_HALF_LIFE)
    incidents = cells.filter("incident").groupBy(*keys, "__hour", "__last", *life).agg(F.sum(fresh).alias("__sum"))
    decayed = _met(incidents, rows, keys, "__hour", "__last").select(by, (F.col("__sum") * _decay(F.col("__slot") - F.col("__hour"), INCIDENT_HALF_LIFE) * _share(carryover)).alias("incident_decay"), F.lit(0.0).alias("asserted"))
    spans = cells.filter("start < end and weight is not null").groupBy(*keys, F.floor(micros(F.col("start")) / HOUR_US).alias("__from"), F.floor((micros(F.col("end")) - 1) / HOUR_US).alias("__to"), *life).agg(F.sum("weight").alias("__sum"))
    touched = _met(spans, rows, keys, "__from", "__to").select(by, F.lit(0.0).alias("incident_decay"), (F.col("__sum") * _share(carryover)).alias("asserted"))
    return decayed.unionByName(touched).groupBy(by).agg(F.sum("incident_decay").alias("incident_decay"), F.sum("asserted").alias("asserted"))


def _nearest_rivals(cells: DataFrame, cases: DataFrame, keys: Sequence[str], carryover: Carryover) -> DataFrame:
    """By __case: rival_decay, the greatest of what is left of a rival of another group than lineage, rival_group, and rival_other, the greatest of any other group than that.

    As two groups at most are left out, own and lineage, the last rivals of three groups speak for a cell.
    """
    cell = [*keys, "__hour", "__last", "__known", "__gone", "__epoch"]
    latest = cells.filter("rival").groupBy(*cell, "group").agg(F.max("time").alias("time"))
    ranked = latest.withColumn("__n", F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc("time"), "group"))).filter("__n <= 3").drop("__n")
    met = _met(ranked, cases, keys, "__hour", "__last")
    if carryover.consume_lineage:
        met = met.filter(F.coalesce(F.col("group") != F.col("lineage"), F.lit(True)))
    left = _decay(hours_between(F.col("slot"), F.col("time")), RIVAL_HALF_LIFE) * _share(carryover)
    met = met.select("__case", "group", left.alias("__left"))
    first = met.groupBy("__case").agg(F.max(F.struct("__left", "group")).alias("__first")).select("__case", F.col("__first.__left").alias("rival_decay"), F.col("__first.group").alias("rival_group"))
    others = met.join(first, "__case").filter(F.coalesce(F.col("group") != F.col("rival_group"), F.lit(True))).groupBy("__case").agg(F.max("__left").alias("rival_other"))
    return first.join(others, "__case", "left")


def asof_vectors(targets: DataFrame, evidence: DataFrame, outcomes: DataFrame, keys: Sequence[str], carryover: Carryover = Carryover()) -> DataFrame:
    """``targets`` with the features of ``features.VECTOR``, each as known at the target's cutoff.

    ``targets``: keys, slot, cutoff (full hours, cutoff <= slot), own_outcome and own_group, which
    are null for plain targets; what an outcome rests on can't predict it, so both are left out.
    ``evidence``: keys, group, time, visible_from, visible_to (see ``revisions.validity``),
    incident, rival, and the asserted range start, end with its weight (null: none).
    ``outcomes``: see ``outcome_history``.
    """
    rows, cases = _cases(contexts(targets, keys), outcomes, keys)
    cases = cases.join(outcome_history(cases, outcomes, keys, "__case"), "__case", "left")
    cases = stored(cases.select("__case", *keys, "slot", "cutoff", "combined", "anchor", "lineage"), "cases")  # read several times, as are the cells
    cells = stored(_cells(evidence, cases.filter("anchor is not null").select(*keys, "anchor").distinct(), keys), "cells")
    total = _sums(cells, cases, keys, carryover, "__case")
    grouped = [*keys, "group"]

    def part(some: DataFrame, by: str) -> DataFrame:
        return _sums(cells.join(some.select(*grouped).distinct(), grouped, "left_semi"), some, grouped, carryover, by)

    whole = cases.select("__case", "combined", "lineage").join(total, "__case", "left").join(_nearest_rivals(cells, cases, keys, carryover), "__case", "left")
    if carryover.consume_lineage:
        lineage = part(cases.withColumn("group", F.col("lineage")).filter("group is not null"), "__case").withColumnsRenamed({"incident_decay": "__li", "asserted": "__la"})
        whole = whole.join(lineage, "__case", "left")
    else:
        whole = whole.withColumns({"__li": F.lit(0.0), "__la": F.lit(0.0)})
    own = rows.select("__row", "__case", F.col("own_group").alias("group")).filter("group is not null").join(cases.drop("combined"), "__case")
    if carryover.consume_lineage:
        own = own.filter(F.coalesce(F.col("group") != F.col("lineage"), F.lit(True)))  # taken off already
    mine = part(own, "__row").withColumnsRenamed({"incident_decay": "__i", "asserted": "__a"})
    out = rows.select("__row", "__case", "own_group").join(whole, "__case").join(mine, "__row", "left")

    def less(whole: str, *parts: str) -> Column:
        rest = F.coalesce(whole, F.lit(0.0))
        for x in parts:
            rest = rest - F.coalesce(x, F.lit(0.0))
        return F.greatest(rest, F.lit(0.0))  # never below 0 by rounding

    rival = F.when(F.col("own_group") == F.col("rival_group"), F.col("rival_other")).otherwise(F.col("rival_decay"))
    out = out.select("__row", F.coalesce("combined", F.lit(0.0)).alias("combined"), less("asserted", "__la", "__a").alias("asserted"), less("incident_decay", "__li", "__i").alias("incident_decay"), F.coalesce(rival, F.lit(0.0)).alias("rival_decay"))
    named = targets.withColumn("__row", F.to_json(F.struct(*keys, "slot", "cutoff", "own_outcome", "own_group"), {"ignoreNullFields": "false"}))
    return features.calendar(named.join(out, "__row").drop("__row"), "slot")


def asof_training_rows(slots: DataFrame, labels: DataFrame, evidence: DataFrame, outcomes: DataFrame, keys: Sequence[str], carryover: Carryover = Carryover()) -> DataFrame:
    """Rows of an interval-censored fit with whole vectors: kind (negative or event), slot, own_outcome, exposure, features.

    ``labels``: outcome_id, group, from_, to and ambiguous, as known when training.  An hour that
    any of them touches is no negative; an unambiguous one is an event row for each hour that it
    covers a share of, from what was known at the full hour before it began.
    """
    touched = overlapping_hours(labels.filter("from_ < to"), "from_", "to")
    quiet = slots.join(touched.select(*keys, "slot").distinct(), [*keys, "slot"], "left_anti")
    of_label = dict(labels.dtypes)
    negatives = quiet.select(*keys, "slot", F.col("slot").alias("cutoff"), F.lit(None).cast(of_label["outcome_id"]).alias("own_outcome"), F.lit(None).cast(of_label["group"]).alias("own_group"), F.lit("negative").alias("kind"), F.lit(1.0).alias("exposure"))
    share = exposure(F.col("slot"), F.col("slot") + F.expr("interval 1 hour"), F.col("from_"), F.col("to"))
    events = touched.filter(~F.col("ambiguous")).select(*keys, "slot", F.least(F.col("slot"), floor_hour(F.col("from_"))).alias("cutoff"), F.col("outcome_id").alias("own_outcome"), F.col("group").alias("own_group"), F.lit("event").alias("kind"), share.alias("exposure"))
    return asof_vectors(negatives.unionByName(events.filter("exposure > 0")), evidence, outcomes, keys, carryover)
