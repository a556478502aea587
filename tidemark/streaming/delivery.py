"""What goes out: rings of inputs, pages after cursors, retries, an outbox, and the changes that are published."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.time import from_micros, micros


def event_key(kind: Column, entity: Column, source: Column, policy: Column) -> Column:
    """Identity of a publication: what happened to what, from which source revision, under which policy."""
    return F.concat(F.lit("pub_"), F.substring(F.sha2(F.concat_ws("\x1f", kind, entity, source, policy), 256), 1, 24))


def delivery_key(kind: Column, entity: Column, meaning: Column) -> Column:
    """Key under which a publication goes out once: its meaning, whatever the revision or policy behind it."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\x1f", kind, entity, F.coalesce(meaning, F.lit("\x00"))), 256))


def input_ring(inputs: DataFrame, arrival: str, key: str, keep: int, parts: int = 64) -> DataFrame:
    """The last ``keep`` inputs with their sequence; one that repeats the key of the input before is none.

    Inputs are dealt into ``parts`` by quantiles of their arrival (a number); the last key of a
    part is carried into the next one, and the parts' counts give each its first number.
    """
    edges = inputs.agg(F.percentile_approx(arrival, F.array(*[F.lit(k / parts) for k in range(1, parts)]), 1000).alias("__edges"))
    rows = inputs.crossJoin(F.broadcast(edges))  # a single row
    rows = rows.withColumn("__part", F.size(F.filter("__edges", lambda e: e < F.col(arrival)))).drop("__edges")
    own, between = Window.partitionBy("__part").orderBy(arrival), Window.orderBy("__part")  # at most ``parts`` rows
    ends = rows.groupBy("__part").agg(F.max_by(key, arrival).alias("__end")).select("__part", F.lag("__end").over(between).alias("__left"))
    marked = rows.join(F.broadcast(ends), "__part").withColumn("__was", F.coalesce(F.lag(key).over(own), F.when(F.row_number().over(own) == 1, F.col("__left"))))
    new = marked.filter(F.col("__was").isNull() | (F.col("__was") != F.col(key))).withColumn("__n", F.row_number().over(own))
    counts = new.groupBy("__part").agg(F.count(F.lit(1)).alias("__c"))
    firsts = counts.select("__part", F.coalesce(F.sum("__c").over(between.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"), F.sum("__c").over(Window.partitionBy()).alias("__total"))
    numbered = new.join(F.broadcast(firsts), "__part").withColumn("sequence", (F.col("__first") + F.col("__n")).cast("long"))
    return numbered.filter(F.col("sequence") > F.col("__total") - keep).select(*inputs.columns, "sequence")


def input_page(ring: DataFrame, sequence: str, after: int, limit: int) -> DataFrame:
    """One page of a ring after a cursor with its status; ahead_of_tail or retention_gap come as one row without a sequence."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    bounds = ring.agg(F.min(sequence).alias("lo"), F.max(sequence).alias("hi"))
    status = F.when(F.lit(after) > F.col("hi"), "ahead_of_tail").when(F.lit(after) < F.col("lo") - 1, "retention_gap").otherwise("ok")
    page = ring.filter(F.col(sequence) > after).orderBy(sequence).limit(limit)
    return bounds.select(status.alias("status")).join(page, F.col("status") == "ok", "left")  # a row beside at most ``limit``


def alert_page(alerts: DataFrame, number: str, after: int, limit: int, durable: int) -> DataFrame:
    """One page of alerts after a cursor, of those that are stored for good (numbers up to ``durable``)."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    return alerts.filter((F.col(number) > after) & (F.col(number) <= durable)).orderBy(number).limit(limit)


def retry_decision(code: Column, attempts: Column, now: Column, base_seconds: float, most_seconds: float, most_attempts: int) -> Column:
    """action and at: done, delete (the address is gone), retry with doubled waits, or disable; code 0 is no answer."""
    again = code.isin(0, 429) | (code >= 500)
    wait = F.least(F.lit(float(most_seconds)), base_seconds * F.pow(F.lit(2.0), attempts - 1))
    action = F.when(code.between(200, 299), "done").when(code.isin(404, 410), "delete").when(again & (attempts < most_attempts), "retry").otherwise("disable")
    return F.struct(action.alias("action"), F.when(action == "retry", from_micros(micros(now) + F.round(wait * 1e6).cast("long"))).alias("at"))


def outbox(jobs: DataFrame, arrival: str, keys: Sequence[str] = ("id", "semantic_key")) -> DataFrame:
    """Jobs as they enter an outbox: the first of each id, and of those the first of each semantic key."""
    for key in keys:
        first = Window.partitionBy(key).orderBy(arrival)
        jobs = jobs.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    return jobs


def streamed_outbox(jobs: DataFrame, time: str, late: str, keys: Sequence[str] = ("id", "semantic_key")) -> DataFrame:
    """The same over a stream; keys are forgotten once the watermark has passed them."""
    jobs = jobs.withWatermark(time, late)
    for key in keys:
        jobs = jobs.dropDuplicatesWithinWatermark([key])
    return jobs


def publication_changes(states: DataFrame, keys: Sequence[str], time: str, tie: str, status: str, row: str) -> DataFrame:
    """What is published as an outcome's status changes: confirmed, corrected (another row), retracted or withdrawn.

    A pending status says nothing; what is taken back must have been confirmed.
    """
    before = Window.partitionBy(*keys).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, -1)
    said = F.when(F.col(status) != "pending", F.struct(F.col(status).alias("s"), F.col(row).alias("r")))
    rows = states.withColumn("__last", F.last(said, ignorenulls=True).over(before))
    was = F.coalesce(F.col("__last.s") == "confirmed", F.lit(False))
    kind = (
        F.when((F.col(status) == "confirmed") & ~was, "confirmed")
        .when((F.col(status) == "confirmed") & ~F.col("__last.r").eqNullSafe(F.col(row)), "corrected")
        .when(F.col(status).isin("retracted", "withdrawn") & was, F.col(status))
    )
    return rows.withColumn("kind", kind).filter("kind is not null").drop("__last")


def watch_changes(values: DataFrame, keys: Sequence[str], time: str, tie: str, value: str, opens: float, closes: float) -> DataFrame:
    """opened and closed: where a watch with hysteresis changes; a key's first value is its silent baseline."""
    order = Window.partitionBy(*keys).orderBy(time, tie)
    mark = F.when(F.col(value) >= opens, 1).when(F.col(value) <= closes, 0)
    rows = values.withColumn("__on", F.coalesce(F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    rows = rows.withColumn("__was", F.lag("__on").over(order))
    changed = rows.filter(F.col("__was").isNotNull() & (F.col("__was") != F.col("__on")))
    return changed.withColumn("change", F.when(F.col("__on") == 1, "opened").otherwise("closed")).drop("__on", "__was")
