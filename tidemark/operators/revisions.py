"""Append-only revisions: latest ones, as of a time, exact references, appends, changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MODES = ("live", "archive_replay", "synthetic_replay")


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The row of each key with the greatest ``order``; one pass with partial aggregation."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    best = F.max_by(F.struct(*df.columns), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(columns)]))
    return df.groupBy(*keys).agg(best.alias("__row")).select("__row.*")


def available_at(mode: str, known: Column, replay: Column, revision: Column) -> Column:
    """When a row could be known: in replays an attested earlier time counts, for first revisions only."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    return known if mode == "live" else F.when((revision == 1) & replay.isNotNull(), replay).otherwise(known)


def as_of(df: DataFrame, cutoff: Column, keys: Sequence[str], available: str, revision: str = "revision", created: str | None = "created_at") -> DataFrame:
    """The greatest revision of each key among rows available by the cutoff (and, unless null, created by it)."""
    known = F.col(available) <= cutoff
    if created:
        known &= F.col(created) <= cutoff
    return latest_by(df.filter(known), keys, [revision])


def validity(df: DataFrame, keys: Sequence[str], available: str, revision: str = "revision", created: str | None = "created_at") -> DataFrame:
    """Rows with visible_from and visible_to (null: open): the times at which the row is its key's greatest known revision.

    A late, lower revision never shows.
    """
    seen = F.greatest(available, created) if created else F.col(available)
    in_time = Window.partitionBy(*keys).orderBy("visible_from", revision)
    ranked = df.withColumn("visible_from", seen).withColumn("__above", F.max(revision).over(in_time.rowsBetween(Window.unboundedPreceding, -1)))
    kept = ranked.filter(F.col("__above").isNull() | (F.col(revision) > F.col("__above"))).drop("__above")
    kept = kept.withColumn("visible_to", F.lead("visible_from").over(in_time))
    return kept.filter(F.col("visible_to").isNull() | (F.col("visible_to") > F.col("visible_from")))


def as_of_cutoffs(df: DataFrame, cutoffs: DataFrame, keys: Sequence[str], available: str, revision: str = "revision", created: str | None = "created_at") -> DataFrame:
    """As ``as_of`` for every row of ``cutoffs`` (column cutoff, distinct), in one pass over the revisions.

    The sorted cutoffs travel as one array literal column, so each revision's validity finds its
    cutoffs without a join; they are a list of points in time that the caller chose.
    """
    points = cutoffs.agg(F.array_sort(F.collect_set("cutoff")).alias("__cutoffs"))
    rows = validity(df, keys, available, revision, created).crossJoin(F.broadcast(points))  # a single row
    inside = F.filter("__cutoffs", lambda c: (c >= F.col("visible_from")) & (F.col("visible_to").isNull() | (c < F.col("visible_to"))))
    return rows.withColumn("cutoff", F.explode(inside)).drop("__cutoffs")


def exact_refs(df: DataFrame, refs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that ``refs`` (the keys and pos) name, with pos, in no particular order; unknown references fall away."""
    return refs.select("pos", *keys).join(df, list(keys))


def split_append(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """``incoming`` with outcome: insert, duplicate (equal bytes) or conflict (other bytes under the same key)."""
    known = stored.select(*keys, F.col(digest).alias("__stored"))
    outcome = F.when(F.col("__stored").isNull(), "insert").when(F.col("__stored") == F.col(digest), "duplicate").otherwise("conflict")
    return incoming.join(known, list(keys), "left").withColumn("outcome", outcome).drop("__stored")


def append_records(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """The rows to append; a conflict raises when they are written."""
    judged = split_append(incoming, stored, keys, digest)
    named = F.concat_ws("@", *[F.col(k).cast("string") for k in keys])
    checked = F.when(F.col("outcome") == "conflict", F.raise_error(F.concat(F.lit("immutable record differs: "), named)).cast("string")).otherwise(F.col("outcome"))
    return judged.withColumn("outcome", checked).filter("outcome = 'insert'").drop("outcome")


def append_or_reuse(incoming: DataFrame, stored_latest: DataFrame, key: str) -> DataFrame:
    """For each incoming key the stored latest row where there is one, else the incoming one, with reused."""
    columns = incoming.columns
    old = stored_latest.select(F.col(key), F.struct(*columns).alias("__old"))
    joined = incoming.join(old, key, "left")
    picked = [F.when(F.col("__old").isNotNull(), F.col(f"__old.{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    return joined.select(*picked, F.col("__old").isNotNull().alias("reused"))


def changed_revisions(incoming: DataFrame, latest: DataFrame, key: str, digest: str, first_seen: str) -> DataFrame:
    """Slowly changing rows: those whose digest is new, with the next revision and the first first_seen kept."""
    old = latest.select(key, F.col(digest).alias("__digest"), F.col("revision").alias("__revision"), F.col(first_seen).alias("__first"))
    joined = incoming.drop("revision").join(old, key, "left")
    changed = joined.filter(F.col("__digest").isNull() | (F.col("__digest") != F.col(digest)))
    next_ = (F.coalesce("__revision", F.lit(0)) + 1).cast("int")
    return changed.withColumn("revision", next_).withColumn("supersedes", F.col("__revision").cast("int")).withColumn(first_seen, F.coalesce("__first", first_seen)).drop("__digest", "__revision", "__first")


def retain(df: DataFrame, refs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(refs.select(*keys).distinct(), list(keys), "left_semi")


def current_then_filter(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], eligible: Column) -> DataFrame:
    """The current row of each key, if eligible: a newer ineligible row hides an older eligible one."""
    return latest_by(df, keys, order).filter(eligible)


#: References that a task compares, about.  Shuffled ids are so small that adaptive execution, which goes by bytes, would put many millions into one.
REFS_TOGETHER = 500_000


def unresolved(refs: DataFrame, targets: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct references that name nothing; ``refs`` are dealt over tasks by their counted rows."""
    parts = 1 + refs.count() // REFS_TOGETHER
    return refs.select(*on).repartition(parts, *on).distinct().join(targets.select(*on), list(on), "left_anti")


def version_key(version: Column) -> Column:
    """Sort key of a dotted version: its numbers, not its characters, count."""
    return F.transform(F.split(version, r"[^0-9]+"), lambda x: F.coalesce(x.try_cast("int"), F.lit(-1)))


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in the given order; the others are pruned."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("__n") <= n).drop("__n")
