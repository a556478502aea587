"""Coverage: who vouches for which time, as known when; labels that follow it as revisions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.time import HOUR_US, micros
from tidemark.operators.intervals import asof_join, merge_intervals
from tidemark.operators.revisions import MODES, as_of_cutoffs

# Fixed value: the adequacy that lets an interval without outcomes count as negative.
ELIGIBLE = "negative_label_eligible"


def assertion_available(mode: str, asserted: Column, replay: Column, attested: Column, start: Column, declared: Column) -> Column:
    """When an assertion could be known.

    Live: when it was made.  In an archive replay an attested earlier time counts; in a synthetic
    one a declared first revision is known from its start on.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode == "archive_replay":
        return F.when(replay.isNotNull() & attested, replay).otherwise(asserted)
    return F.when(declared, start).otherwise(asserted) if mode == "synthetic_replay" else asserted


def adequate_as_of(assertions: DataFrame, cutoffs: DataFrame, available: str = "available_at") -> DataFrame:
    """For each cutoff the latest known revision of each assertion, if it is eligible and not revoked.

    The filter follows the choice: a revoking revision hides the eligible one before it.
    """
    known = as_of_cutoffs(assertions, cutoffs, ["assertion_id"], available, created=None)
    return known.filter((F.col("adequacy") == ELIGIBLE) & ~F.coalesce("revoked", F.lit(False)))


def covered_as_of(assertions: DataFrame, cutoffs: DataFrame, keys: Sequence[str], available: str = "available_at") -> DataFrame:
    """The merged intervals (start, end) that adequate assertions cover at each cutoff."""
    return merge_intervals(adequate_as_of(assertions, cutoffs, available), ["cutoff", *keys], "start", "end").drop("n")


def assertion_faults(row: Mapping[str, Column]) -> Column:
    """What keeps an assertion (start, end, asserted_at, replay_available_at, adequacy, evidence_hash, exhausted_at) from being accepted; empty: nothing."""
    eligible = row["adequacy"] == ELIGIBLE
    replay = row["replay_available_at"]
    rules = {
        "interval_empty": row["start"] >= row["end"],
        "ends_after_assertion": row["end"] > row["asserted_at"],
        "unknown_adequacy": ~row["adequacy"].isin(ELIGIBLE, "outcome_only"),
        "replay_time_out_of_bounds": replay.isNotNull() & (~eligible | (replay < row["end"]) | (replay > row["asserted_at"])),
        "completeness_evidence_missing": eligible & ~F.coalesce(row["evidence_hash"].rlike("^sha256:[a-f0-9]{64}$") & (row["exhausted_at"] >= row["end"]) & (row["exhausted_at"] <= row["asserted_at"]), F.lit(False)),
    }
    return reasons(rules)


def reasons(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that hold, in their order; a rule that is null does not."""
    return F.array_compact(F.array(*[F.when(F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()]))


def append_assertions(incoming: DataFrame, key: str, signature: str, asserted: str, tie: str) -> DataFrame:
    """Revisions of each key's assertions in the order in which they were made.

    One with the same signature as the revision before adds nothing; one that was made earlier
    than it is out of order.  outcome: appended, unchanged or out_of_order; revision: of those
    appended.  ``incoming`` is taken in order of ``tie``, the order of arrival.
    """
    arrival = Window.partitionBy(key).orderBy(tie)
    # a row is late where some earlier one of its key was made after it; late rows change nothing
    late = F.coalesce(F.max(asserted).over(arrival.rowsBetween(Window.unboundedPreceding, -1)) > F.col(asserted), F.lit(False))
    marked = incoming.withColumn("__late", late)
    before = F.last(F.when(~F.col("__late"), F.col(signature)), ignorenulls=True).over(arrival.rowsBetween(Window.unboundedPreceding, -1))
    outcome = F.when(F.col("__late"), "out_of_order").when(before.eqNullSafe(F.col(signature)), "unchanged").otherwise("appended")
    judged = marked.withColumn("outcome", outcome)
    number = F.sum((F.col("outcome") == "appended").cast("int")).over(arrival.rowsBetween(Window.unboundedPreceding, 0))
    return judged.withColumn("revision", F.when(F.col("outcome") == "appended", number.cast("int"))).drop("__late")


def verified_evidence(assertions: DataFrame, blobs: DataFrame, ref: str, digest: str) -> DataFrame:
    """``assertions``, revoked where the evidence they name is missing or has another hash (blobs: ref, content)."""
    found = blobs.select(F.col("ref").alias(ref), F.concat(F.lit("sha256:"), F.sha2(F.col("content").cast("binary"), 256)).alias("__hash"))
    bad = F.col("__hash").isNull() | (F.col("__hash") != F.col(digest))
    checked = assertions.join(found, ref, "left")
    return checked.withColumn("revoked", F.coalesce("revoked", F.lit(False)) | bad).drop("__hash")


def cover_gaps(windows: DataFrame, intervals: DataFrame, on: Sequence[str], window_range: tuple[str, str], interval_range: tuple[str, str]) -> DataFrame:
    """``windows`` with covered: whether intervals that follow each other without a gap hold the whole window.

    Touching intervals are one; an empty window is covered by nothing.
    """
    (ws, we), (s, e) = window_range, interval_range
    islands = merge_intervals(intervals.select(*on, s, e), on, s, e).select(*on, F.col(s).alias("__s"), F.col(e).alias("__e"))
    found = asof_join(windows, islands, on, ws, "__s", ["__e"], strict=False)
    return found.withColumn("covered", F.coalesce((F.col("__e") >= F.col(we)) & (F.col(we) > F.col(ws)), F.lit(False))).drop("__e")


def matured_days(sightings: DataFrame, keys: Sequence[str], day: str, seen: str, ledger: str, close_hours: float = 36.0, stable_hours: float = 6.0) -> DataFrame:
    """status of each sighting of a day's ledger (its hash): early, candidate, eligible or revoked.

    A sighting counts from ``close_hours - stable_hours`` after the day's end on.  A hash that was
    first seen, without another one in between, at least ``stable_hours`` before makes the day
    eligible, once ``close_hours`` have passed since its end; a change after that revokes it and
    begins a new candidate.
    """
    ended = micros((F.col(day).cast("timestamp_ntz") + F.expr("interval 1 day")))
    at = micros(F.col(seen))
    counted = at >= ended + int((close_hours - stable_hours) * HOUR_US)
    w = Window.partitionBy(*keys, day).orderBy(seen, ledger)
    rows = sightings.withColumn("__counted", counted)
    changed = F.col("__counted") & ~F.lag(F.when(F.col("__counted"), F.col(ledger))).over(w).eqNullSafe(F.col(ledger))
    rows = rows.withColumn("__changed", changed).withColumn("__run", F.sum(F.col("__changed").cast("int")).over(w))
    first = F.min(F.when(F.col("__counted"), at)).over(Window.partitionBy(*keys, day, "__run"))
    stable = F.col("__counted") & (at - first >= int(stable_hours * HOUR_US)) & (at >= ended + int(close_hours * HOUR_US))
    rows = rows.withColumn("__stable", stable)
    was = F.coalesce(F.lag("__stable").over(w), F.lit(False))
    status = F.when(~F.col("__counted"), "early").when(F.col("__changed") & was, "revoked").when(F.col("__stable"), "eligible").otherwise("candidate")
    return rows.withColumn("status", status).drop("__counted", "__changed", "__run", "__stable")


def recheck_times(candidates: DataFrame, day: str, first_seen: str, close_hours: float = 36.0, stable_hours: float = 6.0) -> DataFrame:
    """recheck_at: the earliest time at which a candidate day can become eligible."""
    stable = micros(F.col(first_seen)) + int(stable_hours * HOUR_US)
    closed = micros(F.col(day).cast("timestamp_ntz") + F.expr("interval 1 day")) + int(close_hours * HOUR_US)
    return candidates.withColumn("recheck_at", F.timestamp_micros(F.greatest(stable, closed)).cast("timestamp_ntz"))


def attestation_reasons(row: Mapping[str, Column], target: Column, required: Column, start: Column, end: Column, now: Column, pinned: Column) -> Column:
    """Why an attestation (hash, target, identities, valid_from, valid_to, expires_at) does not vouch for a whole poll of [start, end); empty: it does."""
    return reasons(
        {
            "attestation_missing": row["hash"].isNull(),
            "hash_not_pinned": row["hash"] != pinned,
            "target_mismatch": row["target"] != target,
            "identities_missing": F.size(F.array_except(required, row["identities"])) > 0,
            "interval_not_contained": (row["valid_from"] > start) | (row["valid_to"] < end),
            "attestation_expired": row["expires_at"] <= now,
        }
    )


def replay_backdating(first: Column, direct: Column, published: Column, seen: Column, recorded: Column, most_hours: float = 1.0) -> Column:
    """The published time, where a first, direct record may be known from then on in replays.

    Its clocks have to agree: published, seen and recorded in this order, each at most
    ``most_hours`` after the one before.
    """
    most = int(most_hours * HOUR_US)
    a, b, c = micros(published), micros(seen), micros(recorded)
    return F.when(first & direct & (a <= b) & (b <= c) & (b - a <= most) & (c - b <= most), published)


def label_at(windows: DataFrame, end: str, cutoff: Column, hit: Column, unclear: Column, covered: Column) -> DataFrame:
    """status of each window at a cutoff: pending, positive, censored or negative, in this order of tests."""
    status = F.when(F.col(end) > cutoff, "pending").when(hit, "positive").when(unclear, "censored").when(covered, "negative").otherwise("censored")
    return windows.withColumn("status", status)


def decision_revisions(decisions: DataFrame, keys: Sequence[str], order: str, decision: Sequence[str]) -> DataFrame:
    """The decisions that differ from the one before of their key, numbered as revisions, with what they retract."""
    w = Window.partitionBy(*keys).orderBy(order)
    same = F.lit(True)
    for c in decision:
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    marked = decisions.withColumns({"__first": F.lag(order).over(w).isNull(), "__same": same})
    kept = marked.filter(F.col("__first") | ~F.col("__same")).drop("__first", "__same")
    return kept.withColumns({"revision": F.row_number().over(w), "retracts": F.lag(decision[0]).over(w)})
