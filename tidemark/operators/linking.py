"""Evidence brought together: which signal speaks for an observation, which updates are one, which cluster goes on which earlier one."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.functions.text import DISTINCTIVE
from tidemark.functions.time import HOUR_US, micros
from tidemark.operators.identity import claims
from tidemark.operators.revisions import latest_by
from tidemark.session import stored


def speaking_signals(signals: DataFrame, observation: str, observation_revision: str, eligible: Column, direct: Column, official: Column, available: str, tie: str, at: Column) -> DataFrame:
    """The signal that speaks for each observation at a time.

    Of the eligible ones known by then: that of the last observation revision; then a direct one,
    an official one, the last available one, the one of the smallest ``tie``.
    """
    known = signals.filter(eligible & (F.col(available) <= at))
    return latest_by(known, [observation], [F.col(observation_revision), direct.cast("int"), official.cast("int"), F.col(available), -F.col(tie)])


def collapsed_updates(signals: DataFrame, group: str, signature: Sequence[str], time: str, tie: str, tokens: str) -> DataFrame:
    """Each group of dependent evidence as one row: its updates (equal ones once, at their first time), tokens, first and last update.

    anchor_tie is the tie of the first update, signal_tie of the last; two aggregations, the
    second over what the first left.
    """
    one = signals.groupBy(group, *signature).agg(F.min(F.struct(time, tie)).alias("u"), F.array_distinct(F.flatten(F.collect_set(tokens))).alias("t"))
    out = one.groupBy(group).agg(F.min("u").alias("a"), F.max("u").alias("b"), F.count(F.lit(1)).alias("n_updates"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("t")))).alias(tokens))
    return out.select(group, F.col(f"a.{time}").alias("first_at"), F.col(f"b.{time}").alias("last_at"), F.col(f"a.{tie}").alias("anchor_tie"), F.col(f"b.{tie}").alias("signal_tie"), "n_updates", tokens)


@dataclass
class _Cluster:
    name: object
    category: str
    surfaces: set
    tokens: set
    last: int
    wild: bool = False


def _score(c: _Cluster, category: str, surfaces: set, tokens: set, followup: bool, distinctive: frozenset) -> int:
    """4: same category, a common surface and topic; 1: a follow-up on a common surface; else -1."""
    common = c.wild or "unknown" in surfaces or bool(c.surfaces & surfaces)
    shared = c.tokens & tokens
    if c.category == category and common and (len(shared) >= 2 or shared & distinctive):
        return 4
    return 1 if followup and common and (c.category == category or category == "other" or "unknown" in surfaces) else -1


def scored_clusters(entries: DataFrame, keys: Sequence[str], first: str, last: str, tie: str, category: str, surfaces: str, tokens: str, followup: str, gap_hours: float = 72.0, distinctive: Sequence[str] = DISTINCTIVE) -> DataFrame:
    """``entries`` with cluster, the tie of the first entry of the cluster that each one joins.

    In order of their first time, an entry joins the cluster of the best score that had evidence
    at most ``gap_hours`` before, of equal ones that with the last evidence; if several clusters
    are mere follow-up matches, it begins its own.  A key's entries are cut where nothing
    reaches over the gap, and each piece is one ordered fold; clusters beyond the gap are dropped
    from memory.
    """
    gap = int(gap_hours * HOUR_US)
    words = frozenset(distinctive)
    by_time = Window.partitionBy(*keys).orderBy(first, tie)
    reach = F.max(micros(F.col(last))).over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    cut = reach.isNull() | (micros(F.col(first)) - reach > gap)
    pieces = entries.withColumn("__cut", cut.cast("int")).withColumn("__piece", F.sum("__cut").over(by_time)).drop("__cut")
    rows = pieces.withColumns({"__first": micros(F.col(first)), "__last": micros(F.col(last))}).repartition(*keys, "__piece").sortWithinPartitions(*keys, "__piece", "__first", tie)
    schema = T.StructType([*entries.schema.fields, T.StructField("cluster", entries.schema[tie].dataType)])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, open_ = None, []
        for part in parts:
            names = []
            for r in part.to_dict("records"):
                here = (*(r[k] for k in keys), r["__piece"])
                if here != held:
                    held, open_ = here, []
                open_ = [c for c in open_ if r["__first"] - c.last <= gap]
                own_surfaces, own_tokens = set(r[surfaces]), set(r[tokens])
                scored = [(_score(c, r[category], own_surfaces, own_tokens, r[followup], words), c) for c in open_]
                scored = [x for x in scored if x[0] >= 0]
                best = max(scored, key=lambda x: (x[0], x[1].last), default=(0, None))
                into = None if best[0] == 1 and sum(s == 1 for s, _ in scored) > 1 else best[1]
                if into is None:
                    into = _Cluster(r[tie], r[category], set(), set(), r["__last"])
                    open_.append(into)
                into.surfaces |= own_surfaces
                into.wild |= "unknown" in own_surfaces
                into.tokens |= own_tokens
                into.last = max(into.last, r["__last"])
                names.append(into.name)
            part["cluster"] = names
            yield part[[f.name for f in schema.fields]]

    return rows.mapInPandas(run, schema)


def claimed_identities(clusters: DataFrame, priors: DataFrame, keys: Sequence[str], cluster: str, order: str, groups: str, prior: str, created: str, members: DataFrame | None = None) -> DataFrame:
    """identity of each cluster: the oldest earlier entity of its key that shares a group and is not claimed yet, else null.

    Clusters claim in their ``order``, in blocks and rounds (see ``identity.claims``).  ``members``,
    where clusters have no groups: keys, cluster, order and groups, which a cluster may have in
    several rows; it is read several times.
    """
    if members is None:
        clusters = members = stored(clusters, "named")
    own = members.select(*keys, F.col(cluster).alias("cluster"), F.col(order).alias("turn"), F.explode(groups).alias("g"))
    before = stored(priors.select(*keys, F.col(prior).alias("prior"), F.col(created).alias("created"), F.col(groups).alias("groups")), "before")
    taken = claims(own, before, keys).select(*keys, F.col("cluster").alias(cluster), F.col("prior").alias("identity"))
    return clusters.join(taken, [*keys, cluster], "left").select(*clusters.columns, "identity")


def uncancelled(supports: DataFrame, contradictions: DataFrame, keys: Sequence[str], available: str, active: Column, tie: str) -> DataFrame:
    """The last active support of each key that came strictly after every contradiction of it."""
    against = contradictions.groupBy(*keys).agg(F.max(available).alias("__against"))
    open_ = supports.join(against, list(keys), "left").filter(F.col("__against").isNull() | (F.col(available) > F.col("__against"))).filter(active)
    return latest_by(open_.drop("__against"), keys, [F.col(available), F.col(tie)])


def pending(observations: DataFrame, done: DataFrame, refs: Sequence[str], signature: str) -> DataFrame:
    """Observations whose exact revision was not processed yet, or under another signature."""
    known = done.select(*refs, F.col(signature).alias("__done")).distinct()
    return observations.join(known.withColumnRenamed("__done", signature), [*refs, signature], "left_anti")


def reconciled(candidates: DataFrame, previous: DataFrame, key: str, payload: str) -> DataFrame:
    """Each candidate beside the latest stored one of its key: kept (equal payload), new, or the next revision."""
    old = previous.select(key, F.col(payload).alias("__old"), F.col("revision").alias("__revision"))
    joined = candidates.join(old, key, "left")
    same = F.col("__old").eqNullSafe(F.col(payload)) & F.col("__revision").isNotNull()
    action = F.when(F.col("__revision").isNull(), "new").when(same, "kept").otherwise("revised")
    number = F.when(same, F.col("__revision")).otherwise(F.coalesce("__revision", F.lit(0)) + 1)
    return joined.withColumns({"action": action, "revision": number.cast("int")}).drop("__old", "__revision")


def matching_plans(statuses: DataFrame, observations: DataFrame, signals: DataFrame, candidates: DataFrame) -> DataFrame:
    """status_id and the last candidate whose evidence has a signal of an observation of that status."""
    chain = statuses.select("status_id").distinct().join(observations.select("status_id", "observation"), "status_id").join(signals.select("observation", "signal"), "observation")
    named = candidates.select("candidate", "as_of", F.explode("evidence").alias("signal"))
    return chain.join(named, "signal").groupBy("status_id").agg(F.max_by("candidate", F.struct("as_of", "candidate")).alias("candidate"))


def confirmation_timeline(observations: DataFrame, signals: DataFrame, limit: int = 12) -> DataFrame:
    """The last statuses: best observation (rank, then last seen), last signal matched to any of its observations, first sighting."""
    best = observations.groupBy("status_id").agg(F.max_by("observation", F.struct("rank", "seen", "observation")).alias("observation"), F.min("seen").alias("first_seen"), F.max("published").alias("published"))
    last = observations.select("status_id", "observation").join(signals, "observation").groupBy("status_id").agg(F.max_by("signal", F.struct("available", "signal")).alias("signal"))
    return best.join(last, "status_id", "left").orderBy(F.desc("published"), "status_id").limit(limit)


def continuity_order(versions: DataFrame, cluster: str, version: str, direct: Column, official: Column, recent: Column) -> DataFrame:
    """The last version of each cluster with continuity, the sum of 4 (direct), 2 (official) and 1 (recent), and tier: its place among the eight possible sums, 1 for the best.

    Versions are looked at in order of tier, then cluster; the order itself is the reader's, as
    ranking all clusters would need them sorted.
    """
    last = latest_by(versions, [cluster], [version])
    score = direct.cast("int") * 4 + official.cast("int") * 2 + recent.cast("int")
    return last.withColumn("continuity", score).withColumn("tier", 8 - F.col("continuity"))


def source_exclusions(outcomes: DataFrame, key: str, record: str, refs: str, groups: str) -> DataFrame:
    """records (own and referred to) and groups of each key's outcomes, which may not serve as evidence for them."""
    own = F.array_union(F.array(record), F.coalesce(refs, F.array().cast("array<string>")))
    return outcomes.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(own)))).alias("records"), F.array_compact(F.array_sort(F.array_distinct(F.flatten(F.collect_set(groups))))).alias("groups"))


def sample_times(updates: DataFrame, keys: Sequence[str], time: str, at: Column, ttl_hours: float) -> DataFrame:
    """The times at which an episode's pressure can peak: now, each update, just before it (but the first), and when it grows old."""
    us, now = micros(F.col(time)), micros(at)
    points = F.array(now, us, F.when(F.col(time) > F.col("__first"), us - 1000), F.least(now, us + int(ttl_hours * HOUR_US)))
    known = updates.filter(F.col(time) <= at)
    rows = known.join(known.groupBy(*keys).agg(F.min(time).alias("__first")), list(keys))
    return rows.select(*keys, F.explode(F.array_compact(points)).alias("sample")).distinct()


def historical_peaks(updates: DataFrame, keys: Sequence[str], time: str, weight: str, at: Column, ttl_hours: float, half_life_hours: float) -> DataFrame:
    """The highest pressure of each episode up to a time: at a sample time, the greatest weight so far, which halves once nothing new has come for ``ttl_hours``."""
    samples = sample_times(updates, keys, time, at, ttl_hours)
    rows = updates.select(*keys, micros(F.col(time)).alias("__t"), F.col(weight).alias("__w"), F.lit(0).alias("__side"))
    asked = samples.select(*keys, F.col("sample").alias("__t"), F.lit(None).cast("double").alias("__w"), F.lit(1).alias("__side"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.unionByName(asked).withColumns({"__top": F.max("__w").over(w), "__seen": F.max(F.when(F.col("__side") == 0, F.col("__t"))).over(w)})
    idle = (F.col("__t") - F.col("__seen")) / F.lit(float(HOUR_US)) - ttl_hours
    pressure = F.col("__top") * F.pow(F.lit(0.5), F.floor(F.greatest(F.lit(0.0), idle)) / F.lit(float(half_life_hours)))
    return carried.filter("__side = 1").groupBy(*keys).agg(F.max(pressure).alias("peak"))


def linked_events(signals: DataFrame, keys: Sequence[str], time: str, end: str, tie: str, phase: str, stance: str, gap_hours: float = 2.0, span_hours: float = 6.0) -> DataFrame:
    """Clusters of signals in time with their state, hull and number: event candidates."""
    from tidemark.operators.episodes import candidate_states
    from tidemark.operators.sequences import gap_span_clusters

    clustered = gap_span_clusters(signals, keys, time, tie, gap_hours, span_hours)
    own = [*keys, "cluster_start"]
    hull = clustered.groupBy(*own).agg(F.max(end).alias("cluster_end"), F.count(F.lit(1)).alias("n"))
    return hull.join(candidate_states(clustered, own, phase, stance), own)

