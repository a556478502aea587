"""Vectors at cutoffs against plain Python, one target at a time."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof_features as af
from tidemark.operators import features

T0 = dt.datetime(2024, 3, 4)
EVIDENCE = "scope int, `group` string, time timestamp_ntz, visible_from timestamp_ntz, visible_to timestamp_ntz, incident boolean, rival boolean, start timestamp_ntz, end timestamp_ntz, weight double, cells int, __slots string"
OUTCOMES = "scope int, outcome_id int, `group` string, from_ timestamp_ntz, to timestamp_ntz, visible_from timestamp_ntz, visible_to timestamp_ntz"
LABELS = "scope int, outcome_id int, `group` string, from_ timestamp_ntz, to timestamp_ntz, ambiguous boolean"
TARGETS = "scope int, slot timestamp_ntz, cutoff timestamp_ntz, own_outcome int, own_group string, anchor string"


def at(hours):
    return None if hours is None else T0 + dt.timedelta(hours=hours)


def hours(a, b):
    return (a - b).total_seconds() / 3600


def history(n=60):
    """Evidence of two scopes with late, withdrawn, exactly hourly, tied and very old rows, and outcomes known out of order."""
    rows = []
    for i in range(n):
        t = i * 7.3 if i % 5 else float(i * 7)
        rows.append((i % 2, None if i % 9 == 0 else "abc"[i % 3], at(t), at(t + i % 4 * 0.4), at(t + 20) if i % 6 == 0 else None, i % 3 == 0, i % 3 == 1, at(t + 1) if i % 3 == 2 else None, at(t + 1 + i % 8) if i % 3 == 2 else None, 1.0 if i % 2 else 0.35, i, "x"))
    rows += [rows[3]] * 2  # repeated rows count each
    rows.append((0, "a", None, at(0), None, True, True, None, None, None, 0, "x"))
    rows.append((None, "a", at(1), at(1), None, True, True, None, None, None, 0, "x"))
    outcomes = [(k % 2, k, "abc"[k % 3], at(30 + 55.5 * k), at(31.5 + 55.5 * k), at(33 + 55.5 * k + (90 if k == 2 else 0)), at(200) if k == 3 else None) for k in range(7)]
    return rows, outcomes


def expected(target, evidence, outcomes):
    scope, slot, cut, own, own_group = target[:5]
    known = sorted((o for o in outcomes if o[0] == scope and o[5] <= cut and (o[6] is None or o[6] > cut) and o[1] != own), key=lambda o: (o[3], o[1]))
    mids = [o[3] + (o[4] - o[3]) / 2 for o in known]
    earlier = [o for o, m in zip(known, mids, strict=True) if m < slot]
    latest = earlier[-1] if earlier else None
    incident = rival = asserted = 0.0
    for e in evidence:
        if e[0] != scope or e[2] is None or e[3] > cut or (e[4] is not None and e[4] <= cut) or (own_group is not None and e[1] == own_group):
            continue
        share = 1.0
        if latest:
            share = 0.0 if e[1] is not None and e[1] == latest[2] else 0.5 if e[2] < latest[4] else 1.0
        age = hours(slot, e[2])
        if 0 <= age <= 14 * 24:
            incident += share * 2 ** (-age / 24) if e[5] else 0.0
            rival = max(rival, share * 2 ** (-age / 36)) if e[6] else rival
        if e[7] is not None and e[7] < e[8] and e[7] < slot + dt.timedelta(hours=1) and e[8] > slot:
            asserted += e[9] * share
    combined = 0.0
    if known:
        gaps = [hours(b, a) for a, b in zip(mids, mids[1:], strict=False)]
        age = hours(slot, mids[-1])

        def bell(x):
            return math.exp(-x * x / 2)

        def ring(a, b, period):
            return min(abs(a - b), period - abs(a - b))

        def day(x):
            return x.hour + x.minute / 60

        def week(x):
            return x.weekday() * 24 + day(x)

        if gaps and age >= 0:
            combined += sum(bell(math.log1p(age) - math.log1p(g)) for g in gaps) / len(gaps)
        combined += sum(bell(ring(day(slot), day(m), 24) / 6) + 0.5 * bell(ring(week(slot), week(m), 168) / 36) for m in mids) / len(mids)
    return [combined, asserted, incident, rival]


def frames(spark, evidence, outcomes):
    return spark.createDataFrame(evidence, EVIDENCE), spark.createDataFrame(outcomes, OUTCOMES)


@pytest.mark.parametrize("stride", [1])
def test_vectors_equal_plain_python(spark, stride):
    evidence, outcomes = history()
    targets = [(s, at(h), at(h - lag), own, group, "clash") for s in (0, 1) for h in range(0, 430, 11) for lag, own, group in ((0, None, None), (2, 4, "a"), (5, 3, None))]
    out = af.asof_vectors(spark.createDataFrame(targets, TARGETS), *frames(spark, evidence, outcomes), ["scope"])
    got = {tuple(r[:5]): [r[c] for c in features.VECTOR[-4:]] for r in out.select("scope", "slot", "cutoff", "own_outcome", "own_group", *features.VECTOR[-4:]).collect()}
    assert len(got) == len(targets)
    for t in targets:
        assert got[t[:5]] == pytest.approx(expected(t, evidence, outcomes), abs=1e-9), t
    assert "anchor" in out.columns  # an extra column of the targets stays as it is


def test_nothing_is_known_before_its_time(spark):
    """What becomes known after a cutoff changes nothing, whenever it happened."""
    evidence, outcomes = history()
    late = [(*e[:3], at(500), *e[4:]) for e in evidence] + evidence
    targets = spark.createDataFrame([(0, at(h), at(h), None, None, "") for h in range(0, 430, 43)], TARGETS)
    pick = ["slot", *features.VECTOR]
    one, two = (sorted(map(tuple, af.asof_vectors(targets, *frames(spark, e, outcomes), ["scope"]).select(*pick).collect())) for e in (evidence, late))
    assert [x[0] for x in one] == [x[0] for x in two]
    for a, b in zip(one, two, strict=True):
        assert a[1:] == pytest.approx(b[1:], abs=1e-12)


def test_training_rows(spark):
    evidence, outcomes = history(12)
    slots = spark.createDataFrame([(0, at(h)) for h in range(24, 40)], "scope int, slot timestamp_ntz")
    labels = spark.createDataFrame([(0, 0, "a", at(30), at(31.5), False), (0, 9, "b", at(36.5), at(36.75), True), (0, 8, "b", at(38), at(38), False)], LABELS)
    out = af.asof_training_rows(slots, labels, *frames(spark, evidence, outcomes), ["scope"])
    rows = out.select("kind", F.expr("cast(timestampdiff(hour, timestamp_ntz'2024-03-04', slot) as int)"), F.expr("cast(timestampdiff(hour, timestamp_ntz'2024-03-04', cutoff) as int)"), "own_outcome", "exposure").collect()
    assert sorted(tuple(r) for r in rows if r["kind"] == "event") == [("event", 30, 30, 0, 1.0), ("event", 31, 30, 0, 0.5)]
    assert sorted(r[1] for r in rows if r["kind"] == "negative") == [h for h in range(24, 40) if h not in (30, 31, 36)]


def test_empty_tables(spark):
    targets = spark.createDataFrame([(0, at(5), at(5), None, None, "")], TARGETS)
    row = af.asof_vectors(targets, *frames(spark, [], []), ["scope"]).first()
    assert [row[c] for c in features.VECTOR[-4:]] == [0.0] * 4 and row["weekly_cos_1"] is not None
    evidence, outcomes = frames(spark, *history())
    assert af.asof_vectors(targets.limit(0), evidence, outcomes, ["scope"]).count() == 0


def test_targets_of_one_slot_and_cutoff_are_one_case(spark):
    """Own outcomes that a cutoff doesn't know yet set nothing apart, so that history is weighed once however many there are."""
    evidence, outcomes = history()
    outcomes += [(0, 100 + k, f"own{k}", at(250 + k / 60), at(251 + k / 60), at(400), None) for k in range(30)]
    targets = [(0, at(251), at(250), own, group, "") for own, group in [(None, None), (2, "a"), (4, "b"), *((100 + k, f"own{k}") for k in range(30))]]
    frame, (_, history_) = spark.createDataFrame(targets, TARGETS), frames(spark, evidence, outcomes)
    rows, cases = af._cases(af.contexts(frame, ["scope"]), history_, ["scope"])
    assert rows.count() == 33 and sorted((r["own_outcome"] or 0) for r in cases.collect()) == [0, 2]
    got = {r["own_outcome"]: [r[c] for c in features.VECTOR[-4:]] for r in af.asof_vectors(frame, *frames(spark, evidence, outcomes), ["scope"]).collect()}
    for t in targets:
        assert got[t[3]] == pytest.approx(expected(t, evidence, outcomes), abs=1e-9), t
