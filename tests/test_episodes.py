"""Pressure of episodes by plain Python, with one episode that has most of the updates."""

from __future__ import annotations

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from tidemark.operators import episodes, linking

HOUR = 3_600_000_000
WEIGHTS = {"resolved": 0.1, "mitigating": 0.5}
SCHEMA = "k string, ts timestamp_ntz, tie int, origin string, state string, sev double, scope double, work double, cat string"


def plain(updates, at, ttl, half_life):
    """``updates`` of one episode in order, times in microseconds."""
    seen = [u for u in updates if u[0] <= at]
    if not seen:
        return None
    done, state, spell, closed, was = False, None, seen[0][0], None, None
    for t, _, _, s, *_ in seen:
        if s == "resolved":
            done, closed = True, t
        elif was == "resolved":
            spell, closed = t, None
        state = "reopened" if s != "resolved" and done else s
        was = s
    sev, scope = max((u[4], u[5]) for u in seen if u[7] == seen[0][7])
    end = closed if was == "resolved" else at
    active = max(0.0, min(ttl, (end - spell) / HOUR))
    keeps = (1 - math.exp(-3 * math.floor(active) / ttl)) / (1 - math.exp(-3))
    sources = len({u[2] for u in seen})
    fresh = 0.5 ** (math.floor(max(0.0, (at - seen[-1][0]) / HOUR - ttl)) / half_life)
    base = sev * 0.4 + scope * 0.25 + keeps * 0.1 + min(1, 0.4 + 0.2 * (sources - 1)) * 0.15 + seen[-1][6] * 0.1
    return state, sources, spell, min(1.0, max(0.0, base * WEIGHTS.get(state, 1.0) * fresh))


def test_swept_pressure(spark):
    rng = random.Random(12)
    begin = dt.datetime(2024, 1, 1)
    rows = []
    for k in range(700):
        key = "hot" if k % 10 else f"e{k % 7}"
        at = begin + dt.timedelta(hours=rng.choice([0, 1, 2, 30, 31, 90]) + rng.randrange(0, 400) // 3, milliseconds=rng.randrange(3))
        rows.append((key, at, k, f"g{rng.randrange(40)}", rng.choice(["resolved", "mitigating", "active", "active"]), rng.random(), rng.random(), rng.random(), rng.choice("ab")))
    df = spark.createDataFrame(rows, SCHEMA)
    now = F.lit("2024-01-08 12:00:00").cast("timestamp_ntz")
    samples = linking.sample_times(df, ["k"], "ts", now, 12.0)
    got = episodes.pressure_at(df, samples, ["k"], "ts", "tie", "origin", "state", "sev", "scope", "work", "cat", WEIGHTS, 12.0, 6.0).collect()
    by_key = {}
    for key, at, tie, *rest in rows:
        us = (at - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        by_key.setdefault(key, []).append((us, tie, *rest))
    assert len(got) == samples.count()
    for r in got:
        state, sources, spell, level = plain(sorted(by_key[r["k"]]), r["sample"], 12.0, 6.0)
        assert (r["state"], r["sources"], r["spell_start"]) == (state, sources, spell) and abs(r["pressure"] - level) < 1e-9
    early = spark.createDataFrame([("hot", 0), ("none", 5)], "k string, sample long")
    assert episodes.pressure_at(df, early, ["k"], "ts", "tie", "origin", "state", "sev", "scope", "work", "cat", WEIGHTS, 12.0, 6.0).collect() == []
