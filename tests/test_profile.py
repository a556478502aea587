"""Whole threshold profiles: empty and odd inputs, the choice of windows, and what names the content."""

from __future__ import annotations

import datetime as dt

from tidemark.operators import profile

T0 = dt.datetime(2024, 1, 1)
ROWS = "start timestamp_ntz, tie int, p double, y int, status string, n bigint, alerts int"
HELD = "event int, p double, tie int"


def report(spark, rows, held):
    return profile.whole_profile(spark.createDataFrame(rows, ROWS), spark.createDataFrame(held, HELD), "p", "start", "tie", "event", 4.0, 3, 1).first()


def row(hour, p, y, tie=0, status=None):
    return (T0 + dt.timedelta(hours=hour), tie, p, y, status or {1: "positive", 0: "negative"}.get(y, "immature"), 7, 7)


def test_choice_and_events(spark):
    rows = [row(0, 0.5, 1), row(1, 0.305, 0), row(1, 0.305, 0, tie=1), row(4, 0.25, 1), row(7, 1.0, 0), row(8, 0.0, 0), row(9, None, None), row(9, 0.9, None, status="censored_incomplete_coverage")]
    got = report(spark, rows, [(1, 0.5, 0), (1, 0.25, 0), (2, 0.25, 0)])
    assert (got["sample_count"], got["positive"], got["negative"], got["event_count"]) == (6, 2, 4, 2)
    assert (got["status"], got["immature"], got["censored_incomplete_coverage"]) == ("available", 1, 1)
    curve = {c["threshold_percent"]: c for c in got["curve"]}
    assert sorted(curve) == list(range(101))
    assert (curve[20]["alerts"], curve[20]["chosen"], curve[20]["chosen_hits"]) == (5, 2, 2)  # 0 and 4 h; 7 h overlaps
    assert (curve[30]["alerts"], curve[30]["chosen"], curve[30]["chosen_hits"]) == (4, 2, 1)  # 0 and 7 h
    assert [curve[k]["events_hit"] for k in (0, 24, 25, 49, 50)] == [2, 2, 1, 1, 0]
    assert curve[99]["alerts"] == 1 and curve[100]["alerts"] == 0 and curve[100]["rate"] is None and curve[0]["confidence"] is None
    assert sum(b["n"] for b in got["distribution"]) == 6


def test_content_names_rows_whatever_their_order(spark):
    rows = [row(h, h / 10, h % 2) for h in range(8)]
    one, two, other, twice = (report(spark, r, []) for r in (rows, rows[::-1], [*rows[:-1], row(7, 0.71, 1)], [*rows, rows[0], rows[0]]))
    assert one["content"] == two["content"] and len({one["content"], other["content"], twice["content"]}) == 3
    assert one["curve"][0]["recall"] is None and one["event_count"] == 0 and not one["events_passed"]


def test_no_labelled_windows(spark):
    got = report(spark, [row(1, 0.4, None)], [])
    assert (got["status"], got["reason"], got["sample_count"], got["positive"], got["first_start"]) == ("insufficient", "no_labelled_windows", 0, 0, None)
    assert len(got["curve"]) == 101 and {c["alerts"] for c in got["curve"]} == {0} and {c["density"] for c in got["curve"]} == {0.0}


def test_episodes_are_folded_once(spark):
    from tidemark.plans import profile_queries

    out = profile_queries.impact_episodes(spark, "/root/testdata/sf0.001")
    assert "MapInPandas" not in out._jdf.queryExecution().toString()  # what reads the clusters reads them stored
