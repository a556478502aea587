"""Cases that are easy to get wrong, on a few rows."""

from __future__ import annotations

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import episodes, hazard, intervals, profile, sequences
from tidemark.plans import metric_queries, source_queries, text_queries
from tidemark.streaming import subscriptions

DAY = dt.datetime(2024, 1, 1)


def at(hours: float) -> dt.datetime:
    return DAY + dt.timedelta(hours=hours)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("batch", ["2", "10000"])
def test_folds_go_on_across_batches(spark, batch):
    """Greedy choices and clusters do not depend on how rows fall into Arrow batches."""
    rows = [(k, i, at(h)) for k in (1, 2) for i, h in enumerate([0, 1, 3, 4, 4, 7, 20, 21, 26])]
    df = spark.createDataFrame(rows, "k int, i int, ts timestamp_ntz")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        chosen = sequences.non_overlapping(df, ["k"], "ts", "i", 4).filter("chosen = 1").collect()
        clusters = sequences.gap_span_clusters(df, ["k"], "ts", "i", 3, 6).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["k"], r["i"]) for r in chosen) == [(k, i) for k in (1, 2) for i in (0, 3, 6, 8)]
    first = {(r["k"], r["i"]): r["cluster_start"] for r in clusters}
    assert all([first[k, i] for i in range(9)] == [at(0)] * 5 + [at(7)] + [at(20)] * 2 + [at(26)] for k in (1, 2))


def test_touching_intervals(spark):
    df = spark.createDataFrame([(1, at(0), at(1)), (1, at(1), at(2)), (1, at(3), at(3)), (1, at(4), at(5))], "k int, start timestamp_ntz, end timestamp_ntz")
    one = sorted((r["start"], r["end"], r["n"]) for r in intervals.merge_intervals(df, ["k"]).collect())
    two = sorted((r["start"], r["end"], r["n"]) for r in intervals.merge_intervals(df, ["k"], touching=False).collect())
    assert one == [(at(0), at(2), 2), (at(4), at(5), 1)] and two == [(at(0), at(1), 1), (at(1), at(2), 1), (at(4), at(5), 1)]


def test_half_open_overlap(spark):
    a = spark.createDataFrame([(1, at(0), at(2)), (1, at(5), at(5))], "k int, s timestamp_ntz, e timestamp_ntz")
    b = spark.createDataFrame([(1, at(2), at(3)), (1, at(1), at(9)), (2, at(0), at(9))], "k int, f timestamp_ntz, t timestamp_ntz")
    got = intervals.overlap_join(a, b, ["k"], ("s", "e"), ("f", "t"), 1).collect()
    assert [(r["s"], r["f"]) for r in got] == [(at(0), at(1))]


def test_asof_is_strict_or_not(spark):
    left = spark.createDataFrame([(1, at(2))], "k int, t timestamp_ntz")
    right = spark.createDataFrame([(1, at(1), 10), (1, at(2), 20)], "k int, u timestamp_ntz, v int")
    assert [intervals.asof_join(left, right, ["k"], "t", "u", ["v"], strict=s).first()["v"] for s in (True, False)] == [10, 20]


def test_pressure_curves(spark):
    assert value(spark, episodes.persistence(F.lit(500.0), 72.0)) == 1.0
    assert value(spark, episodes.persistence(F.lit(0.9), 72.0)) == 0.0
    assert math.isclose(value(spark, episodes.persistence(F.lit(36.5), 72.0)), (1 - math.exp(-1.5)) / (1 - math.exp(-3)))
    assert [value(spark, episodes.freshness(F.lit(h), 72.0, 36.0)) for h in (10.0, 72.9, 108.0)] == [1.0, 1.0, 0.5]


def test_later_success_ends_an_error(spark):
    rows = [(True, at(3), at(2), "x"), (True, at(2), at(2), "x"), (True, None, None, None), (True, at(-100), None, None), (False, at(3), None, None), (True, at(3), None, None)]
    df = spark.createDataFrame(rows, "on boolean, ok timestamp_ntz, bad timestamp_ntz, error string")
    status = episodes.provider_status(F.col("on"), F.col("ok"), F.col("bad"), F.col("error"), F.lit(at(4)), 24.0)
    assert [r["s"] for r in df.select(status.alias("s")).collect()] == ["fresh", "error", "unknown", "stale", "disabled", "fresh"]


def test_certain_hazard_is_certain(spark):
    df = spark.createDataFrame([(1, k, h) for k, h in enumerate([0.1, 1.0, 0.3])], "k int, i int, hazard double")
    got = [r["cumulative"] for r in hazard.log_cumulative(df, ["k"], "i", "hazard").orderBy("i").collect()]
    assert math.isclose(got[0], 0.1) and got[1:] == [1.0, 1.0]


def test_every_document_has_all_its_topic_tokens(spark, tmp_path):
    rows = [(1, "en", "alpha bravo charlie delta echoes foxtrot golfing"), (2, "de", "haus und garten"), (3, None, "tiempo")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n"], r["tokens"]) for r in text_queries.QUERIES["topic_tokens_all"](spark, str(tmp_path)).collect()}
    assert got == {1: (7, "alpha bravo charlie delta echo foxtrot golf"), 2: (2, "haus garten"), 3: (1, "tiempo")}


def test_one_distinctive_token_is_a_shared_topic(spark):
    rows = [("login broken", "login slowly"), ("crashed here", "crashing yonder"), ("broken again", "broken pipe"), ("red blue tools", "tools blue green"), ("login", "upload")]
    df = spark.createDataFrame(rows, "a string, b string").select(text.shares_topic(text.topic_tokens(F.col("a")), text.topic_tokens(F.col("b"))).alias("x"))
    assert [r["x"] for r in df.collect()] == [True, True, False, True, False]


@pytest.mark.parametrize("batch", ["2", "10000"])
def test_replay_folds_in_batches(spark, batch):
    """Equal to the plain fold of each subscriber, a null one too, without a subscriber's rows in one frame."""
    rows = [(s, f"p{(i * 7) % 11}", i, i, i + 5, i, (i * 37 % 100) / 100, str(i // 6), -1, i, 0.5) for s in (1, 2, None) for i in range(20 + (s or 0))]
    names = ["subscriber", *subscriptions.COLUMNS, "now", "threshold"]
    df = spark.createDataFrame(rows[::-1], "subscriber long, prediction string, issued long, emitted long, expires long, cutoff long, probability double, outcome string, outcome_known long, now long, threshold double")
    want, watches = [], {}
    for r in (dict(zip(names, r, strict=True)) for r in rows):
        watch, reason, said = subscriptions.transition(watches.get(r["subscriber"]), subscriptions.Input(*[r[c] for c in subscriptions.COLUMNS]), r["now"], r["threshold"])
        watches[r["subscriber"]] = watch
        want.append((r["subscriber"], r["prediction"], r["emitted"], reason, said, bool(watch and watch.active)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = subscriptions.replay(df)
        got = [tuple(r) for r in out.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(r[4] for r in got)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()


def test_carry_of_purchases_sees_one_row_an_hour(spark, monkeypatch):
    sides, join = [], intervals.asof_join
    monkeypatch.setattr(intervals, "asof_join", lambda left, right, *a, **b: sides.append(right) or join(left, right, *a, **b))
    folder = "/root/testdata/sf0.01"
    hours = metric_queries.refractory_multiplier(spark, folder).count()
    assert 0 < sides[0].count() <= hours and sides[0].select(F.date_trunc("hour", "at")).distinct().count() == sides[0].count()


def test_stems_before_stop_words(spark):
    """By hand: "stills" stems to a stop word, "crashing" and "crashed" to one token, "runs" is too short to lose its end."""
    row = spark.createDataFrame([("Stills runs; crashing crashed THAT workspace workspaces",)], "t string").select(text.topic_tokens(F.col("t")).alias("a"), text.topic_tokens(F.col("t"), suffixes=(), stop_words=("that",)).alias("b")).first()
    assert row["a"] == ["runs", "crash", "workspace", "workspac"]
    assert row["b"] == ["stills", "runs", "crashing", "crashed", "workspace", "workspaces"]


def test_watermark_sees_changed_and_repeated_rows(spark):
    base = [(1, "2024-01-01", 5), (2, "2024-01-02", 6)]
    marks = [profile.watermark(spark.createDataFrame(rows, "id int, t string, v int"), "t", "id") for rows in (base, [*base[:1], (2, "2024-01-02", 7)], [*base, base[0], base[0]], [*base, base[1], base[1]], base[::-1])]
    assert marks[0] == marks[4] and len(set(marks[:4])) == 4


def test_hazards_come_back_from_tiny_masses(spark):
    """Hazards near 1 leave less than 1e-12 after a few slots; the mass of no event keeps what is left exact."""
    want = [0.95, 0.94, 0.9, 0.97] * 6
    df = spark.createDataFrame([(1, i, h) for i, h in enumerate(want)] + [(2, i, h) for i, h in enumerate([0.5, 1.0, 0.3])], "k int, i int, hazard double")
    mass = hazard.no_event_mass(hazard.first_event_mass(df, ["k"], "i"), ["k"])
    rows = hazard.hazards_of_mass(mass.drop("hazard"), ["k"], "i", no_event="no_event").collect()
    got = {(r["k"], r["i"]): r["hazard"] for r in rows}
    assert [got[1, i] for i in range(24)] == pytest.approx(want, rel=1e-9)
    assert [got[2, i] for i in range(3)] == [0.5, 1.0, 0.0]


@pytest.mark.parametrize("number", [7, 4194303, 4194304, 5999999])
def test_times_of_ids_with_wide_sequences(spark, tmp_path, number):
    """A sequence of more than 22 bits reaches into those of the time, which is the millisecond that it was made from."""
    spark.createDataFrame([(number,)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    row = text_queries.snowflake_times(spark, str(tmp_path)).first()
    ms = 410000000000 + number * 977
    assert row["status_id"] == str(ms * 4194304 + number)
    assert row["at"] == dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms + 1288834974657)


def test_gateway_times_of_wide_sequences(spark, tmp_path):
    spark.createDataFrame([(n, 3, "view", DAY) for n in (0, 4194304, 5999998)], "event_id long, user_id long, event_type string, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["published"] for r in source_queries.gateway_items(spark, str(tmp_path)).filter("published is not null").collect()}
    assert got == {dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=410000000000 + n * 977 + 1288834974657) for n in (0, 4194304, 5999998) if n % 3 < 2}


def test_references_without_semicolon_stay(spark):
    df = spark.createDataFrame([("<b>a&amp&amp;b &am &quot;c&quot &#65; &#x42; &#67 &notit; &middot;</b>",)], "html string")
    assert df.select(text.html_to_text(F.col("html"))).first()[0] == 'a&amp&b &am "c&quot A B &#67 &notit; ·'


def test_sentences_as_in_sql(spark, tmp_path):
    """White space of ASCII only after a stop, spaces of any width trimmed, words between ASCII bounds: one row a case, against the SQL."""
    cases = ["a.\n\t\nb", "a.\x0b", "a. \u3000", "x\u00a0\n\u00a0", "a.\u2003b! c", "All rights \u00e9reserved.", "reserved\u00f1", "re\u017ferved", "unreserved", "Reserved_", "\u00e9 reserved\u0301", "...", "\n", "", None, "a\r\n.b\u3002 c\uff01"]
    spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in text_queries.sentence_counts(spark, str(tmp_path)).select("doc_id", "n", "legal").collect())
    assert got == sorted(con.execute(f"SELECT doc_id, n, legal FROM ({text_queries.ORACLES['sentence_counts']})").fetchall())


def test_references_are_dealt_by_rows(spark, monkeypatch):
    """As many tasks as counted references need, however few bytes they have."""
    from tidemark.operators import revisions

    monkeypatch.setattr(revisions, "REFS_TOGETHER", 100)
    out = revisions.unresolved(spark.range(1000).union(spark.range(500)), spark.range(0, 1000, 2), ["id"])
    assert sorted(r["id"] for r in out.collect()) == list(range(1, 1000, 2))
    assert len(out.select(F.spark_partition_id().alias("p")).distinct().collect()) > 8
