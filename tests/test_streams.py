"""Streams that run in several batches, or from the start again, leave what batch operators give."""

from __future__ import annotations

import datetime
import inspect
import random

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.plans import model_queries, source_queries, stream_queries
from tidemark.streaming import delivery, ledger, projector, ring, settlement, subscriptions, traffic

FOLDER = "/root/testdata/sf0.001"


def halves(spark, df, path, time):
    """``df`` as two files, the later rows in the second."""
    middle = df.select(F.percentile_approx(time, 0.5)).first()[0]
    for name, part in (("a", df.filter(F.col(time) <= middle)), ("b", df.filter(F.col(time) > middle))):
        part.coalesce(1).write.parquet(f"{path}/{name}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_watches_of_a_stream_are_those_of_a_replay(spark, tmp_path):
    inputs = model_queries._forecast_inputs(spark, FOLDER)
    stream = halves(spark, inputs, str(tmp_path / "in"), "emitted")
    out = str(tmp_path / "out")
    query = subscriptions.watch_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 2
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == sorted(map(tuple, subscriptions.replay(inputs).collect()))


def candidates(spark):
    e = spark.read.parquet(f"{FOLDER}/events.parquet").filter("event_type = 'error'")
    return e.select(F.col("event_id").cast("string").alias("event_id"), F.concat_ws("|", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("delivery_key"), "ts", F.col("event_id").alias("n"))


def test_published_stream_is_dense_and_has_nothing_twice(spark, tmp_path):
    rows = candidates(spark)
    stream = halves(spark, rows.union(rows.limit(50)), str(tmp_path / "in"), "n")
    path, checkpoint = str(tmp_path / "ledger"), str(tmp_path / "c")
    ledger.publish(stream, path, ["ts", "n"], checkpoint).trigger(availableNow=True).start().awaitTermination()
    # started again, it finds everything published
    ledger.publish(stream, path, ["ts", "n"], checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(path).collect()
    assert sorted(r["sequence"] for r in got) == list(range(1, len(got) + 1))
    assert {r["delivery_key"] for r in got} == {r["delivery_key"] for r in rows.collect()}
    assert len({r["delivery_key"] for r in got}) == len(got) and len({r["batch"] for r in got}) == 2
    page = ledger.page(spark.read.parquet(path).withColumn("topic", F.lit("t")), 3, 5, ["t"]).collect()
    assert [r["sequence"] for r in page] == [4, 5, 6, 7, 8] and {r["next_after"] for r in page} == {8}


def test_ledger_in_two_batches(spark):
    rows = candidates(spark)
    first = ledger.next_entries(rows.filter("ts < timestamp_ntz'2024-01-12'"), None, ["ts", "n"])
    second = ledger.next_entries(rows, first, ["ts", "n"])
    whole = ledger.next_entries(rows, None, ["ts", "n"])
    key = lambda r: (r["sequence"], r["delivery_key"])
    assert sorted(map(key, first.unionByName(second).collect())) == sorted(map(key, whole.collect()))
    assert ledger.next_entries(rows.limit(0), None, ["ts", "n"]).collect() == []


def test_windows_of_two_batches(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = halves(spark, events, str(tmp_path / "in"), "event_id")
    failed = F.col("event_type") == "error"
    path = str(tmp_path / "table")
    traffic.keep_windows(traffic.minute_metrics(stream, "ts", "value", failed, width="6 hours", late="1 hour"), path, str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.parquet(path)
    want = traffic.minute_metrics(events, "ts", "value", failed, width="6 hours")
    assert kept.count() > want.count()  # the window in the middle was written by both
    assert sorted(map(tuple, traffic.latest_windows(kept).collect())) == sorted(map(tuple, want.collect()))


def test_streamed_outbox(spark, tmp_path):
    e = spark.read.parquet(f"{FOLDER}/events.parquet").select(F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") / 2).cast("long").cast("string").alias("id"), F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("semantic_key"))
    stream = halves(spark, e, str(tmp_path / "in"), "at")
    out = str(tmp_path / "out")
    delivery.streamed_outbox(stream, "at", "60 days").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == got.select("id").distinct().count() == got.select("semantic_key").distinct().count()
    assert got.count() > 0 and source_queries.outbox_jobs(spark, FOLDER).count() > 0


def published(df):
    return sorted((tuple(r) for r in df.select("subject", F.col("at").cast("timestamp_ntz").alias("at"), "kind", "entity", "row").collect()), key=repr)


class Kept:
    """State in memory that counts how often it is asked for or changed."""

    def __init__(self):
        self.calls, self.timers, self.tables = 0, [], {}

    def getMapState(self, name, *_):
        return self.tables.setdefault(name, Kept())

    getValueState = getMapState

    def registerTimer(self, at):
        self.timers.append(at)

    def __getattr__(self, name):
        self.calls += 1
        rows = self.tables
        return {
            "exists": lambda: bool(rows),
            "get": lambda: rows["value"],
            "update": lambda v: rows.update(value=v),
            "getValue": rows.get,
            "containsKey": rows.__contains__,
            "updateValue": rows.__setitem__,
            "removeKey": rows.pop,
        }[name]


def odd_facts(n, seed=7):
    """Facts of three outcomes, one watch and four windows, with ties, nulls and statuses that nobody knows."""
    r = random.Random(seed)
    day = datetime.datetime(2024, 1, 1)
    out = []
    for tie in range(n):
        at = day + datetime.timedelta(minutes=5 * (tie // 3))
        kind = r.choice(["outcome", "probability", "authority", "else"])
        status = r.choice(["pending", "confirmed", "confirmed", "retracted", "withdrawn", "unheard", None])
        ends = r.choice([None, *(day + datetime.timedelta(days=k) for k in (1, 40, 41))])
        out.append((1, at, tie, kind, r.choice(["a", "b", None]), status, r.choice(["x", "y", None]), r.choice([None, 0.1, 0.3, 0.4, 0.5, 0.9]), ends))
    return out


def test_a_row_costs_no_call_to_the_state(spark):
    """Three batches, each in parts out of order, publish what windows over all facts do; state is called once an outcome or window."""
    rows = odd_facts(3000)
    facts = spark.createDataFrame(rows, projector.FACT)
    names = [c.split()[0] for c in projector.FACT.split(", ")]
    handle, it, got = Kept(), projector.Projector(), []
    it.init(handle)
    for lo in (0, 1000, 2000):
        own = pd.DataFrame(rows[lo : lo + 1000], columns=names).sample(frac=1, random_state=lo)
        own["at"], own["ends"] = (pd.to_datetime(own[c]).astype("datetime64[us]") for c in ("at", "ends"))
        for found in it.handleInputRows((1, 0), (own.iloc[k : k + 90] for k in range(0, 1000, 90)), None):
            got += list(found.itertuples(index=False, name=None))
    # facts that name a window again after its end say nothing, so that all windows may stay in the state here
    want = [tuple(r) for r in projector.publications(facts.withColumn("until", F.lit(None).cast("timestamp")), "until").withColumn("at", F.col("at").cast("timestamp_ntz")).collect()]
    assert sorted(got, key=repr) == sorted(((s, pd.Timestamp(at), *x) for s, at, *x in want), key=repr)
    assert {r[2] for r in got} == {"confirmed", "corrected", "retracted", "withdrawn", "opened", "closed", "authority_opened"}
    assert sum(x.calls for x in handle.tables.values()) < 100 and len(handle.timers) <= 9


def test_lanes_leave_the_publications_of_one(spark, tmp_path):
    facts = spark.createDataFrame(odd_facts(300), projector.FACT)
    facts.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = []
    for lanes in (1, 5):
        stream = spark.readStream.schema(facts.schema).parquet(str(tmp_path / "in"))
        out = str(tmp_path / f"out{lanes}")
        stream_queries.run_stream(spark, projector.publication_stream(stream, lanes=lanes), out, str(tmp_path / f"c{lanes}"))
        found.append(published(spark.read.parquet(out)))
    assert found[0] == found[1] == published(projector.publications(stream_queries._until(facts), "until"))


def test_publications_of_a_stream_that_stops_and_goes_on(spark, tmp_path):
    """Two runs with one checkpoint: the state and the timers of the first live on in the second."""
    rows = stream_queries.facts(spark.read.parquet(f"{FOLDER}/events.parquet")).persist()
    edges = rows.select(F.percentile_approx("at", [0.3, 0.6])).first()[0]
    path, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    kept = 0
    for k, (lo, hi) in enumerate(zip([None, *edges], [*edges, None], strict=True)):
        part = rows.filter((F.lit(True) if lo is None else F.col("at") > F.lit(lo)) & (F.lit(True) if hi is None else F.col("at") <= F.lit(hi)))
        part.coalesce(1).write.parquet(f"{path}/{k}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(path)
        stream_queries.run_stream(spark, projector.publication_stream(stream), out, checkpoint)
        now = spark.read.parquet(out).count()
        assert now > kept
        kept = now
    got = published(spark.read.parquet(out))
    want = published(projector.publications(stream_queries._until(rows), "until"))
    assert got == want
    assert {r[2] for r in got} == {"confirmed", "corrected", "retracted", "withdrawn", "opened", "closed", "authority_opened", "authority_ended"}
    rows.unpersist()


def test_publication_rules(spark):
    import datetime as dt

    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    rows = [
        (1, day(1), 1, "outcome", "a", "retracted", "x", None, None),  # nothing was confirmed
        (1, day(1), 2, "outcome", "a", "confirmed", "x", None, None), (1, day(2), 3, "outcome", "a", "pending", "y", None, None),
        (1, day(3), 4, "outcome", "a", "confirmed", "x", None, None), (1, day(4), 5, "outcome", "a", "confirmed", "z", None, None),
        (1, day(5), 6, "outcome", "a", "withdrawn", "z", None, None), (1, day(6), 7, "outcome", "a", "retracted", "z", None, None),
        (1, day(1), 8, "probability", None, None, None, 0.9, None), (1, day(2), 9, "probability", None, None, None, 0.4, None), (1, day(3), 10, "probability", None, None, None, 0.3, None), (1, day(4), 11, "probability", None, None, None, None, None), (1, day(5), 12, "probability", None, None, None, 0.5, None),
        (1, day(1), 13, "authority", "w", None, "r", None, day(3)), (1, day(2), 14, "authority", "w", None, "s", None, day(3)), (1, day(4), 15, "authority", "w", None, "t", None, day(3)), (2, day(1), 16, "authority", "w", None, "q", None, None),
    ]
    got = projector.publications(spark.createDataFrame(rows, projector.FACT)).orderBy("at", "kind").collect()
    assert [(r["at"].day, r["kind"], r["row"]) for r in got] == [(1, "authority_opened", "r"), (1, "confirmed", "x"), (3, "authority_ended", "r"), (3, "closed", None), (4, "corrected", "z"), (5, "opened", None), (5, "withdrawn", "z")]


def decided(facts, t, start, end):
    """Status of a window by all that was known at t."""
    latest = {}
    for at, kind, entity, revision, s, e, status in facts:
        if at <= t and kind != "window":
            latest[(kind, entity)] = max(latest.get((kind, entity), (-1,)), (revision, s, e, status))
    met = {v[3] for (k, _), v in latest.items() if k == "outcome" and v[1] < end and v[2] > start}
    held = set()
    for (k, _), v in latest.items():
        if k == "coverage" and v[3] == "eligible":
            held |= set(range(v[1], v[2]))
    return "positive" if "confirmed" in met else "censored" if "ambiguous" in met else "negative" if set(range(start, end)) <= held else "censored"


def test_desk_says_what_is_known():
    import random

    rng = random.Random(8)
    for _ in range(200):
        facts = [(0, "window", f"w{k}", 0, k * 5, k * 5 + rng.randrange(1, 12), None) for k in range(4)]
        revisions = {}
        for at in sorted(rng.choices(range(60), k=14)):
            kind = rng.choice(["outcome", "coverage"])
            entity = f"{kind}{rng.randrange(4)}"
            revisions[entity] = revisions.get(entity, 0) + 1
            s = rng.randrange(30)
            facts.append((at, kind, entity, revisions[entity], s, s + rng.randrange(1, 15), rng.choice(["confirmed", "ambiguous", "cancelled"] if kind == "outcome" else ["eligible", "eligible", "other"])))
        desk = settlement.Desk()
        cut = rng.randrange(len(facts) + 1)
        got = []
        for part in (facts[:cut], facts[cut:]):
            if part and cut and part is not facts[:cut] and facts[cut - 1][0] == part[0][0]:
                break  # facts of one time arrive together
            got += desk.advance(part)
        else:
            got += desk.expire(1 << 62)
            for k in range(4):
                start, end = k * 5, facts[k][5]
                own = [g for g in got if g[0] == f"w{k}"]
                assert [g[5] for g in own] == list(range(1, len(own) + 1)) and [g[6] for g in own] == [None, *[g[4] for g in own[:-1]]]
                for t in range(end, 70):
                    assert [g for g in own if g[3] <= t][-1][4] == decided(facts, t, start, end)


def test_settlement_of_a_stream_that_stops_and_goes_on(spark, tmp_path):
    rows = stream_queries.settlement_facts(spark, FOLDER).filter("subject % 4 = 0").persist()
    edges = rows.select(F.percentile_approx("at", [0.3, 0.7])).first()[0]
    path, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    for k, (lo, hi) in enumerate(zip([None, *edges], [*edges, None], strict=True)):
        part = rows.filter((F.lit(True) if lo is None else F.col("at") > F.lit(lo)) & (F.lit(True) if hi is None else F.col("at") <= F.lit(hi)))
        part.coalesce(1).write.parquet(f"{path}/{k}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(path)
        stream_queries.run_stream(spark, settlement.settlement_stream(stream), out, checkpoint)
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    got = key(spark.read.parquet(out))
    until = rows.crossJoin(F.broadcast(rows.agg((F.max("at") - F.expr("interval 1 hour")).alias("until"))))
    assert got == key(settlement.settlement_history(until, "until"))
    assert any(r[7] for r in got) and {r[5] for r in got} == {"positive", "negative", "censored"}
    rows.unpersist()


def test_inputs_of_a_stream_that_stops_and_goes_on(spark, tmp_path):
    rows = stream_queries.ring_facts(spark.read.parquet(f"{FOLDER}/events.parquet")).persist()
    edges = rows.select(F.percentile_approx("at", [0.4, 0.8])).first()[0]
    path, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    for k, (lo, hi) in enumerate(zip([None, *edges], [*edges, None], strict=True)):
        part = rows.filter((F.lit(True) if lo is None else F.col("at") > F.lit(lo)) & (F.lit(True) if hi is None else F.col("at") <= F.lit(hi)))
        part.coalesce(1).write.parquet(f"{path}/{k}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(path)
        stream_queries.run_stream(spark, ring.numbered_stream(stream, 10), out, checkpoint)
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(spark.read.parquet(out)) == key(ring.numbered(rows, 10))
    rows.unpersist()


def test_replay_fails_closed_on_a_gap(spark):
    inputs = model_queries._forecast_inputs(spark, FOLDER)
    w = Window.partitionBy("subscriber").orderBy("emitted", "prediction")
    rows = inputs.withColumn("sequence", F.row_number().over(w)).persist()
    floors = rows.groupBy("subscriber").agg((F.max("sequence") - 4).alias("floor"), F.max("sequence").alias("tail"))
    cursors = floors.select("subscriber", (F.col("floor") - 1 - F.col("subscriber") % 2).alias("after"))
    got = ring.replay_after(rows, cursors, floors).collect()
    gaps = {r["subscriber"] for r in got if r["reason"] == "retention_gap"}
    assert gaps and gaps == {r["subscriber"] for r in cursors.collect() if r["subscriber"] % 2}
    assert all(r["prediction"] is None for r in got if r["subscriber"] in gaps)
    sound = rows.join(floors.filter("subscriber % 2 = 0"), "subscriber").filter("sequence >= floor").select(*inputs.columns)
    assert sorted(map(tuple, [r for r in got if r["subscriber"] not in gaps])) == sorted(map(tuple, subscriptions.replay(sound).collect()))
    rows.unpersist()


def test_settlement_does_not_depend_on_buckets(spark):
    """Days or weeks as keys: the same revisions, also where one moves a fact away from a window."""
    facts = stream_queries.settlement_facts(spark, FOLDER).filter("subject % 7 = 0").persist()
    shown = ["subject", "window", "start", "end", "at", "status", "revision", "retracts"]
    days, weeks = (sorted((tuple(r) for r in settlement.settlement_history(facts, bucket_hours=h).select(*shown).collect()), key=repr) for h in (24.0, 168.0))
    assert days and days == weeks
    facts.unpersist()
    desk, hour = settlement.Desk(), 3_600_000_000
    moves = [(0, "window", "w", 0, 0, 24 * hour, None), (25 * hour, "outcome", "o", 0, hour, 2 * hour, "confirmed"), (30 * hour, "outcome", "o", 1, 50 * hour, 51 * hour, "confirmed")]
    assert [(x[4], x[5], x[6]) for x in desk.advance(moves)] == [("censored", 1, None), ("positive", 2, "censored"), ("censored", 3, "positive")]


def test_settlement_keys_are_few(spark):
    """A month of one subject's days is a handful of keys of the stream, not one or two a day."""
    facts = stream_queries.settlement_facts(spark, FOLDER)
    width = inspect.signature(settlement.settlement_stream).parameters["bucket_hours"].default
    keys = settlement.in_buckets(facts, width).select("subject", "bucket").distinct().groupBy("subject").count().agg(F.max("count")).first()[0]
    assert keys <= 7


def test_lanes_leave_the_settlement_of_one(spark, tmp_path):
    rows = stream_queries.settlement_facts(spark, FOLDER).filter("subject % 5 = 0").persist()
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    found = []
    for lanes in (1, 6):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        out = str(tmp_path / f"out{lanes}")
        stream_queries.run_stream(spark, settlement.settlement_stream(stream, lanes=lanes), out, str(tmp_path / f"c{lanes}"), 2)
        found.append(sorted(map(tuple, spark.read.parquet(out).collect()), key=repr))
    until = rows.crossJoin(F.broadcast(rows.agg((F.max("at") - F.expr("interval 1 hour")).alias("until"))))
    assert found[0] == found[1] == sorted(map(tuple, settlement.settlement_history(until, "until").collect()), key=repr)
    rows.unpersist()


def test_a_lane_of_subjects_is_one_state_and_one_timer():
    from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

    class Kept:
        value, calls = None, 0

        def exists(self):
            return self.value is not None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

    kept, timers = Kept(), []
    handle = type("Handle", (), {"getValueState": lambda self, *_: kept, "registerTimer": lambda self, t: timers.append(t)})()
    settler = settlement.Settler()
    settler.init(handle)
    day = pd.Timestamp("2024-01-01")
    rows = pd.DataFrame([(s, day, 0, "window", f"w{d}", 0, day + pd.Timedelta(days=d), day + pd.Timedelta(days=d + 1), None) for s in range(30) for d in range(3)], columns=["subject", "at", "tie", "kind", "entity", "revision", "start", "end", "status"])
    ms = lambda d: (day + pd.Timedelta(days=d)).value // 1_000_000
    assert not list(settler.handleInputRows((0, 0), iter([rows[:50], rows[50:]]), None)) and timers == [ms(1)] and kept.calls == 1
    out = pd.concat(list(settler.handleExpiredTimer((0, 0), TimerValues(0, ms(2.5)), ExpiredTimerInfo(ms(1)))))
    assert len(out) == 60 and set(out["window"]) == {"w0", "w1"} and set(out["status"]) == {"censored"} and (out["at"] == out["end"]).all()
    assert timers == [ms(1), ms(3)] and kept.calls == 3


def test_settlement_facts_are_written_once(spark, tmp_path, monkeypatch):
    """Both parts come from one reading of the events, also where the first has no rows."""
    spark.read.parquet(f"{FOLDER}/events.parquet").filter("ts >= '2024-01-20' and user_id < 5").write.parquet(str(tmp_path / "events.parquet"))
    calls, facts = [], stream_queries.settlement_facts
    monkeypatch.setattr(stream_queries, "settlement_facts", lambda *args: calls.append(args) or facts(*args))
    got = sorted(map(tuple, stream_queries.streamed_settlement(spark, str(tmp_path)).collect()), key=repr)
    assert len(calls) == 1 and got
    assert got == sorted(map(tuple, stream_queries.settled_as_of(spark, str(tmp_path)).collect()), key=repr)
