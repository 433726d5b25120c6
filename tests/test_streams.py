import pytest
from helpers import ELECTION, at, receipt, rows, vote, votes
from pyspark.sql import functions as F

from tallyweave.config import JobConfig, Schedule
from tallyweave.functions.windows import window_id
from tallyweave.operators import admission, chain, tally, timeline
from tallyweave.operators.ledger import Ledger
from tallyweave.sources import wire
from tallyweave.streaming import panes, pipeline
from tallyweave.streaming.job import TallyJob
from tallyweave.operators.late import Slicing, compose, pane_log, to_panes
from tallyweave.operators.panes import PaneStore

CONTROL = "schemaVersion int, type string, electionId string, at timestamp"


def ms(second):
    return round(at(second).timestamp() * 1000)


def data(n=60):
    return [vote(i, f"v{i * 7 % 40}" if i % 11 else None, f"c{i % 3}", "sp" if i % 2 else "MG", f"City{i % 4}", second=i * 2.5, election="other" if i % 13 == 0 else ELECTION) for i in range(1, n + 1)]


def test_job_equals_batch_over_restarts(spark, tmp_path):
    """Slices of arrival, the job stopped and started after each: decisions, counts, late
    votes, markers and the chain are those of all rows at once. One vote comes late, one
    receipt twice."""
    src, ctl, out = f"{tmp_path}/votes", f"{tmp_path}/control", f"{tmp_path}/job"
    late = [vote(61, "late1", second=3.0), vote(62, "twice1", second=140, receipt="ab" * 32), vote(63, "twice2", second=141, receipt="ab" * 32), vote(64, "v9", second=200)]
    df = votes(spark, data(40) + late)
    control = spark.createDataFrame([(1, "ELECTION_CLOSED", ELECTION, at(600))], CONTROL)
    control.limit(0).write.parquet(ctl)
    source = lambda path, like: spark.readStream.schema(like.schema).parquet(path)

    def run():
        pipeline.run_to_end(
            lambda: pipeline.decisions_query(source(src, df), source(ctl, control), out, ELECTION), lambda: pipeline.tally_query(spark, out),
            lambda: pipeline.events_query(spark, out, 15_000), lambda: pipeline.ledger_query(spark, out, 15_000))

    for low, high in ((0, 20), (20, 61), (61, 99)):
        df.where((F.col("arrival_seq") > low) & (F.col("arrival_seq") <= high)).coalesce(1).write.mode("append").parquet(src)
        if high == 99:
            control.write.mode("append").parquet(ctl)
        run()
    batch = admission.admit(df, ELECTION)
    got = pipeline.read_decisions(spark, out, False)
    assert got.count() == df.count() + 1
    assert rows(got.where("kind = 'VOTE'"), "arrival_seq", "reason", "originalReceipt") == rows(batch, "arrival_seq", "reason", "originalReceipt")
    counted = tally.tally(batch.where("reason is null"))
    assert rows(pipeline.standings(spark, out), "dimension", "key", "count") == rows(counted, "dimension", "key", "count")
    t = timeline.mark_late(batch, 15_000)
    assert rows(spark.read.schema("arrival_seq bigint").parquet(f"{out}/late/*"), "arrival_seq") == rows(t.where("reason is null and late"), "arrival_seq") != []
    told = timeline.markers(t, 15_000, control, distinct="receipt")
    topic = lambda name: spark.read.json(f"{out}/topics/{name}")
    sent = wire.decode(topic("votes.windows"), wire.WINDOW_MARKER)[0]
    assert rows(sent, "windowId", "count", "windowEnd") == rows(told, "windowId", "count", "windowEnd")
    in_time = t.where("reason is null and not late").select(window_id(F.col("window_ms")).alias("windowId"), "receipt")
    want = chain.seal(in_time, told)[2]
    ledger = Ledger(spark, f"{out}/ledger")
    assert rows(ledger.records().drop("sealedAt"), *want.columns) == rows(want, *want.columns) and want.count() == told.count()
    assert ledger.health().first()["pendingWindows"] == 0
    roots = wire.decode(topic("merkle.roots"), wire.ROOT)[0]
    assert rows(roots, "windowId", "sequence", "root") == rows(want, "windowId", "sequence", "root") and roots.where("sealedAt is null").count() == 0
    assert (topic("votes.accepted").count(), topic("votes.rejected").count()) == (batch.where("reason is null").count(), batch.where("reason is not null").count())
    states = topic("results.by-state")
    last = wire.decode(states, wire.TALLY_UPDATE)[0].groupBy("key").agg(F.max("count").alias("count"))
    assert rows(last, "key", "count") == rows(counted.where("dimension = 'STATE'"), "key", "count") and states.where("timestamp is null").count() == 0
    # A batch that is repeated changes nothing.
    assert pipeline.ledger_step(ledger, got, ledger.meta()["batch"], 15_000) is None


def test_control_events_move_the_clock_and_never_count(spark, tmp_path):
    names = [c.split()[0] for c in pipeline.LINE.split(", ")]
    row = lambda seq, kind, s: tuple({"arrival_seq": seq, "kind": kind, "at": at(s), "castAt": at(s) if kind == "VOTE" else None, "receipt": receipt(seq or 0)}.get(n) for n in names)
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    step = lambda n, *data: pipeline.ledger_step(ledger, spark.createDataFrame(data, pipeline.LINE), n, 60_000)
    assert step(0, row(1, "VOTE", 1), row(2, "VOTE", 2)).count() == 0
    assert rows(step(1, row(None, "CONTROL", 65)), "windowId", "count") == [("2026-10-04T13:00:00Z", 2)]
    assert step(2, row(3, "VOTE", 3), row(None, "CONTROL", 70)).count() == 0  # late: neither leaf nor marker
    assert ledger.leaves().count() == 2 and ledger.records().count() == 1 and ledger.refused().count() == 0


def test_job_reads_topics_and_keeps_dead_letters(spark, tmp_path):
    """The job as its main runs it, from topics of JSON records to topics of JSON records."""
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    config = JobConfig.from_args(["--election.id", ELECTION, "--merkle.window.ms", "15000", "--parallelism", "2", "--topic.accepted", "folhas"])
    topics, df = wire.FileTopics(f"{tmp_path}/topics"), votes(spark, data(12))
    topics.send(df.coalesce(1).withColumn("schemaVersion", F.lit(1)), "votes.cast", 0)
    spark.createDataFrame([("k", "{oops"), ("k", None)], "key string, value string").write.mode("append").json(f"{tmp_path}/topics/votes.cast/batch=0")
    topics.send(spark.createDataFrame([(1, "ELECTION_CLOSED", ELECTION, at(600))], CONTROL), "votes.control", 0)
    job = TallyJob(spark, config, str(tmp_path))
    try:
        job.run_to_end()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    batch = admission.admit(df, ELECTION)
    assert spark.read.json(f"{tmp_path}/topics/folhas").count() == batch.where("reason is null").count()
    assert rows(pipeline.read_decisions(spark, str(tmp_path), False).where("kind = 'VOTE'"), "receipt", "reason") == rows(batch, "receipt", "reason")
    assert rows(spark.read.parquet(f"{tmp_path}/dead-letters/votes.cast"), "value") == [("{oops",), (None,)]
    assert spark.read.json(f"{tmp_path}/topics/merkle.roots").count() > 0
    with pytest.raises(ValueError):
        TallyJob(spark, config, str(tmp_path), kafka=True)


def test_streamed_panes_count_whatever_comes_when(spark, tmp_path):
    """Files in any order: the oldest arrivals come last. Every row is counted, and what was
    emitted last for each closed window is what the batch form says."""
    s = Slicing(size=30_000, slide=15_000, delay=5_000, cutoff=60_000, tick=5_000)
    lag = [0, 1, 30, 3, 70, 0, 45, 8, 200, 2]
    events = [(i, at(i * 4), at(i * 4 + lag[i % 10]) if i % 17 else None) for i in range(1, 50)] + [(99, None, at(5000))]
    df = spark.createDataFrame(events, "n int, event timestamp, arrived timestamp").cache()
    for cut in ("arrived >= timestamp_millis(%d)" % ms(200), "arrived < timestamp_millis(%d) and n %% 2 = 0" % ms(200), "arrived is null or (arrived < timestamp_millis(%d) and n %% 2 = 1)" % ms(200)):
        df.where(cut).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    panes.emit_corrections(stream, "event", "arrived", s, f"{tmp_path}/out").start().awaitTermination()
    want = compose(pane_log(to_panes(df, F.unix_millis("event"), F.unix_millis("arrived"), s)), s)
    store = PaneStore(spark, f"{tmp_path}/out/store", s)
    assert rows(store.counts(), "window_start", "revision", "n") == rows(want, "window_start", "revision", "n")
    told = store.emissions()
    last = told.join(told.groupBy("window_ms").agg(F.max("version").alias("version")), ["window_ms", "version"])
    assert rows(last, "window_start", "revision", "n") == rows(want, "window_start", "revision", "n")
    assert told.select("version").distinct().count() == 3
    # A batch that is repeated after a failure counts once; one without rows changes nothing.
    batch = to_panes(df, F.unix_millis("event"), F.unix_millis("arrived"), s)
    assert not store.apply(batch, 2) and store.apply(batch.limit(0), 3)
    assert rows(store.counts(), "window_start", "n") == rows(want, "window_start", "n")


def test_only_windows_over_changed_panes_are_emitted(spark, tmp_path):
    s = Slicing(size=30_000, slide=15_000, delay=5_000, cutoff=60_000, tick=5_000)
    store = PaneStore(spark, f"file://{tmp_path}/s", s, ("g",), period_ms=60_000)
    step = lambda data: store.apply(to_panes(spark.createDataFrame(data, "g string, e bigint, a bigint"), F.col("e"), F.col("a"), s))
    emitted = lambda v: rows(store.emissions().where(F.col("version") == v), "g", "window_ms", "revision", "n")
    assert store.counts().count() == 0 and store.corrections(spark.createDataFrame([], "g string, pane_ms bigint, tick bigint")) is None
    step([("a", 1_000, 2_000), ("a", 200_000, 201_000), (None, 16_000, 17_000)])
    # Windows that the arrival clock has closed; the two over the last pane stay open.
    assert emitted(1) == sorted([("a", -15_000, 0, 1), ("a", 0, 0, 1), (None, 0, 0, 1), (None, 15_000, 0, 1)], key=str)
    step([("a", 20_000, 52_000), ("a", 300_000, 301_000), ("a", 1_000, 299_000)])
    # One late row: the windows at 0 and 15 s are corrected; the row beyond the cut-off changes nothing.
    assert emitted(2) == sorted([("a", 0, 0, 1), ("a", 0, 4, 2), ("a", 15_000, 1, 1), ("a", 180_000, 0, 1), ("a", 195_000, 0, 1)], key=str)
    late = to_panes(spark.createDataFrame([("a", 20_000, 52_000), ("a", 1_000, 299_000), ("a", 200_000, 201_000), ("b", 20_000, 52_000)], "g string, e bigint, a bigint"), F.col("e"), F.col("a"), s)
    assert rows(store.corrections(late), "g", "pane_ms") == [("a", 15_000)]


def test_sentinel_and_heartbeats(spark):
    s = Schedule(None, ms(0))
    assert timeline.closing_sentinel(spark, ELECTION, s, ms(-1)).count() == 0
    for woke in (1, 7, 29):
        assert rows(timeline.closing_sentinel(spark, ELECTION, s, ms(woke)), F.unix_millis("at")) == [(ms(30),)]
    with pytest.raises(ValueError):
        timeline.closing_sentinel(spark, ELECTION, s, ms(1), margin_ms=5_000)
    assert timeline.heartbeats(spark, ELECTION, ms(0), ms(12)).count() == 3


def test_votes_only_keeps_votes_without_a_time(spark):
    df = votes(spark, [vote(1), vote(2, castAt=None)])
    ctl = spark.createDataFrame([(1, "HEARTBEAT", ELECTION, at(5))], CONTROL)
    assert rows(timeline.votes_only(timeline.timeline(df, ctl)), "arrival_seq") == [(1,), (2,)]


def test_late_votes_and_markers(spark):
    d = admission.admit(votes(spark, [vote(1, "a", second=1), vote(2, "b", second=40), vote(3, "c", second=2), vote(4, "d", second=41), vote(5, "e", city=" ", second=90)]), ELECTION)
    t = timeline.mark_late(d, 15_000)
    assert rows(t.where("late"), "arrival_seq") == [(3,)]
    assert rows(timeline.markers(t, 15_000), "windowId", "count") == [("2026-10-04T13:00:00Z", 1), ("2026-10-04T13:00:30Z", 2)]


def test_json_events(spark):
    good = '{"schemaVersion":1,"type":"HEARTBEAT","electionId":"e","at":"2026-10-04T13:00:00.250Z","extra":[1]}'
    raw = spark.createDataFrame([(1, good), (2, "null"), (3, "{oops"), (4, '{"type":"X"}'), (5, None), (6, '{"at":"yesterday"}'), (7, "")], "n int, value string")
    events, corrupt = wire.decode(raw, wire.CONTROL)
    assert rows(events, "n", "type", F.unix_millis("at") % 1000) == [(1, "HEARTBEAT", 250), (4, "X", None)]
    assert rows(corrupt, "n") == [(2,), (3,), (5,), (6,), (7,)]
    out = wire.encode(events.where("n = 1"), wire.CONTROL, "type").first()
    assert out["key"] == "HEARTBEAT" and out["value"] == '{"schemaVersion":1,"type":"HEARTBEAT","electionId":"e","at":"2026-10-04T13:00:00.250Z"}'
    assert wire.decode(spark.createDataFrame([(out["value"],)], "value string"), wire.CONTROL)[0].count() == 1


def test_lists_topics_and_console(spark, tmp_path):
    (tmp_path / "p.csv").write_text("uf,municipio,peso\nSP,São Paulo,10\n\nMG,Ouro Preto,\n", encoding="utf-8")
    assert rows(wire.read_list(spark, f"{tmp_path}/p.csv", wire.PLACES)) == [("MG", "Ouro Preto", None), ("SP", "São Paulo", 10)]
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 5), ("b", 3, 1)], "key string, n int, v int")
    assert rows(wire.latest(df, "key", "n")) == [("a", 2, 5), ("b", 3, 1)]
    assert [r["n"] for r in wire.console(df, "n", 2).collect()] == [3, 2]
