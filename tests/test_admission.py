import pytest
from helpers import ELECTION, at, receipt, rows, vote, votes
from pyspark.sql import functions as F

from tallyweave.config import JobConfig, Schedule
from tallyweave.functions.receipts import sha256_policy
from tallyweave.functions.text import normalize_id
from tallyweave.operators import admission, ingest, tally
from tallyweave.sources import generator, wire


def ms(second):
    return round(at(second).timestamp() * 1000)


def decide(spark, data, schedule=Schedule()):
    return {r["arrival_seq"]: (r["reason"], r["originalReceipt"]) for r in admission.admit(votes(spark, data), ELECTION, schedule).collect()}


def counts(spark, data, dimension, schedule=Schedule()):
    d = admission.admit(votes(spark, data), ELECTION, schedule).where("reason is null")
    return {r["key"]: r["count"] for r in tally.tally(d, (dimension,)).collect()}


def test_first_vote_counts_and_second_is_refused_with_the_first_receipt(spark):
    data = [vote(1, "v1", "cand-1"), vote(2, "v1", "cand-2"), vote(3, "v2", "cand-2")]
    assert counts(spark, data, "CANDIDATE") == {"cand-1": 1, "cand-2": 1}
    assert decide(spark, data)[2] == ("DUPLICATE_VOTE", receipt(1))


def test_arrival_decides_not_cast_time(spark):
    assert decide(spark, [vote(1, second=50), vote(2, second=1)]) == {1: (None, None), 2: ("DUPLICATE_VOTE", receipt(1))}


def test_refused_votes_keep_the_voters_place(spark):
    data = [vote(1, election="br-2030"), vote(2, city="  "), vote(3, castAt=None), vote(4, receipt="XYZ"), vote(5), vote(6, election="br-2030")]
    got = decide(spark, data)
    assert [got[i][0] for i in range(1, 7)] == ["WRONG_ELECTION", "INVALID_VOTE", "INVALID_VOTE", "INVALID_VOTE", None, "WRONG_ELECTION"]
    assert got[1][1] is None and got[6][1] == receipt(5)


def test_schedule_is_half_open_and_goes_before_duplicates(spark):
    s = Schedule(ms(-60), ms(30))
    got = decide(spark, [vote(1, second=10), vote(2, "v2", second=90), vote(3, second=90), vote(4, "v3", second=29.999), vote(5, "v4", second=30), vote(6, "v5", second=-61)], s)
    assert got == {1: (None, None), 2: ("ELECTION_CLOSED", None), 3: ("ELECTION_CLOSED", receipt(1)), 4: (None, None), 5: ("ELECTION_CLOSED", None), 6: ("ELECTION_NOT_OPEN", None)}


def test_cities_carry_their_state_and_states_are_upper_cased(spark):
    data = [vote(1, "a", state="mg", city="Bom Jesus"), vote(2, "b", state="RS", city="Bom Jesus"), vote(3, "c", state="MG ", city="Bom Jesus\t")]
    assert counts(spark, data, "CITY") == {"MG/Bom Jesus": 2, "RS/Bom Jesus": 1}
    assert counts(spark, data, "STATE") == {"MG": 2, "RS": 1}


def test_null_voter_extra_columns_and_empty_input(spark):
    df = votes(spark, [vote(1, voterId=None), vote(2)]).withColumn("first", F.lit(1)).withColumn("note", F.lit("x"))
    df = df.withColumns({c: F.lit("old") for c in ("reason", "originalReceipt", "voter", "valid", "screened", "standing")})
    got = admission.admit(df, ELECTION)
    assert rows(got, "arrival_seq", "reason", "note", "first", "voter", "standing") == [(1, "INVALID_VOTE", "x", 1, None, "old"), (2, None, "x", 1, "v1", "old")]
    assert admission.admit(votes(spark, []), ELECTION).count() == 0


def test_hot_voter(spark):
    data = [vote(i, "hot" if i % 3 else f"v{i}") for i in range(1, 200)]
    got = decide(spark, data)
    assert got[1] == (None, None) and got[2] == ("DUPLICATE_VOTE", receipt(1))
    assert sum(r[0] is None for r in got.values()) == 1 + len([i for i in range(1, 200) if i % 3 == 0])


def test_normalisation(spark):
    df = spark.createDataFrame([(" a\t",), ("",), (" ",), (None,), ("x" * 128,), ("x" * 129,), (" " + "x" * 128,), ("a ",)], "s string")
    assert [r[0] for r in df.select(normalize_id("s")).collect()] == ["a", None, None, None, "x" * 128, None, "x" * 128, "a "]


def test_receipt_sample(spark):
    c = sha256_policy("pepper-de-teste")(F.lit(ELECTION), F.lit("voter-1"), F.lit("cand-1"), F.lit(1791118800000))
    assert spark.range(1).select(c).first()[0] == "31ee07a4d1d54079e8c9fbda87230bc4920e9c8a240be921519909a6ec4c8c1a"
    with pytest.raises(ValueError):
        sha256_policy("  ")


def test_events_hide_the_candidate(spark):
    d = admission.admit(votes(spark, [vote(1)]), ELECTION)
    assert admission.accepted_events(d, 60_000).columns == ["schemaVersion", "receipt", "voterId", "windowId", "castAt"]
    assert "candidateId" not in ingest.receipt_events(d.withColumn("error", F.lit(None).cast("string"))).columns


def test_tally_log_and_books(spark):
    data = [vote(1, "a", "x", second=5), vote(2, "b", "x", second=3), vote(3, "c", "y"), vote(4, "a", "y")]
    d = admission.admit(votes(spark, data), ELECTION)
    log = tally.changelog(d.where("reason is null"), "CANDIDATE")
    assert rows(log, "key", "count", "arrival_seq") == [("x", 1, 1), ("x", 2, 2), ("y", 1, 3)]
    last = {r["key"]: r for r in tally.compact(log).collect()}
    assert last["x"]["count"] == 2 and last["x"]["updatedAt"].second == 3
    book = tally.reconcile(d).first()
    assert book["balanced"] and (book["requests"], book["accepted"], book["rejected"]) == (4, 3, 1)
    assert tally.reconcile(d.limit(0)).first()["balanced"]


def test_edge(spark):
    req = spark.createDataFrame([(None, "v", "c", "p", "sp", "X"), ("other", "v", "c", "p", "sp", "X"), (" ", "v", " ", "p", "sp", "X")], "electionId string, voterId string, candidateId string, partyId string, state string, city string")
    now = F.lit("2026-10-04T13:00:00Z").cast("timestamp")
    got = ingest.cast_votes(req, ELECTION, Schedule(), sha256_policy("p"), now)
    assert [(r["error"], r["status"], r["receipt"] is not None) for r in got.collect()] == [(None, 201, True), ("ELEICAO_INCORRETA", 400, False), ("VOTO_INVALIDO", 400, False)]
    assert got.first()["state"] == "SP"
    closed = ingest.cast_votes(req, ELECTION, Schedule(None, 1), sha256_policy("p"), now)
    assert [r["status"] for r in closed.collect()] == [403, 400, 403]


def test_config():
    assert JobConfig().merkle_window_ms == 60_000
    c = JobConfig.from_args(["--merkle.window.ms", "15000", "--exactly.once", "false", "--election.opens.at", "2026-10-04T08:00:00Z"])
    assert c.merkle_window_ms == 15_000 and not c.exactly_once and c.schedule() == Schedule()
    for bad in (["--nope", "1"], ["--parallelism"], ["--merkle.window.ms", "0"]):
        with pytest.raises(ValueError):
            JobConfig.from_args(bad)
    with pytest.raises(ValueError):
        Schedule.of("2026-10-04T08:00:00Z", "2026-10-04T08:00:00Z")
    with pytest.raises(ValueError):
        Schedule.of("2026-10-04T08:00:00Z", "", strict=True)


def test_generator(spark):
    people, places = [(str(i), f"P{i}") for i in range(12)], [("SP", "A", 900), ("RR", "B", 50), ("MG", "C", 50)]
    a = generator.ballots(spark, 10_000, people, places, 0.2)
    assert rows(a.limit(300)) == rows(generator.ballots(spark, 10_000, people, places, 0.2).limit(300))
    assert abs(a.where("duplicate").count() - 2000) < 200
    n = {r["candidateId"]: r["count"] for r in a.groupBy("candidateId").count().collect()}
    assert len(n) == 12 and max(n.values()) > 5 * min(n.values())
    s = {r["state"]: r["count"] for r in a.groupBy("state").count().collect()}
    assert s["SP"] > s["RR"] > 0


def test_submitted_votes_have_receipts_or_503(spark, tmp_path):

    cast = ingest.cast_votes(votes(spark, [vote(1), vote(2, "v2", election="other")]).drop("receipt", "castAt"), ELECTION, Schedule(), sha256_policy("p"), F.lit("2026-10-04T13:00:00Z").cast("timestamp"))
    topics = wire.FileTopics(f"{tmp_path}/topics")
    done = ingest.submit(cast, topics, 0)
    assert rows(done, "status") == [(201,), (400,)]
    again = ingest.submit(cast, topics, 0)  # a batch sent again is there once
    sent = wire.decode(spark.read.json(f"{tmp_path}/topics/votes.receipts"), wire.RECEIPT)[0]
    assert rows(sent, "receipt") == rows(again.where("error is null"), "receipt") and sent.count() == 1

    class Down:
        def send(self, *a):
            raise OSError("no broker")

    lost = ingest.submit(cast, Down(), 1)
    assert rows(lost, "status", "error", "receipt") == [(400, "ELEICAO_INCORRETA", None), (503, "REGISTRO_INDISPONIVEL", None)]
