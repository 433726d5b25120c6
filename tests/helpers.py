from datetime import datetime, timedelta, timezone

T0 = datetime(2026, 10, 4, 13, 0, tzinfo=timezone.utc)
ELECTION = "br-2026-presidencial"
VOTE = "arrival_seq bigint, electionId string, voterId string, candidateId string, partyId string, state string, city string, castAt timestamp, receipt string"


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def receipt(i: int) -> str:
    return f"{i:064x}"


def vote(seq, voter="v1", candidate="cand-1", state="SP", city="Sao Paulo", second=0.0, election=ELECTION, party="P1", **other):
    row = dict(arrival_seq=seq, electionId=election, voterId=voter, candidateId=candidate, partyId=party, state=state, city=city, castAt=at(second), receipt=receipt(seq))
    row.update(other)
    return row


def votes(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in VOTE.split(", ")) for r in rows], VOTE)


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)
