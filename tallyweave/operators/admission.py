"""Admission: one vote per voter, by first arrival; every refusal gives a row.

Order of the rules: INVALID_VOTE, WRONG_ELECTION, ELECTION_NOT_OPEN, ELECTION_CLOSED,
DUPLICATE_VOTE. A vote refused by the first four does not use up the voter's place.
A refusal other than INVALID_VOTE names the receipt that stood at its arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.config import Schedule
from tallyweave.functions.text import is_receipt, normalize_id, trim_low
from tallyweave.functions.windows import window_id, window_start_ms
from tallyweave.operators.hotkeys import skew_join

REASONS = ("INVALID_VOTE", "WRONG_ELECTION", "ELECTION_NOT_OPEN", "ELECTION_CLOSED", "DUPLICATE_VOTE")
IDS = {"electionId": "election", "voterId": "voter", "candidateId": "candidate", "partyId": "party", "state": "region", "city": "place"}
VERSION = 1


def normalize(votes: DataFrame) -> DataFrame:
    """Add the values as the domain holds them (election, voter, candidate, party,
    region, place), each null where it is not valid, and ``valid`` for the whole vote."""
    out = votes.withColumns({name: normalize_id(c) for c, name in IDS.items()}).withColumn("region", F.upper("region"))
    ok = F.col("castAt").isNotNull() & is_receipt("receipt")
    for name in IDS.values():
        ok = ok & F.col(name).isNotNull()
    return out.withColumn("valid", ok)


def schedule_reason(cast_ms: Column, schedule: Schedule) -> Column:
    """Null within the schedule, else why not."""
    reason = F.lit(None).cast("string")
    if schedule.closes is not None:
        reason = F.when(cast_ms >= schedule.closes, "ELECTION_CLOSED").otherwise(reason)
    if schedule.opens is not None:
        reason = F.when(cast_ms < schedule.opens, "ELECTION_NOT_OPEN").otherwise(reason)
    return reason


def screen(votes: DataFrame, election: str, schedule: Schedule = Schedule()) -> DataFrame:
    """Normalised votes with ``screened``: the reason that does not depend on others."""
    reason = (
        F.when(~F.col("valid"), "INVALID_VOTE")
        .when(F.col("election") != election, "WRONG_ELECTION")
        .otherwise(schedule_reason(F.unix_millis("castAt"), schedule))
    )
    return normalize(votes).withColumn("screened", reason)


def admit(votes: DataFrame, election: str, schedule: Schedule = Schedule(), order: str = "arrival_seq") -> DataFrame:
    """Decisions: the votes with normalised values, ``reason`` (null: accepted) and
    ``originalReceipt``.

    The first eligible vote of each voter is found by an aggregation with partial
    minima and joined back; a voter who sent a third of all rows is split over tasks
    in that join. Empty input gives no rows; rows without a voter are INVALID_VOTE.
    Other columns are carried along; those named like a value that this adds are
    replaced by it."""
    screened = screen(votes.drop("reason", "originalReceipt", "_first", "_standing"), election, schedule)
    firsts = screened.where(F.col("screened").isNull()).groupBy("voter").agg(F.min(F.struct(F.col(order).alias("_first"), F.col("receipt").alias("_standing"))).alias("_f"))
    firsts = firsts.select("voter", "_f._first", "_f._standing")
    tasks = int(votes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Loads from the trimmed column alone: normalising all values is dearer than the estimate.
    loads = votes.select(trim_low("voterId").alias("voter"))
    joined = skew_join(screened, firsts, ("voter",), [order], tasks, "left", estimate=loads)
    later = F.coalesce(F.col(order) > F.col("_first"), F.lit(False))
    reason = F.when(F.col("screened").isNotNull(), F.col("screened")).when(later, "DUPLICATE_VOTE")
    original = F.when(later & ~F.col("screened").eqNullSafe("INVALID_VOTE"), F.col("_standing"))
    return joined.select(*screened.drop("screened").columns, reason.alias("reason"), original.alias("originalReceipt"))


def accepted_events(decisions: DataFrame, window_ms: int, *keep: str) -> DataFrame:
    """What the seal may see of an accepted vote: never the candidate."""
    start = window_start_ms(F.unix_millis("castAt"), window_ms)
    return decisions.where(F.col("reason").isNull()).select(F.lit(VERSION).alias("schemaVersion"), "receipt", "voterId", window_id(start).alias("windowId"), "castAt", *keep)


def rejected_events(decisions: DataFrame, *keep: str) -> DataFrame:
    """Refusals with values as they came; ``rejectedAt`` is the event's own time."""
    return decisions.where(F.col("reason").isNotNull()).select(
        F.lit(VERSION).alias("schemaVersion"), "electionId", "voterId", "candidateId", "receipt", "reason", "originalReceipt", F.col("castAt").alias("rejectedAt"), *keep
    )
