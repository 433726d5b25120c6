"""The timeline of votes and control events, window markers and late votes.

Time is data: a control event moves the watermark like a vote does, and so do votes
that are refused. A window is marked when the watermark (latest event time seen minus
the bound) has reached its end; a vote is late when the watermark of everything that
arrived strictly before it had.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.config import Schedule
from tallyweave.functions.windows import check_size, window_id, window_start_ms
from tallyweave.operators.ranking import running_max_before

HEARTBEAT, CLOSED = "HEARTBEAT", "ELECTION_CLOSED"
BOUND_MS, MARGIN_MS, HEARTBEAT_MS = 5_000, 30_000, 5_000
_CONTROL = "schemaVersion int, type string, electionId string, at timestamp"


def heartbeats(spark: SparkSession, election: str, from_ms: int, to_ms: int, every_ms: int = HEARTBEAT_MS) -> DataFrame:
    """One control event per interval of the edge's clock in [from, to]."""
    check_size(every_ms)
    ids = spark.range(max(0, (to_ms - from_ms) // every_ms + 1))
    return ids.select(F.lit(1).alias("schemaVersion"), F.lit(HEARTBEAT).alias("type"), F.lit(election).alias("electionId"), F.timestamp_millis(F.col("id") * every_ms + from_ms).alias("at"))


def closing_sentinel(spark: SparkSession, election: str, schedule: Schedule, now_ms: int, margin_ms: int = MARGIN_MS, bound_ms: int = BOUND_MS) -> DataFrame:
    """The event that says no more votes come: none before the close, afterwards one,
    always stamped close + margin, whenever the clock woke up."""
    if margin_ms <= bound_ms:
        raise ValueError("the sentinel's margin must exceed the watermark's bound")
    if schedule.closes is None or now_ms < schedule.closes:
        return spark.createDataFrame([], _CONTROL)
    return spark.range(1).select(F.lit(1).alias("schemaVersion"), F.lit(CLOSED).alias("type"), F.lit(election).alias("electionId"), F.timestamp_millis(F.lit(schedule.closes + margin_ms)).alias("at"))


def timeline(votes: DataFrame, control: DataFrame) -> DataFrame:
    """Votes and control events under one envelope: kind, at, and the vote's columns
    (null for control events)."""
    v = votes.withColumns({"kind": F.lit("VOTE"), "at": F.col("castAt")})
    c = control.select(F.lit("CONTROL").alias("kind"), "at", "electionId", F.col("schemaVersion"))
    return v.unionByName(c, allowMissingColumns=True)


def votes_only(line: DataFrame) -> DataFrame:
    """Drop control events. The predicate reads the event time, so that in a stream it
    is not moved below the watermark, where control events would be lost."""
    return line.where(F.when(F.col("kind") == "VOTE", F.coalesce(F.col("at") == F.col("at"), F.lit(True))).otherwise(False))


def mark_late(decisions: DataFrame, window_ms: int, bound_ms: int = BOUND_MS, order: str = "arrival_seq") -> DataFrame:
    """Add ``window_ms`` (start) and ``late``: the window had been closed by what
    arrived before. Needs one total arrival order."""
    timed = decisions.withColumn("_at", F.unix_millis("castAt"))
    seen = running_max_before(timed, "_at", order, "_seen")
    start = window_start_ms(F.col("_at"), window_ms)
    return seen.withColumn("window_ms", start).withColumn("late", F.coalesce(start + window_ms <= F.col("_seen") - bound_ms, F.lit(False))).drop("_at", "_seen")


def markers(decisions: DataFrame, window_ms: int, control: DataFrame | None = None, bound_ms: int = BOUND_MS, distinct: str | None = None) -> DataFrame:
    """One marker per closed window that has accepted votes in time; empty windows have
    none. ``decisions`` holds every vote (refused ones move time too) with ``window_ms``
    and ``late`` from mark_late. ``distinct`` counts different values of a column instead
    of votes: two accepted votes with one receipt are one leaf, and a window that counts
    them twice never completes."""
    latest = decisions.agg(F.max(F.unix_millis("castAt"))).first()[0]
    if control is not None:
        told = control.agg(F.max(F.unix_millis("at"))).first()[0]
        latest = max((x for x in (latest, told) if x is not None), default=None)
    in_time = decisions.where(F.col("reason").isNull() & ~F.col("late"))
    end = F.col("window_ms") + window_ms
    counts = in_time.groupBy("window_ms").agg((F.count_distinct(distinct) if distinct else F.count(F.lit(1))).alias("count"))
    closed = counts.where(end + bound_ms <= F.lit(latest).cast("bigint"))
    return closed.select(
        F.lit(1).alias("schemaVersion"), window_id(F.col("window_ms")).alias("windowId"),
        F.timestamp_millis("window_ms").alias("windowStart"), F.timestamp_millis(end).alias("windowEnd"), "count",
    )
