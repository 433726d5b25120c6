"""The job's queries, each restartable from its checkpoint.

decisions  admits votes; every decision and control event becomes a row of the line
events     accepted and rejected votes as keyed records
tallies    running counts, and the keys that each batch changed as keyed records
ledger     moves the event clock with every row of the line, keeps late votes apart, adds
           leaves, marks the windows that the clock has closed and seals what is complete

The last three read the line that the first one writes. A batch that is repeated after a
failure writes the same records again and changes neither counts nor ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.config import Schedule
from tallyweave.functions.windows import check_size, window_id
from tallyweave.operators import tally
from tallyweave.operators.ledger import Ledger
from tallyweave.operators.timeline import mark_late
from tallyweave.operators.trees import leaf_set
from tallyweave.session import written
from tallyweave.sources import wire
from tallyweave.streaming.admission import DECISION, admit_stream

LINE = DECISION + ", kind string, at timestamp"
ONCE = {"availableNow": True}


def decisions_query(votes: DataFrame, control: DataFrame | None, folder: str, election: str, schedule: Schedule = Schedule(), **trigger):
    """The file sink and its log make the line exactly-once."""
    line = admit_stream(votes, election, schedule).withColumns({"kind": F.lit("VOTE"), "at": F.col("castAt")})
    if control is not None:
        line = line.unionByName(control.select(F.lit("CONTROL").alias("kind"), "at"), allowMissingColumns=True)
    return line.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/decisions").option("checkpointLocation", f"{folder}/checkpoints/decisions").queryName("decisions").trigger(**trigger or ONCE)


def read_decisions(spark: SparkSession, folder: str, stream: bool = True) -> DataFrame:
    reader = (spark.readStream if stream else spark.read).schema(LINE)
    return reader.parquet(f"{folder}/decisions")


def counters(decisions: DataFrame, name: str = "admission") -> DataFrame:
    """The frame with the job's counters attached: acceptedVotes and rejectedVotes are
    reported as metrics of every batch that passes."""
    return decisions.observe(name, F.count(F.when(F.col("reason").isNull(), 1)).alias("acceptedVotes"), F.count("reason").alias("rejectedVotes"))


def events_query(spark: SparkSession, folder: str, window_ms: int, topics=None, names: dict[str, str] | None = None, **trigger):
    """Accepted and rejected votes to their topics (see wire.FileTopics)."""
    line = counters(read_decisions(spark, folder).where("kind = 'VOTE'"))
    topics, names = topics or wire.FileTopics(f"{folder}/topics"), names or {}

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        ms = F.unix_millis("castAt")
        accepted = batch.where("reason is null").select(F.lit(1).alias("schemaVersion"), "receipt", "voterId", window_id(ms - F.pmod(ms, F.lit(window_ms))).alias("windowId"), "castAt")
        rejected = batch.where("reason is not null").select(F.lit(1).alias("schemaVersion"), "electionId", "voterId", "candidateId", "receipt", "reason", "originalReceipt", F.col("castAt").alias("rejectedAt"))
        topics.send(accepted, "votes.accepted", number, names.get("votes.accepted"))
        topics.send(rejected, "votes.rejected", number, names.get("votes.rejected"))
        batch.unpersist()

    return line.writeStream.option("checkpointLocation", f"{folder}/checkpoints/events").queryName("events").trigger(**trigger or ONCE).foreachBatch(write)


def tally_query(spark: SparkSession, folder: str, topics=None, **trigger):
    """Running counts: each batch writes the keys it changed, under its own number, so a
    repeated batch overwrites itself. The last count of a key is its greatest."""
    line = read_decisions(spark, folder).where((F.col("kind") == "VOTE") & F.col("reason").isNull())
    counts = tally.tally(line)
    topics = topics or wire.FileTopics(f"{folder}/topics")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/tallies/batch={number}")
        again = spark.read.schema(batch.schema).parquet(f"{folder}/tallies/batch={number}").withColumn("schemaVersion", F.lit(1))
        for d in tally.DIMENSIONS:
            topics.send(again.where(F.col("dimension") == d), f"results.by-{d.lower()}", number)

    return counts.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoints/tallies").queryName("tallies").trigger(**trigger or ONCE).foreachBatch(write)


def standings(spark: SparkSession, folder: str) -> DataFrame:
    """The compacted view of the running counts."""
    return tally.compact(spark.read.parquet(f"{folder}/tallies"))


def ledger_step(ledger: Ledger, line: DataFrame, number: int, window_ms: int, bound_ms: int = 5_000, late_to: str | None = None) -> DataFrame | None:
    """Take one batch of the line in and return the markers of the windows that it closed.

    The event clock is the latest time of any row so far, control events and refused votes
    too, less the bound; the manifest keeps it. A vote is late if the rows that arrived before
    it had closed its window: it has been counted, but stays out of markers and trees. Control
    events move the clock after the votes of their batch. A marker counts different receipts,
    as leaves do. A batch that was taken in before is left out (None)."""
    check_size(window_ms)
    meta = ledger.meta()
    if number <= meta.get("batch", -1):
        return None
    spark, seen = ledger.spark, meta.get("seen")
    votes = written(line.where("kind = 'VOTE'").select("arrival_seq", "castAt", "receipt", "reason"), "line")
    marked = mark_late(votes, window_ms, bound_ms)
    if seen is not None:  # what earlier batches had closed
        marked = marked.withColumn("late", F.col("late") | F.coalesce(F.col("window_ms") + window_ms <= F.lit(seen - bound_ms), F.lit(False)))
    mine = written(marked.where("reason is null").select("arrival_seq", "receipt", window_id(F.col("window_ms")).alias("windowId"), "late"), "accepted")
    if late_to:
        mine.where("late").drop("late").write.mode("overwrite").parquet(f"{late_to}/batch={number}")
    latest = line.agg(F.max(F.unix_millis("at"))).first()[0]
    now = max((x for x in (seen, latest) if x is not None), default=None)
    ledger.apply(mine.where("not late").select("windowId", "receipt"))
    if now is None:
        ledger.apply(batch=number, seen=None)
        return None
    # Windows whose end the clock has passed with this batch; those before are marked.
    state = ledger.store.state()
    last, first = (now - bound_ms) // ledger.period, None if seen is None else (seen - bound_ms) // ledger.period - -(-window_ms // ledger.period)
    parts = [p for p in ledger.store.parts(state, "leaves") if p <= last and (first is None or p >= first)]
    found = ledger._table(state, "leaves", "windowId string, receipt string", parts)
    start = F.unix_millis(F.col("windowId").cast("timestamp"))
    end = start + window_ms + bound_ms
    due = found.withColumn("_end", end).where((F.col("_end") <= now) & (F.lit(seen is None) | (F.col("_end") > F.lit(seen)))).groupBy("windowId").agg(F.count(F.lit(1)).alias("count"))
    told = written(due.select(F.lit(1).alias("schemaVersion"), "windowId", F.timestamp_millis(start).alias("windowStart"), F.timestamp_millis(start + window_ms).alias("windowEnd"), "count"), "markers")
    ledger.apply(markers=told, batch=number, seen=now)
    return told


def ledger_query(spark: SparkSession, folder: str, window_ms: int, bound_ms: int = 5_000, topics=None, names: dict[str, str] | None = None, **trigger):
    """Marks, seals and publishes; roots are published after the seals are in the ledger."""
    topics, names = topics or wire.FileTopics(f"{folder}/topics"), names or {}
    ledger = Ledger(spark, f"{folder}/ledger")
    ledger.restore()

    def publish(number: int) -> None:
        ledger.publish(lambda new: topics.send(new.withColumns({"schemaVersion": F.lit(1), "leafCount": F.col("leafCount").cast("int")}), "merkle.roots", number))

    def step(batch: DataFrame, number: int) -> None:
        told = ledger_step(ledger, batch, number, window_ms, bound_ms, f"{folder}/late")
        if told is not None:
            topics.send(told, "votes.windows", number, names.get("votes.windows"))
        publish(number)

    return read_decisions(spark, folder).writeStream.option("checkpointLocation", f"{folder}/checkpoints/ledger").queryName("ledger").trigger(**trigger or ONCE).foreachBatch(step)


def run_to_end(*steps) -> None:
    """Build and start each step's query after the one before has drained its input, as
    a step reads what the one before has written."""
    for step in steps:
        step().start().awaitTermination()
