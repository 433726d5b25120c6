"""Queries that run the streaming job to the end of its input and read what it wrote."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.operators.ledger import Ledger
from tallyweave.operators.panes import PaneStore
from tallyweave.plans import stream_quality, tally_queries
from tallyweave.plans.tally_queries import ELECTION, SCHEDULE, WINDOW_MS
from tallyweave.session import SETTINGS, run_dir
from tallyweave.sources.tables import table
from tallyweave.streaming import panes, pipeline
from tallyweave.streaming.admission import admit_stream

#: Slices of arrival in which a table is fed to a stream, with a restart after each.
SLICES = 2


@contextmanager
def rocksdb(spark: SparkSession):
    """State on the executors' disks for the queries started inside."""
    names = [k for k in SETTINGS if ".stateStore." in k]
    before = {k: spark.conf.get(k, None) for k in names}
    for k in names:
        spark.conf.set(k, SETTINGS[k])
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def votes_stream(spark: SparkSession, d: str) -> DataFrame:
    """vote_cast as a stream of its files; the path is a pattern, as a stream takes a
    single file in no other way."""
    path = f"{d}/vote_cast.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def stream_admission(spark: SparkSession, d: str) -> DataFrame:
    """Decisions as the stateful stream makes them."""
    folder = run_dir(spark, "stream")
    with rocksdb(spark):
        out = admit_stream(votes_stream(spark, d), ELECTION, SCHEDULE)
        q = out.writeStream.format("parquet").option("path", f"{folder}/decisions").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/decisions").select("arrival_seq", "voter", "reason", "originalReceipt")


def job_ledger(spark: SparkSession, d: str) -> Ledger:
    """The ledger after the job has been fed vote_cast slice by slice and the control events
    last, and was stopped and started again after each."""
    folder = run_dir(spark, "job")
    votes = table(spark, d, "vote_cast")
    low, high = (x or 0 for x in votes.agg(F.min("arrival_seq"), F.max("arrival_seq")).first())
    control = tally_queries.control(spark)
    control.limit(0).write.parquet(f"{folder}/in/control")
    for k in range(SLICES + 1):
        if k < SLICES:
            cut = F.floor((F.col("arrival_seq") - low) * SLICES / (high - low + 1)) == k
            votes.where(cut).write.mode("append").parquet(f"{folder}/in/votes")
        else:
            control.write.mode("append").parquet(f"{folder}/in/control")
        source = lambda name, like: spark.readStream.schema(like.schema).parquet(f"{folder}/in/{name}")
        with rocksdb(spark):
            pipeline.run_to_end(
                lambda: pipeline.decisions_query(source("votes", votes), source("control", control), folder, ELECTION, SCHEDULE),
                lambda: pipeline.ledger_query(spark, folder, WINDOW_MS),
            )
    return Ledger(spark, f"{folder}/ledger")


def stream_chain(spark: SparkSession, d: str) -> DataFrame:
    """Checkpoints as the job seals them, window after window."""
    return job_ledger(spark, d).records().drop("sealedAt")


def stream_p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """p1_window_counts by a stream whose files come latest arrivals first."""
    rows = stream_quality.arrival_steps(spark, d)
    folder = run_dir(spark, "pane-stream")
    for step in reversed(range(stream_quality.PANE_STEPS)):
        rows.where(F.col("step") == step).drop("step").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.drop("step").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    store = PaneStore(spark, f"{folder}/store", stream_quality.SLICING, ("tbl", "phase"))
    panes.step_panes(stream, store, f"{folder}/checkpoint").start().awaitTermination()
    return stream_quality.shifted(store.counts())


QUERIES = {f.__name__: f for f in (stream_admission, stream_chain, stream_p1_counts)}
