"""The tally job: ``python -m tallyweave.streaming.job FOLDER [--flag value ...]``.

Votes and control events come from the topics that the flags name, as JSON: from Kafka, or,
where Spark's Kafka package is missing, from FOLDER/topics/<topic>. Every
``checkpoint.interval.ms`` a micro-batch of each query runs; ``parallelism`` is the number of
shuffle partitions. ``exactly.once`` asks for sinks that write every record once, which
files do and Kafka does not (Spark writes to it at least once); with Kafka it is refused
unless set to false. ``transaction.timeout.ms`` concerns transactional producers, of which
there are none: it is accepted and has no effect.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.config import JobConfig
from tallyweave.session import build_session
from tallyweave.sources import wire
from tallyweave.streaming import pipeline


class TallyJob:
    """The queries of the job over one folder, which holds line, counts, ledger and checkpoints."""

    def __init__(self, spark: SparkSession, config: JobConfig, folder: str, kafka: bool = False):
        if kafka and config.exactly_once:
            raise ValueError("Spark's Kafka sink is at-least-once: use files, or --exactly.once false")
        self.spark, self.config, self.folder, self.kafka = spark, config, folder.rstrip("/"), kafka
        self.topics = wire.KafkaTopics(config.bootstrap_servers) if kafka else wire.FileTopics(f"{self.folder}/topics")
        spark.conf.set("spark.sql.shuffle.partitions", str(config.parallelism))

    def _raw(self, name: str) -> DataFrame:
        if self.kafka:
            return wire.stream_topic(self.spark, self.config.bootstrap_servers, name, self.config.consumer_group)
        return wire.stream_records(self.spark, f"{self.folder}/topics/{name}")

    def _events(self, topic: str, name: str) -> DataFrame:
        """Readable events. What is not readable is left out, as it would stop the job at every
        restart; a query of its own counts and keeps it."""
        return wire.decode(self._raw(name), wire.SCHEMAS[topic])[0]

    def corrupt_records(self, topic: str, name: str, **trigger):
        """Unreadable records of a topic, to FOLDER/dead-letters."""
        bad = wire.decode(self._raw(name), wire.SCHEMAS[topic])[1].select("value").observe(f"{topic}.corrupt", F.count(F.lit(1)).alias("corruptRecords"))
        return bad.writeStream.format("parquet").option("path", f"{self.folder}/dead-letters/{topic}").option("checkpointLocation", f"{self.folder}/checkpoints/dead-{topic}").queryName(f"dead-{topic}").trigger(**trigger or pipeline.ONCE)

    def steps(self, **trigger) -> list:
        """What builds each query, in the order in which they feed each other."""
        c, spark, folder = self.config, self.spark, self.folder
        names = {"votes.accepted": c.topic_accepted, "votes.rejected": c.topic_rejected, "votes.windows": c.topic_windows}
        votes = lambda: self._events("votes.cast", c.topic_votes)
        control = lambda: self._events("votes.control", c.topic_control)
        return [
            lambda: pipeline.decisions_query(votes(), control(), folder, c.election_id, c.schedule(), **trigger),
            lambda: pipeline.events_query(spark, folder, c.merkle_window_ms, self.topics, names, **trigger),
            lambda: pipeline.tally_query(spark, folder, self.topics, **trigger),
            lambda: pipeline.ledger_query(spark, folder, c.merkle_window_ms, c.watermark_out_of_orderness_ms, self.topics, names, **trigger),
            lambda: self.corrupt_records("votes.cast", c.topic_votes, **trigger),
            lambda: self.corrupt_records("votes.control", c.topic_control, **trigger),
        ]

    def run_to_end(self) -> None:
        """Everything that is there, once."""
        pipeline.run_to_end(*self.steps())

    def start(self) -> list:
        """The continuous job: all queries, a micro-batch every interval."""
        return [s().start() for s in self.steps(processingTime=f"{self.config.checkpoint_interval_ms} milliseconds")]


def main(args: list[str]) -> None:
    if not args:
        raise SystemExit(__doc__)
    config = JobConfig.from_args(args[1:])
    spark = build_session("tally-job")
    has_kafka = True
    try:
        spark._jvm.java.lang.Class.forName("org.apache.spark.sql.kafka010.KafkaSourceProvider")
    except Exception:  # the package is not on the class path
        has_kafka = False
    TallyJob(spark, config, args[0], has_kafka).start()
    spark.streams.awaitAnyTermination()


if __name__ == "__main__":
    main(sys.argv[1:])
