"""Has this key been seen before? A streaming state store that answers exactly.

Deliveries come one after another. Each is reduced to its different keys before the
shuffle; the state (RocksDB on the executors' disks, changelogs and snapshots in the
checkpoint) is partitioned by key and holds, for each key, the number of its first
arrival. There is no watermark, so nothing expires. The micro-batch that brings a delivery
in writes what the state says about its keys, and the delivery's rows are answered from that
alone: a row is the first of its key if it is the arrival that the state holds, else a
repeat. Null keys are neither.

Answers are exact at once where deliveries come in order of arrival. One that brings an
arrival from before others amends their answers, from the log of what the state said. Memory
holds RocksDB's caches and one delivery's keys, not all keys.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.session import filesystem

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
ROW = "tbl string, key binary, arrival_seq bigint"
LOG = "tbl string, key binary, first_seq bigint, delivery int"
ANSWER = "tbl string, arrival_seq bigint, first boolean, delivery int"


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class SeenKeys:
    """Keys seen so far, in a folder that all executors share: deliveries as they came, the
    state's checkpoint, the log of firsts, and the answers. Another object on the same folder
    goes on where the last one stopped."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, name: str) -> bool:
        fs, where = filesystem(self.spark, f"{self.folder}/{name}")
        return fs.exists(where)

    def deliveries(self) -> int:
        """How many deliveries have been answered."""
        fs, where = filesystem(self.spark, f"{self.folder}/answers/delivery=*/_SUCCESS")
        return len(fs.globStatus(where) or [])

    def bring(self, rows: DataFrame) -> int:
        """Take one delivery in: rows (tbl, key, arrival_seq), arrival numbers unique in
        their table. The query is started from its checkpoint and stopped again. Returns the
        delivery's number. One that died is brought in again under its number, and its rows,
        which the state may know by then, are answered alike."""
        number = self.deliveries()
        source = f"{self.folder}/in/delivery={number}"
        # What a dead run has written whole may be in the stream's plans already.
        if not self._exists(f"in/delivery={number}/_SUCCESS"):
            rows.where(F.col("key").isNotNull()).select("tbl", "key", "arrival_seq").write.mode("overwrite").parquet(source)
        self._run(number)
        self._answer(number)
        return number

    def _run(self, number: int) -> None:
        stream = self.spark.readStream.schema(ROW).parquet(f"{self.folder}/in/delivery=*")
        flags = stream.groupBy("tbl", "key").agg(F.min("arrival_seq").alias("first_seq"))
        with _settings(self.spark, _STATE):
            log = lambda batch, _: batch.write.mode("append").parquet(f"{self.folder}/log/delivery={number}")
            flags.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).foreachBatch(log).start().awaitTermination()

    def _answer(self, number: int) -> None:
        rows = self.spark.read.schema(ROW).parquet(f"{self.folder}/in/delivery={number}")
        empty = not self._exists(f"log/delivery={number}")
        told = self.spark.createDataFrame([], LOG) if empty else self.spark.read.schema(LOG.rsplit(",", 1)[0]).parquet(f"{self.folder}/log/delivery={number}")
        # On arrival numbers, which are unique: a hot key does not gather in one task.
        firsts = told.select("tbl", F.col("first_seq").alias("arrival_seq"), F.lit(True).alias("_first")).distinct()
        out = rows.join(firsts, ["tbl", "arrival_seq"], "left").select("tbl", "arrival_seq", F.coalesce("_first", F.lit(False)).alias("first"))
        if number and self._out_of_order(rows, number):
            before = self._log().where(F.col("delivery") < number).select("tbl", "key", F.col("first_seq").alias("arrival_seq"))
            amended = before.join(told, ["tbl", "key"]).where(F.col("arrival_seq") > F.col("first_seq"))
            out = out.unionByName(amended.select("tbl", "arrival_seq", F.lit(False).alias("first")).distinct())
        out.write.mode("overwrite").parquet(f"{self.folder}/answers/delivery={number}")

    def _out_of_order(self, rows: DataFrame, number: int) -> bool:
        """Whether an arrival is older than one of a delivery before; one number per table."""
        before = self.spark.read.schema(ROW + ", delivery int").parquet(f"{self.folder}/in").where(F.col("delivery") < number)
        latest = before.groupBy("tbl").agg(F.max("arrival_seq").alias("_latest"))
        return not rows.groupBy("tbl").agg(F.min("arrival_seq").alias("_first")).join(latest, "tbl").where("_first < _latest").isEmpty()

    def _log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.folder}/log") if self._exists("log") else self.spark.createDataFrame([], LOG)

    def answers(self) -> DataFrame:
        """(tbl, arrival_seq, first) for every row with a key."""
        if not self._exists("answers"):
            return self.spark.createDataFrame([], ANSWER).drop("delivery")
        given = self.spark.read.schema(ANSWER).parquet(f"{self.folder}/answers")
        # Firsts are only ever taken back, so the row's last answer is the lesser one. Where
        # nothing was amended there is one answer for each row, and nothing to combine.
        if self._amended(given):
            return given.groupBy("tbl", "arrival_seq").agg(F.min("first").alias("first"))
        return given.select("tbl", "arrival_seq", "first")

    def _amended(self, given: DataFrame) -> bool:
        rows = self.spark.read.schema(ROW).parquet(f"{self.folder}/in")
        return given.count() != rows.count()
