"""Events on the wire: JSON in and out, corrupt input, CSV lists, Kafka."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def _struct(**fields: str) -> T.StructType:
    kinds = {"int": T.IntegerType(), "long": T.LongType(), "str": T.StringType(), "ts": T.TimestampType(), "path": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(k, kinds[v]) for k, v in fields.items()])


#: Event schemas in contract order.
VOTE_CAST = _struct(schemaVersion="int", electionId="str", voterId="str", candidateId="str", partyId="str", state="str", city="str", castAt="ts", receipt="str")
REJECTED = _struct(schemaVersion="int", electionId="str", voterId="str", candidateId="str", receipt="str", reason="str", originalReceipt="str", rejectedAt="ts")
ACCEPTED = _struct(schemaVersion="int", receipt="str", voterId="str", windowId="str", castAt="ts")
TALLY_UPDATE = _struct(schemaVersion="int", dimension="str", key="str", count="long", updatedAt="ts")
WINDOW_MARKER = _struct(schemaVersion="int", windowId="str", windowStart="ts", windowEnd="ts", count="long")
CONTROL = _struct(schemaVersion="int", type="str", electionId="str", at="ts")
RECEIPT = _struct(schemaVersion="int", receipt="str", electionId="str", voterId="str", issuedAt="ts")
ROOT = _struct(schemaVersion="int", windowId="str", sequence="int", leafCount="int", root="str", previousHash="str", checkpointHash="str", sealedAt="ts")
PROOF = _struct(receipt="str", windowId="str", sequence="int", leafIndex="int", treeSize="int", root="str", previousHash="str", checkpointHash="str", sealedAt="ts", path="path", verification="str")

#: Topic key of each event.
KEYS = {"votes.cast": "voterId", "votes.rejected": "voterId", "votes.accepted": "receipt", "votes.windows": "windowId", "votes.control": "type", "votes.receipts": "receipt", "merkle.roots": "windowId"} | {f"results.by-{d}": "key" for d in ("candidate", "state", "city", "party")}
#: The field that gives an event's record its time.
TIMES = {"votes.cast": "castAt", "votes.rejected": "rejectedAt", "votes.accepted": "castAt", "votes.windows": "windowEnd", "votes.control": "at", "votes.receipts": "issuedAt", "merkle.roots": "sealedAt"} | {f"results.by-{d}": "updatedAt" for d in ("candidate", "state", "city", "party")}


def decode(raw: DataFrame, schema: T.StructType, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON texts to (events, corrupt). Unknown fields are ignored and missing ones null;
    text that is no JSON object of the schema (a literal null too) goes to ``corrupt``
    with all its columns, so that it can be counted and looked at."""
    whole = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = raw.withColumn("_e", F.from_json(value, whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    object_like = F.coalesce(F.col(value).rlike(r"^\s*\{"), F.lit(False))
    bad = F.col("_e").isNull() | F.col("_e._corrupt").isNotNull() | ~object_like
    rest = [c for c in raw.columns if c != value and c not in schema.names]
    events = parsed.where(~bad).select(*rest, *(F.col(f"_e.{n}").alias(n) for n in schema.names))
    return events, parsed.where(bad).drop("_e")


def encode(events: DataFrame, schema: T.StructType, key: Column | str, at: Column | str | None = None) -> DataFrame:
    """Events as (key, value) with JSON values, fields in contract order and times in
    ISO-8601, and with the record's ``timestamp`` where ``at`` says what it is. A null key
    stays null."""
    fields = []
    for f in schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            ms = F.unix_millis(c)
            c = F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(ms % 1000 != 0, F.date_format(c, ".SSS")).otherwise(""), F.lit("Z"))
        fields.append(c.alias(f.name))
    k = F.col(key) if isinstance(key, str) else key
    time = [] if at is None else [(F.col(at) if isinstance(at, str) else at).alias("timestamp")]
    return events.select(k.cast("string").alias("key"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"), *time)


#: Schema of the events of each topic.
SCHEMAS = {"votes.cast": VOTE_CAST, "votes.rejected": REJECTED, "votes.accepted": ACCEPTED, "votes.windows": WINDOW_MARKER, "votes.control": CONTROL, "votes.receipts": RECEIPT, "merkle.roots": ROOT} | {f"results.by-{d}": TALLY_UPDATE for d in ("candidate", "state", "city", "party")}


class FileTopics:
    """Topics as folders of JSON records, a sub-folder for each batch: a batch that is
    repeated after a failure overwrites itself, so every record is there once."""

    def __init__(self, folder: str):
        self.folder = folder

    def send(self, events: DataFrame, topic: str, number: int, name: str | None = None) -> None:
        """``name`` is what the topic is called here, where the job's flags rename it."""
        records = encode(events, SCHEMAS[topic], KEYS[topic], TIMES[topic])
        # Offsets grow from batch to batch; within one they follow the rows' order.
        offset = F.lit(number).cast("bigint") * (1 << 43) + F.monotonically_increasing_id()
        records.withColumn("offset", offset).write.mode("overwrite").json(f"{self.folder}/{name or topic}/batch={number}")


class KafkaTopics:
    """The same into Kafka, acknowledged by all replicas. Spark's sink delivers at least
    once: readers take the last record of a key, or count different receipts."""

    def __init__(self, servers: str):
        self.servers = servers

    def send(self, events: DataFrame, topic: str, number: int, name: str | None = None) -> None:
        records = encode(events, SCHEMAS[topic], KEYS[topic], TIMES[topic])
        records.write.format("kafka").option("kafka.bootstrap.servers", self.servers).option("kafka.acks", "all").option("topic", name or topic).save()


def read_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV list with a header, in UTF-8; blank lines are skipped."""
    return spark.read.option("header", True).option("encoding", "UTF-8").schema(schema).csv(path)


PARTIES, CANDIDATES, PLACES = "numero string, sigla string, nome string", "numero string, nome string, partido string", "uf string, municipio string, peso int"


def stream_files(spark: SparkSession, path: str, schema: T.StructType, files: int = 1000, kind: str = "parquet") -> DataFrame:
    """Events as files that arrive in a folder."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files).load(path)


def stream_records(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """A topic kept as files (see FileTopics): ``value``, and ``arrival_seq``, the record's
    offset, or the time of its file where it has none."""
    raw = spark.readStream.format("json").schema("value string, offset bigint").option("maxFilesPerTrigger", files).load(path)
    return raw.select("value", F.coalesce("offset", F.shiftleft(F.unix_millis("_metadata.file_modification_time"), 20)).alias("arrival_seq"))


def stream_topic(spark: SparkSession, servers: str, topic: str, group: str = "tallyweave") -> DataFrame:
    """A Kafka topic from its beginning: ``value`` as text, and ``arrival_seq``, which orders
    the records of a partition and so those of a key. Needs Spark's Kafka package."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("groupIdPrefix", group).load()
    return raw.select(F.col("value").cast("string").alias("value"), (F.col("offset") * 1024 + F.col("partition")).alias("arrival_seq"))


def latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """A compacted topic: the last event of each key."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_e")).select(key, *(F.col(f"_e.{c}").alias(c) for c in rest))


def console(events: DataFrame, order: str, lines: int = 20) -> DataFrame:
    """The last events, newest first: what a console reader shows."""
    return events.orderBy(F.desc(order)).limit(lines)
