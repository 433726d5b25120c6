"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings that every session of the engine wants.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app: str = "tallyweave", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the engine's settings; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = SETTINGS | {k.replace("__", "."): str(v) for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the checkpoint folder
    that the session was given. Only where neither is set and everything runs on one
    machine (tests) it is a temporary folder of our own."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tallyweave-")
    context.setCheckpointDir(own)
    return own


#: Folders of this driver that may go when their frames have been read.
_FOLDERS: list[tuple[SparkSession, str]] = []


def run_dir(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder under the shared one; removed by ``release`` or when the driver ends
    unless ``keep``."""
    path = f"{shared_dir(spark)}/tallyweave/{name}-{uuid.uuid4().hex[:12]}"
    if not keep:
        _FOLDERS.append((spark, path))
    return path


@atexit.register
def release() -> None:
    """Remove the folders of all results so far; call it when these have been read."""
    while _FOLDERS:
        _forget(*_FOLDERS.pop())


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as its object."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    fs, where = filesystem(spark, path)
    fs.delete(where, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session may be gone already
        pass


def written(df, name: str, by: str | None = None):
    """``df`` written to the shared folder and read back: a lineage cut that survives
    the loss of executors, for frames that several steps read. ``by`` names a column of
    few values; rows of one value can then be read by themselves."""
    spark = df.sparkSession
    path = run_dir(spark, name)
    writer = df.write.partitionBy(by) if by else df.write
    schema = df.schema
    writer.parquet(path)
    return spark.read.schema(schema).parquet(path)


def is_small(df, limit_bytes: int = 8 << 20) -> bool:
    """Whether the optimiser's upper estimate of a frame is within ``limit_bytes``;
    only frames that pass may be broadcast."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit_bytes


def few_rows(df, most: int, what: str) -> list:
    """All rows of a frame that has few by its nature; more than ``most`` are refused, as
    the driver holds them. Nothing is left out."""
    found = df.take(most + 1)
    if len(found) > most:
        raise ValueError(f"more than {most} {what}")
    return found


def broadcast_if_small(df, limit_bytes: int = 8 << 20):
    """``df`` with a broadcast hint where its size is proven, else as it is."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if is_small(df, limit_bytes) else df
