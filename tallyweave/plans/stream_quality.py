"""Queries on deliveries, lateness, skew and references (problems 1, 3, 4 and 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyweave.functions.text import filled, message_key, trim_low
from tallyweave.functions.windows import named_instant_ms
from tallyweave.operators import late
from tallyweave.operators.hotkeys import balanced_counts, combined, skew_join
from tallyweave.operators.late import Slicing, compose, first_copies, lateness, pane_log, to_panes
from tallyweave.operators.orphans import DELETED, LATE as LATE_PARENT, MISSING, OK, reference_status
from tallyweave.operators.panes import PaneStore
from tallyweave.operators.redelivery import KEY, SEQ, DeliveryStore
from tallyweave.session import run_dir, written
from tallyweave.sources.tables import table

SLICING = Slicing(size=15_000, delay=5_000, cutoff=300_000, tick=5_000)
#: A key is reported as hot from this share of all rows, or of all weight.
HOT_SHARE = 1 / 20
#: Length of one period of the stores, and of the orphan report.
PERIOD_SECONDS = 3_600
#: Steps in which the history is brought into the stores of problems 1 and 6.
PANE_STEPS, DELIVERY_BATCHES = 4, 8


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# -- 1: late and out-of-order events --------------------------------------

def timed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of both tables with the start of their window. A window id may name an
    instant off the grid; ``phase`` carries what remains, so that panes stay aligned."""
    votes = table(spark, d, "vote_cast", "receipt", "voterId", "castAt", "arrival_seq", "arrivedAt")
    cast_ms = F.unix_millis("castAt")
    votes = votes.select(
        F.lit("vote_cast").alias("tbl"), message_key("receipt", "voterId").alias("_key"), "arrival_seq",
        (cast_ms - F.pmod(cast_ms, F.lit(SLICING.size))).alias("_event"), F.unix_millis("arrivedAt").alias("_arrived"),
    )
    accepted = table(spark, d, "accepted", "receipt", "voterId", "windowId", "arrival_seq", "arrivedAt")
    accepted = accepted.select(
        F.lit("accepted").alias("tbl"), message_key("receipt", "voterId").alias("_key"), "arrival_seq",
        named_instant_ms("windowId").alias("_event"), F.unix_millis("arrivedAt").alias("_arrived"),
    )
    both = votes.unionByName(accepted).withColumn("phase", F.pmod("_event", F.lit(SLICING.pane)))
    panes = to_panes(both, F.col("_event") - F.col("phase"), F.col("_arrived") - F.coalesce("phase", F.lit(0)), SLICING)
    return panes.select("tbl", "_key", "arrival_seq", "phase", "pane_ms", "tick")


def late_messages(spark: SparkSession, d: str) -> DataFrame:
    """The first copy of each message with its pane, tick and lateness."""
    return first_copies(timed_rows(spark, d), "_key", "arrival_seq", "tbl").withColumn("status", lateness(SLICING))


def arrival_steps(spark: SparkSession, d: str) -> DataFrame:
    """First copies with the ``step`` in which they arrive: PANE_STEPS stretches of the
    arrival clock of equal length, written so that each can be read by itself."""
    rows = first_copies(timed_rows(spark, d), "_key", "arrival_seq", "tbl").drop("_key")
    bounds = table(spark, d, "vote_cast", "arrivedAt").unionByName(table(spark, d, "accepted", "arrivedAt")).agg(F.min(F.unix_millis("arrivedAt")), F.max(F.unix_millis("arrivedAt"))).first()
    low, high = (x // SLICING.tick if x is not None else 0 for x in bounds)
    step = F.floor((F.col("tick") - F.lit(low)) * PANE_STEPS / F.lit(high - low + 1))
    return written(rows.withColumn("step", F.greatest(F.least(F.coalesce(step, F.lit(0)), F.lit(PANE_STEPS - 1)), F.lit(0)).cast("int")), "arrivals", "step")


def paned(spark: SparkSession, d: str) -> tuple[DataFrame, PaneStore]:
    """The rows, and the pane store after it has taken them in step by step."""
    rows = arrival_steps(spark, d)
    store = PaneStore(spark, run_dir(spark, "panes"), SLICING, ("tbl", "phase"))
    for step in range(PANE_STEPS):
        store.apply(rows.where(F.col("step") == step))
    return rows, store


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows that correct a window after its close and before its cut-off: those whose
    pane and tick made the store emit a closed window again."""
    rows, store = paned(spark, d)
    corrected = written(store.corrections(rows), "corrected")
    keys = ("tbl", "phase", "pane_ms", "tick")
    narrow = rows.where("pane_ms is not null").select(*keys, "arrival_seq")
    return skew_join(narrow, corrected, keys, ["arrival_seq"], tasks(spark), "left_semi").select("tbl", "arrival_seq")


def shifted(counts: DataFrame) -> DataFrame:
    shift = F.make_dt_interval(secs=(F.col("phase") / 1000).cast("decimal(18,6)"))
    return counts.select("tbl", *((F.col(c) + shift).alias(c) for c in ("window_start", "window_end", "emitted_at")), "revision", "delta", "n")


def p1_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts per window as of the close (revision 0) and after each correction."""
    return shifted(paned(spark, d)[1].counts())


def p1_lateness_summary(spark: SparkSession, d: str) -> DataFrame:
    """Messages per table and status: in time, late, beyond the cut-off, no window."""
    return late_messages(spark, d).groupBy("tbl", "status").agg(F.count(F.lit(1)).alias("messages"))


def p1_sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of votes, copies too, per sliding window of 60 s every 15 s: the same
    panes, composed differently."""
    sliding = Slicing(size=60_000, slide=15_000, delay=5_000, cutoff=300_000, tick=5_000)
    votes = table(spark, d, "vote_cast", "castAt", "arrivedAt")
    panes = to_panes(votes, F.unix_millis("castAt"), F.unix_millis("arrivedAt"), sliding)
    return compose(pane_log(panes), sliding).select("window_start", "window_end", "revision", "emitted_at", "delta", "n")


# -- 3: a few keys holding most records ------------------------------------

def _dimensions(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """One row per vote and dimension: dim, key_value (null and blank too) and ``more``."""
    votes = table(spark, d, "vote_cast", "state", "candidateId", *more)
    dims = F.array(
        F.struct(F.lit("state").alias("dim"), F.upper(trim_low("state")).alias("key_value")),
        F.struct(F.lit("candidateId").alias("dim"), trim_low("candidateId").alias("key_value")),
    )
    return votes.select(F.explode(dims).alias("k"), *more).select("k.dim", "k.key_value", *more)


def list_entries(spark: SparkSession, d: str) -> DataFrame:
    """The matching side: how many entries of its list a state or candidate has."""
    states = table(spark, d, "municipios", "uf").select(F.lit("state").alias("dim"), F.upper(trim_low("uf")).alias("key_value"))
    candidates = table(spark, d, "candidatos", "numero").select(F.lit("candidateId").alias("dim"), trim_low("numero").alias("key_value"))
    both = states.unionByName(candidates).where(filled(F.col("key_value")))
    return both.groupBy("dim", "key_value").agg(F.count(F.lit(1)).alias("entries"))


def keyed_places(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "municipios", "mun_code", "uf", "municipio", "peso")
    return places.select(F.lit("municipio").alias("dim"), F.concat("uf", F.lit("/"), "municipio").alias("key_value"), "mun_code", "peso")


def key_loads(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every key of both dimensions, and the entries of its list. Rows are summed
    up where they are read; the sums are the loads that are packed to tasks and sharded,
    and the list is copied to the shards of its keys."""
    n = tasks(spark)
    rows = combined(_dimensions(spark, d).withColumn("_row", F.monotonically_increasing_id()), ("dim", "key_value"), ["_row"], n)
    return balanced_counts(written(rows, "loads"), ("dim", "key_value"), ["_salt"], n, load=F.col("_rows"), match=list_entries(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys that hold at least 1/20 of all rows, places with at least 1/20 of the weight."""
    counts = key_loads(spark, d)
    # Every row counts once per dimension, null and blank values too; one row per dimension.
    total = counts.groupBy("dim").agg(F.sum("load").alias("total"))
    votes = counts.join(F.broadcast(total), "dim").where(filled(F.col("key_value")) & (F.col("load") * 20 >= F.col("total")))
    places = keyed_places(spark, d)
    weights = balanced_counts(places, ("dim", "key_value", "mun_code"), ["mun_code"], tasks(spark), load=F.col("peso"))
    all_weight = places.agg(F.sum("peso")).first()[0]
    heavy = weights.where(F.col("load") * 20 >= F.lit(all_weight))
    return votes.select("dim", "key_value").unionByName(heavy.select("dim", "key_value").distinct())


def p3_key_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows and different voters per state and per candidate, and the entries of their
    list. Rows of one voter stay in one shard, so the shards' distinct counts add up."""
    rows = _dimensions(spark, d, "voterId").select("dim", "key_value", trim_low("voterId").alias("voter")).where(filled(F.col("key_value")))
    return balanced_counts(
        rows, ("dim", "key_value"), ["voter"], tasks(spark), match=list_entries(spark, d),
        voters=F.countDistinct("voter"),
    ).select("dim", "key_value", "n", "voters", F.coalesce("entries", F.lit(0)).alias("entries"))


# -- 4: references to records that do not exist -----------------------------

def references(spark: SparkSession, d: str) -> DataFrame:
    """All references of vote_cast and accepted; null and blank values are none."""
    votes = table(spark, d, "vote_cast", "candidateId", "partyId", "castAt", "arrivedAt", "arrival_seq")
    pair = lambda name: F.struct(F.lit(name).alias("field"), trim_low(name).alias("key"))
    votes = votes.select(
        F.lit("vote_cast").alias("tbl"), "arrival_seq", F.unix_millis("castAt").alias("at_ms"), F.unix_millis("arrivedAt").alias("arrived_ms"),
        F.explode(F.array(pair("candidateId"), pair("partyId"))).alias("r"),
    ).where(filled(F.col("r.key")))
    accepted = table(spark, d, "accepted", "windowId", "arrivedAt", "arrival_seq").where(filled(trim_low("windowId")))
    arrived = F.unix_millis("arrivedAt")
    accepted = accepted.select(
        F.lit("accepted").alias("tbl"), F.lit("windowId").alias("field"), named_instant_ms("windowId").cast("string").alias("key"),
        arrived.alias("at_ms"), "arrival_seq", arrived.alias("arrived_ms"),
    )
    return votes.select("tbl", "r.field", "r.key", "at_ms", "arrival_seq", "arrived_ms").unionByName(accepted)


def parents(spark: SparkSession, d: str) -> DataFrame:
    """Parent keys with the interval in which they hold. A party always holds; a
    window holds from its first marker on, and is withdrawn for good where its last
    marker is empty."""
    none = F.lit(None).cast("bigint")
    no = F.lit(False)
    candidates = table(spark, d, "candidatos", "numero", "registeredAt", "removedAt").select(
        F.lit("candidateId").alias("field"), F.col("numero").alias("key"),
        F.unix_millis("registeredAt").alias("from_ms"), F.unix_millis("removedAt").alias("to_ms"), no.alias("withdrawn"),
    )
    parties = table(spark, d, "partidos", "sigla").select(F.lit("partyId").alias("field"), F.col("sigla").alias("key"), none.alias("from_ms"), none.alias("to_ms"), no.alias("withdrawn"))
    markers = table(spark, d, "window_marker", "windowId", "windowStart", "windowEnd", "count", "arrival_seq", "arrivedAt")
    empty = F.col("windowStart").isNull() & F.col("windowEnd").isNull() & F.col("count").isNull()
    windows = (
        markers.select(named_instant_ms("windowId").cast("string").alias("key"), empty.alias("empty"), F.unix_millis("arrivedAt").alias("ms"), "arrival_seq")
        .groupBy("key")
        .agg(F.min(F.when(~F.col("empty"), F.col("ms"))).alias("from_ms"), F.max_by("ms", "arrival_seq").alias("last_ms"), F.max_by("empty", "arrival_seq").alias("withdrawn"))
        .select(F.lit("windowId").alias("field"), "key", "from_ms", F.when(F.col("withdrawn"), F.col("last_ms")).alias("to_ms"), "withdrawn")
    )
    return candidates.unionByName(parties).unionByName(windows)


def reference_report(spark: SparkSession, d: str) -> DataFrame:
    return reference_status(references(spark, d), parents(spark, d), tasks(spark))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """References whose parent does not hold. A window that was closed only after the
    reference arrived is late, but it exists."""
    orphan = F.col("status").isin(MISSING, DELETED) | ((F.col("status") == LATE_PARENT) & (F.col("field") != "windowId"))
    return reference_report(spark, d).where(orphan).select("tbl", "field", "arrival_seq")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """References per table, field, hour of arrival and status."""
    hour = F.timestamp_seconds(F.floor(F.col("arrived_ms") / (1000 * PERIOD_SECONDS)) * PERIOD_SECONDS)
    return reference_report(spark, d).groupBy("tbl", "field", hour.alias("period"), "status").agg(F.count(F.lit(1)).alias("refs"))


# -- 6: messages delivered more than once ------------------------------------

def deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Both tables as the one-copy store takes them, with the hour of arrival as period."""
    out = None
    for name in ("vote_cast", "accepted"):
        t = table(spark, d, name, "receipt", "voterId", "arrival_seq", "batch_no", "arrivedAt")
        part = F.coalesce(F.floor(F.unix_seconds("arrivedAt") / PERIOD_SECONDS), F.lit(-1)).cast("int")
        t = t.select(F.lit(name).alias("tbl"), message_key("receipt", "voterId").alias(KEY), F.col("arrival_seq").alias(SEQ), part.alias("part"), "batch_no")
        out = t if out is None else out.unionByName(t)
    return out


def deduplicate(spark: SparkSession, d: str) -> tuple[DeliveryStore, DataFrame]:
    """Bring the delivery batches in, in DELIVERY_BATCHES groups of consecutive numbers,
    as they would come; each is one incremental step of the store. The result does not
    depend on the cut: the lowest arrival of a message wins in whatever order batches are
    applied. Rows without a batch number come last."""
    bounds = table(spark, d, "vote_cast", "batch_no").unionByName(table(spark, d, "accepted", "batch_no")).agg(F.min("batch_no").alias("low"), F.max("batch_no").alias("high")).first()
    low, high = bounds["low"] or 0, bounds["high"] or 0
    step = F.floor((F.col("batch_no") - low) * DELIVERY_BATCHES / (high - low + 1)).cast("int")
    rows = written(deliveries(spark, d).withColumn("step", F.coalesce(step, F.lit(DELIVERY_BATCHES - 1))).drop("batch_no"), "deliveries", "step")
    store = DeliveryStore(spark, run_dir(spark, "one-copy"), buckets=min(32, tasks(spark)))
    dropped = None
    for k in range(DELIVERY_BATCHES):
        done = store.apply(rows.where(F.col("step") == k).drop("step")).dropped
        store.vacuum()
        dropped = done if dropped is None else dropped.unionByName(done)
    return store, dropped


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows to drop: later copies of a message."""
    return deduplicate(spark, d)[1].select("tbl", F.col(SEQ).alias("arrival_seq"))


def p6_kept_per_day(spark: SparkSession, d: str) -> DataFrame:
    """Messages kept per table and day of arrival, counted in the store."""
    store, _ = deduplicate(spark, d)
    day = F.date_format(F.timestamp_seconds(F.col("part").cast("bigint") * PERIOD_SECONDS), "yyyy-MM-dd")
    return store.kept().groupBy("tbl", F.when(F.col("part") >= 0, day).alias("day")).agg(F.count(F.lit(1)).alias("messages"))


QUERIES = {f.__name__: f for f in (p1_found, p1_window_counts, p1_lateness_summary, p1_sliding_counts, p3_found, p3_key_counts, p4_found, p4_report, p6_found, p6_kept_per_day)}
