"""The lasting ledger: leaves, markers and seals, appended step by step.

Tables of the store (see sources/parts), cut by period of window start:
  leaves   windowId, receipt: different leaves of windows
  markers  windowId, count: how many leaves a closed window has
  seals    checkpoints with ``sealedAt`` (which no hash covers)
  refused  what the ledger would not take, and why

A step adds leaves and markers and seals what has become complete, onto the head that the
manifest keeps, in order of window start and only as far as every marked window before is
complete. Only windows that wait and periods that the step touches are read. The same
leaf or marker again changes nothing. Refused are leaves of a sealed window that are not in
its tree (SEALED_WITHOUT_IT), other counts for a marked or sealed window (CONFLICT) and
markers that name no window or no count (INVALID).

``restore`` audits the whole ledger before it goes on: it rebuilds every root from the
leaves, checks every link, and seals windows that were complete when a step died.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyweave.functions import merkle
from tallyweave.functions.windows import named_instant_ms
from tallyweave.operators import chain, trees
from tallyweave.session import written
from tallyweave.sources.parts import PartStore

LEAF = "windowId string, receipt string"
MARKER = "windowId string, count bigint"
SEAL = chain.RECORD + ", sealedAt timestamp"
REFUSED = "windowId string, receipt string, count bigint, reason string"
PERIOD_MS = 3_600_000


@dataclass(frozen=True)
class Step:
    """What a step sealed and refused, both written."""

    sealed: DataFrame
    refused: DataFrame


class BrokenLedger(ValueError):
    """The leaves do not give the recorded checkpoints."""


class Ledger:
    """A ledger in a folder that all executors share. Its identity (``store_id``) lives and
    dies with the folder."""

    def __init__(self, spark: SparkSession, root: str, period_ms: int = PERIOD_MS):
        self.spark, self.period, self.store = spark, period_ms, PartStore(spark, root)
        state = self.store.state()
        if "store_id" not in state["meta"]:
            state["meta"] |= {"store_id": uuid.uuid4().hex, "head": None, "waiting": [], "published": -1}
            self.store.commit(state)

    # -- parts -----------------------------------------------------------------
    def _part(self) -> Column:
        """Period of the window's start; windows whose name spells no instant share a few."""
        other = -1 - F.pmod(F.xxhash64("windowId"), F.lit(16))
        return F.coalesce(F.floor(named_instant_ms("windowId") / self.period), other).cast("int")

    def _table(self, state: dict, name: str, schema: str, parts: list[int] | None = None) -> DataFrame:
        columns = [c.split()[0] for c in schema.split(", ")]
        found = self.store.load(state, name, parts)
        return self.spark.createDataFrame([], schema) if found is None else found.select(*columns)

    def leaves(self, state: dict | None = None) -> DataFrame:
        return self._table(state or self.store.state(), "leaves", LEAF)

    def records(self, state: dict | None = None) -> DataFrame:
        """All checkpoints, with sealedAt."""
        return self._table(state or self.store.state(), "seals", SEAL)

    def refused(self) -> DataFrame:
        return self._table(self.store.state(), "refused", REFUSED)

    def meta(self) -> dict:
        return self.store.state()["meta"]

    # -- steps -----------------------------------------------------------------
    def apply(self, leaves: DataFrame | None = None, markers: DataFrame | None = None, sealed_at: Column | None = None, **meta) -> Step:
        """Add leaves (windowId, receipt) and markers (windowId, count), then seal. ``meta`` goes
        into the manifest of the same commit, for the caller's own progress."""
        state, gen = self.store.state(), self.store.generation()
        none = self.spark.createDataFrame
        new_leaves = written(trees.leaf_set(leaves).withColumn("part", self._part()), "new-leaves") if leaves is not None else none([], LEAF + ", part int")
        told = none([], MARKER) if markers is None else markers.select("windowId", F.col("count").cast("bigint").alias("count"))
        valid = chain.valid_markers(told)
        # Of markers that differ within a step the least stands, as of those within a table.
        first = valid.groupBy("windowId").agg(F.min("count").alias("count"))
        new_marks = written(first.withColumn("part", self._part()), "new-markers")
        invalid = told.where(~F.coalesce((F.col("windowId") != "") & (F.col("count") >= 0), F.lit(False)))
        touched = {r[0] for r in new_leaves.select("part").union(new_marks.select("part")).distinct().collect()}  # one row per period
        near = sorted(touched | set(state["meta"]["waiting"]))
        old_leaves, old_marks, seals = (self._table(state, t, s, near) for t, s in (("leaves", LEAF), ("markers", MARKER), ("seals", SEAL)))
        fresh = new_leaves.join(old_leaves, ["windowId", "receipt"], "left_anti")
        sealed_windows = seals.select("windowId")
        added = written(fresh.join(sealed_windows, "windowId", "left_anti"), "added")
        late = fresh.join(sealed_windows, "windowId", "left_semi").select("windowId", "receipt", F.lit(None).cast("bigint").alias("count"), F.lit("SEALED_WITHOUT_IT").alias("reason"))
        known = old_marks.withColumnRenamed("count", "_known")
        other = valid.join(known.unionByName(new_marks.select("windowId", F.col("count").alias("_known")).join(old_marks, "windowId", "left_anti")), "windowId").where("count <> _known")
        no = F.lit(None).cast("string").alias("receipt")
        refused = late.unionByName(other.select("windowId", no, "count", F.lit("CONFLICT").alias("reason"))).unionByName(invalid.select("windowId", no, "count", F.lit("INVALID").alias("reason"))).distinct()
        refused = written(refused.withColumn("part", F.coalesce(self._part(), F.lit(-1))), "refused")
        marked = new_marks.join(old_marks, "windowId", "left_anti").select("windowId", "count", "part")
        # Windows that wait: marked, not sealed.
        pending = written(old_marks.unionByName(marked.drop("part")).join(sealed_windows, "windowId", "left_anti"), "pending")
        theirs = written(old_leaves.unionByName(added.select("windowId", "receipt")).join(pending, "windowId", "left_semi"), "waiting-leaves")
        status = written(chain.seal_status(theirs, pending).where("expected is not null"), "status")
        ready = status.where("sealable").select("windowId", F.col("expected").alias("_n"))
        roots = trees.roots(trees.numbered(theirs.join(ready, "windowId", "left_semi")))
        empty = ready.where("_n = 0").select("windowId", F.lit(0).cast("bigint").alias("leafCount"), F.lit(merkle.EMPTY_ROOT).alias("root"))
        head = state["meta"]["head"]
        links = chain.chain(roots.unionByName(empty), head["checkpointHash"] if head else merkle.GENESIS, head["sequence"] + 1 if head else 0)
        sealed = written(links.withColumn("sealedAt", F.current_timestamp() if sealed_at is None else sealed_at), "sealed")
        for name, frame in (("leaves", added), ("markers", marked), ("seals", sealed.withColumn("part", self._part())), ("refused", refused)):
            self.store.write(state, name, frame, gen)
        last = sealed.select("windowId", "sequence", "checkpointHash").orderBy(F.desc("sequence")).first()
        if last is not None:
            state["meta"]["head"] = last.asDict()
        waiting = status.where("not sealable").select(self._part().alias("part")).distinct().collect()  # one row per period
        state["meta"] |= {"waiting": sorted(r[0] for r in waiting)} | meta
        self.store.commit(state)
        return Step(sealed, refused.drop("part"))

    # -- audit -----------------------------------------------------------------
    def audit(self) -> DataFrame:
        """windowId and ``finding`` (ROOT, LEAF_COUNT, CHAIN, SEQUENCE, NO_LEAVES) of every
        checkpoint that leaves and links do not confirm. All windows are checked at once:
        each link is recomputed from the recorded one before it."""
        state = self.store.state()
        records = self.records(state)
        rebuilt = trees.roots(trees.numbered(self.leaves(state).join(records.select("windowId"), "windowId", "left_semi")))
        a = rebuilt.select("windowId", F.col("leafCount").alias("_n"), F.col("root").alias("_root"))
        both = chain.check_links(records.drop("sealedAt")).join(a, "windowId", "left")
        twice = records.groupBy("sequence").agg((F.count(F.lit(1)) > 1).alias("_twice"))
        finding = (
            F.when(F.col("_root").isNull() & (F.col("leafCount") > 0), "NO_LEAVES")
            .when(F.coalesce("_n", F.lit(0)) != F.col("leafCount"), "LEAF_COUNT")
            .when(F.coalesce("_root", F.lit(merkle.EMPTY_ROOT)) != F.col("root"), "ROOT")
            .when(F.col("_twice") | ~F.col("linked"), "SEQUENCE")
            .when(~F.col("hashed"), "CHAIN")
        )
        return both.join(twice, "sequence").select("windowId", finding.alias("finding")).where("finding is not null")

    def restore(self, sealed_at: Column | None = None) -> DataFrame:
        """Take the ledger up after a stop: refuse one that the audit contradicts, then seal
        what was complete. Returns the checkpoints sealed now, which are not published yet."""
        bad = self.audit().take(10)
        if bad:
            raise BrokenLedger(", ".join(f"{r['windowId']}: {r['finding']}" for r in bad))
        return self.apply(sealed_at=sealed_at).sealed

    # -- publishing --------------------------------------------------------------
    def publish(self, send) -> int:
        """Hand checkpoints that have not been published to ``send`` (a frame), and note
        that; one that died in between is handed over again. Returns the last sequence."""
        state = self.store.state()
        last = state["meta"]["published"]
        head = state["meta"]["head"]
        if head is None or head["sequence"] <= last:
            return last
        send(self.records(state).where(F.col("sequence") > last))
        state["meta"]["published"] = head["sequence"]
        self.store.commit(state)
        return head["sequence"]

    def health(self) -> DataFrame:
        """One row: sealedCheckpoints, pendingWindows, head, headWindow, storeId."""
        state = self.store.state()
        meta, head = state["meta"], state["meta"]["head"]
        waiting = self._table(state, "markers", MARKER, meta["waiting"]).join(self._table(state, "seals", SEAL, meta["waiting"]).select("windowId"), "windowId", "left_anti")
        unmarked = self.leaves(state).select("windowId").distinct().join(self._table(state, "markers", MARKER).select("windowId"), "windowId", "left_anti")
        pending = waiting.select("windowId").unionByName(unmarked).groupBy().agg(F.count(F.lit(1)).alias("pendingWindows"))
        return pending.select(
            F.lit("UP").alias("status"), F.lit(head["sequence"] + 1 if head else 0).cast("bigint").alias("sealedCheckpoints"), "pendingWindows",
            F.lit(head["checkpointHash"] if head else None).cast("string").alias("head"), F.lit(head["windowId"] if head else None).cast("string").alias("headWindow"), F.lit(meta["store_id"]).alias("storeId"))
