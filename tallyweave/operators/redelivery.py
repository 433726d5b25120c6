"""Messages delivered more than once: a store that keeps one copy of each.

Tables of the store (see sources/parts):
  kept      the kept copies, cut by period of arrival
  index     identifier index, cut by a prefix of the identifier's hash: which period holds
            the kept copy of an identifier
  dropped   the rows that each applied batch gave up, cut by the batch's period

``apply`` takes a batch of deliveries, looks their identifiers up in the touched buckets
of the index, reads only the periods that hold a copy of one of them, picks the copy with
the lowest arrival anew among those and the batch, writes these periods as a new generation
and commits with one manifest. A run that dies before leaves the store as it was.

Every row has an identifier: that of its message, or, for a message of its own, its groups
and arrival number; so a batch may be applied again, in whole or in part, and changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.operators.late import first_copies
from tallyweave.session import broadcast_if_small, written
from tallyweave.sources.parts import PartStore

KEY, SEQ = "_key", "_seq"
#: Buckets of the index, and generations that a bucket may have before it is written anew.
BUCKETS, GENERATIONS = 8, 5


@dataclass(frozen=True)
class Applied:
    """What a batch did: the rows dropped (groups and seq, written), and the periods rewritten."""

    dropped: DataFrame
    affected: list[int]


class DeliveryStore:
    """One-copy store of messages.

    Rows carry ``_key`` (struct or null: a message of its own), ``_seq`` (unique
    arrival number within the groups), the group columns and ``part`` (int, the
    period of the row's arrival; null: unknown, -1). Any further columns are kept with the
    copy; columns named like those of the store (_h, _new, gen) are replaced."""

    def __init__(self, spark: SparkSession, root: str, groups: tuple[str, ...] = ("tbl",), buckets: int = BUCKETS):
        self.spark, self.groups, self.buckets = spark, groups, buckets
        self.store = PartStore(spark, root)

    def kept(self) -> DataFrame | None:
        """Every kept copy, or None where nothing was applied yet."""
        s = self.store.state()
        if "kept" not in s["tables"]:
            return None
        found = self.store.load(s, "kept")
        return (self.store.empty(s, "kept") if found is None else found).drop("gen", "_new", "_h")

    def _with_hash(self, rows: DataFrame) -> DataFrame:
        own = F.xxhash64(*self.groups, SEQ, F.lit("alone"))
        return rows.withColumn("_h", F.when(F.col(KEY).isNotNull(), F.xxhash64(*self.groups, KEY)).otherwise(own))

    def _bucket(self):
        return F.pmod(F.col("_h"), F.lit(self.buckets)).cast("int")

    def _affected(self, state: dict, looked: DataFrame) -> list[int]:
        """Periods that hold a copy of an identifier of the batch. A clash of hashes, or an
        entry that a later generation has replaced, may name a period too many, never one
        too few."""
        if not self.store.parts(state, "index"):
            return []
        touched = [r[0] for r in looked.select(self._bucket().alias("b")).distinct().collect()]  # at most BUCKETS rows
        index = self.store.load(state, "index", touched)
        if index is None:
            return []
        found = index.join(broadcast_if_small(looked), "_h", "left_semi").select("period").distinct().collect()  # one row a period at most
        return sorted(r[0] for r in found)

    def apply(self, batch: DataFrame) -> Applied:
        """Bring a batch of deliveries in. The batch is read twice: give it a written or
        cheap frame."""
        state, gen = self.store.state(), self.store.generation()
        order = [c for c in batch.columns if c not in ("part", "gen", "_h", "_new")]
        rows = self._with_hash(batch.select(*order, F.coalesce(F.col("part").cast("int"), F.lit(-1)).alias("part")))
        affected = self._affected(state, rows.select("_h"))
        old = self.store.load(state, "kept", affected)
        both = rows.withColumn("_new", F.lit(1))
        if old is not None:
            both = both.unionByName(old.select(*order, "part", "_h", F.lit(0).alias("_new")))
        # Of two rows with one arrival number the stored one wins: _new follows the number.
        both = both.select(*self.groups, KEY, SEQ, "_new", "_h", "part", *(c for c in order if c not in (*self.groups, KEY, SEQ)))
        winners = first_copies(both, KEY, SEQ, *self.groups)
        self.store.write(state, "kept", winners.select(*order, "_h", "_new", "part"), gen, instead_of=affected)
        key = [*self.groups, SEQ]
        fresh = self.store.load({"tables": {"kept": {"schema": state["tables"]["kept"]["schema"], "parts": {p: [gen] for p, gens in state["tables"]["kept"]["parts"].items() if gen in gens}}}}, "kept")
        if fresh is None:
            fresh = self.store.empty(state, "kept")
        entries = fresh.where("_new = 1").select("_h", F.col("part").alias("period"), F.lit(state["version"] + 1).alias("version"), self._bucket().alias("part"))
        self.store.write(state, "index", entries, gen)
        self._compact(state)
        held = fresh.select(*(F.col(c).alias(f"_kept_{c}") for c in key))
        same = [F.col(c).eqNullSafe(F.col(f"_kept_{c}")) for c in key]
        # A row may be in the batch and in the store; what it lost to is in the store.
        dropped = written(both.select(*key).join(held, same, "left_anti").distinct(), "dropped")
        self.store.commit(state)
        return Applied(dropped, affected)

    def _compact(self, state: dict) -> None:
        """Write buckets with many generations anew, one entry an identifier: its latest."""
        parts = state["tables"]["index"]["parts"]
        full = [int(p) for p, gens in parts.items() if len(gens) > GENERATIONS]
        if full:
            entries = self.store.load(state, "index", full).groupBy("_h", "part").agg(F.max_by("period", "version").alias("period"), F.max("version").alias("version"))
            self.store.write(state, "index", entries.select("_h", "period", "version", "part"), self.store.generation(), instead_of=full)

    def vacuum(self) -> int:
        """Delete generations of periods and index that no version needs any more, and
        what writers left that died; returns how many."""
        return self.store.vacuum()
