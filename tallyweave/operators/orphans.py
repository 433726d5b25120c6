"""References to records that do not exist, by a merge of sorted streams.

References and parent records of one key meet in one partition, sorted by time;
a single forward pass carries the parents' validity along and gives each reference
its status. Keys that many rows refer to are split into shards, and their parents
are copied to those shards (see hotkeys).

Status of a reference at its time t:
  OK       a parent holds at t (its ``valid_from`` <= t < ``valid_to``)
  MISSING  no parent has ever had the key
  DELETED  parents began by t but none holds then, or the key was withdrawn for good
  LATE     the first parent begins only after t
A reference without a time is OK if any parent has the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyweave.operators.hotkeys import fragment, make_plan, replicate

OK, MISSING, DELETED, LATE = "OK", "MISSING", "DELETED", "LATE"
FOREVER = (1 << 63) - 1
EVER = -(1 << 63)


def reference_status(refs: DataFrame, parents: DataFrame, tasks: int) -> DataFrame:
    """``refs`` has tbl, field, key (string, may be null), at_ms, arrival_seq and any
    columns besides, ``parents`` field, key, from_ms, to_ms (null: open ends) and
    ``withdrawn`` (boolean: the key is gone for good). Returns refs with ``status``.

    A null key can match no parent: MISSING. Parents may overlap or repeat."""
    extra = [c for c in refs.columns if c not in ("tbl", "field", "key", "at_ms", "arrival_seq")]
    plan = make_plan(refs, ("field", "key"), tasks)
    left = fragment(refs.select("tbl", "field", "key", "at_ms", "arrival_seq", *extra), plan, ["arrival_seq"], move=False).select(
        "_task", "field", "key", F.coalesce("at_ms", F.lit(FOREVER)).alias("_t"), F.lit(1).alias("_kind"),
        F.lit(None).cast("bigint").alias("_to"), F.lit(None).cast("boolean").alias("_gone"),
        F.struct("tbl", "at_ms", "arrival_seq", *extra).alias("_ref"),
    )
    known = parents.where(F.col("key").isNotNull())
    from_ms = F.coalesce("from_ms", F.lit(EVER))
    # A key's first record at the start of its run says that there is a parent at all.
    head = known.groupBy("field", "key").agg(F.max("withdrawn").alias("_gone")).select("field", "key", F.lit(EVER).alias("_t"), F.lit(-1).alias("_kind"), F.lit(None).cast("bigint").alias("_to"), "_gone")
    span = known.select("field", "key", from_ms.alias("_t"), F.lit(0).alias("_kind"), F.coalesce("to_ms", F.lit(FOREVER)).alias("_to"), F.lit(None).cast("boolean").alias("_gone"))
    right = replicate(head.unionByName(span), plan, move=False).withColumn("_ref", F.lit(None).cast(left.schema["_ref"].dataType))
    both = left.unionByName(right).repartitionById(plan.tasks, F.col("_task"))
    run = Window.partitionBy("_task", "field", "key").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = both.select(
        "field", "key", "_t", "_kind", "_ref",
        F.max(F.col("_kind") == -1).over(run).alias("_known"),
        F.max("_gone").over(run).alias("_dead"),
        F.max("_to").over(run).alias("_until"),
    )
    status = (
        F.when(F.col("key").isNull() | ~F.col("_known"), MISSING)
        .when(F.coalesce("_dead", F.lit(False)), DELETED)
        .when(F.col("_ref.at_ms").isNull(), OK)
        .when(F.col("_until").isNull(), LATE)
        .when(F.col("_until") > F.col("_t"), OK)
        .otherwise(DELETED)
    )
    return merged.where(F.col("_kind") == 1).select(F.col("_ref.tbl").alias("tbl"), "field", "key", F.col("_ref.at_ms").alias("at_ms"), F.col("_ref.arrival_seq").alias("arrival_seq"), *(F.col(f"_ref.{c}").alias(c) for c in extra), status.alias("status"))
