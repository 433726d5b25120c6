"""Counts of accepted votes over any dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.operators.ranking import running_count

#: Dimension -> key of a normalised vote. A city is named with its state.
DIMENSIONS: dict[str, Column | str] = {"CANDIDATE": "candidate", "STATE": "region", "CITY": "region/place", "PARTY": "party"}


def key_column(dimension: str) -> Column:
    spec = DIMENSIONS[dimension]
    if isinstance(spec, Column):
        return spec
    return F.concat_ws("/", *spec.split("/")) if "/" in spec else F.col(spec)


def _pairs(accepted: DataFrame, dimensions: tuple[str, ...], order: str) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), key_column(d).alias("key")) for d in dimensions))
    return accepted.select(F.explode(pairs).alias("_p"), "castAt", order).select("_p.dimension", "_p.key", "castAt", order)


def tally(accepted: DataFrame, dimensions: tuple[str, ...] = tuple(DIMENSIONS), order: str = "arrival_seq") -> DataFrame:
    """Final counts: dimension, key, count, and the cast time of the last arrival. One
    shuffle for all dimensions, of partial counts only."""
    pairs = _pairs(accepted, dimensions, order)
    return pairs.groupBy("dimension", "key").agg(F.count(F.lit(1)).alias("count"), F.max_by("castAt", order).alias("updatedAt"))


def changelog(accepted: DataFrame, dimension: str, order: str = "arrival_seq") -> DataFrame:
    """The running count after every vote, as the streaming job emits it."""
    pairs = _pairs(accepted, (dimension,), order)
    return running_count(pairs, ["dimension", "key"], order, "count").select("dimension", "key", "count", F.col("castAt").alias("updatedAt"), order)


def compact(log: DataFrame) -> DataFrame:
    """The last state of every key of a changelog (a compacted topic)."""
    return log.groupBy("dimension", "key").agg(F.max("count").alias("count"), F.max_by("updatedAt", "count").alias("updatedAt"))


def reconcile(decisions: DataFrame) -> DataFrame:
    """One row that shows whether the books agree: requests, accepted, rejected, and
    the totals of each dimension over the one accepted set."""
    totals = tally(decisions.where(F.col("reason").isNull())).groupBy().agg(*(F.sum(F.when(F.col("dimension") == d, F.col("count")).otherwise(0)).alias(f"by_{d.lower()}") for d in DIMENSIONS))
    counts = decisions.groupBy().agg(F.count(F.lit(1)).alias("requests"), F.count(F.when(F.col("reason").isNull(), 1)).alias("accepted"), F.count("reason").alias("rejected"))
    rows = counts.unionByName(totals, allowMissingColumns=True)
    both = rows.groupBy().agg(*(F.max(c).alias(c) for c in rows.columns))
    ok = F.col("requests") == F.col("accepted") + F.col("rejected")
    for d in DIMENSIONS:
        ok = ok & (F.col(f"by_{d.lower()}") == F.col("accepted"))
    return both.withColumn("balanced", F.coalesce(ok, F.col("requests") == 0))
