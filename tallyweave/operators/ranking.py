"""Ranks and running values in one order, without one task that sorts everything.

Rows are cut into ranges of the order column, each range is summed up, and sums of
earlier ranges are carried into the next; only rows of one range (and group) are
ever sorted together. Ranges are of equal width, which suits dense sequence numbers;
for any other spread results are the same and only the balance differs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def ranges(df: DataFrame, order: str, count: int | None = None) -> Column:
    """The range (0 .. count - 1) of each row's ``order`` value."""
    count = count or max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    low, high = df.agg(F.min(order), F.max(order)).first()
    if low is None:
        return F.lit(0)
    width = max(1, -(-(high - low + 1) // count))
    return F.floor((F.col(order) - F.lit(low)) / F.lit(width)).cast("int")


def _carry(df: DataFrame, keys: list[str], order: str, total: Column, combine) -> tuple[DataFrame, list[str]]:
    parts = df.withColumn("_range", ranges(df, order))
    sums = parts.groupBy(*keys, "_range").agg(total.alias("_v"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "_range", combine("_v").over(before).alias("_before"))
    on = [parts[k].eqNullSafe(carried[k]) for k in keys] + [parts["_range"] == carried["_range"]]
    joined = parts.join(carried, on, "left").select(parts["*"], carried["_before"])
    return joined, [*keys, "_range"]


def running_count(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Number of rows of the same keys up to and with the row; ``order`` is unique
    within the keys."""
    joined, group = _carry(df, keys, order, F.count(F.lit(1)), F.sum)
    w = Window.partitionBy(*group).orderBy(order)
    return joined.withColumn(name, F.row_number().over(w) + F.coalesce("_before", F.lit(0))).drop("_range", "_before")


def running_max_before(df: DataFrame, value: str, order: str, name: str) -> DataFrame:
    """Greatest ``value`` over all rows strictly earlier in ``order`` (unique), null for
    the first row. The carried table has one row per range."""
    joined, group = _carry(df, [], order, F.max(value), F.max)
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(name, F.greatest(F.max(value).over(w), F.col("_before"))).drop("_range", "_before")
