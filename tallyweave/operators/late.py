"""Late and out-of-order events by stream slicing.

Event time is cut into panes that do not overlap, as long as the greatest common
divisor of window size and slide. A row changes one pane only; a window's count
is composed of the panes it covers, and a window is emitted again only when a
late row has changed one of them. A pane keeps one number per *tick* (the
interval between two emissions), never rows, so its size has a bound that does
not depend on how many rows fall into it.

A window ends at its start + size, closes ``delay`` later (revision 0) and takes
corrections until ``cutoff`` after its end (revisions 1, 2, ... one per tick).
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame, Window, functions as F

ON_TIME, LATE, TOO_LATE, NO_WINDOW, COPY = "ON_TIME", "LATE", "TOO_LATE", "NO_WINDOW", "COPY"


@dataclass(frozen=True)
class Slicing:
    """Window geometry and lateness bounds, all in milliseconds."""

    size: int = 15_000
    slide: int | None = None
    delay: int = 5_000
    cutoff: int = 300_000
    tick: int = 5_000

    def __post_init__(self) -> None:
        if self.size <= 0 or (self.slide or self.size) <= 0 or self.size % (self.slide or self.size):
            raise ValueError("size must be positive and a multiple of slide")
        if self.tick <= 0 or self.pane % self.tick or (self.cutoff - self.delay) % self.tick or self.cutoff < self.delay:
            raise ValueError("tick must divide the pane and cutoff - delay")

    @property
    def step(self) -> int:
        return self.slide or self.size

    @property
    def pane(self) -> int:
        return gcd(self.size, self.step)


def to_panes(events: DataFrame, event_ms: Column, arrived_ms: Column, slicing: Slicing) -> DataFrame:
    """Add ``pane_ms`` (start of the row's pane) and ``tick`` (emission interval of
    its arrival). Both are null where the row has no event time; a row without an
    arrival time counts as arrived in the first tick."""
    pane = event_ms - F.pmod(event_ms, F.lit(slicing.pane).cast("bigint"))
    tick = F.floor((arrived_ms - slicing.delay) / slicing.tick).cast("bigint")
    first = (pane + slicing.pane) / slicing.tick - 1
    return events.withColumns({"pane_ms": pane, "tick": F.when(event_ms.isNotNull(), F.greatest(F.coalesce(tick, first.cast("bigint")), first.cast("bigint")))})


def lateness(slicing: Slicing) -> Column:
    """Status of a row against the last window that covers its pane; for tumbling
    windows that is the only one. Needs ``pane_ms`` and ``tick``."""
    end = F.col("pane_ms") - F.pmod(F.col("pane_ms"), F.lit(slicing.step).cast("bigint")) + slicing.size
    close, last = end / slicing.tick, (end + slicing.cutoff - slicing.delay) / slicing.tick
    return (
        F.when(F.col("pane_ms").isNull(), NO_WINDOW)
        .when(F.col("tick") < close, ON_TIME)
        .when(F.col("tick") < last, LATE)
        .otherwise(TOO_LATE)
    )


def pane_log(panes: DataFrame, *groups: str) -> DataFrame:
    """Rows per (groups, pane, tick). Partial sums run before the shuffle, so a
    pane that holds a third of all rows still ships a few numbers per task."""
    return panes.where(F.col("pane_ms").isNotNull()).groupBy(*groups, "pane_ms", "tick").agg(F.count(F.lit(1)).alias("n"))


def compose(log: DataFrame, slicing: Slicing, *groups: str) -> DataFrame:
    """Emissions of every window: one row per (window, revision) that changes it,
    with the change (``delta``) and the count after it (``n``). Revision 0 is the
    count as of the close; rows beyond the cut-off change nothing."""
    first = F.col("pane_ms") - F.pmod(F.col("pane_ms"), F.lit(slicing.step).cast("bigint")) - (slicing.size - slicing.step)
    covering = F.transform(F.sequence(F.lit(0), F.lit(slicing.size // slicing.step - 1)), lambda i: first + i * slicing.step)
    starts = log.withColumn("window_ms", F.explode(covering) if slicing.size != slicing.step else first)
    close = (F.col("window_ms") + slicing.size) / slicing.tick
    revision = F.greatest(F.col("tick") - close + 1, F.lit(0)).cast("bigint")
    deltas = (
        starts.withColumn("revision", revision)
        .where(F.col("revision") <= (slicing.cutoff - slicing.delay) // slicing.tick)
        .groupBy(*groups, "window_ms", "revision")
        .agg(F.sum("n").alias("delta"))
    )
    order = Window.partitionBy(*groups, "window_ms").orderBy("revision")
    end = F.col("window_ms") + slicing.size
    return deltas.select(
        *groups,
        F.timestamp_millis("window_ms").alias("window_start"),
        F.timestamp_millis(end).alias("window_end"),
        "revision",
        F.timestamp_millis(end + slicing.delay + F.col("revision") * slicing.tick).alias("emitted_at"),
        "delta",
        F.sum("delta").over(order).alias("n"),
    )


def first_copies(rows: DataFrame, key: str, seq: str, *groups: str) -> DataFrame:
    """The row with the lowest ``seq`` of each message. ``key`` is a struct or null;
    a row with a null key is a message of its own. All other columns are kept.

    One aggregation with partial minima: copies of a message that holds a third of
    all rows are combined before the shuffle."""
    alone = F.when(F.col(key).isNull(), F.col(seq))
    rest = [c for c in rows.columns if c not in (key, *groups)]
    value = F.struct(F.col(seq), *(F.col(c) for c in rest if c != seq))
    found = rows.groupBy(*groups, F.col(key).alias(key), alone.alias("_alone")).agg(F.min(value).alias("_first"))
    return found.select(*groups, key, *(F.col(f"_first.{c}").alias(c) for c in rest))
