"""Late events under Structured Streaming: each micro-batch is one step of a pane store.

There is no watermark, as one would drop what comes out of order: rows are counted by
the arrival time that they carry, whichever file they come in and whenever.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyweave.operators.late import Slicing, to_panes
from tallyweave.operators.panes import PaneStore


def emit_corrections(rows: DataFrame, event: str, arrived: str, slicing: Slicing, folder: str, **trigger):
    """A query that brings a stream of rows into the pane store in ``folder``/store. A
    batch that is repeated after a failure is not counted twice."""
    panes = to_panes(rows, F.unix_millis(event), F.unix_millis(arrived), slicing).select("pane_ms", "tick")
    return step_panes(panes, PaneStore(rows.sparkSession, f"{folder}/store", slicing), f"{folder}/checkpoint", **trigger)


def step_panes(panes: DataFrame, store: PaneStore, checkpoint: str, **trigger):
    """The same for rows that have pane and tick already."""
    def step(batch: DataFrame, number: int) -> None:
        store.apply(batch, number)

    return panes.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(step)
