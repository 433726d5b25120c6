"""Late events, step by step: panes are kept, and only windows over changed panes re-emitted.

Tables of the store (see sources/parts), cut by period of event time:
  panes       rows per (groups, pane, tick): what each step added
  emissions   windows as each step emitted them: revision, change and count

A step takes the rows that arrived since the last one, counts them per pane and tick, and
adds these counts to the panes. The arrival clock, the latest arrival seen, tells which
windows are closed; devices' clocks close nothing, and a row that comes with an older
arrival time than rows before it is counted where it belongs. Emitted are the closed
windows that cover a changed pane, and those that the clock has closed since; they are
composed of their panes again, and only periods that hold one of these panes are read.
Rows beyond the cut-off change nothing and are not kept.

A pane is a few numbers (one per tick up to the cut-off), whatever the number of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyweave.operators.late import Slicing, compose, pane_log
from tallyweave.session import written
from tallyweave.sources.parts import PartStore

#: Generations of a period before it is written as one.
GENERATIONS = 8


class PaneStore:
    """Panes and emissions of one window geometry. ``groups`` are the columns that tell
    independent sets of windows apart; ``period_ms`` is the length of a stored period."""

    def __init__(self, spark: SparkSession, root: str, slicing: Slicing, groups: tuple[str, ...] = (), period_ms: int = 21_600_000):
        self.spark, self.slicing, self.groups, self.period = spark, slicing, groups, period_ms
        self.store = PartStore(spark, root)

    def _part(self, ms: Column) -> Column:
        return F.floor(ms / self.period).cast("int")

    def _starts(self) -> Column:
        """Starts of the windows that cover ``pane_ms``."""
        s = self.slicing
        first = F.col("pane_ms") - F.pmod(F.col("pane_ms"), F.lit(s.step).cast("bigint")) - (s.size - s.step)
        return F.transform(F.sequence(F.lit(0), F.lit(s.size // s.step - 1)), lambda i: first + i * s.step)

    def _windows(self, panes: DataFrame) -> DataFrame:
        """(groups, pane, tick) once for each covering window, with its ``revision``."""
        s = self.slicing
        close = (F.col("window_ms") + s.size) / s.tick
        out = panes.select(*self.groups, "pane_ms", "tick", F.explode(self._starts()).alias("window_ms"))
        return out.withColumn("revision", F.greatest(F.col("tick") - close + 1, F.lit(0)).cast("bigint"))

    @property
    def last_revision(self) -> int:
        return (self.slicing.cutoff - self.slicing.delay) // self.slicing.tick

    def apply(self, rows: DataFrame, tag: int | None = None) -> bool:
        """Take in rows (groups, pane_ms, tick: see late.to_panes; a null pane counts
        nowhere). With a ``tag`` (the number of a micro-batch) a step that was done
        before is left out. Returns whether the step was done."""
        state = self.store.state()
        meta = state["meta"]
        if tag is not None and tag <= meta.get("tag", -1):
            return False
        s, gen = self.slicing, self.store.generation()
        # Beyond the cut-off of its last window a row changes nothing, but it moves the clock.
        last = F.element_at(self._starts(), -1) + s.size
        counted = pane_log(rows, *self.groups).withColumn("beyond", F.col("tick") >= (last + s.cutoff - s.delay) / s.tick)
        deltas = written(counted, "deltas")
        before = meta.get("clock")
        found = deltas.agg(F.max("tick").alias("clock"), F.min(F.when(~F.col("beyond"), F.col("pane_ms"))).alias("low")).first()
        clock = max((x for x in (before, found["clock"]) if x is not None), default=None)
        meta |= {"clock": clock, "tag": tag if tag is not None else meta.get("tag", -1)}
        if found["clock"] is None:
            self.store.commit(state)
            return True
        kept = deltas.where(~F.col("beyond")).drop("beyond")
        stored = self.store.parts(state, "panes")
        changed = [r[0] for r in kept.select(self._part(F.col("pane_ms")).alias("p")).distinct().collect()]  # one row per period
        # Windows of these periods, and of those that the clock has passed since, may be due.
        # Widths in periods: what a window reaches over, and from its start to its close.
        reach = -(-s.size // self.period)
        due = []
        if before is not None and clock > before:
            low, high = (before * s.tick - s.size) // self.period - 1, (clock * s.tick) // self.period + 1
            due = [p for p in stored if low <= p <= high]
        wanted = {q for p in (*changed, *due) for q in range(p - reach, p + reach + 1)}
        old = self.store.load(state, "panes", sorted(wanted & set(stored)))
        now = kept.withColumn("_now", F.lit(1))
        if old is not None:
            now = now.unionByName(old.select(*self.groups, "pane_ms", "tick", "n", F.lit(0).alias("_now")))
        panes = now.groupBy(*self.groups, "pane_ms", "tick").agg(F.sum("n").alias("n"), F.max("_now").alias("_now"))
        end_tick = (F.col("window_ms") + s.size) / s.tick
        touched = self._windows(panes.withColumn("pane_ms", F.col("pane_ms")).select(*self.groups, "pane_ms", "tick", "_now").where("_now = 1"))
        touched = touched.where(F.col("revision") <= self.last_revision).select(*self.groups, "window_ms")
        passed = self._windows(panes).where(end_tick > F.lit(before if before is not None else -(1 << 62))).select(*self.groups, "window_ms")
        ready = touched.unionByName(passed).where(end_tick <= F.lit(clock)).distinct()
        emitted = compose(panes, s, *self.groups).withColumn("window_ms", F.unix_millis("window_start"))
        on = [emitted[g].eqNullSafe(ready[g]) for g in self.groups] + [emitted["window_ms"] == ready["window_ms"]]
        emitted = emitted.join(ready, on, "left_semi").withColumn("version", F.lit(state["version"] + 1))
        self.store.write(state, "emissions", emitted.withColumn("part", self._part(F.col("window_ms"))), gen)
        self.store.write(state, "panes", kept.withColumn("part", self._part(F.col("pane_ms"))), gen)
        self._compact(state)
        self.store.commit(state)
        return True

    def _compact(self, state: dict) -> None:
        """Periods of many generations become one, equal panes and ticks added up."""
        parts = state["tables"]["panes"]["parts"]
        full = [int(p) for p, gens in parts.items() if len(gens) > GENERATIONS]
        if full:
            merged = self.store.load(state, "panes", full).groupBy(*self.groups, "pane_ms", "tick", "part").agg(F.sum("n").alias("n"))
            self.store.write(state, "panes", merged.select(*self.groups, "pane_ms", "tick", "n", "part"), self.store.generation(), instead_of=full)

    # -- reading ----------------------------------------------------------------
    def counts(self) -> DataFrame:
        """All windows as their panes stand, open ones as of now: see late.compose."""
        state = self.store.state()
        found = self.store.load(state, "panes")
        if found is None:
            kinds = ", ".join(f"{g} string" for g in self.groups)
            found = self.store.empty(state, "panes") if "panes" in state["tables"] else self.spark.createDataFrame([], f"{kinds + ', ' if kinds else ''}pane_ms bigint, tick bigint, n bigint")
        return compose(found.groupBy(*self.groups, "pane_ms", "tick").agg(F.sum("n").alias("n")), self.slicing, *self.groups)

    def emissions(self, state: dict | None = None) -> DataFrame | None:
        """Every emission there was: groups, window, revision, delta, n, version (of the
        step); a window's latest version holds."""
        return self.store.load(state or self.store.state(), "emissions")

    def corrections(self, rows: DataFrame) -> DataFrame | None:
        """(groups, pane_ms, tick) among ``rows`` by which a closed window was corrected: a
        window over the pane was emitted with the revision that the tick makes."""
        found = self.emissions()
        if found is None:
            return None
        revised = found.where("revision > 0").select(*(F.col(g).alias(f"_{g}") for g in self.groups), F.col("window_ms").alias("_w"), F.col("revision").alias("_r")).distinct()
        ticks = self._windows(rows.where("pane_ms is not null").select(*self.groups, "pane_ms", "tick").distinct())
        on = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in self.groups] + [F.col("window_ms") == F.col("_w"), F.col("revision") == F.col("_r")]
        return ticks.join(revised, on, "left_semi").select(*self.groups, "pane_ms", "tick").distinct()
