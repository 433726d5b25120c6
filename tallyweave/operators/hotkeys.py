"""Per-key work without stragglers: fragment-replicate by estimated load.

1. Estimate: the load of every hash group of keys (a fixed number of groups), then
   of the single keys inside groups heavy enough to hold a hot key.
2. Plan: a key whose load exceeds a task's fair share is split into shards in
   proportion; shards and groups of light keys are bin-packed to tasks, largest
   first to the emptiest task.
3. Assign: a row goes to its key's group, or to a shard chosen by a hash of other
   columns; a matching side is copied to exactly the shards of its key.

What the driver holds is bounded by the number of groups and by tasks / hot share,
whatever the number of rows or keys.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

#: Hash groups per task; the resolution of the estimate.
GROUPS_PER_TASK = 16


@dataclass
class Plan:
    """Where each key goes. ``light`` has a task per hash group; ``hot`` the tasks of
    the shards of each hot key (as a tuple of its key columns)."""

    keys: tuple[str, ...]
    tasks: int
    light: list[int]
    hot: dict[tuple, list[int]] = field(default_factory=dict)
    loads: list[float] = field(default_factory=list)
    hot_loads: dict[tuple, float] = field(default_factory=dict)
    total: float = 0.0


def _group(keys: tuple[str, ...], groups: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int")


def make_plan(rows: DataFrame, keys: tuple[str, ...], tasks: int, load: Column | None = None, hot_share: float = 0.5) -> Plan:
    """Estimate loads and pack. ``load`` is a row's weight (default 1; null counts 0,
    negative as 0); a key is hot when its load exceeds ``hot_share`` of a task's fair share."""
    groups = GROUPS_PER_TASK * tasks
    weight = F.greatest(F.coalesce(load, F.lit(0)), F.lit(0)).cast("double") if load is not None else F.lit(1.0)
    weighed = rows.select(*keys, weight.alias("_w"), _group(keys, groups).alias("_g"))
    of_group = {r["_g"]: r["w"] for r in weighed.groupBy("_g").agg(F.sum("_w").alias("w")).collect()}  # at most `groups` rows
    total = sum(of_group.values())
    limit = hot_share * total / tasks
    plan = Plan(keys, tasks, [0] * groups, total=total)
    heavy = [g for g, w in of_group.items() if total and w > limit]
    if heavy:  # at most tasks / hot_share keys can pass
        found = weighed.where(F.col("_g").isin(heavy)).groupBy(*keys, "_g").agg(F.sum("_w").alias("w")).where(F.col("w") > limit).collect()
        for r in found:
            plan.hot_loads[tuple(r[k] for k in keys)] = r["w"]
            of_group[r["_g"]] -= r["w"]
    pieces: list[tuple[float, object]] = [(of_group.get(g, 0.0), g) for g in range(groups)]
    for key, w in plan.hot_loads.items():
        shards = min(tasks, max(1, -(-int(w * tasks) // max(1, int(total)))))
        plan.hot[key] = []
        pieces += [(w / shards, key)] * shards
    heap = [(0.0, t) for t in range(tasks)]
    for w, what in sorted(pieces, key=lambda p: (-p[0], str(p[1]))):
        filled, task = heapq.heappop(heap)
        heapq.heappush(heap, (filled + w, task))
        if isinstance(what, tuple):
            plan.hot[what].append(task)
        else:
            plan.light[what] = task
    plan.loads = [w for w, _ in sorted(heap, key=lambda p: p[1])]
    return plan


def _with_tasks(df: DataFrame, plan: Plan, name: str) -> DataFrame:
    """Add the array of tasks that hold a row's key."""
    # One literal, whatever the number of tasks; it is folded to an array of ints.
    places = F.split(F.lit(",".join(map(str, plan.light))), ",").cast("array<int>")
    light = F.array(F.element_at(places, _group(plan.keys, len(plan.light)) + 1))
    if not plan.hot:
        return df.withColumn(name, light)
    spark = df.sparkSession
    fields = [f for f in df.select(*plan.keys).schema.fields]
    names = ", ".join(f"_k{i} {f.dataType.simpleString()}" for i, f in enumerate(fields))
    hot = spark.createDataFrame([(*k, t) for k, t in plan.hot.items()], f"{names}, _hot array<int>")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(plan.keys)]
    joined = df.join(F.broadcast(hot), on, "left")  # at most tasks / hot_share rows
    return joined.withColumn(name, F.coalesce("_hot", light)).drop("_hot", *(f"_k{i}" for i in range(len(fields))))


def fragment(df: DataFrame, plan: Plan, spread: list[str], task: str = "_task", move: bool = True) -> DataFrame:
    """Send each row to one task that holds its key. ``spread`` columns choose the
    shard of a hot key; rows equal in them stay together. With ``move`` off the task
    is only named, for a caller that moves the rows later."""
    t = _with_tasks(df, plan, "_tasks")
    shard = F.pmod(F.xxhash64(*spread), F.size("_tasks")).cast("int") + 1
    named = t.withColumn(task, F.element_at("_tasks", shard)).drop("_tasks")
    return named.repartitionById(plan.tasks, F.col(task)) if move else named


def replicate(df: DataFrame, plan: Plan, task: str = "_task", move: bool = True) -> DataFrame:
    """Copy each row of a matching side to the tasks that hold its key, no others."""
    t = _with_tasks(df, plan, "_tasks")
    copies = t.withColumn(task, F.explode(F.array_distinct("_tasks"))).drop("_tasks")
    return copies.repartitionById(plan.tasks, F.col(task)) if move else copies


def balanced_counts(rows: DataFrame, keys: tuple[str, ...], spread: list[str], tasks: int, load: Column | None = None, match: DataFrame | None = None, **aggregates: Column) -> DataFrame:
    """Per-key results with every task carrying about the same load.

    Returns keys, ``n`` (rows) and ``load``, and the given ``aggregates``, which must
    be sums or counts over rows (``spread`` must hold the columns of a distinct
    count, so that shards add up). A ``match`` frame (the keys and other columns, at most
    one row per key) is copied to the shards of its keys only and joined there; its columns
    may stand in ``aggregates`` and come out with the key (null: no match). Null keys form
    a group of their own and match nothing; an empty input gives no rows."""
    load = F.lit(1) if load is None else load
    rows = rows.withColumn("_load", load)
    plan = make_plan(rows, keys, tasks, F.col("_load"))
    parts = fragment(rows, plan, spread)
    told = [c for c in match.columns if c not in keys] if match is not None else []
    if match is not None:
        parts = parts.join(replicate(match, plan), ["_task", *keys], "left")
    partial = parts.groupBy("_task", *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("_load").alias("load"), *(a.alias(k) for k, a in aggregates.items()), *(F.first(c).alias(c) for c in told))
    return partial.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n", "load", *aggregates)), *(F.first(c).alias(c) for c in told))


def combined(rows: DataFrame, keys: tuple[str, ...], spread: list[str], tasks: int) -> DataFrame:
    """Rows summed up to (keys, ``_salt``, ``_rows``) before anything is moved: a map task
    sends at most GROUPS_PER_TASK * tasks rows of one key, however many it has read. The
    salt comes from the ``spread`` columns and tells later which shard they go to."""
    salt = F.pmod(F.xxhash64(*spread), F.lit(GROUPS_PER_TASK * tasks)).cast("int")
    return rows.groupBy(*keys, salt.alias("_salt")).agg(F.count(F.lit(1)).alias("_rows"))


def skew_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...], spread: list[str], tasks: int, how: str = "inner", estimate: DataFrame | None = None, load: Column | None = None) -> DataFrame:
    """Equi-join of a skewed left side: hot keys are split, and the right side's rows
    are copied only to the shards of their key. ``how``: inner, left, left_semi or
    left_anti; null keys match nothing. Columns of the right side that the left has
    too (other than the keys) are refused. ``estimate`` may give the keys' loads more
    cheaply than ``left`` does: a frame with the key columns, each row of which stands for
    ``load`` rows (default 1). Without hot keys the join is Spark's own."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_join cannot do a {how} join")
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    plan = make_plan(left if estimate is None else estimate, keys, tasks, load)
    if not plan.hot:
        return left.join(right, list(keys), how)
    return fragment(left, plan, spread).join(replicate(right, plan), ["_task", *keys], how).drop("_task")
