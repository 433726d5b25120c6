"""Filling containers of a fixed capacity: linear grouping, then best fit.

The plan is made from the histogram of lengths, which has at most ``capacity``
entries whatever the number of texts, and is carried out on the texts in parallel:

1. Texts above the capacity are split into full pieces and a rest.
2. Large items (above SMALL of the capacity) are sorted and cut into GROUPS groups of
   equal count; each counts as long as the longest of its group.
3. Configurations (how many items of each group one container takes) are found for
   these few sizes by column generation: the linear programme over configurations,
   priced by a knapsack, rounded down, and the rest first-fit decreasing.
4. The texts take the places of their group in order of length, and the room that is
   really left in each container is counted.
5. Small items go, longest first, where they leave the least room: all containers
   with the same room are one class, handled as runs of a count, not one by one.

A text's place in a container follows from its rank among texts of its length, so
no step gathers texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tallyweave.session import written

#: Items up to this share of the capacity are small.
SMALL = 1 / 8
#: Groups of large items; the waste of rounding is about 1 / GROUPS of them.
GROUPS = 24
#: Rank buckets of one length, so that no task sorts all texts of a frequent length.
BUCKETS = 64


def groups_of(lengths: dict[int, int], count: int = GROUPS) -> list[tuple[int, int, int]]:
    """(shortest, longest, items) of about equal counts, longest group first; equal
    lengths stay in one group. ``lengths`` maps length to number of items."""
    total = sum(lengths.values())
    share = max(1, -(-total // count))
    out: list[tuple[int, int, int]] = []
    high = n = 0
    low = 0
    for length in sorted(lengths, reverse=True):
        high = high or length
        low, n = length, n + lengths[length]
        if n >= share:
            out.append((low, high, n))
            high = n = 0
    if n:
        out.append((low, high, n))
    return out


def _knapsack(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, tuple[int, ...]]:
    """Best configuration for item values, exactly, for any capacity: ``best`` holds for each
    room the most that one item more brings. There are as many steps as a container takes of
    the shortest items (less than 1 / SMALL where all items are large)."""
    best, steps = np.zeros(capacity + 1), []
    for _ in range(capacity // min(sizes)):
        more, took = best.copy(), np.full(capacity + 1, -1, dtype=np.int32)
        for i, s in enumerate(sizes):
            gain = best[: capacity + 1 - s] + values[i]
            better = gain > more[s:] + 1e-12
            more[s:][better] = gain[better]
            took[s:][better] = i
        steps.append(took)
        if np.array_equal(more, best):
            break
        best = more
    config, room = [0] * len(sizes), capacity
    for took in reversed(steps):
        if took[room] >= 0:
            i = int(took[room])
            config[i] += 1
            room -= sizes[i]
    return float(best[capacity]), tuple(config)


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Configurations with how often each is used, which hold exactly ``counts`` items
    of ``sizes`` (each at most ``capacity``). Columns are generated until none improves."""
    if not sizes:
        return []
    columns = [tuple((capacity // s) if i == j else 0 for j in range(len(sizes))) for i, s in enumerate(sizes)]
    demand = np.array(counts, dtype=float)
    use, price = _linear(columns, demand)
    while True:
        value, config = _knapsack(sizes, price, capacity)
        if value <= 1 + 1e-6 or config in columns:
            break
        columns.append(config)
        use, price = _linear(columns, demand)
    left, out = list(counts), []
    for config, x in sorted(zip(columns, use), key=lambda p: -p[1]):
        n = int(x + 1e-9)
        n = min([n, *(left[i] // k for i, k in enumerate(config) if k)])
        if n > 0:
            out.append((config, n))
            left = [a - n * k for a, k in zip(left, config)]
    # What rounding down left over: whole configurations while they fit, then greedy.
    while any(left):
        config, free = [0] * len(sizes), capacity
        for i, s in enumerate(sizes):
            k = min(left[i], free // s)
            config[i], free = k, free - k * s
        n = min(left[i] // k for i, k in enumerate(config) if k)
        out.append((tuple(config), n))
        left = [a - n * k for a, k in zip(left, config)]
    return out


def _linear(columns: list[tuple[int, ...]], demand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimise the number of containers with ``columns @ x >= demand``: a revised
    simplex from the basis of single-size columns. Returns x and the dual prices."""
    a = np.array(columns, dtype=float).T
    m, n = a.shape
    basis = list(range(m))
    for _ in range(20 * n + 50):
        b = a[:, basis]
        x = np.linalg.solve(b, demand)
        price = np.linalg.solve(b.T, np.ones(m))
        reduced = 1 - price @ a
        enter = int(np.argmin(reduced))
        if reduced[enter] > -1e-9:
            break
        step = np.linalg.solve(b, a[:, enter])
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        if not np.isfinite(ratio).any():
            break
        basis[int(np.argmin(ratio))] = enter
    out = np.zeros(n)
    out[basis] = np.maximum(np.linalg.solve(a[:, basis], demand), 0)
    return out, np.linalg.solve(a[:, basis].T, np.ones(m))


@dataclass
class LargePlan:
    """Places for large items: item r (by length, longest first) of group g goes to the
    container found by searching ``starts[g]``; all arrays are short."""

    groups: list[tuple[int, int, int]]
    starts: list[list[int]] = field(default_factory=list)
    first_bin: list[list[int]] = field(default_factory=list)
    per_bin: list[list[int]] = field(default_factory=list)
    bins: int = 0


def plan_large(lengths: dict[int, int], capacity: int, count: int = GROUPS) -> LargePlan:
    groups = groups_of(lengths, count)
    plan = LargePlan(groups, [[] for _ in groups], [[] for _ in groups], [[] for _ in groups])
    placed = [0] * len(groups)
    for config, n in configurations([g[1] for g in groups], [g[2] for g in groups], capacity):
        for g, k in enumerate(config):
            if k:
                plan.starts[g].append(placed[g])
                plan.first_bin[g].append(plan.bins)
                plan.per_bin[g].append(k)
                placed[g] += k * n
        plan.bins += n
    return plan


@dataclass
class SmallPlan:
    """Runs: items of ``length`` with rank in [item, item + n) go to the containers of
    rank [place, place + n) among those whose room was ``room`` after the large items;
    a negative room numbers containers opened for small items."""

    length: np.ndarray
    item: np.ndarray
    n: np.ndarray
    room: np.ndarray
    place: np.ndarray
    opened: int = 0


def plan_small(lengths: dict[int, int], rooms: dict[int, int], capacity: int) -> SmallPlan:
    """Best fit, longest first, on counts. ``rooms`` maps room to number of containers."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # room now -> (room at first, place, n)
    for room, n in rooms.items():
        if n:
            runs[room].append((room, 0, n))
    order = sorted(runs)
    out, opened = [], 0
    for length in sorted((x for x in lengths if x > 0), reverse=True):
        left, item = lengths[length], 0
        while left:
            i = bisect_left(order, length)
            if i == len(order):
                # As many new containers as items of this length fill.
                n = -(-left // (capacity // length))
                runs[capacity] = [(-1, opened, n)]
                insort(order, capacity)
                opened += n
                continue
            room = order[i]
            origin, place, n = runs[room].pop()
            k = min(n, left)
            if k < n:
                runs[room].append((origin, place + k, n - k))
            if not runs[room]:
                del runs[room]
                order.pop(i)
            out.append((length, item, k, origin, place))
            item, left = item + k, left - k
            rest = room - length
            if rest:
                if rest not in runs:
                    insort(order, rest)
                runs[rest].append((origin, place, k))
    cols = np.array(out, dtype=np.int64).reshape(-1, 5).T
    return SmallPlan(cols[0], cols[1], cols[2], cols[3], cols[4], opened)


def ranked(items: DataFrame, by: str, key: str, name: str) -> DataFrame:
    """Rank (from 0) of each row among those with equal ``by``, in order of a hash of
    ``key``. Counts per hash bucket are summed first, so a value that a third of all
    rows have is ranked by BUCKETS tasks."""
    buckets = max(BUCKETS, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucketed = items.withColumn("_b", F.pmod(F.xxhash64(key, F.lit("rank")), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy(by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(by, "_b").orderBy(F.xxhash64(key), key)
    return bucketed.join(starts, [by, "_b"]).withColumn(name, F.row_number().over(within) - 1 + F.col("_start")).drop("_b", "_start")


def _histogram(items: DataFrame, column: str) -> dict[int, int]:
    """Items per value; lengths and rooms have at most ``capacity`` different values."""
    return {int(r[column]): int(r["n"]) for r in items.groupBy(column).agg(F.count(F.lit(1)).alias("n")).collect()}


def _large_lookup(plan: LargePlan, lengths: dict[int, int]):
    group, offset = {}, {}
    at = 0
    seen = 0
    for length in sorted(lengths, reverse=True):
        if length < plan.groups[at][0]:
            at, seen = at + 1, 0
        group[length], offset[length] = at, seen
        seen += lengths[length]
    arrays = [tuple(np.array(x, dtype=np.int64) for x in t) for t in zip(plan.starts, plan.first_bin, plan.per_bin)]

    @F.pandas_udf("bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.empty(len(length), dtype=np.int64)
        g = length.map(group).to_numpy()
        r = rank.to_numpy() + length.map(offset).to_numpy()
        for k in np.unique(g):
            mine = g == k
            starts, first, per = arrays[int(k)]
            i = np.searchsorted(starts, r[mine], side="right") - 1
            out[mine] = first[i] + (r[mine] - starts[i]) // per[i]
        return pd.Series(out)

    return place


def _small_lookup(plan: SmallPlan):
    order = np.lexsort((plan.item, plan.length))
    length, item, room, place = (x[order] for x in (plan.length, plan.item, plan.room, plan.place))
    width = np.int64(1) << 40

    @F.pandas_udf("struct<room:bigint,place:bigint>")
    def find(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        r = ranks.to_numpy()
        i = np.searchsorted(length * width + item, lengths.to_numpy().astype(np.int64) * width + r, side="right") - 1
        return pd.DataFrame({"room": room[i], "place": place[i] + r - item[i]})

    return find


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "tokens") -> DataFrame:
    """Assign items to containers of ``capacity``: (id, piece, tokens, bin).

    An item above the capacity comes as several pieces, all full but the last; any
    other has piece 0. Items without size (null, 0 or negative) take no container.
    ``sizes`` is read several times: give it a written or cheap frame. Bins of full
    pieces have negative numbers."""
    if capacity < 1:
        raise ValueError("a container needs a capacity of at least 1")
    spark = sizes.sparkSession
    items = sizes.where(F.col(size_col) > 0).select(F.col(id_col).alias("id"), F.col(size_col).cast("bigint").alias("tokens"))
    whole = F.floor((F.col("tokens") - F.when(F.col("tokens") % capacity == 0, 1).otherwise(0)) / capacity)
    full = items.where(F.col("tokens") > capacity).select("id", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)).alias("piece"))
    full = full.select("id", "piece", F.lit(capacity).cast("bigint").alias("tokens"), (-1 - F.monotonically_increasing_id()).alias("bin"))
    rest = items.select("id", F.when(F.col("tokens") > capacity, whole).otherwise(0).cast("bigint").alias("piece"), F.when(F.col("tokens") > capacity, F.col("tokens") - whole * capacity).otherwise(F.col("tokens")).alias("tokens"))
    limit = max(1, int(capacity * SMALL))
    lengths = _histogram(rest, "tokens")
    large = {x: n for x, n in lengths.items() if x > limit}
    small = {x: n for x, n in lengths.items() if x <= limit}
    out, bins, rooms, opened_from = full, None, {}, 0
    if large:
        plan = plan_large(large, capacity)
        places = ranked(rest.where(F.col("tokens") > limit), "tokens", "id", "_rank")
        # Written: the rooms left, the classes of bins and the result all read it.
        placed = written(places.select("id", "piece", "tokens", _large_lookup(plan, large)("tokens", "_rank").alias("bin")), "packing")
        out = out.unionByName(placed)
        bins = placed.groupBy("bin").agg((F.lit(capacity) - F.sum("tokens")).alias("room"))
        rooms = _histogram(bins, "room")
        opened_from = plan.bins
    if small:
        plan = plan_small(small, rooms, capacity)
        opened = spark.range(plan.opened).select((F.col("id") + opened_from).alias("bin"), F.lit(-1).cast("bigint").alias("room"), F.col("id").alias("place"))
        if bins is not None:
            opened = opened.unionByName(ranked(bins, "room", "bin", "place").select("bin", "room", "place"))
        spots = ranked(rest.where(F.col("tokens") <= limit), "tokens", "id", "_rank").withColumn("_to", _small_lookup(plan)("tokens", "_rank"))
        spots = spots.select("id", "piece", "tokens", F.col("_to.room").alias("room"), F.col("_to.place").alias("place"))
        out = out.unionByName(spots.join(opened, ["room", "place"]).select("id", "piece", "tokens", "bin"))
    return out.withColumnRenamed("id", id_col)
