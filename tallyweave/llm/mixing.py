"""Mixing sources to target weights, by temperature.

With p the sources' own shares of the tokens and t the target shares, the family
w(a) ~ t (p / t)^a runs from the targets (a = 0) to the natural mixture (a = 1); with
equal targets it is the usual tempered mixture p^a. The exponent is bisected to the
least a at which no source is used more often than it may be, or to a wanted entropy.
Sources without documents or without a target have no weight; what they would have had
is shared out in proportion.

The weights become token budgets. A source is gone through in epochs, each a permutation
of its own of all its documents, until its budget is used up; what the document at the end
would exceed is left to the longest documents that still fit. The mixture comes in blocks of
about BLOCK_TOKENS, each of which has the sources in the shares of the whole, and in each
block the documents are permuted again.

A document's place in its epoch is the sum of the tokens before it: buckets of a permutation
are summed first, so no step goes through a source in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from tallyweave.llm.packing import ranked
from tallyweave.session import written

#: Least number of buckets of one permutation, and tokens of a block.
BUCKETS = 1024
BLOCK_TOKENS = 65_536


@dataclass(frozen=True)
class Mix:
    """Weights of the sources, their token budgets, and the exponent."""

    weights: dict[str, float]
    budgets: dict[str, int]
    exponent: float
    total: int


def tempered(natural: dict[str, float], target: dict[str, float], a: float) -> dict[str, float]:
    logs = {s: math.log(t) + a * (math.log(natural[s]) - math.log(t)) for s, t in target.items()}
    top = max(logs.values())
    raw = {s: math.exp(x - top) for s, x in logs.items()}
    return {s: x / sum(raw.values()) for s, x in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def bisect(fits, low: float, high: float) -> float:
    """The least exponent in [low, high] that fits; ``high`` does, and from some point on all do."""
    if fits(low):
        return low
    while True:
        mid = (low + high) / 2
        if not low < mid < high:
            return high
        low, high = (low, mid) if fits(mid) else (mid, high)


def _usable(tokens: dict[str, int], targets: dict[str, tuple[float, int]]) -> tuple[dict[str, float], dict[str, float]]:
    live = [s for s, (share, most) in targets.items() if tokens.get(s, 0) > 0 and (share or 0) > 0 and (most or 0) > 0]
    have, want = sum(tokens[s] for s in live), sum(targets[s][0] for s in live)
    return {s: tokens[s] / have for s in live}, {s: targets[s][0] / want for s in live}


def _planned(weights: dict[str, float], most: dict[str, int], total: int, a: float) -> Mix:
    return Mix(weights, {s: min(most[s], round(total * w)) for s, w in weights.items()}, a, total)


def plan_mix(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> Mix:
    """Budgets for ``targets`` (share, most repeats). Without ``total`` the mixture is
    as large as it can be with the targets met exactly; with a larger total the
    exponent rises just so far that the repeat limits hold, and past the natural
    mixture's own limit the total is cut to what the limits allow."""
    natural, want = _usable(tokens, targets)
    if not want:
        return Mix({}, {}, 0.0, 0)
    most = {s: targets[s][1] * tokens[s] for s in want}
    # A hair more than the quotient, which may come out below a whole number.
    allowed = lambda a: min(most[s] / w for s, w in tempered(natural, want, a).items()) * (1 + 1e-12)
    total = int(allowed(0.0)) if total is None else min(total, int(allowed(1.0)))
    a = bisect(lambda x: total <= allowed(x), 0.0, 1.0)
    return _planned(tempered(natural, want, a), most, total, a)


def plan_full(tokens: dict[str, int], targets: dict[str, tuple[float, int]]) -> Mix:
    """The mixture of as many tokens as its sources have: the repeat limits bind, and the
    exponent is what they ask for."""
    return plan_mix(tokens, targets, sum(tokens[s] for s in _usable(tokens, targets)[0]))


def plan_entropy(tokens: dict[str, int], targets: dict[str, tuple[float, int]], wanted: float | None = None) -> Mix:
    """Plain temperature: w ~ p^a with the entropy ``wanted`` (default: that of the
    targets), the largest mixture that the repeat limits allow. More entropy than equal
    shares have gives equal shares (a = 0). Entropy falls as the exponent rises, towards
    that of the largest sources alone; what is not above that is met within 1e-9 of it."""
    natural, want = _usable(tokens, targets)
    if not want:
        return Mix({}, {}, 0.0, 0)
    equal = {s: 1 / len(want) for s in want}
    wanted = entropy(want) if wanted is None else wanted
    fits = lambda a: entropy(tempered(natural, equal, a)) <= wanted + 1e-9
    high = 1.0
    top = math.log(sum(1 for p in natural.values() if p == max(natural.values())))
    while not fits(high) and entropy(tempered(natural, equal, high)) > top + 1e-9:
        high *= 2
    a = bisect(fits, 0.0, high)
    weights = tempered(natural, equal, a)
    most = {s: targets[s][1] * tokens[s] for s in want}
    return _planned(weights, most, int(min(most[s] / w for s, w in weights.items())), a)


def _begins(uses: DataFrame, buckets: int, seed: int) -> DataFrame:
    """Add ``begin``, the tokens of the source before each use: those of earlier epochs
    (``_held`` each) and of the documents before it in its epoch's permutation."""
    mixed = uses.withColumn("_h", F.xxhash64("id", "epoch", F.lit(seed))).withColumn("_b", F.pmod("_h", F.lit(buckets)).cast("int"))
    sums = mixed.groupBy("source", "epoch", "_b").agg(F.sum("tokens").alias("_w"))
    before = Window.partitionBy("source", "epoch").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "epoch", "_b", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("source", "epoch", "_b").orderBy("_h", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = mixed.join(starts, ["source", "epoch", "_b"]).withColumn("_in", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    return placed.withColumn("begin", F.col("epoch") * F.col("_held") + F.col("_start") + F.col("_in")).drop("_h", "_b", "_start", "_in")


def _filling(rest: DataFrame, gaps: dict[str, int]) -> dict[tuple[str, int], int]:
    """How many documents of which length fill what is left of each budget, longest first.
    What comes to the driver is bounded by the different lengths up to the longest gap, and a
    gap is shorter than one document."""
    room = F.create_map(*(F.lit(x) for pair in gaps.items() for x in pair))
    lengths = rest.where(F.col("tokens") <= room[F.col("source")]).groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")).collect()
    left, out = dict(gaps), {}
    for r in sorted(lengths, key=lambda r: (r["source"], -r["tokens"])):
        k = min(r["n"], left[r["source"]] // r["tokens"])
        if k:
            out[r["source"], r["tokens"]] = k
            left[r["source"]] -= k * r["tokens"]
    return out


def realise(sizes: DataFrame, mix: Mix, seed: int = 17, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per use of a document: (id, source, tokens, epoch, block, position); read in
    order of block and position they are the mixture. ``sizes`` has id, source and tokens;
    documents without tokens are never used. ``sizes`` is read twice."""
    spark = sizes.sparkSession
    names = sorted(mix.budgets)
    docs = sizes.where((F.col("tokens") > 0) & F.col("source").isin(names)).select("id", "source", F.col("tokens").cast("bigint").alias("tokens"))
    if not names:
        return docs.select("id", "source", "tokens", *(F.lit(0).alias(c) for c in ("epoch", "block", "position"))).limit(0)
    buckets = max(BUCKETS, 16 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = {r[0]: r[1] for r in docs.groupBy("source").agg(F.sum("tokens")).collect()}  # one row per source of the target table
    blocks = max(1, -(-sum(mix.budgets.values()) // block_tokens))
    plan = spark.createDataFrame([(s, mix.budgets[s], held[s], mix.budgets[s] // held[s]) for s in names if s in held], "source string, _budget bigint, _held bigint, _whole bigint")
    known = docs.join(F.broadcast(plan), "source")  # one row per source of the target table
    # Whole epochs, and one more of which the first part is used.
    uses = known.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_whole"))))
    placed = written(_begins(uses.where(F.col("epoch") * F.col("_held") < F.col("_budget")), buckets, seed), "mixing")
    fits = F.col("begin") + F.col("tokens") <= F.col("_budget")
    rest = placed.where(~fits)
    used = {r[0]: r[1] for r in placed.where(fits).groupBy("source").agg(F.sum("tokens")).collect()}
    gaps = {s: mix.budgets[s] - used.get(s, 0) for s in held if mix.budgets[s] > used.get(s, 0)}
    chosen = placed.where(fits)
    filling = _filling(rest, gaps) if gaps else {}
    if filling:
        wanted = spark.createDataFrame([(s, n, k) for (s, n), k in filling.items()], "source string, tokens bigint, _k bigint")
        near = rest.join(F.broadcast(wanted), ["source", "tokens"]).withColumn("_kind", F.struct("source", "tokens"))  # a few lengths per source
        # The last of the budget; they go to the last block.
        last = ranked(near, "_kind", "id", "_rank").where(F.col("_rank") < F.col("_k")).withColumn("begin", F.col("_budget") - 1)
        chosen = chosen.unionByName(last.select(*chosen.columns))
    block = F.least(F.floor(F.col("begin") * F.lit(blocks) / F.col("_budget")), F.lit(blocks - 1)).cast("bigint")
    out = chosen.select("id", "source", "tokens", F.col("epoch").cast("int").alias("epoch"), block.alias("block"))
    # A block holds about block_tokens tokens, so its rows are few.
    order = Window.partitionBy("block").orderBy(F.xxhash64("id", "epoch", F.lit(seed + 1)), "id", "epoch")
    return out.withColumn("position", F.row_number().over(order) - 1)
