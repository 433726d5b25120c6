"""A deterministic source of ballots: weighted candidates and places, some repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Weights of the candidates, in ballot order.
CANDIDATE_WEIGHTS = (28, 24, 12, 9, 7, 6, 4, 3, 3, 2, 1, 1)


def uniform(seed: int, purpose: str, *columns: str) -> Column:
    """A number in [0, 1) that depends on seed, purpose and columns only."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *(F.col(c).cast("string") for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def pick(u: Column, weights: list[int]) -> Column:
    """Index (from 0) that a uniform number selects by weight."""
    total, sums, at = sum(weights), [], 0
    if total <= 0 or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative, nor all 0")
    for w in weights:
        at += w
        sums.append(at / total)
    bounds = F.array(*map(F.lit, sums))
    return F.least(F.size(F.filter(bounds, lambda b: b <= u)), F.lit(len(weights) - 1))


def ballots(spark: SparkSession, count: int, candidates: list[tuple[str, str]], places: list[tuple[str, str, int]], duplicate_rate: float = 0.1, seed: int = 42) -> DataFrame:
    """``count`` ballots with ``id`` 0, 1, ...; the same seed gives the same ballots.

    With probability ``duplicate_rate`` a ballot comes from a voter who has voted
    (``duplicate``). Candidates are (number, party), places (state, city, weight);
    without either there are no ballots."""
    if not candidates or not places:
        return spark.createDataFrame([], "id bigint, voterId string, candidateId string, partyId string, state string, city string, duplicate boolean")
    if not 0 <= duplicate_rate < 1:
        raise ValueError("the rate of duplicates lies in [0, 1)")
    weights = [CANDIDATE_WEIGHTS[i] if i < len(CANDIDATE_WEIGHTS) else 1 for i in range(len(candidates))]
    ids = spark.range(count)
    again = (uniform(seed, "again", "id") < duplicate_rate) & (F.col("id") > 0)
    # A repeat names an earlier ballot; where that was a repeat too, its voter is the
    # one that it would have had on its own, who may not have voted: follow it to 0 at worst.
    earlier = F.floor(uniform(seed, "whom", "id") * F.col("id")).cast("bigint")
    chosen = F.when(again, earlier).otherwise(F.col("id"))
    out = ids.select("id", again.alias("duplicate"), chosen.alias("_voter"))
    numbers = F.array(*(F.lit(c[0]) for c in candidates))
    parties = F.array(*(F.lit(c[1]) for c in candidates))
    c = pick(uniform(seed, "candidate", "id"), weights) + 1
    spots = F.array(*(F.struct(F.lit(s).alias("state"), F.lit(m).alias("city")) for s, m, _ in places))
    place = F.element_at(spots, pick(uniform(seed, "place", "id"), [w for _, _, w in places]) + 1)
    return out.select(
        "id", F.concat(F.lit("voter-"), F.lpad(F.col("_voter").cast("string"), 12, "0")).alias("voterId"), F.element_at(numbers, c).alias("candidateId"),
        F.element_at(parties, c).alias("partyId"), place["state"].alias("state"), place["city"].alias("city"), "duplicate",
    )
