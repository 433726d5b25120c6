"""Queries of problems 2, 5, 7, 8 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.functions.text import compact, filled, trim_low
from tallyweave.llm import mixing, packing, places, seen, spam
from tallyweave.llm.tokens import counter
from tallyweave.operators.hotkeys import skew_join
from tallyweave.session import broadcast_if_small, few_rows, run_dir, written
from tallyweave.sources.tables import table


#: Deliveries in which the tables of problem 2 come.
DELIVERIES = 4


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# -- 2: seen keys -------------------------------------------------------------

def _voter(df: DataFrame) -> DataFrame:
    v = trim_low("voterId")
    return df.select(F.lit("vote_cast").alias("tbl"), F.when(filled(v), compact(v)).alias("key"), "arrival_seq")


def _original(df: DataFrame) -> DataFrame:
    return df.select(F.lit("rejected").alias("tbl"), compact(F.col("originalReceipt")).alias("key"), "arrival_seq")


def keyed_rows(spark: SparkSession, d: str) -> DataFrame:
    return _voter(table(spark, d, "vote_cast", "voterId", "arrival_seq")).unionByName(_original(table(spark, d, "rejected", "originalReceipt", "arrival_seq")))


def seen_keys(spark: SparkSession, d: str) -> seen.SeenKeys:
    """Both tables brought in as DELIVERIES deliveries in order of arrival; each starts the
    stream again from its checkpoint."""
    rows = keyed_rows(spark, d)
    last = {r[0]: r[1] for r in rows.groupBy("tbl").agg(F.max("arrival_seq")).collect()}  # one row per table
    upto = F.when(F.col("tbl") == "vote_cast", last.get("vote_cast") or 0).otherwise(last.get("rejected") or 0)
    cut = F.floor(F.col("arrival_seq") * DELIVERIES / (upto + 1)).cast("int")
    apart = written(rows.withColumn("cut", F.greatest(F.least(cut, F.lit(DELIVERIES - 1)), F.lit(0))), "keyed", "cut")
    folder = run_dir(spark, "seen")
    for k in range(DELIVERIES):
        # A new object each time, as after the end of the process that had the last one.
        seen.SeenKeys(spark, folder).bring(apart.where(F.col("cut") == k))
    return seen.SeenKeys(spark, folder)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose key an earlier arrival in the table had."""
    return seen_keys(spark, d).answers().where("not first").select("tbl", "arrival_seq")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows, keyed rows, firsts and repeats per table, and the share of answers that an
    exact recount from the tables contradicts."""
    rows, told = keyed_rows(spark, d), seen_keys(spark, d).answers()
    truth = rows.where(F.col("key").isNotNull()).groupBy("tbl", "key").agg(F.min("arrival_seq").alias("arrival_seq")).select("tbl", "arrival_seq", F.lit(True).alias("is_first"))
    every = rows.select("tbl", "arrival_seq", F.col("key").isNotNull().alias("keyed")).join(told, ["tbl", "arrival_seq"], "left").join(truth, ["tbl", "arrival_seq"], "left")
    right = F.when(F.col("keyed"), F.col("first").eqNullSafe(F.coalesce("is_first", F.lit(False)))).otherwise(F.col("first").isNull())
    keyed = F.sum(F.col("keyed").cast("bigint"))
    firsts, repeats = (F.count(F.when(c, 1)) for c in (F.col("first"), ~F.col("first")))
    return every.groupBy("tbl").agg(F.count(F.lit(1)).alias("n_rows"), keyed.alias("keyed"), firsts.alias("firsts"), repeats.alias("repeats"), (F.count(F.when(~right, 1)) / F.greatest(keyed, F.lit(1))).alias("wrong_share"))


# -- 5: places as typed ---------------------------------------------------------

def inexact_places(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Votes whose place is typed but equals no entry, and the list."""
    listed = table(spark, d, "municipios", "mun_code", "uf", "municipio", "peso")
    votes = table(spark, d, "vote_cast", "arrival_seq", "state", "city").where(filled(trim_low("city")))
    exact = listed.select(F.col("uf").alias("_uf"), F.col("municipio").alias("_city")).where("_uf is not null and _city is not null").distinct()
    rest = votes.join(broadcast_if_small(exact), (F.upper(trim_low("state")) == F.col("_uf")) & (trim_low("city") == F.col("_city")), "left_anti")
    return rest.withColumn("state", F.coalesce("state", F.lit(""))), listed


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The entry that each inexact place means, 0 for none."""
    votes, listed = inexact_places(spark, d)
    meant = places.map_places(votes.select("state", "city").distinct(), listed)
    return skew_join(votes, meant.select("state", "city", "mun_code"), ("state", "city"), ["arrival_seq"], tasks(spark)).select("arrival_seq", "mun_code")


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Different places as typed that match no entry, with the votes that name them."""
    votes, listed = inexact_places(spark, d)
    counted = votes.groupBy("state", "city").agg(F.count(F.lit(1)).alias("votes"))
    meant = places.map_places(counted.select("state", "city"), listed)
    return counted.join(meant.where("mun_code = 0").select("state", "city"), ["state", "city"])


# -- 7: packing posts -----------------------------------------------------------

def measured(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source and tokens of every document, written once: encoding is the
    dearest step and the plans read the sizes several times."""
    path = run_dir(spark, "sizes")
    table(spark, d, "documents", "doc_id", "source", "text").select("doc_id", "source", counter()("text").alias("tokens")).write.parquet(path)
    return spark.read.schema("doc_id bigint, source string, tokens int").parquet(path)


def containers(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    """The container table has one row per size."""
    rows = table(spark, d, "containers", "container", "capacity_tokens").where("container is not null and capacity_tokens > 0").distinct().orderBy("capacity_tokens", "container")
    return [(r[0], r[1]) for r in few_rows(rows, 1000, "sizes of containers")]


def _packed(spark: SparkSession, d: str, sizes: DataFrame) -> DataFrame:
    out = sizes.select(F.lit("").alias("container"), "doc_id", F.lit(0).cast("bigint").alias("piece"), F.col("tokens").cast("bigint").alias("tokens"), F.lit(0).cast("bigint").alias("bin")).limit(0)
    for name, capacity in containers(spark, d):
        out = out.unionByName(packing.pack(sizes, capacity).select(F.lit(name).alias("container"), "doc_id", "piece", "tokens", "bin"))
    return out


def p7_assignments(spark: SparkSession, d: str) -> DataFrame:
    """Every document's place in containers of each size."""
    return _packed(spark, d, measured(spark, d))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, the fewest that could hold the tokens, and the share filled."""
    bins = p7_assignments(spark, d).groupBy("container", "bin").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
    sizes = table(spark, d, "containers", "container", "capacity_tokens").where("container is not null").distinct()
    used = bins.groupBy("container").agg(F.count(F.lit(1)).alias("bins"), F.sum("tokens").alias("tokens"), F.sum("items").alias("items"), F.max("tokens").alias("fullest"))
    return used.join(broadcast_if_small(sizes), "container").select("*", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_bins"), (F.col("tokens") / (F.col("bins") * F.col("capacity_tokens"))).alias("filled"))


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per size of container: documents with text, those placed, those cut although they
    fit, those whose pieces do not add up, and containers above their capacity."""
    sizes = measured(spark, d)
    placed = written(_packed(spark, d, sizes), "placed")
    of = table(spark, d, "containers", "container", "capacity_tokens").where("container is not null").distinct()
    docs = placed.groupBy("container", "doc_id").agg(F.sum("tokens").alias("held"), F.count(F.lit(1)).alias("pieces")).join(sizes.select("doc_id", F.col("tokens").alias("size")), "doc_id").join(broadcast_if_small(of), "container")
    whole = docs.groupBy("container").agg(
        F.count(F.lit(1)).alias("placed"), F.count(F.when((F.col("pieces") > 1) & (F.col("size") <= F.col("capacity_tokens")), 1)).alias("cut_though_fitting"),
        F.count(F.when(F.col("held") != F.col("size"), 1)).alias("not_adding_up"))
    bins = placed.groupBy("container", "bin").agg(F.sum("tokens").alias("tokens")).join(broadcast_if_small(of), "container")
    over = bins.groupBy("container").agg(F.count(F.when(F.col("tokens") > F.col("capacity_tokens"), 1)).alias("overfull"))
    texts = table(spark, d, "documents", "text").where(F.length("text") > 0).count()
    return whole.join(over, "container").withColumn("documents", F.lit(texts))


# -- 8: mixing sources -----------------------------------------------------------

def _targets(spark: SparkSession, d: str) -> dict[str, tuple[float, int]]:
    """The target table has one row per source."""
    rows = table(spark, d, "mix_targets", "source", "target_share", "max_repeats").where("source is not null").orderBy("source", "target_share")
    return {r[0]: (r[1] or 0.0, r[2] or 0) for r in few_rows(rows, 10_000, "sources with a target")}


def _source_tokens(sizes: DataFrame, names: list[str]) -> dict[str, int]:
    return {r[0]: int(r[1]) for r in sizes.where(F.col("source").isin(names)).groupBy("source").agg(F.sum("tokens")).collect()}


def _planned(spark: SparkSession, d: str, plan) -> tuple[DataFrame, mixing.Mix]:
    sizes = measured(spark, d).withColumnRenamed("doc_id", "id")
    targets = _targets(spark, d)
    return sizes, plan(_source_tokens(sizes, list(targets)), targets)


def _mix(spark: SparkSession, d: str, plan) -> DataFrame:
    return mixing.realise(*_planned(spark, d, plan)).withColumnRenamed("id", "doc_id")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixture that meets the targets as nearly as it can, one row per use: the largest
    in which no limit on repeats binds."""
    return _mix(spark, d, mixing.plan_mix)


def p8_full_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixture of as many tokens as the sources have: limits bind, and the exponent is
    bisected until they hold."""
    return _mix(spark, d, mixing.plan_full)


def p8_entropy_mix(spark: SparkSession, d: str) -> DataFrame:
    """The plain tempered mixture that has the targets' entropy."""
    return _mix(spark, d, mixing.plan_entropy)


def _shares(spark: SparkSession, d: str, plan) -> DataFrame:
    sizes, mix = _planned(spark, d, plan)
    uses = mixing.realise(sizes, mix)
    targets = table(spark, d, "mix_targets", "source", "target_share", "max_repeats")
    used = uses.groupBy("source").agg(F.sum("tokens").alias("used_tokens"), F.count(F.lit(1)).alias("uses"), (F.max("epoch") + 1).alias("most_uses"))
    used = written(used, "used")
    have = sizes.groupBy("source").agg(F.sum("tokens").cast("bigint").alias("source_tokens"))
    total = used.agg(F.sum("used_tokens")).first()[0] or 0
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    all_sources = targets.join(have, "source", "full").join(used, "source", "left")
    return all_sources.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), "max_repeats", zero("source_tokens"), zero("used_tokens"), zero("uses"), zero("most_uses"), (F.coalesce("used_tokens", F.lit(0)) / F.lit(float(max(1, total)))).alias("share"), F.lit(mix.exponent).alias("exponent"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every source."""
    return _shares(spark, d, mixing.plan_mix)


def p8_full_shares(spark: SparkSession, d: str) -> DataFrame:
    """The same for the mixture whose limits bind."""
    return _shares(spark, d, mixing.plan_full)


def p8_entropy_shares(spark: SparkSession, d: str) -> DataFrame:
    """The same for the plain tempered mixture that has the targets' entropy."""
    return _shares(spark, d, mixing.plan_entropy)


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per mixture: sources in it, uses beyond a limit, uses that come twice in an epoch, uses
    in a later epoch of documents that the one before left out, sources whose budget is missed
    by as much as their longest document, and blocks whose positions are not 0, 1, 2, ..."""
    sizes, targets = measured(spark, d).withColumnRenamed("doc_id", "id"), _targets(spark, d)
    tokens, rows = _source_tokens(sizes, list(targets)), []
    limits = table(spark, d, "mix_targets", "source", "max_repeats")
    longest = {r[0]: r[1] for r in sizes.where(F.col("source").isin(list(targets))).groupBy("source").agg(F.max("tokens")).collect()}
    for name, plan in (("target", mixing.plan_mix), ("full", mixing.plan_full), ("entropy", mixing.plan_entropy)):
        mix = plan(tokens, targets)
        uses = written(mixing.realise(sizes, mix), "uses")
        docs = uses.groupBy("source", "id").agg(F.count(F.lit(1)).alias("n"), F.max("epoch").alias("last"), F.count_distinct("epoch").alias("epochs")).join(broadcast_if_small(limits), "source")
        used = {r[0]: r[1] for r in uses.groupBy("source").agg(F.sum("tokens")).collect()}  # one row per source of the target table
        off = sum(not 0 <= b - used.get(s, 0) < longest[s] for s, b in mix.budgets.items())
        blocks = uses.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("low"), F.max("position").alias("high"), F.count_distinct("position").alias("d"))
        gaps = blocks.where("low <> 0 or high + 1 <> n or d <> n").count()
        one = docs.agg(F.count(F.when(F.col("n") > F.col("max_repeats"), 1)), F.coalesce(F.sum(F.col("n") - F.col("epochs")), F.lit(0)), F.count(F.when(F.col("last") + 1 != F.col("epochs"), 1))).first()
        rows.append((name, len(mix.weights), *one, off, gaps))
    return spark.createDataFrame(rows, "mixture string, sources bigint, beyond_limit bigint, twice_in_epoch bigint, left_out bigint, budget_missed bigint, gaps bigint")


# -- 9: spam posts -----------------------------------------------------------------

def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Posts that consist mostly of keywords, links or tags."""
    return spam.page_scores(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text").where(F.col("reason").isNotNull()).select(F.col("id").alias("doc_id"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """The measures of every post."""
    return spam.page_scores(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text").withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (
    p2_found, p2_report, p5_found, p5_unmatched, p7_assignments, p7_fill, p7_invariants, p8_mix, p8_full_mix, p8_entropy_mix,
    p8_shares, p8_full_shares, p8_entropy_shares, p8_invariants, p9_found, p9_scores,
)}
