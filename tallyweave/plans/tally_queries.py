"""Queries on admission, tallies, windows, trees and proofs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.config import Schedule
from tallyweave.functions import merkle
from tallyweave.functions.receipts import sha256_policy
from tallyweave.functions.text import normalize_id
from tallyweave.functions.windows import named_instant_ms, window_id
from tallyweave.operators import admission, chain, ingest, proofs, tally, timeline, trees
from tallyweave.operators.ledger import Ledger
from tallyweave.session import few_rows, run_dir, written
from tallyweave.sources import generator
from tallyweave.sources.tables import table

ELECTION = "vx-2031-geral"
SCHEDULE = Schedule.of("2031-03-02T09:01:00Z", "2031-03-03T21:00:00Z")
SHORT = Schedule.of("2031-03-02T09:05:00Z", "2031-03-02T09:50:00Z")
WINDOW_MS = 15_000
PEPPER = "pepper-de-teste"
CLOCK = "2031-03-02T09:30:00Z"


def votes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vote_cast")


def decisions(spark: SparkSession, d: str) -> DataFrame:
    return admission.admit(votes(spark, d), ELECTION, SCHEDULE)


def accepted(spark: SparkSession, d: str) -> DataFrame:
    return decisions(spark, d).where(F.col("reason").isNull())


def normalize_votes(spark: SparkSession, d: str) -> DataFrame:
    """Votes as the domain holds them, and whether they are valid."""
    return admission.normalize(votes(spark, d)).select("arrival_seq", *admission.IDS.values(), "valid")


def issue_receipts(spark: SparkSession, d: str) -> DataFrame:
    """The receipt that the formula gives each vote."""
    n = admission.normalize(votes(spark, d))
    return n.select("arrival_seq", sha256_policy(PEPPER)(F.col("election"), F.col("voter"), F.col("candidate"), F.unix_millis("castAt")).alias("issued"))


def schedule_status(spark: SparkSession, d: str) -> DataFrame:
    reason = admission.schedule_reason(F.unix_millis("castAt"), SHORT)
    return votes(spark, d).where("castAt is not null").groupBy(F.coalesce(reason, F.lit("OPEN")).alias("status")).agg(F.count(F.lit(1)).alias("votes"))


def admission_decisions(spark: SparkSession, d: str) -> DataFrame:
    return decisions(spark, d).select("arrival_seq", "voter", "reason", "originalReceipt")


def accepted_votes(spark: SparkSession, d: str) -> DataFrame:
    return admission.accepted_events(decisions(spark, d), WINDOW_MS, "arrival_seq")


def rejected_votes(spark: SparkSession, d: str) -> DataFrame:
    return admission.rejected_events(decisions(spark, d), "arrival_seq")


def rejections_by_reason(spark: SparkSession, d: str) -> DataFrame:
    return decisions(spark, d).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("votes"), F.count("originalReceipt").alias("with_original"))


def _one_tally(dimension: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return tally.tally(accepted(spark, d), (dimension,))

    return query


def tally_all_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return tally.tally(accepted(spark, d))


def tally_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """The four counts as grouping sets of one statement."""
    accepted(spark, d).createOrReplaceTempView("tallyweave_accepted")
    return spark.sql("""
        select candidate, region, place, party, count(*) as votes from tallyweave_accepted
        group by grouping sets ((candidate), (region), (region, place), (party))""")


def tally_changelog_candidate(spark: SparkSession, d: str) -> DataFrame:
    return tally.changelog(accepted(spark, d), "CANDIDATE")


def tally_latest_compacted(spark: SparkSession, d: str) -> DataFrame:
    return tally.compact(tally.changelog(accepted(spark, d), "STATE"))


def tally_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    return tally.reconcile(decisions(spark, d))


def distinct_voters(spark: SparkSession, d: str) -> DataFrame:
    return decisions(spark, d).groupBy().agg(F.count_distinct("voter").alias("voters"), F.count_distinct(F.when(F.col("reason").isNull(), F.col("voter"))).alias("counted_voters"), F.count(F.lit(1)).alias("requests"))


def votes_from_orders_tally(spark: SparkSession, d: str) -> DataFrame:
    """Orders as ballots of their customers: the first order of each customer counts."""
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    first = orders.groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("candidate"))
    people = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment").join(table(spark, d, "nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = first.join(people, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("candidate", F.col("n_name").alias("state"), F.col("c_mktsegment").alias("party")).agg(F.count(F.lit(1)).alias("votes"))


def leaderboard_topk(spark: SparkSession, d: str) -> DataFrame:
    """The twelve best candidates; ties go to the lower number."""
    counts = tally.tally(accepted(spark, d), ("CANDIDATE",)).select("key", "count")
    return counts.orderBy(F.desc("count"), "key").limit(12)


# -- timeline and windows -----------------------------------------------------

def control(spark: SparkSession) -> DataFrame:
    beats = timeline.heartbeats(spark, ELECTION, SHORT.opens, SHORT.closes, 60_000)
    return beats.unionByName(timeline.closing_sentinel(spark, ELECTION, SCHEDULE, SCHEDULE.closes + 7_000))


def control_events(spark: SparkSession, d: str) -> DataFrame:
    return control(spark)


def timeline_union(spark: SparkSession, d: str) -> DataFrame:
    """Events per kind and minute on the joined timeline."""
    line = timeline.timeline(votes(spark, d), control(spark)).where("at is not null")
    return line.groupBy("kind", F.date_trunc("minute", "at").alias("minute")).agg(F.count(F.lit(1)).alias("events"))


def timed(spark: SparkSession, d: str) -> DataFrame:
    """Decisions with window and lateness; several steps read them, so they are written."""
    narrow = decisions(spark, d).select("arrival_seq", "castAt", "receipt", "reason")
    return written(timeline.mark_late(written(narrow, "decisions"), WINDOW_MS), "timed")


def window_markers(spark: SparkSession, d: str) -> DataFrame:
    return timeline.markers(timed(spark, d), WINDOW_MS, control(spark))


def late_votes(spark: SparkSession, d: str) -> DataFrame:
    """Accepted votes that came after their window had been closed."""
    return timed(spark, d).where("reason is null and late").select("arrival_seq", "receipt", window_id(F.col("window_ms")).alias("windowId"))


def in_time(t: DataFrame) -> DataFrame:
    """Accepted votes that were in time, as (windowId, receipt)."""
    return t.where("reason is null and not late").select(window_id(F.col("window_ms")).alias("windowId"), "receipt")


def sealed_leaves(spark: SparkSession, d: str, t: DataFrame | None = None) -> DataFrame:
    """Leaves of accepted votes that were in time. ``t``: timed votes, where a query has them."""
    return trees.leaf_set(in_time(timed(spark, d) if t is None else t))


def window_leaf_counts(spark: SparkSession, d: str) -> DataFrame:
    return sealed_leaves(spark, d).groupBy("windowId").agg(F.count(F.lit(1)).alias("leaves"))


def seal_status(spark: SparkSession, d: str) -> DataFrame:
    """The recorded leaves against the recorded markers."""
    name = window_id(named_instant_ms("windowId"))
    leaves = trees.leaf_set(table(spark, d, "accepted", "windowId", "receipt").select(name.alias("windowId"), "receipt"))
    return chain.seal_status(leaves, table(spark, d, "window_marker", "windowId", "count").select(name.alias("windowId"), "count"))


# -- trees, chain and proofs -----------------------------------------------------

def numbered(spark: SparkSession, d: str, t: DataFrame | None = None) -> DataFrame:
    return written(trees.numbered(sealed_leaves(spark, d, t)), "leaves")


def merkle_leaf_hashes(spark: SparkSession, d: str) -> DataFrame:
    return numbered(spark, d).select("windowId", "receipt", "leafIndex", merkle.leaf_hash(F.col("receipt")).alias("hash"))


def merkle_roots(spark: SparkSession, d: str) -> DataFrame:
    return trees.roots(numbered(spark, d))


def merkle_levels(spark: SparkSession, d: str) -> DataFrame:
    return trees.tree_levels(numbered(spark, d))


def told_markers(spark: SparkSession, t: DataFrame) -> DataFrame:
    return timeline.markers(t, WINDOW_MS, control(spark), distinct="receipt")


def sealed(spark: SparkSession, d: str, t: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Numbered leaves, and checkpoints of the windows that have a marker; admission and
    timeline run once for both."""
    t = timed(spark, d) if t is None else t
    leaves, _, records = chain.seal(in_time(t), told_markers(spark, t))
    return leaves, written(records, "chain")


def sealed_chain(spark: SparkSession, d: str) -> DataFrame:
    """Checkpoints of the windows that have a marker."""
    return sealed(spark, d)[1]


def lasting(spark: SparkSession, d: str) -> Ledger:
    """A ledger that has taken everything in one step."""
    t = timed(spark, d)
    ledger = Ledger(spark, run_dir(spark, "ledger"))
    ledger.apply(in_time(t), told_markers(spark, t))
    return ledger


def roots(spark: SparkSession, d: str) -> DataFrame:
    """All checkpoints of the ledger, as the proof service lists them."""
    return proofs.roots(lasting(spark, d).records()).drop("sealedAt")


def root_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The checkpoint of each window that has an accepted vote, or that it is not sealed."""
    t = timed(spark, d)
    asked = t.where("reason is null").select(window_id(F.col("window_ms")).alias("windowId")).distinct()
    records = sealed(spark, d, t)[1].select("windowId", "root", "checkpointHash")
    return asked.join(records, "windowId", "left").select("windowId", F.when(F.col("root").isNull(), "JANELA_NAO_SELADA").otherwise("SEALED").alias("outcome"), "root", "checkpointHash")


def health(spark: SparkSession, d: str) -> DataFrame:
    """What the proof service says of itself; the identity of the store is new each time."""
    return lasting(spark, d).health().drop("storeId")


def ledger_restored(spark: SparkSession, d: str) -> DataFrame:
    """A ledger taken up again after a stop: findings of its audit (none), checkpoints, and
    those that it had still to seal (none)."""
    ledger = lasting(spark, d)
    found, more = ledger.audit().count(), Ledger(spark, ledger.store.root).restore().count()
    return ledger.records().groupBy().agg(F.count(F.lit(1)).alias("checkpoints"), F.lit(found).cast("bigint").alias("findings"), F.lit(more).cast("bigint").alias("sealed_now"))


def chain_totals(spark: SparkSession, d: str) -> DataFrame:
    """Checkpoints, and leaves over all of them."""
    return sealed_chain(spark, d).groupBy().agg(F.count(F.lit(1)).alias("checkpoints"), F.sum("leafCount").alias("leaves"))


def seal_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Windows whose recorded leaves are fewer than the marker says: what was lost on the way."""
    return seal_status(spark, d).where("status = 'INCOMPLETE'").select("windowId", (F.col("expected") - F.col("leaves")).alias("missing"))


def tally_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Keys per dimension, and how many of them break a rule: a blank key, a negative count."""
    bad = F.col("key").isNull() | (F.trim("key") == "") | (F.col("count") < 0)
    return tally.tally(accepted(spark, d)).groupBy("dimension").agg(F.count(F.lit(1)).alias("keys"), F.count(F.when(bad, 1)).alias("broken"))


def chain_verify(spark: SparkSession, d: str) -> DataFrame:
    return chain.verify_chain(sealed_chain(spark, d))


def tampered(records: DataFrame, at: int = 3) -> DataFrame:
    """Records with the root of one checkpoint rewritten."""
    return records.withColumn("root", F.when(F.col("sequence") == at, F.sha2(F.encode("root", "UTF-8"), 256)).otherwise(F.col("root")))


def chain_tampered_break(spark: SparkSession, d: str) -> DataFrame:
    return chain.verify_chain(tampered(sealed_chain(spark, d)))


def inclusion_proofs(spark: SparkSession, d: str) -> DataFrame:
    """Every leaf's proof, the path as one text."""
    return trees.proofs(numbered(spark, d)).select("windowId", "receipt", "leafIndex", "treeSize", F.concat_ws(",", "path").alias("path"))


def checked_proofs(spark: SparkSession, d: str) -> DataFrame:
    leaves = numbered(spark, d)
    return proofs.check(trees.proofs(leaves).join(trees.roots(leaves).select("windowId", "root"), "windowId"))


def proof_verify(spark: SparkSession, d: str) -> DataFrame:
    return checked_proofs(spark, d).groupBy("windowId").agg(F.count(F.lit(1)).alias("proofs"), F.count(F.when(F.col("valid"), 1)).alias("valid"))


def proof_tampered(spark: SparkSession, d: str) -> DataFrame:
    """Proofs altered in five ways, and how many of each still pass: none."""
    p = checked_proofs(spark, d).drop("valid").where("treeSize > 1")
    flip = lambda c: F.concat(F.when(F.substring(c, 1, 1) == "0", "1").otherwise("0"), F.substring(c, 2, 63))
    kinds = {
        "leaf": {"receipt": flip("receipt")}, "root": {"root": flip("root")}, "index": {"leafIndex": F.col("treeSize") + F.col("leafIndex")},
        "short": {"path": F.slice("path", 1, F.size("path") - 1)}, "long": {"path": F.concat("path", F.array("root"))},
    }
    variants = F.array(*(F.struct(F.lit(k).alias("kind"), *(v.get(c, F.col(c)).alias(c) for c in ("receipt", "leafIndex", "treeSize", "path", "root"))) for k, v in kinds.items()))
    flat = p.select(F.explode(variants).alias("v")).select("v.*")
    return proofs.check(flat).groupBy("kind").agg(F.count(F.lit(1)).alias("proofs"), F.count(F.when(F.col("valid"), 1)).alias("accepted"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Receipts to ask for: those of every vote whose number ends in 0."""
    return votes(spark, d).where("arrival_seq % 10 = 0 and receipt is not null").select("receipt")


def receipt_lookup(spark: SparkSession, d: str) -> DataFrame:
    t = timed(spark, d)
    leaves, records = sealed(spark, d, t)
    found = proofs.lookup(_asked(spark, d), leaves, records, t.where("reason is not null"))
    return found.select("receipt", "windowId", "leafIndex", "treeSize", "outcome", "cause")


def receipt_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on asked receipts against a chain whose checkpoint 40 was rewritten."""
    leaves, records = sealed(spark, d)
    checked = proofs.check(proofs.proof_responses(_asked(spark, d), leaves, records)).select("receipt", "sequence", "valid")
    want = _asked(spark, d).select(F.lower("receipt").alias("receipt")).distinct()
    all_asked = want.join(checked, "receipt", "left")
    return proofs.verdicts(all_asked, chain.check_links(tampered(records, 40))).groupBy("verdict").agg(F.count(F.lit(1)).alias("receipts"))


def ledger_audit(spark: SparkSession, d: str) -> DataFrame:
    """Findings when one root of the records was rewritten and one leaf exchanged."""
    leaves, records = sealed(spark, d)
    leaves = leaves.select("windowId", "receipt")
    first = leaves.groupBy("windowId").agg(F.min("receipt").alias("_first"))
    forged = leaves.join(first, "windowId").withColumn("receipt", F.when((F.col("receipt") == F.col("_first")) & (F.col("windowId") == "2031-03-02T09:10:00Z"), F.sha2(F.encode("receipt", "UTF-8"), 256)).otherwise(F.col("receipt"))).drop("_first")
    return chain.audit(trees.numbered(forged), tampered(records)).where("finding <> 'CHAIN'")


def ingest_errors(spark: SparkSession, d: str) -> DataFrame:
    """Votes sent again as requests to an edge whose clock stands still."""
    now = F.lit(CLOCK).cast("timestamp")
    cast = ingest.cast_votes(votes(spark, d).select("electionId", "voterId", "candidateId", "partyId", "state", "city"), ELECTION, SHORT, sha256_policy(PEPPER), now)
    return cast.groupBy(F.coalesce("error", F.lit("-")).alias("error"), "status").agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("receipt").alias("receipts"))


def candidate_parties(spark: SparkSession, d: str) -> DataFrame:
    """Candidates whose party is in no list of parties."""
    c, p = table(spark, d, "candidatos", "numero", "nome", "partido"), table(spark, d, "partidos", "sigla")
    return c.join(p, c["partido"] == p["sigla"], "left_anti").orderBy(F.col("numero").cast("int"))


def feeder_distribution(spark: SparkSession, d: str) -> DataFrame:
    """As many ballots of the generator as there are votes, per candidate. Both lists are small
    fixed tables."""
    people = few_rows(table(spark, d, "candidatos", "numero", "partido").groupBy("numero").agg(F.min("partido").alias("partido")).orderBy("numero"), 10_000, "candidates")
    places = few_rows(table(spark, d, "municipios", "mun_code", "uf", "municipio", "peso").where("peso > 0").orderBy("uf", "municipio", "mun_code").drop("mun_code"), 100_000, "places")
    b = generator.ballots(spark, votes(spark, d).count(), [(r[0], r[1]) for r in people], [(r[0], r[1], r[2]) for r in places])
    return b.groupBy("candidateId").agg(F.count(F.lit(1)).alias("ballots"), F.count(F.when(F.col("duplicate"), 1)).alias("repeats"), F.count_distinct("state").alias("states"))


QUERIES = {f.__name__: f for f in (
    normalize_votes, issue_receipts, schedule_status, admission_decisions, accepted_votes, rejected_votes, rejections_by_reason,
    tally_all_dimensions, tally_grouping_sets, tally_changelog_candidate, tally_latest_compacted, tally_reconciliation, distinct_voters,
    votes_from_orders_tally, leaderboard_topk, control_events, timeline_union, window_markers, late_votes, window_leaf_counts, seal_status,
    merkle_leaf_hashes, merkle_roots, merkle_levels, chain_verify, chain_tampered_break, inclusion_proofs, proof_verify, proof_tampered,
    receipt_lookup, receipt_verdict, ledger_audit, roots, root_lookup, health, ledger_restored, chain_totals, seal_gaps, tally_invariants,
    ingest_errors, candidate_parties, feeder_distribution,
)}
QUERIES |= {f"tally_{k.lower()}": _one_tally(k) for k in tally.DIMENSIONS} | {"chain": sealed_chain}
