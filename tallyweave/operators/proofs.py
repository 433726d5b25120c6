"""Answers to those who hold a receipt: proof, window, verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyweave.functions import merkle
from tallyweave.functions.text import is_receipt
from tallyweave.operators import trees
from tallyweave.session import broadcast_if_small

RULE = "RFC 6962: leaf = SHA-256(0x00 || receipt), node = SHA-256(0x01 || left || right)"


def lookup(asked: DataFrame, leaves: DataFrame, records: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """One row per asked receipt: its checkpoint and ``outcome``: SEALED, or NOT_FOUND with
    the cause in ``cause``: MALFORMED, OPEN_WINDOW (accepted, not sealed yet), REJECTED, UNKNOWN."""
    want = asked.select(F.lower("receipt").alias("receipt")).distinct()
    at = leaves.join(broadcast_if_small(want.where("receipt is not null")), "receipt", "left_semi").select("receipt", "windowId", "leafIndex", "treeSize")
    found = want.join(at, "receipt", "left").join(records.select("windowId", "sequence", "root", "previousHash", "checkpointHash"), "windowId", "left")
    no = F.lit(False)
    if rejected is not None:
        refused = rejected.select(F.lower("receipt").alias("receipt"), F.lit(True).alias("_refused")).where("receipt is not null").distinct()
        found = found.join(refused, "receipt", "left")
        no = F.coalesce("_refused", F.lit(False))
    sealed = F.col("checkpointHash").isNotNull()
    cause = F.when(~sealed, F.when(~is_receipt("receipt"), "MALFORMED").when(F.col("windowId").isNotNull(), "OPEN_WINDOW").when(no, "REJECTED").otherwise("UNKNOWN"))
    return found.select("receipt", "windowId", "leafIndex", "treeSize", "sequence", "root", "previousHash", "checkpointHash", F.when(sealed, "SEALED").otherwise("NOT_FOUND").alias("outcome"), cause.alias("cause"))


def proof_responses(asked: DataFrame, leaves: DataFrame, records: DataFrame) -> DataFrame:
    """What the proof service answers for the receipts that are sealed."""
    paths = trees.proofs(leaves, asked)
    when = F.col("sealedAt") if "sealedAt" in records.columns else F.lit(None).cast("timestamp")
    kept = records.select("windowId", "sequence", "root", "previousHash", "checkpointHash", when.alias("sealedAt"))
    return paths.join(kept, "windowId").select("receipt", "windowId", "sequence", "leafIndex", "treeSize", "root", "previousHash", "checkpointHash", "sealedAt", "path", F.lit(RULE).alias("verification"))


def check(proofs: DataFrame) -> DataFrame:
    """Add ``valid``: the path leads from the receipt to the root."""
    return proofs.withColumn("valid", merkle.verify(F.col("receipt"), F.col("leafIndex"), F.col("treeSize"), F.col("path"), F.col("root")))


def verdicts(checked: DataFrame, links: DataFrame) -> DataFrame:
    """INCLUDED (proof and chain up to its window hold), INCONSISTENT, or UNDETERMINED
    where the receipt has no proof. ``checked`` has receipt, sequence and valid (null: no
    proof); ``links`` comes from chain.check_links."""
    broken = links.where(~(F.col("linked") & F.col("hashed"))).agg(F.min("sequence")).first()[0]
    holds = F.col("valid") & (F.lit(True) if broken is None else F.col("sequence") < broken)
    return checked.select("receipt", F.when(F.col("valid").isNull(), "UNDETERMINED").when(holds, "INCLUDED").otherwise("INCONSISTENT").alias("verdict"))


def health(leaves: DataFrame, records: DataFrame, status: DataFrame) -> DataFrame:
    """One row: checkpoints, leaves sealed, windows that wait, and the head of the chain. A
    lasting ledger has its own, with its identity."""
    head = records.groupBy().agg(F.count(F.lit(1)).alias("checkpoints"), F.sum("leafCount").alias("sealedLeaves"), F.max_by("checkpointHash", "sequence").alias("head"), F.max_by("windowId", "sequence").alias("headWindow"))
    waiting = status.where("not sealable").groupBy().agg(F.count(F.lit(1)).alias("pendingWindows"))
    known = leaves.groupBy().agg(F.count(F.lit(1)).alias("leaves"))
    rows = head.unionByName(waiting, allowMissingColumns=True).unionByName(known, allowMissingColumns=True)
    one = rows.groupBy().agg(*(F.max(c).alias(c) for c in rows.columns))
    return one.select("checkpoints", F.coalesce("sealedLeaves", F.lit(0)).alias("sealedLeaves"), "leaves", "pendingWindows", F.coalesce("head", F.lit(merkle.GENESIS)).alias("head"), "headWindow")


def roots(records: DataFrame) -> DataFrame:
    """All checkpoints, in order."""
    return records.orderBy("sequence")


def root(records: DataFrame, window_id: str) -> DataFrame:
    """The checkpoint of one window; no row if it is not sealed."""
    return records.where(F.col("windowId") == window_id)
