"""Merkle trees over the leaves of each window, of any size, in parallel.

Leaves are numbered in canonical order (by receipt) without sorting a window in one
task, and hashed in aligned blocks of BLOCK leaves. An aligned block is a subtree, so
block roots are the leaves of a smaller tree of the same rule; further rounds follow
until no window has more than one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyweave.functions import merkle
from tallyweave.functions.text import is_receipt

BLOCK = 4096


def leaf_set(accepted: DataFrame) -> DataFrame:
    """Different (windowId, receipt) pairs that can be leaves: lower-cased receipts of
    32 bytes with a window."""
    r = F.lower("receipt")
    return accepted.where(is_receipt(r) & F.coalesce(F.col("windowId") != "", F.lit(False))).select("windowId", r.alias("receipt")).distinct()


def numbered(leaves: DataFrame) -> DataFrame:
    """Add ``leafIndex`` (rank of the receipt in its window) and ``treeSize``. Receipts
    are digests, so their first digits spread a large window evenly over tasks."""
    cut = leaves.withColumn("_b", F.substring("receipt", 1, 3))
    sums = cut.groupBy("windowId", "_b").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy("windowId").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("windowId", "_b", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy("windowId")).alias("treeSize"))
    within = Window.partitionBy("windowId", "_b").orderBy("receipt")
    return cut.join(starts, ["windowId", "_b"]).select("windowId", "receipt", (F.row_number().over(within) - 1 + F.col("_start")).alias("leafIndex"), "treeSize")


def _blocks(nodes: DataFrame, with_levels: bool) -> DataFrame:
    """Nodes (windowId, pos, hash) to one row per aligned block."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"])
    grouped = nodes.groupBy("windowId", F.floor(F.col("pos") / BLOCK).alias("block")).agg(ordered.alias("hashes"))
    value: Column = merkle.levels(F.col("hashes")) if with_levels else F.array(F.array(merkle.root_of(F.col("hashes"))))
    return grouped.select("windowId", "block", value.alias("levels"))


def rounds(leaves: DataFrame, with_levels: bool = True) -> list[DataFrame]:
    """Block tables (windowId, block, levels) from the leaves upwards; the last has one
    block per window. ``leaves`` is numbered. Each round divides the number of nodes by
    BLOCK, so there are two for up to 16 million leaves in a window."""
    most = leaves.agg(F.max("treeSize")).first()[0] or 0
    nodes = leaves.select("windowId", F.col("leafIndex").alias("pos"), merkle.leaf_hash(F.col("receipt")).alias("hash"))
    out = []
    while True:
        out.append(_blocks(nodes, with_levels))
        if most <= BLOCK:
            return out
        most = -(-most // BLOCK)
        nodes = out[-1].select("windowId", F.col("block").alias("pos"), F.element_at(F.element_at("levels", -1), 1).alias("hash"))


def roots(leaves: DataFrame) -> DataFrame:
    """windowId, leafCount and root; ``leaves`` is numbered."""
    top = rounds(leaves, False)[-1].select("windowId", F.element_at(F.element_at("levels", -1), 1).alias("root"))
    sizes = leaves.groupBy("windowId").agg(F.max("treeSize").alias("leafCount"))
    return sizes.join(top, "windowId")


def tree_levels(leaves: DataFrame) -> DataFrame:
    """Every node as a row: windowId, level, pos, hash. A round of a window that has
    more rounds to come gives the levels below its block roots, in which the node of a
    block that is not full rises unchanged; the next round begins with those roots."""
    width, out, done = BLOCK.bit_length() - 1, None, None
    for i, blocks in enumerate(rounds(leaves)):
        if done is not None:
            blocks = blocks.join(done, "windowId", "left_anti")
        single = blocks.groupBy("windowId").agg((F.max("block") == 0).alias("_last"))
        ended = single.where("_last").select("windowId")
        done = ended if done is None else done.unionByName(ended)
        filled = F.slice(F.concat("levels", F.array_repeat(F.element_at("levels", -1), width)), 1, width)
        rows = blocks.join(single, "windowId").select("windowId", "block", F.when(F.col("_last"), F.col("levels")).otherwise(filled).alias("levels"))
        rows = rows.select("windowId", "block", F.posexplode("levels").alias("level", "row")).select("windowId", "block", "level", F.posexplode("row").alias("at", "hash"))
        start = F.floor(F.col("block") * F.pow(F.lit(2.0), F.lit(width) - F.col("level"))).cast("bigint")
        part = rows.select("windowId", (F.col("level") + i * width).cast("int").alias("level"), (start + F.col("at")).alias("pos"), "hash")
        out = part if out is None else out.unionByName(part)
    return out


def proofs(leaves: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Inclusion proofs: windowId, receipt, leafIndex, treeSize, path. ``wanted`` (with a
    receipt column, any letter case) restricts them; without it every leaf has one."""
    asked = leaves
    if wanted is not None:
        asked = leaves.join(wanted.select(F.lower("receipt").alias("receipt")).where("receipt is not null").distinct(), "receipt", "left_semi")
    out = asked.select("windowId", "receipt", "leafIndex", "treeSize", F.col("leafIndex").alias("_at"), F.array().cast("array<string>").alias("path"))
    for blocks in rounds(leaves):
        if wanted is not None:
            there = out.select("windowId", F.floor(F.col("_at") / BLOCK).alias("block")).distinct()
            blocks = blocks.join(there, ["windowId", "block"], "left_semi")
        # All paths of a block in one expression: a leaf is never joined to a whole block.
        every = F.transform(F.sequence(F.lit(0), F.size(F.element_at("levels", 1)) - 1), lambda i: merkle.siblings(F.col("levels"), i))
        paths = blocks.select("windowId", "block", F.posexplode(every).alias("_pos", "_part")).select("windowId", (F.col("block") * BLOCK + F.col("_pos")).alias("_at"), "_part")
        out = out.join(paths, ["windowId", "_at"])
        out = out.select("windowId", "receipt", "leafIndex", "treeSize", F.floor(F.col("_at") / BLOCK).alias("_up"), F.concat("path", "_part").alias("path")).withColumnRenamed("_up", "_at")
    return out.drop("_at")
