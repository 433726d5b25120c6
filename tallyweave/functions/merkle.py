"""Hashes of RFC 6962 trees as column expressions; digests are lower-case hex."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the formats.
LEAF, NODE, LINK = "00", "01", "02"
EMPTY_ROOT = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
GENESIS = "0" * 64


def _bytes(hex_text: str) -> Column:
    return F.unhex(F.lit(hex_text))


def leaf_hash(receipt: Column) -> Column:
    """SHA-256(00 || the decoded receipt)."""
    return F.sha2(F.concat(_bytes(LEAF), F.unhex(receipt)), 256)


def node_hash(left: Column, right: Column) -> Column:
    """SHA-256(01 || left || right)."""
    return F.sha2(F.concat(_bytes(NODE), F.unhex(left), F.unhex(right)), 256)


def link_hash(previous: Column, root: Column, batch: Column, leaves: Column) -> Column:
    """SHA-256(02 || previous || root || batch id | leaf count)."""
    return F.sha2(F.concat(_bytes(LINK), F.unhex(previous), F.unhex(root), F.encode(F.concat(batch, F.lit("|"), leaves.cast("string")), "UTF-8")), 256)


def parents(level: Column) -> Column:
    """The next level up; an odd last node moves up unchanged."""
    def pair(i: Column) -> Column:
        left, right = F.get(level, i * 2), F.get(level, i * 2 + 1)
        return F.when(right.isNull(), left).otherwise(node_hash(left, right))

    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(level) / 2).cast("int") - 1), pair)


def height(leaves: Column) -> Column:
    """Levels above the leaves: ceil(log2(n)), exactly."""
    return F.when(leaves <= 1, 0).otherwise(F.length(F.regexp_replace(F.bin((leaves - 1).cast("bigint")), "^0+", "")))


def levels(hashes: Column) -> Column:
    """All levels of the tree over a non-empty array of hashes, leaves first."""
    steps = F.sequence(F.lit(1), F.greatest(height(F.size(hashes)), F.lit(1)))
    grow = lambda acc, _: F.when(F.size(F.element_at(acc, -1)) == 1, acc).otherwise(F.concat(acc, F.array(parents(F.element_at(acc, -1)))))
    return F.aggregate(steps, F.array(hashes), grow)


def root_of(hashes: Column) -> Column:
    """Root over an array of leaf hashes; that of the empty tree for none."""
    steps = F.sequence(F.lit(1), F.greatest(height(F.size(hashes)), F.lit(1)))
    top = F.aggregate(steps, hashes, lambda acc, _: F.when(F.size(acc) == 1, acc).otherwise(parents(acc)))
    return F.when(F.size(hashes) == 0, F.lit(EMPTY_ROOT)).otherwise(F.element_at(top, 1))


def siblings(all_levels: Column, index: Column) -> Column:
    """Path of a leaf, bottom up; a level in which the node has no sibling adds nothing."""
    def at(level: Column, k: Column) -> Column:
        i = F.floor(index / F.pow(F.lit(2.0), k)).cast("int")
        return F.get(level, i + 1 - 2 * (i % 2))

    below = F.slice(all_levels, 1, F.greatest(F.size(all_levels) - 1, F.lit(0)))
    return F.filter(F.transform(below, at), lambda h: h.isNotNull())


def verify(receipt: Column, index: Column, size: Column, path: Column, root: Column) -> Column:
    """Whether a path proves that the leaf stands at ``index`` of a tree of ``size``
    leaves with this root. Paths that are too long or too short, siblings that are not
    32 bytes, and indices outside the tree fail; nulls fail too."""
    start = F.struct(index.cast("bigint").alias("fn"), (size - 1).cast("bigint").alias("sn"), leaf_hash(receipt).alias("h"), ((index >= 0) & (index < size)).alias("ok"))

    def step(acc: Column, sibling: Column) -> Column:
        fn, sn, h = acc["fn"], acc["sn"], acc["h"]
        right = (fn % 2 == 1) | (fn == sn)
        # A node that is last in its level rises until it has a left sibling.
        rise = F.when((fn % 2 == 0) & (fn > 0) & (fn == sn), F.length(F.regexp_extract(F.bin(fn), "0*$", 0))).otherwise(0)
        whole = F.coalesce(sibling.rlike(r"^[0-9a-f]{64}\z"), F.lit(False))
        halves = lambda x: F.floor(x / F.pow(F.lit(2.0), rise + 1)).cast("bigint")
        return F.struct(
            halves(fn).alias("fn"), halves(sn).alias("sn"),
            F.when(right, node_hash(sibling, h)).otherwise(node_hash(h, sibling)).alias("h"),
            (acc["ok"] & (sn > 0) & whole).alias("ok"),
        )

    end = F.aggregate(path, start, step)
    return F.coalesce(end["ok"] & (end["sn"] == 0) & (end["h"] == root), F.lit(False))
