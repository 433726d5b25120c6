import hashlib

from helpers import rows
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tallyweave.functions import merkle
from tallyweave.operators import chain, proofs, trees

# Golden values: (window, leaves, root, checkpoint).
GOLDEN = [
    ("2026-01-01T00:00:00Z/15s", 1, "7f9c9e31ac8256ca2f258583df262dbc7d6f68f2a03043d5c99a4ae5a7396ce9", "59b6d0052d7bc423a9e48106ec0fcde18027a00d0456750e000dab455eba2b24"),
    ("2026-01-01T00:01:00Z/15s", 2, "0ce81b149370f4ead3ca3322dd40a9df4bc11c8af3deae293ef67bfb7e6bc026", "cd6a9fee8dc7878104e5aa5d00afbc219851456ab36417852f6ca8bc7db8b13c"),
    ("2026-01-01T00:02:00Z/15s", 3, "879dd3d48bc3bf2e8bea7e965cf5b5f343e03194c940a72b6dee2f6d54d36bf3", "655942d35f326e9d12d8010e8df35640fb152db41dd6a0ecd7b9c797b7d6c7aa"),
    ("2026-01-01T00:03:00Z/15s", 7, "ffdf1248654780d18e34e2c9c8efa00527829a758f1f41eb2676cfa70bad22d6", "1adc6dd8041b471caf663802f2d726d273519368f5181dd4f2a7570497f280bb"),
    ("2026-01-01T00:04:00Z/15s", 12, "ea60da19823475e1ee089f5689f7a6e6c05869617480c71b371bbcf31c03a64f", "5bd8bdbc30d9e4765b53e322a3158bfe8539354cafd1f55c02286a7ed25eccfc"),
]


def leaves(spark, sizes=None):
    data = [(w, f"{i * 1000 + j:064x}") for i, (w, n, *_) in enumerate(GOLDEN if sizes is None else sizes) for j in range(n)]
    return spark.createDataFrame(data, "windowId string, receipt string")


def marks(spark, pairs):
    return spark.createDataFrame(pairs, "windowId string, count bigint")


def plain_root(hashes):
    while len(hashes) > 1:
        hashes = [hashlib.sha256(b"\x01" + hashes[i] + hashes[i + 1]).digest() if i + 1 < len(hashes) else hashes[i] for i in range(0, len(hashes), 2)]
    return hashes[0] if hashes else hashlib.sha256(b"").digest()


def leaf(r):
    return hashlib.sha256(b"\x00" + bytes.fromhex(r)).digest()


def test_golden_chain(spark):
    _, status, got = chain.seal(leaves(spark), marks(spark, [(w, n) for w, n, *_ in GOLDEN]))
    assert rows(got, "sequence", "windowId", "leafCount", "root", "checkpointHash") == [(i, *g) for i, g in enumerate(GOLDEN)]
    assert got.where("sequence = 0").first()["previousHash"] == "0" * 64
    assert chain.verify_chain(got).first().asDict() == {"ok": True, "checkpoints": 5, "firstBroken": None}
    assert status.where("not sealable").count() == 0


def test_tampered_chains(spark):
    got = chain.seal(leaves(spark), marks(spark, [(w, n) for w, n, *_ in GOLDEN]))[2]
    one = lambda c, v: got.withColumn(c, F.when(F.col("sequence") == 1, v).otherwise(F.col(c)))
    for bad, first in ((one("root", F.lit("ab" * 32)), 1), (one("leafCount", F.lit(9)), 1), (one("windowId", F.lit("x")), 1), (got.where("sequence <> 2"), 3)):
        r = chain.verify_chain(bad).first()
        assert not r["ok"] and r["firstBroken"] == first
    assert not chain.verify_chain(got.where("sequence > 0")).first()["ok"]
    assert chain.verify_chain(got.limit(0)).first()["ok"]


def test_all_sizes_and_every_proof(spark, monkeypatch):
    monkeypatch.setattr(trees, "BLOCK", 8)  # several rounds on small trees
    sizes = [(f"w{n:02d}", n) for n in range(1, 65)]
    numbered = trees.numbered(leaves(spark, sizes)).cache()
    roots = trees.roots(numbered)
    got = {r["windowId"]: r["root"] for r in roots.collect()}
    for i, (w, n) in enumerate(sizes):
        assert got[w] == plain_root([leaf(f"{i * 1000 + j:064x}") for j in range(n)]).hex()
    checked = proofs.check(trees.proofs(numbered).join(roots.select("windowId", "root"), "windowId"))
    assert checked.count() == sum(n for _, n in sizes) and checked.where("not valid").count() == 0
    nodes = trees.tree_levels(numbered).groupBy("windowId").agg(F.count("*").alias("n"), F.countDistinct("level", "pos").alias("d"), F.max("level").alias("h"))
    for r in nodes.collect():
        n, total = int(r["windowId"][1:]), 0
        while n > 1:
            total, n = total + n, -(-n // 2)
        assert r["n"] == r["d"] == total + 1


def test_altered_proofs_fail(spark):
    numbered = trees.numbered(leaves(spark))
    p = trees.proofs(numbered).join(trees.roots(numbered).select("windowId", "root"), "windowId").where("treeSize = 7")
    valid = lambda df: proofs.check(df).where("valid").count()
    assert valid(p) == 7
    for change in (
        {"receipt": F.lit("f" * 64)}, {"root": F.lit(GOLDEN[0][2])}, {"path": F.concat("path", F.array(F.lit("0" * 64)))}, {"path": F.slice("path", 1, F.size("path") - 1)},
        {"leafIndex": F.lit(-1)}, {"leafIndex": F.lit(7)}, {"leafIndex": F.lit(99)}, {"leafIndex": (F.col("leafIndex") + 1) % 7}, {"path": F.transform("path", lambda s: F.substring(s, 1, 62))}, {"path": F.lit(None).cast("array<string>")},
    ):
        assert valid(p.withColumns(change)) == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(order=st.permutations(range(12)), seed=st.integers(0, 3))
def test_root_does_not_depend_on_order_or_repeats(spark, order, seed):
    data = [("w", f"{i:064x}") for i in [*order, *order[: seed]]]
    df = spark.createDataFrame(data, "windowId string, receipt string")
    got = trees.roots(trees.numbered(trees.leaf_set(df))).first()
    assert (got["leafCount"], got["root"]) == (12, plain_root([leaf(f"{i:064x}") for i in range(12)]).hex())


def test_sealing_waits_in_order(spark):
    def status(leaf_counts, markers):
        df = trees.leaf_set(leaves(spark, leaf_counts))
        return {r["windowId"]: (r["status"], r["sealable"]) for r in chain.seal_status(df, marks(spark, markers)).collect()}

    assert status([("j1", 1), ("j2", 2)], [("j1", 2), ("j2", 2)]) == {"j1": ("INCOMPLETE", False), "j2": ("COMPLETE", False)}
    assert status([("j1", 3)], [("j1", 2)])["j1"] == ("OVERFLOW", False)
    assert status([("j1", 2)], [("j1", 2), ("j1", 2)])["j1"] == ("COMPLETE", True)
    assert status([("j1", 2)], [("j1", 2), ("j1", 3)])["j1"] == ("CONFLICT", False)
    assert status([("j1", 2), ("j2", 1)], [("j2", 1), (None, 3), ("", 1), ("j3", -1)]) == {"j1": ("OPEN", False), "j2": ("COMPLETE", True)}


def test_empty_window_has_the_empty_tree(spark):
    got = chain.seal(leaves(spark, []), marks(spark, [("w", 0)]))[2].first()
    assert (got["leafCount"], got["root"]) == (0, merkle.EMPTY_ROOT)
    assert merkle.EMPTY_ROOT == hashlib.sha256(b"").hexdigest()
    df = spark.range(1).select(merkle.leaf_hash(F.lit("")).alias("h"))
    assert df.first()["h"] == "6e340b9cffb37a989ca544e6bb780a2c78901d3fb33738768511a30617afa01d"


def test_audit_and_answers(spark):
    numbered, _, records = chain.seal(leaves(spark), marks(spark, [(w, n) for w, n, *_ in GOLDEN[:4]]))
    assert chain.audit(numbered, records).count() == 0
    state = proofs.health(numbered, records, chain.seal_status(numbered, marks(spark, [(w, n) for w, n, *_ in GOLDEN[:4]]))).first()
    assert (state["checkpoints"], state["sealedLeaves"], state["leaves"], state["pendingWindows"], state["head"]) == (4, 13, 25, 1, GOLDEN[3][3])
    assert [r["sequence"] for r in proofs.roots(records).collect()] == [0, 1, 2, 3] and proofs.root(records, GOLDEN[2][0]).first()["root"] == GOLDEN[2][2]
    forged = numbered.withColumn("receipt", F.when(F.col("receipt") == f"{1001:064x}", "e" * 64).otherwise(F.col("receipt")))
    assert ("2026-01-01T00:01:00Z/15s", "ROOT") in rows(chain.audit(trees.numbered(forged.select("windowId", "receipt")), records))
    assert rows(chain.audit(numbered.where(F.col("windowId") != GOLDEN[2][0]), records))[-1][1] in ("NO_LEAVES", "SEQUENCE")
    asked = spark.createDataFrame([(f"{3005:064x}".upper(),), (f"{4005:064x}",), ("nope",), ("d" * 64,), ("a" * 64,), (None,)], "receipt string")
    refused = spark.createDataFrame([("d" * 64,)], "receipt string")
    got = {r["receipt"]: (r["outcome"], r["cause"]) for r in proofs.lookup(asked, numbered, records, refused).collect()}
    assert got == {f"{3005:064x}": ("SEALED", None), f"{4005:064x}": ("NOT_FOUND", "OPEN_WINDOW"), "nope": ("NOT_FOUND", "MALFORMED"), "d" * 64: ("NOT_FOUND", "REJECTED"), "a" * 64: ("NOT_FOUND", "UNKNOWN"), None: ("NOT_FOUND", "MALFORMED")}
    answer = proofs.proof_responses(asked, numbered, records)
    assert answer.count() == 1 and proofs.check(answer).first()["valid"]
    checked = proofs.check(answer).select("receipt", "sequence", "valid").unionByName(spark.createDataFrame([("a" * 64, None, None)], "receipt string, sequence int, valid boolean"))
    assert [r[1] for r in rows(proofs.verdicts(checked, chain.check_links(records)))] == ["INCLUDED", "UNDETERMINED"]
    broken = records.withColumn("root", F.when(F.col("sequence") == 2, "0" * 64).otherwise(F.col("root")))
    assert rows(proofs.verdicts(checked, chain.check_links(broken)))[0][1] == "INCONSISTENT"
