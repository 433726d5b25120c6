import pytest
from helpers import rows
from pyspark.sql import functions as F

from tallyweave.operators import chain
from tallyweave.operators.ledger import BrokenLedger, Ledger

W = [f"2026-01-01T0{i}:00:00Z" for i in range(6)]


def leaves(spark, *pairs):
    return spark.createDataFrame([(W[w], f"{i:064x}") for w, i in pairs], "windowId string, receipt string")


def marks(spark, *pairs):
    return spark.createDataFrame([(W[w] if isinstance(w, int) else w, n) for w, n in pairs], "windowId string, count bigint")


def test_steps_and_restarts_give_one_chain(spark, tmp_path):
    """Steps in any cut, each by a new object on the folder, give the chain of all at once."""
    root = f"file://{tmp_path}/l"
    every = leaves(spark, (0, 1), (0, 2), (1, 3), (2, 4), (2, 5), (2, 6), (4, 9))
    want = chain.seal(every, marks(spark, (0, 2), (1, 1), (2, 3)))[2]
    one = Ledger(spark, root)
    name = one.meta()["store_id"]
    # The second window is complete before the first is: nothing is sealed.
    step = one.apply(leaves(spark, (0, 1), (1, 3)), marks(spark, (1, 1), (0, 2)))
    assert step.sealed.count() == 0 and one.health().first()["pendingWindows"] == 2
    step = Ledger(spark, root).apply(leaves(spark, (0, 2), (0, 1), (2, 4), (2, 5)))
    assert rows(step.sealed, "windowId", "sequence") == [(W[0], 0), (W[1], 1)]
    step = Ledger(spark, root).apply(leaves(spark, (2, 6), (4, 9)), marks(spark, (2, 3), (0, 2), (1, 1)))
    assert step.refused.count() == 0
    two = Ledger(spark, root)
    assert rows(two.records().drop("sealedAt"), *want.columns) == rows(want, *want.columns) and two.records().where("sealedAt is null").count() == 0
    h = two.health().first()
    assert (h["status"], h["sealedCheckpoints"], h["pendingWindows"], h["headWindow"], h["storeId"]) == ("UP", 3, 1, W[2], name)
    # Roots are published once each; one that died after sending sends again.
    sent = []
    assert two.publish(lambda f: sent.extend(r["sequence"] for r in f.collect())) == 2 and two.publish(lambda f: sent.append(None)) == 2 and sorted(sent) == [0, 1, 2]
    assert two.restore().count() == 0 and two.audit().count() == 0
    assert Ledger(spark, f"file://{tmp_path}/other").meta()["store_id"] != name


def test_what_is_refused(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    ledger.apply(leaves(spark, (0, 1)), marks(spark, (0, 1), (1, 2)))
    step = ledger.apply(leaves(spark, (0, 1), (0, 7)), marks(spark, (0, 1), (0, 5), (1, 3), (None, 4), ("", 1), (2, -1), (2, None)))
    got = {(r["windowId"], r["receipt"] and int(r["receipt"], 16), r["count"], r["reason"]) for r in step.refused.collect()}
    assert got == {(W[0], 7, None, "SEALED_WITHOUT_IT"), (W[0], None, 5, "CONFLICT"), (W[1], None, 3, "CONFLICT"), (None, None, 4, "INVALID"), ("", None, 1, "INVALID"), (W[2], None, -1, "INVALID"), (W[2], None, None, "INVALID")}
    assert ledger.refused().count() == 7 and ledger.leaves().count() == 1
    # More leaves than the marker says: the window and all behind it wait; an empty window seals.
    step = ledger.apply(leaves(spark, (1, 2), (1, 3), (1, 4)), marks(spark, (3, 0)))
    assert step.sealed.count() == 0 and ledger.records().count() == 1


def test_restore_seals_what_was_complete_and_refuses_forgeries(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/l")
    ledger.apply(leaves(spark, (0, 1), (0, 2)), marks(spark, (0, 2), (3, 0)))
    store = ledger.store

    def put(table, frame, instead=()):
        state = store.state()
        store.write(state, table, frame.withColumn("part", ledger._part()), store.generation(), instead_of=instead)
        state["meta"]["waiting"] = sorted({*state["meta"]["waiting"], *store.parts(state, "markers")})
        store.commit(state)

    # Leaves and marker were written, the seal was not.
    put("leaves", leaves(spark, (4, 8)))
    put("markers", marks(spark, (4, 1)))
    assert rows(ledger.restore(), "windowId", "sequence") == [(W[4], 2)] and ledger.restore().count() == 0
    part = lambda w: [r[0] for r in leaves(spark, (w, 1)).select(ledger._part()).collect()]
    put("leaves", leaves(spark, (0, 1), (0, 99)), part(0))  # an exchanged leaf
    assert rows(ledger.audit()) == [(W[0], "ROOT")]
    with pytest.raises(BrokenLedger):
        ledger.restore()
    put("leaves", leaves(spark, (0, 1)), part(0))
    assert rows(ledger.audit()) == [(W[0], "LEAF_COUNT")]
    put("leaves", leaves(spark, (0, 1), (0, 2)), part(0))
    assert ledger.audit().count() == 0
    seals = ledger.records().where(F.col("windowId") == W[4])
    put("seals", seals.withColumn("sequence", F.lit(5)), part(4))  # a seal out of order
    assert rows(ledger.audit()) == [(W[4], "SEQUENCE")]
