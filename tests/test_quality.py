import random

import pytest
from helpers import at, rows
from pyspark.sql import functions as F

from tallyweave.functions.text import message_key
from tallyweave.functions.windows import named_instant_ms, window_id, window_start_ms
from tallyweave.operators import hotkeys, late, ranking
from tallyweave.operators.late import Slicing
from tallyweave.operators.orphans import reference_status
from tallyweave.operators.redelivery import DeliveryStore


def ms(second):
    return round(at(second).timestamp() * 1000)


# -- text and windows -----------------------------------------------------------

def test_named_instants(spark):
    same = ["2031-03-02T09:00:00Z", " 2031-03-02t09:00:00z\t", "2031-03-02 09:00:00Z", "2031-03-02T09:00:00.000Z", "2031-03-02T06:00:00-03:00", "2031-03-02T09:00:00+00:00", "2031-03-02T09:00:00Z/15s", "20310302T090000Z", "2031/03/02T09:00Z"]
    none = [None, "", "NaN", "0", "janela-000212", "2031-02-30T09:00:00Z", "2031-03-02T25:00:00Z", "2031-03-02T09:00:00", "x2031-03-02T09:00:00Z"]
    df = spark.createDataFrame([(s,) for s in same + none], "s string")
    got = [r[0] for r in df.select(named_instant_ms("s")).collect()]
    assert set(got[: len(same)]) == {1930208400000} and got[len(same):] == [None] * len(none)


def test_window_alignment(spark):
    df = spark.createDataFrame([(ms(337.412), 60_000), (ms(359.999), 60_000), (ms(360), 60_000), (-30_000, 60_000), (1_250, 500)], "t bigint, size bigint")
    got = [r[0] for s in (60_000, 500) for r in df.where(F.col("size") == s).select(window_id(window_start_ms(F.col("t"), s))).collect()]
    assert got == ["2026-10-04T13:05:00Z", "2026-10-04T13:05:00Z", "2026-10-04T13:06:00Z", "1969-12-31T23:59:00Z", "1970-01-01T00:00:01Z"]
    with pytest.raises(ValueError):
        window_start_ms(F.col("t"), 0)


def test_message_keys(spark):
    df = spark.createDataFrame([("A" * 64, "v"), (" " + "a" * 64, "v\n"), ("a", "v"), ("A\t", " v"), (None, "v"), ("a", " "), ("", "v")], "r string, v string")
    k = [r[0] for r in df.select(message_key("r", "v")).collect()]
    assert k[0] == k[1] and k[2] == k[3] != k[0] and k[4:] == [None] * 3


# -- late events -----------------------------------------------------------------

def brute(events, s):
    """Counts per window and revision, straight from the definition."""
    out = {}
    for event, arrived in events:
        if event is None:
            continue
        first = (event // s.pane * s.pane) // s.step * s.step - (s.size - s.step)
        for i in range(s.size // s.step):
            w = first + i * s.step
            end = w + s.size
            rev = 0 if arrived is None or arrived < end + s.delay else (arrived - end - s.delay) // s.tick + 1
            if arrived is None or arrived < end + s.cutoff:
                out.setdefault(w, {}).setdefault(rev, 0)
                out[w][rev] += 1
    return sorted((w, rev, sum(n for r, n in by.items() if r <= rev)) for w, by in out.items() for rev in by)


@pytest.mark.parametrize("s", [Slicing(), Slicing(size=60_000, slide=15_000), Slicing(size=30_000, slide=10_000, delay=0, cutoff=20_000, tick=10_000)])
def test_panes_match_the_definition(spark, s):
    rng = random.Random(5)
    events = [(rng.randrange(0, 200_000), None) for _ in range(3)] + [(None, 5)]
    for _ in range(400):
        e = 45_000 if rng.random() < 0.33 else rng.randrange(-50_000, 200_000)
        events.append((e, e + rng.choice([0, 1, 4_999, 5_000, 20_000, 299_999, 300_000, 315_000, 400_000, rng.randrange(-9_000, 360_000)])))
    df = spark.createDataFrame(events, "e bigint, a bigint")
    got = late.compose(late.pane_log(late.to_panes(df, F.col("e"), F.col("a"), s)), s)
    assert [(w, r, n) for w, r, n in sorted(tuple(x) for x in got.select(F.unix_millis("window_start"), "revision", "n").collect())] == brute(events, s)
    assert late.compose(late.pane_log(late.to_panes(df.limit(0), F.col("e"), F.col("a"), s)), s).count() == 0


def test_lateness_bounds(spark):
    data = [(0, 19_999), (0, 20_000), (0, 314_999), (0, 315_000), (None, 1), (0, None), (14_999, 20_000), (15_000, 20_000)]
    df = late.to_panes(spark.createDataFrame(data, "e bigint, a bigint"), F.col("e"), F.col("a"), Slicing())
    assert [r[0] for r in df.select(late.lateness(Slicing())).collect()] == ["ON_TIME", "LATE", "LATE", "TOO_LATE", "NO_WINDOW", "ON_TIME", "LATE", "ON_TIME"]
    for bad in (dict(size=0), dict(size=10, slide=3), dict(tick=7_000), dict(cutoff=1)):
        with pytest.raises(ValueError):
            Slicing(**bad)


# -- hot keys ---------------------------------------------------------------------

def test_plan_spreads_the_load(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), "id")
    plan = hotkeys.make_plan(df, ("k",), 8)
    assert set(plan.hot) == {("hot",), (None,)} and all(len(set(t)) >= 2 for t in plan.hot.values())
    assert max(plan.loads) < 1.35 * sum(plan.loads) / 8
    sizes = [r["count"] for r in hotkeys.fragment(df, plan, ["id"]).groupBy("_task").count().collect()]
    assert sum(sizes) == 9000 and max(sizes) < 1.5 * 9000 / 8
    got = {r["k"]: (r["n"], r["ids"]) for r in hotkeys.balanced_counts(df, ("k",), ["id"], 8, ids=F.countDistinct("id")).collect()}
    want = {r["k"]: (r["n"], r["n"]) for r in df.groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert got == want
    # A matching side comes along with its keys, and only sums of rows need be moved.
    pre = hotkeys.combined(df, ("k",), ["id"], 8)
    assert pre.where("k = 'hot'").count() <= 8 * hotkeys.GROUPS_PER_TASK
    match = spark.createDataFrame([("hot", 7), ("k1", 8), (None, 9), ("zz", 1)], "k string, told int")
    met = hotkeys.balanced_counts(pre, ("k",), ["_salt"], 8, load=F.col("_rows"), match=match)
    assert {r["k"]: (r["load"], r["told"]) for r in met.collect()} == {k: (n, {"hot": 7, "k1": 8}.get(k)) for k, (n, _) in want.items()}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_is_a_join(spark, how):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 40).cast("int").alias("k"), "id")
    right = spark.createDataFrame([(7, "a"), (7, "b"), (3, "c"), (None, "d"), (99, "e")], "k int, name string")
    a, b = hotkeys.skew_join(left, right, ("k",), ["id"], 6, how), left.join(right, "k", how)
    assert sorted(a.columns) == sorted(b.columns) and rows(a, *sorted(a.columns)) == rows(b, *sorted(a.columns))
    assert hotkeys.skew_join(left.limit(0), right, ("k",), ["id"], 6, how).count() == 0


def test_skew_join_refuses_what_it_cannot_do(spark):
    df = spark.range(3).withColumn("x", F.lit(1))
    with pytest.raises(ValueError):
        hotkeys.skew_join(df, df, ("id",), ["id"], 2)
    with pytest.raises(ValueError):
        hotkeys.skew_join(df, df.drop("x"), ("id",), ["id"], 2, "full")


def test_weights_may_be_null_or_negative(spark):
    df = spark.createDataFrame([("a", 100), ("b", None), ("c", -5), ("d", 1)], "k string, w int")
    got = {r["k"]: (r["n"], r["load"]) for r in hotkeys.balanced_counts(df, ("k",), ["k"], 2, load=F.col("w")).collect()}
    assert got == {"a": (1, 100), "b": (1, None), "c": (1, -5), "d": (1, 1)}


# -- orphans -----------------------------------------------------------------------

REF = "tbl string, field string, key string, at_ms bigint, arrival_seq bigint"
PARENT = "field string, key string, from_ms bigint, to_ms bigint, withdrawn boolean"


def statuses(spark, refs, parents, tasks=3):
    df = reference_status(spark.createDataFrame([("t", "f", k, t, i) for i, (k, t) in enumerate(refs)], REF).withColumn("note", F.lit("n")), spark.createDataFrame([("f", *p) for p in parents], PARENT), tasks)
    return [r["status"] for r in df.orderBy("arrival_seq").collect()]


def test_reference_status(spark):
    parents = [("a", 10, 20, False), ("a", 30, None, False), ("b", None, None, False), ("gone", 0, None, True), ("c", 5, 9, False), ("c", 7, 15, False), (None, 0, None, False), ("a", 10, 20, False)]
    refs = [("a", 9), ("a", 10), ("a", 19), ("a", 20), ("a", 30), ("a", None), ("b", -5), ("gone", 3), ("x", 3), (None, 3), ("c", 10), ("c", 15), ("gone", None), ("x", None), ("a", 10)]
    want = ["LATE", "OK", "OK", "DELETED", "OK", "OK", "OK", "DELETED", "MISSING", "MISSING", "OK", "DELETED", "DELETED", "MISSING", "OK"]
    assert statuses(spark, refs, parents) == want
    assert statuses(spark, [("a", 1)], []) == ["MISSING"]
    assert statuses(spark, [], parents) == []


def test_hot_reference(spark):
    rng = random.Random(3)
    refs = [("hot" if i % 3 else f"k{i}", rng.randrange(100)) for i in range(600)]
    parents = [("hot", 20, 40, False), ("hot", 60, None, False), ("k3", 0, 50, False)]
    want = ["LATE" if t < 20 else "OK" if t < 40 or t >= 60 else "DELETED" if t < 60 else "OK" for k, t in refs if k == "hot"]
    got = statuses(spark, refs, parents, 5)
    assert [s for s, (k, _) in zip(got, refs) if k == "hot"] == want
    assert all(s == "MISSING" for s, (k, _) in zip(got, refs) if k not in ("hot", "k3"))


# -- one-copy store ------------------------------------------------------------------

DELIVERY = "tbl string, receipt string, voter string, _seq bigint, part int, body string"


def batch(spark, data):
    df = spark.createDataFrame(data, DELIVERY)
    return df.select("tbl", message_key("receipt", "voter").alias("_key"), "_seq", "part", "body")


def test_store_keeps_one_copy_whatever_the_batches(spark, tmp_path):
    rng = random.Random(11)
    data = [("t", "hot" if i % 3 == 0 else f"r{rng.randrange(40)}" if i % 7 else None, "v", i, i // 30, f"b{i}") for i in range(1, 150)]
    firsts = {}
    for t, r, _, seq, *_ in data:
        firsts.setdefault((t, r) if r else seq, seq)
    want = sorted(firsts.values())
    for name, order in (("one", [data]), ("many", [data[100:], data[:60], data[60:100]])):
        store = DeliveryStore(spark, f"file://{tmp_path}/{name}")
        dropped = []
        for part in order:
            dropped += [r["_seq"] for r in store.apply(batch(spark, part)).dropped.collect()]
        assert sorted(r["_seq"] for r in store.kept().collect()) == want
        assert sorted(dropped) == sorted(set(range(1, 150)) - set(want))
        again = store.apply(batch(spark, data[:20]))
        assert sorted(r["_seq"] for r in store.kept().collect()) == want
        assert {r["_seq"] for r in again.dropped.collect()} <= set(range(1, 150)) - set(want)


def files_of(store):
    s = store.store.state()
    return {p: sorted(gens) for p, gens in s["tables"]["kept"]["parts"].items()}


def test_only_affected_parts_are_rewritten(spark, tmp_path):
    store = DeliveryStore(spark, f"file://{tmp_path}/s")
    assert store.kept() is None
    store.apply(batch(spark, [("t", "a", "v", 1, 0, "x"), ("t", "b", "v", 2, 1, "x"), ("t", "c", "v", 3, 2, "x")]))
    before = files_of(store)
    done = store.apply(batch(spark, [("t", "b", "v", 9, 3, "y"), ("t", "d", "v", 10, 2, "y")]))
    after = files_of(store)
    assert done.affected == [1] and after["0"] == before["0"] and after["1"] != before["1"] and before["2"][0] in after["2"]
    assert rows(store.kept(), "_seq", "body") == [(1, "x"), (10, "y"), (2, "x"), (3, "x")]
    assert store.vacuum() == 1 and rows(done.dropped, "_seq") == [(9,)]
    # An earlier arrival of a known message takes over, and the part it was in is freed of it.
    done = store.apply(batch(spark, [("t", "c", "v", 0, 5, "z"), (None, None, None, 50, None, None)]))
    assert [r["_seq"] for r in done.dropped.collect()] == [3]
    assert ("t", 0, 5) in rows(store.kept(), "tbl", "_seq", "part")


def test_applying_again_changes_nothing(spark, tmp_path):
    """Messages without a key too; and the index keeps one entry an identifier."""
    store = DeliveryStore(spark, f"file://{tmp_path}/s", buckets=2)
    one = [("t", None, "v", 1, 0, "x"), ("t", "a", None, 2, 0, "x"), ("t", "k", "v", 3, 0, "x"), (None, "k", "v", 3, 1, "x")]
    two = [("t", "k", "v", 4, 1, "y"), ("t", " ", "v", 5, 1, "y"), ("t", "m", "v", 6, None, "y")]
    for data in (one, two):
        store.apply(batch(spark, data))
    kept = rows(store.kept(), "tbl", "_seq", "part", "body")
    for data in (one, two, one + two, two, one):
        assert {r["_seq"] for r in store.apply(batch(spark, data)).dropped.collect()} <= {4}
        assert rows(store.kept(), "tbl", "_seq", "part", "body") == kept
    assert len(kept) == 6
    index = store.store.load(store.store.state(), "index")
    assert index.count() == index.select("_h").distinct().count() == 6
    assert store.vacuum() > 0 and rows(store.kept(), "tbl", "_seq", "part", "body") == kept


def test_dead_writers_and_second_writers(spark, tmp_path):
    store = DeliveryStore(spark, f"file://{tmp_path}/s")
    store.apply(batch(spark, [("t", "a", "v", 1, 0, "x")]))
    parts = store.store
    stale = parts.state()
    parts.write(parts.state(), "kept", store.kept().select("tbl", "_key", "_seq", "body", F.lit(1).alias("_h"), F.lit(1).alias("_new"), "part"), "dead")
    (tmp_path / "s" / "manifest" / "0000000002.json").write_text('{"version": 2, "tab')
    assert store.kept().count() == 1 and parts.state()["version"] == 1
    store.apply(batch(spark, [("t", "b", "v", 2, 0, "x")]))
    assert parts.state()["version"] == 3 and store.kept().count() == 2
    with pytest.raises(RuntimeError):
        parts.commit(stale)
    assert store.vacuum() >= 1 and store.kept().count() == 2


def test_empty_batch(spark, tmp_path):
    store = DeliveryStore(spark, f"file://{tmp_path}/s")
    assert store.apply(batch(spark, [])).dropped.count() == 0 and store.kept().count() == 0
    store.apply(batch(spark, [("t", "a", "v", 1, 0, "x")]))
    assert store.kept().count() == 1


# -- ranks ----------------------------------------------------------------------------

def test_running_values(spark):
    rng = random.Random(2)
    data = [(i * rng.choice([1, 1, 50]), rng.choice("aab") if i % 5 else None, rng.randrange(100) if i % 4 else None) for i in range(1, 200)]
    data = list({d[0]: d for d in data}.values())
    df = spark.createDataFrame(data, "o bigint, k string, v int")
    seen, want, top, tops = {}, {}, None, {}
    for o, k, v in sorted(data):
        seen[k] = seen.get(k, 0) + 1
        want[o] = seen[k]
        tops[o] = top
        top = max((x for x in (top, v) if x is not None), default=None)
    assert {r["o"]: r["n"] for r in ranking.running_count(df, ["k"], "o", "n").collect()} == want
    assert {r["o"]: r["m"] for r in ranking.running_max_before(df, "v", "o", "m").collect()} == tops
    assert ranking.running_count(df.limit(0), ["k"], "o", "n").count() == 0
