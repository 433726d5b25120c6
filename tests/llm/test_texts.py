import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallyweave.llm import mixing, packing, posts, spam, tokens

CHAT = ["The caretaker forgot to mention the old laptop, so we left it behind the garage.", "Minha prima pesou o regador e deu o dia por encerrado.", "Nobody here knows what the router was for and my neighbour doubts it too.", "El conserje no sabe nada sobre el enrejado de la casa."]


# -- own text and spam -------------------------------------------------------------

def test_own_text():
    own = posts.own_text
    assert own(None) == own("") == own("> quoted\n| too") == ""
    assert own("[quote=a]x [quote author=b]y[/quote] z[/quote]mine") == "mine"
    assert own("<blockquote>a<blockquote>b</blockquote>c</blockquote>mine<br />more") == "mine\nmore"
    assert own("bob wrote:\n>old\n&gt; older\nnew\n-- \nbob\nhttp://x.example/") == "new"
    assert own("mine\n_______________\nsig") == "mine" and own("mine\n~~~ bob ~~~") == "mine" and own("mine\n[size=1][i]sig[/i] x[/size]") == "mine"
    assert own("[quote]never ends and mine") == "never ends and mine"
    assert own("see [here](http://x.test/a) and www.y.test") .count(posts.LINK) == 2
    assert own("<p " + "x" * 5000 + ">mine</p>") == "mine" and own("[quote=" + "y" * 5000 + "]theirs[/quote]mine") == "mine"
    assert own("mine\n--\n" + "sig\n" * 40) == "mine" and own("mine\n_____\n" + "more\n" * 40).count("more") == 40
    assert len(own("<a " * 100_000)) > 0 and len(own("[url=" * 100_000)) > 0
    assert len(own("[quote]" * 3000 + "x" * 200_000 + "[/quote]" * 3000)) == 0


def test_words_have_one_spelling():
    assert spam.words("Ph0ne cаse p.h.o.n.e c​ase") == ["phone", "case", "phone", "case"]
    assert spam.words(f"#deal {posts.LINK} 12 A123 2x") == [spam.T, spam.L, spam.N, spam.N, spam.N]


STUFFED = {
    "repeated": "Hair Serum ~ " * 40, "list": "\n".join(f"{a} hair serum {b}" for a in ("buy", "cheap", "best") for b in ("online", "now", "discount", "review")) * 3,
    "links": "\n".join(f"http://a{i}.example/x" for i in range(9)), "tags": " ".join(f"#buyserum{i % 4}" for i in range(20)),
    "prices": "\n".join(f"A{i} {w} red $ {i}.99" for i, w in enumerate(["hair serum", "car mats", "slim tea", "web hosting"] * 8)),
    "sentences": "Looking for hair serum? Our hair serum is the best hair serum because hair serum buyers know hair serum. " * 4,
    "after a sentence": CHAT[0] + "\n" + "car mats original | cheap car mats | car mats outlet | " * 8,
}


def corpus():
    rng = random.Random(1)
    docs = [(i, " ".join(rng.sample(CHAT, 1 + i % 4))) for i in range(300)]
    docs += [(1000 + i, t) for i, t in enumerate(STUFFED.values())]
    docs += [(2000, "[quote=x]" + STUFFED["repeated"] + "[/quote]" + CHAT[2]), (2001, None), (2002, ""), (2003, "up up"), (2004, "thanks, see http://x.example/ for more"), (2005, STUFFED["list"]), (2006, STUFFED["list"])]
    return docs


def scored(spark, docs):
    return {r["id"]: r for r in spam.page_scores(spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("n", F.lit(1)).withColumn("reason", F.lit("mine")), "doc_id", "text").collect()}


def found(got):
    return {i for i, r in got.items() if r["reason"]}


BAD = {*range(1000, 1000 + len(STUFFED)), 2005, 2006}


def test_stuffed_pages_are_found_and_others_not(spark):
    got = scored(spark, corpus())
    assert found(got) == BAD
    assert len(got) == len(corpus()) and got[2001]["mean_pmi"] is None
    assert spam.page_scores(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0


def test_nothing_is_found_without_mutual_information(spark, monkeypatch):
    """The decision is PMI's: with every PMI at 0 the stuffed pages are lost."""
    real = spam.mutual_information
    monkeypatch.setattr(spam, "mutual_information", lambda *a: real(*a).withColumns({"pmi": F.lit(0.0), "pmi_pages": F.lit(0.0)}))
    assert not {i for i, r in scored(spark, corpus()).items() if r["reason"] == "STUFFED"}


def test_scores_match_a_plain_computation(spark):
    docs = corpus()
    ws = {i: spam.words(posts.own_text(t)) for i, t in docs}
    count, on = Counter(), Counter()
    for w in ws.values():
        count.update(zip(w, w[1:]))
        on.update(set(zip(w, w[1:])))
    def pmi(c):
        left, right = Counter(), Counter()
        for (a, b), k in c.items():
            left[a] += k
            right[b] += k
        n = sum(c.values())
        return {(a, b): math.log(k * n / (left[a] * right[b])) for (a, b), k in c.items()}
    every, pages = pmi(count), pmi(on)
    got = scored(spark, docs)
    for i, w in ws.items():
        pairs = list(zip(w, w[1:]))
        if pairs:
            assert got[i]["mean_pmi"] == pytest.approx(sum(every[p] for p in pairs) / len(pairs))
            assert got[i]["gap"] == pytest.approx(sum(abs(every[p] - pages[p]) for p in pairs if count[p] > on[p]) / len(pairs))
            blocks = max(1, round(len(pairs) / spam.BLOCK))
            again = sum(k * math.log(k) * max(every[p], 0) for b in range(blocks) for p, k in Counter(pairs[b * len(pairs) // blocks : (b + 1) * len(pairs) // blocks]).items())
            assert got[i]["stuffing"] == pytest.approx(again / len(pairs), rel=1e-5, abs=1e-9)


def test_long_cycles_and_lists_that_do_not_repeat(spark):
    rng = random.Random(3)
    letters = "bcdfgklmnprstv"
    invented = ["".join(rng.choice(letters) + rng.choice("eiu") for _ in range(3)) for _ in range(400)]
    chat = [(i, " ".join(rng.sample(CHAT, 1 + i % 4))) for i in range(200)]
    spun = " ".join(f"best {a} for {b}" for a, b in zip(invented[250:300], invented[300:350]))
    bad = {1000: " ".join(invented[:70] * 40), 1001: " ".join(invented[100:160]), 1002: ", ".join(invented[160:190]) + ".", 1003: " ".join([spun] * 3), 1004: CHAT[0] + " " + " ".join(invented[190:250])}
    fine = {2000: " ".join(CHAT) + " " + " ".join(invented[:9]), 2002: " ".join(invented[360:365])}
    got = scored(spark, [*chat, *bad.items(), *fine.items()])
    assert found(got) == set(bad)
    assert got[1000]["stuffing"] == 0 and got[1000]["reason"] == "STUFFED" and got[1001]["reason"] == "SALAD"


def test_word_salad_is_found(spark):
    rng = random.Random(4)
    rare = [f"{a}{b}{c}" for a in ("ba", "ce", "di", "fu", "ge", "ki", "lu", "me", "ni", "ru") for b in ("ba", "ce", "di", "fu", "ge", "ki", "lu", "me", "ni", "ru") for c in ("ban", "cel", "dir", "fum", "gen", "kil", "lur", "mel", "nis", "rup")]
    sentences = [[w for _ in range(3) for w in (rng.choice("the of and with from for to in by on".split()), *rng.sample(rare, 2))] for _ in range(200)]
    stream = [w for x in sentences for w in x]
    docs = [(i, ". ".join(" ".join(x) for x in rng.sample(sentences, 3))) for i in range(300)] + [(1000 + i, " ".join(rng.sample(stream, 80))) for i in range(5)]
    got = scored(spark, docs)
    assert {i: r["reason"] for i, r in got.items() if r["reason"]} == {1000 + i: "SALAD" for i in range(5)}
    # A pair that only the page itself has does not connect its words.
    alone = scored(spark, [(1, "alpha beta gamma"), (2, "delta beta gamma")])
    assert alone[1]["connection"] == pytest.approx((-1 + 1 * math.log(1 * 2 / (1 * 1)) / math.log(2)) / 2)


# -- packing --------------------------------------------------------------------------

@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(130, 1000), st.integers(1, 40), min_size=1, max_size=60))
def test_large_plan_places_every_item_once(lengths):
    plan = packing.plan_large(lengths, 1000)
    fill = Counter()
    order = [x for x in sorted(lengths, reverse=True) for _ in range(lengths[x])]
    at = 0
    for g, (low, high, n) in enumerate(plan.groups):
        for r in range(n):
            size = order[at]
            at += 1
            assert low <= size <= high
            i = max(k for k, s in enumerate(plan.starts[g]) if s <= r)
            fill[plan.first_bin[g][i] + (r - plan.starts[g][i]) // plan.per_bin[g][i]] += size
    assert at == len(order) and max(fill.values()) <= 1000 and set(fill) <= set(range(plan.bins))


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 50), min_size=1), st.dictionaries(st.integers(0, 90), st.integers(1, 9)))
def test_small_plan_never_overfills(lengths, rooms):
    plan = packing.plan_small(lengths, rooms, 100)
    fill, placed = Counter(), Counter()
    for length, item, n, room, place in zip(plan.length, plan.item, plan.n, plan.room, plan.place):
        placed[length] += n
        for k in range(n):
            fill[room, place + k] += length
    assert dict(placed) == lengths
    assert all(v <= (100 if room < 0 else room) and place < (plan.opened if room < 0 else rooms[room]) for (room, place), v in fill.items())


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(13, 100), st.floats(0, 1)), min_size=1, max_size=5), st.integers(100, 5000))
def test_knapsack_is_exact_for_any_capacity(items, capacity):
    sizes = [s * capacity // 100 for s, _ in items]
    best = lambda room: max([0.0, *(v + best(room - s) for s, (_, v) in zip(sizes, items) if s <= room)])
    value, config = packing._knapsack(sizes, packing.np.array([v for _, v in items]), capacity)
    assert value == pytest.approx(best(capacity)) and sum(k * s for k, s in zip(config, sizes)) <= capacity
    assert sum(k * v for k, (_, v) in zip(config, items)) == pytest.approx(value)


@pytest.mark.parametrize("capacity", [100, 512])
def test_packing_is_whole_and_tight(spark, capacity):
    rng = random.Random(6)
    data = [(i, rng.choice([0, None, 3, 40, 40, 40, rng.randrange(1, 90), rng.randrange(1, 1300)])) for i in range(1500)] + [(9000, 512 * 4), (9001, 100)]
    df = spark.createDataFrame(data, "doc_id bigint, tokens int").withColumn("bin", F.lit("x"))
    got = [r.asDict() for r in packing.pack(df, capacity).collect()]
    held, bins, pieces = Counter(), Counter(), Counter()
    for r in got:
        held[r["doc_id"]] += r["tokens"]
        bins[r["bin"]] += r["tokens"]
        pieces[r["doc_id"]] += 1
    assert held == {i: n for i, n in data if n}
    assert max(bins.values()) <= capacity
    assert all(pieces[i] == (1 if n <= capacity else -(-n // capacity)) for i, n in data if n)
    assert len({(r["doc_id"], r["piece"]) for r in got}) == len(got)
    assert sum(bins.values()) / (len(bins) * capacity) > 0.95
    assert packing.pack(df.limit(0), capacity).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, 0)


def test_token_counts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.FOLDER}/{tokens.VOCABULARY}")
    t.encode_special_tokens = True
    texts = [None, "", "hello world", "ação  e   reação\n\n", "word " * 30_000, "x" * 50_000, "<|endoftext|>"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, s string").coalesce(1).orderBy("i").select(tokens.counter()("s")).collect()]
    want = [len(t.encode(x, add_special_tokens=False).ids) if x else 0 for x in texts]
    assert got[:5] == want[:5] and got[6] == want[6] and abs(got[5] - want[5]) <= 3
    assert all("".join(tokens.pieces(x)) == x for x in texts if x)


# -- mixing -------------------------------------------------------------------------

def test_mix_meets_targets_and_limits():
    held = {"a": 1000, "b": 100, "c": 10, "x": 50}
    targets = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.1, 10), "none": (0.1, 3)}
    m = mixing.plan_mix(held, targets)
    assert m.exponent == 0 and m.weights["a"] == pytest.approx(5 / 9) and all(m.budgets[s] <= targets[s][1] * held[s] for s in m.budgets)
    big = mixing.plan_mix(held, targets, 900)
    assert 0 < big.exponent < 1 and all(m <= targets[s][1] * held[s] for s, m in big.budgets.items()) and sum(big.weights.values()) == pytest.approx(1)
    full = mixing.plan_full(held, targets)
    # Past what the natural mixture allows the total is cut, here to all there is.
    assert mixing.plan_mix(held, targets, 10**9) == full
    assert full.total == 1110 and 0 < full.exponent < 1 and max(b / (targets[s][1] * held[s]) for s, b in full.budgets.items()) == pytest.approx(1, abs=1e-3)
    even = mixing.plan_entropy({"a": 30, "b": 30}, {"a": (0.9, 5), "b": (0.1, 5)})
    assert even.weights == {"a": 0.5, "b": 0.5}
    e = mixing.plan_entropy(held, {k: (v[0], 100) for k, v in targets.items()})
    assert mixing.entropy(e.weights) == pytest.approx(mixing.entropy({"a": 5 / 9, "b": 3 / 9, "c": 1 / 9}), abs=1e-6)
    assert mixing.plan_mix({}, targets).budgets == {} and mixing.plan_mix(held, {}).budgets == {}


def test_realised_mix(spark):
    rng = random.Random(9)
    docs = [(i, "hot" if i % 3 == 0 else rng.choice(["b", "c", None]), rng.choice([0, None, 5, 50, 400])) for i in range(3000)]
    df = spark.createDataFrame(docs, "id bigint, source string, tokens int").withColumn("epoch", F.lit("x"))
    held = {s: sum(n or 0 for _, t, n in docs if t == s) for s in ("hot", "b", "c")}
    most = {"hot": 2, "b": 3, "c": 1}
    m = mixing.plan_mix(held, {"hot": (0.6, 2), "b": (0.3, 3), "c": (0.1, 1)})
    uses = [r.asDict() for r in mixing.realise(df, m, block_tokens=20_000).collect()]
    per = Counter((r["source"], r["id"]) for r in uses)
    assert len({(r["id"], r["epoch"]) for r in uses}) == len(uses) and all(n <= most[s] for (s, _), n in per.items())
    got, blocks = Counter(), {}
    for r in uses:
        got[r["source"]] += r["tokens"]
        blocks.setdefault(r["block"], []).append(r)
    # Lengths are 5, 50 and 400: budgets are filled up to less than the shortest.
    assert all(0 <= m.budgets[s] - got[s] < 5 for s in m.budgets)
    # Every block has the shares of the whole, in an order of its own.
    assert sorted(blocks) == list(range(-(-sum(m.budgets.values()) // 20_000)))
    for rows in blocks.values():
        assert sorted(r["position"] for r in rows) == list(range(len(rows)))
        for s, w in m.weights.items():
            assert abs(sum(r["tokens"] for r in rows if r["source"] == s) / sum(r["tokens"] for r in rows) - w) < 0.06
    # An epoch uses what the one before used, in another order; documents come back late.
    begin = lambda e: [r["id"] for r in sorted(uses, key=lambda r: (r["block"], r["position"])) if r["source"] == "b" and r["epoch"] == e]
    assert set(begin(1)) <= set(begin(0)) and begin(0)[:20] != begin(1)[:20]
    assert rows_of(mixing.realise(df, m)) == rows_of(mixing.realise(df, m))
    assert mixing.realise(df.limit(0), m).count() == 0 and mixing.realise(df, mixing.plan_mix({}, {})).count() == 0


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())
