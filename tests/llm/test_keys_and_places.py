import random
import shutil

import pytest
from pyspark.sql import functions as F

from tallyweave.functions.text import compact
from tallyweave.llm import places, seen

ROWS = "tbl string, k string, arrival_seq bigint"


def keyed(df):
    return df.select("tbl", compact(F.col("k")).alias("key"), "arrival_seq")


def truth(data):
    """{(tbl, number): is it the first of its key} for rows with a key, in order of arrival."""
    met, out = set(), {}
    for t, k, i in sorted(data, key=lambda r: r[2]):
        if k is not None:
            out[t, i] = (t, k) not in met
            met.add((t, k))
    return out


def told(store):
    return {(r["tbl"], r["arrival_seq"]): r["first"] for r in store.answers().collect()}


@pytest.mark.parametrize("ordered", [True, False])
def test_seen_keys_are_exact_and_outlive_a_restart(spark, tmp_path, ordered):
    rng = random.Random(4)
    data = [("a" if i % 4 else "b", None if i % 9 == 0 else "hot" if i % 3 == 0 else f"k{rng.randrange(60)}", i) for i in range(1, 240)]
    if not ordered:
        rng.shuffle(data)
    folder, got = f"file://{tmp_path}/state", []
    assert told(seen.SeenKeys(spark, folder)) == {}
    for k in range(3):
        got += data[k * 80 : (k + 1) * 80]
        store = seen.SeenKeys(spark, folder)  # knows nothing but its folder
        assert store.bring(keyed(spark.createDataFrame(data[k * 80 : (k + 1) * 80], ROWS))) == k
        assert told(store) == truth(got)
    # A delivery without keys, and one that died before its answers were written.
    store.bring(keyed(spark.createDataFrame([("a", None, 900)], ROWS)))
    shutil.rmtree(tmp_path / "state" / "answers" / "delivery=3")
    seen.SeenKeys(spark, folder).bring(keyed(spark.createDataFrame([("a", None, 900)], ROWS)))
    shutil.rmtree(tmp_path / "state" / "answers" / "delivery=2")
    shutil.rmtree(tmp_path / "state" / "answers" / "delivery=3")
    again = seen.SeenKeys(spark, folder)
    again.bring(keyed(spark.createDataFrame(data[160:240], ROWS)))
    assert told(again) == truth(got)


LIST = [(1, "KR", "Ponte Samivela", 100), (2, "KR", "Fonte Brumivela", 50), (3, "KR", "Fonte Brumivelo", 40), (4, "VA", "Fonte Brumivela", 60), (5, "VA", "Morro Tadunópe", None), (6, "QI", "Nossa Senhora de Venseriú", 9), (7, "HO", "Lagoa Savétané", 5), (8, "TA", "Olho d'Água de Lintuqua", 3)]
PLACES = "mun_code int, uf string, municipio string, peso int"


def meant(spark, typed):
    listed = spark.createDataFrame(LIST, PLACES)
    df = spark.createDataFrame([(s, c) for s, c, _ in typed], "state string, city string").withColumn("extra", F.lit(1))
    got = places.map_places(df.select("state", "city").distinct(), listed)
    return {(r["state"], r["city"]): r["mun_code"] for r in got.collect()}


def test_places_as_people_type_them(spark):
    cases = [
        ("KR", "ponte samivela", 1), ("kr ", "PONTE  SAMIVELA", 1), ("K.R.", "Pte Samivela", 1), ("Est. KR", "PonteSamivela", 1), ("KR", "P0nte Samive1a", 1), ("KR", "Ponte_Samivela/KR", 1),
        ("KR", "Pnte damivela", 1), (None, "Ponte Samivela (KR)", 1), ("", "KR Ponte Samivela", 1), ("KR", "Município de Ponte Samivela", 1), ("KR", "Centro, Ponte Samivela", 1), ("KR", "Ponte Sami", 1),
        ("KR", "Fonte Brumivela.", 2), ("KR", "fonte brumivelo", 3), ("VA", "Fte Brumivela", 4), (None, "Fonte Brumivela", 4), ("VA", "MorrozTadun&oacute;pe", 5), ("VA", "Morro TadunÃ³pe", 5),
        ("QI", "N. Sra. de Venseriu", 6), ("HO", "Lga Savetane", 7), ("TA", "Olho dAgua Lintuqua", 8), ("xx", "Lagoa Savétané", 7),
        ("KR", "Fjellnyegy", 0), ("KR", "???", 0), ("KR", "Ponte Qeshthwaiteyngwe", 0), ("VA", "não informado", 0), ("KR", "x" * 5000, 0), ("KR", None, 0), ("KR", " ", 0), (None, None, 0),
    ]
    got = meant(spark, cases)
    wrong = {k: (got[k], w) for *k, w in ((s, c, w) for s, c, w in cases) for k in [tuple(k)] if got[k] != w}
    assert not wrong


def test_similarity_join_loses_no_pair(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ba", "lo", "mi", "ra", "te", "vu"]) for _ in range(rng.randrange(1, 6)))
    listed = [(i, rng.choice(["AA", "BB"]), word() + " " + word(), 1) for i in range(60)]
    names = sorted({(rng.choice(["AA", "BB", "*"]), word() + rng.choice([" ", ""]) + word()) for _ in range(120)})
    grams = lambda n: {s[i : i + 2] for s in ["^" + n.replace(" ", "") + "$"] for i in range(len(s) - 1)}
    for t in (0.3, 0.5, 0.8):
        want = set()
        for scope, n in names:
            for code, uf, m, _ in listed:
                a, b = grams(n), grams(m)
                if scope in (uf, "*") and len(a & b) / len(a | b) >= t - 1e-12:
                    want.add((scope, n, code))
        got = places.similar(spark.createDataFrame(names, "scope string, name string"), places.entries(spark.createDataFrame(listed, PLACES)), t)
        assert {(r["scope"], r["name"], r["mun_code"]) for r in got.collect()} == want
    with pytest.raises(ValueError):
        places.similar(None, None, 0)


def test_empty_list_and_no_places(spark):
    empty = spark.createDataFrame([], PLACES)
    df = spark.createDataFrame([("KR", "Ponte")], "state string, city string")
    assert [r["mun_code"] for r in places.map_places(df, empty).collect()] == [0]
    assert places.map_places(df.limit(0), spark.createDataFrame(LIST, PLACES)).count() == 0


def test_no_state_of_a_long_list_is_left_out(spark):
    listed = spark.createDataFrame([(i, f"{chr(65 + i // 40)}{i}", "Ponte", 1) for i in range(1001)], PLACES)
    with pytest.raises(ValueError):
        places.map_places(spark.createDataFrame([("KR", "Ponte")], "state string, city string"), listed)


def test_the_end_of_a_state_name_is_no_code(spark):
    codes = {"SP": "SP", " s.p. ": "SP", "Est. RJ": "RJ", "UF: ba": "BA", "Estado de SE": "SE", "Sergipe - SE": "SE", "(PE)": "PE", "Rio de Janeiro": None, "Sergipe": None, "Paraíba": None, "Paraiba": None, "Maranhão": None, "": None}
    got = {r[0]: r[1] for r in spark.createDataFrame([(c,) for c in codes], "state string").select("state", places.state_code("state")).collect()}
    assert got == codes
    listed = spark.createDataFrame([(1, "RJ", "Niteroi", 5), (2, "RO", "Vilhena", 5)], "mun_code int, uf string, municipio string, peso int")
    meant = places.map_places(spark.createDataFrame([("Rio de Janeiro", "Niteroy")], "state string, city string"), listed)
    assert [r["mun_code"] for r in meant.collect()] == [1]
