"""Free-typed places to the entries of a list, by a prefix-filtered similarity join.

A name becomes the set of its letter pairs. Two sets with Jaccard similarity t or
more share a token among the first ``n - ceil(t n) + 1`` of each, where tokens are
ordered from rare to common; only those prefixes are joined. Lengths and token
positions discard pairs that cannot reach t, what remains is verified exactly, and
each typed place keeps its best entry.

The join runs on different spellings, not rows, and inside the typed state where
that is a state of the list, else over the whole list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyweave.functions.text import trim_low
from tallyweave.session import broadcast_if_small, few_rows, run_dir

#: Least Jaccard similarity of the letter pairs of two names.
MIN_SIMILARITY = 0.34
#: Most edits per letter of the longer name that the final check lets pass.
MAX_EDITS = 0.40

# Letters and what they become, spellings of letters read in a wrong
# encoding, words of administration before a name.
ACCENTED = "áàâãäåéèêëíìîïóòôõöøúùûüçñýÿ"
PLAIN = "aaaaaaeeeeiiiioooooouuuucnyy"
DIGITS, LOOKALIKE = "01345", "oieas"
MOJIBAKE = {"¡": "a", "¢": "a", "£": "a", "¤": "a", "©": "e", "ª": "e", "¨": "e", "\xad": "i", "³": "o", "´": "o", "µ": "o", "¶": "o", "º": "u", "¼": "u", "§": "c", "±": "n", "\x81": "a", "\x89": "e", "\x8d": "i", "\x93": "o", "\x9a": "u", "\x87": "c", "\x83": "a", "‡": "c", "‰": "e", "“": "o", "š": "u", "ƒ": "a", "•": "o", "‚": "a", "\xa0": "a", "€": "a", "\x80": "a", "\x95": "o", "\x82": "a", "\x8a": "e", "\x94": "o", "Š": "e", "”": "o"}
STATE = r"(?:^|[-–/(\[,:;|])\P{L}*(?:(?:UF|EST|ESTADO|STATE)\P{L}*(?:D[EOA]\P{L}+)?)?([A-Z][. ]?[A-Z])\P{L}*$"
OFFICE = r"^(?:(?:municipio|mun|pref|prefeitura(?: municipal)?|cidade|distrito(?: sede)?|distr?|centro|bairro)(?: de| do| da)? )+"


ENTITY = "&([A-Za-z])(?:acute|grave|circ|tilde|cedil|uml|ring|slash);"


def clean(c: Column | str) -> Column:
    """Lower-case letters and single spaces: entities, wrongly decoded letters,
    accents, look-alike digits, punctuation and words of administration undone."""
    t = F.regexp_replace(trim_low(c), ENTITY, "$1")
    for bad, good in MOJIBAKE.items():
        t = F.replace(t, F.lit("Ã" + bad), F.lit(good))
    t = F.translate(F.lower(t), ACCENTED + DIGITS, PLAIN + LOOKALIKE)
    t = F.regexp_replace(t, r"[̀-ͯ​-‍﻿'’]", "")
    t = F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))
    return F.regexp_replace(t, OFFICE, "")


def state_code(c: Column | str) -> Column:
    """The two letters of a typed state, without points, where they are the whole value
    or follow a word for state or a dash, slash or the like; null if none. The last
    letters of a name are no code."""
    t = F.regexp_extract(F.upper(trim_low(c)), STATE, 1)
    t = F.regexp_replace(t, "[^A-Z]", "")
    return F.when(F.length(t) == 2, t)


def pairs(name: Column) -> Column:
    """The set of letter pairs of a name without its spaces, ends marked."""
    s = F.concat(F.lit("^"), F.replace(name, F.lit(" "), F.lit("")), F.lit("$"))
    n = F.length(s)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2))))


def entries(places: DataFrame) -> DataFrame:
    """The list as the join needs it: mun_code, uf, name, tokens, peso."""
    name = clean("municipio")
    return places.select("mun_code", F.upper(trim_low("uf")).alias("uf"), name.alias("name"), pairs(name).alias("tokens"), F.coalesce("peso", F.lit(0)).alias("peso")).where("name <> ''")


def typed(spellings: DataFrame, states: list[str]) -> DataFrame:
    """Different (state, city) as typed, with name and scope. A state code at either
    end of the city is taken off, and stands in for a missing state."""
    codes = "|".join(s.lower() for s in states if s.isalpha()) or "-"
    name = clean("city")
    hint = F.upper(F.coalesce(F.nullif(F.regexp_extract(name, rf" ({codes})$", 1), F.lit("")), F.nullif(F.regexp_extract(name, rf"^({codes}) ", 1), F.lit(""))))
    code = state_code("state")
    scope = F.when(code.isin(states), code).when(hint.isin(states), hint).otherwise("*")
    bare = F.regexp_replace(F.regexp_replace(name, rf" ({codes})$", ""), rf"^({codes}) ", "")
    return spellings.select("state", "city", scope.alias("scope"), F.when(bare != "", bare).otherwise(name).alias("name"))


def _ranked(sets: DataFrame, ids: list[str], frequency: DataFrame) -> DataFrame:
    """Token sets as one row per token, from rare to common; ``n`` is the set's size."""
    tokens = sets.select(*ids, F.explode("tokens").alias("token")).join(broadcast_if_small(frequency), "token", "left")
    order = Window.partitionBy(*ids).orderBy(F.coalesce("freq", F.lit(0)), "token")
    return tokens.select(*ids, "token", (F.row_number().over(order) - 1).alias("pos"), F.count(F.lit(1)).over(Window.partitionBy(*ids)).alias("n"))


def _prefix(ranked: DataFrame, t: float) -> DataFrame:
    return ranked.where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * t))


def similar(names: DataFrame, listed: DataFrame, t: float = MIN_SIMILARITY) -> DataFrame:
    """All pairs (scope, name, mun_code) with Jaccard similarity >= t of their letter
    pairs, with ``jaccard``, the entry's name and peso. ``names`` has different
    (scope, name); scope is a uf of the list or '*' for all of it."""
    if not 0 < t <= 1:
        raise ValueError("similarity must lie in (0, 1]")
    left = names.where("name <> ''").select("scope", "name", pairs(F.col("name")).alias("tokens"))
    frequency = listed.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    a = _prefix(_ranked(left, ["scope", "name"], frequency), t)
    b = _prefix(_ranked(listed, ["mun_code"], frequency), t).select("mun_code", "token", F.col("pos").alias("pos2"), F.col("n").alias("m"))
    b = b.join(broadcast_if_small(listed.select("mun_code", "uf")), "mun_code")
    b = b.withColumn("scope", F.explode(F.array(F.col("uf"), F.lit("*")))).drop("uf")
    need = F.ceil((F.col("n") + F.col("m")) * (t / (1 + t)) - 1e-9)
    most = F.least("pos", "pos2") + 1 + F.least(F.col("n") - F.col("pos") - 1, F.col("m") - F.col("pos2") - 1)
    candidates = (
        a.join(broadcast_if_small(b), ["scope", "token"])
        .where((F.col("m") >= F.col("n") * t - 1e-9) & (F.col("n") >= F.col("m") * t - 1e-9) & (most >= need))
        .select("scope", "name", "mun_code").distinct()
    )
    entry = listed.select("mun_code", F.col("name").alias("entry"), F.col("tokens").alias("_b"), "peso")
    tokens = pairs(F.col("name"))
    verified = candidates.join(broadcast_if_small(entry), "mun_code").withColumn("_both", F.size(F.array_intersect(tokens, "_b")))
    return verified.withColumn("jaccard", F.col("_both") / (F.size(tokens) + F.size("_b") - F.col("_both"))).where(F.col("jaccard") >= t - 1e-12).drop("_both", "_b")


def best(found: DataFrame, max_edits: float = MAX_EDITS) -> DataFrame:
    """The entry that each (scope, name) means: candidates within ``max_edits`` edits a
    letter (a name cut short is held against as much of the entry), the most similar
    first, then the entry with more weight, then the lower code."""
    a, b = F.replace("name", F.lit(" "), F.lit("")), F.replace("entry", F.lit(" "), F.lit(""))
    whole = F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
    short = F.when(F.length(a) >= 5, F.levenshtein(a, F.substring(b, F.lit(1), F.length(a))) / F.length(a) + 0.1)
    # An abbreviated first word: same first letter, and the rest of the name agrees.
    rest_a, rest_b = F.regexp_replace("name", "^[^ ]+ ", ""), F.regexp_replace("entry", "^[^ ]+ ", "")
    first = (F.substring("name", 1, 1) == F.substring("entry", 1, 1)) & F.col("name").contains(" ") & F.col("entry").contains(" ")
    abbreviated = F.when(first & (F.length(rest_a) >= 4), F.levenshtein(rest_a, rest_b) / F.greatest(F.length(rest_a), F.length(rest_b)) + 0.1)
    edits = F.least(whole, F.coalesce(short, whole), F.coalesce(abbreviated, whole))
    ok = found.withColumn("edits", edits).where(F.col("edits") <= max_edits)
    score = F.struct((F.round(F.col("jaccard") - F.col("edits"), 6)).alias("s"), "peso", (-F.col("mun_code")).alias("c"))
    return ok.groupBy("scope", "name").agg(F.max_by(F.struct("mun_code", "jaccard", "edits", "entry"), score).alias("_b")).select("scope", "name", "_b.*")


def map_places(spellings: DataFrame, places: DataFrame, t: float = MIN_SIMILARITY) -> DataFrame:
    """mun_code for each different (state, city) as typed; 0 where no entry is meant.

    Null and blank cities are no places and get 0 too; a null state searches the
    whole list. The list's state codes are collected: a list has few states."""
    listed = entries(places)
    states = sorted(r[0] for r in few_rows(listed.select("uf").distinct(), 1000, "states in the list") if r[0])
    # Written, so that cleaning runs once per spelling: a filter on the clean name would
    # otherwise be moved below the step that makes the spellings different.
    spark = spellings.sparkSession
    path = run_dir(spark, "places")
    typed(spellings, states).write.parquet(path)
    names = spark.read.schema("state string, city string, scope string, name string").parquet(path)
    found = best(similar(names.select("scope", "name").distinct(), listed, t))
    return names.join(found.select("scope", "name", "mun_code", "jaccard", "edits", "entry"), ["scope", "name"], "left").select(
        "state", "city", F.coalesce("mun_code", F.lit(0)).cast("int").alias("mun_code"), "scope", "name", "entry", "jaccard", "edits"
    )
