"""Keyword-stuffed and link-list pages, by the mutual information of neighbouring words.

The author's own words (see posts) are brought to one spelling, and links, tags and
numbers to one mark each. From the counts of the corpus two neighbouring words have the
pointwise mutual information PMI(a, b) = ln(c(a b) N / (c(a .) c(. b))), once with c the
number of occurrences and once with c the number of pages that have the pair. Per page:

  mean_pmi    mean of PMI over its pairs of neighbours
  stuffing    mean over its pairs of PMI, counted only where the pair comes back within a
              passage, ln k times where it comes k times: repeated collocations
  gap         mean of |PMI by occurrences - PMI by pages|, 0 for a pair that no page repeats:
              what the corpus owes to pages that say the same over and over; near the corpus
              median for sentences
  connection  mean of PMI / -ln(c(a b) / N) without the page's own counts, -1 for a pair
              that no other page has: how far other pages put these words together

Excessively repeated collocations (stuffing + GAP_WEIGHT * (gap - corpus median) at or above
EXCESSIVE) are STUFFED: keywords, and lists of links or tags, whose marks follow each other.
Word salad, also a list of words that no other page puts together, has a connection far
below the lower quartile of the corpus.

Counts come from every page. Repeats are counted within passages of BLOCK words, so that
a long text is not held to be repetitive for its length; what comes back only after more
words than that shows in the gap. Nothing depends on lists of words or languages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.llm.posts import LINK, own_text
from tallyweave.operators.hotkeys import skew_join
from tallyweave.session import run_dir, written

BLOCK = 64
#: Fewer words tell nothing.
MIN_WORDS = 4
#: What repeated collocations must come to, and the weight of the gap in it.
EXCESSIVE, GAP_WEIGHT = 3.75, 10.0
#: Word salad has SALAD_WORDS or more and a connection this many times the distance
#: from the corpus median to its lower quartile below that quartile.
SALAD_WORDS, SALAD_DISTANCE = 20, 15.0
#: Least distance, for corpora whose pages are all alike.
LEAST_DISTANCE = 0.03

# Letters of other alphabets that pass for Latin ones, digits that pass
# for letters.
LOOKALIKES = str.maketrans("аеорсхуіјѕһԁɡкмтвнАЕОРСХУІЈЅКМТВНαορεικνυ", "aeopcxyijshdgkmtbhAEOPCXYIJSKMTBHaopeiknu")
LEET = str.maketrans("0134578", "oieastb")
_INVISIBLE = re.compile("[­​-‏⁠﻿̀-ͯ]")
_DOTTED = re.compile(r"(?<![^\W\d_])(?:[^\W_][.\-_*·]){2,}[^\W_](?![^\W\d_])")
_DOTS = re.compile(r"[.\-_*·]")
_TOKEN = re.compile(r"#\w+|[^\W_]+(?:['’][^\W_]+)?|" + LINK)
_CODE = re.compile(r"[^\W\d_]{1,2}\d+|\d+[^\W\d_]{1,3}")
L, T, N = "\x01link", "\x01tag", "\x01number"


def words(own: str) -> list[str]:
    """Words in one spelling; links, hashtags, and numbers and codes as one mark each."""
    t = _INVISIBLE.sub("", own).translate(LOOKALIKES)
    t = _DOTTED.sub(lambda m: _DOTS.sub("", m.group(0)), t).lower()
    out = []
    for w in _TOKEN.findall(t):
        if w.isalpha():
            out.append(w)
        elif w == LINK:
            out.append(L)
        elif w[0] == "#":
            out.append(N if w[1:].isdigit() else T)
        elif w.isdigit():
            out.append(N)
        elif any(c.isdigit() for c in w):
            out.append(N if _CODE.fullmatch(w) else w.translate(LEET))
        else:
            out.append(w)
    return out


def neighbours(ws: list) -> dict[tuple, list]:
    """Per pair of neighbours how often it occurs, and the sum of k ln k over the passages
    that have it k times."""
    pairs = list(zip(ws, ws[1:]))
    blocks = max(1, round(len(pairs) / BLOCK))
    found: dict[tuple, list] = {}
    for i in range(blocks):
        for p, k in Counter(pairs[i * len(pairs) // blocks : (i + 1) * len(pairs) // blocks]).items():
            x = found.setdefault(p, [0, 0.0])
            x[0] += k
            x[1] += k * math.log(k)
    return found


_GRAM = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("tf", pa.int32()), ("again", pa.float32()), ("ta", pa.int32()), ("tb", pa.int32())]))
_SCHEMA = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("grams", _GRAM)])
_DDL = "id bigint, n int, grams array<struct<a:bigint,b:bigint,tf:int,again:float,ta:int,tb:int>>"
#: Pairs after which a batch of pages leaves, so that long texts go in smaller batches.
BATCH_PAIRS = 50_000


def word_hash(w: str) -> int:
    """64 bits of a word, as a signed number."""
    h = xxhash.xxh64_intdigest(w)
    return h - (1 << 64) if h >> 63 else h


def _columns(ids: list, sizes: list, grams: list) -> pa.RecordBatch:
    """One batch; the pairs of each page are given as columns."""
    offsets = np.concatenate([[0], np.cumsum([len(g[0]) for g in grams])]).astype(np.int32)
    flat = [[x for g in grams for x in g[k]] for k in range(6)]
    kinds = [f.type for f in _GRAM.value_type]
    values = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(flat, kinds)], fields=list(_GRAM.value_type))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], schema=_SCHEMA)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, grams, held = [], [], [], 0
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ws = words(own_text(text))
            known = {w: word_hash(w) for w in set(ws)}
            hs = [known[w] for w in ws]
            firsts, seconds = Counter(hs[:-1]), Counter(hs[1:])
            found = neighbours(hs)
            ids.append(i)
            sizes.append(len(ws))
            grams.append(([a for a, _ in found], [b for _, b in found], [x[0] for x in found.values()], [x[1] for x in found.values()], [firsts[a] for a, _ in found], [seconds[b] for _, b in found]))
            held += len(found)
            if held > BATCH_PAIRS:
                yield _columns(ids, sizes, grams)
                ids, sizes, grams, held = [], [], [], 0
        if ids:
            yield _columns(ids, sizes, grams)


def measure(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per page its words counted and its pairs of neighbours, words as 64-bit hashes. Null
    and empty texts have none."""
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(_measure, _DDL)


def mutual_information(types: DataFrame, total: int, pages: int, tasks: int) -> DataFrame:
    """Both PMI of each pair, from rows (a, b, c, d): occurrences, and pages that have it.
    Counts of single words are summed from the pairs; a word that very many different pairs
    have is split over tasks where its sum is joined back."""
    out = types
    for word, other, c, d in (("a", "b", "ca", "da"), ("b", "a", "cb", "db")):
        single = types.groupBy(word).agg(F.sum("c").alias(c), F.sum("d").alias(d))
        out = skew_join(out, single, (word,), [other], tasks, estimate=types.select(word))
    by = lambda x, y, z, n: F.log(F.col(x) * F.lit(float(n)) / (F.col(y).cast("double") * F.col(z)))
    return out.select("a", "b", "c", "d", "ca", "cb", by("c", "ca", "cb", total).alias("pmi"), by("d", "da", "db", pages).alias("pmi_pages"))


def connection(total: int) -> Column:
    """Normalised PMI of a page's pair on the other pages, from -1 (never together) to 1."""
    others = F.lit(float(total)) - F.col("all_pairs")
    c, ca, cb = (F.col(x) - F.col(y) for x, y in (("c", "tf"), ("ca", "ta"), ("cb", "tb")))
    return F.when(c < 1, -1.0).when(c >= others, 1.0).otherwise(F.log(c * others / (ca.cast("double") * cb)) / -F.log(c / others))


def page_scores(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per page: id, words, mean_pmi, stuffing, gap, connection, excess (stuffing and gap
    together) and the reason to hold it for spam (STUFFED, SALAD), or null. Pages with fewer
    than two words have no measures and are no spam; pages with fewer than MIN_WORDS are none
    either. The measured pages are written to the shared folder, as corpus counts and page
    scores both read them. The join of pages and pairs is split by the pages a pair is on."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = run_dir(spark, "spam")
    measure(docs, id_col, text_col).write.parquet(path)
    pages = spark.read.schema(_DDL).parquet(path)
    flat = pages.select("id", (F.col("n") - 1).alias("all_pairs"), F.inline("grams"))
    types = written(flat.groupBy("a", "b").agg(F.sum("tf").alias("c"), F.count(F.lit(1)).alias("d")), "pairs")
    total, on_pages = (x or 1 for x in types.agg(F.sum("c"), F.sum("d")).first())
    known = skew_join(flat, mutual_information(types, total, on_pages, tasks), ("a", "b"), ["id"], tasks, estimate=types, load=F.col("d"))
    mean = lambda x: (F.sum(F.col("tf") * x) / F.sum("tf"))
    sums = written(known.groupBy("id").agg(
        F.sum("tf").alias("pairs"), mean(F.col("pmi")).alias("mean_pmi"), mean(connection(total)).alias("connection"),
        (F.sum(F.col("again") * F.greatest("pmi", F.lit(0.0))) / F.sum("tf")).alias("stuffing"), mean(F.when(F.col("c") > F.col("d"), F.abs(F.col("pmi") - F.col("pmi_pages"))).otherwise(0.0)).alias("gap"),
    ), "sums")
    middle_of = lambda c, q, least: F.percentile_approx(F.when(F.col("pairs") >= least, F.col(c)), q, 10_000)
    quarter, middle, usual = (x or 0.0 for x in sums.agg(middle_of("connection", 0.25, SALAD_WORDS - 1), middle_of("connection", 0.5, SALAD_WORDS - 1), middle_of("gap", 0.5, MIN_WORDS - 1)).first())
    scored = pages.select("id", "n").join(sums, "id", "left").withColumn("excess", F.col("stuffing") + GAP_WEIGHT * (F.col("gap") - usual))
    stuffed = (F.col("n") >= MIN_WORDS) & (F.col("excess") >= EXCESSIVE)
    salad = (F.col("n") >= SALAD_WORDS) & (F.col("connection") < quarter - SALAD_DISTANCE * max(middle - quarter, LEAST_DISTANCE))
    reason = F.when(F.coalesce(stuffed, F.lit(False)), "STUFFED").when(F.coalesce(salad, F.lit(False)), "SALAD")
    return scored.select("id", F.col("n").alias("words"), "mean_pmi", "stuffing", "gap", "connection", "excess", reason.alias("reason"))
