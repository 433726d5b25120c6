"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F

#: Folder of the vocabulary files, and the file used unless another is named.
FOLDER = os.environ.get("TALLYWEAVE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
#: A text is encoded in pieces of at most this many characters, cut at white space.
PIECE = 20_000


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The whole text in pieces that end before white space where there is any, so
    that no word is cut; a byte-level tokenizer then counts as it does on the whole."""
    out, at = [], 0
    while len(text) - at > size:
        cut = max(text.rfind(c, at + 1, at + size) for c in " \n")
        if cut <= at or text[cut - 1].isspace():
            cut = next((i for i in range(at + size, at, -1) if text[i].isspace() and not text[i - 1].isspace()), at + size)
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out


def counter(vocabulary: str = VOCABULARY, folder: str = FOLDER):
    """A column function: tokens of a text, 0 for null and empty ones. The vocabulary file is
    sent to the executors, which need not have the folder; each Python worker loads it once."""
    path = f"{folder}/{vocabulary}"
    SparkSession.getActiveSession().sparkContext.addFile(path)

    @F.pandas_udf("int")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from pyspark import SparkFiles
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(SparkFiles.get(vocabulary))
        t.encode_special_tokens = True
        for texts in batches:
            sizes = []
            for text in texts:
                cut = pieces(text) if text else []
                sizes.append(sum(len(e.ids) for e in t.encode_batch(cut, add_special_tokens=False)) if cut else 0)
            yield pd.Series(sizes, dtype="int32")

    def count(text: Column | str) -> Column:
        return tokens(F.col(text) if isinstance(text, str) else text)

    return count
