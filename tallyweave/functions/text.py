"""Text rules shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: All characters up to U+0020; the trim of the wire contract removes these and no others.
LOW_CHARS = "".join(map(chr, range(0x21)))
RECEIPT = r"^[0-9a-f]{64}\z"
#: Only characters that Java's String.isBlank takes for white space.
BLANK = r"^[\t-\r\x1c-\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{2028}\x{2029}\x{205f}\x{3000}]*$"
MAX_ID_CHARS = 128


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_low(c: Column | str) -> Column:
    """Strip characters up to U+0020 at both ends; null stays null."""
    return F.btrim(col(c), F.lit(LOW_CHARS))


def filled(c: Column) -> Column:
    """True where a trimmed value is neither null nor empty, never null."""
    return F.coalesce(c != "", F.lit(False))


def is_receipt(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(RECEIPT), F.lit(False))


def normalize_id(c: Column | str) -> Column:
    """An identifier as the domain holds it: trimmed; null where the value is null,
    blank (any Unicode white space) or longer than 128 characters after the trim."""
    t = trim_low(c)
    # A printable ASCII character settles it; only other text needs the pattern.
    ok = (F.ascii(t).between(33, 126) | ~col(c).rlike(BLANK)) & (F.length(t) <= MAX_ID_CHARS)
    return F.when(ok, t)


def compact(c: Column) -> Column:
    """A lossless binary form: 64 lower-case hex digits take 33 bytes, other text
    its UTF-8 bytes with another first byte."""
    return F.when(is_receipt(c), F.concat(F.unhex(F.lit("01")), F.unhex(c))).when(
        c.isNotNull(), F.concat(F.unhex(F.lit("00")), F.encode(c, "UTF-8"))
    )


def message_key(receipt: Column | str, voter: Column | str) -> Column:
    """Struct (receipt, voter) that copies of one message share, or null where
    either is null or blank; such a row is a message of its own."""
    r, v = F.lower(trim_low(receipt)), trim_low(voter)
    return F.when(filled(r) & filled(v), F.struct(compact(r).alias("receipt"), v.alias("voter")))
