"""Event-time windows: alignment, ids and the instants that ids name."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyweave.functions.text import col, trim_low

#: Date, time and zone in any usual ISO-8601 spelling, read after upper-casing.
INSTANT = (
    r"^(\d{4})[-/._ ]?(\d{2})[-/._ ]?(\d{2})[T _]+(\d{2})[:.\-_hH ]?(\d{2})(?:[:.\-_mM ]?(\d{2})(?:[.,](\d{1,9}))?)?"
    r"\s*(Z|UTC|GMT|[+-]\d{2}(?::?\d{2})?)\s*(?:/.*)?$"
)
PLAIN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\z"


def check_size(size_ms: int) -> int:
    if size_ms <= 0:
        raise ValueError(f"a window needs a positive size, not {size_ms} ms")
    return size_ms


def window_start_ms(event_ms: Column, size_ms: int) -> Column:
    """Epoch-aligned start of the window; floors, so instants before 1970 work too."""
    return event_ms - F.pmod(event_ms, F.lit(check_size(size_ms)).cast("bigint"))


def window_id(start_ms: Column) -> Column:
    """ISO-8601 start, with milliseconds only where there are any."""
    ts = F.timestamp_millis(start_ms)
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(ts, ".SSS")
    return F.concat(whole, F.when(F.pmod(start_ms, F.lit(1000)) != 0, part).otherwise(""), F.lit("Z"))


def named_instant_ms(window: Column | str) -> Column:
    """Epoch milliseconds of the instant that a window id spells, whatever its
    separators, letter case, padding, fraction, offset or trailing "/size";
    null for any other value, among them dates that do not exist."""
    t = F.upper(trim_low(col(window)))
    # The usual spelling needs no taking apart.
    plain = F.coalesce(t.rlike(PLAIN), F.lit(False))
    # One pass of the pattern puts all parts into a list.
    parts = F.split(F.regexp_replace(t, INSTANT, "$1,$2,$3,$4,$5,$6,$7,$8"), ",")
    part = lambda i: F.element_at(parts, i)
    zone = F.regexp_replace(part(8), ":", "")
    offset = F.when(part(8).isin("Z", "UTC", "GMT"), F.lit("+00:00")).otherwise(F.concat(F.substring(zone, 1, 3), F.lit(":"), F.rpad(F.substring(zone, 4, 2), 2, "0")))
    second = F.when(part(6) == "", "00").otherwise(part(6))
    text = F.concat(part(1), F.lit("-"), part(2), F.lit("-"), part(3), F.lit("T"), part(4), F.lit(":"), part(5), F.lit(":"), second, F.lit("."), F.rpad(F.substring(part(7), 1, 6), 6, "0"), offset)
    other = F.coalesce(t.rlike(INSTANT), F.lit(False))
    return F.when(plain, F.unix_millis(t.try_cast("timestamp"))).when(other, F.unix_millis(text.try_cast("timestamp")))
