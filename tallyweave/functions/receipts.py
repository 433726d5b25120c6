"""Receipts of votes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: (election, voter, candidate, cast instant in ms) -> receipt; any such function may
#: stand in for ``sha256_policy``.
ReceiptPolicy = Callable[[Column, Column, Column, Column], Column]


def sha256_policy(pepper: str) -> ReceiptPolicy:
    """SHA-256 over election|voter|candidate|milliseconds|pepper, in lower-case hex.
    Null where any part is null. The parts are joined without escaping."""
    if not pepper or not pepper.strip():
        raise ValueError("the pepper must not be blank")

    def receipt(election: Column, voter: Column, candidate: Column, cast_ms: Column) -> Column:
        bar = F.lit("|")
        return F.sha2(F.encode(F.concat(election, bar, voter, bar, candidate, bar, cast_ms.cast("string"), bar, F.lit(pepper)), "UTF-8"), 256)

    return receipt
