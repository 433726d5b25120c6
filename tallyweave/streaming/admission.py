"""Admission under Structured Streaming: one state per voter, without expiry.

The state holds the receipt that stands. Rows of one voter are taken in order of
arrival within a micro-batch; there is no watermark, as late votes are admitted too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyweave.config import Schedule
from tallyweave.operators.admission import screen

DECISION = "arrival_seq bigint, electionId string, voterId string, candidateId string, voter string, candidate string, party string, region string, place string, receipt string, castAt timestamp, reason string, originalReceipt string"
NAMES = [c.split()[0] for c in DECISION.split(", ")]


class FirstVote(StatefulProcessor):
    """Accepts a voter's first eligible vote and names it to all later ones. A voter's rows
    of one micro-batch are held together, in Arrow chunks; the trigger's limit on files or
    offsets bounds them. Nothing runs row by row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._standing = handle.getValueState("standing", "receipt string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        chunks = list(rows)
        before = self._standing.get()
        first, standing = -1, before[0] if before else None
        if before is None:
            # The first eligible arrival over all chunks.
            able = [(c.loc[c["screened"].isna(), "arrival_seq"].min(), c) for c in chunks if c["screened"].isna().any()]
            if able:
                first, chunk = min(able, key=lambda x: x[0])
                chosen = (chunk["screened"].isna() & (chunk["arrival_seq"] == first)).idxmax()
                standing = chunk.loc[chosen, "receipt"]
                self._standing.update((standing,))
            else:
                first = None
        for c in chunks:
            # With a standing vote from before, every row is later than it.
            later = c["arrival_seq"] >= first if first is not None else pd.Series(False, index=c.index)
            if before is None and first is not None and c is chunk:
                later[chosen] = False
            reason = c["screened"].astype(object).where(c["screened"].notna(), None)
            reason = reason.mask(c["screened"].isna() & later, "DUPLICATE_VOTE")
            original = pd.Series(None, index=c.index, dtype=object).mask(later & (c["screened"] != "INVALID_VOTE"), standing)
            yield c.drop(columns=["screened"]).assign(voter=key[0], reason=reason, originalReceipt=original)[NAMES]

    def close(self) -> None:
        pass


def admit_stream(votes: DataFrame, election: str, schedule: Schedule = Schedule()) -> DataFrame:
    """Decisions on a stream of votes. Votes without a valid voter are refused without
    state, so they do not meet in one group."""
    screened = screen(votes, election, schedule).select("arrival_seq", "electionId", "voterId", "candidateId", "voter", "candidate", "party", "region", "place", "receipt", "castAt", "screened")
    stateless = F.col("screened").eqNullSafe("INVALID_VOTE")
    refused = screened.where(stateless).withColumn("reason", F.col("screened")).withColumn("originalReceipt", F.lit(None).cast("string")).select(NAMES)
    decided = screened.where(~stateless).groupBy("voter").transformWithStateInPandas(FirstVote(), DECISION, "Append", "None")
    return decided.select(NAMES).unionByName(refused)
