"""The edge in batch form: requests become stamped, receipted votes or errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.config import Schedule
from tallyweave.functions.receipts import ReceiptPolicy
from tallyweave.functions.text import normalize_id

#: Most that a vote's time may lie ahead of the clock.
MAX_AHEAD_MS = 60_000
#: Error code -> HTTP status.
STATUS = {"VOTO_INVALIDO": 400, "ELEICAO_INCORRETA": 400, "VOTACAO_FECHADA": 403, "REGISTRO_INDISPONIVEL": 503}
REQUIRED = ("voterId", "candidateId", "partyId", "state", "city")


def http_status(code: Column) -> Column:
    """201 for no error, else the status of the code, 500 for one that is not known."""
    out = F.when(code.isNull(), 201)
    for name, status in STATUS.items():
        out = out.when(code == name, status)
    return out.otherwise(500)


def cast_votes(requests: DataFrame, election: str, schedule: Schedule, policy: ReceiptPolicy, now: Column) -> DataFrame:
    """Requests (electionId optional, no time of their own that counts) with the time
    ``now`` stamped on as castAt, normalised values, receipt, ``error`` and ``status``.

    Order of the checks: election, schedule, fields. An electionId that is missing or
    blank is the configured one. Refused requests have no receipt."""
    ms = F.unix_millis(now)
    asked = F.coalesce(normalize_id("electionId"), F.lit(election)) if "electionId" in requests.columns else F.lit(election)
    out = requests.withColumns({"_election": asked, "castAt": now} | {f"_{c}": normalize_id(c) for c in REQUIRED})
    missing = F.lit(False)
    for c in REQUIRED:
        missing = missing | F.col(f"_{c}").isNull()
    closed = F.lit(False)
    if schedule.opens is not None:
        closed = closed | (ms < schedule.opens)
    if schedule.closes is not None:
        closed = closed | (ms >= schedule.closes)
    error = F.when(F.col("_election") != election, "ELEICAO_INCORRETA").when(closed, "VOTACAO_FECHADA").when(missing | F.col("castAt").isNull(), "VOTO_INVALIDO")
    rest = [c for c in requests.columns if c not in {*REQUIRED, "electionId", "castAt", "receipt", "error", "status", "schemaVersion"}]
    receipt = policy(F.col("_election"), F.col("_voterId"), F.col("_candidateId"), F.unix_millis("castAt"))
    return out.withColumn("error", error).select(
        F.lit(1).alias("schemaVersion"), F.col("_election").alias("electionId"), F.col("_voterId").alias("voterId"), F.col("_candidateId").alias("candidateId"), F.col("_partyId").alias("partyId"),
        F.upper("_state").alias("state"), F.col("_city").alias("city"), "castAt", F.when(F.col("error").isNull(), receipt).alias("receipt"), "error", http_status(F.col("error")).alias("status"), *rest,
    )


def ahead_of_clock(cast_at: Column, now: Column) -> Column:
    """The edge's guard against times in the future."""
    return F.unix_millis(cast_at) > F.unix_millis(now) + MAX_AHEAD_MS


def receipt_events(cast: DataFrame) -> DataFrame:
    """Receipts of accepted requests; they never carry the candidate."""
    return cast.where(F.col("error").isNull()).select(F.lit(1).alias("schemaVersion"), "receipt", "electionId", "voterId", F.col("castAt").alias("issuedAt"))


def submit(cast: DataFrame, topics, number: int) -> DataFrame:
    """Record the accepted requests: votes first, receipts only once these are recorded
    (``topics``: see sources/wire; a batch is acknowledged as a whole). Where that fails, they
    become REGISTRO_INDISPONIVEL without a receipt, and may be sent again under the same
    ``number``. Returns the requests as they are answered. Give it a written frame."""
    accepted = cast.where(F.col("error").isNull())
    try:
        topics.send(accepted, "votes.cast", number)
        topics.send(receipt_events(cast), "votes.receipts", number)
    except Exception:  # whatever the reason, nothing was acknowledged
        code = F.coalesce("error", F.lit("REGISTRO_INDISPONIVEL"))
        return cast.withColumns({"receipt": F.lit(None).cast("string"), "error": code}).withColumn("status", http_status(F.col("error")))
    return cast
