"""Settings of the tally job."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import datetime, timezone


def instant_ms(text: str | None) -> int | None:
    """Epoch milliseconds of an ISO-8601 instant; null and blank give None."""
    if text is None or not text.strip():
        return None
    t = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    return round(t.timestamp() * 1000)


@dataclass(frozen=True)
class Schedule:
    """When votes count: [opens, closes) in epoch milliseconds, None for no bound."""

    opens: int | None = None
    closes: int | None = None

    def __post_init__(self) -> None:
        if self.opens is not None and self.closes is not None and self.opens >= self.closes:
            raise ValueError("an election has to open before it closes")

    @classmethod
    def of(cls, opens: str | None = None, closes: str | None = None, strict: bool = False) -> Schedule:
        """From ISO-8601 texts. With one of them blank the schedule has no bounds;
        ``strict`` (the edge's rule) refuses that."""
        a, b = instant_ms(opens), instant_ms(closes)
        if (a is None) != (b is None):
            if strict:
                raise ValueError("give both bounds of the schedule or neither")
            return cls()
        return cls(a, b)


@dataclass(frozen=True)
class JobConfig:
    """All flags of the job with their defaults; names on the command line have dots
    (``--merkle.window.ms 15000``)."""

    # The defaults that users of the job rely on.
    bootstrap_servers: str = "localhost:9092"
    consumer_group: str = "voting-aggregation"
    topic_votes: str = "votes.cast"
    topic_control: str = "votes.control"
    topic_rejected: str = "votes.rejected"
    topic_accepted: str = "votes.accepted"
    topic_windows: str = "votes.windows"
    transaction_timeout_ms: int = 900_000
    parallelism: int = 2
    checkpoint_interval_ms: int = 10_000
    watermark_out_of_orderness_ms: int = 5_000
    exactly_once: bool = True
    election_id: str = "br-2026-presidencial"
    election_opens_at: str = ""
    election_closes_at: str = ""
    merkle_window_ms: int = 60_000

    @classmethod
    def from_args(cls, args: list[str]) -> JobConfig:
        kinds = {f.name: type(f.default) for f in fields(cls)}
        if len(args) % 2:
            raise ValueError("flags come as --name value")
        given = {}
        for flag, value in zip(args[::2], args[1::2]):
            name = flag.removeprefix("--").replace(".", "_")
            if not flag.startswith("--") or name not in kinds:
                raise ValueError(f"unknown flag {flag}")
            kind = kinds[name]
            given[name] = value.strip().lower() == "true" if kind is bool else kind(value)
        config = cls(**given)
        if config.merkle_window_ms <= 0 or config.watermark_out_of_orderness_ms < 0:
            raise ValueError("the window must be positive and the watermark bound not negative")
        return config

    def schedule(self) -> Schedule:
        return Schedule.of(self.election_opens_at, self.election_closes_at)
