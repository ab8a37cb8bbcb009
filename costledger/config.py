"""Settings of the ledger."""

from __future__ import annotations

from dataclasses import dataclass, field

DAY_MS = 86_400_000
VERSION = "0.2.0"


@dataclass(frozen=True)
class AttributionConfig:
    """A commit can take an event from ``grace`` before to ``horizon`` after it, both ends included."""

    horizon_days: float = 14
    grace_seconds: float = 120
    weight_file: float = 0.6
    weight_time: float = 0.25
    weight_branch: float = 0.15

    @property
    def horizon_ms(self) -> int:
        return round(self.horizon_days * DAY_MS)

    @property
    def grace_ms(self) -> int:
        return round(self.grace_seconds * 1000)


@dataclass(frozen=True)
class Flags:
    """Options that every report takes; ``since`` and ``until`` restrict what is shown, never what is attributed."""

    since: int | None = None
    until: int | None = None
    strict: bool = False
    plan: str | None = None
    color: bool = False
    now_ms: int = 0


PLANS = ("pro", "max5", "max20", "team", "enterprise", "api")
ADAPTERS = ("claude-code", "codex", "gemini-cli", "aider")


@dataclass(frozen=True)
class RepoConfig:
    plan: str | None = None
    attribution: AttributionConfig = field(default_factory=AttributionConfig)
    adapters: tuple[str, ...] = ADAPTERS
    warnings: tuple[str, ...] = ()
