"""The transcript sources that the engine reads, each behind one contract.

An adapter finds its root (a given one, else its environment variable, else a folder below the home
directory) and reads it.  Another source is one more entry of ``ADAPTERS``; where two of them find the
same file, it belongs to the earlier one.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events
from . import aider, claude, codex, gemini


@dataclass(frozen=True)
class Adapter:
    """``read`` (spark, root, repository) gives (events, file stats).  ``schema_verified`` says that the
    form was checked against real transcripts, and not against its description alone."""

    id: str
    schema_verified: bool
    variable: str
    folder: str | None
    read: Callable[[SparkSession, str, str], tuple[DataFrame, DataFrame]]

    def root(self, given: str | None = None, repo: str | None = None) -> str | None:
        """Where it looks; an adapter without a folder of its own looks in the repository."""
        if self.folder is None:
            return given or repo
        return given or os.environ.get(self.variable) or os.path.join(os.path.expanduser("~"), self.folder)


def _aider(spark: SparkSession, root: str, repo: str) -> tuple[DataFrame, DataFrame]:
    return aider.read(spark, root, os.environ.get(AIDER.variable))


AIDER = Adapter("aider", False, "COSTLEDGER_AIDER_HISTORY", None, _aider)
#: In the order of their claims.
ADAPTERS: dict[str, Adapter] = {
    a.id: a
    for a in (
        Adapter("claude-code", True, "COSTLEDGER_CLAUDE_DIR", ".claude", lambda spark, root, repo: claude.read(spark, root)),
        Adapter("codex", False, "COSTLEDGER_CODEX_DIR", ".codex", lambda spark, root, repo: codex.read(spark, root)),
        Adapter("gemini-cli", False, "COSTLEDGER_GEMINI_DIR", ".gemini", lambda spark, root, repo: gemini.read(spark, root)),
        AIDER,
    )
}


def claimed(usage: DataFrame, stats: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """Usage and stats of each file by the first of ``ids`` that found it."""
    rank = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("agent")).alias("adapter_rank")
    own = events.first_adapter(stats.select("source_file", "agent", rank)).select("source_file", "agent")
    return usage.join(own, ["source_file", "agent"], "left_semi"), stats.join(own, ["source_file", "agent"], "left_semi")


def read_all(spark: SparkSession, ids: tuple[str, ...], roots: dict[str, str] | None, repo: str) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """(usage, file stats, roots used).  With ``roots`` only the agents that it names are read, else all
    of ``ids`` in their default places."""
    used = {i: ADAPTERS[i].root((roots or {}).get(i), repo) for i in ids if roots is None or i in roots}
    if not used:
        raise ValueError("no transcript source is configured")
    found = [ADAPTERS[i].read(spark, root, repo) for i, root in used.items()]
    usage, stats = found[0]
    for e, s in found[1:]:
        usage, stats = usage.unionByName(e), stats.unionByName(s)
    return (usage, stats, used) if len(found) == 1 else (*claimed(usage, stats, list(used)), used)
