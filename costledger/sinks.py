"""Reports as JSON, text and markdown, and the writers of notes and comments.

Only small aggregates are collected here; every sum was made in Spark.
"""

from __future__ import annotations

import json
import os
import re
import subprocess
from collections.abc import Callable, Iterable
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from .config import VERSION
from .functions.money import format_usd, money_json

SCHEMA_VERSION = 1
ANSI = re.compile(r"\x1b\[[0-9;]*m")


# --- formats ----------------------------------------------------------------------------------------


def format_tokens(n: int) -> str:
    """9,999 and below in full, then k, M and B with one decimal, halves up; a rounded 1000.0 moves on."""
    if n < 10_000:
        return f"{n:,}"
    for size, unit in ((10**3, "k"), (10**6, "M"), (10**9, "B")):
        tenths = (n * 10 + size // 2) // size
        if tenths < 10_000:
            break
    return f"{tenths // 10:,}.{tenths % 10}{unit}"


def format_bytes(n: int) -> str:
    """By 1,024, with one decimal from KB on."""
    value, unit = float(n), 0
    while value >= 1024 and unit < 4:
        value, unit = value / 1024, unit + 1
    return f"{n} B" if unit == 0 else f"{value:.1f} {['B', 'KB', 'MB', 'GB', 'TB'][unit]}"


def date_utc(ms: int) -> str:
    return datetime.fromtimestamp(ms / 1000, timezone.utc).strftime("%Y-%m-%d")


def minute_utc(ms: int) -> str:
    return datetime.fromtimestamp(ms / 1000, timezone.utc).strftime("%Y-%m-%d %H:%M")


def iso_utc(ms: int | None) -> str | None:
    return None if ms is None else datetime.fromtimestamp(ms // 1000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S") + f".{ms % 1000:03d}Z"


def local_time(ms: int, zone: str | None = None) -> str:
    """Wall time with its offset, for the heads of reports only; without a zone the system's."""
    at = datetime.fromtimestamp(ms // 1000, timezone.utc).astimezone(ZoneInfo(zone) if zone else None)
    return at.strftime("%Y-%m-%d %H:%M:%S ") + at.strftime("%z")[:3] + ":" + at.strftime("%z")[3:5]


def parse_date(text: str, now_ms: int) -> int:
    """``today``, ``yesterday``, ``N units ago`` (a month has 30 days, a year 365) or ISO 8601 (UTC)."""
    day = 86_400_000
    text = text.strip()
    if text in ("today", "yesterday"):
        return now_ms // day * day - (day if text == "yesterday" else 0)
    m = re.fullmatch(r"(\d+)\s+(minute|hour|day|week|month|year)s?\s+ago", text)
    if m:
        return now_ms - int(m[1]) * {"minute": 60_000, "hour": 3_600_000, "day": day, "week": 7 * day, "month": 30 * day, "year": 365 * day}[m[2]]
    try:
        found = datetime.fromisoformat(text)
    except ValueError as e:
        raise ValueError(f"no date: {text!r}") from e
    return round((found if found.tzinfo else found.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def width(text: str) -> int:
    return len(ANSI.sub("", text))


def truncate(text: str, most: int) -> str:
    return text if len(text) <= most else text[: max(0, most - 1)] + "…"


def cost_cell(total: int, unpriced: int) -> str:
    """A dash only where nothing was priced."""
    return "$—" if total == 0 and unpriced > 0 else format_usd(total)


def table(columns: list[tuple[str, str]], rows: Iterable[Iterable[str]]) -> str:
    """Columns (header, "left" or "right") under a rule, two spaces apart, without trailing spaces."""
    cells = [[h for h, _ in columns], *[list(r) for r in rows]]
    size = [max(width(r[i]) for r in cells) for i in range(len(columns))]
    pad = lambda c, i: " " * (size[i] - width(c)) + c if columns[i][1] == "right" else c + " " * (size[i] - width(c))
    out = ["  ".join(pad(c, i) for i, c in enumerate(r)).rstrip() for r in cells]
    return "\n".join([out[0], "  ".join("-" * n for n in size), *out[1:]])


def md_cell(text: str) -> str:
    return text.replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")


PLAN_NOTE = "at API list prices; a flat-rate plan is billed differently"


# --- JSON -------------------------------------------------------------------------------------------


def tokens_json(r) -> dict[str, int]:
    out = {"input": r["input_tokens"], "output": r["output_tokens"], "cacheWrite": r["cache_write_tokens"], "cacheRead": r["cache_read_tokens"]}
    return {k: v or 0 for k, v in out.items()} | {"total": sum(v or 0 for v in out.values())}


def breakdown_json(r) -> dict:
    names = {"input": "cost_input", "output": "cost_output", "cacheWrite": "cost_cache_write", "cacheRead": "cost_cache_read", "total": "cost_total"}
    return {k: money_json(int(r[c] or 0)) for k, c in names.items()}


def bucket_json(b: dict) -> dict:
    return {k: b[k] for k in ("cost", "tokens", "sessions")}


def envelope(command: str, check, repo: str, plan: str | None = None, pricing: dict | None = None, warnings: Iterable[str] = ()) -> dict:
    """The head that every report shares."""
    sums = {"attributed": check["attributed"], "waste": check["waste"], "overhead": check["overhead"], "outOfScope": check["out_of_scope"]}
    invariant = {"ok": check["ok"], "totalTokens": check["raw_tokens"], **sums, "deltaTokens": check["mismatch_tokens"]}
    head = {"schemaVersion": SCHEMA_VERSION, "command": command, "costledger": VERSION, "repoRoot": repo, "plan": plan, "pricing": pricing or {}, "invariant": invariant, "warnings": list(warnings)}
    return head if check["ok"] else head | {"accountingMismatch": {"tokens": check["mismatch_tokens"]}}


def to_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False, default=int)


def exit_code(check, strict: bool) -> int:
    """3 only if tokens are unaccounted for and that was asked to fail."""
    return 3 if strict and not check["ok"] else 0


def invariant_line(check) -> str:
    if check["ok"]:
        return f"tokens accounted for: {format_tokens(check['raw_tokens'])}"
    return f"MISMATCH: {check['mismatch_tokens']} tokens read are not in the ledger"


# --- writers ----------------------------------------------------------------------------------------


def write_markdown(path: str, text: str, force: bool = False) -> None:
    if os.path.exists(path) and not force:
        raise FileExistsError(f"{path} is there already; force overwrites it")
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


NOTES_REF = "refs/notes/costledger"


def _notes(repo: str, *args: str, data: str | None = None) -> str:
    run = subprocess.run(["git", "-C", repo, "notes", f"--ref={NOTES_REF}", *args], input=data, capture_output=True, text=True, timeout=600)
    if run.returncode:
        raise RuntimeError(run.stderr.strip())
    return run.stdout


def list_notes(repo: str) -> list[str]:
    return sorted(line.split()[1] for line in _notes(repo, "list").splitlines() if line.strip())


def read_note(repo: str, commit: str) -> str:
    return _notes(repo, "show", commit).rstrip("\n")


def sync_notes(repo: str, payloads: Iterable[tuple[str, str]]) -> list[str]:
    """Writes (hash, payload) notes in order of hash; writing the same again changes nothing."""
    done = []
    have = set(list_notes(repo))
    for commit, payload in sorted(payloads):
        if commit not in have or read_note(repo, commit) != payload:
            _notes(repo, "add", "-f", "-F", "-", commit, data=payload)
        done.append(commit)
    return done


def clear_notes(repo: str, within: set[str] | None = None) -> list[str]:
    """Removes this ledger's notes, and no others."""
    gone = [c for c in list_notes(repo) if within is None or c in within]
    for commit in gone:
        _notes(repo, "remove", "--ignore-missing", commit)
    return gone


MARKER = "<!-- costledger -->"


def upsert_comment(transport: Callable[[str, str, dict | None], object], pull: int, body: str) -> str:
    """Edits the comment that has the marker, or adds one.  ``transport(method, path, data)`` is the forge."""
    text = f"{MARKER}\n{body}"
    for comment in transport("GET", f"issues/{pull}/comments", None) or ():
        if MARKER in (comment.get("body") or ""):
            if comment["body"] != text:
                transport("PATCH", f"issues/comments/{comment['id']}", {"body": text})
                return "updated"
            return "unchanged"
    transport("POST", f"issues/{pull}/comments", {"body": text})
    return "created"
