"""Scripted repositories and logs, through the engine."""

import json
import os
import subprocess

import pytest

from costledger import sinks, text_reports
from costledger.config import Flags
from costledger.engine import Engine, UserError, load_config
from costledger.functions import money
from costledger.sources import adapters, claude
from costledger.streaming import ingest
from tests.test_sources import call, write

PRICES = {"schemaVersion": 1, "asOf": "2026-01-01", "source": "test", "models": {
    "atlas-4": {"displayName": "Atlas 4", "inputPerMTok": "5", "outputPerMTok": "25", "cacheWritePerMTok": "6.25", "cacheReadPerMTok": "0.5"},
    "boreal": {"displayName": "Boreal", "inputPerMTok": "0.435", "outputPerMTok": "0.87", "cacheWritePerMTok": "0", "cacheReadPerMTok": "0.003625"},
}}


class Repo:
    def __init__(self, path):
        self.path = os.path.realpath(path)
        os.makedirs(path, exist_ok=True)
        self.git("init", "-q", "-b", "main")
        self.git("config", "user.name", "a")
        self.git("config", "user.email", "a@x")

    def git(self, *args, when=None):
        env = os.environ | {"GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null", "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@x"}
        if when:
            env |= {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when}
        return subprocess.run(["git", "-C", self.path, *args], env=env, check=True, capture_output=True, text=True).stdout.strip()

    def commit(self, message, when, *files):
        for f in files:
            with open(f"{self.path}/{f}", "a") as out:
                out.write(f"{message}\n")
        self.git("add", "-A")
        self.git("commit", "-q", "-m", message, when=when)
        return self.git("rev-parse", "HEAD")


def used(repo, i, when, model="atlas-4", files=(), tokens=(100, 10, 0, 0), cwd=None, **more):
    names = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
    content = [{"type": "tool_use", "name": "Edit", "input": {"file_path": f"{repo.path}/{f}"}} for f in files]
    return call(dict(zip(names, tokens)), timestamp=when, cwd=cwd or repo.path, requestId=f"q{i}", message={"id": f"m{i}", "model": model, "content": content}, **more)


@pytest.fixture
def world(tmp_path):
    repo = Repo(f"{tmp_path}/repo")
    a = repo.commit("first", "2026-01-01T10:00:00+00:00", "a.py")
    b = repo.commit("second | piped", "2026-01-02T10:00:00+00:00", "b.py", "c.py")
    rows = [
        used(repo, 1, "2026-01-01T09:00:00Z"), used(repo, 2, "2026-01-01T09:10:00Z", files=["a.py"], isSidechain=True), used(repo, 3, "2026-01-01T11:00:00Z", files=["b.py", "c.py"]),
        used(repo, 3, "2026-01-01T11:00:00Z", files=["b.py", "c.py"]), used(repo, 4, "2026-01-01T12:00:00Z", model="mystery", tokens=(7, 0, 0, 0)),
        used(repo, 5, "2026-01-03T12:00:00Z", files=["z.py"]), used(repo, 6, "2026-01-03T12:00:00Z", cwd="/elsewhere"), used(repo, 7, "2026-01-01T00:00:00Z", sessionId="talk", tokens=(0, 0, 8, 1_000_000)),
    ]
    write(f"{tmp_path}/logs/projects/p/s.jsonl", rows)
    return repo, f"{tmp_path}/logs", a, b


def test_reports(spark, world):
    repo, logs, a, b = world
    eng = Engine.build(spark, repo.path, {"claude-code": logs}, PRICES)
    told = eng.summary()
    each = 100 * 5000 + 10 * 25000
    talk = 8 * 6250 + 1_000_000 * 500
    assert told["invariant"]["ok"] and told["totals"]["cost"]["nanoUsd"] == str(4 * each + talk) and told["totals"]["unpricedTokens"] == {"input": 7, "output": 0, "cacheWrite": 0, "cacheRead": 0, "total": 7}
    assert told["waste"]["sessions"] == 1 and told["inProgress"]["cost"]["nanoUsd"] == str(each) and told["overhead"]["cost"]["nanoUsd"] == str(talk) and told["covered"] == {"sessions": 2, "commits": 2}
    assert any("mystery" in w for w in told["warnings"]) and [m["model"] for m in told["byModel"]] == ["atlas-4", "mystery"] and told["byModel"][1]["cost"] is None
    log = eng.log()
    assert [c["hash"] for c in log["commits"]] == [b, a] and [c["cost"]["nanoUsd"] for c in log["commits"]] == [str(each), str(2 * each)] and log["commits"][1]["confidence"] == "high"
    assert eng.log(limit=1)["totals"]["commitsShown"] == 1 and eng.log(f"{a}..{b}")["commits"][0]["hash"] == b
    show = eng.show("HEAD")
    assert show["filesMatched"] == {"matched": ["b.py", "c.py"], "unmatched": []} and show["adoptedEvents"] == 0 and show["evidence"][0]["matchedFiles"] == 2
    first = eng.show(a)
    assert first["adoptedEvents"] == 1 and first["subagents"]["sharePctOfTokens"] == 50.0
    span = eng.range(f"{a}..{b}", "r1")
    assert span["headline"]["cost"]["nanoUsd"] == str(each) and span["span"]["from"] == span["span"]["to"] and span["revListCommits"] == 1
    again = eng.reprice("boreal-9", f"{a}..{b}")
    assert again["target"]["id"] == "boreal" and again["repriced"]["cost"]["total"]["nanoUsd"] == str(100 * 435 + 10 * 870) and again["deltaPct"] == "-93.0" and not again["cacheFallback"]
    text = eng.markdown()
    assert "second \\| piped" in text and "$—" in text and "tokens accounted for" in text and b[:7] in eng.log_text()
    doc = eng.doctor()
    assert doc["parse"] == {"filesFound": 1, "filesRead": 1, "filesSkipped": 0, "linesRead": 8, "eventsExtracted": 8, "linesSkipped": 0, "duplicatesRemoved": 1, "outOfScope": {"events": 1, "tokens": 110}}
    assert doc["ok"] and doc["unknownModels"] == ["mystery"] and [(c["name"], c["status"]) for c in doc["checks"] if c["status"] != "ok"] == [("models", "warn")]
    assert doc["adapters"][0] == {"id": "claude-code", "root": logs, "files": 1, "bytes": os.path.getsize(f"{logs}/projects/p/s.jsonl"), "schemaVerified": True}
    assert json.loads(sinks.to_json(told))["schemaVersion"] == 1
    assert "cache reads" in text_reports.summary(told) and "b.py" in text_reports.show(show) and "r1: $" in text_reports.range_(span) and "-93.0%" in text_reports.reprice(again)
    with pytest.raises(UserError):
        eng.range("HEAD")
    with pytest.raises(UserError):
        eng.reprice("nothing")


def pull(*oids):
    return {"number": 7, "title": "t", "baseRefName": "main", "headRefName": "x", "commits": [{"oid": o} for o in oids]}


HEAD = {"schemaVersion", "command", "costledger", "repoRoot", "plan", "pricing", "invariant", "warnings"}
BUCKET = {"cost", "tokens", "sessions"}


def test_json_shapes(spark, world):
    """The keys that scripts read, command by command."""
    repo, logs, a, b = world
    eng = Engine.build(spark, repo.path, {"claude-code": logs}, PRICES)
    told = eng.summary()
    assert set(told) == HEAD | {"scope", "totals", "byModel", "cacheEfficiency", "waste", "inProgress", "overhead", "covered"}
    assert set(told["invariant"]) == {"ok", "totalTokens", "attributed", "waste", "overhead", "outOfScope", "deltaTokens"} and told["pricing"] == {"asOf": "2026-01-01", "origin": "bundled"}
    assert set(told["waste"]) == set(told["inProgress"]) == BUCKET and set(told["totals"]) == {"cost", "costBreakdown", "tokens", "events", "unpricedEvents", "unpricedTokens"}
    assert sum(told["invariant"][k] for k in ("attributed", "waste", "overhead", "outOfScope")) == told["invariant"]["totalTokens"]
    log = eng.log()
    assert set(log) == HEAD | {"range", "maxCount", "inProgress", "commits", "totals"} and set(log["inProgress"]) == BUCKET | {"events", "newestTs"} and log["inProgress"]["newestTs"] == "2026-01-03T12:00:00.000Z"
    assert {"hash", "date", "subject", "cost", "confidence", "models", "sessions", "events", "tokens"} <= set(log["commits"][0]) and log["commits"][0]["tokens"]["total"] == 110
    span = eng.range(f"{a}..{b}")
    assert set(span) == HEAD | {"range", "label", "headline", "totals", "byModel", "commits", "span", "waste", "overhead", "revListCommits"} and set(span["overhead"]) == BUCKET
    again = eng.reprice("boreal")
    assert set(again) == HEAD | {"target", "scope", "repriced", "measured", "deltaPct", "cacheFallback", "label"} and again["measured"]["unpricedTokens"]["input"] == 7 and again["scope"]["tokens"]["total"] == told["totals"]["tokens"]["total"]
    show = eng.show(b)
    assert set(show["unpricedTokens"].values()) == {0} and {"ref", "commit", "attributed", "sessions", "byModel", "subagents", "evidence", "adoptedEvents", "advisoryEvents", "filesMatched"} <= set(show)
    out = eng.report(f"{repo.path}/../LEDGER.md")
    assert set(out) == HEAD | {"out", "commits"} and out["commits"] == 2
    text = open(out["out"], encoding="utf-8").read()
    for fact in ("prices: 2026-01-01 (bundled)", "**measured**", "| tokens | input |", "Provenance of the calls: 5 measured, 0 repriced, 1 advisory.", "Not priced: 7 tokens of 1 calls", "## Method", "in progress"):
        assert fact in text, fact
    with pytest.raises(FileExistsError):
        eng.report(out["out"])
    assert eng.short_models() == {"atlas-4": "atlas-4", "mystery": "mystery"} and "human?" in eng.log_text(span=f"{b}..{b}") + "human?"
    eng.ledger.rows = eng.ledger.rows.where("id <> 'm2:q2'")
    assert eng.summary()["accountingMismatch"] == {"tokens": 110}


def test_default_places(spark, tmp_path, monkeypatch):
    repo = Repo(f"{tmp_path}/repo")
    repo.commit("first", "2026-01-01T10:00:00+00:00", "a.py")
    write(f"{tmp_path}/home/.claude/projects/p/s.jsonl", [used(repo, 1, "2026-01-01T09:00:00Z")])
    write(f"{tmp_path}/other/projects/p/s.jsonl", [used(repo, i, "2026-01-01T09:00:00Z") for i in (1, 2)])
    history = ["# aider chat started at 2026-01-01 09:00:00", "> Model: atlas-4 with diff edit format", "> Tokens: 100 sent, 10 received."]
    for path in (f"{repo.path}/.aider.chat.history.md", f"{tmp_path}/more.md"):
        write(path, history)
    monkeypatch.setenv("HOME", f"{tmp_path}/home")
    monkeypatch.setenv("COSTLEDGER_AIDER_HISTORY", f"{tmp_path}/more.md")
    count = lambda eng: {r["id"]: r["files"] for r in eng.doctor()["adapters"]}
    eng = Engine.build(spark, repo.path, None, PRICES)
    assert count(eng) == {"claude-code": 1, "codex": 0, "gemini-cli": 0, "aider": 2}
    assert [c["name"] for c in eng.doctor()["checks"] if c["status"] == "warn"] == ["adapter codex", "adapter gemini-cli", "aider precision"]
    monkeypatch.setenv("COSTLEDGER_CLAUDE_DIR", f"{tmp_path}/other")
    assert Engine.build(spark, repo.path, {"claude-code": None}, PRICES).summary()["totals"]["events"] == 2
    assert Engine.build(spark, repo.path, {"claude-code": f"{tmp_path}/home/.claude"}, PRICES).summary()["totals"]["events"] == 1


def test_first_adapter_claims_a_file(spark):
    usage = spark.createDataFrame([("f", "codex", 1), ("f", "claude-code", 2), ("g", "codex", 3)], "source_file string, agent string, n int")
    kept, stats = adapters.claimed(usage, usage, ["claude-code", "codex"])
    assert {r.n for r in kept.collect()} == {r.n for r in stats.collect()} == {2, 3}


def test_notes_and_pr(spark, world):
    repo, logs, a, b = world
    repo.git("notes", "add", "-m", "mine", a)
    eng = Engine.build(spark, repo.path, {"claude-code": logs}, PRICES)
    assert eng.notes()["synced"] == sorted([a, b])
    before = repo.git("rev-parse", sinks.NOTES_REF)
    assert eng.notes()["synced"] == sorted([a, b]) and repo.git("rev-parse", sinks.NOTES_REF) == before
    note = json.loads(sinks.read_note(repo.path, b))
    assert note["tokens"] == {"input": 100, "output": 10, "cacheWrite": 0, "cacheRead": 0, "total": 110} and note["provenance"] == "measured"
    assert eng.notes(clear=True)["cleared"] == sorted([a, b]) and repo.git("notes", "show", a) == "mine"
    comments = []

    def forge(method, path, data):
        if method == "GET":
            return comments
        if method == "POST":
            comments.append({"id": 1, **data})
        else:
            comments[0].update(data)

    assert eng.pr(pull(b, "absent"), forge)["comment"] == "created" and eng.pr(pull(b, "absent"), forge)["comment"] == "unchanged"
    out = eng.pr(pull(a, b, "absent"), forge)
    assert out["comment"] == "updated" and len(comments) == 1 and [c["hash"] for c in out["byCommit"]] == [a, b, "absent"] and out["byCommit"][2] == {"hash": "absent", "inScope": False, "cost": None, "tokens": 0}
    assert out["pr"] == {"number": 7, "title": "t", "base": "main", "head": "x", "commits": 3, "commitsInScope": 2} and out["tokens"]["total"] == sum(c["tokens"] for c in out["byCommit"]) and eng.pr(pull(a))["comment"] is None
    with pytest.raises(UserError):
        eng.pr({"number": 7})


def test_window_and_tamper(spark, world):
    repo, logs, a, b = world
    flags = Flags(since=sinks.parse_date("2026-01-01T09:05:00Z", 0), until=sinks.parse_date("2026-01-01T23:00:00Z", 0))
    eng = Engine.build(spark, repo.path, {"claude-code": logs}, PRICES, flags=flags)
    assert eng.summary()["totals"]["events"] == 3 and eng.summary()["invariant"]["ok"] and [c["hash"] for c in eng.log()["commits"]] == [a]
    eng.ledger.rows = eng.ledger.rows.where("id <> 'm2:q2'")
    check = eng.check()
    assert not check["ok"] and check["mismatch_tokens"] == 110 and sinks.exit_code(check, True) == 3 and sinks.exit_code(check, False) == 0


def test_branches_and_merges(spark, tmp_path):
    repo = Repo(f"{tmp_path}/repo")
    repo.commit("root", "2026-01-01T00:00:00Z", "r")
    repo.git("checkout", "-q", "-b", "x")
    x = repo.commit("x", "2026-01-02T00:00:00Z", "x.py")
    repo.git("checkout", "-q", "main")
    y = repo.commit("y", "2026-01-02T01:00:00Z", "y.py")
    repo.git("merge", "-q", "--no-ff", "-m", "merge", "x", when="2026-01-03T00:00:00Z")
    rows = [used(repo, 1, "2026-01-01T10:00:00Z", files=["x.py"], gitBranch="x", sessionId="A"), used(repo, 2, "2026-01-01T10:00:00Z", files=["y.py"], sessionId="B")]
    write(f"{tmp_path}/logs/projects/p/s.jsonl", rows)
    eng = Engine.build(spark, repo.path, {"claude-code": f"{tmp_path}/logs"}, PRICES, all_refs=True)
    got = {c["hash"]: c["events"] for c in eng.log()["commits"]}
    assert got[x] == got[y] == 1 and sum(got.values()) == 2 and len(got) == 4


def test_empty_repository(spark, tmp_path):
    repo = Repo(f"{tmp_path}/repo")
    write(f"{tmp_path}/logs/projects/p/s.jsonl", [used(repo, 1, "2026-01-01T10:00:00Z", files=["x.py"])])
    eng = Engine.build(spark, repo.path, {"claude-code": f"{tmp_path}/logs"}, PRICES)
    assert eng.log()["commits"] == [] and eng.summary()["inProgress"]["sessions"] == 1


def test_incremental_is_cold(spark, tmp_path):
    logs, store = f"{tmp_path}/logs/projects", f"{tmp_path}/store"
    u = lambda i, s: call({"input_tokens": i}, requestId=f"q{i}", sessionId=s)
    path = f"{logs}/p/a.jsonl"

    def same():
        ingest.update(spark, "claude-code", logs, store)
        warm, _ = ingest.events(spark, "claude-code", store)
        cold, _ = claude.read(spark, f"{tmp_path}/logs")
        got = lambda df: sorted((r.id, r.input, r.line_no, os.path.basename(r.source_file)) for r in df.collect())
        assert got(warm) == got(cold)
        return len(got(warm))

    write(path, [u(1, "s"), "bad"], tail='{"type":')
    assert same() == 1 and same() == 1
    with open(path, "a") as f:
        f.write('"user"}\n' + json.dumps(u(2, "s")) + "\n")
    write(f"{logs}/p/b.jsonl", [u(3, "t")])
    assert same() == 3
    write(path, [u(9, "s")])
    os.utime(path, (2_000_000_000, 2_000_000_000))
    assert same() == 2
    with open(path, "a") as f:
        f.writelines(json.dumps(u(i, "s")) + "\n" for i in (4, 5, 6))
    assert same() == 5
    write(path, [u(7, "s")])  # restored with an older time stamp
    os.utime(path, (1_000_000_000, 1_000_000_000))
    assert same() == 2
    os.remove(f"{logs}/p/b.jsonl")
    assert same() == 1
    write(f"{logs}/p/b.jsonl", [u(8, "t")])  # back again, older than before
    os.utime(f"{logs}/p/b.jsonl", (1_000_000_000, 1_000_000_000))
    assert same() == 2
    write(path, [])
    assert same() == 1
    with open(f"{store}/v{ingest.VERSION}/claude-code/seal.json", "w") as f:
        f.write("{}")
    assert same() == 1  # a damaged store is built anew


def test_config(tmp_path):
    assert load_config(str(tmp_path)).attribution.horizon_days == 14
    write(f"{tmp_path}/.costledger.json", [{"plan": "gold", "attribution": {"horizonDays": 3, "graceSeconds": -1, "weights": {"file": 1}}, "adapters": ["codex", "x"], "more": 1}])
    got = load_config(str(tmp_path))
    assert got.plan is None and got.attribution.horizon_days == 3 and got.attribution.grace_seconds == 120 and got.attribution.weight_file == 1 and got.adapters == ("codex",) and len(got.warnings) == 4
    write(f"{tmp_path}/.costledger.json", ["[]"])
    assert load_config(str(tmp_path)).warnings


def test_formats():
    assert [sinks.format_tokens(n) for n in (0, 9999, 10000, 999_949, 999_950, 3_200_000, 999_960_000)] == ["0", "9,999", "10.0k", "999.9k", "1.0M", "3.2M", "1.0B"]
    assert [sinks.format_tokens(n) for n in (10_250, 10_249, 1_250_000, 1_234_500_000_000)] == ["10.3k", "10.2k", "1.3M", "1,234.5B"]
    assert sinks.format_bytes(1023) == "1023 B" and sinks.format_bytes(1536) == "1.5 KB" and sinks.format_bytes(5 * 2**30) == "5.0 GB"
    assert money.format_usd(-1_234_565_000_000) == "-$1,234.56" and money.format_usd(1_234_575_000_000) == "$1,234.58" and money.usd_string(5_000_001) == "0.01"
    assert sinks.table([("a", "right"), ("b", "left")], [["1", "x"], ["22", ""]]) == " a  b\n--  -\n 1  x\n22"
    now = 1_767_225_600_000 + 5_000_000
    assert sinks.parse_date("today", now) == 1_767_225_600_000 and sinks.parse_date("2 months ago", now) == now - 60 * 86_400_000 and sinks.parse_date("2026-01-01", now) == 1_767_225_600_000
    with pytest.raises(ValueError):
        sinks.parse_date("whenever", now)
    assert sinks.iso_utc(1) == "1970-01-01T00:00:00.001Z" and sinks.truncate("abcdef", 4) == "abc…" and sinks.local_time(0, "Asia/Tokyo") == "1970-01-01 09:00:00 +09:00" and sinks.local_time(1500, "UTC") == "1970-01-01 00:00:01 +00:00"
