import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from costledger.functions.paths import collapse_rename, normalise, resolve
from costledger.sources import aider, claude, codex, gemini, gitlog, lines, prices
from costledger.sources.usage import canonical_json


def write(path, rows, tail=""):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        for r in rows:
            f.write((r if isinstance(r, bytes) else (r if isinstance(r, str) else json.dumps(r)).encode()) + b"\n")
        f.write(tail.encode())


def events(df):
    return [r.asDict() for r in df.orderBy("source_file", "line_no", "sub_no").collect()]


def stats(df):
    return {os.path.basename(r.source_file): (r.lines_read, r.events_extracted, r.lines_skipped, r.bytes_consumed) for r in df.collect()}


# --- lines ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("split", [1, 3, 7, 1000])
def test_lines_in_splits(monkeypatch, split):
    monkeypatch.setattr(lines, "BLOCK", 5)
    data = b"ab\n\ncdefgh\r\n" + b"x" * 40 + b"\nlast\ntail"
    read_at = lambda n, at: data[at : at + n]
    got = [x for a in range(0, len(data), split) for x in lines.iter_lines(read_at, a, min(a + split, len(data)), len(data), 20)]
    assert got == [(0, 3, "ok", b"ab"), (3, 1, "ok", b""), (4, 8, "ok", b"cdefgh\r"), (12, 41, "oversized", b""), (53, 5, "ok", b"last"), (58, 4, "truncated", b"")]
    assert lines.complete_until(read_at, len(data)) == 58 and lines.complete_until(read_at, 0) == 0


def test_line_source(spark, tmp_path):
    write(f"{tmp_path}/a/one.jsonl", ["x", "", "y\r", b"\xff\xfe"], tail="open")
    write(f"{tmp_path}/b.txt", ["no"])
    got = lines.read_lines(spark, str(tmp_path), splitBytes="3").orderBy("offset").collect()
    assert [(r.offset, r.status, r.text) for r in got] == [(0, "ok", "x"), (3, "ok", "y"), (6, "ok", "��"), (9, "truncated", None)]
    assert lines.read_lines(spark, f"{tmp_path}/none").collect() == []


# --- claude-code form -------------------------------------------------------------------------------


def call(usage, **more):
    message = {"id": "m1", "model": "atlas-4", "usage": usage, "content": [{"type": "text", "text": "[sanitized]"}]}
    message.update(more.pop("message", {}))
    return {"type": "assistant", "sessionId": "s1", "timestamp": "2026-01-01T00:00:00.000Z", "cwd": "/r", "gitBranch": "main", "requestId": "q1", "message": message, **more}


def drop(record, *keys):
    return {k: v for k, v in record.items() if k not in keys}


def test_claude(spark, tmp_path):
    top = {"input_tokens": 10, "output_tokens": 5, "cache_creation_input_tokens": 2, "cache_read_input_tokens": 3}
    edit = lambda name, **i: {"type": "tool_use", "name": name, "input": i}
    blocks = [edit("Edit", file_path="/r/a"), edit("Read", file_path="/r/no"), edit("NotebookEdit", notebook_path="/r/n"), edit("Write", file_path="/r/a"), edit("Write", file_path=7), "text", None]
    bare = {"z": 1.0, "input_tokens": 4, "a": {"c": "é", "b": [1, 2.5, None]}}
    rows = [
        call(top, message={"content": blocks}),
        call({**top, "iterations": [{"input_tokens": 11}, top]}, requestId="q2", isSidechain=True),
        call({"input_tokens": 0, "iterations": [{"input_tokens": 7, "output_tokens": 1, "type": "message"}, {"cache_read_input_tokens": 2}]}, requestId="q3"),
        drop(call(bare), "requestId"),
        {"type": "user", "message": 3},
        call(None),
        call(top, message={"model": "<synthetic>"}),
        call(top, message={"model": ""}),
        call({"input_tokens": 3.5}), call({"input_tokens": -1}), call({"input_tokens": "7"}), call({"input_tokens": 2**53}), call({"input_tokens": None}),
        call(top, isSidechain=None), call(top, requestId=None), call(top, timestamp="soon"), call(top, message={"id": 4}),
        call({"iterations": [{"input_tokens": 1.5}]}), call({"iterations": None}, requestId="q4", cwd=None, gitBranch=None),
        "not json", "[1]", '{"type": 3}',
        '{"type": "assistant", "type": "user"}',
    ]
    write(f"{tmp_path}/projects/p/deep/s.jsonl", rows, tail='{"type": "assist')
    found, told = claude.read(spark, str(tmp_path))
    got = events(found)
    ident = "s1:2026-01-01T00:00:00.000Z:" + hashlib.sha256('{"a":{"b":[1,2.5,null],"c":"é"},"input_tokens":4,"z":1}'.encode()).hexdigest()[:16]
    assert [e["id"] for e in got] == ["m1:q1", "m1:q2", "m1:q3", ident, "m1:q4"]
    assert [(e["input"], e["output"], e["cache_write"], e["cache_read"]) for e in got] == [(10, 5, 2, 3), (10, 5, 2, 3), (7, 1, 0, 2), (4, 0, 0, 0), (0, 0, 0, 0)]
    assert got[0]["edited_files"] == ["/r/a", "/r/n"] and got[0]["ts_ms"] == 1767225600000 and got[1]["is_sidechain"] and got[4]["cwd"] is None
    size = os.path.getsize(f"{tmp_path}/projects/p/deep/s.jsonl")
    assert stats(told) == {"s.jsonl": (24, 5, 15, size - 16)}


def test_canonical_json():
    assert canonical_json('{"b": 1.0, "a": [true, null, {"d": "x", "c": 1.50}]}') == '{"a":[true,null,{"c":1.5,"d":"x"}],"b":1}'


# --- codex form -------------------------------------------------------------------------------------


def test_codex(spark, tmp_path):
    stamp = lambda i: f"2026-01-01T00:00:{i:02d}.000Z"
    line = lambda i, t, p: {"timestamp": stamp(i), "type": t, "payload": p}
    count = lambda i, **info: line(i, "event_msg", {"type": "token_count", "info": info or None})
    use = lambda a, c, o: {"input_tokens": a, "cached_input_tokens": c, "output_tokens": o}
    func = lambda name, args: line(0, "response_item", {"type": "function_call", "name": name, "arguments": args if isinstance(args, str) else json.dumps(args)})
    patch = lambda *paths: "*** Begin Patch\n" + "".join(f"*** Update File: {p}\n+x\n" for p in paths)
    rows = [
        func("apply_patch", {"input": patch("rel/dropped", "/abs/kept")}),
        count(1, last_token_usage=use(10, 30, 5)),
        line(2, "session_meta", {"id": "S", "cwd": "/w", "git": {"branch": "dev"}, "source": {"subagent": "x"}}),
        line(3, "turn_context", {"model": "atlas-4", "cwd": ""}),
        func("shell", {"command": ["apply_patch", patch("a.py", "../b.py")]}),
        count(4),
        line(5, "event_msg", {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 1.5}}}),
        func("exec_command", {"cmd": "apply_patch <<'E'\n" + patch("./c.py", "a.py") + "E"}),
        count(6, total_token_usage=use(100, 40, 20)),
        count(7, total_token_usage=use(150, 30, 25)),
        line(8, "turn_context", {"cwd": "/other", "model": None}),
        func("apply_patch", {"input": patch("d.py")}),
        func("apply_patch", "{bad"), func("shell", {"command": "ls"}), func("apply_patch", {"input": 3}), func("other", "{bad"),
        line(9, "session_meta", {"id": "S2", "git": False, "source": "cli"}),
        line(9, "session_meta", {"id": 5}),
        {"timestamp": "never", "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": use(1, 0, 0)}}},
        count(10, last_token_usage=use(9, 4, 3), total_token_usage=use(200, 60, 40)),
        count(11, total_token_usage=use(203, 61, 41)),
        {"type": "unknown"}, "[]", "{",
    ]
    write(f"{tmp_path}/sessions/2026/rollout-1.jsonl", rows)
    found, told = codex.read(spark, str(tmp_path))
    got = events(found)
    assert [(e["input"], e["output"], e["cache_read"]) for e in got] == [(0, 5, 30), (60, 20, 40), (50, 5, 0), (5, 3, 4), (2, 1, 1)]
    assert [e["edited_files"] for e in got] == [["/abs/kept"], ["/w/a.py", "/b.py", "/w/c.py"], [], ["/other/d.py"], []]
    path = got[0]["source_file"]
    assert [e["session_id"] for e in got] == [path, "S", "S", "S2", "S2"] and [e["model"] for e in got] == ["", *["atlas-4"] * 4]
    assert [e["git_branch"] for e in got] == [None, "dev", "dev", None, None] and [e["is_sidechain"] for e in got] == [False, True, True, False, False]
    assert got[1]["id"].startswith(f"S:{stamp(6)}:") and [e["cwd"] for e in got] == [None, "/w", "/w", "/other", "/other"]
    assert stats(told)["rollout-1.jsonl"][:3] == (24, 5, 7)


# --- gemini form ------------------------------------------------------------------------------------


def test_gemini(spark, tmp_path, monkeypatch):
    say = lambda i, **m: {"id": i, "timestamp": "2026-01-01T00:00:00Z", "type": "gemini", "model": "cirrus", "tokens": {"input": 10, "cached": 4, "output": 2, "thoughts": 3, "tool": 9}, **m}
    calls = [{"name": "replace", "args": {"file_path": "src/a"}}, {"name": "write_file", "args": {"file_path": "/x/b"}}, {"name": "read", "args": {"file_path": "/no"}}, {"name": "replace", "args": None}, 5]
    rows = [
        {"sessionId": "G", "kind": "main"}, say("1", toolCalls=calls), say(2), {"$rewindTo": "1"},
        {"$set": {"messages": [say("1"), {"type": "user"}, say("3"), say("4", tokens={"input": -1})]}},
        {"$set": {"messages": None}}, {"$set": 4}, {"sessionId": "late"}, say("5", model=""), say("", model="cirrus"), say("6", tokens=None), {"type": "info"}, "[]", "no",
    ]
    root = f"{tmp_path}/gem"
    write(f"{root}/tmp/slug/chats/c.jsonl", rows)
    write(f"{root}/tmp/slug/chats/parent/sub.jsonl", [say("7")], tail="x")
    write(f"{root}/tmp/other/chats/o.jsonl", [{"sessionId": "", "kind": "sub"}, say("8", toolCalls=calls)])
    write(f"{root}/tmp/slug/.project_root", ["/marker"])
    write(f"{root}/projects.json", [{"projects": {"/zz": "other", "/aa": "other", "rel": "other"}}])
    write(f"{root}/tmp/slug/chats/old.json", [{"sessionId": "L", "messages": [say("9"), {"type": "gemini", "tokens": {}}, 3]}])
    write(f"{root}/tmp/slug/chats/bad.json", ["{"])
    found, told = gemini.read(spark, root)
    got = {(os.path.basename(e["source_file"]), e["id"], e["sub_no"]): e for e in events(found)}
    assert set(got) == {("c.jsonl", "G:1", 0), ("c.jsonl", "G:2", 0), ("c.jsonl", "G:3", 1), ("sub.jsonl", "sub:7", 0), ("o.jsonl", "o:8", 0), ("old.json", "L:9", 0)} | {("c.jsonl", "G:1", 0)}
    first = next(e for e in events(found) if e["id"] == "G:1" and e["edited_files"])
    assert first["edited_files"] == ["/marker/src/a", "/x/b"] and (first["input"], first["output"], first["cache_read"]) == (6, 5, 4)
    assert got["sub.jsonl", "sub:7", 0]["is_sidechain"] and got["o.jsonl", "o:8", 0]["cwd"] == "/aa" and got["o.jsonl", "o:8", 0]["is_sidechain"]
    files = {os.path.basename(r.source_file): r for r in gemini.read(spark, f"file://{root}")[1].collect()}
    assert len(files) == 5 and all(r.source_file.startswith("file:///") for r in files.values())
    monkeypatch.setattr(gemini, "MAX_DOCUMENT_BYTES", os.path.getsize(f"{root}/tmp/slug/chats/old.json"))
    few, refused = gemini.read(spark, root)
    assert "L:9" not in {e["id"] for e in events(few)} and [os.path.basename(r.source_file) for r in refused.where("refused").collect()] == ["old.json"]
    told = stats(told)
    assert told["c.jsonl"][:3] == (14, 4, 6) and told["sub.jsonl"][:3] == (2, 1, 1) and told["old.json"][:3] == (4, 1, 2) and told["bad.json"][:3] == (1, 0, 1)


# --- aider form -------------------------------------------------------------------------------------


def test_aider(spark, tmp_path):
    rows = [
        "> Tokens: 5 sent, 5 received.", "# aider chat started at 2026-01-02 03:04:05", "> Main model: atlas-4 with diff edit format, cached", "> Weak model: no",
        "> Applied edit to early.py", "> Tokens: 4.2k sent, 1k cache write, 500 cache hit, 99 received. Cost: $1", "> Applied edit to late.py", "> Applied edit to late.py",
        "Tokens: 12k sent, 2.5 received.", "Tokens: 12k sent, 7 received.", "# aider chat started at 2026-02-30 00:00:00", "> Model: p/boreal-2 with whole edit format", "> Applied edit to x/../y.py",
        "# aider chat started at 2026-01-02 03:04:05", "> Tokens: 1 sent, 2 received.",
    ]
    write(f"{tmp_path}/.aider.chat.history.md", rows)
    found, told = aider.read(spark, str(tmp_path))
    got = events(found)
    base = "aider:1767323045000"
    assert [e["id"] for e in got] == [f"{base}:0:0", f"{base}:0:1", f"{base}:1:0"]
    assert [(e["input"], e["output"], e["cache_write"], e["cache_read"]) for e in got] == [(2700, 99, 1000, 500), (12000, 7, 0, 0), (1, 2, 0, 0)]
    assert [e["model"] for e in got] == ["atlas-4", "atlas-4", "p/boreal-2"]
    assert [[p.removeprefix(str(tmp_path)) for p in e["edited_files"]] for e in got] == [["/early.py", "/late.py"], ["/y.py"], []]
    assert list(stats(told).values())[0][:3] == (15, 3, 3)


def test_aider_counts(spark):
    df = spark.createDataFrame([("999",), ("4.2k",), ("12k",), ("1.23456k",), ("2.5",), ("k",)], "t string")
    assert [r[0] for r in df.select(aider.token_count(F.col("t"))).collect()] == [999, 4200, 12000, 1234, None, None]


# --- git and prices ---------------------------------------------------------------------------------


def test_git_log(spark):
    f = "\x1f"
    log = (
        f"noise\x1eh1{f}p1 p2{f}2026-01-02T00:00:00+00:00{f}merge{f}refs/heads/main\n1\t1\tignored\n"
        f"\x1eh2{f}p1{f}2026-01-01T01:00:00+01:00{f}subject: a{f}refs/heads/feat/x\n3\t1\tsrc/{{old => new}}/a.ts\n-\t-\timg.png\n2\t0\tb => c\n1\t0\tsrc/{{x => }}/y\n1\t1\t\"q\\303\\244\\\"t\"\nodd\n"
        f"\x1eh3{f}{f}2026-01-01T00:00:00Z{f}root{f}refs/tags/v1\n\x1e{f}{f}{f}\x1eh4{f}p{f}never{f}x"
    )
    got = gitlog.parse_log(gitlog.records(spark, log), True).orderBy("enum_pos").collect()
    assert [(r.hash, r.is_merge, r.branch_hint, r.files, r.insertions, r.deletions) for r in got] == [
        ("h1", True, "main", [], 0, 0), ("h2", False, "feat/x", ["src/new/a.ts", "img.png", "c", "src/y", 'qä"t'], 7, 2), ("h3", False, None, [], 0, 0),
    ]
    assert got[1].author_ts_ms == got[2].author_ts_ms == 1767225600000 and got[2].parents == []


def test_paths(spark):
    df = spark.createDataFrame([("/a//b/./../c/", "../x", "p/{a => b}/q"), ("/", "/y/..", "a => b"), ("/..", "z", "plain")], "a string, b string, c string")
    got = df.select(normalise(F.col("a")), resolve(F.lit("/w/d"), F.col("b")), collapse_rename(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("/a/c", "/w/x", "p/b/q"), ("/", "/", "b"), ("/", "/w/d/z", "plain")]


def test_prices(spark, tmp_path):
    good = {"schemaVersion": 1, "asOf": "2026-01-01", "source": "x", "models": {"m": {"displayName": "M", "inputPerMTok": "5", "outputPerMTok": "0.25"}}}
    path = f"{tmp_path}/p.json"
    write(path, [{**good, "more": 1}])
    frame, origin, warned = prices.load(spark, good, path)
    assert origin == {"asOf": "2026-01-01", "origin": "refreshed"} and len(warned) == 1 and frame.count() == 1
    write(path, [{**good, "models": {"m": {"displayName": "M", "inputPerMTok": "-5", "outputPerMTok": "1"}}}])
    assert prices.load(spark, good, path)[1]["origin"] == "bundled"
    assert [prices.per_million(x) for x in (1.5e-5, 3e-6, 4.35e-7, 0, 1e-16)] == ["15", "3", "0.435", "0", "0"] and prices.per_million(5.5e-16) == "0.000000001"
    row = lambda **k: {"litellm_provider": "openai", "mode": "chat", "input_cost_per_token": 1e-6, "output_cost_per_token": 2e-6, **k}
    feed = {"gpt-9": row(cache_read_input_token_cost=-1), "azure/gpt-9": row(), "o3": row(mode="image"), "claude-x": row(litellm_provider="anthropic"), "gemini/gemini-1": row(litellm_provider="gemini"), "qq/qwen-coder": row(litellm_provider="alibaba"), "sample_spec": row(), "gpt-bad": row(input_cost_per_token="1"), "gpt-none": {"litellm_provider": "openai", "mode": "chat"}}
    got = prices.convert_feed(feed)
    assert set(got) == {"gpt-9", "claude-x", "gemini-1", "qwen-coder"} and "cacheReadPerMTok" not in got["gpt-9"]
    prices.refresh(f"{tmp_path}/new/t.json", lambda: feed, "2026-01-02", "feed")
    assert prices.load(spark, good, f"{tmp_path}/new/t.json")[1] == {"asOf": "2026-01-02", "origin": "refreshed"}
    with pytest.raises(prices.PriceError):
        prices.refresh(f"{tmp_path}/new/t.json", dict, "2026-01-02", "feed")
