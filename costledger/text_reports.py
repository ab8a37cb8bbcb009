"""The JSON reports as plain text."""

from __future__ import annotations

from . import sinks

MARKS = {True: {"high": "●", "medium": "◐", "low": "○", None: "·human?"}, False: {"high": "*", "medium": "~", "low": ".", None: "human?"}}
#: Rows of evidence and of files that ``show`` lists; the JSON report has all.
EVIDENCE_ROWS, FILE_ROWS = 12, 20


def confidence_mark(level: str | None, color: bool = False) -> str:
    """A sign for each level, ASCII unless the terminal is known to take more."""
    return MARKS[color].get(level, MARKS[color]["low"])


def plan_suffix(plan: str | None) -> str:
    """Wording only; a plan never changes a figure."""
    return f" (plan {plan}: {sinks.PLAN_NOTE})" if plan else ""


def _usd(money: dict | None) -> str:
    return "$—" if money is None else sinks.format_usd(int(money["nanoUsd"]))


def _tokens(t: dict) -> str:
    parts = ", ".join(f"{name} {sinks.format_tokens(t[key])}" for name, key in (("input", "input"), ("output", "output"), ("cache write", "cacheWrite"), ("cache read", "cacheRead")))
    return f"{sinks.format_tokens(t['total'])} ({parts})"


def _invariant(report: dict) -> str:
    i = report["invariant"]
    return sinks.invariant_line({"ok": i["ok"], "raw_tokens": i["totalTokens"], "mismatch_tokens": i["deltaTokens"]})


def _models(rows: list[dict]) -> str:
    columns = [("model", "left"), ("events", "right"), ("tokens", "right"), ("cost", "right")]
    return sinks.table(columns, [[m.get("displayName") or m["model"] or "(unknown)", str(m["events"]), sinks.format_tokens(m["tokens"]["total"]), _usd(m["cost"])] for m in rows])


def summary(r: dict) -> str:
    t, c = r["totals"], r["cacheEfficiency"]
    span = ", ".join(f"{k} {v}" for k, v in r["scope"].items() if v) or "all history"
    out = [f"scope: {span}", f"total: {_usd(t['cost'])}{plan_suffix(r['plan'])}", f"tokens: {_tokens(t['tokens'])}"]
    if t["unpricedTokens"]["total"]:
        out.append(f"not priced: {sinks.format_tokens(t['unpricedTokens']['total'])} tokens of {t['unpricedEvents']} calls to unknown models")
    out += ["", _models(r["byModel"]), ""]
    if c["pctOfInputVolume"] is not None:
        out.append(f"cache reads: {c['pctOfInputVolume']}% of the input, {_usd(c['savings'])} below its price ({c['label']})")
    out += [f"{name}: {_usd(r[key]['cost'])} in {r[key]['sessions']} sessions" for name, key in (("waste", "waste"), ("in progress", "inProgress"), ("overhead", "overhead"))]
    return "\n".join([*out, f"covered: {r['covered']['sessions']} sessions, {r['covered']['commits']} commits", _invariant(r)])


def show(r: dict, color: bool = False) -> str:
    c = r["commit"]
    out = [f"{c['shortHash']} {c['subject'] if c['inEnumeratedHistory'] else '(not in the history that was read)'}"]
    if c["inEnumeratedHistory"]:
        out.append(f"{c['date']}, {len(c['files'])} files, +{c['insertions']} -{c['deletions']}{', a merge: never costed' if c['isMerge'] else ''}")
    if not r["attributed"]:
        return "\n".join([*out, "no usage belongs to it; cost $0.00", _invariant(r)])
    p = r["provenance"]
    out += [f"cost: {_usd(r['cost']['total'])}{plan_suffix(r['plan'])}", f"tokens: {_tokens(r['tokens'])}", f"confidence: {confidence_mark(r['confidence'], color)} {r['confidence']}", f"events: {p['measured']} measured, {p['advisory']} advisory, {p['repriced']} repriced", ""]
    out += [sinks.table([("session", "left"), ("from", "left"), ("events", "right"), ("cost", "right")], [[s["idPrefix"], s["from"][:16], str(s["events"]), _usd(s["cost"])] for s in r["sessions"]]), "", _models(r["byModel"]), ""]
    if r["subagents"]["tokens"]:
        out += [f"subagents: {sinks.format_tokens(r['subagents']['tokens'])} tokens, {r['subagents']['sharePctOfTokens']}%", ""]
    score = lambda x: f"{x:.2f}"
    rows = [[e["ts"][:16], f"{e['matchedFiles']}/{e['editedFiles']}", score(e["fileScore"]), score(e["timeScore"]), score(e["branchScore"]), score(e["score"]), confidence_mark(e["confidence"], color)] for e in r["evidence"][:EVIDENCE_ROWS]]
    out.append(sinks.table([("time", "left"), ("files", "right"), ("file", "right"), ("time score", "right"), ("branch", "right"), ("score", "right"), ("conf", "left")], rows))
    if len(r["evidence"]) > EVIDENCE_ROWS:
        out.append(f"and {len(r['evidence']) - EVIDENCE_ROWS} more")
    files = [f"  + {f}" for f in r["filesMatched"]["matched"]] + [f"    {f}" for f in r["filesMatched"]["unmatched"]]
    out += [f"{r['adoptedEvents']} further events adopted these", "", f"files edited: {len(r['filesMatched']['matched'])}/{len(c['files'])}", *files[:FILE_ROWS], *([f"  and {len(files) - FILE_ROWS} more"] if len(files) > FILE_ROWS else [])]
    return "\n".join([*out, _invariant(r)])


def range_(r: dict, color: bool = False) -> str:
    h = r["headline"]
    out = [f"{r['label'] or r['range']}: {_usd(h['cost'])}{plan_suffix(r['plan'])} for {h['commits']} commits, {h['sessions']} sessions", f"tokens: {_tokens(r['totals']['tokens'])}", "", _models(r["byModel"]), ""]
    rows = [[_usd(c["cost"]) if c["cost"] else "$0.00", confidence_mark(c["confidence"], color), c["shortHash"], c["date"], sinks.truncate(c["subject"], 48)] for c in r["commits"]]
    out.append(sinks.table([("cost", "right"), ("conf", "left"), ("hash", "left"), ("date", "left"), ("subject", "left")], rows))
    if r["span"]["from"]:
        out.append(f"between its first and last commit: waste {_usd(r['waste']['cost'])}, overhead {_usd(r['overhead']['cost'])}")
    return "\n".join([*out, _invariant(r)])


def reprice(r: dict) -> str:
    cost = r["repriced"]["cost"]
    out = [f"{r['target']['displayName']} ({r['target']['id']}): {_usd(cost['total'])} for {sinks.format_tokens(r['scope']['tokens']['total'])} tokens of {r['scope']['events']} calls"]
    out.append(f"measured: {_usd(r['measured']['cost'])}{'' if r['deltaPct'] is None else f', {r['deltaPct']}%'}")
    if r["cacheFallback"]:
        out.append("the target has no cache prices; cache tokens count at its input price")
    if r["measured"]["unpricedEvents"]:
        out.append(f"{r['measured']['unpricedEvents']} calls have no measured price but are in the repriced total")
    return "\n".join([*out, r["label"], _invariant(r)])
