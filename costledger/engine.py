"""The engine: sources in, one ledger, nine reports out."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .config import ADAPTERS, PLANS, VERSION, AttributionConfig, Flags, RepoConfig
from .functions.money import CLASSES, format_usd, money_json
from .operators import events, rollup, tables
from .plans import ledger as ledgers
from .plans import reports
from .plans.ledger import Ledger
from .sources import gitlog, prices
from .sources.adapters import ADAPTERS as SOURCES
from .sources.adapters import read_all

REPRICE_LABEL = "Repriced: the same tokens at the target's prices. Another model would have used other tokens."

LEGEND = (
    "**measured**: priced from the tokens of each call at its model's price. **repriced**: the same tokens at another model's price. "
    "**advisory**: the commit was found by time alone, or there is none."
)
BUCKET_NOTES = {"attributed": "taken by a commit", "waste": "edits that no commit took within the horizon", "in_progress": "newer than the newest commit, no waste yet", "overhead": "sessions without edits; advisory"}
METHOD = (
    "Only metadata of transcripts is read: token counts, model names, session ids, paths of edited files; no prompts, no answers. Each call is given to a "
    "commit by the files it edited, its time and its branch, and costs what its own tokens cost; nothing is estimated from the size of a change. Which commit "
    "takes a call is likely, not certain: see the confidence. What no commit took is listed as waste or overhead, and attributed, waste, overhead and out of scope "
    "must add up to all tokens that were read."
)


class UserError(ValueError):
    pass


def load_config(repo: str) -> RepoConfig:
    """``.costledger.json`` of a repository; what is wrong in it is left at its default, with a warning."""
    path, warned = os.path.join(repo, ".costledger.json"), []
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        if not isinstance(data, dict):
            raise ValueError("no object")
    except FileNotFoundError:
        return RepoConfig()
    except (OSError, ValueError) as e:
        return RepoConfig(warnings=(f"{path}: {e}; defaults are used",))
    plan = data.get("plan")
    if plan is not None and plan not in PLANS:
        warned.append(f"{path}: unknown plan {plan!r}")
        plan = None
    given, cfg = data.get("attribution", {}), {}
    names = {"horizonDays": "horizon_days", "graceSeconds": "grace_seconds"}
    for key, value in (given if isinstance(given, dict) else {}).items():
        fine = isinstance(value, (int, float)) and not isinstance(value, bool) and (value > 0 if key == "horizonDays" else value >= 0)
        if key in names and fine:
            cfg[names[key]] = value
        elif key == "weights" and isinstance(value, dict) and all(isinstance(w, (int, float)) and w >= 0 for w in value.values()):
            cfg |= {f"weight_{k}": w for k, w in value.items() if k in ("file", "time", "branch")}
        else:
            warned.append(f"{path}: attribution.{key} is not used")
    listed = data.get("adapters", list(ADAPTERS))
    chosen = tuple(a for a in ADAPTERS if isinstance(listed, list) and a in listed)
    if not isinstance(listed, list) or set(listed) - set(ADAPTERS):
        warned.append(f"{path}: unknown adapters are not used")
    warned += [f"{path}: unknown key {k!r}" for k in data if k not in ("plan", "attribution", "adapters")]
    return RepoConfig(plan, AttributionConfig(**cfg), chosen or ADAPTERS, tuple(warned))


@dataclass
class Engine:
    """Everything a report needs, built once; ``ledger.rows`` is a table."""

    spark: SparkSession
    repo: str
    ledger: Ledger
    stats: DataFrame
    config: RepoConfig
    flags: Flags = field(default_factory=Flags)
    warnings: tuple[str, ...] = ()
    pricing: dict = field(default_factory=dict)
    roots: dict = field(default_factory=dict)

    @classmethod
    def build(cls, spark: SparkSession, repo: str, roots: dict[str, str] | None, price_table: dict, user_prices: str | None = None, flags: Flags | None = None, all_refs: bool = False) -> Engine:
        """``roots``: agent -> folder of its logs, and only these agents are read; None reads all that the
        configuration names, from their default places."""
        repo = os.path.realpath(gitlog.repo_root(repo))
        config = load_config(repo)
        try:
            usage, stats, used = read_all(spark, config.adapters, roots, repo)
        except ValueError as e:
            raise UserError(str(e)) from e
        cards, pricing, warned = prices.load(spark, price_table, user_prices)
        # Bronze, silver, gold: each is a table, so that it is computed once and plans stay small.
        folder = tables.store(spark)
        usage, stats = tables.written(usage.withColumn("repo_id", F.lit(repo)), folder, "parsed"), tables.written(stats, folder, "stats")
        usage = tables.written(cls._in_repo(usage, repo), folder, "usage")
        led = ledgers.build(usage, gitlog.read(spark, repo, all_refs=all_refs), cards, F.lit(repo), config.attribution, folder)
        unknown = rollup.unpriced_models(led.rows).orderBy("model").collect()
        warned = [*config.warnings, *warned, *[f"unknown model {json.dumps(r.model)}: {r.events} events, {r.tokens} tokens are not priced" for r in unknown]]
        return cls(spark, repo, led, stats, config, flags or Flags(), tuple(warned), pricing, used)

    @staticmethod
    def _in_repo(usage: DataFrame, repo: str) -> DataFrame:
        """Working directories and edited paths made canonical, then relative to the repository.

        Links are resolved on the driver, once per distinct folder; a folder of the logs that is not
        there any more counts by its name."""
        folders = usage.select(F.col("cwd").alias("p")).union(usage.select(F.explode("edited_files").alias("q")).select(F.regexp_replace("q", "/[^/]*$", "")))
        spark = usage.sparkSession
        # The folders pass by one partition at a time, and only those that are links are kept.
        found = ((r.p, os.path.realpath(r.p)) for r in folders.distinct().where("p like '/%'").toLocalIterator())
        links = spark.createDataFrame([pair for pair in found if pair[0] != pair[1]], "p string, q string")
        moved = usage.join(links, usage.cwd == links.p, "left").withColumn("cwd", F.coalesce("q", "cwd")).drop("p", "q")
        key = ["source_file", "line_no", "sub_no", "id"]
        parts = moved.select(*key, F.posexplode("edited_files").alias("n", "f")).withColumn("d", F.regexp_replace("f", "/[^/]*$", ""))
        parts = parts.join(links, F.col("d") == F.col("p"), "left").withColumn("f", F.concat(F.coalesce("q", "d"), F.regexp_extract("f", "(/[^/]*)$", 1)))
        lists = parts.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "f"))), lambda s: s["f"]).alias("_files"))
        out = moved.join(lists, key, "left").withColumn("edited_files", F.coalesce("_files", "edited_files")).drop("_files")
        return out.withColumn("rel_files", events.relative_paths(F.col("edited_files"), F.lit(repo)))

    # --- reports ---

    def check(self):
        return reports.accounting(self.ledger).first()

    def _head(self, command: str, check) -> dict:
        return sinks.envelope(command, check, self.repo, self.plan, self.pricing, self.warnings)

    @property
    def plan(self) -> str | None:
        return self.flags.plan or self.config.plan

    def _span(self, span: str | None) -> DataFrame | None:
        return None if span is None else gitlog.rev_list(self.spark, self.repo, span).withColumn("repo_id", F.lit(self.repo))

    def _models(self, rows: DataFrame) -> list[dict]:
        names = rows.select("model", "display_name").distinct()
        found = reports.models(rows).join(names, "model", "left").orderBy(F.col("cost_total").desc(), "model").collect()
        return [{"model": r.model, "displayName": r.display_name, "priced": r.unpriced_events == 0, "events": r.events, "tokens": sinks.tokens_json(r), "cost": None if r.cost is None else money_json(int(r.cost))} for r in found]

    def _buckets(self, rows: DataFrame) -> dict[str, dict]:
        return {r.bucket: {"cost": money_json(int(r.cost_total)), "tokens": sinks.tokens_json(r), "sessions": r.sessions, "events": r.events, "newestTs": sinks.iso_utc(r.max_ts_ms)} for r in rollup.by_bucket(rows).collect()}

    def summary(self) -> dict:
        check, rows = self.check(), reports.scoped(self.ledger, self.flags)
        r = rows.agg(*rollup.measures(models=False), F.count_distinct("hash").alias("commits")).first()
        saved = rollup.cache_savings(rows).withColumn("pct", rollup.percent1(F.col("cache_read_tokens"), F.col("input_tokens") + F.col("cache_read_tokens"))).first()
        b = self._buckets(rows)
        return self._head("summary", check) | {
            "scope": {"since": sinks.iso_utc(self.flags.since), "until": sinks.iso_utc(self.flags.until)},
            "totals": {"cost": money_json(int(r.cost_total)), "costBreakdown": sinks.breakdown_json(r), "tokens": sinks.tokens_json(r), "events": r.events, "unpricedEvents": r.unpriced_events, "unpricedTokens": self._unpriced(rows)},
            "byModel": self._models(rows),
            "cacheEfficiency": {"cacheReadTokens": saved.cache_read_tokens, "inputTokens": saved.input_tokens, "pctOfInputVolume": saved.pct, "savings": money_json(int(saved.saved_nano)), "label": "measured"},
            "waste": sinks.bucket_json(b["waste"]), "inProgress": sinks.bucket_json(b["in_progress"]), "overhead": sinks.bucket_json(b["overhead"]),
            "covered": {"sessions": r.sessions, "commits": r.commits},
        }

    def _unpriced(self, rows: DataFrame) -> dict[str, int]:
        return sinks.tokens_json(rows.agg(*rollup.unpriced_tokens()).first())

    def log(self, span: str | None = None, limit: int | None = None) -> dict:
        if limit is not None and limit <= 0:
            raise UserError("the limit must be positive")
        check, rows = self.check(), reports.scoped(self.ledger, self.flags)
        order = self.ledger.commits.select("hash", "enum_pos")
        found = reports.log(self.ledger, self.flags, self._span(span)).join(order, "hash").orderBy("enum_pos")
        found = (found.limit(limit) if limit else found).collect()
        b = self._buckets(rows)
        total = sum(int(r.cost_total or 0) for r in found)
        commits = [
            {"hash": r.hash, "shortHash": r.hash[:7], "authorTs": r.author_ts_ms, "date": sinks.date_utc(r.author_ts_ms), "subject": r.subject, "attributed": r.events > 0, "cost": money_json(int(r.cost_total)) if r.events else None, "unpricedTokens": r.unpriced_tokens, "confidence": r.confidence, "models": r.models or [], "sessions": r.sessions, "events": r.events, "tokens": sinks.tokens_json(r) if r.events else None}
            for r in found
        ]
        totals = {"attributedCost": money_json(total), "commitsShown": len(found), "commitsCosted": sum(r.events > 0 for r in found), "waste": b["waste"]["cost"], "overhead": b["overhead"]["cost"], "inProgress": b["in_progress"]["cost"]}
        under_way = b["in_progress"] if b["in_progress"]["events"] else None
        return self._head("log", check) | {"range": span, "maxCount": limit, "inProgress": under_way, "commits": commits, "totals": totals}

    def show(self, ref: str) -> dict:
        check, commit = self.check(), gitlog.resolve_ref(self.repo, ref)
        t = reports.show(self.ledger, self.repo, commit, self.flags)
        rows = reports.scoped(self.ledger, self.flags).where((F.col("kind") == "commit") & (F.col("hash") == commit))
        c, r, files = t["commit"].first(), t["total"].first(), t["files"].first()
        some = r.events > 0
        provenance = t["provenance"].first().asDict()
        evidence = [{"eventId": e.id, "ts": sinks.iso_utc(e.ts_ms), "editedFiles": e.edited_files, "matchedFiles": e.matched_files, "fileScore": e.file_score, "timeScore": e.time_score, "branchScore": e.branch_score, "score": e.score, "confidence": e.confidence} for e in t["evidence"].collect()]
        matched = files.matched if files else []
        told = sinks.tokens_json(r)
        share = None if not told["total"] else int(r.subagent_tokens / told["total"] * 1000 + 0.5) / 10
        return self._head("show", check) | {
            "ref": ref,
            "commit": {"hash": commit, "shortHash": commit[:7], "subject": c and c.subject, "authorTs": c and c.author_ts_ms, "date": c and sinks.date_utc(c.author_ts_ms), "files": c.files if c else [], "insertions": c and c.insertions, "deletions": c and c.deletions, "isMerge": c and c.is_merge, "inEnumeratedHistory": c is not None},
            "attributed": some, "cost": sinks.breakdown_json(r) if some else None, "tokens": told, "unpricedTokens": self._unpriced(rows), "events": r.events,
            "confidence": t["confidence"].first().confidence if some else None, "provenance": provenance,
            "sessions": [{"sessionId": s.session_id, "idPrefix": s.session_id[:8], "from": sinks.iso_utc(s.min_ts_ms), "to": sinks.iso_utc(s.max_ts_ms), "events": s.events, "tokens": sinks.tokens_json(s), "cost": money_json(int(s.cost_total))} for s in t["sessions"].collect()],
            "byModel": [{"model": m.model, "events": m.events, "tokens": sinks.tokens_json(m), "cost": None if m.cost is None else money_json(int(m.cost))} for m in t["models"].collect()],
            "subagents": {"tokens": r.subagent_tokens, "cost": money_json(int(r.subagent_cost)), "sharePctOfTokens": share},
            "evidence": evidence, "adoptedEvents": r.events - len(evidence), "advisoryEvents": provenance["advisory"],
            "filesMatched": {"matched": matched, "unmatched": [f for f in (c.files if c else []) if f not in set(matched)]},
        }

    def range(self, span: str, label: str | None = None) -> dict:
        if ".." not in span:
            raise UserError(f"a range like A..B is needed, not {span!r}")
        check, hashes = self.check(), self._span(span)
        rows = reports.scoped(self.ledger, self.flags).where("kind = 'commit'").join(hashes, ["repo_id", "hash"], "left_semi")
        r, t = rows.agg(*rollup.measures(models=False)).first(), reports.range_totals(self.ledger, hashes, self.flags).first()
        per = self.log(span)["commits"]
        # Waste and overhead belong to a release by the time between its first and last commit.
        within = reports.scoped(self.ledger, self.flags).where(F.col("ts_ms").between(t.span_from, t.span_to) if t else F.lit(False))
        b = self._buckets(within)
        return self._head("range", check) | {
            "range": span, "label": label, "headline": {"cost": money_json(int(r.cost_total)), "commits": t.commits if t else 0, "sessions": r.sessions},
            "totals": {"cost": money_json(int(r.cost_total)), "costBreakdown": sinks.breakdown_json(r), "tokens": sinks.tokens_json(r), "events": r.events, "unpricedTokens": self._unpriced(rows)},
            "byModel": self._models(rows), "commits": per, "span": {"from": sinks.iso_utc(t.span_from) if t else None, "to": sinks.iso_utc(t.span_to) if t else None},
            "waste": sinks.bucket_json(b["waste"]), "overhead": sinks.bucket_json(b["overhead"]), "revListCommits": hashes.count(),
        }

    def reprice(self, model: str, span: str | None = None) -> dict:
        check = self.check()
        try:
            target = reports.find_card(self.ledger, model).first()
            r = reports.reprice(self.ledger, model, self.flags, self._span(span)).first()
        except LookupError as e:
            raise UserError(str(e)) from e
        names = {"input": "repriced_input", "output": "repriced_output", "cacheWrite": "repriced_cache_write", "cacheRead": "repriced_cache_read", "total": "repriced_total"}
        return self._head("reprice", check) | {
            "target": {"id": target.model_id, "displayName": target.display_name}, "scope": {"kind": "range" if span else "repo", "range": span, "events": r.events, "tokens": sinks.tokens_json(r)},
            "repriced": {"cost": {k: money_json(int(r[c])) for k, c in names.items()}, "provenance": "repriced"}, "measured": {"cost": money_json(int(r.measured_total)), "unpricedEvents": r.unpriced_events, "unpricedTokens": sinks.tokens_json({f"{c}_tokens": r[f"unpriced_{c}"] for c in CLASSES})},
            "deltaPct": r.delta_pct, "cacheFallback": r.cache_fallback, "label": REPRICE_LABEL,
        }

    def notes(self, span: str | None = None, clear: bool = False) -> dict:
        check = self.check()
        if span is not None and ".." not in span:
            raise UserError(f"a range like A..B is needed, not {span!r}")
        hashes = self._span(span)
        if clear:
            within = None if hashes is None else {r.hash for r in hashes.toLocalIterator()}
            return self._head("notes", check) | {"cleared": sinks.clear_notes(self.repo, within)}
        # One commit at a time: notes are written by git on the driver.
        found = reports.notes(self.ledger, self.flags, hashes).orderBy("hash").toLocalIterator()
        return self._head("notes", check) | {"synced": sinks.sync_notes(self.repo, ((r.hash, r.payload) for r in found))}

    def pr(self, pull: dict, transport=None) -> dict:
        """``pull``: number, title, baseRefName, headRefName and commits ({oid}) as the forge tells them;
        with ``transport`` the comment is written."""
        number, oids = pull_request(pull)
        frame = self.spark.createDataFrame(list(enumerate(oids)), "position bigint, hash string")
        check, found = self.check(), reports.pull_request(self.ledger, frame, self.flags).collect()
        rows = reports.scoped(self.ledger, self.flags).where("kind = 'commit'").join(frame.select("hash").distinct(), "hash", "left_semi")
        r = rows.agg(*rollup.measures(models=False)).first()
        used = {x.hash: x.n for x in rows.groupBy("hash").agg(F.sum("total").alias("n")).collect()}
        out = self._head("pr", check) | {
            "pr": {"number": number, "title": pull.get("title"), "base": pull.get("baseRefName"), "head": pull.get("headRefName"), "commits": len(oids), "commitsInScope": sum(x.enumerated for x in found)},
            "cost": sinks.breakdown_json(r), "tokens": sinks.tokens_json(r), "events": r.events, "sessions": r.sessions,
            "byCommit": [{"hash": x.hash, "inScope": x.enumerated, "cost": {"nanoUsd": str(int(x.cost_total))} if x.events else None, "tokens": used.get(x.hash, 0)} for x in found],
            "comment": None,
        }
        lost = sum(not x.enumerated for x in found)
        if lost:
            out["warnings"] = [*out["warnings"], f"{lost} commits of the pull request are not in the local history"]
        if transport is not None:
            lines = [f"| {x.hash[:7]} {sinks.md_cell(x.subject or '')} | {format_usd(int(x.cost_total or 0))} |" for x in found]
            body = "\n".join([f"Cost of this pull request: {format_usd(int(r.cost_total))}", "", "| commit | cost |", "| --- | ---: |", *lines])
            out["comment"] = sinks.upsert_comment(transport, number, body)
        return out

    def report(self, path: str, span: str | None = None, force: bool = False) -> dict:
        """Writes the markdown ledger; a file that is there is left alone without ``force``."""
        sinks.write_markdown(path, self.markdown(span), force)
        return self._head("report", self.check()) | {"out": os.path.abspath(path), "commits": len(self.log(span)["commits"])}

    def markdown(self, span: str | None = None) -> str:
        """A ledger that stands by itself; a range keeps all usage that no commit took."""
        check, hashes = self.check(), self._span(span)
        rows = reports.report_rows(self.ledger, hashes, self.flags)
        r, b = rows.agg(*rollup.measures(models=False)).first(), self._buckets(rows)
        mix, per = rollup.provenance_counts(rows).first(), self.log(span)["commits"]
        conf = {x.hash: x.c for x in rows.where("kind = 'commit'").groupBy("hash").agg(rollup.report_confidence().alias("c")).collect()}
        used, short = sinks.tokens_json(r), sinks.format_tokens
        usd = lambda money: format_usd(int(money["nanoUsd"]))
        lines = [f"# {f'Cost ledger of {span}' if span else f'Cost ledger of {os.path.basename(self.repo)}'}", ""]
        lines += [f"- repository: `{self.repo}`", f"- made: {sinks.local_time(self.flags.now_ms)} by costledger {VERSION}", f"- prices: {self.pricing.get('asOf')} ({self.pricing.get('origin')})", ""]
        lines += [f"> {LEGEND}", *([f"> Plan {self.plan}: {sinks.PLAN_NOTE}."] if self.plan else []), "", "## Totals", ""]
        lines += [f"**{usd(money_json(int(r.cost_total)))}** for {r.events} calls in {r.sessions} sessions; {len(conf)} commits have a cost.", ""]
        lines += ["| tokens | input | output | cache write | cache read |", "| ---: | ---: | ---: | ---: | ---: |", "| " + " | ".join(short(used[k]) for k in ("total", "input", "output", "cacheWrite", "cacheRead")) + " |", ""]
        lines.append(f"Provenance of the calls: {mix.measured} measured, {mix.repriced} repriced, {mix.advisory} advisory.")
        if r.unpriced_tokens:
            lines += ["", f"Not priced: {short(r.unpriced_tokens)} tokens of {r.unpriced_events} calls to models without a price ($—)."]
        lines += ["", "## Buckets", "", "| bucket | cost | tokens | sessions | |", "| --- | ---: | ---: | ---: | --- |"]
        lines += [f"| {name.replace('_', ' ')} | {usd(x['cost'])} | {short(x['tokens']['total'])} | {x['sessions']} | {BUCKET_NOTES[name]} |" for name, x in b.items()]
        lines += ["", "## Models", "", "| model | events | tokens | cost |", "| --- | ---: | ---: | ---: |"]
        lines += [f"| {sinks.md_cell(m['model'] or '(unknown)')} | {m['events']} | {short(m['tokens']['total'])} | {'$—' if m['cost'] is None else usd(m['cost'])} |" for m in self._models(rows)]
        lines += ["", "## Commits", "", "| commit | date | subject | cost | confidence |", "| --- | --- | --- | ---: | --- |"]
        lines += [f"| {c['shortHash']} | {c['date']} | {sinks.md_cell(c['subject'])} | {'$0.00 (human?)' if c['cost'] is None else usd(c['cost'])} | {conf.get(c['hash'], '—')} |" for c in per]
        return "\n".join([*lines, "", "## Method", "", METHOD, "", sinks.invariant_line(check), ""])

    def doctor(self) -> dict:
        """What was read, per agent and in all, and whether anything is amiss; nothing is attributed for it."""
        per = {r.agent: r for r in self.stats.groupBy("agent").agg(
            F.count("*").alias("files"), F.sum("size").alias("bytes"), F.min("mtime_ms").alias("oldest"), F.max("mtime_ms").alias("newest"),
            F.count(F.when(F.col("refused"), 1)).alias("refused"), *[F.sum(c).alias(c) for c in ("lines_read", "events_extracted", "lines_skipped")],
        ).collect()}
        total = lambda name: sum(r[name] for r in per.values())
        found, refused, read, skipped, raw = (total(n) for n in ("files", "refused", "lines_read", "lines_skipped", "events_extracted"))
        kept, out = self.ledger.raw.count(), self.ledger.tally.first()
        unknown = rollup.unpriced_models(self.ledger.rows).orderBy("model").collect()
        parse = {
            "filesFound": found, "filesRead": found - refused, "filesSkipped": refused, "linesRead": read, "eventsExtracted": raw, "linesSkipped": skipped,
            "duplicatesRemoved": raw - kept - out.oos_events, "outOfScope": {"events": out.oos_events, "tokens": out.oos_tokens},
        }
        checks = [told("git", "ok", gitlog.git(self.repo, "--version").strip()), told("repository", "ok", self.repo)]
        if gitlog.is_shallow(self.repo):
            checks.append(told("history", "warn", "a shallow clone: older commits cannot take any usage", "fetch the whole history (git fetch --unshallow)"))
        checks += [told("configuration", "warn", w) for w in self.config.warnings]
        checks.append(told("plan", "ok", f"{self.plan}: {sinks.PLAN_NOTE}" if self.plan else "none: costs are API prices"))
        checks.append(told("prices", "ok", f"of {self.pricing.get('asOf')} ({self.pricing.get('origin')}), {self.ledger.cards.count()} models"))
        agents = []
        for agent, root in self.roots.items():
            r, verified = per.get(agent), SOURCES[agent].schema_verified
            agents.append({"id": agent, "root": root, "files": r.files if r else 0, "bytes": r.bytes if r else 0, "schemaVerified": verified})
            if r is None:
                checks.append(told(f"adapter {agent}", "warn", f"no transcripts under {root}", f"nothing to do if {agent} is not used; else set its folder"))
            else:
                detail = f"{r.files} files ({sinks.format_bytes(r.bytes)}, {sinks.date_utc(r.oldest)} to {sinks.date_utc(r.newest)}) under {root}"
                checks.append(told(f"adapter {agent}", "ok", detail + ("" if verified else "; its form was not checked against real transcripts")))
        if "aider" in self.roots:
            checks.append(told("aider precision", "warn", "its history has no time per call and rounds token counts"))
        covered = "" if not read else f", {int((read - skipped) / read * 1000 + 0.5) / 10}% understood"
        amiss = skipped or refused
        checks.append(told("parsing", "warn" if amiss else "ok", f"{found - refused} of {found} files, {read} lines, {raw} events{covered}", "send a sample of the lines that were not understood" if amiss else None))
        checks.append(told("scope", "ok", f"{kept} events are of this repository; {out.oos_events} ({out.oos_tokens} tokens) are of other folders"))
        names = ", ".join(f"{json.dumps(r.model)} ({r.tokens} tokens)" for r in unknown)
        checks.append(told("models", "warn", f"without a price: {names}", "refresh the price table") if unknown else told("models", "ok", "each has a price"))
        return {
            "schemaVersion": sinks.SCHEMA_VERSION, "command": "doctor", "costledger": VERSION, "ok": all(c["status"] != "fail" for c in checks),
            "checks": checks, "adapters": agents, "parse": parse, "unknownModels": [r.model for r in unknown],
        }

    def short_models(self) -> dict[str, str]:
        """Model -> the price table's id of it, or the name itself; ``(unknown)`` for none."""
        found = self.ledger.rows.select("model", "price_id").distinct().collect()
        return {r.model: r.price_id or r.model or "(unknown)" for r in found}

    def log_text(self, limit: int | None = None, span: str | None = None) -> str:
        report, short = self.log(span, limit), self.short_models()
        models = lambda c: sinks.truncate(",".join(sorted({short[m] for m in c["models"]})), 18)
        rows = [[c["cost"] and cost_text(c) or "$0.00", c["confidence"] or "human?", c["shortHash"], c["date"], sinks.truncate(c["subject"], 48), models(c), str(c["sessions"])] for c in report["commits"]]
        columns = [("cost", "right"), ("conf", "left"), ("hash", "left"), ("date", "left"), ("subject", "left"), ("models", "left"), ("sessions", "right")]
        totals = report["totals"]
        return sinks.table(columns, rows) + f"\n\ntotals: ${totals['attributedCost']['usd']} across {totals['commitsShown']} commits"


def told(name: str, status: str, detail: str, remedy: str | None = None) -> dict:
    """One finding of the doctor: ok, warn or fail."""
    return {"name": name, "status": status, "detail": detail, "remedy": remedy}


def pull_request(data) -> tuple[int, list[str]]:
    """(number, commit ids in their order) of a forge's description; raises where it is no such thing."""
    commits = data.get("commits") if isinstance(data, dict) else None
    fine = isinstance(commits, list) and isinstance(data.get("number"), int) and all(isinstance(data.get(k), str) for k in ("title", "baseRefName", "headRefName"))
    if not fine or not all(isinstance(c, dict) and isinstance(c.get("oid"), str) for c in commits):
        raise UserError("a pull request needs number, title, baseRefName, headRefName and commits with their oid")
    return data["number"], [c["oid"] for c in commits]


def cost_text(commit: dict) -> str:
    return sinks.cost_cell(int(commit["cost"]["nanoUsd"]), commit["unpricedTokens"])
