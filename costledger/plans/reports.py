"""The nine reports as DataFrames over a ledger; ``costledger.sinks`` turns them into JSON, text and markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Flags
from ..functions.money import CLASSES, NANO
from ..operators import rollup
from ..operators.events import in_window, total_tokens
from ..operators.pricing import reprice as reprice_rows
from ..operators.tables import Keep, in_parts
from .ledger import Ledger

GENERATOR = "costledger"


def scoped(led: Ledger, flags: Flags | None = None) -> DataFrame:
    flags = flags or Flags()
    return led.rows.where(in_window(F.col("ts_ms"), flags.since, flags.until)) if flags.since is not None or flags.until is not None else led.rows


def _cost_of(bucket: str):
    return F.coalesce(F.sum(F.when(rollup.bucket() == bucket, F.col("cost_total"))), F.lit(0).cast(NANO)).cast(NANO)


def summary(led: Ledger, flags: Flags | None = None) -> DataFrame:
    """Totals of each repository, with its waste, overhead, what is in progress and what caches did."""
    rows = scoped(led, flags)
    buckets = [_cost_of(b).alias(f"{b}_cost") for b in ("waste", "in_progress", "overhead")]
    reads, inputs = F.sum("cache_read"), F.sum("input")
    return rows.groupBy("repo_id").agg(*rollup.measures(models=False), *buckets, F.count_distinct("hash").alias("commits_covered"), rollup.percent1(reads, inputs + reads).alias("cache_pct"))


def _commit_rollup(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.where("kind = 'commit'").groupBy(*keys).agg(*rollup.measures(), rollup.dominant_confidence().alias("confidence"), rollup.report_confidence().alias("report_confidence"))


def log(led: Ledger, flags: Flags | None = None, hashes: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Commits with what they cost; those without events stay.  The range and the dates choose
    commits, the limit then keeps the newest."""
    flags = flags or Flags()
    commits = led.commits
    if hashes is not None:
        commits = commits.join(hashes, ["repo_id", "hash"], "left_semi")
    commits = commits.where(in_window(F.col("author_ts_ms"), flags.since, flags.until))
    if limit is not None:
        commits = commits.orderBy(F.col("author_ts_ms").desc(), "hash").limit(limit)
    rows = scoped(led, flags)

    def part(keep: Keep) -> DataFrame:
        mine = keep("repo_id", "hash")
        costed = _commit_rollup(rows.where(mine), "repo_id", "hash").select("repo_id", "hash", "events", "cost_total", "confidence", "unpriced_tokens", "sessions", "models", *[f"{c}_tokens" for c in CLASSES])
        out = commits.where(mine).select("repo_id", "hash", "author_ts_ms", "subject").join(costed, ["repo_id", "hash"], "left")
        return out.na.fill(0, ["events", "unpriced_tokens", "sessions"])

    return in_parts(led.spark, part, led.parts if limit is None else 1)


def evidence(led: Ledger, flags: Flags | None = None) -> DataFrame:
    """Directly scored edit events of each commit, with how many of their files it has."""
    scored = scoped(led, flags).where("score is not null and adopted_from is null")
    both = scored.join(led.commits.select("repo_id", "hash", "files"), ["repo_id", "hash"])
    return both.withColumn("edited_files", F.size("rel_files").cast("bigint")).withColumn("matched_files", F.size(F.array_intersect("rel_files", "files")).cast("bigint"))


def files_matched(led: Ledger, flags: Flags | None = None) -> DataFrame:
    """Each commit's files that its evidence edited, and its others."""
    edited = scoped(led, flags).where("score is not null and adopted_from is null").select("repo_id", "hash", F.explode("rel_files").alias("f")).distinct()
    files = led.commits.select("repo_id", "hash", F.explode(F.array_distinct("files")).alias("f"))
    seen = edited.select("repo_id", "hash").distinct()
    marked = files.join(seen, ["repo_id", "hash"], "left_semi").join(edited.withColumn("hit", F.lit(True)), ["repo_id", "hash", "f"], "left")
    listed = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("f"))))
    return marked.groupBy("repo_id", "hash").agg(listed(F.col("hit").isNotNull()).alias("matched"), listed(F.col("hit").isNull()).alias("unmatched"))


def show(led: Ledger, repo_id, commit: str, flags: Flags | None = None) -> dict[str, DataFrame]:
    """The tables of one commit's report."""
    rows = scoped(led, flags).where((F.col("kind") == "commit") & (F.col("hash") == commit) & (F.col("repo_id") == repo_id))
    own = Ledger(led.spark, rows, led.raw, led.tally, led.commits.where((F.col("hash") == commit) & (F.col("repo_id") == repo_id)), led.cards)
    return {
        "commit": own.commits,
        "total": rollup.rollup(rows),
        "confidence": rows.agg(rollup.dominant_confidence().alias("confidence")),
        "provenance": rollup.provenance_counts(rows),
        "sessions": rollup.by_session(rows).orderBy("session_id"),
        "models": models(rows),
        "evidence": evidence(own).orderBy("ts_ms", "id"),
        "files": files_matched(own),
    }


def models(rows: DataFrame) -> DataFrame:
    """By cost, the highest first, then by name.  A model's cost is null if none of its events has one."""
    got = rollup.rollup(rows, "model", models=False)
    cost = F.when(F.col("unpriced_events") < F.col("events"), F.col("cost_total"))
    return got.withColumn("cost", cost).orderBy(F.col("cost_total").desc(), "model")


def range_totals(led: Ledger, hashes: DataFrame, flags: Flags | None = None) -> DataFrame:
    """A release's cost per repository, and the waste and overhead between its first and last commit."""
    rows = scoped(led, flags)
    chosen = led.commits.join(hashes.select("repo_id", "hash").distinct(), ["repo_id", "hash"], "left_semi")
    span = chosen.groupBy("repo_id").agg(F.min("author_ts_ms").alias("span_from"), F.max("author_ts_ms").alias("span_to"), F.count("*").alias("commits"))
    marked = rows.join(chosen.select("repo_id", "hash", F.lit(True).alias("_in")), ["repo_id", "hash"], "left")
    both = span.join(marked, "repo_id", "left")
    inside = F.col("ts_ms").between(F.col("span_from"), F.col("span_to"))
    money = lambda c: F.coalesce(F.sum(F.when(c, F.col("cost_total"))), F.lit(0).cast(NANO)).cast(NANO)
    return both.groupBy("repo_id", "span_from", "span_to", "commits").agg(
        money(F.col("_in")).alias("cost_total"),
        F.count(F.when(F.col("_in"), 1)).alias("events"),
        money(inside & (F.col("kind") == "waste") & ~F.col("in_progress")).alias("waste_cost"),
        money(inside & (F.col("kind") == "overhead")).alias("overhead_cost"),
    )


def find_card(led: Ledger, model: str) -> DataFrame:
    """The card of an exact id, else of the longest id that begins the name; raises with the known ids."""
    got = led.cards.where((F.col("model_id") == model) | F.lit(model).startswith(F.col("model_id"))).orderBy((F.col("model_id") == model).desc(), F.length("model_id").desc()).limit(1)
    if got.isEmpty():
        known = sorted(r.model_id for r in led.cards.select("model_id").collect())
        raise LookupError(f"unknown model {model!r}; known are {', '.join(known)}")
    return got


def reprice(led: Ledger, model: str, flags: Flags | None = None, hashes: DataFrame | None = None) -> DataFrame:
    """What the same traffic would cost on one card; with ``hashes`` only what those commits took."""
    rows = scoped(led, flags)
    if hashes is not None:
        rows = rows.where("kind = 'commit'").join(hashes, ["repo_id", "hash"], "left_semi")
    again = reprice_rows(rows, find_card(led, model))
    unpriced = F.col("cost_total").isNull()
    long = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    money = lambda c: F.coalesce(F.sum(c), F.lit(0).cast(NANO)).cast(NANO)
    out = again.agg(
        F.count("*").alias("events"), F.coalesce(F.sum(total_tokens()), F.lit(0)).cast("bigint").alias("tokens"),
        *[money(f"repriced_{c}").alias(f"repriced_{c}") for c in ("input", "output", "cache_write", "cache_read", "total")],
        money("cost_total").alias("measured_total"), F.count(F.when(unpriced, 1)).alias("unpriced_events"),
        *[long(F.col(c)).alias(f"{c}_tokens") for c in CLASSES], *[long(F.when(unpriced, F.col(c))).alias(f"unpriced_{c}") for c in CLASSES],
        F.coalesce(F.bool_or("cache_fallback"), F.lit(False)).alias("cache_fallback"),
    )
    return out.withColumn("delta_pct", rollup.delta_percent(F.col("measured_total"), F.col("repriced_total")))


def report_rows(led: Ledger, hashes: DataFrame | None, flags: Flags | None = None) -> DataFrame:
    """Rows of the markdown ledger: a range keeps all that is not attributed to a commit."""
    rows = scoped(led, flags)
    if hashes is None:
        return rows
    marked = rows.join(hashes.select("repo_id", "hash").distinct().withColumn("_in", F.lit(True)), ["repo_id", "hash"], "left")
    return marked.where("kind <> 'commit' or _in").drop("_in")


def pull_request(led: Ledger, oids: DataFrame, flags: Flags | None = None) -> DataFrame:
    """``oids`` (position, hash) in their order, with cost and whether the history has them."""
    costed = _commit_rollup(scoped(led, flags), "hash").select("hash", "cost_total", "events", "confidence")
    known = led.commits.select("hash", "subject", F.lit(True).alias("enumerated"))
    out = oids.join(known, "hash", "left").join(costed, "hash", "left")
    return out.na.fill(0, ["events"]).na.fill(False, ["enumerated"]).select("position", "hash", "subject", "cost_total", "events", "confidence", "enumerated").orderBy("position")


def notes(led: Ledger, flags: Flags | None = None, hashes: DataFrame | None = None) -> DataFrame:
    """(repo_id, hash, payload): one JSON note per costed commit, its keys in a fixed order."""
    rows = scoped(led, flags).where("kind = 'commit'")
    if hashes is not None:
        rows = rows.join(hashes, ["repo_id", "hash"], "left_semi")
    sums = rows.groupBy("repo_id", "hash").agg(
        F.coalesce(F.sum("cost_total"), F.lit(0).cast(NANO)).cast(NANO).alias("cost"),
        *[F.sum(c).alias(c) for c in ("input", "output", "cache_write", "cache_read")],
        rollup.dominant_confidence().alias("confidence"),
        F.bool_or(F.col("provenance") == "advisory").alias("advisory"),
    )
    tokens = F.struct("input", "output", F.col("cache_write").alias("cacheWrite"), F.col("cache_read").alias("cacheRead"), total_tokens().alias("total"))
    label = F.when(F.col("advisory"), "advisory").otherwise("measured")
    body = F.struct(F.lit(1).alias("v"), F.col("cost").cast("string").alias("costNanoUsd"), tokens.alias("tokens"), "confidence", label.alias("provenance"), F.lit(GENERATOR).alias("generatedBy"))
    return sums.select("repo_id", "hash", F.to_json(body).alias("payload"))


def accounting(led: Ledger) -> DataFrame:
    """The check over the whole ledger, whatever a report shows of it."""
    return rollup.conservation(led.rows, led.tally, led.raw)
