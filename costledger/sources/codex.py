"""Rollout logs: stateful lines, where the latest metadata and turn context hold for what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonv as J
from ..functions.paths import resolve
from .lines import by_file, file_stats, forward, read_lines
from .usage import EVENT, canonical_hash, exploded

AGENT = "codex"
# The header lines of a patch, and a shell command that applies one.
PATCH_HEADER = r"(?m)^\*\*\* (?:Add|Update|Delete) File: (.+)$"
PATCH_COMMAND = r"^\s*apply_patch(\s|$)"
TRIPLE = {"input": "input_tokens", "cached": "cached_input_tokens", "output": "output_tokens"}


def patch_paths(patch: Column, cwd: Column) -> Column:
    """Paths of a patch's headers, absolute; relative ones are dropped without a working directory."""
    raw = F.transform(F.regexp_extract_all(patch, F.lit(PATCH_HEADER), 1), lambda p: F.regexp_replace(p, "\r$", ""))
    found = F.transform(F.filter(raw, lambda p: p != ""), lambda p: resolve(cwd, p))
    return F.filter(found, lambda p: p.isNotNull())


def to_tokens(t: Column) -> dict[str, Column]:
    """Input includes what was cached; reasoning is in the output; cache writes are not billed."""
    cached = F.greatest(t["cached"], F.lit(0))
    return {"input": F.greatest(t["input"] - cached, F.lit(0)), "output": F.greatest(t["output"], F.lit(0)), "cache_write": F.lit(0).cast("bigint"), "cache_read": cached}


def positive_delta(now: Column, before: Column) -> Column:
    return F.struct(*[F.greatest(now[f] - F.coalesce(before[f], F.lit(0)), F.lit(0)).alias(f) for f in TRIPLE])


def _usage_ok(v: Column, path: str) -> Column:
    fine = J.is_object(v, path)
    for f in TRIPLE.values():
        fine = fine & J.count_ok(v, f"{path}.{f}")
    for f in ("reasoning_output_tokens", "total_tokens"):
        fine = fine & J.count_ok(v, f"{path}.{f}", True)
    return J.missing(v, path) | fine


def _triple(v: Column, path: str) -> Column:
    values = F.struct(*[F.coalesce(J.count(v, f"{path}.{f}"), F.lit(0)).alias(k) for k, f in TRIPLE.items()])
    return F.when(J.is_object(v, path), values)


def _patch(v: Column, args: Column) -> Column:
    """The text in which a call carries a patch."""
    command = F.when(J.absent(args, "$.command") | J.is_null(args, "$.command"), J.at(args, "$.cmd")).otherwise(J.at(args, "$.command"))
    argv = J.array(command, "$")
    line = J.string(command, "$")
    from_argv = F.when(J.string(F.get(argv, 0), "$") == "apply_patch", J.string(F.get(argv, 1), "$"))
    from_line = F.when(line.rlike(PATCH_COMMAND), line)
    return F.when(J.string(v, "$.payload.name") == "apply_patch", J.string(args, "$.input")).otherwise(F.coalesce(from_argv, from_line))


def classify(lines: DataFrame) -> DataFrame:
    """Each line with its outcome and events.  A malformed line changes no state."""
    J.allow_duplicate_keys(lines.sparkSession)
    v, kind = F.col("v"), F.col("kind")
    s = lambda p, n=True: J.optional(J.is_string(v, p), v, p, n)
    base = lines.withColumn("v", J.parse(F.col("text")))
    envelope = (F.col("status") == "ok") & v.isNotNull() & J.is_object(v) & J.is_string(v, "$.type") & s("$.timestamp", False)
    base = base.withColumn("kind", F.when(envelope, J.string(v, "$.type")))
    body = J.is_object(v, "$.payload")
    inner = J.string(v, "$.payload.type")
    meta_ok = body & J.is_string(v, "$.payload.id") & s("$.payload.cwd") & s("$.payload.thread_source")
    turn_ok = body & s("$.payload.cwd") & s("$.payload.model")
    info = "$.payload.info"
    last_p, total_p = f"{info}.last_token_usage", f"{info}.total_token_usage"
    info_ok = J.missing(v, info) | (J.is_object(v, info) & _usage_ok(v, last_p) & _usage_ok(v, total_p))
    ts = J.millis(J.string(v, "$.timestamp"))
    silent = J.missing(v, info) | (J.missing(v, last_p) & J.missing(v, total_p))
    called = J.string(v, "$.payload.name")
    args = J.parse(J.string(v, "$.payload.arguments"))
    args_ok = args.isNotNull() & J.is_object(args) & ((called != "apply_patch") | J.is_string(args, "$.input"))
    message = F.when(~body | inner.isNull(), "malformed").when(inner != "token_count", "ignored").when(~info_ok, "malformed").when(silent, "ignored").when(ts.isNull(), "malformed").otherwise("event")
    response = (
        F.when(~body | inner.isNull(), "malformed")
        .when(inner != "function_call", "ignored")
        .when(~J.is_string(v, "$.payload.name") | ~J.is_string(v, "$.payload.arguments"), "malformed")
        .when(~called.isin("apply_patch", "shell", "exec_command"), "ignored")
        .when(~args_ok, "malformed")
        .otherwise("call")
    )
    outcome = (
        F.when(kind.isNull(), "malformed")
        .when(kind == "session_meta", F.when(meta_ok, "meta").otherwise("malformed"))
        .when(kind == "turn_context", F.when(turn_ok, "turn").otherwise("malformed"))
        .when(kind == "event_msg", message)
        .when(kind == "response_item", response)
        .otherwise("ignored")
    )
    told = base.withColumn("step", outcome)
    step = F.col("step")
    subagent = F.coalesce(J.string(v, "$.payload.thread_source") == "subagent", F.lit(False)) | (J.is_object(v, "$.payload.source") & ~J.missing(v, "$.payload.source.subagent"))
    branch = F.when(J.is_object(v, "$.payload.git"), J.nonempty(v, "$.payload.git.branch"))
    meta = F.when(step == "meta", F.struct(J.string(v, "$.payload.id").alias("id"), subagent.alias("side"), branch.alias("branch")))
    events_only = lambda c: F.when(step == "event", c)
    told = told.select(
        *lines.columns, "step", "v",
        forward(meta).alias("meta"),
        forward(F.when(step.isin("meta", "turn"), J.nonempty(v, "$.payload.cwd"))).alias("cwd"),
        forward(F.when(step == "turn", J.nonempty(v, "$.payload.model"))).alias("model"),
        events_only(_triple(v, last_p)).alias("own"), events_only(_triple(v, total_p)).alias("totals"),
        F.when(step == "call", _patch(v, args)).alias("patch"),
        events_only(J.string(v, "$.timestamp")).alias("stamp"), events_only(ts).alias("ts_ms"), events_only(F.to_json(J.at(v, info))).alias("info"),
    ).drop("v")
    told = told.withColumn("before", F.last("totals", ignorenulls=True).over(by_file().rowsBetween(Window.unboundedPreceding, -1)))
    # Lines between two emitted calls are one segment: its patches belong to the call that ends it.
    told = told.withColumn("segment", F.coalesce(F.sum(F.when(step == "event", 1)).over(by_file().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    told = told.withColumn("paths", F.when(F.col("patch").isNotNull(), patch_paths(F.col("patch"), F.col("cwd"))))
    edits = F.array_distinct(F.flatten(F.collect_list("paths").over(by_file("segment").rowsBetween(Window.unboundedPreceding, 0))))
    told = told.withColumn("edits", edits)
    used = F.coalesce("own", positive_delta(F.col("totals"), F.col("before")))
    t = to_tokens(used)
    session = F.coalesce(F.col("meta.id"), F.col("source_file"))
    parts = [
        F.concat(session, F.lit(":"), F.col("stamp"), F.lit(":"), F.col("_hash")), F.lit(AGENT), session, F.col("ts_ms"), F.coalesce("model", F.lit("")),
        t["input"], t["output"], t["cache_write"], t["cache_read"], F.col("cwd"), F.col("meta.branch"), F.col("edits"), F.coalesce(F.col("meta.side"), F.lit(False)),
    ]
    told = told.withColumn("_hash", canonical_hash("info"))
    told = told.withColumn("events", F.when(step == "event", F.array(F.struct(*parts).cast(EVENT))).otherwise(F.array().cast(f"array<{EVENT}>")))
    final = F.when(step.isin("meta", "turn", "call"), "ignored").otherwise(step).alias("outcome")
    return told.select(*lines.columns, final, "events", F.size("events").alias("n_events"))


def read(spark, root: str) -> tuple[DataFrame, DataFrame]:
    """(events, file stats) of ``root``/sessions."""
    told = classify(read_lines(spark, f"{root.rstrip('/')}/sessions"))
    return exploded(told), file_stats(told, AGENT)
