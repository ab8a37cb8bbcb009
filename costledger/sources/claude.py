"""Line logs in which assistant records carry the usage of each call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonv as J
from .lines import file_stats, read_lines
from .usage import EVENT, canonical_hash, exploded

AGENT = "claude-code"
# The tools that edit files, the model of records that stand for failed calls, the counts.
EDIT_TOOLS = ("Edit", "Write", "MultiEdit", "NotebookEdit")
SYNTHETIC = "<synthetic>"
COUNTS = {"input": "input_tokens", "output": "output_tokens", "cache_write": "cache_creation_input_tokens", "cache_read": "cache_read_input_tokens"}


# What is looked at of a record; a message's texts are never copied.
RECORD = dict.fromkeys(("type", "sessionId", "timestamp", "cwd", "gitBranch", "isSidechain", "requestId"), "variant")
BLOCK = J.struct_of(type="variant", name="variant", input=J.struct_of(file_path="variant", notebook_path="variant"))
MESSAGE = {"id": "variant", "model": "variant", "usage": "variant", "content": f"array<{BLOCK}>"}
USAGE = dict.fromkeys(COUNTS.values(), "variant")


def _counts(u: Column) -> Column:
    """struct of the four counts, null where there is none, and ``fine``: each is a count or absent."""
    found = {k: J.count(u[f], "$") for k, f in COUNTS.items()}
    fine = u.isNotNull()
    for k, f in COUNTS.items():
        fine = fine & (u[f].isNull() | found[k].isNotNull())
    return F.struct(*[c.alias(k) for k, c in found.items()], fine.alias("fine"))


def with_usage(rows: DataFrame, usage: Column) -> DataFrame:
    """Adds ``_top``, the counts of a usage record, and ``_rounds``, those of its iterations; null for a
    usage without any, and ``_rounds_fine``."""
    rows = rows.withColumn("_u", J.fields(usage, "$", iterations="variant", **USAGE))
    listed = J.array(F.col("_u")["iterations"], "$")
    rounds = F.transform(listed, lambda r: J.fields(r, "$", type="variant", **USAGE))
    rows = rows.withColumns({"_top": _counts(F.col("_u")), "_parts": rounds})
    typed = lambda r: r["type"].isNull() | J.is_string(r["type"], "$")
    rows = rows.withColumn("_rounds", F.transform("_parts", lambda r: F.struct(_counts(r).alias("c"), typed(r).alias("typed"))))
    fine = F.forall("_rounds", lambda r: r["c"]["fine"] & F.coalesce(r["typed"], F.lit(False)))
    return rows.withColumn("_rounds_fine", J.missing(F.col("_u")["iterations"], "$") | F.coalesce(fine, F.lit(False))).drop("_parts")


def usage_ok() -> Column:
    return F.col("_u").isNotNull() & F.col("_top.fine") & F.col("_rounds_fine")


def tokens() -> dict[str, Column]:
    """The top-level counts, or the sum of the iterations where those are all zero."""
    zero = F.lit(0).cast("bigint")
    top = {k: F.coalesce(F.col(f"_top.{k}"), zero) for k in COUNTS}
    some = sum(list(top.values())[1:], top["input"]) > 0
    rounds = F.coalesce(F.size("_rounds"), F.lit(0))
    added = lambda k: F.aggregate("_rounds", zero, lambda acc, r: acc + F.coalesce(r["c"][k], zero))
    return {k: F.when(some | (rounds <= 0), top[k]).otherwise(added(k)) for k in COUNTS}


def edited_files(blocks: Column) -> Column:
    """Paths named by editing tool calls, first seen first.  Nothing else of a call is read."""
    edits = F.filter(blocks, lambda b: F.coalesce((J.string(b["type"], "$") == "tool_use") & J.string(b["name"], "$").isin(*EDIT_TOOLS), F.lit(False)))
    paths = F.transform(edits, lambda b: F.coalesce(J.nonempty(b["input"]["file_path"], "$"), J.nonempty(b["input"]["notebook_path"], "$")))
    return F.coalesce(F.array_distinct(F.filter(paths, lambda p: p.isNotNull())), F.array().cast("array<string>"))


def classify(lines: DataFrame) -> DataFrame:
    """Each line with its outcome (event, ignored, malformed) and its events."""
    J.allow_duplicate_keys(lines.sparkSession)
    v, r, m = F.col("v"), F.col("_r"), F.col("_m")
    base = lines.withColumn("v", J.parse(F.col("text")))
    base = base.withColumns({"_r": J.fields(v, "$", **RECORD), "_m": J.fields(v, "$.message", **MESSAGE)})
    # Absent, or anything but an object: told apart only where there is no message to read.
    base = base.withColumn("_none", F.when(m.isNull(), J.missing(v, "$.message")).otherwise(F.lit(False))).drop("v")
    base = with_usage(base, m["usage"])
    o = lambda x, null: J.optional(J.is_string(x, "$"), x, "$", null)
    shape = (
        J.is_string(r["sessionId"], "$") & J.is_string(r["timestamp"], "$") & o(r["cwd"], True) & o(r["gitBranch"], True)
        & J.optional(J.is_boolean(r["isSidechain"], "$"), r["isSidechain"], "$") & o(r["requestId"], False)
    )
    message = m.isNotNull() & o(m["id"], False) & o(m["model"], False) & (J.missing(m["usage"], "$") | usage_ok())
    model, ts = J.string(m["model"], "$"), J.millis(J.string(r["timestamp"], "$"))
    outcome = (
        F.when((F.col("status") != "ok") | r.isNull() | ~J.is_string(r["type"], "$"), "malformed")
        .when(J.string(r["type"], "$") != "assistant", "ignored")
        .when(~(shape & (F.col("_none") | message)), "malformed")
        .when(F.col("_none") | J.missing(m["usage"], "$"), "ignored")
        .when(F.coalesce(model, F.lit("")) == "", "malformed")
        .when(model == SYNTHETIC, "ignored")
        .when(ts.isNull(), "malformed")
        .otherwise("event")
    )
    told = base.withColumn("outcome", outcome)
    is_event = F.col("outcome") == "event"
    own = F.concat(J.nonempty(m["id"], "$"), F.lit(":"), J.nonempty(r["requestId"], "$"))
    told = told.withColumn("_own", F.when(is_event, own))
    parts = {
        "agent": F.lit(AGENT), "session_id": J.string(r["sessionId"], "$"), "ts_ms": ts, "model": model, **tokens(), "cwd": J.string(r["cwd"], "$"), "git_branch": J.string(r["gitBranch"], "$"),
        "edited_files": edited_files(m["content"]), "is_sidechain": F.coalesce(F.try_variant_get(r["isSidechain"], "$", "boolean"), F.lit(False)),
    }
    plain = F.concat(J.string(r["sessionId"], "$"), F.lit(":"), J.string(r["timestamp"], "$"), F.lit(":"))
    # All that needs the record is read before Python comes in, so that only small rows wait for it;
    # records with ids send nulls.
    unnamed = is_event & F.col("_own").isNull()
    told = told.withColumns({"_e": F.when(is_event, F.struct(*[c.alias(k) for k, c in parts.items()])), "_usage": F.when(unnamed, F.to_json(m["usage"])), "_plain": F.when(unnamed, plain)})
    told = told.select(*lines.columns, "outcome", "_own", "_e", "_usage", "_plain").withColumn("_hash", canonical_hash("_usage"))
    ident = F.coalesce("_own", F.concat("_plain", "_hash"))
    event = F.when(is_event, F.array(F.struct(ident, *[F.col(f"_e.{k}") for k in parts]).cast(EVENT))).otherwise(F.array().cast(f"array<{EVENT}>"))
    done = told.withColumn("events", event)
    return done.select(*lines.columns, "outcome", "events", F.size("events").alias("n_events"))


def read(spark, root: str) -> tuple[DataFrame, DataFrame]:
    """(events, file stats) of ``root``/projects."""
    told = classify(read_lines(spark, f"{root.rstrip('/')}/projects"))
    return exploded(told), file_stats(told, AGENT)
