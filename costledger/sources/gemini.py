"""Chat logs: line files with metadata first, and single JSON documents of an older form."""

from __future__ import annotations

import json
import posixpath

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonv as J
from ..functions.paths import base_name, resolve
from .lines import file_stats, forward, list_files, read_lines
from .usage import EVENT, exploded

AGENT = "gemini-cli"
# The tools that edit files, and the size from which an old document is refused.
EDIT_TOOLS = ("replace", "write_file")
MAX_DOCUMENT_BYTES = 64 << 20
COUNTS = ("input", "output", "cached", "thoughts", "tool", "total")


def tokens(t: Column) -> dict[str, Column]:
    """Input includes what was cached; thoughts are billed as output; cache writes are not billed."""
    n = lambda f: F.coalesce(J.count(t, f"$.{f}"), F.lit(0))
    return {"input": F.greatest(n("input") - n("cached"), F.lit(0)), "output": n("output") + n("thoughts"), "cache_write": F.lit(0).cast("bigint"), "cache_read": n("cached")}


def edited_files(calls: Column, cwd: Column) -> Column:
    good = F.filter(
        F.coalesce(calls, F.array().cast("array<variant>")),
        lambda c: J.is_object(c) & F.coalesce(J.string(c, "$.name").isin(*EDIT_TOOLS), F.lit(False)) & J.is_object(c, "$.args") & J.nonempty(c, "$.args.file_path").isNotNull(),
    )
    paths = F.transform(good, lambda c: F.when(J.string(c, "$.args.file_path").startswith("/"), J.string(c, "$.args.file_path")).otherwise(resolve(cwd, J.string(c, "$.args.file_path"))))
    return F.array_distinct(F.filter(paths, lambda p: p.isNotNull()))


def _message(m: Column, session: Column, side: Column, cwd: Column) -> Column:
    """struct<outcome, event> of one message record."""
    s = lambda p: J.optional(J.is_string(m, p), m, p)
    counts = J.is_object(m, "$.tokens")
    for f in COUNTS:
        counts = counts & J.count_ok(m, f"$.tokens.{f}")
    shape = (
        J.optional(J.is_string(m, "$.id") | J.is_number(m, "$.id"), m, "$.id") & s("$.timestamp") & s("$.model")
        & (J.missing(m, "$.tokens") | counts) & (J.missing(m, "$.toolCalls") | J.array(m, "$.toolCalls").isNotNull())
    )
    ts, model = J.millis(J.string(m, "$.timestamp")), J.nonempty(m, "$.model")
    ident = F.coalesce(J.nonempty(m, "$.id"), F.when(J.is_number(m, "$.id"), F.regexp_replace(F.try_variant_get(m, "$.id", "string"), r"\.0+$", "")))
    outcome = (
        F.when(~J.is_object(m), "malformed")
        .when(~J.is_string(m, "$.type"), "ignored")
        .when(~shape, "malformed")
        .when((J.string(m, "$.type") != "gemini") | J.missing(m, "$.tokens"), "ignored")
        .when(ident.isNull() | ts.isNull() | model.isNull(), "malformed")
        .otherwise("event")
    )
    t = tokens(J.at(m, "$.tokens"))
    event = F.struct(
        F.concat(session, F.lit(":"), ident), F.lit(AGENT), session, ts, model, t["input"], t["output"], t["cache_write"], t["cache_read"],
        cwd, F.lit(None).cast("string"), edited_files(J.array(m, "$.toolCalls"), cwd), side,
    ).cast(EVENT)
    return F.struct(outcome.alias("outcome"), F.when(outcome == "event", event).alias("event"))


def with_context(files: DataFrame, root: str, roots: DataFrame) -> DataFrame:
    """Adds slug, nested (a subagent's session), fallback (session by file name) and cwd.

    ``roots`` (slug, cwd) has a row per project; it grows with the projects and is joined, not broadcast by hint.
    """
    rest = F.split(F.regexp_replace("source_file", f"^.*?{posixpath.basename(root.rstrip('/'))}/tmp/", ""), "/")
    out = files.withColumn("slug", F.get(rest, 0)).withColumn("nested", F.size(rest) > 3).withColumn("fallback", base_name(F.col("source_file"), ".jsonl", ".json"))
    return out.join(roots, "slug", "left")


def classify(lines: DataFrame) -> DataFrame:
    """``lines`` with nested, fallback and cwd -> each with outcome and events."""
    J.allow_duplicate_keys(lines.sparkSession)
    v = F.col("v")
    base = lines.withColumn("v", J.parse(F.col("text"))).withColumn("head", F.col("offset") == F.min("offset").over(_whole_file()))
    meta = (
        F.col("head") & (F.col("status") == "ok") & v.isNotNull() & J.is_object(v) & J.absent(v, "$.type") & J.absent(v, "$['$set']") & J.absent(v, "$['$rewindTo']") & J.is_string(v, "$.sessionId")
    )
    for f in ("projectHash", "startTime", "kind"):
        meta = meta & J.optional(J.is_string(v, f"$.{f}"), v, f"$.{f}")
    base = base.withColumn("meta", F.coalesce(meta, F.lit(False)))
    told = F.when(F.col("meta"), F.struct(J.nonempty(v, "$.sessionId").alias("id"), F.coalesce(J.string(v, "$.kind") != "main", F.lit(False)).alias("side")))
    base = base.withColumn("_m", forward(told))
    session = F.coalesce(F.col("_m.id"), F.col("fallback"))
    side = F.col("nested") | F.coalesce(F.col("_m.side"), F.lit(False))
    base = base.withColumn("_session", session).withColumn("_side", side)
    patch = ~J.absent(v, "$['$set']")
    inside = "$['$set'].messages"
    patch_ok = J.is_object(v, "$['$set']") & (J.missing(v, inside) | J.array(v, inside).isNotNull())
    members = F.when(patch, F.coalesce(J.array(v, inside), F.array().cast("array<variant>"))).otherwise(F.array(v))
    bad = (F.col("status") != "ok") | v.isNull() | ~J.is_object(v) | (patch & ~patch_ok & J.absent(v, "$['$rewindTo']"))
    quiet = F.col("meta") | ~J.absent(v, "$['$rewindTo']")
    results = F.when(bad | quiet, F.array().cast(f"array<struct<outcome:string,event:{EVENT}>>")).otherwise(F.transform(members, lambda m: _message(m, F.col("_session"), F.col("_side"), F.col("cwd"))))
    done = base.withColumn("_r", results)
    events = F.transform(F.filter("_r", lambda r: r["outcome"] == "event"), lambda r: r["event"])
    outcome = F.when(bad | F.exists("_r", lambda r: r["outcome"] == "malformed"), "malformed").when(F.size(events) > 0, "event").otherwise("ignored")
    return done.select(*lines.columns, outcome.alias("outcome"), events.alias("events"), F.size(events).alias("n_events"))


def _whole_file():
    from pyspark.sql import Window

    return Window.partitionBy("source_file")


def classify_documents(docs: DataFrame) -> DataFrame:
    """``docs`` (source_file, size, mtime_ms, text, nested, fallback, cwd): one row per file, with its
    events and stats.  A document counts as a line, and so does each message."""
    J.allow_duplicate_keys(docs.sparkSession)
    v = F.col("v")
    base = docs.where(F.col("size") < MAX_DOCUMENT_BYTES).withColumn("v", J.parse(F.col("text")))
    ok = v.isNotNull() & J.is_object(v) & (J.missing(v, "$.messages") | J.array(v, "$.messages").isNotNull())
    for f in ("sessionId", "projectHash", "startTime", "kind"):
        ok = ok & J.optional(J.is_string(v, f"$.{f}"), v, f"$.{f}")
    ok = F.coalesce(ok, F.lit(False))
    session = F.coalesce(J.nonempty(v, "$.sessionId"), F.col("fallback"))
    side = F.col("nested") | F.coalesce(J.string(v, "$.kind") != "main", F.lit(False))
    base = base.withColumn("_ok", ok).withColumn("_session", session).withColumn("_side", side)
    members = F.when(F.col("_ok"), F.coalesce(J.array(v, "$.messages"), F.array().cast("array<variant>"))).otherwise(F.array().cast("array<variant>"))
    done = base.withColumn("_r", F.transform(members, lambda m: _message(m, F.col("_session"), F.col("_side"), F.col("cwd"))))
    events = F.transform(F.filter("_r", lambda r: r["outcome"] == "event"), lambda r: r["event"])
    skipped = F.size(F.filter("_r", lambda r: r["outcome"] == "malformed")) + F.when(F.col("_ok"), 0).otherwise(1)
    return done.select(
        "source_file", F.lit(0).cast("bigint").alias("offset"), events.alias("events"), F.lit(AGENT).alias("agent"), "size", "mtime_ms",
        F.when(F.col("_ok"), F.col("size")).otherwise(0).cast("bigint").alias("bytes_consumed"), (F.size("_r") + 1).cast("bigint").alias("lines_read"),
        F.size(events).cast("bigint").alias("events_extracted"), skipped.cast("bigint").alias("lines_skipped"), F.lit(False).alias("refused"),
    )


def project_roots(spark: SparkSession, root: str) -> DataFrame:
    """(slug, cwd): a project's marker file, else the least path that the project list gives its slug."""
    fs, path = pafs.FileSystem.from_uri(root)
    text = lambda p: fs.open_input_file(p).read().decode("utf-8", "replace")
    listed: dict[str, str] = {}
    try:
        found = json.loads(text(f"{path}/projects.json"))["projects"]
        if all(isinstance(s, str) for s in found.values()):
            for p in sorted(found, reverse=True):
                if p.startswith("/"):
                    listed[found[p]] = p
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        listed = {}
    for info in fs.get_file_info(pafs.FileSelector(f"{path}/tmp", allow_not_found=True)):
        if info.type == pafs.FileType.Directory:
            try:
                marker = text(f"{info.path}/.project_root").strip()
            except OSError:
                continue
            if marker.startswith("/"):
                listed[posixpath.basename(info.path)] = marker
    return spark.createDataFrame(sorted(listed.items()), "slug string, cwd string")


def read(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(events, file stats) of ``root``/tmp, both forms.  Documents that are too large are refused, and
    their stats say so."""
    root = root.rstrip("/")
    roots = project_roots(spark, root)
    told = classify(with_context(read_lines(spark, f"{root}/tmp"), root, roots)).where(F.col("source_file").contains("/chats/"))
    stats = file_stats(told, AGENT)
    events = exploded(told)
    old = [f for f in list_files({"path": f"{root}/tmp", "suffix": ".json"}) if "/chats/" in f[0]]
    fine = [uri for uri, size, _ in old if size < MAX_DOCUMENT_BYTES]
    if fine:
        # Without a scheme a path is local here, whatever Spark's default file system is.
        files = spark.read.text([uri if "://" in uri else f"file://{uri}" for uri in fine], wholetext=True)
        local = "file:///" if root.startswith("file:") else "/"
        named = files.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", local).alias("source_file"), F.col("_metadata.file_size").alias("size"), F.unix_millis(F.col("_metadata.file_modification_time")).alias("mtime_ms"), F.col("value").alias("text"))
        docs = classify_documents(with_context(named, root, roots))
        events = events.unionByName(exploded(docs))
        stats = stats.unionByName(docs.select(*stats.columns))
    refused = [(uri, AGENT, size, mtime, 0, 0, 0, 0, True) for uri, size, mtime in old if size >= MAX_DOCUMENT_BYTES]
    if refused:
        kinds = dict(stats.dtypes)
        names = ["source_file", "agent", "size", "mtime_ms", "bytes_consumed", "lines_read", "events_extracted", "lines_skipped", "refused"]
        stats = stats.unionByName(spark.createDataFrame(refused, ", ".join(f"{n} {kinds[n]}" for n in names)))
    return events, stats
