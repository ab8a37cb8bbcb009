"""Chat histories in markdown: sessions by header lines, usage lines, and edits around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import resolve
from .lines import by_file, file_stats, forward, read_lines
from .usage import EVENT, exploded

AGENT = "aider"
HISTORY = ".aider.chat.history.md"
# The lines that carry anything.
HEADER = r"^# aider chat started at (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\s*$"
MODEL = r"^> (?:Main model|Model): (.+?) with .+ edit format"
EDIT = r"^> Applied edit to (.+)$"
NUMBER = r"\d+(?:\.\d+)?k?"
USAGE = rf"^(?:> )?Tokens: ({NUMBER}) sent(?:, ({NUMBER}) cache write)?(?:, ({NUMBER}) cache hit)?, ({NUMBER}) received\."


def token_count(text: Column) -> Column:
    """``999``, ``4.2k`` (at most three decimals count), null for a fraction without ``k``."""
    whole, part = F.regexp_extract(text, r"^(\d+)", 1), F.regexp_extract(text, r"\.(\d+)", 1)
    thousands = whole.cast("bigint") * 1000 + F.rpad(F.substring(part, 1, 3), 3, "0").cast("bigint")
    return F.when(text.rlike(r"^\d+$"), whole.cast("bigint")).when(text.rlike(r"^\d+(\.\d+)?k$"), thousands)


def classify(lines: DataFrame, repo: Column) -> DataFrame:
    """Each line with its outcome and events.  Header times are in the session's time zone; a date that
    the calendar has not is skipped."""
    text = F.coalesce("text", F.lit(""))
    starts = text.startswith("# aider chat started at ")
    ts = F.unix_millis(F.try_to_timestamp(F.nullif(F.regexp_extract(text, HEADER, 1), F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss")))
    head = F.when(starts & ts.isNotNull(), F.struct(ts.alias("ts"), "offset"))
    claims = text.rlike(r"^(?:> )?Tokens: ") & ~starts
    group = lambda i: F.nullif(F.regexp_extract(text, USAGE, i), F.lit(""))
    sent, write, hit, received = (token_count(group(i)) for i in (1, 2, 3, 4))
    write = F.when(group(2).isNull(), F.lit(0)).otherwise(write)
    hit = F.when(group(3).isNull(), F.lit(0)).otherwise(hit)
    parsed = F.when(claims & text.rlike(USAGE) & sent.isNotNull() & write.isNotNull() & hit.isNotNull() & received.isNotNull(), F.struct(sent.alias("sent"), write.alias("write"), hit.alias("hit"), received.alias("received")))
    model = F.when(~starts & ~claims, F.nullif(F.regexp_extract(text, MODEL, 1), F.lit("")))
    edit = F.when(~starts & ~claims & model.isNull() & text.rlike(EDIT), F.regexp_extract(text, EDIT, 1))
    w = by_file().rowsBetween(Window.unboundedPreceding, 0)
    base = lines.withColumns({"_starts": starts, "_head": head, "_claims": claims, "_usage": parsed, "_edit": edit})
    base = base.withColumns({"_session": forward(F.col("_head")), "_ordinal": F.sum(F.col("_head").isNotNull().cast("int")).over(w) - 1, "_model": F.coalesce(forward(model), F.lit(""))})
    used = F.col("_usage").isNotNull() & F.col("_session").isNotNull()
    own = Window.partitionBy("source_file", "_ordinal").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    base = base.withColumn("_used", used).withColumn("_count", F.sum(F.col("_used").cast("int")).over(own))
    # An edit belongs to the usage before it, or else to its session's first one.
    base = base.withColumn("_slot", F.greatest(F.col("_count"), F.lit(1)))
    path = F.when(F.col("_edit").isNotNull() & F.col("_session").isNotNull(), resolve(repo, F.col("_edit")))
    slot = Window.partitionBy("source_file", "_ordinal", "_slot").orderBy("offset").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = base.withColumn("_path", path).withColumn("_edits", F.array_distinct(F.collect_list("_path").over(slot)))
    bad = (F.col("status") != "ok") | (F.col("_starts") & F.col("_head").isNull()) | (F.col("_claims") & ~F.col("_used"))
    u = F.col("_usage")
    session = F.concat(F.lit("aider:"), F.col("_session.ts").cast("string"), F.lit(":"), F.col("_ordinal").cast("string"))
    event = F.struct(
        F.concat(session, F.lit(":"), (F.col("_count") - 1).cast("string")), F.lit(AGENT), session, F.col("_session.ts"), F.col("_model"),
        F.greatest(u["sent"] - u["write"] - u["hit"], F.lit(0)), u["received"], u["write"].cast("bigint"), u["hit"].cast("bigint"), repo, F.lit(None).cast("string"), F.col("_edits"), F.lit(False),
    ).cast(EVENT)
    events = F.when(F.col("_used"), F.array(event)).otherwise(F.array().cast(f"array<{EVENT}>"))
    outcome = F.when(bad, "malformed").when(F.col("_used"), "event").otherwise("ignored")
    return base.select(*lines.columns, outcome.alias("outcome"), events.alias("events"), F.size(events).alias("n_events"))


def read(spark, repo_root: str, extra: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, file stats) of the repository's history file, and of one more."""
    paths = "|".join(dict.fromkeys(p for p in (f"{repo_root.rstrip('/')}/{HISTORY}", extra) if p))
    told = classify(read_lines(spark, paths, suffix=".md"), F.lit(repo_root.rstrip("/")))
    return exploded(told), file_stats(told, AGENT)
