"""The transcript parsers over log lines made from the driver's events, each with the SQL of its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsonv import count, parse
from ..functions.paths import collapse_rename
from ..sources import adapters, aider, claude, codex, gemini, gitlog, lines, prices
from ..sources.usage import exploded
from . import demo
from .queries import query

_B = """
b AS (SELECT event_id AS e, user_id AS u, event_type AS t, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k, epoch_us(ts) // 1000 AS ts_ms FROM events)"""


def _lines(spark, sf_dir, text: Column, *extra: Column) -> DataFrame:
    """One line per event, in a file per user, in the order of event ids."""
    b = demo.base(spark, sf_dir)
    name = F.concat(F.lit("/x/tmp/p/chats/u"), F.col("user_id").cast("string"), F.lit(".jsonl"))
    return b.select(
        name.alias("source_file"), F.col("event_id").alias("offset"), F.lit(1).cast("bigint").alias("length"), F.lit("ok").alias("status"), text.alias("text"),
        F.lit(0).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("mtime_ms"), F.lit(0).cast("bigint").alias("generation"), *extra,
    )


def _text(template: str) -> Column:
    """``template`` with {e}, {u}, {k}, {k3}, {stamp} put in."""
    stamp = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    parts = {"e": F.col("event_id").cast("string"), "u": F.col("user_id").cast("string"), "k": F.col("k").cast("string"), "k3": (F.col("k") * 3).cast("string"), "stamp": stamp}
    out: list[Column] = []
    for i, piece in enumerate(template.split("@")):
        if piece:
            out.append(parts[piece] if i % 2 else F.lit(piece))
    return F.concat(*out)


def _pick(*cases: tuple[Column, str], last: str) -> Column:
    out = None
    for c, t in cases:
        out = F.when(c, _text(t)) if out is None else out.when(c, _text(t))
    return out.otherwise(_text(last))


_E = lambda n: F.col("event_id") % n == 0
_HEAD = '{"type":"assistant","sessionId":"s@u@","timestamp":"@stamp@","requestId":"q@e@","message":{"id":"m@e@","model":"atlas-4","usage":'


def _claude(spark, sf_dir) -> DataFrame:
    return claude.classify(_lines(spark, sf_dir, _pick(
        (_E(7), _HEAD + '{"input_tokens":@k@.5}}}'),
        (_E(5), _HEAD + '{"iterations":[{"input_tokens":@k@},{"output_tokens":@k3@,"input_tokens":1}]}}}'),
        (_E(3), '{"type":"user"}'),
        last=_HEAD + '{"input_tokens":@k@,"output_tokens":@k3@,"iterations":[{"input_tokens":9}]},"content":[{"type":"tool_use","name":"Edit","input":{"file_path":"/r/@k@"}}]}}',
    )))


@query("SELECT CASE WHEN e % 7 = 0 THEN 'malformed' WHEN e % 5 <> 0 AND e % 3 = 0 THEN 'ignored' ELSE 'event' END AS outcome, CAST(count(*) AS BIGINT) AS lines FROM b GROUP BY 1", _B)
def transcript_outcomes(spark, sf_dir):
    return _claude(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("lines"))


@query("""SELECT 's' || u AS session_id, 'm' || e || ':q' || e AS id, ts_ms // 1000 * 1000 AS ts_ms,
 CASE WHEN e % 5 = 0 OR k = 0 THEN k + CASE WHEN e % 5 = 0 THEN 1 ELSE 9 END ELSE k END AS input, CASE WHEN e % 5 = 0 OR k > 0 THEN k * 3 ELSE 0 END AS output, CASE WHEN e % 5 = 0 THEN [] ELSE ['/r/' || k] END AS edited_files
 FROM b WHERE e % 7 <> 0 AND (e % 5 = 0 OR e % 3 <> 0)""", _B)  # fmt: skip
def token_normalise_claude(spark, sf_dir):
    return exploded(_claude(spark, sf_dir)).select("session_id", "id", "ts_ms", "input", "output", "edited_files")


@query("SELECT e AS event_id, CASE WHEN e % 4 IN (0, 3) THEN k END AS n FROM b", _B)
def token_bounds(spark, sf_dir):
    b = demo.base(spark, sf_dir)
    k = F.col("k").cast("string")
    e = F.col("event_id")
    text = F.when(e % 4 == 0, F.concat(F.lit('{"n":'), k, F.lit("}"))).when(e % 4 == 1, F.concat(F.lit('{"n":-'), k, F.lit(".25}"))).when(e % 4 == 2, F.concat(F.lit('{"n":"'), k, F.lit('"}'))).otherwise(F.concat(F.lit('{"n":'), k, F.lit(".0}")))
    return b.withColumn("v", parse(text)).select("event_id", count(F.col("v"), "$.n").alias("n"))


_COUNT = '{"timestamp":"@stamp@","type":"event_msg","payload":{"type":"token_count","info":{"total_token_usage":{"input_tokens":@k3@,"cached_input_tokens":@k@,"output_tokens":@k@}}}}'


@query("""SELECT 'u' || u AS name, e AS line_no, coalesce('S' || last_value(CASE WHEN t = 'purchase' THEN e END IGNORE NULLS) OVER w, '/x/tmp/p/chats/u' || u || '.jsonl') AS session_id,
 greatest(i - c, 0) AS input, c AS cache_read, o AS output, '/w/' || last_value(CASE WHEN t = 'purchase' THEN k END IGNORE NULLS) OVER w AS cwd FROM (
 SELECT *, greatest(k * 3 - coalesce(lag(x * 3) OVER v, 0), 0) AS i, greatest(k - coalesce(lag(x) OVER v, 0), 0) AS c, greatest(k - coalesce(lag(x) OVER v, 0), 0) AS o FROM (
   SELECT *, last_value(CASE WHEN t NOT IN ('purchase', 'click') THEN k END IGNORE NULLS) OVER (PARTITION BY u ORDER BY e) AS x FROM b) WINDOW v AS (PARTITION BY u ORDER BY e))
 WINDOW w AS (PARTITION BY u ORDER BY e) QUALIFY t NOT IN ('purchase', 'click')""", _B)  # fmt: skip
def codex_delta(spark, sf_dir):
    """State carried forward, and cumulative totals as positive differences."""
    return _codex(spark, sf_dir).select(F.regexp_extract("source_file", r"(u\d+)\.jsonl$", 1).alias("name"), "line_no", "session_id", "input", "cache_read", "output", "cwd")


def _codex(spark, sf_dir) -> DataFrame:
    call = '{"type":"response_item","payload":{"type":"function_call","name":"apply_patch","arguments":"{\\"input\\":\\"*** Update File: /f/@k@\\\\n\\"}"}}'
    return exploded(codex.classify(_lines(spark, sf_dir, _pick(
        (F.col("event_type") == "purchase", '{"type":"session_meta","payload":{"id":"S@e@","cwd":"/w/@k@"}}'),
        (F.col("event_type") == "click", call),
        last=_COUNT,
    ))))


@query("""SELECT g.e AS line_no, coalesce(list_sort(list_distinct(list('/f/' || c.k) FILTER (c.k IS NOT NULL))), []) AS edited_files FROM
 (SELECT *, coalesce(lag(e) OVER (PARTITION BY u ORDER BY e), -1) AS before FROM b WHERE t NOT IN ('purchase', 'click')) g LEFT JOIN b c ON c.u = g.u AND c.t = 'click' AND c.e > g.before AND c.e < g.e GROUP BY g.e""", _B)  # fmt: skip
def codex_pending_edits(spark, sf_dir):
    return _codex(spark, sf_dir).select("line_no", F.sort_array("edited_files").alias("edited_files"))


@query("SELECT 'u' || u || ':' || e AS id, greatest(k - k * 3, 0) + CASE WHEN e % 2 = 0 THEN k ELSE 0 END AS input, k * 3 + 5 AS output, CASE WHEN e % 2 = 0 THEN 0 ELSE k * 3 END AS cache_read, e % 2 = 0 AS even FROM b WHERE e % 9 <> 0", _B)
def gemini_tokens(spark, sf_dir):
    say = '{"id":@e@,"timestamp":"@stamp@","type":"gemini","model":"cirrus","tokens":{"input":@k@,"output":@k3@,"thoughts":5'
    text = _pick((_E(9), '{"type":"info"}'), (_E(2), say + "}}"), last=say + ',"cached":@k3@}}')
    rows = _lines(spark, sf_dir, text, F.lit(False).alias("nested"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("fallback"), F.lit(None).cast("string").alias("cwd"))
    return exploded(gemini.classify(rows)).select("id", "input", "output", "cache_read", (F.col("line_no") % 2 == 0).alias("even"))


@query("SELECT e AS event_id, CASE WHEN e % 3 = 0 THEN k * 1000 + (e % 10) * 100 WHEN e % 3 = 1 THEN k END AS n FROM b", _B)
def aider_counts(spark, sf_dir):
    k, e = F.col("k").cast("string"), F.col("event_id")
    text = F.when(e % 3 == 0, F.concat(k, F.lit("."), (e % 10).cast("string"), F.lit("k"))).when(e % 3 == 1, k).otherwise(F.concat(k, F.lit(".5")))
    return demo.base(spark, sf_dir).select("event_id", aider.token_count(text).alias("n"))


@query("""SELECT 'u' || u AS name, e AS line_no, 'aider:' || (sts // 1000 * 1000) || ':' || (ord - 1) || ':' || (row_number() OVER (PARTITION BY u, ord ORDER BY e) - 1) AS id, k * 1000 AS input, k AS output FROM (
 SELECT *, sum(CASE WHEN t = 'purchase' THEN 1 ELSE 0 END) OVER w AS ord, last_value(CASE WHEN t = 'purchase' THEN ts_ms END IGNORE NULLS) OVER w AS sts FROM b WINDOW w AS (PARTITION BY u ORDER BY e))
 WHERE t NOT IN ('purchase', 'click') AND ord > 0""", _B)  # fmt: skip
def aider_sessions(spark, sf_dir):
    header = F.concat(F.lit("# aider chat started at "), F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd HH:mm:ss"))
    text = F.when(F.col("event_type") == "purchase", header).when(F.col("event_type") == "click", _text("> Applied edit to f@k@")).otherwise(_text("> Tokens: @k@k sent, @k@ received."))
    found = exploded(aider.classify(_lines(spark, sf_dir, text), F.lit("/r")))
    return found.select(F.regexp_extract("source_file", r"(u\d+)\.jsonl$", 1).alias("name"), "line_no", "id", "input", "output")


@query("SELECT e AS event_id, ['/abs/a' || k, '/w/b' || (k % 5)] AS paths FROM b", _B)
def patch_paths(spark, sf_dir):
    patch = _text("*** Begin Patch\n*** Add File: /abs/x/../a@k@\n+*** no\n*** Delete File: ./b")
    text = F.concat(patch, (F.col("k") % 5).cast("string"), F.lit("\r\n*** End Patch"))
    return demo.base(spark, sf_dir).select("event_id", codex.patch_paths(text, F.lit("/w")).alias("paths"))


@query("SELECT e AS event_id, CASE e % 4 WHEN 0 THEN 'src/n' || k || '/a' WHEN 1 THEN 'n' || k WHEN 2 THEN 'src/a' || k ELSE 'plain' || k END AS path FROM b", _B)
def rename_collapse(spark, sf_dir):
    e = F.col("event_id")
    text = F.when(e % 4 == 0, _text("src/{o@k@ => n@k@}/a")).when(e % 4 == 1, _text("o@k@ => n@k@")).when(e % 4 == 2, _text("src/{old => }/a@k@")).otherwise(_text("plain@k@"))
    return demo.base(spark, sf_dir).select("event_id", collapse_rename(text).alias("path"))


@query("SELECT 'h' || e AS hash, CASE WHEN e % 13 = 0 THEN [] ELSE ['f' || k, 'bin'] END AS files, CASE WHEN e % 13 = 0 THEN 0 ELSE k END AS insertions, CASE WHEN e % 13 = 0 THEN 0 ELSE k * 3 END AS deletions, e % 13 = 0 AS is_merge, ts_ms // 1000 * 1000 AS author_ts_ms, CASE WHEN e % 2 = 0 THEN 'b' || u END AS branch_hint FROM b", _B)
def git_log_parse(spark, sf_dir):
    e = F.col("event_id")
    source = F.when(e % 2 == 0, _text("refs/heads/b@u@")).otherwise(F.lit("refs/tags/x"))
    parents = F.when(e % 13 == 0, F.lit("p q")).otherwise(F.lit("p"))
    value = F.concat(_text("h@e@\x1f"), parents, _text("\x1f@stamp@\x1fsubject\x1f"), source, _text("\n@k@\t@k3@\tf@k@\n-\t-\tbin\nnoise"))
    log = demo.base(spark, sf_dir).select(value.alias("value"), e.alias("pos"))
    return gitlog.parse_log(log, True).select("hash", "files", "insertions", "deletions", "is_merge", "author_ts_ms", "branch_hint")


@query("""SELECT e AS line_no, 's' || u || ':' || stamp || ':' || substr(sha256('{"cache_read_input_tokens":5,"input_tokens":' || k * 3 || ',"output_tokens":' || k || '}'), 1, 16) AS id
 FROM (SELECT *, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM b) WHERE e % 6 <> 0""", _B)  # fmt: skip
def claude_ids(spark, sf_dir):
    """Records without ids of their own: by session, time and the hash of their canonical usage.  Those
    that stand for failed calls are left out."""
    text = '{"type":"assistant","sessionId":"s@u@","timestamp":"@stamp@","message":{"model":"%s","usage":{"output_tokens":@k@,"input_tokens":@k3@.0,"cache_read_input_tokens":5}}}'
    rows = _lines(spark, sf_dir, _pick((_E(6), text % claude.SYNTHETIC), last=text % "atlas-4"))
    return exploded(claude.classify(rows)).select("line_no", "id")


@query("""SELECT e AS line_no, coalesce('S' || m.e, '/x/tmp/p/chats/u' || u || '.jsonl') AS session_id, coalesce(model, '') AS model, CASE WHEN m.e % 5 <> 0 THEN 'b' || m.k END AS git_branch, coalesce(m.e % 2 = 0 OR m.e % 3 = 0, false) AS is_sidechain
 FROM (SELECT *, last_value(CASE WHEN t = 'purchase' THEN {'e': e, 'k': k} END IGNORE NULLS) OVER w AS m, last_value(CASE WHEN t = 'click' AND e % 7 <> 0 THEN 'm' || k END IGNORE NULLS) OVER w AS model FROM b WINDOW w AS (PARTITION BY u ORDER BY e)) WHERE t NOT IN ('purchase', 'click')""", _B)  # fmt: skip
def codex_state(spark, sf_dir):
    """Session, model, branch and subagent as the lines before a call tell them."""
    meta = '{"type":"session_meta","payload":{"id":"S@e@"%s}}'
    branch, sub, nested = ',"git":{"branch":"b@k@"}', ',"thread_source":"subagent"', ',"source":{"subagent":{"n":1}}'
    is_meta = F.col("event_type") == "purchase"
    cases = []
    for five in (True, False):
        for two in (True, False):
            for three in (True, False):
                is_case = is_meta & (_E(5) == F.lit(five)) & (_E(2) == F.lit(two)) & (_E(3) == F.lit(three))
                cases.append((is_case, meta % (("" if five else branch) + (sub if two else "") + (nested if three else ',"source":"cli"'))))
    turn = F.col("event_type") == "click"
    cases += [(turn & _E(7), '{"type":"turn_context","payload":{}}'), (turn, '{"type":"turn_context","payload":{"model":"m@k@"}}')]
    found = exploded(codex.classify(_lines(spark, sf_dir, _pick(*cases, last=_COUNT))))
    return found.select("line_no", "session_id", "model", "git_branch", "is_sidechain")


def _gemini(spark, sf_dir) -> DataFrame:
    """A file's first line is its metadata; then patches with a bad member, rewinds, and messages."""
    head = F.col("event_id") == F.min("event_id").over(Window.partitionBy("user_id"))
    say = '{"id":@e@,"timestamp":"@stamp@","type":"gemini","model":"cirrus","tokens":{"input":@k@,"output":1}'
    text = _pick(
        (head & _E(2), '{"sessionId":"G@e@","kind":"main"}'), (head, '{"sessionId":"G@e@","kind":"sub"}'),
        (_E(4), '{"$set":{"messages":[{"type":"user"},3,' + say + "}]}}"), (F.col("event_id") % 4 == 1, '{"$rewindTo":"@e@"}'),
        last=say + ',"toolCalls":[{"name":"replace","args":{"file_path":"a@k@"}},{"name":"read_file","args":{"file_path":"b"}}]}',
    )
    return gemini.classify(_lines(spark, sf_dir, text, F.lit(False).alias("nested"), F.lit("name").alias("fallback"), F.lit("/p").alias("cwd")))


_GEMINI = _B + ", g AS (SELECT *, min(e) OVER (PARTITION BY u) AS head FROM b)"


@query("SELECT e AS line_no, CAST(0 AS INTEGER) AS sub_no, 'G' || head || ':' || e AS id, k AS input, CASE WHEN e % 4 = 0 THEN [] ELSE ['/p/a' || k] END AS edited_files, head % 2 <> 0 AS is_sidechain FROM g WHERE e <> head AND e % 4 <> 1", _GEMINI)
def gemini_lines(spark, sf_dir):
    return exploded(_gemini(spark, sf_dir)).select("line_no", "sub_no", "id", "input", "edited_files", "is_sidechain")


@query("SELECT CASE WHEN e = head OR e % 4 = 1 THEN 'ignored' WHEN e % 4 = 0 THEN 'malformed' ELSE 'event' END AS outcome, CAST(count(*) AS BIGINT) AS lines, CAST(count(*) FILTER (e <> head AND e % 4 <> 1) AS BIGINT) AS events FROM g GROUP BY 1", _GEMINI)
def gemini_outcomes(spark, sf_dir):
    """A line with a bad member counts as skipped once, and its good members stay."""
    return _gemini(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("lines"), F.sum("n_events").alias("events"))


@query("SELECT e AS event_id, 'p' || (u % 7) AS slug, e % 2 = 0 AS nested, 'u' || u AS fallback, CASE WHEN u % 7 < 4 THEN '/work/p' || (u % 7) END AS cwd FROM b", _B)
def gemini_context(spark, sf_dir):
    """Project, subagent and session by the path of a file, the working directory by its project."""
    slug = F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string"))
    inner = F.when(_E(2), F.lit("parent/")).otherwise(F.lit(""))
    path = F.concat(F.lit("/home/x/.gem/tmp/"), slug, F.lit("/chats/"), inner, F.lit("u"), F.col("user_id").cast("string"), F.when(_E(3), F.lit(".json")).otherwise(F.lit(".jsonl")))
    roots = spark.createDataFrame([(f"p{i}", f"/work/p{i}") for i in range(4)], "slug string, cwd string")
    return gemini.with_context(demo.base(spark, sf_dir).select("event_id", path.alias("source_file")), "/home/x/.gem", roots).select("event_id", "slug", "nested", "fallback", "cwd")


@query("SELECT 'u' || u AS name, CAST(count(*) AS BIGINT) AS lines_read, CAST(count(*) FILTER (e % 7 <> 0 AND (e % 5 = 0 OR e % 3 <> 0)) AS BIGINT) AS events_extracted, CAST(count(*) FILTER (e % 7 = 0) AS BIGINT) AS lines_skipped, max(e) + 1 AS bytes_consumed FROM b GROUP BY u", _B)
def file_statistics(spark, sf_dir):
    told = lines.file_stats(_claude(spark, sf_dir), claude.AGENT)
    return told.select(F.regexp_extract("source_file", r"(u\d+)\.jsonl$", 1).alias("name"), "lines_read", "events_extracted", "lines_skipped", "bytes_consumed")


@query("""SELECT 'claude-code' AS agent, CAST(count(*) AS BIGINT) AS events, CAST(count(DISTINCT u) AS BIGINT) AS files FROM b WHERE u % 2 = 0 AND e % 7 <> 0 AND (e % 5 = 0 OR e % 3 <> 0)
 UNION ALL SELECT 'codex', CAST(count(*) AS BIGINT), CAST(count(DISTINCT u) AS BIGINT) FROM b WHERE u % 3 = 0 AND u % 2 <> 0 AND t NOT IN ('purchase', 'click')""", _B)  # fmt: skip
def agents_union(spark, sf_dir):
    """Two adapters' events together; a file that both find is the first one's."""
    user = F.regexp_extract("source_file", r"u(\d+)\.jsonl$", 1).cast("bigint")
    both = exploded(_claude(spark, sf_dir)).where(user % 2 == 0).unionByName(_codex(spark, sf_dir).where(user % 3 == 0))
    stats = both.select("source_file", "agent").distinct()
    # Every file of the first adapter is there to be claimed, also one without events.
    stats = stats.unionByName(_lines(spark, sf_dir, F.lit("")).where(user % 2 == 0).select("source_file", F.lit(claude.AGENT).alias("agent")).distinct()).distinct()
    kept, _ = adapters.claimed(both, stats, [claude.AGENT, codex.AGENT])
    return kept.groupBy("agent").agg(F.count("*").alias("events"), F.count_distinct("source_file").alias("files"))


@query("""SELECT b.e AS event_id FROM b JOIN (SELECT u, arg_max(t, (k, CASE t WHEN 'click' THEN 1 ELSE 0 END)) AS t, max(k) AS since FROM b WHERE t IN ('purchase', 'click') AND e % 3 = 0 GROUP BY u) m ON m.u = b.u AND m.t = 'purchase' AND b.k >= m.since WHERE NOT (b.t IN ('purchase', 'click') AND b.e % 3 = 0)""", _B)
def live_lines(spark, sf_dir):
    """Of what a stream has gathered, the lines that are in the files now: k is the generation; some
    purchases begin a file anew, some clicks find it gone."""
    marks = F.col("event_type").isin("purchase", "click") & _E(3)
    status = F.when(marks, F.when(F.col("event_type") == "purchase", "begun").otherwise("gone")).otherwise("ok")
    rows = _lines(spark, sf_dir, F.lit("x"), status.alias("_status"), F.col("k").alias("_generation"))
    rows = rows.withColumn("status", F.col("_status")).withColumn("generation", F.col("_generation"))
    return lines.latest(rows).select(F.col("offset").alias("event_id"))


@query("SELECT e AS event_id, CASE e % 3 WHEN 0 THEN 'caf\u00e9' || k || chr(9) || '\"' WHEN 1 THEN 'plain' || k ELSE 'a\\b' || k END AS path FROM b", _B)
def git_quoted_paths(spark, sf_dir):
    e = F.col("event_id")
    text = F.when(e % 3 == 0, _text('"caf\\303\\251@k@\\t\\""')).when(e % 3 == 1, _text("plain@k@")).otherwise(_text('"a\\\\b@k@"'))
    return demo.base(spark, sf_dir).select("event_id", gitlog.unquoted(text).alias("path"))


@query("""SELECT 'gpt-' || i AS model_id, CASE WHEN i % 10 = 0 THEN '' || (i // 10) ELSE (i // 10) || '.' || (i % 10) END AS input, '' || i AS output, CASE WHEN i % 4 <> 0 THEN '0.000' || lpad('' || i, 3, '0') END AS cache_read
 FROM range(101, 400) r(i) WHERE i % 7 <> 0 AND i % 5 <> 0 AND i % 10 <> 0""")  # fmt: skip
def price_feed(spark, sf_dir):
    """A community feed as cards: other providers and modes go, bad cache prices are left out."""
    feed = {}
    for i in range(101, 400):
        row = {"litellm_provider": "azure" if i % 5 == 0 else "openai", "mode": "image" if i % 7 == 0 else "chat", "input_cost_per_token": i / 1e7, "output_cost_per_token": i / 1e6}
        feed[f"gpt-{i}"] = row | {"cache_read_input_token_cost": -1 if i % 4 == 0 else i / 1e12}
    table, _ = prices.validate({"schemaVersion": 1, "asOf": "2026-01-01", "source": "feed", "models": prices.convert_feed(feed)})
    return prices.to_frame(spark, table).select("model_id", "input", "output", "cache_read")
