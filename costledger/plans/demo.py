"""The driver's tables projected onto the ledger's domain, by expressions that SQL repeats exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pricing

#: model_id, display name, and decimal prices per million tokens; a null cache price falls back.
CARDS = [
    ("atlas-4", "Atlas 4", "5", "25", "6.25", "0.5"),
    ("atlas-4-mini", "Atlas 4 Mini", "1", "5", "1.25", "0.1"),
    ("boreal-2", "Boreal 2", "0.435", "0.87", "0", "0.003625"),
    ("cirrus", "Cirrus", "2", "8", None, None),
    ("dune-1", "Dune 1", "0.1", "0.4", None, "0.025"),
]
MODELS = ["atlas-4", "atlas-4-mini-20260101", "boreal-2-20251101", "cirrus", "dune-1-preview", "mystery-x"]
REPOS = 15
SESSION_MS = 172_800_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id", "user_id", "event_type",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        (F.col("user_id") % REPOS).alias("repo_id"),
    )


def raw_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage rows as read: with duplicates and rows of unknown working directory."""
    b = base(spark, sf_dir).where("event_type <> 'purchase'")
    k, e = F.col("k"), F.col("event_id")
    path = lambda x: F.concat(F.lit("src/m"), x.cast("string"), F.lit(".ts"))
    files = F.when(F.col("event_type") == "click", F.array_distinct(F.when(k % 3 == 0, F.array(path(k % 13), path(k % 7))).otherwise(F.array(path(k % 13))))).otherwise(F.array().cast("array<string>"))
    branch = F.when(F.col("user_id") % 4 == 1, "main").when(F.col("user_id") % 4 != 0, "feat")
    models = F.array(*[F.lit(m) for m in MODELS])
    rows = b.select(
        "repo_id", e.cast("string").alias("id"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.floor(F.col("ts_ms") / SESSION_MS).cast("string")).alias("session_id"),
        "ts_ms", F.element_at(models, (e % 6 + 1).cast("int")).alias("model"),
        ((e * 37) % 5000).alias("input"), ((k * 13) % 900).alias("output"), ((e % 5) * 100).alias("cache_write"), ((e * 7919) % 20000).alias("cache_read"),
        F.when(e % 17 != 0, F.concat(F.lit("/r/"), F.col("repo_id").cast("string"), F.when(e % 2 == 0, "/src").otherwise(""))).alias("cwd"),
        branch.alias("git_branch"), files.alias("rel_files"), (e % 10 == 0).alias("is_sidechain"),
        F.lit("a.jsonl").alias("source_file"), e.alias("line_no"), F.lit(0).alias("sub_no"),
    )
    # Some rows come twice, as a session that was resumed writes them again.
    again = F.explode(F.when(F.col("line_no") % 50 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    twice = rows.withColumn("_again", again)
    return twice.withColumn("input", F.when(F.col("_again"), F.col("input") + 1).otherwise(F.col("input"))).withColumn("source_file", F.when(F.col("_again"), "b.jsonl").otherwise("a.jsonl")).drop("_again")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir).where("event_type = 'purchase'")
    k, e = F.col("k"), F.col("event_id")
    path = lambda x: F.concat(F.lit("src/m"), x.cast("string"), F.lit(".ts"))
    merge = e % 13 == 0
    return b.select(
        "repo_id", F.md5(e.cast("string").cast("binary")).alias("hash"),
        F.when(merge, F.array(F.lit("p"), F.lit("q"))).otherwise(F.array(F.lit("p"))).alias("parents"),
        F.col("ts_ms").alias("author_ts_ms"), F.concat(F.lit("commit "), e.cast("string")).alias("subject"),
        F.when(k % 3 == 1, "main").when(k % 3 == 2, "feat").alias("branch_hint"),
        F.array_distinct(F.array(path(k % 10), path((k + 3) % 10))).alias("files"),
        k.alias("insertions"), (k % 7).alias("deletions"), merge.alias("is_merge"),
    )


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CARDS, pricing.CARD)


_USAGE = """
b AS (SELECT event_id AS e, user_id AS u, event_type AS t, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k,
        epoch_us(ts) // 1000 AS ts_ms, user_id % 15 AS repo_id FROM events),
raw0 AS (SELECT repo_id, CAST(e AS VARCHAR) AS id, CAST(u AS VARCHAR) || '-' || CAST(ts_ms // 172800000 AS VARCHAR) AS session_id, ts_ms,
        CASE e % 6 {models} END AS model, (e * 37) % 5000 AS input, (k * 13) % 900 AS output, (e % 5) * 100 AS cache_write, (e * 7919) % 20000 AS cache_read,
        CASE WHEN e % 17 <> 0 THEN '/r/' || repo_id || CASE WHEN e % 2 = 0 THEN '/src' ELSE '' END END AS cwd,
        CASE WHEN u % 4 = 1 THEN 'main' WHEN u % 4 <> 0 THEN 'feat' END AS git_branch,
        CASE WHEN t = 'click' THEN list_distinct(CASE WHEN k % 3 = 0 THEN ['src/m' || (k % 13) || '.ts', 'src/m' || (k % 7) || '.ts'] ELSE ['src/m' || (k % 13) || '.ts'] END) ELSE [] END AS rel_files,
        e % 10 = 0 AS is_sidechain, 'a.jsonl' AS source_file, e AS line_no FROM b WHERE t <> 'purchase'),
raw AS (SELECT * FROM raw0 UNION ALL SELECT * REPLACE (input + 1 AS input, 'b.jsonl' AS source_file) FROM raw0 WHERE line_no % 50 = 0),
marked AS (SELECT *, coalesce(cwd = '/r/' || repo_id OR starts_with(cwd, '/r/' || repo_id || '/'), false) AS inside FROM raw),
usage AS (SELECT * EXCLUDE (n, inside) FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, id ORDER BY source_file DESC, line_no DESC) AS n FROM marked WHERE inside) WHERE n = 1),
oos AS (SELECT CAST(count(*) AS BIGINT) AS oos_events, CAST(coalesce(sum(input + output + cache_write + cache_read), 0) AS BIGINT) AS oos_tokens FROM marked WHERE NOT inside),
commits AS (SELECT repo_id, md5(CAST(e AS VARCHAR)) AS hash, ts_ms AS author_ts_ms, 'commit ' || e AS subject,
        CASE k % 3 WHEN 1 THEN 'main' WHEN 2 THEN 'feat' END AS branch_hint, list_distinct(['src/m' || (k % 10) || '.ts', 'src/m' || ((k + 3) % 10) || '.ts']) AS files,
        k AS insertions, k % 7 AS deletions, e % 13 = 0 AS is_merge FROM b WHERE t = 'purchase'),
targets AS (SELECT * FROM commits WHERE NOT is_merge)"""

_ATTRIBUTION = """
edits AS (SELECT repo_id, id, ts_ms, git_branch, rel_files, len(rel_files) AS n_rel FROM usage WHERE len(rel_files) > 0),
cand AS (SELECT e.repo_id, e.id, e.ts_ms, e.git_branch, t.hash, t.author_ts_ms, t.branch_hint, len(list_intersect(e.rel_files, t.files)) / e.n_rel AS file_score,
        least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1.0::DOUBLE - (t.author_ts_ms - e.ts_ms) / {horizon}.0::DOUBLE)) AS time_score,
        CASE WHEN e.git_branch IS NULL OR t.branch_hint IS NULL THEN 0.5::DOUBLE WHEN e.git_branch = t.branch_hint THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS branch_score
      FROM edits e JOIN targets t ON t.repo_id = e.repo_id AND t.author_ts_ms BETWEEN e.ts_ms - 120000 AND e.ts_ms + {horizon}),
scored AS (SELECT *, (0.6::DOUBLE * file_score + 0.25::DOUBLE * time_score) + 0.15::DOUBLE * branch_score AS score FROM cand),
matched AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY repo_id, id) AS n FROM scored WHERE file_score > 0 WINDOW w AS (PARTITION BY repo_id, id ORDER BY score DESC, author_ts_ms, hash)),
best AS (SELECT repo_id, id, 'commit' AS kind, hash, CASE WHEN file_score >= 0.8 AND (branch_score = 1 OR n = 1) THEN 'high' WHEN file_score >= 0.4 THEN 'medium' ELSE 'low' END AS confidence, file_score, time_score, branch_score, score FROM matched WHERE r = 1),
timed AS (SELECT *, row_number() OVER (PARTITION BY repo_id, id ORDER BY CASE WHEN git_branch IS NOT NULL AND branch_hint = git_branch THEN 0 ELSE 1 END, author_ts_ms, hash) AS r
      FROM scored s WHERE author_ts_ms >= ts_ms AND NOT EXISTS (SELECT 1 FROM best x WHERE x.repo_id = s.repo_id AND x.id = s.id)),
fallback AS (SELECT repo_id, id, 'commit' AS kind, hash, 'low' AS confidence, file_score, time_score, branch_score, score FROM timed WHERE r = 1),
won AS (SELECT * FROM best UNION ALL SELECT * FROM fallback),
own AS (SELECT e.repo_id, e.id, e.ts_ms, coalesce(won.kind, 'waste') AS kind, hash, confidence, file_score, time_score, branch_score, score FROM edits e LEFT JOIN won ON won.repo_id = e.repo_id AND won.id = e.id),
src AS (SELECT u.repo_id, u.session_id, u.id, u.ts_ms, CASE WHEN len(rel_files) > 0 THEN id END AS eid FROM usage u),
adopt AS (SELECT repo_id, id, coalesce(last_value(eid IGNORE NULLS) OVER (PARTITION BY repo_id, session_id ORDER BY ts_ms DESC, id DESC ROWS UNBOUNDED PRECEDING),
        last_value(eid IGNORE NULLS) OVER (PARTITION BY repo_id, session_id ORDER BY ts_ms, id ROWS UNBOUNDED PRECEDING)) AS sid FROM src),
newest AS (SELECT repo_id, max(author_ts_ms) AS m FROM commits GROUP BY repo_id),
attributed AS (SELECT u.*, coalesce(o.kind, 'overhead') AS kind, o.hash, o.confidence, o.file_score, o.time_score, o.branch_score, o.score,
        CASE WHEN a.sid <> u.id AND o.score IS NOT NULL THEN a.sid END AS adopted_from,
        CASE WHEN o.kind IS NULL OR (o.kind = 'commit' AND o.file_score = 0) THEN 'advisory' ELSE 'measured' END AS provenance,
        coalesce(o.kind, 'overhead') = 'waste' AND (m IS NULL OR u.ts_ms > m) AS in_progress
      FROM usage u JOIN adopt a ON a.repo_id = u.repo_id AND a.id = u.id LEFT JOIN own o ON o.repo_id = a.repo_id AND o.id = a.sid LEFT JOIN newest nw ON nw.repo_id = u.repo_id)"""

_COST = lambda c: f"CAST(CAST({c} AS HUGEINT) * p.{c}_nano // 1000000 AS BIGINT)"
_PRICES = """
cards AS (SELECT * FROM (VALUES {cards}) AS v(model_id, display_name, input_nano, output_nano, cache_write_nano, cache_read_nano, cache_fallback)),
models AS (SELECT model, model_id FROM (SELECT m.model, c.model_id, row_number() OVER (PARTITION BY m.model ORDER BY length(c.model_id) DESC) AS r FROM (SELECT DISTINCT model FROM usage) m JOIN cards c ON starts_with(m.model, c.model_id)) WHERE r = 1),
ledger AS (SELECT a.*, a.input + a.output + a.cache_write + a.cache_read AS total, p.model_id AS price_id, p.display_name, p.input_nano, p.cache_read_nano, {costs}, cost_input + cost_output + cost_cache_write + cost_cache_read AS cost_total
      FROM attributed a LEFT JOIN models m ON m.model = a.model LEFT JOIN cards p ON p.model_id = m.model_id)"""


def _nano(price: str) -> int:
    whole, _, part = price.partition(".")
    return int(whole) * 10**9 + int((part + "0" * 9)[:9])


def _card_rows() -> str:
    rows = []
    for i, name, *prices in CARDS:
        n = [None if p is None else _nano(p) for p in prices]
        full = [*n[:2], *[n[0] if x is None else x for x in n[2:]]]
        rows.append(f"('{i}', '{name}', {', '.join(f'CAST({x} AS BIGINT)' for x in full)}, {str(None in n[2:]).lower()})")
    return ", ".join(rows)


def usage_sql() -> str:
    return _USAGE.replace("{models}", " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MODELS)))


def attribution_sql(horizon_ms: int) -> str:
    return usage_sql() + "," + _ATTRIBUTION.replace("{horizon}", str(horizon_ms))


def ledger_sql(horizon_ms: int) -> str:
    costs = ", ".join(f"{_COST(c)} AS cost_{c}" for c in ("input", "output", "cache_write", "cache_read"))
    return attribution_sql(horizon_ms) + "," + _PRICES.replace("{cards}", _card_rows()).replace("{costs}", costs)
