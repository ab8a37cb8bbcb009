"""Which commit a usage event belongs to.

Edit events (those that edited files of the repository) compare with the commits of a time window by
shared files, time and branch; where none shares a file, the next commit within the horizon takes
them, and else they are waste.  Other events adopt the result of the next edit event of their
session, or of its last one; sessions without any are overhead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DAY_MS, AttributionConfig
from .fill import ROLE, nearest
from .tables import Keep, dropped, everything, mode, part, parts_of, store, written

NAMES = ["kind", "hash", "confidence", "file_score", "time_score", "branch_score", "score"]
#: Time buckets that a window is cut into for the join on files.
BUCKETS = 14


def targets(commits: DataFrame) -> DataFrame:
    """Commits that can take events: no merges, at most one parent."""
    return commits.where(~F.col("is_merge") & (F.size("parents") <= 1))


def _time_score(author_ts: Column, ts: Column, cfg: AttributionConfig) -> Column:
    raw = F.lit(1.0) - (author_ts - ts) / F.lit(float(max(1, cfg.horizon_ms)))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def _branch_score(own: Column, hint: Column) -> Column:
    return F.when(own.isNull() | hint.isNull(), 0.5).when(own == hint, 1.0).otherwise(0.0)


def _score(file: Column, time: Column, branch: Column, cfg: AttributionConfig) -> Column:
    return (F.lit(cfg.weight_file) * file + F.lit(cfg.weight_time) * time) + F.lit(cfg.weight_branch) * branch


PAIR = ["repo_id", "id", "ts_ms", "git_branch", "n_rel", "hash", "author_ts_ms", "branch_hint"]


def _pairs(edits: DataFrame, commits: DataFrame, cfg: AttributionConfig) -> DataFrame:
    """(PAIR): a row for each file that an edit event shares with a commit in its window.

    An equi-join on repository, file and time bucket.  A bucket is a fourteenth of the window, and a commit
    is in each that its events can be in: a file that every commit touches is spread over many keys,
    and an event meets little more than the commits that can take it.
    """
    width = max(1, -(-(cfg.horizon_ms + cfg.grace_ms) // BUCKETS))
    bucket = lambda c: F.floor(c / width)
    left = edits.select("repo_id", "id", "ts_ms", "git_branch", F.size(F.array_distinct("rel_files")).alias("n_rel"), F.explode(F.array_distinct("rel_files")).alias("file"), bucket(F.col("ts_ms")).alias("b"))
    at = F.col("author_ts_ms")
    reach = F.sequence(bucket(at - cfg.horizon_ms), bucket(at + cfg.grace_ms))
    right = targets(commits).select("repo_id", "hash", "author_ts_ms", "branch_hint", F.explode(F.array_distinct("files")).alias("file")).withColumn("b", F.explode(reach))
    near = at.between(F.col("ts_ms") - cfg.grace_ms, F.col("ts_ms") + cfg.horizon_ms)
    return left.join(right, ["repo_id", "file", "b"]).where(near).select(*PAIR)


def file_candidates(edits: DataFrame, commits: DataFrame, cfg: AttributionConfig) -> DataFrame:
    """(PAIR, hits): commits in the window that share files with an edit event, and how many.

    An event of one file meets a commit once, so its pairs are not shuffled to be counted."""
    size = F.size(F.array_distinct("rel_files"))
    one = _pairs(edits.where(size == 1), commits, cfg).withColumn("hits", F.lit(1).cast("bigint"))
    return one.unionByName(_pairs(edits.where(size > 1), commits, cfg).groupBy(*PAIR).agg(F.count("*").alias("hits")))


def _digest(files: Column) -> Column:
    """A sorted list of files as one short key (SHA-256)."""
    return F.sha2(F.to_json(files).cast("binary"), 256)


def _overlaps(edits: DataFrame, commits: DataFrame, cfg: AttributionConfig, keep: Keep = everything) -> tuple[DataFrame, DataFrame]:
    """(edit events, commits), both with ``what`` and ``hits``: a row for each number of files, of two or more, that
    sets of files share.  ``what`` is the event's set.

    Sets are compared, not events: of those with one set in a window's length one is compared.  Events' sets are
    those that ``keep`` picks."""
    span = max(1, cfg.horizon_ms + cfg.grace_ms)
    width = lambda c: F.floor(c / span)
    many = edits.where(F.col("n_rel") > 1).withColumn("what", _digest(F.col("files"))).where(keep("repo_id", "what"))
    reach = F.explode(F.sequence(width(F.col("ts_ms") - cfg.grace_ms), width(F.col("ts_ms") + cfg.horizon_ms))).alias("b")
    wanted = many.select("repo_id", "what", "files", reach).distinct().select("repo_id", "what", "b", F.explode("files").alias("file"))
    taking = commits.where(F.size("files") > 1).withColumns({"_set": _digest(F.col("files")), "b": width(F.col("author_ts_ms"))})
    given = taking.select("repo_id", "_set", "b", "files").distinct().select("repo_id", "_set", "b", F.explode("files").alias("file"))
    sets = wanted.join(given, ["repo_id", "file", "b"]).groupBy("repo_id", "what", "_set", "b").agg(F.count("*").cast("int").alias("hits")).where("hits > 1")
    levels = sets.select("repo_id", "what", "hits").distinct()
    return many.join(levels, ["repo_id", "what"]), taking.join(sets, ["repo_id", "_set", "b"])


def _best(edits: DataFrame, commits: DataFrame, cfg: AttributionConfig, keep: Keep = everything) -> DataFrame:
    """(repo_id, id, w, least, most): of the candidates by the files and sets that ``keep`` picks the first, and the least
    and greatest hash that lanes tell.

    Pairs of events and commits are not listed, since their number grows as the square of a history's density.  Of
    commits that share as many files with an event and agree with its branch alike, the first in its window scores
    highest.  So it is looked up in lanes: a repository's commits by one file, or by a set of files of which they have
    ``hits``; all of them, those of one branch, and those of none.  A commit of more hits than its lane tells only
    scores too low there, and has a lane of its own.  The last commit of the window by each file tells whether
    there is but one.
    """
    if min(cfg.weight_file, cfg.weight_time, cfg.weight_branch) < 0:
        raise ValueError("weights of the attribution are not negative")
    width = max(1, min(DAY_MS, cfg.horizon_ms + cfg.grace_ms))
    each = lambda c: F.sort_array(F.array_distinct(c))
    edits = edits.select("repo_id", "id", "ts_ms", "git_branch", each("rel_files").alias("files")).withColumn("n_rel", F.size("files"))
    commits = targets(commits).select("repo_id", "hash", "author_ts_ms", "branch_hint", each("files").alias("files"))
    by_file = lambda df: df.withColumns({"what": F.explode("files"), "hits": F.lit(1)}).where(keep("repo_id", "what"))
    event, commit = ["repo_id", "id", "ts_ms", "git_branch", "n_rel", "what", "hits"], ["repo_id", "hash", "author_ts_ms", "branch_hint", "what", "hits"]
    many, taking = _overlaps(edits, commits, cfg, keep)
    lane = lambda own, branch, *more: F.struct(F.lit(own).alias("own"), branch.cast("string").alias("branch"), *more)
    first, last = (F.col("ts_ms") - cfg.grace_ms).alias("t"), (F.col("ts_ms") + cfg.horizon_ms + 1).alias("t")
    ask = lambda own, branch, t=first, end=False: lane(own, branch, t, F.lit(end).alias("end"))
    none, branch, hint = F.lit(None), F.col("git_branch"), F.col("branch_hint")
    asked = F.filter(
        F.array(ask(False, none), F.when(branch.isNotNull(), ask(True, none)), F.when(branch.isNotNull(), ask(True, branch)), F.when(F.col("hits") == 1, ask(False, none, last, True))),
        lambda x: x.isNotNull(),
    )
    rows = by_file(edits).select(*event).unionByName(many.select(*event)).select(*event, F.lit(None).cast("string").alias("h"), F.inline(asked))
    mark = F.struct(F.col("author_ts_ms").alias("ts"), "hash", hint.alias("hint"))
    marks = by_file(commits).select(*commit).unionByName(taking.select(*commit))
    marks = marks.select("repo_id", "what", "hits", F.col("author_ts_ms").alias("t"), F.col("hash").alias("h"), mark.alias("n"), F.inline(F.array(lane(False, none), lane(True, hint))))
    found = nearest(rows, marks, ["repo_id", "what", "hits", "own", "branch"], ["t", ROLE, "h"], "n", width, before=True)
    found = found.withColumn("n", F.when(F.col("end"), F.col("earlier")).otherwise(F.col("later")))
    found = found.where(F.col("n.ts").between(F.col("ts_ms") - cfg.grace_ms, F.col("ts_ms") + cfg.horizon_ms))
    file, time, own = F.col("hits") / F.col("n_rel"), _time_score(F.col("n.ts"), F.col("ts_ms"), cfg), _branch_score(branch, F.col("n.hint"))
    rank = F.struct((-_score(file, time, own, cfg)).alias("s"), "n.ts", "n.hash", (-file).alias("f"), time.alias("time_score"), own.alias("branch_score"))
    return _united(found.select("repo_id", "id", rank.alias("w"), F.col("n.hash").alias("least"), F.col("n.hash").alias("most")))


def _united(best: DataFrame) -> DataFrame:
    return best.groupBy("repo_id", "id").agg(F.min("w").alias("w"), F.min("least").alias("least"), F.max("most").alias("most"))


def _matched(best: DataFrame) -> DataFrame:
    """(repo_id, id) and the result of what ``_best`` found among all files and sets."""
    file = -F.col("w.f")
    sure = (file >= 0.8) & ((F.col("w.branch_score") == 1.0) | (F.col("least") == F.col("most")))
    confidence = F.when(sure, "high").when(file >= 0.4, "medium").otherwise("low")
    return best.select("repo_id", "id", F.lit("commit").alias("kind"), "w.hash", confidence.alias("confidence"), file.alias("file_score"), "w.time_score", "w.branch_score", (-F.col("w.s")).alias("score"))


def file_match(edits: DataFrame, commits: DataFrame, cfg: AttributionConfig) -> DataFrame:
    """(repo_id, id) and the result for edit events that share a file with some candidate.

    The highest score wins; equal ones by the earlier author time, then the lesser hash."""
    return _matched(_best(edits, commits, cfg))


def _timed(edits: DataFrame, commits: DataFrame, cfg: AttributionConfig, *carried: str) -> DataFrame:
    """(repo_id, id, carried..., rank, r): the results by time alone, null where there is none: for each edit event a
    row of rank 2 for any branch, and one of rank 1 for its own if it has one.

    Both are looked up in one pass: a lane is a repository's commits, or those of one of its branches."""
    width = max(1, min(DAY_MS, cfg.horizon_ms))
    lane = lambda branch: F.explode(F.when(branch.isNotNull(), F.array(F.lit(None).cast("string"), branch)).otherwise(F.array(F.lit(None).cast("string")))).alias("lane")
    rows = edits.select("repo_id", "id", *carried, F.col("ts_ms").alias("t"), "git_branch", F.lit(None).cast("string").alias("h"), lane(F.col("git_branch")))
    mark = F.struct(F.col("author_ts_ms").alias("ts"), "hash", F.col("branch_hint").alias("hint"))
    marks = targets(commits).select("repo_id", F.col("author_ts_ms").alias("t"), F.col("hash").alias("h"), mark.alias("n"), lane(F.col("branch_hint")))
    # A commit of an event's time takes it; of several the least hash is the nearest.
    found = nearest(rows, marks, ["repo_id", "lane"], ["t", ROLE, "h"], "n", width).withColumnRenamed("later", "n")
    time, branch = _time_score(F.col("n.ts"), F.col("t"), cfg), _branch_score(F.col("git_branch"), F.col("n.hint"))
    result = F.struct(
        F.lit("commit").alias("kind"), F.col("n.hash").alias("hash"), F.lit("low").alias("confidence"), F.lit(0.0).alias("file_score"),
        time.alias("time_score"), branch.alias("branch_score"), _score(F.lit(0.0), time, branch, cfg).alias("score"),
    )
    near = F.col("n.ts") <= F.col("t") + cfg.horizon_ms
    return found.select("repo_id", "id", *carried, F.when(F.col("lane").isNull(), 2).otherwise(1).alias("rank"), F.when(near, result).alias("r"))


def _first_result(ranked: DataFrame, *more: Column) -> DataFrame:
    """(repo_id, id, r, ...): of each event's results that of least rank, null if it has none."""
    return ranked.groupBy("repo_id", "id").agg(F.min_by("r", F.when(F.col("r").isNotNull(), F.col("rank"))).alias("r"), *more)


def next_commit(edits: DataFrame, commits: DataFrame, cfg: AttributionConfig) -> DataFrame:
    """(repo_id, id) and the result by time alone: the first target at or after the event within the
    horizon, on the event's own branch if there is one, else on any.  Rows without one are absent."""
    return _first_result(_timed(edits, commits, cfg)).where("r is not null").select("repo_id", "id", "r.*")


def _own(edits: DataFrame, matched: DataFrame, commits: DataFrame, cfg: AttributionConfig, *carried: str) -> DataFrame:
    """(repo_id, id, carried...) and the result for every one of ``edits``: the match by files, else that by time."""
    matched = matched.select("repo_id", "id", F.lit(0).alias("rank"), F.struct(*NAMES).alias("r"))
    both = _timed(edits, commits, cfg, *carried).unionByName(matched, allowMissingColumns=True)
    out = _first_result(both, *[F.max(c).alias(c) for c in carried])
    return out.select("repo_id", "id", *carried, F.coalesce("r.kind", F.lit("waste")).alias("kind"), *[f"r.{n}" for n in NAMES[1:]])


def attribute_edits(events: DataFrame, commits: DataFrame, cfg: AttributionConfig, *carried: str) -> DataFrame:
    """(repo_id, id, carried...) and the result for every edit event."""
    edits = events.where(F.size("rel_files") > 0)
    return _own(edits, file_match(edits, commits, cfg), commits, cfg, *carried)


def _edits_table(events: DataFrame, commits: DataFrame, cfg: AttributionConfig, folder: str, n: int) -> DataFrame:
    """The results of edit events as the table ``edits`` of ``folder``, in ``n`` parts: matches by parts of files and
    sets, then results by parts of events.  Each event is compared with all that it would be in one."""
    edits, carried = events.where(F.size("rel_files") > 0), ("session_id", "ts_ms")
    if n == 1:
        return written(attribute_edits(edits, commits, cfg, *carried), folder, "edits")
    for k in range(n):
        best = written(_best(edits, commits, cfg, part(k, n)), folder, "best", mode(k))
    for k in range(n):
        mine = part(k, n)("repo_id", "id")
        out = written(_own(edits.where(mine), _matched(_united(best.where(mine))), commits, cfg, *carried), folder, "edits", mode(k))
    dropped(events.sparkSession, folder, "best")
    return out


def _newest(commits: DataFrame) -> DataFrame:
    """(repo_id, newest_ts_ms): the last commit's time of each repository."""
    return commits.groupBy("repo_id").agg(F.max("author_ts_ms").alias("newest_ts_ms"))


def _adopted(events: DataFrame, own: DataFrame, newest: DataFrame) -> DataFrame:
    """``events`` with the result of their own or of the edit event whose result they adopt."""
    marks = own.select("repo_id", "session_id", "ts_ms", "id", F.struct(F.struct(*NAMES).alias("r"), F.col("id").alias("src")).alias("v"))
    rows = nearest(events, marks, ["repo_id", "session_id"], ["ts_ms", "id", ROLE], "v", DAY_MS, before=True)
    out = rows.withColumn("_p", F.coalesce("later", "earlier")).join(newest, "repo_id", "left")
    kind = F.coalesce(F.col("_p.r.kind"), F.lit("overhead"))
    result = [kind.alias("kind"), *[F.col(f"_p.r.{n}").alias(n) for n in NAMES[1:]]]
    adopted = F.when((F.col("_p.src") != F.col("id")) & F.col("_p.r.score").isNotNull(), F.col("_p.src")).alias("adopted_from")
    out = out.select(*events.columns, *result, adopted, "newest_ts_ms")
    advisory = (F.col("kind") == "overhead") | ((F.col("kind") == "commit") & (F.col("file_score") == 0.0))
    later = F.col("newest_ts_ms").isNull() | (F.col("ts_ms") > F.col("newest_ts_ms"))
    return out.withColumn("provenance", F.when(advisory, "advisory").otherwise("measured")).withColumn("in_progress", (F.col("kind") == "waste") & later).drop("newest_ts_ms")


def attribute(events: DataFrame, commits: DataFrame, cfg: AttributionConfig | None = None, folder: str | None = None) -> DataFrame:
    """``events`` (repo_id, id, session_id, ts_ms, git_branch, rel_files, ...; id unique in its
    repository) with the result, ``adopted_from``, ``provenance`` and ``in_progress``.

    A session's order is time, then id.  An event is in progress if it is waste and later than every
    commit of its repository, merges included, or the repository has none.  The results of edit events are
    a table in ``folder``, or a new one of the shared folder; ``events`` is read several times and had
    better be a table too.
    """
    own = _edits_table(events, commits, cfg or AttributionConfig(), folder or store(events.sparkSession), parts_of(events))
    return _adopted(events, own, _newest(commits))


def attribute_table(events: DataFrame, commits: DataFrame, cfg: AttributionConfig | None, folder: str, name: str, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``finish``, which looks at single rows, makes of ``attribute``, as the table ``name`` of ``folder``.

    ``events`` is a table.  A large one is gone through in parts of whole sessions, each appended before the next begins."""
    n = parts_of(events)
    own = _edits_table(events, commits, cfg or AttributionConfig(), folder, n)
    # Written, the few repositories are known to be few, and events are not shuffled by them.
    newest = written(_newest(commits), folder, "newest")
    for k in range(n):
        keep = part(k, n)("repo_id", "session_id")
        out = written(finish(_adopted(events.where(keep), own.where(keep), newest)), folder, name, mode(k))
    dropped(events.sparkSession, folder, "edits")
    dropped(events.sparkSession, folder, "newest")
    return out
