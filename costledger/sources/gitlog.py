"""Git history: one subprocess on the driver, or a log that was saved before."""

from __future__ import annotations

import re
import subprocess

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.paths import collapse_rename
from ..functions.jsonv import millis

# The log format (record and field separators, then hash, parents, author date, subject, source).
RECORD, FIELD = "\x1e", "\x1f"
PRETTY = "%x1e%H%x1f%P%x1f%aI%x1f%s"
COMMIT = "hash string, parents array<string>, author_ts_ms bigint, subject string, branch_hint string, files array<string>, insertions bigint, deletions bigint, is_merge boolean, enum_pos bigint"
_ESCAPES = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "\\": 92, '"': 34}


class GitError(RuntimeError):
    pass


def git(repo: str, *args: str, check: bool = True) -> str:
    try:
        run = subprocess.run(["git", "-C", repo, *args], capture_output=True, timeout=600)
    except FileNotFoundError as e:
        raise GitError("git is not installed") from e
    if check and run.returncode:
        raise GitError(run.stderr.decode("utf-8", "replace").strip() or f"git {args[0]} failed")
    return run.stdout.decode("utf-8", "replace") if run.returncode == 0 else ""


def repo_root(folder: str) -> str:
    return git(folder, "rev-parse", "--show-toplevel").strip()


def is_shallow(repo: str) -> bool:
    return git(repo, "rev-parse", "--is-shallow-repository").strip() == "true"


def has_head(repo: str) -> bool:
    return bool(git(repo, "rev-parse", "--verify", "--quiet", "HEAD^{commit}", check=False).strip())


def resolve_ref(repo: str, ref: str) -> str:
    found = git(repo, "rev-parse", "--verify", "--quiet", "--end-of-options", f"{ref}^{{commit}}", check=False).strip()
    if not found:
        raise GitError(f"unknown revision {ref}")
    return found


def rev_list(spark: SparkSession, repo: str, span: str) -> DataFrame:
    """(hash): the commits of a range."""
    return spark.createDataFrame([(h,) for h in git(repo, "rev-list", span, "--").split()], "hash string")


def unquote(path: str) -> str:
    """A path as git quotes it in C style, with octal bytes."""
    if len(path) < 2 or path[0] != '"' or path[-1] != '"':
        return path
    out = bytearray()
    for m in re.finditer(r"\\([0-7]{1,3})|\\(.)|([^\\]+)", path[1:-1], re.S):
        octal, sign, plain = m.groups()
        if octal:
            out.append(int(octal, 8) & 255)
        elif sign:
            out += bytes([_ESCAPES[sign]]) if sign in _ESCAPES else sign.encode()
        else:
            out += plain.encode()
    return out.decode("utf-8", "replace")


@F.pandas_udf(StringType())
def _unquote(paths: pd.Series) -> pd.Series:
    return paths.map(unquote)


def unquoted(path: Column) -> Column:
    """``unquote`` of a column."""
    return _unquote(path)


def parse_log(text: DataFrame, with_source: bool = False) -> DataFrame:
    """``text`` (value, pos): one record each, without its separator -> COMMIT.

    Merges have no files; binary files count no lines; records without hash or date are left out.
    """
    head, rest = F.split("value", "\n", 2), F.split("value", "\n")
    f = F.split(F.get(head, 0), FIELD)
    field = lambda i: F.coalesce(F.get(f, i), F.lit(""))
    parents = F.when(field(1) == "", F.array().cast("array<string>")).otherwise(F.split(field(1), " "))
    lines = F.filter(rest, lambda x, i: (i > 0) & x.rlike(r"^(\d+|-)\t(\d+|-)\t(.+)$"))
    base = text.select("pos", field(0).alias("hash"), parents.alias("parents"), millis(field(2)).alias("author_ts_ms"), field(3).alias("subject"), field(4).alias("src"), lines.alias("lines"))
    base = base.where("hash <> '' and author_ts_ms is not null").withColumn("is_merge", F.size("parents") > 1)
    stat = base.where("not is_merge").select("pos", F.posexplode("lines").alias("n", "l"))
    part = lambda i: F.regexp_extract("l", r"^(\d+|-)\t(\d+|-)\t(.+)$", i)
    stat = stat.select("pos", "n", part(1).alias("a"), part(2).alias("d"), part(3).alias("raw"))
    # Quoted paths are rare; only they go through Python.
    quoted = stat.where(F.col("raw").startswith('"')).withColumn("path", collapse_rename(_unquote("raw")))
    plain = stat.where(~F.col("raw").startswith('"')).withColumn("path", collapse_rename(F.col("raw")))
    number = lambda c: F.coalesce(F.sum(F.when(F.col(c) != "-", F.col(c).cast("bigint"))), F.lit(0)).cast("bigint")
    files = plain.unionByName(quoted).groupBy("pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "path"))), lambda s: s["path"]).alias("files"), number("a").alias("insertions"), number("d").alias("deletions"))
    out = base.join(files, "pos", "left")
    hint = F.when(F.lit(with_source) & F.col("src").startswith("refs/heads/"), F.substr(F.col("src"), F.lit(12)))
    return out.select(
        "hash", "parents", "author_ts_ms", "subject", hint.alias("branch_hint"), F.coalesce("files", F.array().cast("array<string>")).alias("files"),
        F.coalesce("insertions", F.lit(0)).cast("bigint").alias("insertions"), F.coalesce("deletions", F.lit(0)).cast("bigint").alias("deletions"), "is_merge", F.col("pos").alias("enum_pos"),
    )


def records(spark: SparkSession, log: str) -> DataFrame:
    parts = [p for p in log.split(RECORD)[1:]]
    return spark.createDataFrame([(p, i) for i, p in enumerate(parts)], "value string, pos bigint")


def read(spark: SparkSession, repo: str, repo_id: str | None = None, all_refs: bool = False, span: str | None = None) -> DataFrame:
    """A repository's commits, newest first by ``enum_pos``; an empty one has none."""
    if has_head(repo):
        # The options that decide what a line of the log looks like.
        args = ["-c", "core.quotepath=false", "-c", "log.showSignature=false", "-c", "diff.renames=true", "log"]
        if all_refs:
            args += [*([span] if span else []), "--exclude=refs/notes/*", "--exclude=refs/stash", "--all", "--source"]
        else:
            args.append(span or "HEAD")
        pretty = PRETTY + ("%x1f%S" if all_refs else "")
        log = git(repo, *args, "--date-order", "--no-color", f"--pretty=format:{pretty}", "--numstat")
    else:
        log = ""
    return parse_log(records(spark, log), all_refs).withColumn("repo_id", F.lit(repo_id or repo))
