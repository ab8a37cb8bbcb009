"""From raw usage rows to the events of a repository: scope, duplicates, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_scope(cwd: Column, root: Column) -> Column:
    """The working directory is the repository's root or below it; an unknown one is out of scope."""
    return F.coalesce((cwd == root) | cwd.startswith(F.concat(root, F.lit("/"))), F.lit(False))


def total_tokens() -> Column:
    return F.col("input") + F.col("output") + F.col("cache_write") + F.col("cache_read")


def split_scope(raw: DataFrame, root: Column) -> tuple[DataFrame, DataFrame]:
    """(rows in scope, one row with the tally of the others).  The tally counts duplicates too."""
    marked = raw.withColumn("_in", in_scope(F.col("cwd"), root))
    tally = marked.where("not _in").agg(F.count("*").alias("oos_events"), F.coalesce(F.sum(total_tokens()), F.lit(0)).cast("bigint").alias("oos_tokens"))
    return marked.where("_in").drop("_in"), tally


def last_wins(raw: DataFrame, keys: tuple[str, ...] = ("repo_id", "id")) -> DataFrame:
    """Of rows with one id the last in (source_file, line_no, sub_no) stays.

    An aggregate, not a window: an id that many rows repeat is combined before the shuffle.
    """
    place = ["source_file", "line_no", "sub_no"]
    rest = [*place, *[c for c in raw.columns if c not in (*keys, *place)]]
    return raw.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r")).select(*keys, *[f"_r.{c}" for c in rest]).select(*raw.columns)


def first_adapter(files: DataFrame) -> DataFrame:
    """``files`` (source_file, adapter_rank, agent): a path that several adapters find is the first one's."""
    w = Window.partitionBy("source_file").orderBy("adapter_rank")
    return files.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def relative_paths(files: Column, root: Column) -> Column:
    """Absolute edited paths below the root, relative to it, without repeats."""
    prefix = F.concat(root, F.lit("/"))
    return F.array_distinct(F.transform(F.filter(files, lambda p: p.startswith(prefix)), lambda p: F.substr(p, F.length(prefix) + 1)))


def in_window(ts: Column, since: int | None, until: int | None) -> Column:
    """Both ends included; null leaves that side open."""
    keep = F.lit(True)
    if since is not None:
        keep = keep & (ts >= since)
    if until is not None:
        keep = keep & (ts <= until)
    return keep
