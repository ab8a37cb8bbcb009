"""A data source of the lines of append-only logs, with their byte offsets.

``spark.read.format("costledger_lines")`` gives (source_file, offset, length, status, text, size,
mtime_ms, generation); ``readStream`` gives the same of what was appended.  Spark's text source would
split on bare carriage returns, has no offsets, and shows an unterminated last line as whole.

Options: ``path`` (a folder, or files separated by ``|``), ``suffix`` (``|``-separated, default
``.jsonl``), ``splitBytes``, ``maxLineBytes``.  Paths may be of any file system that pyarrow opens.

A line's status is ``ok``, ``oversized`` (skipped without being held) or ``truncated`` (the last one,
without a line feed: the writer is not done, so a stream reads it again).  Empty lines are left out.
A stream also gives a row of status ``begun`` for a file that it reads from its beginning, because it is
new or no longer the one that was read, and ``gone`` for one that is not there any more; the generation
of a row is that of its batch, and later batches have greater ones.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "costledger_lines"
MAX_LINE_BYTES = 10 << 20
SPLIT_BYTES = 64 << 20
BLOCK = 1 << 20
SCHEMA = "source_file string, offset bigint, length bigint, status string, text string, size bigint, mtime_ms bigint, generation bigint"


def iter_lines(read_at, start: int, end: int, size: int, cap: int) -> Iterator[tuple[int, int, str, bytes]]:
    """(offset, bytes with the line feed, status, content) of lines that begin in [start, end).

    ``read_at(n, offset)`` gives up to n bytes.  A reader that does not begin at 0 leaves the line that
    is under way to the one before it.
    """
    at = start
    if start > 0 and read_at(1, start - 1) != b"\n":
        while at < size:
            block = read_at(BLOCK, at)
            cut = block.find(b"\n")
            if cut >= 0:
                at += cut + 1
                break
            at += len(block)
            if not block:
                return
        else:
            return
    held, length, offset = [], 0, at
    while at < size:
        block = read_at(BLOCK, at)
        if not block:
            break
        begin = 0
        while True:
            cut = block.find(b"\n", begin)
            if cut < 0:
                length += len(block) - begin
                if length <= cap:
                    held.append(block[begin:])
                else:
                    held = []
                break
            if offset >= end:
                return
            length += cut - begin
            if length > cap:
                yield offset, length + 1, "oversized", b""
            else:
                yield offset, length + 1, "ok", b"".join([*held, block[begin:cut]])
            held, length, offset, begin = [], 0, at + cut + 1, cut + 1
        at += len(block)
    if length and offset < end:
        yield offset, length, "truncated", b""


def complete_until(read_at, size: int) -> int:
    """The offset behind the last line feed."""
    at = size
    while at > 0:
        begin = max(0, at - BLOCK)
        cut = read_at(at - begin, begin).rfind(b"\n")
        if cut >= 0:
            return begin + cut + 1
        at = begin
    return 0


@dataclass
class Piece(InputPartition):
    uri: str
    start: int
    end: int
    size: int
    mtime_ms: int
    generation: int
    mark: str = ""


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def list_files(options) -> list[tuple[str, int, int]]:
    """(uri, size, mtime) of all files, sorted; a folder that is not there has none."""
    suffixes = tuple(options.get("suffix", ".jsonl").split("|"))
    found = []
    for root in options["path"].split("|"):
        fs, path = pafs.FileSystem.from_uri(root)
        scheme = root[: root.index("://") + 3] if "://" in root else ""
        host = root[len(scheme) :].split("/", 1)[0] if scheme and scheme != "file://" else ""
        info = fs.get_file_info(path)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, allow_not_found=True, recursive=True)) if info.type == pafs.FileType.Directory else []
        for f in files:
            if f.type == pafs.FileType.File and f.path.endswith(suffixes):
                found.append((scheme + host + f.path, f.size, (f.mtime_ns or 0) // 1_000_000))
    return sorted(set(found))


def _read(piece: Piece, cap: int):
    if piece.mark:
        yield piece.uri, 0, 0, piece.mark, None, piece.size, piece.mtime_ms, piece.generation
        return
    with _open(piece.uri) as f:
        for offset, length, status, data in iter_lines(f.read_at, piece.start, piece.end, piece.size, cap):
            if data.endswith(b"\r"):
                data = data[:-1]
            if data or status != "ok":
                yield piece.uri, offset, length, status, data.decode("utf-8", "replace") if status == "ok" else None, piece.size, piece.mtime_ms, piece.generation


def _pieces(uri: str, start: int, size: int, mtime_ms: int, generation: int, split: int) -> list[Piece]:
    return [Piece(uri, a, min(a + split, size), size, mtime_ms, generation) for a in range(start, size, split)]


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.options = options
        self.cap = int(options.get("maxLineBytes", MAX_LINE_BYTES))

    def partitions(self):
        split = int(self.options.get("splitBytes", SPLIT_BYTES))
        return [p for uri, size, mtime in list_files(self.options) for p in _pieces(uri, 0, size, mtime, 0, split)] or [Piece("", 0, 0, 0, 0, 0)]

    def read(self, partition):
        if partition.uri:
            yield from _read(partition, self.cap)


class _Stream(DataSourceStreamReader):
    """An offset is {file: [bytes of complete lines, size, mtime]} and its generation: the time it was
    taken at, and always more than the last one's, which the option ``after`` tells of earlier runs."""

    def __init__(self, options):
        self.options = options
        self.cap = int(options.get("maxLineBytes", MAX_LINE_BYTES))
        self.seen: dict[str, list[int]] | None = None
        self.generation = int(options.get("after", 0))

    def initialOffset(self):
        return {"files": "{}", "generation": "0"}

    def latestOffset(self):
        now = {}
        for uri, size, mtime in list_files(self.options):
            old = (self.seen or {}).get(uri)
            if old and old[1:] == [size, mtime]:
                now[uri] = old
            else:
                with _open(uri) as f:
                    now[uri] = [complete_until(f.read_at, size), size, mtime]
        if now != self.seen:
            self.generation = max(self.generation + 1, int(time.time() * 1000))
        self.seen = now
        return {"files": json.dumps(now, sort_keys=True), "generation": str(self.generation)}

    def partitions(self, start, end):
        split = int(self.options.get("splitBytes", SPLIT_BYTES))
        before, after = json.loads(start["files"]), json.loads(end["files"])
        generation = int(end["generation"])
        out = [Piece(uri, 0, 0, 0, 0, generation, "gone") for uri in before if uri not in after]
        for uri, (done, size, mtime) in after.items():
            old = before.get(uri)
            if old and old[1:] == [size, mtime]:
                continue
            grown = old is not None and size > old[1]
            if not grown:
                out.append(Piece(uri, 0, 0, size, mtime, generation, "begun"))
            out += _pieces(uri, old[0] if grown else 0, done, mtime, generation, split)
        return out

    def read(self, partition):
        yield from _read(partition, self.cap)

    def commit(self, end):
        pass


class LineSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def read_lines(spark: SparkSession, path: str, suffix: str = ".jsonl", **options) -> DataFrame:
    spark.dataSource.register(LineSource)
    return spark.read.format(FORMAT).option("path", path).option("suffix", suffix).options(**options).load()


def stream_lines(spark: SparkSession, path: str, suffix: str = ".jsonl", **options) -> DataFrame:
    spark.dataSource.register(LineSource)
    return spark.readStream.format(FORMAT).option("path", path).option("suffix", suffix).options(**options).load()


def latest(lines: DataFrame) -> DataFrame:
    """Of lines gathered by a stream those of each file's latest reading from its beginning: a rewritten
    file replaces what it was, whatever its time stamp, and a file that is gone has none."""
    marks = F.col("status").isin("begun", "gone")
    last = lines.where(marks).groupBy("source_file").agg(F.max(F.struct("generation", "status")).alias("_m"))
    alive = last.where("_m.status = 'begun'").select("source_file", F.col("_m.generation").alias("_since"))
    return lines.where(~marks).join(alive, "source_file").where("generation >= _since").drop("_since")


def file_stats(classified: DataFrame, agent: str) -> DataFrame:
    """``classified`` (source_file, offset, length, outcome, n_events, status, size, mtime_ms) per file.
    Bytes of a truncated line are not consumed.  ``refused`` is for files that were found and not read."""
    whole = F.col("status") != "truncated"
    return classified.groupBy("source_file").agg(
        F.lit(agent).alias("agent"), F.max("size").alias("size"), F.max("mtime_ms").alias("mtime_ms"),
        F.coalesce(F.max(F.when(whole, F.col("offset") + F.col("length"))), F.lit(0)).cast("bigint").alias("bytes_consumed"),
        F.count("*").alias("lines_read"), F.coalesce(F.sum("n_events"), F.lit(0)).cast("bigint").alias("events_extracted"),
        F.count(F.when(F.col("outcome") == "malformed", 1)).alias("lines_skipped"), F.lit(False).alias("refused"),
    )


def by_file(*partition: str) -> Window:
    return Window.partitionBy("source_file", *partition).orderBy("offset")


def forward(value: Column, upto: int = 0) -> Column:
    """The latest non-null value so far in the file; ``upto`` -1 leaves the row itself out.

    A file is one session's log, so its lines fit a task; files are spread over tasks.
    """
    return F.last(value, ignorenulls=True).over(by_file().rowsBetween(Window.unboundedPreceding, upto))


__all__ = ["FORMAT", "LineSource", "by_file", "complete_until", "file_stats", "forward", "iter_lines", "list_files", "latest", "read_lines", "stream_lines"]
