"""Incremental ingest: lines stream into a bronze table, events are derived from it in batch.

The stream only appends what files have grown by; a rewritten file is read from its beginning again
and its earlier lines are superseded, and so are those of a file that is gone (``lines.latest``).  A
store whose parts do not fit together is built anew.  Duplicates stay in bronze and are resolved on
every read, since which row of an id is the last can change.  Attribution is a batch job, too: a new
commit can take events of any age within the horizon, so no watermark may drop them.
"""

from __future__ import annotations

import hashlib
import json
import posixpath

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import claude, codex, lines
from ..sources.usage import exploded

#: To be raised when the rows of bronze change: another version is not read, and the stream starts over.
VERSION = 2
CLASSIFY = {"claude-code": claude.classify, "codex": codex.classify}


def bronze_path(store: str, agent: str) -> str:
    """The folder of an agent's lines; it changes with the version."""
    return f"{store.rstrip('/')}/v{VERSION}/{agent}"


def _numbered(fs, folder: str) -> list[int]:
    names = [posixpath.basename(f.path) for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))]
    return sorted(int(n) for n in names if n.isdigit())


def _state(base: str) -> dict | None:
    """The last offset of a store; None if there is none, or the seal is not that of the last committed batch:
    a run that did not end, or files that were lost or changed."""
    fs, root = pafs.FileSystem.from_uri(base)
    read = lambda p: fs.open_input_file(f"{root}/{p}").read()
    try:
        seal = json.loads(read("seal.json"))
        last = _numbered(fs, f"{root}/checkpoint/commits")[-1]
        body = read(f"checkpoint/offsets/{last}")
        if seal != {"batch": last, "sha256": hashlib.sha256(body).hexdigest()}:
            return None
        return json.loads(body.decode().splitlines()[-1])
    except (OSError, ValueError, IndexError, KeyError):
        return None


def _seal(base: str) -> None:
    fs, root = pafs.FileSystem.from_uri(base)
    last = _numbered(fs, f"{root}/checkpoint/commits")[-1]
    body = fs.open_input_file(f"{root}/checkpoint/offsets/{last}").read()
    with fs.open_output_stream(f"{root}/seal.json", compression=None) as f:
        f.write(json.dumps({"batch": last, "sha256": hashlib.sha256(body).hexdigest()}).encode())


def _clear(base: str) -> None:
    fs, root = pafs.FileSystem.from_uri(base)
    if fs.get_file_info(root).type == pafs.FileType.Directory:
        fs.delete_dir(root)


def update(spark: SparkSession, agent: str, path: str, store: str, suffix: str = ".jsonl", **options) -> None:
    """Appends what is new under ``path`` to the bronze table and returns when it is there.

    The last offset is sealed with its checksum.  Without a seal that fits, the agent's folder is removed
    and all files are read again."""
    base = bronze_path(store, agent)
    state = _state(base)
    if state is None:
        _clear(base)
    else:
        options["after"] = state["generation"]
    stream = lines.stream_lines(spark, path, suffix, **options)
    query = stream.writeStream.format("parquet").option("path", f"{base}/lines").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    _seal(base)


def bronze(spark: SparkSession, agent: str, store: str) -> DataFrame:
    """The lines as they now are in the files."""
    return lines.latest(spark.read.schema(lines.SCHEMA).parquet(f"{bronze_path(store, agent)}/lines"))


def events(spark: SparkSession, agent: str, store: str) -> tuple[DataFrame, DataFrame]:
    """(events, file stats), the same as a reading of all files from the beginning gives.

    The state of a stateful form is derived from all of a file's lines again; only complete lines are
    in bronze, so an unterminated one is counted when its rest has come.
    """
    told = CLASSIFY[agent](bronze(spark, agent, store))
    return exploded(told), lines.file_stats(told, agent)


def with_repo(found: DataFrame, repo_id: str) -> DataFrame:
    return found.withColumn("repo_id", F.lit(repo_id))
