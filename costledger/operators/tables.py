"""Tables between stages, in the folder that the cluster's executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are worth a part of their own when a table is written in parts, and how many parts there are at most.
PART_ROWS, MOST_PARTS = 1_000_000, 8
#: Spark's setting by which a query's shuffle files go with its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Picks rows: all, or a part of them by what it is given.
Keep = Callable[..., Column]


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.  Where that is unset, a temporary folder in local mode; on
    a cluster, whose machines share no temporary folder, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError(f"spark.checkpoint.dir is not set; executors of {master or 'this cluster'} need a folder that they share")
        found = "file://" + tempfile.mkdtemp(prefix="costledger-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def store(spark: SparkSession) -> str:
    """A new folder under the shared one."""
    return f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"


@contextmanager
def _without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside are removed as it ends, not when the driver next collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, folder: str, name: str, mode: str = "overwrite") -> DataFrame:
    """``df`` as a table: later plans start from it, and a lost executor costs no more than a task."""
    with _without_leftovers(df.sparkSession):
        df.write.mode(mode).option("compression", "zstd").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def parts_of(table: DataFrame) -> int:
    """In how many parts what is made of ``table`` is written: scratch on disk is then a part's, not the whole's."""
    with _without_leftovers(table.sparkSession):
        return max(1, min(MOST_PARTS, -(-table.count() // PART_ROWS)))


def everything(*by: str) -> Column:
    return F.lit(True)


def part(k: int, n: int) -> Keep:
    """Of ``n`` parts by hash the one with number ``k``."""
    return (lambda *by: F.pmod(F.xxhash64(*by), F.lit(n)) == k) if n > 1 else everything


def mode(k: int) -> str:
    return "append" if k else "overwrite"


def written_in_parts(make: Callable[[Keep], DataFrame], n: int, folder: str, name: str) -> DataFrame:
    """What ``make`` makes of the rows that it is told to keep, of each of ``n`` parts in turn, as a table."""
    for k in range(n):
        out = written(make(part(k, n)), folder, name, mode(k))
    return out


def in_parts(spark: SparkSession, make: Callable[[Keep], DataFrame], n: int) -> DataFrame:
    """What ``make`` makes of the rows that it is told to keep: all at once, or as a table of ``n`` parts."""
    return make(everything) if n == 1 else written_in_parts(make, n, store(spark), "parts")


def dropped(spark: SparkSession, folder: str, name: str) -> None:
    """Removes a table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
