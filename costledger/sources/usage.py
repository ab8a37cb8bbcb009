"""The columns of a usage event, as every transcript source gives them."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

EVENT = (
    "struct<id:string,agent:string,session_id:string,ts_ms:bigint,model:string,input:bigint,output:bigint,cache_write:bigint,cache_read:bigint,"
    "cwd:string,git_branch:string,edited_files:array<string>,is_sidechain:boolean>"
)
COLUMNS = ["id", "agent", "session_id", "ts_ms", "model", "input", "output", "cache_write", "cache_read", "cwd", "git_branch", "edited_files", "is_sidechain"]


def _plain(value):
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return int(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def canonical_json(text: str | None) -> str:
    """JSON with sorted keys and no spaces; whole numbers without a fraction."""
    return json.dumps(_plain(json.loads(text)), sort_keys=True, separators=(",", ":"), ensure_ascii=False) if text else "null"


@F.pandas_udf(StringType())
def canonical_hash(texts: pd.Series) -> pd.Series:
    """First 16 hex digits of the SHA-256 of each text's canonical JSON.  Spark's JSON writer does not
    sort keys; only records without ids of their own come here."""
    return texts.map(lambda t: hashlib.sha256(canonical_json(t).encode("utf-8", "surrogatepass")).hexdigest()[:16] if t is not None else None)


def exploded(classified: DataFrame) -> DataFrame:
    """The events of classified lines (``events`` array<EVENT>), placed by file, offset and ordinal."""
    # An outer explode and a filter behind it: a filter on the array would be moved below and compute it twice.
    rows = classified.select("source_file", F.col("offset").alias("line_no"), F.posexplode_outer("events").alias("sub_no", "e")).where("e is not null")
    return rows.select(*[F.col(f"e.{c}") for c in COLUMNS], "source_file", "line_no", "sub_no")
