"""Batches of like lengths: optimal buckets by dynamic programming over the global length histogram.

Sequences of over ``max_len`` tokens are cut into pieces of that length.  The histogram of piece
lengths has at most ``max_len + 1`` entries, whatever the number of documents; dynamic programming
over it finds the bucket boundaries of least total padding.  Inside a bucket, sequences get
consecutive ranks and each ``token_budget // boundary`` of them are a batch.  Ranks come from a rank
inside a shard plus the sizes of earlier shards, so no bucket is gathered in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

#: Pieces that a shard of one bucket should have at most, on average.
SHARD = 4096


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets that minimise the padding, ascending.

    cost(i, j) of a bucket over lengths i..j-1 is its longest length times their number, less their sum.
    """
    if not lengths:
        return []
    order = np.argsort(lengths)
    size, n = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    number = np.concatenate(([0], np.cumsum(n)))
    total = np.concatenate(([0], np.cumsum(n * size)))
    m, far = len(size), np.iinfo(np.int64).max // 4
    cost = np.full(m + 1, far)
    cost[0] = 0
    back: list[np.ndarray] = []
    for _ in range(min(buckets, m)):
        now, came = np.full(m + 1, far), np.zeros(m + 1, np.int64)
        now[0] = 0
        for a in range(1, m + 1, 256):
            j = np.arange(a, min(a + 256, m + 1))
            pad = size[j - 1][:, None] * (number[j][:, None] - number[None, :]) - (total[j][:, None] - total[None, :])
            whole = np.where(np.arange(m + 1)[None, :] < j[:, None], cost[None, :] + pad, far)
            came[j] = whole.argmin(1)
            now[j] = whole[np.arange(len(j)), came[j]]
        back.append(came)
        cost = now
    found, at = [], m
    for came in reversed(back):
        if at == 0:
            break
        found.append(int(size[at - 1]))
        at = int(came[at])
    return found[::-1]


def _before(sizes: DataFrame) -> DataFrame:
    """``sizes`` (bucket, _hash, _part, _c) -> with ``_before``, the pieces of a bucket's earlier shards.

    Sums inside runs of ``SHARD`` shards, and over one row per run."""
    run = F.floor(F.col("_hash") / SHARD).alias("_run")
    inside = F.sum("_c").over(Window.partitionBy("bucket", "_run").orderBy("_hash", "_part")) - F.col("_c")
    rows = sizes.select("*", run).withColumn("_inside", inside)
    runs = sizes.select("bucket", run, "_c").groupBy("bucket", "_run").agg(F.sum("_c").alias("_r"))
    runs = runs.select("bucket", "_run", (F.sum("_r").over(Window.partitionBy("bucket").orderBy("_run")) - F.col("_r")).alias("_earlier"))
    return rows.join(runs, ["bucket", "_run"]).select("bucket", "_hash", "_part", (F.col("_inside") + F.col("_earlier")).alias("_before"))


def pack(lengths: DataFrame, buckets: int = 8, max_len: int = 2048, token_budget: int = 65536, id_col: str = "doc_id", n_col: str = "n_tokens") -> DataFrame:
    """``lengths`` (id, n_tokens) -> (id, piece, n_tokens, bucket, padded_len, batch_id, slot).

    Every row gives ceil(n_tokens / max_len) pieces, and one of length zero if it has no tokens; null
    lengths count as zero, negative ones too.  A batch is (bucket, batch_id), holds at most max(1, token_budget //
    padded_len) pieces, and only the last one of a bucket is short.  Ids may be null or repeat: each
    row is packed by itself.  An empty table gives an empty result.
    """
    work = Workspace(lengths.sparkSession, "packing")
    n = F.greatest(F.coalesce(F.col(n_col), F.lit(0)), F.lit(0)).cast("long")
    last = F.greatest(F.ceil(n / max_len).cast("int") - 1, F.lit(0))
    pieces = work.table(
        lengths.select(F.col(id_col).alias(id_col), n.alias("_n"), F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(id_col, "piece", F.monotonically_increasing_id().alias("_salt"), F.least(F.col("_n") - F.col("piece").cast("long") * max_len, F.lit(max_len)).cast("long").alias("n_tokens")),
        "pieces",
    )
    seen = [(r.n_tokens, r["count"]) for r in pieces.groupBy("n_tokens").count().collect()]
    edges = best_boundaries([a for a, _ in seen], [c for _, c in seen], buckets) or [max_len]
    shards = max(1, -(-sum(c for _, c in seen) // SHARD))
    bucket = sum((F.when(F.col("n_tokens") > e, 1).otherwise(0) for e in edges), F.lit(0)).cast("int")
    placed = pieces.withColumn("bucket", bucket).withColumn("_hash", F.pmod(F.xxhash64(id_col, "piece"), F.lit(shards)).cast("int"))
    # Ids that are null or repeat fall in one shard; one of several times the wanted size is cut by the
    # salt that was written with the pieces.
    full = placed.groupBy("bucket", "_hash").agg(F.count("*").alias("_c")).where(F.col("_c") > 4 * SHARD).select("bucket", "_hash", F.ceil(F.col("_c") / SHARD).cast("int").alias("_parts"))
    full = work.table(full, "full")
    part = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.col("_salt"), F.col("_parts"))).cast("int")
    placed = placed.join(full, ["bucket", "_hash"], "left").select(id_col, "piece", "n_tokens", "bucket", "_hash", part.alias("_part"))
    sizes = placed.groupBy("bucket", "_hash", "_part").agg(F.count("*").alias("_c"))
    before = _before(sizes).withColumnsRenamed({"bucket": "_bk", "_hash": "_hk", "_part": "_pk"})
    own = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("bucket", "_hash", "_part").orderBy(id_col, "piece", "n_tokens")) - 1)
    padded = F.element_at(F.array(*[F.lit(e).cast("long") for e in edges]), F.col("bucket") + 1)
    per = F.greatest(F.floor(F.lit(token_budget) / F.greatest(padded, F.lit(1))), F.lit(1)).cast("long")
    rank = F.col("_rank") + F.col("_before")
    return own.join(before, (own.bucket == before._bk) & (own._hash == before._hk) & (own._part == before._pk)).select(
        id_col, "piece", "n_tokens", "bucket", padded.alias("padded_len"), F.floor(rank / per).cast("long").alias("batch_id"), (rank % per).cast("int").alias("slot")
    )
