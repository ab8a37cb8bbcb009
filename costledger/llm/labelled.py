"""The bounded sample of labelled rows on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that the driver gets for a fit, at most.
TRAIN_BYTES = 64 << 20


def held_out(doc_id: Column) -> Column:
    """True for the fold from which labels are never learned; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, max_bytes: int = TRAIN_BYTES) -> list[tuple[bytes, int]]:
    """(text, label) of at most ``rows`` labelled documents outside the held-out fold: those whose id
    hashes lowest, so that the sample does not depend on how the tables are stored.

    An id counts once, by its greatest label and, of several texts, that of the least hash.  Only sizes
    reach the driver first; it takes texts in the order of the ids' hashes, leaving out those that would
    bring their sum above ``max_bytes``.  A null text is empty; null ids and null labels are left out.
    """
    fold = labels.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    # At most ``rows`` ids, so both joins broadcast them.
    picked = fold.select("doc_id", "y", F.xxhash64("doc_id").alias("place")).orderBy("place", "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn("th", F.xxhash64("text"))
    sizes = texts.select("doc_id", "th", F.octet_length("text").alias("n")).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.struct("th", "n")).alias("t"), F.first("y").alias("y"), F.first("place").alias("place"))
    left, chosen = max_bytes, []
    for r in sorted(sizes.collect(), key=lambda r: (r.place, r.doc_id)):
        if r.t.n <= left:
            left -= r.t.n
            chosen.append((r.doc_id, r.t.th, r.y))
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame(chosen, f"doc_id {kind}, th bigint, y int")
    # Rows that repeat a document are one before they reach the driver.
    found = texts.join(F.broadcast(wanted), ["doc_id", "th"]).groupBy("doc_id", "th", "y").agg(F.first("text").alias("text")).collect()
    return [(bytes(r.text), r.y) for r in sorted(found, key=lambda r: (r.doc_id, r.y))]
