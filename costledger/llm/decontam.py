"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

Items are partitioned by the size of their set of five-word shingles, a power of two per partition.
A partition's items are searched by their min-wise sketch: the shingles of least hash, as many as
guarantee that a document with the wanted share of an item's shingles has one of the sketch.  A
sketch is looked up among all shingles of a document, so the document's length does not dilute it as
it does the resemblance of two whole sets.  Documents too small for a partition are not matched with
it.  Candidates are then verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, shingles, word_hashes, words
from .workspace import Workspace

#: A benchmark side of at most so many bytes is broadcast; a larger one is merged.
BROADCAST_BYTES = 32 << 20
#: Bytes of a row beside its text.
ROW_BYTES = 64


def _small(df: DataFrame, text: Column) -> DataFrame:
    """``df``, a written table, marked for broadcast or for a merge by its measured size."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES
    found = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df) if found <= BROADCAST_BYTES else df.hint("merge")


def containment(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment): the pairs in which at least ``threshold``
    of the item's distinct shingles occur in the document.

    Words are lower-cased.  Null or blank texts match nothing; a text of fewer than ``n`` words is one
    shingle and matches only such a text of the same words.  Rows that repeat an id and text are one;
    items that share an id count by their best match.  Null ids are kept as null.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "decontam")
    per = round(threshold * 1000)
    need = lambda size: F.ceil(size * per / 1000).cast("int")
    listed = items.select(F.col(item_id).alias("item"), F.lower(text).alias("t")).distinct()
    sets = work.table(
        listed.select("item", F.xxhash64("t").alias("it"), let(words(F.col("t")), lambda w: shingles(w, n)).alias("s"), let(words(F.col("t")), lambda w: F.array_sort(F.array_distinct(word_hashes(w, n)))).alias("h"))
        .withColumn("s", F.array_distinct("s"))
        .withColumn("size", F.size("s"))
        .where("size > 0"),
        "items",
    )
    upper = F.pow(F.lit(2), F.floor(F.log2("size")) + 1) - 1
    sketch = work.table(sets.select("it", "item", need(F.pow(F.lit(2), F.floor(F.log2("size")))).alias("least"), F.explode(F.slice("h", 1, (upper - need(upper) + 1).cast("int"))).alias("h")), "sketch")
    wanted = work.table(sets.select("item", "it", "size", F.explode("s").alias("s")), "wanted")

    rows = docs.select(F.col(doc_id).alias("doc"), F.lower(text).alias("t"))
    rows = rows.select("doc", F.xxhash64("t").alias("dt"), "t")
    # An outer explode: for a plain one the optimizer adds a filter on the array, and would push it
    # below the join and compute the array of every document twice.  The joins drop its null rows.
    hashed = rows.select("doc", "dt", let(words(F.col("t")), lambda w: word_hashes(w, n)).alias("hs")).select("doc", "dt", F.size("hs").alias("many"), F.explode_outer("hs").alias("h"))
    found = work.table(hashed.join(_small(sketch, F.col("item").cast("string")), "h").where("many >= least").select("doc", "dt", "item", "it").distinct(), "candidates")

    suspects = found.select(F.col("doc").alias("d"), F.col("dt").alias("x")).distinct()
    checked = rows.join(suspects, rows.doc.eqNullSafe(suspects.d) & (rows.dt == suspects.x), "left_semi")
    told = checked.select("doc", "dt", let(words(F.col("t")), lambda w: shingles(w, n)).alias("s")).select("doc", "dt", F.explode_outer("s").alias("s"))
    hits = told.join(_small(wanted, F.col("s")), "s").groupBy("doc", "dt", "item", "it", "size").agg(F.count_distinct("s").alias("n_found"))
    pair = [hits.doc.eqNullSafe(found.doc), hits.dt == found.dt, hits.item.eqNullSafe(found.item), hits.it == found.it]
    sure = hits.where(F.col("n_found") * 1000 >= F.col("size") * per).join(found, pair, "left_semi")
    best = sure.groupBy("doc", "item").agg(F.max(F.struct((F.col("n_found") / F.col("size")).alias("containment"), F.col("size").cast("long").alias("n_shingles"), F.col("n_found").cast("long").alias("n_found"))).alias("b"))
    return best.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "b.n_shingles", "b.n_found", "b.containment")


ORACLE_SQL = """
WITH t AS (SELECT 0 AS side, doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL SELECT 1, item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') FROM benchmark),
s AS (SELECT DISTINCT side, id, array_to_string(w[p + 1:p + 5], ' ') AS s FROM (SELECT *, unnest(range(0, greatest(len(w) - 4, 1))) AS p FROM t WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s WHERE side = 1 GROUP BY id),
h AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS k FROM s d JOIN s i ON d.s = i.s AND d.side = 0 AND i.side = 1 GROUP BY ALL)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_shingles, CAST(k AS BIGINT) AS n_found, k / n AS containment FROM h JOIN n ON n.id = item_id WHERE k * 1000 >= n * 800
"""
