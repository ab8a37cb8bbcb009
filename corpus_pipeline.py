"""The corpus pipeline: each stage works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last return the columns of
``documents``; a stage's result is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costledger.llm import decontam, line_dedup, packing, quality_rules, simhash, suffix_dedup, wordpiece
from costledger.llm.text import SPACE
from costledger.llm.workspace import Workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the current policy of the quality rules keeps; null, empty and blank texts have too few
    words and go.  Ids may be null or repeat."""
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines, n_chars recounted where lines went; documents left without a word go,
    null texts stay.  Ids may be null or repeat; other columns, whatever their names, stay as they are."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = line_dedup.dedupe_lines(docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("_rest")))
    changed = F.col("n_removed") > 0
    left = found.where(~changed | F.col("text").rlike(f"[^{SPACE[1:]}"))
    own = {c: F.col("_rest")[c] for c in rest} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in rest:
        own["n_chars"] = F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return left.select(*[own[c].alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest doc_id.  Of rows that repeat an id
    and text one stays.  An id of several texts, and null ids (before all others), are documents of their
    own, ordered by the text's hash."""
    odd = docs.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count()
    if not odd:
        gone = simhash.near_duplicates(docs).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
        # The ids that go grow with the corpus, so they are merged with the documents, not broadcast.
        return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    work = Workspace(spark, "oddids")
    once = work.table(docs.withColumn("_th", F.xxhash64("text")).dropDuplicates(["doc_id", "_th"]).drop("_th"), "once")
    keyed = work.table(suffix_dedup.keyed(once.select("doc_id", "text"), work), "documents")
    found = simhash.near_duplicates(keyed.select(F.col("doc").alias("doc_id"), "text"))
    least = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("doc")).distinct()
    gone = keyed.join(least.hint("merge"), "doc", "left_semi").select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"))
    return _without(once, gone)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for the documents of ``gone`` (_id, _th): id, which may be null, and text hash."""
    return docs.join(gone.hint("merge"), docs.doc_id.eqNullSafe(gone._id) & (F.xxhash64(docs.text) == gone._th), "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than four fifths of each benchmark item's five-word shingles.  A document
    is its id, which may be null, and text: of an id's texts only those go that hold an item.  Null, empty
    and blank texts and items hold nothing."""
    own = docs.select(F.struct("doc_id", F.xxhash64("text").alias("th")).alias("doc_id"), "text")
    leaks = decontam.containment(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return _without(docs, leaks.select(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.th").alias("_th")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of like token counts over what is left: a row per piece of at most 2,048 tokens.  Each row
    is packed by itself, whatever its id; texts without words are pieces of length zero."""
    return packing.pack(wordpiece.token_counts(docs, wordpiece.read_vocab(spark, wordpiece.DEFAULT_VOCAB)))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near_copies), ("decontamination", benchmark), ("packing", pack)]

#: SimHash groups and optimal buckets are beyond SQL; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written to the shared folder and read again."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir), name)
        if before:
            work.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
