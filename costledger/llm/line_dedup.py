"""Removal of repeated lines by overlapping three-line windows, in DataFrame operations only.

A document's content lines are its ``\\n``-separated lines that hold a word.  Each three consecutive
content lines are a window.  Of equal windows anywhere in the corpus the first, by (doc_id, text
hash, position), stays; the content lines that any later one covers are removed, overlaps merged.
Blank lines and documents of fewer than three content lines are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, let
from .workspace import Workspace

WINDOW = 3


def _content(text: Column) -> Column:
    """The content lines as (i, x): place among all lines, text."""
    numbered = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    return F.filter(numbered, lambda s: s["x"].rlike(f"[^{SPACE[1:]}"))


def _windows(content: Column) -> Column:
    def hashed(i: Column) -> Column:
        part = F.slice(content["x"], i, WINDOW)
        return F.struct(F.xxhash64(part).alias("h1"), F.xxhash64(F.lit("second"), part).alias("h2"))

    return F.when(F.size(content) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(content) - (WINDOW - 1)), hashed)).otherwise(F.array().cast("array<struct<h1:bigint,h2:bigint>>"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A document is its id and text: rows that repeat both are one document."""
    return docs.select(docs[id_col].alias("_id"), F.xxhash64(docs[text_col]).alias("_th"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))


def repeated_windows(docs: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _th, places): the windows to remove from each document that has any.  A document's
    places are at most as many as its lines; no other group is gathered."""
    keyed = _keyed(docs, id_col, text_col)
    listed = keyed.select("_id", "_th", let(_content(keyed._row[text_col]), _windows).alias("w"))
    seen = work.table(listed.select("_id", "_th", F.posexplode("w").alias("pos", "h")).select("_id", "_th", "pos", "h.h1", "h.h2").distinct(), "windows")
    first = seen.groupBy("h1", "h2").agg(F.min(F.struct("_id", "_th", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = seen.join(first, ["h1", "h2"]).where(~F.struct("_id", "_th", "pos").eqNullSafe(F.col("first")))
    return work.table(later.groupBy("_id", "_th").agg(F.sort_array(F.collect_list("pos")).alias("places")), "places")


def dedupe_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` -> its columns, the text without removed lines, and n_lines (content lines),
    n_removed, n_spans (maximal runs of removed content lines), all long.

    Null texts stay null with no lines; empty texts stay empty.  Ids may be null or repeat: rows of
    equal id and text are one document, and rows of equal id and other text are ordered by its hash.
    Columns of the result's new names are replaced.
    """
    work = Workspace(docs.sparkSession, "lines")
    found = repeated_windows(docs, work, id_col, text_col)
    rows = _keyed(docs, id_col, text_col)
    # The places grow with the corpus, so they are merged with the texts and never broadcast.
    both = rows.join(found.hint("merge"), rows._id.eqNullSafe(found._id) & (rows._th == found._th), "left")
    text = rows._row[text_col]
    content = _content(text)
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (WINDOW - 1))))))
    base = both.select("_row", "places", F.size(content).cast("long").alias("_n"), F.when(F.col("places").isNotNull(), content).alias("_content"), covered.alias("_covered"))
    text = F.col("_row")[text_col]
    lines = F.split(text, "\n")
    gone = F.transform("_covered", lambda p: F.get(F.col("_content"), p)["i"])
    kept = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda i: F.get(x, i)), "\n"))
    spans = F.size(F.filter("_covered", lambda p, j: (j == 0) | (p != F.get(F.col("_covered"), j - 1) + 1)))
    some = F.col("places").isNotNull()
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "n_spans")]
    return base.select(
        *[(F.when(some, kept).otherwise(text) if c == text_col else F.col("_row")[c]).alias(c) for c in names],
        F.col("_n").alias("n_lines"),
        F.when(some, F.size("_covered")).otherwise(0).cast("long").alias("n_removed"),
        F.when(some, spans).otherwise(0).cast("long").alias("n_spans"),
    )


ORACLE_SQL = """
WITH l AS (SELECT doc_id, coalesce(text, '') AS t, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
c AS (SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]')),
w AS (SELECT doc_id, p, x || chr(10) || lead(x, 1) OVER d || chr(10) || lead(x, 2) OVER d AS s FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w WHERE s IS NOT NULL) WHERE k > 1),
g AS (SELECT DISTINCT doc_id, p + k AS p FROM r, range(0, 3) AS q(k)),
s AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN b IS NULL OR b <> p - 1 THEN 1 ELSE 0 END) AS spans FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS b FROM g) GROUP BY doc_id),
k AS (SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.i) AS t FROM l LEFT JOIN c ON c.doc_id = l.doc_id AND c.i = l.i LEFT JOIN g ON g.doc_id = c.doc_id AND g.p = c.p WHERE g.p IS NULL GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(s.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(s.spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(k.t, '')) AS kept_sha256
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""
