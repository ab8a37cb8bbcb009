"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one failure bit per
rule.  A policy is a set of rules, hence a mask: applying one, or asking what a document's fate would
be without some rule, is bitwise arithmetic on the ledger and never reads a text again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, count_bytes, let, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: name, failure condition over the measurements, the same in SQL.  A rule's bit is its place in this
#: list: add at the end only.
RULES: list[tuple[str, Callable[[Column], Column], str]] = [
    ("few_words", lambda m: m["n_words"] < 20, "n_words < 20"),
    ("repeated_windows", lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 30, "100 * n_repeat_words > 30 * n_words"),
    ("symbols", lambda m: m["n_symbols"] * 100 > m["word_chars"] * 5, "100 * n_symbols > 5 * word_chars"),
    ("duplicate_lines", lambda m: (m["n_lines"] >= 4) & (m["n_dup_lines"] * 100 > m["n_lines"] * 40), "n_lines >= 4 and 100 * n_dup_lines > 40 * n_lines"),
    ("exclamations", lambda m: m["n_exclamations"] * 2 > m["n_words"], "2 * n_exclamations > n_words"),
    ("word_length", lambda m: (m["word_chars"] < m["n_words"] * 2) | (m["word_chars"] > m["n_words"] * 20), "word_chars < 2 * n_words or word_chars > 20 * n_words"),
]
NAMES = [name for name, _, _ in RULES]
#: version -> the rules it applies.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "2": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "exclamations", "word_length"),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclamations"]


def mask(policy: str) -> int:
    return sum(1 << NAMES.index(r) for r in POLICIES[policy])


def _repeat_words(w: Column) -> Column:
    """Words inside a window of eight that occurs twice or more, its first occurrence included."""

    def covered(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
            hit = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
            return F.array_sort(F.transform(hit, lambda j: F.get(s, j)["i"]))

        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last"))
        count = F.aggregate(let(ranked, places), zero, step, lambda acc: acc["n"])
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(count)

    windows = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    return F.when(F.size(w) >= WINDOW, let(windows, covered)).otherwise(F.lit(0).cast("long"))


def entry(text: Column) -> Column:
    """A text's measurements and failure bits as one struct.

    Each step is bound once, so a filter on the bits that the optimizer moves below other columns
    still evaluates every measurement and every rule once per document.
    """

    def measure(b: Column) -> Column:
        t, w, lines = b["t"], b["w"], b["l"]
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            (F.char_length(t) - count_bytes(t, " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
            count_bytes(t, SYMBOLS).alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            count_bytes(t, "!").alias("n_exclamations"),
        )

    def judge(m: Column) -> Column:
        bits = [F.when(fails(m), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, fails, _) in enumerate(RULES)]
        return F.struct(*[m[c].alias(c) for c in MEASURES], sum(bits[1:], bits[0]).alias("failures"))

    whole = F.coalesce(text, F.lit(""))
    parts = F.struct(whole.alias("t"), words(whole).alias("w"), F.filter(F.split(whole, "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}")).alias("l"))
    return let(let(parts, measure), judge)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` -> (id, measurements..., failures): one row per row, without a shuffle.

    A null text has no words and no lines, like an empty one.  Further columns are ignored, ids may
    repeat or be null, and an empty table gives an empty ledger.
    """
    return docs.select(docs[id_col].alias(id_col), entry(docs[text_col]).alias("_entry")).select(id_col, "_entry.*")


def verdict(failures: Column, policy: str) -> Column:
    return failures.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(entries: DataFrame) -> DataFrame:
    """(policy, rule, n_failed, n_only): documents a rule rejects, and those no other rule of the
    policy rejects.  The ledger is first summed by its bit pattern, of which there are at most 2^rules."""
    patterns = entries.groupBy("failures").count()
    cases = [(p, r, mask(p), 1 << NAMES.index(r)) for p in POLICIES for r in POLICIES[p]]
    listed = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("m"), F.lit(b).cast("long").alias("b")) for p, r, m, b in cases]))
    x = patterns.select("failures", "count", listed.alias("c")).select("failures", "count", "c.*")
    hit = x.failures.bitwiseAND(x.b) != 0
    only = x.failures.bitwiseAND(x.m) == x.b
    total = lambda c: F.coalesce(F.sum(F.when(c, x["count"])), F.lit(0)).cast("long")
    return x.groupBy("policy", "rule").agg(total(hit).alias("n_failed"), total(only).alias("n_only"))


def filter_documents(docs: DataFrame, policy: str = "2", text_col: str = "text") -> DataFrame:
    """The rows that a policy keeps, with the columns of ``docs``.  Nothing is shuffled."""
    return docs.where(verdict(entry(docs[text_col])["failures"], policy))


_W = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

#: DuckDB: measurements of every document.  The measure must equal the ledger's.
LEDGER_SQL = f"""
w AS (SELECT doc_id, coalesce(text, '') AS t, {_W} AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, unnest(range(0, len(ws) - 7)) AS p, ws FROM w WHERE len(ws) >= 8),
hit AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[p + 1:p + 8], ' ')) AS n FROM win),
cov AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM hit, range(0, 8) AS r(k) WHERE hit.n >= 2 GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclamations
      FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
ledger AS (SELECT *, CAST({" + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, _, rule) in enumerate(RULES))} AS BIGINT) AS failures FROM m)"""
ORACLE_SQL = f"WITH {LEDGER_SQL.strip()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, (failures & {mask('2')}) = 0 AS kept, failures FROM ledger"
