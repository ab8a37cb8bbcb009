import hashlib

from pyspark.sql import functions as F

from costledger.llm import decontam, line_dedup, quality_rules
from costledger.llm.queries import oracle_sql, queries
from tests.llm.fixtures import documents, empty, odd_texts
from tests.oracle import same


def plain_ledger(text):
    t = text or ""
    w = [x for x in t.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if x]
    lines = [x for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(8)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_ledger(spark):
    got = {r.doc_id: r for r in quality_rules.ledger(documents(spark)).collect()}
    for i, t in enumerate(odd_texts()):
        r = got[i * 13 % 997]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_ledger(t)
        assert (r.failures & quality_rules.mask("base") != 0) == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert quality_rules.ledger(empty(spark)).collect() == []


def test_filter_and_ablations(spark):
    docs = documents(spark)
    entries = quality_rules.ledger(docs)
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns
    rows = entries.collect()
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.failures & quality_rules.mask("2")}
    for r in quality_rules.ablations(entries).collect():
        m, b = quality_rules.mask(r.policy), 1 << quality_rules.NAMES.index(r.rule)
        assert r.n_failed == sum(1 for x in rows if x.failures & b) and r.n_only == sum(1 for x in rows if x.failures & m == b)


def test_queries_against_sql(spark, tables):
    docs = documents(spark, extra=False)
    item = odd_texts()[40].split()[6:40]
    items = spark.createDataFrame([(1, " ".join(item)), (2, "nowhere to be found in any text"), (3, None), (4, "one"), (5, "")], "item_id long, text string")
    folder = tables(documents=docs, benchmark=items)
    for name in ("op2_decontaminate", "op5_line_dedup", "op8_quality_rules"):
        assert same(queries()[name](spark, folder), oracle_sql()[name], folder)


def test_line_dedup_text(spark):
    rows = [(2, "x one\ny two\nz three\nlast"), (1, "x one\n\ny two\nz three"), (3, "y two\nz three"), (4, None), (4, None), (None, "x one\ny two\nz three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    got = {(r.doc_id, r.text, r.n_removed, r.n_spans) for r in line_dedup.dedupe_lines(df).collect()}
    assert got == {(2, "last", 3, 1), (1, "", 3, 1), (3, "y two\nz three", 0, 0), (4, None, 0, 0), (None, "x one\ny two\nz three", 0, 0)}
    assert line_dedup.dedupe_lines(empty(spark)).collect() == []


def test_containment_paths(spark, monkeypatch):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    near = item.replace("mu", "MU").upper()
    long = " ".join(f"word{i}" for i in range(5000))
    rows = [(1, f"{long} {near} {long}"), (2, item.replace("zeta", "other")), (3, None), (4, ""), (5, f"{item} {item}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(7, item), (None, item), (8, "  ")], "item_id long, text string").withColumn("doc_id", F.lit(0))
    want = {(1, 7), (5, 7), (1, None), (5, None)}
    for limit in (32 << 20, 0):
        monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)
        assert {(r.doc_id, r.item_id) for r in decontam.containment(docs, items).collect()} == want
    assert decontam.containment(empty(spark), items).collect() == []


def test_kept_hash_is_of_the_text(spark, tables):
    folder = tables(documents=documents(spark, extra=False))
    kept = {r.doc_id: r.text for r in line_dedup.dedupe_lines(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    for r in queries()["op5_line_dedup"](spark, folder).collect():
        assert r.kept_sha256 == hashlib.sha256((kept[r.doc_id] or "").encode()).hexdigest()
