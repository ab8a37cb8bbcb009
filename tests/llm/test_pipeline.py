import random

import corpus_pipeline
from tests.llm.fixtures import documents, empty


def test_stages(spark, tables):
    rnd = random.Random(8)
    text = lambda n: " ".join(f"w{rnd.randint(0, 9999)}" for _ in range(n))
    clean = [text(80) for _ in range(30)]
    item = text(30)
    shared = "\n".join(text(9) for _ in range(4))
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100, clean[3]), (101, clean[4].replace(" w", " w1", 1)), (102, f"{text(60)} {item} {text(60)}"), (103, "too short"), (104, "%%% " * 60)]
    rows += [(105, f"{text(40)}\n{shared}"), (106, f"{text(40)}\n{shared}"), (107, None), (108, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    folder = tables(documents=docs, benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    current, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, folder)
        assert current.columns == docs.columns
        kept.append({r.doc_id: r for r in current.collect()})
    quality, lines, near, leaks = kept
    assert set(quality) == set(range(30)) | {100, 101, 102, 105, 106}
    assert lines[105].text == dict(rows)[105] and shared not in lines[106].text and lines[106].n_chars == len(lines[106].text)
    assert set(near) == set(range(30)) | {102, 105, 106} and set(leaks) == set(range(30)) | {105, 106}
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == set(leaks)


def test_odd_tables(spark, tables):
    folder = tables(benchmark=spark.createDataFrame([(1, None)], "item_id long, text string"))
    for docs in (documents(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, folder).count() <= docs.count() * 3


def test_odd_ids(spark, tables):
    rnd = random.Random(12)
    text = lambda n: " ".join(f"w{rnd.randint(0, 9999)}" for _ in range(n))
    item, copy, clean, other, lone = text(30), text(120), text(120), text(120), text(120)
    folder = tables(benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = lambda *r: spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in r], kind)
    got = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    leak = f"{text(40)} {item}"
    found = corpus_pipeline.benchmark(spark, rows((None, leak), (None, clean), (3, leak), (3, other), (4, None), (None, None)), folder)
    assert got(found) == sorted([(None, clean), (3, other), (4, None), (None, None)], key=repr)
    found = corpus_pipeline.near_copies(spark, rows((None, copy), (None, copy), (None, copy + " more"), (3, copy), (3, other), (5, lone), (5, lone), (6, other)), folder)
    kept = got(found)
    assert len([t for d, t in kept if d is None]) == 1 and kept[:2] == [(3, other), (5, lone)] and len(kept) == 3


def test_ids_of_several_texts(spark):
    rnd = random.Random(13)
    text = lambda n: " ".join(f"w{rnd.randint(0, 9999)}" for _ in range(n))
    a, b = text(120), text(120)
    docs = spark.createDataFrame([(5, a), (3, b), (5, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [(3, b), (5, a)]


def test_lines_keep_other_columns(spark):
    shared = "a one\nb two\nc three"
    docs = spark.createDataFrame([(1, "x", shared, 9), (2, "y", f"{shared}\nd four", 8)], "doc_id long, n_lines string, text string, n_removed int")
    assert sorted(tuple(r) for r in corpus_pipeline.lines(spark, docs, "").collect()) == [(1, "x", shared, 9), (2, "y", "d four", 8)]
