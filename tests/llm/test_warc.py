import hashlib

from pyspark.sql import functions as F

from costledger.llm import warc
from costledger.llm.queries import oracle_sql, queries
from costledger.llm.workspace import Workspace
from tests.oracle import same


def pages(spark):
    big, other = "<p>ä</p>" * 40, "<q>" * 50
    rows = [(9, "http://a/\r\nx y", big), (3, "http://b", big), (4, None, big), (5, "http://c", "short"), (6, "http://d", "short"), (7, "e", None), (8, "f", ""), (12, "g", other), (11, "h", other + "\r\n\r\nWARC/1.1\r\n"), (13, "i", other)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip(spark, tables, monkeypatch):
    df = pages(spark)
    work = Workspace(spark, "warc-test")
    for limits in ((256 << 20, 64 << 10), (1, 0)):
        monkeypatch.setattr(warc, "MAX_ARCHIVE", limits[0])
        monkeypatch.setattr(warc, "GAP", limits[1])
        index = warc.write_archives(df, work)
        got = {r.page_id: r for r in warc.read_records(index, work).collect()}
        for r in df.collect():
            body = (r.html or "").encode()
            assert got[r.page_id].payload_digest == hashlib.sha256(body).hexdigest()
            assert bytes(got[r.page_id].payload or body) == body
        some = warc.read_records(index.where("page_id in (3, 13)"), work).collect()
        assert {(r.page_id, r.record_type, r.refers_to) for r in some} == {(3, "response", None), (13, "revisit", 12)}
    folder = tables(pages=df)
    assert same(queries()["op9_warc"](spark, folder), oracle_sql()["op9_warc"], folder) == 10


def test_odd_rows(spark):
    big = "x" * 200
    df = spark.createDataFrame([(None, "u", big), (2, "u", big), (2, "v", big), (5, "w", big)], "page_id long, url string, html string")
    got = sorted(((r.page_id or -1, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=repr)
    assert got == [(-1, "revisit", 2), (2, "response", None), (2, "response", None), (5, "revisit", 2)]
    assert warc.round_trip(df.limit(0)).collect() == []


def test_ranges(monkeypatch):
    monkeypatch.setattr(warc, "GAP", 10)
    monkeypatch.setattr(warc, "MAX_READ", 100)
    rows = [("a", 0, 20), ("a", 25, 10), ("a", 90, 5), ("b", 0, 500), ("b", 500, 10)]
    assert [(r[0], r[1], r[2], len(r[3])) for r in warc._ranges(rows)] == [("a", 0, 35, 2), ("a", 90, 95, 1), ("b", 0, 500, 1), ("b", 500, 510, 1)]


def test_ids_of_any_type(spark):
    big = "y" * 150
    rows = [("b/%>", "u", big), ("a ä\r\n", "u", big), ("", "u", "z"), (None, "u", None), ("long", "u", "q" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string").withColumn("archive", F.lit("clash")).withColumn("payload", F.lit(1))
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(df).collect()}
    assert got == {"b/%>": ("revisit", "a ä\r\n", 150), "a ä\r\n": ("response", None, 150), "": ("response", None, 1), None: ("response", None, 0), "long": ("response", None, 3_000_000)}


def test_reading_is_spread(spark, monkeypatch):
    monkeypatch.setattr(warc, "SLAB", 4096)
    df = spark.createDataFrame([(i, "u", f"{i} " * 400) for i in range(400)], "page_id long, url string, html string").repartition(2)
    work = Workspace(spark, "warc-spread")
    index = warc.write_archives(df, work)
    found = warc.read_records(index, work)
    assert found.rdd.getNumPartitions() == index.selectExpr("archive", "floor(offset / 4096)").distinct().count() > 4
    assert {r.page_id: len(r.payload) for r in found.collect()} == {i: len(f"{i} " * 400) for i in range(400)}
