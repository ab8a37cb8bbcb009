import random
import re
import shutil
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from costledger.functions import money as M
from costledger.operators import attribution, events, pricing, rollup, tables
from costledger.plans import ledger as ledgers
from costledger.plans import queries as Q
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_against_sql(spark, name):
    same(Q.queries()[name](spark, SF), Q.oracle_sql()[name], SF)


def test_money(spark):
    rnd = random.Random(1)
    edge = [0, 1, 999_999, 10**6, 2**53 - 1]
    rows = [(rnd.choice([*edge, rnd.randint(0, 2**53 - 1)]), rnd.choice([0, 1, 10**18 - 1, rnd.randint(0, 10**18)]), Decimal(rnd.choice([0, 5_000_000, 5_000_001, -5_000_000, 15_000_000, -25_000_000, rnd.randint(-(10**30), 10**30)]))) for _ in range(2000)]
    df = spark.createDataFrame(rows, "t long, n long, x decimal(38,0)")
    for r in df.select("*", M.class_cost(F.col("t"), F.col("n")).alias("c"), M.cents_half_even(F.col("x")).alias("h"), M.nano_to_usd(F.col("x")).alias("u")).collect():
        assert int(r.c) == r.t * r.n // 10**6 == M.cost_int(r.t, r.n) and int(r.h) == M.cents_int(int(r.x)) and r.u == M.usd_string(int(r.x))
    texts = ["5", "0.003625", " 6.25 ", "1e3", "-1", "1.2345678901", "", ".5", "5.", "123456789.123456789", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "p string").select(M.price_to_nano(F.col("p"))).collect()]
    assert got == [5 * 10**9, 3_625_000, 6_250_000_000, None, None, None, None, None, None, 123456789123456789, None]


def test_pricing(spark):
    table = spark.createDataFrame([("m", "M", "1", "2", "3", "4"), ("m-2", "M2", "5", "6", None, "0.1"), ("z", "Z", "1", "1", None, None)], pricing.CARD)
    usage = spark.createDataFrame([("m",), ("m-2-x",), ("m-3",), ("q",), ("",), ("z",)], "model string").selectExpr("model", "1000000L as input", "0L as output", "10L as cache_write", "10L as cache_read")
    got = {r.model: r for r in pricing.price(usage, pricing.cards(table)).collect()}
    assert {m: r.price_id for m, r in got.items()} == {"m": "m", "m-2-x": "m-2", "m-3": "m", "q": None, "": None, "z": "z"}
    assert got["m-2-x"].cost_total == 5 * 10**9 + 10 * 5000 + 10 * 100 and got["m-2-x"].cache_fallback and not got["m"].cache_fallback and got["q"].cost_total is None


def test_delta_and_percent(spark):
    df = spark.createDataFrame([(Decimal(4_972_967_000), Decimal(182_383_931)), (Decimal(1000), Decimal(1000)), (Decimal(0), Decimal(5)), (Decimal(1000), Decimal(1500)), (Decimal(100_000), Decimal(99_999))], "m decimal(38,0), r decimal(38,0)")
    assert [r[0] for r in df.select(rollup.delta_percent(F.col("m"), F.col("r"))).collect()] == ["-96.3", "+0.0", None, "+50.0", "+0.0"]
    df = spark.createDataFrame([(1, 3), (1, 0), (5, 10_000)], "a long, b long")
    assert [r[0] for r in df.select(rollup.percent1(F.col("a"), F.col("b"))).collect()] == [33.3, None, 0.1]


def test_confidence_ties(spark):
    rows = [("a", "high", 5), ("a", "medium", 5), ("b", "medium", 0), ("c", "low", 3), ("c", "medium", 3), ("d", None, 3)]
    df = spark.createDataFrame(rows, "k string, confidence string, input long").selectExpr("*", "0L as output", "0L as cache_write", "0L as cache_read")
    got = {r.k: (r.x, r.y) for r in df.groupBy("k").agg(rollup.dominant_confidence().alias("x"), rollup.report_confidence().alias("y")).collect()}
    assert got == {"a": ("medium", "high"), "b": ("low", "high"), "c": ("low", "medium"), "d": ("low", "—")}


def test_scope_and_paths(spark):
    rows = [("/r", ["/r/a", "/r/a", "/rx/b", "/r/c/d"]), ("/r/sub", []), ("/rx", ["/r"]), (None, [])]
    df = spark.createDataFrame(rows, "cwd string, f array<string>")
    got = df.select(events.in_scope(F.col("cwd"), F.lit("/r")), events.relative_paths(F.col("f"), F.lit("/r"))).collect()
    assert [tuple(r) for r in got] == [(True, ["a", "c/d"]), (True, []), (False, []), (False, [])]
    files = spark.createDataFrame([("p", 2, "b"), ("p", 1, "a"), ("q", 2, "b")], "source_file string, adapter_rank int, agent string")
    assert {(r.source_file, r.agent) for r in events.first_adapter(files).collect()} == {("p", "a"), ("q", "b")}


def test_ledger_is_built_again_for_other_tables(spark, tmp_path):
    """One build in a session; another one where the input or the written ledger has changed."""
    source = spark.read.parquet(f"{SF}/events.parquet")
    write = lambda n: source.where(f"event_id < {n}").write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    write(300)
    first = ledgers.demo(spark, str(tmp_path))
    assert ledgers.demo(spark, str(tmp_path)) is first and ledgers.demo(spark, str(tmp_path), Q.SIX_HOURS) is not first
    n = first.raw.count()
    write(200)
    second = ledgers.demo(spark, str(tmp_path))
    assert second is not first and second.raw.count() < n
    shutil.rmtree(second.rows.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])
    third = ledgers.demo(spark, str(tmp_path))
    assert third is not second and third.rows.count() == third.raw.count()


def shuffle_files(spark):
    """Sizes of the shuffle files that lie on the disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName(): f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}


def test_a_ledger_leaves_no_shuffle_files(spark, monkeypatch):
    """What building a ledger shuffles is off the disk with each table, also where it is built in parts; the setting
    is what it was."""
    monkeypatch.setattr(ledgers, "_BUILT", {})
    monkeypatch.setattr(tables, "PART_ROWS", 200)
    spark.conf.set(tables.CLEANUP, "false")
    before = shuffle_files(spark)
    led = ledgers.demo(spark, SF)
    assert spark.conf.get(tables.CLEANUP) == "false"
    spark.conf.unset(tables.CLEANUP)
    left = {n for n in shuffle_files(spark) if n not in before}
    assert not left, left
    assert led.rows.count() == led.raw.count() > 2 * tables.PART_ROWS


def test_ledger_queries_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ledgers, "_BUILT", {})
    monkeypatch.setattr(tables, "PART_ROWS", 200)
    for name in ("attrib_full_14d", "reprice", "reprice_delta", "rollup_by_commit", "rollup_by_model", "rollup_by_session", "rollup_total", "unpriced_models", "cache_savings", "report_log", "top_model"):
        same(Q.queries()[name](spark, SF), Q.oracle_sql()[name], SF)
    monkeypatch.setattr(ledgers, "_BUILT", {})


def test_prices_do_not_shuffle_events(spark):
    """With the models known from a table, pricing is a join with that table and deals no event by its model."""
    led = ledgers.demo(spark, SF)
    known = tables.written(pricing.known_models(led.raw, led.cards), tables.store(spark), "models")
    df = pricing.price(led.raw, led.cards, known)
    assert "hashpartitioning(model" not in df._jdf.queryExecution().executedPlan().toString()
    want = {(r.id, r.price_id, r.cost_total) for r in pricing.price(led.raw, led.cards).collect()}
    assert {(r.id, r.price_id, r.cost_total) for r in df.collect()} == want


def test_a_large_ledger_shuffles_parts(spark, monkeypatch):
    """Events are not dealt by their repository while the ledger is written, the table has no costs (they follow from
    the models), and reports of many rows come from a table that was made in parts."""
    monkeypatch.setattr(ledgers, "_BUILT", {})
    monkeypatch.setattr(tables, "PART_ROWS", 200)
    plans, really = [], tables.written

    def spied(df, folder, name, mode="overwrite"):
        if name == "ledger":
            plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return really(df, folder, name, mode)

    monkeypatch.setattr(attribution, "written", spied)
    ledgers.demo(spark, SF)
    assert len(plans) > 1 and not any("cost_total" in columns or re.search(r"hashpartitioning\(repo_id#\d+L?, \d+\)", plan) for columns, plan in plans)
    for name in ("rollup_by_commit", "rollup_by_session", "report_log"):
        got = Q.queries()[name](spark, SF)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString(), name
        same(got, Q.oracle_sql()[name], SF)
    monkeypatch.setattr(ledgers, "_BUILT", {})


#: Rollups that group by no result of the attribution, and those of commits.
EVENT_ROLLUPS = ["unpriced_models", "cache_savings", "top_model", "rollup_total", "rollup_by_model", "rollup_by_session"]
COMMIT_ROLLUPS = ["rollup_by_commit", "report_log"]


@pytest.mark.parametrize("name", EVENT_ROLLUPS + COMMIT_ROLLUPS)
def test_rollups_write_what_they_read(spark, monkeypatch, name):
    """Events are written in parts, with the columns that rollups read; only rollups of commits have events attributed,
    and keep those that a commit takes."""
    monkeypatch.setattr(ledgers, "_BUILT", {})
    monkeypatch.setattr(tables, "PART_ROWS", 200)
    made, really = [], tables.written

    def spied(df, folder, name, mode="overwrite"):
        made.append((name, mode, set(df.columns)))
        return really(df, folder, name, mode)

    monkeypatch.setattr(tables, "written", spied)
    monkeypatch.setattr(attribution, "written", spied)
    same(Q.queries()[name](spark, SF), Q.oracle_sql()[name], SF)
    own, placed = set(ledgers.ROLLED), name in COMMIT_ROLLUPS
    kept = [(mode, columns) for table, mode, columns in made if table == "events"]
    assert [mode for mode, _ in kept] == ["overwrite", *["append"] * (len(kept) - 1)] and len(kept) > 2
    assert all(columns == (own | {"id", "git_branch", "rel_files"} if placed else own) for _, columns in kept)
    assert [columns for table, _, columns in made if table == "ledger"] == [own | {"kind", "hash", "confidence"}] * (len(kept) if placed else 0)
    made.clear()
    Q.queries()[name](spark, SF)
    assert not {"events", "edits", "ledger"} & {table for table, _, _ in made}
    monkeypatch.setattr(ledgers, "_BUILT", {})


def test_rollups_read_the_ledger_that_is_there(spark):
    whole = ledgers.demo(spark, SF)
    assert ledgers.demo_rolled(spark, SF) is ledgers.demo_rolled(spark, SF, placed=False) is whole
    assert ledgers.demo_rolled(spark, SF, Q.SIX_HOURS, placed=False) is not whole
