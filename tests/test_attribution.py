"""Many small repositories in one Spark job each: a case is a repo_id."""

import random

from costledger.config import DAY_MS, AttributionConfig
from costledger.operators import attribution, tables

EVENT = "repo_id string, id string, session_id string, ts_ms long, git_branch string, rel_files array<string>"
COMMIT = "repo_id string, hash string, parents array<string>, author_ts_ms long, branch_hint string, files array<string>, is_merge boolean"
H, G = 14 * DAY_MS, 120_000


def plain(evs, commits, cfg):
    """The definition, event by event, for one repository."""
    targets = sorted((c for c in commits if not c["is_merge"] and len(c["parents"]) <= 1), key=lambda c: (c["author_ts_ms"], c["hash"]))
    out = {}
    for e in evs:
        rel = set(e["rel_files"])
        if not rel:
            continue
        best, n, fallback = None, 0, [None, None]
        for c in targets:
            dt = c["author_ts_ms"] - e["ts_ms"]
            if not -cfg.grace_ms <= dt <= cfg.horizon_ms:
                continue
            fs = len(rel & set(c["files"])) / len(rel)
            ts = min(1.0, max(0.0, 1 - dt / max(1, cfg.horizon_ms)))
            known = e["git_branch"] is not None and c["branch_hint"] is not None
            bs = (1.0 if e["git_branch"] == c["branch_hint"] else 0.0) if known else 0.5
            s = cfg.weight_file * fs + cfg.weight_time * ts + cfg.weight_branch * bs
            found = (c["hash"], fs, ts, bs, s)
            if fs > 0:
                n += 1
                if best is None or s > best[4]:
                    best = found
            if dt >= 0:
                fallback[1] = fallback[1] or found
                if known and bs == 1.0:
                    fallback[0] = fallback[0] or found
        if best:
            conf = "high" if best[1] >= 0.8 and (best[3] == 1 or n == 1) else "medium" if best[1] >= 0.4 else "low"
            out[e["id"]] = ("commit", best[0], conf, best[1], None)
        elif fallback[0] or fallback[1]:
            out[e["id"]] = ("commit", (fallback[0] or fallback[1])[0], "low", 0.0, None)
        else:
            out[e["id"]] = ("waste", None, None, None, None)
    done = {}
    for e in evs:
        own = sorted((x for x in evs if x["session_id"] == e["session_id"]), key=lambda x: (x["ts_ms"], x["id"]))
        edits = [x["id"] for x in own if x["id"] in out]
        at = own.index(e)
        if e["id"] in out:
            src, adopted = e["id"], None
        elif not edits:
            done[e["id"]] = ("overhead", None, None, "advisory", None, False)
            continue
        else:
            later = [x["id"] for x in own[at:] if x["id"] in out]
            src = later[0] if later else edits[-1]
            adopted = src if out[src][0] == "commit" else None
        kind, h, conf, fs, _ = out[src]
        newest = max((c["author_ts_ms"] for c in commits), default=None)
        wip = kind == "waste" and (newest is None or e["ts_ms"] > newest)
        done[e["id"]] = (kind, h, conf, "advisory" if kind == "commit" and fs == 0 else "measured", adopted, wip)
    return done


def run(spark, cases, cfg=None, attribute=attribution.attribute):
    cfg = cfg or AttributionConfig()
    evs = [(k, e["id"], e["session_id"], e["ts_ms"], e["git_branch"], e["rel_files"]) for k, (es, _) in cases.items() for e in es]
    cs = [(k, c["hash"], c["parents"], c["author_ts_ms"], c["branch_hint"], c["files"], c["is_merge"]) for k, (_, cc) in cases.items() for c in cc]
    got = attribute(spark.createDataFrame(evs, EVENT), spark.createDataFrame(cs, COMMIT), cfg)
    found = {(r.repo_id, r.id): (r.kind, r.hash, r.confidence, r.provenance, r.adopted_from, r.in_progress) for r in got.collect()}
    want = {(k, i): v for k, (es, cc) in cases.items() for i, v in plain(es, cc, cfg).items()}
    assert len(found) == len(evs)
    for key, v in want.items():
        assert found[key] == v, (key, found[key], v, cases[key[0]])
    return found


def ev(i, ts, *files, session="s", branch=None):
    return {"id": i, "session_id": session, "ts_ms": ts, "git_branch": branch, "rel_files": list(files)}


def co(h, ts, *files, branch=None, merge=False, parents=("p",)):
    return {"hash": h, "author_ts_ms": ts, "branch_hint": branch, "files": list(files), "is_merge": merge, "parents": list(parents)}


def test_definitions(spark):
    t = 1_767_225_600_000
    cases = {
        "horizon end": ([ev("a", t, "f")], [co("h", t + H, "f")]),
        "past horizon": ([ev("a", t, "f")], [co("h", t + H + 1, "f")]),
        "grace end": ([ev("a", t, "f")], [co("h", t - G, "f")]),
        "past grace": ([ev("a", t, "f")], [co("h", t - G - 1, "f")]),
        "repeated paths": ([ev("a", t, "f", "f", "g")], [co("h", t, "f", "f")]),
        "merge": ([ev("a", t, "f")], [co("m", t, "f", merge=True, parents=("p", "q")), co("h", t + 9, "x")]),
        "two parents": ([ev("a", t, "f")], [co("m", t, "f", parents=("p", "q"))]),
        "root commit": ([ev("a", t, "f")], [co("r", t, "f", parents=())]),
        "branch decides": ([ev("a", t, "f", branch="b")], [co("x", t + 1, "f", branch="c"), co("y", t + DAY_MS, "f", branch="b")]),
        "edge of high": ([ev("a", t, *"abcde")], [co("h", t, *"abcd")]),
        "edge of medium": ([ev("a", t, *"abcde")], [co("h", t, *"ab")]),
        "two candidates": ([ev("a", t, "f")], [co("h", t, "f"), co("i", t + 1, "f")]),
        "equal grace commits": ([ev("a", t, "f")], [co("z", t - 2000, "f"), co("b", t - 1000, "f")]),
        "equal times": ([ev("a", t, "f")], [co("z", t + 5, "f"), co("b", t + 5, "f")]),
        "fallback prefers its branch": ([ev("a", t, "f", branch="b")], [co("n", t + 1, "x", branch="c"), co("o", t + 2, "x", branch="b")]),
        "fallback other branch": ([ev("a", t, "f", branch="b")], [co("n", t + 1, "x", branch="c")]),
        "fallback at once": ([ev("a", t, "f")], [co("z", t, "x"), co("b", t, "y")]),
        "no fallback before": ([ev("a", t, "f")], [co("h", t - 1, "x")]),
        "wip": ([ev("a", t, "f"), ev("b", t + 1)], []),
        "next edit, then last": ([ev("1", t), ev("2", t + 1, "f"), ev("3", t + 2), ev("4", t + 3, "g"), ev("5", t + 4 + 3 * DAY_MS)], [co("f", t + 9, "f"), co("g", t + 9, "g")]),
        "same time by id": ([ev("b", t, "f"), ev("a", t), ev("c", t)], [co("h", t, "f")]),
        "overhead": ([ev("a", t), ev("b", t, "f", session="t")], [co("h", t, "f")]),
        "adopts waste": ([ev("a", t), ev("b", t + 1, "f")], [co("h", t - DAY_MS, "f")]),
    }
    got = run(spark, cases)
    assert got["edge of high", "a"][2] == "high" and got["edge of medium", "a"][2] == "medium" and got["two candidates", "a"][2] == "medium"
    assert got["equal grace commits", "a"][1] == "z" and got["equal times", "a"][1] == "b" and got["fallback at once", "a"][1] == "b"
    assert got["adopts waste", "a"][3] == "measured" and got["wip", "b"] == ("waste", None, None, "measured", None, True)


def test_random_histories(spark):
    rnd = random.Random(20260101)
    t0 = 1_767_225_600_000
    for cfg in (AttributionConfig(), AttributionConfig(horizon_days=2, grace_seconds=0), AttributionConfig(horizon_days=0.01, grace_seconds=3600)):
        cases = {}
        for k in range(120):
            files = [f"f{i}" for i in range(6)]
            minute = lambda: t0 + rnd.randint(-20, 20) * 1440 * 60_000 + rnd.randint(0, 60) * 60_000
            branch = lambda: rnd.choice([None, "main", "feat"])
            commits = [co(f"{rnd.randint(0, 9)}{i:02d}", minute(), *rnd.sample(files, rnd.randint(0, 4)), branch=branch(), merge=rnd.random() < 0.2) for i in range(rnd.randint(0, 12))]
            evs = [ev(f"{rnd.randint(0, 9)}{i:02d}", minute(), *(rnd.sample(files, rnd.randint(1, 3)) if rnd.random() < 0.4 else []), session=f"s{rnd.randint(1, 4)}", branch=branch()) for i in range(rnd.randint(0, 40))]
            cases[f"{k:03d}"] = (evs, commits)
        run(spark, cases, cfg)


def most_rows(df):
    """Rows of the largest step of a query that has run."""

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            yield from walk(node.executedPlan())
            return
        if name.endswith("QueryStageExec"):
            yield from walk(node.plan())
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            yield metric.get().value()
        for i in range(node.children().size()):
            yield from walk(node.children().apply(i))

    df.collect()
    return max(walk(df._jdf.queryExecution().executedPlan()))


def test_dense_history_is_not_paired(spark):
    """Many commits in the window of many events that share their files: right results, and no row for each pair."""
    rnd = random.Random(7)
    t, n = 1_767_225_600_000, 800
    files, branch = [f"f{i}" for i in range(4)], lambda: rnd.choice([None, "main", "feat"])
    moment = lambda: t + rnd.randint(0, 300) * 60_000
    evs = [ev(f"e{i:04d}", moment(), *rnd.sample(files, rnd.randint(1, 3)), branch=branch()) for i in range(n)]
    commits = [co(f"c{rnd.randint(0, 9)}{i:04d}", moment(), *rnd.sample(files, rnd.randint(1, 3)), branch=branch()) for i in range(n)]
    run(spark, {"r": (evs, commits)})
    edits = spark.createDataFrame([("r", e["id"], e["session_id"], e["ts_ms"], e["git_branch"], e["rel_files"]) for e in evs], EVENT)
    history = spark.createDataFrame([("r", c["hash"], c["parents"], c["author_ts_ms"], c["branch_hint"], c["files"], c["is_merge"]) for c in commits], COMMIT)
    assert most_rows(attribution.file_match(edits, history, AttributionConfig())) < 40 * n


def test_sets_in_any_order_and_weights(spark):
    """Commits that list the same files in another order are of one set; a weight of nothing leaves ties to the time."""
    t = 1_767_225_600_000
    cases = {
        "orders": ([ev("a", t, "g", "f", branch="b")], [co("x", t + 5, "f", "g", branch="b"), co("y", t + 3, "g", "f", branch="c"), co("z", t + 1, "f", "x", branch="b")]),
        "more files later": ([ev("a", t, *"abc")], [co("x", t + 1, "a"), co("y", t + 2, "a", "b", "q"), co("z", t + 3, *"abc", "d")]),
        "last in window": ([ev("a", t, "f")], [co("x", t + 1, "f"), co("y", t + H + 1, "f"), co("z", t - G - 1, "f")]),
        "null hint first": ([ev("a", t, "f", branch="b")], [co("x", t + 1, "f", branch="c"), co("y", t + 2, "f"), co("z", t + 3, "f", branch="b")]),
    }
    for weights in ((0.6, 0.25, 0.15), (0.0, 1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, 0.0, 0.0)):
        cfg = AttributionConfig(weight_file=weights[0], weight_time=weights[1], weight_branch=weights[2])
        got = run(spark, cases, cfg)
        assert got["last in window", "a"][2] == "high"


def histories(seed, cases):
    rnd = random.Random(seed)
    t, files = 1_767_225_600_000, [f"f{i}" for i in range(6)]
    moment = lambda: t + rnd.randint(-20 * 1440, 20 * 1440) * 60_000
    branch = lambda: rnd.choice([None, "main", "feat"])
    for k in range(cases):
        commits = [co(f"{rnd.randint(0, 9)}{i:02d}", moment(), *rnd.sample(files, rnd.randint(0, 4)), branch=branch(), merge=rnd.random() < 0.2) for i in range(rnd.randint(0, 12))]
        evs = [ev(f"{rnd.randint(0, 9)}{i:02d}", moment(), *(rnd.sample(files, rnd.randint(1, 4)) if rnd.random() < 0.4 else []), session=f"s{rnd.randint(1, 4)}", branch=branch()) for i in range(rnd.randint(0, 40))]
        yield f"{k:03d}", (evs, commits)


def test_parts_are_the_whole(spark, monkeypatch):
    """A table that is made in parts has the rows of one made at once, and only the last table stays."""
    cases, modes = dict(histories(20261127, 60)), []
    write = tables.written

    def spy(df, folder, name, mode="overwrite"):
        modes.append((name, mode))
        return write(df, folder, name, mode)

    monkeypatch.setattr(attribution, "written", spy)
    folder = tables.store(spark)
    in_table = lambda events, commits, cfg: attribution.attribute_table(events, commits, cfg, folder, "out", lambda df: df)
    for rows, parts in ((200, 7), (100, tables.MOST_PARTS), (10**6, 1)):
        monkeypatch.setattr(tables, "PART_ROWS", rows)
        n = sum(len(es) for es, _ in cases.values())
        assert max(1, min(tables.MOST_PARTS, -(-n // rows))) == parts, n
        modes.clear()
        once = run(spark, cases)
        assert run(spark, cases, attribute=in_table) == once
        assert [m for name, m in modes if name == "out"] == ["overwrite", *["append"] * (parts - 1)]
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        assert [f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)] == ["out"]
    assert run(spark, {}, attribute=in_table) == {} and run(spark, {"no commits": ([ev("a", 1, "f"), ev("b", 2)], [])}, attribute=in_table)
