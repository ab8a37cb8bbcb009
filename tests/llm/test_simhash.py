import random

import numpy as np
import xxhash

from costledger.llm import simhash as S


def plain(text, k=4):
    w = (text or "").encode()
    w = w.lower().split()
    sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fp = [(d, plain(t)) for d, t in rows]
    low = {f: f for _, f in fp}
    keys = list(low)
    label = {f: min(d for d, g in fp if g == f) for f in keys}
    moved = True
    while moved:
        moved = False
        for f in keys:
            m = min(label[g] for g in keys if (f ^ g).bit_count() <= 4)
            moved |= m != label[f]
            label[f] = m
    return sorted((d, f"{f:016x}", label[f]) for d, f in fp)


def brute_by_id(rows):
    """Components of ids: equal ids, and fingerprints within the radius, are links."""
    fp = [(d, plain(t)) for d, t in rows]
    label = {d: d for d, _ in fp}
    for _ in fp:
        for d, f in fp:
            label[d] = min(label[e] for e, g in fp if e == d or (f ^ g).bit_count() <= 4)
    return sorted((d, f"{f:016x}", label[d]) for d, f in fp)


def corpus():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(50)] + ["Ünï", "AB", "x" * 300]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 200))) for _ in range(60)]
    texts += [t.replace("w1 ", "w2 ", 1) for t in texts[:30]] + texts[:10] + ["", None, " \t\n", "one two", "ONE two"]
    return [(i * 3 % 211, t) for i, t in enumerate(texts)]


def test_signature_in_pieces(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 64)
    for _, t in corpus():
        assert int.from_bytes(S.signature(t.encode() if t else None, 4, 1), "big") == plain(t)


def test_forest_against_all_pairs():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 200).astype(np.uint64)
    flips = [sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(0, 7)))) for _ in range(100)]
    x = np.r_[x, [x[i] ^ np.uint64(f) for i, f in enumerate(flips)]].astype(np.uint64)
    n = len(x)
    label, _ = S.forest(x.astype(">u8").view(np.uint8).reshape(n, 8), np.arange(n) + 1, np.full(n, n), 4)
    want = np.arange(n)
    near = np.array([[(int(a) ^ int(b)).bit_count() <= 4 for b in x] for a in x])
    for _ in range(10):
        want = np.array([want[row].min() for row in near])
    assert (label == want).all()


def test_components(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 8)  # many tiles
    rows = corpus()
    df = spark.createDataFrame([(d, t, "extra") for d, t in rows], "doc_id long, text string, sig string").repartition(3)
    got = sorted(tuple(r) for r in S.simhash_components(df).collect())
    assert got == brute(rows)


def test_edge_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_components(none).collect() == []
    odd = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (None, "zz yy xx")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in S.simhash_components(odd).collect())
    assert got == [(-1, -1), (-1, 4), (4, 4), (4, 4)]


def test_near_duplicates(spark):
    rnd = random.Random(5)
    base = [[f"w{rnd.randint(0, 5000)}" for _ in range(150)] for _ in range(40)]
    near = [w[:70] + ["changed"] + w[71:] for w in base[:20]]
    rows = [(i, " ".join(w)) for i, w in enumerate(base + near)]
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[40 + i] == got[i] == i for i in range(20)) and all(got[i] == i for i in range(20, 40))


def test_near_duplicates_with_filler(spark):
    rnd = random.Random(6)
    filler = " ".join(["."] * 104)
    rows = [(i, " ".join(f"w{rnd.randint(0, 50000)}" for _ in range(300)) + " " + filler) for i in range(12)]
    rows += [(20, rows[0][1].replace(" . .", " . . ."))]
    sigs = {S.signature(t.encode(), 5, 8) for _, t in rows[:2]}
    assert len(sigs) == 1 or sum((x ^ y).bit_count() for x, y in zip(*sigs)) <= 53
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(12)} | {20: 0}


def test_equal_signatures_are_verified(spark, monkeypatch):
    real = S.set_signature
    monkeypatch.setattr(S, "set_signature", lambda t, n, w: (b"\x55" * 64, real(t, n, w)[1]))
    rows = [(i, " ".join(f"{'abc'[i % 3]}{k}" for k in range(60))) for i in range(6)]
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 3 for i in range(6)}


def jaccard_components(rows, k=5, similarity=0.8):
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (t.split() for _, t in rows)]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    label = list(range(len(rows)))
    for _ in rows:
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    return {d: rows[label[i]][0] for i, (d, _) in enumerate(rows)}


def family(members, pairs, seed):
    """Documents of one template at a similarity of about 0.7, of which the last have a copy at about 0.87."""
    rnd = random.Random(seed)
    new = lambda n: [f"w{rnd.randint(0, 99999)}" for _ in range(n)]
    template = new(240)
    own = [template + new(50) for _ in range(members)]
    return [(i, " ".join(w)) for i, w in enumerate(own + [w[:-18] + new(18) for w in own[members - pairs :]])]


def test_pairs_in_a_family(spark, monkeypatch):
    rows = family(60, 30, 7)
    want = jaccard_components(rows)
    assert len(set(want.values())) == 60
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in S.near_duplicates(df).collect()} == want
    monkeypatch.setattr(S, "CHUNK", 16)  # many tiles
    assert {r.doc_id: r.component_id for r in S.near_duplicates(df).collect()} == want


def test_bands_miss_little():
    rng = np.random.default_rng(3)
    bands = S.sliced_bands(512, 14)
    far = np.packbits(rng.random((20000, 512)) < S.expected_distance(0.8, 512) / 512, axis=1)
    missed = np.ones(len(far), bool)
    for key in S._keys(far, bands):
        missed &= key != 0
    assert missed.mean() < 0.003


def test_rows_of_one_id_are_one_document(spark):
    words = lambda s: " ".join(f"{s}{k}" for k in range(60))
    cases = [[(5, words("a")), (3, words("b")), (5, words("b"))], [(9, "x"), (9, "y"), (4, "y"), (4, "z"), (2, "z"), (7, "w"), (9, "x")]]
    rnd = random.Random(14)
    cases.append([(rnd.randint(1, 40), words(rnd.randint(1, 60))) for _ in range(60)])
    for rows in cases:
        got = sorted(tuple(r) for r in S.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == brute_by_id(rows)


def test_recall_of_pairs(spark):
    """Of all pairs at 0.8 or more among the test tables' documents."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    sets, by = {}, {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
        for s in sets[d]:
            by.setdefault(s, []).append(d)
    met = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    pairs = [(a, b) for a, b in met if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    found = sum(got[a] == got[b] for a, b in pairs)
    print(f"{found} of {len(pairs)} pairs")
    assert len(pairs) > 30 and found >= 0.9 * len(pairs)
    assert all(root(d) == root(c) for d, c in got.items())
