import itertools
import math
import random
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from costledger.llm import labelled as labelled_module
from costledger.llm import packing, quality_cnn, toxicity, wordpiece
from tests.llm.fixtures import documents, empty, odd_texts


def labelled(spark, n=500):
    """Clean prose; junk with symbols; insults, some in disguise."""
    rnd = random.Random(2)
    words = ["".join(rnd.choice("aeiounrst") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [rnd.choice(words) for _ in range(rnd.randint(30, 120))]
        toxic, bad = int(i % 6 == 0), int(i % 5 == 1)
        if toxic:
            for _ in range(3):
                w.insert(rnd.randint(0, len(w)), rnd.choice(["Blarg", "bl4rg", "zwompf", "zwоmpf"]))
        if bad:
            w = [x + rnd.choice(["%%%", "$$$"]) for x in w]
        docs.append((i, " ".join(w)))
        labels.append((i, 1 - bad, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(found, labels, label):
    rows = found.join(labels, "doc_id").where("held_out").select("predicted", label, "held_out", "doc_id", "score").collect()
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)
    return sum(r.predicted == r[label] for r in rows) / len(rows)


def test_toxicity(spark):
    docs, labels = labelled(spark)
    assert accuracy(toxicity.classify(docs, labels), labels, "toxic") > 0.97
    assert {r.score for r in toxicity.classify(docs, labels.limit(0)).collect()} and toxicity.classify(empty(spark), labels).collect() == []


def test_toxicity_exceptions():
    model = toxicity.Model({" clown": 5.0}, (" clown fish ",), -4.0, 1.0)
    auto = model.automaton()
    assert toxicity.matched(toxicity.fold("A CLOWN fish"), auto) == (0.0, 0)
    assert toxicity.matched(toxicity.fold("cl0wn, c​lown and сlown!"), auto)[1] == 3
    assert toxicity.matched(toxicity.fold(""), auto) == (0.0, 0) and toxicity.matched(" x ", toxicity.Model().automaton()) == (0.0, 0)


def test_quality(spark):
    docs, labels = labelled(spark)
    assert accuracy(quality_cnn.classify(docs, labels), labels, "quality") > 0.97
    odd = quality_cnn.classify(documents(spark), labels.join(docs.select("doc_id"), "doc_id"))
    assert odd.count() == len(odd_texts())
    assert quality_cnn.classify(empty(spark), labels).collect() == []


def test_long_texts_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    net = quality_cnn.train([(bytes(rng.integers(97, 100 + 5 * (i % 2), 300).astype(np.uint8)), i % 2) for i in range(60)], epochs=1)
    texts = [b"", b"ab", bytes(rng.integers(32, 120, 5000).astype(np.uint8)), b"x" * 1000]
    want = quality_cnn.probabilities(net, net.pairs(), texts)
    monkeypatch.setattr(quality_cnn, "LAYOUT", 512)
    assert np.allclose(quality_cnn.probabilities(net, net.pairs(), texts), want, atol=1e-6)
    # One position, by the definition of the response.
    data, real, _ = quality_cnn.layout([texts[2]])
    got = quality_cnn.responses(data, real, net.pairs(), 0, 1)[0, 5]
    assert np.allclose(got, sum(net.taps[k, texts[2][5 + k]] for k in range(quality_cnn.WIDTH)), atol=1e-4)


def naive(word, pieces):
    n = 0
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in pieces), 0)
        if not k:
            return -1
        word, n = word[k:], n + 1
    return n


def test_longest_match():
    rnd = random.Random(4)
    for vocab in ([b"a", b"abcdx", b"b", b"c", b"cdy", b"dz", b"ab"], [b" a", b"bb", b"b", b"ab", b"abbba", b" "]):
        auto = wordpiece.Automaton(vocab)
        for _ in range(3000):
            w = bytes(rnd.choice(b"abcdxyz ") for _ in range(rnd.randint(0, 9)))
            assert auto.length(w) == naive(w, set(vocab)), w


def test_token_counts(spark):
    vocab = [bytes([c]) for c in range(256) if c != ord("#")] + [b" wort", b"ort1", b"xxxx", b" x"]
    got = {r.doc_id: r for r in wordpiece.token_counts(documents(spark), vocab).collect()}
    for i, t in enumerate(odd_texts()):
        lens = [naive(b" " + w, set(vocab)) for w in (t or "").encode().split()]
        r = got[i * 13 % 997]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(lens), sum(1 if n < 0 else n for n in lens), lens.count(-1))
    assert wordpiece.token_counts(empty(spark), vocab).collect() == []


def test_boundaries():
    rnd = random.Random(5)
    for _ in range(200):
        m = rnd.randint(1, 7)
        lens, counts, k = rnd.sample(range(30), m), [rnd.randint(1, 9) for _ in range(m)], rnd.randint(1, 4)
        pad = lambda b: sum(c * (min(x for x in b if x >= n) - n) for n, c in zip(lens, counts))  # noqa: B023, E731
        best = min(pad(b) for r in range(1, min(k, m) + 1) for b in itertools.combinations(sorted(lens), r) if max(b) == max(lens))
        got = packing.best_boundaries(lens, counts, k)
        assert pad(got) == best and len(got) <= k


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 16)
    rnd = random.Random(6)
    rows = [(i, rnd.choice([0, 3, 7, 40, 250])) for i in range(300)] + [(None, 5), (7, 9), (8, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), buckets=3, max_len=100, token_budget=400).collect()
    assert sum(r.n_tokens for r in got) == sum(n or 0 for _, n in rows)
    assert len(got) == sum(max(1, -(-(n or 0) // 100)) for _, n in rows)
    batches = {}
    for r in got:
        assert r.n_tokens <= r.padded_len
        batches.setdefault((r.bucket, r.batch_id), []).append((r.slot, r.padded_len))
    for key, members in batches.items():
        per = max(1, 400 // max(1, members[0][1]))
        assert sorted(s for s, _ in members) == list(range(len(members))) and len(members) <= per
        assert len(members) == per or key[1] == max(b for k, b in batches if k == key[0])
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).collect() == []


def test_pack_with_a_hot_shard(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 8)
    rows = [(None, 5)] * 300 + [(7, 9)] * 200 + [(i, i % 40) for i in range(100)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("bucket", F.lit("clash")), buckets=2, max_len=100, token_budget=100).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in got) == sorted((-1 if d is None else d, n) for d, n in rows)
    places = {}
    for r in got:
        places.setdefault(r.bucket, []).append(r.batch_id * max(1, 100 // r.padded_len) + r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_training_rows_are_bounded(spark):
    free = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5][:12]
    one = free[0]
    labels = spark.createDataFrame([(i, 1) for i in free] + [(one, 0), (None, 1), (free[1], None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(one, f"text {k}") for k in range(3000)] + [(i, "x" * 100) for i in free[1:]] * 3 + [(99, "unlabelled")], "doc_id long, text string")
    got = labelled_rows(docs, labels, 10)
    assert len(got) <= 10 and all(y == 1 for _, y in got) and sum(t.startswith(b"text") for t, _ in got) <= 1
    assert len(labelled_rows(docs, labels, 100)) == len(free)
    small = labelled_rows(docs, labels, 100, 350)
    assert 0 < sum(len(t) for t, _ in small) <= 350
    assert labelled_rows(docs, labels, 100, 350) == small and labelled_rows(empty(spark), labels, 5) == []


def labelled_rows(docs, labels, rows, *size):
    return labelled_module.training_rows(docs, labels, "toxic", rows, *size)


def plain_matches(folded, weights, exceptions):
    """All occurrences of patterns; those inside an occurrence of an exception do not count."""
    places = lambda p: [i for i in range(len(folded)) if folded.startswith(p, i)]
    exempt = [(i, i + len(p)) for p in exceptions for i in places(p)]
    hits = [w for p, w in weights.items() if p not in exceptions for i in places(p) if not any(a <= i and i + len(p) <= b for a, b in exempt)]
    return sum(hits), len(hits)


def test_matching_against_all_occurrences():
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 4)))
    for _ in range(300):
        weights = {f" {word()}": float(rnd.randint(1, 9)) for _ in range(rnd.randint(0, 5))}
        exceptions = tuple({f" {word()} {word()} " for _ in range(rnd.randint(0, 4))}) if weights else ()
        folded = f" {' '.join(word() for _ in range(rnd.randint(0, 40)))} "
        got = toxicity.matched(folded, toxicity.Model(weights, exceptions).automaton())
        assert got == plain_matches(folded, weights, exceptions), (folded, weights, exceptions)


def test_matching_is_linear():
    auto = toxicity.Model({" clown": 1.0}, (" clown fish ",)).automaton()
    times = []
    for n in (20_000, 160_000):
        folded = " clown fish" * n + " "
        began = time.perf_counter()
        assert toxicity.matched(folded, auto) == (0.0, 0)
        times.append(time.perf_counter() - began)
    assert times[1] < 40 * times[0]


def test_length_is_that_of_the_words(spark):
    model = toxicity.Model({" clown": 5.0}, (), -1.0, 1.0)
    plain, marked = " ".join(["clown"] + ["word"] * 400), ", ".join(["clown"] + ["word -- "] * 400)
    rows = [(1, plain), (2, marked), (3, None), (4, ""), (5, " \n"), (6, "clown " * 200_000), (6, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("predicted", F.lit(7))
    got = [(r.doc_id, r.score, r.n_matches) for r in toxicity.score(docs, model).collect()]
    by = dict((d, s) for d, s, _ in got if d != 6)
    assert abs(by[1] - by[2]) < 1e-12 and by[3] == by[4] == by[5] and sorted(n for d, _, n in got if d == 6) == [0, 200_000]
    assert abs(by[1] - 1 / (1 + math.exp(1 - 5 / (1 + math.log1p(401 / 500))))) < 1e-12
    assert toxicity.score(empty(spark), model).collect() == []


def test_learned_exceptions():
    rnd = random.Random(3)
    filler = lambda: " ".join("".join(rnd.choice("eiou") + rnd.choice("lmnr") for _ in range(3)) for _ in range(30))
    rows = [(f"{filler()} clown {filler()}".encode(), 1) for _ in range(40)]
    rows += [(f"{filler()} clown fish {filler()}".encode(), 0) for _ in range(6)] + [(filler().encode(), 0) for _ in range(200)]
    model = toxicity.fit(rows)
    assert any(" clown".startswith(p) for p in model.weights) and " clown fish " in model.exceptions
    auto = model.automaton()
    assert toxicity.matched(toxicity.fold("a CL0WN fish"), auto)[1] == 0 and toxicity.matched(toxicity.fold("a clown cried"), auto)[1] == 1


def network(dtype, seed=4):
    rng = np.random.default_rng(seed)
    f = quality_cnn.FILTERS
    return quality_cnn.Network(rng.normal(0, 0.3, (quality_cnn.WIDTH, 256, f)).astype(dtype), rng.normal(0, 0.2, f).astype(dtype), rng.normal(0, 0.5, 2 * f).astype(dtype), np.array([0.1], dtype))


def naive_probability(net, text):
    """The network by its definition, position by position."""
    chunk, width = quality_cnn.CHUNK, quality_cnn.WIDTH
    padded = text + b"\0" * width
    pooled = []
    for a in range(0, len(text) + width - 1, chunk):
        inside = [sum(net.taps[k, padded[p + k]] for k in range(width)) for p in range(a, min(a + chunk, len(text)))]
        pooled.append(np.maximum(np.max(inside, 0) + net.bias, 0) if inside else np.zeros(quality_cnn.FILTERS))
    v = np.concatenate((np.mean(pooled, 0), np.max(pooled, 0)))
    return 1 / (1 + math.exp(-(v @ net.out + net.base[0])))


def test_network_against_its_definition(monkeypatch):
    rng = np.random.default_rng(8)
    net = network(np.float64)
    sizes = [0, 1, 5, 59, 60, 63, 64, 65, 300, 512, 515, 1000]
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in sizes]
    want = [naive_probability(net, t) for t in texts]
    assert np.allclose(quality_cnn.probabilities(net, net.pairs(), texts), want, atol=1e-9)
    monkeypatch.setattr(quality_cnn, "LAYOUT", 128)  # texts in parts
    monkeypatch.setattr(quality_cnn, "BLOCK", 3)
    assert np.allclose(quality_cnn.probabilities(net, net.pairs(), texts), want, atol=1e-9)


def test_gradients_against_differences():
    rng = np.random.default_rng(9)
    net, decay = network(np.float64), 1e-2
    texts = [bytes(rng.integers(97, 110, n).astype(np.uint8)) for n in (0, 3, 70, 200)]
    y = np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        p = quality_cnn.probabilities(net, net.pairs(), texts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + decay / 2 * (np.sum(net.taps**2) + np.sum(net.out**2))

    for params, grad in zip((net.taps, net.bias, net.out, net.base), quality_cnn.gradients(net, texts, y, decay)):
        flat, g = params.reshape(-1), np.asarray(grad).reshape(-1)
        assert flat.shape == g.shape
        # The steepest ones, and some at random.
        for i in {*np.argsort(-abs(g))[:12], *rng.integers(0, len(g), 12)}:
            held = flat[i]
            flat[i] = held + 1e-6
            up = loss()
            flat[i] = held - 1e-6
            down = loss()
            flat[i] = held
            assert abs((up - down) / 2e-6 - g[i]) < 1e-5, (i, (up - down) / 2e-6, g[i])
