import hashlib
import random

import pyarrow as pa
from pyspark.sql import functions as F

from costledger.llm import suffix_dedup as S
from costledger.llm.suffix_array import suffix_array


def test_suffix_array():
    rnd = random.Random(1)
    for _ in range(2000):
        s = [rnd.randint(0, rnd.choice([1, 2, 3])) for _ in range(rnd.randint(0, 20))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(rows):
    """rows: (doc_id, bytes), ids unique."""
    first, out = {}, []
    for d, t in sorted(rows):
        gone = bytearray(len(t))
        for i in range(len(t) - 99):
            w = t[i : i + 100]
            if first.setdefault(w, (d, i)) != (d, i):
                gone[i : i + 100] = b"\1" * 100
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def corpus():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(40) for _ in range(4)]
    texts = [text(rnd.randint(0, 120)) for _ in range(25)]
    texts += [text(rnd.randint(0, 20)) + rnd.choice(passages)[rnd.randint(0, 60) :] + text(rnd.randint(0, 20)) for _ in range(40)]
    texts += texts[:5] + [t[:200] + "X" + t[200:] for t in texts[5:15]] + ["ab" * 200, "z" * 500, "z" * 130, "", None, "short"]
    texts += [(passages[0] + " ") * 3, "y" + "z" * 300]
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)]


def digest(df):
    rows = []
    for r in df.collect():
        rows.append((r.doc_id, r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()))
    return sorted(rows, key=repr)


def test_against_all_windows(spark, monkeypatch):
    rows = corpus()
    want = sorted(brute([(d, (t or "").encode()) for d, t in rows]), key=repr)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df = df.withColumn("doc", F.lit("clash")).withColumn("h", F.lit(1)).withColumn("list", F.lit(2))
    assert digest(S.dedupe_bytes(df)) == want
    monkeypatch.setattr(S, "GROUP", 2)
    assert digest(S.dedupe_bytes(df)) == want


def test_blocks(monkeypatch):
    text = (" ".join(str(i * i) for i in range(400)) * 2).encode()
    plain = [[x.tolist() for x in part] for part in S.fragments(text)]
    monkeypatch.setattr(S, "BLOCK", 256)
    S._powers.cache_clear()
    cut = [tuple(x) for part in S.fragments(text) for x in zip(*(c.tolist() for c in part))]
    S._powers.cache_clear()
    covered = lambda parts: {(a + k, h, r - k) for h, a, n, r in parts for k in range(n)}
    assert covered(cut) == covered(list(zip(*plain[0])))


def test_odd_ids(spark):
    t = "".join(chr(97 + i * i % 23) + str(i) for i in range(60))
    rows = [(None, t), (3, t), (3, "another " + t), (3, t), (5, None)]
    got = [(r.doc_id, len(r.spans)) for r in S.dedupe_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == [(3, 1), (3, 1), (3, 1), (5, 0), (None, 0)]
    assert S.dedupe_bytes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeated_rows_hold_the_first_occurrence(spark, monkeypatch):
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = text(300)
    rows = [(1, text(150) + passage + text(150)), (2, text(90) + passage[40:260] + text(90)), (3, text(50) + passage[:210] + text(50))]
    want = {d: r for d, *r in brute([(d, t.encode()) for d, t in rows])}
    df = spark.createDataFrame([rows[0], *rows, rows[2]], "doc_id long, text string").repartition(3)
    repeated = sorted(((d, *want[d]) for d in (1, 1, 2, 3, 3)), key=repr)
    assert want[1][1] == 0 and want[2][1] == 220
    assert digest(S.dedupe_bytes(df)) == repeated
    monkeypatch.setattr(S, "GROUP", 1)
    assert digest(S.dedupe_bytes(df)) == repeated


def test_halves_keep_every_window():
    """Down to single windows, whose core is the whole window."""
    rnd = random.Random(17)
    text = bytes(rnd.choice(b"abcdefgh ") for _ in range(700))
    rows = [(h, first, count, reach) for h, first, count, reach in zip(*(x.tolist() for x in next(S.fragments(text))))]
    want = sorted(a + i for _, a, n, _ in rows for i in range(n))

    class Cut:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    level = [(1, 5, S._pack(a, n, r), text[a : a + n + 99], 0, 0) for _, a, n, r in rows]
    for turn in range(8):
        cols = [pa.array(c, t) for c, t in zip(zip(*level), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32()))]
        (out,) = S._halves(Cut()).run([pa.RecordBatch.from_arrays(cols, list("abcdef"))])
        level = list(zip(*(c.to_pylist() for c in out.columns)))
        got = []
        for _, doc, pos, data, left, right in level:
            first, count, reach = S._unpack(pos)
            assert data == text[first : first + count + 99]
            assert all(s <= first + reach - left and s + 100 >= first + reach + S.K + right for s in range(first, first + count))
            got += range(first, first + count)
        assert sorted(got) == want
    assert all(left + right + S.K == 100 and S._unpack(pos)[1] == 1 for _, _, pos, _, left, right in level)
