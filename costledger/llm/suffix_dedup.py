"""Removal of repeated byte strings with suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document of
smaller id, or earlier in the same one.  Equal windows of LENGTH bytes have the same minimizer (their
least K-gram by hash, the leftmost of equals) at the same place.  So each document is cut into
fragments, one per run of windows that share a minimizer occurrence, and equal windows can only be in
fragments of one minimizer.

1. Fragments whose minimizer occurs once are left out; nothing else in the corpus can match them.
2. Equal fragments: all but the first go as a whole.  Equality is that of minimizer and 128-bit hash:
   among N different fragments two are taken for one with a probability below N * N / 2^129, 2e-11 for
   10^14 (about a hundred petabytes of text).
3. First fragments of a minimizer with several different ones: each is trimmed to the bytes it may
   share with a neighbour in sorted order, on either side of the minimizer; what is then equal is
   settled as in 2; the others of the group are concatenated, and the suffix array (``suffix_array``)
   brings equal windows together.
4. A minimizer with over ``GROUP`` different fragments does not fit that.  Its fragments are halved: the
   windows that reach further to the left of what they have in common go by a longer core on that side,
   the others by one on the right, and steps 2 and 3 are repeated for these cores.  What is still too
   large is halved again, in the end down to single windows, whose core is all of them: then a group
   has one fragment, and step 2 settles it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffix_array import suffix_array
from .workspace import Workspace

LENGTH, K = 100, 24
#: Windows in a row that start in one K-gram's reach; a fragment has at most this many windows.
SPAN = LENGTH - K + 1
#: Window starts of a text that are hashed at a time; below 2^24.
BLOCK = 1 << 18
#: Different fragments of one minimizer that one task sorts.
GROUP = 2000

_ODD = 0x9E3779B97F4A7C15


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = BLOCK + LENGTH + 1
    up = lambda f: np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, f, np.uint64))))
    return up(_ODD), up(pow(_ODD, -1, 1 << 64))


def _mix(z: np.ndarray) -> np.ndarray:
    for _ in range(2):
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(32))


def fragments(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(minimizer hash, first window, windows, minimizer's distance from the first window), in blocks.

    Where a block ends a run is cut; a fragment and a part of it are two fragments of one minimizer.
    """
    power, inverse = _powers()
    for at in range(0, len(text) - LENGTH + 1, BLOCK):
        part = np.frombuffer(text, np.uint8, min(BLOCK + LENGTH - 1, len(text) - at), at).astype(np.uint64) + np.uint64(1)
        n = len(part)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(part * power[:n], out=total[1:])
        hashes = _mix((total[K:] - total[:-K]) * inverse[: n - K + 1])
        least = (hashes & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while width * 2 <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < SPAN:
            least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
        place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        count = np.diff(np.concatenate((first, [len(place)])))
        yield hashes[place[first]], first + at, count, place[first] - first


def _pack(first, count, reach):
    return first << 16 | reach << 8 | count


def _unpack(pos):
    return pos >> 16, pos & 255, pos >> 8 & 255


def _runs(docs: DataFrame) -> DataFrame:
    """(h, f, g, doc, pos): a row per fragment; f and g are the 128-bit hash of its bytes."""

    def run(batches):
        for batch in batches:
            hs, fs, ds, ps = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or b""
                for h, first, count, reach in fragments(text) if len(text) >= LENGTH else ():
                    hs.append(h)
                    ends = (first + count + (LENGTH - 1)).tolist()
                    fs.append(np.frombuffer(b"".join([xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(first.tolist(), ends)]), np.int64).reshape(-1, 2))
                    ds.append(np.full(len(h), doc, np.int64))
                    ps.append(_pack(first, count, reach))
            if hs:
                f, g = np.ascontiguousarray(np.concatenate(fs).T)
                cols = [np.concatenate(hs).view(np.int64), f, g, np.concatenate(ds), np.concatenate(ps)]
                for a in range(0, len(cols[0]), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a : a + (1 << 16)]) for c in cols], ["h", "f", "g", "doc", "pos"])

    return docs.select("doc", "text").mapInArrow(run, "h bigint, f bigint, g bigint, doc bigint, pos bigint")


def _cut(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes of fragments: (h, doc, pos, bytes).  A document's list is no longer than the document."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("h", "pos")).alias("list"))

    def run(batches):
        for batch in batches:
            hs, ds, ps, bs = [], [], [], []
            for doc, text, items in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text = text.as_py()
                for item in items.as_py():
                    first, count, _ = _unpack(item["pos"])
                    hs.append(item["h"])
                    ds.append(doc)
                    ps.append(item["pos"])
                    bs.append(text[first : first + count + LENGTH - 1])
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(ds, pa.int64()), pa.array(ps, pa.int64()), pa.array(bs, pa.binary())], ["h", "doc", "pos", "bytes"])

    # Neither side is broadcast: the lists grow with the corpus.
    return docs.join(lists.hint("merge"), "doc").select("doc", "text", "list").mapInArrow(run, "h bigint, doc bigint, pos bigint, bytes binary")


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _most_common(parts: list[bytes]) -> list[int]:
    """For each string, its longest common prefix with any other; sorted neighbours have it."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    best = [0] * len(parts)
    for i, j in zip(order, order[1:]):
        n = _common(parts[i], parts[j])
        best[i], best[j] = max(best[i], n), max(best[j], n)
    return best


def later_windows(group: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, int]]:
    """``group``: (doc, first byte, minimizer's distance from it, bytes) of different fragments of one
    minimizer, ordered.  Returns (doc, start, end) of bytes covered by windows that start earlier."""
    right = _most_common([b[r:] for _, _, r, b in group])
    left = _most_common([b[:r][::-1] for _, _, r, b in group])
    out, known, parts = [], set(), []
    for (doc, at, reach, data), r, l in zip(group, right, left):
        if l + r < LENGTH:
            continue
        start, piece = at + reach - l, data[reach - l : reach + r]
        if (l, piece) in known:
            out.append((doc, start, start + len(piece)))
        else:
            known.add((l, piece))
            parts.append((doc, start, piece))
    if len(parts) < 2:
        return out
    # One integer string: a separator of its own after each part, all less than any byte.
    whole, of, symbols = bytearray(), [], []
    for i, (_, _, piece) in enumerate(parts):
        symbols.extend(c + len(parts) for c in piece)
        symbols.append(i)
        of.extend([i] * (len(piece) + 1))
        whole += piece + b"\0"
    ends, at = [], 0
    for _, _, piece in parts:
        ends.append(at + len(piece))
        at += len(piece) + 1
    base = [e - len(p[2]) for e, p in zip(ends, parts)]
    later: dict[int, list[int]] = {}

    def settle(same: list[int]) -> None:
        if len(same) > 1:
            placed = sorted((parts[of[s]][0], parts[of[s]][1] + s - base[of[s]], s) for s in same)
            for _, _, s in placed[1:]:
                later.setdefault(of[s], []).append(s - base[of[s]])

    same: list[int] = []
    window = b""
    whole = bytes(whole)
    for s in suffix_array(symbols):
        if s + LENGTH > ends[of[s]]:
            continue
        own = whole[s : s + LENGTH]
        if own != window:
            settle(same)
            same, window = [], own
        same.append(s)
    settle(same)
    for i, offsets in later.items():
        doc, start, _ = parts[i]
        low = high = -1
        for o in sorted(offsets):
            if low >= 0 and o <= high:
                high = o + LENGTH
            else:
                if low >= 0:
                    out.append((doc, start + low, start + high))
                low, high = o, o + LENGTH
        out.append((doc, start + low, start + high))
    return out


def _sorted_groups(cut: DataFrame) -> DataFrame:
    """(doc, start, end) from the groups that fit a task."""

    def run(batches):
        held, key = [], None
        found: list[tuple[int, int, int]] = []

        def flush():
            cols = list(zip(*found)) or [(), (), ()]
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc", "start", "end"])
            found.clear()
            return out

        for batch in batches:
            for h, doc, pos, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if h != key:
                    found.extend(later_windows(held))
                    held, key = [], h
                first, _, reach = _unpack(pos)
                held.append((doc, first, reach, data))
            if len(found) > 1 << 16:
                yield flush()
        found.extend(later_windows(held))
        yield flush()

    return cut.repartition("h").sortWithinPartitions("h", "doc", "pos").select("h", "doc", "pos", "bytes").mapInArrow(run, "doc bigint, start bigint, end bigint")


def _halves(cut: DataFrame) -> DataFrame:
    """(h, doc, pos, bytes, l, r): each fragment's windows in two parts, under the hash of their longer core.

    A core are the bytes that all windows of a group have in common: the minimizer, ``l`` bytes before and
    ``r`` behind it."""

    def run(batches):
        for batch in batches:
            out = []
            for h, doc, pos, data, l, r in zip(*(batch.column(i).to_pylist() for i in range(6))):
                first, count, reach = _unpack(pos)
                slack = LENGTH - K - l - r
                more = (slack + 1) // 2
                # The first windows reach ``more`` bytes beyond the core on its left; the others then
                # reach at least ``slack + 1 - more`` beyond it on its right.
                cut_at = min(count, max(0, reach - l - more + 1))
                seed = h & 0xFFFFFFFFFFFFFFFF
                for begin, end, a, b in ((0, cut_at, l + more, r), (cut_at, count, l, r + slack + 1 - more)):
                    if begin < end:
                        key = xxhash.xxh3_64_intdigest(data[reach - a : reach + K + b], seed ^ (a > l))
                        out.append((key - (1 << 64) if key >> 63 else key, doc, _pack(first + begin, end - begin, reach - begin), data[begin : end + LENGTH - 1], a, b))
            cols = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["h", "doc", "pos", "bytes", "l", "r"])

    return cut.select("h", "doc", "pos", "bytes", "l", "r").mapInArrow(run, "h bigint, doc bigint, pos bigint, bytes binary, l int, r int")


def _large_groups(cut: DataFrame, work: Workspace) -> DataFrame | None:
    """(doc, start, end) from groups that do not fit a task, halved until they do; None if there are none.

    A level has at most two rows per row of the one before and its cores are longer by half of what was
    left, so there are at most eight."""
    found, level = None, 0
    cut = cut.withColumns({"l": F.lit(0), "r": F.lit(0)})
    while cut.limit(1).count():
        level += 1
        name = lambda n: f"{n}-{level}"  # noqa: B023, E731
        halves = work.table(_halves(cut).withColumns({"f": F.xxhash64("bytes"), "g": F.xxhash64(F.lit("second"), "bytes")}), name("halves"))
        kinds = work.table(halves.groupBy("h", "f", "g").agg(F.min(F.struct("doc", "pos")).alias("first")), name("kinds"))
        both = halves.join(kinds.hint("merge"), ["h", "f", "g"]).withColumn("is_first", F.struct("doc", "pos") == F.col("first")).drop("first", "f", "g")
        both = work.table(both, name("rows"))
        mixed = work.table(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), name("mixed"))
        rest = work.table(both.where("is_first").join(mixed.hint("merge"), "h").select("h", "doc", "pos", "bytes", "l", "r", "kinds"), name("rest"))
        done = work.table(both.where("not is_first").select("doc", *_span()).union(_sorted_groups(rest.where(F.col("kinds") <= GROUP))), name("found"))
        found = done if found is None else found.union(done)
        work.drop(name("halves"), name("kinds"), name("rows"), name("mixed"), f"rest-{level - 1}")
        cut = rest.where(F.col("kinds") > GROUP).drop("kinds")
    if level:
        work.drop(f"rest-{level}")
    return found


def _span():
    """First byte and end of a fragment's windows."""
    start = F.shiftright("pos", 16)
    return start.alias("start"), (start + F.col("pos").bitwiseAND(F.lit(255)) + (LENGTH - 1)).alias("end")


def repeated_spans(docs: DataFrame, work: Workspace) -> DataFrame:
    """``docs`` (doc bigint, text binary), doc unique.

    Returns (doc, start, end): bytes to remove, possibly overlapping.
    """
    often = work.table(_runs(docs).groupBy("h").count().where("count > 1").select("h"), "minimizers")
    runs = work.table(_runs(docs).join(often.hint("merge"), "h"), "runs")
    work.drop("minimizers")
    kinds = work.table(runs.groupBy("h", "f", "g").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count("*").alias("n")), "kinds")
    mixed = work.table(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "mixed")
    equal = work.table(runs.join(kinds.where("n > 1").select("h", "f", "g", "first").hint("merge"), ["h", "f", "g"]).where(F.struct("doc", "pos") != F.col("first")).select("doc", *_span()), "equal")
    work.drop("runs")
    wanted = kinds.join(mixed.hint("merge"), "h").select("h", "first.doc", "first.pos", "kinds")
    cut = work.table(_cut(wanted.select("h", "doc", "pos"), docs).join(mixed.hint("merge"), "h"), "cut")
    work.drop("kinds", "mixed")
    sorted_ = work.table(_sorted_groups(cut.where(F.col("kinds") <= GROUP)), "sorted")
    large = _large_groups(cut.where(F.col("kinds") > GROUP).drop("kinds"), work)
    work.drop("cut")
    return equal.union(sorted_) if large is None else equal.union(sorted_).union(large)


def keyed(docs: DataFrame, work: Workspace) -> DataFrame:
    """``docs`` (doc_id, text) with a bigint ``doc`` that orders rows like doc_id.  Where an id is null
    or has several texts, that is a number in the order of (doc_id, text hash), for all rows."""
    odd = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).where("doc_id is null or a <> b").limit(1).count()
    if not odd and dict(docs.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint"):
        return docs.withColumn("doc", F.col("doc_id").cast("bigint"))
    # Behind a global sort these numbers ascend with the order, over partitions and inside them.
    keys = docs.select("doc_id", F.xxhash64("text").alias("th")).distinct().orderBy("doc_id", "th").withColumn("doc", F.monotonically_increasing_id())
    ranks = work.table(keys, "ranks").withColumnRenamed("doc_id", "_id")
    both = docs.withColumn("_th", F.xxhash64("text"))
    return work.table(both.join(ranks.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("th"))).select("doc_id", "text", "doc"), "keyed")


def _once(keyed: DataFrame, work: Workspace) -> DataFrame:
    """(doc, text), a row per document.  Only a table that repeats a document is written again."""
    if not keyed.groupBy("doc").count().where("count > 1").limit(1).count():
        return keyed
    return work.table(keyed.select("doc", "text").dropDuplicates(["doc"]), "once")


def dedupe_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` -> (doc_id, n_bytes, spans array<struct<start, end>>, kept binary), a row per row.

    ``spans`` are the maximal removed runs, ascending; ``kept`` is what is left.  Null texts count as
    empty.  Rows that repeat an id and text are one document; an id of several texts, and null ids
    (before all others), are ordered by the text's hash.  Texts may be of any length.  Further columns
    are ignored; an empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession, "suffix")
    text = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    own = keyed(docs.select(docs[id_col].alias("doc_id"), text.alias("text")), work)
    lists = repeated_spans(_once(own, work), work).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("list"))
    both = own.join(lists.hint("merge"), "doc", "left").select("doc_id", "text", "list")

    def run(batches):
        for batch in batches:
            spans, kept = [], []
            for data, items in zip(batch.column(1), batch.column(2)):
                data, own, parts, at = data.as_py(), [], [], 0
                for item in items.as_py() or ():
                    a, b = item["start"], item["end"]
                    if own and a <= own[-1][1]:
                        own[-1] = (own[-1][0], max(own[-1][1], b))
                    else:
                        own.append((a, b))
                for a, b in own:
                    parts.append(data[at:a])
                    at = b
                spans.append([{"start": a, "end": b} for a, b in own])
                kept.append(b"".join([*parts, data[at:]]))
            size = pa.array([len(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return both.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
