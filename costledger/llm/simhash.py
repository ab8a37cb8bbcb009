"""SimHash near-duplicate groups by bit-sliced comparison.

A document's signature is ``words`` times 64 bits: bit i is set if it is set in over half of its
shingles' hashes.  Equal signatures are collapsed first, so copies cost nothing further.  Rows meet
in buckets of equal signature slices (``bands``).  Inside a bucket the signatures are stored as bit
planes: word w of plane p holds bit p of 64 signatures, so that one XOR compares a query with 64
others at that bit.  Differing bits are added up by carry-save adders into bit-sliced counters, and a
block of 64 is abandoned as soon as all its counters are above the radius.

A bucket of over ``CHUNK`` signatures is cut into chunks, and each pair of chunks becomes a task's
tile, so no group of any size meets in one task.  A tile emits a spanning forest of its links, never
all pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytestext import word_lists
from .components import connected_components
from .text import let, word_hashes, words as words_of
from .workspace import Workspace

#: Signatures of one bucket that are compared in one piece.
CHUNK = 4096
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
#: Work items (a query against 64 signatures) in flight.
ITEMS = 1 << 15

#: Earlier rows of a tile to which a row is compared by its shingles at first.  A row meets others in many
#: bands, and a group's least rows in most of them, so this joins most groups without all pairs being made.
#: Rows that meet more are compared with all of them that are not joined by then.
LINKS = 3
#: Bytes of shingle hashes in one chunk of rows that are compared with all others.
SET_BYTES = 1 << 25

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes | None, n_words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each run of ``n_words`` words, in pieces.  A-Z are lower-cased; words are
    separated by ASCII white space.  Fewer words than that: the hash of all.  None: nothing."""
    if not text:
        return
    carry: list[bytes] = []
    first = True
    hash_of = xxhash.xxh64_intdigest
    for part in word_lists(text.lower(), PIECE):
        words = carry + part
        if len(words) < n_words:
            carry = words
            continue
        first = False
        joined = b" ".join(words)
        ends = list(itertools.accumulate(map(len, words)))
        n = len(words) - n_words + 1
        starts = itertools.chain((0,), map(int.__add__, ends, range(1, n)))
        stops = map(int.__add__, ends[n_words - 1 :], range(n_words - 1, len(words)))
        yield np.fromiter((hash_of(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n)
        carry = words[-(n_words - 1) :] if n_words > 1 else []
    if first and carry:
        yield np.array([hash_of(b" ".join(carry), 42)], np.uint64)


def widen(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` independent 64-bit hashes of each; the first is the hash itself."""
    if words == 1:
        return hashes[:, None]
    z = hashes[:, None] + np.arange(words, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    z[:, 0] = hashes
    return z


def column_counts(rows: np.ndarray) -> np.ndarray:
    """How many of the rows (n, words) have each bit set, by carry-save addition: (words, 64)."""
    shift = np.arange(64, dtype=np.uint64)
    total = np.zeros((rows.shape[1], 64), np.int64)
    weight = 0
    while len(rows):
        carries = []
        while len(rows) > 2:
            m = len(rows) // 3
            a, b, c = rows[:m], rows[m : 2 * m], rows[2 * m : 3 * m]
            u = a ^ b
            carries.append((a & b) | (u & c))
            rows = np.concatenate((u ^ c, rows[3 * m :]))
        if len(rows) == 2:
            carries.append(rows[:1] & rows[1:])
            rows = rows[:1] ^ rows[1:]
        total += (((rows[0][:, None] >> shift) & np.uint64(1)).astype(np.int64)) << weight
        rows = np.concatenate(carries) if carries else rows[:0]
        weight += 1
    return total


def signature(text: bytes | None, n_words: int, words: int) -> bytes:
    """Big-endian signature; without words, all zero."""
    counts, n = np.zeros((words, 64), np.int64), 0
    for hashes in shingle_hashes(text, n_words):
        n += len(hashes)
        counts += column_counts(widen(hashes, words))
    bits = (2 * counts > n)[:, ::-1]
    return np.packbits(bits.astype(np.uint8), axis=1).tobytes()


def signatures(docs: DataFrame, n_words: int = 5, words: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sig): one row per row of ``docs``.  Null and empty texts have the zero signature."""

    def run(batches):
        for batch in batches:
            sigs = [signature(t.as_py(), n_words, words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary())], ["doc_id", "sig"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, sig binary")


def set_signature(text: bytes | None, n_words: int, words: int) -> tuple[bytes, bytes]:
    """(signature, digest) of the set of a text's shingles: repeats count once."""
    hashes = np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, n_words)]))
    counts = np.zeros((words, 64), np.int64)
    for at in range(0, len(hashes), 1 << 18):
        counts += column_counts(widen(hashes[at : at + (1 << 18)], words))
    bits = (2 * counts > len(hashes))[:, ::-1]
    return np.packbits(bits.astype(np.uint8), axis=1).tobytes(), xxhash.xxh3_128_digest(hashes.tobytes())


def set_signatures(docs: DataFrame, n_words: int, words: int) -> DataFrame:
    """(doc_id, sig, digest): one row per row of ``docs``; equal shingle sets have equal digests."""

    def run(batches):
        for batch in batches:
            found = [set_signature(t.as_py(), n_words, words) for t in batch.column(1)]
            sigs, digests = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary()), pa.array(digests, pa.binary())], ["doc_id", "sig", "digest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs["text"].cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, sig binary, digest binary")


def planes_of(sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures as bytes (n, m) -> bits (8m, n) and planes (8m, ceil(n / 64)) of 64-bit words."""
    bits = np.ascontiguousarray(np.unpackbits(sigs, axis=1).T)
    pad = -bits.shape[1] % 64
    wide = np.pad(bits, ((0, 0), (0, pad))) if pad else bits
    return bits, np.ascontiguousarray(np.packbits(wide, axis=1, bitorder="little")).view("<u8")


def _add(a, b, c):
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose bit-sliced counter is over the radius."""
    over, level = np.zeros_like(counter[0]), np.full_like(counter[0], _ONES)
    for i in reversed(range(len(counter))):
        if radius >> i & 1:
            level &= counter[i]
        else:
            over |= level & counter[i]
            level &= ~counter[i]
    return over


def close_lanes(bits: np.ndarray, planes: np.ndarray, query: np.ndarray, word: np.ndarray, valid: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, other row) within the radius; an item compares a query with 64 lanes."""
    n_bits = len(bits)
    counter = [np.zeros(len(query), np.uint64) for _ in range(n_bits.bit_length())]
    for at in range(0, n_bits, 7):
        diff = [planes[p][word] ^ (np.uint64(0) - bits[p][query].astype(np.uint64)) for p in range(at, min(at + 7, n_bits))]
        diff += [np.zeros(len(query), np.uint64)] * (7 - len(diff))
        ones, c1 = _add(*diff[:3])
        ones, c2 = _add(ones, *diff[3:5])
        ones, c3 = _add(ones, *diff[5:])
        twos, fours = _add(c1, c2, c3)
        carry = np.zeros(len(query), np.uint64)
        for i in range(len(counter)):
            plane = (ones, twos, fours)[i] if i < 3 else None
            if plane is None:
                counter[i], carry = counter[i] ^ carry, counter[i] & carry
            else:
                counter[i], carry = _add(counter[i], plane, carry)
        if at + 7 > radius:
            valid = valid & ~_above(counter, radius)
            keep = valid != 0
            if not keep.any():
                return query[:0], query[:0]
            if keep.mean() < 0.75:
                query, word, valid, counter = query[keep], word[keep], valid[keep], [c[keep] for c in counter]
    lanes = np.unpackbits(valid.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    item, lane = np.nonzero(lanes)
    return query[item], word[item] * 64 + lane


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(flat := label[label], label):
            label[:] = flat


def close_pairs(sigs: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (n, m bytes); row i is compared with rows first[i] to last[i] - 1.

    Yields pairs (row, other row) within the radius, ordered, in pieces."""
    bits, planes = planes_of(sigs)
    rows = np.flatnonzero(last > first)
    spans = ((last[rows] - 1) >> 6) - (first[rows] >> 6) + 1
    at, total = 0, np.cumsum(spans)
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + ITEMS, "right")))
        part, span = rows[at:stop], spans[at:stop]
        query = np.repeat(part, span)
        word = np.repeat(first[part] >> 6, span) + np.arange(len(query)) - np.repeat(np.cumsum(span) - span, span)
        low = np.clip(first[query] - word * 64, 0, 63).astype(np.uint64)
        high = np.clip(last[query] - 1 - word * 64, 0, 63).astype(np.uint64)
        valid = (_ONES << low) & (_ONES >> (np.uint64(63) - high))
        yield close_lanes(bits, planes, query, word, valid, radius)
        at = stop


def forest(sigs: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the smallest row that it is linked with through rows of these comparisons; and the
    rows for which that is another row."""
    label = np.arange(len(sigs))
    for a, b in close_pairs(sigs, first, last, radius):
        _merge(label, a, b)
    return label, np.flatnonzero(label != np.arange(len(sigs)))


def _tile(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in ("band", "key", "i", "j")], 1)


def _ranges(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by tile and chunk -> (first, last, sigs) to compare, and the first row of each row's tile."""
    n = table.num_rows
    tile = _tile(table)
    new = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]).any(1)])
    bound = np.r_[new, n]
    of = np.repeat(np.arange(len(new)), np.diff(bound))
    first, last = np.arange(n) + 1, bound[of + 1].copy()
    across = tile[:, 2] != tile[:, 3]
    own = table.column("chunk").to_numpy() == tile[:, 2]
    start_j = np.r_[new, 0][:-1] + np.add.reduceat((own & across).astype(np.int64), new) if n else new
    first = np.where(across, start_j[of], first)
    last = np.where(across & ~own, first, last)
    sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(n, -1)
    return first, last, sigs, new[of]


def _links(radius: int):
    """Rows sorted by tile and chunk -> links (a, b) of nodes, a spanning forest for each tile."""

    def links(table: pa.Table) -> pa.RecordBatch:
        first, last, sigs, _ = _ranges(table)
        label, moved = forest(sigs, first, last, radius)
        node = table.column("node").to_numpy()
        a, b = node[moved], node[label[moved]]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return links


def _new(sigs: np.ndarray, bands: list[list[tuple[int, int]]], band: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) of rows agree on no band before that in which they have met."""
    rows, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    keys, x, y = _keys(sigs[rows], bands), at[: len(a)], at[len(a) :]
    new = np.ones(len(a), bool)
    for k in range(len(bands)):
        new &= (band[a] <= k) | (keys[k][x] != keys[k][y])
    return new


def _candidates(radius: int, bands: list[list[tuple[int, int]]]):
    """Rows sorted by tile and chunk -> pairs (a, b) of nodes within the radius, for each row those with
    the first ``LINKS`` earlier rows of its tile; and (band, key, i, j) of tiles that have more.

    Near copies meet in many bands, and the least rows of a group in most: a pair is given in the first
    band that it agrees on only.  Where it is not among the first there, that tile is one that has more."""

    def links(table: pa.Table) -> pa.RecordBatch:
        first, last, sigs, start_of = _ranges(table)
        band = table.column("band").to_numpy()
        taken, more = np.zeros(len(sigs), np.int64), np.zeros(len(sigs), bool)
        found = [np.zeros((0, 2), np.int64)]
        for a, b in close_pairs(sigs, first, last, radius):
            order = np.argsort(b, kind="stable")
            a, b = a[order], b[order]
            start = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else b
            keep = np.arange(len(b)) - np.repeat(start, np.diff(np.r_[start, len(b)])) + taken[b] < LINKS
            taken += np.bincount(b, minlength=len(sigs))
            more[start_of[b[~keep]]] = True
            a, b = a[keep], b[keep]
            new = _new(sigs, bands, band, a, b)
            found.append(np.stack((a[new], b[new]), 1))
        node = table.column("node").to_numpy()
        a, b = node[np.concatenate(found)].T
        tile = _tile(table)[more]
        fill = lambda n, kind: pa.nulls(n, kind)
        ends = [pa.concat_arrays([pa.array(c), fill(len(tile), pa.int64())]) for c in (np.maximum(a, b), np.minimum(a, b))]
        tiles = [pa.concat_arrays([fill(len(a), kind), pa.array(c, kind)]) for c, kind in zip(tile.T, (pa.int32(), pa.int64(), pa.int32(), pa.int32()))]
        return pa.RecordBatch.from_arrays([*ends, *tiles], ["a", "b", "band", "key", "i", "j"])

    return links


def _unjoined(radius: int, bands: list[list[tuple[int, int]]]):
    """Rows sorted by tile and chunk -> (band, key, node, sig, component) of rows within the radius of one
    of another component.  A pair counts in the first band that it agrees on."""

    def rows(table: pa.Table) -> pa.RecordBatch:
        first, last, sigs, _ = _ranges(table)
        band, component = table.column("band").to_numpy(), table.column("component").to_numpy()
        open_ = np.zeros(len(sigs), bool)
        for a, b in close_pairs(sigs, first, last, radius):
            apart = component[a] != component[b]
            a, b = a[apart], b[apart]
            new = _new(sigs, bands, band, a, b)
            open_[a[new]] = open_[b[new]] = True
        at = pa.array(np.flatnonzero(open_))
        names = ["band", "key", "node", "sig", "component"]
        return pa.RecordBatch.from_arrays([table.column(c).combine_chunks().take(at) for c in names], names)

    return rows


def _verified(radius: int, similarity: float):
    """Rows sorted by tile and chunk, with their shingle sets ``s`` -> links (a, b) of nodes of different
    components whose sets are at least so similar.  All pairs within the radius that are not joined by
    then are compared."""

    def links(table: pa.Table) -> pa.RecordBatch:
        first, last, sigs, _ = _ranges(table)
        lists = table.column("s").combine_chunks()
        flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        sets = [np.sort(flat[e - n : e]) for e, n in zip(ends, sizes)]
        node = table.column("node").to_numpy()
        _, start, of = np.unique(table.column("component").to_numpy(), return_index=True, return_inverse=True)
        label, found = start[of], [np.zeros((0, 2), np.int64)]
        for a, b in close_pairs(sigs, first, last, radius):
            able = (label[a] != label[b]) & (np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b]))
            a, b = a[able], b[able]
            cuts = np.r_[np.flatnonzero(np.r_[True, a[1:] != a[:-1]]), len(a)] if len(a) else a
            for lo, hi in zip(cuts, cuts[1:]):
                x, ys = a[lo], b[lo:hi]
                ys = ys[label[ys] != label[x]]
                if not len(ys):
                    continue
                other, n = np.concatenate([sets[y] for y in ys]), sizes[ys]
                at = np.searchsorted(sets[x], other)
                hit = np.zeros(len(other) + 1, np.int64)
                inside = at < sizes[x]
                hit[1:][inside] = sets[x][at[inside]] == other[inside]
                total, stop = np.cumsum(hit), np.cumsum(n)
                common = total[stop] - total[stop - n]
                ys = ys[common >= similarity * (sizes[x] + n - common)]
                found.append(np.stack((np.full(len(ys), x), ys), 1))
                _merge(label, found[-1][:, 0], ys)
        a, b = node[np.concatenate(found)].T
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return links


def _by_tile(work_on, rows: int = 1 << 15):
    """Hands whole tiles of batches sorted by tile to ``work_on``, about ``rows`` rows at a time."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < rows:
                continue
            table = pa.Table.from_batches(held)
            tile = _tile(table)
            cut = np.flatnonzero((tile != tile[-1]).any(1))
            if len(cut):
                done = int(cut[-1]) + 1
                yield work_on(table.slice(0, done))
                table = table.slice(done)
            held = table.to_batches()
        if held and sum(b.num_rows for b in held):
            yield work_on(pa.Table.from_batches(held))

    return run


def exact_bands(bits: int, radius: int, blocks: int) -> list[list[tuple[int, int]]]:
    """Slices such that signatures within the radius agree on one of them (pigeonhole): the bits
    are cut into ``blocks``, and each choice of ``blocks - radius`` of them is a band."""
    cuts = [round(i * bits / blocks) for i in range(blocks + 1)]
    return [[(cuts[i], cuts[i + 1]) for i in pick] for pick in itertools.combinations(range(blocks), blocks - radius)]


def sliced_bands(bits: int, band_bits: int, orders: int = 2) -> list[list[tuple[int, int]]]:
    """The bands of ``band_bits`` that the bits give in their own order, and in shuffled ones."""
    starts = range(0, bits - band_bits + 1, band_bits)
    bands = [[(a, a + band_bits)] for a in starts]
    for seed in range(1, orders):
        order = np.random.default_rng(seed).permutation(bits).tolist()
        bands += [[(p, p + 1) for p in order[a : a + band_bits]] for a in starts]
    return bands


def _keys(sigs: np.ndarray, bands: list[list[tuple[int, int]]]) -> list[np.ndarray]:
    """Signatures as bytes (n, m) -> for each band, the bits of its slices as numbers."""
    bits = np.ascontiguousarray(np.unpackbits(sigs, axis=1).T)
    keys = []
    for spans in bands:
        key = np.zeros(len(sigs), np.int64)
        for a, b in spans:
            for p in range(a, b):
                key = key << 1 | bits[p]
        keys.append(key)
    return keys


def _bucketed(reps: DataFrame, bands: list[list[tuple[int, int]]]) -> DataFrame:
    """A row per band: (band, key, node, sig)."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = batch.column(0)
            for band, key in enumerate(_keys(np.frombuffer(b"".join(sig.to_pylist()), np.uint8).reshape(n, -1), bands)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, band, np.int32)), pa.array(key), batch.column(1), sig], ["band", "key", "node", "sig"])

    return reps.select("sig", "node").mapInArrow(run, "band int, key bigint, node bigint, sig binary")


def _tiled(rows: DataFrame, large: DataFrame) -> DataFrame:
    """``rows`` (band, key, node, ...) of buckets -> sorted rows of tiles; ``large`` (band, key, chunks)
    has the buckets of several chunks."""
    rest = [c for c in rows.columns if c not in ("band", "key", "node")]
    return (
        rows.join(large, ["band", "key"], "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("band", "key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", *rest)
    )


def _sorted_tiles(tiles: DataFrame) -> DataFrame:
    tile = ["band", "key", "i", "j"]
    return tiles.repartition(*tile).sortWithinPartitions(*tile, "chunk", "node")


def _tiles(reps: DataFrame, bands: list[list[tuple[int, int]]], work: Workspace) -> DataFrame:
    """Rows of tiles of ``reps`` (sig, node)."""
    rows = _bucketed(reps.where("node is not null"), bands)
    large = work.table(rows.groupBy("band", "key").count().where(F.col("count") > CHUNK).select("band", "key", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")), "large")
    return _tiled(rows, large)


def _of_one_id(sigs: DataFrame, reps: DataFrame, work: Workspace) -> DataFrame | None:
    """Links (a, b) between the signatures of documents that have several; None if there is no such one."""
    h = F.xxhash64("sig")
    several = work.table(sigs.where("doc_id is not null").groupBy("doc_id").agg(F.min(h).alias("x"), F.max(h).alias("y")).where("x <> y").select("doc_id"), "several")
    if not several.limit(1).count():
        return None
    own = sigs.join(several.hint("merge"), "doc_id").select("doc_id", "sig").distinct()
    return own.join(reps.hint("merge"), "sig").select(F.col("doc_id").cast("bigint").alias("a"), F.col("node").cast("bigint").alias("b"))


def groups(sigs: DataFrame, radius: int, bands: list[list[tuple[int, int]]], work: Workspace) -> DataFrame:
    """(sig, component): the smallest doc_id reachable over links of at most ``radius`` bits.

    ``sigs`` (doc_id, sig).  Rows without a doc_id link nothing; their signature's component is null
    unless a row with an id has the same signature.  Rows that repeat a doc_id are one document, which
    links its signatures.
    """
    reps = work.table(sigs.groupBy("sig").agg(F.min("doc_id").alias("node")), "reps")
    edges = _sorted_tiles(_tiles(reps, bands, work)).mapInArrow(_by_tile(_links(radius)), "a bigint, b bigint")
    same = _of_one_id(sigs, reps, work)
    if same is not None:
        edges = edges.union(same)
    found = connected_components(edges, work)
    return reps.join(found, reps.node == found.node, "left").select(reps.sig, F.coalesce(found.component, reps.node).alias("component"))


def blocks_for(n: int, bits: int = 64, radius: int = 4) -> int:
    """The fewest blocks for which a bucket of uniform signatures stays within CHUNK; any number
    gives the same links, more blocks give more and smaller buckets."""
    for blocks in range(radius + 1, radius + 5):
        if n / 2 ** (bits * (blocks - radius) // blocks) <= CHUNK:
            break
    return blocks


def simhash_components(docs: DataFrame, n_words: int = 4, radius: int = 4, words: int = 1) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, fingerprint, component_id), a row per row.

    Exact: all fingerprints within ``radius`` bits are linked, whatever their number.  A null, empty
    or blank text has fingerprint zero and is linked like any other; ties and repeated rows share a
    fingerprint; rows of one id are one document, whatever their texts, and so share its component;
    further columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "simhash")
    sigs = work.table(signatures(docs, n_words, words), "sigs")
    n = sigs.agg(F.approx_count_distinct("sig")).first()[0]
    found = work.table(groups(sigs, radius, exact_bands(64 * words, radius, blocks_for(n, 64 * words, radius)), work), "found")
    work.drop("reps", "large", "several")
    return sigs.join(found, "sig").select("doc_id", F.lower(F.hex("sig")).alias("fingerprint"), F.col("component").alias("component_id"))


def expected_distance(similarity: float, bits: int) -> float:
    """Differing bits between documents of a Jaccard similarity over shingle sets."""
    return bits * math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius_for(similarity: float, bits: int) -> int:
    """Three standard errors above the expected distance."""
    d = expected_distance(similarity, bits)
    return math.ceil(d + 3 * math.sqrt(d * (1 - d / bits)))


def _sets(docs: DataFrame, ids: DataFrame, n_words: int) -> DataFrame:
    """(doc_id, s): the distinct shingles of the documents of ``ids`` (doc_id)."""
    # The ids grow with the corpus, so they are merged with the texts, not broadcast.
    texts = docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left_semi")
    return texts.select("doc_id", let(words_of(F.lower("text")), lambda w: F.array_distinct(word_hashes(w, n_words))).alias("s"))


def _similar(docs: DataFrame, pairs: DataFrame, n_words: int, similarity: float, work: Workspace) -> DataFrame:
    """The pairs (a, b) of doc_ids whose shingle sets are at least so similar."""
    pairs = work.table(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = work.table(_sets(docs, ids, n_words), "sets")
    left = pairs.join(sets.hint("merge").withColumnRenamed("doc_id", "a").withColumnRenamed("s", "x"), "a")
    both = left.join(sets.hint("merge").withColumnRenamed("doc_id", "b").withColumnRenamed("s", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b")


def _rest(docs: DataFrame, tiles: DataFrame, more: DataFrame, joined: DataFrame, n_words: int, similarity: float, radius: int, bands: list[list[tuple[int, int]]], work: Workspace) -> DataFrame:
    """The links (a, b) at the similarity that the tiles ``more`` hold between components of ``joined``.

    Rows within the radius of another component's come with their sets to tiles of few bytes, where all
    pairs not yet joined are compared: no pair becomes a row of a table unless it is a link."""
    again = tiles.join(more, ["band", "key", "i", "j"], "left_semi")
    parts = joined.hint("merge").withColumnRenamed("node", "_node")
    again = again.join(parts, again.node == parts._node, "left").withColumn("component", F.coalesce("component", "node")).drop("_node")
    kind = "band int, key bigint, node bigint, sig binary, component bigint"
    names = ["band", "key", "i", "j", "chunk", "node", "sig", "component"]
    rows = work.table(_sorted_tiles(again.select(*names)).mapInArrow(_by_tile(_unjoined(radius, bands)), kind).distinct(), "unjoined")
    sets = work.table(_sets(docs, rows.select(F.col("node").alias("doc_id")).distinct(), n_words), "unjoined-sets")
    chunks = lambda n: F.greatest(F.ceil(F.sum(8 * n) / SET_BYTES), F.ceil(F.count("*") / CHUNK)).cast("int")
    sizes = sets.select(F.col("doc_id").alias("node"), F.size("s").cast("long").alias("n"))
    large = work.table(rows.join(sizes.hint("merge"), "node").groupBy("band", "key").agg(chunks(F.col("n")).alias("chunks")).where("chunks > 1"), "unjoined-large")
    # The rows are cut into tiles before the sets are added, so that a bucket never gathers them.
    held = _tiled(rows, large)
    full = held.join(sets.hint("merge").withColumnRenamed("doc_id", "node"), "node")
    return work.table(_sorted_tiles(full).mapInArrow(_by_tile(_verified(radius, similarity), 1), "a bigint, b bigint"), "rest")


def near_duplicates(docs: DataFrame, n_words: int = 5, similarity: float = 0.8, words: int = 8, band_bits: int = 14) -> DataFrame:
    """(doc_id, component_id) of near-duplicate groups at a shingle similarity, by wide SimHash.

    72 bands of 14 of the 512 bits, half of them over shuffled bits, find a pair at 0.8 with probability
    0.999, at 0.85 with 0.9999.
    The signature is that of the shingle set.  Equal sets are one row; every other link, also one of
    equal signatures, is compared by the shingles: first with ``LINKS`` rows for each document and
    tile, then, in tiles that hold more, with all rows of other components.

    ``docs`` (doc_id, text, ...): ids do not repeat (the pipeline keys rows that do); a null id links
    nothing.  Null, empty and blank texts form one group.  Further columns are ignored; an empty table
    gives an empty result.
    """
    work = Workspace(docs.sparkSession, "nearcopies")
    sigs = work.table(set_signatures(docs, n_words, words), "sigs")
    bands = sliced_bands(64 * words, band_bits)
    radius = radius_for(similarity, 64 * words)
    reps = work.table(sigs.groupBy("sig", "digest").agg(F.min("doc_id").alias("node")), "reps")
    tiles = _tiles(reps, bands, work)
    links = work.table(_sorted_tiles(tiles).mapInArrow(_by_tile(_candidates(radius, bands)), "a bigint, b bigint, band int, key bigint, i int, j int"), "links")
    edges = work.table(_similar(docs, links.where("a <> b").select("a", "b").distinct(), n_words, similarity, work), "similar")
    joined = work.table(connected_components(edges, work), "joined")
    more = work.table(links.where("a is null").select("band", "key", "i", "j").distinct(), "more")
    if more.limit(1).count():
        rest = _rest(docs, tiles, more, joined, n_words, similarity, radius, bands, work)
        joined = connected_components(edges.union(rest), work)
    found = work.table(reps.join(joined, reps.node == joined.node, "left").select("sig", "digest", F.coalesce(joined.component, reps.node).alias("component")), "found")
    work.drop("reps", "large", "links", "pairs", "sets", "similar", "joined", "more", "unjoined", "unjoined-sets", "unjoined-large", "rest")
    return sigs.join(found, ["sig", "digest"]).select("doc_id", F.col("component").alias("component_id"))
