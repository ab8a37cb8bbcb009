"""Quality by a byte-level convolutional network in numpy.

Learned filters of ``WIDTH`` bytes slide over the whole document.  Their responses are max-pooled in
chunks of ``CHUNK`` positions; a filter at a chunk's end reads on into the next, so the chunks
overlap.  The pooled responses of all chunks are combined by their mean and their maximum, and a
logistic unit makes one probability of both.  The network is trained end to end by back-propagation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, training_rows

#: Labelled rows that the network is fitted on, at most.
TRAIN_ROWS = 2400
WIDTH, FILTERS, CHUNK = 6, 16, 64
#: Chunks whose responses are held at a time, and bytes of text that are laid out at a time.
BLOCK, LAYOUT = 2048, 8 << 20
_LOW = np.float32(-1e9)


@dataclass
class Network:
    taps: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (2 * FILTERS,)
    base: np.ndarray  # (1,)

    def pairs(self) -> list[np.ndarray]:
        """Tables of two adjacent taps over byte pairs: half the look-ups."""
        return [(self.taps[k][:, None, :] + self.taps[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, WIDTH, 2)]


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes padded with zeros to whole chunks, the positions that hold text, and each text's first chunk."""
    n = np.array([len(t) for t in texts], np.int64)
    chunks = -(-(n + WIDTH - 1) // CHUNK)
    first = np.concatenate(([0], np.cumsum(chunks)))
    data = np.zeros(first[-1] * CHUNK + WIDTH, np.uint8)
    real = np.zeros(first[-1] * CHUNK, bool)
    for t, a in zip(texts, first[:-1] * CHUNK):
        data[a : a + len(t)] = np.frombuffer(t, np.uint8)
        real[a : a + len(t)] = True
    return data, real, first


def responses(data: np.ndarray, real: np.ndarray, pairs: list[np.ndarray], a: int, b: int) -> np.ndarray:
    """(chunks a..b, CHUNK, FILTERS); positions outside a text respond very low."""
    lo, hi = a * CHUNK, b * CHUNK
    code = data[lo : hi + WIDTH - 1].astype(np.int32)
    code = (code[:-1] << 8) | code[1:]
    total = pairs[0].take(code[: hi - lo], axis=0)
    for k in range(1, len(pairs)):
        total += pairs[k].take(code[2 * k : 2 * k + hi - lo], axis=0)
    total[~real[lo:hi]] = _LOW
    return total.reshape(b - a, CHUNK, -1)


def _pool(net: Network, pairs: list[np.ndarray], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pooled chunk activations and the first chunk of each text."""
    data, real, first = layout(texts)
    parts = [responses(data, real, pairs, a, min(a + BLOCK, first[-1])).max(1) for a in range(0, first[-1], BLOCK)]
    return np.maximum(np.concatenate(parts) + net.bias, 0), first


def _vectors(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    mean = np.add.reduceat(h, first[:-1], 0) / np.diff(first)[:, None]
    return np.concatenate((mean, np.maximum.reduceat(h, first[:-1], 0)), 1)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def probabilities(net: Network, pairs: list[np.ndarray], texts: list[bytes]) -> np.ndarray:
    """Texts of any length: a text above LAYOUT bytes is pooled in parts that end on chunks."""
    out = np.zeros(len(texts))
    at = 0
    while at < len(texts):
        stop, size = at + 1, len(texts[at])
        while stop < len(texts) and size + len(texts[stop]) <= LAYOUT:
            size += len(texts[stop])
            stop += 1
        if size <= LAYOUT:
            v = _vectors(*_pool(net, pairs, texts[at:stop]))
        else:
            total, most, n, t = 0.0, None, 0, texts[at]
            for a in range(0, len(t), LAYOUT):
                part = t[a : a + LAYOUT + WIDTH - 1]
                h, first = _pool(net, pairs, [part])
                h = h[: LAYOUT // CHUNK] if a + LAYOUT < len(t) else h
                total, n = total + h.sum(0, dtype=np.float64), n + len(h)
                most = h.max(0) if most is None else np.maximum(most, h.max(0))
            v = np.concatenate((total / n, most))[None, :]
        out[at:stop] = _sigmoid(v @ net.out + net.base[0])
        at = stop
    return out


def gradients(net: Network, texts: list[bytes], y: np.ndarray, decay: float = 0.0) -> list[np.ndarray]:
    """Of the mean cross-entropy and half of ``decay`` times the squares of taps and output weights, by
    taps, bias, out and base.  A maximum passes its gradient to the position, or chunk, that has it."""
    pairs = net.pairs()
    data, real, first = layout(texts)
    best, where = [], []
    for a in range(0, first[-1], BLOCK):
        r = responses(data, real, pairs, a, min(a + BLOCK, first[-1]))
        w = r.argmax(1)
        best.append(np.take_along_axis(r, w[:, None, :], 1)[:, 0])
        where.append(w + (np.arange(a, a + len(r)) * CHUNK)[:, None])
    h, pos = np.maximum(np.concatenate(best) + net.bias, 0), np.concatenate(where)
    v = _vectors(h, first)
    err = (_sigmoid(v @ net.out + net.base[0]) - y).astype(net.out.dtype) / len(texts)
    dv = err[:, None] * net.out[None, :]
    of = np.repeat(np.arange(len(texts)), np.diff(first))
    dh = dv[of, :FILTERS] / np.diff(first)[of][:, None]
    dh += np.where(h == v[of, FILTERS:], dv[of, FILTERS:], 0)
    dh[h <= 0] = 0
    chunk, filt = np.nonzero(dh)
    g = dh[chunk, filt]
    taps = np.zeros_like(net.taps)
    for k in range(WIDTH):
        np.add.at(taps[k], (data[pos[chunk, filt] + k], filt), g)
    return [taps + decay * net.taps, dh.sum(0), v.T @ err + decay * net.out, np.array([err.sum()])]


def train(rows: list[tuple[bytes, int]], epochs: int = 8, batch: int = 32, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Network:
    """Adam on the cross-entropy.  Without rows of both labels, a constant network that gives their share."""
    rng = np.random.default_rng(seed)
    f4 = np.float32
    net = Network(rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(f4), np.full(FILTERS, 0.1, f4), rng.normal(0, 0.2, 2 * FILTERS).astype(f4), np.zeros(1, f4))
    y_all = np.array([y for _, y in rows], f4)
    share = float(y_all.mean()) if len(rows) else 0.5
    net.base[0] = np.log((share + 1e-3) / (1 - share + 1e-3))
    if share in (0.0, 1.0) or not rows:
        net.out[:] = 0
        return net
    params = [net.taps, net.bias, net.out, net.base]
    m, s, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            grads = gradients(net, [rows[i][0] for i in pick], y_all[pick], decay)
            step += 1
            lr = rate * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
            for p, d, mi, si in zip(params, grads, m, s):
                mi += 0.1 * (d - mi)
                si += 0.001 * (d * d - si)
                p -= (lr * (mi / (1 - 0.9**step)) / (np.sqrt(si / (1 - 0.999**step)) + 1e-8)).astype(f4)
    return net


def score(docs: DataFrame, net: Network, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` -> (id, score, predicted), a row per row; null texts score like empty ones, for which
    no filter responds.  Further columns are ignored.  The network (under 1 MB) goes with the task."""

    def run(batches):
        pairs = net.pairs()
        for batch in batches:
            p = probabilities(net, pairs, [t.as_py() or b"" for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(docs[id_col].alias(id_col), docs[text_col].cast("binary").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per row of ``docs``; ``labels`` (doc_id, quality).

    Null texts score like empty ones, repeated rows alike.  Null ids are held out.  Without labels of both
    kinds the score is their share (0.5 without any).  Further columns are ignored; an empty table gives
    an empty result.
    """
    net = train(training_rows(docs, labels, "quality", train_rows))
    return score(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
