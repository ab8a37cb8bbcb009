"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: case, compatibility forms, homoglyphs, and digits or signs that stand for
letters.  The lexicon is learned from labelled rows: word beginnings that toxic documents have and
others lack, weighted by their log odds.  Exception phrases (a lexicon word with its neighbour, as
clean documents use it) are in the same automaton and cancel the matches they cover.  The weighted
sum is normalised by the document's length and mapped to a probability.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, training_rows

#: Labelled rows that the lexicon is learned from, at most.
TRAIN_ROWS = 6000

# Cyrillic and Greek letters that look like Latin ones, and digits written for letters.
HOMOGLYPHS = dict(zip("авекмнорстухіјѕԁһӏαβεικνορτυχ", "abekmhopctyxijsdhlaeeiknoptux"))
DIGITS = dict(zip("0134578", "oieastb"))
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}

_SIGN = re.compile(r"(?:(?<=[^\W\d_])|(?<!\S))[@$!|](?=[^\W\d_])")


class _Fold(dict):
    """Character -> folded text; anything that is no letter becomes a space."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in HOMOGLYPHS:
            out = HOMOGLYPHS[c]
        elif c in DIGITS:
            out = DIGITS[c]
        else:
            wide = unicodedata.normalize("NFKC", c).lower()
            out = wide if wide.isalpha() else "" if unicodedata.category(c) in ("Mn", "Cf") else " "
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """Folded words, each between single spaces or more."""
    text = text.lower()
    if not _SIGN.search(text):
        return f" {text.translate(_FOLD)} "
    return f" {_SIGN.sub(lambda m: SIGNS[m[0]], text).translate(_FOLD)} "


@dataclass
class Model:
    """``weights``: pattern (" stem") -> weight; ``exceptions``: folded phrases between spaces."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    intercept: float = -4.0
    slope: float = 1.0

    def automaton(self):
        if not self.weights:
            return None
        found = ahocorasick.Automaton()
        for p, w in self.weights.items():
            found.add_word(p, (len(p), w))
        for p in self.exceptions:
            found.add_word(p, (len(p), found.get(p)[1] if p in self.weights else 0.0, True))
        found.make_automaton()
        return found


def matched(folded: str, automaton) -> tuple[float, int]:
    """Summed weights of the matches outside exception phrases, and their number."""
    if automaton is None:
        return 0.0, 0
    hits, exempt = [], []
    for end, value in automaton.iter(folded):
        (exempt if len(value) > 2 else hits).append((end - value[0] + 1, end, value[1]))
    if exempt:
        # One sweep by first character: of the phrases that begin no later, the farthest end decides.
        hits.sort()
        exempt.sort()
        kept, at, reach = [], 0, -1
        for hit in hits:
            while at < len(exempt) and exempt[at][0] <= hit[0]:
                reach = max(reach, exempt[at][1])
                at += 1
            if hit[1] > reach:
                kept.append(hit)
        hits = kept
    return math.fsum(h[2] for h in hits), len(hits)


def normalised(raw: float, folded: str) -> float:
    """The sum by the number of folded words, the same in fitting and scoring."""
    return raw / (1.0 + math.log1p(len(folded.split()) / 500.0))


def _candidates(folded: str) -> set[str]:
    """Word beginnings of three to eight letters, and whole words."""
    found = set()
    for w in set(folded.split()):
        found.update(" " + w[:k] for k in range(3, min(8, len(w)) + 1))
        if 8 < len(w) <= 24:
            found.add(" " + w)
    return found


def _distinct(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Rows without copies and near copies: those that share one of the four least hashes of their
    four-word runs with an earlier row go, since copies would make any word of theirs look telling."""
    seen: set[int] = set()
    kept = []
    for text, y in rows:
        w = text.split()
        least = sorted({xxhash.xxh64_intdigest(" ".join(w[i : i + 4])) for i in range(max(1, len(w) - 3))})[:4]
        if not seen.intersection(least):
            kept.append((text, y))
        seen.update(least)
    return kept


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method, lightly regularised."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w, r = p * (1 - p) + 1e-9, y - p
        g = np.array([r.sum() - 1e-3 * a, (r * x).sum() - 1e-3 * b])
        h = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        da, db = np.linalg.solve(h, g)
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[tuple[bytes, int]], exceptions: tuple[str, ...] = (), evidence: float = 20.0) -> Model:
    """A pattern enters the lexicon if toxic rows have it with a log-likelihood ratio of at least
    ``evidence`` over chance and four fifths of its rows are toxic.  A beginning enters in its longest
    form that is not rarer.  Without rows of both kinds the lexicon is empty."""
    texts = _distinct([(fold(t.decode("utf-8", "replace")), y) for t, y in rows])
    toxic, clean = Counter(), Counter()
    for t, y in texts:
        (toxic if y else clean).update(_candidates(t))
    n1 = sum(y for _, y in texts)
    n0 = len(texts) - n1
    if not n1 or not n0:
        return Model(exceptions=exceptions)
    base = n1 / (n1 + n0)

    def ratio(p: str) -> float:
        k, m = toxic[p], toxic[p] + clean[p]
        return 2 * (k * math.log(k / m / base) + ((m - k) * math.log((m - k) / m / (1 - base)) if m > k else 0.0))

    able = [p for p, k in toxic.items() if k >= 3 and k >= 0.8 * (k + clean[p])]
    ranked = sorted(((ratio(p), len(p), p) for p in able), key=lambda v: (-round(v[0], 6), -v[1], v[2]))
    weights: dict[str, float] = {}
    for score, _, p in ranked:
        if score < evidence:
            break
        if not any(p.startswith(q) or q.startswith(p) for q in weights):
            weights[p] = math.log(((toxic[p] + 0.5) / (n1 + 1)) / ((clean[p] + 0.5) / (n0 + 1)))
    model = Model(weights, exceptions)
    model.exceptions = tuple(sorted({*exceptions, *_learned_exceptions(texts, model)}))
    auto = model.automaton()
    x = np.array([normalised(matched(t, auto)[0], t) for t, _ in texts])
    model.intercept, model.slope = _logistic(x, np.array([float(y) for _, y in texts]))
    return model


def _learned_exceptions(texts: list[tuple[str, int]], model: Model) -> set[str]:
    """Pairs of neighbouring words around a match that at least three clean rows have and no toxic one."""
    seen = {0: Counter(), 1: Counter()}
    stems = tuple(p[1:] for p in model.weights)
    for t, y in texts:
        w = t.split()
        seen[y].update({f" {a} {b} " for a, b in zip(w, w[1:]) if stems and (a.startswith(stems) or b.startswith(stems))})
    return {p for p, n in seen[0].items() if n >= 3 and not seen[1][p]}


def score(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` -> (id, score, predicted, n_matches), a row per row; whole texts are scored.

    Null and empty texts score as a text without matches.  Further columns are ignored.
    """

    def run(batches):
        auto = model.automaton()
        for batch in batches:
            scores, counts = [], []
            for text in batch.column(1):
                folded = fold(text.as_py() or "")
                raw, n = matched(folded, auto)
                x = model.intercept + model.slope * normalised(raw, folded) if n else model.intercept
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, x)))))
                counts.append(n)
            s = pa.array(scores, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), s, pa.array([int(v >= threshold) for v in scores], pa.int32()), pa.array(counts, pa.int64())], [id_col, "score", "predicted", "n_matches"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(docs[id_col].alias(id_col), docs[text_col].alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, n_matches bigint")


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_matches), a row per row of ``docs``; ``labels`` (doc_id, toxic).

    Null, empty and blank texts score as texts without matches, repeated rows alike.  Null ids are held
    out.  Without labels of both kinds the lexicon is empty and every score the same.  Further columns
    are ignored; an empty table gives an empty result.
    """
    model = fit(training_rows(docs, labels, "toxic", train_rows))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_matches")
