"""Greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie with failure links.  Where the next byte has no edge, a node's failure link
leads to the node of what is left after its longest pieces are popped, and the number of those pieces
is stored with the link; so a word's length is a sum of stored counts, each byte is read once, and no
piece is ever built.

A word is a run without ASCII white space; it is matched with the vocabulary's word mark (a space)
before it, and pieces that begin a word are those that carry the mark.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bytestext import word_lists

DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Vocabularies are broadcast; a larger file is refused.
MAX_VOCAB_BYTES = 64 << 20
#: Distinct words whose lengths a task keeps.
CACHE = 1 << 17


def read_vocab(spark: SparkSession, path: str) -> list[bytes]:
    """Pieces of a rank file (base64 piece, rank per line), read on the driver."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCAB_BYTES + 1)
    if len(data) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path} has over {MAX_VOCAB_BYTES} bytes")
    return [base64.b64decode(line.split()[0]) for line in data.splitlines() if line.strip()]


class Automaton:
    """``edges[node * 256 + byte]`` -> node; ``link[node]`` and ``pops[node]`` as above, -1 without a link."""

    def __init__(self, pieces: list[bytes]):
        edges: dict[int, int] = {}
        final, parent, letter = [False], [0], [0]
        for piece in pieces:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                following = edges.get(key)
                if following is None:
                    following = edges[key] = len(final)
                    final.append(False)
                    parent.append(node)
                    letter.append(byte)
                node = following
            final[node] = node != 0
        depth = [0] * len(final)
        for v in range(1, len(final)):
            depth[v] = depth[parent[v]] + 1
        link, pops = [-1] * len(final), [0] * len(final)
        for v in sorted(range(1, len(final)), key=depth.__getitem__):
            if final[v]:
                link[v], pops[v] = 0, 1
                continue
            z, n = link[parent[v]], pops[parent[v]]
            while z >= 0 and (z << 8 | letter[v]) not in edges:
                n += pops[z]
                z = link[z]
            if z >= 0:
                link[v], pops[v] = edges[z << 8 | letter[v]], n
        self.edges, self.link, self.pops = edges, link, pops

    def length(self, word: bytes) -> int:
        """Pieces of the word's greedy longest-match split; -1 if some part is in no piece."""
        edges, link, pops = self.edges, self.link, self.pops
        node = n = 0
        for byte in word:
            following = edges.get(node << 8 | byte)
            while following is None:
                if node == 0 or link[node] < 0:
                    return -1
                n += pops[node]
                node = link[node]
                following = edges.get(node << 8 | byte)
            node = following
        while node:
            if link[node] < 0:
                return -1
            n += pops[node]
            node = link[node]
        return n


class _Lengths(dict):
    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.length(b" " + word)
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = n
        return n


def token_counts(docs: DataFrame, vocab: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` -> (id, n_words, n_tokens, n_unknown), all long, a row per row.

    A word with a part that no piece covers counts as one unknown token.  Null, empty and blank texts
    count zero.  Further columns are ignored; ids may be null or repeat; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        lengths = None
        for batch in batches:
            if lengths is None:
                lengths = _Lengths(Automaton(shared.value))
            out: tuple[list[int], list[int], list[int]] = ([], [], [])
            for text in batch.column(1):
                words = tokens = unknown = 0
                for part in word_lists(text.as_py()):
                    found = [lengths[w] for w in part]
                    bad = found.count(-1)
                    words += len(part)
                    tokens += sum(found) + 2 * bad
                    unknown += bad
                for column, n in zip(out, (words, tokens, unknown)):
                    column.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out)], [id_col, "n_words", "n_tokens", "n_unknown"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(docs[id_col].alias(id_col), docs[text_col].cast("binary").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_tokens bigint, n_unknown bigint")
