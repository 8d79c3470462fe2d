"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a byte trie. Every node has a failure link and the number of tokens popped on taking
it, so one pass over a word gives the number of longest-match pieces; no piece is ever built. Links are
folded into a dense transition table (next state and popped tokens), which all words of a batch walk
together.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import automaton
from .common import joined, prepare, slices, utf8, word_bounds

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NONE = -1


def read_vocabulary(path: str) -> list[bytes]:
    """Tokens of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class LongestMatch:
    """The automaton. ``pieces`` of a word are the greedy longest matches of ``prefix + word``."""

    def __init__(self, vocabulary: Iterable[bytes], prefix: bytes = b" "):
        tokens = set(vocabulary) | {bytes([b]) for b in range(256)}  # every byte is a token, so no word is unknown
        child: list[dict[int, int]] = [{}]
        depth, parent, byte = [0], [NONE], [0]
        is_token = [False]
        for t in sorted(tokens):
            node = 0
            for b in t:
                nxt = child[node].get(b)
                if nxt is None:
                    nxt = child[node][b] = len(child)
                    child.append({})
                    depth.append(depth[node] + 1)
                    parent.append(node)
                    byte.append(b)
                    is_token.append(False)
                node = nxt
            is_token[node] = True
        n = len(child)
        fail, pops = np.zeros(n, np.int64), np.zeros(n, np.int64)
        #: state * 256 + byte: next state, and in the high 8 bits the tokens popped on the way
        table = np.zeros((n, 256), dtype=np.uint32)
        for b, v in child[0].items():
            table[0, b] = v
        final = np.zeros(n, np.int64)
        for v in sorted(range(1, n), key=depth.__getitem__):
            if is_token[v]:
                fail[v], pops[v] = 0, 1
            else:  # the parent's way on by this byte, had the trie no such child
                u = parent[v]
                z, k = int(fail[u]), int(pops[u])
                got = int(table[z, byte[v]])
                fail[v], pops[v] = got & 0xFFFFFF, k + (got >> 24)
            row = table[fail[v]] + np.uint32(int(pops[v]) << 24)
            for b, w in child[v].items():
                row[b] = w
            table[v] = row
            final[v] = pops[v] + (final[fail[v]] if fail[v] else 0)
        if n >= 1 << 24:
            raise ValueError("the vocabulary is too large for 24-bit states")
        self.table, self.final, self.n_states = table.reshape(-1), final, n
        self.begin, self.begun = 0, 0
        for b in prefix:
            got = int(self.table[self.begin * 256 + b])
            self.begin, self.begun = got & 0xFFFFFF, self.begun + (got >> 24)

    def count(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        state, total = automaton.run(self.table, 256, buf, starts, ends, self.begin)
        return total + self.final[state] + self.begun


_built: dict[tuple, LongestMatch] = {}


def token_counts(df: DataFrame, vocabulary: list[bytes], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_words`` and ``n_tokens`` of every row, in one narrow pass.

    Words are the runs of bytes that are not ASCII white space; each is matched with one leading space.
    Null and empty texts have no words and no tokens; repeated rows and null ids are kept as they are;
    other columns are ignored. The vocabulary, bounded by its file, is broadcast; each worker compiles it once.
    """
    sc = prepare(df.sparkSession).sparkContext
    shared = sc.broadcast(vocabulary)
    key = (len(vocabulary), hash(tuple(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:
            _built.clear()
            _built[key] = LongestMatch(shared.value)
        auto = _built[key]
        for b in slices(batches, "text"):
            buf, at = joined(b.column("text").to_pylist())
            starts, ends = word_bounds(buf)
            doc = np.searchsorted(at, starts, side="right") - 1
            n = b.num_rows
            tokens = np.bincount(doc, weights=auto.count(buf, starts, ends), minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.bincount(doc, minlength=n).astype(np.int64)), pa.array(tokens)], ["id", "n_words", "n_tokens"])

    kind = dict(df.dtypes)[id_col]
    out = df.select(df[id_col].alias("id"), utf8(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_words bigint, n_tokens bigint")
    return out.withColumnRenamed("id", id_col)
