"""Token counts: greedy longest-match word-piece lengths by a linear automaton.

A trie of the vocabulary gets failure links: where a node has no edge for the next byte, the pieces that
the longest match would pop are already known as a count, and the scan goes on at the link. Counting a
word so reads each byte once and never builds a piece. All different words of a block advance together,
one byte column per step; very long words, few if any, are read one after the other instead.

The vocabulary is a byte-level one: a piece that begins with a blank starts a word, others continue it.
Words are runs without ASCII white space; each is scanned with a blank before it. Every single byte is a
piece, so every word has a tokenisation. Null and empty texts have no words and no tokens. Every row is
counted by itself, repeated ones alike; an empty table gives an empty one. Only doc_id and text are read.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .flat import NOT_SPACE, counts_of, flat_blocks, hash_spans, words
from .frames import documents, map_arrow, read, tokenizer_file

VOCABULARY = "byte_bpe_50k.json"
#: Equal words are scanned once per block.
_BLOCK = 2_000_000
#: Words of more bytes than this are scanned alone: a column step for one word costs more than its byte.
LONG_WORD = 256


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def pieces_of(path: str) -> list[bytes]:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    chars = _byte_of_char()
    special = {t["content"] for t in model.get("added_tokens", [])}
    return [bytes(chars[c] for c in p) for p in model["model"]["vocab"] if p not in special]


class Automaton:
    def __init__(self, pieces: list[bytes]):
        edges: dict[int, int] = {}
        final = [False]
        for piece in pieces:
            node = 0
            for b in piece:
                key = node << 8 | b
                node = edges.get(key) or edges.setdefault(key, len(final))
                if node == len(final):
                    final.append(False)
            final[node] = bool(piece)
        missing = [b for b in range(256) if b not in edges or not final[edges[b]]]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        children: list[list[tuple[int, int]]] = [[] for _ in final]
        for key, child in edges.items():
            children[key >> 8].append((key & 255, child))
        link, popped = [0] * len(final), [0] * len(final)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for b, v in children[u]:
                queue.append(v)
                if final[v]:
                    link[v], popped[v] = 0, 1
                    continue
                z, count = link[u], popped[u]
                while (z << 8 | b) not in edges:
                    z, count = link[z], count + popped[z]
                link[v], popped[v] = edges[z << 8 | b], count
        order = sorted(edges)
        self.edges = edges
        self.keys = np.array(order, np.int64)
        self.targets = np.array([edges[k] for k in order], np.int64)
        self.link, self.popped = np.array(link), np.array(popped)

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each span of bytes, a blank taken before it."""
        out = np.empty(len(starts), np.int64)
        long = np.flatnonzero(ends - starts > LONG_WORD)
        for k in long.tolist():
            out[k] = self._count(data[starts[k] : ends[k]].tobytes())
        short = np.flatnonzero(ends - starts <= LONG_WORD)
        out[short] = self._columns(data, starts[short], ends[short])
        return out

    def _count(self, word: bytes) -> int:
        """Pieces of one word, a blank taken before it."""
        edges, link, popped = self.edges, self.link.tolist(), self.popped.tolist()
        state, count = edges[0x20], 0
        for b in word:
            while (step := edges.get(state << 8 | b)) is None:
                count += popped[state]
                state = link[state]
            state = step
        while state:
            count += popped[state]
            state = link[state]
        return count

    def _columns(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        lengths = ends - starts
        order = np.argsort(-lengths, kind="stable")
        at, left = starts[order], lengths[order]
        state = np.full(len(at), self.targets[np.searchsorted(self.keys, 0x20)])
        count = np.zeros(len(at), np.int64)
        falling = -left
        for column in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(falling, -column, "left"))  # words longer than this column
            self._step(state, count, np.arange(n), data[at[:n] + column].astype(np.int64))
        open_ = np.flatnonzero(state)
        while len(open_):  # at the end whatever is still unmatched is popped
            count[open_] += self.popped[state[open_]]
            state[open_] = self.link[state[open_]]
            open_ = open_[state[open_] != 0]
        out = np.empty_like(count)
        out[order] = count
        return out

    def _step(self, state, count, who, byte) -> None:
        while len(who):
            key = state[who] << 8 | byte
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[found] == key
            state[who[hit]] = self.targets[found[hit]]
            who, byte = who[~hit], byte[~hit]
            count[who] += self.popped[state[who]]
            state[who] = self.link[state[who]]


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(pieces_of(path))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens, longest_word_tokens) of every text."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scan = automaton(tokenizer_file(vocabulary))
        for i, j, data, offsets in flat_blocks(batch.column("text"), _BLOCK):
            starts, ends, rows = words(data, offsets, NOT_SPACE)
            _, first, inverse = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
            per_word = scan.counts(data, starts[first], ends[first])[inverse] if len(starts) else np.zeros(0, np.int64)
            longest = np.zeros(j - i, np.int64)
            np.maximum.at(longest, rows, per_word)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(i, j - i),
                    pa.array(counts_of(rows, j - i)),
                    pa.array(np.bincount(rows, weights=per_word, minlength=j - i).astype(np.int64)),
                    pa.array(longest),
                ],
                ["doc_id", "n_words", "n_tokens", "longest_word_tokens"],
            )

    return map_arrow(documents(docs), one, "doc_id long, n_words long, n_tokens long, longest_word_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))


QUERIES = {"op10_token_counts": op10_token_counts}
