"""SentencePiece encoding and decoding: vectorised merge rounds over flat symbol arrays.

``Bpe`` reads a BPE model with byte fallback. The words of a block (spans no vocabulary piece can
cross) are encoded once per different word: all symbols of all words lie in one numpy array; a round
finds each word's lowest pair rank by a segmented minimum, merges its leftmost occurrences at once and
compacts the arrays, until no word has a pair left. Where merging all occurrences of a pair could let a
better pair appear in between, only the leftmost is merged in that round, as the library does.

Null texts are empty and give no ids. Ids equal the library's, without begin or end ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .flat import flat_blocks, ranges, uniques
from .frames import documents, map_arrow, read, tokenizer_file

MODEL = "piece_bpe_32k.model"
_SPACE = "▁"
_NONE = np.iinfo(np.int64).max
#: Equal words are encoded once per block.
_BLOCK = 2_000_000


class Bpe:
    """Vocabulary of a BPE model and its tables of mergeable pairs."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != 2 or not trainer.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and identity normalisation")
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        score = [p.score for p in model.pieces]
        size = len(model.pieces)
        self.byte_id = np.zeros(256, np.int64)
        text: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                b = int(p.piece[1:-1], 16)
                self.byte_id[b] = i
                text.append(bytes([b]))
            elif p.type == 1:
                text.append(p.piece.replace(_SPACE, " ").encode())
            elif p.type == 2:
                text.append(" ⁇ ".encode())
            else:
                text.append(b"")
        self.size = size
        # rank: position by falling score; equal scores share a rank and the leftmost pair goes first
        order = sorted({score[i] for i in normal.values()}, reverse=True)
        place = {s: k for k, s in enumerate(order)}
        pairs = []
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                a, b = normal.get(piece[:cut]), normal.get(piece[cut:])
                if a is not None and b is not None:
                    pairs.append((a * size + b, place[score[i]], i))
        pairs.sort()
        self.pair_key = np.array([p[0] for p in pairs], np.int64)
        self.pair_rank = np.array([p[1] for p in pairs], np.int64)
        self.pair_id = np.array([p[2] for p in pairs], np.int64)
        self.char_id = {ord(" " if p == _SPACE else p): i for p, i in normal.items() if len(p) == 1}
        # bytes that stand side by side in some piece: elsewhere no merge ever crosses
        self.joined = np.zeros((256, 256), bool)
        self.joined[:, 0x80:0xC0] = True
        for piece in normal:
            raw = np.frombuffer(piece.replace(_SPACE, " ").encode(), np.uint8)
            self.joined[raw[:-1], raw[1:]] = True
        # the escape sign itself written in a text is the same symbol as a blank
        sign = np.frombuffer(_SPACE.encode(), np.uint8)
        self.joined[:, sign[0]] = True
        self.joined[sign[2], :] = True
        lengths = np.array([len(t) for t in text], np.int64)
        self.piece_length = lengths
        self.piece_start = np.cumsum(lengths) - lengths
        self.piece_bytes = np.frombuffer(b"".join(text), np.uint8)
        self.decimal = [str(i) for i in range(size)]

    def _pairs(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each symbol with its right neighbour."""
        rank = np.full(len(symbols), _NONE, np.int64)
        merged = np.full(len(symbols), -1, np.int64)
        if len(symbols) > 1:
            a, b = symbols[:-1], symbols[1:]
            ok = np.flatnonzero((word[:-1] == word[1:]) & (a >= 0) & (b >= 0))
            found, r, m = self._lookup(a[ok], b[ok])
            rank[ok[found]], merged[ok[found]] = r, m
        return rank, merged

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_key, key), max(len(self.pair_key) - 1, 0))
        found = np.flatnonzero(self.pair_key[at] == key) if len(self.pair_key) else np.zeros(0, np.int64)
        return found, self.pair_rank[at[found]], self.pair_id[at[found]]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and their counts by word."""
        n_words = len(words)
        texts = [w.decode().replace(_SPACE, " ") for w in words]
        sizes = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        seen, inverse = np.unique(points, return_inverse=True)
        table = np.array([self.char_id.get(int(c), -1 - int(c)) for c in seen], np.int64)
        symbols = table[inverse] if len(points) else np.zeros(0, np.int64)
        word = np.repeat(np.arange(n_words), sizes)
        done_symbols, done_words = [], []
        rank, merged = self._pairs(symbols, word)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(symbols)])
            open_ = best < _NONE
            if not open_.all():  # finished words leave the arrays
                closed = np.repeat(~open_, lengths)
                done_symbols.append(symbols[closed])
                done_words.append(word[closed])
                keep = ~closed
                symbols, word, rank, merged = symbols[keep], word[keep], rank[keep], merged[keep]
                best, lengths = best[open_], lengths[open_]
                if not len(symbols):
                    break
            starts = np.cumsum(lengths) - lengths
            hit = np.flatnonzero(rank == np.repeat(best, lengths))
            owner = word[hit]
            # overlapping occurrences (aaa): every second one of a run of neighbours
            fresh = np.r_[True, (hit[1:] != hit[:-1] + 1) | (owner[1:] != owner[:-1])]
            run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            owner = word[hit]
            hit = hit[self._together(symbols, word, rank, merged, hit, owner)]
            symbols[hit] = merged[hit]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            now = np.cumsum(keep)[hit] - 1
            symbols, word, rank, merged = symbols[keep], word[keep], rank[keep], merged[keep]
            for at in (now, now[now > 0] - 1):  # only pairs beside a merge change
                right = np.minimum(at + 1, len(symbols) - 1)
                a, b = symbols[at], symbols[right]
                fit = (right == at + 1) & (word[at] == word[right]) & (a >= 0) & (b >= 0)
                rank[at], merged[at] = _NONE, -1
                at = at[fit]
                found, r, m = self._lookup(a[fit], b[fit])
                rank[at[found]], merged[at[found]] = r, m
        symbols = np.concatenate(done_symbols) if done_symbols else symbols
        word = np.concatenate(done_words) if done_words else word
        order = np.argsort(word, kind="stable")
        return self._bytes(symbols[order], word[order], n_words)

    def _together(self, symbols, word, rank, merged, hit, owner) -> np.ndarray:
        """Which of the occurrences may be merged in one round: all, or each word's leftmost."""
        first = np.r_[True, owner[1:] != owner[:-1]]
        many = np.flatnonzero(~first)
        if not len(many):
            return np.arange(len(hit))
        new, limit = merged[hit], rank[hit]
        n = len(symbols)
        risky = np.zeros(len(hit), bool)
        for a_at, b_at in ((hit - 1, hit), (hit, hit + 2)):
            inside = (a_at >= 0) & (b_at < n)
            left, right = np.maximum(a_at, 0), np.minimum(b_at, n - 1)
            same = inside & (word[left] == word[right])
            a = np.where(left == hit, new, symbols[left])
            b = np.where(right == hit, new, symbols[right])
            ok = np.flatnonzero(same & (a >= 0) & (b >= 0))
            found, r, _ = self._lookup(a[ok], b[ok])
            risky[ok[found]] |= r <= limit[ok[found]]
        # neighbours that both merge: the pair of two new symbols
        found, r, _ = self._lookup(new, new)
        risky[found] |= r <= limit[found]
        bad = np.unique(owner[risky])
        return np.flatnonzero(first | ~np.isin(owner, bad))

    def _bytes(self, symbols, word, n_words) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the ids of their bytes."""
        unknown = np.flatnonzero(symbols < 0)
        counts = np.ones(len(symbols), np.int64)
        if len(unknown):
            raw = [chr(-1 - int(s)).encode() for s in symbols[unknown]]
            counts[unknown] = [len(r) for r in raw]
            out = np.repeat(symbols, counts)
            at = ranges((np.cumsum(counts) - counts)[unknown], counts[unknown])
            out[at] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        else:
            out = symbols
        return out, np.bincount(np.repeat(word, counts), minlength=n_words).astype(np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a block, and row offsets into them."""
        sizes = np.diff(offsets)
        full = np.flatnonzero(sizes)
        n = len(data) + len(full)
        spaced = np.full(n, 0x20, np.uint8)  # the dummy prefix of each text that is not empty
        heads = offsets[full] + np.arange(len(full))
        body = np.ones(n, bool)
        body[heads] = False
        spaced[body] = data
        cut = np.ones(n, bool)
        if n:
            cut[1:] = ~self.joined[spaced[:-1], spaced[1:]]
            cut[heads] = True
        starts = np.flatnonzero(cut)
        ends = np.r_[starts[1:], n].astype(np.int64) if n else starts
        different, inverse = uniques(spaced, starts, ends)
        ids, counts = self.encode_words(different)
        firsts = np.cumsum(counts) - counts
        lengths = counts[inverse]
        out = ids[ranges(firsts[inverse], lengths)]
        row = full[np.searchsorted(heads, starts, "right") - 1] if n else starts
        per_row = np.bincount(row, weights=lengths, minlength=len(sizes)).astype(np.int64)
        return out, np.r_[0, np.cumsum(per_row)]

    def decode(self, ids: np.ndarray) -> str:
        """Text of one row's ids; the blank of the dummy prefix goes."""
        raw = self.piece_bytes[ranges(self.piece_start[ids], self.piece_length[ids])].tobytes()
        return raw[1 if raw[:1] == b" " else 0 :].decode()

    def decode_rows(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        lengths = self.piece_length[ids]
        raw = self.piece_bytes[ranges(self.piece_start[ids], lengths)].tobytes()
        ends = np.r_[0, np.cumsum(lengths)][offsets].tolist()
        return [raw[a + (raw[a : a + 1] == b" " and b > a) : b].decode() for a, b in zip(ends, ends[1:])]


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


COLUMNS = {"ids": "array<int>", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, columns: tuple[str, ...] = ("ids", "decoded"), model: str = MODEL) -> DataFrame:
    """doc_id and the asked ``columns`` of every text: ids, decoded text, count, digests of both.

    The digest of ids is taken over their decimal forms joined by commas.
    """
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tokens = bpe(tokenizer_file(model))
        for i, j, data, offsets in flat_blocks(batch.column("text"), _BLOCK):
            ids, rows = tokens.encode(data, offsets)
            texts = tokens.decode_rows(ids, rows) if {"decoded", "decoded_sha256"} & {*columns} else []
            # row by row: a block's ids as Python numbers would take far more room than its array
            cut = list(zip(rows.tolist(), rows[1:].tolist()))
            made = {
                "ids": lambda: pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(ids, pa.int32())),
                "decoded": lambda: pa.array(texts, pa.string()),
                "n_tokens": lambda: pa.array(np.diff(rows)),
                "ids_sha256": lambda: pa.array([sha(",".join(map(tokens.decimal.__getitem__, ids[a:b].tolist())).encode()) for a, b in cut]),
                "decoded_sha256": lambda: pa.array([sha(t.encode()) for t in texts]),
            }
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *(made[c]() for c in columns)], ["doc_id", *columns])

    return map_arrow(documents(docs), one, ", ".join(["doc_id long", *(f"{c} {COLUMNS[c]}" for c in columns)]))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), ("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES = {"op8_sentencepiece": op8_sentencepiece}
