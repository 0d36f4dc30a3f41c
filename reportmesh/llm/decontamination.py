"""Benchmark decontamination: documents are scanned for windows of benchmark words.

Words of both sides are lower-cased (A-Z) runs of ASCII letters and digits and of non-ASCII bytes. Every
ten consecutive words of an item are a window; an item of fewer words, but not none, is one window. The
windows' hashes form a set that is broadcast while their counted bytes are within ``MAX_BYTES``; each
hash hit is verified against the window's words. Beyond that the windows of the documents are joined with
those of the items by a shuffle instead; the results are the same.

Null texts have no words. Items with a null id count for nothing. Repeated items are one. Every row of
documents is judged by itself, repeated or not. An empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import lookup
from ..session import cut_lineage
from .flat import byte_class, counts_of, flat, flat_blocks, fold, hash_spans, lower_ascii, ranges, words
from .frames import documents, map_arrow, read

WINDOW = 10
#: Bound of the broadcast in bytes, as counted before anything is collected.
MAX_BYTES = 64_000_000

_WORD = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


class _Text:
    """Words of a block of texts and hashes of windows of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.lower = lower_ascii(data)
        self.starts, self.ends, self.rows = words(self.lower, offsets, _WORD)
        self.hashes = hash_spans(self.lower, self.starts, self.ends)
        self.raw = self.lower.tobytes()

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of all windows of a length that lie in one row."""
        n = len(self.starts) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.rows[:n] == self.rows[length - 1 :])
        return first, fold([self.hashes[first + k] for k in range(length)])

    def text(self, first: int, length: int) -> bytes:
        return b" ".join(self.raw[a:b] for a, b in zip(self.starts[first : first + length].tolist(), self.ends[first : first + length].tolist()))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(length, hash, item_id, window binary) of all items, each once. The id is compared as a string."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, _, data, offsets in flat_blocks(batch.column("text")):
            t = _Text(data, offsets)
            n_words = counts_of(t.rows, len(offsets) - 1)
            whole = np.cumsum(n_words) - n_words
            ids = batch.column("item_id").slice(i, len(n_words)).to_pylist()
            out = []
            first, h = t.windows(window)
            out += [(window, x, ids[t.rows[k]], t.text(k, window)) for k, x in zip(first.tolist(), h.view(np.int64).tolist())]
            for row in np.flatnonzero((n_words > 0) & (n_words < window)).tolist():
                m, k = int(n_words[row]), int(whole[row])
                x = fold([t.hashes[k + j : k + j + 1] for j in range(m)]).view(np.int64)[0]
                out.append((m, int(x), ids[row], t.text(k, m)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int32(), pa.int64(), pa.string(), pa.binary()))] if out
                else [pa.array([], kind) for kind in (pa.int32(), pa.int64(), pa.string(), pa.binary())],
                ["length", "hash", "item_id", "window"],
            )

    rows = items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).filter("item_id is not null")
    return map_arrow(rows, one, "length int, hash long, item_id string, window binary").distinct()


class WindowSet:
    """Windows of each length sorted by hash: hashes, places of their texts in one string, and items."""

    def __init__(self, table: pa.Table):
        order = np.lexsort((table["hash"].to_numpy().view(np.uint64), table["length"].to_numpy()))
        table = table.take(pa.array(order)).combine_chunks()
        length, names = table["length"].to_numpy(), table["item_id"].combine_chunks().dictionary_encode()
        hashes = table["hash"].to_numpy().view(np.uint64)
        self.raw, self.places = (a.copy() for a in flat(table["window"].combine_chunks()))
        self.names = names.dictionary.to_pylist()
        self.item = names.indices.to_numpy()
        self.lengths = np.unique(length).tolist()
        at = np.searchsorted(length, [*self.lengths, 1 << 30])
        self.hashes = {m: (int(low), hashes[low:high]) for m, low, high in zip(self.lengths, at, at[1:])}

    def hits(self, t: _Text) -> list[tuple[int, int, set[str]]]:
        """(first word, length, items) of all verified occurrences."""
        found = []
        for m in self.lengths:
            offset, known = self.hashes[m]
            first, h = t.windows(m)
            low = np.searchsorted(known, h, "left")
            for k in np.flatnonzero(known[np.minimum(low, len(known) - 1)] == h).tolist():
                text, items, at = t.text(int(first[k]), m), set(), int(low[k])
                while at < len(known) and known[at] == h[k]:  # one window of several items, or equal hashes
                    a, b = self.places[offset + at : offset + at + 2]
                    if self.raw[a:b].tobytes() == text:
                        items.add(self.names[self.item[offset + at]])
                    at += 1
                if items:
                    found.append((int(first[k]), m, items))
        return found


def _covered(n: int, firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n words lie in some span."""
    hit = np.zeros(n, bool)
    hit[ranges(firsts, lengths)] = True
    return hit


def _marked(data, offsets, t: _Text, hit: np.ndarray, items: dict[int, set[str]]) -> list[list]:
    """Result columns of a block from its hit words: counts, items and the text without hit spans.

    A removed span runs from the first to the last byte of neighbouring hit words of a row.
    """
    n = len(offsets) - 1
    where = np.flatnonzero(hit)
    opens = np.r_[True, (np.diff(where) > 1) | (np.diff(t.rows[where]) > 0)] if len(where) else np.zeros(0, bool)
    a = t.starts[where[opens]] if len(where) else where
    b = t.ends[where[np.r_[opens[1:], True]]] if len(where) else where
    raw = data.tobytes()
    cleaned = []
    span_row = np.searchsorted(offsets, a, "right") - 1
    bounds = np.searchsorted(span_row, np.arange(n + 1))
    for r in range(n):
        lo, hi, parts = int(offsets[r]), int(offsets[r + 1]), []
        for k in range(bounds[r], bounds[r + 1]):
            parts.append(raw[lo : a[k]])
            lo = int(b[k])
        cleaned.append((b"".join(parts) + raw[lo:hi]).decode())
    return [
        counts_of(t.rows, n).tolist(),
        counts_of(t.rows[where], n).tolist(),
        [sorted(items.get(r, ())) for r in range(n)],
        cleaned,
    ]


_SCHEMA = "n_words long, n_hit long, item_ids array<string>, cleaned string"


def decontaminate(docs: DataFrame, items: DataFrame, *more: str, window: int = WINDOW, max_bytes: int = MAX_BYTES, cleaned: bool = True) -> DataFrame:
    """(doc_id, more..., n_words, n_hit, item_ids, cleaned) of every row: ``cleaned`` is the text without
    the hit spans, or null where it is not asked for.

    The windows are broadcast if their counted bytes are within ``max_bytes``, else joined: same result.
    """
    spark = docs.sparkSession
    known = cut_lineage(item_windows(items, window))
    size = F.sum(F.length("window") + F.octet_length("item_id") + 24)
    n_bytes = known.agg(F.coalesce(size, F.lit(0))).first()[0]
    docs = documents(docs, *more)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop("text").schema) + f", {_SCHEMA}"
    if n_bytes <= max_bytes:
        windows = spark.sparkContext.broadcast(WindowSet(known.toArrow()))

        def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for i, j, data, offsets in flat_blocks(batch.column("text")):
                t = _Text(data, offsets)
                found = windows.value.hits(t)
                items_of: dict[int, set[str]] = {}
                for first, _, ids in found:
                    items_of.setdefault(int(t.rows[first]), set()).update(ids)
                hit = _covered(len(t.starts), np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64))
                yield _result(batch, i, j, _marked(data, offsets, t, hit, items_of), cleaned)

        return map_arrow(docs, one, schema)
    return _by_join(docs, known, cleaned, schema)


def _result(batch, i, j, columns, cleaned) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string())
    if not cleaned:
        columns[3] = [None] * (j - i)
    own = [c for c in batch.schema.names if c not in ("text", "row_key", "spans", "items")]
    return pa.RecordBatch.from_arrays(
        [batch.column(c).slice(i, j - i) for c in own] + [pa.array(c, k) for c, k in zip(columns, kinds)],
        [*own, "n_words", "n_hit", "item_ids", "cleaned"],
    )


def _by_join(docs: DataFrame, known: DataFrame, cleaned: bool, schema: str) -> DataFrame:
    """The same result for a benchmark of any size: windows meet in a sort-merge join."""
    lengths = sorted(r[0] for r in known.select("length").distinct().collect())  # at most ``window`` numbers
    keyed = cut_lineage(docs.withColumn("row_key", F.expr("uuid()")))

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, data, offsets in flat_blocks(batch.column("text")):
            t = _Text(data, offsets)
            keys = batch.column("row_key").slice(i, j - i)
            before = np.searchsorted(t.rows, np.arange(j - i))
            for m in lengths:
                first, h = t.windows(m)
                rows = t.rows[first]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(rows)), pa.array(first - before[rows]), pa.array(np.full(len(first), m, np.int32)),
                     pa.array(h.view(np.int64)), pa.array([t.text(int(k), m) for k in first], pa.binary())],
                    ["row_key", "first", "length", "hash", "window"],
                )

    seen = map_arrow(keyed.select("row_key", "text"), cut, "row_key string, first long, length int, hash long, window binary")
    hits = (
        # a window that many texts share is split
        lookup(seen, known, ["length", "hash", "window"], spread_by="row_key")
        .groupBy("row_key")
        .agg(F.collect_set(F.struct("first", "length")).alias("spans"), F.collect_set("item_id").alias("items"))
    )

    def mark(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, data, offsets in flat_blocks(batch.column("text")):
            t = _Text(data, offsets)
            before = np.searchsorted(t.rows, np.arange(j - i))
            spans = batch.column("spans").slice(i, j - i).to_pylist()
            items = batch.column("items").slice(i, j - i).to_pylist()
            pairs = [(int(before[r]) + s["first"], s["length"]) for r in range(j - i) for s in spans[r] or ()]
            hit = _covered(len(t.starts), np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64))
            yield _result(batch, i, j, _marked(data, offsets, t, hit, {r: set(x) for r, x in enumerate(items) if x}), cleaned)

    return map_arrow(keyed.join(hits, "row_key", "left"), mark, schema)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), cleaned=False)
    return marked.select(
        "doc_id", "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op6_decontamination": op6_decontamination}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {
    "op6_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT r, m, i, array_to_string(w[i : i + m - 1], ' ') AS t
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lengths WHERE len(w) >= m)),
h AS (SELECT r, i, dw.m, item_id FROM dw JOIN bw ON dw.t = bw.t AND dw.m = bw.m),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM h) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN s USING (r)"""
}
