"""Fingerprints from spot signatures, and likeness of fingerprints.

A common word is an anchor. With the chain of the next content words after it (``CHAIN`` of them, each
``DISTANCE`` content words further) it forms a spot signature; the set of a text's signatures, as 48-bit
hashes, is its fingerprint. Where no common word stood among the last ``GAP`` words every word is an
anchor, so texts of other languages and lists have signatures too, and an edit changes only those near it.
A chain that meets the end of the text is cut short: any text with a word has a signature.

Likeness is the Jaccard coefficient of two sets. Sets are partitioned by their length, with borders
that grow by 1 / ``least``: sets of partitions that are no neighbours cannot reach ``least``. Comparing
goes through the partitions and prunes pairs by their lengths. ``with_edits`` states exact likeness, and
decides by that pruning whether a text and its edited one, or the next one, are copies (``LEAST`` or more).

Words are runs of ASCII letters and digits and of all other characters, A-Z in lower case. A fingerprint
is the base64 of its sorted hashes, six bytes each, first byte highest. Texts without words, null or empty,
have the empty fingerprint; two equal fingerprints, empty ones too, have likeness 1.

Next documents: rows stand in the order of doc_id, rows of one id in that of a digest of their text, so
a row may be next to another of its id. A row without doc_id has no place in that order; its next text is
empty. Columns other than doc_id and text are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .flat import byte_class, counts_of, flat, flat_blocks, fold, hash_spans, lower_ascii, words
from .frames import documents, map_arrow, read

CHAIN, DISTANCE, GAP = 2, 1, 8
LEAST = 0.75
_BITS = 48
_WORD = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Common words of the languages at hand; a parameter of ``fingerprints``.
COMMON = (
    "a an and are as at be been but by for from had has have he in is it its not of on or she that the their they this to was were which will with "
    "aber als auch auf aus bei das dem den der des die ein eine einen einer er es für im ist mit nach nicht noch sich sie sind und von war werden wie wird zu zum zur über "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous ont ou où par pas plus pour que qui sa se ses son sont sur un une vous "
    "al como con de del el en entre era es esta este ha la las lo los más no o para pero por que se ser sin sobre son su sus un una y"
)


@lru_cache(maxsize=4)
def _hashes(common: str) -> np.ndarray:
    data, offsets = flat(pa.array([common.encode()]))
    starts, ends, _ = words(data, offsets, _WORD)
    return np.unique(hash_spans(data, starts, ends))


def signatures(data: np.ndarray, offsets: np.ndarray, common: str = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different signatures of all rows, and row offsets into them."""
    n = len(offsets) - 1
    low = lower_ascii(data)
    starts, ends, rows = words(low, offsets, _WORD)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    h = hash_spans(low, starts, ends)
    known = _hashes(common)
    is_common = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
    place = np.arange(len(h))
    size = counts_of(rows, n)
    begin = (np.cumsum(size) - size)[rows]
    last = np.maximum.accumulate(np.where(is_common, place, -1))
    anchor = np.flatnonzero((last < begin) | (place - last > GAP) | is_common)
    content = np.r_[np.flatnonzero(~is_common), np.full(CHAIN * DISTANCE, len(h))]
    after = np.searchsorted(content[: len(content) - CHAIN * DISTANCE], anchor, "right")
    edge = np.r_[rows, -1]
    word = np.r_[h, np.uint64(0)]
    parts = [h[anchor]]
    for k in range(CHAIN):
        at = content[after + (k + 1) * DISTANCE - 1]
        parts.append(np.where(edge[at] == rows[anchor], word[at], np.uint64(k)))
    value = fold(parts) >> np.uint64(64 - _BITS)
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(rows[anchor][order].astype(np.uint32), kind="stable")]
    value, owner = value[order], rows[anchor][order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[keep], np.r_[0, np.cumsum(counts_of(owner[keep], n))]


def written(sets: np.ndarray, ends: np.ndarray) -> list[str]:
    """Fingerprints as strings."""
    raw = sets.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
    return [base64.b64encode(raw[6 * a : 6 * b]).decode() for a, b in zip(ends.tolist(), ends[1:].tolist())]


def parsed(fingerprint: str) -> np.ndarray:
    """The sorted signatures of a fingerprint."""
    six = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    return np.pad(six, ((0, 0), (2, 0))).copy().view(">u8").ravel().astype(np.uint64)


def partition_of(n: np.ndarray, least: float) -> np.ndarray:
    """Partition of each set length. A set and a longer one with likeness >= ``least`` lie in one
    partition or in neighbouring ones; empty sets have partition -1."""
    borders = [1]
    while borders[-1] <= int(np.max(n, initial=0)):
        borders.append(int(borders[-1] / least) + 1)
    return np.searchsorted(borders, n, "right") - 1


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float = 0.0) -> np.ndarray:
    """Jaccard coefficient of row k of ``a`` with row k of ``b``, both as made by ``signatures``.

    Pairs that cannot reach ``least`` by their partitions or lengths are pruned: they are 0.
    """
    (left, left_ends), (right, right_ends) = a, b
    n, m = np.diff(left_ends), np.diff(right_ends)
    small, large = np.minimum(n, m), np.maximum(n, m)
    open_ = small > 0
    if least > 0:
        open_ &= np.abs(partition_of(n, least) - partition_of(m, least)) <= 1
        open_ &= small >= least * large
    row = lambda sizes: np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    x, y = row(n), row(m)
    x, left = x[open_[x]], left[open_[x]]
    y, right = y[open_[y]], right[open_[y]]
    out = np.where(large == 0, 1.0, 0.0)
    for start in range(0, len(n), 1 << (63 - _BITS)):  # rows and hashes in one number
        def key(rows, values):
            mine = (rows >= start) & (rows < start + (1 << (63 - _BITS)))
            return (rows[mine] - np.uint64(start)) << np.uint64(_BITS) | values[mine]

        both = np.sort(np.concatenate([key(x, left), key(y, right)]))
        common = both[1:][both[1:] == both[:-1]] >> np.uint64(_BITS)
        size = min(len(n) - start, 1 << (63 - _BITS))
        shared = np.bincount(common.astype(np.int64), minlength=size)
        part = slice(start, start + size)
        value = shared / np.maximum(n[part] + m[part] - shared, 1)
        out[part] = np.where(open_[part] & (value >= least), value, out[part])
    return out


def fingerprints(docs: DataFrame, common: str = COMMON) -> DataFrame:
    """(doc_id, n_signatures, fingerprint) of every row."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, data, offsets in flat_blocks(batch.column("text")):
            sets, ends = signatures(data, offsets, common)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(ends)), pa.array(written(sets, ends))],
                ["doc_id", "n_signatures", "fingerprint"],
            )

    return map_arrow(documents(docs), one, "doc_id long, n_signatures long, fingerprint string")


def _heads(ids: DataFrame, parts: int) -> list[int]:
    """First ids of ranges of about equally many rows; at most ``parts`` numbers reach the driver."""
    shares = [k / parts for k in range(parts)]
    found = ids.agg(F.min("doc_id").alias("first"), F.percentile_approx("doc_id", shares, 100 * parts).alias("cuts")).first()
    return [] if found.first is None else sorted({found.first, *found.cuts})


def in_order(docs: DataFrame) -> DataFrame:
    """Rows dealt to tasks by ranges of doc_id and sorted, with compressed texts.

    The first rows of a range stand once more, as copies, at the end of the range before it (those of the
    first range at the end of the last), so the row after any row lies in its own task. This is the only
    shuffle; what it carries twice is one id per range.
    """
    own = documents(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heads = _heads(own.select("doc_id").filter("doc_id is not null"), parts)

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        out: dict[str, list] = {"block": [], "copied": [], "doc_id": [], "digest": [], "body": []}

        def put(*values) -> None:
            for column, value in zip(out.values(), values):
                column.append(value)

        starts = set(heads)
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary())):
            raw = text.as_py() or b""
            digest, body = hashlib.md5(raw).digest(), squeeze(raw)
            if doc_id is None:
                put(-1 - digest[0] % parts, False, None, digest, body)
                continue
            block = int(np.searchsorted(heads, doc_id, "right")) - 1
            put(block, False, doc_id, digest, body)
            if doc_id in starts:
                put((block - 1) % len(heads), True, doc_id, digest, body)
        kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out.values(), kinds)], list(out))

    dealt = map_arrow(own, one, "block int, copied boolean, doc_id long, digest binary, body binary")
    # one range to a task: hashing as many numbers as there are tasks would give some of them several
    return dealt.repartitionById(parts, F.pmod("block", F.lit(parts))).sortWithinPartitions("block", "copied", "doc_id", "digest")


def edited_text(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first as many code points of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_edits(docs: DataFrame, common: str = COMMON, least: float = 0.0) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; that with the next document too.

    Texts go through a task one by one, whole; a block of results ends after about a million characters.
    """
    limit = 1_000_000

    def compared(rows: list[tuple], following: str) -> pa.RecordBatch:
        """``rows`` are (doc_id or None, text), each the one before the next; ``following`` is the last one's next."""
        n = len(rows)
        texts = [text for _, text in rows]
        after = [*texts[1:], following]
        changed = [edited_text(t, f).encode() if doc_id is not None else t[: len(t) - len(t) // 2].encode() for (doc_id, t), f in zip(rows, after)]
        alone = np.array([doc_id is None for doc_id, _ in rows])
        own = signatures(*flat(pa.array([t.encode() for t in (*texts, following)], pa.large_binary())), common)
        edits = signatures(*flat(pa.array(changed, pa.large_binary())), common)
        first = own[0][: own[1][n]], own[1][: n + 1]
        second = own[0][own[1][1] :], own[1][1:] - own[1][1]
        near_next = likeness(first, second, least)
        copies = [likeness(first, other, LEAST) > 0 for other in (edits, second)]  # by partition and length first
        copies[1] &= ~alone
        near_next[alone] = np.where(np.diff(first[1])[alone] == 0, 1.0, 0.0)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([doc_id for doc_id, _ in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in changed]), pa.array(written(*first)), pa.array(written(*edits)),
                pa.array(likeness(first, edits, least)), pa.array(near_next), pa.array(np.diff(first[1])), pa.array(np.diff(edits[1])),
                pa.array(partition_of(np.diff(first[1]), LEAST)), pa.array(copies[0]), pa.array(copies[1]),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures", "n_edited_signatures",
             "length_partition", "edited_is_copy", "next_is_copy"],
        )

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        held: list[tuple] = []
        held_block, held_size, done = None, 0, False
        for batch in batches:
            for block, copied, doc_id, body in zip(*(batch.column(c).to_pylist() for c in ("block", "copied", "doc_id")), batch.column("body")):
                if block != held_block:
                    if held:
                        yield compared(held, "")
                    held, held_block, held_size, done = [], block, 0, False
                if done:
                    continue
                text = open_(body.as_buffer()).decode()
                if held and (copied or held_size > limit):
                    yield compared(held, text)
                    held, held_size = [], 0
                done = copied
                if not copied:
                    held.append((doc_id, text))
                    held_size += len(text)
        if held:
            yield compared(held, "")

    return in_order(docs).mapInArrow(
        every,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
        "near_next double, n_signatures long, n_edited_signatures long, length_partition long, edited_is_copy boolean, next_is_copy boolean",
    )


def op11_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(read(spark, sf_dir, "documents"))


QUERIES = {"op11_spot_signatures": op11_spot_signatures}
