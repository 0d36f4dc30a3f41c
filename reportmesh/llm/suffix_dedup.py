"""Removal of repeated passages by a suffix array over the whole collection.

A byte goes if some 50-byte string over it also starts in a document with a smaller id. The strings of
the collection are cut so that equal windows always meet, whatever surrounds them:

1. A window's key is the smallest hash of the 20-byte strings in it; neighbouring windows with one key
   form a segment of at most 64 windows. Equal windows have equal keys.
2. Equal segments (key and digest) are one string of the collection, its owner the smallest document;
   the copies of other documents go whole. A string that is alone under its key has nothing to match.
3. The other strings go to the task of their key. Those that share a longer key with another string of
   their group stay, and a collection Burrows-Wheeler transform with common prefixes is built of them column by column (``collection_bwt``); runs of prefixes of 50 bytes or more
   are equal windows, and the smallest owner of each run decides.

Copies are combined in each batch before the shuffle, so one row per batch and string is counted. Keys
of many different strings are salted by digest in the count, and cut anew by a key of 42 bytes for the
transform. Groups in a task are cut at keys, near ``GROUP_SEGMENTS`` strings of about 66 bytes, which
bounds the transform.

Null and short texts lose nothing. Rows with a null id neither give nor lose. Rows that repeat an id are
one owner: they do not remove from each other. Where such rows have different texts, places in them
travel with a digest of their text, so that each row loses its own bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .collection_bwt import smallest_owner
from .flat import flat, flat_blocks, hash_grams, hash_spans, mix, ranges, rows_of, running_sums
from .frames import BATCH_ROWS, arrived, documents, map_arrow, read, travelling

WINDOW = 50
_GRAM, _LONG_GRAM = 20, 42
_RUN = 64
#: Different strings under a key from which they are cut anew, over all batches and in one.
HOT = 4096
BATCH_HOT = 256
GROUP_SEGMENTS = 5_000
_M = 0xD6E8FEB86659FD93
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def _tails(flags: np.ndarray, offsets: np.ndarray, length: int, value) -> np.ndarray:
    """Positions at which no string of ``length`` bytes fits into its row get the value."""
    low = np.maximum(offsets[:-1], offsets[1:] - (length - 1))
    at = ranges(low, offsets[1:] - low)
    flags[at[at < len(flags)]] = value
    return flags


def _keys(sums: np.ndarray, offsets: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of the window at each position of the bytes but the last, and whether a window starts there."""
    # keys only bring strings together: 48 bits travel cheaper
    least, span, size = _tails(hash_grams(sums, gram) >> np.uint64(16), offsets, gram, _NEVER), WINDOW - gram + 1, 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if span > size:
        least = np.minimum(least[: size - span], least[span - size :])
    return least, _tails(np.ones(len(least), bool), offsets, WINDOW, False)


class Segments:
    """Runs of windows with one key in a block: positions in its bytes, and rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gram: int = _GRAM, only: np.ndarray | None = None):
        self.data, self.offsets, self.sums = data, offsets, running_sums(data)
        if len(data) < WINDOW:
            key, good = np.zeros(0, np.uint64), np.zeros(0, bool)
        else:
            key, good = _keys(self.sums, offsets, gram)
        if only is not None:
            good &= only[: len(good)]
        # no window starts at the last bytes of a row, so that a run ends with its row
        edge = key[1:] != key[:-1]
        starts, lasts = good.copy(), good.copy()
        starts[1:] &= ~good[:-1] | edge
        lasts[:-1] &= ~good[1:] | edge
        first = np.flatnonzero(starts)
        count = np.flatnonzero(lasts) - first + 1
        pieces = -(-count // _RUN)  # long runs (texts of one repeated byte) are cut
        owner = np.repeat(np.arange(len(first)), pieces)
        step = ranges(np.zeros(len(first), np.int64), pieces)
        self.first = first[owner] + step * _RUN
        self.windows = np.minimum(count[owner] - step * _RUN, _RUN)
        self.key = key[self.first].view(np.int64)
        self.row = rows_of(offsets, self.first)
        self.ends = self.first + self.windows + WINDOW - 1

    def digest(self) -> np.ndarray:
        return hash_spans(self.data, self.first, self.ends, self.sums).view(np.int64)

    def local(self) -> np.ndarray:
        """First byte of each segment within its row."""
        return self.first - self.offsets[self.row]


def _outside(batch: pa.RecordBatch, i: int, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes of a block at which no removed window starts."""
    outside = np.ones(len(data), bool)
    lists = batch.column("gone").slice(i, len(offsets) - 1)
    flat = lists.flatten()
    if len(flat):
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        base = np.repeat(offsets[:-1], sizes)
        low = base + flat.field("low").to_numpy(zero_copy_only=False)
        high = base + flat.field("high").to_numpy(zero_copy_only=False)
        outside[ranges(low, high - low)] = False
    return outside


FOLLOWS, MEETS, MEETS_MANY = 1, 2, 3


def string_rows(key: np.ndarray, digest: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
    """Rows (key, salt, digest, doc_id, witness) of a batch's strings.

    Each string comes under its smallest document; the other documents are known to follow and come with
    their tag as key and a negative salt. Strings of a key with many of them are salted by digest, and a
    witness tells the other batches.
    """
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    tied = np.flatnonzero(np.r_[same, False] | np.r_[False, same]) if len(key) else order
    some = order[tied]
    order[tied] = some[np.lexsort((owner[some], digest[some], key[some]))]
    key, digest, owner = key[order], digest[order], owner[order]
    new_key = np.ones(len(key), bool)
    new_key[1:] = key[1:] != key[:-1]
    new_string = new_key.copy()
    new_string[1:] |= digest[1:] != digest[:-1]
    new_owner = new_string.copy()
    new_owner[1:] |= owner[1:] != owner[:-1]
    follows = new_owner & ~new_string
    strings = np.bincount(np.cumsum(new_key)[new_string] - 1) if len(key) else np.zeros(0, np.int64)
    many = np.repeat(strings > BATCH_HOT, strings)
    lead = np.flatnonzero(new_string)
    told = np.flatnonzero(new_key)[strings > BATCH_HOT]
    follow = np.flatnonzero(follows)
    columns = (
        np.r_[key[lead], key[told], _tags(key[follow], digest[follow])],
        np.r_[np.where(many, 1 + (digest[lead] & 0x3FF), 0), np.zeros(len(told), np.int64), -1 - (owner[follow] & 0x3FF)].astype(np.int32),
        np.r_[digest[lead], digest[told], np.zeros(len(follow), np.int64)],
        np.r_[owner[lead], owner[told], owner[follow]],
        np.r_[np.zeros(len(lead), bool), np.ones(len(told), bool), np.zeros(len(follow), bool)],
    )
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "salt", "digest", "doc_id", "witness"])


def _tags(key: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Name of a string within a document; two bits are left for its kind."""
    return (key ^ digest) & ~np.int64(3)


def string_table(docs: DataFrame) -> DataFrame:
    """Rows of all documents' strings, batch by batch."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        parts = []
        for i, _, data, offsets in flat_blocks(batch.column("text")):
            s = Segments(data, offsets)
            parts.append((s.key, s.digest(), ids[i + s.row].astype(np.int64)))
        yield string_rows(*(np.concatenate(c) for c in zip(*parts)))

    return map_arrow(docs.filter("doc_id is not null"), one, "key long, salt int, digest long, doc_id long, witness boolean")


def kinds_of_strings(strings: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, tags): for each document the strings that follow a smaller document's or meet others."""
    by_digest = Window.partitionBy("key", "salt").orderBy("digest")
    equal = by_digest.rangeBetween(Window.currentRow, Window.currentRow)
    all_ = by_digest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = strings.withColumns({
        "first_doc": F.min("doc_id").over(equal), "low": F.min("digest").over(all_), "high": F.max("digest").over(all_),
        "told": F.max("witness").over(all_), "n": F.count(F.lit(1)).over(all_),
    }).filter(~F.col("witness"))
    known = F.col("salt") < 0
    many = (F.col("salt") > 0) | F.col("told") | ((F.col("low") < F.col("high")) & (F.col("n") > hot))
    kind = (
        F.when(known | (F.col("first_doc") < F.col("doc_id")), FOLLOWS).when(many, MEETS_MANY)
        .when(F.col("low") < F.col("high"), MEETS)
    )
    tag = F.when(known, F.col("key")).otherwise(F.expr("(key ^ digest) & ~3L"))
    return (
        seen.select("doc_id", tag.bitwiseOR(kind.cast("long")).alias("tag")).filter("tag is not null")
        .groupBy("doc_id").agg(F.collect_list("tag").alias("tags"))
    )


def _kinds(s: Segments, digest: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Kind of each segment by its row's tags, 0 where it has none."""
    tags = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros(len(digest), np.int64)
    if not len(tags) or not len(digest):
        return out
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    name = lambda tag, row: mix(tag.view(np.uint64) + row.astype(np.uint64) * np.uint64(_M))
    known = name(tags & ~np.int64(3), np.repeat(np.arange(len(sizes)), sizes))
    order = np.argsort(known)
    known = known[order]
    mine = name(_tags(s.key, digest), s.row)
    at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
    hit = known[at] == mine
    out[hit] = (tags & 3)[order[at[hit]]]
    return out


def _joined(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring ranges of a row as one. Ranges come in text order."""
    if not len(row):
        return row, low, high
    head = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (low[1:] != high[:-1])])
    return row[head], low[head], high[np.r_[head[1:], len(row)] - 1]


_SHIPPED = "key long, segment binary, doc_id long, text_digest long, low int, high int"


def ship(docs: DataFrame) -> DataFrame:
    """Strings that meet others (with their bytes), and ranges of windows that go (without)."""

    def rows(key, segment, doc, text, low, high) -> pa.RecordBatch:
        """Strings have a segment, whose length tells where they end; ranges have an end instead."""
        n = len(doc)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(key), pa.nulls(n, pa.binary()) if segment is None else pa.array(segment, pa.binary()), pa.array(doc), pa.array(text),
                pa.array(low.astype(np.int32)), pa.nulls(n, pa.int32()) if high is None else pa.array(high.astype(np.int32)),
            ],
            ["key", "segment", "doc_id", "text_digest", "low", "high"],
        )

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("doc_id").fill_null(0).to_numpy()  # a null id has no tags
        texts = batch.column("text_digest").to_numpy()
        for i, j, data, offsets in flat_blocks(arrived(batch.column("body"))):
            s = Segments(data, offsets)
            digest = s.digest()
            kind = _kinds(s, digest, batch.column("tags").slice(i, j - i))
            raw = data.tobytes()
            gone = np.flatnonzero(kind == FOLLOWS)
            ranges_ = [_joined(s.row[gone], s.local()[gone], (s.local() + s.windows)[gone])]
            sent = [(s, np.flatnonzero(kind == MEETS))]
            wide = np.zeros(len(data), bool)
            many = kind == MEETS_MANY
            wide[ranges(s.first[many], s.windows[many])] = True
            if many.any():
                h = Segments(data, offsets, _LONG_GRAM, wide)
                d, owner = h.digest(), ids[i + h.row]
                order = np.lexsort((owner, d, h.key))
                k, x, o = h.key[order], d[order], owner[order]
                new = np.r_[True, (k[1:] != k[:-1]) | (x[1:] != x[:-1])]
                lead = o[np.flatnonzero(new)][np.cumsum(new) - 1] == o
                sent.append((h, np.sort(order[lead])))
                gone = np.sort(order[~lead])
                ranges_.append(_joined(h.row[gone], h.local()[gone], (h.local() + h.windows)[gone]))
            for own, at in sent:
                if len(at):
                    bytes_ = [raw[a:b] for a, b in zip(own.first[at].tolist(), own.ends[at].tolist())]
                    yield rows(own.key[at], bytes_, ids[i + own.row[at]], texts[i + own.row[at]], own.local()[at], None)
            row, low, high = (np.concatenate(c) for c in zip(*ranges_))
            if len(row):
                doc = ids[i + row]
                yield rows(mix(doc.view(np.uint64)).view(np.int64), None, doc, texts[i + row], low, high)

    return map_arrow(docs, one, _SHIPPED)


def may_share(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each string of a group has a window whose longer key another of them has, too: strings
    with a common 20-byte string mostly differ right beside it, and no window of theirs is equal."""
    s = Segments(data, offsets, _LONG_GRAM)
    out = np.zeros(len(offsets) - 1, bool)
    if len(s.key):
        order = np.argsort(s.key, kind="stable")
        key, string = s.key[order], s.row[order]
        new = np.r_[True, key[1:] != key[:-1]]
        group = np.cumsum(new) - 1
        other = string != string[np.flatnonzero(new)][group]
        out[string[np.bincount(group[other], minlength=group[-1] + 1)[group] > 0]] = True
    return out


def match(shipped: DataFrame) -> DataFrame:
    """(doc_id, text_digest, low, high): all ranges of windows that also start in a smaller document."""
    spark = shipped.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = shipped.repartition(parts, "key").sortWithinPartitions("key", "segment", "doc_id")

    def result(doc, text, low, high) -> pa.RecordBatch:
        columns = (doc, text, low.astype(np.int32), high.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "text_digest", "low", "high"])

    def solve(table: pa.Table) -> pa.RecordBatch:
        doc, text, low, fresh = (table[c].to_numpy() for c in ("doc_id", "text_digest", "low", "fresh"))
        once, string = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        some = table["segment"].combine_chunks().cast(pa.large_binary()).take(pa.array(once))
        data, offsets = flat(some)
        meets = may_share(data, offsets)
        counts, owner = np.zeros(len(meets), np.int64), np.zeros(0, np.int64)
        if meets.any():
            counts[meets], owner = smallest_owner(data, offsets[:-1][meets], np.diff(offsets)[meets], doc[fresh][meets], WINDOW)
        # each row's windows with an owner before its document, neighbours as one range
        own = counts[string]
        at = ranges((np.cumsum(counts) - counts)[string], own)
        row = np.repeat(np.arange(len(doc)), own)
        place = ranges(low.astype(np.int64), own)
        goes = owner[at] < doc[row]
        row, place = row[goes], place[goes]
        head = np.ones(len(row), bool)
        head[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
        head = np.flatnonzero(head)
        last = np.r_[head[1:], len(row)][: len(head)].astype(np.int64) - 1
        return result(doc[row[head]], text[row[head]], place[head], place[last] + 1)

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows, last, owner = 0, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            segment = batch.column("segment")
            is_range = np.asarray(segment.is_null())
            key, doc, text, low = (batch.column(c).to_numpy() for c in ("key", "doc_id", "text_digest", "low"))
            data, ends = flat(segment)
            size = np.diff(ends)
            high = np.where(is_range, batch.column("high").fill_null(0).to_numpy(), low + size - WINDOW + 1)
            # rows are sorted: the first of a string has its smallest owner
            digest = hash_spans(data, ends[:-1], ends[1:])
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (size[1:] != size[:-1]) | (digest[1:] != digest[:-1])
            new[0] = (key[0], size[0], digest[0]) != last
            owners = np.r_[owner, doc[new]]
            lead = owners[np.cumsum(new)]
            last, owner = (key[-1], size[-1], digest[-1]), lead[-1]
            gone = is_range | (lead < doc)
            if gone.any():
                yield result(doc[gone], text[gone], low[gone], high[gone])
            if not gone.all():
                held.append(pa.Table.from_batches([batch]).append_column("fresh", pa.array(new)).filter(pa.array(~gone)))
                rows += held[-1].num_rows
            if rows >= GROUP_SEGMENTS:
                table = pa.concat_tables(held)
                cut = int(np.searchsorted(table["key"].to_numpy(), table["key"][-1].as_py()))  # the last key may go on
                held, rows = [table.slice(cut)], table.num_rows - cut
                if cut:
                    yield solve(table.slice(0, cut))
        if held and rows:
            yield solve(pa.concat_tables(held))

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return dealt.mapInArrow(every, "doc_id long, text_digest long, low int, high int")


def _text_digest() -> Column:
    """Names a text among those of its id; never 0."""
    return F.xxhash64(F.col("text").cast("string")).bitwiseOR(F.lit(1).cast("long"))


def removed_ranges(docs: DataFrame, bodies: DataFrame) -> DataFrame:
    """(doc_id, text_digest, low, high): window starts whose string also starts in a smaller document.
    The digest is 0 for ids with one text."""
    known = docs.filter("doc_id is not null")
    several = known.groupBy("doc_id").agg(F.min(_text_digest()).alias("a"), F.max(_text_digest()).alias("b")).filter("a < b")
    # outer joins, so that the shuffle of the texts is the one of the last join
    tagged = bodies.join(kinds_of_strings(string_table(docs)), "doc_id", "left").join(several.select("doc_id", F.lit(True).alias("several")), "doc_id", "left")
    return match(ship(tagged.withColumn("text_digest", F.when(F.col("several"), F.col("text_digest")).otherwise(F.lit(0).cast("long"))).drop("several")))


def deduplicate(docs: DataFrame, *more: str, as_text: bool = False) -> DataFrame:
    """(doc_id, more..., n_bytes, n_removed, n_spans, kept) of every row.

    ``kept`` are the remaining bytes; as text, bytes of characters that were cut apart go too.
    """
    own = travelling(docs, *more, _text_digest().alias("text_digest"))
    ranges_of = removed_ranges(documents(docs), own).withColumnsRenamed({"doc_id": "of_doc", "text_digest": "of_text"})
    # dealt by id alone: the texts are, too
    lists = ranges_of.repartition("of_doc").groupBy("of_doc", "of_text").agg(F.collect_list(F.struct("low", "high")).alias("gone"))
    same = (F.col("doc_id") == F.col("of_doc")) & ((F.col("of_text") == 0) | (F.col("of_text") == F.col("text_digest")))
    joined = own.join(lists, same, "left").drop("of_doc", "of_text", "text_digest")

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, data, offsets in flat_blocks(arrived(batch.column("body"))):
            starts = ~_outside(batch, i, data, offsets)
            depth = np.zeros(len(data) + WINDOW, np.int32)  # each window start covers its window
            edge = np.diff(np.r_[False, starts, False].astype(np.int8))
            np.add.at(depth, np.flatnonzero(edge == 1), 1)
            np.add.at(depth, np.flatnonzero(edge == -1) + WINDOW - 1, -1)
            gone = np.cumsum(depth)[: len(data)] > 0
            row = np.repeat(np.arange(j - i), np.diff(offsets))
            head = gone.copy()
            head[1:] &= ~gone[:-1] | (row[1:] != row[:-1])
            kept = data[~gone].tobytes()
            left = np.r_[0, np.cumsum(~gone)][offsets].tolist()
            columns = [c for c in batch.schema.names if c not in ("body", "gone")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).slice(i, j - i) for c in columns]
                + [
                    pa.array(np.diff(offsets)), pa.array(np.bincount(row[gone], minlength=j - i).astype(np.int64)),
                    pa.array(np.bincount(row[head], minlength=j - i).astype(np.int64)),
                    pa.array([kept[a:b].decode("utf-8", "ignore") for a, b in zip(left, left[1:])], pa.string())
                    if as_text else pa.array([kept[a:b] for a, b in zip(left, left[1:])], pa.binary()),
                ],
                [*columns, "n_bytes", "n_removed", "n_spans", "kept"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.drop("body", "gone").schema)
    return map_arrow(joined, one, f"{kinds}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {"op3_suffix_dedup": op3_suffix_dedup}
