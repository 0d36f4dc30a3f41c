"""N-gram Jaccard join by T-occurrence search, and the components of its links.

A document is the set of its different 5-word shingles (as 64-bit hashes); two documents link when
100 * intersection >= 75 * union. Equal sets are one class, so copies are never paired with each other.

1. A document with n shingles needs T = ceil(0.75 n) of them in a partner. Of the shingles whose hash
   lies below a fixed mark (three eighths of all), at most n - T may be nobody else's; documents with
   more cannot link and go. That takes one count of the marked shingles.
2. Among the rest shingles are counted exactly. Shingles of one class only help nobody; of the others
   the n_shared - T + 1 rarest are a document's short lists. Every partner shares one of them, so the
   components over short lists are groups that hold all links; they become search blocks of bounded
   size, larger groups as pairs of blocks.
3. A block is one task's index. Each document merges its short lists, drops what is already in its
   component, and completes the overlaps on its long lists: by binary probes into the postings where
   few candidates are left, else by merging those lists too (DivideSkip's trade-off). Documents that
   share most go first, so that a group of near copies meets in one component at once and needs no
   pairs among its members.

Documents without words are empty and linked with nothing; fewer than 5 words are one shingle. A null
doc_id has a null component. Rows that repeat an id are one document with several sets: each set links,
and all rows of the id have one component. Such sets share one row of short lists, long enough for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import write_stage
from . import sharing
from .flat import NOT_SPACE, counts_of, flat_blocks, fold, hash_spans, lower_ascii, ranges, words
from .frames import arrived, documents, map_arrow, read, travelling

SHINGLE = 5
PERCENT = 75
#: Shingles below this hash are counted first.
_MARK = np.uint64(3 << 61)
#: Bounds of a search block: classes and shingles.
BLOCK_CLASSES, BLOCK_SHINGLES = 2048, 1_000_000


def needed(n):
    """Least overlap of a set of n shingles with any partner."""
    return (PERCENT * n + 99) // 100


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different shingle hashes of all rows, and row offsets into them."""
    n = len(offsets) - 1
    low = lower_ascii(data)
    starts, ends, rows = words(low, offsets, NOT_SPACE)
    h = hash_spans(low, starts, ends)
    size = counts_of(rows, n)
    begin = np.cumsum(size) - size
    window = max(len(h) - SHINGLE + 1, 0)
    inside = np.flatnonzero(rows[:window] == rows[SHINGLE - 1 :][:window]) if window else np.zeros(0, np.int64)
    value = [fold([h[inside + k] for k in range(SHINGLE)])]
    owner = [rows[inside]]
    for short in range(1, SHINGLE):
        at = np.flatnonzero(size == short)
        if len(at):
            value.append(fold([h[begin[at] + k] for k in range(short)]))
            owner.append(at)
    value, owner = np.concatenate(value), np.concatenate(owner)
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(owner[order].astype(np.uint32), kind="stable")]
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[keep], np.r_[0, np.cumsum(counts_of(owner[keep], n))]


def _classes(sets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit digest of each row's set, as two numbers."""
    raw = sets.tobytes()
    digests = b"".join(xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(ends.tolist(), ends[1:].tolist()))
    return np.frombuffer(digests, np.int64).reshape(-1, 2)


def class_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n, marked, c1, c2) of every row: set size, shingles below the mark, and class."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, data, offsets in flat_blocks(batch.column("text")):
            sets, ends = shingle_sets(data, offsets)
            c = _classes(sets, ends)
            marked = np.r_[0, np.cumsum(sets < _MARK)][ends]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(ends)), pa.array(np.diff(marked)),
                 pa.array(np.ascontiguousarray(c[:, 0])), pa.array(np.ascontiguousarray(c[:, 1]))],
                ["doc_id", "n", "marked", "c1", "c2"],
            )

    return map_arrow(docs, one, "doc_id long, n long, marked long, c1 long, c2 long")


def _marked_keys(docs: DataFrame) -> DataFrame:
    """Marked shingles of a batch's classes, each under its smallest document of the batch."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        keys, owners, seen = [], [], []
        for i, j, data, offsets in flat_blocks(batch.column("text")):
            sets, ends = shingle_sets(data, offsets)
            low = sets < _MARK
            row = np.repeat(np.arange(j - i), np.diff(ends))
            keys.append((sets[low] >> np.uint64(16)).view(np.int64))  # only counted: fewer bits travel cheaper
            owners.append(i + row[low])
            seen.append(_classes(sets, ends))
        key, owner, c = np.concatenate(keys), np.concatenate(owners), np.concatenate(seen)
        order = np.lexsort((ids, c[:, 1], c[:, 0]))
        fresh = np.r_[True, (c[order][1:] != c[order][:-1]).any(1)]
        first = np.zeros(len(ids), bool)
        first[order[fresh]] = True
        mine = first[owner]
        yield sharing.rows_of_keys(key[mine], ids[owner[mine]])

    return map_arrow(docs.filter("doc_id is not null"), one, sharing.SCHEMA)


def survivors(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, c1, c2, n): first documents of classes that may link, by the counts of marked shingles."""
    found = sharing.shared(_marked_keys(docs)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("found"))
    first = classes.filter("n > 0 and doc_id is not null").groupBy("c1", "c2", "n", "marked").agg(F.min("doc_id").alias("doc_id"))
    may = F.coalesce("found", F.lit(0)) >= F.col("marked") - (F.col("n") - F.expr(f"({PERCENT} * n + 99) div 100"))
    return first.join(found, "doc_id", "left").filter(may).select("doc_id", "c1", "c2", "n")


def set_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, n, shingles binary) of the wanted classes, from the text of their first documents."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c1, c2, ids = (batch.column(c).to_numpy() for c in ("c1", "c2", "doc_id"))
        for i, j, data, offsets in flat_blocks(arrived(batch.column("body"))):
            sets, ends = shingle_sets(data, offsets)
            c = _classes(sets, ends)
            raw = sets.tobytes()
            own = np.flatnonzero((c[:, 0] == c1[i:j]) & (c[:, 1] == c2[i:j]))  # an id may repeat with other texts
            own = own[np.unique(np.stack([ids[i + own], c1[i + own], c2[i + own]], 1), axis=0, return_index=True)[1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i).take(pa.array(own)), pa.array(np.diff(ends)[own]),
                 pa.array([raw[8 * ends[k] : 8 * ends[k + 1]] for k in own], pa.binary())],
                ["id", "n", "shingles"],
            )

    joined = travelling(docs).join(wanted.drop("n"), "doc_id")
    return map_arrow(joined, one, "id long, n long, shingles binary")


def short_lists(sets: DataFrame) -> DataFrame:
    """(key, id): the rarest shared shingles of each class that can still reach its overlap."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = np.repeat(batch.column("id").to_numpy(), batch.column("n").to_numpy())
        yield sharing.rows_of_keys(np.frombuffer(b"".join(batch.column("shingles").to_pylist()), np.int64), ids)

    mine = sharing.shared(map_arrow(sets, one, sharing.SCHEMA)).groupBy("doc_id").agg(F.collect_set(F.struct("df", "key")).alias("lists"))
    # of an id with several sets the smallest drops the fewest frequent shingles: what any of them needs is left
    sizes = sets.groupBy("id").agg(F.min("n").alias("n"))
    room = F.size("lists") - F.expr(f"cast(({PERCENT} * n + 99) div 100 as int)") + 1
    return (
        mine.join(sizes, F.col("doc_id") == F.col("id")).withColumn("room", room).filter("room > 0")
        .select("id", F.explode(F.slice(F.array_sort("lists"), 1, F.col("room"))).alias("t")).select("id", "t.key")
    )


def groups(lists: DataFrame) -> DataFrame:
    """(id, component): classes that share short lists, directly or through others."""
    heads = lists.groupBy("key").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("key", "head")
    edges = lists.join(heads, "key").filter("id > head").select(F.col("head").alias("left_id"), F.col("id").alias("right_id")).distinct()
    edges = write_stage(edges)[0]
    vertices = edges.select(F.col("left_id").alias("id")).union(edges.select(F.col("right_id").alias("id"))).distinct()
    return connected_components(vertices, edges)


def search(ids: np.ndarray, n: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """T-occurrence self-join of one block; returns for each class the smallest id of its component.

    ``sets`` holds the classes' shingles one after the other, ``n`` of each. Classes of one id are linked.
    """
    size = len(ids)
    _, head, same = np.unique(ids, return_index=True, return_inverse=True)
    comp = head[same]
    doc = np.repeat(np.arange(size), n)
    key, token, df = np.unique(sets, return_inverse=True, return_counts=True)
    live = df[token] > 1
    doc, token = doc[live], token[live]
    # tokens by rarity: ranks below are positions in one global order
    rank = np.empty(len(key), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(key))
    df = df[np.argsort(df, kind="stable")]
    token = rank[token]
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    n_live = counts_of(doc, size)
    begin = np.r_[0, np.cumsum(n_live)]
    n_short = np.maximum(n_live - needed(n) + 1, 0)
    postings = token * size + doc  # sorted by token, then class, for merges and probes
    by_token = np.sort(postings)
    first = np.searchsorted(by_token, np.arange(len(key) + 1) * size)
    of_short = np.arange(len(doc)) - begin[doc] < n_short[doc]
    short_postings = np.sort(postings[of_short])
    short_first = np.searchsorted(short_postings, np.arange(len(key) + 1) * size)
    weight = np.bincount(doc, weights=df[token], minlength=size) / np.maximum(n, 1)
    turn = np.argsort(-weight, kind="stable")
    place = np.empty(size, np.int64)
    place[turn] = np.arange(size)
    dead = np.diff(short_first) < 2
    for t, x in enumerate(turn.tolist()):
        if not n_short[x]:
            continue
        if t & (t - 1) == 0 or t % 256 == 0:  # lists within one component have nothing left to find
            some = np.flatnonzero(~dead)
            if not len(some):
                break
            lengths = np.diff(short_first)[some]
            c = comp[short_postings[ranges(short_first[:-1][some], lengths)] % size]
            at = np.cumsum(lengths) - lengths
            dead[some] = np.minimum.reduceat(c, at) == np.maximum.reduceat(c, at)
        mine = token[begin[x] : begin[x + 1]]
        short = mine[: n_short[x]]
        short = short[~dead[short]]
        met = short_postings[ranges(short_first[short], short_first[short + 1] - short_first[short])] % size
        met = np.unique(met[(comp[met] != comp[x]) & (place[met] > t)])
        # sizes alone must allow the overlap
        met = met[(n[met] >= needed(n[x])) & (n[x] >= needed(n[met]))]
        if not len(met):
            continue
        lengths = first[mine + 1] - first[mine]
        if len(met) * len(mine) * 24 < lengths.sum():  # probe every list for the candidates
            at = np.repeat(mine, len(met)) * size + np.tile(met, len(mine))
            found = by_token[np.minimum(np.searchsorted(by_token, at), len(by_token) - 1)] == at
            overlap = found.reshape(len(mine), len(met)).sum(0)
        else:
            overlap = np.bincount(by_token[ranges(first[mine], lengths)] % size, minlength=size)[met]
        union = n[x] + n[met] - overlap
        linked = met[100 * overlap >= PERCENT * union]
        if len(linked):
            labels = np.unique(np.r_[comp[x], comp[linked]])
            comp[np.isin(comp, labels)] = labels[0]
    smallest = np.full(size, np.iinfo(np.int64).max)
    np.minimum.at(smallest, comp, ids)
    return smallest[comp]


def links(sets: DataFrame, grouped: DataFrame) -> DataFrame:
    """(id, root, whole): classes of a block with the smallest id they are linked to in it. ``whole``
    says that the block holds the whole group, so the root is final."""
    spark = sets.sparkSession
    joined = sets.join(grouped, "id")
    sizes = joined.groupBy("component").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("classes") / BLOCK_CLASSES), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        joined.join(sizes.select("component", blocks.alias("blocks")), "component")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "component", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"),
            (F.col("blocks") == 1).alias("whole"), "id", "n", "shingles",
        )
        .repartition(parts, "component", "a", "b")
        .sortWithinPartitions("component", "a", "b", "id")
    )

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        sets = np.frombuffer(b"".join(table["shingles"].to_pylist()), np.uint64)
        root = search(table["id"].to_numpy(), table["n"].to_numpy().astype(np.int64), sets)
        return pa.RecordBatch.from_arrays([table["id"].combine_chunks(), pa.array(root), table["whole"].combine_chunks()], ["id", "root", "whole"])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last, rows = None, 0
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in ("component", "a", "b"))))
            start = 0
            for k in range(len(names) + 1):
                if k == len(names) or names[k] != last:
                    if k > start:
                        held.append(batch.slice(start, k - start))
                        rows += k - start
                    start = k
                    if k < len(names):
                        if rows >= 256:  # small blocks are searched together: links lie within them anyway
                            yield solve(held)
                            held, rows = [], 0
                        last = names[k]
        if held:
            yield solve(held)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return dealt.mapInArrow(every, "id long, root long, whole boolean")


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    docs = documents(docs)
    classes = write_stage(class_table(docs))[0]
    sets = write_stage(set_table(docs, survivors(docs, classes)))[0]
    found = write_stage(links(sets, groups(write_stage(short_lists(sets))[0])))[0]
    parts = found.filter("not whole and id <> root").select(F.col("root").alias("left_id"), F.col("id").alias("right_id"))
    large = connected_components(found.filter("not whole").select("id").distinct(), parts)
    roots = (
        found.filter("whole").select("id", F.col("root").alias("component")).unionByName(large)
        .filter("component < id").groupBy("id").agg(F.min("component").alias("component"))
    )
    first = classes.filter("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("id"))
    named = first.join(roots, "id", "left").select("c1", "c2", F.coalesce("component", "id").alias("component_id"))
    linked = classes.filter("n > 0 and doc_id is not null").join(named, ["c1", "c2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = classes.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return _one_of_each_id(classes, linked.unionByName(alone))


def _one_of_each_id(classes: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``found`` with one component for all sets of an id."""
    sets = F.struct("c1", "c2")
    several = classes.filter("doc_id is not null").groupBy("doc_id").agg(F.min(sets).alias("a"), F.max(sets).alias("b")).filter("a < b")
    several = write_stage(several.select("doc_id"))[0]
    if several.isEmpty():
        return found
    found = write_stage(found)[0]
    of_them = found.join(several, "doc_id").select("doc_id", "component_id").distinct()
    lows = of_them.groupBy("doc_id").agg(F.min("component_id").alias("left_id"))
    edges = of_them.join(lows, "doc_id").filter("left_id < component_id").select("left_id", F.col("component_id").alias("right_id"))
    edges = write_stage(edges.distinct())[0]
    vertices = edges.select(F.col("left_id").alias("id")).union(edges.select(F.col("right_id").alias("id"))).distinct()
    joined = connected_components(vertices, edges).select(F.col("id").alias("component_id"), "component")
    return found.join(joined, "component_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(read(spark, sf_dir, "documents"))


QUERIES = {"op1_jaccard_join": op1_jaccard_join}
