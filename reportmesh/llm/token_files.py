"""Token ids as flat binary files.

Documents are range-partitioned by doc_id. Each task encodes its rows and writes one file of unsigned
integers (16 bits where the vocabulary allows, else 32) and one of document lengths; its counts go to a
manifest table. Prefix sums over the manifest (one row per partition) give each partition's base, from
which 64-bit document offsets over the whole corpus are written. Readers map the files into memory.

Files lie in the shared folder. A task attempt writes files of its own name and only the manifest rows
of successful attempts are read, so a lost executor leaves at most unread files.

Null texts are empty: one end id. A null doc_id sorts first. Repeated rows each have their own entry.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, write_stage
from .flat import byte_class, flat_blocks, hash_spans, ranges
from .frames import documents, map_arrow, read, tokenizer_file

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
_NULL_ID = np.iinfo(np.int64).min
_UNIT_BYTES = 6_000_000
#: Different pieces of text whose ids a worker keeps: some 40 MB.
_KNOWN_UNITS = 1_000_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


_BLANK = ~byte_class((0x20, 0x20), (0x09, 0x0D))
_WORDY = ~byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
_POINT = ~byte_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


def _units(data: np.ndarray, offsets: np.ndarray, points: np.ndarray = _POINT) -> np.ndarray:
    """Starts of pieces that can be encoded one by one: white space with what follows it, and points
    that follow a word.

    A cut lies before an ASCII blank whose left neighbour ends no white space of any script, and before
    one of ``points`` after an ASCII letter or digit: no token of the byte-level pattern reaches across.
    """
    n = len(data)
    cut = np.zeros(n, bool)
    if n:
        space = _BLANK[data]
        cut[1:] = space[1:] & ~space[:-1]
        after = np.flatnonzero(cut)
        last = data[after - 1]
        wide = after[last >= 0x80]
        if len(wide):
            last, second, third = data[wide - 1], data[np.maximum(wide - 2, 0)], data[np.maximum(wide - 3, 0)]
            two = (second == 0xC2) & ((last == 0x85) | (last == 0xA0))
            three = np.isin(third, (0xE1, 0xE2, 0xE3)) & (last < 0xB0)
            cut[wide[two | three]] = False
        cut[1:] |= points[data[1:]] & _WORDY[data[:-1]]
        cut[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(cut)


@lru_cache(maxsize=2)
def _id_bytes(path: str) -> np.ndarray:
    """Bytes of text each id stands for."""
    coder = tokenizer(path)
    added = {i: len(t.content.encode()) for i, t in coder.get_added_tokens_decoder().items()}
    names = {i: len(p) for p, i in coder.get_vocab(with_added_tokens=False).items()}
    return np.array([added.get(i, names.get(i, 0)) for i in range(max([*names, *added]) + 1)], np.int64)


@lru_cache(maxsize=2)
def _points(path: str) -> np.ndarray:
    """Points that stand in no added token: those are found in the text before any pattern."""
    points = _POINT.copy()
    for token in tokenizer(path).get_added_tokens_decoder().values():
        points[list(token.content.encode())] = False
    return points


class Known:
    """Ids of the units met before, by the units' hashes. It is emptied when more than ``most`` are held."""

    def __init__(self, most: int = _KNOWN_UNITS):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.firsts = self.counts = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash in the rising ones held, and whether it is there."""
        at = np.searchsorted(self.hashes, hashes)
        there = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        there[inside] = self.hashes[at[inside]] == hashes[inside]
        return at, there

    def add(self, at: np.ndarray, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Hold new units; ``at`` are their places by ``find``."""
        firsts = len(self.ids) + np.cumsum(counts) - counts
        self.hashes, self.firsts, self.counts = (
            np.insert(old, at, new) for old, new in ((self.hashes, hashes), (self.firsts, firsts), (self.counts, counts))
        )
        self.ids = np.r_[self.ids, ids.astype(np.uint32)]


@lru_cache(maxsize=2)
def _known(path: str) -> Known:
    return Known()


def _encode_units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, alone: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the units, and their counts. Units that are not ``alone`` are joined to long strings:
    cuts between them are token borders, so bytes per id tell which ids belong to which unit."""
    raw = data.tobytes()
    coder, sizes = tokenizer(path), _id_bytes(path)
    order = np.r_[np.flatnonzero(~alone), np.flatnonzero(alone)]
    n_joined = int((~alone).sum())
    pieces = [raw[a:b] for a, b in zip(starts[order].tolist(), ends[order].tolist())]
    joined = [b"".join(pieces[k : min(k + 1000, n_joined)]).decode() for k in range(0, n_joined, 1000)]
    coded = coder.encode_batch_fast(joined + [p.decode() for p in pieces[n_joined:]], add_special_tokens=False)
    ids = np.concatenate([np.array(e.ids, np.int64) for e in coded]) if coded else np.zeros(0, np.int64)
    upto = np.searchsorted(np.cumsum(sizes[ids]), np.cumsum((ends - starts)[order]), "left") + 1
    counts = np.empty(len(order), np.int64)
    counts[order] = np.diff(np.r_[0, upto])
    firsts = np.empty(len(order), np.int64)
    firsts[order] = np.r_[0, upto[:-1]] if len(upto) else upto
    return ids[ranges(firsts, counts)], counts


def encode_block(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows with the end id after each, and the rows' lengths. Equal units are encoded once,
    also those of blocks that this worker had before."""
    n = len(offsets) - 1
    starts = _units(data, offsets, _points(path))
    ends = np.r_[starts[1:], len(data)].astype(np.int64)
    if not len(starts):
        return np.full(n, END_ID, np.uint32), np.ones(n, np.int64)
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    # only pieces that begin with a blank can follow any other piece
    alone = border[starts] | border[ends] | ~_BLANK[data[starts]]
    hashes, first, inverse = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
    known = _known(path)
    if len(known.hashes) > known.most:
        known.clear()
    at, there = known.find(hashes)
    if not there.all():
        fresh = first[~there]
        known.add(at[~there], hashes[~there], *_encode_units(data, starts[fresh], ends[fresh], alone[fresh], path))
        at, _ = known.find(hashes)
    lengths = known.counts[at][inverse]
    body = known.ids[ranges(known.firsts[at][inverse], lengths)]
    row = np.searchsorted(offsets, starts, "right") - 1
    per_row = np.bincount(row, weights=lengths, minlength=n).astype(np.int64)
    out = np.full(len(body) + n, END_ID, np.uint32)
    out[np.arange(len(body)) + np.repeat(np.arange(n), per_row)] = body
    return out, per_row + 1


def _filesystem(uri: str):
    """File system and path of a folder; local files are mapped into memory."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):  # as Hadoop writes local folders
        uri = "file://" + uri[5:]
    system, path = fs.FileSystem.from_uri(uri)
    return (fs.LocalFileSystem(use_mmap=True) if isinstance(system, fs.LocalFileSystem) else system), path


def write_tokens(docs: DataFrame, folder: str, name: str = TOKENIZER) -> DataFrame:
    """Write id and length files; returns the manifest (part, name, n_docs, n_tokens, width)."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = documents(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        path = tokenizer_file(name)
        kind = width(tokenizer(path).get_vocab_size())
        system, base = _filesystem(folder)
        own = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        system.create_dir(base, recursive=True)
        n_docs = n_tokens = 0
        with system.open_output_stream(f"{base}/{own}.ids") as ids_file, system.open_output_stream(f"{base}/{own}.docs") as docs_file:
            for batch in batches:
                doc_ids = batch.column("doc_id").fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
                for i, j, data, offsets in flat_blocks(batch.column("text"), _UNIT_BYTES):
                    ids, lengths = encode_block(data, offsets, path)
                    ids_file.write(ids.astype(kind).tobytes())
                    docs_file.write(np.stack([doc_ids[i:j], lengths], 1).astype("<i8").tobytes())
                    n_docs, n_tokens = n_docs + j - i, n_tokens + len(ids)
        yield pa.RecordBatch.from_pylist(
            [{"part": context.partitionId(), "name": own, "n_docs": n_docs, "n_tokens": n_tokens, "width": kind}],
            pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.string())]),
        )

    schema = "part int, name string, n_docs long, n_tokens long, width string"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return write_stage(ordered.mapInArrow(write, schema))[0].filter("n_docs > 0")


def with_bases(manifest: DataFrame) -> DataFrame:
    """Ids and documents before each partition. The manifest has one row per partition."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumns({
        "base": F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)),
        "first_doc": F.coalesce(F.sum("n_docs").over(earlier), F.lit(0)),
    })


def write_offsets(manifest: DataFrame, folder: str) -> DataFrame:
    """Write 64-bit offsets of all documents (and the end) of each partition; returns the manifest."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        system, base = _filesystem(folder)
        for row in batch.to_pylist():
            _, lengths = _docs(system, base, row["name"])
            offsets = row["base"] + np.r_[0, np.cumsum(lengths)]
            with system.open_output_stream(f"{base}/{row['name']}.offsets") as f:
                f.write(offsets.astype("<u8").tobytes())
        yield batch

    spread = _spread(manifest)
    return write_stage(map_arrow(spread, one, spread.schema.simpleString()[7:-1].replace(":", " ")))[0]


def _docs(system, base: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    table = np.frombuffer(system.open_input_file(f"{base}/{name}.docs").read_buffer(), "<i8").reshape(-1, 2)
    return table[:, 0], table[:, 1]


def _spread(manifest: DataFrame) -> DataFrame:
    spark = manifest.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return manifest.repartition(parts, "part")


def read_tokens(manifest: DataFrame, folder: str, *, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, read from the mapped files."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int64()))] if ids else []

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        system, base = _filesystem(folder)
        for row in batch.to_pylist():
            doc_ids, _ = _docs(system, base, row["name"])
            tokens = np.frombuffer(system.open_input_file(f"{base}/{row['name']}.ids").read_buffer(), row["width"])
            offsets = np.frombuffer(system.open_input_file(f"{base}/{row['name']}.offsets").read_buffer(), "<u8").astype(np.int64)
            at = offsets - offsets[0]
            for i in range(0, len(doc_ids), 1000):
                here = at[i : min(i + 1000, len(doc_ids)) + 1]
                own = [tokens[a:b].astype("<u4") for a, b in zip(here, here[1:])]
                names = doc_ids[i : i + 1000]
                columns = [
                    pa.array(names, pa.int64(), mask=names == _NULL_ID),
                    pa.array(offsets[i : i + len(own)], pa.int64()),
                    pa.array(np.diff(here), pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                ] + ([pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))] if ids else [])
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")
    return map_arrow(_spread(manifest), one, schema)


def token_files(docs: DataFrame, folder: str, name: str = TOKENIZER) -> DataFrame:
    """Write all files of a corpus; the manifest names them."""
    return write_offsets(with_bases(write_tokens(docs, folder, name)), folder)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = token_files(read(spark, sf_dir, "documents"), folder)
    return read_tokens(manifest, folder, ids=False)


QUERIES = {"op2_token_files": op2_token_files}
