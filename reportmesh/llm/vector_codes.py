"""Vector codes: product quantisation in exact integers.

Components become integers, vectors are cut into equal parts, and each part position has a codebook.
A part goes to the nearest entry, by squared distance |x|^2 - 2 x.c + |c|^2. The dot products of a block
run as float64 matrix products over limbs: integers are broken into limbs so short that every sum of
products of two limbs stays below 2^53 and so is exact; shifted sums of them give the dot products in
int64. The first smallest distance wins, so ties go to the lower index.

Codebooks start from the smallest kept vec_ids. A round assigns all parts and replaces each entry by the
floored mean of its parts; sums and counts are added up in the tasks and then over tasks, and the driver
gets one row per entry and component, whatever the number of vectors. Errors over equal labels are summed
before they are joined back, with labels of many rows split.

Vectors that are null or hold null or non-finite components are dropped. The dimension is that of the
smallest kept vec_id whose length is a positive multiple of the parts; kept vectors of other lengths stay
as rows with a null code and error. Null vec_ids come last in the order, repeated ones are ordered by their
components; fewer vectors than entries give smaller codebooks. Rows with a null label are one label, whose
error is null if all its errors are. A component too large for exact distances fails the job (see
``largest``). An empty table gives an empty one. Columns other than vec_id, embedding and label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import lookup
from ..session import write_stage
from .frames import map_arrow, read

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of one block of distances.
_ROWS = 512


def largest(dimension: int) -> int:
    """Greatest size of a component for which all distances of whole vectors fit into 64 bits."""
    return isqrt((1 << 63) // (4 * dimension)) - 1


def _limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """float64 arrays whose sum, the k-th shifted by k * bits, is ``x``. The last one carries the sign."""
    out = []
    while len(x) and int(np.abs(x).max()) >= 1 << bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact products of (parts, n, width) with (parts, entries, width), as (parts, n, entries) in int64."""
    bits = (53 - (x.shape[2] - 1).bit_length()) // 2
    total = np.zeros((*x.shape[:2], c.shape[1]), np.int64)
    right = [limb.transpose(0, 2, 1) for limb in _limbs(c, bits)]
    for i, a in enumerate(_limbs(x, bits)):
        for j, b in enumerate(right):
            total += np.matmul(a, b).astype(np.int64) << (bits * (i + j))
    return total


def nearest(x: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the first nearest entries of (parts, n, width), and their squared distances."""
    far = (x * x).sum(2)[:, :, None] - 2 * dots(x, codebooks) + (codebooks * codebooks).sum(2)[:, None, :]
    at = far.argmin(2)
    return at, np.take_along_axis(far, at[:, :, None], 2)[:, :, 0]


def integers(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kept rows of a column of vectors: (row, start, length) and the array of floored components."""
    n = len(column)
    present = column.is_valid().to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy().astype(np.int64)
    lengths = np.where(present, np.diff(offsets), 0)
    values = column.values
    known = values.is_valid().to_numpy(zero_copy_only=False)
    numbers = values.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    bad = ~(known & np.isfinite(numbers))
    upto = np.r_[0, np.cumsum(bad)]
    kept = np.flatnonzero(present & (upto[offsets[:-1] + lengths] == upto[offsets[:-1]]))
    floats = np.floor(np.where(bad, 0.0, numbers) * SCALE)
    return kept, offsets[:-1][kept], lengths[kept], floats


def _exact(floats: np.ndarray, dimension: int) -> np.ndarray:
    if len(floats) and np.abs(floats).max() > largest(dimension):
        raise ValueError(f"a component of 1/{SCALE} steps exceeds {largest(dimension)}: distances would not fit into 64 bits")
    return floats.astype(np.int64)


def _blocks(column: pa.ListArray, dimension: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, parts of them as (parts, n, width)) of vectors of the dimension, block by block."""
    rows, starts, lengths, floats = integers(column)
    fits = lengths == dimension
    rows, starts = rows[fits], starts[fits]
    for k in range(0, len(rows), _ROWS):
        at = starts[k : k + _ROWS, None] + np.arange(dimension)
        x = _exact(floats[at], dimension).reshape(len(at), PARTS, -1).transpose(1, 0, 2)
        yield rows[k : k + _ROWS], np.ascontiguousarray(x)


def _vectors(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), *more)


def first_vectors(df: DataFrame, n: int = ENTRIES) -> list[list[float]]:
    """The floored components of the ``n`` smallest vec_ids that have the dimension."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, starts, lengths, floats = integers(batch.column("embedding"))
        ids = batch.column("vec_id").take(pa.array(rows))
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        number = ids.fill_null(0).to_numpy()
        fits = (lengths > 0) & (lengths % PARTS == 0)
        out_id, out = [], []
        for size in np.unique(lengths[fits]).tolist():
            at = np.flatnonzero(fits & (lengths == size))
            v = floats[starts[at, None] + np.arange(size)]
            order = np.lexsort((*v.T[::-1], number[at], ~known[at]))[:n]
            out_id += [int(number[k]) if known[k] else None for k in at[order].tolist()]
            out += v[order].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out, pa.list_(pa.float64()))], ["vec_id", "v"])

    found = map_arrow(_vectors(df), one, "vec_id long, v array<double>")
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    head = found.orderBy(*order).limit(1).collect()
    if not head:
        return []
    return [r.v for r in found.filter(F.size("v") == len(head[0].v)).orderBy(*order).limit(n).collect()]


def _moved(df: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    parts, entries, width = codebooks.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, width), np.int64)
        count = np.zeros(parts * entries, np.int64)
        for batch in batches:
            for _, x in _blocks(batch.column("embedding"), parts * width):
                slot = (nearest(x, codebooks)[0] + np.arange(parts)[:, None] * entries).ravel()
                np.add.at(total, slot, x.reshape(-1, width))
                count += np.bincount(slot, minlength=parts * entries)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, width).astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(used))),
             pa.array(total[used].ravel()), pa.array(np.repeat(count[used], width))],
            ["slot", "place", "total", "n"],
        )

    found = _vectors(df).drop("vec_id").mapInArrow(sums, "slot int, place int, total long, n long")
    found = found.groupBy("slot", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    moved = codebooks.copy().reshape(-1, width)
    for r in found.collect():  # as many rows as the codebooks have components
        moved[r.slot, r.place] = int(r.total) // r.n
    return moved.reshape(codebooks.shape)


def train(df: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks as (parts, entries, width); without vectors they have no entries."""
    if entries > 256:
        raise ValueError("codes have two hex digits: at most 256 entries")
    first = np.array(first_vectors(df, entries))
    if not len(first):
        return np.zeros((PARTS, 0, 1), np.int64)
    first = _exact(first, first.shape[1])
    codebooks = np.ascontiguousarray(first.reshape(len(first), PARTS, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        codebooks = _moved(df, codebooks)
    return codebooks


def encode(df: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every kept row."""
    dimension = codebooks.shape[0] * codebooks.shape[2]
    label = df.schema["label"].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column("embedding")
        code: list = [None] * len(batch)
        error: list = [None] * len(batch)
        for rows, x in _blocks(column, dimension) if codebooks.shape[1] else ():
            at, far = nearest(x, codebooks)
            text = np.ascontiguousarray(at.T.astype(np.uint8)).tobytes().hex()
            width = 2 * len(at)
            for k, (row, e) in enumerate(zip(rows.tolist(), far.sum(0).tolist())):
                code[row], error[row] = text[k * width : (k + 1) * width], e
        kept = pa.array(integers(column)[0])
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id").take(kept), batch.column("label").take(kept),
             pa.array(code, pa.string()).take(kept), pa.array(error, pa.int64()).take(kept)],
            ["vec_id", "label", "code", "error"],
        )

    return map_arrow(_vectors(df, "label"), one, f"vec_id long, label {label}, code string, error long")


def decode(code: str | None, codebooks: np.ndarray) -> np.ndarray | None:
    """The integer vector a code stands for."""
    if code is None:
        return None
    return np.concatenate([book[k] for book, k in zip(codebooks, bytes.fromhex(code))])


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with the column ``label_error``: the sum of errors over rows of equal labels."""
    keyed = coded.withColumn("_label", F.struct("label"))  # a struct's null equals another
    sums = keyed.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_rows"))
    return lookup(keyed, sums, ["_label"], spread_by="code", row_count="_rows").drop("_label", "_rows")


def digest(codebooks: np.ndarray) -> str:
    """All entries' decimal components by part, entry and place, comma-joined, as sha256."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    codebooks = train(vectors)
    coded = write_stage(encode(vectors, codebooks))[0]
    return label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


QUERIES = {"op12_vector_codes": op12_vector_codes}


def _round_sql(k: int) -> str:
    """Assignment of all parts to codebook ``k``, and the codebook after it."""
    return f"""
d{k} AS (SELECT x.r, x.p, c.k, sum((x.v - c.v) * (x.v - c.v)) AS far FROM x JOIN c{k} c USING (p, j) GROUP BY ALL),
a{k} AS (SELECT r, p, arg_min(k, (far, k)) AS k, CAST(min(far) AS BIGINT) AS far FROM d{k} GROUP BY ALL),
m{k} AS (SELECT p, k, j, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM a{k} JOIN x USING (r, p) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT p, k, j, CASE WHEN n IS NULL THEN c.v ELSE (s - ((s % n) + n) % n) // n END AS v FROM c{k} c LEFT JOIN m{k} USING (p, k, j))"""


ORACLE = {
    "op12_vector_codes": f"""
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label,
    list_transform(embedding, lambda y: CAST(floor({SCALE} * CAST(y AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
f AS (SELECT r, unnest(range(len(w))) AS i, unnest(w) AS v, len(w) // {PARTS} AS wide FROM e),
x AS MATERIALIZED (SELECT r, i // wide AS p, i % wide AS j, v FROM f),
c0 AS (SELECT p, r AS k, j, v FROM x WHERE r < {ENTRIES}),{",".join(_round_sql(k) for k in range(ROUNDS))},
d AS (SELECT x.r, x.p, c.k, sum((x.v - c.v) * (x.v - c.v)) AS far FROM x JOIN c{ROUNDS} c USING (p, j) GROUP BY ALL),
a AS (SELECT r, p, arg_min(k, (far, k)) AS k, CAST(min(far) AS BIGINT) AS far FROM d GROUP BY ALL),
coded AS (SELECT r, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error FROM a GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, k, j)) FROM c{ROUNDS}) AS codebooks_sha256
FROM e JOIN coded USING (r)"""
}
