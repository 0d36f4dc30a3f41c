"""Fill-in-the-middle order of texts, by in-place block rotation.

Two cuts, drawn from a digest of the document's id, part a text into prefix, middle and suffix. Sentinels
are inserted at the cuts of a bytearray,

    <P> prefix <M> middle <S> suffix

and two neighbouring blocks then change places by three reversals: the blocks of middle and suffix give
the order prefix, suffix, middle (psm), the blocks before and after ``<S>`` give suffix, prefix, middle
(spm). Restoring finds the sentinels, runs the inverse rotation and takes them out again; it needs the
output and its form only, and returns the exact text.

A text that holds a sentinel, an empty or null one, and a drawn share of all texts stay plain. Cuts are
places between code points, found by one scan of the bytes in pieces; a text is held once, beside half of
the segment being reversed. Every row is changed by itself: rows that repeat an id and a text have equal
results, a null doc_id is drawn as an id without digits, an empty table gives an empty one. Columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import documents, map_arrow, read

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = "1"
#: Shares in percent: texts left plain, and suffix-first forms among the others.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
_SCAN = 1 << 20


def rotate(block: bytearray, start: int, cut: int, end: int) -> None:
    """Exchange block[start:cut] and block[cut:end] in place."""
    for i, j in ((start, cut), (cut, end), (start, end)):
        half = (j - i) // 2
        left = block[i : i + half]
        block[i : i + half] = block[j - half : j][::-1]
        block[j - half : j] = left[::-1]


def _leads(raw: bytes, at: int) -> np.ndarray:
    """Flags of the bytes that begin a code point, in one piece of the scan."""
    return (np.frombuffer(raw, np.uint8, min(_SCAN, len(raw) - at), at) & 0xC0) != 0x80


def code_points(raw: bytes) -> int:
    if raw.isascii():
        return len(raw)
    return sum(int(np.count_nonzero(_leads(raw, at))) for at in range(0, len(raw), _SCAN))


def byte_place(raw: bytes, k: int, n: int) -> int:
    """Byte at which code point ``k`` of ``n`` begins; the end for k = n."""
    if n == len(raw) or k == 0:
        return k
    if k == n:
        return len(raw)
    for at in range(0, len(raw), _SCAN):
        leads = _leads(raw, at)
        here = int(np.count_nonzero(leads))
        if k < here:
            return at + int(np.flatnonzero(leads)[k])
        k -= here
    raise ValueError("not that many code points")


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4)]


def arranged(raw: bytes, drawn: list[int], plain: int, spm: int) -> tuple[bytes, str, int, int | None, int | None]:
    """(output, form, code points, of the prefix, of the middle) of one text."""
    n = code_points(raw)
    if not raw or drawn[2] % 100 >= 100 - plain or any(s in raw for s in (PREFIX, SUFFIX, MIDDLE)):
        return raw, "plain", n, None, None
    first, second = sorted((drawn[0] % (n + 1), drawn[1] % (n + 1)))
    a, b = byte_place(raw, first, n), byte_place(raw, second, n)
    block = bytearray(raw)
    block[b:b] = SUFFIX
    block[a:a] = MIDDLE
    block[0:0] = PREFIX
    middle, suffix = a + len(PREFIX), b + len(PREFIX) + len(MIDDLE)
    form = "spm" if drawn[3] % 100 < spm else "psm"
    rotate(block, 0 if form == "spm" else middle, suffix, len(block))
    return bytes(block), form, n, first, second - first


def restored(raw: bytes, form: str) -> bytes:
    """The text whose output in this form is ``raw``."""
    if form == "plain":
        return raw
    block = bytearray(raw)
    start, cut = (0, block.index(PREFIX)) if form == "spm" else (block.index(SUFFIX), block.index(MIDDLE))
    rotate(block, start, cut, len(block))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = block.index(sentinel)
        del block[at : at + len(sentinel)]
    return bytes(block)


def _raw(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def _text(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def fill_in_middle(
    docs: DataFrame, seed: str = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("doc_id")
        found = [
            arranged(raw, draws(doc_id, seed), plain_percent, spm_percent)
            for raw, doc_id in zip(_raw(batch.column("text")), ids.to_pylist())
        ]
        output, form, n, prefix, middle = zip(*found)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), _text(list(output))],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )

    return map_arrow(documents(docs), one, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(outputs: DataFrame) -> DataFrame:
    """``outputs`` with the column ``restored``: the text rebuilt from output and form."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        forms = batch.column("form").to_pylist()
        texts = [restored(raw, form) for raw, form in zip(_raw(batch.column("output")), forms)]
        yield pa.RecordBatch.from_arrays([*batch.columns, _text(texts)], [*batch.schema.names, "restored"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outputs.schema)
    return map_arrow(outputs, one, f"{kinds}, restored string")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return restore(fill_in_middle(read(spark, sf_dir, "documents"))).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored")
    )


QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}

ORACLE = {
    "op13_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
  CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
s AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM s"""
}
